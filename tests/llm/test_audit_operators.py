"""Hard negatives, URL verdicts and the divergence of sources, against brute force."""

import re
from collections import Counter, defaultdict
from math import isfinite

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eigenspark.llm import divergence, negatives, queries, urls

VECTORS = "vec_id long, embedding array<double>, label int"


def vector_table(spark, rows, clash=False):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    for c in ("score", "cell", "anchor", "place", "id", "rank", "b", "v") if clash else ():
        df = df.withColumn(c, F.lit(c))
    return df


def plain_negatives(rows, every=100, positives=5, k=10, low=30, high=90):
    rows = [(i, [int(np.floor(256 * x)) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    out, seen = [], set()
    for i, a, c in rows:
        if i % every or (i, tuple(a), c) in seen:
            continue
        seen.add((i, tuple(a), c))
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), j, d) for j, b, d in rows if j != i)
        for p, j, _ in [s for s in scored if s[2] == c][:positives]:
            fit = [(n, m) for n, m, d in scored if d != c and low * -p <= 100 * -n <= high * -p][:k]
            out += [(i, j, r + 1, m, -p, -n) for r, (n, m) in enumerate(fit)]
    return sorted(out)


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(31)
    rows = [(i, (rng.normal(size=6) + 0.6).tolist(), int(rng.integers(4)) if rng.random() < 0.6 else 7) for i in range(900)]
    rows += [(900 + i, rows[100][1], 7) for i in range(60)] + [(1000, [], 2), (1001, [1.0], 2), (1100, [0.0] * 6, 3)]
    rows += [(200, rows[200][1], rows[200][2])] * 2 + [(200, rows[3][1], 7), (-300, rows[8][1], 1)]  # repeated ids
    rows += [(None, [1.0] * 6, 1), (2000, None, 1), (2100, [None] * 6, 1), (2200, [float("nan")] * 6, 1), (2300, [float("inf")] * 6, 1), (2400, [1.0] * 6, None)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 90, "LEAST": 10, "ANCHORS": 2, "BLOCKS": 3}, {"BUCKETS": 2, "LEAST": 10, "BLOCK": 200}])
def test_negatives_match_brute_force(spark, labelled, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(negatives, name, value)
    got = sorted(map(tuple, negatives.hard_negatives(vector_table(spark, labelled, clash=True)).collect()))
    assert got == plain_negatives(labelled) and len(got) > 300


@pytest.mark.parametrize("size", [3e2, 3e5, 2e6])
def test_negatives_of_large_components(spark, labelled, size):
    rows = [(i, (np.array(v) * size).tolist(), c) for i, v, c in labelled if v is not None and None not in v][:300]
    assert sorted(map(tuple, negatives.hard_negatives(vector_table(spark, rows)).collect())) == plain_negatives(rows)


def test_negatives_of_little(spark, labelled):
    df = vector_table(spark, labelled)
    assert negatives.hard_negatives(df.limit(0)).count() == 0
    for some in ("vec_id = 100", "vec_id in (100, 2400, 2000)", "label = 7", "vec_id % 100 <> 0"):
        assert negatives.hard_negatives(df.where(some)).count() == 0
    with pytest.raises(Exception, match="64-bit"):
        negatives.hard_negatives(vector_table(spark, [(0, [1e10], 1), (1, [1e10], 1)])).collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-9, 9), max_size=30), st.integers(-12, 12), st.integers(1, 5), st.sampled_from([int, object]))
def test_limits_by_binary_search(scores, positive, k, kind):
    falling = np.array(sorted(scores, reverse=True), kind)
    first, last = negatives.within_limits(falling, positive, 30, 90, k)
    assert list(falling[first:last]) == [s for s in falling if 30 * positive <= 100 * s <= 90 * positive][:k]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(2**50), 2**50) | st.integers(-3, 3), max_size=40))
def test_full_order(scores):
    s = np.array(scores, np.int64)
    want = sorted(range(len(s)), key=lambda i: (-scores[i], i))
    assert list(negatives.full_order(s, np.arange(len(s)))) == want == list(negatives.full_order(s.astype(object), np.arange(len(s))))


PAGES = "page_id long, url string, html string"
RULES = [("org", "/", "allow"), ("Example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def plain_canonical(url):
    site, path = split_url(url)
    site = re.sub(r":(80|443)?\Z", "", re.sub(r"^www\.", "", site))
    if not site:
        return None
    asked = url.split("://", 1)[1].split("#")[0].partition("?")[2]
    asked = sorted(p for p in asked.split("&") if p and not re.match("utm_|gclid=|fbclid=|ref=", p))
    return site + re.sub(r"/+\Z", "", path) + ("?" + "&".join(asked) if asked else "")


def plain_verdict(url, listed, rules=RULES):
    site, path = split_url(url)
    fits = [(len(h + p), len(h), h.lower() + p, v) for h, p, v in rules if (site == h.lower() or site.endswith("." + h.lower())) and path.startswith(p)]
    if fits:
        return site, path, *max(fits)[2:]
    return site, path, None, "block" if plain_canonical(url) in listed else "allow"


@pytest.fixture(scope="module")
def addresses():
    rng = np.random.default_rng(32)
    out = [None, "", "no scheme/a", "://", "x://", "http://a://b", "HTTP://WWW.Example.ORG:80/es/?b=2&a=1&utm_x=3#f", "http://org", "http://org/", "http://norg/", "http://exämple.net/ÄÖ", "http://a.net/\n/x?q#z", "ftp://u:p@b.net/", "http://e.net?x", "http://e.net#/y", "http://" + "l" * 30_000 + ".net/" + "p" * 30_000]
    for _ in range(1500):
        site = str(rng.choice(["example.org", "m.example.org", "a.com", "b.a.com", "c.net", "www.c.net", "d.net"]))
        tail = str(rng.choice(["", "/", "?utm_a=1", "?b=1&a=2", "?a=2&b=1", "#x", "?ref=y"]))
        out.append(f"{rng.choice(['http', 'https'])}://{site}/{rng.choice(['fr', 'de', 'es', 'en'])}/{rng.integers(30)}{tail}")
    return out + ["http://hot.net/x"] * 900


@pytest.mark.parametrize("limit", [None, 0])
def test_urls_match_brute_force(spark, addresses, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(urls, "BLOCKS", limit)  # the filter is joined by block
    some = ["http://c.net/fr/3", "https://www.d.net/en/7/?b=1&a=2", "http://hot.net/x", "http://a.com/fr/1", None, "nothing", "http://exämple.net/ÄÖ/", *[f"http://d.net/de/{k}" for k in range(9)], *[f"http://other{k}.net/" for k in range(400)]]
    listed = {plain_canonical(u) for u in some} - {None}
    pages = spark.createDataFrame([(i if i % 9 else None, u, "") for i, u in enumerate(addresses)], PAGES).repartition(3)
    pages = pages.select("*", *[F.lit(1).alias(c) for c in ("_maybe", "host", "rule", "w0")])
    got = urls.judged(pages, spark.createDataFrame([(u,) for u in some], "url string"), RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(i if i % 9 else None, *plain_verdict(u, listed)) for i, u in enumerate(addresses)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and sum(w[4] == "block" for w in want) > 900


def test_urls_of_nothing(spark, addresses):
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(addresses[:60])], PAGES)
    none = pages.limit(0)
    assert urls.judged(none, pages).count() == 0 and urls.judged(pages, none).where("verdict = 'block' or rule is not null").count() == 0
    with pytest.raises(ValueError):
        urls.ruled(F.lit(""), F.lit(""), [(f"h{k}", "/", "block") for k in range(urls.RULES + 1)])


def test_filter_passes_all_listed_and_few_others(spark):
    listed = spark.range(20_000).select(F.format_string("http://h%d.net/", "id").alias("url"))
    others = spark.range(20_000, 120_000).select(F.format_string("http://h%d.net/", "id").alias("url"))
    assert urls.false_positives(listed, listed).first().unlisted == 0
    assert urls.judged(listed.withColumn("page_id", F.lit(1)), listed).where("verdict <> 'block'").count() == 0
    found = urls.false_positives(others, listed).first()
    assert found.unlisted == 100_000 and found.passed < 200


def test_url_query_stays_in_the_jvm(spark, small):
    plan = queries.op12_url_filters(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


DOCS = "doc_id long, text string, lang string, source string"


def plain_audit(rows, least=10, terms=10):
    """rows: (text, lang, source)."""
    docs = [(g or "", s or "", [re.sub("[A-Z]", lambda c: c[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for t, g, s in rows]
    out = []
    for g in {d[0] for d in docs}:
        df = Counter(w for lang, _, own in docs if lang == g for w in set(own))
        kept = sorted(w for w, n in df.items() if n >= least)
        count = defaultdict(Counter)
        for lang, s, own in docs:
            if lang == g:
                count[s].update(w for w in own if df[w] >= least)
        whole = Counter()
        for c in list(count.values()):
            whole.update(c)
        share = lambda c, w: 1 + 10**9 * (c[w] + 2) // (c.total() + 2 * len(kept))  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in count:
            pairs = [(-sum(f(share(count[s], w), share(count[o], w)) for w in kept), o) for o in count if o != s]
            out += [(g, s, "pair", o, -v, r + 1) for r, (v, o) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())))]
            own = [(-f(share(count[s], w), share(whole, w)), w) for w in kept if count[s][w] and share(count[s], w) > share(whole, w)]
            out += [(g, s, "term", w, -v, r + 1) for r, (v, w) in enumerate(sorted(own, key=lambda x: (x[0], x[1].encode()))[:terms])]
    return sorted(out)


@pytest.fixture(scope="module")
def sourced():
    rng = np.random.default_rng(33)
    names = [chr(97 + k) * 2 + "é" * (k % 3) for k in range(26)] + ["ÀB", "The", "the", "漢字"]
    weights = {s: rng.dirichlet(np.ones(len(names)) * 0.4) for s in "abcdefg"}
    rows = []
    for _ in range(500):
        s = "a" if rng.random() < 0.4 else str(rng.choice(list("abcdefg")))
        rows.append((" 1,".join(rng.choice(names, int(rng.integers(0, 12)), p=weights[s]).tolist()), str(rng.choice(["en", "de"])), s))
    rows += [(None, "en", "quiet"), ("", "en", None), ("aa bb", None, "x"), ("one two", None, "y"), ("aa " * 20_000, "en", "b"), (" ".join(names) * 3, "de", "a")] + [("Aa bb cc", "fr", "s")] * 40
    return rows


@pytest.mark.parametrize("sizes", [{}, {"PIECE": 200, "GATHERED": 60, "KEPT": 20}, {"TILE": 2, "TILES": 2, "AT_ONCE": 8}, {"GROUPS": 3}])
def test_divergence_matches_brute_force(spark, sourced, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame([(i % 50 if i % 11 else None, *r) for i, r in enumerate(sourced)], DOCS).repartition(3)
    for c in ("term", "n", "docs", "value", "item", "wave", "i", "j"):
        docs = docs.withColumn(c, F.lit(c))
    got = divergence.audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(sourced)


def test_divergence_in_small_batches(spark, sourced):
    """Runs go on from batch to batch."""
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(sourced)], DOCS).repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(map(tuple, divergence.audit(docs).collect())) == plain_audit(sourced)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_divergence_of_little(spark, sourced):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(sourced[:8])], DOCS)
    assert divergence.audit(docs.limit(0)).count() == 0
    got = divergence.audit(docs)  # no term in 10 documents
    assert {r.value for r in got.collect()} == {0} and sorted(map(tuple, got.collect())) == plain_audit(sourced[:8])


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**12), st.integers(1, 10**15))
def test_shares_are_exact(count, more):
    whole = count + 2 + more
    assert divergence.shares(np.array([count]), np.array([whole]))[0] == 1 + 10**9 * (count + 2) // whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbB é.\n1", max_size=30), min_size=1, max_size=6), st.integers(1, 9))
def test_runs_of_a_slice(texts, size):
    raw, groups = [t.encode() for t in texts], np.arange(len(texts)) % 2
    want = Counter()
    for t, g in zip(texts, groups, strict=True):
        for w, n in Counter(re.sub("[A-Z]", lambda c: c[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)).items():
            want[g, w.encode(), "docs"] += 1
            want[g, w.encode(), "n"] += n
    got = divergence.term_runs(raw, groups).to_pylist()
    assert {(r["group"], r["term"], c): r[c] for r in got for c in ("docs", "n")} == want and len(got) * 2 == len(want)
    for t in raw:
        assert b"".join(divergence.pieces(t, size)) == t
        one = pa.concat_tables([divergence.term_runs([p], groups[:1]) for p in divergence.pieces(t, size)])
        whole = divergence.term_runs([t], groups[:1])
        assert Counter({(r["term"]): 0 for r in whole.to_pylist()}).keys() == {r["term"] for r in one.to_pylist()} and sum(one["n"].to_pylist()) == sum(whole["n"].to_pylist())
