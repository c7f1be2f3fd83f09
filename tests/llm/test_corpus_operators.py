"""Near and substring dedup, packing, sharding, quality rules, search and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import exp, lgamma, log, log1p

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from eigenspark.llm import checks, nearest, neardup, packing, quality, queries, sharding, substrings

ODD = [None, "", " \n ", "a b c", "a b c", "A, b c!", "!!!", "???", "漢 字 é", "x" * 20_000]


def edited(rng, text, n):
    w = text.split()
    for k in rng.integers(0, len(w), n):
        w[k] = f"e{rng.integers(1 << 30)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies(random_words):
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(25):
        base = random_words(rng, int(rng.integers(60, 400)))
        texts += [base, *(edited(rng, base, int(n)) for n in rng.integers(0, 9, 6))]
    star = random_words(rng, 150)
    texts += [edited(rng, star, int(n)) for n in rng.integers(1, 8, 90)]
    texts += [" ".join(["spam ham eggs"] * 40 + random_words(rng, 20).split()) for _ in range(4)]
    return texts + ODD


def word_list(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_classes(texts):
    bags = []
    for t in texts:
        w = word_list(t)
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    same = defaultdict(list)
    for i, t in enumerate(texts):
        same[tuple(word_list(t)) or (t or "")].append(i)
    for own in same.values():
        for i in own[1:]:
            up[top(i)] = top(own[0])
    first = [own[0] for own in same.values()]
    for a in first:
        for b in first:
            if a < b and bags[a].keys() & bags[b].keys():
                x, y = bags[a], bags[b]
                w, v = x.total(), y.total()
                if sum(min(x[d] / w, y[d] / v) for d in x.keys() & y.keys()) < 0.79:
                    continue  # each term of the similarity is at most this
                both = x.keys() | y.keys()
                if sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in both) for d in x.keys() & y.keys()) >= 0.8 - 1e-9:
                    up[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for i in range(len(texts)):
        least[top(i)] = min(i, least.get(top(i), i))
    return {i: least[top(i)] for i in range(len(texts))}


@pytest.fixture(scope="module")
def expected(copies):
    return plain_classes(copies)


def test_near_classes_match_brute_force(spark, make_docs, copies, expected):
    docs = make_docs(copies, clash=True)
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == expected
    kept = neardup.kept(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_near_classes_in_parts(spark, make_docs, copies, expected, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 40)
    got = {r.doc_id: r.class_id for r in neardup.classes(make_docs(copies)).collect()}
    assert got == expected


@pytest.mark.parametrize("limit", [{"PART": 20}, {"PART_BYTES": 90_000}])
def test_near_classes_of_large_buckets_are_whole(spark, make_docs, random_words, monkeypatch, limit):
    """Many texts of one template, 0.7 to 0.79 alike, in twins of 0.82: only a comparison of all finds each twin."""
    rng = np.random.default_rng(14)
    base = random_words(rng, 600).split()
    texts = []
    for _ in range(40):
        places = 6 * rng.permutation(99)[:22] + 3
        for n in (10, 22):
            w = list(base)
            for k in places[:n]:
                w[k] = f"e{rng.integers(1 << 30)}" if n == 10 or k not in places[:10] else texts[-1].split()[k]
            texts.append(" ".join(w))
    whole = neardup.sketched
    monkeypatch.setattr(neardup, "sketched", lambda docs: whole(docs).withColumn("bands", F.array(F.lit(7).cast("long"))))  # all meet in one bucket
    for name, value in limit.items():
        monkeypatch.setattr(neardup, name, value)
    got = {r.doc_id: r.class_id for r in neardup.classes(make_docs(texts)).collect()}
    grams = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    alike = {(i, j) for i in range(80) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])}
    assert alike == {(i, i - 1) for i in range(1, 80, 2)} and got == {i: i - i % 2 for i in range(80)}


def test_components_of_long_chains(spark, make_docs):
    ids = np.random.default_rng(15).permutation(1000).tolist()
    links = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)) + [(2000, 2001)], "a long, b long")
    assert {r.id: r.root for r in neardup.components(links).collect()} == {**dict.fromkeys(ids, 0), 2000: 2000, 2001: 2000}


def test_near_repeated_and_null_ids(spark, make_docs):
    t = "one two three four five six seven"
    docs = make_docs([(1, t, "en"), (1, t, "en"), (2, t, "en"), (None, t, "en"), (None, t, "en"), (3, "other words are here now", "en")])
    assert sorted((r.doc_id, r.class_id) for r in neardup.classes(docs).where("doc_id is not null").collect()) == [(1, 1), (1, 1), (2, 1), (3, 3)]
    assert sorted(str(r.doc_id) for r in neardup.kept(docs).collect()) == ["1", "3", "None", "None"]
    assert neardup.classes(make_docs([])).count() == 0 and neardup.kept(make_docs([])).count() == 0


def test_ids_with_several_texts(spark, make_docs, random_words):
    """Links are those of the texts, whichever row of an id comes first."""
    rng = np.random.default_rng(27)
    for _ in range(3):
        a, b, c = (random_words(rng, 80) for _ in range(3))
        rows = [(5, a, "en"), (5, b, "en"), (7, c, "en"), (9, edited(rng, b, 1), "en"), (11, edited(rng, a, 1), "en"), (12, b, "en")]
        for some in (rows, rows[::-1]):
            assert dict(sorted(map(tuple, neardup.classes(make_docs(some).coalesce(1)).collect()))) == {5: 5, 7: 7, 9: 5, 11: 5, 12: 5}
    bases = [random_words(rng, 60) for _ in range(12)]
    rows = [(int(i), edited(rng, bases[k], int(n)), "en") for i, k, n in zip(rng.integers(20, 60, 90), rng.integers(0, 12, 90), rng.integers(0, 3, 90), strict=True)]
    of = plain_classes([t for _, t, _ in rows])
    least = defaultdict(lambda: 10**9)
    for k, (i, _, _) in enumerate(rows):
        least[of[k]] = min(least[of[k]], i)
    want = defaultdict(lambda: 10**9)
    for k, (i, _, _) in enumerate(rows):
        want[i] = min(want[i], least[of[k]])
    assert {r.doc_id: r.class_id for r in neardup.classes(make_docs(rows)).collect()} == want


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(0, 12), st.integers(1, 5), min_size=1), st.dictionaries(st.integers(0, 12), st.integers(1, 5), min_size=1))
def test_likeness_and_its_estimate(a, b):
    pack = lambda x: (np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)]))
    both = a.keys() | b.keys()
    want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in both) for d in a.keys() & b.keys())
    (x, w), (y, v) = pack(a), pack(b)
    assert neardup.likeness(x, w, y, v) == pytest.approx(want)
    registers = neardup.prob_min_hash(neardup.mix(np.concatenate([x, y]) + np.uint64(1)), np.repeat([0, 1], [len(x), len(y)]), np.concatenate([w, v]), 2, 2048)
    assert (registers[0] == registers[1]).mean() == pytest.approx(want, abs=0.08)


def plain_removal(rows):
    """rows: (doc_id, text)."""
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out)


def test_substrings_match_brute_force(spark, make_docs, random_words, monkeypatch):
    rng = np.random.default_rng(7)
    shared = [random_words(rng, int(n)) for n in (12, 13, 14, 40, 90)]
    texts = [" ".join([random_words(rng, int(rng.integers(0, 40))), str(rng.choice(shared)), random_words(rng, 5), str(rng.choice(shared))]) for _ in range(120)]
    texts += ["a b " * 200, "a b " * 90, "  lead\n\ttail  ", *ODD, *texts[:5]]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[9] + " more")]
    docs = make_docs([(i, t, "en") for i, t in rows], clash=True)
    want = plain_removal(rows)
    assert sorted(map(tuple, substrings.digests(docs).collect())) == want
    monkeypatch.setattr(substrings, "SLICE", 5000)
    for limit, levels in ((60_000, 0), (14_000, 2), (200, 3)):  # more and longer prefixes are lengthened, at last whole windows
        monkeypatch.setattr(substrings, "GROUP_BYTES", limit)
        assert len(substrings.long_prefixes(docs)) == levels
        assert sorted(map(tuple, substrings.digests(docs).collect())) == want
    cut = substrings.deduplicated(docs)
    assert cut.columns == docs.columns
    assert sorted((r.doc_id, len((r.text or "").split())) for r in cut.collect() if r.doc_id != 3) == sorted((i, n - g) for i, n, g, _ in want if i != 3)


def plain_nodes(ids, depth):
    """Depth and places of every maximal set of two or more suffixes that share at least `depth` elements, from all pairs."""
    def common(i, j):
        n = 0
        while max(i, j) + n < len(ids) and ids[i + n] == ids[j + n]:
            n += 1
        return n

    out = set()
    for i in range(len(ids)):
        for j in range(i):
            d = common(i, j)
            if d >= depth:
                out.add((d, tuple(k for k in range(len(ids)) if common(i, k) >= d)))
    return out


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=30), st.integers(1, 4))
def test_suffix_array_and_its_nodes(ids, depth):
    order, common = substrings.suffix_array(np.array(ids), 40)
    assert [ids[i:] for i in order] == sorted(ids[i:] for i in range(len(ids)))
    found = {(d, tuple(sorted(order[a : b + 1].tolist()))) for d, a, b in substrings.internal_nodes(common, depth)}
    assert found == plain_nodes(ids, depth)
    # told apart by a few elements only, common prefixes up to that are exact
    few, short = substrings.suffix_array(np.array(ids), depth)
    cut = [next((n for n in range(depth) if max(i, j) + n >= len(ids) or ids[i + n] != ids[j + n]), depth) for i, j in zip(few[1:], few, strict=False)]
    assert [min(c, depth) for c in short[1:].tolist()] == cut


def test_maximal_repeats_match_brute_force(spark, make_docs, random_words, monkeypatch):
    rng = np.random.default_rng(30)
    shared = [random_words(rng, int(n)) for n in (12, 13, 20, 60)]
    rows = [(i, " ".join([random_words(rng, int(rng.integers(0, 20))), str(rng.choice(shared)), random_words(rng, 3), str(rng.choice(shared))]), "en") for i in range(60)] + [(60, "a b " * 60, "en"), (61, "a b " * 40, "en")]
    first, want = {}, []
    for i, t, _ in rows:
        w = t.split()
        again = [first.setdefault(tuple(w[k : k + 13]), i) < i for k in range(len(w) - 12)]
        k = 0
        while k < len(again):
            n = next((j for j in range(k, len(again)) if not again[j]), len(again)) - k
            want += [(i, k, n + 12)] if n else []
            k += n + 1
    for limit in (substrings.GROUP_BYTES, 300):
        monkeypatch.setattr(substrings, "GROUP_BYTES", limit)
        assert sorted(map(tuple, substrings.maximal_repeats(make_docs(rows)).collect())) == sorted(want) and max(n for _, _, n in want) >= 60


def test_substring_sift_across_batches(make_docs, monkeypatch, spark):
    docs = make_docs(["p " + " ".join(f"k{j}" for j in range(30))] * 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = sorted(map(tuple, substrings.digests(docs).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [g[2] for g in got] == [0] + [31] * 39


def test_substrings_of_nothing_and_null_ids(spark, make_docs):
    assert substrings.digests(make_docs([])).count() == 0
    t = " ".join(f"k{j}" for j in range(20))
    got = [tuple(r)[:3] for r in substrings.digests(make_docs([(None, t, "en"), (None, t, "en"), (4, t, "en")])).collect()]
    assert sorted(got, key=str) == [(4, 20, 0), (None, 20, 0), (None, 20, 0)]
    assert substrings.cut("  a b\n\nc d e", [{"start": 1, "n": 1}], 2) == "  a d e"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_packing_fits(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, sizes, total = packing.packed_group(lengths, (16, 32, 64))
    used = Counter()
    for k, n in zip(bins, lengths, strict=True):
        used[k] += n
    assert all(used[k] <= s and s in (16, 32, 64) and (s == 16 or used[k] > s // 2) for k, s in enumerate(sizes))
    alone = sum(packing.cost(next(s for s in (16, 32, 64) if n <= s)) for n in lengths)
    assert total <= alone + 1e-9 and total == pytest.approx(sum(map(packing.cost, sizes)))


def test_packing_query(spark, make_docs, random_words):
    rng = np.random.default_rng(8)
    texts = [random_words(rng, int(n)) for n in rng.integers(1, 700, 300)] + [random_words(rng, 9500)] + ODD
    docs = make_docs(texts, clash=True)
    rows = packing.packed(docs, group=100).collect()
    per_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[r.doc_id].append(r)
        if r.bin is not None:
            bins[r.bin].append(r)
    for i, t in enumerate(texts):
        own = sorted(per_doc[i], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in own) == len((t or "").split()) and [r["first"] for r in own] == [4096 * r.piece for r in own]
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.n_tokens for x in own[:k]) for k in range(len(own))] and sum(r.n_tokens for r in own) <= own[0].bin_size
    assert sum(r.n_tokens for r in rows) / sum(own[0].bin_size for own in bins.values()) > 0.9
    assert packing.packed(make_docs([])).count() == 0


def plain_packing(lengths, sizes):
    """Best fit by looking at every open bin, for each limit of the sizes opened freely; the cheapest."""
    best = None
    for most in sizes:
        room, used, of = [], [], []
        for i, n in enumerate(lengths):
            fits = [(r, -k) for k, r in enumerate(room) if r >= n]
            if fits:
                k = max((k for k, r in enumerate(room) if r == min(fits)[0]), key=lambda k: packing_turn[k])
            else:
                each = []
                for s in [s for s in sizes if n <= s <= most] or [next(s for s in sizes if n <= s)]:
                    rest = sum(x for j, x in enumerate(lengths) if j > i and x <= s - n)
                    each.append((packing.cost(s) / min(s, n + rest), s))
                k = len(room)
                room.append(min(each)[1])
                used.append(0)
                packing_turn.append(0)
            room[k] -= n
            used[k] += n
            packing_turn[k] = i + 1  # of bins with equal room, the one touched last
            of.append(k)
        final = [next(s for s in sizes if u <= s) for u in used]
        total = sum(map(packing.cost, final))
        if best is None or total < best[2]:
            best = of, final, total
        packing_turn.clear()
    return best


packing_turn: list[int] = []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_packing_matches_a_plain_version(lengths):
    lengths = sorted(lengths, reverse=True)
    assert packing.packed_group(lengths, (16, 32, 64)) == plain_packing(lengths, (16, 32, 64))


def test_packing_does_not_depend_on_the_layout(spark, make_docs, random_words):
    rng = np.random.default_rng(25)
    rows = [(i, random_words(rng, int(n)), "en") for i, n in enumerate(rng.integers(0, 300, 400))]
    rows += [(7, "same words here", "en")] * 200 + [(None, "a b c", "en")] * 50
    docs = make_docs(rows)
    one, two = (sorted(map(str, packing.packed(docs.repartition(n), group=50).collect())) for n in (2, 5))
    assert one == two and len(one) == len(rows)
    groups = Counter(r.bin >> 24 for r in packing.packed(docs, group=50).collect() if r.bin is not None)
    assert max(groups.values()) < 3 * 50


def plain_places(rows, chosen):
    """Shard and place of rows (doc_id, size, text_crc32, virtual_slot) that are dealt out slot by slot."""
    filled, out = [0] * chosen.shards, []
    for i, size, crc, v in sorted(rows, key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[2], r[1])):
        s = chosen.shard_of[v]
        out.append((i, size, crc, v, s, filled[s]))
        filled[s] += 1
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [500_000, 40])
def test_sharding(spark, make_docs, random_words, monkeypatch, rows):
    monkeypatch.setattr(sharding, "ROWS", rows)
    rng = np.random.default_rng(9)
    hot, warm = "hot text " * 3, "warm text"
    texts = [random_words(rng, int(n)) for n in rng.integers(1, 60, 3000)] + [hot] * 2500 + [warm] * 400 + ["cold copy of some words"] * 3 + ODD
    docs = make_docs([*((i, t, "en") for i, t in enumerate(texts)), (5, texts[5], "en"), (5, "another", "en"), (None, warm, "en"), (None, None, "en")], clash=True)
    texts += [texts[5], "another", warm, None]
    out, chosen, weights = sharding.shard_rows(docs)
    found = out.collect()
    assert len(found) == len(texts) and {r.law for r in found} == {"bytes"} and {r.grown_shard for r in found} == {None} and {r.map_version for r in found} == {1}
    size, slots, by_slot = Counter(), defaultdict(list), Counter()
    for r in found:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        by_slot[r.virtual_slot] += r.size
    raw = [(t or "").encode() for t in texts]
    assert sorted((r.size, r.text_crc32) for r in found) == sorted((len(t) + 1, zlib.crc32(t)) for t in raw)
    assert [by_slot[v] for v in range(4096)] == weights and chosen == sharding.even_map(weights, 16)
    if rows > 40:
        own = [(r.doc_id, r.size, r.text_crc32, r.virtual_slot) for r in found]
        assert sorted(((*x, r.shard, r.slot) for x, r in zip(own, found, strict=True)), key=str) == plain_places(own, chosen)
    assert max(size.values()) < 1.1 * sum(size.values()) / 16 and len(size) == 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    of = defaultdict(set)
    for r in found:
        of[r.text_crc32, r.size].add(r.shard)
    assert {k for k, s in of.items() if len(s) > 1} == {(zlib.crc32(hot.encode()), len(hot) + 1)}  # over a sixteenth of all bytes
    grown = sharding.rebalanced(chosen, weights, 17)
    moved = [v for v, (a, b) in enumerate(zip(chosen.shard_of, grown.shard_of, strict=True)) if a != b]
    assert moved and all(grown.shard_of[v] == 16 for v in moved) and grown.version == 2
    fewer = sharding.rebalanced(chosen, weights, 11)
    load = Counter()
    for v, s in enumerate(fewer.shard_of):
        load[s] += weights[v]
    assert set(load) == set(range(11)) and max(load.values()) < 1.2 * sum(weights) / 11
    assert sharding.shard_rows(make_docs([]))[0].count() == 0


def test_places_do_not_depend_on_the_layout(spark, make_docs, random_words, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS", 40)
    monkeypatch.setattr(sharding, "COPIES", 7)
    rng = np.random.default_rng(28)
    rows = [(i, random_words(rng, int(n)), "en") for i, n in enumerate(rng.integers(1, 30, 800))] + [(5, "hot", "en")] * 300 + [(None, "hot", "en")] * 60 + [(i, "hot", "en") for i in range(200)]
    docs = make_docs(rows)
    one, two = (sorted(map(str, sharding.shard_rows(df, slots=64)[0].collect())) for df in (docs.repartition(6), docs.orderBy(F.desc("doc_id")).coalesce(1)))
    assert one == two and len(one) == len(rows)


def test_shard_maps_are_stored_by_version(spark, make_docs, random_words, tmp_path):
    one = sharding.even_map([5, 1, 1, 3], 2)
    two = sharding.rebalanced(one, [5, 1, 1, 30])
    empty = sharding.SlotMap(3, 9, (0, 0, 1, 1))
    for m in (one, two, empty):
        m.save(spark, str(tmp_path / "maps"))
    load = sharding.SlotMap.load
    assert load(spark, str(tmp_path / "maps")) == empty and load(spark, str(tmp_path / "maps"), 1) == one and load(spark, str(tmp_path / "maps"), 2) == two
    docs = make_docs([random_words(np.random.default_rng(19), 20) for _ in range(300)])
    _, first, weights = sharding.shard_rows(docs, 4, 64, str(tmp_path / "own"))
    rows, second, _ = sharding.shard_rows(docs, 5, 64, str(tmp_path / "own"))
    assert second == sharding.rebalanced(first, weights, 5) and {r.map_version for r in rows.collect()} == {2}


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_counts_match_brute_force(spark, make_docs, random_words):
    rng = np.random.default_rng(10)
    texts = [random_words(rng, int(n), 12) for n in rng.integers(0, 90, 60)] + ["a b c a b c a b c", "x\ny\nx\n\n\nx", "#|<> $$ *", "a a a a", *ODD]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality.judged(make_docs(texts, clash=True), labels).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == plain_counts(texts[r.doc_id])
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0]) and r.kept == (not r.base_failed)
    assert quality.judged(make_docs([]), labels).count() == 0
    twice = quality.judged(make_docs([(1, texts[0], "en"), (1, texts[0], "en"), (None, texts[0], None), (2, "a b " * 9000, None)]), spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")).collect()
    assert sorted(str(r.doc_id) for r in twice) == ["1", "1", "2", "None"] and {r.n_repeat_words for r in twice if r.doc_id == 2} == {18_000}


def test_quality_cutoffs_keep_their_promise(spark, make_docs, random_words):
    rng = np.random.default_rng(11)
    good = [random_words(rng, 80) for _ in range(2000)]
    bad = [" ".join(w + "###" for w in random_words(rng, 80).split()) for _ in range(200)]
    docs = make_docs([(i, t, "en") for i, t in enumerate(good + bad)])
    labels = spark.createDataFrame([(i, int(i < 2000), 0) for i in range(2200)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.judged(docs, labels).collect()}
    assert all(kept[i] for i in range(2000)) and not any(kept[i] for i in range(2000, 2200))
    few = quality.judged(docs, labels.where("doc_id % 30 = 0"))
    assert few.where("not kept and not base_failed").count() == 0  # too few labels to prove anything


RULES = "doc_id long, stratum string, base_failed boolean, " + ", ".join(f"{r} double" for r in quality.CUTOFFS)


def test_quality_cutoffs_may_lose_more_than_they_catch(spark):
    value = lambda i: 0.6 if i < 10 or 20_000 <= i < 20_040 else 0.0
    rows = spark.createDataFrame([(i, "en", False, value(i), 0.0, 0.0, 0.0, 0.0) for i in range(20_080)], RULES)
    labels = spark.range(20_080).selectExpr("id doc_id", "int(id < 20000) quality")
    assert list(map(tuple, quality.cutoffs(rows, labels).collect())) == [("en", "symbol_rate", 0.5)]


def binomial_tail(k, n, p):
    if k >= n * p:
        return 1.0
    return sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1))


def plain_cutoffs(rows, learning, limit=0.02, confidence=0.95):
    """rows: (part, stratum, good, values by rule) of the labelled documents; learning: the part that orders the steps."""
    strata, out = sorted({r[1] for r in rows}), {}
    for g in strata:
        own = [r for r in rows if r[1] == g and r[0] == learning]
        good, bad = sum(r[2] for r in own), sum(not r[2] for r in own)
        pairs = []
        for rule, cuts in quality.CUTOFFS.items():
            for c in cuts:
                lost, caught = (sum(r[3][rule] > c for r in own if r[2] == kind) for kind in (True, False))
                if caught * good > lost * bad or (good == 0 and caught):
                    pairs.append((-((caught + 1) / (bad + 2) * (good + 2) / (lost + 1)), -c, rule))
        steps = [(rule, -c) for _, c, rule in sorted(pairs)]
        first = lambda r: next((i for i, (rule, c) in enumerate(steps) if r[3][rule] > c), None)
        useful = {first(r) for r in own if not r[2]}
        steps = [s for i, s in enumerate(steps) if i in useful]
        tested = [r for r in rows if r[1] == g and r[0] != learning and r[2]]
        for i, (rule, c) in enumerate(steps):
            lost = sum(first(r) is not None and first(r) <= i for r in tested)
            if not tested or binomial_tail(lost, len(tested), limit) > (1 - confidence) / len(strata):
                break
            out[g, rule] = min(c, out.get((g, rule), c))
    return out


@pytest.fixture(scope="module")
def rated():
    rng = np.random.default_rng(17)
    out = []
    for i in range(6000):
        good, g = bool(rng.random() < 0.85), str(rng.choice(["en", "de", ""]))
        values = {r: float(rng.exponential(cuts[0] / (6 if good else 1.5))) for r, cuts in quality.CUTOFFS.items()}
        out.append((i, g, good, values))
    return out


def test_quality_cutoffs_match_a_plain_version(spark, rated):
    rows = spark.createDataFrame([(i, g, False, *v.values()) for i, g, _, v in rated], RULES)
    labels = spark.createDataFrame([(i, int(good)) for i, _, good, _ in rated] + [(5, None), (None, 0), (7, 0), (7, 1)], "doc_id long, quality int")
    part = {r.id: r.p for r in spark.range(6000).select("id", F.pmod(F.xxhash64("id", F.lit("learning")), F.lit(quality.LEARNING)).alias("p")).collect()}
    want = plain_cutoffs([(part[i], g, good or i == 7, v) for i, g, good, v in rated], 0)
    assert {(r.stratum, r.rule): r.cutoff for r in quality.cutoffs(rows, labels).collect()} == want and len(want) > 3


def test_quality_risk_is_held(rated):
    """Of many holdouts, at most about one in twenty lets a stratum lose more than the limit of its good documents."""
    rng, broken = np.random.default_rng(18), 0
    values = np.array([[v[r] for r in quality.CUTOFFS] for _, _, good, v in rated if good])
    bad = np.array([[v[r] for r in quality.CUTOFFS] for _, _, good, v in rated if not good])
    truth = lambda cuts: (values > [cuts.get(("en", r), np.inf) for r in quality.CUTOFFS]).any(1).mean()
    for _ in range(60):
        x = [(int(rng.integers(4)), "en", kind, dict(zip(quality.CUTOFFS, v, strict=True))) for kind, own, n in ((True, values, 600), (False, bad, 60)) for v in own[rng.integers(0, len(own), n)]]
        broken += truth(plain_cutoffs(x, 0)) >= 0.02
    assert broken <= 7


def test_binomial_tail(spark):
    cases = [(0, 50), (1, 50), (3, 200), (7, 200), (50, 50), (0, 1), (900, 25_000), (39_000, 1_000_000)]
    for r in spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.tail(F.col("k"), F.col("n"), 0.04).alias("p")).collect():
        assert r.p == pytest.approx(binomial_tail(r.k, r.n, 0.04), rel=1e-6)


def plain_search(rows, k=5):
    dims = max((len(v) for _, v in rows), default=0)
    x = {i: [int(np.floor(256 * float(c))) for c in v] + [0] * (dims - len(v)) for i, v in rows}
    out = []
    for q in x:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x[q], x[i], strict=True)), i) for i in x if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(12)
    return [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(400 + i, [0.5] * 8) for i in range(60)] + [(500, [0.0] * 8), (600, []), (601, [3.0]), (602, [])]


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id long, embedding array<double>, label int, score double").repartition(3)


def test_search_matches_brute_force(spark, vectors):
    bad = [(501, None), (502, [None] * 8), (550, [float("nan")] * 8), (551, [float("inf")] * 8), (None, [1.0] * 8)]
    df = vector_table(spark, vectors + bad)
    for sizes in ({"cell": 90, "queries": 3}, {"pivots": 1}, {}):
        assert sorted(map(tuple, nearest.largest_products(df, **sizes).collect())) == plain_search(vectors)
    few = df.where("vec_id in (0, 1, 2, 502)")
    assert sorted(map(tuple, nearest.largest_products(few).collect())) == plain_search(vectors[:3])
    assert nearest.largest_products(df.limit(0)).count() == 0 and nearest.largest_products(df.where("vec_id = 1")).count() == 0
    assert nearest.largest_products(df.where("vec_id = 600 or vec_id = 602")).collect() == [(600, 1, 602, 0)]


@pytest.mark.parametrize("size", [3e2, 3e4, 3e5, 2e6, 3e6])
def test_search_of_large_components(spark, vectors, size):
    """Scores are exact up to the range of a long, also where they no longer fit a double."""
    rows = [(i, (np.array(v) * size).tolist()) for i, v in vectors] + [(700, [300000.0, 1.0]), (701, [300000.0, 0.0]), (702, [400000.0, 0.0])]
    assert sorted(map(tuple, nearest.largest_products(vector_table(spark, rows), cell=200).collect())) == plain_search(rows)


def test_search_refuses_what_a_long_cannot_hold(spark):
    for value in (1e60, 1e10):
        with pytest.raises(Exception, match="64-bit"):
            nearest.largest_products(vector_table(spark, [(0, [value]), (1, [value])])).collect()


def test_search_leaves_cells_out(spark):
    rng = np.random.default_rng(16)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] / np.linalg.norm(centres[i % 30]) * 3 + rng.normal(size=16) / 50).tolist()) for i in range(3000)]
    df = vector_table(spark, rows)
    assert sorted(map(tuple, nearest.largest_products(df, cell=500).collect())) == plain_search(rows)
    looked = nearest.evaluated(df, cell=500).first()
    assert looked.queries == 60 and looked.evaluated < 0.1 * 60 * 3000


def test_search_sends_candidates_where_they_are_wanted(spark, monkeypatch):
    """The rows that travel follow the visits: a cell that no query visits isn't sent, and others only to the blocks of their queries."""
    rng = np.random.default_rng(29)
    centres = rng.normal(size=(40, 16)) * 3
    rows = [(i, (centres[i % 40] + rng.normal(size=16) / 50).tolist()) for i in range(4000)]
    df, travelled, whole = vector_table(spark, rows), [], nearest.wanted_only

    def counted(candidates, *how):
        out = whole(candidates, *how)
        travelled.append((out.count(), candidates.count()))
        return out

    monkeypatch.setattr(nearest, "wanted_only", counted)
    assert sorted(map(tuple, nearest.largest_products(df, cell=100, queries=20).collect())) == plain_search(rows)
    down = 4000 // 50 // 20
    assert len(travelled) == 2 and all(sent < 0.6 * down * own for sent, own in travelled)


def test_search_stops_early():
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(20, 16)) * 300
    x = np.floor(np.repeat(centres, 200, 0) + rng.normal(size=(4000, 16)) * 5)
    radius = float((x**2).sum(1).max())
    points = nearest.spread_out(nearest.lifted(x, radius), 32)
    far = nearest.distances(nearest.lifted(x, radius), points).T.astype(np.float32)
    q = x[7]
    ids, score, looked = nearest.search(q, 7, nearest.distances(np.append(q, 0.0)[None], points)[0], float(q @ q) + radius, np.arange(4000), x, far, 5)
    want = np.lexsort((np.arange(4000), -(x @ q)))
    assert list(ids) == [i for i in want if i != 7][:5] and looked < 2000


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL | checks.SQL))
def test_same_rows_as_sql(spark, compare, name):
    compare(spark, (queries.QUERIES | checks.QUERIES)[name], (queries.ORACLE_SQL | checks.SQL)[name])


def test_language_stage_without_labels(spark, make_docs):
    docs = make_docs([(i, t, None) for i, t in enumerate([*ODD, "the house of the green water"])])
    out = corpus_pipeline.identify_language(spark, docs, "")
    want = [i for i, t in enumerate([*ODD, "x"]) if t and any(map(str.isalpha, t))]
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == want


def test_language_stage_carries_the_language_found(spark, make_docs):
    """Rows without a lang or with a wrong one (1004, which nothing is learned from) get the language of their text; nothing but lang changes."""
    own = {"en": "the of and is that was house green water", "de": "der und ist nicht das haus wasser über grün", "fr": "le et est dans que maison eau très vert"}
    rng = np.random.default_rng(8)
    text = lambda v: " ".join(rng.choice(own[v].split(), 25))
    rows = [(i, text(v), v) for i, v in enumerate(list(own) * 40)]
    odd = [(1000, text("de"), None), (1001, text("fr"), None), (1002, text("en"), None), (1004, text("de"), "en"), (1004, text("de"), "en"), (None, text("fr"), None), (1005, "12 !", None)]
    docs = make_docs(rows + odd, clash=True)
    out = corpus_pipeline.identify_language(spark, docs, "")
    got = out.collect()
    assert out.schema == docs.schema and sorted((r.doc_id or -1, r.lang) for r in got if r.doc_id is None or r.doc_id >= 1000) == [(-1, "fr"), (1000, "de"), (1001, "fr"), (1002, "en"), (1004, "de"), (1004, "de")]
    assert all(r.lang == rows[r.doc_id][2] for r in got if r.doc_id is not None and r.doc_id < 1000) and len(got) == len(rows) + 6
    key = lambda r: str({k: v for k, v in r.asDict().items() if k != "lang"})
    assert sorted(map(key, got)) == sorted(key(r) for r in docs.collect() if r.doc_id != 1005)
    untaught = make_docs([(i, t, None) for i, (_, t, _) in enumerate(rows[:5])])
    assert {r.lang for r in corpus_pipeline.identify_language(spark, untaught, "").collect()} == {None}


def test_pipeline_matches_plain_stages(spark, make_docs, random_words, tmp_path):
    """The contents after each stage against plain versions, from planted documents."""
    rng = np.random.default_rng(26)
    passage = random_words(rng, 60)
    texts = [random_words(rng, int(n), 100_000) for n in rng.integers(20, 120, 150)]
    texts += [f"{random_words(rng, 20)} {passage} {random_words(rng, 9)}" for _ in range(12)] + [edited(rng, texts[k], 1) for k in range(20)] + texts[30:40] + ["12 34 !", "", None, "x " * 5000]
    toxic = {int(i) for i in 50 + rng.permutation(100)[:60]}  # of texts without copies
    rows = [(i, f"you zorgig idiot {t} you blukka idiot" if i in toxic else t, "en") for i, t in enumerate(texts)]
    docs = make_docs([*rows, (None, "some words that nobody else has got", "en")], clash=True)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen, out = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path)).persist()
        seen[name] = out.collect()
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
    ids = lambda name: sorted(r.doc_id for r in seen[name] if r.doc_id is not None)
    lettered = [i for i, t, _ in rows if t and any(map(str.isalpha, t))]
    clean = [i for i in lettered if i not in toxic]
    assert ids("language_id") == lettered and ids("toxicity") == clean
    of = plain_classes([rows[i][1] for i in clean])
    first = sorted({clean[c] for c in of.values()})
    assert ids("minhash_near_dedup") == first and len(first) < len(clean)
    cut = plain_removal([(i, rows[i][1]) for i in first])
    assert sorted((r.doc_id, len(r.text.split())) for r in seen["substring_dedup"] if r.doc_id is not None) == [(i, n - g) for i, n, g, _ in cut] and sum(g for _, _, g, _ in cut) > 200
    assert all(r.n_chars == len(r.text) for r in seen["substring_dedup"])
    packed = Counter()
    for r in seen["best_fit_packing"]:
        packed[r.doc_id] += r.n_tokens
    assert packed == {**{i: n - g for i, n, g, _ in cut}, None: 7}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, seen["best_fit_packing"]))


def test_pipeline(spark, make_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    count = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() <= count, name
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert 100 < len({r.doc_id for r in rows}) <= count
    odd = make_docs([*ODD, "the house of the green water and some more words"], clash=True)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, "/root/testdata/sf0.001").count() > 0, name
        assert stage(spark, odd.limit(0), "/root/testdata/sf0.001").count() == 0, name


def test_suffix_groups_and_overlaps_take_few_bytes_of_memory():
    import tracemalloc

    import zstandard

    from eigenspark.llm import neardup, substrings

    rng = np.random.default_rng(3)
    names = np.array([b"w%d" % i for i in range(5_000)])
    texts = [b" ".join(names[rng.integers(0, len(names), 2_000)]) for _ in range(50)] * 2
    head = (np.diff(np.arange(100, dtype=np.int64), prepend=0), np.arange(100, dtype=np.uint32), np.zeros(100, np.int32), np.full(100, 200, np.uint8))
    body = b"".join(b" ".join(t.split()[:212]) + b"\n" for t in texts)
    packet = (100, zstandard.ZstdCompressor().compress(b"".join(v.tobytes() for v in head) + body))
    # group of many such packets: the second half of the stretches repeats the first
    tracemalloc.start()
    found = substrings._tree([packet] * 20, 13)
    tree = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(set(found.column("doc_id").to_pylist())) == list(range(50, 100))
    assert tree < 20 * 20 * len(body)

    sets = [(np.unique(rng.integers(0, 2**32, 20).astype(np.uint32)), np.full(20, 2, np.uint32)) for _ in range(1_500)]
    sets = [(v, w[: len(v)]) for v, w in sets] + [(v, w[: len(v)]) for v, w in sets[:2]]
    tracemalloc.start()
    links = neardup.missing_links(np.arange(len(sets)), np.arange(len(sets)), sets)
    overlaps = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links == [(0, 1500), (1, 1501)]
    assert overlaps < 2.5 * 4 * len(sets) ** 2
