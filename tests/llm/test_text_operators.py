"""BPE, licenses, language and toxicity."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers as tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eigenspark.llm import bpe, language, licenses, queries, toxicity

PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n\n\t", "a", "é", "漢字 😀", "x" * 30_000, "ab " * 5000, "don't", "don't", "\x00\x07", "١٢٣ ½"]


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_bpe_encodes_as_the_library(text):
    ours = bpe.coder(PATH, tokenizers.PATTERN)
    ids = ours.encode(text)
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ours.pieces.ranks, special_tokens={}) if not hasattr(test_bpe_encodes_as_the_library, "e") else test_bpe_encodes_as_the_library.e
    test_bpe_encodes_as_the_library.e = own
    assert ids == own.encode_ordinary(text)
    assert ours.decode(ids) == text.encode()


def test_rank_queue_pops_by_rank_and_place():
    rng, queue, want = random.Random(1), bpe.RankQueue(), []
    for _ in range(500):
        x = (rng.randrange(50_000), rng.randrange(99))
        queue.push(*x)
        want.append(x)
    assert [queue.pop() for _ in want] == sorted(want) and not queue


def test_pieces_forget_but_stay_right():
    ranks = bpe.read_ranks(PATH)
    few = bpe.Pieces(ranks, most=3)
    texts = [f"wörd{i % 7}" for i in range(50)]
    assert [few[t] for t in texts] == [",".join(map(str, bpe.merged(t.encode(), ranks))) if t.encode() not in ranks else str(ranks[t.encode()]) for t in texts]
    assert len(few) + len(few.old) <= 6


def test_bpe_query_and_odd_texts(spark, make_docs, theirs):
    docs = make_docs(ODD, clash=True)
    got = {r.doc_id: r for r in bpe.digests(docs, PATH, tokenizers.PATTERN).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encoded(docs, PATH, tokenizers.PATTERN).collect()}
    back = {r.doc_id: bytes(r.data) for r in bpe.decoded(bpe.encoded(docs, PATH, tokenizers.PATTERN), PATH, tokenizers.PATTERN).collect()}
    for i, text in enumerate(ODD):
        want = theirs.encode_ordinary(text or "")
        assert ids[i] == want and back[i] == (text or "").encode()
        assert got[i].n_tokens == len(want) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(make_docs([]), PATH, tokenizers.PATTERN).count() == 0
    twice = bpe.digests(make_docs([(1, "a b", "en"), (1, "a b", "en"), (None, "a b", "en"), (1, None, "en")]), PATH, tokenizers.PATTERN).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in twice) == [(False, 0), (False, 2), (False, 2), (True, 2)]


def base_scan(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for i in range(len(ws)) if ws[i : i + len(p)] == p]
    starts = sorted(i for i, _ in hits)
    return len(ws), len(hits), starts[0] if hits else None, starts[-1] if hits else None, ",".join(sorted({x for _, x in hits}))


LICENSED = ["Released under the MIT License.", "x CC BY-NC cc by nc CC-BY-NC", "Apache License, Version 2.0", "under the mit licenses", "ÉUnder the MIT license", "under the mit license " * 3, "a" * 40_000 + " under the MIT license"]


def test_license_base_matches_brute_force(spark, make_docs):
    texts = ODD + LICENSED
    for r in licenses.scanned(make_docs(texts, clash=True)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_scan(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scanned(make_docs([])).count() == 0


def test_license_inexact_notices_around_an_exact_one():
    near, exact = "licensed under the apache licence version 2 0", "licensed under the apache license version 2 0"
    for notices in ([near, exact], [near, near, exact, near], [exact, near]):
        spans = licenses.scan_text(" ".join(notices))[7]
        assert [(x["label"], x["first_word"], x["errors"], x["found"]) for x in spans] == [("apache-2", 8 * i, int(n == near), n) for i, n in enumerate(notices)]


def test_license_fuzzy_notices():
    find = lambda t: licenses.scan_text(t)
    exact = find("Intro here. Licensed under the GNU General Public License, version 3. End")
    assert exact[5] == "gpl-3" and exact[7][0] == {"label": "gpl-3", "first_word": 2, "n_words": 9, "errors": 0, "found": "licensed under the gnu general public license version 3"}
    typo = find("foo Permision is hereby granted, fre of charge, to any person obtaining a copi of this software bar")
    assert typo[5] == "mit" and typo[1] == 0 and typo[7][0]["errors"] == 3 and typo[7][0]["first_word"] == 1 and 0 < typo[6] < 1
    assert find("nothing to see under the mitten licence of the state")[5] == ""


def least_errors(notice, text):
    """The least number of edits that make a part of the text the notice: (errors, and where such parts end)."""
    row = list(range(len(notice) + 1))
    best, ends = row[-1], [0]
    for j, c in enumerate(text, 1):
        new = [0]
        for i, n in enumerate(notice, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (n != c)))
        row = new
        if row[-1] < best:
            best, ends = row[-1], []
        if row[-1] == best:
            ends.append(j)
    return best, ends


def distance(a, b):
    row = list(range(len(a) + 1))
    for j, c in enumerate(b, 1):
        new = [j]
        for i, n in enumerate(a, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (n != c)))
        row = new
    return row[-1]


def garbled(rng, notice, edits):
    x = list(notice)
    for _ in range(edits):
        i = rng.randrange(len(x))
        x[i : i + 1] = rng.choice([[], ["z"], [x[i], "q"], ["q", x[i]]])
    return "".join(x)


def test_license_notices_match_edit_distances():
    """Found notices, their errors and spans against the table of edit distances of every notice and text."""
    rng, own = random.Random(20), licenses._notices()
    filler = "some plain words of no license at all under version public use".split()
    seen = 0
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            notice = rng.choice(licenses.NOTICES)[0]
            parts += [" ".join(rng.choices(filler, k=rng.randrange(0, 5))), garbled(rng, notice, rng.randrange(licenses.errors(notice) + 3))]
        text = " " + " ".join(" ".join(parts).split()) + " "
        found = own.verified(text)
        for k, (notice, _) in enumerate(own.notices):
            least, _ = least_errors(notice, text)
            mine = [x for x in found if x[0] == k]
            assert bool(mine) == (least <= licenses.errors(notice))
            assert not mine or min(x[3] for x in mine) == least
            for _, a, b, e in mine:
                assert distance(notice, text[a:b]) == e <= licenses.errors(notice)
            seen += len(mine)
        labels = {own.notices[k][1] for k, *_ in found}
        kept = own.matches(text)
        assert {x[0] for x in kept} <= labels and bool(kept) == bool(labels)
        assert all(x[2] <= y[1] for x, y in zip(kept, kept[1:], strict=False))
        assert all(any(x[1] < b and a < x[2] and x[4] >= 1 - e / len(own.notices[k][0]) - 1e-12 for x in kept) for k, a, b, e in found if sum(a < y[2] and y[1] < b for y in found) == 1)
    assert seen > 150


def test_closest_notices_first():
    """Of three notices in a row, each overlapping the next, the outer ones stay where the middle one is no closer."""
    own = licenses.Notices((("alpha beta gamma delta", "x"), ("gamma delta epsilon zeta eta theta", "y"), ("eta theta iota kappa lambda mu", "z")))
    text = " alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu "
    assert [x[0] for x in own.matches(text)] == ["y"]  # the longest of equally close ones overlaps both others
    assert [x[0] for x in own.matches(text.replace("zeta", "zetta"))] == ["x", "z"]
    mended = "licensed under the apache license version icensed under cc by nc 4 0reative commons attribution 4 0 international"
    assert licenses.scan_text(mended)[5] == "apache-2,cc-by,cc-by-nc"  # the last by its base phrase


def plain_matches(found, notices):
    """The closest first, each against all that is taken."""
    rows = sorted((-(1 - e / len(notices[k][0])), a - b, [-ord(c) for c in notices[k][1]] + [0], a, b, notices[k][1]) for k, a, b, e in found)
    kept = []
    for x in rows:
        if all(x[4] <= y[3] or y[4] <= x[3] for y in kept):
            kept.append(x)
    return sorted((x[3], x[4], x[5]) for x in kept)


def test_overlapping_notices_match_brute_force():
    rng, own = random.Random(21), licenses._notices()
    chains = 0
    for _ in range(400):
        text = " "
        for _ in range(3):
            notice = garbled(rng, rng.choice(licenses.NOTICES)[0], rng.randrange(3))
            text = text[: len(text) - rng.randrange(0, min(9, len(text)))] + notice + rng.choice(["", " ", " some words "])
        found = own.verified(text)
        kept = own.matches(text)
        assert [(x[1], x[2], x[0]) for x in kept] == plain_matches(found, own.notices)
        chains += len(found) > len(kept) > 1
    assert chains > 10


def test_license_score_and_repeated_rows(spark, make_docs):
    text = "x licensed under the apache licence version 2 0 y"
    rows = licenses.scanned(make_docs([(1, text, "en"), (1, text, "en"), (None, text, "en"), (2, text + " under the MIT license", "en"), (3, None, None)], clash=True)).collect()
    notice = "licensed under the apache license version 2 0"
    for r in rows:
        if r.doc_id == 3:
            assert (r.labels, r.score, r.spans) == ("", 0.0, [])
        elif r.doc_id == 2:
            assert (r.labels, r.base_labels, r.score) == ("apache-2,mit", "mit", 1.0)
        else:
            assert (r.labels, r.base_labels) == ("apache-2", "") and r.score == pytest.approx(1 - 1 / len(notice))
            assert [tuple(x) for x in r.spans] == [("apache-2", 1, 8, 1, "licensed under the apache licence version 2 0")]
    assert len(rows) == 5 and not licenses.scan_text("all rights reserved")[5]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_pigeonhole_misses_no_notice(data):
    k = data.draw(st.integers(0, len(licenses.NOTICES) - 1))
    notice, _ = licenses.NOTICES[k]
    x = list(notice)
    for _ in range(licenses.errors(notice)):
        i = data.draw(st.integers(0, len(x) - 1))
        x[i : i + 1] = data.draw(st.sampled_from(["", "z", x[i] + "q"]))
    assert k in {w[0] for w in licenses._notices().windows("aaa " + "".join(x) + " bbb")}


def speech(rng, lang, n):
    own = {"en": "the of and is that was house green water", "de": "der und ist nicht das haus wasser über grün", "fr": "le et est dans que maison eau très vert"}[lang].split()
    return " ".join(rng.choice(own, n))


def test_language_on_held_out_and_odd_rows(spark, make_docs):
    rng = np.random.default_rng(4)
    rows = [(i, speech(rng, g, int(rng.integers(3, 60))), g) for i, g in enumerate(np.tile(["en", "de", "fr"], 100).tolist())]
    rows += [(1000 + i, t, None) for i, t in enumerate(ODD)] + [(5, "the house is green", "en"), (None, "der und das", "de")]
    docs = make_docs(rows, clash=True)
    out = language.identified(docs, language.learned(docs)).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {*docs.columns, "ambiguous"}
    held = [r for r in out if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 50 and np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    for r in out:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) and 0 <= r.score <= 1
    assert {r.lang_pred for r in language.identified(docs, language.learned(docs.limit(0))).collect()} == {"und"}
    one = language.learned(docs.where("lang = 'de'"))
    assert one.predict(["haus", "", None])[0][:2] == ("de", 1.0)
    assert language.identified(make_docs([]), one).count() == 0


def test_all_languages_are_learned(spark, make_docs):
    """More languages than a code has rows of random tables to spare, a hot one, and texts of one id."""
    rng, rows = np.random.default_rng(21), []
    for g in range(90):
        own = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)]
        rows += [(1000 * g + i, " ".join(rng.choice(own, 40)), f"l{g}") for i in range(300 if g == 7 else 12)]
    rows += [(8, f"only words of number {i}", "one") for i in range(3)] * 50  # crc32("8") % 3 is not 1
    model = language.learned(make_docs(rows), most=900)
    assert zlib.crc32(b"8") % 3 != 1 and model.classes == sorted({g for _, _, g in rows})
    held = [(t, g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    said = model.predict([t for t, _ in held])
    assert np.mean([x[0] == g for x, (_, g) in zip(said, held, strict=True)]) > 0.9
    small = language.learned(make_docs(rows), most=900, least=1)
    assert len(small.classes) == 91


def test_decoding_matches_a_plain_version():
    """The nearest codeword by the weighted exponential loss of each bit, and shares of the losses."""
    rng = np.random.default_rng(22)
    code = language.codewords(5)
    model = language.OutputCode(list("abcde"), code, rng.normal(size=(language.DIMS, code.shape[1])).astype(np.float32), rng.normal(size=code.shape[1]).astype(np.float32), rng.random(code.shape).astype(np.float32))
    texts = [speech(rng, "en", 9), "été", "x"]
    for x, (name, score, unsure) in zip(language.vectors(texts), model.predict(texts), strict=True):
        margins = [min(4.0, max(-4.0, float(sum(float(a) * float(b) for a, b in zip(x, w, strict=True)) + c))) for w, c in zip(model.weights.T, model.bias, strict=True)]
        losses = [sum(float(k) * np.exp(-m * float(c)) for m, c, k in zip(margins, row, own, strict=True)) for row, own in zip(code, model.skill, strict=True)]
        shares = np.exp(min(losses) - np.array(losses)) / np.exp(min(losses) - np.array(losses)).sum()
        assert name == "abcde"[int(np.argmin(losses))] and score == pytest.approx(shares.max(), abs=1e-4)
        assert unsure == (np.sort(shares)[-1] - np.sort(shares)[-2] < language.MARGIN)


def test_codewords_differ_and_correct_errors():
    for n in (2, 3, 4, 6, 7, 20):
        code = language.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2 + 999 * np.eye(n)
        assert code.shape[0] == n and apart.min() >= (1 if n == 2 else 2)


def test_toxicity_on_held_out_and_odd_rows(spark, make_docs, random_words):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(400):
        text = random_words(rng, 60, 400).split()
        if i % 4 == 0:
            for k in rng.integers(0, 60, 4):
                text[k] = rng.choice(["zorgig", "blukka", "idiot"])
        rows.append((i, " ".join(text), "en"))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000 + i, t, "en") for i, t in enumerate(ODD)] + [(None, "hello", "en"), (3, "twice", "en")]
    labels += [(7, None, None), (None, 1, 1), (8, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = make_docs(rows, clash=True)
    model = toxicity.learned(docs, table, rounds=5)
    assert {"zorgig", "blukka"} <= set(model.lexicon.weights)
    out = toxicity.scored(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert {r.held_out for r in out if r.doc_id is not None} == {True, False} and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held if r.doc_id != 3]) > 0.95
    none = toxicity.learned(docs, table.limit(0))
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}
    assert toxicity.scored(make_docs([]), model).count() == 0


def test_toxicity_learns_apart_from_its_calibration(spark, make_docs, random_words):
    """A word that marks toxic texts of the calibration part alone is not learned; copies of an id count once."""
    rng = np.random.default_rng(23)
    ids = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 != 1]
    held = {r.doc_id for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0).collect()}
    rows = [(i, random_words(rng, 30, 300) + (f" {'heldword' if i in held else 'fitword'}" if i % 3 == 0 else ""), "en") for i in ids]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in ids] + [(ids[0], 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learned(make_docs(rows + rows[:50]), labels, rounds=3)
    assert "fitword" in model.lexicon.weights and "heldword" not in model.lexicon.weights and model.calibration is not None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aabzéé漢漢😀😀 0@$!|*._AA", max_size=30))
def test_texts_are_passed_over_only_without_a_match(text):
    data = np.frombuffer(text.encode(), np.uint8)
    assert toxicity.may_be_obfuscated(data) or not toxicity._OBFUSCATED.search(text)
    assert toxicity.may_be_stretched(data) or not toxicity._STRETCHED.search(text)


def pooled(rows):
    """Isotonic means of (margin, target, weight) by pooling neighbours that fall, a block at a time."""
    blocks = []
    for m, y, w in sorted(rows):
        blocks.append([y * w, w, [m]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            y, w, own = blocks.pop()
            blocks[-1][0] += y
            blocks[-1][1] += w
            blocks[-1][2] += own
    return {m: y / w for y, w, own in blocks for m in own}


def test_calibration_matches_a_plain_version(spark):
    rng = np.random.default_rng(24)
    rows = [(float(np.round(rng.normal(), 1)), float(rng.random() < 0.3)) for _ in range(80)] + [(0.5, 1.0)] * 300
    n, added = len(rows), {}
    for m, y in rows:
        added.setdefault(m, []).append(y)
    own = lambda m: 1 / (1 + np.exp(-2 * m))
    want = pooled([(m, (np.mean(y) + toxicity.PRIOR / n * own(m)) / (1 + toxicity.PRIOR / n), len(y)) for m, y in added.items()])
    table = spark.createDataFrame(rows, "_margin double, label double")
    curve = toxicity.calibrated(table)
    for r in curve.transform(spark.createDataFrame([(m,) for m in want], "_margin double")).collect():
        assert r._share == pytest.approx(want[r._margin])
    few = toxicity.calibrated(table.limit(1))
    assert 0 < few.transform(table.limit(1)).first()._share < 1 and toxicity.calibrated(table.limit(0)) is None


def test_toxicity_features():
    lexicon = toxicity.Lexicon({"zorg": 3.0, "blukk-": 2.0})
    f = dict(zip(toxicity.FEATURES, toxicity.features("You zorg! Blukkaaa 1d1ot st*ff ABC", lexicon), strict=True))
    assert f["lexicon_rate"] > 0 and f["near_second_person"] > 0 and f["obfuscated"] > 0 and f["capitals"] > 0 and f["stretched"] > 0
    assert len(toxicity.features(None, lexicon)) == len(toxicity.FEATURES) and not any(toxicity.features("", lexicon))


def test_queries_run_on_small_tables(spark):
    for name in ("op3_license_scans", "op5_byte_bpe", "op6_language_id"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 200
    assert F.lit(1) is not None


def test_pieces_decode_as_whole_texts_do_and_are_remembered_within_bounds():
    from eigenspark.llm import bpe

    ranks = {bytes([k]): k for k in range(256)} | {b"ab": 256, b" ab": 257}
    c = bpe.Coder(ranks, r" ?\p{L}+|\s+|[^\s\p{L}]+")
    c.tokens.most = 2
    for text in ["", None, "ab ab  ć", "\U0001f600 ab12", "x" * 100, "日本 ab"] * 2:
        pieces = c.encode_pieces(text)
        assert ",".join(pieces) == c.encode_text(text)
        assert c.decode_pieces(pieces) == c.decode_text(c.encode_text(text)) == (text or "").encode()
        assert len(c.tokens) <= 2


def split_ids(ids, counts):
    cuts = np.cumsum(counts)[:-1]
    return [x.tolist() for x in np.split(ids, cuts)]


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=5), max_size=60), st.integers(0, 9), st.lists(st.text("abé", min_size=1, max_size=30), min_size=1, max_size=40))
def test_pieces_merged_together_are_as_merged_alone(tokens, seed, texts):
    tokens = sorted({bytes([k]) for k in range(256)} | {t.encode() for t in tokens})
    numbers = random.Random(seed).sample(range(5_000), len(tokens))  # merges may make ranks below their own
    ranks = dict(zip(tokens, numbers, strict=True))
    pieces = [t.encode() for t in texts]
    assert split_ids(*bpe.merged_together(pieces, bpe.Pairs(ranks))) == [bpe.merged(p, ranks) for p in pieces]


def test_bytes_that_are_no_tokens_are_merged_or_refused_in_both_ways():
    ranks = {b"ab": 0, b"c": 1, b"abc": 2}
    pairs = bpe.Pairs(ranks)
    assert split_ids(*bpe.merged_together([b"ab", b"abc", b"cc", b"cab"], pairs)) == [bpe.merged(p, ranks) for p in (b"ab", b"abc", b"cc", b"cab")] == [[0], [2], [1, 1], [1, 0]]
    for call in (lambda: bpe.merged(b"cb", ranks), lambda: bpe.merged_together([b"cb"], pairs)):
        with pytest.raises(KeyError):
            call()


def test_new_pieces_of_a_batch_are_merged_together(spark, make_docs, theirs, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeéñ漢", k=rng.randint(3, 14))) for _ in range(9_000)]
    texts = [*(" ".join(words[k : k + 100]) for k in range(0, 9_000, 100)), None, "", "\x00 " + "y" * 500, words[0]]
    alone = []
    monkeypatch.setattr(bpe, "merged", lambda piece, ranks, f=bpe.merged: alone.append(piece) or f(piece, ranks))
    for most in (400_000, 5_000):
        c = bpe.Coder(bpe.read_ranks(PATH), tokenizers.PATTERN)
        c.pieces.most = most
        if most == 5_000:
            for name, value in {"TOGETHER": 5_000, "STRETCH": 40_000, "MANY": 3_000, "FEW": 10}.items():
                monkeypatch.setattr(bpe, name, value)
        for _ in range(2):
            got = list(c.encode_all(texts))
            assert [",".join(x) for x in got] == [",".join(map(str, theirs.encode_ordinary(t or ""))) for t in texts]
            assert [c.decode_pieces(x) for x in got] == [(t or "").encode() for t in texts]
        assert len(c.pieces) <= most and len(c.pieces.old) <= most
        if most == 400_000:  # before, each of some 9,000 new words
            assert {len(p) for p in alone} <= {501} and alone
    assert list(c.encode_all([])) == []
    got = {r.doc_id: r for r in bpe.digests(make_docs(texts), PATH, tokenizers.PATTERN).collect()}
    for i, text in enumerate(texts):
        want = theirs.encode_ordinary(text or "")
        assert got[i].n_tokens == len(want) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
