"""Removal of word sequences that a document with a smaller id holds too, by prefix-partitioned sparse suffix trees.

Suffixes are sampled by content: a window of 13 words belongs to the run of words in it with the lowest hash (its prefix),
which equal windows share; windows in a row with the same prefix travel together as one stretch of words.  Prefixes split
the stretches into groups of a bounded size.  A census of all texts finds the prefixes with more bytes than a group may
have; these are lengthened, and counted again, up to the whole window.  In a group, prefix doubling gives the suffix array of
its stretches with common prefixes, which is the suffix tree: intervals whose suffixes share 13 words or more are its deep
internal nodes.  The smallest document below such a node keeps the words, and windows that follow each other join to
maximal repeats (`maximal_repeats`).
Where even one window has more bytes than a group, its node is settled by a minimum alone.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_BLANK, Words, kept_powers, mix, partitions, run_hashes, slices, widened

WINDOW = 13
#: Words of a prefix; the next length where the group of a prefix would be too large.
PREFIXES = (2, 6, WINDOW)
#: Bytes of stretches that a prefix may have before it is lengthened; groups have about as much.
GROUP_BYTES = 8 << 20
#: Prefixes lengthened at each length, at most, the largest first; any other has at most 1 / MOST of all bytes.
MOST = 100_000
#: The first census counts bytes in so many slots; only slots over GROUP_BYTES are counted by prefix.
SLOTS = 1 << 16
#: Characters whose words are cut out at once.
SLICE = 1_000_000
#: Bytes of stretches that are copied at once; a task has 24 bytes of places for each of them.
COPIED = 1 << 18

_PLACE = 1 << 31  # a place is crc32 of the text * 2**31 + the window's first word
_PACKETS = "bucket int, n int, data binary"
_RUNS = "doc_id long, place long, n int"


class Stretches:
    """Windows in a row that share a prefix, from some texts: prefix, text, first word (in words), and windows."""

    def __init__(self, words: Words, prefix: np.ndarray, text: np.ndarray, first: np.ndarray, count: np.ndarray):
        self.words, self.prefix, self.text, self.first, self.count = words, prefix, text, first, count

    def edges(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """First byte and the byte after the last of each stretch."""
        return self.words.start[self.first], self.words.end[self.first + self.count + window - 2]

    def places(self) -> np.ndarray:
        """The first word of each stretch, counted in its text."""
        return self.first - self.words.first[self.text]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _levels(texts: list[bytes], window: int, prefixes: tuple[int, ...], long: list[np.ndarray]):
    """Stretches of a few texts for each length of prefix in turn; then the windows of which every prefix is long.

    long: for each length, the sorted prefixes that are lengthened.  A window belongs to the first length whose prefix
    isn't.
    """
    w = Words(texts, NOT_BLANK)
    h = w.hashes()
    n = len(h) - window + 1
    if n <= 0:
        return
    doc = np.repeat(np.arange(len(texts)), w.counts)
    start = np.flatnonzero(doc[:n] == doc[window - 1 : window - 1 + n])
    for level, size in enumerate(prefixes):
        if not len(start):
            return
        grams = run_hashes(h, size)
        low, arg = grams[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, window - size + 1):
            less = grams[j : j + n] < low
            low[less] = grams[j : j + n][less]
            arg[less] = j
        prefix, at = low[start], start + arg[start]
        over = _among(prefix, long[level]) if level < len(long) else np.zeros(len(start), bool)
        own = np.flatnonzero(~over)
        s, p, a = start[own], prefix[own], at[own]
        new = np.ones(len(s), bool)
        new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.flatnonzero(new)
        yield Stretches(w, p[first], doc[s[first]], s[first], np.diff(np.append(first, len(s))))
        start = start[over]
    if len(start):
        yield Stretches(w, run_hashes(h, window)[start], doc[start], start, np.ones(len(start), np.int64))


def _keeping(run):
    """run with the powers of the word hash kept from slice to slice."""

    def kept(batches):
        with kept_powers():
            yield from run(batches)

    return kept


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")


def _encoded(batch: pa.RecordBatch):
    """Ids and UTF-8 texts of some rows at a time."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    texts = [t.encode() for t in batch.column(1).to_pylist()]
    for a, b in slices(texts, SLICE):
        yield ids[a:b], texts[a:b]


def _census(docs: DataFrame, window: int, prefixes: tuple[int, ...], long: list[np.ndarray], level: int, slots: list[int] | None) -> DataFrame:
    """prefix and bytes of the stretches of one level, added up by task; without slots, prefix is the slot."""
    wanted = None if slots is None else np.array(sorted(slots), np.uint64)

    def sums(key: np.ndarray, size: np.ndarray):
        key, inverse = np.unique(key, return_inverse=True)
        return pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.bincount(inverse, size, len(key)).astype(np.int64))], ["prefix", "bytes"])

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            for _, texts in _encoded(b):
                for k, s in enumerate(_levels(texts, window, prefixes, long)):
                    if k != level:
                        continue
                    first, last = s.edges(window)
                    slot, size = mix(s.prefix) % np.uint64(SLOTS), last - first + 24
                    if wanted is None:
                        np.add.at(total, slot.astype(np.int64), size)
                    else:
                        own = _among(slot, wanted)
                        yield sums(s.prefix[own], size[own])
        if wanted is None:
            have = np.flatnonzero(total)
            yield pa.record_batch([pa.array(have), pa.array(total[have])], ["prefix", "bytes"])

    return _rows(docs).mapInArrow(_keeping(run), "prefix long, bytes long").groupBy("prefix").agg(F.sum("bytes").alias("bytes"))


def long_prefixes(docs: DataFrame, window: int = WINDOW, prefixes: tuple[int, ...] = PREFIXES) -> list[np.ndarray]:
    """For each length, the prefixes with over GROUP_BYTES of stretches; at most MOST of them come to the driver."""
    long: list[np.ndarray] = []
    for level in range(len(prefixes)):
        full = [r.prefix for r in _census(docs, window, prefixes, long, level, None).where(F.col("bytes") > GROUP_BYTES).collect()]  # at most SLOTS
        if not full:
            break
        counted = _census(docs, window, prefixes, long, level, full).where(F.col("bytes") > GROUP_BYTES)
        found = [r.prefix for r in counted.orderBy(F.desc("bytes"), "prefix").limit(MOST).collect()]
        if not found:
            break
        long.append(np.sort(np.array(found, np.int64).view(np.uint64)))
    return long


def _copied(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of stretches one after the other, the last byte of each a line feed; COPIED bytes and one stretch at a time at most."""
    ends = np.append(0, np.cumsum(size))
    out = np.empty(ends[-1], np.uint8)
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + COPIED, "right")) - 1)
        out[ends[a] : ends[b]] = data[np.arange(ends[a], ends[b]) + np.repeat(first[a:b] - ends[a:b], size[a:b])]
        a = b
    out[ends[1:] - 1] = 10
    return out


def _packets(docs: DataFrame, window: int, prefixes: tuple[int, ...], long: list[np.ndarray], buckets: int) -> DataFrame:
    """Stretches by bucket of their prefixes: n of them in data, zstandard over ids, places, windows and the words."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            for ids, texts in _encoded(b):
                sums = np.fromiter((zlib.crc32(t) for t in texts), np.uint32, len(texts))
                for k, s in enumerate(_levels(texts, window, prefixes, long)):
                    if k == len(prefixes) or not len(s.prefix):
                        continue  # settled by a minimum, or all lengthened
                    bucket = (mix(s.prefix) % np.uint64(buckets)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    first, last = (e[order] for e in s.edges(window))
                    size = last - first + 1
                    ends = np.append(0, np.cumsum(size))
                    data = _copied(s.words.data, first, size)
                    text, place, count = s.text[order], s.places()[order].astype(np.int32), s.count[order].astype(np.uint8)
                    have, cut = np.unique(bucket[order], return_index=True)
                    out = []
                    for x, y in zip(cut, np.append(cut[1:], len(order)), strict=True):
                        head = (np.diff(ids[text[x:y]], prepend=0), sums[text[x:y]], place[x:y], count[x:y], data[ends[x] : ends[y]])
                        out.append(squeeze(b"".join(v.tobytes() for v in head)))
                    yield pa.record_batch([pa.array(have), pa.array(np.diff(np.append(cut, len(order))).astype(np.int32)), pa.array(out, pa.binary())], ["bucket", "n", "data"])

    return _rows(docs).mapInArrow(_keeping(run), _PACKETS)


def _runs(doc: np.ndarray, place: np.ndarray, row: np.ndarray, flag: np.ndarray):
    """Runs of flagged windows; place: of each window; windows of a row follow each other."""
    at = np.flatnonzero(flag)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at))).astype(np.int32)
    return pa.record_batch([pa.array(doc[at[first]]), pa.array(place[at[first]]), pa.array(n, pa.int32())], ["doc_id", "place", "n"])


def _index(most: int) -> type:
    """Numbers up to most, and one more, in as few bytes as they need."""
    return np.int32 if most < 2**31 - 1 else np.int64


def dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks from 0 of equal keys, an order of the keys, and a place of each rank."""
    order = np.argsort(key)
    rising = key[order]
    new = np.ones(len(key), bool)
    new[1:] = rising[1:] != rising[:-1]
    del rising
    rank = np.empty(len(key), _index(len(key)))
    rank[order] = np.cumsum(new, dtype=rank.dtype) - 1
    return rank, order, order[new]


def exact_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only: words of one hash are compared byte by byte."""
    ids, _, first = dense(hashes)
    size, model = end - start, first[ids]
    same = np.array_equal(size, size[model])
    for a in range(0, len(start) if same else 0, 100_000):
        own, n = slice(a, a + 100_000), size[a : a + 100_000]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = same and np.array_equal(data[np.repeat(start[own], n) + within], data[np.repeat(start[model[own]], n) + within])
    if same:
        return ids
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(start, end, strict=True)], np.int64)


def suffix_array(ids: np.ndarray, length: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a sequence in order, and the common prefix of each with the one before it (0 for the first).

    ids: numbers from 0.  Suffixes are told apart by up to `length` elements at least, by joining the ranks of two or three
    stretches in a row to those of longer ones; the ranks of every length then give the common prefixes, the longest first.
    Common prefixes below `least` needn't be exact.
    """
    levels, have, order = [ids.astype(_index(int(ids.max(initial=0))))], [1], np.argsort(ids) if length <= 1 else None
    while have[-1] < length:
        rank = levels[-1] + 1
        bits = max(1, int(rank.max(initial=0)).bit_length())
        times = 3 if 3 * bits <= 64 else 2
        key = rank.astype(np.uint64)
        for k in range(1, times):
            key <<= np.uint64(bits)
            after = rank[k * have[-1] :]  # 0 past the end
            key[: len(after)] |= after.astype(np.uint64)
        rank, order, _ = dense(key)
        levels.append(rank)
        have.append(times * have[-1])
        del key, after
    order = order.astype(_index(len(order)))
    common = np.zeros(len(order), order.dtype)
    k = max((k for k, h in enumerate(have) if h <= least), default=0)
    near = 1 + np.flatnonzero(levels[k][order[1:]] == levels[k][order[:-1]]) if least else np.arange(1, len(order))
    one, two, shared = order[near], order[near - 1], np.zeros(len(near), order.dtype)
    for k in range(len(levels) - 1, -1, -1):
        for _ in range(1 if k == len(levels) - 1 else have[k + 1] // have[k] - 1):
            inside = np.flatnonzero(np.maximum(one, two) + shared < len(ids))
            shared[inside[levels[k][one[inside] + shared[inside]] == levels[k][two[inside] + shared[inside]]]] += have[k]
    common[near] = shared
    return order, common


def internal_nodes(common: np.ndarray, depth: int) -> list[tuple[int, int, int]]:
    """(depth, first, last) of the internal nodes of at least so many elements: intervals of the suffix array whose suffixes share
    exactly that many, by a stack over the common prefixes."""
    out, open_ = [], []  # of (depth, first)
    for at, c in enumerate([*common.tolist(), 0]):
        first = at - 1
        while open_ and open_[-1][0] > c:
            d, first = open_.pop()
            if d >= depth:
                out.append((d, first, at - 1))
        if c and (not open_ or open_[-1][0] < c):
            open_.append((c, first))
    return out


def _ended(ids: np.ndarray, words: np.ndarray) -> np.ndarray:
    """ids with an element of its own after each stretch, so that no suffix is alike beyond its stretch."""
    ends = np.cumsum(words)
    return np.insert(ids, ends, ids.max(initial=0) + 1 + np.arange(len(words)))


def _tree(packets: list[tuple[int, bytes]], window: int):
    """Runs of windows of a group that lie under a node with a smaller document.

    Windows whose hash is alone in the group have no node; suffixes are ranked for the stretches of the others only.
    What a step no longer needs is dropped before the next, as a group's words take many times their bytes.
    """
    out = zstandard.ZstdDecompressor().decompress
    fields: list[list[np.ndarray]] = [[] for _ in range(4)]
    texts, n_bytes = [], 0
    data, starts, ends, hashes = [], [], [], []

    def tokenised():
        w = Words([b"".join(texts)], NOT_BLANK)
        place = _index(n_bytes + len(w.data))
        data.append(w.data)
        starts.append((w.start + n_bytes).astype(place))
        ends.append((w.end + n_bytes).astype(place))
        hashes.append(w.hashes())
        texts.clear()
        return n_bytes + len(w.data)

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        whole = np.concatenate(parts)
        parts.clear()
        return whole

    held = 0
    for n, packed in packets:
        raw = out(packed)
        cuts = np.cumsum([0, 8 * n, 4 * n, 4 * n, n])
        parts = [np.frombuffer(raw, t, n, a).copy() for t, a in zip((np.int64, np.uint32, np.int32, np.uint8), cuts, strict=False)]
        fields[0].append(np.cumsum(parts[0]))
        for k in (1, 2, 3):
            fields[k].append(parts[k])
        texts.append(raw[cuts[-1] :])
        held += len(texts[-1])
        if held >= 900_000:
            n_bytes, held = tokenised(), 0
    if texts:
        n_bytes = tokenised()
    word = joined(hashes)
    ids, sums, place, count = (joined(x) for x in fields)
    sums, place, count = (x.astype(np.int64) for x in (sums, place, count))
    words = count + window - 1

    def windows(gap: int) -> tuple[np.ndarray, np.ndarray]:
        """The stretch of each window, and its first word where so many more elements follow each stretch."""
        row = np.repeat(np.arange(len(count), dtype=_index(len(count))), count)
        first = np.cumsum(words + gap) - words - gap - np.cumsum(count) + count
        return row, np.arange(len(row)) + np.repeat(first, count)

    row, at = windows(0)
    win = run_hashes(word, window)[at]
    del at
    order = np.argsort(win)
    win = win[order]
    same = np.append(False, win[1:] == win[:-1])
    same[:-1] |= same[1:]
    keep = np.zeros(len(count), bool)
    keep[row[order[same]]] = True
    del row, win, order, same
    if not keep.any():
        return None
    own = np.repeat(keep, words)
    ids, sums, place, count, words = (x[keep] for x in (ids, sums, place, count, words))
    word, start, end = word[own], joined(starts)[own], joined(ends)[own]
    names = _ended(exact_ids(joined(data), start, end, word), words)
    del own, word, start, end
    order, common = suffix_array(names, window, window)
    node = np.empty(len(order), order.dtype)  # of each suffix: the highest internal node of at least a window's words above it
    node[order] = np.cumsum(common < window, dtype=node.dtype)
    del names, order, common
    row, at = windows(1)
    node, doc = node[at], ids[row]
    within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    del at
    least = np.full(node.max(initial=0) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, doc)
    return _runs(doc, (sums * _PLACE + place)[row] + within, row, doc > least[node])


def _grouped(window: int):
    """Runs from packets in the order of their buckets; one bucket is held at a time."""

    def run(batches):
        bucket, held = None, []
        for b in batches:
            for k, n, packed in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if k != bucket and held:
                    if (found := _tree(held, window)) is not None:
                        yield found
                    held = []
                bucket = k
                held.append((n, packed))
        if held and (found := _tree(held, window)) is not None:
            yield found

    return run


def _widest(docs: DataFrame, window: int, prefixes: tuple[int, ...], long: list[np.ndarray]) -> DataFrame:
    """Runs of windows that have more bytes than a group by themselves.

    There are at most MOST of these, so their smallest documents come to the driver and go out with the function.  Windows
    are told by 128 bits here.
    """

    def windows(batch):
        for ids, texts in _encoded(batch):
            for k, s in enumerate(_levels(texts, window, prefixes, long)):
                if k == len(prefixes):
                    yield ids, texts, s, run_hashes(s.words.hashes(1), window, 1)[s.first]

    def least(batches):
        for b in batches:
            for ids, _, s, check in windows(b):
                yield pa.record_batch([pa.array(s.prefix.view(np.int64)), pa.array(check.view(np.int64)), pa.array(ids[s.text])], ["win", "other", "doc_id"])

    got = _rows(docs).mapInArrow(least, "win long, other long, doc_id long").groupBy("win", "other").agg(F.min("doc_id").alias("doc_id")).collect()
    first = {(r.win, r.other): r.doc_id for r in got}

    def run(batches):
        for b in batches:
            for ids, texts, s, check in windows(b):
                sums = np.fromiter((zlib.crc32(t) for t in texts), np.int64, len(texts))
                doc, follows = ids[s.text], np.append(0, np.cumsum(np.diff(s.first) != 1))
                smallest = np.fromiter((first[x] for x in zip(s.prefix.view(np.int64).tolist(), check.view(np.int64).tolist(), strict=True)), np.int64, len(doc))
                yield _runs(doc, sums[s.text] * _PLACE + s.places(), follows * (len(texts) + 1) + s.text, doc > smallest)

    return _rows(docs).mapInArrow(run, _RUNS)


def repeats(docs: DataFrame, window: int = WINDOW, prefixes: tuple[int, ...] | None = None) -> DataFrame:
    """doc_id, place and n: runs of windows that a document with a smaller id holds too."""
    prefixes = tuple(p for p in PREFIXES if p < window) + (window,) if prefixes is None else prefixes
    long = long_prefixes(docs, window, prefixes)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(docs), -(-4 * size // GROUP_BYTES))  # stretches have 3 to 4 times the bytes of the texts
    packets = _packets(docs, window, prefixes, long, buckets)
    found = packets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_keeping(_grouped(window)), _RUNS)
    return found.unionByName(_widest(docs, window, prefixes, long)) if len(long) == len(prefixes) else found


def maximal_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, first_word and n_words of the longest stretches of words of each document all of whose windows a document with a
    smaller id holds too; of rows with one id each counts by itself."""
    found = repeats(docs, window).select("doc_id", F.expr(f"place div {_PLACE}").alias("_sum"), F.expr(f"place % {_PLACE}").alias("a"), (F.expr(f"place % {_PLACE}") + F.col("n")).alias("b"))
    order = Window.partitionBy("doc_id", "_sum").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))  # runs that touch are one stretch of windows
    joined = found.withColumn("_g", F.sum(F.when(F.coalesce(F.col("a") > reach, F.lit(True)), 1).otherwise(0)).over(order))
    out = joined.groupBy("doc_id", "_sum", "_g").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return out.select("doc_id", F.col("a").cast("long").alias("first_word"), (F.col("b") - F.col("a") + window - 1).cast("long").alias("n_words"))


def squeezed(docs: DataFrame) -> DataFrame:
    """docs with `packed`, the compressed UTF-8 text, in place of text, and its crc32: texts travel compressed to the join."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            texts = [None if t is None else t.encode() for t in b.column(len(names)).to_pylist()]
            packed = pa.array([None if t is None else squeeze(t) for t in texts], pa.binary())
            sums = pa.array([None if t is None else zlib.crc32(t) for t in texts], pa.int64())
            yield pa.record_batch([*b.columns[:-1], packed, sums], [*names, "packed", "_sum"])

    rows = docs.select(*names, "text")
    return rows.mapInArrow(run, widened(rows.drop("text"), "packed binary, _sum long"))


def unsqueezed(packed: pa.Array) -> list[str | None]:
    out = zstandard.ZstdDecompressor().decompress
    return [None if p is None else out(p).decode() for p in packed.to_pylist()]


def covered(docs: DataFrame, window: int = WINDOW, prefixes: tuple[int, ...] | None = None) -> DataFrame:
    """The rows of docs (doc_id, text and other columns), text `packed`, with `runs`: first windows and lengths of the
    repeats to remove; null where there are none.

    Repeated ids: rows are told apart by the crc32 of the text; of rows with the same id none removes words of another.
    Rows without an id keep all words and remove none.
    """
    found = repeats(docs, window, prefixes).groupBy("doc_id", F.expr(f"cast(place div {_PLACE} as long)").alias("_sum")).agg(F.collect_list(F.struct(F.expr(f"cast(place % {_PLACE} as int)").alias("start"), "n")).alias("runs"))
    keyed = squeezed(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    return keyed.join(found, ["doc_id", "_sum"], "left").drop("_sum")


def spans(runs, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal spans of words (first, after the last) that the windows of the runs cover."""
    out: list[list[int]] = []
    for a, n in sorted((r["start"], r["n"]) for r in runs or ()):
        b = a + n + window - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept_words(text: str | None, runs, window: int = WINDOW) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept words joined by one space, in UTF-8."""
    words = (text or "").encode().split()
    removed, at, kept = 0, 0, []
    for a, b in spans(runs, window):
        kept += words[at:a]
        removed += b - a
        at = b
    return len(words), removed, b" ".join(kept + words[at:] if removed else words)


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut(text: str | None, runs, window: int = WINDOW) -> str | None:
    """The text without the covered words and the blanks after each; other blanks stay."""
    if not runs or text is None:
        return text
    data = text.encode()
    starts = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    out, at = [], 0
    for a, b in spans(runs, window):
        out.append(data[at : starts[a]])
        at = starts[b]
    return b"".join([*out, data[at:]]).decode()


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words, removed words and sha256 of the kept words of each document.

    Null and empty texts have no words.  Texts of fewer words than a window lose none.  An empty table gives no rows.
    """

    def run(batches):
        for b in batches:
            rows = [kept_words(t, r, window) for t, r in zip(unsqueezed(b.column(1)), b.column(2).to_pylist(), strict=True)]
            yield pa.record_batch(
                [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    rows = covered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window)
    return rows.select("doc_id", "packed", "runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows and columns of docs, their texts without the repeats."""

    def run(batches):
        for b in batches:
            texts, runs = unsqueezed(b.column(1)), b.column(2).to_pylist()
            yield pa.record_batch([b.column(0), pa.array([cut(t, r, window) for t, r in zip(texts, runs, strict=True)], pa.string())], ["row", "text"])

    other = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    rows = covered(docs.select(other, "doc_id", "text"), window).select("row", "packed", "runs")
    out = rows.mapInArrow(run, widened(rows.select("row"), "text string"))
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
