"""Near-duplicates by ProbMinHash, banding and exact verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, checkpointed, hot_join, hot_keys, local, mix, partitions, run_hashes, slices, stored

SHINGLE, SIMILARITY = 5, 0.8
#: Registers are split into bands of so many rows: a pair of similarity 0.8 meets in a band with 1 - 3e-6.
BANDS, ROWS = 24, 4
#: Texts and bytes of shingles of a bucket that one task compares; of larger buckets it compares two blocks of half as much.
PART, PART_BYTES = 2048, 32 << 20
#: Rows whose overlaps with all texts of a task are held at once; a multiple of 128.
OVERLAPS = 512
#: Tasks that the pairs of one text are spread over, at most.
SALTS = 4096

#: Texts with a partner up to which their numbers and hashes are broadcast: 32 bytes each.
SENT = 500_000

_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GOLD, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_IDS = np.uint64((1 << 24) - 1)


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hash, its text and its count, by text and hash; and a 128-bit hash of the words of each text.

    Words are runs of ASCII letters, digits and other characters beyond ASCII; A-Z are lowered.  A text of fewer words
    than a shingle is one shingle; one without words has none and is told by its bytes.
    """
    w = Words([t.translate(_LOWER) for t in texts], _IN_WORD)
    h = w.hashes()
    grams = run_hashes(h, size)
    doc = np.repeat(np.arange(len(texts)), w.counts)
    inside = doc[: len(grams)] == doc[size - 1 : size - 1 + len(grams)] if len(grams) else np.empty(0, bool)
    value, of = grams[inside], doc[: len(grams)][inside]
    few = np.flatnonzero((w.counts > 0) & (w.counts < size))
    short = np.fromiter((run_hashes(h[w.first[i] : w.first[i + 1]], int(w.counts[i]), 1)[0] for i in few), np.uint64, len(few))
    value, of = np.concatenate([value, short]), np.concatenate([of, few])
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    head = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (of[1:] != of[:-1]))) if len(value) else np.empty(0, np.int64)
    count = np.diff(np.append(head, len(value)))
    whole = np.zeros((len(texts), 2), np.uint64)
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(w.first[:-1], w.counts).astype(np.uint64)
    for k, words in enumerate((h, w.hashes(1))):
        np.add.at(whole[:, k], doc, mix(words + place * _GOLD))
    for i in np.flatnonzero(w.counts == 0):
        whole[i] = np.frombuffer(hashlib.blake2b(texts[i], digest_size=16).digest(), np.uint64)
    return value[head], of[head], count, whole


def prob_min_hash(value: np.ndarray, of: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """24-bit ids of the earliest element in each register of each text; two texts agree in a register with probability J_P.

    Each element is a Poisson process whose rate is its weight; each arrival goes to a random register.  An element
    stops once its next arrival is later than the latest first arrival of the text's registers.
    """
    if not len(value):
        return np.zeros((texts, registers), np.uint64)
    best = np.full(texts * registers, np.iinfo(np.uint64).max, np.uint64)
    has = np.unique(of)
    time, state = np.zeros(len(value)), value.copy()
    ids, base, rate = mix(value * _TWO) & _IDS, of * registers, weight.astype(float)
    while len(value):
        block = 1 if len(value) > 20_000 else 16
        draw = mix(state[:, None] + np.arange(1, block + 1, dtype=np.uint64) * _GOLD)
        state = state + np.uint64(block * int(_GOLD) % 2**64)
        arrival = time[:, None] + np.cumsum(-np.log(((draw >> np.uint64(12)).astype(float) + 0.5) / 2.0**52), 1) / rate[:, None]
        slot = base[:, None] + ((mix(draw ^ _TWO) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        key = (arrival.view(np.uint64) & ~_IDS) | ids[:, None]
        np.minimum.at(best, slot.ravel(), key.ravel())
        latest = np.zeros(texts, np.uint64)
        latest[has] = best.reshape(texts, registers)[has].max(1)
        time = arrival[:, -1]
        going = np.flatnonzero(key[:, -1] <= latest[base // registers])
        time, state, ids, base, rate, value = time[going], state[going], ids[going], base[going], rate[going], value[going]
    return best.reshape(texts, registers) & _IDS


def sketched(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, h1, h2 (hash of the words) and the hash of each band; no bands for a text without words."""
    multiplier = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), [(t or "").encode() for t in b.column(1).to_pylist()]
            for first, last in slices(texts):
                n = last - first
                value, of, count, whole = shingles(texts[first:last])
                registers = prob_min_hash(value, of, count, n, bands * rows).reshape(n, bands, rows)
                hashed = mix((registers * multiplier).sum(2) + np.arange(1, bands + 1, dtype=np.uint64) * _GOLD).view(np.int64)
                have = np.zeros(n, bool)
                have[of] = True
                ends = np.zeros(n + 1, np.int32)
                np.cumsum(have * bands, out=ends[1:])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashed[have].ravel()))
                yield pa.record_batch([ids.slice(first, n), pa.array(whole[:, 0].view(np.int64)), pa.array(whole[:, 1].view(np.int64)), lists], ["doc_id", "h1", "h2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, h1 long, h2 long, bands array<long>")


def likeness(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets, given as sorted unique elements and weights."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    w, v = wa[i].astype(float), wb[j].astype(float)
    order = np.argsort(v / w, kind="stable")
    w, v = w[order], v[order]
    ratio = v / w
    upto = np.searchsorted(ratio, ratio, "right")
    lower, upper = np.append(0, np.cumsum(w))[upto], v.sum() - np.append(0, np.cumsum(v))[upto]
    return float((1 / ((wa.sum() - w.sum() + lower) / w + (wb.sum() - v.sum() + upper) / v)).sum())


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, the hash of the words, and the shingles: 32-bit hashes, then their counts unless all are 1."""

    def run(batches):
        for b in batches:
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            out, names = [], []
            for first, last in slices(texts):
                value, of, count, whole = shingles(texts[first:last])
                names.append(whole.view(np.int64))
                cuts = np.searchsorted(of, np.arange(last - first + 1))
                for x, y in zip(cuts, cuts[1:], strict=False):
                    v, k = np.unique((value[x:y] >> np.uint64(32)).astype(np.uint32), return_inverse=True)
                    c = np.bincount(k, count[x:y]).astype(np.uint32)
                    out.append((len(v), v.tobytes() + (c.tobytes() if len(c) and c.max() > 1 else b"")))
            names = np.concatenate(names) if names else np.empty((0, 2), np.int64)
            yield pa.record_batch([b.column(0), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["doc_id", "h1", "h2", "size", "data"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h1 long, h2 long, size int, data binary")


def _unpacked(size: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, np.uint32)
    return x[:size], x[size:] if len(x) > size else np.ones(size, np.uint32)


def verified(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs a, b whose exact similarity is at least so much."""

    def run(batches):
        for b in batches:
            ids_a, ids_b, sa, da, sb, db = (b.column(k).to_pylist() for k in range(6))
            keep, known, own = [], None, None
            for i in range(b.num_rows):
                if known != ids_a[i]:
                    known, own = ids_a[i], _unpacked(sa[i], da[i])
                other = _unpacked(sb[i], db[i])
                if min(sa[i], sb[i]) > 0 and likeness(*own, *other) >= least - 1e-9:
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("size").alias("sa"), F.col("data").alias("da"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("size").alias("sb"), F.col("data").alias("db"))
    hot, keys = hot_keys(pairs, ["a"]), ["a"]
    if hot is not None:  # a text with very many pairs is sent to several tasks, each with some of its pairs
        hot, keys = F.broadcast(hot.select("a", F.least(F.ceil(F.col("_n") / 64), F.lit(SALTS)).cast("int").alias("_salts"))), ["a", "_salt"]
        salts = F.coalesce("_salts", F.lit(1))
        left = left.join(hot, "a", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
        pairs = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("_salt"))
    return pairs.join(right, "b").join(left, keys).select("a", "b", "sa", "da", "sb", "db").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id and the smallest id (root) of its connected component, for ids with links.

    Each round takes the smallest root of the neighbours, for an old root that of its members' neighbours too, and then
    the root's root; so whole trees are hooked at once, and rounds hardly grow with the length of a chain.  Roots only
    fall; when none does, neighbours have equal ones.  Hot ids are aggregated map-side, and hubs and the roots of very many
    ids are joined by broadcast.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    hubs = hot_keys(both, ["b"])
    root = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("r")).select("id", F.least("id", "r").alias("root")))
    ids = root.count()
    while True:
        near = hot_join(both, root.withColumnsRenamed({"id": "b"}), ["b"], hubs).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("r"))
        seen = root.join(near, "id").select("id", F.least("root", "r").alias("root"), F.col("root").alias("old"))
        hook = seen.groupBy(F.col("old").alias("id")).agg(F.min("root").alias("r"))
        step = checkpointed(seen.join(hook, "id", "left").select("id", F.least("root", "r").alias("root"), "old"))
        top = step.select(F.col("id").alias("root"), F.col("root").alias("up"))
        nxt = checkpointed(hot_join(step, top, ["root"], hot_keys(step, ["root"], ids)).select("id", F.least("up", "root").alias("root"), "old"))
        moved = nxt.where(F.col("root") != F.col("old")).limit(1).count()
        root = nxt.select("id", "root")
        if not moved:
            return root


def joined_components(root: DataFrame, links: DataFrame) -> DataFrame:
    """id and root as by `components` after more links: only the components that these join are worked on."""
    ends = links.select("a", "b").join(root.withColumnsRenamed({"id": "a", "root": "_a"}), "a", "left").select(F.coalesce("_a", "a").alias("a"), "b")
    ends = ends.join(root.withColumnsRenamed({"id": "b", "root": "_b"}), "b", "left").select("a", F.coalesce("_b", "b").alias("b"))
    up = stored(components(ends.where("a <> b")).select(F.col("id").alias("root"), F.col("root").alias("up")))
    moved = hot_join(root, up, ["root"], hot_keys(root, ["root"]), "left").select("id", F.coalesce("up", "root").alias("root"))
    alone = up.select(F.col("root").alias("id"), F.col("up").alias("root")).join(root.select("id"), "id", "left_anti")
    return checkpointed(moved.unionByName(alone))


def missing_links(ids: np.ndarray, roots: np.ndarray, sets: list, least: float = SIMILARITY, split: int = 0) -> list[tuple[int, int]]:
    """Links that join the components of some texts: every pair of texts of different components is compared.

    With a split, only pairs of one of the first so many texts and one of the others.

    Overlaps are one matrix product over the shingles that two or more of the texts have.  They settle pairs without
    repeated shingles; for others, the shared part of either text's weight bounds the similarity, which is then computed.
    """
    n = len(ids)
    _, comp = np.unique(roots, return_inverse=True)
    if comp.max(initial=0) == 0:
        return []
    size = np.array([len(v) for v, _ in sets])
    plain = np.array([w.max(initial=1) == 1 for _, w in sets])
    row = np.repeat(np.arange(n), size)
    share = np.concatenate([w / max(1, w.sum()) for _, w in sets]).astype(np.float32)
    _, column, found = np.unique(np.concatenate([v for v, _ in sets]), return_inverse=True, return_counts=True)
    common = found[column] > 1
    row, column, share = row[common], column[common], share[common]
    _, column = np.unique(column, return_inverse=True)
    width = int(column.max(initial=-1)) + 1
    rows, first = split or n, split  # rows x columns from first on are compared

    def overlaps(a: int, b: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Shared shingles of the rows from a to b with all columns, and either text's weight of these where weights differ."""
        both, part = np.zeros((b - a, n - first), np.float32), None if plain.all() else np.zeros((2, b - a, n - first), np.float32)
        for c in range(0, width, step := max(1, 2_000_000 // n)):
            own = (column >= c) & (column < c + step)
            have = np.zeros((n, min(step, width - c)), np.float32)
            have[row[own], column[own] - c] = 1
            both += have[a:b] @ have[first:].T
            if part is not None:
                weight = np.zeros_like(have)
                weight[row[own], column[own] - c] = share[own]
                part[0] += weight[a:b] @ have[first:].T
                part[1] += have[a:b] @ weight[first:].T
        return both, part

    up = list(range(comp.max() + 1))

    def top(c: int) -> int:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    out = []
    for a in range(0, rows, 128):  # some rows at a time, to keep little besides the overlaps
        if a % OVERLAPS == 0:
            both = part = None  # not held beside the next ones
            both, part = overlaps(a, min(rows, a + OVERLAPS))
        own, at = slice(a, min(rows, a + 128)), slice(a % OVERLAPS, a % OVERLAPS + 128)
        overlap = both[at]
        alike = overlap >= (least - 1e-6) * np.maximum(1, size[own, None] + size[None, first:] - overlap)
        if part is not None:
            alike = np.where(plain[own, None] & plain[None, first:], alike, part[:, at].min(0) >= least - 1e-4)
        alike &= (comp[own, None] != comp[None, first:]) & (np.arange(first, n)[None] > np.arange(n)[own, None])
        for i, j in zip(*np.nonzero(alike), strict=True):
            i, j = i + a, j + first
            x, y = top(comp[i]), top(comp[j])
            if x != y and min(size[i], size[j]) and likeness(*sets[i], *sets[j]) >= least - 1e-9:
                up[x] = y
                out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


def _compared(members: DataFrame, least: float) -> DataFrame:
    """Links a, b between texts of different components, from rows with bucket, part, id, root, size and data."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [_unpacked(s, d) for s, d in zip(pdf["size"], pdf["data"], strict=True)]
        return pd.DataFrame(missing_links(pdf["id"].to_numpy(), pdf["root"].to_numpy(), sets, least), columns=["a", "b"])

    return members.groupBy("bucket", "part").applyInPandas(run, "a long, b long").distinct()


def _blocks(rooted: DataFrame) -> DataFrame:
    """rooted with the block of each row of a bucket: about a quarter of PART and PART_BYTES on average.

    Rows of one root share a block, unless they are too many for it; then they have blocks of their own hash.
    """
    cost = F.greatest(F.lit(max(1, PART_BYTES // PART)), F.lit(8) * F.col("size"))
    rows = rooted.withColumn("cost", cost)
    by_root = stored(rows.groupBy("bucket", "root").agg(F.sum("cost").alias("own")))
    whole = by_root.groupBy("bucket").agg(F.sum("own").alias("all"))
    block = max(1, PART_BYTES // 4)
    shares = by_root.join(whole, "bucket").select("bucket", "root", F.ceil(F.col("own") / block).alias("split"), F.ceil(F.col("all") / block).alias("blocks"))
    spread = F.pmod(F.xxhash64("id"), F.col("split"))
    return hot_join(rows, shares, ["bucket", "root"], hot_keys(rows, ["bucket", "root"])).withColumn("block", F.pmod(F.xxhash64("root", spread), F.col("blocks"))).drop("cost", "split", "blocks")


def _compared_blocks(blocks: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """As _compared, each pair of blocks in a task of its own; blocks of one component need no comparison."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        pdf = pdf.sort_values("block", kind="stable")
        own = [_unpacked(s, d) for s, d in zip(pdf["size"], pdf["data"], strict=True)]
        split = int((pdf["block"] == i).sum()) if i < j else 0
        return pd.DataFrame(missing_links(pdf["id"].to_numpy(), pdf["root"].to_numpy(), own, least, split), columns=["a", "b"])

    ends = blocks.groupBy("bucket", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    one, two = ends.select("bucket", F.col("block").alias("i"), "lo"), ends.select("bucket", F.col("block").alias("j"), "hi")
    pairs = one.join(two, "bucket").where("i <= j and lo < hi").select("bucket", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    members = blocks.join(pairs, ["bucket", "block"]).join(sets.select(F.col("doc_id").alias("id"), "data"), "id")
    return members.groupBy("bucket", "i", "j").applyInPandas(run, "a long, b long").distinct()


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id, the smallest id of a document's class, for each row of docs.

    Documents are linked if the probability Jaccard similarity of their 5-word shingles, weighted by their counts, is at
    least 0.8; classes are connected components.  Equal words are one text from the start.  Texts that meet in a band's
    bucket are compared exactly with the bucket's smallest id.  In buckets that then still hold several components,
    every pair across components is compared, inside one task for buckets of up to PART texts and PART_BYTES of shingles.
    Larger buckets are dealt out at random to parts of that size, which joins most of what is alike; those that still hold
    several components are cut into blocks, and every two blocks are compared, so that no pair that meets in a bucket is
    left out.  Shingles are compared by 32-bit hashes within a pair, words of a whole text by 128 bits.
    Null and empty texts are alike; texts without a word are told by their bytes; texts of fewer than 5 words are one
    shingle, and of any length are taken whole.  A null id has a null class.  Rows with the same id share a class, the
    smallest of their texts' classes.  Of ties nothing depends.  An empty table gives no rows; other columns don't matter.
    """
    sketch = stored(sketched(docs))
    ids = sketch.where(F.col("doc_id").isNotNull())
    # texts have numbers of their own, as one id may have several texts; doc_id: their smallest
    texts = ids.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.min_by("bands", "doc_id").alias("bands"))
    texts = stored(texts.withColumn("id", F.monotonically_increasing_id()))
    rows = texts.select("id", F.explode("bands").alias("bucket"))
    full = stored(rows.groupBy("bucket").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    often = max(100, BANDS * texts.count() / (16 * partitions(docs)))  # fewer than 16 * partitions buckets hold more rows
    hot = local(full.where(F.col("n") > often).select("bucket"))
    members = stored(hot_join(rows, full, ["bucket"], hot))
    wanted = stored(texts.select("id", "doc_id", "h1", "h2").join(members.select("id").distinct(), "id"))
    near = F.broadcast if wanted.count() <= SENT else lambda df: df  # else whole texts would be shuffled to find these
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(near(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    sets = _packed(own).join(near(wanted), ["doc_id", "h1", "h2"]).groupBy("id").agg(F.first("size").alias("size"), F.first("data").alias("data"))  # rows of one text have one set
    sets = stored(sets.withColumnRenamed("id", "doc_id"))
    pairs = stored(members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    links = stored(verified(pairs, sets, least))
    root = components(links)

    def in_buckets(members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members with root and size, and the buckets of several components."""
        rooted = members.select("bucket", "id").join(root, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
        rooted = rooted.join(sets.select(F.col("doc_id").alias("id"), "size"), "id")
        return rooted, rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.sum(F.lit(8) * F.col("size")).alias("bytes")).where("lo < hi")

    rooted, mixed = in_buckets(members.where("n > 2"))
    parts = F.ceil(F.greatest(F.col("n") / PART, F.col("bytes") / PART_BYTES)).cast("long")
    dealt = hot_join(rooted, mixed.select("bucket", parts.alias("parts")), ["bucket"], hot).withColumn("part", F.pmod(F.xxhash64("bucket", "id"), F.col("parts")))
    more = stored(_compared(dealt.drop("parts").join(sets.select(F.col("doc_id").alias("id"), "data"), "id"), least))
    large = stored(mixed.where((F.col("n") > PART) | (F.col("bytes") > PART_BYTES)).select("bucket"))
    if more.limit(1).count():
        root = joined_components(root, more)
    if large.limit(1).count():
        rooted, mixed = in_buckets(hot_join(members, large, ["bucket"], hot))
        more = stored(_compared_blocks(stored(_blocks(hot_join(rooted, mixed.select("bucket"), ["bucket"], hot))), sets, least))
        root = joined_components(root, more)
    named = stored(texts.select("h1", "h2", "doc_id", "id").join(root, "id", "left").select("h1", "h2", "doc_id", F.coalesce("root", "id").alias("root")))
    least_of = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = hot_join(named.drop("doc_id"), least_of, ["root"], hot_keys(named, ["root"])).select("h1", "h2", "class_id")
    every = ids.select("doc_id", "h1", "h2")
    own = stored(hot_join(every, stored(named), ["h1", "h2"], hot_keys(every, ["h1", "h2"])).groupBy("doc_id").agg(F.min("class_id").alias("class_id")))
    twice = hot_keys(every, ["doc_id"]) if own.count() < every.count() else None
    return hot_join(sketch.select("doc_id"), own, ["doc_id"], twice, "left")


def kept(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each class: the one with the smallest id.  Rows without an id stay."""
    found = classes(docs, **how)
    one = found.where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    out = docs.where(F.col("doc_id").isNull()).unionByName(docs.join(one.select("doc_id"), "doc_id", "left_semi"))
    twice = one.where("rows > 1").limit(1).count()
    return out.where(F.col("doc_id").isNull()).unionByName(out.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])) if twice else out
