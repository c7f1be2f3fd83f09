"""How the sources of each language differ in their words, in exact whole numbers.

Sorted streams: a slice of texts is sorted by language, term, source and document and scanned run by run, which gives the
documents and occurrences of each term where the texts lie.  These partial runs are dealt out by language and term, sorted
again and scanned once more as a stream; a task holds one run at a time.  Runs of enough documents become one row each.  A
second stream over these rows, with the totals of the sources at hand, hands on partial sums of every two sources and the
first terms of every source.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, slices, stored

#: Bytes of terms: letters and all that isn't ASCII.
LETTERS = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Documents of a language that a term occurs in, at least; smoothing: counts are raised by this and shares are parts of UNIT.
LEAST, MORE, UNIT = 10, 2, 1_000_000_000
TERMS = 10
#: Partial runs that a task gathers before it merges them, and those that it keeps on gathering after that.
GATHERED, KEPT = 1_000_000, 500_000
#: Groups of language and source whose totals are sent to all tasks at once; beyond that languages are dealt out to passes.
GROUPS = 200_000
#: Sources of a side of a tile of partial sums; numbers worked on at once; tiles that a task holds.
TILE, AT_ONCE, TILES = 1024, 1 << 20, 8
#: Bytes of a text that are scanned at once.
PIECE = 500_000

_RUN = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("source", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])


def changes(*columns) -> np.ndarray:
    """Where a row differs from the one before it; the first always does."""
    n = len(columns[0])
    out = np.ones(n, bool)
    if n > 1:
        out[1:] = False
        for c in columns:
            c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            out[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c[1:] != c[:-1]
    return out


def pieces(text: bytes, size: int | None = None):
    """A text in pieces of about so many bytes, cut where no term is."""
    size = size or PIECE
    a = 0
    while len(text) - a > size:
        b = a + size
        while b < len(text) and LETTERS[text[b]]:
            b += 1
        yield text[a:b]
        a = b
    yield text[a:]


def term_runs(texts: list[bytes], groups: np.ndarray) -> pa.Table:
    """group, term, docs and n of a slice of texts, by a sort of (term, group, document) and a scan of its runs.

    groups: a number for the language and source of each text.
    """
    w = Words(texts, LETTERS)
    if not len(w.start):
        return pa.table({"group": pa.array([], pa.int32()), "term": pa.array([], pa.binary()), "docs": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    flat = _LOWER[w.data[LETTERS[w.data]]]
    ends = np.append(0, np.cumsum(w.end - w.start)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(w.start), [None, pa.py_buffer(ends), pa.py_buffer(flat)]).dictionary_encode()
    order = np.argsort(groups, kind="stable")  # documents by group
    place = np.empty(len(texts), np.int64)
    place[order] = np.arange(len(texts))
    key = coded.indices.to_numpy().astype(np.int64) * len(texts) + np.repeat(place, w.counts)
    key.sort()
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))  # runs of a term in a document
    n = np.diff(np.append(start, len(key)))
    term, group = key[start] // len(texts), groups[order][key[start] % len(texts)]
    run = np.flatnonzero(changes(term, group))  # runs of a term in a group
    return pa.table({"group": pa.array(group[run].astype(np.int32)), "term": coded.dictionary.take(pa.array(term[run])), "docs": pa.array(np.diff(np.append(run, len(term)))), "n": pa.array(np.add.reduceat(n, run))})


def _merged(tables: list[pa.Table], docs: str = "sum") -> pa.Table:
    one = pa.concat_tables(tables).group_by(["group", "term"]).aggregate([("docs", docs), ("n", "sum")])
    return one.rename_columns(["group", "term", "docs", "n"]).combine_chunks()


def partial_runs(docs: DataFrame) -> DataFrame:
    """lang, term, source, docs and n: what every task has counted, a row or a few for each of its terms and sources."""

    def run(batches):
        codes: dict[tuple[str, str], int] = {}
        gathered: list[pa.Table] = []

        def merged() -> list[pa.Table]:
            return [_merged(gathered)] if gathered else []

        def rows():
            for t in gathered:
                names = list(codes)
                langs, sources = (pa.array([k[i] for k in names], pa.string()) for i in (0, 1))
                yield from pa.table([langs.take(t["group"].combine_chunks()), t["term"], sources.take(t["group"].combine_chunks()), t["docs"], t["n"]], schema=_RUN).to_batches(max_chunksize=50_000)

        for b in batches:
            texts = [t or b"" for t in b.column(2).to_pylist()]
            pairs = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            groups = np.array([codes.setdefault(p, len(codes)) for p in pairs], np.int64)
            for first, last in slices(texts, PIECE):
                if last == first + 1 and len(texts[first]) > PIECE:
                    parts = [term_runs([p], groups[first:last]) for p in pieces(texts[first])]
                    gathered.append(_merged(parts, "max"))  # one document
                else:
                    gathered.append(term_runs(texts[first:last], groups[first:last]))
                if sum(map(len, gathered)) > GATHERED:
                    gathered = merged()
                    if len(gathered[0]) > KEPT:
                        yield from rows()
                        gathered = []
            if len(codes) > KEPT:
                gathered = merged()
                yield from rows()
                gathered = []
                codes.clear()
        gathered = merged()
        yield from rows()

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text")]
    return docs.select(text[0].alias("lang"), text[1].alias("source"), text[2].cast("binary").alias("text")).mapInArrow(run, "lang string, term binary, source string, docs long, n long")


def runs(partial: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, docs, total, sources and counts of the terms in at least so many documents of a language.

    sources rise; counts are the occurrences in each.
    """
    row = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("total", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def scan(batches):
        held = None  # of the run that may go on, a row for each source

        def finished(t: pa.Table):
            """Whole runs."""
            if not len(t):
                return
            start = np.flatnonzero(changes(t["lang"], t["term"]))
            docs, total = (np.add.reduceat(t[c].to_numpy(), start) for c in ("docs", "n"))
            size = np.diff(np.append(start, len(t)))
            keep = docs >= least
            own = t.filter(pa.array(np.repeat(keep, size)))
            first = pa.array(start[keep])
            ends = pa.array(np.append(0, np.cumsum(size[keep])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, own[c].combine_chunks()) for c in ("source", "n")]
            whole = t.select(["lang", "term"]).take(first)
            yield from pa.table([whole["lang"], whole["term"], pa.array(docs[keep]), pa.array(total[keep]), *lists], schema=row).to_batches(max_chunksize=5_000)

        for b in batches:
            t = pa.Table.from_batches([b]).cast(_RUN)
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if not len(t):
                continue
            start = np.flatnonzero(changes(t["lang"], t["term"], t["source"]))
            sums = [pa.array(np.add.reduceat(t[c].to_numpy(), start)) for c in ("docs", "n")]
            t = pa.table([*(t.select(["lang", "term", "source"]).take(pa.array(start)).columns), *sums], schema=_RUN)
            last = int(np.flatnonzero(changes(t["lang"], t["term"]))[-1])
            held = t.slice(last)
            yield from finished(t.slice(0, last))
        if held is not None:
            yield from finished(held)

    dealt = partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(scan, "lang string, term binary, docs long, total long, sources array<string>, counts array<long>")


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + MORE) / whole), exact where 1000 * whole fits a long."""
    left = np.asarray(count, np.int64) + MORE
    out, left = left // whole, left % whole
    for _ in range(3):  # three digits at a time
        left = left * 1000
        out, left = out * 1000 + left // whole, left % whole
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def audited(kept: DataFrame, totals: dict, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item and value: partial sums of pairs, less what they are for a term that neither has, and the
    first terms of each source, of every task.

    totals: for each language the sources (sorted), the occurrences of kept terms in each and in all, and the kept terms.
    """
    sent = kept.sparkSession.sparkContext.broadcast(totals)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())])

    def run(batches):
        known = sent.value
        tiles: OrderedDict[tuple, np.ndarray] = OrderedDict()
        best: dict[str, pa.Table] = {}

        def pairs(key, sums):
            lang, i, j = key
            names = pa.array(known[lang][0], pa.string())
            a, b = np.nonzero(sums)
            left, right = (names.take(pa.array(x)) for x in (a + i * TILE, b + j * TILE))
            for one, two in ((left, right), (right, left)):
                yield from pa.table([pa.array([lang] * len(a), pa.string()), one, pa.array(["pair"] * len(a), pa.string()), two.cast(pa.binary()), pa.array(sums[a, b])], schema=schema).to_batches(max_chunksize=50_000)

        for batch in batches:
            for lang, i, j in dict.fromkeys(zip(batch.column("lang").to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True)):
                same = pc.and_(pc.equal(batch.column("lang"), lang), pc.and_(pc.equal(batch.column("i"), i), pc.equal(batch.column("j"), j)))
                own = batch.filter(same)
                names, n, n_all, v = known[lang]
                n, lists = np.asarray(n, np.int64), own.column("sources")
                row = np.repeat(np.arange(own.num_rows), np.diff(lists.offsets.to_numpy()))
                source = pc.index_in(lists.flatten(), value_set=pa.array(names, pa.string())).to_numpy()
                p = shares(own.column("counts").flatten().to_numpy(), n[source] + MORE * v)
                if i == 0 and j == 0:
                    q = shares(own.column("total").to_numpy(), n_all + MORE * v)[row]
                    up = np.flatnonzero(p > q)
                    found = pa.table({"source": pa.array(source[up].astype(np.int32)), "value": pa.array(apart(p[up], q[up])), "term": own.column("term").take(pa.array(row[up]))})
                    found = pa.concat_tables([found, *([best[lang]] if lang in best else [])])
                    found = found.take(pc.sort_indices(found, [("source", "ascending"), ("value", "descending"), ("term", "ascending")])).combine_chunks()
                    at = found["source"].to_numpy()
                    start = np.flatnonzero(changes(at))
                    rank = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
                    best[lang] = found.filter(pa.array(rank < terms))
                nothing = shares(np.zeros(len(n)), n + MORE * v)
                key = (lang, i, j)
                if key not in tiles:
                    while len(tiles) >= TILES:
                        old = tiles.popitem(last=False)
                        yield from pairs(*old)
                    tiles[key] = np.zeros((len(n[i * TILE : (i + 1) * TILE]), len(n[j * TILE : (j + 1) * TILE])), np.int64)
                tiles.move_to_end(key)
                sums, columns = tiles[key], np.arange(j * TILE, min(len(n), (j + 1) * TILE))
                step = max(1, AT_ONCE // len(columns))
                for r in range(0, own.num_rows, step):
                    here = (row >= r) & (row < r + step)
                    to_right = here & (source // TILE == j)
                    other = np.tile(nothing[columns], (min(step, own.num_rows - r), 1))  # shares of the right side by row
                    other[row[to_right] - r, source[to_right] - columns[0]] = p[to_right]
                    held = np.zeros(other.shape, bool)
                    held[row[to_right] - r, source[to_right] - columns[0]] = True
                    left = np.flatnonzero(here & (source // TILE == i))
                    left = left[np.argsort(source[left], kind="stable")]
                    for a in range(0, len(left), step):
                        some = left[a : a + step]
                        s, at = source[some], row[some] - r
                        more = apart(p[some][:, None], other[at]) - apart(nothing[s][:, None], nothing[columns][None])
                        more[held[at] & (columns[None] <= s[:, None])] = 0  # where both have the term, the smaller source counts it
                        more[columns[None] == s[:, None]] = 0
                        start = np.flatnonzero(changes(s))
                        sums[s[start] - i * TILE] += np.add.reduceat(more, start, axis=0)
        for one in tiles.items():
            yield from pairs(*one)
        for lang, found in best.items():
            names = pa.array(known[lang][0], pa.string())
            yield from pa.table([pa.array([lang] * len(found), pa.string()), names.take(found["source"].combine_chunks()), pa.array(["term"] * len(found), pa.string()), found["term"], found["value"]], schema=schema).to_batches(max_chunksize=50_000)

    # a language of very many sources is worked on in tiles of pairs of them
    wide = {g: -(-len(t[0]) // TILE) for g, t in totals.items() if len(t[0]) > TILE}
    side = F.lit(1)
    if wide:
        side = F.coalesce(F.create_map(*[F.lit(x) for kv in wide.items() for x in kv])[F.col("lang")], F.lit(1))
    each = kept.withColumn("_s", side).withColumn("i", F.explode(F.expr("sequence(0, _s - 1)"))).withColumn("j", F.explode(F.expr("sequence(0, _s - 1)")))
    each = each.sortWithinPartitions("lang", "i", "j") if wide else each
    return each.select("lang", "term", "total", "sources", "counts", "i", "j").mapInArrow(run, "lang string, source string, part string, item binary, value long").withColumn("item", F.col("item").cast("string"))


def groups_of(docs: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lang, source and n of every group that occurs; lang, n_all and v of every language with kept terms."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("total").alias("n_all"), F.count("*").alias("v"))
    return named.join(each, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0))), langs


def audit(docs: DataFrame, least: int = LEAST, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source's words are from each other source's of the language
    (part pair), and its own words that stand out most from the language (part term, the first `terms`).

    Null languages, sources and texts count as empty strings; every row is a document, whatever its id, so repeated rows
    and null ids count as often as they occur.  Texts of any length are read whole, in pieces.  A group without terms takes
    part in pairs; a language of one source has no pairs, and where no term is in `least` documents all pairs are 0.  Ties go
    by item, in the order of UTF-8.  An empty table gives no rows; other columns don't matter.
    """
    spark = docs.sparkSession
    kept = stored(runs(partial_runs(docs), least))
    groups, langs = groups_of(docs, kept)
    groups, langs = stored(groups), stored(langs)
    waves = max(1, -(-groups.count() // GROUPS))
    wave = F.pmod(F.xxhash64("lang"), F.lit(waves))
    out = []
    for k in range(waves):
        own, known = groups.where(wave == k), {r.lang: (r.n_all, r.v) for r in langs.where(wave == k).collect()}
        by_lang: dict[str, list] = {}
        for r in own.orderBy("lang", "source").collect():  # about GROUPS rows
            if r.lang in known:
                by_lang.setdefault(r.lang, []).append((r.source, r.n))
        totals = {g: ([s for s, _ in rows], [n for _, n in rows], *known[g]) for g, rows in by_lang.items()}
        found = stored(audited(kept.where(wave == k), totals, terms))
        # what a pair's sum is if no term occurred in either: the same for every term
        base = own.join(F.broadcast(langs.where(wave == k)), "lang", "left").withColumn("p", F.expr(f"case when v > 0 then {UNIT * MORE} div (n + {MORE} * v) + 1 end"))
        other = F.broadcast(base.select("lang", F.col("source").alias("item"), F.col("p").alias("q")))
        empty = base.join(other, "lang").where("source <> item").select("lang", "source", "item", F.expr("coalesce(v * (((p - q) * (p - q)) div (p + q)), 0)").alias("value"))
        sums = found.where("part = 'pair'").select("lang", "source", "item", "value").unionByName(empty).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        out += [sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value"), found.where("part = 'term'")]
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= terms)).select("lang", "source", "part", "item", "value", "rank")
