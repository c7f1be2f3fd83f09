"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SIZES = (256, 512, 1024, 2048, 4096)
#: About so many pieces are packed together.
GROUP = 8192


def cost(size: int) -> float:
    """What a sequence costs: a fixed part, a part by its length, and attention by the square of it."""
    return 64.0 + size + size * size / 8192


def best_fit(lengths: list[int], sizes: tuple[int, ...], most: int) -> tuple[list[int], list[int], float]:
    """(bin of each piece, size of each bin, cost); lengths fall, from at most max(sizes) down to 1.

    A piece goes to the open bin that it leaves the least room in.  If none has room, a bin is opened of the size with
    the least cost a token, if it fills up with the pieces to come that fit; larger sizes than `most` only where the
    piece needs one.  In the end each bin shrinks to the least size that holds its contents.
    """
    ends = np.append(np.cumsum(np.asarray(lengths[::-1], np.int64))[::-1], 0)  # tokens from each piece on
    rising = lengths[::-1]
    room: dict[int, list[int]] = {}
    bits, bins, capacity, used = 0, [], [], []
    for i, length in enumerate(lengths):
        fit = bits >> length
        if fit:
            left = length + (fit & -fit).bit_length() - 1
            stack = room[left]
            k = stack.pop()
            if not stack:
                bits ^= 1 << left
        else:
            choice = [s for s in sizes if length <= s <= most] or [next(s for s in sizes if length <= s)]
            best = None
            for s in choice:
                later = max(i + 1, len(lengths) - bisect_left(rising, s - length + 1))
                each = cost(s) / min(s, length + int(ends[later]))
                if best is None or each < best[0]:
                    best = each, s
            left, k = best[1], len(capacity)
            capacity.append(left)
            used.append(0)
        bins.append(k)
        used[k] += length
        left -= length
        if left:
            room.setdefault(left, []).append(k)
            bits |= 1 << left
    final = [next(s for s in sizes if u <= s) for u in used]
    return bins, final, sum(map(cost, final))


def packed_group(lengths: list[int], sizes: tuple[int, ...]) -> tuple[list[int], list[int], float]:
    """The cheapest of the packings under each limit of the sizes that may be opened freely."""
    return min((best_fit(lengths, sizes, most) for most in sizes), key=lambda x: x[2])


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def packed(docs: DataFrame, sizes: tuple[int, ...] = SIZES, length: Column | None = None, group: int = GROUP) -> DataFrame:
    """doc_id, piece, first, n_tokens, bin, bin_size and offset: where each piece of each document goes.

    length: tokens of a document, its words unless given.  Longer documents than the largest size are cut into pieces of
    that size and a rest, so all tokens are packed.  Pieces are dealt out by a hash of the id, the piece and its tokens to
    groups of about `group` pieces, each packed by itself, so places don't depend on the layout of files; the ids of bins
    are unique.  Null and empty texts have one piece of no tokens, and a null bin.  Equal rows are packed as often as they
    occur, told apart by a number, so a repeated or null id is spread like others.  Ties of length go by id, piece and that
    number.  An empty table gives no rows; other columns don't matter.
    """
    sizes = tuple(sorted(sizes))
    top = sizes[-1]
    n = F.greatest(F.lit(0), F.coalesce(length if length is not None else word_count(F.col("text")), F.lit(0))).cast("long")
    whole = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n")))
    same = whole.groupBy("doc_id", "n").agg(F.count("*").alias("times"))  # equal rows are told apart by a number
    each = same.select("doc_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / top))))
    pieces = each.select("doc_id", "n", "copy", piece.alias("piece")).select("doc_id", "copy", "piece", (F.col("piece") * top).alias("first"), F.least(F.lit(top), F.col("n") - F.col("piece") * top).alias("n_tokens"))
    count = whole.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / top)))).first()[0] or 0
    groups = max(1, -(-count // group))
    dealt = pieces.where("n_tokens > 0").withColumn("_group", F.pmod(F.xxhash64("doc_id", "copy", "piece", "n_tokens"), F.lit(groups)))

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece", "copy"], ascending=[False, True, True, True], kind="stable")
        bins, size, _ = packed_group(rows.n_tokens.tolist(), sizes)
        before, filled = [], [0] * len(size)
        for k, t in zip(bins, rows.n_tokens, strict=True):
            before.append(filled[k])
            filled[k] += t
        return rows.assign(bin=(int(key[0]) << 24) + np.asarray(bins, np.int64), bin_size=np.asarray(size, np.int64)[bins], offset=before)[["doc_id", "piece", "first", "n_tokens", "bin", "bin_size", "offset"]]

    schema = "doc_id long, piece long, first long, n_tokens long, bin long, bin_size long, offset long"
    none = pieces.where("n_tokens = 0").select("doc_id", "piece", "first", "n_tokens", F.lit(None).cast("long").alias("bin"), F.lit(0).cast("long").alias("bin_size"), F.lit(0).cast("long").alias("offset"))
    return dealt.groupBy("_group").applyInPandas(run, schema).unionByName(none)
