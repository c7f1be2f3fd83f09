"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from itertools import batched, chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Leaves of the bitmap have so many bits; the root has a bit for each leaf.
LEAF = 256
#: Pieces merged together have queues with a bucket for so many neighbouring ranks.
BAND = 256
#: So many new pieces, of so many characters at most, are worth merging together, and so many bytes of them at a time.
FEW, SHORT, TOGETHER = 1_000, 64, 1 << 21
#: New pieces are merged together of texts of so many characters, and of so many pieces at most.
STRETCH, MANY = 1 << 22, 1 << 20


def ranks_of(lines) -> dict[bytes, int]:
    """Tokens and their ranks from lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return ranks_of(lines)


class RankQueue:
    """Places of pairs by merge rank: a bucket for each rank, and a two-level bitmap of the buckets that hold any."""

    __slots__ = ("buckets", "leaves", "root")

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.leaves: dict[int, int] = {}
        self.root = 0

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, place)
            return
        self.buckets[rank] = [place]
        leaf = rank // LEAF
        self.leaves[leaf] = self.leaves.get(leaf, 0) | 1 << rank % LEAF
        self.root |= 1 << leaf

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost place."""
        leaf = (self.root & -self.root).bit_length() - 1
        bits = self.leaves[leaf]
        rank = leaf * LEAF + (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        place = heappop(bucket)
        if not bucket:
            bits &= bits - 1
            self.leaves[leaf] = bits
            if not bits:
                self.root &= self.root - 1
        return rank, place

    def __bool__(self) -> bool:
        return self.root != 0


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: always the pair of lowest rank is merged, the leftmost of equals.

    The tokens are a linked list over places.  An entry of the queue is stale, and skipped, if its place has been merged
    away or its pair has changed since.
    """
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    of = ranks.get
    at = [of(piece[i : i + 2], -1) for i in range(n - 1)]
    at.append(-1)
    queue = RankQueue()
    for i, rank in enumerate(at):
        if rank >= 0:
            queue.push(rank, i)
    while queue:
        rank, i = queue.pop()
        if at[i] != rank:
            continue
        gone = after[i]
        end = after[gone]
        after[i], at[gone] = end, -1
        at[i] = -1
        if end < n:
            before[end] = i
            at[i] = of(piece[i : after[end]], -1)
            if at[i] >= 0:
                queue.push(at[i], i)
        left = before[i]
        if left >= 0:
            at[left] = of(piece[left:end], -1)
            if at[left] >= 0:
                queue.push(at[left], left)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class BandQueue(RankQueue):
    """The same for arrays: a bucket holds arrays of places of `BAND` neighbouring ranks, and leaves the queue as a whole."""

    __slots__ = ()

    def push_all(self, ranks: np.ndarray, places: np.ndarray) -> None:
        bands = ranks // BAND
        order = bands.argsort(kind="stable")
        bands, places = bands[order], places[order]
        starts = [0, *(np.flatnonzero(bands[1:] != bands[:-1]) + 1).tolist()]
        for band, a, b in zip(bands[starts].tolist(), starts, [*starts[1:], len(bands)], strict=True):
            if bucket := self.buckets.get(band):
                bucket.append(places[a:b])
            else:
                self.push(band, places[a:b])

    def pop_all(self) -> tuple[int, np.ndarray]:
        """The lowest band that has places, and these."""
        leaf = (self.root & -self.root).bit_length() - 1
        bits = self.leaves[leaf]
        band = leaf * LEAF + (bits & -bits).bit_length() - 1
        bucket = self.buckets.pop(band)
        self.leaves[leaf] = bits & bits - 1
        if not self.leaves[leaf]:
            self.root &= self.root - 1
        return band, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class Pairs:
    """Ranks of two neighbouring tokens, given as arrays of ids; -1 if they make no token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.top = max(ranks.values(), default=-1)
        ids = {bytes([k]): self.top + 1 + k for k in range(256)} | ranks  # a byte that is no token may be part of one
        self.bytes = np.array([ids[bytes([k])] for k in range(256)])
        self.end = self.top + 257  # pairs with nothing
        self.size = self.end + 1
        keys, made = [self.size**2], [-1]  # the largest is the key of no pair
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ids.get(token[:k]), ids.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    made.append(rank)
        order = np.argsort(keys)
        self.keys, self.ranks = np.array(keys)[order], np.array(made)[order]

    def __call__(self, left, right) -> np.ndarray:
        key = left * self.size + right
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def merged_together(pieces: list[bytes], pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many pieces, none of them empty, one after the other, and the number of ids of each, as `merged` has them.

    One linked list and one queue hold all pieces, each with a place behind it that pairs with nothing.  The lowest band
    of ranks in the queue has the lowest rank of each piece with a place there; the leftmost such place of each piece is
    merged, all pieces at once.  Other places go back, as the merge may have changed them or made a lower rank.
    """
    lengths = np.array([len(p) for p in pieces])
    n = int(lengths.sum()) + len(pieces)
    own = np.repeat(np.arange(len(pieces)), lengths + 1)
    token = pairs.bytes[np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)]
    token[np.cumsum(lengths + 1) - 1] = pairs.end
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    at = np.append(pairs(token[:-1], token[1:]), -1)
    queue, places, bits = BandQueue(), np.flatnonzero(at >= 0), n.bit_length()
    if len(places):
        queue.push_all(at[places], places)
    while queue:
        band, places = queue.pop_all()
        ranks = at[places] - band * BAND
        order = ((own[places] * BAND + ranks) << bits | places)[(ranks >= 0) & (ranks < BAND)]
        if not len(order):
            continue
        order.sort()
        places, piece = order & (1 << bits) - 1, (order >> bits) // BAND
        same = piece[1:] == piece[:-1]
        if same.any():
            queue.push(band, places[1:][same & (places[1:] != places[:-1])])
            places = np.concatenate([places[:1], places[1:][~same]])
        gone, left = after[places], before[places]
        end = after[gone]
        after[places], before[end], at[gone] = end, places, -1
        token[places], token[gone] = at[places], -1
        new = np.concatenate([places, left])
        ranks = pairs(token[new], token[np.concatenate([end, places])])
        at[new] = ranks
        found = ranks >= 0
        if found.any():
            queue.push_all(ranks[found], new[found])
    kept = (token >= 0) & (token != pairs.end)
    ids = token[kept]
    if len(ids) and ids.max() > pairs.top:
        raise KeyError("a byte is no token")
    return ids, np.bincount(own[kept], minlength=len(pieces))


class Pieces(dict):
    """Decimal ids, joined by commas, of pieces met lately; at most two generations of so many pieces, or of `MANY`, are remembered."""

    def __init__(self, ranks: dict[bytes, int], most: int = 400_000):
        super().__init__()
        self.ranks, self.most, self.old, self.pairs = ranks, most, {}, None

    def learn(self, pieces: set[str]) -> None:
        """Remembers pieces of texts that come next; the new ones are merged together, if they are many."""
        unmet = [p for p in pieces if p not in self and 0 < len(p) <= SHORT]
        known = {p: self.old[p] for p in unmet if p in self.old}
        data = {p: d for p in unmet if p not in known and (d := p.encode()) not in self.ranks}
        if len(data) < FEW:
            return
        if len(self) + len(known) + len(data) > self.most:
            self.old = dict(self)
            self.clear()
        self.update(known)
        self.pairs = self.pairs or Pairs(self.ranks)
        part, size = {}, 0
        for k, (p, d) in enumerate(data.items(), 1):
            part[p] = d
            size += len(d)
            if size >= TOGETHER or k == len(data):
                ids, counts = merged_together(list(part.values()), self.pairs)
                ids, b = list(map(str, ids.tolist())), 0
                for q, count in zip(part, counts.tolist(), strict=True):
                    a, b = b, b + count
                    self[q] = ",".join(ids[a:b])
                part, size = {}, 0

    def __missing__(self, piece: str) -> str:
        ids = self.old.get(piece)
        if ids is None:
            data = piece.encode()
            whole = self.ranks.get(data)
            ids = str(whole) if whole is not None else ",".join(map(str, merged(data, self.ranks)))
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(piece) <= SHORT:
            self[piece] = ids
        return ids


class Tokens(dict):
    """Bytes of decimal ids joined by commas, as pieces have them; at most so many are remembered."""

    def __init__(self, bytes_of: dict[str, bytes], most: int = 400_000):
        super().__init__()
        self.bytes_of, self.most = bytes_of, most

    def __missing__(self, ids: str) -> bytes:
        data = b"".join(map(self.bytes_of.__getitem__, ids.split(",")))
        if len(self) >= self.most:
            self.clear()
        if len(data) <= 64:
            self[ids] = data
        return data


class Coder:
    """Encodes and decodes texts by ranks; each match of the pattern is encoded by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.pieces = Pieces(ranks)
        self.bytes_of = {str(i): token for token, i in ranks.items()}
        self.tokens = Tokens(self.bytes_of)

    def encode_pieces(self, text: str | None) -> list[str]:
        """Decimal ids of each piece, joined by commas."""
        return list(map(self.pieces.__getitem__, self.split(text or "")))

    def encode_many(self, pieces):
        """Decimal ids of pieces; new ones are merged together."""
        self.pieces.learn(set(pieces))
        return map(self.pieces.__getitem__, pieces)

    def encode_all(self, texts: list[str | None]):
        """`encode_pieces` of each text, many pieces at a time."""
        stretch, size = [], 0
        for k, text in enumerate(texts):
            stretch.append(self.split(text or ""))
            size += len(text or "")
            if size >= STRETCH or k == len(texts) - 1:
                ids = chain.from_iterable(map(self.encode_many, batched(chain.from_iterable(stretch), MANY)))
                for own in stretch:
                    yield list(islice(ids, len(own)))
                stretch, size = [], 0

    def encode_text(self, text: str | None) -> str:
        """Decimal ids, joined by commas."""
        return ",".join(self.encode_pieces(text))

    def encode(self, text: str | None) -> list[int]:
        ids = self.encode_text(text)
        return list(map(int, ids.split(","))) if ids else []

    def decode(self, ids) -> bytes:
        """Bytes of ids given as numbers or as decimal text."""
        return b"".join(map(self.bytes_of.__getitem__, map(str, ids)))

    def decode_pieces(self, pieces: list[str]) -> bytes:
        """Bytes of the ids of pieces, as `encode_pieces` gives them."""
        return b"".join(map(self.tokens.__getitem__, pieces))

    def decode_text(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """The coder of this process; the vocabulary is read once."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(read_ranks(path), pattern)
    return _coders[path, pattern]


def sent(spark: SparkSession, path: str, pattern: str):
    """A function that gives a task its coder: the file is read by the driver alone and broadcast, a megabyte or so."""
    with open(path, "rb") as lines:
        data = spark.sparkContext.broadcast(lines.read())

    def own() -> Coder:
        if (path, pattern) not in _coders:
            _coders[path, pattern] = Coder(ranks_of(data.value.splitlines()), pattern)
        return _coders[path, pattern]

    return own


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids array<int> of every whole text; null texts have none; rows are independent of each other."""
    own = sent(docs.sparkSession, path, pattern)

    def run(batches):
        c = own()
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([c.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and data binary, the bytes of ids; null ids have none."""
    own = sent(rows.sparkSession, path, pattern)

    def run(batches):
        c = own()
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([c.decode(x or ()) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    return rows.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number of ids, and sha256 of the ids and of the bytes decoded from them, without sending the ids anywhere.

    Null and empty texts have no ids, and the digests of nothing.  Each piece is coded by itself, so repeated rows and ids
    and other columns don't matter.  Memory: one batch, its pieces and the remembered ones; pieces over 64 characters
    aren't remembered.  Ties of rank go to the leftmost pair.  An empty table gives no rows.
    """
    own = sent(docs.sparkSession, path, pattern)

    def run(batches):
        c = own()
        for b in batches:
            counts, ids_sha, data_sha = [], [], []
            for pieces in c.encode_all(b.column(1).to_pylist()):
                ids = ",".join(pieces)
                counts.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                data_sha.append(hashlib.sha256(c.decode_pieces(pieces)).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
