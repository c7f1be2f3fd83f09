"""Language identification by error-correcting output codes."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, remainder, slices, widened

#: Hashed n-grams: so many numbers a document; n-grams of these many bytes.
DIMS, GRAMS = 4096, (2, 3, 4)
#: Training documents: at most so many in all, shared evenly by the languages; but each language has up to LEAST.
SAMPLE, LEAST = 3000, 5
UNKNOWN = "und"
#: A document is ambiguous if the second language's share of the decoded weight is within so much of the first's.
MARGIN = 0.02

_FOLD = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vectors(texts: list[str]) -> np.ndarray:
    """Square roots of the shares of hashed n-grams of whole texts, lower-cased, all but letters as blanks."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for first, last in slices(texts, 400_000, 256):
        own = [f"  {t}  ".lower().encode() for t in texts[first:last]]
        data = _FOLD[np.frombuffer(b"".join(own), np.uint8)].astype(np.uint32)
        row = np.repeat(np.arange(len(own), dtype=np.int64) * DIMS, [len(t) for t in own])
        counts = np.zeros(len(own) * DIMS, np.int64)
        for n in GRAMS:
            code = np.full(len(data) - n + 1, n, np.uint32)
            for i in range(n):
                code = (code + data[i : i + len(code)]) * np.uint32(0x9E3779B1)
                code ^= code >> np.uint32(15)
            counts += np.bincount(row[: len(code)] + (code & np.uint32(DIMS - 1)), minlength=len(counts))
        x = counts.reshape(len(own), DIMS)
        out[first:last] = np.sqrt(x / np.maximum(1, x.sum(1, keepdims=True)))
    return out


def codewords(classes: int, seed: int = 5) -> np.ndarray:
    """A row of +1 and -1 for each class: all splits of few classes, else the best separated of some random tables."""
    if classes < 2:
        return np.ones((classes, 0), np.float32)
    if classes <= 6:
        bits = [b for b in product((-1, 1), repeat=classes) if b[0] == 1 and -1 in b]
        return np.array(bits, np.float32).T
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes)))
    tables = [np.where(rng.random((classes, length)) < 0.5, -1, 1).astype(np.float32) for _ in range(max(1, min(200, 10**6 // classes**2)))]
    apart = lambda t: ((length - t @ t.T) / 2 + length * np.eye(classes)).min()
    return max(tables, key=apart)


@dataclass
class OutputCode:
    """Linear classifiers of the bits of codewords.  weights: DIMS x bits; skill: weight of each bit's loss for each class."""

    classes: list[str]
    code: np.ndarray
    weights: np.ndarray = field(repr=False)
    bias: np.ndarray
    skill: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted exponential loss of each row against each class's codeword."""
        margin = np.clip(x @ self.weights + self.bias, -4, 4)
        return (np.exp(-margin[:, None, :] * self.code[None]) * self.skill[None]).sum(2)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score and whether another language is about as close; UNKNOWN, 0 and true without a letter."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        have = [i for i, t in enumerate(texts) if self.classes and t and has_letter(t)]
        for first, last in slices([texts[i] for i in have], 400_000, max(1, min(256, 4_000_000 // max(1, self.code.size)))):
            rows = have[first:last]
            loss = self.losses(vectors([texts[i] for i in rows]))
            share = np.exp(loss.min(1, keepdims=True) - loss)
            share /= share.sum(1, keepdims=True)
            ranked = np.sort(share, 1)
            second = ranked[:, -2] if ranked.shape[1] > 1 else np.zeros(len(rows))
            for i, k, s, t in zip(rows, share.argmax(1), ranked[:, -1], second, strict=True):
                out[i] = (self.classes[k], float(s), bool(s - t < MARGIN))
        return out


def fitted(x: np.ndarray, labels: list[str], rounds: int = 200, penalty: float = 1e-5) -> OutputCode:
    """Logistic classifiers of all bits at once, by accelerated gradient steps; classes count alike."""
    classes = sorted(set(labels))
    code = codewords(len(classes))
    if len(classes) < 2:
        return OutputCode(classes, code, np.zeros((DIMS, 0), np.float32), np.zeros(0, np.float32), np.ones((len(classes), 0), np.float32))
    of = np.array([classes.index(v) for v in labels])
    weight = (1 / np.bincount(of)[of] / len(classes)).astype(np.float32)[:, None]
    target = code[of]
    w = np.zeros((DIMS, code.shape[1]), np.float32)
    b = np.zeros(code.shape[1], np.float32)
    vw, vb, step = w.copy(), b.copy(), np.float32(4.0)
    for r in range(rounds):
        pull = np.float32(r / (r + 3))
        w0, b0 = w + pull * vw, b + pull * vb
        g = -weight * target / (1 + np.exp(np.clip(target * (x @ w0 + b0), -30, 30)))
        w1, b1 = w0 - step * (x.T @ g + np.float32(penalty) * w0), b0 - step * g.sum(0)
        vw, vb, w, b = w1 - w, b1 - b, w1, b1
    hit = np.sign(x @ w + b) == target
    right = np.array([hit[of == c].mean(0) for c in range(len(classes))])
    right /= np.maximum(1e-9, right.sum(1, keepdims=True))
    return OutputCode(classes, code, w, b, right.astype(np.float32))


def learned(docs: DataFrame, most: int = SAMPLE, least: int = LEAST) -> OutputCode:
    """Learns from rows with an id, a lang and a text with a letter whose id's crc32 modulo 3 isn't 1.

    Every language is learned.  Each has at most max(least, most / languages) documents, the first by a hash of the id;
    ids are ranked first, and the texts of those chosen are measured where they lie.  A document comes to the driver, which
    fits the bits of all codewords, as DIMS half-precision numbers (8 KB, so 24 MB for 3,000), and takes twice that in
    single precision there.  Repeated rows count once; of texts with one id and language, one counts.
    """
    lang = F.col("lang").cast("string").alias("lang")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (remainder(F.col("doc_id")) != 1))
    counts = checkpointed(rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("_all")))  # a row for each language
    languages = counts.count()
    if not languages:
        return fitted(np.zeros((0, DIMS), np.float32), [])
    each = max(least, most // languages)
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    near = rows.join(F.broadcast(counts), "lang").where(place < F.lit(float(1 << 30)) * (2.0 * each + 50) / F.col("_all"))  # about twice as many as are needed
    ids = near.select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    chosen = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).select("doc_id", "lang")

    def run(batches):
        for b in batches:
            x = vectors(b.column(1).to_pylist()).astype(np.float16)
            yield pa.record_batch([b.column(0), pa.array([v.tobytes() for v in x], pa.binary()), b.column(2)], ["doc_id", "x", "lang"])

    measured = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, x binary, lang string")  # at most `each` ids a language
    got = measured.groupBy("doc_id", "lang").agg(F.min("x").alias("x")).orderBy("lang", "doc_id").collect()
    x = np.array([np.frombuffer(r.x, np.float16) for r in got], np.float32).reshape(len(got), DIMS)
    return fitted(x, [r.lang for r in got])


def identified(docs: DataFrame, model: OutputCode, lettered: bool = False) -> DataFrame:
    """The input's rows with lang_pred, score and ambiguous; of clashing names, the input's columns go.

    Null and empty texts and texts without a letter: UNKNOWN, 0, true.  With nothing learned every row is UNKNOWN.  Whole
    texts are measured, however long, and each by itself, so repeated rows and ids and null ids don't matter.  Of equal
    shares the first language by name wins.  An empty table gives no rows.
    lettered: only the rows whose text has a letter, whatever was learned.
    """
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "ambiguous")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index("text")

    def run(batches):
        for b in batches:
            if lettered:
                b = b.take(pa.array([i for i, t in enumerate(b.column(at).to_pylist()) if t and has_letter(t)], pa.int64()))
            lang, score, unsure = zip(*model.predict(b.column(at).to_pylist()), strict=True) if b.num_rows else ((), (), ())
            yield pa.record_batch([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], [*names, "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, widened(rows, "lang_pred string, score double, ambiguous boolean"))
