"""Toxicity: boosted trees over dense features of whole texts, with isotonic calibration."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, remainder, stored, widened

#: Common insults and words of the second person, lower-case.
INSULTS = "idiot moron stupid scum trash loser clown pathetic worthless disgusting dumb fool jerk garbage filth vermin imbecile bastard crap hate".split()
SECOND_PERSON = "you your yours yourself u ur thou du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos usted ustedes vosotros ti tus".split()
#: Symbols that stand for letters inside a word.
_LOOKS_LIKE = str.maketrans("013457@$!|", "oieastasil", "*")

#: Labelled documents that are learned from, at most; learned terms, at most; letters of a learned stem.
SAMPLE, TERMS, STEM = 20_000, 600, 5
THRESHOLD = 0.7
#: Rows that the trees' own probability counts for in the calibration.
PRIOR = 20.0

FEATURES = ("words", "lexicon_rate", "lexicon_hits", "lexicon_weight", "lexicon_most", "insult_rate", "second_person_rate", "near_second_person", "capitals", "punctuation", "exclamations", "obfuscated", "obfuscated_hits", "stretched")

_WORD = re.compile(r"[^\W_]+")
_OBFUSCATED = re.compile(r"[^\W\d_]+(?:[0-9@$*!|]+[^\W\d_]+)+")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_PUNCTUATION = np.array([33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 for b in range(256)])


_SIGN = np.isin(np.arange(256), list(b"0123456789@$*!|"))
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def may_be_obfuscated(data: np.ndarray) -> bool:
    """Whether some sign stands before a letter and some after one: without these, _OBFUSCATED matches nowhere."""
    sign = _SIGN[data]
    if not sign.any():
        return False
    letter = _LETTER[data]
    return bool((sign[:-1] & letter[1:]).any() and (letter[:-1] & sign[1:]).any())


def may_be_stretched(data: np.ndarray) -> bool:
    """Whether some bytes come three times at the distance of a character: without these, _STRETCHED matches nowhere."""
    return any(bool(((data[: -2 * k] == data[k:-k]) & (data[k:-k] == data[2 * k :]) & (_LETTER[data[: -2 * k]])).any()) for k in ((1, 2, 3, 4) if (data >= 128).any() else (1,)) if len(data) > 2 * k)


@dataclass(frozen=True)
class Lexicon:
    """Weights of words and of stems; a stem is the first STEM letters of a longer word, marked by a final hyphen."""

    weights: dict[str, float]

    def weight(self, word: str) -> float:
        own = self.weights.get
        return own(word, 0.0) if len(word) <= STEM else max(own(word, 0.0), own(word[:STEM] + "-", 0.0))


def features(text: str | None, lexicon: Lexicon, reach: int = 4) -> list[float]:
    """FEATURES of a whole text; all are 0 for null and empty texts.  reach: words to either side that count as near."""
    text = text or ""
    words = _WORD.findall(text.lower())
    n = max(1, len(words))
    different = set(words)
    own = {w: x for w in different if (x := lexicon.weight(w)) > 0}
    insults = own.keys() | (_INSULTS & different)
    places = [i for i, w in enumerate(words) if w in insults] if insults else []
    hits = [own[words[i]] for i in places if words[i] in own]
    second = _SECOND & different
    addressed = [i for i, w in enumerate(words) if w in second] if second else []
    near = 0
    if places and addressed:
        at = np.array(addressed)
        k = np.searchsorted(at, places)
        p = np.array(places)
        near = int(((np.abs(at[np.minimum(k, len(at) - 1)] - p) <= reach) | (np.abs(at[np.maximum(k - 1, 0)] - p) <= reach)).sum())
    data = np.frombuffer(text.encode(), np.uint8)
    per_byte = np.bincount(data, minlength=256)
    size = max(1, len(data))
    odd = _OBFUSCATED.findall(text) if may_be_obfuscated(data) else []
    plain = [x.translate(_LOOKS_LIKE).lower() for x in odd]
    return [
        float(np.log1p(len(words))),
        len(hits) / n,
        float(np.log1p(len(hits))),
        sum(hits) / n,
        max(hits, default=0.0),
        sum(words[i] in _INSULTS for i in places) / n,
        len(addressed) / n,
        near / n,
        float(per_byte[65:91].sum()) / size,
        float(per_byte[_PUNCTUATION].sum()) / size,
        float(per_byte[33]) / size,
        len(odd) / n,
        sum(w in _INSULTS or lexicon.weight(w) > 0 for w in plain) / n,
        len(_STRETCHED.findall(text)) / n if may_be_stretched(data) else 0.0,
    ]


_INSULTS, _SECOND = frozenset(INSULTS), frozenset(SECOND_PERSON)


def measured(docs: DataFrame, lexicon: Lexicon, keep_text: bool = False) -> DataFrame:
    """The rows of docs with a features array; text goes unless it is kept."""
    names = [c for c in docs.columns if c not in ("text", "features")] + ["text"]
    out = names if keep_text else names[:-1]

    def run(batches):
        for b in batches:
            rows = [features(t, lexicon) for t in b.column(len(names) - 1).to_pylist()]
            yield pa.record_batch([*b.columns[: len(out)], pa.array(rows, pa.list_(pa.float64()))], [*out, "features"])

    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    return rows.mapInArrow(run, widened(rows.select(*[F.col(f"`{c}`") for c in out]), "features array<double>"))


def sampled(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id and label of at most so many labelled documents whose id's crc32 modulo 3 isn't 1, chosen by a hash.

    A document with several labels counts as toxic if one of them is 1.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.where(remainder(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def learned_lexicon(rows: DataFrame, most: int = TERMS) -> Lexicon:
    """Words and stems with a high ratio of toxic to other documents among the rows (text, label); equal texts count once."""
    w = F.expr(f"filter(array_distinct(split(lower(text), '[^\\\\p{{L}}\\\\p{{N}}]+')), x -> length(x) between 2 and 40)")
    stem = F.expr(f"transform(filter(w, x -> length(x) > {STEM}), x -> concat(substring(x, 1, {STEM}), '-'))")
    once = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.max("label").alias("label"), F.max("text").alias("text"))
    terms = once.select("label", w.alias("w")).select("label", F.explode(F.array_distinct(F.concat("w", stem))).alias("term"))
    ones = once.agg(F.sum("label"), F.count("*")).first()
    toxic, clean = float(ones[0] or 0), float(ones[1] - (ones[0] or 0))
    if not toxic or not clean:
        return Lexicon({})
    counted = terms.groupBy("term").agg(F.sum("label").alias("a"), F.count("*").alias("n"))
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("a") + 0.5) / (clean + 1))
    chosen = counted.where(F.col("a") >= max(3.0, 0.01 * toxic)).select("term", odds.alias("odds")).where(F.col("odds") >= 2.0)
    return Lexicon({r.term: r.odds for r in chosen.orderBy(F.desc("odds"), "term").limit(most).collect()})


@dataclass
class ToxicityModel:
    """A lexicon, trees over the features, and the calibration of their margins; without both labels only a rate."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    rate: float

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds score to rows with features: the calibrated share, moved by up to 1 % by the margin so that ties split."""
        if self.trees is None:
            return rows.drop("features", "score").withColumn("score", F.lit(self.rate))
        out = rows.withColumn("_x", array_to_vector("features"))
        out = self.trees.transform(out).withColumn("_margin", vector_to_array("_raw")[1])
        squashed = 1 / (1 + F.exp(-2 * F.col("_margin")))
        out = out if self.calibration is None else self.calibration.transform(out)
        share = squashed if self.calibration is None else F.col("_share")
        return out.select(*[c for c in rows.columns if c != "features"], (0.99 * share + 0.01 * squashed).alias("score"))


def learned(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, rounds: int = 20, depth: int = 4) -> ToxicityModel:
    """Learns from at most `most` labelled documents (their texts and labels, nothing else).

    Every fourth one, by a hash of the id, is kept for the calibration; neither the lexicon nor the trees see it.
    Held-out rows (remainder 1) and null ids and labels take no part; of texts with one id, one counts; texts are taken
    whole.  Where the trees' part holds one label only, the score is the share of toxic ones; without calibration rows it
    is the trees' own.
    """
    ids = sampled(labels, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")  # at most `most` ids
    rows = stored(rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label")).withColumn("_held", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0))
    lexicon = learned_lexicon(rows.where("not _held"))
    ready = checkpointed(measured(rows, lexicon).select("doc_id", "label", "_held", array_to_vector("features").alias("_x")))
    fit, rest = ready.where("not _held"), ready.where("_held")
    n, toxic = fit.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < toxic < n:
        return ToxicityModel(lexicon, None, None, float(toxic / n) if n else 0.0)
    trees = GBTClassifier(featuresCol="_x", labelCol="label", predictionCol="_label", maxIter=rounds, maxDepth=depth, stepSize=0.3, minInstancesPerNode=5, seed=11).setRawPredictionCol("_raw").setProbabilityCol("_probability").fit(fit)
    margin = trees.transform(rest).select(vector_to_array("_raw")[1].alias("_margin"), "label")
    return ToxicityModel(lexicon, trees, calibrated(margin), float(toxic / n))


def calibrated(margins: DataFrame, prior: float = PRIOR) -> IsotonicRegressionModel | None:
    """The isotonic curve of the share of toxic rows over the margin; None without rows.

    Rows of one margin are added up first, so many equal ones are no load.  The trees' own probability counts as `prior`
    further rows, spread over all: with few rows the curve stays near it, and with many it hardly matters.
    """
    n = margins.count()
    if not n:
        return None
    own = 1 / (1 + F.exp(-2 * F.col("_margin")))
    added = margins.groupBy("_margin").agg(F.avg("label").alias("share"), F.count("*").cast("double").alias("weight"))
    target = (F.col("share") + prior / n * own) / (1 + prior / n)
    return IsotonicRegression(featuresCol="_margin", labelCol="label", weightCol="weight", predictionCol="_share").fit(added.select("_margin", target.alias("label"), "weight"))


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts have features of 0 and a score like others.  Whole texts are measured, however long.  Rows don't
    influence each other, so ties don't arise; repeated and null ids are rows of their own (a null id is held out); only
    doc_id and text are read.  An empty table gives no rows.
    """
    rows = measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model.lexicon)
    out = model.score(rows)
    return out.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
