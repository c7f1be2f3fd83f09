"""A corpus from raw documents to packed sequences, in stages that each take what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenspark.llm import language, neardup, packing, substrings, toxicity
from eigenspark.llm.common import ship, stored, table


def _apart(docs: DataFrame) -> DataFrame:
    """The columns of docs but text in one struct, so that no name clashes with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")


def _together(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, of any language, also where no row teaches one; lang is the language found in the text.

    The given lang stays where another language is about as close as the one found, and where no row teaches one.  Null
    and empty texts go, and texts without a letter; texts of any length are identified whole.  Each row is judged by its
    text alone: repeated rows stay or go together, null ids don't matter and there are no ties.  An empty table gives no
    rows; other columns, whatever their names, come through.
    """
    found = language.identified(_apart(docs), language.learned(docs), lettered=True)
    lang = F.when((F.col("lang_pred") == language.UNKNOWN) | F.col("ambiguous"), F.col("row.lang")).otherwise(F.col("lang_pred").cast(docs.schema["lang"].dataType))
    return _together(found.withColumn("row", F.col("row").withField("lang", lang)), docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the classifier learns from the labels of the tables.

    Null and empty texts have a score like others; texts of any length are measured whole.  Each row is judged by its text
    alone: repeated rows stay or go together, null ids don't matter, and a score equal to the threshold goes.  Without
    labels of both kinds every row has the share of toxic labels as its score.  An empty table gives no rows; other
    columns, whatever their names, come through.
    """
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"))
    scored = model.score(toxicity.measured(_apart(docs), model.lexicon, keep_text=True))
    return _together(scored.where(F.col("score") < toxicity.THRESHOLD), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies.

    Null and empty texts are copies of each other, and texts without a word of those with the same bytes; texts of any
    length are compared whole.  Of rows with one id, one stays; rows without an id all stay.  An empty table gives no
    rows; other columns, whatever their names, come through.
    """
    return neardup.kept(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 or more words that a document with a smaller id holds; n_chars follows.

    All rows stay, also those left without words.  Null texts stay null, with the n_chars null, and texts of any length are
    searched whole.  Rows with one id remove nothing from each other; rows without an id keep all words and remove none.
    An empty table gives no rows; other columns, whatever their names, come through.
    """
    out = substrings.deduplicated(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all words of the documents in sequences of permitted lengths.

    Texts of any length are packed whole, in pieces; null and empty ones have a row without a bin.  Repeated rows are
    packed as often as they occur, null ids like others; ties of length go by id and piece.  An empty table gives no rows;
    other columns don't matter.
    """
    return packing.packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: Trained classifiers and sketches aren't expressible in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the documents are written as Parquet and read again."""
    docs = table(ship(spark), sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
