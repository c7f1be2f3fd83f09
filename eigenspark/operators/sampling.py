"""Seeded order, caps, holdouts and folds, per class.

The order is the md5 of the row's id and the seed, so it is the same at every partitioning.  Ranks in a class are counted
in buckets of the key's first digits, as many as keep a bucket within BUDGET rows, so that no class is a single task.
Where only the first so many of a class are wanted, a histogram of the buckets tells the one in which the last of them
lies: rows before and after it are settled by their key alone, and only that bucket is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import split_counts
from .tables import written

#: Distinct values that are broadcast, at most.
SMALL = 100_000


def key(row_id: str, seed: int | Column) -> Column:
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat(F.col(row_id).cast("string"), F.lit(":"), seed))


#: Rows of a bucket, at most (on average over seeds half of it).
BUDGET = 1_000_000


def digits_for(rows: int) -> int:
    """Hexadecimal digits of a key that split so many rows into buckets of half the budget or less."""
    digits = 0
    while rows > BUDGET // 2 * 16**digits and digits < 32:
        digits += 1
    return digits


def _bucketed(df: DataFrame, by: list[str], order: Column, rows: int | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows with _key, _bucket and _class; _class, _bucket, _before, _in_bucket and n_class of every bucket; its columns."""
    digits = digits_for(df.count() if rows is None else rows)
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))  # equal structs have equal nulls
    keyed = df.withColumn("_key", order).withColumn("_bucket", F.substring("_key", 1, digits) if digits else F.lit("")).withColumn("_class", group)
    counts = keyed.groupBy("_class", "_bucket").agg(F.count("*").alias("_in_bucket"))
    upto = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = counts.select("_class", "_bucket", "_in_bucket", (F.sum("_in_bucket").over(upto) - F.col("_in_bucket")).alias("_before"), F.sum("_in_bucket").over(Window.partitionBy("_class")).alias("n_class"))
    return keyed, sums, df.columns


def ranked(df: DataFrame, by: list[str], order: Column, row_id: str, rows: int | None = None) -> DataFrame:
    """Adds n_class and class_rank (from 1) within the columns `by`, in the order of a hexadecimal key and then row_id.

    Rows with a null among `by` are a class of their own.  rows: their number if it is known; else they are counted.
    """
    keyed, sums, names = _bucketed(df, by, order, rows)
    within = F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy("_key", row_id))
    out = keyed.withColumn("_within", within).join(sums, ["_class", "_bucket"])
    return out.select(*names, "n_class", (F.col("_before") + F.col("_within")).alias("class_rank"))


def selected(df: DataFrame, by: list[str], quota, order: Column, row_id: str, to: str = "_chosen", rows: int | None = None) -> DataFrame:
    """Adds whether a row is among the first quota(n_class) of its class, by radix selection."""
    keyed, sums, names = _bucketed(df, by, order, rows)
    last = sums.withColumn("_left", quota(F.col("n_class")) - F.col("_before")).where((F.col("_left") > 0) & (F.col("_left") <= F.col("_in_bucket")))
    last = written(last.select("_class", F.col("_bucket").alias("_edge"), "_left"))  # at most one bucket of each class
    met = keyed.join(F.broadcast(last) if last.count() <= SMALL else last, "_class", "left")
    sure = met.where("_edge is null or _bucket <> _edge").withColumn(to, F.coalesce(F.col("_bucket") < F.col("_edge"), F.lit(False)))
    within = F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy("_key", row_id))
    close = met.where("_bucket = _edge").withColumn(to, within <= F.col("_left"))
    return sure.unionByName(close).select(*names, to)


def by_class(df: DataFrame, label: str, row_id: str, seed: int) -> DataFrame:
    return ranked(df, [label], key(row_id, seed), row_id)


def per_class_cap(df: DataFrame, cap: int | None, label: str = "label", row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """At most so many seeded-random rows of each class; None or a cap below 1 keeps all."""
    if cap is None or cap <= 0:
        return df
    return selected(df, [label], lambda n: F.least(n, F.lit(cap)), key(row_id, seed), row_id).where("_chosen").drop("_chosen")


def first_per_class(df: DataFrame, cap: int, order: str, label: str = "label") -> DataFrame:
    """The first rows of each class in the order of a column; Spark limits each group before it shuffles."""
    w = Window.partitionBy(label).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def global_cap(df: DataFrame, cap: int | None, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """At most so many seeded-random rows."""
    if cap is None:
        return df
    return selected(df, [], lambda n: F.least(n, F.lit(cap)), key(row_id, seed), row_id).where("_chosen").drop("_chosen")


def holdout_count(n: Column, ratio: float) -> Column:
    """Rounded half to even; of two or more rows at least one and not all; none of one row."""
    return F.when(n > 1, F.greatest(F.lit(1), F.least(F.rint(n * ratio), n - 1))).otherwise(0).cast("long")


def stratified_holdout(df: DataFrame, ratio: float = 0.2, label: str = "label", row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Adds is_holdout."""
    if not 0 < ratio < 1:
        raise ValueError("the holdout ratio must lie between 0 and 1")
    return selected(df, [label], lambda n: holdout_count(n, ratio), key(row_id, seed), row_id, "is_holdout")


def chunk(rank: Column, n: Column, parts: int) -> Column:
    """Which of so many chunks (from 0) a rank (from 1) of n falls in; the first n mod parts chunks are one larger."""
    small, large = F.floor(n / parts), n % parts
    edge = large * (small + 1)
    return F.when(rank <= edge, F.floor((rank - 1) / (small + 1))).otherwise(large + F.floor((rank - 1 - edge) / F.greatest(small, F.lit(1)))).cast("int")


def smallest_class(df: DataFrame, label: str = "label") -> int:
    return df.groupBy(label).count().agg(F.min("count")).first()[0] or 0


def stratified_folds(df: DataFrame, folds: int, label: str = "label", row_id: str = "row_id", seed: int = 42, check: bool = True) -> DataFrame:
    """Adds fold, from 0."""
    if folds < 2:
        raise ValueError("at least 2 folds are needed")
    if check and (least := smallest_class(df, label)) < folds:
        raise ValueError(f"{folds} folds need {folds} rows of each class; the smallest has {least}")
    rows = by_class(df, label, row_id, seed)
    return rows.withColumn("fold", chunk(F.col("class_rank"), F.col("n_class"), folds)).drop("class_rank", "n_class")


def nested_folds(df: DataFrame, outer: int, inner: int, label: str = "label", row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """A row for each outer fold (outer_fold, from 0) and row outside it, with inner_fold; inner keys take seed + outer_fold + 1."""
    rows = stratified_folds(df, outer, label, row_id, seed, check=False).withColumnRenamed("fold", "_own")
    each = rows.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(outer - 1)))).where("outer_fold <> _own").drop("_own")
    inner_rows = ranked(each, ["outer_fold", label], key(row_id, F.col("outer_fold") + seed + 1), row_id)
    return inner_rows.withColumn("inner_fold", chunk(F.col("class_rank"), F.col("n_class"), inner)).drop("class_rank", "n_class")


def nested_feasibility(df: DataFrame, outer: int, inner: int, label: str = "label") -> DataFrame:
    """One row: min_class_count, max_class_count, min_outer_train_count, feasible."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    out = n.agg(F.min("n").alias("min_class_count"), F.max("n").alias("max_class_count"), F.min(F.col("n") - F.ceil(F.col("n") / outer)).cast("long").alias("min_outer_train_count"))
    return out.withColumn("feasible", (F.col("min_class_count") >= outer) & (F.col("min_outer_train_count") >= inner))


def check_nested(df: DataFrame, outer: int, inner: int, label: str = "label") -> None:
    """An error where nested folds can't be made."""
    if outer < 2 or inner < 2:
        raise ValueError("at least 2 outer and 2 inner folds are needed")
    row = nested_feasibility(df, outer, inner, label).first()
    if not row.feasible:
        raise ValueError(f"the smallest class has {row.min_class_count} rows, {row.min_outer_train_count} of them outside an outer fold: too few for {outer} x {inner} folds")


def three_way_split(df: DataFrame, validation: float, test: float, label: str = "label", row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Adds split: test, val or train."""
    if validation < 0 or test < 0 or validation + test >= 1:
        raise ValueError("the ratios must be 0 or more and sum to less than 1")
    rows = by_class(df, label, row_id, seed)
    v, t = split_counts(F.col("n_class"), validation, test)
    split = F.when(F.col("class_rank") <= t, "test").when(F.col("class_rank") <= t + v, "val").otherwise("train")
    return rows.withColumn("split", split).drop("class_rank", "n_class")


def shuffle_split(df: DataFrame, test: float, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Adds is_train: the first int(n * (1 - test)) rows in seeded order, whatever their class."""
    return selected(df, [], lambda n: F.floor(n * (1 - test)), key(row_id, seed), row_id, "is_train")


def complement(df: DataFrame, part: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows of df whose id isn't in part."""
    return df.join(part.select(row_id), row_id, "left_anti")


def encoded(df: DataFrame, raw: str, to: str = "label") -> DataFrame:
    """Adds a dense label from 0 in the order of the raw value's type: numbers by size, text by code points, null last."""
    # only distinct values are ranked; up to SMALL of them are broadcast, so a value that most rows have is no single task
    dim = df.select(F.col(raw).alias("_raw")).distinct().withColumn(to, (F.dense_rank().over(Window.orderBy(F.col("_raw").asc_nulls_last())) - 1).cast("int"))
    return df.join(F.broadcast(dim) if dim.limit(SMALL + 1).count() <= SMALL else dim, F.col(raw).eqNullSafe(F.col("_raw"))).drop("_raw")


def decoded(df: DataFrame, names: DataFrame, label: str = "label") -> DataFrame:
    """Adds the columns of a small dimension table (label, name)."""
    return df.join(names, label, "left")
