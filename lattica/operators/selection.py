"""Splits, samples, rankings and joins that guard against leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.scalars import keyed, unit_hash


def split_by_hash(df: DataFrame, key: Column, seed: str, test: float = 0.1, calibration: float = 0.1) -> DataFrame:
    """Adds ``split``: rows of one key go together, wherever they are."""
    u = unit_hash(keyed(seed, key))
    return df.withColumn("split", F.when(u < test, "test").when(u < test + calibration, "calibration").otherwise("train"))


def leaking_groups(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that stand in more than one split."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def stable_sample(df: DataFrame, key: Column, seed: str, n: int) -> DataFrame:
    """The n rows of the smallest sha256; a top-n, never a sort of all rows."""
    return df.orderBy(F.sha2(keyed(seed, key), 256), key).limit(n)


def capped_per_key(df: DataFrame, group: list[str], order: list[Column], cap: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= cap)


def round_robin(df: DataFrame, group: str, order: list[Column], n: int, seed: str | None = None) -> DataFrame:
    """One of each group in turn, groups in order of their hash (with the seed, if any), until n rows are taken."""
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("turn") <= n)
    return ranked.orderBy("turn", F.sha2(F.col(group).cast("string") if seed is None else keyed(seed, F.col(group)), 256)).limit(n)


def first_of_each(df: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """The first row of each key, as an aggregate that combines before the shuffle."""
    best = df.groupBy(*key).agg(F.min_by(F.struct(*columns), order).alias("best"))
    return best.select(*key, *[F.col(f"best.{c}").alias(c) for c in columns])


def covering_prefix(df: DataFrame, group: str, order: list[Column], size: str, needed: int) -> DataFrame:
    """In order, rows of each group until their sizes cover what is needed."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("before", before).where(F.col("before") < needed)


def rejection_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``reasons``: names of the rules that hold, in the order given."""
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()])))


def interval_join(points: DataFrame, bounds: DataFrame, x: str, width: int) -> DataFrame:
    """points with x in [lo, hi) of ``bounds`` (lo, hi, name): an equi-join on cells of ``width``, which an interval enters as often as it spans them."""
    cells = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    return points.withColumn("cell", F.floor(F.col(x) / width)).join(cells, "cell").where((F.col(x) >= F.col("lo")) & (F.col(x) < F.col("hi"))).drop("cell")
