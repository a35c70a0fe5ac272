"""Voting among candidates of correlated families: a family is heard once, and only if it is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def complete_families(df: DataFrame, page: str, family: str, valid: str) -> DataFrame:
    """Rows of families without any invalid member."""
    whole = df.groupBy(page, family).agg(F.bool_and(valid).alias("whole")).where("whole").drop("whole")
    return df.join(whole, [page, family], "left_semi")


def family_majority(df: DataFrame, page: str, family: str, signature: str, score: str) -> DataFrame:
    """Per page the signature with most families, then members, then score, then code point order; ``majority`` if more than half of the families agree on it."""
    families = df.where(F.col(family).isNotNull()).groupBy(page, family).agg(F.count_distinct(signature).alias("kinds"), F.min(signature).alias("vote"), F.count("*").alias("members"), F.max(score).alias(score))
    votes = families.withColumn("vote", F.when(F.col("kinds") == 1, F.col("vote"))).groupBy(page, F.col("vote").alias(signature)).agg(F.count("*").alias("families"), F.sum("members").alias("members"), F.max(score).alias(score))
    pages = Window.partitionBy(page)  # families that don't agree count among those asked
    first = pages.orderBy(F.col(signature).isNull(), F.desc("families"), F.desc("members"), F.desc(score), signature)
    best = votes.withColumn("of", F.sum("families").over(pages)).withColumn("n", F.row_number().over(first)).where("n = 1").where(F.col(signature).isNotNull())
    return best.select(page, signature, "families", "members", "of", (2 * F.col("families") > F.col("of")).alias("majority"))


def family_median(df: DataFrame, page: str, family: str, value: str) -> DataFrame:
    """Mean within each family, median across families."""
    means = df.groupBy(page, family).agg(F.avg(value).alias("m"))
    return means.groupBy(page).agg(F.percentile("m", 0.5).alias("median"), F.count("*").alias("families"))
