"""Additive counts, rates, gates, curves and calibration metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.scalars import count_f1, harmonic_f1, safe_rate


def multiset_overlap(reference: DataFrame, candidate: DataFrame, case: str, key: list[str]) -> DataFrame:
    """Per case: matched, reference and candidate counts of two multisets. One row a (case, key) and side is shuffled, as counts are made before they move."""
    r = reference.groupBy(case, *key).agg(F.count("*").alias("r"))
    c = candidate.groupBy(case, *key).agg(F.count("*").alias("c"))
    both = r.join(c, [case, *key], "full").withColumns({"r": F.coalesce("r", F.lit(0)), "c": F.coalesce("c", F.lit(0))})
    return both.groupBy(case).agg(F.sum(F.least("r", "c")).alias("matched"), F.sum("r").alias("reference"), F.sum("c").alias("candidate"))


def overlap_of_sides(df: DataFrame, case: str, key: list[str], reference: Column, candidate: Column) -> DataFrame:
    """multiset_overlap of two sides of one table, which is read and shuffled once. A row may be on both sides or none."""
    n = lambda side: F.count(F.when(side, 1))
    both = df.groupBy(case, *key).agg(n(reference).alias("r"), n(candidate).alias("c"))
    return both.groupBy(case).agg(F.sum(F.least("r", "c")).alias("matched"), F.sum("r").alias("reference"), F.sum("c").alias("candidate"))


def most_at_once(df: DataFrame, group: str, voice: str, start: str, end: str) -> DataFrame:
    """Per group the most distinct voices that sound at one time, of half-open intervals; those without length don't count.

    A voice's intervals are merged first; then starts add and ends take away, ends first at one time.
    Times may be of any ordered type, and the cost doesn't depend on how long intervals are.
    """
    own = Window.partitionBy(group, voice).orderBy(start, end)
    rows = df.where(F.col(start) < F.col(end)).withColumn("reach", F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("island", F.sum(F.when(F.col(start) <= F.col("reach"), 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = rows.groupBy(group, voice, "island").agg(F.min(start).alias("a"), F.max(end).alias("b"))
    events = merged.select(group, F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("step")), F.struct(F.col("b").alias("x"), F.lit(-1).alias("step")))).alias("e")).select(group, "e.*")
    sweep = Window.partitionBy(group).orderBy("x", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("n", F.sum("step").over(sweep)).groupBy(group).agg(F.max("n").alias("voices"))


def micro_rates(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sums first, rates after: precision, recall, F1 of counts and of rates, with their conventions for empty sides."""
    s = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("matched", "reference", "candidate")])
    s = s.withColumn("precision", safe_rate(F.col("matched"), F.col("candidate"))).withColumn("recall", safe_rate(F.col("matched"), F.col("reference")))
    return s.withColumn("f1", count_f1(F.col("matched"), F.col("reference"), F.col("candidate"))).withColumn("harmonic_f1", harmonic_f1(F.col("precision"), F.col("recall")))


def evaluate_gates(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """``metrics``: metric, value. ``gates``: relation (minimum or maximum), metric, threshold. A missing metric fails."""
    joined = gates.join(metrics, "metric", "left")
    ok = F.when(F.col("relation") == "minimum", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return joined.select("metric", "relation", "threshold", "value", F.coalesce(ok, F.lit(False)).alias("passed"))


def average_precision(df: DataFrame, group: list[str], score: str, truth: str, tie: str) -> DataFrame:
    """101-point interpolated average precision per group; rows in order of score, ties by ``tie``."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), tie)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("tp", F.sum(F.col(truth).cast("long")).over(upto)).withColumn("n", F.row_number().over(order)).withColumn("all", F.sum(F.col(truth).cast("long")).over(Window.partitionBy(*group)))
    rows = rows.where("all > 0").withColumn("p", F.col("tp") / F.col("n")).withColumn("r", F.col("tp") / F.col("all"))
    best = rows.withColumn("p", F.max("p").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # The best precision at recalls of k / 100 and more is that of the first row that reaches it.
    firsts = best.withColumn("low", F.coalesce(F.lag("tp").over(order), F.lit(-1))).where("tp > low")
    first, last = F.when(F.col("low") < 0, 0).otherwise(F.floor(100 * F.col("low") / F.col("all")) + 1).cast("int"), F.floor(100 * F.col("tp") / F.col("all")).cast("int")
    points = firsts.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last))))  # a row may reach no new point
    return points.groupBy(*group).agg((F.sum("p") / 101).alias("ap"), F.max("all").alias("positives"))


def roc_auc(df: DataFrame, score: str, truth: str, by: list[str] = ()) -> DataFrame:
    """Area under the curve by ranks, ties at their mean rank. Scores are counted first, so that ranks run over distinct scores."""
    counts = df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(F.col(truth).cast("long")).alias("pos"))
    before = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2)
    s = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("ranks"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return s.select(*by, F.col("p").alias("positives"), F.col("q").alias("negatives"), F.when(F.col("p") * F.col("q") > 0, (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def histogram_similarity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """1 - total variation distance of two normalised histograms (key, n)."""
    share = lambda d, name: d.select(key, (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias(name))
    both = share(a, "x").join(share(b, "y"), key, "full")
    return both.agg((1 - 0.5 * F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))))).alias("similarity"))


def rarity_weights(every: DataFrame, df: DataFrame, row: str, label: str, power: float = 0.5, cap: float = 4.0) -> DataFrame:
    """Half uniform, half by the rarest label's (largest count / count) ^ power, capped; 1 for rows of ``every`` without labels; over the mean of all rows."""
    pairs = df.where(F.col(label).isNotNull()).select(row, label).distinct()
    counts = pairs.groupBy(label).agg(F.count("*").alias("n"))
    ratio = counts.withColumn("w", F.least(F.lit(cap), 0.5 + 0.5 * F.pow(F.max("n").over(Window.partitionBy(F.lit(0))) / F.col("n"), F.lit(power))))
    rows = every.select(row).distinct().join(pairs.join(ratio, label).groupBy(row).agg(F.max("w").alias("w")), row, "left").select(row, F.coalesce("w", F.lit(1.0)).alias("w"))
    mean = rows.agg(F.avg("w").alias("mean"))
    return rows.join(F.broadcast(mean)).select(row, (F.col("w") / F.col("mean")).alias("weight"))  # one row is broadcast


def percentiles(df: DataFrame, by: list[str], column: str, at: dict[str, float]) -> DataFrame:
    """Linear percentiles (type 7)."""
    return df.groupBy(*by).agg(*[F.percentile(column, p).alias(name) for name, p in at.items()])


def logistic_score(features: list[Column], means: list[float], scales: list[float], weights: list[float], intercept: float) -> Column:
    from lattica.functions.scalars import sigmoid

    total = F.lit(intercept)
    for f, m, s, w in zip(features, means, scales, weights, strict=True):
        total = total + F.lit(w) * (f - F.lit(m)) / F.lit(s)
    return sigmoid(total)
