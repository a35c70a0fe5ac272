"""Operators over ordered rows: state carried forward, balances, runs, alignment."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each column's last value that isn't null."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({f"{c}_in_force": F.last(c, ignorenulls=True).over(w) for c in columns})


def balance(df: DataFrame, group: list[str], order: list[str], start: Column, stop: Column) -> DataFrame:
    """Per group: stops without a start before them, and starts left open. A counter with floor 0, in closed form: S - min(0, running min of S)."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("s", F.sum(F.when(start, 1).when(stop, -1).otherwise(0)).over(w))
    ends = rows.groupBy(*group).agg(F.least(F.min("s"), F.lit(0)).alias("low"), F.sum(F.when(start, 1).when(stop, -1).otherwise(0)).alias("end"))
    return ends.select(*group, (-F.col("low")).alias("unmatched_stops"), (F.col("end") - F.col("low")).alias("open_starts"))


def runs(df: DataFrame, group: list[str], order: str, gap: Column) -> DataFrame:
    """Adds ``run``: a new one where ``gap`` holds at a row (it may use lag over the group)."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn("run", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def collapse_close(values: Column, tolerance: float) -> Column:
    """Of a sorted array: values further than ``tolerance`` from the last one kept."""
    return F.aggregate(values, F.array().cast("array<double>"), lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) > tolerance), F.concat(kept, F.array(x))).otherwise(kept))


def top_margin(df: DataFrame, group: list[str], score: str, item: str) -> DataFrame:
    """The best item of each group and its lead over the runner-up, or over 0 where it is alone; at least 0."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), item)
    rows = df.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead(score).over(w))
    return rows.where("n = 1").select(*group, item, score, F.greatest(F.lit(0), F.col(score) - F.coalesce("next", F.lit(0))).alias("margin"))


#: Which of equal moves is taken, first to last.
MATCH_DELETE_INSERT, MATCH_INSERT_DELETE = "mdi", "mid"


#: Cells of the table that one alignment may have: 256 MB.
MOST_CELLS = 1 << 25


def align(left: list, right: list, cost: Callable[[object, object], float], gap: float, ties: str = MATCH_DELETE_INSERT) -> tuple[list[tuple], float]:
    """Global alignment of least cost: pairs (i, j) with None for gaps, and the total."""
    return align_costs(np.array([[cost(x, y) for y in right] for x in left], float).reshape(len(left), len(right)), gap, ties)


def align_costs(cost: np.ndarray, gap: float, ties: str = MATCH_DELETE_INSERT) -> tuple[list[tuple], float]:
    """The same from the costs of all matches. A row of the table at a time: an insertion only adds a gap, so it is a running minimum."""
    n, m = cost.shape
    if (n + 1) * (m + 1) > MOST_CELLS:
        raise ValueError(f"sequences of {n} and {m} items are too long to align")
    steps = np.arange(m + 1) * gap
    total = np.empty((n + 1, m + 1))
    total[0] = steps
    for i in range(1, n + 1):
        row = total[i - 1] + gap
        row[1:] = np.minimum(row[1:], total[i - 1, :-1] + cost[i - 1])
        total[i] = np.minimum.accumulate(row - steps) + steps
    pairs, i, j = [], n, m
    while i or j:
        moves = {}
        if i and j:
            moves["m"] = total[i - 1, j - 1] + cost[i - 1, j - 1]
        if i:
            moves["d"] = total[i - 1, j] + gap
        if j:
            moves["i"] = total[i, j - 1] + gap
        least = min(moves.values())
        move = next(t for t in ties if t in moves and moves[t] <= least + 1e-9)
        i, j = i - (move in "md"), j - (move in "mi")
        pairs.append((i if move in "md" else None, j if move in "mi" else None))
    return pairs[::-1], float(total[n, m])


def position_penalty(n: int, m: int, most: float = 0.08, slope: float = 0.12) -> np.ndarray:
    """How far items' relative places differ, at most ``most``."""
    return np.minimum(most, slope * np.abs((np.arange(n) + 0.5)[:, None] / max(n, 1) - (np.arange(m) + 0.5)[None] / max(m, 1)))


def align_groups(left: DataFrame, right: DataFrame, group: str, order: str, value: str, gap: float = 1.0, ties: str = MATCH_DELETE_INSERT, placed: bool = False) -> DataFrame:
    """group, left_order, right_order, step: the alignment of two sequences of each group, by 0/1 substitution, with ``placed`` plus a penalty for place.

    A group is one sequence, not an unbounded set; one beyond MOST_CELLS ends the job.
    """

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(order), b.sort_values(order)
        cost = (a[value].to_numpy(object)[:, None] != b[value].to_numpy(object)[None]).astype(float)
        if placed:
            cost = np.minimum(1.0, cost + position_penalty(len(a), len(b)))
        pairs, _ = align_costs(cost, gap, ties)
        x, y = a[order].tolist(), b[order].tolist()
        return pd.DataFrame({group: [key[0]] * len(pairs), "step": range(len(pairs)), "left_order": pd.array([None if i is None else x[i] for i, _ in pairs], "Int64"), "right_order": pd.array([None if j is None else y[j] for _, j in pairs], "Int64")})

    cols = [group, order, value]
    other = right.select(*[F.col(c).alias(c) for c in cols])  # columns of its own, as both sides may be of one table
    return left.select(*cols).groupBy(group).cogroup(other.groupBy(group)).applyInPandas(run, f"{group} long, step long, left_order long, right_order long")
