"""Matchings of boxes within a page, resampling, and reports over cases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.scalars import keyed
from lattica.operators.clusters import box_iou, boxes_of, by_group, ordered, whole_groups

BOX = ["x1", "y1", "x2", "y2"]


def greedy_matches(iou: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Rows in order; each takes its best column that is left, if that reaches ``least``. The first of equal columns."""
    left, out = np.ones(iou.shape[1], bool), []
    for i, row in enumerate(iou):
        free = np.where(left, row, -1.0)
        if len(free) and free[j := int(free.argmax())] >= least:
            left[j] = False
            out.append((i, j))
    return out


def maximum_matches(iou: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A largest set of pairs (row, column) that reach ``least``, by augmenting paths; rows in order, better columns first."""
    wanted = [[int(j) for j in np.argsort(-row, kind="stable") if row[j] >= least] for row in iou]
    owner: dict[int, int] = {}
    for start in range(len(wanted)):
        # A path of alternate pairs, kept as (row, columns left to try); no recursion, so its length is no limit.
        seen, path, tried = set(), [(start, iter(wanted[start]))], []
        while path:
            row, columns = path[-1]
            column = next((j for j in columns if j not in seen), None)
            if column is None:
                path.pop()
                if tried:
                    tried.pop()
                continue
            seen.add(column)
            tried.append(column)
            if column not in owner:
                for (r, _), c in zip(path, tried, strict=True):
                    owner[c] = r
                break
            path.append((owner[column], iter(wanted[owner[column]])))
    return sorted((r, c) for c, r in owner.items())


def _small_pairs(starts: np.ndarray, f: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of groups whose f found rows and then t truth rows begin at ``starts``: each pair's group, found row and truth row."""
    n = f * t
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return of, starts[of] + k // t[of], starts[of] + f[of] + k % t[of]


class _Overlaps:
    """A matrix of the IoU of found and truth boxes of a large page that is only read row by row; some rows are held at once."""

    def __init__(self, found: np.ndarray, truth: np.ndarray):
        self.found, self.truth, self.shape = found, truth, (len(found), len(truth))

    def __iter__(self):
        step = max(1, (1 << 15) // len(self.truth))
        for a in range(0, len(self.found), step):
            yield from box_iou(self.found[a : a + step, None], self.truth)


def _batch_matches(x: np.ndarray, starts: np.ndarray, f: np.ndarray, t: np.ndarray, least: float, method) -> list[tuple[np.ndarray, np.ndarray]]:
    """Found and truth rows of each match. Pairs of small groups are compared at once; ``method`` sees the groups where a row or column has a choice."""
    small = f * t <= 1024
    of, i, j = _small_pairs(starts[small], f[small], t[small])
    iou = box_iou(x[i], x[j])
    reach = iou >= least
    lone = (np.bincount(i[reach], minlength=len(x)) <= 1)[i] & (np.bincount(j[reach], minlength=len(x)) <= 1)[j]
    chosen = np.bincount(of[reach & ~lone], minlength=int(small.sum())) > 0
    direct = reach & ~chosen[of]
    out = [(i[direct], j[direct])]
    ends = np.cumsum(f[small] * t[small])
    for g, a, n, m in zip(np.flatnonzero(chosen), starts[small][chosen], f[small][chosen], t[small][chosen], strict=True):
        out += [(np.array([p[0] for p in pairs]) + a, np.array([p[1] for p in pairs]) + a + n) for pairs in [method(iou[ends[g] - n * m : ends[g]].reshape(n, m), least)] if pairs]
    for a, n, m in zip(starts[~small], f[~small], t[~small], strict=True):
        pairs = method(_Overlaps(x[a : a + n], x[a + n : a + n + m]), least)
        out += [(np.array([p[0] for p in pairs]) + a, np.array([p[1] for p in pairs]) + a + n)] if pairs else []
    return out


def match_boxes(truth: DataFrame, found: DataFrame, group: str, item: str, score: str | None, least: float, method=greedy_matches) -> DataFrame:
    """group, found_item, truth_item: one-to-one matches of a page's boxes (x1, y1, x2, y2); found ones by falling ``score`` if given.

    A page is in one task, many pages at once. ``least`` is over 0, and ``method`` takes a pair that is
    the only one of its row and of its column to reach ``least``.
    """
    kinds = dict(found.dtypes) | {f"truth_{k}": v for k, v in truth.dtypes}
    box = [F.col(c).cast("double").alias(c) for c in BOX]
    none = lambda k: F.lit(None).cast(k)
    by = kinds[score] if score else "double"
    left = found.select(F.col(group).alias("k0"), F.lit(0).alias("side"), F.col(item).alias("f"), none(kinds[f"truth_{item}"]).alias("t"), *box, (F.col(score) if score else none(by)).alias("s"))
    right = truth.select(F.col(group).alias("k0"), F.lit(1).alias("side"), none(kinds[item]).alias("f"), F.col(item).alias("t"), *box, none(by).alias("s"))

    def run(batches):
        for rows, g in whole_groups(batches, 1):
            order = ordered(g, (rows.column("side"), "ascending"), (rows.column("s"), "descending"), (rows.column("f"), "ascending"), (rows.column("t"), "ascending"))
            side = rows.column("side").to_numpy()[order]
            t = np.bincount(g[order], weights=side).astype(int)
            n = np.bincount(g)
            pairs = _batch_matches(boxes_of(rows, BOX)[order], np.cumsum(n) - n, n - t, t, least, method)
            i, j = (pa.array(order[np.concatenate([p[k] for p in pairs])]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([rows.column("k0").take(i), rows.column("f").take(i), rows.column("t").take(j)], names=[group, "found_item", "truth_item"])

    return by_group(left.unionByName(right), ["k0"]).mapInArrow(run, f"{group} {kinds[group]}, found_item {kinds[item]}, truth_item {kinds[f'truth_{item}']}")


def bootstrap(cases: DataFrame, numbered: str, n: int, samples: int, seed: str, rate: Column, sums: list[str], at: dict[str, float]) -> DataFrame:
    """Percentiles of a rate over resampled cases. ``numbered``: a column of 0 .. n - 1.

    Slot i of sample s draws the case that sha256(seed, s, i) names, so draws need no driver and come
    out alike on any cluster. Draws of one case and sample are counted before cases are joined.
    """
    spark = cases.sparkSession
    slots = spark.range(0, samples * n, 1).select((F.col("id") / n).cast("long").alias("sample"), (F.col("id") % n).alias("slot"))
    digest = F.sha2(keyed(seed, F.col("sample").cast("string"), F.col("slot").cast("string")), 256)
    draws = slots.select("sample", F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(n)).alias(numbered)).groupBy("sample", numbered).agg(F.count("*").alias("times"))
    rates = draws.join(cases, numbered).groupBy("sample").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in sums]).select(rate.alias("rate"))
    return rates.agg(*[F.percentile("rate", p).alias(name) for name, p in at.items()])  # a row a sample


def macro_micro(reports: DataFrame, by: list[str], errors: str, events: str, failed: str) -> DataFrame:
    """Mean of cases' rates and rate of their sums over cases that did not fail; null without any."""
    ok = lambda c: F.when(~F.col(failed), c)
    rate = F.col(errors) / F.greatest(F.col(events), F.lit(1))
    return reports.groupBy(*by).agg(
        F.count("*").alias("cases"), F.count(F.when(F.col(failed), 1)).alias("failures"), F.avg(ok(rate)).alias("macro"),
        (F.sum(ok(F.col(errors))) / F.greatest(F.sum(ok(F.col(events))), F.lit(1))).alias("micro"),
    )
