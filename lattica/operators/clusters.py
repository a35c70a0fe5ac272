"""Order-dependent merges within a group that is small by nature (a page, a system)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 65_536  # of whole groups that are worked on at once; a larger group comes alone


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; null and NaN each equal themselves."""
    kind = column.is_null().to_numpy(zero_copy_only=False).astype(int)
    if pa.types.is_floating(column.type):
        kind = kind + 2 * pc.fill_null(pc.is_nan(column), False).to_numpy(zero_copy_only=False)
    differ = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
    return np.where(kind[1:] == kind[:-1], differ & (kind[1:] == 0), True)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by the first ``keys`` columns, as batches cut between groups, with the number of each row's group."""
    def numbered(rows: pa.RecordBatch) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(np.any([_changes(rows.column(i)) for i in range(keys)], axis=0)))) if rows.num_rows > 1 else np.zeros(rows.num_rows, int)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < ROWS:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        group = numbered(rows)
        last = int(np.searchsorted(group, group[-1]))
        if last:
            yield rows.slice(0, last), group[:last]
        held, n = [rows.slice(last)], 0  # a group that is not over yet is looked at again after as many rows
    if held and (whole := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield whole[0], numbered(whole[0])


def by_group(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each group in one task, in one piece."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def ordered(group: np.ndarray, *keys: tuple[pa.Array, str]) -> np.ndarray:
    """Places of rows by group and then keys, each ascending or descending; nulls and NaN last, ties as they come."""
    columns, names = [pa.array(group)], [("g", "ascending")]
    for i, (c, way) in enumerate(keys):
        columns.append(pc.if_else(pc.is_nan(c), None, c) if pa.types.is_floating(c.type) else c)
        names.append((f"c{i}", way))
    return pc.sort_indices(pa.table(dict(zip([k for k, _ in names], columns, strict=True))), sort_keys=names, null_placement="at_end").to_numpy()


def boxes_of(rows: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([rows.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(float)


def suppress(df: DataFrame, group: list[str], item: str, box: list[str], score: str, most: float) -> DataFrame:
    """group, item of boxes kept: best score first (ties to the smaller item), each kept if no kept box has an IoU of ``most`` or more. A group in one task, many groups at once."""
    kinds = dict(df.dtypes)
    sides = ["x1", "y1", "x2", "y2"]

    def run(batches):
        for rows, g in whole_groups(batches, len(group)):
            left = ordered(g, (rows.column("score"), "descending"), (rows.column("item"), "ascending"))
            x, g, kept = boxes_of(rows, sides), g[left], []
            while len(left):  # each group's best box left is kept, and what it suppresses goes
                first = np.concatenate(([True], g[1:] != g[:-1]))
                kept.append(left[first])
                best = left[first][np.cumsum(first) - 1][~first]
                left, g = left[~first], g[~first]
                free = box_iou(x[best], x[left]) < most
                left, g = left[free], g[free]
            rows = rows.take(pa.array(np.concatenate(kept)))
            yield pa.RecordBatch.from_arrays(rows.columns[: len(group) + 1], names=[*group, item])

    keys = [f"k{i}" for i in range(len(group))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(group, keys, strict=True)], F.col(item).alias("item"), *[F.col(c).cast("double").alias(k) for c, k in zip(box, sides, strict=True)], F.col(score).alias("score"))
    return by_group(rows, keys).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in [*group, item]))


def box_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of one box with each of some, or of boxes pair by pair; 0 where the union is empty."""
    side = lambda k: np.maximum(0, np.minimum(a[..., k + 2], b[:, k + 2]) - np.maximum(a[..., k], b[:, k]))
    inter = side(0) * side(1)
    union = (a[..., 2] - a[..., 0]) * (a[..., 3] - a[..., 1]) + (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def running_median_clusters(values: Column, tolerance: float) -> Column:
    """Of a sorted array of doubles: clusters, a value joining the last one if within ``tolerance`` of that one's median so far."""
    def median(a: Column) -> Column:
        n = F.size(a)
        return (F.element_at(a, F.floor((n + 1) / 2).cast("int")) + F.element_at(a, F.floor(n / 2).cast("int") + 1)) / 2

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.abs(x - median(last)) <= tolerance)
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.array(x))))).otherwise(F.concat(done, F.array(F.array(x))))

    return F.aggregate(values, F.array().cast("array<array<double>>"), step)
