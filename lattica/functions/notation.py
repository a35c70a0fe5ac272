"""Durations, keys, rational times and trees as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps in the order in which a key signature sharpens them; flats come in the reverse order (fixed values).
SHARPENED = "FCGDAEB"


def measure_duration(beats: Column, beat_type: Column) -> Column:
    """4 beats / beat_type in quarters; null where either is null or not positive."""
    return F.when((beats > 0) & (beat_type > 0), 4.0 * beats / beat_type)


def note_duration(base: Column, dots: Column, actual: Column, normal: Column) -> Column:
    """base (2 - 2^-dots) normal / actual."""
    return base * (2 - F.pow(F.lit(2.0), -dots)) * normal / actual


def key_alterations(fifths: Column) -> Column:
    """Map from step to +1 or -1 for the steps that a key signature alters."""
    steps = F.array(*[F.struct(F.lit(s).alias("key"), F.when(fifths > k, 1).when(-fifths > 6 - k, -1).otherwise(0).alias("value")) for k, s in enumerate(SHARPENED)])
    return F.map_from_entries(F.filter(steps, lambda x: x["value"] != 0))


def quantised_equal(ln: Column, ld: Column, rn: Column, rd: Column, divisions: Column) -> Column:
    """Whether ln/ld and rn/rd differ by at most 1/128 and 1/divisions; in whole numbers."""
    difference = F.abs(ln * rd - rn * ld)
    return (difference == 0) | (difference * F.greatest(F.lit(128), divisions) <= ld * rd)


def direction_end(kind: Column, end_value: Column) -> Column:
    """A direction's end value as far as it is content: a wedge's is a number local to its file, and counts as empty. A null kind is no wedge."""
    return F.when(kind == "wedge", "").otherwise(end_value)


def tree_value(nodes: list[dict], features: list[Column]) -> Column:
    """A decision tree compiled to nested conditions, so that scoring stays in the JVM.

    ``nodes``: feature (-2: leaf), threshold, left, right, value. Features count as 32-bit floats;
    at most the threshold goes left; a null or non-finite feature on the way gives 0.0, as does a
    tree that isn't well formed.
    """
    if not tree_is_valid(nodes, len(features)):
        return F.lit(0.0)

    def at(i: int) -> Column:
        n = nodes[i]
        if n["feature"] == -2:
            return F.lit(float(n["value"]))
        x = features[n["feature"]].cast("float").cast("double")
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        return F.when(~finite, 0.0).when(x <= float(n["threshold"]), at(n["left"])).otherwise(at(n["right"]))

    return at(0)


def tree_is_valid(nodes: list[dict], width: int) -> bool:
    """Each node is reached exactly once from the first, and every feature exists."""
    seen, todo = set(), [0]
    while todo:
        i = todo.pop()
        if i in seen or not 0 <= i < len(nodes):
            return False
        seen.add(i)
        if nodes[i]["feature"] != -2:
            if not 0 <= nodes[i]["feature"] < width:
                return False
            todo += [nodes[i]["left"], nodes[i]["right"]]
    return len(seen) == len(nodes)


def greedy_ctc(logits: Column, width: int) -> Column:
    """Best class of each step of a flat array of ``width`` logits a step; repeats merged, the last class (blank) dropped."""
    n = F.floor(F.size(logits) / width).cast("int")
    steps = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(logits, i * width + 1, F.lit(width)))
    best = F.transform(steps, lambda s: F.array_position(s, F.array_max(s)).cast("int") - 1)
    return F.filter(best, lambda c, i: (c != width - 1) & ((i == 0) | (c != F.get(best, i - 1))))


def point_transform(x: Column, y: Column, m: tuple[float, ...]) -> tuple[Column, Column]:
    """(a x + c y + e, b x + d y + f) for m = (a, b, c, d, e, f)."""
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f
