"""Costs, weights, gates and equivalences of notes, measures and candidates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.notation import quantised_equal, tree_value
from lattica.functions.scalars import sigmoid


def held(x: Column, low: float, high: float) -> Column:
    """x within [low, high]."""
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def pitch_cost(a_cents: Column, b_cents: Column, a_rest: Column, b_rest: Column) -> Column:
    """Steps 0, .25, .55, .8, 1 by distance up to 0, 100, 200, 500 cents; a rest against a note 1; one pitch missing .8."""
    d = F.abs(a_cents - b_cents)
    by_pitch = F.when(d == 0, 0.0).when(d <= 100, 0.25).when(d <= 200, 0.55).when(d <= 500, 0.8).otherwise(1.0)
    missing = F.when(a_cents.isNull() & b_cents.isNull(), 0.0).when(a_cents.isNull() | b_cents.isNull(), 0.8)
    return F.when(a_rest | b_rest, F.when(a_rest == b_rest, 0.0).otherwise(1.0)).otherwise(F.coalesce(missing, by_pitch))


def note_cost(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Cost of taking note a for b. Keys: cents, rest, duration, onset, grace, chord, accidental, marks (array of strings)."""
    x, y = a["duration"], b["duration"]
    duration = F.when(x == y, 0.0).when((x <= 0) | (y <= 0), 1.0).otherwise(F.least(F.lit(1.0), F.abs(F.log2(x / y)) / 2))
    onset = F.least(F.lit(1.0), F.abs(a["onset"] - b["onset"]) / F.greatest(x, y, F.lit(0.25)))
    either = F.size(F.array_union(a["marks"], b["marks"]))
    marks = F.when(either == 0, 0.0).otherwise((either - F.size(F.array_intersect(a["marks"], b["marks"]))) / either)
    differs = lambda k: F.when(a[k] == b[k], 0.0).otherwise(1.0)
    total = 0.48 * pitch_cost(a["cents"], b["cents"], a["rest"], b["rest"]) + 0.30 * duration + 0.10 * onset
    return F.least(F.lit(1.0), total + 0.04 * differs("grace") + 0.025 * differs("chord") + 0.02 * differs("accidental") + 0.025 * marks)


def measure_distance(notes: Column, directions: Column, time: Column, key: Column, clef: Column, barlines: Column) -> Column:
    """.80 note distance, .12 direction distance, .08 attributes; the last four are whether they differ."""
    attributes = sum((F.when(c, w).otherwise(0.0) for c, w in ((time, 0.40), (key, 0.25), (clef, 0.20), (barlines, 0.15))), F.lit(0.0))
    return F.least(F.lit(1.0), 0.80 * notes + 0.12 * directions + 0.08 * F.least(F.lit(1.0), attributes))


def aligned_similarity(cost_sum: Column, matched: Column, left: Column, right: Column) -> Column:
    """.72 semantic + .28 coverage over the longer side; 1 where both are empty, 0 where nothing matched."""
    longer = F.greatest(left, right, F.lit(1))
    return F.when(left + right == 0, 1.0).when(matched == 0, 0.0).otherwise(held(0.72 * (matched - cost_sum) / longer + 0.28 * matched / longer, 0.0, 1.0))


def candidate_weight(score: Column, median: Column, valid: Column, local: Column) -> Column:
    """Validity 1 or .35, times .55 + logistic of the score over the median, times a local factor within .5 to 1.5."""
    logistic = 1 / (1 + F.exp(-held((score - median) / 100, -5.0, 5.0)))
    return F.when(valid, 1.0).otherwise(0.35) * (0.55 + logistic) * held(local, 0.5, 1.5)


def candidate_quality(raw_score: Column, gap_penalty: Column, valid: Column, agreement: Column, probability: Column) -> Column:
    """Evidence before any expectation of the layout: score, validity, agreement and probability multiplied."""
    score = held((raw_score + gap_penalty + 120) / 1120, 0.08, 1.35)
    return F.when(valid, 1.0).otherwise(0.30) * score * (0.45 + held(agreement, 0.0, 1.0)) * (0.50 + held(probability, 0.0, 1.0))


def bounded_weight(probability: Column, floor: float, ceiling: float) -> Column:
    """Linear from floor to ceiling; bounds in the wrong order are exchanged."""
    low, high = min(floor, ceiling), max(floor, ceiling)
    return low + (high - low) * held(probability, 0.0, 1.0)


def keys_equivalent(a_fifths: Column, b_fifths: Column) -> Column:
    """The printed key alone, whatever the mode; missing keys equal only each other."""
    return a_fifths.eqNullSafe(b_fifths)


def rhythm_equivalent(a: dict[str, Column], b: dict[str, Column], divisions: Column) -> Column:
    """Same written key (type, dots, chord and so on), and onset and duration equal up to rounding. Keys: key, on_n, on_d, du_n, du_d."""
    return a["key"].eqNullSafe(b["key"]) & quantised_equal(a["on_n"], a["on_d"], b["on_n"], b["on_d"], divisions) & quantised_equal(a["du_n"], a["du_d"], b["du_n"], b["du_d"], divisions)


def candidate_is_strong(valid: Column, issues: list[Column], staff_gap: Column, measure_gap: Column, expected: Column, score: Column, least_score: float, gap_ratio: float) -> Column:
    """Valid, without any issue, no staff too many or few, measures within the allowed gap, and a score of at least ``least_score``."""
    allowed = F.when(F.coalesce(expected, F.lit(0)) == 0, 1).otherwise(F.greatest(F.lit(1), F.bround(expected * gap_ratio).cast("int")))
    clean = valid & (score >= least_score) & (F.coalesce(staff_gap, F.lit(0)) == 0) & F.coalesce(measure_gap <= allowed, F.lit(True))
    for n in issues:
        clean = clean & (n == 0)
    return clean


def nearest_staff(y: Column, staffs: Column, most_spaces: float = 8.0) -> Column:
    """Of an array of structs (index, top, bottom, spacing): index and placement of the nearest staff in its own spaces, the first of equals; null beyond ``most_spaces``."""
    spaces = lambda s: F.greatest(s["top"] - y, y - s["bottom"], F.lit(0.0)) / F.greatest(s["spacing"], F.lit(1.0))
    above = lambda s: F.when(y < s["top"], True).when(y > s["bottom"], False).otherwise(y <= (s["top"] + s["bottom"]) / 2)
    scored = F.transform(staffs, lambda s, i: F.struct(spaces(s).alias("d"), i.alias("i"), s["index"].alias("index"), F.when(above(s), "above").otherwise("below").alias("placement")))
    best = F.array_min(scored)
    return F.when(best["d"] <= most_spaces, F.struct(best["index"].alias("index"), best["placement"].alias("placement")))


def intersection_box(box: list[Column], crop: list[Column]) -> list[Column]:
    """The common part; right below left or bottom above top where there is none."""
    return [F.greatest(box[0], crop[0]), F.greatest(box[1], crop[1]), F.least(box[2], crop[2]), F.least(box[3], crop[3])]


def visible_fraction(box: list[Column], crop: list[Column]) -> Column:
    """Share of a box's area inside a crop; 0 outside, null for a box without area."""
    x = intersection_box(box, crop)
    area = (box[2] - box[0]) * (box[3] - box[1])
    return F.when((box[2] > box[0]) & (box[3] > box[1]), F.greatest(x[2] - x[0], F.lit(0)) * F.greatest(x[3] - x[1], F.lit(0)) / area)


def fragment_visible(box: list[Column], crop: list[Column], least: float, least_long: float, long_span: Column, overlap: float) -> Column:
    """Enough of the area; or, of a long span larger than the crop on some axis, an overlap's width on each such axis and ``least_long`` on the others."""
    x = intersection_box(box, crop)
    some = (x[2] > x[0]) & (x[3] > x[1])
    enough = visible_fraction(box, crop) + 1e-9 >= F.when(long_span, least_long).otherwise(least)
    axes, oversized = F.lit(True), F.lit(False)
    for k in (0, 1):
        whole, room, seen = box[k + 2] - box[k], crop[k + 2] - crop[k], x[k + 2] - x[k]
        too_large = whole > room + 1e-9
        oversized = oversized | too_large
        axes = axes & F.when(too_large, seen + 1e-9 >= F.least(F.lit(overlap), room)).otherwise(seen / whole + 1e-9 >= least_long)
    return some & (enough | (long_span & oversized & axes))


def page_shape_supported(width: Column, height: Column, most: float = 3.0) -> Column:
    """Whether the longer side is at most ``most`` times the shorter; false without sides."""
    return F.when((width > 0) & (height > 0), F.greatest(width, height) / F.least(width, height) <= most).otherwise(False)


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters of a text between two spaces on each side."""
    padded = F.concat(F.lit("  "), c, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3))))


def shortlist_score(a: Column, b: Column, a_grams: Column, b_grams: Column, grams: float = 0.7, lengths: float = 0.3, first: float = 0.15) -> Column:
    """Weighted trigram Jaccard and ratio of lengths, and a bonus for the same first letter."""
    jaccard = F.size(F.array_intersect(a_grams, b_grams)) / F.size(F.array_union(a_grams, b_grams))
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return grams * jaccard + lengths * ratio + F.when(F.left(a, F.lit(1)) == F.left(b, F.lit(1)), first).otherwise(0.0)


def natural_key(c: Column, width: int = 20) -> Column:
    """A string that sorts as text with numbers by value: lower case, runs of digits padded to ``width``."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"([0-9]+|[^0-9]+)"))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, width, "0")).otherwise(p)), "")


#: Marks at both ends that direction words are read without (fixed values).
WORD_EDGES, DIRECTION_EDGES = " ,;:()[]{}", " \t\r\n,;:()[]{}"


def _plain_marks(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.btrim(c, F.lit(" \t\n\r\x0b\x0c")), "’`—–", "''--"), r"\s+", " ")


def normalised_words(c: Column) -> Column:
    """Plain quotes and dashes, single spaces, lower case, without marks at the ends."""
    return F.btrim(F.lower(_plain_marks(c)), F.lit(WORD_EDGES))


def normalised_direction(c: Column) -> Column:
    """As normalised_words, but leading punctuation goes first, full stops, exclamation and question marks among it."""
    return F.lower(F.btrim(F.regexp_replace(_plain_marks(c), r"^[.,;:!?]+", ""), F.lit(DIRECTION_EDGES)))


def forest_probability(trees: list[list[dict]], features: list[Column], intercept: float = 0.0, slope: float = 1.0) -> Column:
    """Logistic of intercept + slope * mean tree value; 0.5 without trees."""
    if not trees:
        return F.lit(0.5)
    return sigmoid(intercept + slope * sum((tree_value(t, features) for t in trees), F.lit(0.0)) / len(trees))


def boosting_probability(trees: list[list[dict]], features: list[Column], start: float, rate: float, intercept: float = 0.0, slope: float = 1.0) -> Column:
    """Logistic of intercept + slope * (start + rate * sum of tree values)."""
    return sigmoid(intercept + slope * (start + rate * sum((tree_value(t, features) for t in trees), F.lit(0.0))))
