"""Rules on the columns of one row: gates on evidence, log lines, page numbers, accidentals, routing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# Thresholds of the evidence gates.
EXACT = {"families": 3, "family_support": 2 / 3, "candidate_support": 2 / 3, "missing": 0.05, "ensemble": 0.0, "measure": 0.0, "event": -0.05, "direct": -0.10, "direct_layers": 2}
SEMANTIC = {"families": 3, "family_support": 2 / 3, "candidate_support": 0.84, "missing": 0.10, "cluster_distance": 0.045, "medoid_distance": 1e-9, "ensemble": 0.0, "measure": 0.0, "event": -0.05, "context": -0.10, "page_score": -17.0, "visual": -0.035}

# Accidentals and what they alter.
ACCIDENTALS = {"sharp": 1, "flat": -1, "natural": 0, "double-sharp": 2, "sharp-sharp": 2, "double-flat": -2, "flat-flat": -2}

# Weights of token families, and the tokens of two of them.
PRIORITY = {"tie": 8.0, "slur": 6.0, "ornament": 6.0, "articulation": 4.0, "beam": 1.0}
ARTICULATIONS = ["accent", "breath-mark", "caesura", "detached-legato", "doit", "falloff", "marcato", "plop", "scoop", "spiccato", "staccatissimo", "staccato", "stress", "strong-accent", "tenuto", "unstress"]
ORNAMENTS = ["delayed-inverted-turn", "delayed-turn", "inverted-mordent", "inverted-turn", "mordent", "schleifer", "shake", "tremolo", "trill-mark", "turn"]

MAJOR, MINOR = (0, 2, 4, 5, 7, 9, 11), (0, 2, 3, 5, 7, 8, 10)


def _families(e: Column, support: str, least: dict) -> Column:
    asked = F.greatest(F.lit(1), e["eligible_families"])
    heard = F.greatest(F.lit(0), F.least(asked, e[support]))
    return (heard >= least["families"]) & (heard / asked >= least["family_support"])


def exact_majority_holds(e: Column) -> Column:
    """Whether struct ``e`` lets an exact majority replace the template. Null evidence gives null, which filters as no."""
    unharmed = sum((e[c] >= EXACT["direct"]).cast("int") for c in ("visual", "event", "context"))
    return (
        (e["kind"] == "exact_majority") & e["strict_majority"] & e["page_valid"] & _families(e, "exact_families", EXACT)
        & (e["exact_support"] >= EXACT["candidate_support"]) & (e["missing"] <= EXACT["missing"])
        & (e["ensemble"] >= EXACT["ensemble"]) & (e["measure"] >= EXACT["measure"]) & (e["event"] >= EXACT["event"])
        & (unharmed >= EXACT["direct_layers"])
    )


def semantic_consensus_holds(e: Column) -> Column:
    """Whether struct ``e`` lets the medoid of a semantic cluster replace the template; either page score or visual evidence may be worse, not both."""
    return (
        (e["kind"] == "semantic_consensus") & e["page_valid"] & _families(e, "semantic_families", SEMANTIC)
        & (e["semantic_support"] >= SEMANTIC["candidate_support"]) & (e["missing"] <= SEMANTIC["missing"])
        & (e["cluster_distance"] <= SEMANTIC["cluster_distance"]) & (e["medoid_distance"] <= SEMANTIC["medoid_distance"])
        & (e["ensemble"] >= SEMANTIC["ensemble"]) & (e["measure"] >= SEMANTIC["measure"])
        & (e["event"] >= SEMANTIC["event"]) & (e["context"] >= SEMANTIC["context"])
        & ((e["page_score"] >= SEMANTIC["page_score"]) | (e["visual"] >= SEMANTIC["visual"]))
    )


def floor_failures(metrics: dict[str, tuple[Column, float]], classes: Column, floors: dict[str, float]) -> Column:
    """Array of ``name=value<floor`` of the metrics below their floor, then of classes by name; a missing metric or class counts as -1."""
    def failure(name: str, value: Column, floor: float) -> Column:
        value = F.coalesce(value.cast("double"), F.lit(-1.0))
        return F.when(value < floor, F.format_string(f"{name}=%.6f<{floor:.6f}", value))

    every = [failure(n, v, f) for n, (v, f) in metrics.items()]
    every += [failure(f"class:{n}", classes[n], f) for n, f in sorted(floors.items())]
    return F.array_compact(F.array(*every))


def accidental_token(name: Column) -> Column:
    """Lower case, _ and inner white space as -, so that two-word names are joined. Null is empty."""
    plain = F.translate(F.lower(F.coalesce(name, F.lit(""))), "_", "-")
    return F.regexp_replace(F.regexp_replace(plain, r"^\s+|\s+$", ""), r"\s+", "-")


def accidental_alter(token: Column) -> Column:
    """Alteration of a normalised accidental; null where it is none of the known ones."""
    known = F.create_map(*[F.lit(x) for pair in ACCIDENTALS.items() for x in pair])
    return F.try_element_at(known, token)


def in_key(cents: Column, fifths: Column, minor: Column) -> Column:
    """1 where the pitch belongs to the scale of the key, else 0."""
    tonic = F.pmod(7 * fifths - F.when(minor, 3).otherwise(0), F.lit(12))
    degree = F.pmod(F.floor(cents / 100) - tonic, F.lit(12))
    return F.when(minor, degree.isin(*MINOR)).otherwise(degree.isin(*MAJOR)).cast("int")


def family_priority(text: Column) -> Column:
    """Weighted tokens of the families of a token text, at most 8 each, and 0.25 for each family present. Null has none."""
    tokens = F.split(F.coalesce(text, F.lit("")), r"\s+")
    rules = {
        "tie": lambda x: x.startswith("tie:") | x.startswith("tied:"),
        "slur": lambda x: x.startswith("slur:"),
        "ornament": lambda x: x.isin(*ORNAMENTS) | x.startswith("wavy-line:"),
        "articulation": lambda x: x.isin(*ARTICULATIONS),
        "beam": lambda x: x.startswith("beam:"),
    }
    counts = {family: F.size(F.filter(tokens, rule)) for family, rule in rules.items()}
    return sum(PRIORITY[f] * F.least(n, F.lit(8)) + F.when(n > 0, 0.25).otherwise(0.0) for f, n in counts.items())


_PAGES = r"\b(?:p|s|k)\.?\s*\[?(\d{1,3})\]?(?:\s*[-–—]\s*\[?(\d{1,3})\]?)?"
_PAGE_LIST = r"\b(?:p|s|k)\.?\s*\[\s*(\d{1,3})\s*,\s*(\d{1,3})"


def page_extent(text: Column) -> Column:
    """Largest page number from 1 to 200 that a p, s or k announces; 0 without any."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p in (_PAGES, _PAGE_LIST) for g in (1, 2)])
    numbers = F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda n: (n > 0) & (n <= 200))
    return F.coalesce(F.array_max(numbers), F.lit(0))


_SUMMARY = r"(?i)((?:\d+ (?:failed|passed|skipped|warnings?|errors?),? ?)+)in \d+(?:\.\d+)?s"


def log_totals(text: Column) -> Column:
    """Struct of passed, failed, skipped, warnings, errors, total and skipped_lines by the last summary of a test log; null without one."""
    body = F.try_element_at(F.regexp_extract_all(text, F.lit(_SUMMARY), F.lit(1)), F.lit(-1))

    def last(kind: str) -> Column:
        return F.coalesce(F.try_element_at(F.regexp_extract_all(body, F.lit(rf"(?i)(\d+) {kind}"), F.lit(1)), F.lit(-1)).cast("int"), F.lit(0))

    passed, failed, skipped, errors = last("passed"), last("failed"), last("skipped"), last("errors?")
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.ltrim(x).startswith("SKIPPED ["))
    fields = {"passed": passed, "failed": failed, "skipped": skipped, "warnings": last("warnings?"), "errors": errors, "total": passed + failed + skipped + errors, "skipped_lines": F.size(lines)}
    return F.when(body.isNotNull(), F.struct(*[v.alias(k) for k, v in fields.items()]))


def metric_log(text: Column, names: tuple[str, ...] = ("precision", "recall", "hmean")) -> Column:
    """Struct of the last finite value of each metric in a log; null where one is missing or outside [0, 1]."""
    def last(name: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9_]){name}(?![A-Za-z0-9_])\s*['\"]?\s*[:=]\s*([0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"), F.lit(1))
        finite = F.filter(F.transform(found, lambda x: x.cast("double")), lambda x: x < float("inf"))
        return F.try_element_at(finite, F.lit(-1))

    values = {n: last(n) for n in names}
    fit = F.lit(True)
    for v in values.values():
        fit = fit & F.coalesce(v.between(0, 1), F.lit(False))
    return F.when(fit, F.struct(*[v.alias(n) for n, v in values.items()]))


def softmax_route(logits: dict[str, Column]) -> tuple[Column, Column]:
    """Map of shares, and names from the largest share down; ties keep the order given. Logits more than 40 below the largest count as 40 below."""
    peak = F.greatest(*logits.values())
    raw = {n: F.exp(F.greatest(F.lit(-40.0), v - peak)) for n, v in logits.items()}
    total = sum(raw.values())
    shares = F.create_map(*[x for n, v in raw.items() for x in (F.lit(n), v / total)])
    order = F.sort_array(F.array(*[F.struct((-v).alias("share"), F.lit(i).alias("at"), F.lit(n).alias("name")) for i, (n, v) in enumerate(raw.items())]))
    return shares, F.transform(order, lambda x: x["name"])


def share_out(estimates: list[int], total: int) -> list[int]:
    """Whole counts of at least 1 near the estimates' shares of ``total``: too many come off where the count exceeds its share most, too few go where it lacks most, earlier places first. No estimates give [total]; a total below their number is exceeded."""
    if not len(estimates):
        return [int(total)]
    weights = [max(1, int(e)) for e in estimates]
    if sum(weights) == total:
        return weights
    shares = [w / sum(weights) * total for w in weights]
    counts = [max(1, int(s // 1)) for s in shares]
    for _ in range(abs(sum(counts) - total)):
        lacks = [s - c for s, c in zip(shares, counts, strict=True)]
        if sum(counts) < total:
            counts[lacks.index(max(lacks))] += 1
        else:
            left = [(lack, i) for i, lack in enumerate(lacks) if counts[i] > 1]
            if not left:
                break
            counts[min(left)[1]] -= 1
    return counts


@F.pandas_udf(ArrayType(IntegerType()))
def shared_out(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """``share_out`` of columns of estimates and totals; a null in either gives null."""
    for estimates, totals in batches:
        yield pd.Series([None if e is None or pd.isna(t) else share_out(list(e), int(t)) for e, t in zip(estimates, totals, strict=True)], dtype=object)
