"""Scalar functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_rate(n: Column, d: Column, empty: float | None = 1.0) -> Column:
    """n / d, and ``empty`` where d is 0."""
    return F.when(d == 0, F.lit(empty)).otherwise(n / d)


def count_f1(matched: Column, reference: Column, candidate: Column) -> Column:
    """2 m / (r + c), 1 when both sides are empty."""
    return safe_rate(2 * matched, reference + candidate)


def harmonic_f1(p: Column, r: Column) -> Column:
    """Harmonic mean of precision and recall; 1 where both are 0."""
    return F.when(p + r == 0, F.lit(1.0)).otherwise(2 * p * r / (p + r))


def sigmoid(x: Column, clamp: float = 40.0) -> Column:
    """Logistic function of x held within +-clamp; 0.5 for null and NaN."""
    held = F.greatest(F.lit(-clamp), F.least(F.lit(clamp), x))
    return F.when(x.isNull() | F.isnan(x), F.lit(0.5)).otherwise(1 / (1 + F.exp(-held)))


def normalised_text(c: Column) -> Column:
    """White space to single spaces, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, lengths of at least 1."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def accent_fold(c: Column | str) -> Column:
    """Compatibility decomposition without combining marks. No SQL function of Spark decomposes, hence Arrow batches."""

    def folded(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)))

    return F.pandas_udf(folded, "string")(c)


#: Character groups that scans confuse, and what they stand for (fixed values).
CONFUSED_PAIRS = [("rn", "m"), ("cl", "d"), ("vv", "w")]
CONFUSED_CHARACTERS = {"0": "o", "1": "l", "|": "l", "5": "s", "2": "z"}


def confusion_skeleton(c: Column) -> Column:
    """Lower case without accents, confused groups merged, letters and digits only."""
    out = accent_fold(F.lower(c))
    for seen, meant in CONFUSED_PAIRS:
        out = F.replace(out, F.lit(seen), F.lit(meant))
    out = F.translate(out, "".join(CONFUSED_CHARACTERS), "".join(CONFUSED_CHARACTERS.values()))
    return F.regexp_replace(out, r"[^\p{L}\p{N}]", "")


def text_family(c: Column) -> Column:
    """numeric: digits and no letter; music_word: letters, no digit, at most 12 characters between marks; else metadata_mixed."""
    t = normalised_text(c)
    letter, digit = t.rlike(r"\p{L}"), t.rlike(r"\p{Nd}")
    short = F.length(F.btrim(t, F.lit(" .,:;()[]{}"))) <= 12
    return F.when(digit & ~letter, "numeric").when(letter & ~digit & short, "music_word").otherwise("metadata_mixed")


def safe_filename(c: Column, most: int = 160, fallback: str = "converted_score") -> Column:
    """Characters that file systems refuse become underscores; trimmed of spaces and dots, white space single, cut; ``fallback`` if nothing is left."""
    clean = F.btrim(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(" ."))
    return F.coalesce(F.nullif(F.left(F.regexp_replace(clean, r"\s+", " "), F.lit(most)), F.lit("")), F.lit(fallback))


#: Words that titles share without being alike (fixed values).
TITLE_STOP_WORDS = ["the", "pour", "par", "chez", "des", "les", "une"]


def title_tokens(c: Column) -> Column:
    """Distinct words of three and more Latin letters, without stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-zà-öø-ÿ]{3,})"))), F.array(*[F.lit(w) for w in TITLE_STOP_WORDS]))


def title_similarity(a: Column, b: Column) -> Column:
    """Shared over all title tokens; 0 where a side has none."""
    x, y = title_tokens(a), title_tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def year_candidates(c: Column) -> Column:
    """Sorted distinct years from 1800 to 1950 that stand alone among digits."""
    years = F.regexp_extract_all(c, F.lit(r"(?<!\d)(1[89]\d{2})(?!\d)")).cast("array<int>")
    return F.array_sort(F.array_distinct(F.filter(years, lambda y: y <= 1950)))


def opening_tags(c: Column, name: str) -> Column:
    """How often a tag opens, with or without attributes, closed in itself or not."""
    return F.regexp_count(c, F.lit(rf"<{name}(?:\s[^<>]*?)?\s*/?>")).cast("long")


def strict_boolean(c: Column) -> Column:
    """true/1 and false/0; anything else is an error."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean"))


def unit_hash(key: Column) -> Column:
    """The first 64 bits of sha256 over 2^64 - 1."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551615.0)


def keyed(*parts) -> Column:
    """Strings joined by NUL, the form in which seeds and ids are hashed."""
    return F.concat_ws("\x00", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def midi_cents(step: Column, octave: Column, alter: Column) -> Column:
    """(semitone + 12 (octave + 1) + alter) * 100; an unknown step counts as 0."""
    semitone = F.lit(0)
    for name, n in zip("CDEFGAB", (0, 2, 4, 5, 7, 9, 11), strict=True):
        semitone = F.when(step == name, n).otherwise(semitone)
    return F.bround((semitone + 12 * (octave + 1) + alter) * 100).cast("int")


def box_overlap(a: list[Column], b: list[Column]) -> dict[str, Column]:
    """Of boxes (x1, y1, x2, y2): intersection area, IoU, and intersection over the smaller area (0 where empty)."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: F.greatest(F.lit(0), x[2] - x[0]) * F.greatest(F.lit(0), x[3] - x[1])
    inter = w * h
    return {"intersection": inter, "iou": safe_rate(inter, area(a) + area(b) - inter, 0.0), "min_overlap": safe_rate(inter, F.least(area(a), area(b)), 0.0)}


def tile_origins(length: Column, tile: int, stride: int) -> Column:
    """Starts of tiles along one axis: every ``stride``, and a last one that ends at the edge."""
    last = F.greatest(F.lit(0), length - tile)
    return F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))))
