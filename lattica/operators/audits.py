"""Audits of measures, patches, families, parts and pages. Groups named small (a measure, a page, a part) are so by nature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import rules as R
from lattica.functions.notation import key_alterations
from lattica.operators.selection import stable_sample

ISSUES = ("multiple_voices", "empty_measure", "zero_duration", "type_duration_mismatch", "pitch_outlier", "chord_duration_mismatch", "density_outlier", "duplicate_direction")


def note_audit(measures: DataFrame, notes: DataFrame, directions: DataFrame, floor: int = 24, factor: int = 5) -> DataFrame:
    """score, measure, code, n of the issues found. measures: score, measure; notes: measure, idx, voice, grace, chord, onset, duration, expected, cents; directions: measure, key.

    Grace notes don't count. A chord note is held against the last main note before it at its onset. A measure is dense when it
    has more than ``floor`` notes and ``factor`` times the upper median of its score's measures that have notes.
    """
    before = Window.partitionBy("measure", "onset").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    main = F.last(F.when(~F.col("chord"), F.col("duration")), ignorenulls=True).over(before)
    long, short = F.greatest("duration", "expected"), F.least("duration", "expected")
    regular = notes.where(~F.col("grace")).withColumn("main", main)
    counted = regular.groupBy("measure").agg(
        F.count("*").alias("density"),
        F.count_distinct("voice").alias("voices"),
        F.count_if(F.col("duration") <= 0).alias("zero_duration"),
        F.count_if((F.col("duration") > 0) & F.col("expected").isNotNull() & (long / F.nullif(short, F.lit(0)) > 1.08)).alias("type_duration_mismatch"),
        F.count_if(~F.col("cents").between(1200, 12000)).alias("pitch_outlier"),
        F.count_if(F.col("chord") & (F.col("main") != F.col("duration"))).alias("chord_duration_mismatch"),
    )
    doubled = directions.groupBy("measure", "key").count().groupBy("measure").agg(F.max("count").alias("repeats"))
    rows = measures.join(counted, "measure", "left").join(doubled, "measure", "left").na.fill(0)
    by_density = Window.partitionBy("score").orderBy("density")
    middle = rows.where("density > 0").groupBy("score", "density").agg(F.count("*").alias("n"))
    middle = middle.withColumn("upto", F.sum("n").over(by_density)).withColumn("all", F.sum("n").over(Window.partitionBy("score")))
    middle = middle.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("score").agg(F.min("density").alias("median"))
    rows = rows.join(middle, "score", "left")
    found = {
        "multiple_voices": F.col("voices") > 1,
        "empty_measure": F.col("density") == 0,
        "density_outlier": F.col("density") > F.greatest(F.lit(floor), F.col("median") * factor),
        "duplicate_direction": F.col("repeats") > 1,
    }
    counts = [F.struct(F.lit(c).alias("code"), (F.coalesce(found[c].cast("long"), F.lit(0)) if c in found else F.col(c)).alias("n")) for c in ISSUES]
    return rows.select("score", "measure", F.inline(F.array(*counts))).where("n > 0")


def introduced_issues(issues: DataFrame, key: str) -> DataFrame:
    """key, accepted, reason from rows of key, code, after (whether seen after the patch): rejected where any audited code became more frequent. Other codes don't count."""
    change = F.sum(F.when(F.col("code").isin(*ISSUES), F.when(F.col("after"), 1).otherwise(-1)).otherwise(0))
    codes = issues.groupBy(key, "code").agg(change.alias("change")).groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("change") > 0, F.col("code")))).alias("codes"))
    none = F.size("codes") == 0
    return codes.select(key, none.alias("accepted"), F.when(none, "validated").otherwise(F.concat(F.lit("introduced_"), F.array_join("codes", "+"))).alias("reason"))


def _pitched(notes: DataFrame) -> DataFrame:
    steps = F.coalesce(F.try_element_at(key_alterations(F.greatest(F.lit(-7), F.least(F.lit(7), F.coalesce("fifths", F.lit(0))))), F.upper("step")), F.lit(0))
    return notes.where("step is not null and not rest and not grace").withColumns({"step": F.upper("step"), "in_key": steps, "token": R.accidental_token(F.col("accidental"))})


def _position(measure: str) -> Window:
    return Window.partitionBy(measure, "step", "octave").orderBy("idx")


def accidental_issues(notes: DataFrame, measure: str) -> DataFrame:
    """measure, idx, code, step, octave of notes (measure, idx, step, octave, alter, fifths, accidental, continues, rest, grace) whose alteration contradicts the accidental or the state so far.

    A known accidental and a tie's continuation set the state of their step and octave; an unknown accidental sets nothing.
    """
    known = R.accidental_alter(F.col("token"))
    sets = F.when(known.isNotNull() | ((F.col("token") == "") & F.col("continues")), F.col("alter"))
    state = F.last(sets, ignorenulls=True).over(_position(measure).rowsBetween(Window.unboundedPreceding, -1))
    code = (
        F.when((F.col("token") != "") & known.isNull(), "unsupported_accidental")
        .when((F.col("token") != "") & (known != F.col("alter")), "explicit_alter_mismatch")
        .when((F.col("token") == "") & ~F.col("continues") & (F.col("alter") != F.coalesce(state, F.col("in_key"))), "implicit_alter_state_mismatch")
    )
    return _pitched(notes).select(measure, "idx", code.alias("code"), "step", "octave").where("code is not null")


def accidental_changes(before: DataFrame, after: DataFrame, measure: str) -> DataFrame:
    """Issues of ``accidental_issues`` that stand on one side only, with change introduced or resolved."""
    keys = [measure, "idx", "code", "step", "octave"]
    both = before.withColumn("side", F.lit(0)).unionByName(after.withColumn("side", F.lit(1)))
    sides = both.groupBy(*keys).agg(F.min("side").alias("least"), F.max("side").alias("most")).where("least = most")
    return sides.select(*keys, F.when(F.col("least") == 1, "introduced").otherwise("resolved").alias("change"))


def accidental_markers(notes: DataFrame, measure: str) -> DataFrame:
    """measure, idx, step, octave, alter of notes that need or carry a sign. After any note the state of its step and octave is that note's alteration."""
    state = F.coalesce(F.lag("alter").over(_position(measure)), F.col("in_key"))
    needs = (F.col("token") != "") | (~F.col("continues") & (F.col("alter") != state))
    return _pitched(notes).select(measure, "idx", "step", "octave", "alter", needs.alias("needs")).where("needs").drop("needs")


def voice_topology(notes: DataFrame, measure: str, staff: Column, voice: Column) -> DataFrame:
    """measure, topology: sorted staff:voice:notes. A null staff or one below 1 is 1, a null or empty voice is 1."""
    keys = [F.greatest(F.lit(1), F.coalesce(staff, F.lit(1))).alias("staff"), F.coalesce(F.nullif(voice, F.lit("")), F.lit("1")).alias("voice")]
    counts = notes.groupBy(measure, *keys).count()
    return counts.groupBy(measure).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("staff", "voice", "count"))), lambda x: F.concat_ws(":", x["staff"], x["voice"], x["count"])), ",").alias("topology"))


def objects_by_class(df: DataFrame, page: list[str], item: str, label: str) -> DataFrame:
    """label, objects: each object of a page once, in however many tiles it shows. One object of two labels is an error."""
    once = df.groupBy(*page, item).agg(F.min(label).alias(label), F.max(label).alias("other"))
    checked = F.when(F.col(label) == F.col("other"), F.col(label)).otherwise(F.raise_error(F.lit("an object has two labels")).cast(dict(df.dtypes)[label]))
    return once.select(checked.alias(label)).groupBy(label).agg(F.count("*").alias("objects"))


def overlap_summary(df: DataFrame, group: list[str], value: str, floors: tuple[float, ...] = (0.25, 0.35, 0.4, 0.5, 0.7)) -> DataFrame:
    """objects, minimum, p10, median, p90 (interpolated), mean and the share at each floor. Buffers a group's distinct values."""
    quantiles = [F.percentile(value, q).alias(n) for n, q in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))]
    shares = [F.avg((F.col(value) >= f).cast("int")).alias(f"at_least_{round(f * 100)}") for f in floors]
    return df.groupBy(*group).agg(F.count(value).alias("objects"), F.min(value).alias("minimum"), *quantiles, F.avg(value).alias("mean"), *shares)


def committed_families(df: DataFrame, page: str, family: str, selected: Column, size: Column) -> DataFrame:
    """page, families: those of which all ``size`` members stand in the page and all are selected."""
    whole = df.groupBy(page, family).agg((F.bool_and(selected) & (F.count("*") == F.max(size))).alias("whole"))
    return whole.groupBy(page).agg(F.count_if("whole").alias("families"))


def count_evidence(df: DataFrame, page: str, family: str, count: str, quality: str, valid: str) -> DataFrame:
    """Evidence for each candidate count of a page. A family gives one vote, shared among its counts by their best quality; one invalid member silences its family. Counts of 0 or null don't take part.

    Rows of a page are dealt once; all later steps keep that dealing.
    """
    cells = df.where(F.col(count) > 0).repartition(page).groupBy(page, family, count).agg(
        F.max(quality).alias("best"), F.sum(quality).alias("support"), F.sum(F.col(quality) * F.col(quality)).alias("squares"),
        F.count("*").alias("members"), F.count_if(valid).alias("valid_members"))
    kin, all_ = Window.partitionBy(page, family), Window.partitionBy(page)
    cells = cells.withColumn("whole", F.min((F.col("members") == F.col("valid_members")).cast("int")).over(kin)).withColumn("share", F.col("best") / F.coalesce(F.nullif(F.sum("best").over(kin), F.lit(0)), F.lit(1)))
    cells = cells.withColumn("first", (F.row_number().over(kin.orderBy(count)) == 1).cast("int")).withColumn("asked", F.greatest(F.lit(1), F.sum(F.col("whole") * F.col("first")).over(all_)))
    heard = F.sum("whole") / F.max("asked")
    mean = F.sum("support") / F.sum("members")
    return cells.groupBy(page, count).agg(
        F.sum("support").alias("support"), (F.sum(F.col("share") * F.col("whole")) / F.max("asked")).alias("balanced_support"),
        (F.sum("valid_members") / F.sum("members")).alias("valid_share"), heard.alias("family_share"), F.sum("whole").alias("families"), F.sum("members").alias("candidates"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum("squares") / F.sum("members") - mean * mean)).alias("quality_std"),
        F.greatest(F.lit(0.0), 1 - F.sum("whole") / F.sum("members")).alias("duplicate_ratio"))


def family_gate(df: DataFrame, run: str, family: str, names: list[str], most: float) -> DataFrame:
    """run, accepted, worst from rows of run, family, side (baseline or candidate), tokens, f1: all named families on both sides, and none that the baseline has tokens of losing more than ``most``. worst is null where none is compared."""
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    both = df.where(F.col(family).isin(*names)).groupBy(run, family).agg(side("baseline", "tokens").alias("tokens"), side("baseline", "f1").alias("was"), side("candidate", "f1").alias("now"), F.count_distinct("side").alias("sides"))
    both = both.withColumn("loss", F.when(F.col("tokens") > 0, F.col("was") - F.col("now")))
    return both.groupBy(run).agg(((F.count_if(F.col("sides") == 2) == len(names)) & (F.coalesce(F.max("loss"), F.lit(float("-inf"))) <= most)).alias("accepted"), F.max("loss").alias("worst"))


def legal_incomplete(df: DataFrame, part: str, order: str, actual: str, expected: str) -> DataFrame:
    """Adds ``legal``: a first and a last bar that make a full one, or a first of at most half a bar before three full ones."""
    rows = Window.partitionBy(part).orderBy(order)
    whole = rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, at = F.count("*").over(Window.partitionBy(part)), F.row_number().over(rows)
    first, last = lambda c: F.first(c).over(whole), lambda c: F.last(c).over(whole)
    fa, fe, la, le = first(actual), first(expected), last(actual), last(expected)
    pair = (n >= 2) & (fe == le) & (fa > 0) & (fa < fe) & (la > 0) & (la < le) & (fa + la == fe)
    full = F.lit(True)
    for k in (1, 2, 3):
        full = full & (F.lead(actual, k).over(rows) == F.col(expected)) & (F.lead(expected, k).over(rows) == F.col(expected))
    pickup = (at == 1) & (n >= 4) & (F.col(expected) > 0) & (F.col(actual) > 0) & (F.col(actual) * 2 <= F.col(expected)) & full
    return df.withColumn("legal", F.coalesce((((at == 1) | (at == n)) & pair) | pickup, F.lit(False)))


def page_ranges(lines: DataFrame, doc: str, order: str, line: str, mark: str = "!!LO:PB:g=original") -> DataFrame:
    """doc, page (from 1), first_measure, last_measure, measures of the numbered bar lines between page marks; pages without any are left out but counted."""
    page = 1 + F.sum((F.col(line) == mark).cast("int")).over(Window.partitionBy(doc).orderBy(order))
    bar = F.regexp_extract(F.split(line, "\t")[0], r"^=+(\d+)", 1)
    bars = lines.select(doc, page.alias("page"), F.nullif(bar, F.lit("")).cast("int").alias("bar")).where("bar is not null")
    return bars.groupBy(doc, "page").agg(F.min("bar").alias("first_measure"), F.max("bar").alias("last_measure"), F.count_distinct("bar").alias("measures"))


def coverage(df: DataFrame, kind: str, confident: Column, emitted: Column, count_only: tuple[str, ...] = ("curved_connector",)) -> DataFrame:
    """Per kind: confident sources, emitted ones, what one side has more of, and the ratio; kinds of ``count_only`` show an excess but no omission."""
    rows = df.groupBy(kind).agg(F.count_if(confident).alias("confident"), F.count_if(emitted).alias("emitted"))
    excess = F.greatest(F.lit(0), F.col("confident") - F.col("emitted"))
    return rows.select(
        kind, "confident", "emitted", excess.alias("excess"), F.when(F.col(kind).isin(*count_only), 0).otherwise(excess).alias("omissions"),
        F.greatest(F.lit(0), F.col("emitted") - F.col("confident")).alias("unmatched"),
        F.when(F.col("confident") > 0, F.least(F.lit(1.0), F.col("emitted") / F.col("confident"))).when(F.col("emitted") == 0, 1.0).otherwise(0.0).alias("ratio"))


def aliases(df: DataFrame, content: str, item: str, labels: list[str], strict: bool = True) -> DataFrame:
    """item, retained, conflict of all rows but the first of each content. Labels that differ within one content are an error, or a flag if not ``strict``. A null content is no alias.

    The first of each content is an aggregate that combines before the shuffle; the join back is one that adaptive execution can split.
    """
    first = df.where(F.col(content).isNotNull()).groupBy(content).agg(F.min_by(F.struct(F.col(item).alias("retained"), F.struct(*labels).alias("kept")), item).alias("f"), F.count("*").alias("n")).where("n > 1")
    rows = df.join(first, content).where(F.col(item) != F.col("f.retained"))
    conflict = ~F.struct(*labels).eqNullSafe(F.col("f.kept"))
    if strict:
        conflict = F.when(conflict, F.raise_error(F.lit("one content has different labels")).cast("boolean")).otherwise(False)
    return rows.select(item, F.col("f.retained").alias("retained"), conflict.alias("conflict"))


def isolated_split(groups: DataFrame, group: str, document: str, seed: str, train: int) -> DataFrame:
    """group, split: the ``train`` groups of smallest hash, and any others that share a document with them, are train, the rest calibration. Rows are groups (works), of which there are far fewer than samples."""
    chosen = stable_sample(groups.select(group, document), F.col(group).cast("string"), seed, train)
    shared = chosen.select(document).distinct().withColumn("split", F.lit("train"))
    named = chosen.select(group, F.lit("train").alias("by_group"))
    rows = groups.select(group, document).join(shared, document, "left").join(named, group, "left")
    return rows.select(group, F.coalesce("split", "by_group", F.lit("calibration")).alias("split"))


def contained(rows: DataFrame, page: str, key: list[str]) -> DataFrame:
    """Rows (page, key, x1, y1, x2, y2, text, sure, likely) of which no wider row of the page holds 86 % and more of the area with the same text in it, or a likely one, at a confidence not 0.18 lower."""
    a, b = rows.alias("a"), rows.alias("b")
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(f"a.{hi}", f"b.{hi}") - F.greatest(f"a.{lo}", f"b.{lo}"))
    area = F.greatest(F.lit(1.0), (F.col("a.x2") - F.col("a.x1")) * (F.col("a.y2") - F.col("a.y1")))
    held = (side("x1", "x2") * side("y1", "y2") / area >= 0.86) & (F.col("b.x2") - F.col("b.x1") > (F.col("a.x2") - F.col("a.x1")) * 1.15)
    text = (F.col("a.text") != "") & (F.col("b.text").contains(F.col("a.text")) | (F.col("b.likely") >= 0.78)) & (F.col("b.sure") >= F.col("a.sure") - 0.18)
    return a.join(b, (F.col(f"a.{page}") == F.col(f"b.{page}")) & held & text, "left_anti").select(page, *key)


def nearest_system(texts: DataFrame, systems: DataFrame, page: str, key: list[str], far: float = 12.0) -> DataFrame:
    """page, key, system, placement, distance of texts (x, y) by systems (at, left, right, spacing, top, bottom) of the page within four spaces sideways; nearest in staff spaces, ties to the smaller ``at``. Beyond ``far`` the system is null; without one in reach all three are."""
    y = F.col("y")
    gap = F.when(y < F.col("top"), F.col("top") - y).when(y > F.col("bottom"), y - F.col("bottom")).otherwise(0.0) / F.greatest(F.col("spacing"), F.lit(1.0))
    place = F.when(y < F.col("top"), "above").when(y > F.col("bottom"), "below").otherwise("within")
    reach = (F.col("x") >= F.col("left") - 4 * F.col("spacing")) & (F.col("x") <= F.col("right") + 4 * F.col("spacing"))
    joined = texts.alias("t").join(systems.withColumnRenamed(page, "of"), (F.col(f"t.{page}") == F.col("of")) & reach, "left")
    best = joined.groupBy(F.col(f"t.{page}").alias(page), *key).agg(F.min(F.when(F.col("of").isNotNull(), F.struct(gap.alias("distance"), F.col("at"), place.alias("placement")))).alias("b"))
    return best.select(page, *key, F.when(F.col("b.distance") <= far, F.col("b.at")).alias("system"), F.col("b.placement").alias("placement"), F.col("b.distance").alias("distance"))


# Classes of detections that may support a kind of candidate.
SUPPORTS = {"crescendo": ["hairpin"], "diminuendo": ["hairpin"], "curved_connector": ["slur", "tie"]}


def corroborated(candidates: DataFrame, detections: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hairpin, slur, tie: the best confidence of a detection of each fitting class on the candidate's page and staff that overlaps it; null without any. Candidates (keys, page, staff, kind, x1, y1, x2, y2, spacing); detections (page, staff, class, confidence, x1, y1, x2, y2) alone give no row."""
    d = detections.select(*[F.col(c).alias(f"d_{c}") for c in ("page", "staff", "class", "confidence", "x1", "y1", "x2", "y2")])
    fits = F.lit(False)
    for kind, classes in SUPPORTS.items():
        fits = fits | ((F.col("kind") == kind) & F.col("d_class").isin(*classes))
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(hi, f"d_{hi}") - F.greatest(lo, f"d_{lo}"))
    size = lambda p: F.greatest(F.lit(1), (F.col(p + "x2") - F.col(p + "x1")) * (F.col(p + "y2") - F.col(p + "y1")))
    near = (
        (side("x1", "x2") * side("y1", "y2") / F.least(size(""), size("d_")) >= 0.30)
        & (side("x1", "x2") / F.greatest(F.lit(1), F.col("x2") - F.col("x1")) >= 0.55)
        & (F.abs(F.col("y1") + F.col("y2") - F.col("d_y1") - F.col("d_y2")) / 2 <= 1.75 * F.greatest(F.lit(1.0), F.coalesce("spacing", F.lit(12.0))))
    )
    joined = candidates.join(d, (F.col("page") == F.col("d_page")) & (F.col("staff") == F.col("d_staff")) & fits & near, "left")
    return joined.groupBy(*keys).agg(*[F.max(F.when(F.col("d_class") == c, F.col("d_confidence"))).alias(c) for c in ("hairpin", "slur", "tie")])


def paired_parts(parts: DataFrame, score: str) -> DataFrame:
    """score, reference, candidate from parts (score, side r or c, at, id, name): each reference part in order takes the one free candidate of its name, else of its id, else that at its place; null where none is left. A null or empty name or id matches nothing. A fold over the parts of a score, which are few."""
    kinds = dict(parts.dtypes)
    at = kinds["at"]
    row = F.struct("at", F.coalesce(F.col("name").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"))
    sides = parts.groupBy(score).agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == s, row))).alias(s) for s in "rc"])

    def step(state: Column, r: Column) -> Column:
        by_name = F.filter(state["free"], lambda c: (r["name"] != "") & (c["name"] == r["name"]))
        by_id = F.filter(state["free"], lambda c: (r["id"] != "") & (c["id"] == r["id"]))
        by_place = F.filter(state["free"], lambda c: c["at"] == r["at"])
        took = F.when(F.size(by_name) == 1, F.get(by_name, F.lit(0))["at"]).when(F.size(by_id) == 1, F.get(by_id, F.lit(0))["at"]).when(F.size(by_place) == 1, F.get(by_place, F.lit(0))["at"])
        free = F.filter(state["free"], lambda c: ~c["at"].eqNullSafe(took))
        return F.struct(free.alias("free"), F.concat(state["pairs"], F.array(F.struct(r["at"].alias("reference"), took.alias("candidate")))).alias("pairs"))

    start = F.struct(F.col("c").alias("free"), F.array().cast(f"array<struct<reference:{at},candidate:{at}>>").alias("pairs"))
    left = lambda s: F.transform(s["free"], lambda c: F.struct(F.lit(None).cast(at).alias("reference"), c["at"].alias("candidate")))
    done = F.aggregate("r", start, step, lambda s: F.concat(s["pairs"], left(s)))
    return sides.select(score, F.inline(done))


def chosen_recogniser(df: DataFrame, run: str, hard: str = "scan_hard") -> DataFrame:
    """run, regressions, cer_gain, hard_gain, selected from rows of run, profile, family, small_exact, medium_exact, small_cer, medium_cer: medium if no family loses more than 0.005 and it gains 0.0005 of error rate or 0.005 exact on the hard profile (the last by name where ``hard`` is missing)."""
    overall = F.col("family") == "overall"
    gain = F.col("medium_exact") - F.col("small_exact")
    last = F.max_by(F.when(overall, gain), F.when(overall, F.struct((F.col("profile") == hard).alias("is"), "profile")))
    rows = df.groupBy(run).agg(
        F.count_if(F.col("medium_exact") + 0.005 < F.col("small_exact")).alias("regressions"),
        (F.avg(F.when(overall, F.col("small_cer"))) - F.avg(F.when(overall, F.col("medium_cer")))).alias("cer_gain"), last.alias("hard_gain"))
    better = (F.col("regressions") == 0) & ((F.col("cer_gain") >= 0.0005) | (F.col("hard_gain") >= 0.005))
    return rows.withColumn("selected", F.when(better, "medium").otherwise("small"))
