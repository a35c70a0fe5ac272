"""Audits, gates by family, parts and pages on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import rules as R
from lattica.functions.scalars import keyed
from lattica.operators import audits as A
from lattica.operators import selection as P
from lattica.plans.queries import query


def _x(sql: str):
    return F.expr(sql)


# Notes: an event each, in the measure of its user.
_NOTE = {
    "step": "substr('CDEFGAB', 1 + {e} % 7, 1)", "octave": "3 + {e} % 2", "alter": "CAST({e} / 14 AS INT) % 3 - 1", "fifths": "user_id % 15 - 7",
    "accidental": "CASE {e} % 11 WHEN 0 THEN 'Sharp' WHEN 1 THEN 'double_flat' WHEN 2 THEN ' flat  flat ' WHEN 3 THEN 'quarter-up' WHEN 4 THEN '' END",
    "continues": "{e} % 5 = 0", "rest": "{e} % 13 = 0", "grace": "{e} % 17 = 0",
}


def _notes(t, shift: int = 0):
    columns = {k: _x(v.format(e=f"(event_id + {shift})").replace("CAST((event_id + %d) / 14 AS INT)" % shift, f"((event_id + {shift}) div 14)")) for k, v in _NOTE.items()}
    return t("events").select("user_id", F.col("event_id").alias("idx"), *[c.cast("int").alias(k) if k in ("octave", "alter", "fifths") else c.alias(k) for k, c in columns.items()])


def _notes_sql(shift: int = 0) -> str:
    parts = ", ".join(f"{v.format(e=f'(event_id + {shift})').replace('CAST((event_id + %d) / 14 AS INT)' % shift, f'((event_id + {shift}) // 14)')} AS {k}" for k, v in _NOTE.items())
    return f"""n0 AS (SELECT user_id, event_id AS idx, {parts} FROM events),
n AS (SELECT *, strpos('FCGDAEB', step) - 1 AS k, CASE WHEN fifths > strpos('FCGDAEB', step) - 1 THEN 1 WHEN -fifths > 7 - strpos('FCGDAEB', step) THEN -1 ELSE 0 END AS in_key,
  CASE trim(coalesce(accidental, '')) WHEN 'Sharp' THEN 1 WHEN 'double_flat' THEN -2 WHEN 'flat  flat' THEN -2 END AS sign, trim(coalesce(accidental, '')) <> '' AS has FROM n0 WHERE NOT rest AND NOT grace)"""


def _issues_sql(shift: int = 0) -> str:
    return f"""WITH {_notes_sql(shift)},
s AS (SELECT *, coalesce(last_value(CASE WHEN sign IS NOT NULL OR (NOT has AND continues) THEN alter END IGNORE NULLS) OVER (PARTITION BY user_id, step, octave ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), in_key) AS expected FROM n)
SELECT * FROM (SELECT user_id, idx, CASE WHEN has AND sign IS NULL THEN 'unsupported_accidental' WHEN has AND sign <> alter THEN 'explicit_alter_mismatch' WHEN NOT has AND NOT continues AND alter <> expected THEN 'implicit_alter_state_mismatch' END AS code, step, octave FROM s) WHERE code IS NOT NULL"""


@query("FLT23_accidental_issues", _issues_sql())
def accidental_issues(t):
    return A.accidental_issues(_notes(t), "user_id")


@query("FLT24_accidental_regression", f"WITH b AS ({_issues_sql()}), a AS ({_issues_sql(3)}) SELECT *, 'introduced' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'resolved' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def accidental_regression(t):
    return A.accidental_changes(A.accidental_issues(_notes(t), "user_id"), A.accidental_issues(_notes(t, 3), "user_id"), "user_id")


@query("WIN6_accidental_markers", f"WITH {_notes_sql()} SELECT user_id, idx, step, octave, alter FROM (SELECT *, coalesce(lag(alter) OVER (PARTITION BY user_id, step, octave ORDER BY idx), in_key) AS expected FROM n) WHERE has OR (NOT continues AND alter <> expected)")
def accidental_markers(t):
    return A.accidental_markers(_notes(t), "user_id")


_AUDIT = """WITH m AS (SELECT c_nationkey AS score, c_custkey AS measure FROM customer),
r AS (SELECT user_id AS measure, event_id AS idx, event_type AS voice, event_id % 4 AS onset, event_id % 9 AS duration, CASE event_id % 3 WHEN 0 THEN NULL ELSE event_id % 9 + event_id % 2 END AS expected, event_id % 150 * 100 AS cents, event_id % 3 = 1 AS chord FROM events WHERE event_id % 10 <> 0),
h AS (SELECT *, last_value(CASE WHEN NOT chord THEN duration END IGNORE NULLS) OVER (PARTITION BY measure, onset ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS main FROM r),
c AS (SELECT measure, count(*) AS density, count(DISTINCT voice) AS voices, count(*) FILTER (duration <= 0) AS zero, count(*) FILTER (duration > 0 AND expected IS NOT NULL AND greatest(duration, expected) / least(duration, expected) > 1.08) AS types, count(*) FILTER (NOT cents BETWEEN 1200 AND 12000) AS pitches, count(*) FILTER (chord AND main <> duration) AS chords FROM h GROUP BY 1),
d AS (SELECT measure, max(n) AS repeats FROM (SELECT o_custkey AS measure, o_orderpriority || o_orderstatus AS key, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT m.*, coalesce(density, 0) AS density, voices, zero, types, pitches, chords, repeats FROM m LEFT JOIN c USING (measure) LEFT JOIN d USING (measure)),
u AS (SELECT score, list_sort(list(density))[len(list(density)) // 2 + 1] AS median FROM a WHERE density > 0 GROUP BY 1),
f AS (SELECT score, measure, 'multiple_voices' AS code, (voices > 1)::BIGINT AS n FROM a UNION ALL SELECT score, measure, 'empty_measure', (density = 0)::BIGINT FROM a UNION ALL SELECT score, measure, 'zero_duration', zero FROM a UNION ALL SELECT score, measure, 'type_duration_mismatch', types FROM a
  UNION ALL SELECT score, measure, 'pitch_outlier', pitches FROM a UNION ALL SELECT score, measure, 'chord_duration_mismatch', chords FROM a UNION ALL SELECT a.score, measure, 'density_outlier', (density > greatest(4, median))::BIGINT FROM a LEFT JOIN u USING (score) UNION ALL SELECT score, measure, 'duplicate_direction', (repeats > 1)::BIGINT FROM a)"""


@query("FLT1_note_audit", f"{_AUDIT} SELECT score, measure, code, n FROM f WHERE n > 0")
def note_audit(t):
    measures = t("customer").select(F.col("c_nationkey").alias("score"), F.col("c_custkey").alias("measure"))
    e = "event_id"
    notes = t("events").select(
        F.col("user_id").alias("measure"), F.col(e).alias("idx"), F.col("event_type").alias("voice"), _x(f"{e} % 10 = 0").alias("grace"), _x(f"{e} % 3 = 1").alias("chord"), _x(f"{e} % 4").alias("onset"),
        _x(f"{e} % 9").alias("duration"), _x(f"CASE {e} % 3 WHEN 0 THEN NULL ELSE {e} % 9 + {e} % 2 END").alias("expected"), _x(f"{e} % 150 * 100").alias("cents"))
    directions = t("orders").select(F.col("o_custkey").alias("measure"), F.concat("o_orderpriority", "o_orderstatus").alias("key"))
    return A.note_audit(measures, notes, directions, floor=4, factor=1)


@query("AGG34_issue_histogram", f"{_AUDIT} SELECT code, CAST(sum(n) AS BIGINT) AS issues, count(*) AS measures FROM f WHERE n > 0 GROUP BY 1")
def issue_histogram(t):
    return note_audit(t).groupBy("code").agg(F.sum("n").alias("issues"), F.count("*").alias("measures"))


_CODES = "CASE l_partkey % 9 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(A.ISSUES)) + " ELSE 'other' END"


@query("FLT22_patch_guard", f"""WITH c AS (SELECT l_orderkey, {_CODES} AS code, sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END) AS change FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_orderkey, string_agg(code, '+' ORDER BY code) FILTER (change > 0 AND code <> 'other') AS codes FROM c GROUP BY 1) SELECT l_orderkey, codes IS NULL AS accepted, coalesce('introduced_' || codes, 'validated') AS reason FROM g""")
def patch_guard(t):
    return A.introduced_issues(t("lineitem").select("l_orderkey", _x(_CODES).alias("code"), _x("l_linenumber % 2 = 0").alias("after")), "l_orderkey")


@query("FLT13_family_gate", """WITH f AS (SELECT l_orderkey, l_returnflag, sum(l_quantity) FILTER (l_linenumber % 2 = 1 AND l_quantity > 5) AS tokens, max(l_discount) FILTER (l_linenumber % 2 = 1) AS was, max(l_discount) FILTER (l_linenumber % 2 = 0) AS now FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, count(*) FILTER (was IS NOT NULL AND now IS NOT NULL) = 3 AND coalesce(max(CASE WHEN tokens > 0 THEN was - now END), -1) <= 0.02 AS accepted, round(max(CASE WHEN tokens > 0 THEN was - now END), 9) AS worst FROM f GROUP BY 1""")
def family_gate(t):
    rows = t("lineitem").groupBy("l_orderkey", "l_returnflag", F.when(F.col("l_linenumber") % 2 == 1, "baseline").otherwise("candidate").alias("side"))
    rows = rows.agg(F.sum(F.when(F.col("l_quantity") > 5, F.col("l_quantity"))).alias("tokens"), F.max("l_discount").alias("f1"))
    return A.family_gate(rows, "l_orderkey", "l_returnflag", ["A", "N", "R"], 0.02).withColumn("worst", F.round("worst", 9))


@query("FLT14_floor_failures", """SELECT p_partkey, concat_ws(';', CASE WHEN p_size / 50 < 0.5 THEN printf('map_50=%.6f<0.500000', p_size / 50) END, CASE WHEN p_size % 8 / 8 < 0.25 THEN printf('map_75=%.6f<0.250000', p_size % 8 / 8) END,
  CASE WHEN coalesce(CASE WHEN p_size % 5 > 0 THEN p_size % 4 / 4 END, -1) < 0.3 THEN printf('class:slur=%.6f<0.300000', coalesce(CASE WHEN p_size % 5 > 0 THEN p_size % 4 / 4 END, -1.0)) END, 'class:tie=-1.000000<0.100000') AS failures FROM part""")
def floor_failures(t):
    n = F.col("p_size")
    classes = F.create_map(F.lit("slur"), F.when(n % 5 > 0, n % 4 / 4))
    return t("part").select("p_partkey", F.array_join(R.floor_failures({"map_50": (n / 50, 0.5), "map_75": (n % 8 / 8, 0.25)}, classes, {"tie": 0.1, "slur": 0.3}), ";").alias("failures"))


_EVIDENCE = {
    "eligible_families": "3 + l_linenumber % 2", "exact_families": "2 + l_partkey % 4", "semantic_families": "2 + l_partkey % 4", "strict_majority": "l_suppkey % 4 > 0", "page_valid": "l_suppkey % 5 > 0",
    "exact_support": "l_quantity / 50", "semantic_support": "l_quantity / 50", "missing": "l_tax", "cluster_distance": "l_discount", "medoid_distance": "l_partkey % 2", "ensemble": "l_discount - 0.02", "measure": "l_discount - 0.01",
    "event": "l_discount - 0.06", "context": "l_tax - 0.12", "visual": "l_tax - 0.11", "page_score": "l_suppkey % 50 - 30",
}


def _evidence(t, kind: str):
    e = F.struct(F.lit(kind).alias("kind"), *[_x(v).alias(k) for k, v in _EVIDENCE.items()])
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", e.alias("e"))


_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_HEARD = "least(3 + l_linenumber % 2, 2 + l_partkey % 4) >= 3 AND least(3 + l_linenumber % 2, 2 + l_partkey % 4) / (3 + l_linenumber % 2) >= 2 / 3"


@query("FLT20_exact_majority", f"""SELECT {_KEYS}, {_HEARD} AND l_suppkey % 4 > 0 AND l_suppkey % 5 > 0 AND l_quantity / 50 >= 2 / 3 AND l_tax <= 0.05 AND l_discount - 0.02 >= 0 AND l_discount - 0.01 >= 0 AND l_discount - 0.06 >= -0.05
  AND (l_tax - 0.11 >= -0.10)::INT + (l_discount - 0.06 >= -0.10)::INT + (l_tax - 0.12 >= -0.10)::INT >= 2 AS holds FROM lineitem""")
def exact_majority(t):
    return _evidence(t, "exact_majority").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.exact_majority_holds(F.col("e")).alias("holds"))


@query("FLT21_semantic_consensus", f"""SELECT {_KEYS}, {_HEARD} AND l_suppkey % 5 > 0 AND l_quantity / 50 >= 0.84 AND l_tax <= 0.10 AND l_discount <= 0.045 AND l_partkey % 2 <= 1e-9 AND l_discount - 0.02 >= 0 AND l_discount - 0.01 >= 0 AND l_discount - 0.06 >= -0.05
  AND l_tax - 0.12 >= -0.10 AND (l_suppkey % 50 - 30 >= -17 OR l_tax - 0.11 >= -0.035) AS holds FROM lineitem""")
def semantic_consensus(t):
    return _evidence(t, "semantic_consensus").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.semantic_consensus_holds(F.col("e")).alias("holds"))


@query("FLT7_rejections", """WITH r AS (SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN ['missing_row'] ELSE list_filter([CASE WHEN o_orderstatus = 'P' THEN 'license_conflict' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'public_domain_inconsistent' END,
  CASE WHEN o_orderkey % 7 = 0 THEN 'lyrics_present' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'out_of_boundary' END], lambda x: x IS NOT NULL) END AS reasons FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey)
SELECT reason, count(*) AS rejected FROM (SELECT unnest(CASE WHEN len(reasons) = 0 THEN ['accepted'] ELSE reasons END) AS reason FROM r) GROUP BY 1""")
def rejections(t):
    known = t("customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    rows = t("orders").join(known, F.col("c_custkey") == F.col("o_custkey"), "left")
    here = F.col("c_custkey").isNotNull()
    rules = {"missing_row": ~here, "license_conflict": here & (F.col("o_orderstatus") == "P"), "public_domain_inconsistent": here & ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "lyrics_present": here & (F.col("o_orderkey") % 7 == 0), "out_of_boundary": here & F.col("o_orderpriority").startswith("5")}
    reasons = P.rejection_reasons(rows, rules).select(F.when(F.size("reasons") == 0, F.array(F.lit("accepted"))).otherwise(F.col("reasons")).alias("reasons"))
    return reasons.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("rejected"))


@query("AGG23_count_evidence", """WITH r AS (SELECT l_orderkey, l_returnflag AS family, l_linenumber % 4 AS n, l_discount + 0.1 AS q, l_linestatus = 'O' OR l_tax > 0.03 AS valid FROM lineitem WHERE l_linenumber % 4 > 0),
c AS (SELECT l_orderkey, family, n, max(q) AS best, sum(q) AS support, count(*) AS members, count(*) FILTER (valid) AS ok FROM r GROUP BY 1, 2, 3),
w AS (SELECT l_orderkey, family, min((members = ok)::INT) AS whole, sum(best) AS total FROM c GROUP BY 1, 2), p AS (SELECT l_orderkey, greatest(1, sum(whole)) AS asked FROM w GROUP BY 1),
s AS (SELECT l_orderkey, n, stddev_pop(q) AS quality_std FROM r GROUP BY 1, 2)
SELECT l_orderkey, n, round(sum(support), 9) AS support, round(sum(best / total * whole) / max(asked), 9) AS balanced_support, round(sum(ok) / sum(members), 9) AS valid_share, round(sum(whole) / max(asked), 9) AS family_share, CAST(sum(whole) AS BIGINT) AS families,
  CAST(sum(members) AS BIGINT) AS candidates, round(max(quality_std), 5) AS quality_std, round(greatest(0.0, 1 - sum(whole) / sum(members)), 9) AS duplicate_ratio FROM c JOIN w USING (l_orderkey, family) JOIN p USING (l_orderkey) JOIN s USING (l_orderkey, n) GROUP BY 1, 2""")
def count_evidence(t):
    rows = t("lineitem").select("l_orderkey", F.col("l_returnflag").alias("family"), _x("l_linenumber % 4").alias("n"), _x("l_discount + 0.1").alias("q"), _x("l_linestatus = 'O' OR l_tax > 0.03").alias("valid"))
    got = A.count_evidence(rows, "l_orderkey", "family", "n", "q", "valid")
    return got.withColumns({c: F.round(c, 5 if c == "quality_std" else 9) for c in ("support", "balanced_support", "valid_share", "family_share", "quality_std", "duplicate_ratio")})


@query("AGG26_committed_families", "SELECT l_orderkey, count(*) FILTER (whole) AS families FROM (SELECT l_orderkey, l_returnflag, bool_and(l_discount < 0.08) AND count(*) = CASE WHEN l_returnflag = 'N' THEN 2 ELSE 1 END AS whole FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def committed_families(t):
    return A.committed_families(t("lineitem"), "l_orderkey", "l_returnflag", _x("l_discount < 0.08"), _x("CASE WHEN l_returnflag = 'N' THEN 2 ELSE 1 END"))


@query("AGG37_voice_topology", "SELECT l_orderkey, string_agg(staff || ':' || l_linestatus || ':' || n, ',' ORDER BY staff, l_linestatus) AS topology FROM (SELECT l_orderkey, greatest(1, l_linenumber % 3) AS staff, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1")
def voice_topology(t):
    return A.voice_topology(t("lineitem"), "l_orderkey", _x("l_linenumber % 3"), F.col("l_linestatus"))


@query("AGG43_objects_by_class", "SELECT label, count(*) AS objects FROM (SELECT DISTINCT l_suppkey, l_partkey, l_partkey % 10 AS label FROM lineitem) GROUP BY 1")
def objects_by_class(t):
    return A.objects_by_class(t("lineitem").select("l_suppkey", "l_partkey", _x("l_partkey % 10").alias("label")), ["l_suppkey"], "l_partkey", "label")


@query("AGG47_overlap_summary", "SELECT l_returnflag, count(v) AS objects, min(v) AS minimum, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.9) AS p90, round(avg(v), 9) AS mean, " + ", ".join(f"avg((v >= {f / 100})::INT) AS at_least_{f}" for f in (25, 35, 40, 50, 70)) + " FROM (SELECT l_returnflag, l_quantity / 64 AS v FROM lineitem) GROUP BY 1")
def overlap_summary(t):
    return A.overlap_summary(t("lineitem").select("l_returnflag", _x("l_quantity / 64").alias("v")), ["l_returnflag"], "v").withColumn("mean", F.round("mean", 9))


_BAR = "CASE WHEN event_id % 6 IN (0, 5) OR event_id % 11 = 0 THEN event_id % 5 ELSE 4 END"


@query("WIN4_legal_incomplete", f"""WITH e AS (SELECT event_id // 6 AS part, event_id FROM events), r AS (SELECT part, event_id, {_BAR} AS a, row_number() OVER w AS k, count(*) OVER (PARTITION BY part) AS n, first_value({_BAR}) OVER w AS fa, last_value({_BAR}) OVER (PARTITION BY part ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS la,
  lead({_BAR}, 1) OVER w AS a1, lead({_BAR}, 2) OVER w AS a2, lead({_BAR}, 3) OVER w AS a3 FROM e WINDOW w AS (PARTITION BY part ORDER BY event_id))
SELECT part, event_id, coalesce((k IN (1, n) AND n >= 2 AND fa > 0 AND fa < 4 AND la > 0 AND la < 4 AND fa + la = 4) OR (k = 1 AND n >= 4 AND a > 0 AND 2 * a <= 4 AND a1 = 4 AND a2 = 4 AND a3 = 4), false) AS legal FROM r""")
def legal_incomplete(t):
    rows = t("events").select(_x("event_id div 6").alias("part"), "event_id", _x(_BAR).alias("actual"), F.lit(4).alias("expected"))
    return A.legal_incomplete(rows, "part", "event_id", "actual", "expected").select("part", "event_id", "legal")


_LINE = "CASE WHEN event_id % 6 = 0 THEN '!!LO:PB:g=original' WHEN event_id % 3 = 1 THEN concat('=', event_id % 40, '{tab}', '=99') WHEN event_id % 5 = 0 THEN '==' ELSE '4c' END"


@query("WIN15_page_ranges", f"""WITH l AS (SELECT user_id, event_id, {_LINE.replace("'{tab}'", "chr(9)")} AS line FROM events), p AS (SELECT user_id, line, 1 + sum((line = '!!LO:PB:g=original')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS page FROM l),
b AS (SELECT user_id, page, try_cast(regexp_extract(split_part(line, chr(9), 1), '^=+([0-9]+)', 1) AS INT) AS bar FROM p) SELECT user_id, CAST(page AS BIGINT) AS page, min(bar) AS first_measure, max(bar) AS last_measure, count(DISTINCT bar) AS measures FROM b WHERE bar IS NOT NULL GROUP BY 1, 2""")
def page_ranges(t):
    return A.page_ranges(t("events").select("user_id", "event_id", _x(_LINE.replace("'{tab}'", "char(9)")).alias("line")), "user_id", "event_id", "line")


@query("TOP7_group_balanced", "WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('s:' || o_custkey || chr(0) || o_orderkey)) AS turn FROM orders) SELECT o_orderkey, o_custkey, turn FROM r ORDER BY turn, sha256('s' || chr(0) || o_custkey) LIMIT 200")
def group_balanced(t):
    rows = t("orders").select("o_orderkey", "o_custkey")
    rank = F.sha2(keyed(F.concat(F.lit("s:"), F.col("o_custkey").cast("string")), F.col("o_orderkey")), 256)
    return P.round_robin(rows, "o_custkey", [rank], 200, seed="s")


_TOKENS = "concat_ws(' ', repeat('tie:start ', p_size % 11), CASE WHEN p_size % 3 = 0 THEN 'staccato' END, repeat('beam:begin ', p_size % 13), CASE WHEN p_size % 4 = 0 THEN 'slur:start trill-mark' END, 'wavy-line:start', 'quarter')"


@query("TOP8_family_priority", """WITH c AS (SELECT p_partkey, p_brand, p_size % 11 AS tie, (p_size % 4 = 0)::INT AS slur, 1 + (p_size % 4 = 0)::INT AS ornament, (p_size % 3 = 0)::INT AS articulation, p_size % 13 AS beam FROM part),
r AS (SELECT p_partkey, p_brand, 8.0 * least(tie, 8) + 6 * slur + 6 * ornament + 4 * articulation + least(beam, 8) + 0.25 * ((tie > 0)::INT + slur + 1 + articulation + (beam > 0)::INT) AS priority FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY priority DESC, sha256('f:' || p_brand || chr(0) || p_partkey)) AS turn FROM r) SELECT p_partkey, p_brand, CAST(priority AS DOUBLE) AS priority, turn FROM k ORDER BY turn, sha256('f' || chr(0) || p_brand) LIMIT 60""")
def family_priority(t):
    rows = t("part").select("p_partkey", "p_brand", R.family_priority(_x(_TOKENS)).alias("priority"))
    rank = F.sha2(keyed(F.concat(F.lit("f:"), F.col("p_brand")), F.col("p_partkey")), 256)
    return P.round_robin(rows, "p_brand", [F.desc("priority"), rank], 60, seed="f")


@query("TOP13_parity_row", """WITH o AS (SELECT l_orderkey, CASE WHEN l_partkey % 5 = 0 THEN 'slur' WHEN l_partkey % 5 = 1 THEN 'tie' ELSE l_returnflag END AS class FROM lineitem),
k AS (SELECT l_orderkey, count(DISTINCT class) FILTER (class IN ('slur', 'tie')) AS geometry, count(DISTINCT class) AS classes, count(*) AS objects FROM o GROUP BY 1) SELECT l_orderkey, geometry, classes, objects FROM k ORDER BY geometry DESC, classes - geometry DESC, classes DESC, objects DESC, sha256(CAST(l_orderkey AS VARCHAR)) LIMIT 1""")
def parity_row(t):
    rows = t("lineitem").select("l_orderkey", _x("CASE WHEN l_partkey % 5 = 0 THEN 'slur' WHEN l_partkey % 5 = 1 THEN 'tie' ELSE l_returnflag END").alias("class"))
    pages = rows.groupBy("l_orderkey").agg(F.count_distinct(F.when(F.col("class").isin("hairpin", "slur", "tie"), F.col("class"))).alias("geometry"), F.count_distinct("class").alias("classes"), F.count("*").alias("objects"))
    rank = F.struct(-F.col("geometry"), F.col("geometry") - F.col("classes"), -F.col("classes"), -F.col("objects"), F.sha2(F.col("l_orderkey").cast("string"), 256))
    return pages.agg(F.min_by(F.struct("l_orderkey", "geometry", "classes", "objects"), rank).alias("best")).select("best.*")


_NOTE_TEXT = "concat('P. 3, p. [', p_size, ']-', p_size * 3, ' str. 7 s.', p_size % 9, ' k [', p_partkey % 250, ' , ', p_size + 2, '] 1850')"


@query("STR20_page_extent", f"""WITH x AS (SELECT p_partkey, {_NOTE_TEXT} AS s FROM part), y AS (SELECT p_partkey, list_concat(list_concat(regexp_extract_all(s, '\\b(?:p|s|k)\\.?\\s*\\[?(\\d{{1,3}})\\]?(?:\\s*[-–—]\\s*\\[?(\\d{{1,3}})\\]?)?', 1), regexp_extract_all(s, '\\b(?:p|s|k)\\.?\\s*\\[?(\\d{{1,3}})\\]?(?:\\s*[-–—]\\s*\\[?(\\d{{1,3}})\\]?)?', 2)),
  list_concat(regexp_extract_all(s, '\\b(?:p|s|k)\\.?\\s*\\[\\s*(\\d{{1,3}})\\s*,\\s*(\\d{{1,3}})', 1), regexp_extract_all(s, '\\b(?:p|s|k)\\.?\\s*\\[\\s*(\\d{{1,3}})\\s*,\\s*(\\d{{1,3}})', 2))) AS found FROM x)
SELECT p_partkey, coalesce(list_max(list_filter(list_transform(found, lambda v: try_cast(v AS INT)), lambda n: n > 0 AND n <= 200)), 0) AS pages FROM y""")
def page_extent(t):
    return t("part").select("p_partkey", R.page_extent(_x(_NOTE_TEXT)).alias("pages"))


_CENTS = "CAST(l_quantity AS INT) * 100 + l_partkey % 2 * 50"


@query("MTH9_key_ratio", f"""WITH n AS (SELECT l_orderkey, l_orderkey % 2 = 1 AS minor, CASE WHEN l_linestatus = 'O' THEN (((CAST(floor(({_CENTS}) / 100) AS BIGINT) - (7 * (l_orderkey % 15 - 7) - 3 * (l_orderkey % 2))) % 12) + 12) % 12 END AS d FROM lineitem)
SELECT l_orderkey, round(coalesce(avg(CASE WHEN d IS NULL THEN NULL WHEN minor THEN (d IN (0, 2, 3, 5, 7, 8, 10))::INT ELSE (d IN (0, 2, 4, 5, 7, 9, 11))::INT END), 1.0), 9) AS ratio FROM n GROUP BY 1""")
def key_ratio(t):
    fits = R.in_key(_x(f"CASE WHEN l_linestatus = 'O' THEN {_CENTS} END"), _x("l_orderkey % 15 - 7"), _x("l_orderkey % 2 = 1"))
    return t("lineitem").groupBy("l_orderkey").agg(F.round(F.coalesce(F.avg(fits), F.lit(1.0)), 9).alias("ratio"))


_LOG = "concat('== 3 passed in 1.0s ==', '{nl}', 'SKIPPED [1] a.py', '{nl}', CASE WHEN p_size % 3 = 0 THEN concat(p_size % 4, ' failed, ') ELSE '' END, p_size, ' passed, ', p_size % 7, ' Skipped, 1 warning, ', p_size % 2, ' errors in ', p_size % 9, '.25s')"


@query("SRC24_test_log", "SELECT p_partkey, p_size AS passed, CASE WHEN p_size % 3 = 0 THEN p_size % 4 ELSE 0 END AS failed, p_size % 7 AS skipped, 1 AS warnings, p_size % 2 AS errors, p_size + CASE WHEN p_size % 3 = 0 THEN p_size % 4 ELSE 0 END + p_size % 7 + p_size % 2 AS total, 1 AS skipped_lines FROM part")
def log_totals(t):
    return t("part").select("p_partkey", R.log_totals(_x(_LOG.replace("'{nl}'", "char(10)"))).alias("x")).select("p_partkey", "x.*")


_METRICS = "concat('metric: precision: 0.', p_size, ', my_recall: 0.9, ''recall'': ', p_size / 64, ' hmean=1e400 hmean = ', CASE WHEN p_size % 5 = 0 THEN '1.5' ELSE '5e-1' END)"


@query("SRC25_metric_log", "SELECT p_partkey, CAST('0.' || p_size AS DOUBLE) AS precision, p_size / 64 AS recall, 0.5 AS hmean FROM part WHERE p_size % 5 <> 0")
def metric_log(t):
    return t("part").select("p_partkey", R.metric_log(_x(_METRICS)).alias("x")).where("x is not null").select("p_partkey", "x.*")


@query("JON16_nearest_system", """WITH x AS (SELECT DISTINCT l_orderkey, l_partkey, l_quantity * 10 + 100 AS x, l_suppkey * 10.0 AS y FROM lineitem WHERE l_linenumber % 2 = 0),
s AS (SELECT l_orderkey AS o, l_partkey AS i, l_quantity * 10 AS l, l_quantity * 10 + 300 AS r, l_linenumber AS sp, l_suppkey * 8.0 AS top, l_suppkey * 8.0 + 40 AS bottom FROM lineitem WHERE l_linenumber % 2 = 1),
d AS (SELECT l_orderkey, l_partkey, x, y, i, CASE WHEN y < top THEN top - y WHEN y > bottom THEN y - bottom ELSE 0 END / greatest(sp, 1) AS distance, CASE WHEN y < top THEN 'above' WHEN y > bottom THEN 'below' WHEN o IS NOT NULL THEN 'within' END AS placement, o FROM x LEFT JOIN s ON o = l_orderkey AND x >= l - 4 * sp AND x <= r + 4 * sp)
SELECT l_orderkey, l_partkey, x, y, CASE WHEN distance <= 12 THEN i END AS system, placement, round(CASE WHEN o IS NOT NULL THEN distance END, 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey, x, y ORDER BY distance, i, placement) AS k FROM d) WHERE k = 1""")
def nearest_system(t):
    rows = t("lineitem")
    texts = rows.where("l_linenumber % 2 = 0").select("l_orderkey", "l_partkey", _x("l_quantity * 10 + 100").alias("x"), _x("l_suppkey * 10D").alias("y"))
    systems = rows.where("l_linenumber % 2 = 1").select("l_orderkey", F.col("l_partkey").alias("at"), _x("l_quantity * 10").alias("left"), _x("l_quantity * 10 + 300").alias("right"), F.col("l_linenumber").alias("spacing"), _x("l_suppkey * 8D").alias("top"), _x("l_suppkey * 8D + 40").alias("bottom"))
    return A.nearest_system(texts, systems, "l_orderkey", ["l_partkey", "x", "y"]).withColumn("distance", F.round("distance", 9))


_BOX = {"x1": "CAST(l_quantity AS INT)", "y1": "CAST(l_suppkey % 20 AS INT)", "x2": "CAST(l_quantity + 20 + l_partkey % 30 AS INT)", "y2": "CAST(l_suppkey % 20 + 15 + l_partkey % 7 AS INT)"}
_BOXES = ", ".join(f"{v} AS {k}" for k, v in _BOX.items())


@query("JON17_corroborated", f"""WITH c AS (SELECT DISTINCT l_orderkey, l_partkey, CASE l_returnflag WHEN 'A' THEN 'crescendo' WHEN 'R' THEN 'diminuendo' ELSE 'curved_connector' END AS kind, {_BOXES} FROM lineitem WHERE l_linenumber % 2 = 1),
d AS (SELECT l_orderkey AS o, CASE WHEN l_linestatus = 'F' THEN 'hairpin' WHEN l_partkey % 2 = 0 THEN 'slur' ELSE 'tie' END AS class, l_discount AS conf, {', '.join(f'{v} AS d{k}' for k, v in _BOX.items())} FROM lineitem WHERE l_linenumber % 2 = 0),
j AS (SELECT c.*, CASE WHEN (class = 'hairpin') = (kind <> 'curved_connector') AND greatest(0, least(x2, dx2) - greatest(x1, dx1)) * greatest(0, least(y2, dy2) - greatest(y1, dy1)) / least((x2 - x1) * (y2 - y1), (dx2 - dx1) * (dy2 - dy1)) >= 0.30 AND greatest(0, least(x2, dx2) - greatest(x1, dx1)) / (x2 - x1) >= 0.55 AND abs(y1 + y2 - dy1 - dy2) / 2 <= 10.5 THEN class END AS class, conf FROM c LEFT JOIN d ON o = l_orderkey)
SELECT l_orderkey, l_partkey, kind, x1, y1, x2, y2, max(conf) FILTER (class = 'hairpin') AS hairpin, max(conf) FILTER (class = 'slur') AS slur, max(conf) FILTER (class = 'tie') AS tie FROM j GROUP BY ALL""")
def corroborated(t):
    boxes = [_x(v).alias(k) for k, v in _BOX.items()]
    rows = t("lineitem").withColumns({"page": F.col("l_orderkey"), "staff": F.lit(1), "spacing": F.lit(6.0)})
    candidates = rows.where("l_linenumber % 2 = 1").select("l_orderkey", "l_partkey", "page", "staff", "spacing", _x("CASE l_returnflag WHEN 'A' THEN 'crescendo' WHEN 'R' THEN 'diminuendo' ELSE 'curved_connector' END").alias("kind"), *boxes)
    detections = rows.where("l_linenumber % 2 = 0").select("page", "staff", _x("CASE WHEN l_linestatus = 'F' THEN 'hairpin' WHEN l_partkey % 2 = 0 THEN 'slur' ELSE 'tie' END").alias("class"), F.col("l_discount").alias("confidence"), *boxes)
    return A.corroborated(candidates, detections, ["l_orderkey", "l_partkey", "kind", *_BOX])


@query("JON19_coverage", """SELECT kind, confident, emitted, greatest(0, confident - emitted) AS excess, CASE WHEN kind = 'curved_connector' THEN 0 ELSE greatest(0, confident - emitted) END AS omissions, greatest(0, emitted - confident) AS unmatched, round(CASE WHEN confident > 0 THEN least(1.0, emitted / confident) WHEN emitted = 0 THEN 1.0 ELSE 0.0 END, 9) AS ratio
FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'crescendo' WHEN 'R' THEN 'diminuendo' ELSE 'curved_connector' END AS kind, count(*) FILTER (l_discount > 0.05) AS confident, count(*) FILTER (l_linestatus = 'F') AS emitted FROM lineitem GROUP BY 1)""")
def coverage(t):
    rows = t("lineitem").withColumn("kind", _x("CASE l_returnflag WHEN 'A' THEN 'crescendo' WHEN 'R' THEN 'diminuendo' ELSE 'curved_connector' END"))
    return A.coverage(rows, "kind", F.col("l_discount") > 0.05, F.col("l_linestatus") == "F").withColumn("ratio", F.round("ratio", 9))


@query("JON31_aliases", "WITH f AS (SELECT md5(text) AS h, min(doc_id) AS retained FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT d.doc_id, retained, d.lang IS DISTINCT FROM k.lang AS conflict FROM documents d JOIN f ON h = md5(d.text) JOIN documents k ON k.doc_id = retained WHERE d.doc_id <> retained")
def aliases(t):
    return A.aliases(t("documents").select("doc_id", "lang", F.md5("text").alias("digest")), "digest", "doc_id", ["lang"], strict=False)


@query("SET3_isolated_split", """WITH k AS (SELECT c_custkey, c_custkey // 3 AS document, row_number() OVER (ORDER BY sha256('s' || chr(0) || c_custkey)) <= 40 AS chosen FROM customer) SELECT c_custkey, CASE WHEN document IN (SELECT document FROM k WHERE chosen) THEN 'train' ELSE 'calibration' END AS split FROM k""")
def isolated_split(t):
    return A.isolated_split(t("customer").select("c_custkey", _x("c_custkey div 3").alias("document")), "c_custkey", "document", "s", 40)


_PROFILE = "CASE l_returnflag WHEN 'A' THEN 'clean' WHEN 'N' THEN 'scan_easy' ELSE 'scan_hard' END"
_FAMILY = "CASE l_linenumber % 4 WHEN 0 THEN 'overall' WHEN 1 THEN 'numeric' WHEN 2 THEN 'music_word' ELSE 'metadata_mixed' END"


@query("SCORE8_recogniser", f"""WITH g AS (SELECT l_suppkey, {_PROFILE} AS profile, {_FAMILY} AS family, max(l_discount) AS se, max(l_tax) + 0.02 AS me, max(l_tax) AS sc, max(l_discount) - 0.015 AS mc FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT l_suppkey, count(*) FILTER (me + 0.005 < se) AS regressions, avg(sc) FILTER (family = 'overall') - avg(mc) FILTER (family = 'overall') AS cer_gain, arg_max(me - se, CASE WHEN profile = 'scan_hard' THEN 'z' ELSE profile END) FILTER (family = 'overall') AS hard_gain FROM g GROUP BY 1)
SELECT l_suppkey, regressions, round(cer_gain, 9) AS cer_gain, round(hard_gain, 9) AS hard_gain, CASE WHEN regressions = 0 AND (cer_gain >= 0.0005 OR hard_gain >= 0.005) THEN 'medium' ELSE 'small' END AS selected FROM r""")
def recogniser(t):
    rows = t("lineitem").groupBy("l_suppkey", _x(_PROFILE).alias("profile"), _x(_FAMILY).alias("family")).agg(F.max("l_discount").alias("small_exact"), (F.max("l_tax") + 0.02).alias("medium_exact"), F.max("l_tax").alias("small_cer"), (F.max("l_discount") - 0.015).alias("medium_cer"))
    return A.chosen_recogniser(rows, "l_suppkey").withColumns({"cer_gain": F.round("cer_gain", 9), "hard_gain": F.round("hard_gain", 9)})


@query("SCORE9_routing", """WITH l AS (SELECT p_partkey, p_size / 10 AS a, p_size % 7 / 2 AS b, p_size % 3 * 50.0 AS c FROM part), e AS (SELECT *, exp(greatest(-40, a - greatest(a, b, c))) AS ea, exp(greatest(-40, b - greatest(a, b, c))) AS eb, exp(greatest(-40, c - greatest(a, b, c))) AS ec FROM l)
SELECT p_partkey, round(eb / (ea + eb + ec), 9) AS grey, array_to_string(list_transform(list_sort([{'s': -ea, 'i': 0, 'n': 'plain'}, {'s': -eb, 'i': 1, 'n': 'grey'}, {'s': -ec, 'i': 2, 'n': 'sharp'}]), lambda x: x.n), '>') AS route FROM e""")
def routing(t):
    shares, route = R.softmax_route({"plain": _x("p_size / 10"), "grey": _x("p_size % 7 / 2"), "sharp": _x("p_size % 3 * 50D")})
    return t("part").select("p_partkey", F.round(shares["grey"], 9).alias("grey"), F.array_join(route, ">").alias("route"))


_ROW = {"x1": "l_quantity", "y1": "CAST(l_suppkey % 3 AS DOUBLE)", "x2": "l_quantity + 10 + l_partkey % 60", "y2": "l_suppkey % 3 + 10D + l_partkey % 5", "text": "substr('cresc. poco a poco', 1, CAST(l_partkey % 17 AS INT))", "sure": "l_discount * 5", "likely": "l_tax * 10"}


@query("CLU6_contained_rows", f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(f"{v.replace('10D', '10.0')} AS {k}" for k, v in _ROW.items())} FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.l_orderkey = b.l_orderkey AND greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / greatest(1.0, (a.x2 - a.x1) * (a.y2 - a.y1)) >= 0.86
  AND b.x2 - b.x1 > (a.x2 - a.x1) * 1.15 AND a.text <> '' AND (contains(b.text, a.text) OR b.likely >= 0.78) AND b.sure >= a.sure - 0.18)""")
def contained_rows(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[_x(v).alias(k) for k, v in _ROW.items()])
    return A.contained(rows, "l_orderkey", ["l_linenumber", "l_partkey"])


@query("SNK9_share_out")
def shared_out(t):
    """Lines of each order share its whole price in hundreds by quantity."""
    rows = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_quantity").cast("int"))).alias("estimates"), (F.sum("l_extendedprice") / 4000).cast("int").alias("total"))
    return rows.select("l_orderkey", "estimates", "total", R.shared_out("estimates", "total").alias("counts"))


@query("JON1_part_pairs")
def part_pairs(t):
    parts = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("name"), (F.min("l_partkey") % 3).cast("string").alias("id"))
    sides = F.explode(F.array(F.struct(F.lit("r").alias("side"), F.col("l_linenumber").alias("at")), F.struct(F.lit("c").alias("side"), (8 - F.col("l_linenumber")).alias("at"))))
    return A.paired_parts(parts.select("l_orderkey", "name", "id", sides.alias("s")).select("l_orderkey", "name", "id", "s.side", "s.at"), "l_orderkey")
