"""Costs, weights, gates, matchings and reports on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.functions import costs as K
from lattica.functions import scalars as S
from lattica.operators import matching as T
from lattica.plans.notation import TREE
from lattica.plans.queries import query
from lattica.sources import tables

_KEY = ["l_orderkey", "l_linenumber"]


def _pairs(t, *columns):
    """Lines and the next line of their order, as structs a and b."""
    rows = t("lineitem").select(*_KEY, *columns)
    here = rows.select(*_KEY, F.struct(*columns).alias("a"))
    return here.join(rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.struct(*columns).alias("b")), _KEY)


_NEXT = "FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"
_PITCH = "CASE WHEN {a}.l_tax > 0.07 OR {b}.l_tax > 0.07 THEN CASE WHEN ({a}.l_tax > 0.07) = ({b}.l_tax > 0.07) THEN 0.0 ELSE 1.0 END WHEN abs({a}.l_quantity - {b}.l_quantity) = 0 THEN 0.0 WHEN abs({a}.l_quantity - {b}.l_quantity) * 25 <= 100 THEN 0.25 WHEN abs({a}.l_quantity - {b}.l_quantity) * 25 <= 200 THEN 0.55 WHEN abs({a}.l_quantity - {b}.l_quantity) * 25 <= 500 THEN 0.8 ELSE 1.0 END".format(a="a", b="b")


def _cents(x):
    return (x["l_quantity"] * 25).cast("double"), x["l_tax"] > 0.07


@query("MTH3_pitch_cost", f"SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, b.l_partkey AS next_part, CAST({_PITCH} AS DOUBLE) AS cost {_NEXT}")
def pitch_costs(t):
    rows = _pairs(t, "l_quantity", "l_tax", "l_partkey")
    (ac, ar), (bc, br) = _cents(F.col("a")), _cents(F.col("b"))
    return rows.select(*_KEY, F.col("a.l_partkey").alias("l_partkey"), F.col("b.l_partkey").alias("next_part"), K.pitch_cost(ac, bc, ar, br).alias("cost"))


_MARKS = "list_distinct([{x}.l_returnflag, {x}.l_linestatus])"


@query("MTH2_note_cost", f"""SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, b.l_partkey AS next_part, round(least(1.0, 0.48 * ({_PITCH})
  + 0.30 * CASE WHEN a.l_discount = b.l_discount THEN 0.0 WHEN a.l_discount <= 0 OR b.l_discount <= 0 THEN 1.0 ELSE least(1.0, abs(log2(CAST(a.l_discount AS DOUBLE) / b.l_discount)) / 2) END
  + 0.10 * least(1.0, abs(CAST(a.l_tax AS DOUBLE) - b.l_tax) / greatest(a.l_discount, b.l_discount, 0.25)) + 0.04 * (a.l_suppkey % 2 <> b.l_suppkey % 2)::INT + 0.025 * (a.l_suppkey % 3 <> b.l_suppkey % 3)::INT + 0.02 * (a.l_linestatus <> b.l_linestatus)::INT
  + 0.025 * (len(list_distinct(list_concat({_MARKS.format(x='a')}, {_MARKS.format(x='b')}))) - len(list_intersect({_MARKS.format(x='a')}, {_MARKS.format(x='b')}))) / len(list_distinct(list_concat({_MARKS.format(x='a')}, {_MARKS.format(x='b')})))), 7) AS cost {_NEXT}""")
def note_costs(t):
    def note(x):
        cents, rest = _cents(x)
        return {"cents": cents, "rest": rest, "duration": x["l_discount"].cast("double"), "onset": x["l_tax"].cast("double"), "grace": x["l_suppkey"] % 2, "chord": x["l_suppkey"] % 3, "accidental": x["l_linestatus"], "marks": F.array_distinct(F.array(x["l_returnflag"], x["l_linestatus"]))}

    rows = _pairs(t, "l_quantity", "l_tax", "l_discount", "l_suppkey", "l_linestatus", "l_returnflag", "l_partkey")
    return rows.select(*_KEY, F.col("a.l_partkey").alias("l_partkey"), F.col("b.l_partkey").alias("next_part"), F.round(K.note_cost(note(F.col("a")), note(F.col("b"))), 7).alias("cost"))


@query("MTH5_measure_distance", "SELECT p_partkey, round(least(1.0, 0.8 * (p_size % 11) / 10 + 0.12 * (p_size % 7) / 6 + 0.08 * least(1.0, 0.4 * (p_size % 2) + 0.25 * (p_size % 3 = 0)::INT + 0.2 * (p_size % 5 = 0)::INT + 0.15 * (p_size % 7 = 0)::INT)), 9) AS distance FROM part")
def measure_distances(t):
    n = F.col("p_size")
    return t("part").select("p_partkey", F.round(K.measure_distance(n % 11 / 10, n % 7 / 6, n % 2 == 1, n % 3 == 0, n % 5 == 0, n % 7 == 0), 9).alias("distance"))


@query("MTH6_candidate_weight", "SELECT o_orderkey, round(CASE WHEN o_orderstatus <> 'P' THEN 1.0 ELSE 0.35 END * (0.55 + 1 / (1 + exp(-greatest(-5, least(5, (o_totalprice - 150000) / 100))))) * greatest(0.5, least(1.5, o_orderkey % 4 / 2)), 9) AS weight FROM orders")
def candidate_weights(t):
    return t("orders").select("o_orderkey", F.round(K.candidate_weight(F.col("o_totalprice"), F.lit(150000), F.col("o_orderstatus") != "P", F.col("o_orderkey") % 4 / 2), 9).alias("weight"))


@query("MTH7_candidate_quality", "SELECT o_orderkey, round(CASE WHEN o_orderstatus <> 'P' THEN 1.0 ELSE 0.30 END * greatest(0.08, least(1.35, (o_totalprice / 300 + o_orderkey % 50 + 120) / 1120)) * (0.45 + o_orderkey % 5 / 4) * (0.5 + least(1.0, o_orderkey % 7 / 5)), 9) AS quality FROM orders")
def candidate_qualities(t):
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", F.round(K.candidate_quality(F.col("o_totalprice") / 300, k % 50, F.col("o_orderstatus") != "P", k % 5 / 4, k % 7 / 5), 9).alias("quality"))


@query("MTH8_bounded_weight", "SELECT p_partkey, round(0.6 + 0.8 * greatest(0.0, least(1.0, p_size / 40)), 9) AS weight FROM part")
def bounded_weights(t):
    return t("part").select("p_partkey", F.round(K.bounded_weight(F.col("p_size") / 40, 1.4, 0.6), 9).alias("weight"))


@query("MTH10_aligned_similarity", """WITH c AS (SELECT l_orderkey, count(*) FILTER (l_linenumber % 2 = 1) AS l, count(*) FILTER (l_linenumber % 2 = 0) AS r, count(*) FILTER (l_returnflag = 'N') AS k, coalesce(sum(l_discount) FILTER (l_returnflag = 'N'), 0) AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(CASE WHEN l + r = 0 THEN 1.0 WHEN least(k, l, r) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 0.72 * (least(k, l, r) - s) / greatest(l, r) + 0.28 * least(k, l, r) / greatest(l, r))) END, 9) AS similarity FROM c""")
def aligned_similarities(t):
    n = lambda c: F.count(F.when(c, 1))
    odd, flag = F.col("l_linenumber") % 2 == 1, F.col("l_returnflag") == "N"
    c = t("lineitem").groupBy("l_orderkey").agg(n(odd).alias("l"), n(~odd).alias("r"), n(flag).alias("k"), F.coalesce(F.sum(F.when(flag, F.col("l_discount"))), F.lit(0)).alias("s"))
    return c.select("l_orderkey", F.round(K.aligned_similarity(F.col("s"), F.least("k", "l", "r"), F.col("l"), F.col("r")), 9).alias("similarity"))


@query("FLT5_rhythm_equivalence", f"""SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, b.l_partkey AS next_part, a.l_returnflag = b.l_returnflag
  AND (a.l_suppkey % 97 = b.l_suppkey % 97 OR abs(a.l_suppkey % 97 - b.l_suppkey % 97) * 128 <= 1920) AND (a.l_partkey % 97 = b.l_partkey % 97 OR abs(a.l_partkey % 97 - b.l_partkey % 97) * 128 <= 1920) AS same {_NEXT}""")
def rhythm(t):
    def note(x):
        d = F.lit(1920).cast("long")
        return {"key": x["l_returnflag"], "on_n": x["l_suppkey"] % 97, "on_d": d, "du_n": x["l_partkey"] % 97, "du_d": d}

    rows = _pairs(t, "l_returnflag", "l_suppkey", "l_partkey")
    return rows.select(*_KEY, F.col("a.l_partkey").alias("l_partkey"), F.col("b.l_partkey").alias("next_part"), K.rhythm_equivalent(note(F.col("a")), note(F.col("b")), F.lit(4)).alias("same"))


@query("FLT6_key_equivalence", "SELECT d.doc_id, quality IS NOT DISTINCT FROM toxic AS same FROM documents d LEFT JOIN labels l USING (doc_id)")
def same_keys(t):
    return t("documents").join(t("labels"), "doc_id", "left").select("doc_id", K.keys_equivalent(F.col("quality"), F.col("toxic")).alias("same"))


@query("FLT17_strong_candidate", "SELECT o_orderkey, o_orderstatus <> 'P' AND o_totalprice >= 100000 AND o_orderkey % 3 = 0 AND o_custkey % 2 = 0 AND (o_orderkey % 5 IN (0, 4) OR o_orderkey % 5 IS NULL) AND o_orderkey % 7 <= CASE WHEN o_custkey % 30 = 0 THEN 1 ELSE greatest(1, round_even(o_custkey % 30 * 0.1, 0)) END AS strong FROM orders")
def strong(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    gap = F.when(k % 5 == 4, None).otherwise(k % 5)
    return t("orders").select("o_orderkey", K.candidate_is_strong(F.col("o_orderstatus") != "P", [k % 3, c % 2], gap, k % 7, c % 30, F.col("o_totalprice"), 100000.0, 0.1).alias("strong"))


_BOX = "CAST(l_quantity AS INT) AS x1, CAST(l_partkey % 60 AS INT) AS y1, CAST(l_quantity AS INT) + CAST(l_suppkey % 40 AS INT) + 1 AS x2, CAST(l_partkey % 60 AS INT) + 12 AS y2"


def _boxes(t, *more):
    x, y = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 60).cast("int")
    return t("lineitem").select(*_KEY, *more, x.alias("x1"), y.alias("y1"), (x + (F.col("l_suppkey") % 40).cast("int") + 1).alias("x2"), (y + 12).alias("y2"))


_CROP = [10, 5, 45, 40]


@query("GEO8_intersection_box", f"SELECT l_orderkey, l_linenumber, greatest(x1, 10) AS left_edge, greatest(y1, 5) AS top, least(x2, 45) AS right_edge, least(y2, 40) AS bottom FROM (SELECT l_orderkey, l_linenumber, {_BOX} FROM lineitem)")
def intersections(t):
    x = K.intersection_box([F.col(c) for c in T.BOX], [F.lit(v) for v in _CROP])
    return _boxes(t).select(*_KEY, *[v.alias(k) for k, v in zip(("left_edge", "top", "right_edge", "bottom"), x, strict=True)])


_FRACTION = "greatest(0, least(x2, 45) - greatest(x1, 10)) * greatest(0, least(y2, 40) - greatest(y1, 5)) / ((x2 - x1) * (y2 - y1))"


@query("FLT15_clip_floor", f"SELECT l_orderkey, l_linenumber, x1, y1, round({_FRACTION}, 9) AS fraction, {_FRACTION} + 1e-6 >= 0.35 AS kept FROM (SELECT l_orderkey, l_linenumber, {_BOX} FROM lineitem)")
def clipped(t):
    f = K.visible_fraction([F.col(c) for c in T.BOX], [F.lit(v) for v in _CROP])
    return _boxes(t).select(*_KEY, "x1", "y1", F.round(f, 9).alias("fraction"), (f + 1e-6 >= 0.35).alias("kept"))


@query("FLT16_long_span", f"""SELECT l_orderkey, l_linenumber, x1, y1, least(x2, 45) > greatest(x1, 10) AND least(y2, 40) > greatest(y1, 5) AND ({_FRACTION} + 1e-9 >= CASE WHEN long THEN 0.3 ELSE 0.6 END OR (long AND x2 - x1 > 35 AND least(x2, 45) - greatest(x1, 10) >= 8 AND (least(y2, 40) - greatest(y1, 5)) / (y2 - y1) + 1e-9 >= 0.3)) AS visible
FROM (SELECT l_orderkey, l_linenumber, l_returnflag = 'N' AS long, {_BOX} FROM lineitem)""")
def long_spans(t):
    seen = K.fragment_visible([F.col(c) for c in T.BOX], [F.lit(v) for v in _CROP], 0.6, 0.3, F.col("l_returnflag") == "N", 8.0)
    return _boxes(t, "l_returnflag").select(*_KEY, "x1", "y1", seen.alias("visible"))


@query("JON15_nearest_staff", """WITH s(i, top, bottom, spacing) AS (VALUES (0, 40.0, 80.0, 10.0), (1, 200.0, 240.0, 10.0), (2, 500.0, 520.0, 5.0)), c AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 700 AS DOUBLE) AS y FROM lineitem),
  d AS (SELECT *, greatest(top - y, y - bottom, 0) / spacing AS d, CASE WHEN y < top THEN 'above' WHEN y > bottom THEN 'below' WHEN y <= (top + bottom) / 2 THEN 'above' ELSE 'below' END AS p FROM c, s), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY d, i) AS n FROM d)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN d <= 8 THEN i END AS staff, CASE WHEN d <= 8 THEN p END AS placement FROM r WHERE n = 1""")
def staffs(t):
    known = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(a).alias("top"), F.lit(b).alias("bottom"), F.lit(s).alias("spacing")) for i, a, b, s in [(0, 40.0, 80.0, 10.0), (1, 200.0, 240.0, 10.0), (2, 500.0, 520.0, 5.0)]])
    return t("lineitem").select(*_KEY, "l_partkey", K.nearest_staff((F.col("l_partkey") % 700).cast("double"), known).alias("s")).distinct().select(*_KEY, "l_partkey", F.col("s.index").alias("staff"), F.col("s.placement").alias("placement"))


@query("PRJ14_natural_key", "SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(lower(c_name), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 20, '0') ELSE p END), '') AS natural FROM customer")
def natural(t):
    return t("customer").select("c_custkey", K.natural_key(F.col("c_name")).alias("natural"))


@query("PRJ10_event_order", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_returnflag = 'N', l_quantity, l_discount, l_linestatus, l_suppkey, l_linenumber, l_partkey) AS place FROM lineitem")
def event_order(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", F.col("l_returnflag") == "N", "l_quantity", "l_discount", "l_linestatus", "l_suppkey", "l_linenumber", "l_partkey")
    return t("lineitem").select(*_KEY, "l_partkey", F.row_number().over(w).cast("long").alias("place"))


_NOTE = "concat_ws(':', l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus)"


@query("PRJ4_stable_key", f"SELECT l_orderkey, {_NOTE} AS key FROM lineitem")
def stable_keys(t):
    return t("lineitem").select("l_orderkey", F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").alias("key"))


@query("PRJ5_fingerprint", f"SELECT l_orderkey, substr(sha256(string_agg({_NOTE}, '|' ORDER BY l_linenumber, l_partkey, l_suppkey, {_NOTE})), 1, 20) AS fingerprint FROM lineitem GROUP BY 1")
def fingerprints(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").alias("key")))).alias("notes"))
    return rows.select("l_orderkey", F.substring(F.sha2(F.array_join("notes.key", "|"), 256), 1, 20).alias("fingerprint"))


_PLAIN = r"regexp_replace(translate(trim(text, e' \t\n\r\x0b\x0c'), '’`—–', '''''--'), '\s+', ' ', 'g')"


@query("STR1_normalised_words", rf"SELECT conv_id, turn, md5(trim(lower({_PLAIN}), ' ,;:()[]{{}}')) AS digest FROM conversations")
def words(t):
    return t("conversations").select("conv_id", "turn", F.md5(K.normalised_words(F.col("text"))).alias("digest"))


@query("STR2_normalised_direction", rf"SELECT conv_id, turn, md5(lower(trim(regexp_replace({_PLAIN}, '^[.,;:!?]+', ''), e' \t\r\n,;:()[]{{}}'))) AS digest FROM conversations")
def directions(t):
    return t("conversations").select("conv_id", "turn", F.md5(K.normalised_direction(F.col("text"))).alias("digest"))


@query("STR5_accent_fold", "SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents")
def folded(t):
    return t("documents").select("doc_id", F.md5(S.accent_fold("text")).alias("digest"))


FOREST = [TREE, [TREE[1] | {"value": 0.1}], [{"feature": 1, "threshold": 950.0, "left": 1, "right": 2, "value": 0}, TREE[1], TREE[4]]]
_T1 = "CASE WHEN p_size <= 24.5 THEN 0.25 WHEN p_retailprice::FLOAT <= 1200 THEN 0.5 ELSE 0.75 END"
_TREES = f"({_T1} + 0.1 + CASE WHEN p_retailprice::FLOAT <= 950 THEN 0.25 ELSE 0.75 END)"


@query("SCORE1_forest", f"SELECT p_partkey, round(1 / (1 + exp(-(-1.5 + 3.0 * {_TREES} / 3))), 9) AS probability FROM part")
def forest(t):
    return t("part").select("p_partkey", F.round(K.forest_probability(FOREST, [F.col("p_size"), F.col("p_retailprice")], -1.5, 3.0), 9).alias("probability"))


@query("SCORE2_boosting", f"SELECT p_partkey, round(1 / (1 + exp(-(0.1 + 1.2 * (-0.4 + 0.3 * {_TREES})))), 9) AS probability FROM part")
def boosting(t):
    return t("part").select("p_partkey", F.round(K.boosting_probability(FOREST, [F.col("p_size"), F.col("p_retailprice")], -0.4, 0.3, 0.1, 1.2), 9).alias("probability"))


@query("AGG2_numeric_sums", "SELECT lang, sum(TRY_CAST(part AS DOUBLE)) AS total, count(TRY_CAST(part AS DOUBLE)) AS counted FROM (SELECT lang, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN CAST(n_chars AS VARCHAR) END AS part FROM documents) GROUP BY 1")
def numeric_sums(t):
    part = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, F.col("n_chars").cast("string"))
    number = part.try_cast("double")
    return t("documents").groupBy("lang").agg(F.sum(number).alias("total"), F.count(number).alias("counted"))


@query("AGG13_bootstrap", """WITH n AS (SELECT count(*) AS n FROM supplier), c AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS no, s_suppkey FROM supplier),
  k AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS m, count(*) AS r FROM lineitem GROUP BY 1), q AS (SELECT no, coalesce(m, 0) AS m, coalesce(r, 0) AS r FROM c LEFT JOIN k ON l_suppkey = s_suppkey),
  d AS (SELECT s, ('0x' || substr(sha256('boot' || chr(0) || CAST(s AS VARCHAR) || chr(0) || CAST(i AS VARCHAR)), 1, 15))::BIGINT % n AS no FROM n, range(200) a(s), range((SELECT count(*) FROM supplier)) b(i)),
  v AS (SELECT sum(m) / sum(r) AS v FROM d JOIN q USING (no) GROUP BY s)
SELECT round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.5), 9) AS median, round(quantile_cont(v, 0.975), 9) AS high FROM v""")
def bootstrapped(t):
    counts = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("m"), F.count("*").alias("r"))
    # Cases are few and numbered in one place; the draws, of which there are 200 times as many, are not.
    cases = t("supplier").select("s_suppkey", (F.row_number().over(Window.orderBy("s_suppkey")) - 1).cast("long").alias("no")).join(counts, "s_suppkey", "left").na.fill(0, ["m", "r"])
    found = T.bootstrap(cases, "no", t("supplier").count(), 200, "boot", F.col("m") / F.col("r"), ["m", "r"], {"low": 0.025, "median": 0.5, "high": 0.975})
    return found.select(*[F.round(c, 9).alias(c) for c in ("low", "median", "high")])


@query("AGG16_recognition", "SELECT p_brand, count(*) AS samples, count(*) FILTER (p_name = p_type) AS correct, count(*) FILTER (p_name = p_type) / count(*) AS acc, round(avg(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type), 1)), 9) AS norm_edit_dis FROM part GROUP BY 1")
def recognition(t):
    exact = F.count(F.when(F.col("p_name") == F.col("p_type"), 1))
    return t("part").groupBy("p_brand").agg(F.count("*").alias("samples"), exact.alias("correct"), (exact / F.count("*")).alias("acc"), F.round(F.avg(S.edit_similarity(F.col("p_name"), F.col("p_type"))), 9).alias("norm_edit_dis"))


@query("AGG22_confusion", "SELECT lang, count(*) FILTER (n_chars >= 500 AND quality = 1) AS tp, count(*) FILTER (n_chars >= 500 AND quality = 0) AS fp, count(*) FILTER (n_chars < 500 AND quality = 1) AS fn, count(*) FILTER (n_chars < 500 AND quality = 0) AS tn FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def confusion(t):
    said, true = F.col("n_chars") >= 500, F.col("quality") == 1
    n = lambda c: F.count(F.when(c, 1))
    rows = t("documents").select("doc_id", "lang", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id")
    return rows.groupBy("lang").agg(n(said & true).alias("tp"), n(said & ~true).alias("fp"), n(~said & true).alias("fn"), n(~said & ~true).alias("tn"))


@query("AGG39_macro_micro", "SELECT event_type, count(*) AS cases, count(*) FILTER (event_id % 9 = 0) AS failures, round(avg((user_id % 5) / greatest(event_id % 20, 1)) FILTER (event_id % 9 <> 0), 9) AS macro, round(sum(user_id % 5) FILTER (event_id % 9 <> 0) / greatest(sum(event_id % 20) FILTER (event_id % 9 <> 0), 1), 9) AS micro FROM events GROUP BY 1")
def reports(t):
    rows = t("events").select("event_type", (F.col("user_id") % 5).alias("errors"), (F.col("event_id") % 20).alias("n"), (F.col("event_id") % 9 == 0).alias("failed"))
    return T.macro_micro(rows, ["event_type"], "errors", "n", "failed").withColumns({c: F.round(c, 9) for c in ("macro", "micro")})


@query("SCORE10_log_loss", "SELECT lang, round(-avg(CASE WHEN quality = 1 THEN ln(p) ELSE ln(1 - p) END), 9) AS log_loss, round(avg(pow(p - quality, 2)), 9) AS brier FROM (SELECT lang, quality, greatest(1e-12, least(1 - 1e-12, n_chars / (n_chars + 400.0))) AS p FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def losses(t):
    p = K.held(F.col("n_chars") / (F.col("n_chars") + 400.0), 1e-12, 1 - 1e-12)
    rows = t("documents").select("doc_id", "lang", p.alias("p")).join(t("labels").select("doc_id", "quality"), "doc_id")
    return rows.groupBy("lang").agg(F.round(-F.avg(F.when(F.col("quality") == 1, F.log("p")).otherwise(F.log(1 - F.col("p")))), 9).alias("log_loss"), F.round(F.avg(F.pow(F.col("p") - F.col("quality"), F.lit(2.0))), 9).alias("brier"))


@query("JON13_disjoint_training", "SELECT doc_id, doc_id IN (SELECT doc_id FROM documents WHERE source = (SELECT min(source) FROM documents)) AS reserved_id, md5(coalesce(text, '')) IN (SELECT md5(coalesce(text, '')) FROM documents WHERE source = (SELECT min(source) FROM documents)) AS reserved_work FROM documents WHERE source > (SELECT min(source) FROM documents)")
def disjoint(t):
    rows = t("documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("work"), "source")
    first = rows.agg(F.min("source").alias("first"))
    rows = rows.join(F.broadcast(first))  # one row
    held, train = rows.where("source = first"), rows.where("source > first").select("doc_id", "work")
    ids = held.select("doc_id", F.lit(True).alias("reserved_id")).distinct()
    works = held.select("work", F.lit(True).alias("reserved_work")).distinct()
    out = train.join(ids, "doc_id", "left").join(works, "work", "left")
    return out.select("doc_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("reserved_id", "reserved_work")])


@query("TOP3_stable_rows", "SELECT conv_id, turn, md5(text) AS digest FROM conversations ORDER BY sha256('rows' || chr(0) || CAST(conv_id AS VARCHAR) || chr(0) || CAST(turn AS VARCHAR)), conv_id, turn LIMIT 40")
def stable_rows(t):
    key = S.keyed("rows", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return t("conversations").orderBy(F.sha2(key, 256), "conv_id", "turn").limit(40).select("conv_id", "turn", F.md5("text").alias("digest"))


@query("TOP4_stable_ids", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY sha256('ids' || chr(0) || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 30) ORDER BY o_orderkey")
def stable_ids(t):
    return t("orders").select("o_orderkey").orderBy(F.sha2(S.keyed("ids", F.col("o_orderkey").cast("string")), 256), "o_orderkey").limit(30).orderBy("o_orderkey")


_SIDES = f"WITH b AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, {_BOX} FROM lineitem)"


@query("AGG18_iou_matrix", f"""{_SIDES}, i AS (SELECT a.l_orderkey, a.n AS found_item, b.n AS truth_item, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS areas FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.n % 2 = 1 AND b.n % 2 = 0)
SELECT l_orderkey, found_item, truth_item, round(inter / (areas - inter), 9) AS iou FROM i""")
def iou_matrix(t):
    b = _sides(t)
    a, c = b.where("n % 2 = 1"), b.where("n % 2 = 0")
    rows = a.select("l_orderkey", F.col("n").alias("found_item"), F.array(*T.BOX).alias("a")).join(c.select("l_orderkey", F.col("n").alias("truth_item"), F.array(*T.BOX).alias("b")), "l_orderkey")
    iou = S.box_overlap([F.col("a")[i] for i in range(4)], [F.col("b")[i] for i in range(4)])["iou"]
    return rows.select("l_orderkey", "found_item", "truth_item", F.round(iou, 9).alias("iou"))


def _sides(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return _boxes(t, F.row_number().over(w).cast("long").alias("n"))


@query("JON24_maximum_matching")
def maximum(t):
    """Odd lines' boxes against even ones', as many pairs of IoU 0.1 and more as can be; augmenting paths, so tested against brute force."""
    b = _sides(t)
    return T.match_boxes(b.where("n % 2 = 0"), b.where("n % 2 = 1"), "l_orderkey", "n", None, 0.1, T.maximum_matches)


@query("JON25_greedy_matching")
def greedy(t):
    """The same boxes, each odd line's taking the best one left; depends on what was taken, so tested against brute force."""
    b = _sides(t).withColumn("score", F.col("x2").cast("double"))
    return T.match_boxes(b.where("n % 2 = 0"), b.where("n % 2 = 1"), "l_orderkey", "n", "score", 0.1)


@query("FLT26_page_shape", "SELECT p_partkey, p_size % 5 > 0 AND p_partkey % 40 > 0 AND greatest(p_size % 5 * 10, p_partkey % 40) / least(p_size % 5 * 10, p_partkey % 40) <= 3 AS supported FROM part".replace("/ least(p_size % 5 * 10, p_partkey % 40)", "/ nullif(least(p_size % 5 * 10, p_partkey % 40), 0)"))
def page_shapes(t):
    return t("part").select("p_partkey", K.page_shape_supported(F.col("p_size") % 5 * 10, F.col("p_partkey") % 40).alias("supported"))


_GRAMS = "list_distinct(list_transform(range(1, greatest(length('  ' || {c} || '  ') - 1, 2)), lambda i: substr('  ' || {c} || '  ', i, 3)))"


def _shortlist_sql(grams: float, lengths: float, first: float) -> str:
    a, b = _GRAMS.format(c="p.v"), _GRAMS.format(c="n.v")
    return f"""WITH n AS (SELECT n_name, lower(n_name) AS v FROM nation), p AS (SELECT DISTINCT lower(p_type) AS v FROM part), s AS (SELECT p.v AS observed, n_name, round({grams} * len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) + {lengths} * least(length(p.v), length(n.v)) / greatest(length(p.v), length(n.v)) + CASE WHEN left(p.v, 1) = left(n.v, 1) THEN {first} ELSE 0 END, 9) AS score FROM p, n)
SELECT observed, n_name, score FROM (SELECT *, row_number() OVER (PARTITION BY observed ORDER BY score DESC, n_name) AS k FROM s) WHERE k <= 5"""


def _shortlist(t, grams: float, lengths: float, first: float):
    """The lexicon is a fixed word list (25 rows here) that stays with the code, as an array; observed texts are not paired across tasks."""
    words = F.broadcast(t("nation").agg(F.collect_list(F.struct("n_name", F.lower("n_name").alias("v"), K.trigrams(F.lower("n_name")).alias("g"))).alias("lexicon")))
    seen = t("part").select(F.lower("p_type").alias("observed")).distinct().withColumn("grams", K.trigrams(F.col("observed")))
    score = lambda w: F.round(K.shortlist_score(F.col("observed"), w["v"], F.col("grams"), w["g"], grams, lengths, first), 9)
    ranked = seen.join(words).select("observed", F.slice(F.array_sort(F.transform("lexicon", lambda w: F.struct((-score(w)).alias("s"), w["n_name"].alias("n_name")))), 1, 5).alias("best"))
    return ranked.select("observed", F.explode("best").alias("b")).select("observed", F.col("b.n_name").alias("n_name"), (-F.col("b.s")).alias("score"))


@query("STR12_phrase_shortlist", _shortlist_sql(0.7, 0.3, 0.15))
def phrases(t):
    return _shortlist(t, 0.7, 0.3, 0.15)


@query("STR13_token_shortlist", _shortlist_sql(0.72, 0.28, 0.12))
def token_shortlist(t):
    return _shortlist(t, 0.72, 0.28, 0.12)


@query("SRC9_reference_records", "SELECT p_partkey, unnest(['OTL', 'COM']) AS name, unnest([p_name, CASE WHEN p_size > 25 THEN 'a: b' ELSE p_type END]) AS value FROM part")
def records(t):
    text = F.concat(F.lit("!!!OTL: "), "p_name", F.lit("\n**kern\n!!! no record\n!!!COM : "), F.when(F.col("p_size") > 25, "a: b").otherwise(F.col("p_type")), F.lit("\n!!!OTL: later"))
    return tables.reference_records(t("part").select("p_partkey", text.alias("text")), "p_partkey", "text")


@query("SNK2_canonical_json", "SELECT n_nationkey, '{\"n_name\":' || to_json(n_name) || ',\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS json FROM nation")
def jsons(t):
    return t("nation").select("n_nationkey", tables.canonical_json("n_regionkey", "n_name", "n_nationkey").alias("json"))
