"""The operators on the driver's tables: a query and the same rows in SQL, by id of the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import scalars as S
from lattica.operators import metrics as M
from lattica.operators import ordered as O
from lattica.operators import selection as P
from lattica.operators import voting as V

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_OVERLAP = """
  SELECT l_orderkey, sum(least(r, c)) AS matched, sum(r) AS reference, sum(c) AS candidate FROM (
    SELECT l_orderkey, l_returnflag, l_linestatus, count(*) FILTER (l_linenumber % 2 = 1) AS r, count(*) FILTER (l_linenumber % 2 = 0) AS c
    FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1"""


@query("AGG5_multiset_overlap", f"SELECT l_orderkey, CAST(matched AS BIGINT) AS matched, CAST(reference AS BIGINT) AS reference, CAST(candidate AS BIGINT) AS candidate FROM ({_OVERLAP})")
def overlap(t):
    odd = F.col("l_linenumber") % 2 == 1
    return M.overlap_of_sides(t("lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"], odd, ~odd)


_RATES = """CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(reference) AS BIGINT) AS reference, CAST(sum(candidate) AS BIGINT) AS candidate,
  CASE WHEN sum(candidate) = 0 THEN 1.0 ELSE sum(matched) / sum(candidate) END AS precision, CASE WHEN sum(reference) = 0 THEN 1.0 ELSE sum(matched) / sum(reference) END AS recall,
  CASE WHEN sum(reference) + sum(candidate) = 0 THEN 1.0 ELSE 2 * sum(matched) / (sum(reference) + sum(candidate)) END AS f1"""


@query("AGG3_micro_rates", f"SELECT {_RATES} FROM ({_OVERLAP})")
def micro(t):
    return M.micro_rates(overlap(t)).drop("harmonic_f1")


@query("AGG11_stratified_rates", f"SELECT o_orderstatus, {_RATES} FROM ({_OVERLAP}) JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderstatus")
def stratified(t):
    rows = overlap(t).join(t("orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderkey") == F.col("l_orderkey"))
    return M.micro_rates(rows, ["o_orderstatus"]).drop("harmonic_f1")


@query("AGG9_harmonic_f1", f"SELECT o_orderpriority, CASE WHEN p + r = 0 THEN 1.0 ELSE 2 * p * r / (p + r) END AS harmonic_f1 FROM (SELECT o_orderpriority, sum(matched) / sum(candidate) AS p, sum(matched) / sum(reference) AS r FROM ({_OVERLAP}) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)")
def harmonic(t):
    rows = overlap(t).join(t("orders").select("o_orderkey", "o_orderpriority"), F.col("o_orderkey") == F.col("l_orderkey"))
    return M.micro_rates(rows, ["o_orderpriority"]).select("o_orderpriority", "harmonic_f1")


GATES = [("minimum", "precision", 0.5), ("minimum", "recall", 0.99), ("maximum", "f1", 0.9), ("minimum", "coverage", 0.1)]


@query("FLT9_gates", f"""WITH m AS (SELECT {_RATES} FROM ({_OVERLAP})), u AS (SELECT 'precision' AS metric, precision AS value FROM m UNION ALL SELECT 'recall', recall FROM m UNION ALL SELECT 'f1', f1 FROM m)
SELECT g.metric, relation, threshold, value, coalesce(CASE WHEN relation = 'minimum' THEN value >= threshold ELSE value <= threshold END, false) AS passed
FROM (VALUES ('minimum', 'precision', 0.5::DOUBLE), ('minimum', 'recall', 0.99), ('maximum', 'f1', 0.9), ('minimum', 'coverage', 0.1)) g(relation, metric, threshold) LEFT JOIN u ON u.metric = g.metric""")
def gates(t):
    m = micro(t)
    metrics = m.select(F.expr("stack(3, 'precision', precision, 'recall', recall, 'f1', f1) as (metric, value)"))
    return M.evaluate_gates(metrics, m.sparkSession.createDataFrame(GATES, "relation string, metric string, threshold double"))


@query("AGG12_scope_coverage", "SELECT CAST(count(*) AS BIGINT) AS items, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(count(*) - count(DISTINCT (l_orderkey, l_partkey)) AS BIGINT) AS duplicate_excess FROM lineitem")
def coverage(t):
    pairs = t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))
    return pairs.agg(F.sum("n").alias("items"), F.count_distinct("l_partkey").alias("parts"), F.sum(F.col("n") - 1).alias("duplicate_excess"))


@query("AGG14_percentiles", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.025), 6) AS low, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.975), 6) AS high FROM orders GROUP BY 1")
def percentiles(t):
    p = M.percentiles(t("orders"), ["o_orderstatus"], "o_totalprice", {"low": 0.025, "median": 0.5, "high": 0.975})
    return p.select("o_orderstatus", *[F.round(c, 6).alias(c) for c in ("low", "median", "high")])


@query("AGG15_text_recognition", """SELECT p_brand, CAST(count(*) AS BIGINT) AS n, avg(CASE WHEN p_name = p_type THEN 1.0 ELSE 0.0 END) AS exact_rate,
  sum(levenshtein(p_name, p_type)) / sum(length(p_type)) AS cer FROM part GROUP BY 1""")
def text_recognition(t):
    d = F.levenshtein("p_name", "p_type")
    return t("part").groupBy("p_brand").agg(F.count("*").alias("n"), F.avg(F.when(F.col("p_name") == F.col("p_type"), 1.0).otherwise(0.0)).alias("exact_rate"), (F.sum(d) / F.sum(F.length("p_type"))).alias("cer"))


@query("STR10_edit_similarity", "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INT) AS distance, 1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type), 1) AS similarity FROM part")
def edit(t):
    return t("part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"), S.edit_similarity(F.col("p_name"), F.col("p_type")).alias("similarity"))


@query("AGG17_detection_rates", """SELECT user_id, CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (value > 50) / count(*) END AS hit_rate,
  CASE WHEN count(*) FILTER (event_type = 'click') = 0 THEN 0.0 ELSE count(*) FILTER (event_type = 'click' AND value > 50) / count(*) FILTER (event_type = 'click') END AS click_rate FROM events GROUP BY 1""")
def detection(t):
    c = lambda cond: F.count(F.when(cond, 1))
    click, high = F.col("event_type") == "click", F.col("value") > 50
    s = t("events").groupBy("user_id").agg(F.count("*").alias("n"), c(high).alias("h"), c(click).alias("k"), c(click & high).alias("kh"))
    return s.select("user_id", S.safe_rate(F.col("h"), F.col("n"), 0.0).alias("hit_rate"), S.safe_rate(F.col("kh"), F.col("k"), 0.0).alias("click_rate"))


@query("AGG49_histogram_similarity", """WITH a AS (SELECT l_quantity AS k, count(*) / sum(count(*)) OVER () AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
  b AS (SELECT l_quantity AS k, count(*) / sum(count(*)) OVER () AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT round(1 - 0.5 * sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))), 9) AS similarity FROM a FULL JOIN b USING (k)""")
def histograms(t):
    of = lambda flag: t("lineitem").where(F.col("l_returnflag") == flag).groupBy("l_quantity").agg(F.count("*").alias("n"))
    return M.histogram_similarity(of("A"), of("R"), "l_quantity").select(F.round("similarity", 9).alias("similarity"))


@query("AGG50_mean_of_non_null", "SELECT p_brand, coalesce(sum(CASE WHEN p_size > 25 THEN p_size END), 0) / greatest(count(CASE WHEN p_size > 25 THEN p_size END), 1) AS mean_size FROM part GROUP BY 1")
def mean_of_non_null(t):
    big = F.when(F.col("p_size") > 25, F.col("p_size"))
    return t("part").groupBy("p_brand").agg((F.coalesce(F.sum(big), F.lit(0)) / F.greatest(F.count(big), F.lit(1))).alias("mean_size"))


@query("AGG45_rarity_weights", """WITH p AS (SELECT DISTINCT l_orderkey AS o_orderkey, l_returnflag FROM lineitem WHERE l_quantity > 40), c AS (SELECT l_returnflag, count(*) AS n FROM p GROUP BY 1),
  r AS (SELECT l_returnflag, least(4.0, 0.5 + 0.5 * pow(max(n) OVER () / n, 0.5)) AS w FROM c), o AS (SELECT o_orderkey, coalesce(max(w), 1.0) AS w FROM orders LEFT JOIN p USING (o_orderkey) LEFT JOIN r USING (l_returnflag) GROUP BY 1)
SELECT o_orderkey, round(w / (SELECT avg(w) FROM o), 9) AS weight FROM o""")
def rarity(t):
    labels = t("lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return M.rarity_weights(t("orders"), labels, "o_orderkey", "l_returnflag").select("o_orderkey", F.round("weight", 9).alias("weight"))


@query("AGG46_mixture_weights", "SELECT doc_id, source, round(n_chars / sum(n_chars) OVER (PARTITION BY source) / count(DISTINCT source) OVER (), 12) AS weight FROM documents".replace("count(DISTINCT source) OVER ()", "(SELECT count(DISTINCT source) FROM documents)"))
def mixture(t):
    totals = t("documents").groupBy("source").agg(F.sum("n_chars").alias("all"))
    totals = totals.withColumn("sources", F.count("*").over(Window.partitionBy(F.lit(0))))
    return t("documents").select("doc_id", "source", "n_chars").join(totals, "source").select("doc_id", "source", F.round(F.col("n_chars") / F.col("all") / F.col("sources"), 12).alias("weight"))


_TAGS = r"CAST(len(regexp_extract_all(html, '<NAME(?:\s[^<>]*?)?\s*/?>')) AS BIGINT)"


@query("AGG42_tag_audit", f"SELECT page_id, {_TAGS.replace('NAME', 'p')} AS paragraphs, {_TAGS.replace('NAME', 'a')} AS links, 2 * {_TAGS.replace('NAME', 'p')} + {_TAGS.replace('NAME', 'a')} AS richness FROM pages")
def tags(t):
    p, a = (S.opening_tags(F.col("html"), x) for x in "pa")
    return t("pages").select("page_id", p.alias("paragraphs"), a.alias("links"), (2 * p + a).alias("richness"))


@query("AGG6_max_simultaneous", """WITH e AS (SELECT l_suppkey, l_partkey, l_linenumber AS a, l_linenumber + CAST(l_quantity AS INT) % 4 AS b FROM lineitem), x AS (SELECT DISTINCT l_suppkey, a AS x FROM e)
SELECT l_suppkey, CAST(max(n) AS BIGINT) AS voices FROM (SELECT x.l_suppkey, x.x, count(DISTINCT e.l_partkey) AS n FROM x JOIN e ON x.l_suppkey = e.l_suppkey AND e.a <= x.x AND x.x < e.b GROUP BY 1, 2) GROUP BY 1""")
def simultaneous(t):
    e = t("lineitem").select("l_suppkey", "l_partkey", F.col("l_linenumber").alias("a"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 4).alias("b"))
    return M.most_at_once(e, "l_suppkey", "l_partkey", "a", "b")


_VOTES = "SELECT l_orderkey, l_suppkey % 3 AS family, l_returnflag AS sig, l_quantity AS score FROM lineitem"


def _votes(t):
    return t("lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("family"), F.col("l_returnflag").alias("sig"), F.col("l_quantity").alias("score"))


@query("AGG25_complete_families", "SELECT l_orderkey, CAST(family AS BIGINT) AS family, CAST(count(*) AS BIGINT) AS members FROM (SELECT l_orderkey, l_suppkey % 3 AS family, l_quantity FROM lineitem) GROUP BY 1, 2 HAVING bool_and(l_quantity < 45)")
def families(t):
    rows = _votes(t).withColumn("valid", F.col("score") < 45)
    return V.complete_families(rows, "l_orderkey", "family", "valid").groupBy("l_orderkey", "family").agg(F.count("*").alias("members"))


@query("AGG27_family_vote", f"""WITH v AS ({_VOTES}), h AS (SELECT l_orderkey, family, min(sig) AS sig, count(*) AS members, max(score) AS score FROM v GROUP BY 1, 2 HAVING count(DISTINCT sig) = 1),
  g AS (SELECT l_orderkey, sig, count(*) AS families, sum(members) AS members, max(score) AS score FROM h GROUP BY 1, 2),
  b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY families DESC, members DESC, score DESC, sig) AS n FROM g)
SELECT l_orderkey, sig, families, CAST(members AS BIGINT) AS members, "of", 2 * families > "of" AS majority FROM b JOIN (SELECT l_orderkey, count(DISTINCT family) AS "of" FROM v GROUP BY 1) USING (l_orderkey) WHERE n = 1""")
def family_vote(t):
    return V.family_majority(_votes(t), "l_orderkey", "family", "sig", "score")


@query("AGG36_family_median", f"SELECT l_orderkey, round(quantile_cont(m, 0.5), 9) AS median, count(*) AS families FROM (SELECT l_orderkey, family, avg(score) AS m FROM ({_VOTES}) GROUP BY 1, 2) GROUP BY 1")
def family_median(t):
    return V.family_median(_votes(t), "l_orderkey", "family", "score").select("l_orderkey", F.round("median", 9).alias("median"), "families")


@query("AGG19_average_precision", """WITH r AS (SELECT lang, quality, sum(quality) OVER o AS tp, row_number() OVER o AS n, sum(quality) OVER (PARTITION BY lang) AS a FROM documents JOIN labels USING (doc_id) WINDOW o AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  k AS (SELECT lang, CAST(a AS BIGINT) AS a, g, max(CASE WHEN tp * 100 >= g * a THEN tp / n END) AS p FROM r, range(0, 101) x(g) WHERE a > 0 GROUP BY 1, 2, 3)
SELECT lang, round(sum(coalesce(p, 0)) / 101, 9) AS ap, a AS positives FROM k GROUP BY lang, a""")
def average_precision(t):
    rows = t("documents").select("doc_id", "lang", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id")
    return M.average_precision(rows, ["lang"], "n_chars", "quality", "doc_id").select("lang", F.round("ap", 9).alias("ap"), "positives")


@query("SCORE10_roc_auc", """WITH d AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)), r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM d)
SELECT CAST(sum(quality) AS BIGINT) AS positives, CAST(count(*) - sum(quality) AS BIGINT) AS negatives, round((sum(r) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2) / (sum(quality) * (count(*) - sum(quality))), 9) AS auc FROM r""")
def auc(t):
    rows = t("documents").select("doc_id", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id")
    return M.roc_auc(rows, "n_chars", "quality").select("positives", "negatives", F.round("auc", 9).alias("auc"))


@query("SCORE5_logistic", "SELECT p_partkey, round(1 / (1 + exp(-greatest(-40, least(40, 0.25 + 0.8 * (p_size - 25.0) / 14.0 - 0.5 * (p_retailprice - 1000.0) / 300.0)))), 9) AS probability FROM part")
def logistic(t):
    score = M.logistic_score([F.col("p_size"), F.col("p_retailprice")], [25.0, 1000.0], [14.0, 300.0], [0.8, -0.5], 0.25)
    return t("part").select("p_partkey", F.round(score, 9).alias("probability"))


@query("WIN1_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS click_in_force FROM events")
def carried(t):
    rows = t("events").withColumn("click", F.when(F.col("event_type") == "click", F.col("value")))
    return O.carry_forward(rows, ["user_id"], ["ts", "event_id"], ["click"]).select("event_id", "click_in_force")


@query("WIN2_running_offset", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - l_quantity AS offset_before FROM lineitem")
def offsets(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t("lineitem").select("l_orderkey", "l_linenumber", (F.sum("l_quantity").over(w) - F.col("l_quantity")).alias("offset_before"))


@query("WIN3_balance", """WITH s AS (SELECT user_id, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END AS d FROM events)
SELECT user_id, CAST(-least(min(s), 0) AS BIGINT) AS unmatched_stops, CAST(sum(d) - least(min(s), 0) AS BIGINT) AS open_starts FROM s GROUP BY 1""")
def balanced(t):
    return O.balance(t("events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "view")


@query("WIN5_neighbours", "SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def context(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


@query("WIN7_top_margin", """SELECT l_orderkey, l_partkey, l_quantity, greatest(0, l_quantity - coalesce(nxt, 0)) AS margin FROM (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER w AS n, lead(l_quantity) OVER w AS nxt FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey)) WHERE n = 1""")
def margins(t):
    return O.top_margin(t("lineitem"), ["l_orderkey"], "l_quantity", "l_partkey")


@query("WIN11_runs", """WITH g AS (SELECT l_orderkey, l_partkey, CASE WHEN l_partkey - lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) > 200 THEN 1 ELSE 0 END AS g FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))
SELECT l_orderkey, CAST(run AS BIGINT) AS run, count(*) AS n, min(l_partkey) AS lo, max(l_partkey) AS hi FROM (SELECT l_orderkey, l_partkey, sum(g) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS run FROM g) GROUP BY 1, 2""")
def gaps(t):
    rows = t("lineitem").select("l_orderkey", "l_partkey").distinct()
    gap = F.col("l_partkey") - F.lag("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_partkey")) > 200
    found = O.runs(rows.withColumn("gap", gap), ["l_orderkey"], "l_partkey", F.col("gap"))
    return found.groupBy("l_orderkey", "run").agg(F.count("*").alias("n"), F.min("l_partkey").alias("lo"), F.max("l_partkey").alias("hi"))


@query("WIN10_collapse_close", "SELECT l_orderkey, list_reduce(x, lambda a, v: CASE WHEN v - a[-1] > 150 THEN list_append(a, v) ELSE a END, [x[1]]) AS kept FROM (SELECT l_orderkey, list_sort(list(DISTINCT CAST(l_partkey AS DOUBLE))) AS x FROM lineitem GROUP BY 1)")
def collapsed(t):
    """Per order the distinct part keys further than 150 from the last one kept."""
    sizes = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.col("l_partkey").cast("double"))).alias("x"))
    return sizes.select("l_orderkey", O.collapse_close(F.col("x"), 150.0).alias("kept"))


_U = "('0x' || substr(sha256('seed-1' || chr(0) || CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615.0"


@query("SET2_hash_split", f"SELECT doc_id, CASE WHEN {_U} < 0.1 THEN 'test' WHEN {_U} < 0.2 THEN 'calibration' ELSE 'train' END AS split FROM documents")
def hash_split(t):
    return P.split_by_hash(t("documents").select("doc_id"), F.col("doc_id").cast("string"), "seed-1")


@query("SET4_leaking_groups", f"SELECT source, count(DISTINCT split) AS splits FROM (SELECT source, CASE WHEN {_U} < 0.1 THEN 'test' WHEN {_U} < 0.2 THEN 'calibration' ELSE 'train' END AS split FROM documents) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leaks(t):
    return P.leaking_groups(P.split_by_hash(t("documents").select("doc_id", "source"), F.col("doc_id").cast("string"), "seed-1"), "source")


@query("SET7_first_of_each", "SELECT md5(text) AS fingerprint, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def firsts(t):
    rows = t("documents").select(F.md5("text").alias("fingerprint"), "doc_id", "source")
    return P.first_of_each(rows, ["fingerprint"], "doc_id", ["doc_id", "source"])


@query("SET6_key_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def difference(t):
    return t("customer").select("c_custkey").distinct().join(t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SET9_leave_one_group_out", "SELECT f.r_regionkey AS fold, count(*) AS n FROM region f JOIN nation ON n_regionkey <> f.r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def folds(t):
    """Counts of all but the fold's group: the whole less the group, without pairing folds with rows."""
    by = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("n"))
    every = t("region").join(by, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_regionkey").alias("fold"), F.coalesce("n", F.lit(0)).alias("own"))
    return every.select("fold", (F.sum("own").over(Window.partitionBy(F.lit(0))) - F.col("own")).alias("n")).where("n > 0")


@query("SET11_symmetric_difference", """WITH c AS (SELECT l_orderkey, list_distinct(list(l_returnflag) FILTER (l_linenumber % 2 = 1)) AS a, list_distinct(list(l_returnflag) FILTER (l_linenumber % 2 = 0)) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, (len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) - len(list_intersect(coalesce(a, []), coalesce(b, [])))) / greatest(len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), 1) AS ratio FROM c""")
def symmetric(t):
    odd = F.col("l_linenumber") % 2 == 1
    c = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(odd, F.col("l_returnflag"))).alias("a"), F.collect_set(F.when(~odd, F.col("l_returnflag"))).alias("b"))
    union = F.size(F.array_union("a", "b"))
    return c.select("l_orderkey", ((union - F.size(F.array_intersect("a", "b"))) / F.greatest(union, F.lit(1))).alias("ratio"))


@query("TOP2_stable_sample", "SELECT doc_id FROM documents ORDER BY sha256('seed-2' || chr(0) || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def sample(t):
    return P.stable_sample(t("documents").select("doc_id"), F.col("doc_id").cast("string"), "seed-2", 50)


@query("TOP6_round_robin", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS turn FROM documents) ORDER BY turn, sha256(source) LIMIT 60")
def robin(t):
    return P.round_robin(t("documents").select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], 60).select("doc_id", "source")


@query("TOP9_capped_per_key", "SELECT source, doc_id, CAST(rank AS INT) AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM documents) WHERE rank <= 5")
def capped(t):
    return P.capped_per_key(t("documents").select("source", "doc_id"), ["source"], [F.sha2(F.col("doc_id").cast("string"), 256), F.col("doc_id")], 5)


@query("TOP16_covering_prefix", "SELECT source, doc_id, CAST(before AS BIGINT) AS before FROM (SELECT source, doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 20000")
def covering(t):
    return P.covering_prefix(t("documents").select("source", "doc_id", "n_chars"), "source", [F.sha2(F.col("doc_id").cast("string"), 256), F.col("doc_id")], "n_chars", 20000).select("source", "doc_id", "before")


@query("JON7_catalogue_reasons", """SELECT reason, count(*) AS n FROM (SELECT unnest([CASE WHEN quality IS NULL THEN 'missing' END, CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN n_chars < 200 THEN 'short' END]) AS reason FROM documents LEFT JOIN labels USING (doc_id)) WHERE reason IS NOT NULL GROUP BY 1""")
def reasons(t):
    rows = t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id", "left")
    rules = {"missing": F.col("quality").isNull(), "low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "short": F.col("n_chars") < 200}
    return P.rejection_reasons(rows, rules).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("JON9_isolation", "SELECT d.doc_id FROM documents d WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 10 = 0) AND doc_id % 10 <> 0")
def isolation(t):
    rows = t("documents").select("doc_id", F.md5("text").alias("fp"), (F.col("doc_id") % 10 == 0).alias("held"))
    return rows.where("not held").join(rows.where("held").select("fp"), "fp", "left_semi").select("doc_id")


@query("JON14_interval_join", "SELECT name, count(*) AS n, sum(o_orderkey) AS keys FROM (SELECT o_orderkey, CASE WHEN o_totalprice < 0 THEN NULL WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' WHEN o_totalprice < 1000000 THEN 'high' END AS name FROM orders) WHERE name IS NOT NULL GROUP BY 1")
def intervals(t):
    orders = t("orders").select("o_orderkey", "o_totalprice")
    bounds = orders.sparkSession.createDataFrame([(0, 50000, "low"), (50000, 150000, "mid"), (150000, 1000000, "high")], "lo long, hi long, name string")
    return P.interval_join(orders, bounds, "o_totalprice", 25000).groupBy("name").agg(F.count("*").alias("n"), F.sum("o_orderkey").cast("decimal(38,0)").alias("keys"))


@query("JON20_boundary_pairs", "SELECT a.conv_id, a.turn, CAST(1 AS BIGINT) AS pairs FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role <> b.role")
def boundary(t):
    rows = t("conversations").select("conv_id", "turn", "role")
    nxt = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    return rows.join(nxt, ["conv_id", "turn"]).where("role <> next").select("conv_id", "turn", F.lit(1).cast("long").alias("pairs"))


def _aligned(t, **options):
    e = t("events").select("user_id", "event_id", "event_type")
    return O.align_groups(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id", "event_type", **options)


@query("JON2_alignment")
def aligned(t):
    """Users' even events against odd ones: gap 0.62, a penalty for place; a dynamic programme, so tested against brute force."""
    return _aligned(t, gap=0.62, placed=True)


@query("JON5_note_alignment")
def aligned_notes(t):
    """Gap 0.92; of equal moves a match, then an insertion, then a deletion."""
    return _aligned(t, gap=0.92, ties=O.MATCH_INSERT_DELETE)


@query("JON6_token_alignment")
def aligned_tokens(t):
    """0 and 1, gap 1; of equal moves a match, then a deletion."""
    return _aligned(t)


@query("STR6_confusion_skeleton", r"SELECT doc_id, md5(regexp_replace(translate(replace(replace(replace(strip_accents(lower(text)), 'rn', 'm'), 'cl', 'd'), 'vv', 'w'), '01|52', 'ollsz'), '[^\p{L}\p{N}]', '', 'g')) AS skeleton FROM documents")
def skeleton(t):
    return t("documents").select("doc_id", F.md5(S.confusion_skeleton(F.col("text"))).alias("skeleton"))


_FAMILY = r"CASE WHEN d AND NOT a THEN 'numeric' WHEN a AND NOT d AND length(trim(t, ' .,:;()[]{}')) <= 12 THEN 'music_word' ELSE 'metadata_mixed' END"


@query("STR15_text_family", rf"SELECT conv_id, turn, {_FAMILY} AS family FROM (SELECT conv_id, turn, t, regexp_matches(t, '\p{{L}}') AS a, regexp_matches(t, '\p{{Nd}}') AS d FROM (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM conversations))")
def family(t):
    return t("conversations").select("conv_id", "turn", S.text_family(F.col("text")).alias("family"))


@query("STR18_safe_filename", r"""SELECT page_id, coalesce(nullif(left(regexp_replace(trim(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), ' .'), '\s+', ' ', 'g'), 160), ''), 'converted_score') AS name FROM pages""")
def filename(t):
    return t("pages").select("page_id", S.safe_filename(F.col("url")).alias("name"))


@query("STR3_normalised_text", "SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS digest FROM documents".replace("\\\\", "\\"))
def normal(t):
    return t("documents").select("doc_id", F.md5(S.normalised_text(F.col("text"))).alias("digest"))


@query("STR14_title_jaccard", """WITH k AS (SELECT p_partkey, list_filter(list_distinct(regexp_extract_all(lower(p_name), '[a-zà-öø-ÿ]{3,}')), lambda w: w NOT IN ('the', 'pour', 'par', 'chez', 'des', 'les', 'une')) AS a, list_filter(list_distinct(regexp_extract_all(lower(p_type), '[a-zà-öø-ÿ]{3,}')), lambda w: w NOT IN ('the', 'pour', 'par', 'chez', 'des', 'les', 'une')) AS b FROM part)
SELECT p_partkey, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS jaccard FROM k""")
def titles(t):
    return t("part").select("p_partkey", S.title_similarity(F.col("p_name"), F.col("p_type")).alias("jaccard"))


@query("GEO1_box_iou", """WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS x1, CAST(l_linenumber * 3 AS INT) AS y1, CAST(l_quantity AS INT) + 20 AS x2, CAST(l_linenumber * 3 AS INT) + 9 AS y2 FROM lineitem),
  i AS (SELECT a.l_orderkey, a.l_linenumber, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)
SELECT l_orderkey, l_linenumber, inter AS intersection, inter / (360 - inter) AS iou, inter / 180 AS min_overlap FROM i""")
def boxes(t):
    x, y = F.col("l_quantity").cast("int"), F.col("l_linenumber") * 3
    b = t("lineitem").select("l_orderkey", "l_linenumber", F.array(x, y, x + 20, y + 9).alias("box"))
    nxt = b.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("box").alias("other"))
    sides = [[F.col(c)[i] for i in range(4)] for c in ("box", "other")]
    return b.join(nxt, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in S.box_overlap(*sides).items()])


@query("GEO5_tile_origins", "SELECT p_partkey, CAST(x AS INT) AS origin FROM (SELECT p_partkey, unnest(list_distinct(list_concat(range(0, greatest(0, 40 * p_size - 512) + 1, 384), [greatest(0, 40 * p_size - 512)]))) AS x FROM part)")
def tiles(t):
    return t("part").select("p_partkey", F.explode(S.tile_origins(40 * F.col("p_size"), 512, 384)).alias("origin"))


@query("PRJ1_midi_cents", "SELECT p_partkey, CAST((CASE p_size % 8 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 7 WHEN 5 THEN 9 WHEN 6 THEN 11 ELSE 0 END + 12 * (p_size % 5 + 1) + p_size % 3 - 1) * 100 AS INT) AS cents FROM part")
def cents(t):
    step = F.element_at(F.array(*[F.lit(s) for s in "CDEFGABX"]), F.col("p_size") % 8 + 1)
    return t("part").select("p_partkey", S.midi_cents(step, F.col("p_size") % 5, F.col("p_size") % 3 - 1).alias("cents"))


@query("PRJ15_namespaced_ids", "SELECT doc_id, substr(sha256(source || chr(0) || CAST(doc_id AS VARCHAR)), 1, 20) AS row_id FROM documents")
def namespaced(t):
    return t("documents").select("doc_id", F.substring(F.sha2(S.keyed(F.col("source"), F.col("doc_id").cast("string")), 256), 1, 20).alias("row_id"))


def flagship(spark, sf_dir) -> DataFrame:
    """Micro-averaged multiset rates by stratum."""
    return QUERIES["AGG11_stratified_rates"](spark, sf_dir)
