"""Notation, selection, matching and cluster operators on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.functions import notation as N
from lattica.functions import scalars as S
from lattica.operators import clusters as C
from lattica.operators import selection as P
from lattica.plans.queries import query
from lattica.sources.scores import tokens


@query("PRJ2_measure_duration", "SELECT p_partkey, CASE WHEN p_size % 7 - 1 > 0 AND p_size % 5 > 0 THEN 4.0 * (p_size % 7 - 1) / (p_size % 5) END AS quarters FROM part")
def measure_duration(t):
    return t("part").select("p_partkey", N.measure_duration(F.col("p_size") % 7 - 1, F.col("p_size") % 5).alias("quarters"))


@query("PRJ3_note_duration", "SELECT p_partkey, pow(2.0, p_size % 5 - 2) * (2 - pow(2.0, -(p_size % 3))) * 2 / (2 + p_size % 2) AS quarters FROM part")
def note_duration(t):
    n = F.col("p_size")
    return t("part").select("p_partkey", N.note_duration(F.pow(F.lit(2.0), n % 5 - 2), n % 3, 2 + n % 2, F.lit(2)).alias("quarters"))


@query("PRJ9_chord_flags", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_quantity, l_partkey, l_linenumber) > 1 AS continues FROM lineitem")
def chord_flags(t):
    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_quantity", "l_partkey", "l_linenumber")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.row_number().over(w) > 1).alias("continues"))


@query("PRJ11_direction_key", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'wedge' ELSE 'words' END AS kind, p_type AS value, CASE WHEN p_size > 25 THEN '' ELSE p_name END AS end_value FROM part")
def direction_key(t):
    kind = F.when(F.col("p_size") > 25, "wedge").otherwise("words")
    return t("part").select("p_partkey", kind.alias("kind"), F.col("p_type").alias("value"), N.direction_end(kind, F.col("p_name")).alias("end_value"))


@query("PRJ13_key_alterations", """SELECT p_partkey, s AS step, CAST(CASE WHEN f > k THEN 1 ELSE -1 END AS INT) AS alter FROM (SELECT p_partkey, p_size % 15 - 7 AS f FROM part), (VALUES ('F', 0), ('C', 1), ('G', 2), ('D', 3), ('A', 4), ('E', 5), ('B', 6)) v(s, k) WHERE f > k OR -f > 6 - k""")
def key_alterations(t):
    return t("part").select("p_partkey", F.explode(N.key_alterations(F.col("p_size") % 15 - 7)).alias("step", "alter"))


@query("FLT4_quantised_equality", "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_linenumber / 96.0 - l_quantity / 768.0) <= 1 / 128.0 + 1e-12 AS same FROM lineitem")
def quantised(t):
    n, q = F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", N.quantised_equal(n, F.lit(96), q, F.lit(768), F.lit(96)).alias("same"))


@query("FLT8_strict_boolean", "SELECT doc_id, toxic = 1 AS flag FROM labels")
def booleans(t):
    return t("labels").select("doc_id", S.strict_boolean(F.col("toxic").cast("string")).alias("flag"))


@query("FLT18_ambiguity", """SELECT l_orderkey, count(*) < 2 OR count(DISTINCT l_linenumber % 2) > 1 OR max(l_quantity) - coalesce(max(CASE WHEN n = 2 THEN l_quantity END), 0) < 3 AS ambiguous
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS n FROM lineitem) GROUP BY 1""")
def ambiguity(t):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"))
    rows = t("lineitem").withColumn("n", F.row_number().over(w)).groupBy("l_orderkey").agg(F.count("*").alias("c"), F.count_distinct(F.col("l_linenumber") % 2).alias("k"), F.max("l_quantity").alias("best"), F.max(F.when(F.col("n") == 2, F.col("l_quantity"))).alias("next"))
    return rows.select("l_orderkey", ((F.col("c") < 2) | (F.col("k") > 1) | (F.col("best") - F.coalesce("next", F.lit(0)) < 3)).alias("ambiguous"))


@query("JON8_overlap", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def overlapping(t):
    of = lambda flag: t("lineitem").where(F.col("l_returnflag") == flag).select("l_partkey")
    return of("A").join(of("R"), "l_partkey", "left_semi").distinct()


@query("JON12_unused", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unused(t):
    return t("part").select("p_partkey").join(t("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("JON18_inventory", """SELECT l_orderkey, l_returnflag, CAST(count(*) FILTER (l_linenumber % 2 = 1) AS BIGINT) AS source, CAST(count(*) FILTER (l_linenumber % 2 = 0) AS BIGINT) AS output,
  CAST(greatest(count(*) FILTER (l_linenumber % 2 = 1) - count(*) FILTER (l_linenumber % 2 = 0), 0) AS BIGINT) AS missing FROM lineitem GROUP BY 1, 2""")
def inventory(t):
    odd = F.col("l_linenumber") % 2 == 1
    c = t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.when(odd, 1)).alias("source"), F.count(F.when(~odd, 1)).alias("output"))
    return c.withColumn("missing", F.greatest(F.col("source") - F.col("output"), F.lit(0)))


@query("JON28_neighbours", "SELECT l_orderkey, l_linenumber, l_partkey, lag(l_partkey) OVER w AS previous, lead(l_partkey) OVER w AS following FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)")
def neighbours(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lag("l_partkey").over(w).alias("previous"), F.lead("l_partkey").over(w).alias("following"))


@query("AGG7_safe_rate", "SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 1.0 ELSE count(*) FILTER (o_orderstatus = 'F') / count(o_orderkey) END AS rate FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def safe_rate(t):
    rows = t("customer").join(t("orders").select("o_custkey", "o_orderstatus", "o_orderkey"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("k"))
    return rows.select("c_custkey", S.safe_rate(F.col("k"), F.col("n")).alias("rate"))


@query("AGG8_count_f1", """SELECT l_orderkey, CASE WHEN r + c = 0 THEN 1.0 ELSE 2 * m / (r + c) END AS f1 FROM (
  SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS m, count(*) FILTER (l_returnflag = 'A') AS r, count(*) FILTER (l_linestatus = 'F') AS c FROM lineitem GROUP BY 1)""")
def count_f1(t):
    a, f = F.col("l_returnflag") == "A", F.col("l_linestatus") == "F"
    c = t("lineitem").groupBy("l_orderkey").agg(F.count(F.when(a & f, 1)).alias("m"), F.count(F.when(a, 1)).alias("r"), F.count(F.when(f, 1)).alias("c"))
    return c.select("l_orderkey", S.count_f1(F.col("m"), F.col("r"), F.col("c")).alias("f1"))


@query("AGG32_notation_balance", "SELECT user_id, CAST(abs(count(*) FILTER (event_type = 'click') - count(*) FILTER (event_type = 'view')) AS BIGINT) AS imbalance FROM events GROUP BY 1")
def notation_balance(t):
    return t("events").groupBy("user_id").agg(F.abs(F.count(F.when(F.col("event_type") == "click", 1)) - F.count(F.when(F.col("event_type") == "view", 1))).alias("imbalance"))


@query("AGG40_token_families", """WITH k AS (SELECT lower(w) AS w, regexp_extract(w, '^[A-Za-z]') AS family, count(*) FILTER (side = 1) AS r, count(*) FILTER (side = 2) AS c FROM (SELECT unnest(string_split(p_name, ' ')) AS w, 1 AS side FROM part UNION ALL SELECT unnest(string_split(p_type, ' ')), 2 FROM part) GROUP BY w),
  s AS (SELECT family, sum(least(r, c)) AS m, sum(r) AS r, sum(c) AS c FROM k GROUP BY 1)
SELECT family, CASE WHEN c > 0 THEN m / c WHEN r = 0 THEN 1.0 ELSE 0.0 END AS precision, CASE WHEN r > 0 THEN m / r WHEN c = 0 THEN 1.0 ELSE 0.0 END AS recall, CASE WHEN r + c = 0 THEN 1.0 ELSE 2 * m / (r + c) END AS f1 FROM s""")
def token_families(t):
    side = lambda c, n: t("part").select(F.explode(F.split(c, " ")).alias("w"), F.lit(n).alias("side"))
    k = side("p_name", 1).unionByName(side("p_type", 2)).groupBy("w").agg(F.count(F.when(F.col("side") == 1, 1)).alias("r"), F.count(F.when(F.col("side") == 2, 1)).alias("c"))
    s = k.groupBy(F.regexp_extract("w", "^[A-Za-z]", 0).alias("family")).agg(F.sum(F.least("r", "c")).alias("m"), F.sum("r").alias("r"), F.sum("c").alias("c"))
    m, r, c = F.col("m"), F.col("r"), F.col("c")
    return s.select("family", F.when(c > 0, m / c).when(r == 0, 1.0).otherwise(0.0).alias("precision"), F.when(r > 0, m / r).when(c == 0, 1.0).otherwise(0.0).alias("recall"), S.count_f1(m, r, c).alias("f1"))


@query("AGG44_supported_macro", "SELECT avg(v) AS macro, CAST(count(*) AS BIGINT) AS classes FROM (SELECT avg(l_discount) AS v FROM lineitem GROUP BY l_partkey HAVING count(*) >= 30)")
def supported_macro(t):
    by = t("lineitem").groupBy("l_partkey").agg(F.avg("l_discount").alias("v"), F.count("*").alias("n")).where("n >= 30")
    return by.agg(F.avg("v").alias("macro"), F.count("*").alias("classes"))


@query("AGG48_fingerprint", "SELECT n_regionkey, sha256(string_agg(n_name, chr(0) ORDER BY n_nationkey)) AS fingerprint FROM nation GROUP BY 1")
def fingerprint(t):
    rows = t("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    return rows.select("n_regionkey", F.sha2(F.array_join(F.transform("x", lambda x: x["n_name"]), "\x00"), 256).alias("fingerprint"))


@query("WIN8_arc_pairs", """SELECT l_orderkey, l_suppkey % 3 AS number, NOT coalesce(count(*) FILTER (l_linestatus = 'O') = 1 AND count(*) FILTER (l_linestatus = 'F') = 1 AND min(CASE WHEN l_linestatus = 'O' THEN l_linenumber END) <= min(CASE WHEN l_linestatus = 'F' THEN l_linenumber END), false) AS invalid FROM lineitem GROUP BY 1, 2""")
def arcs(t):
    at = lambda s: F.when(F.col("l_linestatus") == s, F.col("l_linenumber"))
    c = t("lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 3).alias("number")).agg(F.count(at("O")).alias("o"), F.count(at("F")).alias("f"), F.min(at("O")).alias("a"), F.min(at("F")).alias("b"))
    return c.select("l_orderkey", "number", (~F.coalesce((F.col("o") == 1) & (F.col("f") == 1) & (F.col("a") <= F.col("b")), F.lit(False))).alias("invalid"))


@query("WIN13_pr_curve", """SELECT doc_id, sum(quality) OVER w / row_number() OVER w AS precision, sum(quality) OVER w / sum(quality) OVER (PARTITION BY lang) AS recall FROM documents JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def pr_curve(t):
    rows = t("documents").select("doc_id", "lang", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id")
    o = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    w = o.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = F.sum("quality").over(Window.partitionBy("lang"))
    return rows.select("doc_id", (F.sum("quality").over(w) / F.row_number().over(o)).alias("precision"), S.safe_rate(F.sum("quality").over(w), every, None).alias("recall"))


@query("TOP1_ranking", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity < 45 DESC, l_extendedprice DESC, l_discount DESC, l_partkey, l_linenumber) AS rank FROM lineitem")
def ranking(t):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc(F.col("l_quantity") < 45), F.desc("l_extendedprice"), F.desc("l_discount"), "l_partkey", "l_linenumber")
    return t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.row_number().over(w).alias("rank"))


@query("TOP5_required_sample", "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY sha256('seed-5' || chr(0) || CAST(doc_id AS VARCHAR)), doc_id LIMIT 40) UNION SELECT doc_id FROM labels WHERE toxic = 1")
def required_sample(t):
    base = P.stable_sample(t("documents").select("doc_id"), F.col("doc_id").cast("string"), "seed-5", 40).select("doc_id")
    return base.unionByName(t("labels").where("toxic = 1").select("doc_id")).distinct()


@query("TOP10_cyclic_balance", "WITH n AS (SELECT source, count(*) AS n, max(count(*)) OVER () AS most FROM documents GROUP BY 1), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents) SELECT doc_id, CAST(most // n + CASE WHEN i < most % n THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r JOIN n USING (source)")
def cyclic(t):
    """How often cyclic repetition up to the largest source takes each row; rows are numbered, not repeated."""
    sizes = t("documents").groupBy("source").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("most", F.max("n").over(Window.partitionBy(F.lit(0))))
    i = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    rows = t("documents").select("doc_id", "source").withColumn("i", i).join(F.broadcast(sizes), "source")
    return rows.select("doc_id", (F.floor(F.col("most") / F.col("n")) + F.when(F.col("i") < F.col("most") % F.col("n"), 1).otherwise(0)).alias("copies"))


@query("TOP14_negatives_by_ratio", """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('seed-14' || chr(0) || CAST(doc_id AS VARCHAR)), doc_id) AS n FROM labels) SELECT doc_id FROM r WHERE quality = 1 OR n <= (SELECT round(0.1 * count(*)) FROM labels WHERE quality = 1)""")
def negatives(t):
    w = Window.partitionBy("quality").orderBy(F.sha2(S.keyed("seed-14", F.col("doc_id").cast("string")), 256), "doc_id")
    keep = t("labels").where("quality = 1").agg(F.round(0.1 * F.count("*")).alias("keep"))
    return t("labels").withColumn("n", F.row_number().over(w)).join(F.broadcast(keep)).where("quality = 1 or n <= keep").select("doc_id")


@query("TOP17_strict_margin", """SELECT l_orderkey, l_returnflag AS choice FROM (SELECT l_orderkey, l_returnflag, count(*) AS n, coalesce(lead(count(*)) OVER w, 0) AS nxt, row_number() OVER w AS k FROM lineitem GROUP BY 1, 2 WINDOW w AS (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_returnflag)) WHERE k = 1 AND n > nxt""")
def strict_margin(t):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("n"), "l_returnflag")
    c = t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    c = c.withColumn("k", F.row_number().over(w)).withColumn("nxt", F.coalesce(F.lead("n").over(w), F.lit(0)))
    return c.where("k = 1 and n > nxt").select("l_orderkey", F.col("l_returnflag").alias("choice"))


_SEEDED = "('0x' || substr(sha256('seed-1' || chr(0) || CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615.0"
_UNIT = "('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615.0"


@query("SET1_unit_hash", f"SELECT doc_id, {_UNIT} AS u FROM documents")
def unit(t):
    return t("documents").select("doc_id", S.unit_hash(F.col("doc_id").cast("string")).alias("u"))


@query("SET5_union_namespaced", "SELECT 'c-' || c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 's-' || s_suppkey, s_nationkey FROM supplier")
def union_namespaced(t):
    side = lambda n, p: t(n).select(F.concat(F.lit(f"{p}-"), F.col(f"{p}_{'cust' if p == 'c' else 'supp'}key").cast("string")).alias("id"), F.col(f"{p}_nationkey").alias("nation"))
    return side("customer", "c").unionByName(side("supplier", "s"))


@query("SET10_final_refit", f"SELECT doc_id, CASE WHEN u >= 0.1 AND u < 0.2 THEN 'diagnostic_test' ELSE 'train' END AS split FROM (SELECT doc_id, {_SEEDED} AS u FROM documents)")
def refit(t):
    rows = P.split_by_hash(t("documents").select("doc_id"), F.col("doc_id").cast("string"), "seed-1")
    return rows.select("doc_id", F.when(F.col("split") == "calibration", "diagnostic_test").otherwise("train").alias("split"))


@query("STR7_levenshtein", "SELECT c_custkey, CAST(levenshtein(c_name, c_mktsegment) AS INT) AS distance FROM customer")
def levenshtein(t):
    return t("customer").select("c_custkey", F.levenshtein("c_name", "c_mktsegment").alias("distance"))


@query("STR19_years", r"SELECT o_orderkey, CAST(y AS INT) AS year FROM (SELECT o_orderkey, unnest(list_distinct(list_filter(regexp_extract_all('ed. ' || (1780 + o_orderkey % 240) || ', no ' || o_orderkey || 'x1850', '[0-9]+'), lambda w: regexp_full_match(w, '1[89][0-9]{2}') AND CAST(w AS BIGINT) <= 1950))) AS y FROM orders)")
def years(t):
    text = F.concat(F.lit("ed. "), 1780 + F.col("o_orderkey") % 240, F.lit(", no "), F.col("o_orderkey"), F.lit("x1850"))
    return t("orders").select("o_orderkey", F.explode(S.year_candidates(text)).alias("year"))


@query("MTH1_sigmoid", "SELECT c_custkey, round(1 / (1 + exp(-greatest(-40, least(40, c_acctbal / 100)))), 9) AS p FROM customer")
def sigmoid(t):
    return t("customer").select("c_custkey", F.round(S.sigmoid(F.col("c_acctbal") / 100), 9).alias("p"))


@query("GEO7_affine", "SELECT p_partkey, 2.0 * p_size + 0.5 * p_retailprice + 3 AS x, -1.0 * p_size + 4.0 * p_retailprice - 2 AS y FROM part")
def affine(t):
    x, y = N.point_transform(F.col("p_size"), F.col("p_retailprice"), (2.0, -1.0, 0.5, 4.0, 3.0, -2.0))
    return t("part").select("p_partkey", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"))


@query("DAT1_retention", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retention(t):
    last = t("events").agg(F.max("ts").alias("last"))
    return t("events").join(F.broadcast(last)).where("ts >= last - interval 7 days").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


TREE = [{"feature": 0, "threshold": 24.5, "left": 1, "right": 2, "value": 0}, {"feature": -2, "threshold": 0, "left": -1, "right": -1, "value": 0.25}, {"feature": 1, "threshold": 1200.0, "left": 3, "right": 4, "value": 0}, {"feature": -2, "threshold": 0, "left": -1, "right": -1, "value": 0.5}, {"feature": -2, "threshold": 0, "left": -1, "right": -1, "value": 0.75}]


@query("SCORE3_tree", "SELECT p_partkey, CASE WHEN p_size <= 24.5 THEN 0.25 WHEN p_retailprice::FLOAT <= 1200 THEN 0.5 ELSE 0.75 END::DOUBLE AS value FROM part")
def tree(t):
    return t("part").select("p_partkey", N.tree_value(TREE, [F.col("p_size"), F.col("p_retailprice")]).alias("value"))


@query("SCORE7_ctc", """WITH s AS (SELECT vec_id, unnest(range(0, len(embedding) // 12)) AS i, embedding FROM embeddings), b AS (SELECT vec_id, i, list_position(embedding[12 * i + 1 : 12 * i + 12], list_max(embedding[12 * i + 1 : 12 * i + 12])) - 1 AS c FROM s),
  k AS (SELECT vec_id, i, c, lag(c) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM b)
SELECT vec_id, coalesce(string_agg(CAST(c AS VARCHAR), ' ' ORDER BY i) FILTER (c <> 11 AND c IS DISTINCT FROM p), '') AS decoded FROM embeddings LEFT JOIN k USING (vec_id) GROUP BY 1""")
def ctc(t):
    return t("embeddings").select("vec_id", F.array_join(N.greedy_ctc(F.col("embedding"), 12).cast("array<string>"), " ").alias("decoded"))


@query("SRC6_tokens", r"SELECT doc_id, kind, CAST(count(*) AS BIGINT) AS n, CAST(count(value) AS BIGINT) AS valued FROM (SELECT doc_id, split_part(w, '-', 1) AS kind, CASE WHEN contains(w, '-') THEN substr(w, instr(w, '-') + 1) END AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\t\n\x0B\f\r ]+')) AS w FROM documents)) GROUP BY 1, 2")
def token_counts(t):
    return tokens(t("documents"), "doc_id", "text").groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.count("value").alias("valued"))


@query("CLU1_suppression")
def suppression(t):
    """Boxes of one order and flag, best price first; depends on what was kept, so no SQL."""
    x, y = F.col("l_quantity"), F.col("l_linenumber") * 3.0
    rows = t("lineitem").select("l_orderkey", "l_returnflag", F.col("l_partkey").alias("item"), x.alias("x1"), y.alias("y1"), (x + 20).alias("x2"), (y + 9).alias("y2"), F.col("l_extendedprice").alias("score"))
    return C.suppress(rows, ["l_orderkey", "l_returnflag"], "item", ["x1", "y1", "x2", "y2"], "score", 0.3)


@query("CLU12_consensus_positions")
def consensus(t):
    """Clusters of an order's quantities by running median; depends on what came before, so no SQL."""
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("x"))
    return rows.select("l_orderkey", C.running_median_clusters(F.col("x"), 4.0).alias("clusters"))
