"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Slot ``i`` of the mix is the point ``frac(i * golden ratio)``; the cumulative shares of the slots
that each source needs for its target cut [0, 1) into one interval a source, and the slot goes to
the source whose interval holds its point, so that every prefix of the mix is near the targets;
slots that a source still lacks after the last point are appended. A source's documents, shuffled by a keyed
hash, lie end to end as one stream of words, cut into blocks of ``block`` words; the source's
``r``-th slot takes its ``r``-th block, starting over after the last one, until the source's
target is reached. What a document gives is what slots take of its range of the stream.

A target stops at ``most`` times its source's size; the excess goes to the others by weight.

Defined cases: null or empty text has size 0 and gives nothing; a null source is a source of its
own, last in order; null doc_id sorts first in the shuffle; repeated rows are rows like others
(rows alike in every column are ordered among themselves by a running number, which changes no
result as they are alike); an empty table gives no row; sources without words have target 0.
Columns of the input other than the named ones are kept by ``mix``'s row variant only.

Skew: the rows of a source are summed in two levels (pieces of the shuffle key, then rows within
a piece), slots in pieces of consecutive numbers; no task gets a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import WORD_PATTERN, Scratch, forget, partitions, prefix_sums

GOLDEN = 0.6180339887498949
CELLS = 4096  # grid on which points meet the sources' intervals


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: int = 3, share: float = 1.0) -> DataFrame:
    """``sizes``: source, source_size, one row a source. Adds weight (1, 2, 3 repeating) and target.

    Filling water to a level: sources whose limit lies below the level stop at it. Sorted by limit
    over weight, the first k stop, for the smallest k at which the next one's limit is above the
    level of the rest. Exact in longs but for one division.
    """
    one = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last()))
    s = sizes.withColumn("n", rank).withColumn("weight", (F.col("n") - 1) % 3 + 1).withColumn("limit", F.col("source_size") * most)
    s = s.withColumn("ratio", F.col("limit") / F.col("weight"))
    upto = one.orderBy("ratio", "n").rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("all_size", F.sum("source_size").over(one))
        .withColumn("all_weight", F.sum("weight").over(one))
        .withColumn("stopped", F.coalesce(F.sum("limit").over(upto), F.lit(0)))
        .withColumn("stopped_weight", F.coalesce(F.sum("weight").over(upto), F.lit(0)))
        .withColumn("level_here", (F.col("all_size") * F.lit(share) - F.col("stopped")) / (F.col("all_weight") - F.col("stopped_weight")))
    )
    s = s.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level_here"), F.struct("ratio", "n", "level_here"))).over(one)["level_here"])
    target = F.when(F.col("ratio") <= F.coalesce("level", F.lit(float("inf"))), F.col("limit").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return s.select("source", F.col("n").alias("source_no"), "source_size", "weight", target.alias("target"))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """source_no, id, r (rank of the slot in its source), for slots until every source has reached its target.

    Sources share the points by the slots they need, so that all finish together although last
    blocks are broken. What the points leave missing of a source follows after them, in turns.
    """
    spark = targets.sparkSession
    goal = F.floor("target").cast("long")
    t = targets.where("source_size > 0").select("source_no", "source_size", goal.alias("goal"))
    full, rest = F.expr("goal div source_size"), F.col("goal") % F.col("source_size")
    t = t.withColumn("need", (full * F.ceil(F.col("source_size") / F.lit(block)) + F.ceil(rest / F.lit(block))).cast("long")).where("need > 0").select("source_no", "need")
    needed, sources, highest = t.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*"), F.coalesce(F.max("source_no"), F.lit(0))).first()
    one = Window.partitionBy(F.lit(0)).orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("need").over(one)
    scratch = Scratch(spark, "schedule")  # steps of their own: one plan would hold each of them up to six times
    t = scratch.save(t.withColumn("hi", upto / F.lit(needed)).withColumn("lo", (upto - F.col("need")) / F.lit(needed)), "needs")
    cells = t.select("source_no", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.col("hi") * CELLS))).alias("cell"))
    # A source of share p gets p * n + O(log n) of n slots.
    n = int(needed * 1.02) + 64 * (sources + 1)
    point = F.col("id") * F.lit(GOLDEN) - F.floor(F.col("id") * F.lit(GOLDEN))
    slots = spark.range(0, n, 1, partitions(targets)).withColumn("u", point).withColumn("cell", F.floor(F.col("u") * CELLS))
    slots = slots.join(cells, "cell").where("u >= lo and u < hi").select("source_no", "id")
    ranked = prefix_sums(slots, [F.col("source_no")], F.floor(F.col("id") / 4096), [F.col("id")], {"r": F.lit(1).cast("long")})
    ranked = scratch.save(ranked.select("source_no", "id", "r"), "ranked")
    t = t.select("source_no", "need")
    got = t.join(ranked.groupBy("source_no").agg(F.count("*").alias("got")), "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long")))
    ranked = ranked.join(t, "source_no").where("r < need").select("source_no", "id", "r")
    missing = got.where("got < need").select("source_no", "got", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("r"))
    after = F.lit(n) + (F.col("r") - F.col("got")) * (highest + 1) + F.col("source_no")
    return ranked.unionByName(missing.select("source_no", after.cast("long").alias("id"), "r"))


def mix(docs: DataFrame, block: int = 1024, most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, and ``takes``: words taken from the document's start by each pass over its source.

    ``keep``: the input's columns come along, in a struct ``row``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    shuffled = F.md5(F.concat_ws("\x00", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), shuffled.alias("key"), F.monotonically_increasing_id().alias("at"), *([F.struct(*docs.columns).alias("row")] if keep else []),
    )
    rows = scratch.save(rows, "rows")  # with each row's number, which stays what it is
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = scratch.save(source_targets(sizes, most).withColumn("goal", F.floor("target").cast("long")), "targets")
    # The targets have a row for each source; AQE broadcasts them by their measured size.
    t = targets.select(F.col("source").alias("__source"), "source_no", "source_size", "target", "goal")
    light = rows.join(t, rows["source"].eqNullSafe(t["__source"])).drop("__source")
    ranged = prefix_sums(
        light.drop("row"), [F.col("source_no")], F.substring("key", 1, 3), [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("at")], {"start": F.col("size")}
    )
    ranged = scratch.save(ranged.drop("key", "source"), "ranged")
    # Slots: the block they read and how many words of it, until the goal.
    slots = schedule(targets, block).join(targets.select("source_no", "source_size", "goal"), "source_no")
    blocks = F.ceil(F.col("source_size") / F.lit(block))
    slots = (
        slots.where("source_size > 0")
        .withColumn("pass", F.floor(F.col("r") / blocks))
        .withColumn("block_no", F.col("r") % blocks)
        .withColumn("before", F.col("pass") * F.col("source_size") + F.col("block_no") * block)
        .withColumn("words", F.least(F.lit(block), F.col("source_size") - F.col("block_no") * block, F.col("goal") - F.col("before")))
        .where("words > 0")
        .select("source_no", "block_no", "pass", "words")
    )
    slots = scratch.save(slots, "slots")  # a row a block; else one plan of all would take the driver's memory
    forget(spark)
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = ranged.where("size > 0").select("at", "source_no", "start", "size", F.explode(F.sequence(first, last)).alias("block_no"))
    begin = F.greatest(F.col("start") - F.col("block_no") * block, F.lit(0))
    end = F.least(F.col("start") + F.col("size") - F.col("block_no") * block, F.col("words"))
    taken = (
        pieces.join(slots.hint("merge"), ["source_no", "block_no"])  # small as a file, not in memory
        .select("at", "pass", F.greatest(end - begin, F.lit(0)).alias("words"))
        .groupBy("at", "pass").agg(F.sum("words").alias("words"))
        .where("words > 0")
        .groupBy("at").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("pass", "words"))).alias("takes"))
    )
    out = ranged.join(taken, "at", "left")
    if keep:
        out = out.join(rows.select("at", "row"), "at")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "takes", *(["row"] if keep else []))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the input's columns: a row for each pass over a document, cut to the words taken.

    A whole document keeps its text unchanged; a document cut by the end of its source's target (at
    most one a source) keeps its first words, joined by one space. n_chars follows the text.
    """
    m = mix(docs, keep=True, **options)
    text_col = options.get("text_col", "text")
    m = m.select("size", "row", F.explode("takes").alias("take"))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(f"({WORD_PATTERN})")), F.lit(1), F.col("take.words").cast("int")), " ")
    text = F.when(F.col("take.words") == F.col("size"), F.col(f"row.{text_col}")).otherwise(cut)
    out = {c: F.col(f"row.{c}") for c in docs.columns} | {text_col: text}
    if "n_chars" in out:
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return m.select(*[v.alias(k) for k, v in out.items()])


def op6_mixing(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).drop("takes")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix' || chr(0) || CAST(doc_id AS VARCHAR)) AS key FROM documents
), z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM z
), l AS (
  SELECT *, 3 * source_size / weight AS ratio, 3 * source_size AS lim FROM w
), k AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level_here
  FROM l WINDOW o AS (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN ratio <= coalesce((SELECT arg_min(level_here, ratio) FROM k WHERE ratio >= level_here), 'inf'::DOUBLE) THEN CAST(lim AS DOUBLE)
    ELSE (SELECT arg_min(level_here, ratio) FROM k WHERE ratio >= level_here) * weight END AS target FROM k
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS goal,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id) - d.size AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - source_size - start)) + greatest(0, least(size, goal - 2 * source_size - start)) AS taken
FROM p
"""
