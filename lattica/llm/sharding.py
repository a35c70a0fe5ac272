"""Sharding by bytes: global prefix sums of row sizes, cut at equal targets into contiguous shards.

Rows get one total order: groups of equal texts by their smallest doc_id, then doc_id. Sizes are
summed per partition, the totals give each partition's start, and a row's shard is where the
middle of its byte range falls among ``shards`` equal targets. A group no larger than the largest
row, or a fiftieth of a target, moves as one unit by its own middle, so that equal texts share a
shard; a larger group (it may hold a third of all rows) is cut between rows like any others, into
consecutive shards.

Defined cases: null text counts no bytes and has the crc of an empty text (0), and null texts are
no group (each stands for itself); null doc_id sorts first; repeated rows are rows like others,
in any order among themselves; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, partitions, prefix_sums

ROW_OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, size, text_crc32, law, shard, slot, grown_shard; order_key columns follow."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.col(text_col).cast("binary")
    rows = scratch.save(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            F.when(text.isNotNull(), F.sha2(text, 256)).alias("digest"),
        ),
        "rows",
    )
    groups = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.sum("size").alias("group_size"), F.count("*").alias("n")).where("n > 1").drop("n")
    total, largest = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    target = max(1.0, total / shards)
    unit = int(max(largest, target / 50))
    keyed = rows.join(groups, "digest", "left").select(
        "doc_id", "size", "text_crc32",
        F.when(F.col("group_size").isNotNull(), F.col("first_id")).otherwise(F.col("doc_id")).alias("first_id"),
        F.when(F.col("group_size") <= unit, F.col("group_size")).alias("unit_size"),
        F.coalesce("digest", F.lit("")).alias("digest"),
    )
    # Written in global order: pieces are then ranges of the order, whatever task reads them later.
    order = [F.col(c).asc_nulls_first() for c in ("first_id", "digest", "doc_id")]
    ordered = scratch.save(keyed.repartitionByRange(partitions(docs), *order, F.col("text_crc32"), F.xxhash64("doc_id", "size", F.rand(7))).withColumn("piece", F.spark_partition_id()), "ordered")
    scratch.drop("rows")
    placed = prefix_sums(ordered, [F.lit(0)], F.col("piece"), order, {"start": F.col("size"), "index": F.lit(1).cast("long")})
    # A unit's start is its first row's; a range boundary may run through a unit, so take the smallest over all its rows.
    units = placed.where("unit_size is not null").groupBy("digest").agg(F.min("start").alias("unit_start"))
    placed = scratch.save(placed.join(units, "digest", "left"), "placed")
    scratch.drop("ordered")
    middle = F.coalesce(F.col("unit_start") + F.col("unit_size") / 2, F.col("start") + F.col("size") / 2)
    sharded = placed.withColumn("shard", F.least(F.floor(middle / F.lit(target)), F.lit(shards - 1)).cast("int"))
    firsts = sharded.groupBy("shard").agg(F.min("index").alias("first_index"))  # one row a shard
    return sharded.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("index") - F.col("first_index")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "first_id",
    )


def op5_sharding(spark, sf_dir):
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("first_id")


SQL = r"""
WITH r AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, text, count(*) OVER (PARTITION BY text) AS n,
    CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS first_id,
    sum(octet_length(encode(coalesce(text, ''))) + 16) OVER (PARTITION BY text) AS group_size
  FROM documents
), t AS (SELECT sum(size) / 40.0 AS target, max(size) AS largest FROM r
), p AS (
  SELECT *, sum(size) OVER (ORDER BY first_id, doc_id) - size AS start, row_number() OVER (ORDER BY first_id, doc_id) AS i,
    text IS NOT NULL AND n > 1 AND group_size <= greatest(largest, target / 50) AS is_unit
  FROM r, t
), s AS (
  SELECT *, CAST(least(floor(CASE WHEN is_unit THEN min(start) OVER (PARTITION BY first_id) + group_size / 2.0 ELSE start + size / 2.0 END / target), 39) AS INT) AS shard
  FROM p
)
SELECT doc_id, CAST(size AS BIGINT) AS size, 'bytes' AS law, shard, CAST(i - min(i) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM s
"""
