"""Shared helpers: intermediate tables in the cluster's shared folder, prefix sums, Arrow batches."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as every contract of this subpackage defines it, is \x20 and \x09-\x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lattica-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_remove_quietly, spark, found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter does
        pass


class Scratch:
    """Tables of one operator call in the shared folder, so that a lost executor costs one stage.

    ``save`` writes and rereads a table, ``drop`` deletes one that is no longer needed; what is
    left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        bound_arrow(spark)
        atexit.register(_remove_quietly, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        # Without a marker of success: nobody waits for it, and each file made takes the driver a process where Hadoop has no native library.
        df.write.mode("overwrite").option("compression", compression).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))

    def keep_only(self, *names: str) -> None:
        """Deletes all tables but these."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.root)
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
        self.drop(*[name for name in (f.getPath().getName() for f in found) if name not in names])


def forget(spark: SparkSession) -> None:
    """Lets the driver drop plans, broadcasts and shuffles (with their files) of steps that are done; else they stay until its heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bound_arrow(spark: SparkSession) -> None:
    """Arrow batches of at most 2,000 rows or 16 MB, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def partitions(df: DataFrame) -> int:
    """Partitions for a shuffle of this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(df: DataFrame, group: list[Column], part: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Exclusive running sums over rows in (group, part, order), in two levels.

    ``part`` cuts a group into pieces in ascending order; only totals of pieces meet in one place
    per group, so a hot group's rows spread over as many tasks as it has pieces. Adds the columns
    named in ``sums``.
    """
    names = [f"__g{i}" for i in range(len(group))]
    df = df.withColumns(dict(zip(names, group, strict=True)) | {"__part": part} | {f"__v_{k}": v for k, v in sums.items()})
    key = [*names, "__part"]
    totals = df.groupBy(*key).agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    before = Window.partitionBy(*names).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"__o{k}") for k in key], *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums])
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({f"__w_{k}": F.coalesce(F.sum(f"__v_{k}").over(inside), F.lit(0)) for k in sums})
    on = [rows[k].eqNullSafe(offsets[f"__o{k}"]) for k in key]
    joined = rows.join(offsets, on, "left")
    keep = [c for c in df.columns if not c.startswith("__")]
    return joined.select(*keep, *[(F.col(f"__w_{k}") + F.col(f"__b_{k}")).alias(k) for k in sums])
