"""Label, detection, licence and record files as DataFrames, and their writers. Schemas are stated, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTIONS = "split string, image string, image_id string, source_key string, crop_xyxy array<int>, objects array<struct<category_id:string,label:int,box_xyxy:array<double>,page_box_xyxy:array<double>,source_object_id:string>>"
#: Columns of the licence table, in its own order (a file format).
LICENCE_COLUMNS = ["metadata", "mxl", "pdf", "license", "license_conflict", "subset:no_license_conflict", "subset:all_valid", "has_lyrics", "n_lyrics", "n_tracks", "tracks", "complexity", "n_notes", "n_annotations"]


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of tiles; a line that isn't such an object ends the job."""
    return spark.read.schema(DETECTIONS).option("mode", "FAILFAST").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """path, label of lines ``path<TAB>label``; empty lines are left out, a line without both parts ends the job."""
    line = F.regexp_replace("value", r"\r$", "")
    rows = spark.read.text(path).select(line.alias("line")).where("line <> ''")
    at = F.instr("line", "\t")
    good = (at > 1) & (F.length("line") > at)
    checked = F.when(good, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("malformed label: "), "line")).cast("string"))
    return rows.select(checked.alias("line")).select(F.substring_index("line", "\t", 1).alias("path"), F.expr("substring(line, instr(line, '\t') + 1)").alias("label"))


def write_labels(labels: DataFrame, path: str) -> None:
    """Lines ``path<TAB>label``; tabs and line breaks in either end the job, as they could not be read back."""
    bad = F.col("path").rlike("[\t\r\n]") | F.col("label").rlike("[\r\n]") | (F.col("path") == "") | (F.col("label") == "")
    line = F.when(~F.coalesce(bad, F.lit(True)), F.concat("path", F.lit("\t"), "label")).otherwise(F.raise_error(F.lit("a label that no line can hold")).cast("string"))
    labels.select(line.alias("value")).write.mode("overwrite").text(path)


def read_licences(spark: SparkSession, path: str) -> DataFrame:
    """The licence table as strings; a missing column is an error, others are kept."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    missing = [c for c in LICENCE_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return rows


def reference_records(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, value of lines ``!!!name: value``; a name's first value wins."""
    lines = df.select(key, F.posexplode(F.split(text, r"\r\n|[\n\r]")).alias("at", "line")).where("line like '!!!%:%'")
    parts = lines.select(key, "at", F.trim(F.expr("substring(substring_index(line, ':', 1), 4)")).alias("name"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    return parts.groupBy(key, "name").agg(F.min_by("value", "at").alias("value"))


def canonical_json(*columns: str) -> Column:
    """A JSON object with its keys in order of code points, nulls included."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def integrity_manifest(files: DataFrame, role: Column) -> DataFrame:
    """role, path, size, sha256 of files read as ``binaryFile``; the bundle's id is the digest of these in order of path."""
    return files.select(role.alias("role"), "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, problem (missing, resized, rehashed, duplicate, unlisted) of a manifest against files now."""
    now = integrity_manifest(files, F.lit("")).select("path", F.col("size").alias("size_now"), F.col("sha256").alias("sha_now"))
    listed = manifest.groupBy("path").agg(F.min("size").alias("size"), F.min("sha256").alias("sha256"), F.count("*").alias("n"))
    both = listed.join(now, "path", "full")
    problem = F.when(F.col("n").isNull(), "unlisted").when(F.col("n") > 1, "duplicate").when(F.col("sha_now").isNull(), "missing").when(F.col("size") != F.col("size_now"), "resized").when(F.col("sha256") != F.col("sha_now"), "rehashed")
    return both.select("path", problem.alias("problem")).where("problem is not null")
