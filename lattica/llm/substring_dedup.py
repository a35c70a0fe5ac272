"""Substring dedup over a log-structured index of window fingerprints.

Documents arrive in batches of ascending doc_id. Every window of ``WINDOW`` words is fingerprinted
by the least hash among its ``GRAM``-word pieces, so that equal windows have equal fingerprints and
neighbouring windows mostly share one: the index holds about a quarter as many entries as there
are words. A batch's fingerprints become an immutable run, sorted by hash in buckets; it is
merge-joined, bucket by bucket and without a shuffle, with the runs of earlier batches. Two runs of
one level are compacted into one of the next before the next batch comes, so that a batch meets a
logarithmic number of runs. Each run keeps the smallest and largest doc_id of a hash.

Fingerprints that two documents have are only candidates. All windows under them are verified:
grouped by two 64-bit hashes of their whole word sequence, made of independent hashes of the words,
and each one that a smaller doc_id starts is a repeat; the smallest is an aggregate, so that copies
of one window are combined before they move. The filter on the way from candidates to windows
is a Bloom filter of bounded size; what it lets through in error, verification removes.

Documents with equal words are compacted first: only the smallest doc_id is indexed, and every
other one is a repeat from end to end (unless shorter than a window).

Defined cases: null or empty text has no words (0, 0, digest of the empty string); repeated rows
have the same doc_id, which isn't smaller, so neither removes from the other; rows of one doc_id
with different texts are judged each by itself, and neither removes from the other; null doc_id comes
first in order, as smaller than any other; texts shorter than a window lose nothing; an empty table
gives no row; other columns are not read. Very long texts and words are read whole.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, map_batches, partitions
from lattica.llm.words import mixed, rolled, word_hashes

WINDOW, GRAM = 13, 6
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_BLOOM_BITS = 1 << 29  # 64 MB at most
_PROBES = 4


def window_fingerprints(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For each window the least hash of its pieces."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    h, span, have = rolled(words, gram), window - gram + 1, 1
    while have < span:  # minima over 1, 2, 4, ... pieces
        step = min(have, span - have)
        h = np.minimum(h[: len(h) - step], h[step:])
        have += step
    return h


def _measuring(batches):
    for batch in batches:
        counts, digests = [], []
        for text in batch.column(2).to_pylist():
            words = text.split() if text else []
            counts.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts, pa.int64()), pa.array(digests)], names=["doc_id", "t", "n_words", "sha256"])


def _fingerprinting(batches):
    for batch in batches:
        found = [np.unique(window_fingerprints(w)) for w in word_hashes(batch.column(2).to_pylist())]
        ids = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)), pa.array(ids)], names=["h", "doc_id"])


class FingerprintIndex:
    """Sorted immutable runs (h, lo, hi), bucketed by h, in levels."""

    def __init__(self, scratch: Scratch, buckets: int):
        self.scratch, self.spark, self.buckets, self.runs = scratch, scratch.spark, buckets, []  # (level, table)

    def _write(self, df: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "h").sortBy("h").option("path", self.scratch.path(name)).option("compression", "zstd").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def compact(self) -> None:
        """Merges the two newest runs while they are of one level."""
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            (level, x), (_, y) = self.runs[-2:]
            a, b = self.spark.table(x).alias("a"), self.spark.table(y).alias("b")
            both = a.join(b, F.col("a.h") == F.col("b.h"), "full")
            merged = both.select(F.coalesce("a.h", "b.h").alias("h"), F.least("a.lo", "b.lo").alias("lo"), F.greatest("a.hi", "b.hi").alias("hi"))
            self.runs[-2:] = [(level + 1, self._write(merged))]
            self._drop(x)
            self._drop(y)

    def add(self, fingerprints: DataFrame) -> DataFrame:
        """Adds a batch (h, doc_id) as a run; returns the hashes that it shares, within itself or with earlier runs."""
        self.compact()
        rows = fingerprints.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        name = self._write(rows)
        new = self.spark.table(name)
        shared = new.where("lo < hi").select("h")
        for _, old in self.runs:
            shared = shared.unionByName(new.join(self.spark.table(old), "h").select("h"))
        self.runs.append((0, name))
        return shared

    def close(self) -> None:
        for _, name in self.runs:
            self._drop(name)
        self.runs = []


def _bits_of(h: np.ndarray, bits: int):
    for k in range(_PROBES):
        yield (mixed(h + np.uint64(k * int(_SECOND) % (1 << 64))) & np.uint64(bits - 1)).astype(np.int64)


def _filtering(bits: int):
    """One bitmap a task, packed, in pieces of 1 MB."""

    def run(batches):
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _bits_of(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(bitmap, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        packed, size = bitmap.tobytes(), 1 << 20
        for i in range(0, len(packed), size):
            yield pa.RecordBatch.from_arrays([pa.array([i // size], pa.int32()), pa.array([packed[i : i + size]], pa.binary())], names=["piece", "bits"])

    return run


def _merging(batches):
    """Joins bitmaps by piece; rows come sorted by piece."""
    piece, total = None, None
    for batch in batches:
        for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            new = np.frombuffer(data, np.uint8)
            if p == piece:
                total = total | new
                continue
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["piece", "bits"])
            piece, total = p, new
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["piece", "bits"])


def bloom_of(hashes: DataFrame, most_bits: int = _BLOOM_BITS) -> np.ndarray:
    """A packed Bloom filter of 16 bits a hash, at most ``most_bits``."""
    n = hashes.count()
    bits = min(most_bits, 1 << max(16, (16 * n).bit_length()))
    tasks = max(1, min(partitions(hashes), n // 100_000 + 1))
    pieces = map_batches(hashes.repartition(tasks), _filtering(bits), "piece int, bits binary")
    whole = map_batches(pieces.repartition(max(1, bits >> 23), "piece").sortWithinPartitions("piece"), _merging, "piece int, bits binary")
    got = sorted(whole.collect())  # most_bits / 8 bytes in all
    return np.frombuffer(b"".join(r["bits"] for r in got), np.uint8) if got else np.zeros(bits // 8, np.uint8)


def _windowing(bloom_of_shared):
    """Windows whose fingerprint may be shared: two hashes of their words, document and place."""

    def run(batches):
        bloom = bloom_of_shared.value
        bits = len(bloom) * 8
        for batch in batches:
            one, two, ids, names, places = [], [], [], [], []
            texts = batch.column(2).to_pylist()
            for doc, t, text, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, word_hashes(texts), strict=True):
                f = window_fingerprints(words)
                keep = np.ones(len(f), bool)
                for at in _bits_of(f, bits):
                    keep &= (bloom[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                at = np.flatnonzero(keep)
                if len(at):
                    one.append(rolled(words, WINDOW)[at])
                    two.append(rolled(word_hashes([text], seed=1)[0], WINDOW, _SECOND)[at])
                    ids.append(np.full(len(at), doc, np.int64))
                    names.append(np.full(len(at), t, np.int64))
                    places.append(at.astype(np.int32))
            if one:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([x.view(np.int64) for x in one], [x.view(np.int64) for x in two], ids, names, places)], names=["w1", "w2", "doc_id", "t", "at"])

    return run


def covered(n: int, starts, window: int = WINDOW) -> np.ndarray:
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, np.asarray(starts, np.int64), 1)
    np.add.at(marks, np.asarray(starts, np.int64) + window, -1)
    return np.cumsum(marks[:-1]) > 0


def _removing(with_text: bool):
    def run(batches):
        for batch in batches:
            removed, digests, texts = [], [], []
            for text, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                gone = covered(len(words), starts)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept if with_text else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(digests), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "t", "n_removed", "kept_sha256", "kept"])

    return run


def _few(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Broadcast behind a count of the rows (16 bytes each); else a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def dedup(docs: DataFrame, batches: int = 4, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and kept (the text left of a document that lost words) if asked for."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"))
    row = ["doc_id", "t"]  # a row's name: rows alike in it are repeated rows
    measured = scratch.save(map_batches(docs, _measuring, "doc_id long, t long, n_words long, sha256 string"), "measured")
    first = measured.where(f"n_words >= {WINDOW}").groupBy("sha256").agg(F.min("doc_id").alias("first_id"))
    measured = scratch.save(measured.join(first, "sha256", "left").withColumn("copy", F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))).drop("first_id"), "classes")
    scratch.drop("measured")
    short_or_copy = measured.where(f"copy or n_words < {WINDOW}").select(*row).distinct()
    texts = docs.join(_few(short_or_copy), row, "left_anti").select(*row, "text")
    edges = sorted(set(measured.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.001)))
    index, shared = FingerprintIndex(scratch, partitions(docs)), None
    for i, (lo, hi) in enumerate(zip([None, *edges], [*edges, None], strict=True)):
        batch = texts if lo is None else texts.where(F.col("doc_id") > int(lo))
        batch = batch if hi is None else batch.where(F.col("doc_id") <= int(hi))
        new = scratch.save(index.add(map_batches(batch, _fingerprinting, "h long, doc_id long")), f"shared{i}")
        shared = new if shared is None else shared.unionByName(new)
    bloom = spark.sparkContext.broadcast(bloom_of(shared))
    index.close()
    windows = scratch.save(map_batches(texts, _windowing(bloom), "w1 long, w2 long, doc_id long, t long, at int"), "windows")
    heads = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    heads = scratch.save(heads, "heads")  # so that the join reads two plain shuffles, which adaptive execution can split where a window is hot
    repeats = windows.join(heads, ["w1", "w2"]).where("doc_id > first_id").groupBy(*row).agg(F.collect_set("at").alias("starts"))
    repeats = scratch.save(repeats, "repeats")
    scratch.drop("windows", "heads", *[f"shared{i}" for i in range(len(edges) + 1)])
    hit = texts.join(_few(repeats.select(*row)), row, "left_semi").dropDuplicates(row)
    cut = map_batches(hit.join(repeats, row).select(*row, "text", "starts"), _removing(with_text), "doc_id long, t long, n_removed long, kept_sha256 string, kept string")
    out = measured.join(cut, row, "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.when(F.col("doc_id") != F.lit(-(2**63)), F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        *([F.when(F.col("copy"), "").otherwise(F.col("kept")).alias("kept")] if with_text else []),
    )


def op1_substring_dedup(spark, sf_dir):
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13
), s AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM g
), f AS (SELECT s, min(doc_id) AS first_id FROM s GROUP BY s
), c AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT s.doc_id, unnest(range(i, i + 13)) AS p FROM s JOIN f USING (s) WHERE s.doc_id > first_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE array_to_string([w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(ps, k)], ' ') END) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id)
"""
