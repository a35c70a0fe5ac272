"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against all documents.

Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. A window is
``n`` consecutive words of a test item; an item of fewer words, but not none, is one window of its
own length. Documents are scanned once: words that no item has cut the scan into short runs, a
rolling hash of word numbers finds possible windows, and the exact word sequence verifies each.

The set is broadcast in slices of at most ``slice_bytes`` of item text (items are dealt to slices
by hash; a single longer item has a slice of its own). One slice is the usual case; with more, the
documents are scanned slice after slice, each pass adding to the marks that the last one left.

Defined cases: null text has no words (n_words 0, no hit) and a null item text no window; null
ids pass through (items of null item_id hit and count as one item, which the digest leaves out); repeated rows are judged each for itself; equal
windows of several items count for each; an empty document table gives no row, an empty benchmark
no hit. Other columns of the documents come along unchanged.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import Scratch, bound_arrow, map_batches

#: Every byte that ends a word becomes a space, A-Z become a-z; bytes from 0x80 on are kept.
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def _rolled(ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    for k in range(length):
        h = h * _FACTOR + ids[starts + k].astype(np.uint64) + np.uint64(1)
    return h


class NGramIndex:
    """The windows of some test items, by length."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, set[str | None]]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int32)
            length = min(n, len(words))
            found = self.windows.setdefault(length, {})
            for i in range(len(words) - length + 1):
                found.setdefault(ids[i : i + length].tobytes(), set()).add(item)
        self.hashes = {}
        for length, found in self.windows.items():
            ids = np.frombuffer(b"".join(found), np.int32)
            self.hashes[length] = np.unique(_rolled(ids, np.arange(len(found)) * length, length))

    def scan(self, ids: np.ndarray):
        """(start, length, items) of each occurrence; a negative number is a word of no item."""
        bad = np.concatenate(([0], np.cumsum(ids < 0)))
        for length, hashes in self.hashes.items():
            if len(ids) < length:
                continue
            starts = np.flatnonzero(bad[length:] == bad[:-length])
            h = _rolled(ids, starts, length)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = self.windows[length]
            for i in starts[hashes[at] == h].tolist():
                if items := known.get(ids[i : i + length].tobytes()):
                    yield i, length, items


def _scanner(index, text_at: int):
    """Adds to each row __n_words, __hits (a bit a word, packed) and __items."""

    def scan(batches):
        got = index.value
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            old_hits, old_items = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            words = [words_of(t) for t in texts]
            counts = np.array([len(w) for w in words], np.int64)
            ends = np.cumsum(counts + 1)  # a separator after each document
            ids = np.full(int(ends[-1]) if len(ends) else 0, -1, np.int32)
            for w, end in zip(words, ends, strict=True):
                ids[end - 1 - len(w) : end - 1] = np.fromiter(map(got.vocabulary.get, w, repeat(-1)), np.int32, len(w))
            marks = np.zeros(len(ids) + 1, np.int32)
            items: dict[int, set[str | None]] = {}
            for start, length, found in got.scan(ids):
                marks[start] += 1
                marks[start + length] -= 1
                items.setdefault(int(np.searchsorted(ends, start, side="right")), set()).update(found)
            covered = np.cumsum(marks[:-1]) > 0
            hits, names = [], []
            for k, (end, count) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                if k in items:
                    bits = covered[end - 1 - count : end - 1]
                    if old_hits[k] is not None:
                        bits = bits | np.unpackbits(np.frombuffer(old_hits[k], np.uint8), count=count).astype(bool)
                    hits.append(np.packbits(bits).tobytes())
                    names.append(sorted(items[k] | set(old_items[k] or ()), key=lambda x: (x is None, x)))
                else:
                    hits.append(old_hits[k])
                    names.append(old_items[k])
            columns = [*batch.columns[:-3], pa.array(counts, pa.int64()), pa.array(hits, pa.binary()), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return scan


def scan_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, slice_bytes: int = 8 << 20, text_col: str = "text") -> DataFrame:
    """The documents with __n_words, __hits (null: no word is hit; else a bit a word) and __items (null: none)."""
    spark = docs.sparkSession
    bound_arrow(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-size // slice_bytes))
    out = docs.withColumns({"__n_words": F.lit(0).cast("long"), "__hits": F.lit(None).cast("binary"), "__items": F.lit(None).cast("array<string>")})
    schema = T.StructType([*docs.schema.fields, *[T.StructField(k, t) for k, t in (("__n_words", T.LongType()), ("__hits", T.BinaryType()), ("__items", T.ArrayType(T.StringType())))]])
    scratch = Scratch(spark, "decontaminate")
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        rows = [(r["item_id"], r["text"]) for r in part.collect()]  # about slice_bytes
        index = spark.sparkContext.broadcast(NGramIndex(rows, n))
        out = map_batches(out, _scanner(index, docs.columns.index(text_col)), schema)
        if slices > 1:
            out = scratch.save(out, f"slice{k}")
            if k:
                scratch.drop(f"slice{k - 1}")
    return out


def _counted(batches):
    for batch in batches:
        hits = [0 if h is None else int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) for h in batch.column(2).to_pylist()]
        items = batch.column(3).to_pylist()
        digests = [hashlib.sha256(",".join(i for i in x or () if i is not None).encode()).hexdigest() for x in items]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(hits, pa.int64()), pa.array([len(x or ()) for x in items], pa.int64()), pa.array(digests), pa.array([h > 0 for h in hits])],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row a document: n_words, n_hit, n_items, items_sha256, contaminated."""
    scanned = scan_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, **options)
    return map_batches(scanned.select("doc_id", "__n_words", "__hits", "__items"), _counted, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _cutter(text_at: int, chars_at: int | None):
    def cut(batches):
        import re

        word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
        for batch in batches:
            texts, hits = batch.column(text_at).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            out = []
            for text, h in zip(texts, hits, strict=True):
                if h is None or text is None:
                    out.append(text)
                    continue
                bits = np.unpackbits(np.frombuffer(h, np.uint8))
                kept, last = [], 0
                spans = [(m.start(), m.end()) for m in word.finditer(text)]
                i = 0
                while i < len(spans):
                    if bits[i]:
                        j = i
                        while j + 1 < len(spans) and bits[j + 1]:
                            j += 1
                        kept.append(text[last : spans[i][0]])
                        last = spans[j][1]
                        i = j
                    i += 1
                out.append(b"".join([*kept, text[last:]]))
            new = pa.array(out, pa.binary()).cast(pa.string())
            columns = list(batch.columns[:-1])
            columns[text_at] = new
            if chars_at is not None:
                columns[chars_at] = pa.array([None if t is None else len(t.decode()) for t in out], batch.schema.types[chars_at])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return cut


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, how: str = "documents", **options) -> DataFrame:
    """The input's columns. how: 'documents' drops every document with a hit; 'spans' cuts the hit words, from the first to the last of each run, out of its text."""
    scanned = scan_documents(docs, benchmark, **options)
    if how == "documents":
        return scanned.where("__hits is null").select(*docs.columns)
    text_col = options.get("text_col", "text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return map_batches(scanned.select(*docs.columns, "__hits"), _cutter(docs.columns.index(text_col), chars_at), docs.schema)


def op10_decontamination(spark, sf_dir):
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), bi AS (
  SELECT item_id, least(10, len(w)) AS n, unnest([array_to_string(w[i : i + least(10, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(10, len(w)) + 2)]) AS win FROM bw WHERE len(w) > 0
), wins AS (SELECT DISTINCT n, win FROM bi
), dl AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM bi)
), hit AS (
  SELECT d.doc_id, d.i, d.n, wins.win FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM dl) d JOIN wins ON d.n = wins.n AND d.win = wins.win
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit JOIN bi ON hit.n = bi.n AND hit.win = bi.win) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""
