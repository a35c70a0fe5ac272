"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Features of a text are its words and word pairs (a word after itself is one feature, whatever the
word), hashed to ``buckets``. The target model is fitted to labelled documents of good quality
that aren't toxic. The raw model counts every document, whole. Raw text is the mixture of that model
and of one for each combination of labels, weighted by their shares: junk and abuse leave different
traces, and one bag of words for all raw text would hide a few abusive words under many ordinary
ones; what is like no labelled kind is left to the raw model. A document's weight is the
ratio of the two models times the target's share, which is also the probability that the document
is from the target. Gumbel noise makes the k largest perturbed log weights a sample without
replacement in proportion to the weights. k is the expected number of target documents, the sum of
all documents' weights, unless given.

Models of labels are fitted on at most ``fit_rows`` labelled documents (the smallest by hash of
their id; a documented bound), all else is computed over every document and whole texts. Models are
by language for the ``languages`` most frequent ones, and one for all others, each smoothed with
what the other languages' labels show.

Defined cases: null or empty text has log weight 0, as all models give it the same probability,
and null doc_id counts as any other id; a doc_id labelled more than once is toxic if any label
says so and good only if all do; null labels are left out; without labels, or without target rows
among them, all weights are 1 and all rows are kept; rows tied at the threshold are kept, repeated
rows thus share their fate; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import Scratch, bound_arrow, map_batches
from lattica.llm.words import mixed, word_hashes

_PAIR, _REPEAT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x5851F42D4C957F2D)


def features(words: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each word, in the lower half of the buckets, then of each pair, in the upper half."""
    pairs = mixed(words[:-1] * _PAIR + words[1:])
    pairs[words[:-1] == words[1:]] = _REPEAT
    half = np.uint64(buckets // 2)
    return np.concatenate((words % half, pairs % half + half)).astype(np.int64)


def _counting(buckets: int, kinds: int):
    """Sums of a task, in rows of place (kind * buckets + bucket) and n."""

    def run(batches):
        total = np.zeros((kinds, buckets), np.int64)
        for batch in batches:
            of = batch.column(0).to_numpy()
            found = [features(words, buckets) for words in word_hashes(batch.column(1).to_pylist())]
            for kind in np.unique(of):
                total[kind] += np.bincount(np.concatenate([found[i] for i in np.flatnonzero(of == kind)]), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], names=["at", "n"])

    return run


class RatioModel:
    """Log ratios of bucket probabilities, by language: of each kind to the labelled sample, and of the sample to raw text, shrunk to 0.

    ``raw``: counts over all documents of a language, labelled or not; a text's own words are taken
    out of them when it is weighed, as it would be likely under itself. The second ratio is the same
    for all kinds and sets them against raw text as a part of the mixture of its own, for what is
    like no labelled kind; no label of n having shown such a text, its share is 1 / (n + 1).
    Languages are told apart as their shares differ between kinds: every word of a text would
    repeat that difference. Place 0 is for all rarer languages together. ``prior``: counts added to
    each word's and each pair's bucket, at the ratio that the other languages show of a kind's count
    to the one expected there from their sizes; a language trusts it the less the more labels of the
    kind it has, as buckets hold other words elsewhere. ``share_prior``: documents added to a
    language's at the shares of all languages. A language without labels of a kind thus takes the
    others' word.
    """

    TARGET = 2  # kind = 2 * quality + toxic

    def __init__(self, languages: dict, labelled: list[tuple[np.ndarray, np.ndarray]], documents: np.ndarray, raw: np.ndarray, prior: tuple[float, float] = (4.0, 500.0), share_prior: float = 20.0):
        """``labelled``: for each kind the distinct places in ``raw``, laid flat, and the kind's counts there; one kind at a time is made dense."""
        self.languages, buckets = languages, raw.shape[1]
        self.added = np.repeat(np.array(prior, np.float32), buckets // 2)
        self.log_ratio = np.empty((len(raw), len(labelled), buckets), np.float32)
        self.raw, self.raw_size = raw.astype(np.float32), raw.sum(axis=1)
        sample = np.zeros(raw.shape)
        for at, n in labelled:
            sample.ravel()[at] += n
        self.sample, self.sample_size = sample.astype(np.float32), sample.sum(axis=1)
        del sample
        for kind, (at, n) in enumerate(labelled):
            c = np.zeros(raw.shape)
            c.ravel()[at] = n
            expected = c.sum(axis=1, keepdims=True) * (self.sample / np.maximum(1, self.sample_size)[:, None])
            elsewhere = (c.sum(axis=0) - c + self.added) / (expected.sum(axis=0) - expected + self.added)
            trust = share_prior / (share_prior + documents[:, kind, None])
            self.log_ratio[:, kind] = np.log((c + self.added * elsewhere**trust) / (expected + self.added))
        total = documents.sum(axis=0)
        n = total.sum()
        shares = (documents + share_prior * total / max(1, n)) / (documents.sum(axis=1, keepdims=True) + share_prior)
        with np.errstate(divide="ignore"):
            self.log_share = np.log(np.concatenate((shares * n, np.ones((len(shares), 1))), axis=1) / (n + 1))
        self.fitted = total[self.TARGET] > 0

    def log_posterior(self, language, found: np.ndarray) -> float:
        """Log of the target's share of the mixture at a text; 0 where there is nothing to tell by."""
        at = self.languages.get(language, 0)
        if not self.fitted or not len(found):
            return 0.0
        found, times = np.unique(found, return_counts=True)
        others = np.maximum(self.raw[at, found] - times, 0) / max(1, self.raw_size[at] - times.sum())
        added = self.added[found]
        to_raw = np.log((self.sample[at, found] + added) / (self.sample_size[at] * others + added)) @ times
        mixture = np.append(self.log_ratio[at][:, found] @ times.astype(np.float64) + to_raw, 0.0) + self.log_share[at]
        top = mixture.max()
        return float(mixture[self.TARGET] - top - np.log(np.exp(mixture - top).sum()))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, buckets: int = 1 << 17, languages: int = 15) -> RatioModel:
    rated = labels.where("quality is not null and toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    some = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    kinds = some.select(F.col("doc_id").alias("__id"), (2 * F.least(F.greatest("q", F.lit(0)), F.lit(1)) + F.least(F.greatest("t", F.lit(0)), F.lit(1))).cast("int").alias("kind"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    # At most fit_rows ids of 12 bytes: broadcasting them keeps the texts where they are.
    rows = docs.select(F.col("doc_id").alias("__id"), lang.alias("lang"), F.col("text").cast("binary").alias("text")).join(F.broadcast(kinds), "__id", "left")
    shares = rows.groupBy("lang").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"k{k}") for k in range(4)])
    scratch = Scratch(docs.sparkSession, "quality-fit")
    shares = scratch.save(shares, "shares")
    common = shares.orderBy(F.desc("n"), F.col("lang").asc_nulls_last()).limit(languages).collect()
    # Place 0 is for languages that aren't among the common ones.
    places = {row["lang"]: i + 1 for i, row in enumerate(common)}
    documents = np.zeros((len(places) + 1, 4), np.int64)
    for row in common:
        documents[places[row["lang"]]] = [row[f"k{k}"] for k in range(4)]
    every = shares.agg(*[F.coalesce(F.sum(f"k{k}"), F.lit(0)) for k in range(4)]).first()
    documents[0] = np.array(list(every)) - documents.sum(axis=0)
    place = F.lit(0)
    for language, i in places.items():
        place = F.when(F.col("lang").eqNullSafe(F.lit(language)), i).otherwise(place)
    # Every document is counted once, those without a label in the sample as a fifth kind.
    rows = rows.select((place * 5 + F.coalesce("kind", F.lit(4))).cast("int").alias("kind"), "text")
    sums = map_batches(rows, _counting(buckets, 5 * len(documents)), "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    place, kind, bucket = F.expr(f"at div {5 * buckets}"), F.expr(f"at div {buckets} % 5"), F.expr(f"at % {buckets}")
    sums = scratch.save(sums.select((place * buckets + bucket).cast("int").alias("at"), kind.cast("int").alias("kind"), "n"), "sums")

    def counts(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """At most (languages + 1) * buckets rows of 12 bytes, whatever the input."""
        got = df.select("at", "n").toArrow()
        return got["at"].to_numpy(), got["n"].to_numpy()

    raw = np.zeros((len(documents), buckets))
    at, n = counts(sums.groupBy("at").agg(F.sum("n").alias("n")))
    raw.ravel()[at] = n
    model = RatioModel(places, [counts(sums.where(F.col("kind") == k)) for k in range(4)], documents, raw)
    scratch.drop("shares", "sums")
    return model


def _weighing(model, text_at: int, lang_at: int | None, buckets: int):
    def run(batches):
        ratio = model.value
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            langs = batch.column(lang_at).cast(pa.string()).to_pylist() if lang_at is not None else [None] * len(texts)
            weights = [ratio.log_posterior(lang, features(t, buckets)) for lang, t in zip(langs, word_hashes(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights, pa.float64())], names=[*batch.schema.names, "__log_weight"])

    return run


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 2048) -> float:
    """The k-th largest value, found by counting values in ever narrower ranges; -inf for all rows."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if n <= k or n == 0:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0  # values over hi
    while lo < hi:
        inside = df.where((F.col(column) >= lo) & (F.col(column) <= hi))
        width = (hi - lo) / bins
        if width == 0 or lo + width == lo:
            return lo
        at = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1))
        rows = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for row in sorted(rows, key=lambda row: -row["bin"]):  # at most ``bins`` rows
            if above + row["n"] >= k:
                lo, hi = row["lo"], row["hi"]
                break
            above += row["n"]
        if above + row["n"] == k:
            return lo
    return lo


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, fit_rows: int = 20_000, buckets: int = 1 << 17, seed: int = 3, scores_only: bool = False) -> DataFrame:
    """The documents that the sample holds, with __log_weight and __key (log weight and Gumbel noise)."""
    spark = docs.sparkSession
    bound_arrow(spark)
    model = fit(docs, labels, fit_rows, buckets)
    shared = spark.sparkContext.broadcast(model)
    schema = lambda df: T.StructType([*df.schema.fields, T.StructField("__log_weight", T.DoubleType())])

    def weighed(df: DataFrame) -> DataFrame:
        df = map_batches(df, _weighing(shared, df.columns.index("text"), df.columns.index("lang") if "lang" in df.columns else None, buckets), schema(df))
        uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return df.withColumn("__key", F.col("__log_weight") - F.log(-F.log(uniform)))

    scores = Scratch(spark, "quality").save(weighed(docs.select("doc_id", "text", *[c for c in ("lang",) if c in docs.columns])).drop("text", "lang"), "scores")
    if k is None:
        k = round(scores.agg(F.coalesce(F.sum(F.exp("__log_weight")), F.lit(0.0))).first()[0])
    threshold = kth_largest(scores, "__key", k)
    return (scores if scores_only else weighed(docs)).where(F.col("__key") >= threshold)


def select_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, log_weight, key of the kept rows."""
    kept = resample(docs, labels, scores_only=True, **options)
    return kept.select("doc_id", F.col("__log_weight").alias("log_weight"), F.col("__key").alias("key"))


def op3_quality(spark, sf_dir):
    return select_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = None  # floating sums over hashed features; tests hold held-out accuracy and the top-k
