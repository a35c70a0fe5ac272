"""Corpus pipeline: quality, near duplicates, decontamination, mixing, token files.

Each stage works on all rows that the one before it kept, and all but the last return the columns
of documents. Nulls, empty tables and repeated rows are handled as each operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers

from lattica.llm import decontaminate, jaccard_join, mixing, quality, token_files
from lattica.llm.common import Scratch, forget, table


def keep_quality(spark, docs, sf_dir):
    """Documents that the importance sample holds; the others go."""
    return quality.resample(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def keep_one_of_each_group(spark, docs, sf_dir):
    """Of each group of near duplicates (similarity 0.75 of 5-word shingles) the document with the smallest doc_id."""
    return jaccard_join.keep_one(docs)


def keep_clean(spark, docs, sf_dir):
    """Documents without any benchmark window; the others go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """The mix: each document as often as it is taken, the last one of a source cut to the target."""
    return mixing.mixed_rows(docs)


def write_tokens(spark, docs, sf_dir):
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the token files."""
    return token_files.token_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", keep_clean),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

ORACLE_SQL = None  # the stages hold models and a tokenizer; tests check each against brute force


def run(spark, sf_dir):
    """The stages over documents, each one's output written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{i}")
        scratch.keep_only(f"stage{i}")
        forget(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
