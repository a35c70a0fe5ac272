"""The subpackage's queries and SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from lattica.llm import decontaminate, jaccard_join, mixing, neighbours, pii, quality, sharding, substring_dedup, token_files, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_quality": quality.op3_quality,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_sharding": sharding.op5_sharding,
    "op6_mixing": mixing.op6_mixing,
    "op7_token_files": token_files.op7_token_files,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_pii": pii.op9_pii,
    "op10_decontamination": decontaminate.op10_decontamination,
}

ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op2_url_filter": url_filter.SQL,
    "op6_mixing": mixing.SQL,
    "op8_jaccard_join": jaccard_join.SQL,
    "op10_decontamination": decontaminate.SQL,
}
