"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from quern.llm import decontaminate, exact_dedup, jaccard_join, packing, quality, secrets, substring_dedup, token_store, toxicity, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_token_store": token_store.op2_token_store,
    "op3_warc": warc.op3_warc,
    "op4_quality": quality.op4_quality,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_packing": packing.op7_packing,
    "op8_ngram_jaccard": jaccard_join.op8_ngram_jaccard,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_secrets": secrets.op10_secrets,
}

#: Queries that SQL expresses; the others are tested against brute force, a round trip or held-out labels in tests/llm.
ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op3_warc": warc.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op8_ngram_jaccard": jaccard_join.SQL,
}
