"""A corpus pipeline: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, with the columns of documents; the last returns a row for
each piece of a document with its sequence. Between stages documents are written as Parquet and read again.

Defined cases: a null text counts as empty, and an empty one is scored, compared and packed like any other; a row without an id can't
be told from others like it, and stays in every stage, unless it repeats another such row's text where ids repeat (it comes once); of
rows that repeat an id, exact copies go by id and text, and the later stages take out all rows of an id that they take out; ties fall
to the largest id among exact copies and to the least among near ones; texts of any length are read whole; an empty table gives an empty
result; further columns, whatever their names, are kept until the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, exact_dedup, jaccard_join, packing, quality
from quern.llm.common import cut, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality.stage),
    ("exact_dedup", exact_dedup.stage),
    ("ngram_jaccard_join", jaccard_join.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("best_fit_packing", packing.stage),
]

#: SQL can express neither the classifier nor the packing; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
