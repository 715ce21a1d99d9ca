"""Triples that arrive as files become edges: a stream whose batches are merged into a table of edge counts.

An extension: the flows that this engine reproduces are bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions import relations, text
from quern.plans.graph import clean_triples

SCHEMA = "subject string, predicate string, object string, source string"


def edge_counts(triples: DataFrame) -> DataFrame:
    rows = clean_triples(triples).select(F.concat(F.lit("name:"), text.canon_name("subject")).alias("src"), relations.raw_type("predicate").alias("predicate_raw"), F.concat(F.lit("name:"), text.canon_name("object")).alias("dst"), "source")
    return rows.groupBy("src", "predicate_raw", "dst", "source").agg(F.count(F.lit(1)).alias("n"))


def start(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Reads JSON files of triples as they come. Each batch writes its counts to a folder of its own, so that a repeated batch overwrites itself."""

    def merge(batch: DataFrame, number: int) -> None:
        edge_counts(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(SCHEMA).json(folder)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edges(spark: SparkSession, out: str) -> DataFrame:
    """All batches so far as one table of edges."""
    return spark.read.parquet(out).groupBy("src", "predicate_raw", "dst", "source").agg(F.sum("n").alias("n"))
