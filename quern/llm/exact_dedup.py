"""Exact dedup by progressive refinement, with DataFrame functions only.

Documents are grouped by length, then by a hash of their first characters, then by the SHA-256 of the whole text; each step looks
only at what the step before left in a group of two or more. Narrow rows (an id, a length, a hash) are all that is shuffled. Which
groups survive is decided by counts that are summed before the shuffle, so that a group of copies that holds a third of all rows
costs one row a task. Lengths and heads that several rows share are broadcast up to FEW, and else joined: lengths to the counts, not to
the rows, so that a hot length is as many rows as it has heads. Rows meet the counts of their digest in a join whose sides are both
plain shuffles of written or grouped rows, which Spark can split where a digest is hot.

Defined cases: a null text counts as empty; a null id is less than any other id; rows that repeat an id with an equal text are one
document, returned once; texts of any length are hashed whole; of equal texts the largest id is unique once equal rows are one, so
that there are no ties; rows that repeat an id with other texts are told apart by length and digest; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import cut, table, without_ids

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters under the second step's hash.
PREFIX = 256
#: Rows of keys (one or two longs) that are broadcast at most: 1.6 MB.
FEW = 100_000


def normalized(text) -> F.Column:
    """A text with A-Z lower-cased and nothing else changed; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, all_digests: bool = False, few: int = FEW) -> DataFrame:
    """Returns id, keep_id, group_size, kept and text_sha256 for each document; of equal texts the one with the largest id is kept.

    text_sha256 is null where refinement never came to the whole text, unless the caller asks for all_digests.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", "text", F.octet_length("text").alias("len"))
    headed = sized.withColumn("head", F.xxhash64(normalized(F.substring("text", 1, prefix))))

    lengths = cut(sized.groupBy("len").count().where("count > 1").select("len"))
    if lengths.count() <= few:
        heads = headed.drop("text").join(F.broadcast(lengths), "len", "left_semi").groupBy("len", "head").count()
    else:
        heads = cut(headed.drop("text").groupBy("len", "head").count()).join(lengths.hint("merge"), "len", "left_semi")
    heads = cut(heads.where("count > 1").select("len", "head", F.lit(True).alias("hit")))

    # Whole texts are hashed for the rows whose length and head others share; when() leaves the rest unread.
    if heads.count() <= few:  # beyond, the texts meet the keys in a shuffle
        whole = headed.join(F.broadcast(heads), ["len", "head"], "left")
    else:
        whole = headed.join(heads.hint("merge"), ["len", "head"], "left")
    digest = F.unhex(F.sha2(normalized(F.col("text")), 256))
    digests = cut(whole.select("id", "len", "hit", digest.alias("digest") if all_digests else F.when(F.col("hit"), digest).alias("digest")))

    alone = digests.where("hit is null").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    members = digests.where("hit").groupBy("id", "len", "digest").agg(F.lit(1)).select("id", "len", "digest")
    groups = cut(members.groupBy("len", "digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    shared = members.join(groups.hint("merge"), ["len", "digest"], "left")
    found = alone.unionByName(shared.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), all_digests=True)


SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents)
select doc_id, max(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
       doc_id = max(doc_id) over (partition by body) as kept, sha256(body) as text_sha256
from t
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, with their columns; a row that repeats an id and a text comes once; rows with a null id stay."""
    gone = exact_dedup(docs).where("not kept")
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        return without_ids(docs, gone.select("doc_id"))
    # Where ids repeat, an id alone doesn't tell which of its texts is a copy.
    keys = cut(gone.select(F.col("doc_id").alias("__quern_key"), F.col("text_sha256").alias("__quern_digest")))
    same = (F.col("doc_id") == F.col("__quern_key")) & (F.sha2(normalized(F.col("text")), 256) == F.col("__quern_digest"))
    return docs.join(keys.hint("merge"), same, "left_anti").dropDuplicates(["doc_id", "text"])
