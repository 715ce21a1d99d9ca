"""Categories of rows by their vectors' likeness to keywords."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.similarity import norm
from quern.plans.iterate import in_blocks

#: Keywords that go to every task at once: vectors of a few thousand words.
MOST_KEYWORDS = 10_000


def best_category(rows: DataFrame, keywords: DataFrame, aggregate: str = "max", threshold: float = 0.5, key: str = "id", vector: str = "embedding") -> DataFrame:
    """key, category, score: the category (keywords: category, ord, embedding) with the greatest max or mean cosine.

    A score has to be above 0 to count and at least threshold, else the row is Uncategorized; the first category (by ord) wins ties.
    Keywords go to every task as one array, in blocks of about MOST_KEYWORDS: rows are read once for each block, and where there are
    several, what a row has of each category is added up over them.
    """
    if aggregate not in ("max", "mean"):
        raise ValueError(f"aggregate {aggregate!r} is neither max nor mean")
    unit = lambda v: F.transform(v, lambda x: x.cast("double") / F.nullif(norm(v), F.lit(0.0)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    words = keywords.select("category", "ord", unit(F.col("embedding")).alias("u"))
    base, parts = rows.select(key, unit(F.col(vector)).alias("v")), []
    blocks = in_blocks(words, MOST_KEYWORDS, "category", "ord")
    for block in blocks:
        lists = block.groupBy("category").agg(F.min("ord").alias("ord"), F.collect_list("u").alias("vectors"))
        table = lists.agg(F.collect_list(F.struct("ord", "category", "vectors")).alias("table"))  # one row
        sims = lambda c: F.transform(c.vectors, lambda k: dot(F.col("v"), k))
        facts = lambda c: F.struct(c.category.alias("category"), c.ord.alias("ord"), F.array_max(sims(c)).alias("most"), F.aggregate(sims(c), F.lit(0.0), lambda s, x: s + x).alias("sum"), F.size(c.vectors).alias("n"))
        parts.append(base.crossJoin(F.broadcast(table)).select(key, F.transform("table", facts).alias("facts")))
    value = (lambda c: c.most) if aggregate == "max" else (lambda c: c["sum"] / c.n)  # a sum with a vector of zeros is null, and counts as 0
    place = lambda c: F.struct(F.coalesce(value(c), F.lit(0.0)).alias("score"), (-c.ord).alias("place"), c.category.alias("category"))
    if len(blocks) == 1:
        best = parts[0].select(key, F.array_max(F.transform("facts", place)).alias("best"))
    else:
        each = reduce(DataFrame.union, parts).select(key, F.explode_outer("facts").alias("f"))
        whole = F.when(F.count_if(F.col("f.sum").isNull()) == 0, F.sum("f.sum"))
        added = each.groupBy(key, "f.category").agg(F.struct(F.col("category"), F.min("f.ord").alias("ord"), F.max("f.most").alias("most"), whole.alias("sum"), F.sum("f.n").alias("n")).alias("f"))
        best = added.groupBy(key).agg(F.max(place(F.col("f"))).alias("best"))
    good = (F.col("best.score") > 0) & (F.col("best.score") >= threshold)
    return best.select(key, F.when(good, F.col("best.category")).otherwise("Uncategorized").alias("category"), F.greatest("best.score", F.lit(0.0)).alias("score"))


def category_counts(rows: DataFrame, column: str = "category") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
