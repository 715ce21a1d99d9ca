"""Filters, cleanups and small joins of tables of addresses, answers, categories and boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.plans.iterate import in_blocks

#: Seed words that go to every task at once.
MOST_SEEDS = 5_000
NOT_FOUND, PROBLEMS = "Not_found", "Processing_problems"


def keep_first(df: DataFrame, keys: list[str], ord_col: str) -> DataFrame:
    """The first row of each key by an ordinal. A sum before the shuffle finds it, so that a hot key costs a row a task."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(ord_col)).alias("_r"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in df.columns])


def clean_urls(urls: DataFrame, url: str = "image_url", ord_col: str = "ord") -> DataFrame:
    """Without failed rows, one row for each address, without those not found."""
    return keep_first(urls.where(F.col(url) != PROBLEMS), [url], ord_col).where(F.col(url) != NOT_FOUND)


def clean_answer(answer) -> Column:
    """Yes. and No. without their dot; all else as it is."""
    c = F.col(answer) if isinstance(answer, str) else answer
    return F.when(c.isin("Yes.", "No."), F.rtrim(c, F.lit("."))).otherwise(c)


def relevant(rows: DataFrame, answer: str = "answer") -> DataFrame:
    return rows.where(clean_answer(answer) == "Yes")


def answer_counts(rows: DataFrame, answer: str = "answer") -> DataFrame:
    c = clean_answer(answer)
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(c == "Error").alias("errors"), F.count_if(c == "Yes").alias("relevant"))


def sample_distinct(df: DataFrame, column: str, n: int = 50, seed: str = "0") -> DataFrame:
    """n distinct values by the order of a hash: the same on every run."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(F.md5(F.concat(F.lit(seed), F.col(column))), column).limit(n)


def address_flags(url) -> dict[str, Column]:
    c = F.col(url) if isinstance(url, str) else url
    path = F.lower(F.regexp_extract(c, r"^[^?#]*", 0))
    return {
        "is_https": F.startswith(F.lower(c), F.lit("https://")), "has_query": F.contains(c, F.lit("?")),
        "has_image_extension": path.rlike(r"\.(png|jpe?g|gif|bmp|tiff?|webp|svg)$"),
    }


def is_image(mime, status) -> Column:
    return F.coalesce(F.startswith(F.lower(mime), F.lit("image")) & (status == 200), F.lit(False))


def is_wrapper(mime, url) -> Column:
    """Whether an address gives a page around an image: text, or a query without an image's extension."""
    flags = address_flags(url)
    return F.coalesce(F.lower(mime).rlike("html|text"), F.lit(False)) | (flags["has_query"] & ~flags["has_image_extension"])


def final_category(by_vector, by_model) -> Column:
    return F.when(by_vector == "Uncategorized", by_model).otherwise(by_vector)


def boxes(words: DataFrame, least: float = 60.0) -> DataFrame:
    """Words read with a confidence of least or more, with the centres of their boxes; rows with missing numbers go."""
    number = {c: F.col(c).try_cast("double") for c in ("left", "top", "width", "height", "conf")}
    out = words.withColumns(number).where(F.col("conf") >= least).withColumn("text", F.trim("text")).where("text <> ''").dropna(subset=["left", "top", "width", "height"])
    return out.withColumns({"cx": F.col("left") + F.col("width") / 2, "cy": F.col("top") + F.col("height") / 2})


def nearest_box(points: DataFrame, words: DataFrame, group: str = "image", point: str = "point_id") -> DataFrame:
    """For each point (x, y) the word whose centre is nearest, the first on ties. Points meet the words of their own image only."""
    pairs = points.join(words.select(group, "ord", "text", "cx", "cy"), group)
    d2 = (F.col("cx") - F.col("x")) ** 2 + (F.col("cy") - F.col("y")) ** 2
    return pairs.groupBy(group, point).agg(F.min_by("text", F.struct(d2, "ord")).alias("text"))


def arrow_triples(arrows: DataFrame, words: DataFrame, least_area: float = 50.0) -> DataFrame:
    """Triples of arrows (image, arrow_id, left, top, width, height, area): the words nearest the left and right ends at half height."""
    big = arrows.where(F.col("area") > least_area).withColumn("y", F.col("top") + F.col("height") / 2)
    tails = nearest_box(big.select("image", F.col("arrow_id").alias("point_id"), F.col("left").alias("x"), "y"), words)
    heads = nearest_box(big.select("image", F.col("arrow_id").alias("point_id"), (F.col("left") + F.col("width")).alias("x"), "y"), words)
    both = tails.withColumnRenamed("text", "subject").join(heads.withColumnRenamed("text", "object"), ["image", "point_id"])
    return both.select("image", F.col("point_id").alias("arrow_id"), "subject", "object")


def sign_predicate(text) -> Column:
    """What a sign beside an arrow says."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(F.contains(c, F.lit("+")), "increases").when(c.rlike("[−–-]"), "decreases").otherwise("interacts_with")


def last_value_map(rows: DataFrame, key: str, value: str, ord_col: str) -> DataFrame:
    """The last value of each key, numbers written with commas read as numbers."""
    number = F.regexp_replace(F.col(key).cast("string"), ",", "").try_cast("long")
    return rows.where(number.isNotNull()).groupBy(number.alias(key)).agg(F.max_by(value, ord_col).alias(value))


def zip_shorter(first: DataFrame, second: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Two ordered lists side by side, as far as the shorter goes."""
    number = lambda df: df.withColumn("_n", F.row_number().over(W.orderBy(ord_col))).drop(ord_col)
    return number(first).join(number(second), "_n").drop("_n")


def numeric_or_zero(column) -> Column:
    """A whole number; 0 for what is missing or no number; fractions cut off."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.try_cast("double"), F.lit(0.0)).cast("long")


def terms_by_category(descriptors: DataFrame, seeds: DataFrame) -> DataFrame:
    """category and its sorted terms: all terms of descriptors (name, terms) of which one contains a seed (category, seed)."""
    known = descriptors.select("name", F.array_distinct(F.concat(F.array("name"), F.coalesce("terms", F.expr("cast(array() as array<string>)")))).alias("terms"))
    low = known.withColumn("low", F.lower(F.array_join("terms", "\n")))
    # Seeds are a list of some hundred words; a long one comes in blocks.
    hits = reduce(DataFrame.union, [low.join(F.broadcast(block), F.contains(F.col("low"), F.lower("seed"))) for block in in_blocks(seeds.select("category", "seed"), MOST_SEEDS, "category", "seed")])
    return hits.select("category", F.explode("terms").alias("term")).distinct().groupBy("category").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def resolve_header(columns: list[str], candidates: list[str], override: str | None = None) -> str | None:
    """The column that goes by one of the candidate names, in any case; the first candidate counts. An override has to be there."""
    low = {c.lower().strip(): c for c in columns}
    if override:
        if override.lower().strip() not in low:
            raise ValueError(f"column {override!r} not among {columns}")
        return low[override.lower().strip()]
    return next((low[c] for c in candidates if c in low), None)


# Header names of triples' parts and types.
HEADERS = {
    "subject": ["subject", "subj", "s", "head", "source", "from"],
    "predicate": ["predicate", "pred", "p", "relation", "rel", "edge", "link", "property"],
    "object": ["object", "obj", "o", "target", "tail", "to"],
}
TYPE_HEADERS = {
    "subject_type": ["subject_type", "subject type", "stype", "subjectlabel", "subject_label", "s_type"],
    "object_type": ["object_type", "object type", "otype", "objectlabel", "object_label", "o_type"],
    "subject_subtype": ["subject_subtype", "subject subtype", "subjectclass", "subject_class", "s_subtype"],
    "object_subtype": ["object_subtype", "object subtype", "objectclass", "object_class", "o_subtype"],
}


def standard_triples(df: DataFrame, **overrides: str) -> DataFrame:
    """A table of triples with its parts and types under their standard names; an error if a part isn't found."""
    out = df
    for name, candidates in {**HEADERS, **TYPE_HEADERS}.items():
        found = resolve_header(df.columns, candidates, overrides.get(name))
        if found:
            out = out.withColumnRenamed(found, name)
        elif name in HEADERS:
            raise ValueError(f"no {name} among {df.columns}")
    return out
