"""Parsing of extraction responses into triples.

A response is split into numbered lines; what a line belongs to (the header above it, whether triples have begun) comes from window
functions over one response's lines. Responses are bounded by a model's answer length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.vocabulary import REFUSALS

HEADER = r"(?i)^\s*Pathophysiolog(?:y|ical)\s+Process:\s*(.+?)\s*$"
TRIPLES = r"(?i)^\s*Triples:\s*$"
TRIPLE = r"^\s*([^|]+)\|([^|]+)\|([^|]+)\s*$"
#: Line ends as Python's splitlines() has them.
LINES = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
NOT_FOUND = "Not_found"
LITERAL_HEADER = "Pathophysiological Process: "
NOTHING = f"{LITERAL_HEADER}{NOT_FOUND}\nTriples:\n{NOT_FOUND}|{NOT_FOUND}|{NOT_FOUND}"


def response_lines(responses: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord and line of each line that isn't blank, trimmed."""
    lines = responses.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), LINES)).alias("ord", "line"))
    trimmed = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    return lines.withColumn("line", trimmed).where("line <> ''")


def parse_blocks(responses: DataFrame, key: str = "id", text: str = "response") -> DataFrame:
    """Triples of responses: key, block, mechanism, ord, subject, predicate, object.

    A header starts a block; triples count after a line "Triples:" within it; a line that isn't three fields is left out.
    """
    lines = response_lines(responses, key, text).withColumn("header", F.regexp_extract("line", HEADER, 1))
    so_far = W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    is_header = F.col("header") != ""
    lines = lines.withColumns({
        "block": F.sum(is_header.cast("int")).over(so_far),
        "mechanism": F.last(F.when(is_header, F.col("header")), ignorenulls=True).over(so_far),
        "began": F.coalesce(F.max(F.when(F.col("line").rlike(TRIPLES), F.col("ord"))).over(so_far), F.lit(-1)),
        "headed": F.coalesce(F.max(F.when(is_header, F.col("ord"))).over(so_far), F.lit(-1)),
    })
    found = lines.where("block > 0 and began > headed").where(F.col("line").rlike(TRIPLE))
    field = lambda k: F.trim(F.regexp_extract("line", TRIPLE, k))
    return found.select(key, F.col("block").cast("int").alias("block"), "mechanism", "ord", field(1).alias("subject"), field(2).alias("predicate"), field(3).alias("object"))


def _counts(text: str) -> Column:
    """How many blocks and triples a response has, from its lines in order: struct of blocks, triples and whether the block's triples have begun."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), LINES), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    zero = F.struct(F.lit(0).cast("long").alias("blocks"), F.lit(0).cast("long").alias("triples"), F.lit(False).alias("began"))

    def step(so_far: Column, line: Column) -> Column:
        header, begins = line.rlike(HEADER), line.rlike(TRIPLES)
        counts = so_far.began & ~header & line.rlike(TRIPLE)
        began = ~header & (so_far.began | (begins & (so_far.blocks > 0)))
        return F.struct((so_far.blocks + header.cast("long")).alias("blocks"), (so_far.triples + counts.cast("long")).alias("triples"), began.alias("began"))

    return F.aggregate(F.filter(trimmed, lambda x: x != ""), zero, step)


def count_blocks(responses: DataFrame, key: str = "id", text: str = "response") -> DataFrame:
    """How many blocks and triples each response has; blocks without triples count. Counted row by row; only numbers are grouped by key."""
    each = responses.select(key, _counts(text).alias("_c")).select(key, "_c.blocks", "_c.triples")
    return each.groupBy(key).agg(F.sum("blocks").alias("blocks"), F.sum("triples").alias("triples"))


def parse_paragraphs(responses: DataFrame, keys: list[str], text: str = "response", keep_not_found: bool = False) -> DataFrame:
    """Triples of full-text responses, strictly: a block with a line that isn't three fields gives one Not_found row and ends its response.

    Blocks before it stay. A response that says nothing was found gives a Not_found row too. Such rows are left out unless kept.
    """
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    base = responses.withColumn("_text", trim(F.coalesce(text, F.lit(""))))
    none = F.array(F.struct(F.lit(0).alias("block"), F.lit(NOT_FOUND).alias("mechanism"), F.lit(0).alias("ord"), F.array(*[F.lit(NOT_FOUND)] * 3).alias("fields"), F.lit(False).alias("bad")))
    blocks = F.filter(F.transform(F.split("_text", LITERAL_HEADER), lambda b, k: F.struct(k.alias("block"), F.split(trim(b), "\n").alias("lines"))), lambda b: b.block > 0)
    rows = lambda b: F.transform(F.slice(b.lines, 3, F.greatest(F.size(b.lines) - 2, F.lit(0))), lambda x, k: F.struct(b.block.alias("block"), trim(b.lines[0]).alias("mechanism"), k.alias("ord"), F.split(trim(x), r"\|").alias("fields"), (F.size(F.split(trim(x), r"\|", -1)) != 3).alias("bad")))
    base = base.withColumn("_rows", F.when(F.col("_text") == NOTHING, none).otherwise(F.flatten(F.transform(blocks, rows))))
    base = base.withColumn("_stop", F.coalesce(F.array_min(F.transform(F.filter("_rows", lambda r: r.bad), lambda r: r.block)), F.lit(2**31 - 1)))
    good = F.filter("_rows", lambda r: r.block < F.col("_stop"))
    stop = F.when(F.col("_stop") < 2**31 - 1, none).otherwise(F.expr("filter(_rows, r -> false)"))
    out = base.select(*keys, F.explode(F.concat(good, stop)).alias("r"))
    out = out.select(*keys, "r.block", "r.mechanism", "r.ord", F.col("r.fields")[0].alias("subject"), F.col("r.fields")[1].alias("predicate"), F.col("r.fields")[2].alias("object"))
    return out if keep_not_found else out.where(F.col("mechanism") != NOT_FOUND)


def outcome(accessible: Column, failed: Column, response: Column, triples: Column) -> Column:
    """What became of an input: inaccessible, error, refused, no_parse or ok, in this order."""
    low = F.lower(F.coalesce(response, F.lit("")))
    refused = F.lit(False)
    for phrase in REFUSALS:
        refused = refused | F.contains(low, F.lit(phrase))
    return F.when(~accessible, "inaccessible").when(failed, "error").when(refused, "refused").when(triples == 0, "no_parse").otherwise("ok")


def run_log(responses: DataFrame, key: str = "id", text: str = "response", accessible: str | None = None, failed: str | None = None) -> DataFrame:
    """A row for each input, whatever its outcome. A response with a block is ok even if the block has no triple."""
    flag = lambda c, default: F.coalesce(c, F.lit(default)) if c else F.lit(default)
    counted = responses.join(count_blocks(responses, key, text), key, "left")
    return counted.withColumn("outcome", outcome(flag(accessible, True), flag(failed, False), F.col(text), F.col("blocks")))


def articles(raw: DataFrame, column: str = "articles") -> DataFrame:
    """id, title, ord, paragraph from a map of articles id -> (title, paragraphs)."""
    each = raw.select(F.explode(column).alias("id", "article"))
    return each.select("id", "article.title", F.posexplode("article.paragraphs").alias("ord", "paragraph"))


def tall_categories(raw: DataFrame, column: str = "categories") -> DataFrame:
    """category, ord, term from a map of categories to terms."""
    each = raw.select(F.explode(column).alias("category", "terms"))
    return each.select("category", F.posexplode("terms").alias("ord", "term"))
