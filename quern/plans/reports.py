"""Report tables over a graph, and top-N exports of such tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import contains_any, display_name
from quern.operators.clean import numeric_or_zero, resolve_header
from quern.plans.graph import Graph
from quern.plans.graph_queries import has_label, joined
from quern.plans.iterate import all_shortest_paths, cut, distances, undirected

DEGREES = {"deg_cbm": "CBM", "deg_gpt": "GPT", "deg_gpt_fulltext": "GPT-fulltext"}


def degrees_by_source(g: Graph) -> DataFrame:
    ends = g.incidences()
    sums = [F.count_if(F.col("source") == s).alias(n) for n, s in DEGREES.items()]
    return ends.groupBy("key").agg(*sums).withColumn("deg_total", sum((F.col(n) for n in DEGREES), F.lit(0)).cast("long"))


def _anchors(g: Graph, words) -> DataFrame:
    return g.nodes.where(contains_any("name", words)).select(F.col("key").alias("id"))


def _near(g: Graph, words, depth: int, both: DataFrame) -> DataFrame:
    """Nodes within depth edges of any anchor: a search from one virtual start, so that a rim holds each node once."""
    seen = _anchors(g, words).distinct()
    for _ in range(depth):
        seen = cut(seen.union(both.join(seen.withColumnRenamed("id", "src"), "src", "left_semi").select("dst")).distinct())
    return seen


def shared_hubs(g: Graph, first_words, second_words, depth: int = 2, limit: int | None = 100) -> DataFrame:
    """Nodes within depth edges of both anchor sets, with their degrees by source."""
    pairs = undirected(g.edges)
    both = _near(g, first_words, depth, pairs).join(_near(g, second_words, depth, pairs), "id").withColumnRenamed("id", "key")
    out = both.join(degrees_by_source(g), "key").join(g.nodes, "key").select(F.col("name").alias("entity"), joined("labels").alias("labels"), "deg_total", *DEGREES, "key")
    return out.orderBy(F.desc("deg_total"), "entity", "key").limit(limit) if limit else out


def neighbors(g: Graph, words, limit: int | None = 300) -> DataFrame:
    """Neighbours of anchors with the edges between them by source."""
    anchors = g.nodes.where(contains_any("name", words)).select(F.col("key").alias("a"), F.col("name").alias("anchor"))
    end = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = F.when(F.col("src") != F.col("dst"), F.array(end("src", "dst"), end("dst", "src"))).otherwise(F.array(end("src", "dst")))
    ends = g.edges.select(F.explode(both).alias("e"), "source").select("e.*", "source")
    local = ends.join(anchors, "a").groupBy("anchor", "b").agg(F.count(F.lit(1)).alias("deg_local"), F.count_if(F.col("source") == "CBM").alias("edges_cbm"), F.count_if(F.startswith("source", F.lit("GPT"))).alias("edges_gpt"))
    out = local.join(g.nodes.select(F.col("key").alias("b"), F.col("name").alias("neighbor"), joined("labels").alias("labels")), "b").select("anchor", "neighbor", "labels", "deg_local", "edges_cbm", "edges_gpt", F.col("b").alias("key"))
    return out.orderBy(F.desc("deg_local"), "anchor", "key").limit(limit) if limit else out


def anchor_paths(g: Graph, first_words, second_words, depth: int = 3, limit: int | None = None) -> DataFrame:
    """Shortest paths between anchor sets: hops, all inner nodes, and the edges by source along them."""
    paths = cut(all_shortest_paths(_anchors(g, first_words), _anchors(g, second_words), g.edges, depth).withColumn("path", F.array_join("nodes", " > ")))
    steps = paths.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda k: F.struct(F.element_at("nodes", k).alias("x"), F.element_at("nodes", k + 1).alias("y")))).alias("k", "s"))
    ends = g.edges.select(F.col("src").alias("x"), F.col("dst").alias("y"), "source").union(g.edges.where("src <> dst").select("dst", "src", "source")).groupBy("x", "y").agg(F.count_if(F.col("source") == "CBM").alias("c"), F.count_if(F.startswith("source", F.lit("GPT"))).alias("p"))
    sums = steps.select("path", F.col("s.x").alias("x"), F.col("s.y").alias("y")).join(ends, ["x", "y"]).groupBy("path").agg(F.sum("c").alias("cbm_edges"), F.sum("p").alias("gpt_edges"))
    inner = F.array_join(F.slice("nodes", 2, F.greatest(F.size("nodes") - 2, F.lit(0))), "|")
    out = paths.join(sums, "path").select(F.col("start").alias("first_anchor"), F.col("end").alias("second_anchor"), F.col("hops").cast("long").alias("hoplen"), inner.alias("mediators"), "cbm_edges", "gpt_edges")
    return out.orderBy("hoplen", "first_anchor", "second_anchor", "mediators").limit(limit) if limit else out


def mediators(g: Graph, first_words, second_words, depth: int = 3) -> DataFrame:
    """Inner nodes of shortest paths between anchor sets, with the edges of those paths that touch them."""
    paths = cut(all_shortest_paths(_anchors(g, first_words), _anchors(g, second_words), g.edges, depth))
    pairs = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda k: F.array_sort(F.array(F.element_at("nodes", k), F.element_at("nodes", k + 1))))).alias("p")).distinct()
    inner = paths.where("hops > 1").select(F.explode(F.slice("nodes", 2, F.col("hops") - 1)).alias("key")).distinct()
    edges = g.edges.select(F.array_sort(F.array("src", "dst")).alias("p"), "source").join(pairs, "p")
    touched = edges.select(F.explode(F.array_distinct("p")).alias("key"), "source").join(inner, "key")
    sums = touched.groupBy("key").agg(F.count(F.lit(1)).alias("edges_on_paths"), F.count_if(F.col("source") == "CBM").alias("cbm_edges_on_paths"), F.count_if(F.startswith("source", F.lit("GPT"))).alias("gpt_edges_on_paths"))
    return sums.join(g.nodes, "key").select(F.col("name").alias("mediator"), joined("labels").alias("labels"), "edges_on_paths", "cbm_edges_on_paths", "gpt_edges_on_paths", "key")


def distance_table(g: Graph, words, depth: int) -> DataFrame:
    return distances(_anchors(g, words), g.edges, depth)


NAME_COLUMNS = ["entity", "cytokine", "name", "node", "mediator"]


def top_table(table: DataFrame, limit: int = 20, ord_col: str = "ord") -> DataFrame:
    """A hub table (CSV columns, with an input ordinal) under standard names, its rows with the greatest degree, ties in input order."""
    name = resolve_header(table.columns, NAME_COLUMNS)
    if not name:
        raise ValueError(f"no name column among {table.columns}")
    have = lambda c: numeric_or_zero(c) if c in table.columns else F.lit(0).cast("long")
    out = table.select(F.col(name).alias("name"), F.col("labels") if "labels" in table.columns else F.lit(None).cast("string").alias("labels"), *[have(c).alias(c) for c in ("deg_total", *DEGREES)], F.col(ord_col).alias("_ord"))
    return out.orderBy(F.desc("deg_total"), "_ord").limit(limit).withColumn("name_short", display_name("name")).drop("_ord")


def without(table: DataFrame, column: str, words) -> DataFrame:
    """Rows whose lower-cased value isn't among the words."""
    return table.where(~F.lower(column).isin(*[w.lower() for w in words]))


def labels_of(text) -> F.Column:
    """An array of a bracketed list such as [Disease, Gene]."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"^\[|\]$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")


def label_hubs(g: Graph, labels, limit: int | None = None) -> DataFrame:
    """Nodes with one of the labels and their degrees by source, the cytokine hubs' table: cytokine, labels, degrees, key."""
    wanted = g.nodes.where(has_label(F.col("labels"), labels))
    out = degrees_by_source(g).join(wanted, "key").select(F.col("name").alias("cytokine"), joined("labels").alias("labels"), "deg_total", *DEGREES, "key")
    return out.orderBy(F.desc("deg_total"), "key").limit(limit) if limit else out


def of_anchor(table: DataFrame, column: str, anchor: str) -> DataFrame:
    """Rows whose value is the anchor in any case."""
    return table.where(F.upper(column) == anchor.upper())


def bars(top: DataFrame) -> DataFrame:
    """What a stacked bar chart of a top table shows: name, series, value, place (0 at the bottom, so that the first row is on top), a bar's total and the axis's end."""
    series = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("value")) for c in DEGREES])
    place = W.orderBy(F.desc("_n"))  # a top table has some twenty rows
    rows = top.withColumn("_n", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(place).cast("long") - 1).withColumn("total", sum((F.col(c) for c in DEGREES), F.lit(0)).cast("long"))
    most = rows.agg(F.max("total").alias("axis_max"))
    return rows.select("name", F.explode(series).alias("s"), "place", "total").select("name", "s.series", "s.value", "place", "total").join(F.broadcast(most))  # one row


def star(leaves: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Adds x and y to the leaves of a star: evenly round its centre, the first on top, in their order. A figure's star has some dozens."""
    order = W.orderBy(ord_col)
    angle = 2 * F.pi() * (F.row_number().over(order) - 1) / F.count(F.lit(1)).over(W.partitionBy()) + F.pi() / 2
    return leaves.withColumn("_a", angle).withColumns({"x": F.cos("_a"), "y": F.sin("_a")}).drop("_a")
