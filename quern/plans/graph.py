"""Property graphs as two DataFrames, and how triples become one.

nodes: key, name, labels array<string>, and other columns. edges: src, dst, predicate_raw, source, mechanism, n, and other columns.
An edge is one for each (src, predicate_raw, dst, source, mechanism); n counts the triples behind it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import relations, text
from quern.plans.iterate import components, cut

# Labels that a reviewer may give.
LABELS = ("Anatomical_Structure", "Biological_Process", "Cell", "Cell_Phenotype", "Chemical", "Disease", "Gene", "Phenotype", "Protein", "Pathway")
#: Other spellings of labels and sources, made one at ingest.
LABEL_ALIASES = {"BiologicalProcess": "Biological_Process", "AnatomicalStructure": "Anatomical_Structure"}
SOURCE_ALIASES = {"GPT fulltext": "GPT-fulltext"}


def _loop() -> Column:
    """Of an edge from a node to itself what tells it from that node's others; of other edges nothing."""
    return F.when(F.col("src") == F.col("dst"), F.struct("predicate_raw", "source", "mechanism")).alias("loop")


@dataclass
class Part:
    """Edges from nodes of one kind to nodes of one kind, as narrow rows.

    rows: src and dst, keys that are unique within their kinds, and what shown makes the edges' other columns of. nodes: (key, name, labels)
    of both kinds by these keys. kinds: what goes before a key, and makes it the graph's. dealt: the end by which rows are dealt to tasks.
    """

    rows: DataFrame
    shown: dict[str, Column]
    nodes: dict[str, DataFrame]
    kinds: dict[str, str]
    dealt: str

    def _keys(self) -> list[Column]:
        return [F.concat(F.lit(f"{kind}:"), F.col(p).cast("string")).alias(p) for p, kind in self.kinds.items()]

    def edges(self) -> DataFrame:
        return self.rows.select(*self._keys(), *[c.alias(k) for k, c in self.shown.items()])

    def named(self, ends: tuple[str, ...] | None) -> DataFrame:
        """Rows meet the nodes by the keys of their kinds; the graph's keys and all strings of edges are made after that."""
        ends = ends or (self.dealt, "dst" if self.dealt == "src" else "src")
        out = _with_ends(self.rows, self.nodes, ends)
        loops = len(set(self.kinds.values())) == 1
        made = out.select(*self._keys(), *[c.alias(k) for k, c in self.shown.items()], *_end_columns(ends))
        return made.withColumn("loop", _loop() if loops else F.lit(None).cast("struct<predicate_raw:string,source:string,mechanism:string>"))


def _end_columns(ends: tuple[str, ...]) -> list[str]:
    return [f"{p}_{c}" for p in ends for c in ("name", "labels")]


def _with_ends(edges: DataFrame, nodes: dict[str, DataFrame], ends: tuple[str, ...]) -> DataFrame:
    for p in ends:
        edges = edges.join(nodes[p].select(F.col("key").alias(p), F.col("name").alias(f"{p}_name"), F.col("labels").alias(f"{p}_labels")), p)
    return edges


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    #: The same edges in parts by kinds of nodes, where the kinds are known.
    parts: list[Part] | None = None

    def named(self, ends: tuple[str, ...] | None = None) -> DataFrame:
        """Edges with names and labels of these ends, joined in this order (both in the order that shuffles least), and loop, which tells edges from a node to itself apart."""
        if self.parts:
            return reduce(DataFrame.unionByName, [p.named(ends) for p in self.parts])
        ends = ends or ("src", "dst")
        return _with_ends(self.edges, dict.fromkeys(ends, self.nodes), ends).withColumn("loop", _loop())

    def incidences(self) -> DataFrame:
        """(key, source) for each end of each edge; a self-loop counts once. Edges are made once for both ends."""
        ends = F.when(F.col("src") != F.col("dst"), F.array("src", "dst")).otherwise(F.array("src"))
        return self.edges.select(F.explode(ends).alias("key"), "source")


def alias(column, names: dict[str, str]):
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.create_map(*[F.lit(v) for pair in names.items() for v in pair])[c], c)


def clean_triples(triples: DataFrame, s: str = "subject", p: str = "predicate", o: str = "object") -> DataFrame:
    """Rows whose three parts are all there."""
    return triples.where(~(text.is_na(s) | text.is_na(p) | text.is_na(o)))


def split_properties(triples: DataFrame, core: list[str]) -> DataFrame:
    """Adds subject_props, object_props and edge_props: maps of the other columns by their prefix, without missing values."""
    groups: dict[str, list] = {"subject_props": [], "object_props": [], "edge_props": []}
    for c in triples.columns:
        if c in core:
            continue
        kind, name = next(((f"{x}_props", c[len(x) + 1 :]) for x in ("subject", "object") if c.lower().startswith(f"{x}_")), ("edge_props", c))
        kind_of = triples.schema[c].dataType.typeName()
        value = F.to_json(c) if kind_of in ("array", "map", "struct") else text.na_to_null(c)
        groups[kind].append(F.struct(text.sanitize_key(F.lit(name)).alias("key"), value.alias("value")))
    empty = F.expr("cast(map() as map<string, string>)")
    made = {k: F.map_filter(F.map_from_entries(F.array(*v)), lambda _, x: x.isNotNull()) if v else empty for k, v in groups.items()}
    return triples.withColumns(made)


#: What tells mentions apart.
VALUES = ("name", "curie", "iri", "raw_id")


def _same(left: str, right: str, prefix: str = "") -> Column:
    """Equal values, or both missing."""
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{prefix}{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in VALUES])


def resolve_nodes(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes from mentions (ord, name, curie, iri, raw_id, labels array, props map): mentions that share a key are one node.

    The node's key is the best of its keys (curie, iri, id, name; then the least). Names and properties are those of the last mention
    that has them; labels add up. Returns nodes (key, name, ontology_id, iri, raw_id, labels, props, keys) and the key of each distinct
    mention (name, curie, iri, raw_id, key). Names are normalized, and keys and components made, for distinct mentions only.
    """
    distinct = mentions.groupBy(*VALUES).agg(F.max("ord").alias("ord"), F.array_distinct(F.flatten(F.collect_set("labels"))).alias("labels"))
    keyed = cut(distinct.withColumn("keys", text.all_keys(text.canon_name("name"), "curie", "iri", "raw_id")).where("size(keys) > 0"))
    pairs = keyed.select(F.element_at("keys", 1).alias("a"), F.explode("keys").alias("b")).distinct()
    roots = components(pairs)
    keyed = cut(keyed.withColumn("first", F.element_at("keys", 1)).join(roots.select(F.col("id").alias("first"), "component"), "first", "left").withColumn("component", F.coalesce("component", "first")))
    rank = F.when(F.col("k").startswith("curie:"), 0).when(F.col("k").startswith("iri:"), 1).when(F.col("k").startswith("id:"), 2).otherwise(3)
    best = cut(keyed.select("component", F.explode("keys").alias("k")).groupBy("component").agg(F.min_by("k", F.struct(rank, "k")).alias("key"), F.array_sort(F.collect_set("k")).alias("keys")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    scalars = keyed.withColumns({"curie": text.norm_curie("curie"), "iri": text.norm_iri("iri"), "raw_id": F.trim(text.na_to_null("raw_id"))}).groupBy("component").agg(last("name"), last("curie"), last("iri"), last("raw_id"))
    labels = keyed.select("component", F.explode("labels").alias("l")).where(~text.is_na("l")).groupBy("component").agg(F.array_sort(F.collect_set(text.sanitize_label(alias("l", LABEL_ALIASES)))).alias("labels"))
    owners = keyed.select(*VALUES, "component").alias("k")
    each = mentions.where("size(props) > 0").select(*VALUES, "ord", F.explode("props").alias("p", "v")).groupBy(*VALUES, "p").agg(F.max_by("v", "ord").alias("v"), F.max("ord").alias("ord"))
    props = each.alias("m").join(owners, _same("m", "k")).groupBy("component", "p").agg(F.max_by("v", "ord").alias("v")).groupBy("component").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "v")))).alias("props"))
    out = best.join(scalars, "component").join(labels, "component", "left").join(props, "component", "left")
    nodes = out.select("key", "name", F.col("curie").alias("ontology_id"), "iri", "raw_id", F.coalesce("labels", F.expr("cast(array() as array<string>)")).alias("labels"), F.coalesce("props", F.expr("cast(map() as map<string, string>)")).alias("props"), "keys")
    return nodes, keyed.select(*VALUES, "component").join(best.select("component", "key"), "component").drop("component")


def build(triples: DataFrame) -> Graph:
    """A graph from triples: ord, subject, predicate, object, and where they are there source, mechanism, subject_/object_ ontology_id, iri, id and type.

    Triples are grouped by their values as they stand, and only what is left meets the keys of the mentions; edges are summed once more.
    """
    columns = {c.lower() for c in triples.columns}
    optional = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    known = ["ord", "subject", "predicate", "object", "source", "mechanism"] + [f"{x}_{y}" for x in ("subject", "object") for y in ("ontology_id", "iri", "id", "type")]
    clean = split_properties(clean_triples(triples), known)
    values = lambda x: dict(zip(VALUES, (F.trim(x), optional(f"{x}_ontology_id"), optional(f"{x}_iri"), optional(f"{x}_id")), strict=True))
    sides = [clean.select("ord", *[v.alias(k) for k, v in values(x).items()], F.array_compact(F.array(optional(f"{x}_type"))).alias("labels"), F.col(f"{x}_props").alias("props")) for x in ("subject", "object")]
    nodes, lookup = resolve_nodes(sides[0].unionByName(sides[1]))
    ends = [v.alias(f"{p}_{k}") for p, x in (("src", "subject"), ("dst", "object")) for k, v in values(x).items()]
    facts = [relations.raw_type("predicate").alias("predicate_raw"), relations.relation_of("predicate").alias("relation"), alias(optional("source"), SOURCE_ALIASES).alias("source"), optional("mechanism").alias("mechanism")]
    rows = clean.select("ord", *ends, *facts, F.col("edge_props").alias("props"))
    same = ["predicate_raw", "relation", "source", "mechanism"]
    whole = rows.groupBy(*[f"{p}_{k}" for p in ("src", "dst") for k in VALUES], *same).agg(F.count(F.lit(1)).alias("n"), F.max_by("props", "ord").alias("props"), F.max("ord").alias("ord"))
    lookup = cut(lookup)
    for p in ("src", "dst"):
        whole = whole.alias("t").join(lookup.alias("k"), _same("t", "k", f"{p}_")).select("t.*", F.col("k.key").alias(p))
    edges = whole.groupBy("src", "dst", *same).agg(F.sum("n").alias("n"), F.max_by("props", "ord").alias("props"))
    return Graph(nodes.drop("keys"), edges.withColumn("bel_relation", relations.bel_of("relation")))


def preview(triples: DataFrame) -> DataFrame:
    """A dry run: how many triples there are, and how many would make edges. Nothing is written."""
    usable = ~(text.is_na("subject") | text.is_na("predicate") | text.is_na("object"))
    counts = triples.agg(F.count(F.lit(1)).alias("triples"), F.count_if(usable).alias("usable"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("count")) for c in ("triples", "usable")])).alias("r")).select("r.*")


def unique_keys(nodes: DataFrame) -> DataFrame:
    """Keys that stand for more than one row: empty where the constraint holds."""
    return nodes.groupBy("key").count().where("count > 1")


def first_known_label(labels, vocabulary=LABELS):
    return F.coalesce(F.try_element_at(F.filter(labels, lambda x: x.isin(*vocabulary)), F.lit(1)), F.lit(""))


def relabel(nodes: DataFrame, reviewed: DataFrame, vocabulary=LABELS) -> DataFrame:
    """Applies a review (key, new_label): the present label and Unknown go, the new one comes; adds changed."""
    now = first_known_label(F.col("labels"), vocabulary)
    joined = nodes.join(reviewed.select("key", "new_label"), "key", "left")
    fits = F.coalesce(F.col("new_label").isin(*vocabulary) & (F.col("new_label") != now), F.lit(False))
    new = F.array_union(F.array_except("labels", F.array(now, F.lit("Unknown"))), F.array("new_label"))
    return joined.withColumn("changed", fits).withColumn("labels", F.when(F.col("changed"), new).otherwise(F.col("labels"))).drop("new_label")
