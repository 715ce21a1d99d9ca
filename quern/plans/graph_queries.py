"""The catalogue of graph questions. Each takes a Graph and its keyword, label and type lists, and returns a DataFrame.

Filters go on each leg before legs are joined. Where a limit cuts a result, the order is total: ties fall to the names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import contains_any
from quern.plans.graph import Graph
from quern.plans.iterate import all_shortest_paths, component_counts, cut, louvain

# Edge types and keywords of the questions as they are asked.
CAUSAL = ("CAUSES", "LEADS_TO", "INDUCES", "TRIGGERS", "RESULTS_IN")
CAUSAL_OR_CHANGE = (*CAUSAL, "INCREASES", "DECREASES")
CAUSAL_OR_ACTIVE = ("CAUSES", "LEADS_TO", "INDUCES", "TRIGGERS", "ACTIVATES")
REGULATORY = ("INHIBITS", "ACTIVATES", "REGULATES", "MODULATES")
CAUSE_WORDS = ("covid", "sars-cov-2", "viral entry")
OUTCOME_WORDS = ("neurodegeneration", "cognitive decline", "memory loss", "dementia")
BRIDGE_LABELS = ("Biological_Process", "Chemical", "Gene", "Protein")
TARGET_LABELS = ("Gene", "Protein", "Chemical")


def has_label(column, labels) -> F.Column:
    return F.arrays_overlap(column, F.array(*[F.lit(x) for x in labels]))


def joined(labels):
    """An array of labels as one string, for grouping and output."""
    return F.array_join(F.array_sort(labels), "|")


def top(df: DataFrame, limit: int | None, *order) -> DataFrame:
    return df.orderBy(*order).limit(limit) if limit else df


def hubs(g: Graph, source: str, limit: int | None = 20) -> DataFrame:
    """Names with the most edges of a source, at either end."""
    ends = g.incidences().where(F.col("source") == source).groupBy("key").agg(F.count(F.lit(1)).alias("d"))
    named = ends.join(g.nodes.select("key", "name"), "key").groupBy(F.col("name").alias("entity")).agg(F.sum("d").alias("degree"))
    return top(named, limit, F.desc("degree"), "entity")


def label_distribution(g: Graph) -> DataFrame:
    return g.nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def degrees(g: Graph) -> DataFrame:
    d = g.incidences().groupBy("key").agg(F.count(F.lit(1)).alias("degree"))
    return g.nodes.join(d, "key", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def degree_distribution(g: Graph) -> DataFrame:
    return degrees(g).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes_with_degree"))


def top_connected(g: Graph, limit: int | None = 20) -> DataFrame:
    return top(degrees(g).select(joined("labels").alias("node_labels"), F.col("key").alias("node"), "degree"), limit, F.desc("degree"), "node")


def relation_types_by_source(g: Graph) -> DataFrame:
    return g.edges.where("source is not null").groupBy(F.col("predicate_raw").alias("relationship_type"), "source").agg(F.count(F.lit(1)).alias("count"))


def triples_by_source(g: Graph) -> DataFrame:
    # Few label sets, many edges: edges are counted by their ends' labels after one join each with narrow columns.
    e = g.named().where("source is not null")
    return e.groupBy("source", joined("src_labels").alias("subject_labels"), F.col("predicate_raw").alias("predicate_type"), joined("dst_labels").alias("object_labels")).agg(F.count(F.lit(1)).alias("triple_count"))


def nodes_per_source(g: Graph) -> DataFrame:
    """Distinct sources plus distinct targets: a node on both sides counts twice, as asked."""
    return g.edges.where("source is not null").groupBy("source").agg((F.count_distinct("src") + F.count_distinct("dst")).alias("unique_nodes_count"))


def density(g: Graph) -> DataFrame:
    counts = g.nodes.agg(F.count(F.lit(1)).alias("node_count")).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("rel_count")))  # one row each
    pairs = F.nullif(F.col("node_count") * (F.col("node_count") - 1), F.lit(0)).cast("double")
    return counts.select("node_count", "rel_count", (F.col("rel_count") / pairs).alias("directed_density"), (F.col("rel_count") * 2 / pairs).alias("undirected_density"))


def components_per_source(g: Graph) -> DataFrame:
    return component_counts(g.nodes, g.edges)


def focus_mentions(g: Graph, focuses: dict[str, tuple[str, ...]], source: str = "GPT") -> DataFrame:
    """How many edges of a source have a keyword at either end, for each focus."""
    e = g.named().where(F.col("source") == source)
    out = None
    for name, words in focuses.items():
        one = e.where(contains_any("src_name", words) | contains_any("dst_name", words)).agg(F.lit(name).alias("focus"), F.count(F.lit(1)).alias("mentions"))
        out = one if out is None else out.unionByName(one)
    return out


def _leg(g: Graph, k: int, types=None) -> DataFrame:
    e = g.edges.where(F.col("predicate_raw").isin(*types)) if types else g.edges
    identity = F.xxhash64("src", "predicate_raw", "dst", "source", "mechanism")
    return e.select(F.col("src").alias(f"v{k - 1}"), F.col("dst").alias(f"v{k}"), F.col("predicate_raw").alias(f"t{k}"), F.col("source").alias(f"s{k}"), identity.alias(f"e{k}"))


def _nodes(g: Graph, k: int, *more) -> DataFrame:
    return g.nodes.select(F.col("key").alias(f"v{k}"), F.col("name").alias(f"n{k}"), F.col("labels").alias(f"l{k}"), *more)


def causal_chains(g: Graph, start_words, end_words, types=("CAUSES", "LEADS_TO"), least: int = 2, most: int = 4, limit: int | None = 10) -> DataFrame:
    """Chains of least to most edges of given types between keywords; an edge occurs once in a chain. Nodes as key > key > key."""
    ends = g.nodes.where(contains_any("name", end_words)).select(F.col("key").alias("at"))
    out, grown = None, None
    for k in range(1, most + 1):
        leg = _leg(g, k, types)
        if grown is None:
            first = g.nodes.where(contains_any("name", start_words)).select(F.col("key").alias("v0"))
            grown = leg.join(first, "v0").select(F.col("v1").alias("at"), F.concat_ws(" > ", "v0", "v1").alias("nodes"), F.col("t1").alias("types"), F.array("e1").alias("used"))
        else:
            step = leg.select(F.col(f"v{k - 1}").alias("at"), F.col(f"v{k}").alias("to"), F.col(f"t{k}").alias("t"), F.col(f"e{k}").alias("e"))
            grown = grown.join(step, "at").where(~F.array_contains("used", F.col("e"))).select(F.col("to").alias("at"), F.concat_ws(" > ", "nodes", "to").alias("nodes"), F.concat_ws(" > ", "types", "t").alias("types"), F.array_append("used", F.col("e")).alias("used"))
        if k >= least:
            found = grown.join(ends, "at").select("nodes", "types", F.lit(k).alias("hops"))
            out = found if out is None else out.unionByName(found)
    return top(out, limit, "hops", "nodes", "types")


def cascade(g: Graph, start_words, end_words, types=CAUSAL, limit: int | None = 10) -> DataFrame:
    """Three causal steps from one keyword set to another, with the source of each step."""
    a = _leg(g, 1, types).join(_nodes(g, 0).where(contains_any("n0", start_words)), "v0")
    c = _leg(g, 3, types).join(_nodes(g, 3).where(contains_any("n3", end_words)), "v3")
    b = _leg(g, 2, types)
    paths = a.join(b, "v1").join(c, "v2").where("e1 <> e2 and e2 <> e3 and e1 <> e3").join(_nodes(g, 1), "v1").join(_nodes(g, 2), "v2")
    columns = {"n0": "initial_trigger", "t1": "step1", "s1": "source1", "n1": "mechanism1", "t2": "step2", "s2": "source2", "n2": "mechanism2", "t3": "step3", "s3": "source3", "n3": "final_outcome"}
    return top(paths.select(*[F.col(k).alias(v) for k, v in columns.items()]), limit, *columns.values())


def only_in(g: Graph, types=CAUSAL, other_types=CAUSAL_OR_CHANGE, source="GPT", other="CBM", limit: int | None = 20) -> DataFrame:
    """Edges of a source and type between nodes that no edge of the other source and types joins."""
    there = g.edges.where((F.col("source") == other) & F.col("predicate_raw").isin(*other_types)).select("src", "dst").distinct()
    mine = Graph(g.nodes, g.edges.where((F.col("source") == source) & F.col("predicate_raw").isin(*types)).join(there, ["src", "dst"], "left_anti"))
    found = mine.named().groupBy(joined("src_labels").alias("cause_type"), F.col("src_name").alias("cause"), F.col("predicate_raw").alias("causal_relationship"), joined("dst_labels").alias("effect_type"), F.col("dst_name").alias("effect")).agg(F.count(F.lit(1)).alias("frequency"))
    return top(found, limit, F.desc("frequency"), "cause", "causal_relationship", "effect", "cause_type", "effect_type")


def only_in_same_type(g: Graph, labels=("Biological_Process",), types=CAUSAL_OR_ACTIVE, source="GPT", other="CBM", limit: int | None = 15) -> DataFrame:
    """Edges of a source that the other source lacks with the same ends and type, with a label at an end or of given types."""
    there = g.edges.where(F.col("source") == other).select("src", "dst", "predicate_raw").distinct()
    mine = Graph(g.nodes, g.edges.where(F.col("source") == source).join(there, ["src", "dst", "predicate_raw"], "left_anti")).named()
    mine = mine.where(has_label("src_labels", labels) | has_label("dst_labels", labels) | F.col("predicate_raw").isin(*types))
    found = mine.groupBy(joined("src_labels").alias("subject_type"), F.col("src_name").alias("subject"), F.col("predicate_raw").alias("relationship"), joined("dst_labels").alias("object_type"), F.col("dst_name").alias("object")).agg(F.count(F.lit(1)).alias("frequency"))
    return top(found, limit, F.desc("frequency"), "subject", "relationship", "object", "subject_type", "object_type")


def direct_links(g: Graph, start_words, end_words) -> DataFrame:
    e = g.named().where(contains_any("src_name", start_words) & contains_any("dst_name", end_words))
    return e.groupBy(joined("src_labels").alias("start_type"), F.col("src_name").alias("start_entity"), F.col("predicate_raw").alias("relationship"), "source", joined("dst_labels").alias("end_type"), F.col("dst_name").alias("end_entity")).agg(F.count(F.lit(1)).alias("frequency"))


def bridges(g: Graph, start_words, end_words, labels=BRIDGE_LABELS, literal: bool = False, limit: int | None = 20) -> DataFrame:
    """Two steps over a bridge. literal: AND binds before OR, so that all labels but the first need no keywords at the ends."""
    keys = contains_any("n0", start_words) & contains_any("n2", end_words)
    if literal:
        a, c = _leg(g, 1), _leg(g, 2)
        a = a.join(_nodes(g, 0), "v0")
        c = c.join(_nodes(g, 2), "v2")
    else:
        a = _leg(g, 1).join(_nodes(g, 0).where(contains_any("n0", start_words)), "v0")
        c = _leg(g, 2).join(_nodes(g, 2).where(contains_any("n2", end_words)), "v2")
    # Each leg is counted before they meet. Self-loops aside, two steps of one pattern are two edges: a node's loops of a kind don't follow themselves.
    mid = _nodes(g, 1).where(has_label("l1", labels)).select("v1", "n1", joined("l1").alias("bridge"), has_label("l1", labels[:1]).alias("first"), (has_label("l1", labels[1:]) if labels[1:] else F.lit(False)).alias("others"))
    a = a.groupBy("v1", "n0", "t1", "s1").agg(F.count(F.lit(1)).alias("ca"), F.count_if(F.col("v0") == F.col("v1")).alias("la"))
    c = c.groupBy("v1", "t2", "s2", "n2").agg(F.count(F.lit(1)).alias("cc"), F.count_if(F.col("v2") == F.col("v1")).alias("lc"))
    want = F.expr("others") | (keys & F.expr("first")) if literal else keys
    twice = F.when((F.col("la") > 0) & (F.col("lc") > 0) & (F.col("t1") == F.col("t2")) & F.col("s1").eqNullSafe(F.col("s2")), F.col("lc")).otherwise(0)
    names = {"n0": "path_start", "t1": "first_relationship", "s1": "source1", "bridge": "bridge_type", "n1": "bridging_mechanism", "t2": "second_relationship", "s2": "source2", "n2": "path_end"}

    def found(legs: DataFrame) -> DataFrame:
        paths = legs.join(c, "v1").where(want).groupBy(*[F.col(k).alias(v) for k, v in names.items()])
        return top(paths.agg(F.sum(F.col("ca") * F.col("cc") - twice).alias("pathway_count")).where("pathway_count > 0"), limit, F.desc("pathway_count"), *names.values())

    if not limit:
        return found(a.join(mid, "v1"))
    # A start's paths over one bridge name and on by one kind of edge are at most its edges times the most that go on so from each bridge. What that bound
    # leaves below the last of the rows found for the starts with the greatest bounds can't be among the first, and isn't paired.
    c = cut(c)
    most = c.groupBy("v1").agg(F.max("cc").alias("most"))
    group = ["n0", "t1", "s1", "bridge", "n1"]
    a = cut(a.join(mid, "v1").join(most, "v1").withColumn("bound", F.sum(F.col("ca") * F.col("most")).over(W.partitionBy(*group))))
    seeds = a.groupBy(*group).agg(F.max("bound").alias("bound")).orderBy(F.desc("bound"), *group).limit(limit)
    seeds = seeds.select(*[F.col(k).alias(f"seed_{k}") for k in group])
    rows = found(a.join(seeds, [F.col(k).eqNullSafe(F.col(f"seed_{k}")) for k in group], "left_semi")).collect()  # no more than the limit
    if len(rows) < limit:
        return found(a)
    last, start = rows[-1]["pathway_count"], rows[-1]["path_start"]
    tie = F.col("n0").isNull() | (F.col("n0") <= start) if start is not None else F.col("n0").isNull()
    return found(a.where((F.col("bound") > last) | ((F.col("bound") == last) & tie)))


def shortest_paths(g: Graph, start_words, end_words, labels=None, depth: int = 5, limit: int | None = 20) -> DataFrame:
    """All shortest undirected paths between keyword sets whose inner nodes bear one of the labels (a filter after the search)."""
    find = lambda words: g.nodes.where(contains_any("name", words)).select(F.col("key").alias("id"))
    barred = g.nodes.where(~has_label("labels", labels)).select("key") if labels else None
    paths = all_shortest_paths(find(start_words), find(end_words), g.edges, depth, barred=barred, least=limit)
    out = paths.select(F.col("start").alias("path_start"), F.col("end").alias("path_end"), F.col("hops").cast("long").alias("hops"), F.array_join("nodes", " > ").alias("nodes"))
    return top(out, limit, "hops", "nodes")


def source_sets(g: Graph) -> DataFrame:
    return g.edges.groupBy("src", F.col("predicate_raw").alias("rel"), "dst").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def shared_triples(g: Graph) -> DataFrame:
    """Triples that more than one source has."""
    return source_sets(g).where("size(sources) > 1").select("src", "rel", "dst", F.array_join("sources", "|").alias("sources"))


def unique_triples(g: Graph) -> DataFrame:
    """Triples that exactly one source has."""
    return source_sets(g).where("size(sources) = 1").select("src", "rel", "dst", F.array_join("sources", "|").alias("sources"))


def targets(g: Graph, first_words, second_words, labels=TARGET_LABELS, types=None, limit: int | None = 10) -> DataFrame:
    """Nodes with edges to both keyword sets. The two edges may be one: they are matched apart.

    Both sides are grouped by target before they meet, so that no target's edges are paired.
    """
    e = g.named().where(has_label("src_labels", labels))
    e = e.where(F.col("predicate_raw").isin(*types)) if types else e
    group = [joined("src_labels").alias("target_type"), F.col("src_name").alias("potential_target")]
    first = e.where(contains_any("dst_name", first_words)).groupBy("src", *group).agg(F.collect_set("dst_name").alias("a"), F.collect_set("source").alias("s"))
    second = e.where(contains_any("dst_name", second_words)).groupBy("src").agg(F.collect_set("dst_name").alias("b"))
    both = first.join(second, "src").groupBy("target_type", "potential_target").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("a", "b", "s")])
    show = lambda c, n: F.array_join(c, "|").alias(n)
    found = both.select("target_type", "potential_target", show("a", "first_connections"), show("b", "second_connections"), show("s", "evidence_sources"), (F.size("a") + F.size("b")).cast("long").alias("connections"))
    return top(found, limit, F.desc("connections"), "potential_target", "target_type")


def repurposing(g: Graph, process_words, outcome_words, labels=("Chemical",), name_words=("drug", "therapy"), fold_case: bool = True) -> DataFrame:
    """Two steps from a drug over a process to an outcome. fold_case: whether words in the drug's name match in any case."""
    name = F.coalesce("src_name", F.lit(""))
    named = contains_any(name, name_words) if fold_case else F.expr(" or ".join(f"contains(src_name, '{w}')" for w in name_words))
    # Processes and outcomes are few, so that edges meet them first. Steps over one node are one edge only if that is the node's loop.
    step = lambda e, k, *more: e.select(*more, F.col("dst_name").alias(f"n{k}"), F.col("predicate_raw").alias(f"t{k}"), F.col("source").alias(f"s{k}"), F.col("loop").alias(f"e{k}"))
    first = g.named(("dst", "src")).where(contains_any("dst_name", process_words)).where(has_label("src_labels", labels) | named)
    a = step(first, 1, F.col("dst").alias("v1"), F.col("src_name").alias("n0"))
    c = step(g.named(("dst",)).where(contains_any("dst_name", outcome_words)), 2, F.col("src").alias("v1"))
    paths = a.join(c, "v1").where("e1 is null or e2 is null or not (e1 <=> e2)")
    return paths.select(F.col("n0").alias("potential_drug"), F.col("n1").alias("process_target"), F.col("t1").alias("drug_effect"), F.col("s1").alias("evidence_source1"), F.col("n2").alias("outcome"), F.col("t2").alias("mechanism"), F.col("s2").alias("evidence_source2"))


def mechanism_frequency(g: Graph, least: int = 5) -> DataFrame:
    counts = g.edges.where("source is not null and mechanism is not null").groupBy("source", "mechanism").agg(F.count(F.lit(1)).alias("c"))
    often = F.when(F.col("c") >= least, F.col("mechanism"))
    return counts.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set(often)), "|").alias("frequent_mechanisms"), F.count(often).alias("frequent_mechanism_count"), F.count(F.lit(1)).alias("total_unique_mechanisms"))


def mechanism_cross(g: Graph, first: str = "GPT", second: str = "CBM", literal: bool = False) -> DataFrame:
    """Mechanisms of both sources. literal: without equality each edge of one meets each of the other, so both counts are a product."""
    count = lambda s: F.sum(F.when(F.col("source") == s, 1).otherwise(0))
    counts = g.edges.where("mechanism is not null").groupBy("mechanism").agg(count(first).alias("a"), count(second).alias("b"))
    if literal:
        total = g.edges.where((F.col("source") == second) & F.col("mechanism").isNotNull()).agg(F.count(F.lit(1)).alias("total"))
        counts = counts.crossJoin(F.broadcast(total)).select("mechanism", (F.col("a") * F.col("total")).alias("a"), (F.col("a") * F.col("total")).alias("b"))  # total is one row
    return counts.where("a > 0 and b > 0").select("mechanism", F.col("a").alias("first_count"), F.col("b").alias("second_count"), F.abs(F.col("a") - F.col("b")).alias("count_difference"), (F.col("a") + F.col("b")).alias("total_evidence"))


def node_schema(g: Graph) -> DataFrame:
    """Properties of each label set with the types they have."""
    types = {c: g.nodes.schema[c].dataType.simpleString() for c in g.nodes.columns if c not in ("labels", "props")}
    pairs = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("p"), F.lit(t).alias("t"))) for c, t in types.items()])
    rows = g.nodes.select(joined("labels").alias("node_labels"), F.explode(F.array_compact(pairs)).alias("x"))
    return rows.groupBy("node_labels", F.col("x.p").alias("property_name")).agg(F.array_join(F.array_sort(F.collect_set("x.t")), "|").alias("property_types"))


def relation_schema(g: Graph) -> DataFrame:
    types = {c: g.edges.schema[c].dataType.simpleString() for c in g.edges.columns if c not in ("src", "dst", "predicate_raw", "props")}
    pairs = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("p"), F.lit(t).alias("t"))) for c, t in types.items()])
    # Grouped before properties are exploded: there are few types and label sets.
    seen = g.named().groupBy(F.col("predicate_raw").alias("relationship_type"), joined("src_labels").alias("source_labels"), joined("dst_labels").alias("target_labels")).agg(F.array_distinct(F.flatten(F.collect_set(F.array_compact(pairs)))).alias("xs"))
    return seen.select("relationship_type", "source_labels", "target_labels", F.explode("xs").alias("x")).select("relationship_type", "source_labels", "target_labels", F.col("x.p").alias("property_name"), F.col("x.t").alias("property_types"))


def projection_nodes(g: Graph, source: str = "CBM") -> DataFrame:
    e = g.edges.where(F.col("source") == source)
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()


def projection_edges(g: Graph, source: str = "CBM") -> DataFrame:
    return g.edges.where(F.col("source") == source).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def communities(g: Graph, source: str = "CBM") -> DataFrame:
    return louvain(g.edges.where(F.col("source") == source))


def named_nodes(g: Graph) -> DataFrame:
    return g.nodes.where("name is not null").select(F.col("key").alias("id"), F.col("name").alias("entity"), joined("labels").alias("labels"))


def star_edges(g: Graph, drugs, targets_, types) -> DataFrame:
    """Edges of given types from listed drugs to listed targets, names compared in lower case with spaces for _."""
    plain = lambda c: F.translate(F.lower(c), "_", " ")
    e = g.named().where(F.col("predicate_raw").isin(*types))
    e = e.where(plain("src_name").isin(*[x.lower() for x in drugs]) & plain("dst_name").isin(*[x.lower() for x in targets_]))
    return e.select(F.col("src_name").alias("drug"), F.col("dst_name").alias("target"), F.col("predicate_raw").alias("rel"), "source")


def fuzzy_unique(g: Graph, distance: int = 2, similarity: float = 0.92, prefix: int = 10) -> DataFrame:
    """Names (of nodes with outgoing edges) by fuzzy key, of which only one source has a variant.

    The key is the Soundex code and the first characters of the cleaned name; variants close to the least one by edit distance or
    Jaro-Winkler similarity make the group.
    """
    from quern.functions.similarity import jaro_winkler

    named = g.edges.where("source is not null").select("src", "source").distinct().join(g.nodes.where("name is not null").select(F.col("key").alias("src"), "name", joined("labels").alias("entity_type")), "src")
    clean = F.regexp_replace(F.lower("name"), r"(?U)[^\w]", "")
    denoised = F.regexp_replace(F.regexp_replace(clean, r"\b(disease|syndrome|disorder)\b", ""), r"\s+", " ")
    keyed = named.select("source", "entity_type", "name", F.concat(F.soundex(clean), F.lit(":"), F.left(denoised, F.lit(prefix))).alias("fuzzy_bucket")).distinct()
    seeds = keyed.groupBy("source", "entity_type", "fuzzy_bucket").agg(F.min("name").alias("seed"))
    near = keyed.join(seeds, ["source", "entity_type", "fuzzy_bucket"]).where((F.levenshtein(F.lower("name"), F.lower("seed")) <= distance) | (jaro_winkler(F.lower("name"), F.lower("seed")) >= similarity))
    tight = near.groupBy("source", "entity_type", "fuzzy_bucket").agg(F.min("name").alias("unique_entity"))
    one = tight.groupBy("entity_type", "fuzzy_bucket", "unique_entity").agg(F.array_sort(F.collect_set("source")).alias("sources")).where("size(sources) = 1")
    return one.select(F.col("sources")[0].alias("unique_to_source"), "entity_type", "unique_entity", "fuzzy_bucket")
