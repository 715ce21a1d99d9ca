"""Every operation over the driver's tables, by name, with the same in SQL where SQL can say it.

Orders, line items, parts, suppliers, customers and nations make a graph (FIXTURES.md, section 2); names of parts and the like stand in for
entities. Counts come out as longs and shares rounded, so that both engines show the same values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import relations, similarity, text
from quern.operators import categorize, clean, dedup, linking, match, parse
from quern.plans import graph_queries as Q
from quern.plans import reports
from quern.plans.graph import Graph, Part, build, first_known_label, relabel, unique_keys
from quern.plans.iterate import cut
from quern.sources.files import prompt
from quern.sources.plug import embed

QUERIES: dict = {}
SQL: dict[str, str] = {}

TYPES = {1: "CAUSES", 2: "LEADS_TO", 3: "INDUCES", 4: "TRIGGERS", 5: "INHIBITS", 6: "BINDS"}
SOURCES = {"A": "CBM", "N": "GPT"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, d: str) -> Graph:
    t = lambda name: table(spark, d, name)
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    kind, source = F.lit("RESULTS_IN"), F.when(F.col("rf") == "A", "CBM").when(F.col("rf") == "N", "GPT").otherwise("GPT-fulltext")
    for k, v in TYPES.items():
        kind = F.when(F.col("ln") == k, v).otherwise(kind)
    # Line items are dealt by part as numbers, grouped there, and meet their part's types there; keys and names are made last, so that none is
    # shuffled. A part's rows of one type are counted (m): an edge stands for as many triples as if rows had been joined before.
    code = F.when(F.col("l_linenumber").isin(*TYPES), F.col("l_linenumber")).otherwise(0).cast("byte")
    flag = F.when(F.col("l_returnflag").isin(*SOURCES), F.col("l_returnflag")).otherwise("")
    items = t("lineitem").where("l_partkey is not null").select("l_orderkey", "l_partkey", "l_suppkey", code.alias("ln"), flag.alias("rf"))
    parts = t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("mech")).repartition("l_partkey").groupBy("l_partkey", "mech").agg(F.count(F.lit(1)).alias("m"))
    dealt = lambda df, end: df.select(end, "l_partkey", "ln", "rf").repartition("l_partkey").groupBy(end, "l_partkey", "ln", "rf").agg(F.count(F.lit(1)).alias("n")).join(parts, "l_partkey").withColumn("n", F.col("n") * F.col("m"))
    alone = lambda df, a, b, ln, rf, mech: df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).withColumns({"ln": F.lit(ln).cast("byte"), "rf": F.lit(rf), "mech": F.lit(mech)})
    ordered = items.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    kinds = {"customer": ("c_cust", "Cell"), "part": ("p_part", "Chemical"), "supplier": ("s_supp", "Gene"), "nation": ("n_nation", "Disease")}
    ends = {name: t(name).select(F.col(f"{short}key").alias("key"), F.col(f"{short[0]}_name").alias("name"), F.array(F.lit(label)).alias("labels")) for name, (short, label) in kinds.items()}
    shown = {"predicate_raw": kind, "source": source, "mechanism": F.col("mech"), "n": F.col("n")}

    def part(df: DataFrame, src: tuple[str, str], dst: tuple[str, str]) -> Part:
        rows = df.select(F.col(src[1]).alias("src"), F.col(dst[1]).alias("dst"), "ln", "rf", "mech", "n")
        return Part(rows, shown, {"src": ends[src[0]], "dst": ends[dst[0]]}, {"src": src[0], "dst": dst[0]}, "dst" if dst[1] == "l_partkey" else "src")

    made = [
        part(dealt(ordered, "o_custkey"), ("customer", "o_custkey"), ("part", "l_partkey")),
        part(dealt(items, "l_suppkey"), ("part", "l_partkey"), ("supplier", "l_suppkey")),
        part(alone(t("supplier"), "s_suppkey", "s_nationkey", 1, "A", "SUPPLY"), ("supplier", "s_suppkey"), ("nation", "s_nationkey")),
        part(alone(t("customer"), "c_nationkey", "c_custkey", 2, "N", "MARKET"), ("nation", "c_nationkey"), ("customer", "c_custkey")),
    ]
    nodes = reduce(DataFrame.unionByName, [df.withColumn("key", key(name, "key")) for name, df in ends.items()])
    return Graph(nodes, reduce(DataFrame.unionByName, [p.edges() for p in made]), made)


KG = """raw as (
  select concat('customer:', o_custkey) src, concat('part:', l_partkey) dst, l_linenumber ln, l_returnflag rf, p_type mech
    from lineitem join orders on l_orderkey = o_orderkey join part on p_partkey = l_partkey
  union all
  select concat('part:', l_partkey), concat('supplier:', l_suppkey), l_linenumber, l_returnflag, p_type from lineitem join part on p_partkey = l_partkey
  union all
  select concat('supplier:', s_suppkey), concat('nation:', s_nationkey), 1, 'A', 'SUPPLY' from supplier
  union all
  select concat('nation:', c_nationkey), concat('customer:', c_custkey), 2, 'N', 'MARKET' from customer),
edges as (select src, dst,
  case ln when 1 then 'CAUSES' when 2 then 'LEADS_TO' when 3 then 'INDUCES' when 4 then 'TRIGGERS' when 5 then 'INHIBITS' when 6 then 'BINDS' else 'RESULTS_IN' end as t,
  case rf when 'A' then 'CBM' when 'N' then 'GPT' else 'GPT-fulltext' end as source, mech as mechanism, count(*) as n from raw group by all),
nodes as (select concat('customer:', c_custkey) as key, c_name as name, 'Cell' as label from customer
  union all select concat('part:', p_partkey), p_name, 'Chemical' from part
  union all select concat('supplier:', s_suppkey), s_name, 'Gene' from supplier
  union all select concat('nation:', n_nationkey), n_name, 'Disease' from nation),
e as (select edges.*, a.name as sn, a.label as sl, b.name as dn, b.label as dl, row_number() over () as id
  from edges join nodes a on src = a.key join nodes b on dst = b.key),
ends as (select src as key, source from edges union all select dst, source from edges where src <> dst)"""
WITH = f"with {KG}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def on_graph(name: str, f, sql: str | None = None) -> None:
    query(name, sql and f"{WITH} {sql}")(lambda spark, d: f(graph(spark, d)))


def like(column: str, *words: str) -> str:
    return "(" + " or ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


def among(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# Graph questions.
for _name, _source in (("hubs_cbm", "CBM"), ("hubs_gpt", "GPT"), ("hubs_fulltext", "GPT-fulltext")):
    on_graph(_name, lambda g, s=_source: Q.hubs(g, s), f"select name as entity, count(*) as degree from ends join nodes using (key) where source = '{_source}' group by 1 order by 2 desc, 1 limit 20")
on_graph("scan_edges", lambda g: g.edges.select("src", "dst", "predicate_raw", "source", "mechanism", "n"), "select src, dst, t as predicate_raw, source, mechanism, n from edges")
on_graph("label_distribution", Q.label_distribution, "select label, count(*) as count from nodes group by 1")
on_graph("degree_distribution", Q.degree_distribution, "select degree, count(*) as nodes_with_degree from (select key, count(ends.key) as degree from nodes left join ends using (key) group by key) group by 1")
on_graph("top_connected", Q.top_connected, "select label as node_labels, nodes.key as node, count(ends.key) as degree from nodes left join ends on nodes.key = ends.key group by 1, 2 order by 3 desc, 2 limit 20")
on_graph("relation_types_by_source", Q.relation_types_by_source, "select t as relationship_type, source, count(*) as count from edges group by 1, 2")
on_graph("triples_by_source", Q.triples_by_source, "select source, sl as subject_labels, t as predicate_type, dl as object_labels, count(*) as triple_count from e group by 1, 2, 3, 4")
on_graph("nodes_per_source", Q.nodes_per_source, "select source, count(distinct src) + count(distinct dst) as unique_nodes_count from edges group by 1")
on_graph("density", Q.density, "select a as node_count, b as rel_count, b / (a * (a - 1)) as directed_density, 2 * b / (a * (a - 1)) as undirected_density from (select count(*) as a from nodes), (select count(*) as b from edges)")
on_graph("components_per_source", Q.components_per_source)
_FOCUS = {"RING": ("ring",), "WIDGET": ("widget", "gizmo")}
on_graph("focus_mentions", lambda g: Q.focus_mentions(g, _FOCUS), " union all ".join(f"select '{k}' as focus, count(*) as mentions from e where source = 'GPT' and ({like('sn', *w)} or {like('dn', *w)})" for k, w in _FOCUS.items()))
_LEG = f"l as (select * from e where t in {among(('CAUSES', 'LEADS_TO'))})"
on_graph("causal_2to4", lambda g: Q.causal_chains(g, ("nation_1",), ("ring",)), f""", {_LEG},
p2 as (select a.src v0, a.dst v1, b.dst v2, a.t t1, b.t t2, a.id i1, b.id i2, b.dn n from l a join l b on a.dst = b.src and a.id <> b.id where {like('a.sn', 'nation_1')}),
p3 as (select p.v0, p.v1, p.v2, c.dst v3, p.t1, p.t2, c.t t3, p.i1, p.i2, c.id i3, c.dn n from p2 p join l c on p.v2 = c.src and c.id not in (p.i1, p.i2)),
p4 as (select p.*, d.dst v4, d.t t4, d.dn m from p3 p join l d on p.v3 = d.src and d.id not in (p.i1, p.i2, p.i3)),
x as (select concat_ws(' > ', v0, v1, v2) as nodes, concat_ws(' > ', t1, t2) as types, cast(2 as int) as hops from p2 where {like('n', 'ring')}
union all select concat_ws(' > ', v0, v1, v2, v3), concat_ws(' > ', t1, t2, t3), 3 from p3 where {like('n', 'ring')}
union all select concat_ws(' > ', v0, v1, v2, v3, v4), concat_ws(' > ', t1, t2, t3, t4), 4 from p4 where {like('m', 'ring')})
select * from x order by hops, nodes, types limit 10""")
on_graph("causal_3hop", lambda g: Q.cascade(g, ("customer#00000000",), ("nation_2",)), f"""select a.sn as initial_trigger, a.t as step1, a.source as source1, a.dn as mechanism1, b.t as step2, b.source as source2, b.dn as mechanism2, c.t as step3, c.source as source3, c.dn as final_outcome
from e a join e b on a.dst = b.src join e c on b.dst = c.src
where {like('a.sn', 'customer#00000000')} and {like('c.dn', 'nation_2')} and a.t in {among(Q.CAUSAL)} and b.t in {among(Q.CAUSAL)} and c.t in {among(Q.CAUSAL)} and a.id <> b.id and b.id <> c.id and a.id <> c.id
order by all limit 10""")
on_graph("only_in_one_source", Q.only_in, f"""select sl as cause_type, sn as cause, t as causal_relationship, dl as effect_type, dn as effect, count(*) as frequency from e
where source = 'GPT' and t in {among(Q.CAUSAL)} and not exists (select 1 from edges m where m.src = e.src and m.dst = e.dst and m.source = 'CBM' and m.t in {among(Q.CAUSAL_OR_CHANGE)})
group by 1, 2, 3, 4, 5 order by 6 desc, 2, 3, 5, 1, 4 limit 20""")
on_graph("only_in_one_source_same_type", lambda g: Q.only_in_same_type(g, labels=("Gene",)), f"""select sl as subject_type, sn as subject, t as relationship, dl as object_type, dn as object, count(*) as frequency from e
where source = 'GPT' and (sl = 'Gene' or dl = 'Gene' or t in {among(Q.CAUSAL_OR_ACTIVE)}) and not exists (select 1 from edges m where m.src = e.src and m.dst = e.dst and m.source = 'CBM' and m.t = e.t)
group by 1, 2, 3, 4, 5 order by 6 desc, 2, 3, 5, 1, 4 limit 15""")
on_graph("direct_links", lambda g: Q.direct_links(g, ("widget", "bolt"), ("supplier#00000000",)), f"select sl as start_type, sn as start_entity, t as relationship, source, dl as end_type, dn as end_entity, count(*) as frequency from e where {like('sn', 'widget', 'bolt')} and {like('dn', 'supplier#00000000')} group by 1, 2, 3, 4, 5, 6")
_BRIDGE = "select a.sn as path_start, a.t as first_relationship, a.source as source1, a.dl as bridge_type, a.dn as bridging_mechanism, b.t as second_relationship, b.source as source2, b.dn as path_end, count(*) as pathway_count from e a join e b on a.dst = b.src and a.id <> b.id where {0} group by 1, 2, 3, 4, 5, 6, 7, 8 order by 9 desc, 1, 2, 3, 4, 5, 6, 7, 8 limit 20"
_KEYS = f"{like('a.sn', 'customer#00000')} and {like('b.dn', 'supplier#00000000')}"
_bridge_words = (("customer#00000",), ("supplier#00000000",))
on_graph("bridge_2hop", lambda g: Q.bridges(g, *_bridge_words), _BRIDGE.format(f"{_KEYS} and a.dl in {among(Q.BRIDGE_LABELS)}"))
on_graph("bridge_2hop_literal", lambda g: Q.bridges(g, *_bridge_words, literal=True), _BRIDGE.format(f"({_KEYS} and a.dl = 'Biological_Process') or a.dl in {among(Q.BRIDGE_LABELS[1:])}"))
on_graph("shortest_paths", lambda g: Q.shortest_paths(g, ("nation_7",), ("nation_9",), labels=("Gene", "Cell", "Chemical"), depth=4), f""", u as (select src, dst from edges union select dst, src from edges),
w1 as (select u.src as s, u.dst as v1 from u join nodes on u.src = key where {like('name', 'nation_7')}),
w2 as (select s, v1, dst as v2 from w1 join u on v1 = src), w3 as (select s, v1, v2, dst as v3 from w2 join u on v2 = src), w4 as (select s, v1, v2, v3, dst as v4 from w3 join u on v3 = src),
f as (select key as k from nodes where {like('name', 'nation_9')}),
p as (select s, k as t, 1 as hops, concat_ws(' > ', s, v1) as nodes from w1 join f on v1 = k union all select s, k, 2, concat_ws(' > ', s, v1, v2) from w2 join f on v2 = k
union all select s, k, 3, concat_ws(' > ', s, v1, v2, v3) from w3 join f on v3 = k union all select s, k, 4, concat_ws(' > ', s, v1, v2, v3, v4) from w4 join f on v4 = k),
q as (select *, min(hops) over (partition by s, t) as least from p),
r as (select s as path_start, t as path_end, cast(hops as bigint) as hops, nodes from q where hops = least)
select * from r where not exists (select 1 from (select unnest(string_split(nodes, ' > ')[2:-2]) as k) x where starts_with(x.k, 'nation')) order by hops, nodes limit 20""")
_SETS = "select src, t as rel, dst, array_to_string(list_sort(list(distinct source)), '|') as sources from edges group by 1, 2, 3 having count(distinct source) {0} 1"
on_graph("shared_triples", Q.shared_triples, _SETS.format(">"))
on_graph("unique_triples", Q.unique_triples, _SETS.format("="))
_TARGET = """, a as (select src, sl, sn, dn, source from e where sl in {labels} and {first} {types}), b as (select src, dn from e where sl in {labels} and {second} {types}),
j as (select a.sl, a.sn, a.dn as x, b.dn as y, a.source from a join b using (src))
select sl as target_type, sn as potential_target, array_to_string(list_sort(list(distinct x)), '|') as first_connections, array_to_string(list_sort(list(distinct y)), '|') as second_connections, array_to_string(list_sort(list(distinct source)), '|') as evidence_sources, count(distinct x) + count(distinct y) as connections
from j group by 1, 2 order by 6 desc, 2, 1 limit 10"""
_first, _second = ("supplier#00000000", "nation_1"), ("supplier#00000001", "nation_2")
for _name, _types in (("targets", None), ("targets_regulatory", ("INHIBITS", "BINDS"))):
    on_graph(_name, lambda g, t=_types: Q.targets(g, _first, _second, types=t), _TARGET.format(labels=among(Q.TARGET_LABELS), first=like("dn", *_first), second=like("dn", *_second), types=f"and t in {among(_types)}" if _types else ""))
_REPURPOSE = """, a as materialized (select * from e where (sl = 'Chemical' or {0}) and {1}), b as materialized (select * from e where {2})
select a.sn as potential_drug, a.dn as process_target, a.t as drug_effect, a.source as evidence_source1, b.dn as outcome, b.t as mechanism, b.source as evidence_source2 from a join b on a.dst = b.src and a.id <> b.id"""
for _name, _fold in (("repurposing", True), ("repurposing_case", False)):
    _own = like("sn", "supplier") if _fold else "contains(sn, 'supplier')"
    on_graph(_name, lambda g, f=_fold: Q.repurposing(g, ("supplier#00000000", "nation_1"), ("nation_2", "customer#00000000"), name_words=("supplier",), fold_case=f), _REPURPOSE.format(_own, like("dn", "supplier#00000000", "nation_1"), like("dn", "nation_2", "customer#00000000")))
on_graph("mechanism_frequency", lambda g: Q.mechanism_frequency(g, 500), """, c as (select source, mechanism, count(*) as c from edges group by 1, 2)
select source, coalesce(array_to_string(list_sort(list(mechanism) filter (c >= 500)), '|'), '') as frequent_mechanisms, count(*) filter (c >= 500) as frequent_mechanism_count, count(*) as total_unique_mechanisms from c group by 1""")
on_graph("mechanism_cross", Q.mechanism_cross, """, c as (select mechanism, count(*) filter (source = 'GPT') as a, count(*) filter (source = 'CBM') as b from edges group by 1)
select mechanism, a as first_count, b as second_count, abs(a - b) as count_difference, a + b as total_evidence from c where a > 0 and b > 0""")
on_graph("mechanism_cross_literal", lambda g: Q.mechanism_cross(g, literal=True), """, c as (select mechanism, count(*) * (select count(*) from edges where source = 'CBM') as a from edges where source = 'GPT' group by 1)
select mechanism, a as first_count, a as second_count, a - a as count_difference, a + a as total_evidence from c where a > 0""")
on_graph("node_schema", Q.node_schema, "select label as node_labels, unnest(['key', 'name']) as property_name, 'string' as property_types from (select distinct label from nodes)")
on_graph("relation_schema", Q.relation_schema, "select distinct t as relationship_type, sl as source_labels, dl as target_labels, p.n as property_name, p.k as property_types from e, (values ('source', 'string'), ('mechanism', 'string'), ('n', 'bigint')) p(n, k)")
on_graph("projection_nodes", Q.projection_nodes, "select src as id from edges where source = 'CBM' union select dst from edges where source = 'CBM'")
on_graph("projection_edges", Q.projection_edges, "select src, dst, count(*) as weight from edges where source = 'CBM' group by 1, 2")
on_graph("communities", Q.communities)
on_graph("named_nodes", Q.named_nodes, "select key as id, name as entity, label as labels from nodes")
on_graph("star_edges", lambda g: Q.star_edges(g, ("red widget", "blue ring"), ("SUPPLIER#000000001", "supplier#000000002"), ("INHIBITS", "BINDS")), "select sn as drug, dn as target, t as rel, source from e where lower(sn) in ('red widget', 'blue ring') and lower(dn) in ('supplier#000000001', 'supplier#000000002') and t in ('INHIBITS', 'BINDS')")
on_graph("fuzzy_unique", Q.fuzzy_unique)
on_graph("report_degrees", reports.degrees_by_source, "select key, count(*) filter (source = 'CBM') as deg_cbm, count(*) filter (source = 'GPT') as deg_gpt, count(*) filter (source = 'GPT-fulltext') as deg_gpt_fulltext, count(*) as deg_total from ends group by 1")
on_graph("report_shared_hubs", lambda g: reports.shared_hubs(g, ("nation_7",), ("nation_9",)), f""", u as (select src, dst from edges union select dst, src from edges),
a as (select key from nodes where {like('name', 'nation_7')}), a1 as (select key from a union select dst from u where src in (select key from a)), a2 as (select key from a1 union select dst from u where src in (select key from a1)),
b as (select key from nodes where {like('name', 'nation_9')}), b1 as (select key from b union select dst from u where src in (select key from b)), b2 as (select key from b1 union select dst from u where src in (select key from b1))
select name as entity, label as labels, count(*) as deg_total, count(*) filter (source = 'CBM') as deg_cbm, count(*) filter (source = 'GPT') as deg_gpt, count(*) filter (source = 'GPT-fulltext') as deg_gpt_fulltext, key
from ends join nodes using (key) where key in (select key from a2) and key in (select key from b2) group by key, name, label order by deg_total desc, entity, key limit 100""")
on_graph("report_neighbors", lambda g: reports.neighbors(g, ("supplier#00000000",)), f""", h as (select src as a, dst as b, source from edges union all select dst, src, source from edges where src <> dst)
select n.name as anchor, m.name as neighbor, m.label as labels, count(*) as deg_local, count(*) filter (source = 'CBM') as edges_cbm, count(*) filter (starts_with(source, 'GPT')) as edges_gpt, m.key as key
from h join nodes n on h.a = n.key join nodes m on h.b = m.key where {like('n.name', 'supplier#00000000')} group by 1, 2, 3, 7 order by 4 desc, 1, 7 limit 300""")
_anchor = (("supplier#000000001", "supplier#000000003"), ("nation_1", "nation_2"))
_PATHS = f""", u as (select src as x, dst as y, count(*) filter (source = 'CBM') as c, count(*) filter (starts_with(source, 'GPT')) as p from (select src, dst, source from edges union all select dst, src, source from edges) group by 1, 2),
a as (select key from nodes where {like('name', *_anchor[0])}), z as (select key from nodes where {like('name', *_anchor[1])}),
w1 as (select x as s, y as v1, c, p from u join a on x = key), w2 as (select s, v1, y as v2, w1.c + u.c as c, w1.p + u.p as p from w1 join u on v1 = x), w3 as (select s, v1, v2, y as v3, w2.c + u.c as c, w2.p + u.p as p from w2 join u on v2 = x),
r as (select s, v1 as t, 1 as hops, '' as mediators, c, p, [s, v1] as nodes from w1 union all select s, v2, 2, v1, c, p, [s, v1, v2] from w2 union all select s, v3, 3, concat_ws('|', v1, v2), c, p, [s, v1, v2, v3] from w3),
q as (select *, min(hops) over (partition by s, t) as least from r where t in (select key from z) and s <> t), best as (select * from q where hops = least)"""
on_graph("report_anchor_paths", lambda g: reports.anchor_paths(g, *_anchor), _PATHS + " select s as first_anchor, t as second_anchor, cast(hops as bigint) as hoplen, mediators, cast(c as bigint) as cbm_edges, cast(p as bigint) as gpt_edges from best")
on_graph("report_mediators", lambda g: reports.mediators(g, *_anchor), _PATHS + """, pairs as (select distinct least(nodes[i], nodes[i + 1]) as x, greatest(nodes[i], nodes[i + 1]) as y from (select nodes, unnest(range(1, len(nodes))) as i from best)),
inn as (select distinct unnest(nodes[2:-2]) as key from best), m as (select least(src, dst) as x, greatest(src, dst) as y, source from edges), t as (select x, y, source from m join pairs using (x, y)), h as (select x as key, source from t union all select y, source from t where x <> y)
select name as mediator, label as labels, count(*) as edges_on_paths, count(*) filter (source = 'CBM') as cbm_edges_on_paths, count(*) filter (starts_with(source, 'GPT')) as gpt_edges_on_paths, key from h join inn using (key) join nodes using (key) group by key, name, label""")


# Text, keys and relations.
NAMES = "select c_custkey as id, c_name as name from customer union all select 100000000 + p_partkey, p_name from part union all select 200000000 + n_nationkey, n_name from nation"


def names(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    return t("customer").selectExpr("c_custkey as id", "c_name as name").union(t("part").selectExpr("100000000 + p_partkey", "p_name")).union(t("nation").selectExpr("200000000 + n_nationkey", "n_name"))


def on_names(name: str, f, sql: str) -> None:
    query(name, f"with t as ({NAMES}) {sql}")(lambda spark, d: f(names(spark, d)))


on_names("normalize_eval", lambda t: t.select("id", text.normalize_eval("name").alias("value")), r"select id, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[_-]', ' ', 'g'), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) as value from t")
on_names("normalize_category", lambda t: t.select("id", text.normalize_category("name").alias("value")), r"select id, trim(regexp_replace(lower(regexp_replace(name, '[;_-]', ' ', 'g')), '\s+', ' ', 'g')) as value from t")
on_names("sanitize_label", lambda t: t.select("id", text.sanitize_label("name").alias("value"), text.sanitize_key(F.concat(F.col("id").cast("string"), F.col("name"))).alias("key")), "select id, regexp_replace(trim(name), '[^0-9A-Za-z_]', '_', 'g') as value, 'p_' || regexp_replace(lower(id || name), '[^a-z0-9_]', '_', 'g') as key from t")
on_names("curie_key", lambda t: t.select("id", text.norm_curie(F.concat(F.lit("mesh : 00"), F.col("id").cast("string"))).alias("curie"), text.norm_iri(F.concat(F.lit(" http://x.example/"), F.col("id").cast("string"), F.lit("//"))).alias("iri")), "select id, 'MESH:' || id as curie, 'https://x.example/' || id as iri from t")
on_names("entity_key", lambda t: t.select("id", text.entity_key(F.lower("name"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("go:"), F.col("id").cast("string"))), F.when(F.col("id") % 3 == 1, F.concat(F.lit("http://x/"), F.col("id").cast("string"))), F.lit("None")).alias("key")), "select id, case id % 3 when 0 then 'curie:GO:' || id when 1 then 'iri:https://x/' || id else 'name:' || lower(name) end as key from t")
on_names("trigram_jaccard", lambda t: t.select("id", F.round(text.jaccard_trigram("name", F.lit("red widget ring")), 6).alias("value")), """, g as (select id, list_distinct(list_transform(range(1, length(name) - 1), lambda k: substr(lower(name), k, 3))) as a, list_distinct(list_transform(range(1, 14), lambda k: substr('red widget ring', k, 3))) as b from t)
select id, case when len(a) = 0 then 0.0 else round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) end as value from g""")
on_names("token_coverage", lambda t: t.select("id", F.round(text.token_coverage("name", F.lit("old red widget pathway")), 6).alias("value"), text.head_noun("name").alias("head")), """, g as (select id, list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda x: length(x) >= 3)) as q, regexp_extract_all(lower(name), '[a-z0-9]+')[-1] as head from t)
select id, case when len(q) = 0 then 0.0 else round(len(list_intersect(q, ['old', 'red', 'widget'])) / len(q), 6) end as value, head from g""")
on_names("split_coordinated", lambda t: t.select("id", F.array_join(text.split_coordinated(F.replace(F.col("name"), F.lit(" "), F.lit(" and "))), "|").alias("parts")), "select id, case when contains(name, ' ') then replace(name, ' ', '|') else '' end as parts from t")
on_names("keys_of_text", lambda t: t.select("id", F.sha1("name").alias("sha1"), F.sha2("name", 256).alias("sha256"), F.soundex("name").alias("soundex"), F.levenshtein("name", F.lit("red widget")).cast("long").alias("distance")).drop("soundex"), "select id, sha1(name) as sha1, sha256(name) as sha256, levenshtein(name, 'red widget') as distance from t")
on_names("display_names", lambda t: t.select("id", text.display_name("name", {"nation 1": "First nation"}).alias("value")), "select id, case when name = 'NATION_1' then 'First nation' else replace(name, '_', ' ') end as value from t")
on_names("prompts", lambda t: t.select("id", prompt("Label {entity} (now {label}).", entity="name", label="id").alias("value")), "select id, 'Label ' || name || ' (now ' || id || ').' as value from t")
on_names("sample_distinct", lambda t: clean.sample_distinct(t, "name", 50), "select name from (select distinct name from t) order by md5('0' || name), name limit 50")
on_names("dedup_keep_first", lambda t: clean.keep_first(t, ["name"], "id"), "select id, name from t qualify row_number() over (partition by name order by id) = 1")

PREDICATES = ["activates", "does not activates", "does_not_activates", "dephosphorylation", "inactivates", "directly_increases", "directlyIncreases", "leads_to", "does not increase", "decreased", "does not decrease", "member of", "inhibited", "up-regulation of", "fails to inhibit", "positively correlates with", "binding", "part of", "localised to", "trafficking", "marker of", "no significant effect", "regulation", "PartOf the", "no increases", "subunit of", "anti-correlation", "elevating", "reduced", "interacts", ""]


def _relation_sql() -> str:
    """The ordered rules as CASE for an engine without look-around."""
    p = "lower(trim(p))"
    has = lambda pattern: f"regexp_matches({p}, '{pattern.replace(chr(39), chr(39) * 2)}')"

    def rule(relation: str, by_phrase: bool) -> str:
        for own, verb, other in ((("INCREASE", "DIRECT_INCREASE"), "increase", "DECREASE"), (("DECREASE", "DIRECT_DECREASE"), "decrease", "INCREASE")):
            if relation in own and by_phrase:
                none = has(rf"\b(no\s+{verb}|does\s+not\s+{verb}|fail(s|ed)?\s+to\s+{verb})\b")
                return f"case when {has(relations.NO_CHANGE)} or {has(relations.NEGATION)} then case when {none} then 'NO_EFFECT' else '{other}' end else '{relation}' end"
            if relation in own:
                none = has(rf"\b(does\s+not|fail(s|ed)?\s+to)\s+{verb}\b")
                return f"case when {has(relations.NO_CHANGE)} or {none} then 'NO_EFFECT' when {has(relations.NEGATION)} then '{other}' else '{relation}' end"
        return f"'{relation}'"

    whens = [f"when {p} = '{v.lower()}' then '{k}'" for k, v in relations.BEL.items()]
    whens += [f"when contains({p}, '{k}') then {rule(v, True)}" for k, v in relations.PHRASES.items()]
    whens += [f"when {has(rf'\b({v.lower()})\b')} then '{k}'" for k, v in relations.BEL.items()]
    whens += [f"when {has(rf'\b({pattern})\b')} then {rule(v, False)}" for pattern, v in relations.PATTERNS]
    whens += [f"when {has(pattern)} then '{v}'" for pattern, v in relations.STEMS]
    return f"case {' '.join(whens)} else 'ASSOCIATION' end"


@query("relation_map", f"with t as (select event_id, list_value({', '.join(repr(x) for x in PREDICATES)})[1 + event_id % {len(PREDICATES)}] as p from events) select event_id, p as predicate, {_relation_sql()} as relation from t")
def relation_map(spark, d):
    phrases = F.array(*[F.lit(x) for x in PREDICATES])
    t = table(spark, d, "events").select("event_id", F.element_at(phrases, (F.col("event_id") % len(PREDICATES) + 1).cast("int")).alias("predicate"))
    return t.select("event_id", "predicate", relations.relation_of("predicate").alias("relation"))


# Responses made of events: a header, then a triple for each remainder below event_id mod 4; every fifth has a bad line among them.
def responses(spark, d) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id as id", r"concat('Pathophysiological Process: ', event_type, '\nTriples:\n', if(event_id % 4 > 0, concat('user_', user_id, '| ', event_type, ' |k\n'), ''), if(event_id % 5 = 0, 'no triple here\n\n', ''), if(event_id % 4 > 1, concat(event_type, '|leads_to|', user_id), '')) as response")


_TRIPLES = """select event_id as id, event_type as mechanism, 'user_' || user_id as subject, event_type as predicate, 'k' as object from events where event_id % 4 > 0
union all select event_id, event_type, event_type, 'leads_to', cast(user_id as varchar) from events where event_id % 4 > 1"""


@query("parse_blocks", _TRIPLES)
def parse_blocks(spark, d):
    return parse.parse_blocks(responses(spark, d)).select("id", "mechanism", "subject", "predicate", "object")


@query("parse_paragraphs", f"select id, mechanism, subject, predicate, object from (select event_id as id, event_type as mechanism, 'user_' || user_id as subject, ' ' || event_type || ' ' as predicate, 'k' as object from events where event_id % 4 > 0 and event_id % 5 > 0 union all select event_id, event_type, event_type, 'leads_to', cast(user_id as varchar) from events where event_id % 4 > 1 and event_id % 5 > 0)")
def parse_paragraphs(spark, d):
    return parse.parse_paragraphs(responses(spark, d), ["id"]).select("id", "mechanism", "subject", "predicate", "object")


@query("run_log", "select event_id as id, case when event_type = 'error' then 'error' else 'ok' end as outcome, 1 as blocks, (event_id % 4 > 0)::int + (event_id % 4 > 1)::int as triples from events")
def run_log(spark, d):
    t = responses(spark, d).join(table(spark, d, "events").selectExpr("event_id as id", "event_type = 'error' as failed"), "id")
    return parse.run_log(t, failed="failed").select("id", "outcome", "blocks", "triples")


@query("filter_na", "select o_orderkey, case when o_orderstatus = 'P' then 'None' else o_orderstatus end as s from orders where o_orderstatus <> 'P'")
def filter_na(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", " None ").otherwise(F.col("o_orderstatus")).alias("s"))
    return t.where(~text.is_na("s"))


@query("answer_counts", "select count(*) as total, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type in ('click', 'view')) as relevant from events")
def answer_counts(spark, d):
    answer = F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "click", "Yes.").when(F.col("event_type") == "view", "Yes").otherwise("No.")
    return clean.answer_counts(table(spark, d, "events").select(answer.alias("answer")))


@query("address_flags", r"select page_id, starts_with(lower(url), 'https://') as is_https, contains(url, '?') as has_query, regexp_matches(lower(split_part(split_part(url, '?', 1), '#', 1)), '\.(png|jpe?g|gif|bmp|tiff?|webp|svg)$') as has_image_extension from pages")
def address_flags(spark, d):
    return table(spark, d, "pages").select("page_id", *[c.alias(k) for k, c in clean.address_flags("url").items()])


@query("semi_subset", "select event_id, user_id from events where user_id in (select user_id from (select distinct user_id from events) order by md5('0' || user_id), user_id limit 50)")
def semi_subset(spark, d):
    t = table(spark, d, "events").select("event_id", F.col("user_id"))
    keep = clean.sample_distinct(t.select(F.col("user_id").cast("string").alias("u")), "u", 50)
    return t.join(keep, t.user_id.cast("string") == keep.u, "left_semi")


@query("last_value_map", "select user_id, arg_max(event_type, event_id) as event_type from events group by 1")
def last_value_map(spark, d):
    t = table(spark, d, "events").select("event_id", F.format_number("user_id", 0).alias("user_id"), "event_type")
    return clean.last_value_map(t, "user_id", "event_type", "event_id")


@query("json_values", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_values(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").k.alias("k"))


@query("numeric_or_zero", "select event_id, cast(trunc(case when event_type = 'view' then 0 else value end) as bigint) as v from events")
def numeric_or_zero(spark, d):
    t = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "n/a").otherwise(F.col("value").cast("string")).alias("v"))
    return t.select("event_id", clean.numeric_or_zero("v").alias("v"))


@query("terms_by_category", """with t as (select p_brand as name, list(distinct p_name) as terms from part group by 1), s as (select unnest(['ring', 'widget']) as seed, unnest(['Rings', 'Widgets']) as category),
h as (select category, unnest(list_concat([name], terms)) as term from t join s on contains(lower(array_to_string(terms, ' ')), seed))
select category, array_to_string(list_sort(list(distinct term)), '|') as terms from h group by 1""")
def terms_by_category(spark, d):
    t = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.collect_set("p_name").alias("terms"))
    seeds = spark.createDataFrame([("ring", "Rings"), ("widget", "Widgets")], "seed string, category string")
    return clean.terms_by_category(t, seeds).select("category", F.array_join("terms", "|").alias("terms"))


@query("nearest_box", """with b as (select p_partkey as k, p_partkey // 10 as image, p_name as text, p_size as cx, p_partkey % 10 as cy from part), p as (select image, min(k) as point_id from b group by 1)
select image, point_id, arg_min(text, {'d': cx * cx + cy * cy, 'k': k}) as text from p join b using (image) group by 1, 2""")
def nearest_box(spark, d):
    t = table(spark, d, "part").select(F.expr("p_partkey div 10").alias("image"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("text"), F.col("p_size").alias("cx"), (F.col("p_partkey") % 10).alias("cy"))
    points = t.groupBy("image").agg(F.min("ord").alias("point_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return clean.nearest_box(points, t).select("image", "point_id", "text")


# Vectors.
def sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """Even vectors are predicted, odd ones gold; the label and a fifth of the ids make the group."""
    t = table(spark, d, "embeddings").select(F.concat_ws("_", F.lit("image"), (F.col("label") * 1000 + F.expr("vec_id div 100")).cast("string")).alias("image"), F.col("vec_id").alias("ord"), "embedding")
    return t.where("ord % 2 = 0"), t.where("ord % 2 = 1")


_PAIRS = """p as (select 'image_' || (label * 1000 + vec_id // 100) as image, vec_id as k, embedding as v from embeddings),
s as (select a.image, a.k as i, b.k as j, list_cosine_similarity(a.v::double[], b.v::double[]) as sim from p a join p b on a.image = b.image where a.k % 2 = 0 and b.k % 2 = 1)"""


@query("cosine_pairs", f"with {_PAIRS} select image, i, j, round(sim, 6) as sim from s")
def cosine_pairs(spark, d):
    return match.pair_similarities(*sides(spark, d)).withColumn("sim", F.round("sim", 6))


@query("similarity_histogram", f"with {_PAIRS}, r as (select round(sim, 9) as sim from s) select cast(least(floor((sim + 1) / 2 * 10), 9) as int) as bin, count(*) as count from r where sim between -1 and 1 group by 1")
def similarity_histogram(spark, d):
    return match.histogram(match.pair_similarities(*sides(spark, d)).withColumn("sim", F.round("sim", 9)), -1.0, 1.0)


@query("best_category", """with m as (select label, p, avg(embedding[p]::double) as v from embeddings, range(1, 65) r(p) group by 1, 2), k as (select label, list(v order by p) as e from m group by 1),
s as (select v.vec_id, k.label, round(list_cosine_similarity(v.embedding::double[], k.e), 9) as score from embeddings v, k), b as (select * from s qualify row_number() over (partition by vec_id order by score desc, label) = 1)
select vec_id, case when score > 0 and score >= 0.3 then 'c' || label else 'Uncategorized' end as category, round(greatest(score, 0), 6) as score from b""")
def best_category(spark, d):
    """Keywords are the mean vectors of the labels."""
    t = table(spark, d, "embeddings")
    means = t.select("label", F.posexplode("embedding").alias("p", "x")).groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("v"))
    vectors = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("e"))
    keywords = vectors.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"), F.col("label").alias("ord"), F.transform("e", lambda x: x.v).alias("embedding"))
    return categorize.best_category(t, keywords, threshold=0.3, key="vec_id").withColumn("score", F.round("score", 6))


@query("category_counts", "select p_type as category, count(*) as count from part group by 1")
def category_counts(spark, d):
    return categorize.category_counts(table(spark, d, "part").select(clean.final_category(F.lit("Uncategorized"), F.col("p_type")).alias("category")))


@query("near_dup_pairs", """with h as (select event_id as id, list_reduce(list_transform(string_split(md5(cast(event_id // 3 as varchar))[1:15], ''), lambda c: cast(('0x' || c) as bigint)), lambda a, b: a * 16 + b) * 4 + event_id % 3 as h from events)
select a.id as a, b.id as b, cast(bit_count(xor(a.h, b.h)) as int) as distance from h a join h b on a.id < b.id where bit_count(xor(a.h, b.h)) < 8""")
def near_dup_pairs(spark, d):
    """Hashes of 60 bits of a digest, which three events share, and two of the id."""
    value = F.conv(F.substring(F.md5(F.expr("cast(event_id div 3 as string)")), 1, 15), 16, 10).cast("long") * 4 + F.col("event_id") % 3
    return dedup.near_pairs(table(spark, d, "events").select(F.col("event_id").alias("id"), value.alias("hash")))


# Linking and building.
def triples(spark, d) -> DataFrame:
    # Order and line number tell line items apart, and make an ordinal that is the same in each use.
    items = table(spark, d, "lineitem").withColumn("ord", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return items.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        "ord", F.col("p_name").alias("subject"), F.lit("inhibits").alias("predicate"), F.col("s_name").alias("object"), F.col("l_returnflag").alias("source"), F.lit("Chemical").alias("subject_type"), F.lit("Gene").alias("object_type")
    )


def terms(spark, d) -> DataFrame:
    """Two of three part names are terms, and all suppliers."""
    parts = table(spark, d, "part").groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("candidate_id")).where("candidate_id % 3 < 2").select("candidate_id", "label", F.lit("mondo").alias("ontology_name"))
    suppliers = table(spark, d, "supplier").select((F.col("s_suppkey") + 10**9).alias("candidate_id"), F.col("s_name").alias("label"), F.lit("doid").alias("ontology_name"))
    return parts.unionByName(suppliers).select("*", F.concat_ws(":", F.upper("ontology_name"), F.col("candidate_id").cast("string")).alias("curie"), F.lit(None).cast("string").alias("obo_id"), F.lit(None).cast("string").alias("iri"), F.lit("table").alias("source"), F.array().cast("array<string>").alias("synonyms"), F.lit("").alias("definition"), F.lit(None).cast("int").alias("taxid"))


_LINKED = "l as (select p_name as entity, min(p_partkey) as k from part group by 1), m as (select distinct p_name as entity from lineitem join part on l_partkey = p_partkey)"


@query("link_best", f"""with {_LINKED} select entity, case when k % 3 < 2 then entity end as matched_label, case when k % 3 < 2 then 'MONDO:' || k end as ontology_id from m join l using (entity)
union all select distinct s_name, s_name, 'DOID:' || (1000000000 + s_suppkey) from lineitem join supplier on l_suppkey = s_suppkey""")
def link_best(spark, d):
    return linking.link(triples(spark, d), terms(spark, d)).select("entity", "matched_label", "ontology_id")


@query("link_summary", f"""with {_LINKED}, a as (select k % 3 < 2 as hit from m join l using (entity) union all select true from (select distinct l_suppkey from lineitem join supplier on l_suppkey = s_suppkey))
select count(*) as total, count(*) filter (hit) as linked, count(*) filter (not hit) as unlinked from a""")
def link_summary(spark, d):
    return linking.link_summary(linking.link(triples(spark, d), terms(spark, d))).select("total", "linked", "unlinked")


@query("enrich_triples", f"""with {_LINKED}, t as (select p_name as subject, s_name as object, case when k % 3 < 2 then 'MONDO:' || k end as subject_ontology_id, 'DOID:' || (1000000000 + s_suppkey) as object_ontology_id
from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join l on p_name = entity)
select *, count(*) as n from t group by all""")
def enrich_triples(spark, d):
    """Triples are counted by their two names before these are linked: a name has one link, so that no two counts are of the same row."""
    pairs = cut(triples(spark, d).groupBy("subject", "object").agg(F.count(F.lit(1)).alias("n")))
    links = linking.link(pairs, terms(spark, d)).select("entity", "ontology_id")
    return linking.enrich(pairs, links).select("subject", "object", "subject_ontology_id", "object_ontology_id", "n")


@query("build_nodes", "with t as (select p_name as name, 'Chemical' as label from lineitem join part on l_partkey = p_partkey union select s_name, 'Gene' from lineitem join supplier on l_suppkey = s_suppkey) select 'name:' || replace(lower(name), ' ', '') as key, label as labels from t")
def build_nodes(spark, d):
    g = build(triples(spark, d))
    return g.nodes.select("key", F.array_join("labels", "|").alias("labels"))


@query("build_edges", "select 'name:' || replace(lower(p_name), ' ', '') as src, 'name:' || lower(s_name) as dst, 'INHIBITS' as predicate_raw, 'DECREASE' as relation, 'decreases' as bel_relation, l_returnflag as source, count(*) as n from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey group by all")
def build_edges(spark, d):
    return build(triples(spark, d)).edges.select("src", "dst", "predicate_raw", "relation", "bel_relation", "source", "n")


@query("unique_keys", f"{WITH} select key, count(*) as count from nodes group by 1 having count(*) > 1")
def unique_keys_of(spark, d):
    return unique_keys(graph(spark, d).nodes)


@query("relabel", f"{WITH} select key, case when label = 'Cell' and cast(split_part(key, ':', 2) as bigint) % 2 = 0 then 'Protein' else label end as labels, label = 'Cell' and cast(split_part(key, ':', 2) as bigint) % 2 = 0 as changed from nodes")
def relabel_nodes(spark, d):
    g = graph(spark, d)
    reviewed = g.nodes.where((first_known_label(F.col("labels")) == "Cell") & (F.split("key", ":")[1].cast("long") % 2 == 0)).select("key", F.lit("Protein").alias("new_label"))
    return relabel(g.nodes, reviewed).select("key", F.array_join("labels", "|").alias("labels"), "changed")


@query("embed_names", "select id, name, 64 as size from (select n_nationkey as id, n_name as name from nation)")
def embed_names(spark, d):
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return embed(t, column="name").select("id", "name", F.size("embedding").alias("size"))
