"""Text, relations, parsing, matching, near duplicates, linking, graphs and reports, against hand-made cases and brute force."""

import csv
import itertools
import json
import random

import numpy as np
import pytest

from quern.functions import relations, similarity, text
from quern.operators import categorize, clean, dedup, linking, match, parse
from quern.plans import graph_queries as Q
from quern.plans import iterate, reports
from quern.plans.graph import Graph, build, relabel
from quern.sources import files, plug, services
from quern.streaming import upsert


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_normalize(spark):
    got = values(spark, [("SARS-CoV_2  (naïve) α!",), (None,), ("",)], "x string", text.normalize_eval("x"), text.normalize_category("x"))
    assert got == [("sars cov 2 naïve α", "sars cov 2 (naïve) α!"), ("", None), ("", "")]
    assert values(spark, [(None,)], "x string", text.normalize_category("x", null_as_nan=True)) == [("nan",)]


def test_keys(spark):
    rows = [(" go : 0006915",), ("GO:0",), ("mesh:D0001",), ("None",), (None,), ("x",)]
    assert [r[0] for r in values(spark, rows, "x string", text.norm_curie("x"))] == ["GO:6915", "GO:0", "MESH:D0001", None, None, "x"]
    assert values(spark, [("http://a.b/c// ",)], "x string", text.norm_iri("x")) == [("https://a.b/c",)]
    keys = text.all_keys(text.canon_name("n"), "c", "i", "d")
    got = values(spark, [("COVID_19", "go:01", None, "7"), ("Naïve  T-cell", "nan", "http://x/", None)], "n string, c string, i string, d string", text.entity_key(text.canon_name("n"), "c", "i", "d"), keys, text.alternative_keys(text.canon_name("n"), "c", "i", "d"))
    assert got == [("curie:GO:1", ["curie:GO:1", "id:7", "name:covid-19"], ["id:7", "name:covid-19"]), ("iri:https://x", ["iri:https://x", "name:naivetcell"], ["name:naivetcell"])]


def test_labels_and_property_keys(spark):
    assert values(spark, [("2 a-b",), (" ",), ("Gene",)], "x string", text.sanitize_label("x"), text.sanitize_key("x")) == [("L_2_a_b", "p_2_a_b"), ("LABEL", "p_"), ("Gene", "gene")]


def test_canonical_forms():
    assert text.canon_entity_py("IL-6") == text.canon_entity_py("IL6") == "il6"
    assert text.canon_entity_py("SARS-CoV-2") == "sars-cov-2" and text.canon_entity_py("diseases") == "disease" and text.canon_entity_py("cell process") == "cellproces"
    assert text.norm_text_py("β-Amyloid  é") == "beta-amyloid e" and text.norm_text_py("Α") == "α" and text.canon_entity_py("rs00123") == "rs123"


RELATIONS = {
    "dephosphorylation": "DIRECT_INCREASE", "inactivates": "INCREASE", "directly_increases": "INCREASE", "leads_to": "ASSOCIATION", "causes": "ASSOCIATION", "does_not_activates": "INCREASE",
    "does not activates": "DECREASE", "does not increase": "NO_EFFECT", "decreased": "DECREASE", "does not decrease": "DECREASE", "member of": "HAS_MEMBER", "DIRECTLYDECREASES": "DIRECT_DECREASE", "": "ASSOCIATION",
    "no change in": "NO_EFFECT", "positively correlates": "CORRELATION_POS", "up-regulation": "INCREASE", "fails to inhibit": "INCREASE", "is a biomarker": "BIOMARKER_FOR", "hasMember": "HAS_MEMBER", "modulates": "REGULATES",
}


def test_relations(spark):
    got = dict(values(spark, [(k,) for k in [*RELATIONS, None]], "p string", "p", relations.relation_of("p")))
    assert {k: got[k] for k in RELATIONS} == RELATIONS and got[None] == "ASSOCIATION"
    assert values(spark, [(k, v) for k, v in relations.BEL.items()], "a string, b string", relations.relation_of("b")) == [(k,) for k in relations.BEL]
    assert values(spark, [("INCREASE",), ("X",)], "r string", relations.bel_of("r")) == [("increases",), ("association",)]


def test_string_ratios():
    assert similarity.ratio("abc", "abc") == 1 and similarity.ratio("ab", "cd") == 0 and similarity.ratio("abcd", "abxd") == 0.75
    assert similarity.partial_ratio("bcd", "abcde") == 1 and similarity.token_sort_ratio("b a", "a b") == 1 and similarity.token_set_ratio("a b", "b a c") == 1
    assert round(similarity.jaro_winkler_py("martha", "marhta"), 4) == 0.9611 and round(similarity.jaro_winkler_py("dixon", "dicksonx"), 4) == 0.8133
    assert similarity.lexical_py("IL-6", "IL6") == 1 and similarity.lexical_py("", "x") == 0 and 0 < similarity.lexical_py("amyloid beta", "amyloid") < 1


def test_trigram_and_coverage(spark):
    got = values(spark, [("abcd", "abce"), ("ab", "abc"), ("tau protein level", "tau")], "a string, b string", text.jaccard_trigram("a", "b"), text.token_coverage("a", "b"), text.head_noun("a"))
    assert got[0][0] == pytest.approx(1 / 3) and got[1][0] == 0 and got[2][1:] == (0.5, "level")


def test_split_coordinated(spark):
    rows = [("IL-6 and TNF",), ("a/b",), ("IL-6",), ("aa, bb & cc",), ("aa/bb/cc/dd/ee/ff/gg",)]
    assert [r[0] for r in values(spark, rows, "x string", text.split_coordinated("x"))] == [["IL-6", "TNF"], [], [], ["aa", "bb", "cc"], []]


RESPONSE = """preamble
a|b|c
pathophysiology process: First one
x|y|z
Triples:

 s1 | p1 |o1
bad|line
a|b|c|d
Pathophysiological Process:  Second
Triples:
s2|p2|o2
Pathophysiological Process: Empty
Triples:"""


def test_parse_blocks(spark):
    df = spark.createDataFrame([(1, RESPONSE), (2, None), (3, "I'm sorry, no"), (4, "nothing")], "id int, response string")
    got = [tuple(r) for r in parse.parse_blocks(df).orderBy("ord").select("id", "block", "mechanism", "subject", "predicate", "object").collect()]
    assert got == [(1, 1, "First one", "s1", "p1", "o1"), (1, 2, "Second", "s2", "p2", "o2")]
    log = {r.id: (r.outcome, r.blocks, r.triples) for r in parse.run_log(df).collect()}
    assert log == {1: ("ok", 3, 2), 2: ("no_parse", 0, 0), 3: ("refused", 0, 0), 4: ("no_parse", 0, 0)}


def test_parse_paragraphs(spark):
    head = "Pathophysiological Process: "
    good, bad = f"{head}A\nTriples:\na|b|c\n d | e|f ", f"{head}B\nTriples:\na|b"
    rows = [(1, good), (2, f"{good}\n{bad}\n{good}"), (3, parse.NOTHING + "  "), (4, f"{head}C\nTriples:\na|b|c\n\nd|e|f"), (5, None), (6, "x")]
    df = spark.createDataFrame(rows, "id int, response string")
    keep = parse.parse_paragraphs(df, ["id"], keep_not_found=True).select("id", "mechanism", "subject", "predicate", "object")
    got = sorted(tuple(r) for r in keep.collect())
    lost = ("Not_found",) * 4
    assert got == sorted([(1, "A", "a", "b", "c"), (1, "A", "d ", " e", "f"), (2, "A", "a", "b", "c"), (2, "A", "d ", " e", "f"), (2, *lost), (3, *lost), (4, *lost)])
    assert parse.parse_paragraphs(df, ["id"]).count() == 4


def test_cleanups(spark):
    urls = spark.createDataFrame([(0, "Processing_problems"), (1, "u"), (2, "Not_found"), (3, "u"), (4, "v")], "ord int, image_url string")
    assert sorted(tuple(r) for r in clean.clean_urls(urls).collect()) == [(1, "u"), (4, "v")]
    assert [r[0] for r in values(spark, [("Yes.",), ("No.",), ("Perhaps.",), (None,)], "a string", clean.clean_answer("a"))] == ["Yes", "No", "Perhaps.", None]
    assert [r[0] for r in values(spark, [("3.9",), ("-2.5",), ("x",), (None,)], "a string", clean.numeric_or_zero("a"))] == [3, -2, 0, 0]
    assert [r[0] for r in values(spark, [("a + b",), ("a – b",), ("ab",), (None,)], "a string", clean.sign_predicate("a"))] == ["increases", "decreases", "interacts_with", "interacts_with"]
    rows = spark.createDataFrame([("1,234", "a", 1), ("1234", "b", 2), ("x", "c", 3)], "pmid string, url string, ord int")
    assert [tuple(r) for r in clean.last_value_map(rows, "pmid", "url", "ord").collect()] == [(1234, "b")]
    with pytest.raises(ValueError):
        clean.standard_triples(spark.createDataFrame([("a",)], "subject string"))
    assert clean.standard_triples(spark.createDataFrame([("a", "b", "c", "d")], "Head string, REL string, tail string, stype string")).columns == ["subject", "predicate", "object", "subject_type"]
    assert values(spark, [("https://github.com/a/b/blob/m/x/y.png",)], "u string", text.raw_github("u")) == [("https://raw.githubusercontent.com/a/b/m/x/y.png",)]


def test_boxes(spark):
    words = clean.boxes(spark.createDataFrame([("i", 1, " virus ", "0", "0", "2", "2", "90"), ("i", 2, "cell", "10", "0", "2", "2", "60"), ("i", 3, "x", "5", "0", "2", "2", "59"), ("i", 4, "y", "bad", "0", "2", "2", "99")], "image string, ord int, text string, left string, top string, width string, height string, conf string"))
    arrows = spark.createDataFrame([("i", 1, 2.0, 0.0, 7.0, 2.0, 60.0), ("i", 2, 0.0, 0.0, 1.0, 1.0, 50.0)], "image string, arrow_id int, left double, top double, width double, height double, area double")
    assert [tuple(r) for r in clean.arrow_triples(arrows, words).collect()] == [("i", 1, "virus", "cell")]


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = map(int, rng.integers(1, 6, 2))
        cost = np.round(rng.random((n, m)), 1)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(cost[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        pairs = match.assign(cost)
        assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        assert sum(cost[i, j] for i, j in pairs) == pytest.approx(best)
    assert match.assign(1 - np.array([[0.9, 0.8], [0.8, 0.1]])) == [(0, 1), (1, 0)] and match.assign(np.zeros((0, 3))) == []


def test_sweep(spark):
    predicted = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("only", 0, [1.0, 0.0])], "image string, ord long, embedding array<double>")
    gold = spark.createDataFrame([("a", 0, [1.0, 0.1]), ("a", 1, [-1.0, 0.0]), ("a", 2, [1.0, 1.0]), ("gold", 0, [1.0, 0.0])], "image string, ord long, embedding array<double>")
    got = {r.threshold: (r.tp, r.fp, r.fn, round(r.precision, 3), round(r.recall, 3), round(r.f1, 3)) for r in match.sweep(match.assignments(match.pair_similarities(predicted, gold)), predicted, gold, thresholds=(0.7, 0.99, 1.0)).collect()}
    assert got == {0.7: (2, 0, 1, 1.0, 0.667, 0.8), 0.99: (1, 1, 2, 0.5, 0.333, 0.4), 1.0: (0, 2, 3, 0.0, 0.0, 0.0)}
    assert {r.bin: r["count"] for r in match.histogram(spark.createDataFrame([(0.5,), (0.54,), (0.999,), (1.0,), (0.4,)], "sim double")).collect()} == {0: 2, 9: 2}


def test_near_pairs_equal_naive(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = base + [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (1, 6, 7, 8, 9)] + base[:3]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, hash long")
    want = {(a, b, bin(hashes[a] ^ hashes[b]).count("1")) for a in range(len(hashes)) for b in range(a + 1, len(hashes)) if bin(hashes[a] ^ hashes[b]).count("1") < 8}
    got = [tuple(r) for r in dedup.near_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_remove_poorer_replays_in_order(spark):
    rng = random.Random(2)
    pixels = [rng.choice([None, 1, 2, 3]) for _ in range(30)]
    pairs = [(a, b) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.08]
    gone: set = set()
    for a, b in pairs:
        if a in gone or b in gone or pixels[a] is None or pixels[b] is None:
            continue
        gone.add(a if pixels[a] < pixels[b] else b)
    items = spark.createDataFrame([(k, k, p) for k, p in enumerate(pixels)], "id long, ord long, pixels long")
    left = dedup.remove_poorer(items, spark.createDataFrame(pairs, "a long, b long"))
    assert {r.id for r in left.collect()} == set(range(30)) - gone


def test_best_category(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.7, 0.7]), (3, [-1.0, -1.0]), (4, [0.0, 0.0])], "id int, embedding array<double>")
    words = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [0.0, 1.0]), ("a", 2, [0.0, -1.0])], "category string, ord int, embedding array<double>")
    assert {r.id: r.category for r in categorize.best_category(rows, words).collect()} == {1: "a", 2: "a", 3: "a", 4: "Uncategorized"}
    assert {r.id: r.category for r in categorize.best_category(rows, words, "mean").collect()} == {1: "a", 2: "b", 3: "Uncategorized", 4: "Uncategorized"}
    with pytest.raises(ValueError):
        categorize.best_category(rows, words, "median")


def test_entity_groups_and_forms(spark):
    def groups(*mentions):
        df = spark.createDataFrame([(k, m, c) for k, (m, c) in enumerate(mentions)], "k int, entity string, context string")
        return [r.g for r in df.withColumn("g", linking.group_of("entity", "context")).orderBy("k").collect()]

    assert groups(*[(x, None) for x in ("AD", "IL6", "ang ii", "rs123", "TLR7", "kinase", "T cell", "dopamine", "Wnt pathway", "high fever", "lung cancer", "xyz")]) == ["disease_disorder", "gene_protein", "chemical_drug", "variant_hgvs", "gene_protein", "gene_protein", "anatomy_tissue_cell", "chemical_drug", "pathway_process", "phenotype_sign_symptom", "disease_disorder", "disease_disorder"]
    assert groups(("xyz", "a new variant"), ("Aβ", None), ("AB", None), ("p.V600E", None), ("ELISA kit", None), ("nerve tissue", None), ("DUX4", None), ("dux4", None)) == [
        "organism_taxon", "chemical_drug", "gene_protein", "variant_hgvs", "assay_device_procedure", "anatomy_tissue_cell", "gene_protein", "disease_disorder",
    ]
    assert "amyloid beta" in linking.expand_acronym("Aβ") and linking.expand_acronym("AB") == []
    canons = lambda *a: {text.canon_entity_py(f) for f in linking.surface_forms(*a)}
    assert {"stat3", "phosphorylatedstat3", "stat3phosphorylation"} <= canons("p-STAT3")
    assert {"lunginjury", "lung"} <= canons("lung injury")
    assert "longcovidsyndrome" in canons("LCS", "long COVID syndrome (LCS)") and "lcs" in canons("long COVID syndrome", "long COVID syndrome (LCS)")
    assert linking.surface_forms("brain fog")[-1] == '"brain fog"'
    forms = linking.surface_forms("IL-6")
    assert "interleukin-6" in forms and len({text.canon_entity_py(f) for f in forms}) == len(forms) <= linking.MOST_FORMS
    assert linking.expand_acronym("LCS", "long COVID syndrome (LCS)") == ["long COVID syndrome"]


TERM = "candidate_id long, label string, ontology_name string, curie string, obo_id string, iri string, source string, synonyms array<string>, definition string, taxid int"


def test_linking(spark):
    terms = spark.createDataFrame(
        [
            (1, "Alzheimer's disease", "mondo", "MONDO:1", None, "i1", "t", ["Alzheimers disease"], "a dementia", None),
            (2, "Alzheimer disease", "ror", "ROR:1", None, None, "t", ["Alzheimer's disease"], "", None),
            (3, "IL6", "hgnc", "HGNC:6018", None, None, "MyGene", ["interleukin-6"], "human gene", 9606),
            (4, "interleukin-6", "mygene", "X:2", None, None, "MyGene", ["IL6"], "mouse gene", 10090),
        ],
        TERM,
    )
    triples = spark.createDataFrame([(1, "AD", "increases", "IL-6"), (2, "IL6 and AD", "affects", "nothing known")], "ord long, subject string, predicate string, object string")
    links = {r.entity: (r.ontology_id, r.confidence) for r in linking.link(triples, terms).collect()}
    assert set(links) == {"AD", "IL-6", "IL6", "nothing known"}
    assert links["AD"][0] == "MONDO:1" and links["IL-6"][0] == links["IL6"][0] == "HGNC:6018" and links["nothing known"] == (None, 0.0)
    rows = linking.enrich(triples, linking.link(triples, terms)).orderBy("ord").collect()
    assert len(rows) == 2 and rows[0].subject_ontology_id == "MONDO:1" and rows[0].object_ontology_id == "HGNC:6018"
    s = linking.link_summary(linking.link(triples, terms)).first()
    assert (s.total, s.linked, s.unlinked, s.linked_percent) == (4, 3, 1, 75.0)


RULES = [
    (("enzyme", "disease_disorder"), ("enzyme", "x", None, [], "", None), 1.0),
    (("enzyme", "gene_protein"), ("enzyme", "hgnc", None, [], "", None), 1.2),
    (("enzyme", "gene_protein"), ("enzyme", "efo", None, [], "", None), 1.05),
    (("enzyme", "gene_protein"), ("enzyme", "x", "MyGene", [], "a human one", None), 1.15),
    (("enzyme", "gene_protein"), ("enzyme", "x", "MyGene", [], "", 10090), 0.85),
    (("zebra enzyme", "disease_disorder"), ("zebra enzyme", "x", None, [], "", None), 1.0),
    (("flu vaccine", "disease_disorder"), ("flu vaccine", "x", None, [], "", None), 0.8),
    (("wnt pathway", "chemical_drug"), ("wnt pathway", "x", None, [], "", None), 0.85),
    (("tumor grade", "disease_disorder"), ("tumor grade", "ncit", None, [], "", None), 1.0),
]


@pytest.mark.parametrize("mention,candidate,lex", RULES)
def test_score_rules(spark, mention, candidate, lex):
    df = spark.createDataFrame([(*mention, *candidate)], "entity string, group string, label string, ontology_name string, source string, synonyms array<string>, definition string, taxid int")
    assert linking.score(df).first().lex == pytest.approx(lex)


def toy(spark):
    nodes = spark.createDataFrame([("a", "Alpha", ["Gene"]), ("b", "Beta", ["Chemical"]), ("c", "Gamma", ["Disease"]), ("d", None, ["Cell"]), ("e", "Eps", ["Gene", "Protein"]), ("z", "Alone", ["Cell"])], "key string, name string, labels array<string>")
    edges = [("a", "b", "CAUSES", "GPT"), ("a", "b", "CAUSES", "CBM"), ("b", "c", "LEADS_TO", "GPT"), ("c", "a", "BINDS", "GPT"), ("c", "c", "CAUSES", "GPT"), ("d", "e", "CAUSES", "CBM"), ("b", "d", "INHIBITS", "GPT")]
    return Graph(nodes, spark.createDataFrame([(*x, "m", 1) for x in edges], "src string, dst string, predicate_raw string, source string, mechanism string, n long"))


def test_graph_questions(spark):
    g = toy(spark)
    assert {r.entity: r.degree for r in Q.hubs(g, "GPT").collect()} == {"Alpha": 2, "Beta": 3, "Gamma": 3, None: 1}
    assert {r.degree: r.nodes_with_degree for r in Q.degree_distribution(g).collect()} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 1}
    assert sum(r.degree for r in Q.degrees(g).collect()) == 2 * 7 - 1
    assert {r.source: r.unique_nodes_count for r in Q.nodes_per_source(g).collect()} == {"GPT": 7, "CBM": 4}
    assert {r.source: r.component_count for r in Q.components_per_source(g).collect()} == {"GPT": 3, "CBM": 4}
    assert {(r.src, r.dst, r.sources) for r in Q.shared_triples(g).collect()} == {("a", "b", "CBM|GPT")}
    assert Q.unique_triples(g).count() == 5
    assert {(r.cause, r.effect) for r in Q.only_in(g).collect()} == {("Beta", "Gamma"), ("Gamma", "Gamma")}
    assert {r.nodes for r in Q.causal_chains(g, ("alpha",), ("gamma",), ("CAUSES", "LEADS_TO"), 2, 4).collect()} == {"a > b > c", "a > b > c > c"}
    assert Q.bridges(g, ("alpha",), ("gamma",), ("Chemical",)).collect()[0].pathway_count == 1
    assert Q.bridges(g, ("nothing",), ("gamma",), ("Biological_Process", "Chemical"), literal=True).count() == 4
    assert Q.bridges(g, ("nothing",), ("gamma",), ("Biological_Process", "Chemical")).count() == 0
    assert {r.nodes for r in Q.shortest_paths(g, ("alpha",), ("eps",)).collect()} == {"a > b > d > e"}
    assert Q.shortest_paths(g, ("alpha",), ("eps",), labels=("Chemical",)).count() == 0
    assert Q.density(Graph(g.nodes.limit(1), g.edges)).first().directed_density is None
    assert {(r.mechanism, r.first_count, r.second_count) for r in Q.mechanism_cross(g, literal=True).collect()} == {("m", 10, 10)}


def test_components_and_paths_against_brute_force(spark):
    rng = random.Random(4)
    edges = list({(f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}") for _ in range(28)})
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def reach(start):
        seen, rim, out = {start}, [[start]], {start: [[start]]}
        while rim:
            grown = [[*p, y] for p in rim for y in near.get(p[-1], ()) if y not in seen]
            for p in grown:
                out.setdefault(p[-1], []).append(p)
            seen |= {p[-1] for p in grown}
            rim = grown
        return out

    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r.id: r.component for r in iterate.components(df.toDF("a", "b")).collect()}
    assert got == {x: min(reach(x)) for x in near if near[x] - {x}}
    ids = spark.createDataFrame([(x,) for x in near], "id string")
    paths = {tuple(r.nodes) for r in iterate.all_shortest_paths(ids, ids, df, 4).collect()}
    assert paths == {tuple(p) for x in near for y, ps in reach(x).items() if y != x for p in ps if len(p) <= 5}


def test_louvain(spark):
    clique = lambda k: [(f"{k}{i}", f"{k}{j}") for i in range(5) for j in range(i)]
    edges = spark.createDataFrame([*clique("a"), *clique("b"), *clique("c"), ("a0", "b0"), ("b1", "c0")], "src string, dst string")
    found = {r.id: r.community for r in iterate.louvain(edges).collect()}
    assert len(found) == 15 and len({found[f"a{k}"] for k in range(5)}) == 1 and len(set(found.values())) == 3


def test_build(spark):
    rows = [(1, "COVID_19", "increases", "IL-6", "GPT", None, "go:01", "nan", "x"), (2, "covid-19", "increases", "IL6", "CBM", "Disease", None, None, None), (3, "other", "does not increase", "Covid19", "GPT", None, "GO:1", None, None), (4, "nan", "x", "y", "GPT", None, None, None, None)]
    g = build(spark.createDataFrame(rows, "ord long, subject string, predicate string, object string, source string, subject_type string, subject_ontology_id string, subject_note string, score string"))
    nodes = {r.key: (r.name, r.labels) for r in g.nodes.collect()}
    assert nodes == {"curie:GO:1": ("Covid19", ["Disease"]), "name:il6": ("IL6", [])}
    got = {(r.src, r.relation, r.dst, r.source, r.n) for r in g.edges.collect()}
    assert got == {("curie:GO:1", "INCREASE", "name:il6", "GPT", 1), ("curie:GO:1", "INCREASE", "name:il6", "CBM", 1), ("curie:GO:1", "NO_EFFECT", "curie:GO:1", "GPT", 1)}
    assert {r.relation: r.props for r in g.edges.where("source = 'GPT'").collect()}["INCREASE"] == {"score": "x"}


def test_relabel(spark):
    nodes = spark.createDataFrame([("a", ["Gene", "Entity"]), ("b", ["Gene", "Unknown"]), ("c", [])], "key string, labels array<string>")
    review = spark.createDataFrame([("a", "Protein"), ("b", "Gene"), ("c", "Nonsense")], "key string, new_label string")
    assert {r.key: (r.labels, r.changed) for r in relabel(nodes, review).collect()} == {"a": (["Entity", "Protein"], True), "b": (["Gene", "Unknown"], False), "c": ([], False)}


def test_top_tables(spark):
    rows = [(k, f"hub_{k}", "[Disease]", str(d), "1.7", None) for k, d in enumerate([5, 9, 9, 1, 7])]
    out = reports.top_table(spark.createDataFrame(rows, "ord int, Cytokine string, labels string, deg_total string, deg_cbm string, deg_gpt string"), 3).collect()
    assert [(r.name, r.deg_total, r.deg_cbm, r.deg_gpt, r.deg_gpt_fulltext, r.name_short) for r in out] == [("hub_1", 9, 1, 0, 0, "hub 1"), ("hub_2", 9, 1, 0, 0, "hub 2"), ("hub_4", 7, 1, 0, 0, "hub 4")]
    assert values(spark, [("[Disease, Gene]",), ("[]",)], "x string", reports.labels_of("x")) == [(["Disease", "Gene"],), ([],)]


def test_readers(spark, tmp_path):
    for sep, name in ((";", "a.csv"), ("\t", "b.tsv"), ("|", "c.psv"), (",", "d.txt")):
        with open(tmp_path / name, "w", newline="") as f:
            csv.writer(f, delimiter=sep).writerows([["subject", "predicate", "object"], ["a", "b", "c"], ["x,y" if sep != "," else "x", "é", "multi\nline"]])
        got = files.read_any(spark, f"file://{tmp_path / name}")
        assert got.columns == ["subject", "predicate", "object"] and got.count() == 2
    with pytest.raises(ValueError):
        files.read_any(spark, "x.unknown")
    (tmp_path / "articles.json").write_text(json.dumps({"1": {"title": "t", "paragraphs": ["p", "q"]}, "2": {"title": None, "paragraphs": []}}))
    got = parse.articles(files.read_articles(spark, f"file://{tmp_path}/articles.json"))
    assert [tuple(r) for r in got.collect()] == [("1", "t", 0, "p"), ("1", "t", 1, "q")]
    (tmp_path / "d.xml").write_text("<Set><DescriptorRecord><DescriptorName><String>Stroke</String></DescriptorName><ConceptList><Concept><TermList><Term><String>Brain stroke</String></Term><Term><String>CVA</String></Term></TermList></Concept></ConceptList></DescriptorRecord></Set>")
    d = files.read_descriptors(spark, f"file://{tmp_path}/d.xml")
    seeds = spark.createDataFrame([("vascular", "STROKE")], "category string, seed string")
    terms = clean.terms_by_category(d, seeds)
    assert [tuple(r) for r in terms.collect()] == [("vascular", ["Brain stroke", "CVA", "Stroke"])]
    files.write_categories(terms, f"file://{tmp_path}/out")
    assert [tuple(r) for r in parse.tall_categories(files.read_categories(spark, f"file://{tmp_path}/out")).collect()] == [("vascular", 0, "Brain stroke"), ("vascular", 1, "CVA"), ("vascular", 2, "Stroke")]
    assert files.find_input(spark, f"file://{tmp_path}", ["d.xml"]).endswith("/d.xml")


def test_plugs(spark):
    df = spark.createDataFrame([(1, "a"), (2, "boom"), (3, "a")], "id int, prompt string")

    def model(batch):
        if "boom" in batch:
            raise RuntimeError
        return [x.upper() for x in batch]

    assert {r.id: (r.response, r.failed) for r in plug.complete(df, model).collect()} == {1: ("A", False), 2: (None, True), 3: ("A", False)}
    vectors = plug.embed(df, column="prompt").collect()
    assert len(vectors) == 3 and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in vectors)
    gray = np.random.default_rng(0).random((32, 32))
    assert plug.perceptual_hash(gray) == plug.perceptual_hash(gray + 3) != plug.perceptual_hash(gray.T)
    fetched = plug.fetch(spark.createDataFrame([("u",)], "url string"), lambda u: (200, "image/png", b"x")).first()
    assert (fetched.http_status, fetched.mime, bytes(fetched.content)) == ("200", "image/png", b"x")


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for k in range(2):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"subject": "IL-6", "predicate": "binds", "object": "TNF", "source": "GPT"}) for _ in range(k + 1)))
        upsert.start(spark, f"file://{source}", f"file://{out}", f"file://{tmp_path}/cp").awaitTermination(120)
    assert [(r.src, r.predicate_raw, r.dst, r.n) for r in upsert.edges(spark, f"file://{out}").collect()] == [("name:il6", "BINDS", "name:tnf", 3)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_command_line(spark, tmp_path, capsys):
    from quern.__main__ import main

    config = tmp_path / "run.ini"
    config.write_text(f"[run]\nfolder = /root/testdata/sf0.001\nout = {tmp_path}/hubs.csv\n[spark]\nspark.sql.session.timeZone = UTC\n")
    main(["hubs_cbm", "--config", str(config), "--dry-run"])
    assert "Physical Plan" in capsys.readouterr().out and not (tmp_path / "hubs.csv").exists()
    main(["hubs_cbm", "--config", str(config)])
    assert files.read_any(spark, f"{tmp_path}/hubs.csv").count() == 20
    with pytest.raises(SystemExit):
        main(["hubs_cbm"])


SCORED = TERM.replace("candidate_id long", "candidate_id long, entity string, group string")


def test_score_rules(spark):
    """What each rule adds to a label that equals its mention (1.0), or takes from it."""
    row = lambda k, entity, group, label, onto="x", source="t", synonyms=(), definition="", taxid=None: (k, entity, group, label, onto, None, None, None, source, list(synonyms), definition, taxid)
    rows = [
        row(1, "qqq", "disease_disorder", "qqq"), row(2, "qqq", "disease_disorder", "qqq", "mondo"), row(3, "qqq", "disease_disorder", "qqq", "wikidata"),
        row(4, "qqq", "gene_protein", "qqq", source="MyGene", taxid=9606), row(5, "qqq", "gene_protein", "qqq", source="UniProt", definition="a mouse gene"),
        row(6, "qqq", "gene_protein", "qqq", source="UniProt", definition="human and mouse"), row(7, "drug", "disease_disorder", "drug"),
        row(8, "pathway", "chemical_drug", "pathway"), row(9, "grade", "disease_disorder", "grade", "ncit"), row(10, "grade", "assay_device_procedure", "grade", "ncit"),
        row(11, "leakage", "disease_disorder", "leakage"), row(12, "IL6", "gene_protein", "IL6"), row(13, "qqq", "disease_disorder", "qqq", "enm"),
    ]
    found = {r.candidate_id: round(r.lex, 6) for r in linking.score(spark.createDataFrame(rows, SCORED)).collect()}
    assert found == {1: 1.0, 2: 1.2, 3: 1.05, 4: 1.15, 5: 0.85, 6: 1.15, 7: 0.8, 8: 0.85, 9: 1.0, 10: 1.2, 11: 1.0, 12: 1.25}


def test_ties_fall_to_preferred_authorities(spark):
    """Within .02 of the best, .03 for genes, a preferred authority goes first; beyond it doesn't."""
    fields = "entity string, group string, candidate_id long, label string, ontology_name string, curie string, obo_id string, iri string, source string, confidence double, lex double, words long, label_cover double, tier int, embed_sim double"
    row = lambda e, g, k, onto, c: (e, g, k, "l", onto, f"{onto}:{k}", None, None, "t", c, c, 1, 1.0, 0, None)
    rows = [row("a", "disease_disorder", 1, "x", 0.90), row("a", "disease_disorder", 2, "mondo", 0.885), row("b", "disease_disorder", 1, "x", 0.90), row("b", "disease_disorder", 2, "mondo", 0.875), row("c", "gene_protein", 1, "x", 0.90), row("c", "gene_protein", 2, "hgnc", 0.875), row("d", "gene_protein", 1, "x", 0.69)]
    found = {r.entity: r.ontology_id for r in linking.decide(spark.createDataFrame(rows, fields)).collect()}
    assert found == {"a": "mondo:2", "b": "x:1", "c": "hgnc:2", "d": None}


def test_vectors_raise_unclear_scores(spark):
    terms = spark.createDataFrame([(1, "chronic lung scarring", "mondo", "M:1", None, None, "t", ["scarred lungs"], "", None)], TERM)
    triples = spark.createDataFrame([(1, "chronic lung scarring of old", "affects", "scarred lungs")], "ord long, subject string, predicate string, object string")
    pairs = linking.score(linking.candidates(linking.with_parts(linking.mentions_of(triples)), terms))
    raised = linking.add_vectors(pairs, linking.vectors_of(pairs, lambda texts: [[1.0, 0.0] for _ in texts]))
    before = {r.entity: r.lex for r in pairs.collect()}
    for r in raised.collect():
        wants = r.words >= 2 and before[r.entity] < linking.THRESHOLD + 0.20
        assert r.embed_sim == (1.0 if wants else 0.0) and abs(r.lex - min(1.5, before[r.entity] + 0.35 * r.embed_sim)) < 1e-9


def test_phrase_search(spark):
    """A mention of several words with few hits meets terms that hold it as a phrase."""
    terms = spark.createDataFrame([(1, "acute brain fog syndrome", "mondo", "M:1", None, None, "t", [], "", None), (2, "fog of brain", "mondo", "M:2", None, None, "t", [], "", None)], TERM)
    triples = spark.createDataFrame([(1, "brain fog", "affects", "x")], "ord long, subject string, predicate string, object string")
    assert {r.candidate_id for r in linking.candidates(linking.mentions_of(triples), terms).where("entity = 'brain fog'").collect()} == {1}


def test_keywords_in_blocks(spark, monkeypatch):
    """Many keywords go to the tasks in blocks, with the same categories."""
    random = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, random.normal(size=8).tolist()) for k in range(60)], "id int, embedding array<double>")
    words = spark.createDataFrame([(f"c{k % 7}", k, random.normal(size=8).tolist() if k else [0.0] * 8) for k in range(50)], "category string, ord int, embedding array<double>")
    for how in ("max", "mean"):
        whole = sorted((r.id, r.category, round(r.score, 9)) for r in categorize.best_category(rows, words, how, 0.1).collect())
        monkeypatch.setattr(categorize, "MOST_KEYWORDS", 9)
        assert sorted((r.id, r.category, round(r.score, 9)) for r in categorize.best_category(rows, words, how, 0.1).collect()) == whole
        monkeypatch.undo()


def test_near_pairs_against_all(spark):
    random = np.random.default_rng(5)
    hashes = [int(x) for x in random.integers(-(2**63), 2**63 - 1, 40)]
    for k in range(40):
        flips = random.choice(64, random.integers(0, 11), replace=False)
        hashes.append(int((np.uint64(hashes[k] & (2**64 - 1)) ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0))).view(np.int64)))
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    want = {(a, b, bits(hashes[a], hashes[b])) for a in range(80) for b in range(a + 1, 80) if bits(hashes[a], hashes[b]) < 8}
    got = [tuple(r) for r in dedup.near_pairs(spark.createDataFrame(list(enumerate(hashes)), "id long, hash long")).collect()]
    assert set(got) == want and len(got) == len(want)


def test_terms_of_services(spark):
    """Answers in each service's shape, and others that give no terms."""
    bodies = {
        "OLS": {"response": {"docs": [{"label": "AD", "iri": "i", "obo_id": "MONDO:1", "ontology_name": "MONDO", "synonym": ["x"], "description": ["d", "e"]}]}},
        "BioPortal": [{"annotatedClass": {"prefLabel": "AD", "@id": "i", "notation": "D1", "synonym": ["s"], "definition": ["first", "second"], "links": {"ontology": "https://x/ontologies/MESH"}}}],
        "MyGene": {"hits": [{"symbol": "IL6", "name": "interleukin 6", "taxid": 9606, "entrezgene": 3569, "alias": ["IL-6"]}]},
        "UniProt": {"results": [{"primaryAccession": "P1", "proteinDescription": {"recommendedName": {"fullName": {"value": "Interleukin"}}}, "organism": {"scientificName": "Homo sapiens", "taxonId": 9606}}]},
        "Wikidata": {"entities": {"Q1": {"labels": {"en": {"value": "fever"}}, "descriptions": {"en": {"value": "heat"}}, "aliases": {"en": [{"value": "pyrexia"}]}}}},
    }
    want = {
        "OLS": ("AD", "mondo", None, "MONDO:1", "i", ["x"], "d e", None), "BioPortal": ("AD", "mesh", None, "D1", "i", ["s"], "first", None),
        "MyGene": ("IL6", "mygene", "NCBIGene:3569", None, "", ["IL-6"], "interleukin 6 taxid:9606", 9606), "UniProt": ("Interleukin", "uniprot", "UniProtKB:P1", None, "", [], "Homo sapiens taxid:9606", 9606),
        "Wikidata": ("fever", "wikidata", "Wikidata:Q1", None, "https://www.wikidata.org/wiki/Q1", ["pyrexia"], "heat", None),
    }
    for name, body in bodies.items():
        answers = spark.createDataFrame([("q", json.dumps(body)), ("q", json.dumps(body)), ("q", "no json"), ("q", "{}"), ("q", None)], "term string, body string")
        got = [(r.label, r.ontology_name, r.curie, r.obo_id, r.iri, r.synonyms, r.definition, r.taxid) for r in services.terms_of(answers, name).collect()]
        assert got == [want[name]], name


def test_addresses_are_fetched_once(spark, tmp_path):
    def client(url):
        with open(f"{tmp_path}/asked", "a") as f:
            f.write(url + "\n")
        return 200, "text/html", b"x"

    rows = spark.createDataFrame([(k, f"u{k % 3}") for k in range(30)], "id int, url string")
    assert {r.http_status for r in plug.fetch(rows, client).collect()} == {"200"}
    assert sorted((tmp_path / "asked").read_text().split()) == ["u0", "u1", "u2"]


def test_image_facts(spark):
    grid = np.add.outer(np.arange(32), np.arange(32)) % 7
    images = spark.createDataFrame([(1, b"a"), (2, b"b"), (3, b"bad"), (4, None)], "id int, content binary")
    decode = lambda content: None if content == b"bad" else (grid + (content == b"b"), 40, 30)
    facts = {r.id: (r.hash, r.pixels) for r in plug.image_facts(images, decode).collect()}
    assert facts[1][1] == 1200 and facts[3] == facts[4] == (None, None)
    assert bin((facts[1][0] ^ facts[2][0]) & (2**64 - 1)).count("1") < dedup.DISTANCE
