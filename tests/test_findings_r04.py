"""Findings of the fourth list (FINDINGS_r03.md): how much is shuffled, and the same rows after."""

import re
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quern.llm import substring_dedup
from quern.plans import graph_queries
from quern.plans.graph import Graph
from quern.plans.queries import SQL
from quern.plans.table_queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def joins_above(df, word):
    """The most joins that rows with an expression of this word, filters aside, pass on their way up the optimized plan."""
    most, above = 0, []
    for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
        depth = re.search(r"[A-Za-z]", line).start()
        above = [x for x in above if x[0] < depth]
        if word in line and "Filter" not in line[: depth + 6]:
            most = max(most, sum(name == "Join" for _, name in above))
        above.append((depth, re.match(r"\w+", line[depth:])[0]))
    return most


@pytest.mark.parametrize("name, joins", [("triples_by_source", 0), ("relation_schema", 0), ("repurposing_case", 1), ("repurposing", 1), ("targets_regulatory", 1), ("star_edges", 0)])
def test_keys_are_made_after_names_are_met(spark, name, joins):
    """Edges meet nodes as numbers; as strings only steps of two edges meet."""
    assert joins_above(QUERIES[name](spark, SMALL), "concat(") <= joins


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Parts of two types or in two rows, orders in two rows, customers and suppliers that are missing, missing keys."""
    folder, connection = tmp_path_factory.mktemp("odd"), duckdb.connect()
    more = {
        "part": "select * from t union all select * replace ('OTHER' as p_type) from t where p_partkey < 20 union all select * from t where p_partkey between 10 and 30",
        "orders": "select * from t union all select * from t where o_orderkey < 50",
        "lineitem": "select * from t union all select * replace (null as l_suppkey) from t where l_orderkey < 20 union all select * replace ('X' as l_returnflag) from t where l_orderkey < 90",
        "customer": "select * from t where c_custkey % 7 > 0",
        "supplier": "select * from t where s_suppkey % 4 > 0",
    }
    for name in ("customer", "supplier", "nation", "part", "orders", "lineitem"):
        connection.execute(f"copy (with t as (from read_parquet('{SMALL}/{name}.parquet')) {more.get(name, 'select * from t')}) to '{folder}/{name}.parquet' (format parquet)")
        connection.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return str(folder), connection


@pytest.mark.parametrize("name", ["triples_by_source", "relation_schema", "focus_mentions", "star_edges"])
def test_odd_rows_of_named_edges(spark, odd, name):
    folder, connection = odd
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    assert got == sorted(map(str, connection.sql(SQL[name]).project(", ".join(columns)).fetchall())) and got


def test_steps_over_loops(spark):
    """An edge from a node to itself isn't followed by itself, only by the node's other loops and edges."""
    nodes = spark.createDataFrame([("a", "drug a", ["Chemical"]), ("p", "process outcome", ["Chemical"])], "key string, name string, labels array<string>")
    rows = [("a", "p", "T", "x", "m"), ("p", "p", "T", "x", "m"), ("p", "p", "T", "x", None), ("p", "p", "T", None, "m")]
    edges = spark.createDataFrame([(*r, 1) for r in rows], "src string, dst string, predicate_raw string, source string, mechanism string, n long")
    found = graph_queries.repurposing(Graph(nodes, edges), ("process",), ("outcome",)).collect()
    names = {"a": "drug a", "p": "process outcome"}
    want = [(names[a[0]], names[a[1]], a[2], a[3], names[b[1]], b[2], b[3]) for a in rows for b in rows if a[1] == b[0] and a != b]
    assert sorted(str(tuple(r)) for r in found) == sorted(map(str, want))


def test_windows_hash_a_word_anew_once(monkeypatch):
    """op5_substring_dedup: windows of all segments and of some, with gaps, against hashes of each window by itself."""
    rng, calls, real = np.random.default_rng(3), [], xxhash.xxh64_intdigest
    monkeypatch.setattr(substring_dedup, "xxhash", SimpleNamespace(xxh64_intdigest=lambda *a: calls.append(1) or real(*a)))
    words = [b"w%d" % k for k in rng.integers(0, 400, 2000)]
    passing = lambda low: SimpleNamespace(value=np.full(1 << 10, low, np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([9]), pa.array([b" ".join(words)])], names=["doc", "row", "text"])
    alone = {}
    for k in range(len(words) - 49):
        s = substring_dedup._first
        one = [substring_dedup.Segments(b" ".join(words[k : k + 50]), 50, 18)]
        again = np.array([real(w, 7) for w in words[k : k + 50]], np.uint64)
        alone[k] = (int(s.spans(one[0].sums, np.array([0]), np.array([50]))[0]), int(substring_dedup._second.runs(substring_dedup._second.sums(again), 50)[0]))
    for bits, least, most in ((0xFFFFFFFFFFFFFFFF, 1951, 1951), (0x0101010101010101, 1, 1000)):
        calls.clear()
        found = pa.Table.from_batches(substring_dedup._expand(50, 18, None, passing(bits))(iter([batch]))).to_pylist()
        assert least <= len(found) <= most and len(calls) <= len(words)
        assert len({r["start"] for r in found}) == len(found)
        assert all((r["key"] % (1 << 64), r["check"] % (1 << 64)) == alone[r["start"]] and (r["doc"], r["row"], r["n"], r["whole"]) == (7, 9, 1, False) for r in found)
