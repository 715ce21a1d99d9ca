"""Graph operations that need rounds: components, shortest paths, communities.

Each round is a few joins or grouped sums over edges; what a round made is written to the shared folder and read again, so that plans
stay short and outlive lost executors. Only a count of changes comes to the driver.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: below spark.checkpoint.dir, or, with a local master only, below a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quern-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"


def cut(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it: its lineage ends, and it outlives lost executors."""
    path = folder or shared_folder(df.sparkSession)
    if _scopes and not folder:
        _scopes[-1].append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders that cut() made in calls of tidied functions that still run, on this driver.
_scopes: list[list[str]] = []


def tidied(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Writes what f(df, ...) returns, then deletes the tables that cut() wrote within, and lets Spark's cleaner take their shuffles."""

    @wraps(f)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        spark = df.sparkSession
        _scopes.append([])
        try:
            found = f(df, *args, **kwargs)
            path = shared_folder(spark)
            found.write.parquet(path)
            schema = found.schema
        finally:
            made = _scopes.pop()
            for folder in made:
                place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        if _scopes:
            _scopes[-1].append(path)
        found = None
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        return spark.read.schema(schema).parquet(path)

    return run


def in_blocks(df: DataFrame, most: int, *keys: str) -> list[DataFrame]:
    """df whole where it has at most `most` rows, else in parts by a hash of keys, of about that many rows each. For lists that are broadcast."""
    count = df.count()
    blocks = max(1, -(-count // most))
    return [df] if blocks == 1 else [df.where(F.pmod(F.xxhash64(*keys), F.lit(blocks)) == k) for k in range(blocks)]


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of edges (a, b) of any ordered type: a row (id, component) for each id in an edge; component is the least id reachable.

    Each round takes the least label among neighbours, hands it to the vertex's present root too, and follows labels once more, so
    that the rounds grow with the logarithm of a component's diameter. A hub's edges are rows, never a list. Rounds end when no label
    changes; limit only guards against an error in the rounds.
    """
    both = cut(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("f")).select(F.col("a").alias("id"), "f"))
    for _ in range(limit):
        near = both.join(labels.select(F.col("id").alias("b"), "f"), "b").groupBy("a").agg(F.min("f").alias("m"))
        seen = labels.join(near.select(F.col("a").alias("id"), "m"), "id")
        offers = seen.select("id", F.least("f", "m").alias("f")).union(seen.where("m < f").select(F.col("f").alias("id"), F.col("m").alias("f")))
        first = offers.groupBy("id").agg(F.min("f").alias("f"))
        new = first.join(first.select(F.col("id").alias("f"), F.col("f").alias("g")), "f").select("id", F.least("f", "g").alias("f"))
        new = cut(new.join(labels.withColumnRenamed("f", "was"), "id").select("id", "f", (F.col("f") < F.col("was")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        labels = new.select("id", "f")
        if not moved:
            return labels.withColumnRenamed("f", "component")
    raise RuntimeError(f"components not settled in {limit} rounds")


def _coded(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) as distinct pairs (x, y), x < y, of 64-bit numbers, and the number (id, h) of each id; a seed is taken that gives no two ids the same. Edges are read twice."""
    edges = edges.where("a <> b").select("a", "b")
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    for seed in range(10):
        code = lambda c, seed=seed: F.xxhash64(F.lit(seed), c)
        coded = cut(ids.select("id", code("id").alias("h")))
        if not coded.groupBy("h").count().where("count > 1").limit(1).count():
            return cut(edges.select(F.least(code("a"), code("b")).alias("x"), F.greatest(code("a"), code("b")).alias("y")).distinct()), coded
    raise RuntimeError("ids of which two have the same hash, whatever its seed")


def contracted_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """The same as components, for many edges.

    Ids are numbers of 64 bits within. Each round hooks every vertex to its least neighbour if that is less, follows hooks to their roots, and
    goes on with the edges between different roots: in two rounds each vertex hooks or is hooked to, so that at least half are gone, and
    rounds get smaller. A hub's edges are rows, never a list. limit only guards against an error in the rounds.
    """
    left, coded = _coded(edges)
    hooks: list[DataFrame] = []
    for _ in range(limit):
        if not left.limit(1).count():
            break
        hook = cut(left.select(F.col("y").alias("h"), F.col("x").alias("r")).union(left.select("x", "x")).groupBy("h").agg(F.min("r").alias("r")))
        for _ in range(limit):
            up = hook.select(F.col("h").alias("r"), F.col("r").alias("up"))
            further = cut(hook.join(up, "r").select("h", F.col("up").alias("r"), (F.col("up") < F.col("r")).alias("moved")))
            hook = further.select("h", "r")
            if not further.where("moved").limit(1).count():
                break
        else:
            raise RuntimeError(f"hooks not followed in {limit} rounds")
        hooks.append(hook)
        x, y = hook.toDF("x", "p"), hook.toDF("y", "q")
        left = cut(left.join(x, "x").select("y", "p").join(y, "y").where("p <> q").select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct())
    else:
        raise RuntimeError(f"components not settled in {limit} rounds")
    roots = None
    for hook in reversed(hooks):  # a later round's vertices are roots of the one before
        roots = hook if roots is None else cut(hook.join(roots.toDF("r", "top"), "r", "left").select("h", F.coalesce("top", "r").alias("r")))
    if roots is None:
        return coded.select("id", F.col("id").alias("component"))
    named = cut(coded.join(roots, "h").select("id", "r"))
    return named.join(named.groupBy("r").agg(F.min("id").alias("component")), "r").select("id", "component")


def component_counts(nodes: DataFrame, edges: DataFrame, by: str = "source") -> DataFrame:
    """For each value of `by`: how many weakly connected components its edges leave among all nodes (a node alone is one)."""
    edges = cut(edges.where(F.col(by).isNotNull()).select(by, "src", "dst"))
    keyed = edges.select(F.struct(F.col(by).alias("g"), F.col("src").alias("k")).alias("a"), F.struct(F.col(by).alias("g"), F.col("dst").alias("k")).alias("b"))
    found = contracted_components(keyed).groupBy(F.col("id.g").alias(by)).agg(F.count(F.lit(1)).alias("reached"), F.count_if(F.col("id") == F.col("component")).alias("parts"))
    loops = edges.select(by).distinct()
    total = nodes.agg(F.count(F.lit(1)).alias("total"))
    joined = loops.join(found, by, "left").join(F.broadcast(total))  # one row
    return joined.select(by, (F.col("total") - F.coalesce("reached", F.lit(0)) + F.coalesce("parts", F.lit(0))).alias("component_count"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of neighbours (src, dst) in both directions, written as a table. For all searches of one question."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    return cut(pairs.select(F.explode(F.array(F.struct(F.col("x").alias("src"), F.col("y").alias("dst")), F.struct(F.col("y").alias("src"), F.col("x").alias("dst")))).alias("e")).select("e.*"))


def distances(sources: DataFrame, edges: DataFrame, depth: int, both: DataFrame | None = None) -> DataFrame:
    """Undirected hop counts (start, id, hops), up to depth, from each id in sources (id). Each round extends the rim by an edge.

    A rim's neighbours are in it, in the one before or in the next, so that each round reads two rims and writes one.
    """
    both = undirected(edges) if both is None else both
    rim = cut(sources.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops")).distinct())
    seen, known = rim, rim
    for hop in range(1, depth + 1):
        step = rim.select("start", F.col("id").alias("src")).join(both, "src").select("start", F.col("dst").alias("id")).distinct()
        new = cut(step.join(known, ["start", "id"], "left_anti").withColumn("hops", F.lit(hop)))
        if not new.limit(1).count():
            break
        seen, known, rim = seen.unionByName(new), rim.unionByName(new), new
    return seen


def all_shortest_paths(starts: DataFrame, ends: DataFrame, edges: DataFrame, depth: int = 5, both: DataFrame | None = None, barred: DataFrame | None = None, least: int | None = None) -> DataFrame:
    """Every shortest undirected path (start, end, hops, nodes) of up to depth edges between different ids in starts and ends.

    Paths follow distances down from the ends, so that only edges on a shortest path are joined. barred (key): ids that no path may have between
    its ends; the search itself passes them. least: how many paths are wanted, the first by their nodes joined with " > ": of the parts
    from one node to one end, no more than as many can be the end of such a path, as all that comes before them is the same.
    """
    both = undirected(edges) if both is None else both
    dist = distances(starts, edges, depth, both)
    paths = cut(dist.join(ends.select("id").distinct(), "id").where("hops > 0").select("start", F.col("id").alias("end"), "hops", F.col("id").alias("at"), F.col("hops").alias("left"), F.array("id").alias("nodes")))
    order = W.partitionBy("start", "end", "at").orderBy(F.array_join("nodes", " > "))
    for _ in range(depth):
        open_ = paths.where("left > 0")
        back = open_.join(both.select(F.col("src").alias("at"), F.col("dst").alias("prev")), "at").join(dist.select("start", F.col("id").alias("prev"), F.col("hops").alias("d")), ["start", "prev"]).where("d = left - 1")
        if barred is not None:
            back = back.join(barred.select("key"), (F.col("prev") == F.col("key")) & (F.col("d") > 0), "left_anti")
        grown = back.select("start", "end", "hops", F.col("prev").alias("at"), F.col("d").alias("left"), F.concat(F.array("prev"), "nodes").alias("nodes"))
        if least:
            grown = cut(grown.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= least).drop("_n"))
        paths = paths.where("left = 0").unionByName(grown)
    return paths.where("left = 0").select("start", "end", "hops", "nodes")


#: Vertices whose labels, volumes and hashes are sent to tasks, 28 bytes each; with more, labels are joined.
MOST_VERTICES = 1 << 24
#: Ends of edges in a block, about; all of a vertex are in one.
IN_BLOCK = 1 << 16
_BINARY = lambda *names: ", ".join(f"{n} binary" for n in names)


def louvain(edges: DataFrame) -> DataFrame:
    """Communities (id, community) of undirected weighted edges by local moves that raise modularity, then by moves of whole communities.

    All vertices look at their neighbours' communities at once, from grouped sums; by turns a half of them, drawn by a hash, moves, so
    that two vertices seldom swap. Rounds go on for as long as two of them raise modularity, and levels likewise, so that both end: what
    didn't raise it is dropped. The least id names a community.

    There are some hundred rounds. Vertices are numbered, a level's edges are written once in blocks of vertices, and a round is one job
    over them without a shuffle: labels go to the tasks as arrays, and what moves comes back.
    """
    sc = edges.sparkSession.sparkContext
    some = edges.where("src <> dst")
    ids = some.select(F.col("src").alias("id")).union(some.select("dst")).distinct()
    for seed in range(10):
        code = lambda c, seed=seed: F.xxhash64(F.lit(seed), c)
        ids = cut(ids.select("id", code("id").alias("h"), F.xxhash64("id").alias("tie")))
        n = ids.count()
        if n > MOST_VERTICES:
            return joined_louvain(edges)
        known = ids.select("h", "tie").toArrow()
        codes, order = np.unique(known["h"].to_numpy(), return_index=True)
        if len(codes) == n:
            break
    else:
        raise RuntimeError("ids of which two have the same hash, whatever its seed")
    if not n:
        return ids.select("id", F.col("id").alias("community"))
    ties, numbers = sc.broadcast(known["tie"].to_numpy()[order]), sc.broadcast(codes)
    pairs = some.select(F.least(code("src"), code("dst")).alias("x"), F.greatest(code("src"), code("dst")).alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    blocks = _blocks(pairs.mapInArrow(_numbered(numbers), "x int, y int, w double"))
    degree = np.zeros(n)
    for row in blocks.mapInArrow(_degrees, _BINARY("x", "k")).toLocalIterator():
        degree[np.frombuffer(row["x"], np.int32)] = np.frombuffer(row["k"])
    twice, own, member = float(degree.sum()), 0.0, np.arange(n, dtype=np.int32)
    while True:
        labels = best = np.arange(n, dtype=np.int32)
        weights, before, turn = sc.broadcast(degree), None, 0
        while True:
            volume = np.bincount(labels, degree, n)
            sent = sc.broadcast((labels, volume))
            rows = blocks.mapInArrow(_moves(sent, weights, ties, twice, turn), "inside double, " + _BINARY("a", "c")).collect()  # labels of vertices that move, at most
            sent.destroy()
            if turn % 2 == 0:
                inside = sum(r["inside"] for r in rows)
                now = (inside + own) / twice - float(((volume / twice) ** 2).sum())
                before = now if before is None else before
                if turn and now <= reached + 1e-9:
                    break
                best, reached, kept = labels, now, inside
            labels, turn = labels.copy(), turn + 1
            for r in rows:
                labels[np.frombuffer(r["a"], np.int32)] = np.frombuffer(r["c"], np.int32)
        weights.destroy()
        if reached <= before + 1e-9:
            break
        member, own, degree = best[member], own + kept, np.bincount(best, degree, n)
        sent = sc.broadcast(best)
        blocks = _blocks(blocks.mapInArrow(_merged(sent), "x int, y int, w double").groupBy("x", "y").agg(F.sum("w").alias("w")))
    named = cut(ids.select("id", "h").mapInArrow(_members(numbers, sc.broadcast(codes[member])), T.StructType([ids.schema["id"], T.StructField("r", T.LongType())])))
    least = cut(named.groupBy("r").agg(F.min("id").alias("community")))
    return named.join(least, "r").select("id", "community")


def _blocks(ends: DataFrame) -> DataFrame:
    """Ends of edges (x, y, w) as a table with a row for each block: arrays of numbers, in order of x."""
    ends = cut(ends)
    count = max(1, -(-ends.count() // IN_BLOCK))

    def run(found: pa.Table) -> pa.Table:
        x, y, w = (found[c].to_numpy() for c in ("x", "y", "w"))
        order = np.argsort(x, kind="stable")
        return pa.table({c: pa.array([v[order].tobytes()], pa.binary()) for c, v in (("x", x), ("y", y), ("w", w))})

    return cut(ends.groupBy(F.pmod("x", F.lit(count)).alias("block")).applyInArrow(run, _BINARY("x", "y", "w")))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            yield tuple(np.frombuffer(v.as_buffer(), t) for v, t in zip(row, (np.int32, np.int32, np.float64), strict=True))


def _numbered(codes):
    """Pairs of hashes in both directions, as places in the sorted codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.searchsorted(codes.value, batch.column(c).to_numpy()).astype(np.int32) for c in ("x", "y"))
            w = batch.column("w").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in ((x, y), (y, x), (w, w))], ["x", "y", "w"])

    return run


def _degrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x, _, w in _each(batches):
        at, of = np.unique(x, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (at, np.bincount(of, w))], ["x", "k"])


def _coin(ties: np.ndarray, turn: int) -> np.ndarray:
    """pmod(xxhash64(id, turn), 2) of ids with the hashes ties."""
    one, two, three, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = ties.view(np.uint64) + five + np.uint64(4)
    h ^= np.array([turn], np.uint64) * one
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * two + three
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * three
    return (h ^ (h >> np.uint64(32))) & np.uint64(1)


def _moves(sent, weights, ties, twice: float, turn: int):
    """By block: the weight of edges within communities, and vertices a with the communities c that they move to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (labels, volume), degree, hashes = sent.value, weights.value, ties.value
        for x, y, w in _each(batches):
            c = labels[y]
            inside = float(w[labels[x] == c].sum())
            a, to = _best(x, c, w, labels, volume, degree, hashes, twice, turn)
            yield pa.RecordBatch.from_arrays([pa.array([inside]), *(pa.array([v.astype(np.int32).tobytes()], pa.binary()) for v in (a, to))], ["inside", "a", "c"])

    return run


def _best(x, c, w, labels, volume, degree, hashes, twice: float, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the vertices whose turn it is, those that gain by another community, and which: of equal gains the one with the largest hash."""
    free = _coin(hashes[x], turn) == 0
    x, c, w = x[free], c[free], w[free]
    if not len(x):
        return x, c
    order = np.argsort(x.astype(np.int64) * len(labels) + c)
    x, c, w = x[order], c[order], w[order]
    start = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (c[1:] != c[:-1])))
    kin, x, c = np.add.reduceat(w, start), x[start], c[start]
    was, k = labels[x], degree[x]
    same = c == was
    gain = kin - k * (volume[c] - np.where(same, k, 0.0)) / twice
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    most = np.maximum.reduceat(gain, first)
    stay = -k[first] * (volume[was[first]] - k[first]) / twice
    top = gain == most[group]
    goes = (most > stay) & ~np.logical_or.reduceat(top & same, first)
    tie = np.where(top, hashes[c], np.iinfo(np.int64).min)
    at = np.flatnonzero(top & goes[group] & (tie == np.maximum.reduceat(tie, first)[group]))
    at = at[np.append(True, x[at][1:] != x[at][:-1])] if len(at) else at
    return x[at], c[at]


def _merged(labels):
    """Edges between different communities, summed by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, w in _each(batches):
            a, b = labels.value[x].astype(np.int64), labels.value[y]
            apart = a != b
            key, of = np.unique(a[apart] << 32 | b[apart], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(np.bincount(of, w[apart], len(key)))], ["x", "y", "w"])

    return run


def _members(codes, roots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(roots.value[np.searchsorted(codes.value, batch.column("h").to_numpy())])], ["id", "r"])

    return run


def joined_louvain(edges: DataFrame) -> DataFrame:
    """The same as louvain by joins, for any number of vertices."""
    base = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))
    graph = cut(base)
    total = graph.agg(F.sum("w")).first()[0]
    ids = cut(graph.select(F.col("a").alias("id")).union(graph.select("b")).distinct())
    member = cut(ids.select("id", F.col("id").alias("community")))
    if not total:
        return member
    while True:
        both = cut(graph.where("a <> b").select("a", "b", "w").union(graph.where("a <> b").select("b", "a", "w")))
        own = graph.where("a = b").select("a", (F.col("w") * 2).alias("w"))
        degree = cut(both.select("a", "w").union(own).groupBy("a").agg(F.sum("w").alias("k")))
        best_labels = labels = cut(degree.select("a", F.col("a").alias("c")))
        reached, turn = _modularity(both, own, degree, labels, total), 0
        while True:
            volume = labels.join(degree, "a").groupBy("c").agg(F.sum("k").alias("v"))
            links = both.join(labels.select(F.col("a").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("kin"))
            mine = labels.join(degree, "a").select("a", F.col("c").alias("was"), "k")
            options = links.join(mine, "a").join(volume, "c").withColumn("rest", F.col("v") - F.when(F.col("c") == F.col("was"), F.col("k")).otherwise(0.0))
            gains = options.select("a", "c", "was", (F.col("kin") - F.col("k") * F.col("rest") / (2 * total)).alias("gain"))
            stay = mine.join(volume, F.col("was") == F.col("c")).select("a", "was", (F.col("was")).alias("c"), (-F.col("k") * (F.col("v") - F.col("k")) / (2 * total)).alias("gain"))
            best = gains.unionByName(stay).groupBy("a", "was").agg(F.max_by(F.struct("c", "gain"), F.struct("gain", (F.col("c") == F.col("was")).alias("same"), F.xxhash64("c"))).alias("to"))
            free = F.pmod(F.xxhash64("a", F.lit(turn)), F.lit(2)) == 0
            moved = cut(best.select("a", F.when(free, F.col("to.c")).otherwise(F.col("was")).alias("c"), (free & (F.col("to.c") != F.col("was"))).alias("moved")))
            labels, turn = moved.select("a", "c"), turn + 1
            if turn % 2 == 0:
                now = _modularity(both, own, degree, labels, total)
                if now <= reached + 1e-9:
                    break
                best_labels, reached = labels, now
        labels = best_labels
        merged = cut(member.join(labels.select(F.col("a").alias("community"), "c"), "community").select("id", F.col("c").alias("community")))
        if modularity(base, merged) <= modularity(base, member) + 1e-9:
            break
        member = merged
        names = labels.select("a", "c")
        graph = cut(graph.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w")))
    least = member.groupBy("community").agg(F.min("id").alias("name"))
    return member.join(least, "community").select("id", F.col("name").alias("community"))


def _modularity(both: DataFrame, own: DataFrame, degree: DataFrame, labels: DataFrame, total: float) -> float:
    """Of a level's labels (a, c): both has each edge in both directions, own each loop's double weight, degree each vertex's weight."""
    named = both.join(labels, "a").join(labels.toDF("b", "d"), "b")
    inside = (named.where("c = d").agg(F.sum("w")).first()[0] or 0.0) + (own.agg(F.sum("w")).first()[0] or 0.0)
    spread = degree.join(labels, "a").groupBy("c").agg(F.sum("k").alias("k")).agg(F.sum((F.col("k") / (2 * total)) ** 2)).first()[0]
    return inside / (2 * total) - spread


def modularity(edges: DataFrame, member: DataFrame) -> float:
    """Of a partition (id, community) of undirected edges (a, b, w)."""
    named = edges.join(member.toDF("a", "x"), "a").join(member.toDF("b", "y"), "b")
    total = named.agg(F.sum("w")).first()[0]
    inside = named.agg(F.sum(F.when(F.col("x") == F.col("y"), F.col("w")).otherwise(0.0))).first()[0]
    ends = named.select(F.col("x").alias("c"), "w").union(named.select("y", "w")).groupBy("c").agg(F.sum("w").alias("k"))
    return inside / total - ends.agg(F.sum((F.col("k") / (2 * total)) ** 2)).first()[0]


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
