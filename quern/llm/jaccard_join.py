"""Exact Jaccard self-join of shingle sets, and its classes: a count-vector R-tree inside blocks of shared rare shingles.

Shingles are hashed to groups; a set's point is its counts by group. The overlap of two sets is at most the sum of the smaller
coordinates, and of a set and a node of the tree at most the sum over the node's upper corner; what can't reach the overlap that a
similarity needs is not looked at. Points alone don't part sets well (with random shingles they lie close together), so points are
compared inside blocks: of a set's shingles, in an order that all sets share, with those that occur often last, the first
n - ceil(t * n) + 1 are its prefix, and two sets of similarity t or more share one in both prefixes. A block is the sets that have
a shingle in their prefixes. No link is lost, and what is found is verified on whole sets.

1. Documents of equal sets are one: their least id stands for all. Counts of hashed shingles, of a fixed size, give the order; a count
   that many shingles share costs work, never a link.
2. Blocks are counted by grouped sums; blocks of the same members are one. In each, members are compared to the least member, and
   components are made of the links. That joins most groups of near copies, however large, with a row or two a member.
3. A pair is to be found in the block of the first shingle that both have, so that its overlap is at most what either has from there
   on. Members that can't reach an overlap with any size in their block leave it: of near copies, those that have changed too much.
4. Blocks that still have members of two components are searched in full, parted by size: members of the largest component need no
   comparison with one another; the others are dealt, block-wise, against all. Each such unit has a bounded number of points, in an
   R-tree. A first pass takes each member's best pair only; a second, over what is still apart, takes all. A group whose members
   allow one another by all these bounds and yet don't link costs pairs in the square of its size.

Defined cases: a null text has no words; fewer than five words make one shingle; an empty set links with nothing; a row with a null
id links with nothing and has a null component; rows that repeat an id are linked with one another; a similarity of exactly the
threshold links, and of equal sets the least id stands for all; texts of any length are read whole; shingles are told apart by hashes
of 64 bits; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Out, Rolling, bit_filter, bounded_batches, components, cut, mix, passes, rows, summed, table, tidied, trimming, word_hashes, without_ids, words_of

SHINGLE = 5
#: Similarity in hundredths.
PERCENT = 80
#: Least and greatest number of coordinates of a point; between them a set of n has n / 2 to n.
GROUPS = 32, 1 << 14
#: Slots of the counts that order shingles, and where a count stops: 16 MB, whatever the input.
SLOTS, MOST = 1 << 24, 255
CHUNKS = 256
#: Points of either side in a unit of step 4.
UNIT = 256
FANOUT = 8

_rolling = Rolling()
_profile = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("mixed", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])
_member = pa.schema([("shingle", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])
_candidate = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("coarse", pa.binary()), ("point", pa.binary()), ("items", pa.binary()), ("blocks", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])


def shingles(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text's words, A-Z lower-cased, as sorted hashes."""
    words = words_of(text.lower() if text else text)
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(_rolling.runs(_rolling.sums(word_hashes(words)), min(k, len(words))))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of n and m with a similarity of percent: 100 o >= percent (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def groups_of(n: int) -> int:
    """Coordinates for a set of n: the power of two over n / 2. With few shingles a coordinate, bounds come near the overlap."""
    return min(GROUPS[1], max(GROUPS[0], 1 << (n // 2).bit_length()))


def point(items: np.ndarray) -> np.ndarray:
    groups = groups_of(len(items))
    return np.bincount(((items >> np.uint64(20)) & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype("<u2")


def packed(p: np.ndarray) -> bytes:
    """A point in half a byte a coordinate: what is over 15 is cut off, and the sum of that comes first."""
    low = np.minimum(p, 15).astype(np.uint8)
    return int(p.sum(dtype=np.int64) - low.sum(dtype=np.int64)).to_bytes(8, "little") + (low[0::2] | low[1::2] << 4).tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, int]:
    """A point's coordinates up to 15 and the sum of what was cut off: no overlap of two is more than the bound of the coordinates and both sums."""
    both = np.frombuffer(data, np.uint8, offset=8)
    return np.stack((both & 15, both >> 4), axis=1).ravel(), int.from_bytes(data[:8], "little")


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """A point, or a row each, with fewer coordinates: groups that agree in their lower bits are one."""
    return p.reshape(*p.shape[:-1], -1, groups).sum(-2, dtype=np.int32)


class Forest:
    """R-trees over points of several numbers of coordinates, one for each that a query meets."""

    def __init__(self, points: list[np.ndarray], sizes: np.ndarray, over: int = 0):
        """over: the most that was cut off of a point."""
        self.sizes, self.points, self.trees, self.over = sizes, points, {}, over
        self.groups = np.array([len(p) for p in points])

    def search(self, q: np.ndarray, size: int, percent: int, over: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """As of a tree, over all of them. over: what was cut off of q."""
        found, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
        for groups in np.unique(self.groups):
            level = int(min(groups, len(q)))
            if max(groups, len(q)) > 2 * level:  # sizes over a factor of two apart
                continue
            if (groups, level) not in self.trees:
                mine = np.flatnonzero(self.groups == groups)
                self.trees[groups, level] = mine, Tree(folded(np.stack([self.points[k] for k in mine]), level), self.sizes[mine])
            mine, tree = self.trees[groups, level]
            at, score = tree.search(folded(q, level), size, percent, over + self.over)
            found.append(mine[at])
            scores.append(score)
        return np.concatenate(found), np.concatenate(scores)


class Tree:
    """An R-tree over points, packed along the sizes and heaviest coordinates; levels from the leaves up."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points.argmax(1), sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        high, small = self.points, self.sizes
        while len(high) > 1:
            at = np.arange(0, len(high), FANOUT)
            high, small = np.maximum.reduceat(high, at), np.minimum.reduceat(small, at)
            self.levels.append((high, small))

    def search(self, q: np.ndarray, size: int, percent: int, over: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Positions, in the order given, of points whose bound and over reach the overlap needed with a set of this size, and the bound over what is needed."""
        open_ = np.zeros(1, np.int64) if self.levels else np.arange(len(self.points))
        for high, small in reversed(self.levels):
            good = np.minimum(high[open_], q).sum(1) + over >= needed(small[open_], np.int64(size), percent)
            open_ = (open_[good][:, None] * FANOUT + np.arange(FANOUT)).ravel()
            below = len(self.points) if high is self.levels[0][0] else len(self.levels[[x[0] is high for x in self.levels].index(True) - 1][0])
            open_ = open_[open_ < below]
        least, most = np.minimum(self.sizes[open_], size), np.maximum(self.sizes[open_], size)
        bound, need = np.minimum(self.points[open_], q).sum(1) + over, needed(self.sizes[open_], np.int64(size), percent)
        good = (bound >= need) & (100 * least >= percent * most)
        return self.order[open_[good]], bound[good] / np.maximum(need[good], 1)


def _profiles(k: int, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, counts = Out(_profile), np.zeros(slots, np.uint8)
        for doc, text in rows(batches, "doc", "text"):
            items = shingles(text, k)
            at = (items & np.uint64(slots - 1)).astype(np.int64)
            held = counts[at]
            counts[at] = held + (held < MOST)
            sums = [int(x.sum(dtype=np.uint64)) for x in (mix(items ^ np.uint64(0x1234567)), mix(items + np.uint64(0x89ABCDEF)))]
            hashed = int(mix(np.array([0 if doc is None else doc], np.int64).view(np.uint64))[0])
            out.add([doc], [len(items)], *([x - (1 << 64) if x >> 63 else x] for x in (*sums, hashed)), [None], [None])
            if out.full():
                yield _lists(out)
        width = slots // CHUNKS
        used = [c for c in range(CHUNKS) if counts[c * width : (c + 1) * width].any()]
        for c in used:
            out.add([None], [None], [None], [None], [None], [c], [_packed(counts[c * width : (c + 1) * width])])
        if out.n:
            yield _lists(out)

    return trimming(run)


def _lists(out: Out) -> pa.RecordBatch:
    columns = [pa.array([x for xs in part for x in xs], f.type) for part, f in zip(out.parts, out.schema, strict=True)]
    out.parts, out.n = [[] for _ in out.schema], 0
    return pa.RecordBatch.from_arrays(columns, schema=out.schema)


def _packed(counts: np.ndarray) -> bytes:
    return pa.compress(np.minimum(counts, MOST).astype(np.uint8).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    """Counts of a chunk, in a type that their sums over partitions fit."""
    return np.frombuffer(pa.decompress(data, SLOTS // CHUNKS, "zstd", asbytes=True), np.uint8).astype(np.uint32)


def _prefix(items: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    order = np.lexsort((items, counts[(items & np.uint64(len(counts) - 1)).astype(np.int64)]))
    return items[order[: prefix_length(len(items), percent)]]


def _members(k: int, percent: int, counts, first):
    """A row for each shingle in the prefix of a document that may be the first of its set, with its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(_member)
        for batch in batches:
            docs, texts = batch.column("doc").to_numpy(), batch.column("text")
            for i in np.flatnonzero(passes(first.value, mix(docs.view(np.uint64)))):
                items = shingles(texts[int(i)].as_py(), k)
                head = _prefix(items, counts.value, percent)
                out.add(head, np.full(len(head), docs[i]), np.full(len(head), len(items), np.int32), np.arange(len(head), dtype=np.int32))
                if out.full():
                    yield out.take()
        if out.n:
            yield out.take()

    return trimming(run)


def _candidates(k: int, percent: int, counts, first, wanted):
    """The documents with a wanted shingle in their prefix: set, point, these shingles and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = Out(_candidate), 0
        for batch in batches:
            docs, texts = batch.column("doc").to_numpy(), batch.column("text")
            for i in np.flatnonzero(passes(first.value, mix(docs.view(np.uint64)))):
                items = shingles(texts[int(i)].as_py(), k)
                head = _prefix(items, counts.value, percent)
                if len(hits := np.flatnonzero(passes(wanted.value, head))):
                    fine = point(items)
                    out.add([docs[i]], [len(items)], [folded(fine, GROUPS[0]).astype("<u4").tobytes()], [packed(fine)], [items.astype("<u8").tobytes()], [head[hits].view(np.int64).tolist()], [hits.tolist()])
                    size += 8 * len(items)
                    if size > 8_000_000:
                        yield _lists(out)
                        size = 0
        if out.n:
            yield _lists(out)

    return trimming(run)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return trimming(run)


def _bound(percent: int, load):
    """Of pairs with points and sizes, those whose bound reaches the overlap needed. load: a point's coordinates, and what was cut off of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for p, q, n, m in zip(*(batch.column(c).to_pylist() for c in ("pa", "pb", "na", "nb")), strict=True):
                (p, x), (q, y) = load(p), load(q)
                level = min(len(p), len(q))
                good.append(int(np.minimum(folded(p, level), folded(q, level)).sum()) + x + y >= -(-percent * (n + m) // (100 + percent)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return trimming(run)


def _among(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(wanted.value, batch.column("doc").to_numpy())))

    return trimming(run)


def _of_pairs(rows_: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of rows whose doc is in a pair, by a bit filter: only these are shuffled. A few others may pass."""
    ends = pairs.select(F.col("a").alias("doc")).union(pairs.select("b"))
    wanted = rows_.sparkSession.sparkContext.broadcast(bit_filter(ends, "doc"))
    some = rows_.select(*columns)
    return some.mapInArrow(_among(wanted), some.schema)


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those that their points allow."""
    light = _of_pairs(sets, pairs, ["doc", "n", "point"])
    pointed = pairs.join(light.toDF("a", "na", "pa").hint("merge"), "a").join(light.toDF("b", "nb", "pb").hint("merge"), "b")
    return cut(pointed.mapInArrow(_bound(percent, unpacked), "a long, b long"))


def _links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those whose sets link."""
    heavy = _of_pairs(sets, near, ["doc", "items"])
    full = near.join(heavy.toDF("a", "x").hint("merge"), "a").join(heavy.toDF("b", "y").hint("merge"), "b")
    return cut(full.mapInArrow(_verify(percent), "a long, b long"))


def _few(near: DataFrame) -> DataFrame:
    """Of pairs (a, b), for each b those with the least and with the greatest a."""
    ends = near.groupBy("b").agg(F.min("a").alias("x"), F.max("a").alias("y"))
    return cut(ends.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("a"), "b"))


def _unit_pairs(percent: int, best: bool):
    """Within units (block, part, i, j), sorted: pairs of a probe and an indexed member of another component whose bounds hold.

    best: of each probe's only the pair with the best bound, and the best with the main component.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(unit: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        probe, doc, comp, main, onward, n, p = (list(x) for x in zip(*unit, strict=True))
        probe, doc, comp, main, onward, n = np.array(probe), np.array(doc, np.int64), np.array(comp, np.int64), main[0], np.array(onward, np.int64), np.array(n, np.int64)
        p, over = zip(*map(unpacked, p), strict=True)
        base = np.flatnonzero(~probe)
        if not len(base):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        tree, a, b = Forest([p[k] for k in base], n[base], max(over[k] for k in base)), [], []
        for k in np.flatnonzero(probe):
            found, score = tree.search(p[k], int(n[k]), percent, over[k])
            found = base[found]
            good = (comp[found] != comp[k]) & (np.minimum(onward[found], onward[k]) >= needed(n[found], n[k], percent))
            found, score = found[good], score[good]
            if best and len(found) > 1:
                order = np.lexsort((doc[found], -score))
                in_main = order[comp[found[order]] == main][:1]
                found = found[np.unique(np.concatenate((order[:1], in_main)))]
            a.append(np.minimum(doc[found], doc[k]))
            b.append(np.maximum(doc[found], doc[k]))
        return np.concatenate(a or [np.zeros(0, np.int64)]), np.concatenate(b or [np.zeros(0, np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, unit = Out(schema), None, []
        for block, part, i, j, *row in rows(batches, "block", "part", "i", "j", "probe", "doc", "component", "main", "onward", "n", "point"):
            if (block, part, i, j) != now:
                if unit:
                    out.add(*solve(unit))
                    if out.full():
                        yield out.take()
                now, unit = (block, part, i, j), []
            unit.append(tuple(row))
        if unit:
            out.add(*solve(unit))
        if out.n:
            yield out.take()

    return trimming(run)


def _able(members: DataFrame, percent: int) -> DataFrame:
    """Members (block, part, doc, onward) that can link with another of their block and part, found at the block's shingle. members:
    block, doc, n, place.

    onward: how many shingles a member has from the block's on. The overlap of a pair is at most that of either, which bounds the
    sizes that a member can link with. A block is parted by size: sets whose sizes allow the similarity are in the same class or in
    neighbouring ones, of which a part holds two.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int")
    onward = (F.col("n") - F.col("place")).alias("onward")
    parted = cut(members.select("block", "doc", "n", onward, F.explode(F.array(size_class, size_class + 1)).alias("part")))
    # The largest set that an overlap of onward is enough for.
    reach = F.floor(((100 + percent) * F.col("onward") - percent * F.col("n")) / percent)
    # Written first: a join of two plain shuffles is one that Spark can split where a block is hot.
    bounds = cut(parted.groupBy("block", "part").agg(F.min("n").alias("least"), F.max(reach).alias("far"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    return cut(parted.join(bounds.drop("m").hint("merge"), ["block", "part"]).where((reach >= F.col("least")) & (F.col("n") <= F.col("far"))).select("block", "part", "doc", "onward"))


def _open_blocks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (block, part, doc, onward, component) of blocks that hold several components, with the block's size m, and the largest
    component main and its size. members: block, part, doc, onward.
    """
    labelled = members.join(labels.select(F.col("id").alias("doc"), "component").hint("merge"), "doc", "left")
    named = cut(labelled.select("block", "part", "doc", "onward", F.coalesce("component", "doc").alias("component")))
    sizes = named.groupBy("block", "part", "component").agg(F.count(F.lit(1)).alias("c"))
    blocks = cut(sizes.groupBy("block", "part").agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("components"), F.max(F.struct("c", "component")).alias("main")).where("components > 1"))
    return cut(named.join(blocks.select("block", "part", "m", F.col("main.component").alias("main"), F.col("main.c").alias("main_size")).hint("merge"), ["block", "part"]))


def _unresolved_pairs(dealt: DataFrame, points: DataFrame, percent: int, unit: int, best: bool) -> DataFrame:
    """All pairs of different components in open blocks that the points allow, or the best of each. points: doc, n, point."""
    ends = dealt.select(F.col("doc").alias("a"), F.col("doc").alias("b"))
    # Indexed members fall to i, the probes (all but the main component) to j.
    dealt = dealt.withColumns({"is": F.ceil(F.col("m") / unit).cast("int"), "js": F.ceil((F.col("m") - F.col("main_size")) / unit).cast("int")})
    dealt = dealt.join(_of_pairs(points, ends, ["doc", "n", "point"]).hint("merge"), "doc")
    where = lambda k: F.pmod(F.xxhash64("doc"), k).cast("int")
    row = ["block", "part", "i", "j", "probe", "doc", "component", "main", "onward", "n", "point"]
    indexed = dealt.withColumn("i", where(F.col("is"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("js") - 1))).withColumn("probe", F.lit(False)).select(*row)
    probes = dealt.where("component <> main").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("is") - 1))).withColumn("j", where(F.col("js"))).withColumn("probe", F.lit(True)).select(*row)
    key = ["block", "part", "i", "j"]
    return indexed.union(probes).repartition(*key).sortWithinPartitions(*key).mapInArrow(_unit_pairs(percent, best), "a long, b long").distinct()


@tidied
@bounded_batches
def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = SHINGLE, unit: int = UNIT) -> DataFrame:
    """Returns id, n_shingles and component_id (the least id reachable by links) for each document."""
    sc = docs.sparkSession.sparkContext
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    both = cut(base.mapInArrow(_profiles(k, SLOTS), "doc long, n long, s1 long, s2 long, mixed long, chunk int, counts binary"))
    profiles = both.where("chunk is null").select("doc", "n", "s1", "s2", "mixed")
    counts = np.zeros(SLOTS, np.uint8)
    for row in summed(both.where("chunk is not null"), "chunk", "counts", _unpacked, _packed).toLocalIterator():  # CHUNKS rows at most
        counts[row["chunk"] * (SLOTS // CHUNKS) : (row["chunk"] + 1) * (SLOTS // CHUNKS)] = _unpacked(row["counts"])
    counts = sc.broadcast(counts)

    sets = cut(profiles.where("n > 0 and doc is not null").groupBy("s1", "s2", "n").agg(F.min(F.struct("doc", "mixed")).alias("first")).select("s1", "s2", "n", "first.*"))
    first = sc.broadcast(bit_filter(sets, "mixed"))
    keyed = base.where("doc is not null")

    members = keyed.mapInArrow(_members(k, percent, counts, first), "shingle long, doc long, n int, place int")
    shared = members.groupBy("shingle").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("place").alias("place")).where("low < high")
    alike = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)
    shared = shared.where((F.col("m") > 2) | alike(F.col("least"), F.col("most")))
    # Of shingles with the same members the first in order, whose places are the least in all of them.
    blocks = shared.groupBy("low", "high", "m", "x").agg(F.min(F.struct("place", "shingle")).alias("first")).withColumn("block", F.col("first.shingle"))
    blocks = cut(blocks.select("block", "low"))
    wanted = sc.broadcast(bit_filter(blocks, "block"))
    found = cut(keyed.mapInArrow(_candidates(k, percent, counts, first, wanted), "doc long, n long, coarse binary, point binary, items binary, blocks array<long>, places array<int>"))

    # All members against the least one of their block, by sizes and coarse points, then by points; of what is left few pairs a document.
    lows = blocks.join(found.select(F.col("doc").alias("low"), F.col("n").alias("na"), F.col("coarse").alias("pa")).hint("merge"), "low")
    inside = found.select("doc", "n", F.explode("blocks").alias("block"), "coarse")
    placed = found.select("doc", "n", F.explode(F.arrays_zip(F.col("blocks").alias("block"), F.col("places").alias("place"))).alias("at")).select("doc", "n", "at.*")
    stars = inside.join(lows.hint("merge"), "block").where("low < doc").where(alike(F.col("na"), F.col("n"))).select(F.col("low").alias("a"), F.col("doc").alias("b"), "na", F.col("n").alias("nb"), "pa", F.col("coarse").alias("pb"))
    stars = cut(stars.mapInArrow(_bound(percent, lambda x: (np.frombuffer(x, "<u4"), 0)), "a long, b long").distinct())
    tried = _few(_near(stars, found, percent))
    links = _links(tried, found, percent)
    labels = components(links)

    # In blocks that are still open, the best pairs by points, which mostly link; then, in what is open even so, all pairs.
    members = _able(placed.join(blocks.select("block").hint("merge"), "block"), percent)
    for best in (True, False):
        rest = _unresolved_pairs(_open_blocks(members, labels), found, percent, unit, best)
        rest = cut(rest.join(tried.hint("merge"), ["a", "b"], "left_anti"))
        more = _links(rest, found, percent)
        if more.limit(1).count():
            links = links.union(more)
            labels = components(links)
        tried = tried.union(rest)

    named = sets.join(labels.select(F.col("id").alias("doc"), "component").hint("merge"), "doc", "left").select("s1", "s2", "n", F.coalesce("component", "doc").alias("component_id"))
    classed = profiles.join(named.hint("merge"), ["s1", "s2", "n"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return classed.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class, with its columns; rows with a null id stay."""
    return without_ids(docs, jaccard_classes(docs).where("doc_id <> component_id").select("doc_id"))


SQL = r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as pos from t where len(w) > 0),
s as (select distinct doc_id, md5(array_to_string(w[pos:pos + 4], ' ')) as g from p),
n as (select doc_id, count(*) as n from s group by 1),
o as (select x.doc_id as a, y.doc_id as b, count(*) as o from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from o join n x on a = x.doc_id join n y on b = y.doc_id where 100 * o >= 80 * (x.n + y.n - o)),
e as (select a, b from l union select b, a from l),
r as (select a as id, b as other from e union select r.id, e.b from r join e on r.other = e.a)
select t.doc_id, coalesce(any_value(n.n), 0) as n_shingles, least(t.doc_id, coalesce(min(r.other), t.doc_id)) as component_id
from t left join n using (doc_id) left join r on r.id = t.doc_id group by t.doc_id
"""
