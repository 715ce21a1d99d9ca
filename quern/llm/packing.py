"""Best-fit packing of documents into sequences, improved by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens. A full piece is a sequence. The others are dealt by hash to blocks of a bounded
number; each block is solved by several islands, each a task of its own with a population of packings. A generation's crossover
injects whole well-filled bins of one parent into another, empties the bins that hold the same pieces, and best-fits the displaced
pieces; mutation empties the least filled bins. Between epochs each island's elite goes to the next island of its block. Then bins
filled to `good` stand, and the pieces of all other bins meet again in blocks of the same bounded number, for as long as a round lowers
the number of pieces in such bins by GAIN; what is left then stands too. No block grows with the input.

Defined cases: a null or empty text is its end id alone; a row with a null id, or rows that repeat an id, are packed each (rows are
dealt to blocks by their place, not their id); a document longer than the capacity is cut into pieces, the last of which may be
shorter; an empty table gives an empty result; other columns are not read. Ties fall to the lower position, and random numbers come from the block and island, so that equal inputs give equal
packings.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, cut, table, trimming
from quern.llm.tokenizing import Encoder

CAPACITY = 4096
#: Pieces in a block, on average.
BLOCK = 2048
ISLANDS = 2
EPOCHS = 2
POPULATION = 5
OFFSPRING = 10
#: Fill from which a bin stands.
GOOD = 0.995
#: Part of the pieces in unfilled bins that a round has to settle for another to follow.
GAIN = 0.05

_piece = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])
_island = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("elite", pa.binary()), ("fitness", pa.float64())])


def _tokenize(vocabulary: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for key, ids in zip(batch.column("id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    out.append((key, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, _piece, strict=True)], schema=_piece)
        Encoder.forget()

    return trimming(run)


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length and ids_crc32 of each piece of each document's ids."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(_tokenize(vocabulary, end_id, capacity), "id long, piece int, start long, length int, ids_crc32 long")


def best_fit(items: list[int], lengths: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Puts items, in the order given, each in the fullest bin that takes it, or in a new one. Changes bins and room."""
    free = sorted((r, k) for k, r in enumerate(room) if r)
    for x in items:
        n = lengths[x]
        at = bisect_left(free, (n, -1))
        if at < len(free):
            r, k = free.pop(at)
            bins[k].append(x)
        else:
            k, r = len(bins), capacity
            bins.append([x])
            room.append(r)
        room[k] = r = r - n
        if r:
            insort(free, (r, k))


class Packing:
    def __init__(self, bins: list[list[int]], room: list[int], capacity: int):
        self.bins, self.room = bins, room
        self.fitness = sum(((capacity - r) / capacity) ** 2 for r in room) / max(1, len(room)) - 1e-9 * len(room)

    @classmethod
    def made(cls, order: list[int], lengths: list[int], capacity: int) -> Packing:
        bins: list[list[int]] = []
        room: list[int] = []
        best_fit(order, lengths, bins, room, capacity)
        return cls(bins, room, capacity)

    def dump(self, n: int) -> bytes:
        out = np.zeros(n, "<i4")
        for k, members in enumerate(self.bins):
            out[members] = k
        return out.tobytes()

    @classmethod
    def load(cls, data: bytes, lengths: list[int], capacity: int) -> Packing:
        at = np.frombuffer(data, "<i4")
        bins: list[list[int]] = [[] for _ in range(int(at.max(initial=-1)) + 1)]
        for x, k in enumerate(at.tolist()):
            bins[k].append(x)
        return cls(bins, [capacity - sum(lengths[x] for x in members) for members in bins], capacity)


def crossed(a: Packing, b: Packing, lengths: list[int], capacity: int, random: np.random.Generator) -> Packing:
    """b's well-filled bins, of which a random part is injected whole, and what is left of a."""
    best = np.argsort(b.room, kind="stable")[: max(1, len(b.room) // 2)]
    chosen = np.sort(random.choice(best, max(1, len(best) // 2), replace=False)).tolist()
    injected = {x for k in chosen for x in b.bins[k]}
    bins, room, loose = [list(b.bins[k]) for k in chosen], [b.room[k] for k in chosen], []
    for members, r in zip(a.bins, a.room, strict=True):
        if injected.isdisjoint(members):
            bins.append(list(members))
            room.append(r)
        else:
            loose += [x for x in members if x not in injected]
    return _mended(bins, room, loose, lengths, capacity, random)


def _mended(bins: list[list[int]], room: list[int], loose: list[int], lengths: list[int], capacity: int, random: np.random.Generator) -> Packing:
    """Empties the least filled bins, and a few at random, and best-fits what is loose, longest first."""
    gone = set(np.argsort(room, kind="stable")[-max(1, len(room) // 50) :].tolist()) | set(random.integers(0, len(room), max(1, len(room) // 100)).tolist())
    loose = loose + [x for k in sorted(gone) for x in bins[k]]
    bins, room = [x for k, x in enumerate(bins) if k not in gone], [x for k, x in enumerate(room) if k not in gone]
    best_fit(sorted(loose, key=lambda x: -lengths[x]), lengths, bins, room, capacity)
    return Packing(bins, room, capacity)


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[bytes], population: int, offspring: int) -> Packing:
    """The best packing of an island's epoch. elites are packings to start from."""
    random = np.random.default_rng(seed)
    longest = sorted(range(len(lengths)), key=lambda x: -lengths[x])
    living = [Packing.load(x, lengths, capacity) for x in elites]
    floor = -(-sum(lengths) // capacity)
    if not living:
        living.append(Packing.made(longest, lengths, capacity))
    while len(living) < population and len(min(living, key=lambda x: len(x.bins)).bins) > floor:
        noise = random.uniform(0.8, 1.25, len(lengths))
        living.append(Packing.made(sorted(range(len(lengths)), key=lambda x: -lengths[x] * noise[x]), lengths, capacity))
    for _ in range(offspring):
        living.sort(key=lambda x: (len(x.bins), -x.fitness))
        if len(living[0].bins) <= floor or len(living) < 2:
            break
        i, j = np.sort(random.choice(len(living), 2, replace=False))
        living = living[: population - 1] + [crossed(living[i], living[j], lengths, capacity, random)]
    return min(living, key=lambda x: (len(x.bins), -x.fitness))


def _evolve(capacity: int, epoch: int, population: int, offspring: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, island, lengths, elites in zip(*(batch.column(c).to_pylist() for c in ("block", "island", "lengths", "elites")), strict=True):
                best = evolve(lengths, capacity, 1_000_003 * (block % 1_000_000) + 1009 * island + epoch, elites or [], population, offspring)
                yield pa.RecordBatch.from_pylist([{"block": block, "island": island, "elite": best.dump(len(lengths)), "fitness": best.fitness - len(best.bins)}], schema=_island)

    return run


def _place(capacity: int, good: float):
    """A row for each piece of a block: its bin, its offset there, and whether the bin stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lengths, elite, last in zip(*(batch.column(c).to_pylist() for c in ("block", "lengths", "elite", "last")), strict=True):
                at = np.frombuffer(elite, "<i4")
                order = np.lexsort((np.arange(len(at)), at))
                n = np.array(lengths, np.int64)[order]
                first = np.concatenate(([True], at[order][1:] != at[order][:-1]))
                before = np.cumsum(n) - n
                offset = np.zeros(len(at), np.int64)
                offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
                fill = np.bincount(at, lengths)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(at), pa.int64()), pa.array(range(len(at)), pa.int32()), pa.array(at), pa.array(offset), pa.array((fill[at] >= good * capacity) | bool(last))], names=["block", "slot", "bin", "offset", "stands"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION, offspring: int = OFFSPRING, good: float = GOOD, gain: float = GAIN) -> DataFrame:
    """Adds sequence_id and offset to pieces (id, piece, start, length, ids_crc32)."""
    spark = pieces.sparkSession
    columns = ["id", "piece", "start", "length", "ids_crc32"]
    whole = F.struct("place", *columns)
    # A row's place in the written table tells rows apart, however often an id repeats.
    pieces = cut(pieces).select(*columns, F.monotonically_increasing_id().alias("place"))
    # Ids of sequences: the round above bit 56, the block above bit 20, the bin. Full pieces are a sequence each, in round 0.
    full = pieces.where(F.col("length") == capacity)
    done = [full.select(*columns, F.col("place").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, before = pieces.where(F.col("length") < capacity), None
    for turn in range(1, 100):
        count = left.count()
        if not count:
            break
        blocks = -(-count // block)
        last, before = blocks == 1 or before is not None and count > (1 - gain) * before, count
        dealt = left.select(F.pmod(F.xxhash64("place", F.lit(turn)), F.lit(blocks)).alias("block"), whole.alias("row"))
        # A block is a row of about BLOCK structs; which is which must not change between tasks, so it is written.
        grouped = cut(dealt.groupBy("block").agg(F.array_sort(F.collect_list("row")).alias("rows")).withColumn("lengths", F.expr("transform(rows, x -> x.length)")))
        tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        elites = None
        for epoch in range(epochs):
            start = grouped.select("block", "lengths", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
            if elites is None:
                start = start.withColumn("elites", F.expr("cast(array() as array<binary>)"))
            else:  # an island has its own elite and that of the one before it
                both = elites.select("block", "island", "elite").union(elites.select("block", ((F.col("island") + 1) % islands).alias("island"), "elite"))
                start = start.join(both.groupBy("block", "island").agg(F.array_sort(F.collect_set("elite")).alias("elites")), ["block", "island"])
            start = start.repartition(min(tasks, blocks * islands), "block", "island")
            elites = cut(start.mapInArrow(_evolve(capacity, epoch, population, offspring), "block long, island int, elite binary, fitness double"))
        best = elites.groupBy("block").agg(F.max_by("elite", F.struct("fitness", F.col("island") * -1)).alias("elite"))
        solved = grouped.select("block", "lengths").join(best, "block").withColumn("last", F.lit(last))
        placed = solved.mapInArrow(_place(capacity, good), "block long, slot int, bin int, offset long, stands boolean")
        rows = grouped.select("block", F.posexplode("rows").alias("slot", "row"))
        settled = cut(rows.join(placed, ["block", "slot"]).select("row.*", (F.lit(turn << 56) + F.shiftleft(F.col("block"), 20) + F.col("bin")).alias("sequence_id"), "offset", "stands"))
        done.append(settled.where("stands").drop("stands", "place"))
        left = settled.where("not stands").select(*columns, "place")
        if last:
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


@bounded_batches
def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    vocabulary = os.environ.get("QUERN_WORD_BPE", public_tokenizers.path("word_bpe_49k.json"))
    return pack(token_pieces(docs, vocabulary, end_id=1)).withColumnRenamed("id", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: a row for each piece, with its sequence and offset."""
    return packed(docs)
