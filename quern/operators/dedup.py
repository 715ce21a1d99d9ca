"""Near-duplicate pairs of 64-bit hashes, and removal of the poorer of each pair."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.iterate import components, cut

#: Pairs with fewer differing bits are near.
DISTANCE = 8
#: Bands of as many bits each: at most seven differing bits leave one equal. Rows that share a band's value are a cell.
BANDS = 8
#: Rows of a cell that are searched together; a larger cell is parted, and its parts are searched two by two.
MOST_IN_PART = 1 << 19
#: Rows of cells in a partition, about.
ROWS_IN_PARTITION = 100_000
#: Within a cell, by its rows at most: bands of the bits that are left, and how many of them are equal at least.
SCHEMES = ((300, 0, 0), (3_000, 8, 1), (150_000, 9, 2), (float("inf"), 10, 3))
_WIDTH = 64 // BANDS


def _mask(bits) -> int:
    return sum(1 << int(k) for k in bits)


def _search(h: np.ndarray, part: np.ndarray, band: int, across: bool, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Near pairs of a cell's hashes that no earlier band has equal; across: only those of two parts. Each comes once, at its first equal bands.

    Hashes are sorted by some of their bits, and each meets the next, the one after it and so on, for as long as these bits are equal, so that
    no more is held than a few values a row.
    """
    count, equal = next((n, k) for most, n, k in SCHEMES if len(h) <= most)
    rest = [k for k in range(64) if k // _WIDTH != band]
    fine = [_mask(x) for x in np.array_split(rest, count)] if count else []
    earlier = [_mask(range(k * _WIDTH, (k + 1) * _WIDTH)) for k in range(band)]
    for key in combinations(range(count), equal):
        value = h & np.uint64(sum(fine[k] for k in key))
        order = np.argsort(value)
        value, mine, parts = value[order], h[order], part[order]
        unequal = [np.uint64(m) for m in (*earlier, *(fine[k] for k in range(max(key, default=0)) if k not in key))]
        at, step = np.arange(len(h) - 1), 1
        while len(at):
            at = at[at + step < len(h)]
            at = at[value[at] == value[at + step]]
            differ = mine[at] ^ mine[at + step]
            near = np.flatnonzero(np.bitwise_count(differ) < distance)
            for m in unequal:
                near = near[(differ[near] & m) != 0]
            if across:
                near = near[parts[at[near]] != parts[at[near] + step]]
            if len(near):
                yield mine[at[near]], mine[at[near] + step], np.bitwise_count(differ[near])
            step += 1


def _cells(distance: int):
    """Near pairs (x, y, distance) of rows (band, value, low, high, part, h) that are sorted by cell and parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list = []

        def ready(least: int) -> Iterator[pa.RecordBatch]:
            if found and sum(len(x) for x, _, _ in found) >= least:
                x, y, d = (np.concatenate(c) for c in zip(*found, strict=True))
                found.clear()
                for k in range(0, len(x), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)].view(np.int64)), pa.array(y[k : k + (1 << 16)].view(np.int64)), pa.array(d[k : k + (1 << 16)].astype(np.int32))], ["x", "y", "distance"])

        def close(held: list) -> Iterator[pa.RecordBatch]:
            h, part = np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held])
            band, _, low, high = held[0][0]
            for f in _search(h, part, band, low != high, distance):
                found.append(f)
                yield from ready(1 << 16)

        held: list = []
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(6)]
            unit = np.stack(columns[:4])
            edges = [0, *(np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                name = tuple(int(x) for x in unit[:, start])
                if held and held[0][0] != name:
                    yield from close(held)
                    held = []
                held.append((name, columns[5][start:end].view(np.uint64).copy(), columns[4][start:end].copy()))
        if held:
            yield from close(held)
        yield from ready(1)

    return run


def near_pairs(hashes: DataFrame, distance: int = DISTANCE, id_col: str = "id", hash_col: str = "hash") -> DataFrame:
    """Pairs (a, b, distance), a < b, whose hashes differ in fewer than `distance` bits.

    Of eight bands one is equal if at most seven bits differ, so that each hash is dealt to eight cells, and pairs are sought within them. Rows
    with equal hashes are one to begin with, and are paired afterwards. Nothing that grows with the input is broadcast: sizes of tables on disk
    say little of such rows.
    """
    if distance > BANDS:
        raise ValueError("bands find at most seven differing bits")
    distinct = cut(hashes.select(F.col(hash_col).cast("long").alias("h")).where("h is not null").distinct())
    value = [F.shiftrightunsigned("h", k * _WIDTH).bitwiseAND(F.lit((1 << _WIDTH) - 1)).cast("int") for k in range(BANDS)]
    dealt = distinct.select("h", F.posexplode(F.array(*value)).alias("band", "value"))
    sizes = [(r.band, r.value, -(-r["count"] // MOST_IN_PART), r["count"]) for r in dealt.groupBy("band", "value").count().collect()]  # 2,048 at most
    parts = [x[:3] for x in sizes if x[2] > 1]
    if parts:
        dealt = dealt.join(F.broadcast(hashes.sparkSession.createDataFrame(parts, "band int, value int, parts long")), ["band", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("long"))
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("h"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    else:
        dealt = dealt.withColumns({"part": F.lit(0), "other": F.lit(0)})
    dealt = dealt.select("band", "value", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "h")
    unit = ["band", "value", "low", "high"]
    partitions = max(1, sum(p * n for _, _, p, n in sizes) // ROWS_IN_PARTITION)
    pairs = cut(dealt.repartition(partitions, *unit).sortWithinPartitions(*unit).mapInArrow(_cells(distance), "x long, y long, distance int"))
    same = distinct.select(F.col("h").alias("x"), F.col("h").alias("y"), F.lit(0).alias("distance"))
    mirrored = pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "distance")
    ids = hashes.select(F.col(id_col).alias("id"), F.col(hash_col).cast("long").alias("h"))
    left = pairs.union(mirrored).union(same).join(ids.toDF("a", "x").hint("merge"), "x")
    return left.join(ids.toDF("b", "y").hint("merge"), "y").where("a < b").select("a", "b", "distance")


def remove_poorer(items: DataFrame, pairs: DataFrame, id_col: str = "id", ord_col: str = "ord", pixels_col: str = "pixels") -> DataFrame:
    """Items that stay when pairs are gone through in order: if both are still there, the one with fewer pixels goes, the later on a tie.

    A pair with an unreadable item (no pixels) is passed over. Order matters only among items that pairs connect, so that each
    component is gone through on its own.
    """
    pairs = cut(pairs.select("a", "b"))
    groups = components(pairs)
    place = items.select(F.col(id_col).alias("id"), F.col(ord_col).cast("long").alias("ord"), F.col(pixels_col).cast("long").alias("pixels"))
    a, b = place.toDF("a", "oa", "pa"), place.toDF("b", "ob", "pb")
    rows = pairs.join(groups.select(F.col("id").alias("a"), "component").hint("merge"), "a").join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    kind = dict(items.dtypes)[id_col]

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        swap = pdf["oa"] > pdf["ob"]
        pdf.loc[swap, ["a", "oa", "pa", "b", "ob", "pb"]] = pdf.loc[swap, ["b", "ob", "pb", "a", "oa", "pa"]].to_numpy()
        gone: set = set()
        for r in pdf.sort_values(["oa", "ob"]).itertuples():
            if r.a in gone or r.b in gone or pd.isna(r.pa) or pd.isna(r.pb):
                continue
            gone.add(r.a if r.pa < r.pb else r.b)
        return pd.DataFrame({"gone": sorted(gone)})

    gone = rows.groupBy("component").applyInPandas(replay, f"gone {kind}")
    return items.join(gone.hint("merge"), items[id_col] == gone["gone"], "left_anti")
