"""What the operators of this subpackage share: files, hashing, a bit filter of fixed size."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.iterate import components, cut, shared_folder, tidied  # noqa: F401

# The system's allocator gives memory of Arrow batches back; others keep it in each worker.
pa.set_memory_pool(pa.system_memory_pool())

#: Bits of a bit filter: 8 MB, whatever the input.
FILTER_BITS = 1 << 26
#: Ids that are broadcast at most, 8 bytes each.
BROADCAST_IDS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Within, Arrow batches for Python hold so many bytes at most: less memory for rows with large values."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trimming(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over a partition's batches that gives a worker's freed memory back to the system at the partition's end, where the C library can."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return trimmed


def bounded_batches(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Runs what f(df, ...) executes in small batches; what it returns is executed later, in the session's own."""

    @wraps(f)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        with small_batches(df.sparkSession):
            return f(df, *args, **kwargs)

    return run


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id isn't among ids (one column). A row with a null id can't be told from others like it, and stays.

    A list of ids of a checked size is broadcast, which spares the texts a shuffle; a longer one is joined.
    """
    keys = cut(ids.toDF("__quern_key").where("__quern_key is not null").distinct())
    few = keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(keys) if few else keys.hint("merge"), F.col(id_col) == F.col("__quern_key"), "left_anti")


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The pyarrow file system of a URI and the path there; usable on the driver and on executors."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def delete(uri: str) -> None:
    where, path = filesystem(uri)
    if where.get_file_info(path).type == fs.FileType.Directory:
        where.delete_dir(path)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on uint64."""
    x = np.asarray(x, np.uint64)
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(text: bytes | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text in UTF-8: bytes.split() parts at exactly those six bytes."""
    return text.split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Rolling:
    """Hashes of all runs of k words of a text from one cumulative sum, modulo 2**64."""

    _base = 0x9E3779B97F4A7C15 | 1

    def __init__(self, base: int = _base):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(1024, 2 * n)
            powers = lambda b: np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, np.uint64(b)))))
            self.up, self.down = powers(self.base), powers(self.inverse)

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        self._grow(len(hashes))
        out = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[: len(hashes)], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Of the runs of k words, in order."""
        n = len(sums) - k
        return mix((sums[k:] - sums[:n]) * self.down[:n] + np.uint64(k))

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the words from start to end, each."""
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def bit_filter(df: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of a fixed size for the hashes in a column, built by a distributed bit_or.

    What comes to the driver is at most bits / 64 words, however many rows df has. A filter may let others pass, never fewer:
    with more hashes than bits it lets nearly all pass, and what uses it then does more work with the same result.
    """
    slot = F.col(column).bitwiseAND(bits - 1)
    words = (
        df.where(F.col(column).isNotNull())
        .select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bit"].to_numpy()
    return out.view(np.uint64)


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = np.asarray(hashes).view(np.uint64) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def summed(df: DataFrame, key: str, values: str, load: Callable[[bytes], np.ndarray], dump: Callable[[np.ndarray], bytes]) -> DataFrame:
    """key and the sum of the arrays in values, of a fixed number of keys. Rows of a key stream through one task, which holds its sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for k, data in rows(batches, key, values):
            part = load(data)
            total[k] = total[k] + part if k in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(map(dump, total.values())), pa.binary())], names=[key, values])

    dealt = df.select(F.col(key).cast("int").alias(key), values).repartition(key)
    return dealt.mapInArrow(trimming(run), f"{key} int, {values} binary")


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


class Out:
    """Gathers columns of numpy arrays or lists and gives Arrow batches of a bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = 100_000):
        self.schema, self.limit = schema, limit
        self.parts: list[list] = [[] for _ in schema]
        self.n = 0

    def add(self, *columns) -> None:
        for part, column in zip(self.parts, columns, strict=True):
            part.append(column)
        self.n += len(columns[0])

    def full(self) -> bool:
        return self.n >= self.limit

    def take(self) -> pa.RecordBatch:
        arrays = []
        for part, field in zip(self.parts, self.schema, strict=True):
            if pa.types.is_integer(field.type) or pa.types.is_floating(field.type) or part and pa.types.is_boolean(field.type):
                data = np.concatenate([np.asarray(x) for x in part]) if part else np.zeros(0)
                arrays.append(pa.array(data.view(np.int64) if data.dtype == np.uint64 else data).cast(field.type))
            else:
                arrays.append(pa.array([x for xs in part for x in xs], field.type))
        self.parts, self.n = [[] for _ in self.schema], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)
