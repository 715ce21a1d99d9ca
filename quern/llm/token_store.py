"""Token ids in binary shards, with a minimal perfect hash index for keyed access in constant time.

A store is a folder:
  shards/<k>.ids      raw ids, little-endian, 2 bytes an id where the vocabulary fits and else 4, documents in ascending key order
  shards/<k>.lens     the number of ids of each document of the shard, 4 bytes each
  index/<b>.mph       for the keys whose hash falls in bucket b: levels of a minimal perfect hash, then for each slot a fingerprint
                      of the key and where its runs stand, then the runs: shard, offset, first document and number of documents
  manifest            a Parquet table of shards with their first id's position in the whole

Texts are encoded where they are read; only ids are shuffled, 2 bytes each, to shards between quantiles of the keys. A lookup hashes
the key, goes to its bucket's index, follows at most a few levels of bits to a slot, compares the fingerprint and has the shard and
offset. Each task writes a shard under a temporary name and renames it, so that a task that ran twice leaves one file of the same
bytes.

Defined cases: a null text counts as empty and holds only the end id; a null key sorts first and is stored under the key -2**63;
rows that repeat a key are stored each, in the order of their ids' bytes, and a lookup finds them all, once each; a key with more rows
than a shard takes is dealt to several by a hash of the ids; texts of any length are encoded whole, a document's ids in one piece; an
empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import Out, cut, filesystem, mix, rows, shared_folder, small_batches, table, trimming
from quern.llm.tokenizing import Encoder

#: Mean number of keys in a bucket of the index: a bucket's index is about 6 MB.
BUCKET_KEYS = 200_000
NULL_KEY = -(2**63)
_LEVEL_SEED = np.uint64(0xA0761D6478BD642F)

#: Quantiles of keys are off by this part of all rows at most, over the number of shards.
ACCURACY = 20

_encoded = pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("ids", pa.binary())])
_run = pa.schema([("key", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()), ("first", pa.int64()), ("documents", pa.int64()), ("n", pa.int64())])
_record = pa.schema([("key", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()), ("n", pa.int64())])
_slots = np.dtype([("fingerprint", "<u4"), ("runs", "<u4"), ("at", "<i8")])
_runs = np.dtype([("shard", "<i4"), ("offset", "<i8"), ("first", "<i8"), ("documents", "<i8"), ("n", "<i8")])


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit hashes: at each level, the hashes that fall alone on a bit have it set and leave."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # of bool
        self.before = np.concatenate(([0], np.cumsum([int(x.sum()) for x in levels])))[:-1].astype(np.int64)
        self.ranks = [np.cumsum(x) - 1 for x in levels]

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        left, levels = np.asarray(hashes, np.uint64), []
        while len(left):
            size = max(64, 2 * len(left))
            at = cls._place(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
            if len(levels) > 64:
                raise ValueError("keys are not distinct")
        return cls(levels)

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes ^ mix(np.full(1, _LEVEL_SEED) + np.uint64(level))) % np.uint64(size)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 where it surely is no key."""
        hashes = np.asarray(hashes, np.uint64)
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for k, level in enumerate(self.levels):
            at = self._place(hashes[open_], k, len(level))
            hit = level[at]
            out[open_[hit]] = self.before[k] + self.ranks[k][at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<i8").tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, data: bytes) -> tuple[PerfectHash, int]:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<i8", n, 8), 8 * (n + 1), []
        for size in map(int, sizes):
            nbytes = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, nbytes, at), count=size).astype(bool))
            at += nbytes
        return cls(levels), at


def key_hash(keys: np.ndarray) -> np.ndarray:
    return mix(np.asarray(keys, np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype("<u4")


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _commit(where, path: str, data_path: str) -> None:
    where.move(data_path, path)


def _encode(vocabulary: str, end_id: int, width: int, bounds: np.ndarray):
    """shard, key and ids of each row. Shards lie between bounds; the rows of a key that several bounds equal are dealt among their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, ids = batch.column("key").to_numpy(), [x + end for x in encoder.encode(batch.column("text").to_pylist())]
            low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
            for k in np.flatnonzero(high > low):
                low[k] += zlib.crc32(ids[k]) % (high[k] - low[k] + 1)
            if width == 2:
                ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(low.astype(np.int32)), pa.array(keys), pa.array(ids, pa.binary())], schema=_encoded)
        Encoder.forget()

    return trimming(run)


class _Shard:
    """A shard's two files, which have their final names only when they are whole, and its runs of equal keys."""

    def __init__(self, where, folder: str, shard: int):
        self.where, self.folder, self.shard = where, folder, shard
        self.temporary = f"{folder}/.{shard}-{uuid.uuid4().hex}"
        self.f, self.lens = where.open_output_stream(self.temporary), where.open_output_stream(f"{self.temporary}.lens")
        self.at = self.documents = 0
        self.run: np.ndarray | None = None

    def add(self, keys: np.ndarray, ids: list[bytes], width: int, out: Out) -> None:
        n = np.fromiter((len(x) // width for x in ids), np.int64, len(ids))
        self.f.write(b"".join(ids))
        self.lens.write(n.astype("<u4").tobytes())
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        documents, total = np.diff(np.concatenate((first, [len(keys)]))), np.add.reduceat(n, first)
        offset = self.at + (np.cumsum(n) - n)[first]
        runs = np.stack((keys[first], np.full(len(first), self.shard), offset, self.documents + first, documents, total), axis=1)
        if self.run is not None and self.run[0] == keys[0]:  # goes on from the batch before
            runs[0] = [*self.run[:4], *(self.run[4:] + runs[0, 4:])]
        elif self.run is not None:
            self.close_run(out)
        if len(runs) > 1:
            out.add(*runs[:-1].T)
        self.run = runs[-1].copy()
        self.at += int(n.sum())
        self.documents += len(n)

    def close_run(self, out: Out) -> None:
        out.add(*self.run[:, None])
        self.run = None

    def commit(self, out: Out) -> None:
        self.close_run(out)
        self.f.close()
        self.lens.close()
        self.where.move(f"{self.temporary}.lens", f"{self.folder}/{self.shard}.lens")
        self.where.move(self.temporary, f"{self.folder}/{self.shard}.ids")


def _write_shards(folder: str, width: int):
    """Rows come in the order of shards and keys. A row for each run of equal keys in a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = filesystem(f"{folder}/shards")
        where.create_dir(path, recursive=True)
        out, now = Out(_run), None
        for batch in batches:
            shards, keys, ids = batch.column("shard").to_numpy(), batch.column("key").to_numpy(), batch.column("ids").to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)] if len(shards) else [0]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if now is None or now.shard != shards[i]:
                    if now is not None:
                        now.commit(out)
                    now = _Shard(where, path, int(shards[i]))
                now.add(keys[i:j], ids[i:j], width, out)
            if out.full():
                yield out.take()
        if now is not None:
            now.commit(out)
        if out.n:
            yield out.take()

    return trimming(run)


def _write_index(folder: str, buckets: int):
    def run(key: tuple, found: pa.Table) -> pa.Table:
        bucket = int(key[0].as_py())
        found = found.sort_by([("key", "ascending"), ("shard", "ascending")])
        keys = found["key"].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        hashes = key_hash(keys[first])
        mph = PerfectHash.build(hashes)
        slots, runs = np.zeros(len(first), _slots), np.zeros(len(keys), _runs)
        at = mph.slots(hashes)
        slots["fingerprint"][at], slots["at"][at], slots["runs"][at] = _fingerprint(hashes), first, np.diff(np.concatenate((first, [len(keys)])))
        for name in _runs.names:
            runs[name] = found[name].to_numpy()
        where, path = filesystem(f"{folder}/index")
        where.create_dir(path, recursive=True)
        with where.open_output_stream(temporary := f"{path}/.{bucket}-{uuid.uuid4().hex}") as f:
            head = mph.dump()
            f.write(np.array([len(head), len(slots), len(runs)], "<i8").tobytes() + head + slots.tobytes() + runs.tobytes())
        _commit(where, f"{path}/{bucket}.mph", temporary)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "keys": pa.array([len(first)], pa.int64())})

    return run


def _preimages(spark: SparkSession, parts: int) -> list[int]:
    """For each partition a number that hash partitioning deals there, so that shards and tasks are one to one."""
    found = spark.range(parts * 16).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p"), "id").groupBy("p").agg(F.min("id").alias("id")).collect()  # parts rows
    at = {r["p"]: r["id"] for r in found}
    return [at.get(k, k) for k in range(parts)]


class TokenStore:
    """A store in a folder; Spark jobs read it through scan(), single keys through get()."""

    def __init__(self, folder: str, width: int, buckets: int, manifest: DataFrame):
        self.folder, self.width, self.buckets, self.manifest = folder, width, buckets, manifest
        self._index: dict[int, tuple[PerfectHash, np.ndarray, np.ndarray]] = {}

    @classmethod
    def write(cls, docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> TokenStore:
        spark = docs.sparkSession
        width = 2 if max(Encoder.of(vocabulary).size, end_id + 1) <= 1 << 16 else 4
        keyed = docs.select(F.coalesce(F.col(id_col), F.lit(NULL_KEY)).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        found = keyed.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)], ACCURACY * parts)).first()[0] if parts > 1 else []
        bounds = np.array(found or [], np.int64)
        dealt = F.element_at(F.array(*map(F.lit, _preimages(spark, parts))), F.col("shard") + 1).cast("int")
        with small_batches(spark):
            encoded = keyed.mapInArrow(_encode(vocabulary, end_id, width, bounds), "shard int, key long, ids binary")
            ordered = encoded.repartition(parts, dealt).sortWithinPartitions("shard", "key", "ids")
            written = cut(ordered.mapInArrow(_write_shards(folder, width), "key long, shard int, offset long, first long, documents long, n long"))
        shards = written.groupBy("shard").agg(F.sum("n").alias("ids"), F.sum("documents").alias("documents"), F.min("key").alias("first_key"))
        # One row a shard: the window sees as many rows as there are shards.
        manifest = cut(shards.withColumn("start", F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))).fillna(0, ["start"]), f"{folder}/manifest")
        total = written.count()
        buckets = max(1, -(-total // BUCKET_KEYS))
        bucketed = written.mapInArrow(_with_bucket(buckets), f"bucket int, {', '.join(f'{c} {t}' for c, t in written.dtypes)}")
        indexed = bucketed.groupBy("bucket").applyInArrow(_write_index(folder, buckets), "bucket int, keys long")
        cut(indexed, f"{folder}/buckets")
        return cls(folder, width, buckets, manifest)

    def _load(self, bucket: int) -> tuple[PerfectHash, np.ndarray, np.ndarray]:
        if bucket not in self._index:
            where, path = filesystem(f"{self.folder}/index/{bucket}.mph")
            with where.open_input_stream(path) as f:
                data = f.read()
            size, n, runs = map(int, np.frombuffer(data, "<i8", 3))
            mph, _ = PerfectHash.load(data[24 : 24 + size])
            if len(self._index) >= 8:
                self._index.clear()
            self._index[bucket] = mph, np.frombuffer(data, _slots, n, 24 + size), np.frombuffer(data, _runs, runs, 24 + size + n * _slots.itemsize)
        return self._index[bucket]

    def locate(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of all keys, and whose each is (a place in keys); none where the fingerprint doesn't match."""
        hashes = key_hash(keys)
        found, whose = [np.zeros(0, _runs)], [np.zeros(0, np.int64)]
        for bucket in np.unique(b := _bucket(hashes, self.buckets)):
            mine = np.flatnonzero(b == bucket)
            mph, slots, runs = self._load(int(bucket))
            at = mph.slots(hashes[mine])
            entry = slots[np.maximum(at, 0)]
            good = (at >= 0) & (entry["fingerprint"] == _fingerprint(hashes[mine]))
            many = entry["runs"][good].astype(np.int64)
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found.append(runs[np.repeat(entry["at"][good], many) + within])
            whose.append(np.repeat(mine[good], many))
        return np.concatenate(found), np.concatenate(whose)

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of each document with this key."""
        runs, _ = self.locate(np.array([NULL_KEY if key is None else key], np.int64))
        shards = _Shards(self.folder, self.width)
        return [np.frombuffer(x, "<u4") for r in runs for _, _, x in shards.documents(*r.tolist())]

    def scan(self, keys: DataFrame, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
        """For each document of each key in keys: its shard, offset and ids (little-endian, 4 bytes), or their CRC-32, read from the files.

        Keys are dealt by bucket, so that a task loads few indexes, and what they locate by shard and in order of offsets, so that a
        task reads a shard from front to back.
        """
        folder, width, buckets = self.folder, self.width, self.buckets
        wanted = keys.select(F.coalesce(F.col(id_col), F.lit(NULL_KEY)).cast("long").alias("key"))
        placed = wanted.mapInArrow(_with_bucket(buckets), "bucket int, key long").groupBy("bucket", "key").agg(F.lit(1)).select("bucket", "key")
        found = placed.mapInArrow(_locate(folder, width, buckets), "key long, shard int, offset long, first long, documents long, n long")
        read = "ids_crc32 long" if digest else "ids binary"
        return found.repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(_read(folder, width, digest), f"key long, shard int, offset long, n long, {read}")


def _with_bucket(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _bucket(key_hash(batch.column("key").to_numpy()), buckets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(b), *batch.columns], names=["bucket", *batch.schema.names])

    return run


def _locate(folder: str, width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = TokenStore(folder, width, buckets, None)
        for batch in batches:
            keys = batch.column("key").to_numpy()
            runs, whose = store.locate(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys[whose]), *(pa.array(runs[c]) for c in _runs.names)], schema=_run)

    return run


class _Shards:
    """Documents of runs; the files of the last shard stay open."""

    def __init__(self, folder: str, width: int):
        self.where, self.path = filesystem(f"{folder}/shards")
        self.width, self.now, self.f, self.lens = width, None, None, None

    def documents(self, shard: int, offset: int, first: int, documents: int, n: int, block: int = 10_000) -> Iterator[tuple[int, int, bytes]]:
        """Offset, number of ids and ids (4 bytes each) of each document of a run."""
        if shard != self.now:
            self.now, self.f, self.lens = shard, self.where.open_input_file(f"{self.path}/{shard}.ids"), None
        if documents == 1:
            yield offset, n, self._ids(offset, n)
            return
        if self.lens is None:
            self.lens = self.where.open_input_file(f"{self.path}/{shard}.lens")
        for k in range(0, documents, block):
            for m in np.frombuffer(self.lens.read_at(4 * min(block, documents - k), 4 * (first + k)), "<u4").tolist():
                yield offset, m, self._ids(offset, m)
                offset += m

    def _ids(self, offset: int, n: int) -> bytes:
        data = self.f.read_at(n * self.width, offset * self.width)
        return data if self.width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def _read(folder: str, width: int, digest: bool):
    schema = _record.append(pa.field("ids_crc32", pa.int64()) if digest else pa.field("ids", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, out, size = _Shards(folder, width), Out(schema), 0
        for key, *where in rows(batches, *_run.names):
            for offset, n, ids in shards.documents(*where):
                out.add([key], [where[0]], [offset], [n], [zlib.crc32(ids) if digest else ids])
                size += 0 if digest else len(ids)
                if size > 8_000_000 or out.full():
                    yield out.take()
                    size = 0
        if out.n:
            yield out.take()

    return run


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = os.environ.get("QUERN_BYTE_BPE", public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = TokenStore.write(docs, shared_folder(spark), vocabulary, end_id=0)
    read = store.scan(docs, digest=True)
    return read.join(F.broadcast(store.manifest.select("shard", "start")), "shard").select(
        F.when(F.col("key") != NULL_KEY, F.col("key")).alias("doc_id"), (F.col("start") + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32"
    )
