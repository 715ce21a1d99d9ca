"""A deterministic sharded WARC writer, and its reader.

Payload digests are grouped first: the record with the smallest key of each payload is a response, the others are revisits that refer
to it. Then records go to range partitions by key; payloads are shuffled once, beside the narrow rows that say which record is which.
A task writes gzip members in key order and starts a new file when the compressed size reaches roll_bytes; it writes each file under
a temporary name, renames it, and names its files, sizes and digests in a manifest row. Headers (length, digests, ids) are made from
the payload; nothing depends on the time or on the task's attempt, so that a task that ran twice leaves the same files.

Defined cases: a null payload counts as empty; a null url is written as urn:page:<key>; a null key sorts first and is written as
"null"; of rows that repeat a key with equal payloads one is the response, the others revisit it; of rows that repeat a key with
other payloads each is a record of its own; ties in the smallest key are such rows; payloads of any length are written whole; an empty
table gives no files; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Out, cut, filesystem, rows, shared_folder, table

#: Compressed bytes after which a file is full.
ROLL_BYTES = 64_000_000
#: A fixed date: the tables have none.
DATE = "2000-01-01T00:00:00Z"

_manifest = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])
_record = pa.schema([("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string())])
_null = "null"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(key: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{_null if key is None else key}')}>"


def record(key: int | None, url: str | None, payload: bytes, refers: bool, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the full payload's digest and length and no body."""
    digest, body = digest_of(payload), b"" if refers else payload
    text = _null if key is None else str(key)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_uri(key)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {''.join((url or '').split()) or 'urn:page:' + text}", f"X-Page-Key: {text}", f"X-Payload-Length: {len(payload)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(body)}"]
    if refers:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}", f"X-Refers-To-Key: {_null if refers_to is None else refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class _File:
    """A file that has its final name only when it is whole."""

    def __init__(self, where, folder: str, part: int, number: int):
        self.where, self.folder, self.part, self.number = where, folder, part, number
        self.temporary = f"{folder}/.{part:05d}-{number:05d}-{uuid.uuid4().hex}"
        self.f, self.bytes, self.records, self.sha1 = where.open_output_stream(self.temporary), 0, 0, hashlib.sha1()

    def add(self, data: bytes) -> None:
        self.f.write(data)
        self.sha1.update(data)
        self.bytes, self.records = self.bytes + len(data), self.records + 1

    def commit(self) -> tuple:
        self.f.close()
        name = f"part-{self.part:05d}-{self.number:05d}.warc.gz"
        self.where.move(self.temporary, f"{self.folder}/{name}")
        return self.part, self.number, name, self.records, self.bytes, self.sha1.hexdigest()


def _write(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, path = filesystem(folder)
        where.create_dir(path, recursive=True)
        part, file, done, page = TaskContext.get().partitionId(), None, [], None
        for key, payload_row, url, payload, refers, refers_to in rows(batches, "key", "payload_row", "url", "payload", "refers", "refers_to"):
            if not payload_row:  # the narrow row comes before its payload
                page = refers, refers_to
                continue
            if file is not None and file.bytes >= roll_bytes:
                done.append(file.commit())
                file = None
            if file is None:
                file = _File(where, path, part, len(done))
            file.add(gzip.compress(record(key, url, payload, *page), 6, mtime=0))
        if file is not None:
            done.append(file.commit())
        yield pa.RecordBatch.from_pylist([dict(zip(_manifest.names, x, strict=True)) for x in done], schema=_manifest)

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes archives to folder and returns their manifest. Payloads of at least `least` bytes that are equal become revisits.

    Rows that repeat a key are told apart by their digest and url; of fully equal rows any is the response.
    """
    base = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    spark = pages.sparkSession
    narrow = cut(base.select("key", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").alias("n")))
    known = narrow.where(F.col("n") >= least)
    # Written first: a join of two plain shuffles is one that Spark can split where a digest is hot.
    first = cut(known.groupBy("digest").agg(F.min(F.struct(F.col("key").isNotNull(), "key")).alias("first")).select("digest", F.col("first.key").alias("first")))
    # Rows that repeat both key and digest follow one another; the first of those is the response. Their count is summed, not windowed.
    repeated = known.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("copies")).join(first.hint("merge"), "digest")
    told = repeated.select("key", "digest", "first", F.explode(F.expr("sequence(1L, copies)")).alias("nth"))
    told = told.select("key", "digest", (~(F.col("key").eqNullSafe(F.col("first")) & (F.col("nth") == 1))).alias("refers"), F.col("first").alias("refers_to"), "nth")
    small = narrow.where(F.col("n") < least).select("key", "digest", F.lit(False).alias("refers"), F.lit(None).cast("long").alias("refers_to"), F.lit(1).cast("long").alias("nth"))
    kinds = told.unionByName(small).select("key", "digest", F.lit(False).alias("payload_row"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers", "refers_to")
    whole = base.select("key", F.unhex(F.sha1("payload")).alias("digest"), F.lit(True).alias("payload_row"), "url", "payload", F.lit(None).cast("boolean").alias("refers"), F.lit(None).cast("long").alias("refers_to"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = kinds.unionByName(whole).repartitionByRange(parts, F.col("key").asc_nulls_first(), "digest").sortWithinPartitions(F.col("key").asc_nulls_first(), "digest", "payload_row", "refers", "url")
    # Of rows that repeat key and digest, all narrow rows come first; _paired puts each beside a payload.
    return cut(ordered.mapInArrow(_paired, ordered.schema).mapInArrow(_write(folder, roll_bytes), "part int, number int, file string, records long, bytes long, sha1 string"), f"{folder}/manifest")


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts each narrow row just before its payload, within rows of one key and digest. Only repeated rows are held, without payloads."""
    kinds: list[dict] = []
    now, k = None, 0
    for batch in batches:
        schema, out = batch.schema, []
        for row in batch.to_pylist():
            if (row["key"], row["digest"]) != now:
                now, kinds, k = (row["key"], row["digest"]), [], 0
            if not row["payload_row"]:
                kinds.append(row)
            else:
                out += [kinds[min(k, len(kinds) - 1)], row]
                k += 1
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def parse(data: io.BufferedIOBase | pa.NativeFile) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record of a .warc.gz, one gzip member at a time."""
    unpack, pending, whole = zlib.decompressobj(31), b"", b""
    while True:
        chunk = pending or data.read(1 << 20)
        if not chunk:
            break
        whole += unpack.decompress(chunk)
        pending = unpack.unused_data if unpack.eof else b""
        if unpack.eof:
            head, _, rest = whole.partition(b"\r\n\r\n")
            headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield headers, rest[: int(headers["Content-Length"])]
            unpack, whole = zlib.decompressobj(31), b""
    if whole:
        raise ValueError("an archive ends within a record")


def _read(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = filesystem(folder)
        key = lambda x: None if x is None or x == _null else int(x)
        for (file,) in rows(batches, "file"):
            out, size = Out(_record), 0
            with where.open_input_stream(f"{path}/{file}", compression=None) as f:
                for h, body in parse(f):
                    if h["WARC-Block-Digest"] != f"sha1:{digest_of(body)}":
                        raise ValueError(f"{file}: a block's digest differs")
                    out.add([key(h["X-Page-Key"])], [h["WARC-Target-URI"]], [h["WARC-Type"]], [key(h.get("X-Refers-To-Key"))], [int(h["X-Payload-Length"])], [h["WARC-Payload-Digest"].removeprefix("sha1:")], [body if with_payload else None], [file])
                    size += len(body) * with_payload
                    if size > 8_000_000 or out.full():
                        yield _batch(out)
                        size = 0
            if out.n:
                yield _batch(out)

    return run


def _batch(out: Out) -> pa.RecordBatch:
    columns = [pa.array([x for xs in part for x in xs], f.type) for part, f in zip(out.parts, _record, strict=True)]
    out.parts, out.n = [[] for _ in _record], 0
    return pa.RecordBatch.from_arrays(columns, schema=_record)


def read_warc(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the files that a manifest names; the blocks' digests are checked."""
    schema = "key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, file string"
    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("file").repartition(parts).mapInArrow(_read(folder, with_payload), schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    manifest = write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(manifest, folder, with_payload=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 from hexadecimal: five hexadecimal digits are four of base 32.
SQL = """
with t as (select page_id, coalesce(html, '') as body, upper(sha1(coalesce(html, ''))) as hex from pages),
u as (select *, min(page_id) over (partition by hex) as first from t)
select page_id, cast(strlen(body) as bigint) as payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(floor(cast('0x' || substr(hex, 1 + 5 * (i // 4), 5) as bigint) / power(32, 3 - i % 4)) as bigint) % 32, 1)), 'string_agg', '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from u
"""
