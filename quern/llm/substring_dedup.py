"""Substring dedup over a log-structured index of fingerprints.

A window is 50 consecutive words. Of the 33 runs of 18 words in a window, the one with the least hash is its anchor; neighbouring
windows mostly share theirs, and such windows form a segment of the text. Equal windows have equal anchors, wherever they stand, so
that only segments with an anchor that another document has too need a closer look. That makes one row for about 17 words.

The index holds runs: immutable Parquet tables sorted by anchor, with a row for each anchor of a batch of documents: the least and
greatest segment hash and the least and greatest document that have it. A new batch's own run is merge-joined with the older ones.
An anchor that only one document has is done. Where all segments with an anchor are the same, the first document owns all their
windows: such segments rest on two hashes of 64 bits, of the anchor and of the segment. Else the windows themselves are compared:
those of the batch and, read again from the texts, those of the history; a second hash of 64 bits, of another base over words hashed
anew, verifies the first. The batch's run then joins the index, and runs are compacted into one when there are more than a few.

Documents are read again where that spares a shuffle of texts or hashes; a bit filter of fixed size says which anchors matter there,
and exact joins follow it. Counts and owners are grouped minima, summed before the shuffle, so that a passage in a third of all
documents costs a row a task; they are written before rows meet them, in joins that Spark can split where a window is hot. Of the texts
only those that may lose words are shuffled.

Defined cases: a null text has no words; fewer than 50 words make no window; rows with a null id neither own nor lose windows; rows
that repeat an id count as one document, whose windows don't remove one another, and each loses only what it has itself; a window that
a document has several times goes each time, or never in its first document; texts of any length are read whole; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Out, Rolling, bit_filter, cut, filesystem, passes, rows, shared_folder, table, word_hashes, words_of

WINDOW = 50
ANCHOR = 18
#: Runs in an index before they are compacted.
RUNS = 3

_seen = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("doc", pa.int64())])
_found = pa.schema([("whole", pa.bool_()), ("key", pa.int64()), ("check", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
_first, _second = Rolling(), Rolling(0xD1342543DE82EF95)


class Segments:
    """The segments of a text: arrays of anchor hash, segment hash, first window and number of windows; windows() hashes them."""

    def __init__(self, text: bytes | None, window: int, anchor: int):
        words = words_of(text)
        self.n, self.window = max(0, len(words) - window + 1), window
        if not self.n:
            return
        self.words, self.sums = words, _first.sums(word_hashes(words))
        grams = _first.runs(self.sums, anchor)
        width = window - anchor + 1
        # A view of each window's runs, without the checks of sliding_window_view, which take longer than a short text.
        at = np.ndarray((self.n, width), np.uint64, grams, 0, (8, 8)).argmin(1)
        at += np.arange(self.n)
        edges = np.flatnonzero(at[1:] != at[:-1]) + 1
        bounds = np.zeros(len(edges) + 2, np.int64)
        bounds[1:-1], bounds[-1] = edges, self.n
        self.start, self.count = bounds[:-1], bounds[1:] - bounds[:-1]
        self.anchor = grams[at[self.start]]
        self.segment = _first.spans(self.sums, self.start, bounds[1:] + (window - 1))

    def windows(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes and the place of each window of the wanted segments; a word is hashed anew once, whatever the number of windows that hold it."""
        start, end = self.start[wanted], self.start[wanted] + self.count[wanted]
        last = end + self.window - 1
        apart = np.flatnonzero(start[1:] > last[:-1])
        again = np.zeros(len(self.words), np.uint64)
        for low, high in zip(start[np.concatenate(([0], apart + 1))].tolist(), last[np.concatenate((apart, [len(last) - 1]))].tolist(), strict=True):
            again[low:high] = np.fromiter(map(xxhash.xxh64_intdigest, self.words[low:high], repeat(7)), np.uint64, high - low)
        at = np.repeat(start - np.concatenate(([0], np.cumsum(end - start)[:-1])), end - start) + np.arange(int((end - start).sum()))
        sums = _second.sums(again)
        return _first.spans(self.sums, at, at + self.window), _second.spans(sums, at, at + self.window), at


def _scan(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(_seen)
        for doc, text in rows(batches, "doc", "text"):
            if (s := Segments(text, window, anchor)).n:
                order = np.lexsort((s.segment, s.anchor))
                a, b = s.anchor[order], s.segment[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                n = int(new.sum())
                out.add(a[new], b[new], np.full(n, doc, np.int64))
            if out.full():
                yield out.take()
        if out.n:
            yield out.take()

    return run


def _expand(window: int, anchor: int, uniform, mixed):
    """Of segments whose anchor passes the filter of uniform anchors a row, of those that pass the one of mixed anchors a row for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(_found)
        for doc, row, text in rows(batches, "doc", "row", "text"):
            s = Segments(text, window, anchor)
            if not s.n:
                continue
            if uniform is not None and len(k := np.flatnonzero(passes(uniform.value, s.anchor))):
                out.add(np.ones(len(k), bool), s.anchor[k], s.segment[k], np.full(len(k), doc, np.int64), np.full(len(k), row, np.int64), s.start[k].astype(np.int32), s.count[k].astype(np.int32))
            if len(k := np.flatnonzero(passes(mixed.value, s.anchor))):
                key, check, at = s.windows(k)
                n = len(at)
                out.add(np.zeros(n, bool), key, check, np.full(n, doc, np.int64), np.full(n, row, np.int64), at.astype(np.int32), np.ones(n, np.int32))
            if out.full():
                yield out.take()
        if out.n:
            yield out.take()

    return run


def _merged() -> list:
    return [F.min("seg_min").alias("seg_min"), F.max("seg_max").alias("seg_max"), F.min("doc_min").alias("doc_min"), F.max("doc_max").alias("doc_max")]


class FingerprintIndex:
    """Runs of anchors in a folder, and the names of the live ones in runs.json. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, window: int = WINDOW, anchor: int = ANCHOR, most_runs: int = RUNS):
        self.spark, self.folder, self.window, self.anchor, self.most_runs = spark, folder, window, anchor, most_runs
        self.runs: list[str] = []
        self.made = 0
        where, path = filesystem(f"{folder}/runs.json")
        if where.get_file_info(path).is_file:
            with where.open_input_stream(path) as f:
                state = json.loads(f.read())
            self.runs, self.made = state["runs"], state["made"]

    def _publish(self) -> None:
        where, path = filesystem(f"{self.folder}/runs.json")
        where.create_dir(path.rpartition("/")[0], recursive=True)
        with where.open_output_stream(f"{path}.new") as f:
            f.write(json.dumps({"runs": self.runs, "made": self.made}).encode())
        where.move(f"{path}.new", path)

    def _run(self, df: DataFrame) -> str:
        name = f"run-{self.made:06d}"
        self.made += 1
        df.repartition("anchor").sortWithinPartitions("anchor").write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return name

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema("anchor long, seg_min long, seg_max long, doc_min long, doc_max long").parquet(f"{self.folder}/{name}")

    def _compact(self) -> None:
        """Merges all runs into one, row by row of equal anchors."""
        merged = reduce(DataFrame.union, [self._read(x) for x in self.runs]).groupBy("anchor").agg(*_merged())
        self.runs = [self._run(merged)]
        self._publish()

    def add(self, batch: DataFrame, history: DataFrame | None) -> DataFrame:
        """Adds a batch (doc long, row long, text binary) and returns its removed spans (doc, row, start, n) of windows; row tells apart the texts of an id.

        history has the documents of earlier batches: their windows are read again where anchors have more than one context. Ids of
        a batch are greater than those in history.
        """
        sc = self.spark.sparkContext
        seen = batch.select("doc", "text").mapInArrow(_scan(self.window, self.anchor), "anchor long, segment long, doc long")
        own = self._run(seen.groupBy("anchor").agg(F.min("segment").alias("seg_min"), F.max("segment").alias("seg_max"), F.min("doc").alias("doc_min"), F.max("doc").alias("doc_max")))
        stats = self._read(own)
        for name in self.runs:
            old = self._read(name).toDF("anchor", *(f"old_{x}" for x in ("seg_min", "seg_max", "doc_min", "doc_max")))
            stats = stats.hint("merge").join(old, "anchor", "left").select(
                "anchor", F.least("seg_min", "old_seg_min").alias("seg_min"), F.greatest("seg_max", "old_seg_max").alias("seg_max"), F.least("doc_min", "old_doc_min").alias("doc_min"), F.greatest("doc_max", "old_doc_max").alias("doc_max")
            )
        shared = cut(stats.where("doc_min < doc_max").select("anchor", F.col("doc_min").alias("owner"), (F.col("seg_min") != F.col("seg_max")).alias("mixed")))
        uniform, mixed = sc.broadcast(bit_filter(shared.where("not mixed"), "anchor")), sc.broadcast(bit_filter(shared.where("mixed"), "anchor"))
        schema = "whole boolean, key long, check long, doc long, row long, start int, n int"
        mine = cut(batch.mapInArrow(_expand(self.window, self.anchor, uniform, mixed), schema))
        whole = mine.where("whole").join(shared.where("not mixed").select(F.col("anchor").alias("key"), "owner").hint("merge"), "key").where("owner < doc")
        windows = mine.where("not whole").select("key", "check", "doc")
        if history is not None:
            older = history.mapInArrow(_expand(self.window, self.anchor, None, mixed), schema).select("key", "check", "doc")
            windows = windows.union(older)
        owners = cut(windows.groupBy("key", "check").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).where("owner < last").drop("last"))
        single = mine.where("not whole").join(owners.hint("merge"), ["key", "check"]).where("owner < doc")
        self.runs.append(own)
        self._publish()
        if len(self.runs) > self.most_runs:
            self._compact()
        return whole.select("doc", "row", "start", "n").union(single.select("doc", "row", "start", "n"))


def removed_spans(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, folder: str | None = None) -> DataFrame:
    """Removed windows (doc, row, start, n windows from start) of documents that come to an index in batches of ascending ids."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("binary")
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))
    index = FingerprintIndex(spark, folder or shared_folder(spark), window, anchor)
    cuts = base.agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    bounds = sorted(set(cuts or []))
    found, low = [], None
    for high in [*bounds, None]:
        batch, history = base, None
        if low is not None:
            batch, history = batch.where(F.col("doc") > low), base.where(F.col("doc") <= low)
        if high is not None:
            batch = batch.where(F.col("doc") <= high)
        found.append(index.add(batch, history))
        low = high
    return reduce(DataFrame.union, found)


def _apply(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = words_of(text)
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.array([(x["start"], x["n"]) for x in spans], np.int64)
                    np.add.at(edge, np.minimum(at[:, 0], len(words)), 1)
                    np.add.at(edge, np.minimum(at[:, 0] + at[:, 1] + window - 1, len(words)), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    stay = [w for w, x in zip(words, gone, strict=True) if not x]
                else:
                    stay = words
                kept.append(b" ".join(stay).decode())
                n_words.append(len(words))
                n_removed.append(len(words) - len(stay))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["id", "kept_text", "n_words", "n_removed"])

    return run


def substring_dedup(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Returns id, kept_text (the words that stay, joined by one space), n_words and n_removed for each document."""
    found = removed_spans(docs, batches, id_col, text_col, window, anchor)
    spans = cut(found.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "n")).alias("spans")))
    text = F.col(text_col).cast("binary")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    losing = docs.sparkSession.sparkContext.broadcast(bit_filter(spans, "row"))
    # Texts that surely lose nothing are not shuffled; a few others may pass the filter and meet no spans.
    whole = base.mapInArrow(_passing(losing, False), base.schema).select("id", "text", F.lit(None).cast("array<struct<start:int,n:int>>").alias("spans"))
    some = base.mapInArrow(_passing(losing, True), base.schema).alias("b")
    joined = some.join(spans.alias("s"), (F.col("id") == F.col("doc")) & (F.col("b.row") == F.col("s.row")), "left").select("id", "text", "spans")
    applied = whole.union(joined).mapInArrow(_apply(window), "id long, kept_text string, n_words long, n_removed long")
    return applied.withColumnRenamed("id", id_col)


def _passing(wanted, inside: bool):
    """The rows whose text may be wanted, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(wanted.value, batch.column("row").to_numpy()) == inside))

    return run


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
p as (select doc_id, words, unnest(range(1, len(words) - 48)) as pos from t where len(words) >= 50),
w as (select doc_id, pos, md5(array_to_string(words[pos:pos + 49], ' ')) as body from p),
o as (select doc_id, pos, min(doc_id) over (partition by body) as owner from w),
gone as (select distinct doc_id, pos + k as pos from (select doc_id, pos, unnest(range(0, 50)) as k from o where owner < doc_id)),
lost as (select doc_id, list(pos) as gone from gone group by doc_id)
select t.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
       sha256(coalesce(array_to_string(case when gone is null then words else list_filter(words, lambda x, i: not list_contains(gone, i)) end, ' '), '')) as kept_sha256
from t left join lost using (doc_id)
"""
