"""Benchmark decontamination by latent semantic retrieval, with checks of what it finds.

Benchmark items become passages of at most 128 words, in blocks of as many passages as a latent space has dimensions. A task for each
block takes the randomised SVD of its passages' TF-IDF rows; document frequencies are counted over all documents, hashed to slots of
a fixed number. All documents are then read once for a bounded number of blocks: sliding windows of words are projected into each
space, and windows whose cosine with a passage reaches `cosine` are candidates. A passage has windows of about its own length, so that
rarer words around a short one don't dilute it, and WINDOW words besides. A copy that keeps only a passage's common words can have any
cosine; stretches that hold as many of a passage's rarer words as `overlap` leaves no copy without are therefore candidates too. (The part of a window's TF-IDF that lies in a block's
words bounds its cosine from above, so that most windows need no projection.) A candidate stands if the longest common subsequence of
the passage and the words around the window covers enough of the passage, and of its answer: the passage's last quarter.

Defined cases: a null or empty text or item holds no words and matches nothing; rows with a null id can match and carry it; rows that
repeat an id count as one document, repeated items as one item; texts of any length are read whole; empty tables give an empty
result; other columns are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Out, bounded_batches, cut, rows, summed, table, trimming, without_ids

SLOTS = 1 << 17
CHUNKS = 16
PASSAGE = 128
#: Dimensions of a latent space, and passages in a block.
RANK = 256
#: Blocks whose spaces are sent to executors at once, about 5 MB each.
BLOCKS = 6
#: Words in a window; windows start half of that apart. A passage has windows of the least width that holds it, and of WINDOW words.
WINDOW, WIDTHS = 48, (4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)
#: Words that are searched at once, and how far such parts reach into the next; multiples of half of each width.
PART, REACH = 16_320, 384
#: Texts are laid end to end and searched together. Each starts at a multiple of GAP, GAP words or more after the one before, so that
#: its windows are those it has by itself, and none holds words of two.
GAP = 192
COSINE = 0.3
#: Norm of what is left of a passage without its weightiest words.
REST = 0.15
OVERLAP = 0.6
ANSWER = 0.5

_counted = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])
_hit = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("overlap", pa.float64()), ("answer_overlap", pa.float64())])
#: Letters and digits stay, in lower case; all else parts words.
_PLAIN = bytes(k + 32 if 65 <= k <= 90 else k if 97 <= k <= 122 or 48 <= k <= 57 or k >= 128 else 32 for k in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_PLAIN).split() if text else []


def slots_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (SLOTS - 1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, n = np.zeros(SLOTS, np.int64), 0
    for (text,) in rows(batches, "text"):
        counts[np.unique(slots_of(list(set(terms(text)))))] += 1
        n += 1
    width = SLOTS // CHUNKS
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([*range(CHUNKS), CHUNKS], pa.int32()), pa.array([*(counts[c * width : (c + 1) * width].tobytes() for c in range(CHUNKS)), np.array([n]).tobytes()], pa.binary())], schema=_counted)


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + documents with it)) of each slot, over all of texts."""
    counts, n = np.zeros(SLOTS), 0
    found = summed(texts.mapInArrow(_frequencies, "chunk int, counts binary"), "chunk", "counts", lambda x: np.frombuffer(x, np.int64), lambda x: x.tobytes())
    for r in found.toLocalIterator():  # CHUNKS + 1 rows
        values = np.frombuffer(r["counts"], np.int64)
        if r["chunk"] == CHUNKS:
            n = int(values[0])
        else:
            counts[r["chunk"] * (SLOTS // CHUNKS) : (r["chunk"] + 1) * (SLOTS // CHUNKS)] = values
    return np.log((1 + n) / (1 + counts)).astype(np.float32) + np.float32(1e-3)


def randomised_svd(a: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """The leading right singular vectors (columns) of a, by a random range finder with two power iterations."""
    q = min(rank + 16, *a.shape)
    y = a @ np.random.default_rng(seed).normal(size=(a.shape[1], q))
    for _ in range(2):
        y = a @ (a.T @ np.linalg.qr(y)[0])
    _, _, vt = np.linalg.svd(np.linalg.qr(y)[0].T @ a, full_matrices=False)
    return vt[: min(rank, len(vt))].T


class Postings:
    """By word of a space: the passages that it counts for, with weights."""

    def __init__(self, found: list[tuple[int, int, float]], words: int):
        found.sort()
        self.passage, self.weight = np.array([x[1] for x in found], np.int64), np.array([x[2] for x in found])
        self.start = np.searchsorted(np.array([x[0] for x in found], np.int64), np.arange(words + 2))

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in at, passage and weight of all postings of the words there."""
        many = self.start[at + 1] - self.start[at]
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.start[at], many)
        return np.repeat(np.arange(len(at)), many), self.passage[k], self.weight[k]


class Space:
    """A block's latent space: rows of the projection for the slots that its passages use, and the passages in it."""

    def __init__(self, items: list[int | None], texts: list[bytes], idf: np.ndarray, rank: int, overlap: float = OVERLAP):
        self.items, self.words = items, [terms(x) for x in texts]
        slots = [slots_of(x) for x in self.words]
        self.slots = np.unique(np.concatenate(slots))
        a = np.zeros((len(slots), len(self.slots)))
        for k, x in enumerate(slots):
            used, times = np.unique(x, return_counts=True)
            a[k, np.searchsorted(self.slots, used)] = np.sqrt(times) * idf[used]
        a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
        basis = randomised_svd(a, rank)
        self.passages, self.basis, self.idf = (a @ basis).astype(np.float32), basis.astype(np.float32), idf[self.slots]
        # Of each passage the weightiest words, by word: whose they are and how much they weigh.
        heads, rarer = [], []
        self.need = np.ones(len(slots))
        for k, row in enumerate(a):
            order = np.argsort(-row, kind="stable")
            left = np.sqrt(np.maximum(0, 1 - np.cumsum(row[order] ** 2)))
            heads += [(x, k, row[x]) for x in order[: int((left > REST).sum()) + 1] if row[x]]
            # A copy has `most` of the passage's words; without the commonest, at most half of `most`, that leaves so many of the rest.
            used, times = np.unique(slots[k], return_counts=True)
            order = np.argsort(idf[used], kind="stable")
            most = max(1, int(np.ceil(overlap * len(slots[k]) - 1e-9)))
            common = int(np.searchsorted(np.cumsum(times[order]), most // 2, "right"))
            self.need[k] = most - times[order[:common]].sum()
            rarer += [(x, k, 1.0) for x in np.searchsorted(self.slots, used[order[common:]])]
        self.heads, self.rarer = Postings(heads, len(self.slots)), Postings(rarer, len(self.slots))
        # By width of windows: the passages whose own it is, and those that have it.
        own = np.array(WIDTHS)[np.searchsorted(WIDTHS, [len(x) for x in self.words])]
        self.own = {w: of for w in WIDTHS if len(of := np.flatnonzero(own == w))}
        self.widths = self.own | {WINDOW: np.arange(len(own))}
        self.at, self.places = None, {}

    def where(self, p: int) -> tuple[tuple[dict[bytes, int], int], tuple[dict[bytes, int], int]]:
        """Places of words in a passage and in its answer, with their numbers of words."""
        if p not in self.places:
            passage = self.words[p]
            tail = passage[-(-3 * len(passage) // 4) - 1 :] if len(passage) > 4 else passage
            self.places[p] = (places_of(passage), len(passage)), (places_of(tail), len(tail))
        return self.places[p]

    def positions(self, slots: np.ndarray) -> np.ndarray:
        """Rows of the projection; len(slots) of the space for words that it doesn't have."""
        if self.at is None:
            self.at = np.full(SLOTS + 1, len(self.slots), np.int32)  # SLOTS itself stands between texts
            self.at[self.slots] = np.arange(len(self.slots))
            self.padded = np.vstack((self.basis, np.zeros((1, self.basis.shape[1])))).astype(np.float64)
            self.near = {width: self.passages[of].astype(np.float64) for width, of in self.widths.items()}
        return self.at[slots]


def _space(idf, rank: int, overlap: float):
    def run(key: tuple, found: pa.Table) -> pa.Table:
        found = found.sort_by([("item", "ascending"), ("part", "ascending")])
        space = Space(found["item"].to_pylist(), found["text"].to_pylist(), idf.value, rank, overlap)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "space": pa.array([pickle.dumps(space)], pa.binary())})

    return run


def places_of(a: list[bytes]) -> dict[bytes, int]:
    """Of each word of a a bit for each place that it has."""
    where: dict[bytes, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    return where


def common_subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence of words."""
    return _subsequence(list(filter(None, map(places_of(a).get, b))), len(a))


def _subsequence(hits: list[int], n: int) -> int:
    """The same, of the places in n words that each word there is in both has: a bit of one integer for each of the n."""
    row = full = (1 << n) - 1
    for hit in hits:
        u = row & hit
        row = (row + u | row - u) & full
    return n - row.bit_count()


def _candidates(slots: np.ndarray, idf: np.ndarray, space: Space, cosine: float) -> dict[int, list[tuple[float, int, int, int]]]:
    """By passage: similarity, start and end of the words to look at, and the window's last place, of the windows that reach the cosine or hold enough rarer words."""
    found: dict[int, list[tuple[float, int, int, int]]] = {}
    for first in range(0, max(1, len(slots) - REACH), PART):
        _part(slots[first : first + PART + REACH], first, idf, space, cosine, found)
    return found


def _part(slots: np.ndarray, first: int, idf: np.ndarray, space: Space, cosine: float, found: dict[int, list[tuple[float, int, int, int]]]) -> None:
    at = space.positions(slots)
    weight = idf[slots].astype(np.float64)
    total = np.concatenate(([0], np.cumsum(weight**2)))  # a term's weight is sqrt(count) * idf, so that squares add up word by word

    def cosines(passages: np.ndarray, i: int, j: int) -> np.ndarray:
        held = np.sort(at[i:j])
        held = held[: held.searchsorted(len(space.slots))]
        if not len(held):
            return np.zeros(len(passages))
        ends = np.append((held[1:] != held[:-1]).nonzero()[0], len(held) - 1)
        used, times = held[ends], ends + 1.0
        times[1:] -= times[:-1].copy()
        projected = (np.sqrt(times) * space.idf[used]) @ space.padded[used]
        return passages @ projected / max(float(np.sqrt(total[j] - total[i])), 1e-12)

    places, passages, weights = space.heads.of(at)
    products = weight[places] * weights
    for width, of in space.widths.items() if len(places) else ():
        step, many = width // 2, len(of)
        place, passage, product = _among(of, len(space.passages), places, passages, products)
        count = max(1, -(-(len(slots) - step) // step))  # windows start at multiples of step; each word is in two
        last = np.minimum(place // step, count - 1)
        sums = np.bincount(last * many + passage, product, count * many)
        both = (place // step == last) & (last > 0)
        sums += np.bincount(((last - 1) * many + passage)[both], product[both], count * many)
        start = np.arange(count) * step
        end = np.minimum(start + width, len(slots))
        norm = np.sqrt(total[end] - total[start])
        hopeful = (norm > 0) & (sums.reshape(count, many) >= (cosine - REST) * norm[:, None]).any(1)
        for k in np.flatnonzero(hopeful):
            i, j = int(start[k]), int(end[k])
            near = cosines(space.near[width], i, j)
            for q in np.flatnonzero(near >= cosine):
                p = int(of[q])
                reach = len(space.words[p]) // 2 + 4
                found.setdefault(p, []).append((float(near[q]), max(0, first + i - reach), first + j + reach, first + j - 1))
    places, passages, ones = space.rarer.of(at)
    for width, of in space.own.items() if len(places) else ():
        step, many = width // 2, len(of)
        place, passage, one = _among(of, len(space.passages), places, passages, ones)
        count = -(-len(slots) // step)
        held = np.bincount((place // step + 2) * many + passage, one, (count + 2) * many).reshape(count + 2, many)
        enough = held[:-2] + held[1:-1] + held[2:] >= space.need[of]  # three steps hold all of a copy, wherever it starts
        for k, q in np.argwhere(enough):
            i, j = max(0, (int(k) - 2) * step), min((int(k) + 1) * step, len(slots))
            found.setdefault(int(of[q]), []).append((float(cosines(space.passages[of[q : q + 1]], i, j)[0]), first + i, first + j, first + j - 1))


def _among(of: np.ndarray, passages: int, place: np.ndarray, passage: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The postings of the passages in of, numbered by their order there."""
    if len(of) == passages:
        return place, passage, weight
    number = np.full(passages, -1)
    number[of] = np.arange(len(of))
    among = number[passage] >= 0
    return place[among], number[passage[among]], weight[among]


def _laid(texts: list[tuple[int | None, list[bytes], np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The slots of texts end to end, and where each starts."""
    sizes = np.array([-(-len(x[1]) // GAP) * GAP + GAP for x in texts])
    starts = np.cumsum(sizes) - sizes
    slots = np.full(int(sizes.sum()), SLOTS, np.int64)
    for start, (_, words, mine) in zip(starts.tolist(), texts, strict=True):
        slots[start : start + len(words)] = mine
    return slots, starts


def _hits(texts: list[tuple[int | None, list[bytes], np.ndarray]], idf: np.ndarray, spaces: list[Space], cosine: float, overlap: float, answer: float) -> Iterator[tuple]:
    """A row for each passage that each text holds."""
    slots, starts = _laid(texts)
    for space in spaces:
        for p, windows in _candidates(slots, idf, space, cosine).items():
            (passage, many), (tail, few) = space.where(p)
            best: dict[int, tuple[float, float, float]] = {}
            places = np.searchsorted(starts, [x[3] for x in windows], "right") - 1
            for k, (similarity, i, j, _) in zip(places.tolist(), windows, strict=True):
                near = texts[k][1][max(0, i - int(starts[k])) : j - int(starts[k])]
                hits = list(filter(None, map(passage.get, near)))
                if len(hits) / many < overlap or (share := _subsequence(hits, many) / many) < overlap:  # no more words in order than in any
                    continue
                if (last := _subsequence(list(filter(None, map(tail.get, near))), few) / few) >= answer:
                    best[k] = max(best.get(k, (0.0, 0.0, 0.0)), (share, last, similarity))
            yield from ((texts[k][0], space.items[p], x[2], x[0], x[1]) for k, x in best.items())


def _matches(idf, spaces, cosine: float, overlap: float, answer: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, some, size, weights = Out(_hit), [], 0, np.append(idf.value, np.float32(0))

        def search() -> None:
            for row in _hits(some, weights, spaces.value, cosine, overlap, answer):
                for column, value in zip(out.parts, row, strict=True):
                    column.append([value])
                out.n += 1

        for doc, text in rows(batches, "doc", "text"):
            if not (words := terms(text)):
                continue
            some.append((doc, words, slots_of(words)))
            size += len(words) + 2 * GAP
            if size >= PART:
                search()
                some, size = [], 0
            if out.n >= 10_000:
                yield _rows(out)
        if some:
            search()
        if out.n:
            yield _rows(out)

    return trimming(run)


def _rows(out: Out) -> pa.RecordBatch:
    columns = [pa.array([x for xs in part for x in xs], f.type) for part, f in zip(out.parts, _hit, strict=True)]
    out.parts, out.n = [[] for _ in _hit], 0
    return pa.RecordBatch.from_arrays(columns, schema=_hit)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items in even parts of at most PASSAGE words, by half a part apart where there are several."""
    for batch in batches:
        out = []
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = terms(text)
            starts = [0] if len(words) <= PASSAGE else range(0, len(words) - PASSAGE // 2, PASSAGE // 2)
            out += [{"item": item, "part": k, "text": b" ".join(words[x : x + PASSAGE])} for k, x in enumerate(starts) if words]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("item", pa.int64()), ("part", pa.int32()), ("text", pa.binary())]))


@bounded_batches
def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cosine: float = COSINE, overlap: float = OVERLAP, answer: float = ANSWER) -> DataFrame:
    """Returns doc_id, item_id, similarity, overlap and answer_overlap for each document and benchmark item that it holds."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("binary").alias("text")).distinct()
    passages = cut(items.mapInArrow(_passages, "item long, part int, text binary"))
    count = passages.count()
    blocks = max(1, -(-count // (RANK * 3 // 4)))  # hashed blocks come out at RANK passages at most, or nearly
    idf = sc.broadcast(inverse_frequencies(base.select("text")))
    dealt = passages.withColumn("block", F.pmod(F.xxhash64("item", "part"), F.lit(blocks)))
    spaces = cut(dealt.groupBy("block").applyInArrow(_space(idf, RANK, overlap), "block long, space binary"))
    found = spark.createDataFrame([], "doc_id long, item_id long, similarity double, overlap double, answer_overlap double")
    for first in range(0, blocks, BLOCKS) if count else []:
        some = [pickle.loads(r["space"]) for r in spaces.where(F.col("block").between(first, first + BLOCKS - 1)).orderBy("block").toLocalIterator()]  # BLOCKS rows at most
        hits = base.mapInArrow(_matches(idf, sc.broadcast(some), cosine, overlap, answer), "doc_id long, item_id long, similarity double, overlap double, answer_overlap double")
        found = cut(hits) if not first else found.union(cut(hits))
    return found.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("similarity", "overlap", "answer_overlap")])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, with their columns; rows with a null id stay."""
    return without_ids(docs, contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))
