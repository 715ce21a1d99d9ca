"""Encoding of whole texts by a tokenizer file, with a cache of pieces.

Neither tokenizer here lets a token reach across a space that stands between two other characters, so that a text is the pieces
between its spaces, encoded one by one; equal pieces are encoded once. New pieces go to the tokenizer in one text, with the spaces
between them that they have in their own texts; which ids are whose is told by the marks that tokens carry, of a space before them or
of a word's end, and checked by their number. Where white space follows a space, pieces aren't independent, and the whole text goes to
the tokenizer. tests/llm compares both ways.

A tokenizer that lower-cases and parts texts by SPLIT before its merges makes the ids of each part by itself. Texts of Latin-1 are parted
so here, over whole arrays, and parts cached: that is a word whatever its case and the marks around it, of which there are far fewer.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

_DOUBLE = re.compile(r" \s")
#: The pattern by which a tokenizer parts texts, and its steps with that.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITS = [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
#: Of each byte of Latin-1: what it is to SPLIT, and its lower case.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KINDS = bytes(_SPACE if chr(k).isspace() else _LETTER if chr(k).isalpha() else _DIGIT if unicodedata.category(chr(k))[0] == "N" else _OTHER for k in range(256))
_LOWER = bytes(ord(chr(k).lower()) for k in range(256))
_SPACES = bytes(k for k in range(256) if _KINDS[k] == _SPACE)
_SHORT = re.compile(rb"'(?:[stmd]|re|ve|ll)")
#: Separators that libraries class differently.
_ODD = b"\x1c\x1d\x1e\x1f\x85"
#: Entries in the caches of a worker, about 250 bytes each; full ones keep what the last texts used.
CACHE = 200_000
#: Characters of the pieces in the caches.
CACHE_CHARACTERS = 8_000_000
#: Characters of texts that are looked at together.
CHUNK = 1_000_000


def _dependent(text: str) -> bool:
    """Whether white space follows a space or stands at an end, or a separator occurs that libraries class differently."""
    return text[0].isspace() or text[-1].isspace() or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text or _DOUBLE.search(text) is not None


def _latin(text: str) -> bytes | None:
    """A text in Latin-1 with A-Z lower-cased, or None where it has other letters or odd separators."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return data.translate(_LOWER) if len(data.translate(None, _ODD)) == len(data) else None


def _split(data: bytes) -> tuple[np.ndarray, pa.Array]:
    """Where the parts that SPLIT makes of lower-cased Latin-1 start, and the parts."""
    kinds = np.frombuffer(data.translate(_KINDS), np.uint8)
    begins = np.concatenate(([_SPACE], kinds[:-1])) != kinds if len(kinds) else np.zeros(0, bool)
    begins = (begins | (kinds == _DIGIT)) & (kinds != _SPACE)
    short = [x.span() for x in _SHORT.finditer(data) if begins[x.start()]]  # an apostrophe after other marks goes with them
    if short:
        at, after = np.array(short).T
        begins[at + 1] = False
        after = after[after < len(kinds)]
        begins[after] |= kinds[after] == _LETTER
    stays = kinds != _SPACE
    offsets = np.append(np.flatnonzero(begins[stays]), np.count_nonzero(stays)).astype("<i4")
    parts = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data.translate(None, _SPACES))])
    return np.flatnonzero(begins), parts


class Encoder:
    _known: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # A byte-level tokenizer keeps a piece's leading space in its first token; the other drops white space.
        self.space = " " if len(self._direct(["a b"])[0]) // 4 == 2 and self._direct(["b"]) != [self._direct(["a b"])[0][4:]] else ""
        special = [(k, x.content) for k, x in sorted(self.tokenizer.get_added_tokens_decoder().items()) if x.special and x.content.startswith("<|") and not (x.lstrip or x.rstrip)]
        self.separator_id, self.separator = special[0] if special else (None, None)
        # Tokens that start a piece after a space, or that end a word.
        marked = (lambda x: x.startswith("\u0120")) if self.space else (lambda x: x.endswith("</w>"))
        self.marked = np.zeros(self.size, bool)
        self.marked[[k for x, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if marked(x)]] = True
        steps = json.loads(self.tokenizer.to_str())
        listed = [(steps[k] or {}).get(x) for k, x in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.parts: dict[bytes, bytes] | None = {} if listed == [_NORMALIZERS, _SPLITS] else None
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {} if self.space else self.first
        self.held = 0

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    @classmethod
    def forget(cls) -> None:
        """Empties the caches at a partition's end: other stages run in the same workers. The tokenizers themselves stay."""
        for known in cls._known.values():
            known.first.clear()
            known.later.clear()
            if known.parts:
                known.parts.clear()
            known.held = 0

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _apart(self, pieces: list[str], space: str) -> list[bytes]:
        """The ids of each piece."""
        if any("<|" in x for x in pieces):
            return self._direct([space + x for x in pieces])
        if space:
            ids = self._ids(space + space.join(pieces))
            cuts = np.flatnonzero(self.marked[ids])
            if len(cuts) == len(pieces) and not cuts[0]:
                return _cut(ids.tobytes(), [*cuts.tolist(), len(ids)])
        elif not self.space and all(map(str.isalpha, pieces)):
            ids = self._ids(" ".join(pieces))
            cuts = np.flatnonzero(self.marked[ids]) + 1
            if len(cuts) == len(pieces) and cuts[-1] == len(ids):
                return _cut(ids.tobytes(), [0, *cuts.tolist()])
        if not self.separator:
            return self._direct([space + x for x in pieces])
        ids = self._ids(self.separator.join(space + x for x in pieces))
        data, ends = ids.tobytes(), 4 * np.flatnonzero(ids == self.separator_id)
        return [data[i:j] for i, j in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(data)], strict=True)]

    def _learn(self, cache: dict[str, bytes], pieces: set[str], space: str) -> None:
        """Adds pieces to a cache."""
        kinds: list[list[str]] = [[], [], []]
        for x in pieces:
            kinds[2 if x.isalpha() else 0 if "<|" in x else 1].append(x)
        if self.space:  # a space tells each piece's start
            kinds[1:] = [kinds[1] + kinds[2]]
        for kind in filter(None, kinds):
            cache.update(zip(kind, self._apart(kind, space), strict=True))
        self.held += sum(map(len, pieces))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        done = self._by_parts(texts, out) if self.parts is not None else set()
        whole = [k for k, x in enumerate(texts) if x and k not in done and _dependent(x)]
        for k, ids in zip(whole, self._direct([texts[k] for k in whole]), strict=True):
            out[k] = ids
        done.update(whole)
        some, size = [], 0
        for k, text in enumerate(texts):
            if text and k not in done:
                some.append((k, text.split(" ")))
                size += len(text)
            if size > CHUNK:
                self._pieces(some, out)
                some, size = [], 0
        self._pieces(some, out)
        return out

    def _by_parts(self, texts: list[str | None], out: list[bytes]) -> set[int]:
        """Encodes the texts of Latin-1 by their parts, a few at a time, and returns which these are."""
        done, some, size = set(), [], 0
        for k, text in enumerate(texts):
            if text and "<|" not in text and (data := _latin(text)) is not None:
                done.add(k)
                some.append((k, data))
                size += len(data)
            if size > 2 * CHUNK:
                self._parts(some, out)
                some, size = [], 0
        self._parts(some, out)
        return done

    def _parts(self, some: list[tuple[int, bytes]], out: list[bytes]) -> None:
        """Encodes a few texts by their parts: what is new in all of them first, in one text, then all from the cache."""
        starts, parts = _split(b"\n".join(x for _, x in some))
        if not len(parts):
            return
        coded = parts.dictionary_encode()
        _, bounds, data = coded.dictionary.buffers()
        bounds, data = np.frombuffer(bounds, "<i4")[: len(coded.dictionary) + 1].tolist(), data.to_pybytes()
        words, at = [data[i:j] for i, j in zip(bounds, bounds[1:], strict=False)], coded.indices.to_numpy()
        if len(self.parts) > CACHE or self.held > CACHE_CHARACTERS:
            self.parts = {x: ids for x in words if (ids := self.parts.get(x)) is not None}
            self.held = sum(map(len, self.parts))
        known = list(map(self.parts.get, words))
        if new := [x for x, ids in zip(words, known, strict=True) if ids is None]:
            names = [x.decode("latin-1") for x in new]
            ids = self._ids(" ".join(names))
            cuts = np.flatnonzero(self.marked[ids]) + 1
            apart = len(cuts) == len(new) and cuts[-1] == len(ids)
            self.parts.update(zip(new, _cut(ids.tobytes(), [0, *cuts.tolist()]) if apart else self._direct(names), strict=True))
            self.held += sum(map(len, new))
            known = [self.parts[x] if ids is None else ids for x, ids in zip(words, known, strict=True)]
        n = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first, n = (np.cumsum(n) - n)[at], n[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        place = np.repeat(first - ends[:-1], n)
        place += np.arange(len(place))
        ids = np.frombuffer(b"".join(known), "<u4")[place].tobytes()
        sizes = np.array([len(x) + 1 for _, x in some], np.int64)
        bounds = 4 * ends[np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))]
        for (k, _), i, j in zip(some, bounds.tolist(), bounds[1:].tolist(), strict=False):
            out[k] = ids[i:j]

    def _pieces(self, some: list[tuple[int, list[str]]], out: list[bytes]) -> None:
        """Encodes a few split texts: what is new in all of them first, then each from the cache."""
        first, later = {x[0] for _, x in some}, set()
        for _, x in some:
            later.update(x[1:])
        if len(self.later) + len(self.first) * (self.first is not self.later) > CACHE or self.held > CACHE_CHARACTERS:
            stay = {x: ids for x in later if (ids := self.later.get(x)) is not None}
            self.first.clear()
            self.later.clear()
            self.later.update(stay)
            self.held = sum(map(len, stay))
        if new := later.difference(self.later):
            self._learn(self.later, new, self.space)
        if new := first.difference(self.first):
            self._learn(self.first, new, "")
        for k, x in some:
            out[k] = self.first[x[0]] + b"".join(map(self.later.__getitem__, x[1:]))


def _cut(data: bytes, bounds: list[int]) -> list[bytes]:
    """The 4-byte ids between neighbouring bounds."""
    return [data[4 * i : 4 * j] for i, j in zip(bounds, bounds[1:], strict=False)]
