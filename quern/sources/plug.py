"""Places for what lies outside: models, services, decoders. Each takes a function of a batch and runs it batch by batch on executors.

The stand-ins are deterministic and offline; they say nothing of a real model's quality.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quern.plans.iterate import cut


def complete(rows: DataFrame, model: Callable[[list[str]], list[str]], column: str = "prompt", out: str = "response", failed: str = "failed") -> DataFrame:
    """Adds a model's answer to each row; a batch that raises is asked row by row, and a row that raises is marked failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            asked = pdf[column].tolist()
            try:
                answers: list[str | None] = list(model(asked))
            except Exception:
                answers = []
                for x in asked:
                    try:
                        answers.append(model([x])[0])
                    except Exception:
                        answers.append(None)
            yield pdf.assign(**{out: answers, failed: [a is None for a in answers]})

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{schema}, `{out}` string, `{failed}` boolean")


def embed(rows: DataFrame, model: Callable[[list[str]], list[list[float]]] | None = None, column: str = "text", out: str = "embedding") -> DataFrame:
    """Adds a vector to each distinct text once, and joins it back."""
    model = model or hashed_vectors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: model(pdf[column].fillna("").tolist())})

    distinct = rows.select(column).distinct()
    vectors = distinct.mapInPandas(run, f"`{column}` string, `{out}` array<float>").withColumnRenamed(column, "_text")
    return rows.join(vectors, rows[column].eqNullSafe(vectors["_text"]), "left").drop("_text")


def hashed_vectors(texts: list[str], size: int = 64) -> list[list[float]]:
    """Unit vectors of hashed words and trigrams."""
    out = []
    for text in texts:
        v = np.zeros(size, np.float32)
        low = text.lower()
        for part in [*low.split(), *(low[k : k + 3] for k in range(len(low) - 2))]:
            h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
            v[h % size] += 1 if h >> 63 else -1
        n = float(np.linalg.norm(v))
        out.append((v / n if n else v).tolist())
    return out


def fetch(rows: DataFrame, client: Callable[[str], tuple[int, str, bytes]], column: str = "url", tries: int = 3) -> DataFrame:
    """Adds http_status, mime and content of each address, which is fetched once however many rows have it; a client that raises is tried again, then its status is error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for url in pdf[column]:
                got: tuple[str, str | None, bytes | None] = ("error", None, None)
                for _ in range(tries):
                    try:
                        status, mime, content = client(url)
                        got = str(status), mime, content
                        break
                    except Exception:
                        continue
                found.append(got)
            yield pdf.assign(http_status=[x[0] for x in found], mime=[x[1] for x in found], content=[x[2] for x in found])

    kind = dict(rows.dtypes)[column]
    got = cut(rows.select(column).distinct().mapInPandas(run, f"`{column}` {kind}, http_status string, mime string, content binary").withColumnRenamed(column, "_address"))
    return rows.join(got, rows[column].eqNullSafe(got["_address"]), "left").drop("_address")


def png_size(content: bytes | None) -> tuple[int, int] | None:
    """Width and height of a PNG by its header."""
    if not content or content[:8] != b"\x89PNG\r\n\x1a\n" or len(content) < 24:
        return None
    return struct.unpack(">II", content[16:24])


def perceptual_hash(gray: np.ndarray) -> int:
    """64 bits of a 32 x 32 grey image: signs of its lowest 8 x 8 cosine coefficients against their median."""
    n = gray.shape[0]
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = np.round((basis @ gray.astype(float) @ basis.T)[:8, :8].ravel(), 6)
    bits = low > np.median(low[1:])
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >> 63 else value


def image_facts(images: DataFrame, decode: Callable[[bytes], tuple[np.ndarray, int, int] | None]) -> DataFrame:
    """Adds hash and pixels to images (content); decode gives a 32 x 32 grey array, width and height, or None."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            facts = [decode(x) if x is not None else None for x in pdf["content"]]
            yield pdf.assign(hash=pd.array([perceptual_hash(f[0]) if f else None for f in facts], "Int64"), pixels=pd.array([f[1] * f[2] if f else None for f in facts], "Int64"))

    schema = ", ".join(f"`{n}` {t}" for n, t in images.dtypes)
    return images.mapInPandas(run, f"{schema}, hash long, pixels long")
