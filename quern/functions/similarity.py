"""Similarities: cosine as an expression; string ratios, which Spark lacks, as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as t

from quern.functions.text import canon_entity_py, significant_tokens_py


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """Null where a vector is 0."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def sign_hash(vector) -> Column:
    """A 64-bit hash of signs, of vectors with 64 entries; near vectors differ in few bits."""
    return F.aggregate(F.transform(vector, lambda x, k: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L"))), F.expr("0L"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x))


def hamming(a, b) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)) if isinstance(a, str) else a.bitwiseXOR(b))


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit of one integer for each character of a."""
    where: dict[str, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if hit := where.get(x):
            u = row & hit
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Indel similarity: 2 * common / sum of lengths."""
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter with a window of the longer of its length, or shorter at an end."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 1.0 if not long else 0.0
    n, m = len(short), len(long)
    windows = [long[max(0, k) : k + n] for k in range(1 - n, m)]
    return max(ratio(short, w) for w in windows)


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = sorted(x & y)
    if both and (x <= y or y <= x):
        return 1.0
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    base = " ".join(both)
    first, second = f"{base} {left}".strip(), f"{base} {right}".strip()
    return max(ratio(first, second), ratio(base, first) if both else 0.0, ratio(base, second) if both else 0.0)


def trigram_py(a: str, b: str) -> float:
    x, y = ({s[k : k + 3] for k in range(len(s) - 2)} for s in (a.lower(), b.lower()))
    return len(x & y) / len(x | y) if x and y else 0.0


def coverage_py(q: str, c: str) -> float:
    wanted = set(significant_tokens_py(q))
    return len(wanted & set(significant_tokens_py(c))) / len(wanted) if wanted else 0.0


def lexical_py(a: str | None, b: str | None) -> float:
    """A weighted mean of ratios of canonical forms: .30 token set, .25 token sort, .15 partial, .15 trigram, .15 coverage, and .10 where one holds the other."""
    x, y = canon_entity_py(a), canon_entity_py(b)
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    inside = 0.10 if min(len(x), len(y)) >= 4 and (x in y or y in x) else 0.0
    score = 0.30 * token_set_ratio(x, y) + 0.25 * token_sort_ratio(x, y) + 0.15 * partial_ratio(x, y) + 0.15 * trigram_py(x, y) + 0.15 * coverage_py(x, y) + inside
    return min(1.0, max(0.0, score))


@F.pandas_udf(t.DoubleType())
def lexical_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lexical_py(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def jaro_winkler_py(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    other = [y for y, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(hits, other, strict=True)) / 2
    jaro = (len(hits) / len(a) + len(hits) / len(b) + (len(hits) - swaps) / len(hits)) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


@F.pandas_udf(t.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_py(x, y) for x, y in zip(a, b, strict=True)], dtype=float)
