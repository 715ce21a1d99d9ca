"""Normalisation of names, keys and addresses, as column expressions.

Regular expressions carry (?U) wherever letters outside ASCII count as word characters. Only what needs Unicode decomposition runs in
Python, as Arrow-batched functions.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as t

# Strings that count as missing.
NA = ("", "nan", "none", "unknown", "null")

# Names of Greek letters.
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta",
    "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "ο": "omicron", "π": "pi",
    "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
}

# Words that tell nothing about an entity.
STOP_WORDS = (
    "process", "pathway", "mechanism", "function", "functions", "activity", "activities", "role", "state", "states",
    "feature", "features", "property", "properties", "factor", "factors", "level", "levels", "amount", "amounts",
    "concentration", "concentrations", "production", "generation", "synthesis", "formation", "damage", "injury",
    "breakdown", "leakage", "disruption", "dysfunction",
)

SPACE = r"(?U)\s+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_na(x) -> Column:
    """Whether a value is null or one of the strings that count as missing."""
    return _c(x).isNull() | F.lower(F.trim(_c(x).cast("string"))).isin(*NA)


def na_to_null(x) -> Column:
    return F.when(~is_na(x), _c(x).cast("string"))


def collapse(x) -> Column:
    return F.trim(F.regexp_replace(_c(x), SPACE, " "))


def normalize_eval(x) -> Column:
    """For comparison: lower case, _ and - to spaces, other punctuation gone; null to ''."""
    plain = F.regexp_replace(F.lower(F.coalesce(_c(x).cast("string"), F.lit(""))), "[_-]", " ")
    return collapse(F.regexp_replace(plain, r"(?U)[^\w\s]", ""))


def triple_sentence(s, p, o) -> Column:
    return F.concat_ws(" ", normalize_eval(s), normalize_eval(p), normalize_eval(o))


def normalize_category(x, null_as_nan: bool = False) -> Column:
    """For categories: ; _ - to spaces, lower case, single spaces."""
    x = F.coalesce(_c(x), F.lit("nan")) if null_as_nan else _c(x)
    return collapse(F.lower(F.regexp_replace(x, r"[;_\-]", " ")))


def combine_subject_object(s, o) -> Column:
    present = lambda x: F.when(_c(x) != "missing", _c(x))
    return F.concat_ws(" ", present(s), present(o))


def norm_curie(x) -> Column:
    """Upper-case prefix, no white space, no zeros before a number."""
    bare = F.regexp_replace(na_to_null(x), SPACE, "")
    prefix = F.regexp_extract(bare, "^([A-Za-z0-9]+):", 1)
    upper = F.when(prefix != "", F.concat(F.upper(prefix), F.substr(bare, F.length(prefix) + 1))).otherwise(bare)
    return F.regexp_replace(upper, r":0+(\d+)$", ":$1")


def norm_iri(x) -> Column:
    return F.replace(F.regexp_replace(F.trim(na_to_null(x)), "/+$", ""), F.lit("http://"), F.lit("https://"))


def sanitize_label(x) -> Column:
    """A label of letters, digits and _; LABEL where nothing is left, L_ before a digit."""
    s = F.regexp_replace(F.trim(F.coalesce(_c(x).cast("string"), F.lit(""))), "[^0-9A-Za-z_]", "_")
    s = F.when(s == "", F.lit("LABEL")).otherwise(s)
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("L_"), s)).otherwise(s)


def sanitize_key(x) -> Column:
    """A property's name: lower case, p_ before anything but a letter."""
    k = F.regexp_replace(F.lower(F.trim(F.coalesce(_c(x).cast("string"), F.lit("")))), "[^A-Za-z0-9_]", "_")
    return F.when(k.rlike("^[A-Za-z]"), k).otherwise(F.concat(F.lit("p_"), k))


def _bare(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if unicodedata.category(ch) != "Mn")


def canon_name_py(text: str | None) -> str:
    """For keys of nodes: no accents, lower case, no separators between word characters."""
    text = re.sub(r"\s+", " ", _bare((text or "").strip()).lower())
    text = re.sub(r"(?<=\w)[-_\s]+(?=\w)", "", text)
    return text.replace("covid19", "covid-19").replace("sarscov2", "sars-cov-2")


def norm_text_py(text: str | None) -> str:
    """No accents, Greek letters by name (small ones only: it comes before lower case), single spaces, lower case."""
    if not text:
        return ""
    if text.isascii():
        text = text.strip()
    else:
        text = _bare(unicodedata.normalize("NFKD", text).strip())
        for letter, name in GREEK.items():
            text = text.replace(letter, name)
    return re.sub(r"\s+", " ", text).lower()


def canon_entity_py(text: str | None) -> str:
    """For linking: norm_text_py, no separators between word characters, singular."""
    if not text:
        return ""
    text = re.sub(r"(?<=\w)[-_\s]+(?=\w)", "", norm_text_py(text))
    text = text.replace("sarscov2", "sars-cov-2").replace("covid19", "covid-19")
    text = re.sub("s$", "", re.sub("(?<!s|x|z)es$", "e", text))
    return re.sub("rs0*", "rs", text)


@F.pandas_udf(t.StringType())
def canon_name(x: pd.Series) -> pd.Series:
    return x.map(canon_name_py)


@F.pandas_udf(t.StringType())
def norm_text(x: pd.Series) -> pd.Series:
    return x.map(norm_text_py)


@F.pandas_udf(t.StringType())
def canon_entity(x: pd.Series) -> pd.Series:
    return x.map(canon_entity_py)


def entity_key(name_key, curie, iri, raw_id) -> Column:
    """The first of curie, iri, id and name that is there. name_key is canon_name of the name."""
    return F.coalesce(F.concat(F.lit("curie:"), norm_curie(curie)), F.concat(F.lit("iri:"), norm_iri(iri)), F.concat(F.lit("id:"), F.trim(na_to_null(raw_id))), F.concat(F.lit("name:"), F.coalesce(_c(name_key), F.lit(""))))


def all_keys(name_key, curie, iri, raw_id) -> Column:
    """Every key of an entity, the preferred one first."""
    keys = F.array(F.concat(F.lit("curie:"), norm_curie(curie)), F.concat(F.lit("iri:"), norm_iri(iri)), F.concat(F.lit("id:"), F.trim(na_to_null(raw_id))), F.concat(F.lit("name:"), F.nullif(_c(name_key), F.lit(""))))
    return F.array_distinct(F.array_compact(keys))


def alternative_keys(name_key, curie, iri, raw_id) -> Column:
    return F.array_except(all_keys(name_key, curie, iri, raw_id), F.array(entity_key(name_key, curie, iri, raw_id)))


def raw_github(x) -> Column:
    """The raw address of a file shown on a code host."""
    return F.regexp_replace(_c(x), r"^https?://github\.com/([^/]+)/([^/]+)/blob/(.+)$", "https://raw.githubusercontent.com/$1/$2/$3")


def number_without_commas(x) -> Column:
    return F.expr("null") if x is None else F.regexp_replace(_c(x).cast("string"), ",", "").try_cast("long")


def display_name(x, aliases: dict[str, str] | None = None) -> Column:
    """_ to spaces; a name's alias where it has one."""
    plain = F.translate(_c(x), "_", " ")
    if not aliases:
        return plain
    known = F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair])
    return F.coalesce(known[F.lower(plain)], plain)


def tokens(x) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit("([a-z0-9]+)"))


def significant_tokens(x) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(tokens(x), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))


def head_noun(x) -> Column:
    return F.coalesce(F.try_element_at(tokens(x), F.lit(-1)), F.lit(""))


def token_coverage(q, c) -> Column:
    """The share of q's significant words that c has."""
    wanted = F.array_distinct(significant_tokens(q))
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(wanted, significant_tokens(c))) / F.size(wanted))


def trigrams(x) -> Column:
    low = F.lower(_c(x))
    return F.when(F.length(low) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda k: F.substr(low, k, F.lit(3)))))


def jaccard_trigram(a, b) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.when((F.size(x) <= 0) | (F.size(y) <= 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def split_coordinated(x) -> Column:
    """Parts of a mention that names two to six things; an empty array for one that doesn't."""
    parts = F.filter(F.transform(F.split(_c(x), r"\s*(?:/|&|,|\band\b)\s*"), lambda p: F.trim(p)), lambda p: F.length(p) >= 2)
    return F.when(F.size(parts).between(2, 6), parts).otherwise(F.array().cast("array<string>"))


def contains_any(x, keywords) -> Column:
    """Whether the lower-cased value contains one of the keywords; null where the value is null."""
    low = F.lower(_c(x))
    found = F.lit(False)
    for keyword in keywords:
        found = found | F.contains(low, F.lit(keyword.lower()))
    return found


def tokens_py(text: str | None) -> list[str]:
    return re.findall("[a-z0-9]+", (text or "").lower())


def significant_tokens_py(text: str | None) -> list[str]:
    return [t for t in tokens_py(text) if len(t) >= 3 and t not in STOP_WORDS]


def strip_generic_tail_py(text: str) -> str:
    """Without the words at the end that tell nothing; the text itself where none is left."""
    found = tokens_py(text)
    while found and (len(found[-1]) < 3 or found[-1] in STOP_WORDS):
        found.pop()
    return " ".join(found) or text
