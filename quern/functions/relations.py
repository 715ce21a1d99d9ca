"""Mapping of free-text predicates to fifteen relations: ordered rules, made into one CASE WHEN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The relations and their names in BEL.
BEL = {
    "DIRECT_INCREASE": "directlyIncreases", "DIRECT_DECREASE": "directlyDecreases", "INCREASE": "increases", "DECREASE": "decreases",
    "REGULATES": "regulates", "ASSOCIATION": "association", "CORRELATION_POS": "positiveCorrelation", "CORRELATION_NEG": "negativeCorrelation",
    "NO_EFFECT": "noEffect", "PART_OF": "partOf", "HAS_MEMBER": "hasMember", "HAS_COMPONENT": "hasComponent",
    "LOCALIZES": "localizes", "TRANSLOCATES": "translocates", "BIOMARKER_FOR": "biomarkerFor",
}

# Phrases that decide if a predicate contains them; the first that does, in this order.
PHRASES = {
    "activates": "INCREASE", "upregulates": "INCREASE", "induces": "INCREASE", "stimulates": "INCREASE", "enhances": "INCREASE",
    "promotes": "INCREASE", "increases": "INCREASE", "augments": "INCREASE", "boosts": "INCREASE", "elevates": "INCREASE", "potentiates": "INCREASE",
    "phosphorylates": "DIRECT_INCREASE", "phosphorylation": "DIRECT_INCREASE", "acetylation": "DIRECT_INCREASE", "methylation": "DIRECT_INCREASE",
    "ubiquitination": "DIRECT_INCREASE", "dephosphorylation": "DIRECT_DECREASE",
    "inhibits": "DECREASE", "suppresses": "DECREASE", "represses": "DECREASE", "blocks": "DECREASE", "attenuates": "DECREASE", "reduces": "DECREASE",
    "downregulates": "DECREASE", "abrogates": "DECREASE", "impairs": "DECREASE", "dampens": "DECREASE",
    "regulates": "REGULATES", "modulates": "REGULATES",
    "binds": "ASSOCIATION", "interacts": "ASSOCIATION", "associates": "ASSOCIATION", "complexes with": "ASSOCIATION", "co-localizes": "ASSOCIATION",
    "positively correlates": "CORRELATION_POS", "negatively correlates": "CORRELATION_NEG",
    "part of": "PART_OF", "has member": "HAS_MEMBER", "member of": "HAS_MEMBER", "has component": "HAS_COMPONENT", "component of": "HAS_COMPONENT",
    "localizes to": "LOCALIZES", "translocates to": "TRANSLOCATES", "biomarker for": "BIOMARKER_FOR",
    "no effect": "NO_EFFECT", "no change": "NO_EFFECT", "unchanged": "NO_EFFECT",
}

# Patterns that decide where no phrase does, in this order.
PATTERNS = [
    (r"phosphorylat(e|ion)|acetylat(e|ion)|methylat(e|ion)|ubiquitinat(e|ion)", "DIRECT_INCREASE"),
    (r"dephosphorylat(e|ion)", "DIRECT_DECREASE"),
    (r"activate|up-?regulat(e|ion)|enhanc(e|ement)|promot(e|ion)|induc(e|tion)|stimulat(e|ion)|increase(s|d)?|elevat(e|ion|ed|es)|augment(s|ed|ation)?|boost(s|ed)?", "INCREASE"),
    (r"inhibit(s|ed)?|down-?regulat(e|ion)|suppress(es|ion)?|repress(es|ion)?|block(s|ed)?|attenuat(e|ion|ed|es)|reduc(e|tion|ed|es)|diminish(es|ed)?|abrogat(e|ion|ed|es)|prevent(s|ed)?|impair(s|ed)?|dampen(s|ed)?", "DECREASE"),
    (r"regulat(e|ion)|modulat(e|ion)", "REGULATES"),
    (r"positiv(e|ely)\s*correlat(e|ion)", "CORRELATION_POS"),
    (r"negativ(e|ely)\s*correlat(e|ion)|anti[- ]?correlat(e|ion)", "CORRELATION_NEG"),
    (r"bind(s|ing)?|interact(s|ion)?|complex(es)?|associate(s|d)?|co-?locali[sz]e(s|d)?", "ASSOCIATION"),
    (r"member of|has member", "HAS_MEMBER"),
    (r"component of|has component|subunit of", "HAS_COMPONENT"),
    (r"part of", "PART_OF"),
    (r"locali[sz]e(s|d)? to|acts in|functions in|participates in", "LOCALIZES"),
    (r"translocat(e|ion)|traffick", "TRANSLOCATES"),
    (r"biomarker|marker of|diagnostic for", "BIOMARKER_FOR"),
    (r"no (significant )?effect|no change|does not affect|unchanged", "NO_EFFECT"),
]
NEGATION = r"\b(no(t)?|doesn'?t|didn'?t|without|lack of|fails? to|fail(ed)? to)\b"
NO_CHANGE = r"\b(no\s+(significant\s+)?(increase|decrease|change)|unchanged)\b"
STEMS = [
    (r"\b(up\s*regulat|up[- ]?shift|increase|elevat|augment|boost|potentiat)\w*", "INCREASE"),
    (r"\b(down\s*regulat|decreas|reduc|attenuat|dampen|impair|repress|suppress)\w*", "DECREASE"),
]
_UP, _DOWN = ("INCREASE", "DIRECT_INCREASE"), ("DECREASE", "DIRECT_DECREASE")


def _rule(text: Column, relation: str, by_phrase: bool) -> Column:
    """What a rule's relation becomes: a negation turns an effect round, or makes it none."""
    has = lambda pattern: text.rlike("(?U)" + pattern)
    for own, verb, other in ((_UP, "increase", "DECREASE"), (_DOWN, "decrease", "INCREASE")):
        if relation in own and by_phrase:
            none = has(rf"\b(no\s+{verb}|does\s+not\s+{verb}|fail(s|ed)?\s+to\s+{verb})\b")
            return F.when(has(NO_CHANGE) | has(NEGATION), F.when(none, "NO_EFFECT").otherwise(other)).otherwise(relation)
        if relation in own:
            none = has(NO_CHANGE) | has(rf"\b(does\s+not|fail(s|ed)?\s+to)\s+{verb}\b")
            return F.when(none, "NO_EFFECT").when(has(NEGATION), other).otherwise(relation)
    return F.lit(relation)


def relation_of(predicate) -> Column:
    """One of the fifteen relations. Order: a BEL name, a phrase within, a pattern, a stem; ASSOCIATION where nothing applies."""
    column = F.col(predicate) if isinstance(predicate, str) else predicate
    trimmed = F.trim(F.coalesce(column, F.lit("")))
    low = F.lower(trimmed)
    out = F.when(low == BEL["DIRECT_INCREASE"].lower(), "DIRECT_INCREASE")
    for relation, name in BEL.items():
        out = out.when(low == name.lower(), relation)
    for phrase, relation in PHRASES.items():
        out = out.when(F.contains(low, F.lit(phrase)), _rule(low, relation, True))
    # A BEL name as a word within; the leftmost counts.
    names = {name.lower(): relation for relation, name in BEL.items()}
    first = F.regexp_extract(low, r"(?U)\b(" + "|".join(names) + r")\b", 1)
    out = out.when(first != "", F.create_map(*[F.lit(v) for pair in names.items() for v in pair])[first])
    for pattern, relation in PATTERNS:
        out = out.when(low.rlike(rf"(?U)\b({pattern})\b"), _rule(low, relation, False))
    for pattern, relation in STEMS:
        out = out.when(low.rlike("(?U)" + pattern), relation)
    return out.otherwise("ASSOCIATION")


def bel_of(relation) -> Column:
    column = F.col(relation) if isinstance(relation, str) else relation
    return F.coalesce(F.create_map(*[F.lit(v) for pair in BEL.items() for v in pair])[column], F.lit("association"))


def raw_type(predicate) -> Column:
    """A predicate as an edge type: upper case, letters, digits and _."""
    column = F.col(predicate) if isinstance(predicate, str) else predicate
    return F.regexp_replace(F.upper(F.trim(column)), "[^0-9A-Z_]+", "_")
