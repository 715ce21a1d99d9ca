"""Terms from what services of vocabularies answer: each service is the schema of its answers and expressions over a term in them.

Answers come from `plug.fetch` or any other table of bodies; an answer that isn't JSON of the schema gives no terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a definition that are kept.
DEFINITION = 300


@dataclass(frozen=True)
class Service:
    """schema of an answer, an array of its terms (over a), and a term's fields (over r; term is what was asked)."""

    schema: str
    terms: str
    label: str
    ontology_name: str
    most_synonyms: int
    synonyms: str = "cast(array() as array<string>)"
    definition: str = "''"
    curie: str = "cast(null as string)"
    obo_id: str = "cast(null as string)"
    iri: str = "''"
    taxid: str = "cast(null as int)"


_TAX = "concat(coalesce({0}, ''), if(coalesce({1}, 0) = 0, '', concat(' taxid:', {1})))"
_EN = "struct<en: struct<value: string>>"

# The shapes of public services' answers, and the names their terms go by.
SERVICES = {
    "OLS": Service(
        "response struct<docs: array<struct<label: string, iri: string, obo_id: string, ontology_name: string, synonym: array<string>, description: array<string>>>>", "a.response.docs",
        "r.label", "lower(r.ontology_name)", 1000, "r.synonym", "array_join(r.description, ' ')", obo_id="r.obo_id", iri="r.iri",
    ),
    "BioPortal": Service(
        "array<struct<annotatedClass: struct<prefLabel: string, `@id`: string, notation: string, synonym: array<string>, definition: string, links: struct<ontology: string>>>>", "a",
        "r.annotatedClass.prefLabel", "lower(element_at(split(r.annotatedClass.links.ontology, '/'), -1))", 10, "r.annotatedClass.synonym",
        "coalesce(get(from_json(r.annotatedClass.definition, 'array<string>'), 0), r.annotatedClass.definition)", obo_id="r.annotatedClass.notation", iri="r.annotatedClass.`@id`",
    ),
    "MyGene": Service(
        "hits array<struct<symbol: string, name: string, taxid: int, entrezgene: string, alias: array<string>>>", "a.hits",
        "coalesce(nullif(r.symbol, ''), nullif(r.name, ''), term)", "'mygene'", 10, "r.alias", _TAX.format("r.name", "r.taxid"), "concat('NCBIGene:', r.entrezgene)", taxid="r.taxid",
    ),
    "UniProt": Service(
        "results array<struct<primaryAccession: string, proteinDescription: struct<recommendedName: struct<fullName: struct<value: string>>>, organism: struct<scientificName: string, taxonId: int>>>", "a.results",
        "coalesce(nullif(r.proteinDescription.recommendedName.fullName.value, ''), r.primaryAccession, term)", "'uniprot'", 0, definition=_TAX.format("r.organism.scientificName", "r.organism.taxonId"), curie="concat('UniProtKB:', r.primaryAccession)", taxid="r.organism.taxonId",
    ),
    "Wikidata": Service(
        f"entities map<string, struct<labels: {_EN}, descriptions: {_EN}, aliases: struct<en: array<struct<value: string>>>>>", "map_entries(a.entities)",
        "coalesce(nullif(r.value.labels.en.value, ''), term)", "'wikidata'", 15, "transform(r.value.aliases.en, x -> x.value)", "r.value.descriptions.en.value", "concat('Wikidata:', r.key)", iri="concat('https://www.wikidata.org/wiki/', r.key)",
    ),
}


def terms_of(answers: DataFrame, service: str, body: str = "body", term: str = "term") -> DataFrame:
    """candidate_id, label, ontology_name, curie, obo_id, iri, source, synonyms, definition, taxid of the terms in a service's answers; a term once."""
    s = SERVICES[service]
    schema = s.schema if s.schema.startswith("array") else f"struct<{s.schema}>"
    parsed = answers.select(F.col(term).alias("term"), F.from_json(F.col(body).cast("string"), schema).alias("a"))
    each = parsed.select("term", F.explode(F.expr(s.terms)).alias("r"))
    none = F.expr("cast(array() as array<string>)")
    out = each.select(
        F.coalesce(F.expr(s.label), F.lit("")).alias("label"), F.coalesce(F.expr(s.ontology_name), F.lit("")).alias("ontology_name"), F.expr(s.curie).alias("curie"), F.expr(s.obo_id).alias("obo_id"),
        F.coalesce(F.expr(s.iri), F.lit("")).alias("iri"), F.lit(service).alias("source"), F.slice(F.coalesce(F.array_compact(F.expr(s.synonyms)), none), 1, max(1, s.most_synonyms)).alias("synonyms"),
        F.left(F.coalesce(F.expr(s.definition), F.lit("")), F.lit(DEFINITION)).alias("definition"), F.expr(s.taxid).alias("taxid"),
    ).where("label <> ''").distinct()
    return out.select(F.xxhash64("source", "ontology_name", "curie", "obo_id", "iri", "label").alias("candidate_id"), "*")
