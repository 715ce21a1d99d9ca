"""Readers and writers: delimited text with a guessed delimiter, JSON maps, XML records, images, manifests."""

from __future__ import annotations

import csv
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLES = "map<string, struct<title: string, paragraphs: array<string>>>"
CATEGORIES = "map<string, array<string>>"
DELIMITERS = ",;\t|"


def sniff(spark: SparkSession, path: str, size: int = 2048) -> str:
    """The delimiter of a file by its first lines, comma where they tell none. Spark reads them, wherever the file lies."""
    sample = "\n".join(r.value for r in spark.read.text(path).limit(20).collect())[:size]  # twenty lines
    try:
        return csv.Sniffer().sniff(sample, delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, schema: str | None = None) -> DataFrame:
    """A table with a header. Without a schema all columns are strings: numbers are cast where they are used."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path, sep=sep or sniff(spark, path))


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet, where a reader for it is installed; such files are small."""
    import pandas as pd

    try:
        frame = pd.read_excel(path, sheet_name=sheet, dtype=str)
    except ImportError as e:
        raise ValueError("reading Excel files needs openpyxl; write the sheet as CSV") from e
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None))


READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": read_delimited,
    "txt": read_delimited,
    "tsv": lambda s, p, **k: read_delimited(s, p, "\t", **k),
    "pipe": lambda s, p, **k: read_delimited(s, p, "|", **k),
    "psv": lambda s, p, **k: read_delimited(s, p, "|", **k),
    "xlsx": read_excel,
    "xls": read_excel,
    "parquet": lambda s, p: s.read.parquet(p),
    "json": lambda s, p: s.read.json(p),
    "orc": lambda s, p: s.read.orc(p),
}


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """By the file's extension; an error for one that isn't known."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind not in READERS:
        raise ValueError(f"no reader for {path!r}; known: {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path, **options)


def read_map(spark: SparkSession, path: str, kind: str, name: str) -> DataFrame:
    """A JSON object whose keys are data, as one map column; a file is one document."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias(name))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return read_map(spark, path, ARTICLES, "articles")


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    return read_map(spark, path, CATEGORIES, "categories")


def write_categories(terms: DataFrame, path: str) -> None:
    """category and terms (array) as one JSON object; a dictionary of some thousand words."""
    whole = terms.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "terms"))))).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


DESCRIPTOR = "DescriptorName struct<String: string>, ConceptList struct<Concept: array<struct<TermList: struct<Term: array<struct<String: string>>>>>>"


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """name and terms of each record of a descriptor file."""
    raw = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(DESCRIPTOR).load(path)
    lists = F.coalesce("ConceptList.Concept", F.expr("cast(array() as array<struct<TermList: struct<Term: array<struct<String: string>>>>>)"))
    terms = F.flatten(F.transform(lists, lambda c: F.coalesce(F.transform(c.TermList.Term, lambda t: t.String), F.expr("cast(array() as array<string>)"))))
    return raw.select(F.col("DescriptorName.String").alias("name"), terms.alias("terms"))


def read_images(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg,tif,tiff}") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def manifest(fetched: DataFrame) -> DataFrame:
    """Number, addresses, status, SHA-256 and time of fetched files (image_number, original_url, github_url, http_status, content)."""
    good = F.col("http_status") == "200"
    return fetched.select("image_number", "original_url", "github_url", F.coalesce("http_status", F.lit("error")).alias("http_status"), F.when(good, F.sha2("content", 256)).otherwise("N/A").alias("sha256"), F.current_timestamp().alias("timestamp"))


def prompt(template: str, **columns: str) -> F.Column:
    """A template with {name} in places, filled from columns."""
    out = F.lit(template)
    for name, column in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return out


#: Rows of a sheet, the header's included.
SHEET_ROWS = 1_048_576


def write_excel(df: DataFrame, path: str) -> None:
    """A sheet, on the driver: an error beyond the rows that a sheet holds, or where no writer is installed."""
    rows = df.limit(SHEET_ROWS).toPandas()
    if len(rows) == SHEET_ROWS:
        raise ValueError(f"a sheet holds {SHEET_ROWS - 1} rows; write another kind")
    try:
        rows.to_excel(path, index=False)
    except ImportError as e:
        raise ValueError("writing Excel files needs openpyxl; write CSV") from e


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)  # quotes are doubled, as the reader takes them
    elif kind == "xlsx":
        write_excel(df, path)
    elif kind in ("parquet", "json", "orc"):
        writer.format(kind).save(path)
    else:
        raise ValueError(f"no writer for {kind!r}")


def find_input(spark: SparkSession, folder: str, names: list[str]) -> str | None:
    """The shallowest file below a folder that has one of the names; of several as deep, the first by name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    found, it = [], files.listFiles(path, True)
    while it.hasNext():
        p = str(it.next().getPath())
        if p.rpartition("/")[2] in names:
            found.append(p)
    return min(found, key=lambda p: (p.count("/"), p), default=None)
