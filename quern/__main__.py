"""Runs a query of this package over a folder of tables: python -m quern QUERY FOLDER [--config FILE] [--out PATH] [--dry-run].

The configuration is an INI file whose section [spark] holds settings of the session, and whose section [run] may hold folder and out.
A dry run prints the plan and writes nothing; without --out twenty rows are printed.
"""

from __future__ import annotations

import argparse
import configparser

from quern.plans.table_queries import QUERIES
from quern.session import session
from quern.sources.files import write_table


def settings(path: str | None) -> configparser.ConfigParser:
    found = configparser.ConfigParser()
    found.optionxform = str  # settings of Spark keep their case
    if path and not found.read(path):
        raise FileNotFoundError(path)
    return found


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quern", description=__doc__)
    parser.add_argument("query", choices=sorted(QUERIES), metavar="QUERY")
    parser.add_argument("folder", nargs="?", help="folder of Parquet tables")
    parser.add_argument("--config", help="INI file")
    parser.add_argument("--out", help="path to write to; the kind goes by its extension, Parquet without one")
    parser.add_argument("--dry-run", action="store_true")
    given = parser.parse_args(arguments)
    config = settings(given.config)
    folder, out = given.folder or config.get("run", "folder", fallback=None), given.out or config.get("run", "out", fallback=None)
    if not folder:
        parser.error("no folder")
    spark = session(name=given.query, **{k.replace(".", "__"): v for k, v in (config.items("spark") if config.has_section("spark") else [])})
    result = QUERIES[given.query](spark, folder)
    if given.dry_run:
        result.explain("formatted")
    elif out:
        kind = out.rpartition(".")[2].lower()
        write_table(result, out, kind if kind in ("csv", "json", "orc", "xlsx") else "parquet")
    else:
        result.show(20, truncate=False)


if __name__ == "__main__":
    main()
