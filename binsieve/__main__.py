"""Command line: build, read and query indexes by the names of a catalog.

    python -m binsieve build-meta  --out META --path DATA [--type TYPE --dims N N ...]
    python -m binsieve build-index --meta META --var NAME --out INDEX --binning sigbits --param 32 --encoding interval
    python -m binsieve index-info  --index INDEX
    python -m binsieve query       --database FILE [--mode count|rids|stats] [--complement auto] 'lb<x<ub' 'y>3' AND

Record ids go to Parquet where ``--out`` names a folder; else rows are printed as they arrive, one partition of the result after another.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from binsieve.functions.binning import binning
from binsieve.operators.index import Index, build_index
from binsieve.operators.index_engine import IndexEngine
from binsieve.plans.encoding import ENCODINGS
from binsieve.plans.terms import parse
from binsieve.sources.database import Database, DatasetMeta, Variable
from binsieve.sources.datasets import write_rids


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="binsieve")
    tools = parser.add_subparsers(dest="tool", required=True)
    meta = tools.add_parser("build-meta", help="describe raw or Parquet data")
    meta.add_argument("--out", required=True)
    meta.add_argument("--path", required=True)
    meta.add_argument("--type", default="", help="of raw data; without it the data are Parquet")
    meta.add_argument("--dims", type=int, nargs="*", default=[])
    build = tools.add_parser("build-index", help="index one variable")
    build.add_argument("--meta", required=True)
    build.add_argument("--var", required=True)
    build.add_argument("--out", required=True)
    build.add_argument("--binning", choices=("sigbits", "precision", "explicit"), required=True)
    build.add_argument("--param", required=True, help="bits, digits, or bounds with commas between them")
    build.add_argument("--type", help="of the variable, where the meta file doesn't tell")
    build.add_argument("--encoding", choices=sorted(ENCODINGS), default="equality")
    build.add_argument("--part-size", type=int)
    build.add_argument("--offset", type=int, default=0)
    build.add_argument("--size", type=int)
    build.add_argument("--absolute", action="store_true", help="keep record ids as they are instead of counting from the offset")
    build.add_argument("--mode", choices=("errorifexists", "overwrite", "append"), default="errorifexists")
    info = tools.add_parser("index-info", help="domains, bins and bytes of each partition")
    info.add_argument("--index", required=True)
    query = tools.add_parser("query", help="answer a postfix query")
    query.add_argument("--database", required=True)
    query.add_argument("--mode", choices=("count", "rids", "stats"), default="count")
    query.add_argument("--complement", choices=("auto", "always", "never"), default="auto")
    query.add_argument("--out", help="a folder for record ids")
    query.add_argument("terms", nargs="+")
    return parser


def _parameter(name: str, text: str):
    if name != "explicit":
        return int(text)
    try:
        return [float(x) if "." in x or "e" in x.lower() else int(x) for x in text.split(",")]
    except ValueError:
        return text.split(",")


def _print(rows: DataFrame, out) -> None:
    for row in rows.toLocalIterator():
        out.write(json.dumps(row.asDict(True), default=str) + "\n")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> None:
    """Run one tool; ``spark`` and ``out`` are for callers that have a session and take the rows."""
    given = _arguments().parse_args(arguments)
    if given.tool == "build-meta":
        made = DatasetMeta("raw" if given.type else "parquet", given.path, given.type, given.dims)
        with open(given.out, "w", encoding="utf-8") as f:
            f.write(DatasetMeta.parse(made.text()).text())
        return
    spark = spark or SparkSession.builder.appName("binsieve").getOrCreate()
    if given.tool == "build-index":
        with open(given.meta, encoding="utf-8") as f:
            kind = given.type or DatasetMeta.parse(f.read()).kind or None
        data = Variable(given.var, given.meta).open_data(spark)
        own = binning(given.binning, _parameter(given.binning, given.param), kind)
        index = build_index(data, given.var, "rid", own, given.part_size, given.offset, given.size, not given.absolute)
        (index if given.encoding in ("equality", "flat") else index.encode(given.encoding)).save(given.out, given.mode)
    elif given.tool == "index-info":
        _print(Index.load(spark, given.index).info(details=True).orderBy("part_id"), out)
    else:
        query, database = parse(given.terms), Database.load(given.database)
        engine = IndexEngine({v: database.get(v).open_index(spark) for v in query.variables()}, complement=given.complement)
        if given.mode == "rids" and given.out:
            write_rids(engine.evaluate(query).select("rid"), given.out)
            return
        rows = {"count": engine.counts, "rids": engine.evaluate, "stats": engine.statistics}[given.mode](query)
        _print(rows.orderBy("part_id"), out)


if __name__ == "__main__":
    main()
