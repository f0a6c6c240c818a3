"""Thin commands over the operators: ``python -m sillok.cli COMMAND``. Results are JSON lines on stdout, errors one JSON line on stderr with exit code 2."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillok.functions import text
from sillok.operators import catalog, scoring
from sillok.session import local_session
from sillok.sources import listings, profiles, sinks


def _show(df: DataFrame) -> None:
    for row in sinks.to_json(df).toLocalIterator():
        print(row[0])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sillok")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [p := sub.add_parser(name), [p.add_argument(a, **k) for a, k in args]]
    companies, portals = ("--companies", {"required": True}), ("--portals", {"required": True})
    add("sources", companies, portals, ("--select", {"nargs": "*", "default": []}))
    add("check-catalog", companies)
    add("discover", companies, portals, ("--query", {"required": True}))
    add("merge", ("fresh", {}), ("--into", {"required": True}))
    add("rank", ("postings", {}), ("--profile", {"required": True}), ("--key", {"default": "ordinal"}), ("--top", {"type": int, "default": 5}))
    add("answers-check", ("file", {}), ("--limit", {"type": int, "required": True}), ("--mode", {"default": "codepoints"}), ("--newlines", {"default": "lf", "choices": ["lf", "crlf"]}))
    add("jobs", ("path", {}))
    return top


def run(args: argparse.Namespace) -> int:
    spark = local_session(name=f"sillok {args.command}")
    read = spark.read.parquet
    if args.command in ("sources", "discover"):
        sources = catalog.all_sources(read(args.companies), read(args.portals))
        if args.command == "discover":
            _show(catalog.discovery_plan(sources, args.query))
        elif args.select:
            _show(catalog.resolve(sources, spark.createDataFrame([(s,) for s in args.select], "selector string")))
        else:
            _show(sources)
    elif args.command == "check-catalog":
        found = catalog.violations(read(args.companies))
        _show(found)
        return int(not found.isEmpty())
    elif args.command == "merge":
        _show(sinks.save_observations(read(args.fresh), args.into).agg(F.count(F.lit(1)).alias("postings"), F.sum("observations").alias("observations")))
    elif args.command == "rank":
        _show(scoring.top(scoring.scored(read(args.postings), profiles.read_profile(args.profile), args.key), args.key, args.top))
    elif args.command == "answers-check":
        with open(args.file, encoding="utf-8", newline="") as f:
            row = spark.createDataFrame([(f.read(),)], "t string").select(text.check_answer(F.col("t"), args.limit, args.mode, rule=args.newlines).alias("r"))
        _show(row.select("r.*"))
        return int(not row.first()["r"]["ok"])
    elif args.command == "jobs":
        _show(listings.read_jobs(spark, args.path).select("file", "ordinal", F.to_json("job").alias("job"), "parse_error"))
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except (OSError, ValueError, RuntimeError, PySparkException) as e:
        print(json.dumps({"error": str(e)[:500]}, ensure_ascii=False), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
