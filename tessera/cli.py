"""Command line: build, inspect, types."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tessera.functions.text import format_bytes, row_size, shorten
from tessera.operators.layout import estimate_chunks
from tessera.operators.profile import infer_schema, recommended_indexes, suggest_chunk_field
from tessera.plans.codegen import generate
from tessera.plans.model import Schema
from tessera.sources import loader
from tessera.sources.store import build

DEFAULT_CHUNK = 5 << 20


def _load(spark: SparkSession, args):
    fmt = args.format or (loader.detect_format(spark, args.input) if loader.exists(spark, args.input) else None)
    return loader.load(spark, args.input, fmt), fmt


def report(spark: SparkSession, path: str, fmt: str | None = None, sample: int = 1000, fast: bool = False) -> str:
    """What a file holds, and how it could be chunked and indexed."""
    fmt = fmt or loader.detect_format(spark, path)
    df = loader.load(spark, path, fmt)
    rows = loader.with_ordinal(loader.head(df, sample))
    n, schema = infer_schema(rows, loader.ORDINAL, loader.field_order(spark, path, fmt) or df.columns)
    size = loader.file_size(spark, path)
    if not n:
        return f"{path}: no records"
    total = loader.estimate_rows(spark, path, loader.head(df, sample), row_size(df) + 1) if fast else df.count()
    lines = [f"{path}: {fmt}, {format_bytes(size)}, {'about ' if fast else ''}{total} records, {format_bytes(size / max(1, total))} each"]
    for f in schema.fields:
        share = 100 * f.stats.cardinality / n
        span = f", {shorten(f.stats.min)} to {shorten(f.stats.max)}" if f.stats.min is not None else ""
        nulls = f", {f.stats.null_count} null" if f.stats.null_count else ""
        lines.append(f"  {f.name}: {f.type}, {f.stats.cardinality} distinct ({share:.0f} %){span}{nulls}; for example {', '.join(shorten(s) for s in f.stats.samples[:3])}")
    lines.append(f"primary: {schema.primary or 'none'}; chunk by: {suggest_chunk_field(schema, n) or 'none'}; index: {', '.join(recommended_indexes(schema)) or 'none'}")
    lines.append(f"chunks at {format_bytes(DEFAULT_CHUNK)}: {estimate_chunks(size, DEFAULT_CHUNK, total)}")
    return "\n".join(lines)


def types_of(spark: SparkSession, path: str, fmt: str | None = None, sample: int = 1000) -> str:
    df = loader.load(spark, path, fmt)
    _, schema = infer_schema(loader.with_ordinal(loader.head(df, sample)), loader.ORDINAL)
    return generate(Schema(sorted(schema.fields, key=lambda f: f.name), schema.primary))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("build", "inspect", "types"):
        p = commands.add_parser(name)
        p.add_argument("input")
        p.add_argument("-f", "--format", choices=loader.FORMATS)
        if name == "build":
            p.add_argument("-o", "--output", required=True)
            p.add_argument("-s", "--chunk-size", default="5mb")
            p.add_argument("-c", "--chunk-by")
            p.add_argument("-i", "--index", help="comma-separated fields")
        else:
            p.add_argument("-n", "--sample", type=int, default=1000)
        if name == "inspect":
            p.add_argument("--fast", action="store_true", help="estimate the number of records")
        if name == "types":
            p.add_argument("-o", "--output")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    try:
        if args.command == "build":
            df, fmt = _load(spark, args)
            indexed = [f.strip() for f in args.index.split(",") if f.strip()] if args.index is not None else None
            m = build(df, args.output, args.chunk_size, args.chunk_by, indexed, loader.field_order(spark, args.input, fmt))
            print(f"{m.total} records in {m.n_chunks} chunks, by {m.config.chunk_by or 'input order'}; index: {', '.join(m.config.indexed) or 'none'}")
        elif args.command == "inspect":
            if not loader.exists(spark, args.input):
                raise FileNotFoundError(f"no input at {args.input}")
            print(report(spark, args.input, args.format, args.sample, args.fast))
        else:
            text = types_of(spark, args.input, args.format, args.sample)
            if args.output:
                with open(args.output, "w", encoding="utf-8") as f:
                    f.write(text)
            else:
                print(text)
    except (FileNotFoundError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0
