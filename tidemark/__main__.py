"""Command line: catalog, warehouse, offline, backfill, replay, parity, serve. Run as ``spark-submit`` or ``python -m tidemark``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidemark.operators import features, parity, warehouse
from tidemark.plans import backfill
from tidemark.plans.catalog import DEFAULT_PATH, describe, load_catalog
from tidemark.sources import readers, sinks
from tidemark.streaming.online import OnlineStore, serve


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidemark")
    commands = out.add_subparsers(dest="command", required=True)
    add = lambda name, *flags: [commands.add_parser(name)] and [commands.choices[name].add_argument(f"--{f}", **k) for f, k in flags]
    need, catalog = {"required": True}, ("catalog-path", {"default": str(DEFAULT_PATH)})
    add("catalog", catalog)
    add("warehouse", ("csv-path", need), ("output", need), ("expected-rows", {"type": int}))
    add("offline", ("facts", need), ("output", need), catalog, ("strategy", {"default": "auto", "choices": features.STRATEGIES}))
    add("backfill", ("facts", need), ("start-date", need), ("end-date", need), ("output-root", need), ("log-path", need), catalog)
    add("replay", ("facts", need), ("store", need), ("features", {"help": "where to write what each event sees"}), catalog)
    add("parity", ("facts", need), ("store", need), ("as-stored", {"action": "store_true"}), ("sample-size", {"type": int}), ("rel-tol", {"type": float, "default": 1e-9}), ("abs-tol", {"type": float, "default": 1e-9}), catalog)
    add("serve", ("store", need), ("host", {"default": "127.0.0.1"}), ("port", {"type": int, "default": 8000}), catalog)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "catalog":
        print(describe(load_catalog(args.catalog_path)))
        return 0
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    if args.command == "warehouse":
        facts = warehouse.build_transactions(readers.read_csv(spark, args.csv_path, warehouse.RAW))
        warehouse.check(facts, args.expected_rows)
        print(f"{sinks.write_facts(facts, args.output)} rows written to {args.output}")
        warehouse.profile(readers.read_facts(spark, args.output)).show(truncate=False)
        return 0
    if args.command == "serve":
        serve(OnlineStore(spark, args.store), args.host, args.port, load_catalog(args.catalog_path)).serve_forever()
        return 0
    facts, catalog = readers.read_facts(spark, args.facts), load_catalog(args.catalog_path)
    if args.command == "offline":
        print(f"{sinks.publish(features.build(facts, catalog, args.strategy), args.output)} rows written to {args.output}")
    elif args.command == "backfill":
        print(backfill.run(facts, args.start_date, args.end_date, output_root=args.output_root, log_path=args.log_path, catalog_path=args.catalog_path))
    elif args.command == "replay":
        observer = (lambda df: print(f"{sinks.publish(df, args.features)} rows written to {args.features}")) if args.features else None
        print(OnlineStore(spark, args.store).replay_facts(facts, catalog, observer))
    elif args.command == "parity":
        options = parity.ParityOptions(args.sample_size, args.rel_tol, args.abs_tol)
        result = parity.store_parity(facts, OnlineStore(spark, args.store), catalog, options, replay=not args.as_stored)
        print(f"{result.sample_count} rows, {result.comparison_count} comparisons, {result.mismatch_count} mismatches")
        if not result.ok:
            result.mismatches.show(20, truncate=False)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
