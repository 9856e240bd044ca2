"""Entry points: replay stored events into features, compaction, audits, comparison; also a command line.

    python -m tickframe.plans.replay replay --tables DIR --output DIR [--start-us N] [--end-us N]
    python -m tickframe.plans.replay audit-features --input DIR [--first-tick N] [--last-tick N] [--exchanges A,B]
        [--symbols S,T] [--windows 1,6] [--engine-version V] [--config-hash H] [--warm yes|no] [--healthy yes|no] [--reasons R,S]
    python -m tickframe.plans.replay compare-features --left DIR --right DIR
    python -m tickframe.plans.replay compact-raw --input DIR --output DIR [--target-rows N]

Exit codes: 0 done, 1 trees differ, 2 wrong use or failure, 130 interrupted.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.config import DEMO, Config, fingerprint, source_hash
from tickframe.functions import scalars as S
from tickframe.operators import audit, cross, features
from tickframe.sources import raw

ENGINE_VERSION = "1"


def persistable(snapshots: DataFrame, cfg: Config) -> DataFrame:
    """Snapshots with payload, its digest, and what they were made with."""
    names = sorted(c for c in snapshots.columns)
    payload = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return snapshots.withColumn("payload_json", payload).withColumn("payload_sha256", F.sha2("payload_json", 256)).withColumn("config_hash", F.lit(fingerprint(cfg))).withColumn("engine_version", F.lit(ENGINE_VERSION))


def runtime_lineage(cfg: Config) -> dict[str, str]:
    """What a capture must have been made with to be replayed here (``raw.check_lineage``)."""
    return {"engine_version": ENGINE_VERSION, "code_sha256": source_hash(), "settings_sha256": fingerprint(cfg)}


def replay(spark: SparkSession, tables: str, output: str, cfg: Config = DEMO, start_us: int | None = None, end_us: int | None = None) -> None:
    """Features of all decisions, both scopes, into an idempotent tree; receive times within the inclusive range."""
    single = features.kept(features.single_venue(features.Inputs(spark, tables, cfg, start_us, end_us)))
    audit.append_features(persistable(single, cfg), f"{output}/single")
    both = cross.cross_venue(single, cfg).withColumn("exchange", F.lit("CROSS"))
    both = both.withColumn("snapshot_id", S.uuid5(S.canonical_text(F.lit("CROSS"), "symbol", "window_ticks", "tick_no")))
    audit.append_features(persistable(both, cfg), f"{output}/cross")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tickframe")
    sub = p.add_subparsers(dest="command", required=True)
    for name, options in {"replay": ("tables", "output"), "audit-features": ("input",), "compare-features": ("left", "right"), "compact-raw": ("input", "output")}.items():
        s = sub.add_parser(name)
        for o in options:
            s.add_argument(f"--{o}", required=True)
        if name == "compact-raw":
            s.add_argument("--target-rows", type=int, default=100_000)
        elif name == "replay":
            s.add_argument("--start-us", type=int)
            s.add_argument("--end-us", type=int)
        elif name == "audit-features":
            texts = lambda x: frozenset(x.split(","))
            kinds = {"first-tick": int, "last-tick": int, "exchanges": texts, "symbols": texts, "windows": lambda x: frozenset(map(int, x.split(","))), "engine-version": str, "config-hash": str, "reasons": texts}
            for o, kind in kinds.items():
                s.add_argument(f"--{o}", type=kind)
            for o in ("warm", "healthy"):
                s.add_argument(f"--{o}", type={"yes": True, "no": False}.__getitem__)
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0) and 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if a.command == "replay":
            replay(spark, a.tables, a.output, start_us=a.start_us, end_us=a.end_us)
        elif a.command == "audit-features":
            wanted = audit.SnapshotFilter(**{f.name: getattr(a, f.name) for f in fields(audit.SnapshotFilter)})
            audit.feature_audit(wanted.applied(spark.read.parquet(a.input))).show(truncate=False)
        elif a.command == "compare-features":
            left, right = spark.read.parquet(a.left), spark.read.parquet(a.right)
            n = audit.differences(left.select("snapshot_id", "payload_sha256"), right.select("snapshot_id", "payload_sha256")).count()
            print(f"{n} differences")
            return int(n > 0)
        else:
            df = raw.read(spark, a.input)
            audit.compact(df, a.output, ["exchange", "symbol", "channel"], ["local_receive_timestamp", "record_id"], "record_id", F.col("raw_payload"), F.concat_ws("/", "exchange", "symbol", "channel"), a.target_rows).show(truncate=False)
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001
        print(f"failed: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
