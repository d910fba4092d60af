"""``python -m millrace.cli verify SOURCE COPY --key table=col,...``, ``... latency TABLE [--csv FILE] [--since SECONDS]``, and the two sides of
replication, ``... reader [--once]`` and ``... writer [--once]``, with their settings from the environment (``EngineConfig``)."""

from __future__ import annotations

import argparse
import signal
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.operators import latency, verify, wal
from millrace.sources.config import EngineConfig
from millrace.streaming import apply
from millrace.streaming.table import names


def _published(spark: SparkSession, cfg: EngineConfig) -> dict[str, list[str]]:
    """Key columns of the published tables, in order of their names."""
    rows = spark.read.schema("publication string, schema string, `table` string, pk array<string>").json(f"{cfg.source}/publication.json").filter(F.col("publication") == cfg.publication)
    found = {f"{r['schema']}.{r['table']}": list(r["pk"]) for r in rows.collect()}
    if not found:
        raise ValueError(f"publication {cfg.publication} has no tables")
    return dict(sorted(found.items()))


def run_reader(spark: SparkSession, cfg: EngineConfig, once: bool) -> None:
    """On the first start the position is pinned and the snapshot at it published, as batch -1; then, as on every start, the log behind it."""
    tables = _published(spark, cfg)
    slot, _ = apply.pin(spark, f"{cfg.checkpoint}/slot.json", cfg.snapshot_position, "snapshot")
    done = f"{cfg.topic}/batch=-1"
    if "_SUCCESS" not in names(spark, done):
        began = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())  # one time for all tables
        parts = [apply.snapshot_events(spark.read.parquet(f"{cfg.source}/{slot['version']}/{t}"), t, pk, began) for t, pk in tables.items()]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        whole.write.mode("overwrite").json(done)
    messages = apply.capture(spark, f"{cfg.source}/log", cfg.batch_files)
    none = spark.createDataFrame([], wal.MESSAGE)
    apply.start_capture(messages, none, cfg.topic, f"{cfg.checkpoint}/reader", once, slot["position"], cfg.trigger).awaitTermination()


def run_writer(spark: SparkSession, cfg: EngineConfig, once: bool) -> None:
    specs = {t: apply.TableSpec(pk) for t, pk in _published(spark, cfg).items()}
    events = apply.published(spark, cfg.topic)
    apply.start_apply(events, specs, cfg.destination, f"{cfg.checkpoint}/writer", once, cfg.trigger, buckets=cfg.buckets).awaitTermination()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace")
    sub = parser.add_subparsers(dest="command", required=True)
    v = sub.add_parser("verify", help="compare tables of two folders by count and digest")
    v.add_argument("source")
    v.add_argument("copy")
    v.add_argument("--key", action="append", required=True, metavar="TABLE=COL,COL")
    v.add_argument("--timeout", type=float, default=30.0)
    m = sub.add_parser("latency", help="commit-to-apply latency by minute")
    m.add_argument("table")
    m.add_argument("--csv")
    m.add_argument("--since", type=float, metavar="SECONDS")
    for name, what in (("reader", "publish the snapshot and the log's changes"), ("writer", "apply published changes to the destination")):
        sub.add_parser(name, help=what).add_argument("--once", action="store_true", help="stop when all there is now is done")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command in ("reader", "writer"):
        signal.signal(signal.SIGTERM, signal.default_int_handler)
        try:
            (run_reader if args.command == "reader" else run_writer)(spark, EngineConfig.load(), args.once)
        except KeyboardInterrupt:  # a clean stop: the checkpoint has what is done
            for query in spark.streams.active:
                query.stop()
        return 0
    if args.command == "verify":
        keys = {k.split("=")[0]: k.split("=")[1].split(",") for k in args.key}

        def read() -> tuple[dict, dict]:
            sides = ({}, {})
            for side, root in zip(sides, (args.source, args.copy), strict=True):
                for t in keys:
                    try:
                        side[t] = spark.read.parquet(f"{root}/{t}.parquet")
                    except Exception:  # an unreadable copy is a mismatch, an unreadable source an error
                        if root == args.source:
                            raise
            return sides

        try:
            out = verify.converge(spark, read, keys, args.timeout)
        except TimeoutError as e:
            print(e)
            return 1
        print(f"VERIFY: all {out.count()} tables MATCH")
        return 0
    df = spark.read.parquet(args.table)
    since = None if args.since is None else F.current_timestamp() - F.make_dt_interval(secs=F.lit(args.since))
    total = latency.overall(df, since).first()
    if not total["row_count"]:
        print("no rows", file=sys.stderr)
        return 1
    if args.csv:
        latency.write_csv(latency.by_minute(df, since), args.csv)
    print(f"LATENCY: {total['row_count']} rows, avg {total['avg_latency_s']:.1f} s, p95 {total['p95_max_bucket_s']:.0f} s (true {total['p95_true_s']:.0f} s), max {total['max_latency_s']:.0f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
