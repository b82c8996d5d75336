"""Watch the runs of an event log: a stream that takes what is new and stops.

    python -m jobs.run_watch --events PATH --out PATH --checkpoint PATH [--config FILE]

``events`` is a folder of Parquet files that grows (or one file). Each start takes the files that
the checkpoint does not know, carries the state of every run on, and appends a row for each
finished section, with measures, findings and level, to ``out/sections`` (partitioned by day); then
it writes the latest row of each run to ``out/runs`` (partitioned by level) anew. A restart after
a failure repeats the unfinished batch; a start without new files changes nothing.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import watch
from tessera.streaming import watch as stream

log = logging.getLogger("jobs.run_watch")
CONFIG = Path(__file__).with_suffix(".json")


def config(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def events_log(events: DataFrame, conf: dict) -> DataFrame:
    """The log of runs that the config's expressions make of an event table."""
    names = ("run", "kind", "section", "minted", "elapsed", "concept")
    types = {"run": "long", "section": "long", "minted": "long", "elapsed": "double"}
    made = [F.expr(conf[f"{n}_of"]).cast(types.get(n, "string")).alias(n) for n in names]
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), *made)


def run(spark: SparkSession, events: str, out: str, checkpoint: str, conf: dict | None = None) -> dict:
    """Takes what is new in ``events``; the numbers of rows read and written."""
    conf = conf or config()
    before = {k: spark.conf.get(k, None) for k in stream.STORE}
    for k, v in stream.STORE.items():
        spark.conf.set(k, v)
    try:
        folder, _, name = events.rstrip("/").rpartition("/")
        # as a pattern: a stream takes a single file by a pattern only
        source = spark.readStream.schema(spark.read.parquet(events).schema).option("maxFilesPerTrigger", conf["files_a_batch"]).parquet(f"{folder}/{{{name}}}")
        rows = watch.verdicts(stream.measures(events_log(source, conf)), conf["limits"]).withColumn("day", F.to_date("ts"))
        query = (
            rows.writeStream.format("parquet").partitionBy("day").option("checkpointLocation", checkpoint)
            .option("path", f"{out}/sections").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        read = sum(p["numInputRows"] for p in query.recentProgress)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    log.info("read %d new events from %s in %d batches", read, events, len(query.recentProgress))
    found = sections(spark, out)
    runs = watch.latest(found.drop("day"))
    runs.write.mode("overwrite").partitionBy("level").parquet(f"{out}/runs")
    levels = {r["level"]: r["count"] for r in spark.read.parquet(f"{out}/runs").groupBy("level").count().collect()}
    total = found.count()
    log.info("%s holds %d sections; runs by level: %s", out, total, levels)
    return {"read": read, "sections": total, "levels": levels}


def sections(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/sections")


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("events", "out", "checkpoint"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config", default=CONFIG)
    got = args.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("run_watch").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, got.events, got.out, got.checkpoint, config(got.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
