"""Health of runs: measures at each finished section of a run's log, and their verdicts.

A log has a row for each event: ``run``, ``event_id``, ``ts``, ``kind`` ("done", "empty" or
"retry"), ``section``, ``minted`` (concepts that a finished section brought), ``elapsed``
(seconds) and ``concept`` (its leading one)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: When a run is stopped (A) or watched (W); fixed values of the health rules.
LIMITS = {
    "stall_minutes": 15.0,
    "empty_after": 30, "empty_abort": 0.05, "empty_warn": 0.02,
    "registry_cap": 2000, "mint_after": 150, "mint_most": 35,
    "pace_after": 20, "pace_abort": 300.0, "pace_warn": 150.0,
    "stop_after": 60, "stop_share": 0.5,
    "retry_after": 30, "retry_share": 0.4,
    "twins_most": 5,
}
#: Finished sections that mint and retry, and that pace look back on.
RECENT, PACE = 100, 20
MEASURES = "run long, event_id long, ts timestamp, done long, empty long, registry long, silent_seconds long, mint long, pace double, stop long, recent long, retried long"


def clean(log: DataFrame) -> DataFrame:
    """Rows without run, id, time or kind go; other nulls are 0, section -1 or the concept ''."""
    known = log.where("run IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL AND kind IS NOT NULL")
    return known.fillna({"minted": 0, "elapsed": 0.0, "section": -1, "concept": ""})


def measures(log: DataFrame) -> DataFrame:
    """One row for each "done" event, of what was known then: all by windows over the run.

    ``retried`` counts the distinct sections of the last ``RECENT`` that had a retry before;
    ``stop`` is the number of sections of the concept that has most; nulls are as in ``clean``."""
    log = clean(log)
    at = F.struct("ts", "event_id")
    order = Window.partitionBy("run").orderBy("ts", "event_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda kind: (F.col("kind") == kind).cast("long")
    rows = log.withColumns({
        "silent_seconds": F.floor((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))) / 1e6).cast("long"),
        "empty": F.sum(is_("empty")).over(so_far),
        "registry": F.sum(F.when(F.col("kind") == "done", F.col("minted")).otherwise(0).cast("long")).over(so_far),
        "first": F.min(F.when(F.col("kind") == "retry", at)).over(Window.partitionBy("run", "section")),
    })
    rows = rows.where("kind = 'done'").withColumn("used", F.count("*").over(Window.partitionBy("run", "concept").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    recent = order.rowsBetween(1 - RECENT, 0)
    times = F.sort_array(F.collect_list("elapsed").over(order.rowsBetween(1 - PACE, 0)))
    n = F.size(times)
    rows = rows.withColumns({
        "done": F.row_number().over(order).cast("long"),
        "mint": F.sum("minted").over(recent).cast("long"),
        "pace": F.round((F.get(times, F.floor((n - 1) / 2).cast("int")) + F.get(times, F.floor(n / 2).cast("int"))) / 2, 4),
        "stop": F.max("used").over(so_far),
        "last": F.collect_set(F.struct("section", "first")).over(recent),
    })
    return rows.select(
        "run", "event_id", "ts", "done", "empty", "registry", "silent_seconds", "mint", "pace", "stop",
        F.size("last").cast("long").alias("recent"), F.size(F.filter("last", lambda x: x["first"] < at)).cast("long").alias("retried"),
    )


def verdicts(rows: DataFrame, limits: dict | None = None, twins: Column | None = None) -> DataFrame:
    """Adds ``findings``, codes in order, and ``level``: 2 with a finding A (stop), 1 with one W
    (watch), else 0. ``twins`` is the number of pairs of nearly equal concepts."""
    p = LIMITS | (limits or {})
    c = F.col
    empty = F.try_divide("empty", c("done") + c("empty"))
    asked = (c("done") + c("empty")) >= p["empty_after"]
    pace, mint = c("done") >= p["pace_after"], (c("done") >= p["mint_after"]) & (c("mint") > p["mint_most"])
    rules = {
        "A1": c("silent_seconds") > 60 * p["stall_minutes"],
        "A2": asked & (empty > p["empty_abort"]),
        "A3": (c("registry") > p["registry_cap"]) | mint,
        "A4": pace & (c("pace") > p["pace_abort"]),
        "W0": asked & (empty > p["empty_warn"]) & (empty <= p["empty_abort"]),
        "W1": (c("done") >= p["stop_after"]) & (c("stop") / c("done") > p["stop_share"]),
        "W2": (c("done") >= p["retry_after"]) & (c("retried") / c("recent") > p["retry_share"]),
        "W3": pace & (c("pace") > p["pace_warn"]) & (c("pace") <= p["pace_abort"]),
        "W4": F.lit(False) if twins is None else twins > p["twins_most"],
    }
    found = F.concat_ws(",", *[F.when(rule, F.lit(code)) for code, rule in rules.items()])
    level = F.when(F.contains("findings", F.lit("A")), 2).when(F.col("findings") != "", 1).otherwise(0)
    return rows.withColumn("findings", found).withColumn("level", level)


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each run."""
    return rows.groupBy("run").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "run"]), F.struct("ts", "event_id")).alias("r")).select("run", "r.*")
