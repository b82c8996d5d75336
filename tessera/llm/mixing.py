"""Mixing sources to target weights by a low-discrepancy schedule (built-in functions only).

Sources, in code-point order with null last, weigh 3, 1, 2 and so on in turn and share
``share`` times all sizes; a target stops at ``most`` times its source's size and the
excess is shared anew by weight (water filling, solved in closed form on one row per
source). The slot points frac(t * golden ratio) are mapped through the cumulative
targets, so every stretch of the schedule holds the sources in proportion. A slot's rank
within its source names the block of ``block`` words it takes: blocks cut the source's
hash-shuffled text stream, and rank r takes block r modulo the number of blocks, in the
next pass. A source's schedule ends where its target is met, its last slot cut to fit.

A hot source is no hot key: streams are summed in two steps, over hash buckets and
within them, and ranks over ranges of slots and within them.

Null and empty texts have size 0 and take 0. Repeated rows are each a document of their
own. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, word_count

BLOCK = 64
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
GOLDEN = (math.sqrt(5) - 1) / 2


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> DataFrame:
    """``sizes(source, source_size)``, one row per source, with number, weight, target."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("number", F.row_number().over(place) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("number") % len(weights) + 1))
    s = s.withColumns({"cap": most * F.col("source_size"), "ratio": most * F.col("source_size").cast("double") / F.col("weight")})
    up = Window.orderBy("ratio", "number")
    every = Window.partitionBy(F.lit(1))
    s = s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
    s = s.withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        / F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)),
    )
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every)
    return s.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select(
        "source", "source_size", "number", "target"
    )


def _streams(docs: DataFrame) -> DataFrame:
    """One small row per document with its offset in its source's shuffled stream."""
    rows = docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), word_count(F.col("text")).alias("size"))
    rows = rows.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = materialize(rows.withColumn("bucket", F.substring("key", 1, 3)), "mixing-sizes")
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("source", "bucket").orderBy("key", "text_md5", "doc_id", "size")
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    at = F.col("base") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    copy = F.row_number().over(Window.partitionBy("source", "bucket", "key", "text_md5", "doc_id").orderBy("size"))
    return rows.select("doc_id", "source", "text_md5", "size", at.alias("offset"), copy.alias("copy"))


def _slots(plan: DataFrame, n_slots: int, block: int) -> DataFrame:
    """The schedule: (number, t, rank, block_no, words, of_pass), ranks dense per source."""
    spark = plan.sparkSession
    cells = 4096
    # the points, mapped through the cumulative targets by an equi-join on cells
    up = Window.orderBy("number")
    cum = F.sum("target").over(up) / F.sum("target").over(Window.partitionBy(F.lit(1)))
    spans = plan.where("slots > 0").withColumn("hi", cum)
    spans = spans.withColumn("lo", F.coalesce(F.lag("hi").over(up), F.lit(0.0)))
    spans = spans.select("number", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell"))
    points = spark.range(n_slots).withColumnRenamed("id", "t")
    points = points.withColumn("u", F.col("t") * F.lit(GOLDEN) - F.floor(F.col("t") * F.lit(GOLDEN)))
    points = points.withColumn("cell", F.floor(F.col("u") * cells))
    stretch = max(1, math.isqrt(n_slots))
    hits = points.join(spans, "cell").where("lo <= u AND u < hi").select("number", "t", F.floor(F.col("t") / stretch).alias("stretch"))
    counts = hits.groupBy("number", "stretch").agg(F.count("*").alias("n"))
    counts = materialize(counts, "mixing-hits")
    before = Window.partitionBy("number").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("number", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.col("base") + F.row_number().over(Window.partitionBy("number", "stretch").orderBy("t")) - 1
    ranked = hits.join(base, ["number", "stretch"]).select("number", F.col("t").cast("long"), rank.alias("rank"))
    # sources that the points leave a few slots short of their target get them at the end
    served = counts.groupBy("number").agg(F.sum("n").alias("served"))
    short = (
        plan.where("slots > 0")
        .join(served, "number", "left")
        .withColumn("served", F.coalesce("served", F.lit(0)))
        .where("served < slots")
        .select("number", F.lit(n_slots).cast("long").alias("t"), F.explode(F.sequence("served", F.col("slots") - 1)).alias("rank"))
    )
    slots = ranked.unionByName(short).join(plan.select("number", "slots", "blocks", "rest"), "number").where("rank < slots")
    last = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0)
    return slots.select(
        "number",
        "t",
        "rank",
        F.floor(F.col("rank") / F.col("blocks")).alias("of_pass"),
        (F.col("rank") % F.col("blocks")).alias("block_no"),
        F.when(last, F.col("rest") - F.floor((F.col("rest") - 1) / block) * block).otherwise(F.lit(block)).alias("words"),
    )


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights=WEIGHTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(documents, takes): each document with its size and its source's target, and the
    word ranges that the schedule takes of it, (.., of_pass, first_slot, start, stop)."""
    streams = materialize(_streams(docs), "mixing-streams")
    sizes = streams.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, share, most, weights).withColumn("take", F.floor(F.col("target") + 0.5))
    passes, rest = F.floor(F.col("take") / F.col("source_size")), F.col("take") % F.col("source_size")
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / block))
    plan = plan.withColumn("rest", F.when(F.col("source_size") > 0, rest).otherwise(0))
    plan = plan.withColumn("slots", F.when(F.col("source_size") > 0, passes * F.col("blocks") + F.ceil(F.col("rest") / block)).otherwise(0).cast("long"))
    plan = materialize(plan, "mixing-plan")
    n_slots = plan.agg(F.sum("slots")).first()[0] or 0
    known = streams.join(
        plan.select(F.col("source").alias("s"), "source_size", "number", "target"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")
    pieces = known.where("size > 0").withColumn(
        "block_no", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block)))
    )
    from_ = F.greatest("offset", F.col("block_no") * block)
    to = F.least(F.col("offset") + F.col("size"), F.col("block_no") * block + F.col("words"))
    takes = (
        pieces.join(_slots(plan, n_slots, block), ["number", "block_no"])
        .select("number", "offset", "of_pass", "t", (from_ - F.col("offset")).alias("start"), (to - F.col("offset")).alias("stop"))
        .where("stop > start")
        .groupBy("number", "offset", "of_pass")
        .agg(F.min("t").alias("first_slot"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    )
    return known, takes


def taken(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each document."""
    known, takes = mix(docs, **how)
    words = takes.groupBy("number", "offset").agg(F.sum(F.col("stop") - F.col("start")).alias("taken"))
    words = words.withColumnsRenamed({"number": "n2", "offset": "o2"})
    hit = (F.col("number") == F.col("n2")) & (F.col("offset") == F.col("o2")) & (F.col("size") > 0)
    return known.join(words, hit, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: the columns of ``docs``, a row for each pass over a document.

    A text that a pass takes in part is cut at words; the rest of a row is unchanged
    (``n_chars``, if there, follows the text). Documents that are not taken go."""
    known, takes = mix(docs, **how)
    keys = ["source", "doc_id", "text_md5"]
    part = F.struct("copy", "of_pass", "start", "stop", "size", "first_slot")
    lists = known.where("size > 0").join(takes, ["number", "offset"]).groupBy(*keys).agg(F.collect_list(part).alias("takes"))
    lists = lists.withColumnsRenamed({k: f"{k}_" for k in keys})
    rows = docs.select(F.struct("*").alias("row"), "source", "doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))).drop("text")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    rows = rows.join(lists, same[0] & same[1] & same[2])
    rows = rows.withColumn("take", F.explode(F.filter("takes", lambda x: x["copy"] == F.col("copy"))))
    chunks = F.regexp_extract_all("row.text", F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.array_join(F.slice(chunks, F.col("take.start") + 1, F.col("take.stop") - F.col("take.start")), "")
    whole = F.col("take.stop") - F.col("take.start") == F.col("take.size")
    # each file is laid out by the schedule, and holds a part of every stretch of it
    rows = rows.withColumn("cut", F.when(whole, F.col("row.text")).otherwise(cut)).sortWithinPartitions("take.first_slot", *keys)
    made = {"text": F.col("cut"), "n_chars": F.length("cut").cast("long")}
    return rows.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
