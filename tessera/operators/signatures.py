"""Section signatures: long frames of (section, concept, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Merged concepts up to which they are sent to the signatures; parts of a concept's sections beyond.
SENT, SALTS = 1_000_000, 16
#: Entries of a task that scales signatures.
TASK_ROWS = 250_000


def normalise(entries: DataFrame, n: int | None = None) -> DataFrame:
    """Merge repeated concepts of a section and scale its weights to sum 1.

    With their number ``n`` entries are dealt by section once, to as many tasks as they need, and
    what follows section by section needs no other shuffle."""
    if n is not None:
        entries = entries.repartition(max(entries.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), "section")
    merged = entries.groupBy("section", "concept").agg(F.sum("weight").alias("w"))
    total = F.sum("w").over(Window.partitionBy("section"))
    return merged.withColumn("weight", F.try_divide("w", total)).where("weight > 0").drop("w")


def violations(signatures: DataFrame, tolerance: float = 0.01) -> DataFrame:
    sums = signatures.groupBy("section").agg(F.sum("weight").alias("weight_sum"))
    return sums.where(F.abs(F.col("weight_sum") - 1) > tolerance)


def sizes(signatures: DataFrame) -> DataFrame:
    """How many sections have signatures of each size."""
    return signatures.groupBy("section").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("sections"))


def usage(signatures: DataFrame) -> DataFrame:
    """Per concept: influence (summed weight), usage (sections) and mean weight."""
    return signatures.groupBy("concept").agg(
        F.round(F.sum("weight"), 6).alias("influence"), F.count("*").alias("usage"), F.round(F.avg("weight"), 6).alias("mean_weight")
    )


def top_concepts(signatures: DataFrame, k: int = 40) -> DataFrame:
    return usage(signatures).orderBy(F.desc("usage"), "concept").limit(k)


def reuse_buckets(signatures: DataFrame, edges=(1, 5, 20)) -> DataFrame:
    """Concepts by how often they are used: once, then up to each bound, then more."""
    n = signatures.groupBy("concept").agg(F.count("*").alias("n"))
    names, low = F.lit(f">{edges[-1]}"), 0
    for e in reversed(edges):
        names = F.when(F.col("n") <= e, F.lit(f"<={e}")).otherwise(names)
    return n.groupBy(names.alias("bucket")).agg(F.count("*").alias("concepts"))


def spans(signatures: DataFrame, sections: DataFrame) -> DataFrame:
    """In how many sources each concept occurs, and how many concepts span each number."""
    per = signatures.join(sections.select("section", "source"), "section").groupBy("concept").agg(F.count_distinct("source").alias("sources"))
    return per.groupBy("sources").agg(F.count("*").alias("concepts"))


def exemplars(signatures: DataFrame, k: int = 3) -> DataFrame:
    """The k sections where a concept weighs most."""
    rank = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("weight"), "section"))
    return signatures.withColumn("rank", rank).where(F.col("rank") <= k)


def samples(signatures: DataFrame, sections: DataFrame, k: int = 3) -> DataFrame:
    """The last k sections of each source in reading order, with a readable signature."""
    signed = sections.join(signatures.select("section").distinct(), "section", "left_semi")
    last = Window.partitionBy("source").orderBy(F.desc("seq"), F.desc("section"))
    picked = signed.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    parts = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "concept")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["concept"].cast("string"), F.lit("="), F.format_string("%.2f", -p["w"]))), ", ")
    return picked.join(signatures, "section").groupBy("source", "rank", "section").agg(text.alias("signature"))


def too_common(signatures: DataFrame, share: float = 0.5) -> DataFrame:
    """Concepts present in more than a share of all sections."""
    total = signatures.agg(F.count_distinct("section").alias("total"))
    n = signatures.groupBy("concept").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(total)).where(F.col("n") / F.col("total") > share).select("concept", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def query_signature(scores: DataFrame, k: int = 6, floor: float = 0.40) -> DataFrame:
    """(query, concept, score) -> the k best at or over the floor, scaled to sum 1."""
    best = Window.partitionBy("query").orderBy(F.desc("score"), "concept")
    top = scores.where(F.round("score", 9) >= floor).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select("query", "concept", (F.col("score") / F.sum("score").over(Window.partitionBy("query"))).alias("weight"))


def rank_sections(queries: DataFrame, signatures: DataFrame, k: int = 30) -> DataFrame:
    """Sections by min-sum overlap with each query signature."""
    overlap = F.sum(F.least("q_weight", "weight"))
    got = queries.withColumnRenamed("weight", "q_weight").join(signatures, "concept").groupBy("query", "section").agg(overlap.alias("overlap"))
    best = Window.partitionBy("query").orderBy(F.desc(F.round("overlap", 9)), "section")
    return got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def repoint(signatures: DataFrame, winners: DataFrame) -> DataFrame:
    """Move weights of merged concepts, (concept, winner), to their winners and add them up.

    A concept may stand in very many sections, so signatures are not dealt by concept: up to
    ``SENT`` winners go to them. More of them are joined by concept and one of ``SALTS`` parts of
    its sections."""
    if winners.limit(SENT + 1).count() <= SENT:
        moved = signatures.join(F.broadcast(winners), "concept", "left")
    else:
        each = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("section"), F.lit(SALTS)).cast("int")
        moved = signatures.withColumn("salt", salt).join(each, ["concept", "salt"], "left").drop("salt")
    moved = moved.withColumn("concept", F.coalesce("winner", "concept"))
    return moved.groupBy("section", "concept").agg(F.sum("weight").alias("weight"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Union in which of each key the row with the greatest order wins."""
    latest = Window.partitionBy(*keys).orderBy(order)
    return old.unionByName(new).withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r")
