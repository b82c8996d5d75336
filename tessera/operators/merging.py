"""The merge pass over a registry: shortlist, decisions, groups, re-pointing and census."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import written
from . import signatures as S
from .registry import closure
from .vectors import similar_pairs

#: Cosine from which a pair is looked at, and from which it is merged without an answer.
SHORTLIST, MECHANICAL = 0.82, 0.93


def usage(signatures: DataFrame) -> DataFrame:
    """(concept, n): the sections that use a concept."""
    return signatures.groupBy("concept").agg(F.count("*").alias("n"))


def shortlist(concepts: DataFrame, used: DataFrame, floor: float = SHORTLIST) -> DataFrame:
    """Pairs a < b of ``concepts(id, v)`` at the floor or over it, with how often each is used. They are
    written out: what follows reads them several times, and the vectors are compared once."""
    of = lambda end: used.select(F.col("concept").alias(end), F.col("n").alias(f"n_{end}"))
    rows = similar_pairs(concepts, floor).join(of("a"), "a", "left").join(of("b"), "b", "left")
    return written(rows.select("a", "b", "score", *[F.coalesce(f"n_{x}", F.lit(0)).alias(f"n_{x}") for x in "ab"]), "shortlist")


def decide(pairs: DataFrame, answers: DataFrame | None = None, mechanical: float = MECHANICAL) -> DataFrame:
    """(a, b, score, how, loser, winner) of a shortlist. ``answers(a, b, merge)`` say what to do with a
    pair, whichever way it is written; without an answer it is merged from ``mechanical`` on. The
    more used one wins, then the smaller; of a pair that is kept both are null."""
    if answers is None:
        rows = pairs.withColumn("merge", F.lit(None).cast("boolean"))
    else:
        known = answers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "merge").groupBy("a", "b").agg(F.bool_and("merge").alias("merge"))
        rows = pairs.join(known, ["a", "b"], "left")
    merged = F.coalesce("merge", F.col("score") >= mechanical)
    first = F.col("n_a") >= F.col("n_b")
    return rows.select(
        "a", "b", "score", F.when(F.col("merge").isNull(), "mechanical").otherwise("answer").alias("how"),
        F.when(merged, F.when(first, F.col("b")).otherwise(F.col("a"))).alias("loser"), F.when(merged, F.when(first, F.col("a")).otherwise(F.col("b"))).alias("winner"),
    )


def apply(spark, signatures: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signatures re-pointed to the winners of their groups, weights of one section and concept
    added up, and (concept, winner) of all that lost. Of a chain, a cycle or two winners the most
    used concept of the group wins."""
    merges = written(decisions.where("loser IS NOT NULL").select("loser", "winner"), "merges")
    winners = written(closure(spark, merges, usage(signatures)), "winners")
    return S.repoint(signatures, winners), winners


def census(before: DataFrame, after: DataFrame, winners: DataFrame) -> DataFrame:
    """(concept, winner, n, n_after) of every concept that was used: its group's winner (itself if it
    lost nothing), its sections before, and its winner's sections after."""
    rows = usage(before).join(winners, "concept", "left").withColumn("winner", F.coalesce("winner", "concept"))
    return rows.join(usage(after).toDF("winner", "n_after"), "winner", "left").select("concept", "winner", "n", "n_after")
