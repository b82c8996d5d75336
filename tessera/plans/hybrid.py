"""Question to evidence: term and vector lists, fusion, lookups, floor and budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import retrieval as R


def run_retrieval(
    pages: DataFrame, index: DataFrame, vectors: DataFrame, terms: DataFrame, questions: DataFrame, depth: int = 8, constant: int = 60
) -> DataFrame:
    """Fused scores (query, id, score): a list for each term phrase, (query, phrase), and one for each
    semantic query, (query, q), and source."""
    phrases = terms.select(F.col("phrase").alias("query"), "phrase").distinct()
    found = R.bm25(index, phrases, depth).withColumnRenamed("query", "phrase").join(terms, "phrase")
    lists = found.select("query", F.concat(F.lit("t:"), "phrase").alias("list"), "rank", F.col("page").alias("id"))
    near = R.nearest(questions, vectors, depth, per="source", other=False)
    lists = lists.unionByName(near.select("query", F.concat(F.lit("v:"), F.col("source").cast("string")).alias("list"), "rank", "id"))
    return R.fuse(lists, constant)


#: Refs of a query that are looked up, in their order.
MOST_REFS = 12


def looked_up(refs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query, id), a row for each page that a ref of (query, turn, ref) names. Of a query the first
    ``MOST_REFS`` refs that are not blank count; a ref named twice counts twice."""
    wanted = refs.withColumn("ref", F.trim("ref")).where("ref <> ''")
    wanted = wanted.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("turn", "ref"))).where(F.col("n") <= MOST_REFS)
    return wanted.join(R.lookup(wanted.select("ref"), passages), "ref").select("query", F.col("page").alias("id"))


def answer_evidence(
    pages: DataFrame, vectors: DataFrame, passages: DataFrame, terms: DataFrame, questions: DataFrame, refs: DataFrame,
    relevance: DataFrame | None = None, budget: int = 8000, floor: int = 2,
) -> DataFrame:
    """The whole path of a question: term and vector lists, fused; a bonus for the pages that its refs
    name; what was judged irrelevant (query, id, relevance) goes; then seats for each source and the
    budget. ``pages(id, source, text)``; ``passages`` as for ``retrieval.lookup``."""
    scores = run_retrieval(pages.withColumnRenamed("id", "page"), R.postings(pages.withColumnRenamed("id", "page")), vectors, terms, questions)
    scores = R.merge_scores(scores, looked_up(refs, passages).withColumn("score", F.lit(1.0)))
    if relevance is not None:
        scores = R.gate(scores, relevance)
    return evidence(scores, pages, budget, floor)


def evidence(scores: DataFrame, pages: DataFrame, budget: int = 8000, floor: int = 2, looked_up: DataFrame | None = None, bonus: float = 1.0) -> DataFrame:
    """Pages within the budget: bonus for looked-up ones, ``floor`` seats for each source."""
    if looked_up is not None:
        scores = R.merge_scores(scores, looked_up.select("query", "id", F.lit(bonus).alias("score")))
    known = pages.select("id", "source", F.length("text").cast("long").alias("chars"))
    return R.fill(R.seats(scores.join(known, "id"), k=floor), budget)
