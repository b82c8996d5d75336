"""Roles of the engine's inputs, taken from the benchmark's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import signatures as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signatures(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    """section = order, concept = part or its brand, weight = share of the price."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section"), "l_partkey", F.col("l_extendedprice").alias("weight"))
    n = lines.count()
    if fine:
        return S.normalise(lines.withColumnRenamed("l_partkey", "concept"), n)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("concept"))
    return S.normalise(lines.join(parts, "l_partkey"), n)


def page_signatures(spark: SparkSession, sf_dir: str, fine: bool = True) -> DataFrame:
    """Signatures of the sections that hold three vectors (or some documents) each: the lines of the
    orders with one remainder are a section, so that searches by concepts and by vectors meet."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 160).alias("section"), "l_partkey", F.col("l_extendedprice").alias("weight"))
    if fine:
        return S.normalise(lines.withColumnRenamed("l_partkey", "concept"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("concept"))
    return S.normalise(lines.join(parts, "l_partkey"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section = order, book = customer, source = region, seq = date."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = nations.select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("source"))
    books = table(spark, sf_dir, "customer").join(F.broadcast(places), "c_nationkey").select(F.col("c_custkey").alias("book"), "source")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section"), F.col("o_custkey").alias("book"), F.col("o_orderdate").alias("seq"))
    return orders.join(books, "book")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("source"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: the vectors whose id is divisible by 100."""
    return vectors(spark, sf_dir).where(F.col("id") % 100 == 0).select(F.col("id").alias("query"), F.col("v").alias("q"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section"), "text", "lang", "source")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "events")
    return got.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("run"), F.col("event_type").alias("event"), "value")
