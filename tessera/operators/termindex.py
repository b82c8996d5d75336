"""A stored term index with fields: built once, opened by the buckets of a query's terms.

``postings`` holds a row for each term of a page's field, in folders by ``bucket``, a hash of the
term; files are sorted by term. A bucket is dealt over ``parts``, by page, so that a term of very
many pages is no single task's. ``totals`` holds the number of pages and their mean length."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip_marks

TOKEN = r"[^\p{L}\p{N}]+"
BUCKETS, PARTS = 64, 4
#: Tokens that a task sorts at about; larger tables have more tasks, and more parts of a bucket.
TASK_TOKENS = 1_000_000
#: Tokens whose places are gathered at once in a task.
AT_ONCE = 1 << 19


def tokens(text: Column) -> Column:
    """The mark-stripped, lower-case tokens; none of null. A text of single bytes has no marks."""
    plain = F.when(F.octet_length(text) == F.length(text), text).otherwise(strip_marks(text))
    return F.coalesce(F.filter(F.split(F.lower(plain), TOKEN), lambda x: x != ""), F.array().cast("array<string>"))


def _gather(key: str, fields: list[str], buckets: int):
    """Of rows (key, length, the tokens of each field) the terms of each row's field, once, with their places in order.
    They leave by ``bucket``, term and key, so that the later sort finds long runs."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.asarray(batch.column("length")).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
                part = batch.slice(start, stop - start)
                start = stop
                for f in fields:
                    n = np.asarray(part.column(f).value_lengths()).astype(np.int64)
                    if not n.sum():
                        continue
                    terms = part.column(f).flatten().dictionary_encode()
                    row = np.repeat(np.arange(len(n)), n)
                    at = (np.arange(len(row)) - (np.cumsum(n) - n)[row]).astype(np.int32)
                    of_term = np.fromiter((int(md5(t).hexdigest()[:6], 16) % buckets for t in terms.dictionary.cast(pa.binary()).to_pylist()), np.int32, len(terms.dictionary))
                    by_term = np.asarray(pc.sort_indices(terms.dictionary))
                    by_term = by_term[np.argsort(of_term[by_term], kind="stable")]
                    by_key = np.asarray(pc.sort_indices(part.column(key)))
                    term_rank, key_rank = np.argsort(by_term), np.argsort(by_key)
                    code = term_rank[np.asarray(terms.indices)] * np.int64(len(n)) + key_rank[row]
                    order = np.argsort(code, kind="stable")
                    code = code[order]
                    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                    term, of = np.divmod(code[first], len(n))
                    term, of = by_term[term], pa.array(by_key[of])
                    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(at[order]))
                    columns = [pa.array(of_term[term]), terms.dictionary.take(pa.array(term)), pa.repeat(f, len(of)), part.column(key).take(of), part.column("length").take(of), places]
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "term", "field", key, "length", "positions"])

    return gather


def bucket(term: Column, buckets: int) -> Column:
    return (F.conv(F.substring(F.md5(term), 1, 6), 16, 10).cast("long") % buckets).cast("int")


def postings(pages: DataFrame, fields: list[str], key: str = "page", buckets: int = BUCKETS, parts: int = PARTS, tasks: int | None = None, unique: bool = False) -> DataFrame:
    """(bucket, term, field, key, tf, positions, length) of the text columns ``fields``. Length is
    the page's number of tokens over all fields. Terms are gathered within their row, then dealt once, by bucket and
    part. Rows of one key and length are one page; ``unique`` says that no key is repeated."""
    rows = pages.select(key, *[tokens(F.col(f)).alias(f) for f in fields])
    rows = rows.select(key, sum((F.size(f) for f in fields), F.lit(0)).alias("length"), *fields)
    rows = rows.mapInArrow(_gather(key, fields, buckets), f"bucket int, term string, field string, `{key}` {pages.schema[key].dataType.simpleString()}, length int, positions array<int>")
    rows = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)))
    got = rows.repartition(*([tasks] if tasks else []), "bucket", "part")
    if not unique:
        got = got.groupBy("bucket", "part", "term", "field", key, "length").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return got.select("bucket", "term", "field", key, F.size("positions").cast("long").alias("tf"), "positions", "length")


def write(pages: DataFrame, path: str, fields: list[str], key: str = "page", buckets: int = BUCKETS, parts: int = PARTS) -> None:
    """The index of ``pages`` at ``path``, in place of an earlier one."""
    spark = pages.sparkSession
    sizes = pages.select(key, sum((F.size(tokens(F.col(f))) for f in fields), F.lit(0)).alias("length"))
    filled = F.when(F.col("length") > 0, F.col("length"))
    sizes = sizes.groupBy(key).agg(F.count(filled).alias("n"), F.sum(filled).alias("length"))
    n, length, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0)), F.max("n")).first()
    totals = spark.createDataFrame([(n, length / n if n else None, buckets)], "n long, mean double, buckets int")
    totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    tasks = math.ceil(length / TASK_TOKENS)
    parts = max(parts, -(-2 * tasks // buckets))
    few = tasks <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = postings(pages, fields, key, buckets, parts, None if few else tasks, most in (None, 0, 1))
    index.sortWithinPartitions("bucket", "term", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def read(spark: SparkSession, path: str, key: str = "page", kind: str = "string") -> DataFrame:
    """The stored postings; ``kind`` is the type of the page ids."""
    schema = f"term string, field string, {key} {kind}, tf long, positions array<int>, length int, bucket int"
    return spark.read.schema(schema).parquet(f"{path}/postings")


def search(
    spark: SparkSession, path: str, queries: DataFrame, weights: dict[str, float], k: int = 8, key: str = "page", kind: str = "string", k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """The best pages, (query, rank, key, score), for each phrase of (query, phrase).

    Terms of a phrase follow one another within a field. A page's frequency is the sum over the
    fields of ``weights`` of weight times occurrences; fields not named are not searched. Only
    the folders of the terms' buckets are read: their numbers (``buckets`` at most) go to the
    driver, as a partition filter. Null and wordless phrases find nothing."""
    totals = spark.read.parquet(f"{path}/totals")
    buckets = totals.first()["buckets"]
    terms = queries.select("query", tokens(F.col("phrase")).alias("t")).select("query", F.size("t").alias("m"), F.posexplode("t").alias("i", "term"))
    terms = terms.withColumn("bucket", bucket(F.col("term"), buckets))
    opened = sorted(r[0] for r in terms.select("bucket").distinct().collect())
    index = read(spark, path, key, kind).where(F.col("bucket").isin(opened) & F.col("field").isin(list(weights)))
    hits = index.join(F.broadcast(terms), ["bucket", "term"])
    # a word's frequency is stored; of a phrase the places of its words meet, page by page
    one = hits.where("m = 1").select("query", key, "field", "length", "tf")
    starts = F.struct("i", F.transform("positions", lambda p: p - F.col("i")).alias("starts"))
    each = hits.where("m > 1").groupBy("query", "m", key, "field", "length").agg(F.collect_list(starts).alias("words")).where(F.size("words") == F.col("m"))
    both = F.aggregate(F.slice("words", 2, F.size("words")), F.get("words.starts", F.lit(0)), lambda s, w: F.array_intersect(s, w["starts"]))
    more = each.select("query", key, "field", "length", F.size(both).cast("long").alias("tf")).where("tf > 0")
    weight = F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, float(w))])[F.col("field")]
    tf = one.unionByName(more).groupBy("query", key, "length").agg(F.sum(weight * F.col("tf")).alias("tf"))
    rows = tf.join(tf.groupBy("query").agg(F.count("*").alias("df")), "query").crossJoin(totals.select("n", "mean"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    best = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return rows.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "rank", key, "score")
