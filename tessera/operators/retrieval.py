"""Pages, term search, fusion, budgets and passage lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import book_keys, parse_ref, ref_keys
from ..sources.sinks import written
from .termindex import tokens
from .vectors import nearest, pairs_between, similar_pairs  # noqa: F401

def pages(sections: DataFrame, target: int = 1200) -> DataFrame:
    """Whole verses (lines) of (section, text) in pages of about ``target`` characters.

    An ordered fold over a section's verse lengths: a page closes before the verse that
    would pass the target, so that a longer verse is a page of its own."""
    verses = F.filter(F.split("text", "\n"), lambda v: F.trim(v) != "")
    start = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("done"), F.lit(0).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("size"))

    def step(s: Column, n: Column) -> Column:
        full = (s["size"] > 0) & (s["size"] + n > target)
        page = F.struct(s["first"].alias("first"), s["last"].alias("last"))
        return F.struct(
            F.when(full, F.array_append(s["done"], page)).otherwise(s["done"]).alias("done"),
            F.when(full, s["last"] + 1).otherwise(s["first"]).alias("first"),
            (s["last"] + 1).alias("last"),
            F.when(full, n).otherwise(s["size"] + n).alias("size"),
        )

    end = lambda s: F.array_append(s["done"], F.struct(s["first"].alias("first"), s["last"].alias("last")))
    rows = sections.withColumn("verses", verses).where(F.size("verses") > 0)
    spans = F.aggregate(F.transform("verses", F.length), start, step, end)
    rows = rows.select("section", "verses", F.posexplode(spans).alias("at", "p"))
    return rows.select(
        "section",
        (F.col("at") + 1).alias("page_no"),
        (F.col("p.first") + 1).alias("first_verse"),
        (F.col("p.last") + 1).alias("last_verse"),
        F.array_join(F.slice("verses", F.col("p.first") + 1, F.col("p.last") - F.col("p.first") + 1), "\n").alias("text"),
    )


def postings(pages: DataFrame, key: str = "page") -> DataFrame:
    """(key, t, length): the tokens of each page's text. For terms that are asked again and again
    write ``termindex`` once instead."""
    return pages.select(key, tokens(F.col("text")).alias("t")).withColumn("length", F.size("t"))


def bm25(index: DataFrame, queries: DataFrame, k: int = 8, key: str = "page", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Best pages for each query phrase, (query, phrase); terms must follow one another.

    The phrase is one unit, as in a full-text index: its frequency and document
    frequency enter the formula. Higher is better. The texts are read once: the phrases of the
    stated queries go to the driver, each page counts them in place, and only its length and
    counts are written; no occurrence is shuffled."""
    asked = queries.select("query", tokens(F.col("phrase")).alias("t")).where(F.size("t") > 0).withColumn("phrase", F.array_join("t", " "))
    phrases = {r["phrase"]: r["t"] for r in asked.select("phrase", "t").distinct().collect()}
    terms = sorted({t for p in phrases.values() for t in p})
    places = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: F.get("t", i).isin(terms))

    def times(phrase: list[str]) -> Column:
        follow = lambda i: reduce(lambda x, y: x & y, [F.coalesce(F.get("t", i + n) == term, F.lit(False)) for n, term in enumerate(phrase)])
        return F.size(F.filter("places", follow)).cast("long")

    none = F.array().cast("array<struct<phrase:string,tf:bigint>>")
    counts = F.array(*[F.struct(F.lit(p).alias("phrase"), times(t).alias("tf")) for p, t in phrases.items()]) if phrases else none
    seen = index.where("length > 0").select(key, "length", "t", places.alias("places"))
    seen = written(seen.select(key, "length", F.filter(counts, lambda c: c["tf"] > 0).alias("found")), "asked-terms")
    totals = seen.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    tf = seen.select(key, "length", F.explode("found").alias("f")).select(key, "length", "f.*").join(F.broadcast(asked.select("query", "phrase")), "phrase").drop("phrase")
    df = tf.groupBy("query").agg(F.count("*").alias("df"))
    rows = tf.join(F.broadcast(df), "query").crossJoin(F.broadcast(totals))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    best = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return rows.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "rank", key, "score")


def fuse(lists: DataFrame, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (query, list, rank, id), ranks from 1."""
    return lists.groupBy("query", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"))


def merge_scores(*frames: DataFrame) -> DataFrame:
    """Add up score contributions (query, id, score)."""
    every = frames[0].select("query", "id", "score")
    for f in frames[1:]:
        every = every.unionByName(f.select("query", "id", "score"))
    return every.groupBy("query", "id").agg(F.sum("score").alias("score"))


def gate(scores: DataFrame, relevance: DataFrame, least: float = 0.35, unscored_boost: float = 0.5) -> DataFrame:
    """Drop what was judged under the gate; the rest gains its relevance (or a default)."""
    got = scores.join(relevance, ["query", "id"], "left").where(F.coalesce("relevance", F.lit(1.0)) >= least)
    return got.select("query", "id", (F.col("score") + F.coalesce("relevance", F.lit(unscored_boost))).alias("score"))


def seats(scored: DataFrame, per: str = "source", k: int = 2) -> DataFrame:
    """Rows by score, the k best of each source first: adds ``seat`` and ``place``."""
    in_source = F.row_number().over(Window.partitionBy("query", per).orderBy(F.desc("score"), "id"))
    got = scored.withColumn("seat", (in_source <= k).cast("int"))
    return got.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("seat"), F.desc("score"), "id")))


def fill(placed: DataFrame, budget: int) -> DataFrame:
    """Greedy fill of a character budget in order of place: what does not fit is skipped,
    the first is always kept, and a full budget ends it. Candidates are a few hundred."""
    rows = F.sort_array(F.collect_list(F.struct("place", "id", "chars", "score")))
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.lit(0).cast("long").alias("used"))

    def step(s: Column, x: Column) -> Column:
        out = (s["used"] >= budget) | ((s["used"] + x["chars"] > budget) & (F.size(s["kept"]) > 0))
        return F.struct(
            F.when(out, s["kept"]).otherwise(F.array_append(s["kept"], x["id"].cast("long"))).alias("kept"),
            F.when(out, s["used"]).otherwise(s["used"] + x["chars"]).alias("used"),
        )

    got = placed.groupBy("query").agg(rows.alias("rows")).select("query", "rows", F.aggregate("rows", start, step, lambda s: s["kept"]).alias("kept"))
    kept = got.select("query", "kept", F.explode("rows").alias("r")).where(F.array_contains("kept", F.col("r.id").cast("long")))
    return kept.select("query", "r.id", "r.score", "r.chars")


def passage_index(pages: DataFrame) -> DataFrame:
    """(key, chapter, first_verse, last_verse, page): pages by every key of their book."""
    return pages.select(F.explode(book_keys(F.col("book"))).alias("key"), "chapter", "first_verse", "last_verse", "page")


#: Letters that a prefix needs at least.
LEAST_PREFIX = 4


def _prefixes(key: str, own: bool) -> Column:
    """The prefixes of ``LEAST_PREFIX`` characters or more, with or without the key itself."""
    most = F.length(key) - (0 if own else 1)
    return F.explode(F.when(most >= LEAST_PREFIX, F.transform(F.sequence(F.lit(LEAST_PREFIX), most), lambda n: F.left(F.col(key), n))))


def near_keys(wanted: DataFrame, keys: DataFrame) -> DataFrame:
    """(wanted, key) for each ``wanted(wanted)`` with exactly one near key in ``keys(key)``: one that
    begins with it, or with which it begins. By equi-joins: an index of the keys' prefixes, with
    the number of keys below each, for the first; the wanted's own prefixes for the second."""
    long = keys.where(F.length("key") >= LEAST_PREFIX)
    below = long.select("key", _prefixes("key", True).alias("wanted")).groupBy("wanted").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    longer = wanted.where(F.length("wanted") >= LEAST_PREFIX).join(below, "wanted")
    shorter = wanted.select("wanted", _prefixes("wanted", False).alias("key")).join(long, "key").groupBy("wanted").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    both = longer.select("wanted", "n", "key").unionByName(shorter.select("wanted", "n", "key"))
    return both.groupBy("wanted").agg(F.sum("n").alias("n"), F.min("key").alias("key")).where("n = 1").drop("n")


def lookup(refs: DataFrame, pages: DataFrame, k: int = 6) -> DataFrame:
    """Pages (page, book, chapter, first_verse, last_verse) that a textual ref names: (ref, rank, page).

    The keys of a ref are tried in order: its book as written, without an article, with doubled
    letters single, under its other name; then, for each that no book has, the only key that begins
    with it or with which it begins. The first that gives pages counts. A ref without verses means
    the whole chapter. Refs that cannot be read, null ones included, give nothing."""
    index = passage_index(pages)
    known = index.select("key").distinct()
    wanted = refs.select("ref").distinct().select("ref", parse_ref(F.col("ref")).alias("p")).where("p IS NOT NULL")
    wanted = wanted.select("ref", "p.*").select("ref", "chapter", "verse_from", "verse_to", F.posexplode(ref_keys(F.col("book"), F.col("chapter"))).alias("turn", "wanted"))
    tried = wanted.join(known.select(F.col("key").alias("wanted"), F.col("key")), "wanted", "left")
    lost = tried.where("key IS NULL").drop("key")
    near = lost.join(near_keys(lost.select("wanted").distinct(), known), "wanted").withColumn("turn", F.col("turn") + 1000)
    rows = tried.where("key IS NOT NULL").unionByName(near).join(index, ["key", "chapter"])
    hit = F.coalesce((F.col("first_verse") <= F.col("verse_to")) & (F.col("last_verse") >= F.col("verse_from")), F.lit(True))
    rows = rows.where(hit).groupBy("ref", "turn", "page").agg(F.min(F.struct("first_verse", "last_verse")).alias("at"))
    rows = rows.withColumn("first", F.min("turn").over(Window.partitionBy("ref"))).where("turn = first")
    rank = F.row_number().over(Window.partitionBy("ref").orderBy("at", "page"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("ref", "rank", "page")


def repair_refs(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """A ref that is an id, or the tail of exactly one id after a colon; others go."""
    tails = ids.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("id", ":"))), lambda i: F.array_join(F.slice(F.split("id", ":"), i, 99), ":"))).alias("ref"))
    got = refs.join(tails, "ref").groupBy("ref").agg(F.max(F.col("ref") == F.col("id")).alias("same"), F.count_distinct("id").alias("n"), F.min("id").alias("one"))
    return got.where("same OR n = 1").select("ref", F.when(F.col("same"), F.col("ref")).otherwise(F.col("one")).alias("id"))


def second_pass(first: DataFrame, second: DataFrame, relevance: DataFrame, least: float = 0.35, unscored_boost: float = 0.5, bonus: float = 1.0) -> DataFrame:
    """Merge two retrieval passes (query, id, score). What was judged under the gate in the first
    pass stays out unless the second one looked it up (a score of ``bonus`` or more); what was
    kept gains its relevance, or the default."""
    judged = first.join(relevance, ["query", "id"], "left").withColumn("kept", F.coalesce("relevance", F.lit(1.0)) >= least)
    rows = judged.select("query", "id", F.col("score").alias("s1"), "kept", "relevance").join(second.select("query", "id", F.col("score").alias("s2")), ["query", "id"], "full")
    rows = rows.where(F.coalesce("kept", F.lit(True)) | (F.col("s2") >= bonus))
    boost = F.when(F.col("kept"), F.coalesce("relevance", F.lit(unscored_boost))).otherwise(F.lit(0.0))
    return rows.select("query", "id", (F.coalesce("s1", F.lit(0.0)) + F.coalesce("s2", F.lit(0.0)) + boost).alias("score"))
