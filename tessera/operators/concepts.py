"""Search by concepts, names of concepts, candidate sets and what two runs agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cosine
from ..functions.text import slugify
from .edges import both_ways


def match(seeds: DataFrame, edges: DataFrame, near: int = 2, discount: float = 0.5) -> DataFrame:
    """(query, concept, score, via): seeds (query, concept, score) and the ``near`` best
    neighbours of each over ``edges(a, b, npmi)`` at score * npmi * discount. Of each concept the best
    score stays; a seed goes before a neighbour, then the least ``via``. ``via`` of seeds is null."""
    ends = both_ways(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "npmi"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("npmi"), "dst"))
    ends = ends.withColumn("r", rank).where(F.col("r") <= near)
    more = seeds.join(ends, seeds["concept"] == ends["src"])
    more = more.select("query", F.col("dst").alias("concept"), (F.col("score") * F.col("npmi") * discount).alias("score"), F.col("src").alias("via"))
    every = seeds.select("query", "concept", "score", F.lit(None).cast(seeds.schema["concept"].dataType).alias("via")).unionByName(more)
    best = Window.partitionBy("query", "concept").orderBy(F.desc("score"), F.asc_nulls_first("via"))
    return every.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def search(matched: DataFrame, signatures: DataFrame, k: int = 8, evidence: int = 8) -> DataFrame:
    """(query, rank, section, score, evidence): the k best sections by the sum of concept score *
    signature weight, with their concepts by that product."""
    rows = matched.withColumnRenamed("score", "s").join(signatures, "concept").withColumn("part", F.col("s") * F.col("weight"))
    # scores first, evidence of the winners alone after
    total = rows.groupBy("query", "section").agg(F.round(F.sum("part"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "section"))
    top = total.withColumn("rank", rank).where(F.col("rank") <= k)
    found = F.sort_array(F.collect_list(F.struct((-F.round("part", 6)).alias("p"), "concept")))
    of = rows.join(top, ["query", "section"]).groupBy("query", "rank", "section", "score").agg(F.slice(found, 1, evidence).alias("e"))
    return of.select("query", "rank", "section", "score", F.transform("e", lambda x: x["concept"]).alias("evidence"))


def best_pages(sections: DataFrame, pages: DataFrame, queries: DataFrame) -> DataFrame:
    """Of every (query, section) the page (id, section, v) nearest to the query (query, q)."""
    rows = sections.join(pages, "section").join(queries, "query").withColumn("s", F.round(cosine(F.col("q"), F.col("v")), 6))
    return rows.groupBy(*sections.columns).agg(F.max_by("id", F.struct("s", (-F.col("id")).alias("id"))).alias("page"))


def bucket(found: DataFrame, pages: DataFrame, queries: DataFrame, retrieved: DataFrame, k: int = 5, bonus: float = 0.05) -> DataFrame:
    """(query, place, page, section, score): the best page of each found section but for those that
    were retrieved already, (query, page), the first k; ``bonus`` is what each adds to the fusion."""
    rows = best_pages(found.select("query", "rank", "section"), pages, queries).join(retrieved, ["query", "page"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    return rows.withColumn("place", place).where(F.col("place") <= k).select("query", "place", "page", "section", F.lit(bonus).alias("score"))


def first_of_section(ranked: DataFrame, k: int = 8) -> DataFrame:
    """Of pages (query, id, section, score), best first, the first of each section, k sections."""
    order = [F.desc("score"), F.col("id")]
    own = F.row_number().over(Window.partitionBy("query", "section").orderBy(*order))
    rows = ranked.withColumn("r", own).where("r = 1")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).drop("r")


def compare_buckets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per query: sections (query, section) of either side, shared ones, Jaccard and what is new right."""
    both = left.select("query", "section").distinct().withColumn("l", F.lit(1)).join(right.select("query", "section").distinct().withColumn("r", F.lit(1)), ["query", "section"], "full")
    got = both.groupBy("query").agg(F.count("l").alias("base"), F.count("r").alias("signal"), F.count(F.col("l") + F.col("r")).alias("shared"), F.count("*").alias("every"))
    return got.select("query", "base", "signal", "shared", (F.col("signal") - F.col("shared")).alias("novel"), F.round(F.col("shared") / F.col("every"), 6).alias("jaccard"))


def resolve(assigned: DataFrame, concepts: DataFrame) -> DataFrame:
    """``assigned(key, id, name)`` with ``concept``: by exact id, the id as a slug of a name or
    alias, the name in lower case, the name as a slug; null if none of these is known.

    ``concepts(concept, name, aliases)``; of several with one name or slug the greatest id counts."""
    names = concepts.select("concept", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("known"))
    low = names.groupBy(F.lower("known").alias("low")).agg(F.max("concept").alias("by_name"))
    slugs = names.groupBy(slugify(F.col("known")).alias("slug")).agg(F.max("concept").alias("c")).where("slug <> ''")
    rows = assigned.withColumns({"id": F.trim("id"), "name": F.trim("name")})
    rows = rows.withColumns({"low": F.lower("name"), "id_slug": slugify(F.col("id")), "name_slug": slugify(F.col("name"))})
    rows = rows.join(concepts.select(F.col("concept").alias("by_id")), F.col("id") == F.col("by_id"), "left")
    rows = rows.join(slugs.toDF("id_slug", "by_id_slug"), "id_slug", "left").join(low, "low", "left").join(slugs.toDF("name_slug", "by_name_slug"), "name_slug", "left")
    return rows.select("key", F.coalesce("by_id", "by_id_slug", "by_name", "by_name_slug").alias("concept"))


def nearest_of_section(near: DataFrame, k: int = 6) -> DataFrame:
    """(section, concept, score): the greatest similarity over a section's pages, the k best."""
    best = near.groupBy("section", "concept").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("score"), "concept"))
    return best.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def candidates(*ways: DataFrame, cap: int = 12) -> DataFrame:
    """Candidate concepts (section, rank, concept, score) found in several ways, each (section,
    concept, score): the first way that names a concept gives its score (the greatest there)."""
    rows = [w.select("section", "concept", "score", F.lit(i).alias("way")) for i, w in enumerate(ways)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    first = every.groupBy("section", "concept").agg(F.min(F.struct("way", (-F.col("score")).alias("s"))).alias("m"))
    first = first.select("section", "concept", (-F.col("m.s")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("score"), "concept"))
    return first.withColumn("rank", rank).where(F.col("rank") <= cap).select("section", "rank", "concept", "score")


def draft_overlap(drafts: DataFrame, hits: DataFrame, signatures: DataFrame) -> DataFrame:
    """Of ``hits(draft, section)`` the sum of least weights of the draft (draft, concept, weight)
    and the section's signature; null where the section has none."""
    own = drafts.select("draft", "concept", F.col("weight").alias("w"))
    # a draft has few concepts, a section may have very many: the draft's are looked up
    shared = hits.join(own, "draft").join(signatures, ["section", "concept"]).groupBy("draft", "section").agg(F.sum(F.least("w", "weight")).alias("o"))
    signed = signatures.select("section").distinct().withColumn("signed", F.lit(True))
    rows = hits.join(signed, "section", "left").join(shared, ["draft", "section"], "left")
    return rows.select("draft", "section", F.when(F.col("signed"), F.round(F.coalesce("o", F.lit(0.0)), 6)).alias("overlap"))


def usable(entries: DataFrame, least: int = 2, most: int = 6, low: float = 0.7, high: float = 1.3) -> DataFrame:
    """Sections whose proposed entries (section, concept, weight) are few enough, with a sum near 1."""
    got = entries.where("weight > 0").groupBy("section").agg(F.count("*").alias("entries"), F.round(F.sum("weight"), 6).alias("total"))
    return got.where(F.col("entries").between(least, most) & F.col("total").between(low, high))


def not_verbatim(drafts: DataFrame, sections: DataFrame) -> DataFrame:
    """Drafts (section, verse) whose verse does not stand in the section's text."""
    return drafts.join(sections.select("section", "text"), "section").where(~F.contains("text", F.trim("verse"))).select("section", "verse")


def latest_runs(runs: DataFrame) -> DataFrame:
    """One row of ``runs(run, started, finished)``: the latest, the latest finished and the latest
    that is not (``finished`` null)."""
    order = F.struct("started", "run")
    of = lambda when: F.max_by(F.when(when, F.col("run")), F.when(when, order))
    return runs.agg(F.max_by("run", order).alias("latest"), of(F.col("finished").isNotNull()).alias("finished"), of(F.col("finished").isNull()).alias("unfinished"))


def agreement(left: DataFrame, right: DataFrame, mapping: DataFrame, golden: DataFrame) -> DataFrame:
    """(section, overlap) of each golden section: the sum of least weights of the concepts of two
    runs that ``mapping(a, b)`` matches; 0 where none is shared."""
    x = left.select("section", F.col("concept").alias("a"), F.col("weight").alias("wa")).join(mapping, "a")
    y = right.select("section", F.col("concept").alias("b"), F.col("weight").alias("wb"))
    got = x.join(y, ["section", "b"]).groupBy("section").agg(F.sum(F.least("wa", "wb")).alias("o"))
    return golden.select("section").join(got, "section", "left").select("section", F.round(F.coalesce("o", F.lit(0.0)), 6).alias("overlap"))


def _slug(section: str, renames: dict[str, str]):
    raw = F.split(section, ":")[1]
    for old, new in renames.items():
        raw = F.when(F.split(section, ":")[1] == old, F.lit(new)).otherwise(raw)
    return raw


def parallel(sections: DataFrame, left: str, right: str, renames: dict[str, str]) -> DataFrame:
    """Edges (src, dst) between the same chapters of two sources; ids are source:slug:chapter, and
    ``renames`` takes slugs of the left source to those of the right one."""
    chapter = F.split("section", ":")[2]
    x = sections.where(F.col("source") == left).select(F.col("section").alias("src"), _slug("section", renames).alias("slug"), chapter.alias("chapter"))
    y = sections.where(F.col("source") == right).select(F.col("section").alias("dst"), _slug("section", {}).alias("slug"), chapter.alias("chapter"))
    return x.join(y, ["slug", "chapter"]).select("src", "dst")


def families(sections: DataFrame, own: dict[str, str], base: str, renames: dict[str, str], shared: str, rest: str) -> DataFrame:
    """(section, family): sources of ``own`` have one each; a book of the ``base`` source, in whichever
    source, is of the family ``shared``; all else is of ``rest``."""
    books = sections.where(F.col("source") == base).select(_slug("section", renames).alias("slug"), F.lit(True).alias("there")).distinct()
    slug = F.when(F.col("source") == base, _slug("section", renames)).otherwise(_slug("section", {}))
    rows = sections.withColumn("slug", slug).join(books, "slug", "left")
    family = F.when(F.col("there"), F.lit(shared)).otherwise(F.lit(rest))
    for source, name in own.items():
        family = F.when(F.col("source") == source, F.lit(name)).otherwise(family)
    return rows.select("section", family.alias("family"))
