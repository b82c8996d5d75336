"""The state of a concept space as one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import novelty_threshold
from ..sources.sinks import written

#: Rows of the lists.
TOP, ACROSS, EDGE, SAMPLES = 15, 12, 8, 3
#: Largest usage of the classes of reuse.
REUSE = ((1, "once"), (5, "2-5"), (20, "6-20"))


def _row(part: str, label, n, value=None, text=None) -> list[Column]:
    null = lambda x, kind: (F.lit(None) if x is None else x).cast(kind)
    return [F.lit(part).alias("part"), (F.lit(label) if isinstance(label, str) else label).cast("string").alias("label"), null(n, "long").alias("n"), null(value, "double").alias("value"), null(text, "string").alias("text")]


def snapshot(signatures: DataFrame, sections: DataFrame, concepts: DataFrame, log: DataFrame) -> DataFrame:
    """(part, label, n, value, text): every figure and list of the document.

    Of ``signatures(section, concept, weight)``, ``sections(section, source, seq)``, the registry
    ``concepts(concept, name, definition, created)`` and ``log(section, minted, rejected, ts,
    event_id)``. One pass with grouping sets makes a table by concept and source and by section
    and source, of which all else follows."""
    base = signatures.join(sections.select("section", "source"), "section")
    cube = base.groupingSets([["concept", "source"], ["section", "source"]], "concept", "section", "source").agg(
        F.grouping("concept").alias("by_section"), F.count("*").alias("n"), F.sum("weight").alias("w"), F.max("weight").alias("most")
    )
    cube = written(cube, "snapshot")
    per_section = cube.where("by_section = 1").select("section", "source", "n", "most")
    pairs = cube.where("by_section = 0").select("concept", "source", "n", "w")
    per_concept = pairs.groupBy("concept").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("sources")).join(concepts.select("concept", "name"), "concept", "left")
    per_concept = per_concept.withColumn("name", F.coalesce("name", F.col("concept").cast("string")))
    registry = concepts.agg(F.count("*").alias("n"))
    total = sections.groupBy("source").agg(F.count("*").alias("total"))
    reuse = F.coalesce(*[F.when(F.col("n") <= n, name) for n, name in REUSE], F.lit("21+"))
    by_source = total.join(per_section.groupBy("source").agg(F.count("*").alias("signed")), "source", "left").withColumn("signed", F.coalesce("signed", F.lit(0)))
    whole = by_source.agg(F.sum("signed").alias("signed"), F.sum("total").alias("total"))
    share = lambda: F.round(F.try_divide(100 * F.col("signed"), F.col("total")), 1)

    def best(df: DataFrame, part: str, k: int, *order) -> DataFrame:
        top = df.orderBy(*order).limit(k)
        place = F.row_number().over(Window.orderBy(*order))  # of k rows
        return top.withColumn("place", place).select(*_row(part, F.format_string("%02d %s", "place", "name"), F.col("n"), F.round("w", 2)))

    def edge(part: str, order: Column) -> DataFrame:
        some = concepts.orderBy(order, "concept").limit(EDGE).withColumn("place", F.row_number().over(Window.orderBy(order, "concept")))
        return some.select(*_row(part, F.format_string("%02d %s", "place", "name"), None, text=F.left(F.coalesce("definition", F.lit("")), F.lit(280))))

    heavy = (F.desc(F.round("w", 9)), F.col("concept"))
    n_sources = total.agg(F.count("*").alias("k"))
    newest = Window.partitionBy("source").orderBy(F.desc("seq"), F.desc("section"))
    last = sections.join(per_section.select("section"), "section").withColumn("r", F.row_number().over(newest)).where(F.col("r") <= SAMPLES)
    named = signatures.join(last.select("section", "source", "r"), "section").join(concepts.select("concept", "name"), "concept", "left")
    entry = F.struct((-F.round("weight", 9)).alias("less"), F.coalesce("name", F.col("concept").cast("string")).alias("name"), "weight")
    sampled = named.groupBy("source", "r", "section").agg(F.sort_array(F.collect_list(entry)).alias("s"))
    line = F.left(F.array_join(F.transform("s", lambda x: F.concat(x["name"], F.format_string(" %.2f", x["weight"]))), " · "), F.lit(320))
    end = log.where("section IS NOT NULL").agg(F.max_by("section", F.struct("ts", "event_id")).alias("section"))
    parts = [
        whole.select(*_row("sections", "signed", F.col("signed"), share())),
        whole.select(*_row("sections", "total", F.col("total"))),
        registry.select(*_row("registry", "concepts", F.col("n"), F.round(novelty_threshold(F.col("n")), 3))),
        per_section.agg(F.avg("n").alias("a"), F.avg("most").alias("b")).select(F.explode(F.array(*[F.struct(*_row("mean", n, None, F.round(c, d))) for n, c, d in (("size", "a", 2), ("largest weight", "b", 3))])).alias("x")).select("x.*"),
        log.agg(F.coalesce(F.sum("minted"), F.lit(0)).alias("a"), F.coalesce(F.sum("rejected"), F.lit(0)).alias("b")).select(F.explode(F.array(*[F.struct(*_row("gate", n, F.col(c))) for n, c in (("created", "a"), ("rejected", "b"))])).alias("x")).select("x.*"),
        per_concept.groupBy("sources").agg(F.count("*").alias("n")).select(*_row("span", F.col("sources"), F.col("n"))),
        per_concept.groupBy(reuse.alias("class")).agg(F.count("*").alias("n")).select(*_row("reuse", F.col("class"), F.col("n"))),
        by_source.select(*_row("source", F.col("source"), F.col("signed"), share(), F.col("total"))),
        per_section.groupBy(F.col("n").alias("size")).agg(F.count("*").alias("n")).select(*_row("size", F.col("size"), F.col("n"))),
        best(per_concept, "top", TOP, *heavy),
        best(per_concept.crossJoin(n_sources).where("sources = k"), "across", ACROSS, *heavy),
        edge("newest", F.desc("created")), edge("oldest", F.col("created")),
        sampled.select(*_row("sample", F.format_string("%s %d", "source", "r"), F.col("section"), text=line)),
        end.join(sections, "section").select(*_row("last", F.col("source"), F.col("section"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def document(rows: DataFrame) -> DataFrame:
    """One row, ``json``: the parts by name, each a list in order of its labels. The lists are bounded
    by ``TOP`` and the like, or by the numbers of sources and of sizes."""
    per = rows.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("label", "n", "value", "text"))).alias("rows"))
    return per.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("part", "rows"))))).alias("json"))


def export(rows: DataFrame, path: str, stamp: str) -> None:
    """Write the document under its stamp, and as the latest."""
    doc = written(document(rows), "snapshot-document").coalesce(1)
    for name in (stamp, "latest"):
        doc.write.mode("overwrite").text(f"{path}/{name}")
