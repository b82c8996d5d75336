"""Edges between sections and concepts, all pure functions of signatures and order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import npmi
from ..sources.sinks import written


def conceptual(signatures: DataFrame, cutoff: float = 0.35) -> DataFrame:
    """Pairs of sections whose signatures overlap, sum of least weights, at the cutoff.

    Exact prefix filter: with a section's concepts in ascending order of use, a pair at
    the cutoff shares a concept at which either side still has the cutoff's weight left.
    Only such rows are joined, so hub concepts, which stand last, make few candidates.

    A row of the join carries its section's whole signature, so that nothing of a candidate is
    shuffled: a pair counts where it meets first, its overlap is bounded by what is left there
    (nothing but the concept itself, if what comes after it has none in common), and what the
    bound leaves is added up in place."""
    least = cutoff - 1e-9
    use = signatures.groupBy("concept").agg(F.count("*").alias("use"))
    rest = F.sum("weight").over(Window.partitionBy("section").orderBy("use", "concept").rowsBetween(0, Window.unboundedFollowing))
    entry = F.struct("use", "concept", "weight", rest.alias("rest"))
    whole = signatures.join(use, "concept").select("section", entry.alias("e")).groupBy("section").agg(F.sort_array(F.collect_list("e")).alias("e"))
    whole = whole.select("section", F.col("e.concept").alias("c"), F.col("e.weight").alias("w"), F.filter(F.col("e.rest"), lambda r: r >= least).alias("left"))
    met = whole.select("section", "c", "w", F.posexplode("left").alias("at", "rest"))
    after = F.slice("c", F.col("at") + 2, F.size("c"))
    met = met.select(F.get("c", "at").alias("concept"), "section", "at", F.get("w", "at").alias("own"), "rest", after.alias("after"), "c", "w")
    a, b = (met.select("concept", *[F.col(c).alias(f"{c}_{x}") for c in met.columns[1:]]) for x in ("a", "b"))
    own, over = F.least("own_a", "own_b"), F.least(F.col("rest_a") - F.col("own_a"), F.col("rest_b") - F.col("own_b"))
    pairs = a.join(b, "concept").where(F.col("section_a") < F.col("section_b")).where((own >= least) | ((own + over >= least) & F.arrays_overlap("after_a", "after_b")))
    both = F.array_intersect("c_a", "c_b")
    pairs = pairs.withColumn("both", both).where(F.get("both", F.lit(0)) == F.col("concept"))
    weight = lambda x, c: F.get(f"w_{x}", (F.array_position(f"c_{x}", c) - 1).cast("int"))
    overlap = F.aggregate("both", F.lit(0.0), lambda s, c: s + F.least(weight("a", c), weight("b", c)))
    found = pairs.select(F.col("section_a").alias("a"), F.col("section_b").alias("b"), overlap.alias("overlap"), F.size("both").cast("long").alias("shared"))
    return found.where(F.round("overlap", 9) >= cutoff)


def _pairs(signatures: DataFrame) -> DataFrame:
    x = signatures.select("section", F.col("concept").alias("a"), F.col("weight").alias("wa"))
    y = signatures.select("section", F.col("concept").alias("b"), F.col("weight").alias("wb"))
    return x.join(y, "section").where("a < b")


def co_occurrence(signatures: DataFrame, least: int = 3, floor: float = 0.10) -> DataFrame:
    """Concept pairs by NPMI of their presence in sections."""
    together = _pairs(signatures).groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    alone = signatures.groupBy("concept").agg(F.count("*").alias("n"))
    total = signatures.agg(F.count_distinct("section").alias("total"))
    got = (
        together.join(alone.select(F.col("concept").alias("a"), F.col("n").alias("n_a")), "a")
        .join(alone.select(F.col("concept").alias("b"), F.col("n").alias("n_b")), "b")
        .join(F.broadcast(total))
    )
    got = got.withColumn("npmi", F.round(npmi(F.col("together"), F.col("n_a"), F.col("n_b"), F.col("total")), 4))
    return got.where(F.col("npmi") >= floor).select("a", "b", "together", "n_a", "n_b", "npmi")


def co_variance(signatures: DataFrame, least: int = 5, floor: float = 0.40) -> DataFrame:
    """Concept pairs by Pearson correlation of their weights in shared sections."""
    got = _pairs(signatures).groupBy("a", "b").agg(
        F.count("*").alias("n"), F.covar_pop("wa", "wb").alias("c"), F.stddev_pop("wa").alias("sa"), F.stddev_pop("wb").alias("sb")
    )
    got = got.where((F.col("n") >= least) & (F.col("sa") >= 1e-9) & (F.col("sb") >= 1e-9))
    got = got.withColumn("r", F.round(F.try_divide("c", F.col("sa") * F.col("sb")), 4)).where(F.abs("r") >= floor)
    return got.select("a", "b", "n", F.abs("r").alias("weight"), F.when(F.col("r") < 0, -1).otherwise(1).alias("sign"))


def _stretches(sections: DataFrame, *keys: str) -> DataFrame:
    """``sections`` in stretches of the order by ``keys``, seq and section, of about equal size whatever
    the keys: range-partitioned and written, with the number of its stretch as ``stretch``."""
    order = [*keys, "seq", "section"]
    ranged = sections.select(*order).repartitionByRange(*order)
    stored = written(ranged.withColumn("stretch", F.spark_partition_id()), "stretches")
    return stored.repartitionByRange("stretch")


def _same(left: str, right: str, keys: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _follow(sections: DataFrame, *keys: str) -> DataFrame:
    """Each section and the next with the same keys. Within a stretch by a window; the last row of a
    stretch is followed by the first of the next one that has rows (a row for each stretch)."""
    order = F.struct(*keys, "seq", "section")
    rows = _stretches(sections, *keys)
    firsts = rows.groupBy("stretch").agg(F.min(order).alias("first"))
    borders = firsts.select("stretch", F.lead("first").over(Window.orderBy("stretch")).alias("border"))
    inside = rows.select("stretch", order.alias("own"), F.lead(order).over(Window.partitionBy("stretch").orderBy(*keys, "seq", "section")).alias("after"))
    joined = inside.join(borders, "stretch").withColumn("after", F.coalesce("after", "border"))
    return joined.where(F.col("after").isNotNull() & _same("own", "after", keys)).select(F.col("own.section").alias("src"), F.col("after.section").alias("dst"))


def adjacency(sections: DataFrame) -> DataFrame:
    """Neighbours within a book."""
    return _follow(sections, "source", "book")


def temporal(sections: DataFrame) -> DataFrame:
    """Each section and the next of its source in reading order."""
    return _follow(sections, "source")


def _turns(sections: DataFrame) -> DataFrame:
    """(section, source, turn): the place in the source's own order, from 1. Numbers within a stretch,
    and what the stretches before it hold of the source (a row for each stretch and source in it)."""
    rows = _stretches(sections, "source")
    counts = rows.groupBy("stretch", "source").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("stretch", F.col("source").alias("of"), before.alias("before"))
    own = F.row_number().over(Window.partitionBy("stretch", "source").orderBy("seq", "section"))
    inside = rows.select("stretch", "section", "source", own.alias("own")).alias("r")
    joined = inside.join(offsets.alias("o"), (F.col("r.stretch") == F.col("o.stretch")) & F.col("source").eqNullSafe(F.col("of")))
    return joined.select("section", "source", (F.col("own") + F.col("before")).cast("int").alias("turn"))


#: Turns that share a key when they look up what is ahead of them.
_CHUNK = 65_536


def reading_order(sections: DataFrame, interleaved: bool = True, done: DataFrame | None = None) -> DataFrame:
    """Places from 1: one section of each source in turn, or source after source; those that are
    ``done(section)`` are left out first. A place follows from the turn and from how many sections
    of each source come before: no window runs over all, or over a source.

    Interleaved, a turn holds its sources in order, and comes after what the turns before it hold."""
    if done is not None:
        sections = sections.join(done, "section", "left_anti")
    rows = written(_turns(sections), "turns")
    sizes = rows.groupBy("source").agg(F.max("turn").cast("long").alias("n"))
    if not interleaved:
        before = F.coalesce(F.sum("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = sizes.select(F.col("source").alias("of"), before.alias("before"))
        placed = rows.join(offsets, F.col("source").eqNullSafe(F.col("of")))
        return placed.select("section", "source", "turn", (F.col("turn") + F.col("before")).alias("place"))
    # between two sizes every turn holds the same number of sources
    ends = sizes.groupBy(F.col("n").alias("end")).agg(F.count("*").alias("stop"))
    by_end = Window.orderBy("end")
    spans = ends.select("end", (F.coalesce(F.lag("end").over(by_end), F.lit(0)) + 1).alias("start"), F.sum("stop").over(by_end.rowsBetween(0, Window.unboundedFollowing)).alias("width"))
    held = (F.col("end") - F.col("start") + 1) * F.col("width")
    ahead = F.coalesce(F.sum(held).over(by_end.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.withColumn("ahead", ahead).withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / _CHUNK), F.floor(F.col("end") / _CHUNK))))
    nth = F.row_number().over(Window.partitionBy("chunk", "turn").orderBy("source"))
    rows = rows.withColumn("chunk", F.floor(F.col("turn") / _CHUNK)).withColumn("nth", nth).alias("r")
    inside = (F.col("r.chunk") == F.col("s.chunk")) & (F.col("turn") >= F.col("start")) & (F.col("turn") <= F.col("end"))
    place = F.col("ahead") + (F.col("turn") - F.col("start")) * F.col("width") + F.col("nth")
    return rows.join(spans.alias("s"), inside).select("section", "source", "turn", place.cast("long").alias("place"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("dst"), F.col("src"), *[F.col(c) for c in edges.columns[2:]]))


def discovery(conceptual_edges: DataFrame, structural: DataFrame, sections: DataFrame, k: int = 100) -> DataFrame:
    """Overlapping pairs that stand in no structural relation nor in one book: across
    sources first, then by overlap; of twins (same books and overlap) the first."""
    known = both_ways(structural.select("src", "dst")).distinct()
    new = conceptual_edges.join(known.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    of = lambda x: sections.select(F.col("section").alias(x), F.col("book").alias(f"book_{x}"), F.col("source").alias(f"source_{x}"))
    new = new.join(of("a"), "a").join(of("b"), "b").where("book_a <> book_b")
    new = new.withColumns({"across": (F.col("source_a") != F.col("source_b")).cast("int"), "overlap": F.round("overlap", 6)})
    twin = Window.partitionBy(F.least("book_a", "book_b"), F.greatest("book_a", "book_b"), "overlap").orderBy(F.desc("across"), "a", "b")
    new = new.withColumn("twin", F.row_number().over(twin)).where("twin = 1")
    return new.orderBy(F.desc("across"), F.desc("overlap"), "a", "b").limit(k).select("a", "b", "source_a", "source_b", "across", "overlap")


def ego(edges: DataFrame, node, kinds=None, k: int = 24) -> DataFrame:
    """The heaviest edges, (kind, src, dst, weight), of a node and their other ends."""
    own = edges.where((F.col("src") == node) | (F.col("dst") == node))
    if kinds:
        own = own.where(F.col("kind").isin(*kinds))
    other = F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src"))
    return own.select("kind", other.alias("other"), "weight").orderBy(F.desc("weight"), "kind", "other").limit(k)


def stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(
        F.count("*").alias("edges"), F.round(F.avg("weight"), 6).alias("mean_weight"), F.round(F.max("weight"), 6).alias("max_weight")
    )


def expand(seeds: DataFrame, edges: DataFrame, k: int = 2, discount: float = 0.5) -> DataFrame:
    """Seeds (concept, score) and the k best neighbours of each at a discount; best score."""
    near = both_ways(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("npmi")))
    best = Window.partitionBy("src").orderBy(F.desc("npmi"), "dst")
    near = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    more = seeds.join(near, seeds["concept"] == near["src"]).select(F.col("dst").alias("concept"), (F.col("score") * F.col("npmi") * discount).alias("score"))
    return seeds.select("concept", "score").unionByName(more).groupBy("concept").agg(F.max("score").alias("score"))


def graphml(edges: DataFrame) -> DataFrame:
    """GraphML lines in order: (part, line)."""
    from ..functions.text import xml_escape

    text = lambda c: xml_escape(F.col(c).cast("string"))
    edges = written(edges, "edges")  # it is read three times, and sampled to be sorted
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    lines = nodes.select(F.lit(1).alias("part"), F.format_string('<node id="%s"/>', text("id")).alias("line"))
    tags = F.format_string('<edge source="%s" target="%s"><data key="kind">%s</data><data key="weight">%.6f</data></edge>', text("src"), text("dst"), text("kind"), F.col("weight"))
    lines = lines.union(edges.select(F.lit(2), tags))
    ends = edges.sparkSession.createDataFrame(
        [(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="undirected">'), (3, "</graph></graphml>")], "part int, line string"
    )
    return lines.union(ends).orderBy("part", "line")
