"""The concept registry: gating of proposed concepts, merging, matching, health."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import written
from .vectors import best_of_ends


FOLDED = "run string, section long, concept string, weight double, minted boolean, threshold double"
#: The gate: threshold of an almost empty registry, of a very large one, and the size halfway.
START, MOST, HALF = 0.55, 0.92, 150.0


class Registry:
    """A run's registry: concepts in order of minting, with unit vectors in one growing matrix."""

    def __init__(self, start: float = START, most: float = MOST, half: float = HALF):
        self.gate, self.names, self.place, self.matrix = (start, most, half), [], {}, None

    def add(self, concept: str, vector) -> None:
        v, n = np.asarray(vector, float), len(self.names)
        if self.matrix is None:
            self.matrix = np.zeros((16, len(v)))
        elif n == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[n] = v / max(math.sqrt(v @ v), 1e-12)
        self.place[concept] = n
        self.names.append(concept)

    def commit(self, run, section, rows: dict[str, list]) -> list[tuple]:
        """The kept weights of one section, as rows of ``FOLDED``."""
        start, most, half = self.gate
        n, got, minted = len(self.names), {}, set()
        tau = 0.0 if n == 0 else most - (most - start) * half / (half + n)
        for concept, confidence, weight, vector in zip(rows["concept"], rows["confidence"], rows["weight"], rows["embedding"], strict=True):
            if not weight > 0:
                continue
            confidence = 0.5 if confidence is None or confidence != confidence else confidence
            if concept in self.place:
                target = concept
            elif confidence >= tau:
                self.add(concept, vector)
                minted.add(concept)
                target = concept
            elif self.names:
                target = self.names[int((self.matrix[: len(self.names)] @ np.asarray(vector, float)).argmax())]
            else:
                continue
            got[target] = got.get(target, 0.0) + weight
        total = sum(got.values())
        return [(run, section, c, w / total, c in minted, tau) for c, w in got.items()]


def in_order(rows: pd.DataFrame):
    """(section, rows) in order of ``ord`` and section, concepts by name; rows are a dict of lists, since
    a run has many sections of few rows."""
    rows = rows.sort_values(["ord", "section", "concept"], kind="stable")
    columns = {c: rows[c].tolist() for c in ("concept", "confidence", "weight", "embedding")}
    at, section = rows["ord"].to_numpy(), rows["section"].to_numpy()
    starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (section[1:] != section[:-1])]) if len(rows) else []
    for lo, hi in zip(starts, [*starts[1:], len(rows)], strict=True):
        yield section[lo], {c: v[lo:hi] for c, v in columns.items()}


def gate_fold(assignments: DataFrame, start: float = START, most: float = MOST, half: float = HALF, vectors: DataFrame | None = None) -> DataFrame:
    """Commit assignments in order under the rising novelty threshold.

    ``assignments(run, ord, section, concept, confidence, weight, embedding)``. The
    threshold of a section is fixed by the registry's size before its own new concepts; a
    known concept is kept, a new one enters at or over the threshold, else its weight
    goes to the nearest concept, or is lost while there is none. Serial by nature: each run
    is one ordered fold; runs are independent groups. Weights are scaled to sum 1. The stream
    of ``streaming.registry`` takes a run batch by batch instead of whole.

    Where few vectors serve all concepts they are given as ``vectors(key, embedding)``, which go to the
    driver and to every task; assignments then have ``key`` in place of ``embedding``, and those
    whose key has no vector take no part."""
    known = None if vectors is None else {r["key"]: np.asarray(r["embedding"], float) for r in vectors.select("key", "embedding").collect()}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        registry, out = Registry(start, most, half), []
        if known is not None:
            pdf = pdf[pdf["key"].isin(known)].assign(embedding=lambda t: t["key"].map(known))
        for section, rows in in_order(pdf):
            out += registry.commit(pdf["run"].iloc[0], section, rows)
        return pd.DataFrame(out, columns=[c.split()[0] for c in FOLDED.split(", ")])

    return assignments.groupBy("run").applyInPandas(fold, FOLDED)


def greedy_match(pairs: DataFrame, floor: float = 0.75) -> DataFrame:
    """One-to-one matching of (run, a, b, score), best first, both ends free: (run, a, b, score).

    By rounds over all runs at once: a pair that is the best of both its ends (ties: least a, then
    least b) is what the greedy order would take, whatever else is taken; then all pairs of taken
    ends go. Every round takes at least each run's best pair, and is written out. Pairs under
    the floor, with a null score or end take no part; of a repeated pair the best score counts."""
    order = F.struct((-F.col("score")).alias("less"), "a", "b")
    known = pairs.where(F.col("score") >= floor).where("a IS NOT NULL AND b IS NOT NULL AND NOT isnan(score)")
    left = written(known.groupBy("run", "a", "b").agg(F.max("score").alias("score")), "match")
    taken = None
    while not left.isEmpty():
        best = lambda end: left.groupBy("run", end).agg(F.min(order).alias(f"best_{end}"))  # noqa: E731, B023
        one = best("a").select("run", "best_a.*").join(best("b").select("run", "best_b.*"), ["run", "less", "a", "b"])
        new = written(one.select("run", "a", "b", (-F.col("less")).alias("score")), "matched")
        taken = new if taken is None else taken.unionByName(new)
        left = written(left.join(new, ["run", "a"], "left_anti").join(new, ["run", "b"], "left_anti"), "match")
    return left.select("run", "a", "b", "score") if taken is None else taken


def match_vectors(left: DataFrame, right: DataFrame, floor: float = 0.75, k: int = 16) -> DataFrame:
    """``greedy_match`` of all pairs of a row of ``left`` and one of ``right``, (id, v), by cosine: (a, b, score).

    The pairs over the floor are never held. Of every end that is free the k best free partners are
    searched; a pair that leads what is left of both its ends' lists is taken. When none leads
    both any more, the ends still free are searched again, with twice the k. After each search at
    least the best pair of all is taken, and a search that finds none ends the matching."""
    order = F.struct((-F.col("score")).alias("less"), "a", "b")
    taken = None
    while True:
        free = [t if taken is None else t.join(taken.select(F.col(end).alias("id")), "id", "left_anti") for t, end in ((left, "a"), (right, "b"))]
        lists = written(best_of_ends(*free, k, floor), "match-lists")
        if lists.isEmpty():
            return lists.select("a", "b", "score") if taken is None else taken
        new = None
        while new is None or not new.isEmpty():
            if new is not None:
                taken = new if taken is None else taken.unionByName(new)
                lists = written(lists.join(new.select("a"), "a", "left_anti").join(new.select("b"), "b", "left_anti"), "match-lists")
            one, two = (lists.where(F.col("end") == e).groupBy(e).agg(F.min(order).alias("best")).select("best.*") for e in "ab")
            new = written(one.join(two, ["less", "a", "b"]).select("a", "b", (-F.col("less")).alias("score")), "matched")
        k *= 2


def closure(spark, merges: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """The end of every merged concept: (concept, winner) of all but the winners.

    Merges (loser, winner) unite concepts whichever way they point, so that a concept merged
    into two, and a cycle, end in one group. Of a group the most used concept of
    ``usage(concept, n)`` wins; without it, or between equals, one that is never a loser, then
    the least. Least labels spread along the merges and jump over the labels found so far, by
    joins, until none moves; every round is written out, so that plans and memory stay small."""
    pairs = merges.select("loser", "winner").where("loser IS NOT NULL AND winner IS NOT NULL")
    both = written(pairs.toDF("src", "dst").union(pairs.select("winner", "loser")).distinct(), "closure-merges")
    labels = written(both.groupBy(F.col("src").alias("id")).agg(F.least("src", F.min("dst")).alias("label")), "closure")
    moved = True
    while moved:
        near = both.join(labels.toDF("src", "near"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("near").alias("near"))
        least = labels.join(near, "id").withColumn("near", F.least("label", "near"))
        far = least.join(labels.toDF("near", "far"), "near").select("id", F.col("label").alias("old"), F.least("near", "far").alias("label"))
        new = written(far, "closure")
        moved, labels = not new.where("label <> old").isEmpty(), new.select("id", "label")
    lost = pairs.where("loser <> winner").select(F.col("loser").alias("id")).distinct().withColumn("lost", F.lit(1))
    ranked = labels.join(lost, "id", "left")
    if usage is not None:
        ranked = ranked.join(usage.select(F.col("concept").alias("id"), F.col("n").alias("used")), "id", "left")
    used = F.coalesce("used", F.lit(0)) if usage is not None else F.lit(0)
    order = F.struct((-used).alias("used"), F.coalesce("lost", F.lit(0)).alias("lost"), "id")
    best = ranked.groupBy("label").agg(F.min_by("id", order).alias("winner"))
    return labels.join(best, "label").where("id <> winner").select(F.col("id").alias("concept"), "winner")


def trailing(events: DataFrame, value: str, rows: int, by: str = "run", order=("ts", "event_id")) -> Column:
    """Sum over the trailing rows of a run's log, the current one included."""
    return F.sum(value).over(Window.partitionBy(by).orderBy(*order).rowsBetween(1 - rows, 0))


def trailing_median(value: str, rows: int, by: str = "run", order=("ts", "event_id")) -> Column:
    """Exact median over trailing rows (``median`` takes no frame)."""
    frame = F.sort_array(F.collect_list(value).over(Window.partitionBy(by).orderBy(*order).rowsBetween(1 - rows, 0)))
    n = F.size(frame)
    return (F.get(frame, F.floor((n - 1) / 2).cast("int")) + F.get(frame, F.floor(n / 2).cast("int"))) / 2


def rolling_median(events: DataFrame, rows: int = 60, factor: float = 4.0) -> DataFrame:
    """Per run the median of the last accepted values; a value over ``factor`` times the
    median before it is counted but not accepted. An ordered fold for each run."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[float] = []
        out = []
        for r in pdf.sort_values(["ts", "event_id"]).itertuples():
            before = float(np.median(kept[-rows:])) if kept else None
            accepted = before is None or r.value <= factor * before
            if accepted:
                kept.append(r.value)
            out.append((r.run, r.event_id, accepted, float(np.median(kept[-rows:]))))
        return pd.DataFrame(out, columns=["run", "event_id", "accepted", "median"])

    return events.select("run", "event_id", "ts", "value").groupBy("run").applyInPandas(fold, "run long, event_id long, accepted boolean, median double")


def jaccard(left: Column, right: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))), F.lit(0.0))


def health(events: DataFrame, empty_share: float = 0.05, slow: float = 300.0) -> DataFrame:
    """One row per run: counts, shares and the worst finding (0 fine, 1 warn, 2 abort)."""
    got = events.groupBy("run").agg(
        F.count("*").alias("n"),
        F.round(F.avg((F.col("event") == "error").cast("double")), 6).alias("empty_rate"),
        F.round(F.median("value"), 6).alias("median_value"),
    )
    level = F.when((F.col("empty_rate") > empty_share) & (F.col("n") >= 30), 2).when((F.col("empty_rate") > empty_share / 2) | (F.col("median_value") > slow), 1)
    return got.withColumn("level", F.coalesce(level, F.lit(0)))
