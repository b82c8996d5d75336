"""Near-duplicate documents by DartMinHash signatures and banded joining.

A text is the multiset of its five-word shingles; a text of one to four words is one
shingle. The weight of a shingle is its count, and each unit of weight is a region of its
own ("the third occurrence of s"), so that the weighted Jaccard similarity is exact on
counts. Darts fall on every region as a Poisson process that depends on the region
alone: each has an arrival time and one of ``K`` coordinates. A text throws only the
darts that arrive before a time that gives it about K ln K + 2 K of them, whatever its
size, and keeps the earliest of each coordinate; where a coordinate is still empty, it
waits twice as long.

Equal texts are one class member from the start. Representatives of distinct texts are
joined on bands of ``ROWS`` coordinates: in each bucket all meet one head, and those that
fail against it meet, by an exact prefix filter on rare shingles, all members of their
buckets that are not yet of their class. Where these are many, stars with other heads
unite classes first. So no similar pair of a bucket is lost, and neither a large group nor a
common passage is expanded into all pairs. Every pair is verified on the exact weighted Jaccard similarity, at least ``SIMILARITY``.
A class is a connected component of verified pairs; its id is its least ``doc_id``.

Texts that are null or have no word are near nothing: each is a class of its own. Rows
without id take no part; rows that repeat an id are one document, similar to another if
any of its texts is, in the least of their classes. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialize, mix, release, take_turn, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
K = 240
ROWS = 8
#: Stars of a region go on while it has more pairs of unlike labels a row than this, and while
#: a round unites at least one label in ``YIELD``. ``SALTS`` spread the rows of one label.
PAIRS_PER_ROW, YIELD, SALTS = 2, 50, 16
_BATCH, _HELD = 128, 500_000  # texts whose darts are thrown together; regions that are held until then
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit regions of a text: shingles told apart by occurrence."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(h))):
        out = mix(out * _A + h[i : i + n])
    out.sort()
    fresh = np.append(True, out[1:] != out[:-1])
    start = np.flatnonzero(fresh)
    nth = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    out = np.where(nth > 0, mix(out + _C * nth.astype(np.uint64)), out)
    out.sort()
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays of regions."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def signatures(regions: list[np.ndarray], k: int = K) -> np.ndarray:
    """(texts, k) dart ids; every text has at least one region."""
    n = np.array([len(r) for r in regions])
    every, owner = np.concatenate(regions), np.repeat(np.arange(len(n)), n)
    limit = (k * math.log(k) + 2 * k) / n
    ids = np.full((len(n), k), _NONE)
    times = np.full((len(n), k), np.inf)
    since, pending = np.zeros(len(n)), np.arange(len(n))
    state = [np.arange(len(every)), np.zeros(len(every)), np.zeros(len(every), np.uint64)]
    while len(pending):
        at, time, turn = state
        parked: list[list[np.ndarray]] = []
        while len(at):
            # the next dart of every region that is still before its text's limit
            h = mix(every[at] + (turn + np.uint64(1)) * _B)
            arrival = time - np.log1p(-((h >> np.uint64(11)).astype(float) * 2.0**-53))
            inside = arrival < limit[owner[at]]
            parked.append([at[~inside], time[~inside], turn[~inside]])
            at, time, turn, h = at[inside], arrival[inside], turn[inside] + np.uint64(1), mix(h[inside] ^ _A)
            if not len(at):
                break
            cell = owner[at] * k + (h % np.uint64(k)).astype(np.int64)
            np.minimum.at(times.reshape(-1), cell, time)
            first = times.reshape(-1)[cell] == time
            ids.reshape(-1)[cell[first]] = mix(h[first])
        empty = (ids == _NONE).any(axis=1)
        pending = np.flatnonzero(empty)
        limit = np.where(empty, limit * 2, since)
        state = [np.concatenate(x) for x in zip(*parked, strict=True)]
        keep = empty[owner[state[0]]]
        state = [x[keep] for x in state]
    return ids


def bands_of(ids: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(texts, k // rows) band hashes as signed 64-bit numbers."""
    grouped = ids[:, : ids.shape[1] // rows * rows].reshape(len(ids), -1, rows)
    out = np.zeros(grouped.shape[:2], np.uint64) + np.arange(grouped.shape[1], dtype=np.uint64) * _C
    for i in range(rows):
        out = mix(out * _A + grouped[:, :, i])
    return out.view(np.int64)


def _sign(k: int, rows: int, size: int):
    def run(texts: pd.Series) -> pd.Series:
        take_turn("neardup")
        out: list[np.ndarray | None] = [None] * len(texts)
        own: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> None:
            order = sorted(range(len(own)), key=lambda i: len(held[i]))  # texts of one size take as many turns
            while order:
                part = [order.pop()]
                while order and len(part) < _BATCH and len(part) * len(held[part[0]]) < _HELD // 4:
                    part.append(order.pop())
                for i, b in zip(part, bands_of(signatures([held[i] for i in part], k), rows), strict=True):
                    out[own[i]] = np.append(len(held[i]), b)
            own.clear()
            held.clear()

        n_held = 0
        for i, text in enumerate(texts):
            if len(regions := shingles(text, size)):
                own.append(i)
                held.append(regions)
                n_held += len(regions)
                if n_held >= _HELD:
                    flush()
                    n_held = 0
        flush()
        release()
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<long>")


def _compare(size: int):
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        take_turn("neardup")
        out, last, shelf = [], None, None
        for a, b in zip(left, right, strict=True):
            if a != last:
                last, shelf = a, shingles(a, size)
            out.append(similarity(shelf, shingles(b, size)))
        return pd.Series(out, dtype=float)

    return F.pandas_udf(run, "double")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, floor: float, name: str) -> DataFrame:
    """``pairs(src, dst)`` with whether they are similar; written to the shared folder."""
    wanted = pairs.select(F.col("src").alias("doc_id")).union(pairs.select("dst")).distinct()
    own = materialize(texts.join(wanted, "doc_id", "left_semi"), f"{name}-texts")
    rows = pairs.join(own.withColumnsRenamed({"doc_id": "src", "text": "a"}), "src")
    rows = rows.join(own.withColumnsRenamed({"doc_id": "dst", "text": "b"}), "dst")
    similar = _compare(size)("a", "b") >= F.lit(floor - 1e-12)
    return materialize(rows.select("src", "dst", similar.alias("similar")), f"{name}-verified")


def _rare_regions(docs: DataFrame, near: DataFrame, size: int, similarity: float) -> DataFrame:
    """The rows by which the texts of ``near(doc_id, label, open)`` meet: the exact prefix filter. Two texts at the similarity s share one
    of the n - ceil(s n) + 1 regions that come first in any fixed order; here the rarest do,
    so that texts which share no more than a common passage do not meet."""
    parts = F.pandas_udf(lambda texts: pd.Series([shingles(t, size).view(np.int64) for t in texts], dtype=object), "array<long>")
    own = materialize(docs.join(near, "doc_id"), "neardup-near-texts")
    rows = own.select("doc_id", "label", "open", parts("text").alias("regions"))
    rows = rows.select("doc_id", "label", "open", F.size("regions").alias("n"), F.explode("regions").alias("region"))
    rows = materialize(rows, "neardup-regions")
    # the regions of one text alone come first, and meet nothing
    rows = rows.withColumn("c", F.count("*").over(Window.partitionBy("region"))).where("c > 1")
    per = Window.partitionBy("doc_id", "n")
    rows = rows.withColumns({"m": F.count("*").over(per), "r": F.row_number().over(per.orderBy("c", "region"))})
    rows = rows.withColumn("r", F.col("r") + F.col("n") - F.col("m"))
    rows = rows.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-9)) + 1)
    return materialize(rows.select("doc_id", "label", "open", "n", "region", "r"), "neardup-prefixes")


def _may_be_near(similarity: float):
    """Whether the lengths, and what is left after a common region of the prefixes, allow the similarity."""
    alike = F.least("n", "o_n") >= F.greatest("n", "o_n") * F.lit(similarity - 1e-12)
    overlap = F.ceil((F.col("n") + F.col("o_n")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9))
    return alike & (1 + F.least(F.col("n") - F.col("r"), F.col("o_n") - F.col("o_r")) >= overlap) & (F.col("open") | F.col("o_open"))


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]


def _leading(rows: DataFrame) -> DataFrame:
    """Of each region whose rows are of several labels, one open: its most frequent label
    and how many pairs of unlike labels it has."""
    per = rows.groupBy("region", "label").agg(F.count("*").alias("c"), F.max("open").alias("o"))
    made = per.groupBy("region").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("within"), F.count("*").alias("labels"), F.max("o").alias("o"))
    return made.where("labels > 1 AND o").select("region", F.col("m.label").alias("lead"), ((F.col("all") * F.col("all") - F.col("within")) / 2).alias("unlike"))


def _relabel(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """``rows`` with the labels that ``merges(id, label)`` unites; each merge is copied over
    salts, so that the rows of a hot label spread over tasks."""
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    new = merges.select(F.col("id").alias("label"), F.col("label").alias("new"), salts)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    got = salted.join(new, ["label", "salt"], "left").withColumn("label", F.coalesce("new", "label"))
    return got.select(*rows.columns)


def _star_rounds(rows: DataFrame, docs: DataFrame, size: int, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with fewer labels, and the verified pairs (src, dst, similar), None if none.

    While regions have many pairs of unlike labels, those of other labels meet one head
    of the region, another in each round; what is found alike becomes one label. A large group of
    near copies so ends in one label before all pairs of unlike labels are compared. It
    stops when few such pairs are left or a round unites little: no pair is lost, since
    what is still of unlike labels meets in ``_unlike``."""
    tried, turn = None, 0
    while True:
        turn += 1
        lead = materialize(_leading(rows), f"neardup-lead-{turn}")
        unlike = lead.agg(F.sum("unlike").alias("s")).first()["s"] or 0
        if unlike <= PAIRS_PER_ROW * rows.count():
            return rows, tried
        here = rows.join(lead.select("region"), "region")
        order = F.xxhash64("doc_id", F.lit(turn))
        heads = here.groupBy("region").agg(F.min(F.struct(order.alias("o"), *[F.col(c).alias(f"o_{c}") for c in ("doc_id", "label", "open", "n", "r")])).alias("h"))
        met = here.join(heads.select("region", "h.*"), "region").where((F.col("label") != F.col("o_label")) & F.coalesce(_may_be_near(similarity), F.lit(False)))
        met = met.select(*_pair("doc_id", "o_doc_id"), *[f.alias(n) for f, n in ((F.least("label", "o_label"), "a"), (F.greatest("label", "o_label"), "b"))]).distinct()
        met = materialize(met, f"neardup-met-{turn}")
        if tried is not None:
            met = met.join(tried.select("src", "dst"), ["src", "dst"], "left_anti")
        checked = _verified(met.select("src", "dst"), docs, size, similarity, f"neardup-star-{turn}")
        tried = checked if tried is None else tried.union(checked)
        joined = met.join(checked.where("similar"), ["src", "dst"]).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        merges = components(joined, f"neardup-labels-{turn}")
        united, of = merges.where("id <> label").count(), rows.select("label").distinct().count()
        if united:
            rows = materialize(_relabel(rows, merges), f"neardup-relabelled-{turn}")
        if united * YIELD < of:
            return rows, tried


def _unlike(rows: DataFrame, similarity: float) -> DataFrame:
    """All candidate pairs (src, dst) of unlike labels, one of them open. In a region one of the two
    is not of its most frequent label, so that a large class does not meet itself."""
    here = materialize(rows.join(_leading(rows).drop("unlike"), "region"), "neardup-unlike")
    minor = here.where("label <> lead").drop("lead").withColumnRenamed("region", "own")
    other = here.select("region", (F.col("label") != F.col("lead")).alias("o_minor"), *[F.col(c).alias(f"o_{c}") for c in ("doc_id", "label", "open", "n", "r")])
    once = ~F.col("o_minor") | (F.col("doc_id") < F.col("o_doc_id"))
    got = minor.join(other, (F.col("own") == F.col("region")) & (F.col("label") != F.col("o_label")) & _may_be_near(similarity) & once)
    return materialize(got.select(*_pair("doc_id", "o_doc_id")).distinct(), "neardup-pairs")


def classes(docs: DataFrame, similarity: float = SIMILARITY, k: int = K, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """doc_id, class_id, is_first: a row for each document with an id."""
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    content = F.sha2(F.coalesce("text", F.lit("")), 256)
    signed = materialize(docs.select("doc_id", content.alias("content"), _sign(k, rows, size)("text").alias("bands")), "neardup-bands")
    # equal texts: map-side combined minimum, then every document knows its representative; texts
    # of no word stay out of the join, and what it meets is written, so that a text of many copies is split
    worded = signed.where("bands IS NOT NULL")
    firsts = materialize(worded.groupBy("content").agg(F.min("doc_id").alias("rep")), "neardup-firsts")
    known = materialize(worded.join(firsts, "content"), "neardup-known")
    # the first number is the weight: similar texts have similar weights
    reps = known.where("doc_id = rep").select("doc_id", F.get("bands", F.lit(0)).alias("n"), F.posexplode(F.slice("bands", 2, k // rows)).alias("band", "key"))
    # the head of a bucket is the member that meets most others in all its buckets: of copies
    # that were each changed in their own way, most often the text that they were made from
    shared = reps.groupBy("band", "key").agg(F.count("*").alias("c")).where("c > 1")
    members = materialize(reps.join(shared, ["band", "key"]), "neardup-buckets")
    met = members.groupBy("doc_id").agg(F.sum("c").alias("met"))
    members = members.join(met, "doc_id")
    heads = members.groupBy("band", "key").agg(F.max(F.struct("met", (-F.col("doc_id")).alias("doc_id"), "n")).alias("h"))
    heads = heads.select("band", "key", (-F.col("h.doc_id")).alias("head"), F.col("h.n").alias("head_n"))
    members = materialize(members.drop("met", "c").join(heads, ["band", "key"]), "neardup-members")
    alike = lambda x, y: F.least(x, y) >= F.greatest(x, y) * F.lit(similarity - 1e-12)
    stars = members.where("doc_id <> head").select(F.col("head").alias("src"), F.col("doc_id").alias("dst"), alike("n", "head_n").alias("alike")).distinct()
    tried = _verified(stars.where("alike").select("src", "dst"), docs, size, similarity, "neardup")
    edges = tried.where("similar").select("src", "dst")
    failed = tried.where("NOT similar").select("src", "dst").union(stars.where("NOT alike").select("src", "dst"))
    found = components(edges, "neardup-cc")
    lone = members.select(F.col("doc_id").alias("id")).distinct()
    of = lone.join(found, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("label", "id").alias("label"))
    placed = members.join(of, "doc_id")
    left = placed.join(failed.withColumnsRenamed({"src": "head", "dst": "doc_id"}), ["head", "doc_id"], "left_semi")
    left = materialize(left.select("band", "key", "doc_id", "label"), "neardup-failed")
    if not left.isEmpty():
        near = placed.join(left.select("band", "key").distinct(), ["band", "key"], "left_semi").select("doc_id", "label").distinct()
        near = near.join(left.select("doc_id").distinct().withColumn("open", F.lit(True)), "doc_id", "left")
        near = near.withColumn("open", F.coalesce("open", F.lit(False)))
        rows, met = _star_rounds(_rare_regions(docs, materialize(near, "neardup-near"), size, similarity), docs, size, similarity)
        seen = tried.select(*_pair("src", "dst"))
        again = _unlike(rows, similarity).join(seen if met is None else seen.union(met.select("src", "dst")), ["src", "dst"], "left_anti")
        more = _verified(again, docs, size, similarity, "neardup-again")
        more = (more if met is None else more.union(met)).where("similar").select("src", "dst")
        if not more.isEmpty():
            found = components(edges.union(more), "neardup-cc2")
    own = known.select("doc_id", "rep").unionAll(signed.where("bands IS NULL").select("doc_id", F.col("doc_id").alias("rep")))
    own = own.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("class_id"))
    own = own.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return own.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("is_first"))
