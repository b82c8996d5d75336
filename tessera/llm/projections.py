"""Near-duplicate vectors by collision-counting projections.

Unit vectors are put on many one-dimensional Gaussian projections. A pair at the cosine floor
differs on each by a normal amount of known spread (``reach``), so that the probability of a
collision within a window centred on the vector is known and everything else follows from it:

* the projections come in tables of ``dims`` coarse ones and a sorted one. Two vectors meet in
  a table if they share its cell of coarse projections and lie within each other's window on the
  sorted one. The number of dims follows from the number of vectors (so that a cell holds about
  ``CELL_ROWS``), the number of tables from the share of pairs at the floor that may be missed;
* of a pair that meets, collisions within the window are counted over the projections of all tables
  (the first ``COUNTED`` of them). The count asked for is the largest that a pair at the floor reaches with a
  probability of 1 - ``COUNT_MISS``; what passes is verified by its cosine in double precision.

A pair is counted at its first table only, which both vectors' projections tell, so pairs are
never shuffled: a task returns sums of links for each vector and a spanning forest. Cells of more
than ``BLOCK_ROWS`` rows are dealt into blocks, and two blocks meet in a task. Equal vectors are
one row with a number of copies.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

FLOOR = 0.95
#: Share of pairs exactly at the floor that may meet in no table, or fail the count.
TABLE_MISS, COUNT_MISS = 0.002, 0.0005
#: Cell width and half window, as multiples of the spread of a pair at the floor.
CELL, WINDOW = 4.0, 2.0
CELL_ROWS, BLOCK_ROWS = 2_000, 8_192
#: Projections on which collisions are counted, at most: more would add cost, not certainty.
COUNTED = 64
_TILE, _FIRST = 512, 12


def _within(x: float) -> float:
    """P(|N(0, 1)| <= x)."""
    return math.erf(x / math.sqrt(2))


def _same_cell(width: float) -> float:
    """P(two values that differ by N(0, 1) fall into one cell of a randomly shifted grid)."""
    return _within(width) - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-width * width / 2))


def plan(n: int, floor: float = FLOOR, seed: int = 11) -> dict:
    """Numbers of dims and tables and the count, for ``n`` distinct vectors."""
    reach = math.sqrt(2 - 2 * floor)
    far = _same_cell(CELL * reach / math.sqrt(2))
    dims = max(1, math.ceil(math.log(max(n, 1) / CELL_ROWS) / -math.log(far))) if n > CELL_ROWS else 1
    meet = _same_cell(CELL) ** dims * _within(WINDOW)
    tables = math.ceil(math.log(TABLE_MISS) / math.log(1 - meet))
    m, p = min(tables * (dims + 1), COUNTED), _within(WINDOW)
    count, below = 0, 0.0
    while (below := below + math.comb(m, count) * p**count * (1 - p) ** (m - count)) <= COUNT_MISS:
        count += 1
    return {"dims": dims, "tables": tables, "counted": m, "count": count, "cell": CELL * reach, "window": WINDOW * reach, "floor": floor, "seed": seed}


@lru_cache(maxsize=8)
def _directions(dim: int, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, m)), rng.random(m)


def units(vectors) -> np.ndarray:
    x = np.stack(vectors).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def project(u: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Projections (row, table, place) and cells (row, table). Summed dimension by dimension: a
    row's values do not depend on the rows beside it, as those of a matrix product may."""
    a, shift = _directions(u.shape[1], p["tables"] * (p["dims"] + 1), p["seed"])
    out = np.zeros((len(u), a.shape[1]))
    for d in range(u.shape[1]):
        out += u[:, d, None] * a[d]
    out = out.reshape(len(u), p["tables"], p["dims"] + 1)
    at = np.floor(out[:, :, 1:] / p["cell"] + shift.reshape(p["tables"], -1)[:, 1:]).astype(np.int64)
    code = np.full(at.shape[:2], u.shape[1], np.int64)
    for k in range(p["dims"]):
        code = code * np.int64(1_000_003) + at[:, :, k]
    return out, code


def _cells(p: dict):
    def run(batches):
        for t in batches:
            for _, part in t.groupby(t["embedding"].map(len)):
                part = part.reset_index(drop=True)
                yield part.assign(cells=list(project(units(part["embedding"]), p)[1]))

    return run


def _forest(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after the links i - j: only links between different trees are looped over."""
    other = parent[i] != parent[j]
    if not other.any():
        return parent
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    for x, y in np.unique(np.stack([parent[i[other]], parent[j[other]]], 1), axis=0).tolist():
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    names = np.arange(len(parent))
    for x in up:
        names[x] = find(x)
    return names[parent]


def _count(p: dict) -> Callable:
    """Links of the rows of a cell, or of two of its blocks (``side`` 0 and 1; 2 is one block with
    itself), as (rid, links, root)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        table = int(key[1])
        u = units(rows["embedding"])
        proj, code = project(u, p)
        order = np.argsort(proj[:, table, 0], kind="stable")
        u, proj, code = u[order], proj[order], code[order]
        rid, copies, side = (rows[c].to_numpy()[order] for c in ("rid", "copies", "side"))
        lead, flat = proj[:, table, 0], proj.reshape(len(u), -1)[:, : p["counted"]].astype(np.float32)
        window, misses, n = p["window"], flat.shape[1] - p["count"], len(u)
        links, parent = np.zeros(n, np.int64), np.arange(n)
        for at in range(0, n, _TILE):
            end = min(n, at + _TILE)
            for left in range(at, stop := int(np.searchsorted(lead, lead[end - 1] + window, "right")), 4 * _TILE):
                right = min(stop, left + 4 * _TILE)
                open_ = np.abs(lead[at:end, None] - lead[None, left:right]) <= window
                open_ &= np.arange(at, end)[:, None] < np.arange(left, right)[None, :]
                if side[0] != 2:
                    open_ &= side[at:end, None] != side[None, left:right]
                for k in range(table):  # met in an earlier table: counted there
                    met = code[at:end, k, None] == code[None, left:right, k]
                    if met.any():
                        open_ &= ~(met & (np.abs(proj[at:end, k, 0, None] - proj[None, left:right, k, 0]) <= window))
                missed = np.zeros(open_.shape, np.uint8)
                for c in range(min(_FIRST, flat.shape[1])):
                    missed += np.abs(flat[at:end, c, None] - flat[None, left:right, c]) > window
                i, j = np.nonzero(open_ & (missed <= misses))
                i, j = i + at, j + left
                for some in range(0, len(i), 1 << 18):
                    x, y = i[some : some + (1 << 18)], j[some : some + (1 << 18)]
                    near = (np.abs(flat[x] - flat[y]) <= window).sum(1) >= p["count"]
                    x, y = x[near], y[near]
                    hit = np.einsum("ij,ij->i", u[x], u[y]) >= p["floor"]
                    x, y = x[hit], y[hit]
                    links += np.bincount(x, copies[y], n).astype(np.int64) + np.bincount(y, copies[x], n).astype(np.int64)
                    parent = _forest(parent, x, y)
        some = links > 0
        return pd.DataFrame({"rid": rid[some], "links": links[some], "root": rid[parent[some]]})

    return run


def near_duplicates(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", floor: float = FLOOR, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``vectors``, linked at a cosine of at least
    ``floor`` (which must be over 0). Pairs exactly at the floor are found with a probability of
    about 99.7 %, those above it more surely; none below it is linked.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an
    id, link with nothing (without an id: component null, not kept). Vectors of different lengths
    never link. Rows of a repeated id are vectors of their own. Other columns are ignored.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(column).alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False)) & F.col("id").isNotNull()
    distinct = rows.where(sound).groupBy("embedding").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    distinct = materialize(distinct.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    p = plan(distinct.count(), floor)
    kind = distinct.schema["embedding"].dataType.simpleString()
    celled = materialize(distinct.select("rid", "copies", "embedding").mapInPandas(_cells(p), f"rid long, copies long, embedding {kind}, cells array<long>"), "vector-cells")
    dealt = celled.select(F.size("embedding").alias("dim"), F.posexplode("cells").alias("table", "cell"), "rid", "copies", "embedding")
    big = celled.select(F.size("embedding").alias("dim"), F.posexplode("cells").alias("table", "cell"))
    big = big.groupBy("dim", "table", "cell").count().where(F.col("count") > block_rows)
    dealt = dealt.join(big.withColumn("blocks", F.ceil(F.col("count") / block_rows)).drop("count"), ["dim", "table", "cell"], "left")
    block = F.pmod(F.xxhash64("rid"), F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select("dim", "table", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rid", "copies", "embedding", side.alias("side"))
    found = materialize(dealt.groupBy("dim", "table", "cell", "i", "j").applyInPandas(_count(p), "rid long, links long, root long"), "vector-links")
    groups = components(found.select(F.col("rid").alias("src"), F.col("root").alias("dst")), "vector-groups")
    least = groups.withColumnRenamed("id", "rid").join(distinct.select("rid", "least"), "rid")
    least = least.join(least.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("rid", "component_id")
    known = distinct.join(found.groupBy("rid").agg(F.sum("links").alias("links")), "rid", "left").join(least, "rid", "left")
    known = known.select(F.col("embedding").alias("same"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.where(sound).join(known, F.col("embedding") == F.col("same")).select("id", "n_links", "component_id")
    out = out.unionByName(rows.where(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
