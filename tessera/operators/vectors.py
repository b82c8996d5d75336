"""Cosine search and pairs: blocks and matrix products, and a stored index of cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import written

#: Vectors of a block at most: a task compares two blocks.
BLOCK_ROWS = 4_096
#: Rows of a block of searches of which only few rows of two blocks leave the task.
END_ROWS = 16_384


def _block(id_: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int")


def _units(vectors) -> np.ndarray:
    x = np.stack(list(vectors)).astype(float).reshape(len(vectors), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _by_dim(left: pd.DataFrame, x: str, right: pd.DataFrame, y: str) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Rows of either side whose vectors have one length."""
    a, b = left[x].map(len), right[y].map(len)
    for dim in sorted(set(a) & set(b)):
        yield left[a == dim], right[b == dim]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best finite scores of each row, ties to the smaller id."""
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k] if scores.shape[1] > k else np.full((len(scores), 1), -np.inf)
    i, j = np.nonzero((scores >= least) & np.isfinite(scores))
    order = np.lexsort((ids[j], -scores[i, j], i))
    i, j = i[order], j[order]
    turn = np.arange(len(i)) - np.searchsorted(i, i)
    return i[turn < k], j[turn < k]


def _block_best(k: int, per: str | None, floor: float | None, other: bool) -> Callable:
    """Of two blocks, queries and corpus, the k best of each query (and value of ``per``)."""

    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        asked, names = asked.rename(columns=lambda c: c.removeprefix("q_")), ["query", *([per] if per else []), "id", "score"]
        parts = []
        if len(asked) and len(rows):
            for qs, vs in _by_dim(asked, "q", rows, "v"):
                for value, group in vs.groupby(per, dropna=False) if per else ((None, vs),):
                    u, ids = _units(group["v"]), group["id"].to_numpy(dtype=object if group["id"].dtype.kind not in "iuf" else None)
                    for at in range(0, len(qs), 512):
                        some = qs.iloc[at : at + 512]
                        scores = np.round(_units(some["q"]) @ u.T, 6)
                        asks = some["query"].to_numpy(dtype=object if some["query"].dtype.kind not in "iuf" else None)
                        if other:
                            scores[asks[:, None] == ids[None, :]] = -np.inf
                        if floor is not None:
                            scores[scores < floor] = -np.inf
                        i, j = _best(scores, ids, k)
                        parts.append([asks[i], *([np.full(len(i), value, object)] if per else []), ids[j], scores[i, j]])
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [[] for _ in names]
        return pd.DataFrame({n: pd.Series(c, dtype=getattr(c, "dtype", object)) for n, c in zip(names, columns, strict=True)})

    return run


def _types(queries: DataFrame, corpus: DataFrame, per: str | None) -> str:
    kind = lambda t, c: t.schema[c].dataType.simpleString()
    return ", ".join([f"query {kind(queries, 'query')}", *([f"{per} {kind(corpus, per)}"] if per else []), f"id {kind(corpus, 'id')}", "score double"])


def _ranked(rows: DataFrame, k: int, per: str | None) -> DataFrame:
    group = ["query", *([per] if per else [])]
    best = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(*group, "rank", "id", "score")


def nearest(
    queries: DataFrame, corpus: DataFrame, k: int = 8, per: str | None = None, floor: float | None = None, other: bool = True, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Cosine top-k of (query, q) in (id, v[, per]): in all, or for each value of ``per``.

    Both sides are dealt into blocks by their number of rows; two blocks meet in a task, by one
    matrix product, and only the k best of each query leave it. Rows without id or vector take
    no part, vectors of different lengths are not compared, and a zero vector scores 0."""
    asked = queries.where("query IS NOT NULL AND q IS NOT NULL").select("query", "q")
    there = corpus.where("id IS NOT NULL AND v IS NOT NULL").select("id", "v", *([per] if per else []))
    m = max(1, -(-asked.count() // rows))
    n = max(-(-there.count() // rows), -(-corpus.sparkSession.sparkContext.defaultParallelism // m))
    x = asked.select(F.col("query").alias("q_query"), F.col("q").alias("q_q"), _block("query", m).alias("q_i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("q_j"))
    y = there.withColumns({"j": _block("id", n), "i": F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
    found = x.groupBy("q_i", "q_j").cogroup(y.groupBy("i", "j")).applyInPandas(_block_best(k, per, floor, other), _types(queries, corpus, per))
    return _ranked(found, k, per)


def nearest_groups(queries: DataFrame, corpus: DataFrame, k: int, floor: float | None = None, rows: int = END_ROWS) -> DataFrame:
    """(query, source, rank, id, score): for each (query, own, q) and each ``source`` of (id, source, group, v) the k
    best groups, each by its best row, without the group ``own``; ``source``, ``own`` and ``group``
    are strings. Of two blocks only k rows of each query and source leave the task: a group that is among the k
    best of all is among them where its best row is."""
    asked = queries.where("query IS NOT NULL AND q IS NOT NULL").select("query", "own", "q")
    there = corpus.where("id IS NOT NULL AND v IS NOT NULL").select("id", "source", "group", "v")
    m = max(1, -(-asked.count() // rows))
    n = max(-(-there.count() // rows), -(-corpus.sparkSession.sparkContext.defaultParallelism // m))
    x = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns], _block("query", m).alias("q_i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("q_j"))
    y = there.withColumns({"j": _block("id", n), "i": F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
    kind = lambda t, c: t.schema[c].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        left = left.rename(columns=lambda c: c.removeprefix("q_"))
        for qs, vs in _by_dim(left, "q", right, "v") if len(left) and len(right) else ():
            # rows of one source, then of one group, stand together
            vs = vs.sort_values(["source", "group", "id"])
            groups, sources = vs.groupby(["source", "group"], sort=False).ngroup().to_numpy(), vs.groupby("source", sort=False).ngroup().to_numpy()
            starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            u, ids, of_source, of_group = _units(vs["v"]), vs["id"].to_numpy(), vs["source"].to_numpy(dtype=object), vs["group"].to_numpy(dtype=object)
            first, of = of_group[starts], sources[starts]
            bounds = np.append(np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of))
            places = pd.Series(np.arange(len(first))).groupby(first).apply(np.array).to_dict()
            for at in range(0, len(qs), 256):
                some = qs.iloc[at : at + 256]
                scores = np.round(_units(some["q"]) @ u.T, 6)
                scores[~np.isfinite(scores) | (scores < (-np.inf if floor is None else floor))] = -np.inf
                best = np.maximum.reduceat(scores, starts, axis=1)
                for i, own in enumerate(some["own"]):
                    best[i, places.get(own, [])] = -np.inf
                for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                    part = best[:, lo:hi]
                    least = -np.partition(-part, k - 1, axis=1)[:, k - 1 : k] if hi - lo > k else np.full((len(part), 1), -np.inf)
                    i, g = np.nonzero((part >= least) & np.isfinite(part))
                    # of a group the least id with its best score; rows of a group are in order of id
                    s, a = part[i, g], starts[lo + g]
                    ends = np.append(starts[1:], len(ids))[lo + g]
                    row = np.array([a_ + int((scores[i_, a_:e_] == s_).argmax()) for i_, a_, e_, s_ in zip(i, a, ends, s, strict=True)], np.int64)
                    order = np.lexsort((ids[row], -s, i))
                    i, s, row = i[order], s[order], row[order]
                    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
                    parts.append((some["query"].to_numpy()[i[kept]], of_source[row[kept]], of_group[row[kept]], ids[row[kept]], s[kept]))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, object)] * 5
        names = ["query", "source", "group", "id", "score"]
        return pd.DataFrame({n: pd.Series(c, dtype=c.dtype) for n, c in zip(names, columns, strict=True)})

    types = f"query {kind(asked, 'query')}, source string, group string, id {kind(there, 'id')}, score double"
    found = x.groupBy("q_i", "q_j").cogroup(y.groupBy("i", "j")).applyInPandas(run, types)
    once = F.row_number().over(Window.partitionBy("query", "source", "group").orderBy(F.desc("score"), "id"))
    rank = F.row_number().over(Window.partitionBy("query", "source").orderBy(F.desc("score"), "id"))
    found = found.withColumn("n", once).where("n = 1").withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query", "source", "rank", "id", "score")


def _products(floor: float, own: bool) -> Callable:
    """Pairs of two blocks at or over the cosine floor, by one product of their matrices."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "score": np.zeros(0)}
        parts = []
        right = right.rename(columns=lambda c: c.removeprefix("o_"))
        for x, y in _by_dim(left, "v", right, "v") if len(left) and len(right) else ():
            u, v, ia, ib = _units(x["v"]), _units(y["v"]), x["id"].to_numpy(), y["id"].to_numpy()
            for at in range(0, len(u), 512):
                scores = np.round(u[at : at + 512] @ v.T, 6)
                i, j = np.nonzero(scores >= floor)
                a, b, s = ia[at + i], ib[j], scores[i, j]
                if own:
                    keep = a < b if key[0] == key[1] else a != b  # two blocks of one set meet once
                    a, b, s = np.minimum(a, b)[keep], np.maximum(a, b)[keep], s[keep]
                parts.append((a, b, s))
        if parts:
            out = dict(zip(out, map(np.concatenate, zip(*parts, strict=True)), strict=True))
        return pd.DataFrame(out)

    return run


def _dealt(left: DataFrame, right: DataFrame, own: bool, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides in blocks (i, j) and (o_i, o_j), each row once for every block that it meets."""
    least = 2 * left.sparkSession.sparkContext.defaultParallelism  # block pairs at least, to use all cores
    known = lambda t: t.where("v IS NOT NULL AND id IS NOT NULL").select(F.col("id").cast("long"), "v")
    left, right = known(left), known(right)
    few = math.isqrt(least - 1) + 1
    m = max(-(-left.count() // rows), few)
    n = m if own else max(-(-right.count() // rows), few)
    each = lambda lo, hi: F.explode(F.sequence(lo, hi))
    x = left.withColumn("i", _block("id", m)).withColumn("j", each(F.col("i") if own else F.lit(0), F.lit(n - 1)))
    y = right.withColumn("j", _block("id", n)).withColumn("i", each(F.lit(0), F.col("j") if own else F.lit(m - 1)))
    return x, y.select(F.col("id").alias("o_id"), F.col("v").alias("o_v"), F.col("i").alias("o_i"), F.col("j").alias("o_j"))


def _block_pairs(left: DataFrame, right: DataFrame, floor: float, own: bool, rows: int) -> DataFrame:
    x, y = _dealt(left, right, own, rows)
    return x.groupBy("i", "j").cogroup(y.groupBy("o_i", "o_j")).applyInPandas(_products(floor, own), "a long, b long, score double")


def similar_pairs(vectors: DataFrame, floor: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs a < b of (id, v) at or over the cosine floor. All pairs are compared once, as a registry
    of concepts needs: blocks by the number of rows, one matrix product for each two of them."""
    return _block_pairs(vectors, vectors, floor, True, rows)


def pairs_between(left: DataFrame, right: DataFrame, floor: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """All pairs (a, b, score) of a row of ``left`` and one of ``right``, (id, v), at or over the
    cosine floor, in the same way. No row's pairs are capped."""
    return _block_pairs(left, right, floor, False, rows)



def _leading(x: np.ndarray, ids: np.ndarray, y: np.ndarray, others: np.ndarray, k: int, floor: float) -> list[tuple]:
    """(id, other, score) of the k best of ``y`` for each row of ``x``, of those at or over the floor."""
    parts, width = [], 128
    groups = -(-len(y) // width)
    for at in range(0, len(x), 256):
        scores = x[at : at + 256] @ y.T
        bound = np.full(len(scores), floor)
        if groups > k:
            # k groups of columns have a score at or over the k-th best of the groups' best ones
            tops = np.maximum.reduceat(scores, np.arange(groups) * width, axis=1)
            bound = np.maximum(bound, np.partition(tops, groups - k, axis=1)[:, groups - k])
        i, j = np.nonzero(scores >= bound[:, None] - 2e-6)  # scores are rounded
        s = np.round(scores[i, j], 6)
        i, j, s = i[s >= floor], j[s >= floor], s[s >= floor]
        order = np.lexsort((others[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        parts.append((ids[at + i[first]], others[j[first]], s[first]))
    return parts


def best_of_ends(left: DataFrame, right: DataFrame, k: int, floor: float, rows: int = END_ROWS) -> DataFrame:
    """(end, a, b, score): the k best of ``right`` for every row of ``left`` (end ``a``) and the k best of
    ``left`` for every row of ``right`` (end ``b``), of (id, v), at or over the cosine floor; ties to
    the smaller id. Only k rows of each end leave two blocks."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        parts = []
        y = y.rename(columns=lambda c: c.removeprefix("o_"))
        for p, q in _by_dim(x, "v", y, "v") if len(x) and len(y) else ():
            u, v, a, b = _units(p["v"]), _units(q["v"]), p["id"].to_numpy(), q["id"].to_numpy()
            there, others = np.isfinite(u).all(axis=1), np.isfinite(v).all(axis=1)
            u, a, v, b = u[there], a[there], v[others], b[others]
            if len(u) and len(v):
                parts += [("a", i, j, s) for i, j, s in _leading(u, a, v, b, k, floor)]
                parts += [("b", j, i, s) for i, j, s in _leading(v, b, u, a, k, floor)]
        ends = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]) if parts else []
        columns = [np.concatenate(c) for c in list(zip(*parts, strict=True))[1:]] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame({"end": pd.Series(ends, dtype=object), "a": columns[0], "b": columns[1], "score": columns[2]})

    x, y = _dealt(left, right, False, rows)
    found = x.groupBy("i", "j").cogroup(y.groupBy("o_i", "o_j")).applyInPandas(run, "end string, a long, b long, score double")
    own, other = F.when(F.col("end") == "a", F.col("a")).otherwise(F.col("b")), F.when(F.col("end") == "a", F.col("b")).otherwise(F.col("a"))
    best = Window.partitionBy("end", "own").orderBy(F.desc("score"), "other")
    ranked = found.withColumns({"own": own, "other": other}).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("end", "a", "b", "score")


#: Pivots of an index at most; they go to the driver and to every task.
PIVOTS = 256


def write_index(vectors: DataFrame, path: str, pivots: int | None = None, rows: int = BLOCK_ROWS) -> None:
    """Store (id, v, ...) at ``path`` by cell: the pivot with the largest cosine. ``pivots`` of the
    vectors themselves are drawn by the hash of their ids (default: the square root of their
    number, ``PIVOTS`` at most). ``cells`` has each cell's pivot, size and radius, the largest
    angle between its pivot and a vector; large cells are dealt over parts. All vectors are to
    have one length; rows without id, or with a null or zero vector, are left out."""
    known = vectors.where("id IS NOT NULL").where(F.exists("v", lambda x: x != 0))
    n = known.count()
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, pivots or math.isqrt(n) + 1)).select("v").collect()
    base = _units([r["v"] for r in drawn]) if drawn else np.zeros((0, 1))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            cosines = _units(t["v"]) @ base.T
            cell = cosines.argmax(axis=1)
            yield t.assign(cell=cell.astype(np.int32), angle=np.arccos(np.clip(cosines[np.arange(len(t)), cell], -1, 1)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema)
    placed = known.mapInPandas(place, f"{kinds}, cell int, angle double")
    placed = written(placed, "vector-cells")
    # a cell is dealt over as many parts as its own size asks for
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))  # at most PIVOTS rows
    placed = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    placed.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    stored = vectors.sparkSession.read.schema(f"{kinds}, angle double, part int, cell int").parquet(f"{path}/vectors")
    sizes = stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"), F.collect_set("part").alias("parts"))
    of = vectors.sparkSession.createDataFrame([(i, p.tolist()) for i, p in enumerate(base)], "cell int, pivot array<double>")
    sizes.join(of, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 8, floor: float | None = None, other: bool = True, probe: int = 2, rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The exact k best of (query, q), as ``nearest`` gives them, and (query, cells, opened).

    The angle to a vector is at least the angle to its cell's pivot less the cell's radius. First
    the ``probe`` cells with the best bound are opened for each query; then those, and only
    those, whose bound reaches the k-th score found. Of the files only opened cells are read."""
    cells = spark.read.schema("cell int, n long, radius double, parts array<int>, pivot array<double>").parquet(f"{path}/cells").collect()  # at most PIVOTS
    base = _units([c["pivot"] for c in cells]) if cells else np.zeros((0, 1))
    number, radius = np.array([c["cell"] for c in cells], np.int32), np.array([c["radius"] for c in cells])
    kind = queries.schema["query"].dataType.simpleString()

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            if not len(cells) or not len(t):
                continue
            angle = np.arccos(np.clip(_units(t["q"]) @ base.T, -1, 1))
            most = np.cos(np.maximum(angle - radius, 0)) + 2e-6  # scores are rounded
            turn = np.argsort(np.argsort(-most + 1e-9 * angle, axis=1), axis=1)
            at = np.repeat(np.arange(len(t)), len(cells))
            yield pd.DataFrame({"query": t["query"].to_numpy()[at], "cell": np.tile(number, len(t)), "most": most.ravel(), "turn": turn.ravel().astype(np.int32)})

    asked = queries.where("query IS NOT NULL").where(F.exists("q", lambda x: x != 0)).select("query", "q")
    reach = asked.mapInPandas(bounds, f"query {kind}, cell int, most double, turn int")
    stored = spark.read.parquet(f"{path}/vectors") if cells else None
    blocks = max(1, -(-asked.count() // rows))
    parts = spark.createDataFrame([(c["cell"], p) for c in cells for p in c["parts"]], "cell int, part int")

    def score(visits: DataFrame) -> DataFrame:
        opened = [r["cell"] for r in visits.select("cell").distinct().collect()]
        x = visits.join(asked, "query").join(parts, "cell").select(F.col("query").alias("q_query"), F.col("q").alias("q_q"), F.col("cell").alias("q_cell"), F.col("part").alias("q_part"), _block("query", blocks).alias("q_block"))
        y = stored.where(F.col("cell").isin(opened)).select("id", "v", "cell", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        got = x.groupBy("q_cell", "q_part", "q_block").cogroup(y.groupBy("cell", "part", "block"))
        return got.applyInPandas(_block_best(k, None, floor, other), _types(queries, stored, None))

    if not cells:
        nothing = spark.createDataFrame([], f"query {kind}, rank int, id long, score double")
        return nothing, spark.createDataFrame([], f"query {kind}, cells int, opened long")
    first = reach.where(F.col("turn") < probe)
    early = _ranked(score(first), k, None)
    least = early.where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    rest = reach.where(F.col("turn") >= probe).join(least, "query", "left").where(F.col("most") >= F.coalesce("least", F.lit(-1.0 if floor is None else floor)))
    rest = rest.select("query", "cell")
    visits = first.select("query", "cell").unionByName(rest).groupBy("query").agg(F.lit(len(cells)).alias("cells"), F.count("*").alias("opened"))
    return _ranked(early.drop("rank").unionByName(score(rest)), k, None), visits
