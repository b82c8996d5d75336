"""Cosine search by blocks and by a stored index of cells, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors

KINDS = "id long, v array<double>, source string"


def brute(rows, queries, k, per=False, floor=None):
    u = {i: np.array(v) / max(np.linalg.norm(v), 1e-300) for i, v, _ in rows if i is not None and v is not None}
    out = []
    for q, x in queries:
        got = sorted(((-round(float(np.array(x) / max(np.linalg.norm(x), 1e-300) @ u[i]), 6), i, s) for i, v, s in rows if i in u and i != q and len(v) == len(x)))
        got = [g for g in got if floor is None or -g[0] >= floor]
        for source in sorted({g[2] for g in got}) if per else [None]:
            out += [(q, *([source] if per else []), n + 1, i, 0.0 - s) for n, (s, i, _) in enumerate([g for g in got if not per or g[2] == source][:k])]
    return sorted(out)


def data(n, spread, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((12, 16))
    return [(i, (base[i % 12] + spread * rng.standard_normal(16)).tolist(), "ab"[i % 2]) for i in range(n)]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("rows", [4096, 40])
def test_nearest(spark, rows):
    table = data(150, 1.0) + [(500, None, "a"), (501, [0.0] * 16, "a"), (502, [1.0, 2.0], "b"), (None, [1.0] * 16, "b"), (600, data(1, 1.0)[0][1], "a"), (601, data(1, 1.0)[0][1], "a")]
    asked = [(i, v) for i, v, _ in data(150, 1.0) if i % 10 == 0] + [(501, [0.0] * 16)]
    corpus, queries = spark.createDataFrame(table, KINDS), spark.createDataFrame([*asked, (9, None)], "query long, q array<double>")
    near = lambda *a, **b: rows_of(vectors.nearest(queries, corpus, *a, rows=rows, **b))
    assert near(3) == brute(table, asked, 3)
    assert near(2, per="source") == brute(table, asked, 2, per=True)
    assert near(200, floor=0.3) == brute(table, asked, 200, floor=0.3)
    assert vectors.nearest(queries.limit(0), corpus).collect() == vectors.nearest(queries, corpus.limit(0)).collect() == []


@pytest.mark.parametrize("rows", [4096, 20])
def test_pairs_once(spark, rows):
    table = data(90, 0.5)
    df = spark.createDataFrame(table, KINDS)
    want = sorted({(min(q, i), max(q, i)) for q, _, i, s in brute(table, [(i, v) for i, v, _ in table], 90, floor=0.6)})
    assert sorted((r["a"], r["b"]) for r in vectors.similar_pairs(df, 0.6, rows).collect()) == want
    even, odd = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    assert sorted((min(r["a"], r["b"]), max(r["a"], r["b"])) for r in vectors.pairs_between(even, odd, 0.6, rows).collect()) == [p for p in want if (p[0] + p[1]) % 2]


@pytest.mark.parametrize(("spread", "skipped"), [(0.05, 0.5), (1.5, 0.0)])
def test_index_is_exact_and_skips_cells(spark, tmp_path, spread, skipped):
    table = data(400, spread)
    df = spark.createDataFrame([*table, (900, None, "a"), (901, [0.0] * 16, "b")], KINDS)
    vectors.write_index(df, str(tmp_path), rows=100)
    asked = [(i, v) for i, v, _ in table if i % 20 == 0]
    queries = spark.createDataFrame(asked, "query long, q array<double>")
    got, visits = vectors.search_index(spark, str(tmp_path), queries, 4, rows=7)
    assert rows_of(got) == brute(table, asked, 4)
    seen = visits.collect()
    assert len(seen) == len(asked) and 1 - sum(r["opened"] for r in seen) / sum(r["cells"] for r in seen) >= skipped
    high = vectors.search_index(spark, str(tmp_path), queries, 400, floor=0.9)[0]
    assert rows_of(high) == brute(table, asked, 400, floor=0.9)
    vectors.write_index(df.limit(0), f"{tmp_path}/none")
    assert vectors.search_index(spark, f"{tmp_path}/none", queries)[0].collect() == []


@pytest.mark.parametrize("rows", [16_384, 9])
def test_nearest_groups(spark, rows):
    # groups whose rows lie in several blocks, a null source and group, ties and vectors that take no part
    table = [(i, "ab"[i % 2] if i % 13 else None, f"g{i % 20}" if i % 7 else None, v) for i, v, _ in data(120, 0.6)]
    table += [(200 + i, s, g, v) for i, s, g, v in table[:9]] + [(300, "a", "g1", None), (301, "b", "g2", [1.0, 2.0]), (302, "a", "g3", [float("nan")] * 16)]
    corpus = spark.createDataFrame(table, "id long, source string, group string, v array<double>")
    asked = [(i, g, v) for i, _, g, v in table if i % 10 == 0 and v is not None and len(v) == 16]
    u = {i: np.array(v) / max(np.linalg.norm(v), 1e-300) for i, _, _, v in table if v is not None and len(v) == 16}
    want = []
    for q, own, x in asked:
        for source in ("a", "b", None):
            best = {}
            for i, s, g, _ in table:
                score = round(float(u[q] @ u[i]), 6) if i in u else float("nan")
                if s == source and g != own and score >= 0.2:
                    best[g] = min(best.get(g, (9.0, 0)), (-score, i))
            want += [(q, source, n + 1, i, -s) for n, (s, i) in enumerate(sorted(best.values())[:2])]
    name = lambda c: F.coalesce(c, F.lit("none"))
    queries = spark.createDataFrame(asked, "query long, own string, q array<double>").withColumn("own", name("own"))
    got = vectors.nearest_groups(queries, corpus.withColumns({"source": name("source"), "group": name("group")}), 2, 0.2, rows)
    assert sorted(map(str, map(tuple, got.withColumn("source", F.nullif("source", F.lit("none"))).collect()))) == sorted(map(str, want)) and len(want) > 40
    assert vectors.nearest_groups(queries.limit(0), corpus, 2).collect() == vectors.nearest_groups(queries, corpus.limit(0), 2).collect() == []


def test_small_cells_of_an_index_are_not_dealt(spark, tmp_path):
    df = spark.createDataFrame(data(400, 0.05), KINDS)
    vectors.write_index(df, str(tmp_path), pivots=24, rows=50)
    cells = spark.read.parquet(f"{tmp_path}/cells").collect()
    # a query is sent to every part of a cell it opens
    assert sum(c["n"] for c in cells) == 400 and all(len(c["parts"]) <= -(-c["n"] // 50) for c in cells) and min(len(c["parts"]) for c in cells) == 1
