"""Vector near-duplicates and spelling variants against brute force."""

import collections
import re
import zlib

import numpy as np
import pytest
from conftest import DATA

from tessera.llm import projections, spelling
from tessera.llm.common import table


def brute_links(rows, floor=0.95):
    """id -> (links, component), by all pairs."""
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, up = collections.Counter(), {}

    def find(i):
        while up.get(i, i) != i:
            i = up[i]
        return i

    for a, (i, v) in enumerate(ok):
        for j, w in ok[:a]:
            if len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= floor:
                    n[i] += 1
                    n[j] += 1
                    x, y = find(i), find(j)
                    up[max(x, y)] = min(x, y)
    return {i: (n[i], find(i)) for i, _ in rows if i is not None}


def got_links(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


def test_vectors_of_all_kinds(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 24))
    rows = [(i, list(map(float, base[i % 6] + rng.normal(0, 0.22, 24)))) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(5)] + [(300, [2.0 * x for x in rows[1][1]])]
    rows += [(400, None), (401, []), (402, [0.0] * 24), (403, [1.0, None] * 12), (404, [float("nan")] * 24), (405, [float("inf")] * 24)]
    rows += [(500, [1e300, 0.0]), (501, [1e-300, 0.0]), (502, [1.0, 0.33]), (503, [1.0, 0.0, 0.0]), (504, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, component_id string")
    want = brute_links(rows)
    assert 60 < sum(n > 0 for n, _ in want.values()) and len({c for _, c in want.values()}) > 10
    assert got_links(projections.near_duplicates(df)) == want
    assert got_links(projections.near_duplicates(df, block_rows=7)) == want
    out = projections.near_duplicates(df.limit(0)).collect()
    assert out == []
    one = projections.near_duplicates(spark.createDataFrame([(None, [1.0]), (7, [1.0]), (7, [2.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["kept"]) for r in one) == [(0, 0, False), (7, 1, True), (7, 1, True)]


def test_recall_at_the_floor(spark):
    # 3,000 pairs at a cosine of 0.95 to 0.952 among vectors that are otherwise far apart
    rng = np.random.default_rng(5)
    u = rng.standard_normal((3000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.standard_normal((3000, 64))
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    c = rng.uniform(0.9501, 0.952, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([u, c * u + np.sqrt(1 - c * c) * w]))]
    got = got_links(projections.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert sum(got[i + 3000] == (1, i) for i in range(3000)) >= 2970
    assert all(n <= 1 for n, _ in got.values())


def test_plan_follows_the_rows():
    few, many = projections.plan(1_000), projections.plan(10**9)
    assert few["dims"] < many["dims"] and few["tables"] < many["tables"]


def brute_variants(rows):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(low)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if c >= 2 and len(w) >= 7}
    letters = {x for w in n for x in w}
    out, form = {}, {}
    for w in n:
        edits = {w[:i] + x + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) for x in (*letters, "") if j <= len(w)}
        near = [x for x in edits - {w} if x in n]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
        out[w] = len(near)
    roots = {}
    for w in n:
        roots[w] = w
        while form[roots[w]]:
            roots[w] = form[roots[w]]
    return {(w, form[w], roots[w], n[w], out[w], n.get(form[w])) for w in n}


@pytest.mark.parametrize("shard_words", [None, 3])
def test_variants(spark, monkeypatch, shard_words):
    docs = table(spark, DATA, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()][: None if shard_words is None else 40]
    rows += [(None, "spelling Spelling " * 30 + "speling speling spellingg spellingg"), (9, None), (10, ""), (11, "Äpfelbaum äpfelbaum ÷÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷÷")]
    # a chain: 300, 30 and 2 times
    rows += [(50_000 + i, "abcdefgh " * k) for i, k in ((0, 300),)] + [(50_001, "abcdefgx " * 30), (50_002, "abcdefxx " * 2)]
    rows += [(60_000 + i, "prefixes" + chr(97 + i % 26) + chr(97 + i // 26) + " ") for i in range(100) for _ in (0, 1)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, word int")
    if shard_words:
        monkeypatch.setattr(spelling.near_words, "__defaults__", (shard_words,))
    got = {tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = brute_variants(rows)
    assert got == want and any(w[1] and w[1] != w[2] for w in want)
    assert spelling.variants(df.limit(0)).collect() == []
