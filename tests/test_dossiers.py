"""The merge pass, evidence of drafts, entries, metrics of reports and blobs."""

import numpy as np
import pytest
from compare import connect
from pyspark.sql import functions as F

from tessera.functions import blobs
from tessera.operators import dossiers, merging
from tessera.queries import ORACLES


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_pass_with_chains_and_cycles(spark):
    vectors = spark.createDataFrame([(i, [float(np.cos(i / 20)), float(np.sin(i / 20))]) for i in range(6)] + [(9, [0.0, -1.0])], "id long, v array<double>")
    sig = spark.createDataFrame([(s, c, 1.0 / 3) for s, cs in enumerate([(0, 1, 2), (2, 3, 9), (2, 4, 9), (5, 9, 0)]) for c in cs], "section int, concept long, weight double")
    pairs = merging.shortlist(vectors, merging.usage(sig), 0.99)
    assert [(r["a"], r["b"], r["n_a"], r["n_b"]) for r in pairs.orderBy("a", "b").collect()][:3] == [(0, 1, 2, 1), (0, 2, 2, 3), (1, 2, 1, 3)]
    answers = spark.createDataFrame([(1, 0, True), (2, 0, False), (3, 2, True), (3, 2, True), (4, 3, True), (4, 2, True)], "a long, b long, merge boolean")
    found = merging.decide(pairs, answers, mechanical=2.0)
    assert {(r["a"], r["b"]): (r["how"], r["loser"], r["winner"]) for r in found.collect()}[(2, 3)] == ("answer", 3, 2)
    after, winners = merging.apply(spark, sig, found)
    assert rows_of(winners) == [(1, 0), (3, 2), (4, 2)]
    assert {(r["section"], r["concept"]): round(r["weight"], 6) for r in after.collect()}[(1, 2)] == round(2 / 3, 6)
    assert rows_of(merging.census(sig, after, winners)) == [(0, 0, 2, 2), (1, 0, 1, 2), (2, 2, 3, 3), (3, 2, 1, 3), (4, 2, 1, 3), (5, 5, 1, 1), (9, 9, 3, 3)]
    kept, none = merging.apply(spark, sig, merging.decide(pairs, mechanical=2.0))
    assert none.count() == 0 and kept.count() == sig.count()


def test_evidence_leaves_out_the_own_section_and_repeats(spark):
    pages = spark.createDataFrame([(1, 10, "a", [1.0, 0.0]), (2, 11, "a", [1.0, 0.1]), (3, 11, "a", [1.0, 0.05]), (4, 12, "a", [0.9, 0.2]), (5, 13, "b", [1.0, 0.0]), (6, 14, "b", [0.0, 1.0])], "id long, section int, source string, v array<double>")
    drafts = spark.createDataFrame([(10, 100, "x", 0.7, [1.0, 0.0]), (10, 101, None, 0.9, [1.0, 0.0]), (10, 102, "y", 0.3, [0.0, 1.0])], "draft int, query long, concept string, weight double, q array<double>")
    sig = spark.createDataFrame([(11, "x", 0.5), (11, "y", 0.5), (13, "z", 1.0)], "section int, concept string, weight double")
    got = rows_of(dossiers.gather(drafts, pages, sig, k=1).select("concept", "source", "section", "page", "overlap"))
    assert got == [("x", "a", 11, 3, 0.8), ("x", "b", 13, 5, 0.0), ("y", "b", 14, 6, None)]
    assert rows_of(dossiers.gather(drafts, pages, sig, k=1, most=1).select("concept", "section", "overlap")) == [("x", 11, 0.5), ("x", 13, 0.0)]


def test_entries_and_views(spark):
    pages = spark.createDataFrame([(1, 10, "a", "G 1:1", "word " * 10), (2, 11, "b", "H 2", "x")], "id long, section int, source string, ref string, text string")
    sig = spark.createDataFrame([(10, 7, 0.25, None), (10, 8, 0.75, "since")], "section int, concept int, weight double, rationale string")
    names = spark.createDataFrame([(7, "peace"), (8, "war")], "concept int, name string")
    assert rows_of(dossiers.page_concepts(pages, sig, names)) == [(1, 10, 7, "peace", 0.25, ""), (1, 10, 8, "war", 0.75, "since")]
    assert rows_of(dossiers.entries(pages, sig, names, 9)) == [(1, "[1] G 1:1 (a)  signature: war 0.75, peace 0.25\nword word [...]"), (2, "[2] H 2 (b)\nx")]


def test_metrics(spark):
    reports = spark.createDataFrame([(1, "However, scholars may not interpret this in context: however."), (2, None), (3, "Provisional and incomplete.")], "report int, text string")
    assert rows_of(dossiers.report_metrics(reports)) == [(1, 9, 6, 666.7, 0), (2, 1, 0, 0.0, 0), (3, 3, 0, 0.0, 2)]
    cited = spark.createDataFrame([(1, "ab:1", True), (1, "ab:2", False), (1, None, True), (2, "c", None)], "report int, page string, quote boolean")
    assert rows_of(dossiers.mix(cited, {"ab": "A"})) == [(1, "A", 2, 1), (1, "unknown", 1, 1), (2, "unknown", 1, 0)]


def test_blobs(spark):
    rows = [(1, [1.5, -2.0, float("inf")]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "id int, v array<float>").withColumn("blob", blobs.to_blob("v"))
    got = {r["id"]: r["x"] for r in df.select("id", blobs.from_blob(F.col("blob")).alias("x")).collect()}
    assert {i: (x["vector"], x["fault"]) for i, x in got.items()} == {1: (rows[0][1], None), 2: ([], None), 3: (None, None)}
    bad = df.where("id = 1").select(F.substring("blob", 1, 11).alias("b")).select(blobs.from_blob(F.col("b")).alias("x"), blobs.from_blob(F.substring("b", 1, 8), 3).alias("y")).first()
    assert bad["x"]["vector"] is None and "11 bytes" in bad["x"]["fault"] and bad["y"]["fault"] == "2 components, not 3"
    whole = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    back = whole.select("embedding", blobs.from_blob(blobs.to_blob("embedding"), 64).alias("x"))
    assert back.where("NOT (embedding <=> x.vector) OR x.fault IS NOT NULL").count() == 0


@pytest.mark.parametrize(("name", "column"), [("signal_harness", "shared"), ("draft_evidence", "overlap"), ("blob_codec", "fault")])
def test_rows_show_something(name, column):
    found = connect("/root/testdata/sf0.01").execute(ORACLES[name]).df()[column]
    assert found.nunique() > 1


def test_shortlist_compares_vectors_once(spark):
    vectors = spark.createDataFrame([(i, [float(np.cos(i / 20)), float(np.sin(i / 20))]) for i in range(6)], "id long, v array<double>")
    used = spark.createDataFrame([(1, 3)], "concept long, n long")
    pairs = merging.shortlist(vectors, used, 0.99)
    assert len(pairs.inputFiles()) > 0 and pairs.count() == pairs.where("a < b").count() > 0
