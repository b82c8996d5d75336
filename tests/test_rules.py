"""Constraints and the snapshot document."""

import json

from compare import connect
from conftest import DATA
from pyspark.sql import functions as F

from tessera.operators import rules, snapshot
from tessera.queries import ORACLES, QUERIES


def got(df):
    return {r["rule"]: (r["kind"], r["checked"], r["broken"], r["first"], r["last"]) for r in df.collect()}


def test_rules_of_all_kinds(spark):
    df = spark.createDataFrame([(1, "a_b", 3), (2, "A b", 3), (3, None, None), (4, "c", -1), (None, "?", 3)], "id int, slug string, n int")
    holds = {"slug": "slug RLIKE '^[a-z_]+$'", "n": F.col("n") > 0, "all": "true"}
    assert got(rules.rows(df, "id", holds)) == {"slug": ("row", 5, 3, "2", "3"), "n": ("row", 5, 2, "3", "4"), "all": ("row", 5, 0, None, None)}
    assert got(rules.rows(df.limit(0), "id", holds)) == {r: ("row", 0, 0, None, None) for r in holds}
    assert got(rules.unique(df, ["n"], "u")) == {"u": ("unique", 3, 1, "3", "3")}
    to = spark.createDataFrame([(3,), (3,), (None,)], "k int")
    assert got(rules.references(df, "n", to, "k", "r")) == {"r": ("reference", 2, 1, "-1", "-1")}
    assert got(rules.groups(df, "n", {"g": "size BETWEEN 2 AND 5"}, size=F.count("*"))) == {"g": ("group", 3, 2, "-1", "-1")}
    assert rules.report(x=[rules.rows(df, "id", holds)], y=[rules.unique(df, ["n"], "u")]).columns[0] == "of"


def test_rules_are_counted_while_a_table_is_written(spark, tmp_path):
    df, seen = rules.observed(spark.range(10), "id", {"even": "id % 2 = 0", "small": "id < 9"})
    df.write.parquet(f"{tmp_path}/t")
    assert [tuple(r) for _, r in sorted(seen.get.items())] == [("even", 10, 5, "1", "9"), ("small", 10, 1, "9", "9")]


def test_every_rule_kind_breaks_somewhere():
    rows = connect("/root/testdata/sf0.01").execute(ORACLES["constraints"]).df()
    assert set(rows["kind"][rows["broken"] > 0]) == {"row", "unique", "reference", "group"} and (rows["broken"] == 0).any()


def test_watchdog_shows_every_level():
    rows = connect("/root/testdata/sf0.01").execute(ORACLES["watchdog"]).df()
    assert set(rows["level"]) == {0, 1, 2}
    assert {c for f in rows["findings"] for c in f.split(",") if c} == {"A1", "A2", "A3", "A4", "W0", "W1", "W2", "W3", "W4"}


def test_snapshot_document(spark, tmp_path):
    rows = QUERIES["concept_snapshot"](spark, DATA)
    doc = json.loads(snapshot.document(rows).first()["json"])
    assert set(doc) == {"sections", "registry", "mean", "gate", "span", "reuse", "source", "size", "top", "across", "newest", "oldest", "sample", "last"}
    assert len(doc["top"]) == 15 and len(doc["newest"]) == 8 and {x["label"] for x in doc["gate"]} == {"created", "rejected"}
    snapshot.export(rows, str(tmp_path), "2024-01-01")
    latest = spark.read.text(f"{tmp_path}/latest").collect()
    assert latest == spark.read.text(f"{tmp_path}/2024-01-01").collect() and json.loads(latest[0][0]) == doc


def test_snapshot_of_nothing(spark):
    empty = lambda s: spark.createDataFrame([], s)
    out = snapshot.snapshot(empty("section int, concept int, weight double"), empty("section int, source string, seq int"), empty("concept int, name string, definition string, created int"), empty("section int, minted int, rejected int, ts timestamp, event_id int"))
    assert {(r["part"], r["label"]): r["n"] for r in out.collect()} == {("sections", "signed"): None, ("sections", "total"): None, ("registry", "concepts"): 0, ("mean", "size"): None, ("mean", "largest weight"): None, ("gate", "created"): 0, ("gate", "rejected"): 0}
