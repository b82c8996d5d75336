"""The jobs: against SQL, on growing input, run again, and from the command line."""

import os
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from compare import connect, same
from conftest import DATA
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from jobs import queries, run_watch, term_index
from tessera.operators import watch
from tessera.streaming import watch as stream

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None), spark.conf.get("spark.sql.sources.partitionOverwriteMode", None)
    same(queries.QUERIES[name](spark, DATA), queries.ORACLES[name], connect(DATA))
    assert before == (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None), spark.conf.get("spark.sql.sources.partitionOverwriteMode", None))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_term_index_again_and_search(spark, tmp_path):
    docs = [(1, "src1", "en", "In the beginning\nthe word was\n"), (2, "src2", "fr", "le mot\n\n  \nun autre mot"), (3, None, "en", "the the the"), (4, "src1", None, None), (5, "src1", "en", " \n"), (None, "en", "fr", "x")]
    make = lambda d: spark.createDataFrame(d, "doc_id long, source string, lang string, text string").write.mode("overwrite").parquet(f"{tmp_path}/docs")
    make(docs)
    conf = term_index.config() | {"page_chars": 20}
    first = term_index.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", conf)
    read = lambda: (rows(spark.read.parquet(f"{tmp_path}/out/pages")), rows(spark.read.parquet(f"{tmp_path}/out/index/postings")))
    once = read()
    assert term_index.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", conf) == first and read() == once
    assert first["documents"] == 6 and {p[0] for p in once[0]} == {"1:p01", "1:p02", "2:p01", "3:p01", "none:p01"}
    assert ("1:p02", "src1 en 1:2-2") in {(p[0], p[2]) for p in once[0]}

    ask = spark.createDataFrame([("a", "the"), ("b", "src1"), ("c", "autre mot"), ("d", "mot autre"), ("e", None), ("f", "..."), ("g", "fr"), ("h", "en the")], "query string, phrase string")
    got = {}
    for r in term_index.search(spark, f"{tmp_path}/out", ask, conf=conf).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["page"])
    assert got == {"a": ["3:p01", "1:p01", "1:p02"], "b": ["1:p01", "1:p02"], "c": ["2:p01"], "g": ["none:p01", "2:p01"]}

    make([d for d in docs if d[1] != "src2"])  # a source that is gone leaves nothing behind
    term_index.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", conf)
    assert not {"2:p01"} & {p[0] for p in read()[0]}
    make([])
    assert term_index.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", conf) == {"documents": 0, "pages": 0, "postings": 0}


def test_search_opens_buckets_of_its_terms_only(spark, tmp_path, capsys):
    term_index.run(spark, f"{DATA}/documents.parquet", str(tmp_path))
    ask = spark.createDataFrame([("q", "the")], "query string, phrase string")
    plan = term_index.search(spark, str(tmp_path), ask)
    plan.explain("formatted")
    text = capsys.readouterr().out
    number = spark.range(1).select(F.expr("int(conv(substring(md5('the'), 1, 6), 16, 10) % 32)")).first()[0]
    assert "PartitionFilters" in text and f"bucket#" in text and f" = {number})" in text
    assert plan.count() == 8


def log_rows(n):
    at = datetime(2024, 3, 1)
    kinds = ["done", "done", "retry", "done", "empty", "done"]
    return [(i % 3, i, at + timedelta(minutes=7 * i, seconds=i % 5), kinds[i * 7 % 6], i % 17, i % 2, float(i * 37 % 400) * (2 if i > 600 else 1), "abcd"[i * i % 4]) for i in range(n)]


LOG = "run long, event_id long, ts timestamp, kind string, section long, minted long, elapsed double, concept string"
SAME = {f"{c}_of": c for c in ("run", "kind", "section", "minted", "elapsed", "concept")} | {"files_a_batch": 1, "limits": {"stall_minutes": 21}}


def test_watch_on_growing_input(spark, tmp_path):
    events = spark.createDataFrame(log_rows(900), LOG)
    add = lambda lo, hi: events.where(f"event_id >= {lo} AND event_id < {hi}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    start = lambda: run_watch.run(spark, f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/checkpoint", SAME)
    want = lambda n: rows(watch.verdicts(watch.measures(events.where(f"event_id < {n}")), SAME["limits"]))
    got = lambda: rows(run_watch.sections(spark, f"{tmp_path}/out").drop("day"))
    add(0, 250)
    assert start()["read"] == 250 and got() == want(250)
    assert start()["read"] == 0 and got() == want(250)
    add(250, 600)
    add(600, 601)
    assert start()["read"] == 351 and got() == want(601)
    runs = spark.read.parquet(f"{tmp_path}/out/runs")
    add(601, 900)
    assert start()["read"] == 299 and got() == want(900)
    runs = spark.read.parquet(f"{tmp_path}/out/runs")
    assert {r["run"]: r["done"] for r in runs.collect()} == {r: len([x for x in want(900) if x[0] == r]) for r in range(3)}
    found = {c for r in got() for c in r[-2].split(",")}
    assert {"A1", "A2", "A3", "A4", "W2", "W3"} <= found


def test_watch_goes_on_after_a_failure(spark, tmp_path):
    events = spark.createDataFrame(log_rows(300), LOG)
    for lo in (0, 100, 200):
        events.where(f"event_id >= {lo} AND event_id < {lo + 100}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    paths = f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    broken = SAME | {"concept_of": "CASE WHEN event_id = 250 THEN raise_error('broken') ELSE concept END"}
    with pytest.raises(StreamingQueryException):
        run_watch.run(spark, *paths, broken)
    kept = rows(run_watch.sections(spark, paths[1]).drop("day"))
    run_watch.run(spark, *paths, SAME)
    want = rows(watch.verdicts(watch.measures(events), SAME["limits"]))
    assert rows(run_watch.sections(spark, paths[1]).drop("day")) == want and set(kept) < set(want)


def brute(log):
    out = []
    for run in {e[0] for e in log}:
        done, empty, retries, before = [], 0, set(), None
        for e in sorted((e for e in log if e[0] == run), key=lambda e: (e[2], e[1])):
            silent = None if before is None else int((e[2] - before).total_seconds() // 1)
            before = e[2]
            empty += e[3] == "empty"
            if e[3] == "retry":
                retries.add(e[4])
            if e[3] == "done":
                done.append(e)
                last, pace = {x[4] for x in done[-100:]}, sorted(x[6] for x in done[-20:])
                mid = round((pace[(len(pace) - 1) // 2] + pace[len(pace) // 2]) / 2, 4)
                stop = max(sum(x[7] == c for x in done) for c in "abcd")
                out.append((run, e[1], e[2], len(done), empty, sum(x[5] for x in done), silent, sum(x[5] for x in done[-100:]), mid, stop, len(last), len(last & retries)))
    return sorted(out, key=str)


def test_measures_against_brute_force(spark):
    log = log_rows(700)
    assert rows(watch.measures(spark.createDataFrame(log, LOG))) == brute(log)
    assert watch.measures(spark.createDataFrame([], LOG)).collect() == []


def test_each_rule(spark):
    base = dict(run=1, event_id=1, ts=datetime(2024, 1, 1), done=200, empty=0, registry=10, silent_seconds=0, mint=0, pace=1.0, stop=0, recent=100, retried=0)
    cases = {
        "A1": {"silent_seconds": 901}, "A2": {"empty": 11}, "A3": {"registry": 2001}, "A4": {"pace": 300.5}, "W0": {"empty": 5},
        "W1": {"stop": 101}, "W2": {"retried": 41}, "W3": {"pace": 151.0}, "": {"silent_seconds": None, "empty": 4, "stop": 100, "retried": 40, "pace": 150.0, "mint": 35, "registry": 2000},
    }
    cases["A3,W3"] = {"mint": 36, "pace": 200.0}
    for code, change in cases.items():
        df = watch.verdicts(spark.createDataFrame([tuple((base | change).values())], watch.MEASURES))
        r = df.first()
        assert (r["findings"], r["level"]) == (code, 2 if "A" in code else 1 if code else 0)
    young = base | {"done": 19, "empty": 9, "pace": 999.0, "stop": 19, "retried": 100}
    few = spark.createDataFrame([tuple(young.values())], watch.MEASURES)
    assert watch.verdicts(few).first()["findings"] == ""  # too early for the rates
    assert watch.verdicts(few, twins=F.lit(6)).first()["findings"] == "W4"


def test_watch_with_nulls(spark, tmp_path):
    at = datetime(2024, 1, 1)
    log = [(1, 1, at, "done", None, None, None, None), (1, 2, at, "retry", None, 0, 0.0, "a"), (1, 3, at, "done", None, 2, 5.0, None), (None, 4, at, "done", 1, 1, 1.0, "a"), (1, None, at, "done", 1, 1, 1.0, "a"), (1, 5, None, "done", 1, 1, 1.0, "a"), (1, 6, at, None, 1, 1, 1.0, "a")]
    df = spark.createDataFrame(log, LOG)
    want = rows(watch.measures(df))
    assert want == [(1, 1, at, 1, 0, 0, None, 0, 0.0, 1, 1, 0), (1, 3, at, 2, 0, 2, 0, 2, 2.5, 2, 1, 1)]
    df.coalesce(1).write.parquet(f"{tmp_path}/events")
    run_watch.run(spark, f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/checkpoint", SAME)
    assert rows(run_watch.sections(spark, f"{tmp_path}/out").select(*spark.createDataFrame([], watch.MEASURES).columns)) == want
    assert stream.MEASURES == watch.MEASURES


def test_command_lines(tmp_path):
    call = lambda *a: subprocess.run([sys.executable, "-m", *a], cwd=ROOT, capture_output=True, text=True, timeout=300)
    got = call("jobs.term_index", "--documents", f"{DATA}/documents.parquet", "--out", f"{tmp_path}/index")
    assert got.returncode == 0 and "wrote" in got.stderr and os.path.isdir(f"{tmp_path}/index/index/postings"), got.stderr[-2000:]
    for new in (1000, 0):
        got = call("jobs.run_watch", "--events", f"{DATA}/events.parquet", "--out", f"{tmp_path}/watch", "--checkpoint", f"{tmp_path}/state")
        assert got.returncode == 0 and f"read {new} new events" in got.stderr, got.stderr[-2000:]


def test_watch_takes_a_large_batch_in_parts(spark, tmp_path, monkeypatch):
    from pyspark import cloudpickle

    monkeypatch.setattr(stream, "ROWS_OUT", 64)
    # the processor travels with its module, so that the workers see the small parts
    cloudpickle.register_pickle_by_value(stream)
    try:
        df = spark.createDataFrame(log_rows(700), LOG)
        df.orderBy(F.desc("ts")).coalesce(1).write.parquet(f"{tmp_path}/events")
        run_watch.run(spark, f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/checkpoint", SAME)
    finally:
        cloudpickle.unregister_pickle_by_value(stream)
    assert rows(run_watch.sections(spark, f"{tmp_path}/out").drop("day")) == rows(watch.verdicts(watch.measures(df), SAME["limits"]))
    frame = df.select("event_id", "ts", "kind", "section", "minted", "elapsed", "concept").toPandas()
    got = list(stream._in_order(iter([frame[300:], frame[:300]])))
    want = frame.sort_values(["ts", "event_id"])
    assert got == list(want.itertuples(index=False, name=None))
