"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
words_of = re.compile(WORD).findall
#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_SHARED = "/tmp/checkpoints"
#: Spark removes a query's shuffle files as it ends; else they wait for the driver to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    os.makedirs(LOCAL_SHARED, exist_ok=True)
    return f"file://{LOCAL_SHARED}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, a lost executor
    costs at most the tasks that were running, and what was shuffled leaves the disk."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` but for its columns of names that an operator is about to add."""
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])


def crc_mod(doc_id, n: int):
    """crc32 of the id as text, modulo n: the fold of a document."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Hashes(dict):
    """word -> 64-bit hash, kept for words seen lately (bounded)."""

    LIMIT = 250_000

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_turn: dict = {"of": None, "forget": None}


def release() -> None:
    """Gives memory that a Python worker has freed back to the machine."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def take_turn(of: str, forget=None) -> None:
    """Called in a Python worker by the operator ``of``. Workers outlive a stage: what the
    operator before this one has kept in this worker is given up (``forget``)."""
    if _turn["of"] != of:
        if _turn["forget"] is not None:
            _turn["forget"]()
        _turn.update(of=of, forget=forget)
    release()


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over uint64 arrays."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_FACTOR, _STEP, _PIECE = 0x9E3779B97F4A7C15, 4096, 1 << 20
_POWERS = np.cumprod(np.full(_STEP, _FACTOR, np.uint64))
#: Of each byte its value in a hash: 0 for white space.
_VALUES = np.where(np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)]), 0, np.arange(1, 257)).astype(np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, in order, without a Python object for each."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= _PIECE:
        return _word_hashes(raw)
    # long texts piece by piece, cut at white space
    blanks, out, start = np.append(np.flatnonzero(_VALUES[raw] == 0), len(raw)), [], 0
    while start < len(raw):
        stop = int(blanks[max(0, min(np.searchsorted(blanks, start + _PIECE), len(blanks) - 1))])
        out.append(_word_hashes(raw[start : stop + 1]))
        start = stop + 1
    return np.concatenate(out)


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    values = _VALUES[raw]
    inside = values != 0
    starts = np.flatnonzero(inside & ~np.append(False, inside[:-1])) if len(raw) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = starts[0]
    place = np.arange(first, len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    weights = _POWERS[place & (_STEP - 1)]
    if (far := int(place.max()) // _STEP) > 0:
        steps = np.cumprod(np.append(np.uint64(1), np.full(far, _POWERS[-1], np.uint64)))
        weights = weights * steps[place // _STEP]
    return mix(np.add.reduceat(values[first:] * weights, starts - first))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows_per_class: int, keep) -> DataFrame:
    """At most ``rows_per_class`` labelled documents of either class, by hash order.

    The limit is taken on ids alone; the bounded id list is then joined to the texts
    as a broadcast (at most ``2 * rows_per_class`` rows). Rows without id or label take
    no part; of a repeated id the largest label counts.
    """
    spark = docs.sparkSession
    known = (
        labels.select(F.col("doc_id"), F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & keep)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    rows = [r for y in (0, 1) for r in known.where(F.col("label") == y).orderBy(*order).limit(rows_per_class).collect()]
    ids = spark.createDataFrame([(r["doc_id"], r["label"]) for r in rows], known.schema)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def class_weights(labels: DataFrame, column: str, keep, of: np.ndarray) -> np.ndarray:
    """Weights that bring a sample with labels ``of`` back to the classes' shares of all labels."""
    share = {r["v"]: r["n"] for r in labels.where(keep & F.col(column).isin(0, 1)).groupBy(F.col(column).cast("int").alias("v")).agg(F.count("*").alias("n")).collect()}
    out = np.array([share.get(int(v), 1) / max(1, int((of == v).sum())) for v in of], float)
    return out / out.mean() if len(out) else out


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges(src, dst)``: (id, label), label the least id.

    Min-label hooking with pointer jumping. Every round is joins and map-side combined
    minima, so a hub spreads over tasks; each round is written to the shared folder.
    """
    both = edges.select("src", "dst").where("src <> dst").distinct()
    both = materialize(both.union(both.select(F.col("dst"), F.col("src"))).distinct(), f"{name}-edges")
    labels = materialize(both.groupBy(F.col("src").alias("id")).agg(F.least("src", F.min("dst")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        offers = (
            both.join(labels.withColumnsRenamed({"id": "src", "label": "offer"}), "src")
            .groupBy(F.col("dst").alias("id"))
            .agg(F.min("offer").alias("offer"))
        )
        hooked = labels.join(offers, "id").select("id", "label", F.least("label", "offer").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("label").alias("far"))
        new = hooked.join(jump, "near").select("id", F.least("near", "far").alias("label"), (F.least("near", "far") != F.col("label")).alias("moved"))
        new = materialize(new, f"{name}-{turn}")
        labels = new.select("id", "label")
        if new.where("moved").isEmpty():
            return labels
