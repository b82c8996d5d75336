"""Packing by concatenate and cut: token sequences of a fixed length.

Pass one encodes every document once and writes the ids with the document's place in
its partition; a sum over the partitions' token totals (one row for each partition)
then gives each partition its global offset. Pass two cuts the one long stream into
windows of ``length`` ids, row by row and without a shuffle: a document that crosses a
window's end yields a boundary record on either side. Only the last window is short.

Null and empty texts give the end id alone. Repeated rows are packed as often as they
occur. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release, take_turn
from .tokens import END_ID, encoder, forget

LENGTH = 4096

_ENCODED = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("before", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
PIECES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)
_BATCH, _BYTES = 500, 64 << 20  # texts, and bytes of texts, that are encoded together


def _encode(path: str | None):
    def run(batches):
        take_turn("packing", forget)
        bpe, part, before = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], np.uint16).tobytes()
        for whole in batches:
            sizes, at = pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False), 0
            while at < whole.num_rows:
                n_rows = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + _BATCH]), _BYTES, side="right")))
                rows = whole.slice(at, n_rows)
                at += n_rows
                ids = [x.tobytes() + end for x in bpe.encode_batch(rows.column(1).to_pylist())]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                columns = [pa.array(np.full(len(n), part, np.int32)), rows.column(0), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, _ENCODED.names)
        release()

    return run


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pass one, written to the shared folder: ids are 16-bit little-endian."""
    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode(path), _ENCODED), "packing-ids")


def part_offsets(tokens: DataFrame) -> dict[int, int]:
    """Global offset of each partition of pass one; as many rows as it had tasks."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect()
    offsets, total = {}, 0
    for r in totals:
        offsets[r["part"]] = total
        total += r["n"]
    return offsets


def _cut(offsets: dict[int, int], length: int, with_ids: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for part, doc, before, n, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids, at, start = np.frombuffer(raw, np.uint16).astype("<u4"), offsets[part] + before, 0
                while start < n:
                    take = min(n - start, length - at % length)
                    piece = ids[start : start + take]
                    rows.append((doc, start, take, zlib.crc32(piece), n, at // length, at % length, *([piece.tolist()] if with_ids else [])))
                    start, at = start + take, at + take
            if not rows:
                continue
            columns = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:7]]
            if with_ids:
                columns.append(pa.array([r[7] for r in rows], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [*PIECES.names, *(["ids"] if with_ids else [])])

    return run


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece; with ``with_ids`` also the ids themselves."""
    tokens = encoded(docs, path)
    schema = T.StructType([*PIECES.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    return tokens.mapInArrow(_cut(part_offsets(tokens), length, with_ids), schema)
