"""Vectors as blobs: float32 in little-endian order, as stores keep them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


@F.pandas_udf(BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    """The blob of an array of floats; of null, null. A null component is not a number."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def _decoded(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in blobs:
        yield batch.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


def from_blob(blob: Column, dim: int | None = None) -> Column:
    """struct(vector, fault): the vector of a blob, or why there is none. ``dim`` is the length that a
    vector is to have; null blobs have neither vector nor fault."""
    n = F.octet_length(blob)
    odd = F.when(n % 4 != 0, F.format_string("%d bytes are no whole number of components", n))
    wrong = F.lit(None).cast("string") if dim is None else F.when(n != 4 * dim, F.format_string("%d components, not %d", (n / 4).cast("int"), F.lit(dim)))
    fault = F.coalesce(odd, wrong)
    return F.struct(F.when(fault.isNull(), _decoded(blob)).alias("vector"), fault.alias("fault"))
