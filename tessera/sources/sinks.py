"""Keyed writes on immutable Parquet, and small artifacts."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Without the setting,
    only a local master has a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints"
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_partition(df: DataFrame, path: str, by: list[str], rebuilt: list[dict] | None = None) -> None:
    """Overwrite only the partitions that ``df`` has (a source, or a run's edges of a kind). Of
    the partitions named in ``rebuilt``, {column: value}, also those that have no rows now go;
    a null value names the partition of null."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    for part in rebuilt or []:
        same = [F.col(c).eqNullSafe(F.lit(part[c])) for c in by]
        if df.where(reduce(lambda x, y: x & y, same)).isEmpty():
            jvm = spark._jvm
            default = "__HIVE_DEFAULT_PARTITION__"
            folder = "/".join([path, *(f"{c}={default if part[c] is None else part[c]}" for c in by)])
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it lacks."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def update_where(df: DataFrame, condition, **values) -> DataFrame:
    return df.withColumns({c: F.when(condition, v if not isinstance(v, (str, int, float)) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def json_artifact(value: dict, path: str) -> None:
    """A small JSON file on the driver, complete or absent."""
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1)
    os.replace(tmp, path)


def append_log(df: DataFrame, path: str) -> None:
    df.withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("append").json(path)


def sql_rows(spark, statement: str, as_json: bool = False) -> DataFrame:
    """One text column of a statement's rows: ``a|b``, or JSON objects."""
    got = spark.sql(statement)
    line = F.to_json(F.struct("*")) if as_json else F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in got.columns])
    return got.select(line.alias("line"))
