"""Constraints of tables: rules on rows in one pass, uniqueness, references and sizes of groups.

Each check gives rows (rule, kind, checked, broken, first, last): how many rows (or keys, or
groups) were looked at, how many break the rule, and the first and last that do, as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _counts(holds: dict[str, Column | str], key: Column) -> list[Column]:
    """A struct for each rule; what is null does not hold."""
    out = []
    for name, rule in holds.items():
        broken = ~F.coalesce(F.expr(rule) if isinstance(rule, str) else rule, F.lit(False))
        ends = [f(F.when(broken, key)).cast("string").alias(n) for f, n in ((F.min, "first"), (F.max, "last"))]
        out.append(F.struct(F.lit(name).alias("rule"), F.count("*").alias("checked"), F.coalesce(F.count_if(broken), F.lit(0)).alias("broken"), *ends))
    return out


def rows(df: DataFrame, key: str, holds: dict[str, Column | str], kind: str = "row") -> DataFrame:
    """Rules that each row is to fulfil, all in one pass over ``df``."""
    found = df.agg(F.array(*_counts(holds, F.col(key))).alias("r")).select(F.explode("r").alias("r"))
    return found.select("r.rule", F.lit(kind).alias("kind"), "r.checked", "r.broken", "r.first", "r.last")


def observed(df: DataFrame, key: str, holds: dict[str, Column | str]) -> tuple[DataFrame, Observation]:
    """``df`` with the same rules counted while it is written or read elsewhere: no pass of its own.
    After an action the observation's ``get`` has a struct for each rule, by number."""
    seen = Observation()
    return df.observe(seen, *[c.alias(f"rule_{i}") for i, c in enumerate(_counts(holds, F.col(key)))]), seen


def unique(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys that more than one row has (a null is a key of its own)."""
    key = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    counted = df.select(F.struct(*keys).alias("k"), key.alias("key")).groupBy("k", "key").agg(F.count("*").alias("n"))
    return rows(counted, "key", {rule: F.col("n") == 1}, "unique")


def references(df: DataFrame, column: str, to: DataFrame, other: str, rule: str) -> DataFrame:
    """Values of a column that the other table lacks; nulls refer to nothing and are left out."""
    wanted = df.select(F.col(column).alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))
    there = to.select(F.col(other).alias("key"), F.lit(True).alias("there")).distinct()
    return rows(wanted.join(there, "key", "left"), "key", {rule: F.col("there")}, "reference")


def groups(df: DataFrame, by: str, holds: dict[str, Column | str], kind: str = "group", **measures: Column) -> DataFrame:
    """Rules on measures of the groups of a column."""
    return rows(df.groupBy(by).agg(*[m.alias(n) for n, m in measures.items()]), by, holds, kind)


def report(**tables: list[DataFrame]) -> DataFrame:
    """The checks of several tables, with the name of the table."""
    every = [found.select(F.lit(name).alias("of"), "*") for name, checks in tables.items() for found in checks]
    return reduce(DataFrame.unionByName, every)
