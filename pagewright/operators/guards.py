"""Fail-closed checks: a guard is a table of violations that must be empty before anything is published."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Refused(ValueError):
    """A guard found a violation."""


def violations(df: DataFrame, rule: str, key: str | Column, when: Column | None = None) -> DataFrame:
    """``(rule, key)`` of the rows that break a rule."""
    rows = df if when is None else df.filter(F.coalesce(when, F.lit(True)))
    key = F.col(key) if isinstance(key, str) else key
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def require(*guards: DataFrame) -> None:
    """Raise ``Refused`` with the first violation, if there is one."""
    first = reduce(DataFrame.unionByName, guards).limit(1).collect()
    if first:
        raise Refused(f"{first[0]['rule']}: {first[0]['key']}")
