"""Keyed unions: maps as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows win."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    values = F.struct("_age", *[c for c in old.columns if c != key])
    return both.groupBy(key).agg(F.max(values).alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in old.columns if c != key])


def inserted_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows win."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def renumbered(*kinds: DataFrame, order: str) -> DataFrame:
    """Objects of several kinds in one sequence from 1: by kind as given, then by ``order``."""
    out = None
    for k, df in enumerate(kinds):
        df = df.withColumn("_kind", F.lit(k))
        out = df if out is None else out.unionByName(df)
    return out.withColumn("object_no", F.row_number().over(Window.orderBy("_kind", order)).cast("long")).drop("_kind")


def merged_maps(*columns: str):
    """Later maps win; sorted entries, since maps have no order."""
    entries = F.flatten(F.array(*[_aged(c, k) for k, c in enumerate(columns)]))
    ordered = F.array_sort(entries)
    last = F.filter(ordered, lambda e, i: (i == F.size(ordered) - 1) | (F.get(ordered, i + 1)["key"] != e["key"]))
    return F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def _aged(column: str, age: int):
    return F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("key"), F.lit(age).alias("age"), e["value"].alias("value")))
