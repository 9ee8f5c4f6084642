"""Merging records of several sources: ordered first-wins, coalescing and overlaying merges, fallbacks.

Positions are explicit columns; nothing depends on the order in which rows arrive. Merges are plain
aggregations, so they combine before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def union_all(sources: list[DataFrame]) -> DataFrame:
    """All sources under each other, with source_rank by their place in the list."""
    return reduce(DataFrame.unionByName, [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)])


def interleave(sources: list[DataFrame], group: str, key: str, parts: int | None = None) -> DataFrame:
    """Ranked lists (with pos) of each group taken in turn, of each key the first row; place is the
    position in the result. With parts, dealt out by group, once, to so many partitions."""
    rows = union_all(sources)
    kept = first_wins(rows.repartition(parts, group) if parts else rows, [group, key], F.asc("pos"), F.asc("source_rank"))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("pos", "source_rank")))


def truthy(c: Column, kind: str) -> Column:
    """Not missing: neither null nor, by kind, an empty text, zero or a dash."""
    empty = {"string": (c == "") | (c == "—"), "number": c == 0}.get(kind)
    return c.isNotNull() if empty is None else c.isNotNull() & ~empty


def coalescing_merge(rows: DataFrame, key: list[str], pos: Column, first: dict[str, str], most: list[str], union: list[str]) -> DataFrame:
    """One row a key: of each field of `first` (name to kind) the first value that isn't missing, of
    `most` the largest, of `union` the distinct values in order of their first place, comma-joined."""
    picked = [F.min_by(F.col(c), F.when(truthy(F.col(c), kind), pos)).alias(c) for c, kind in first.items()]
    joined = [F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), F.col(c).alias("v")))), lambda x: x["v"])), ",").alias(c) for c in union]
    return rows.groupBy(*key).agg(*picked, *[F.max(c).alias(c) for c in most], *joined)


def overlay_merge(rows: DataFrame, key: list[str], pos: Column, last: dict[str, str], first: dict[str, str], most: list[str]) -> DataFrame:
    """One row a key: of `last` the last value that isn't missing, of `first` the first one."""
    late = [F.max_by(F.col(c), F.when(truthy(F.col(c), kind), pos)).alias(c) for c, kind in last.items()]
    early = [F.min_by(F.col(c), F.when(truthy(F.col(c), kind), pos)).alias(c) for c, kind in first.items()]
    return rows.groupBy(*key).agg(*late, *early, *[F.max(c).alias(c) for c in most])


def fallback(found: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """found, and for keys it has no row of, other's."""
    return found.unionByName(other.join(found.select(key).distinct(), key, "left_anti"))


def supplement(rows: DataFrame, extra: DataFrame, group: str, key: str, least: int, most: int) -> DataFrame:
    """rows, and for groups of less than `least` of them extra ones whose key isn't there yet; at most
    `most` a group, by source_rank and pos."""
    thin = extra.select(group).distinct().join(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), group, "left").where(F.coalesce("_n", F.lit(0)) < least).select(group)
    more = extra.join(thin, group, "left_semi").join(rows.select(group, key), [group, key], "left_anti")
    every = union_all([rows, more])
    return every.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("source_rank", "pos"))).where(F.col("place") <= most)
