"""Places in an order of any length: no task holds more than a range of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.staging import Stage


def places(rows: DataFrame, group: list[str], order: list[Column], stage: Stage, into: str = "place") -> DataFrame:
    """rows with their place, from 1, in each group's total order; equal rows have neighbouring places.

    Rows are dealt by range of group and order and sorted there; what a group has in the ranges before is
    added up from one count for each group and range, and joined back. A group may be as long as the table."""
    keyed = [F.asc_nulls_first(g) for g in group] + order
    dealt = rows.repartitionByRange(*keyed).sortWithinPartitions(*keyed)
    dealt = stage(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = dealt.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_n")
    starts = counts.withColumn("_before", before).select(F.col("_range").alias("_of"), "_first", "_before", *[F.col(g).alias(f"_group{i}") for i, g in enumerate(group)])
    same = [F.col(g).eqNullSafe(F.col(f"_group{i}")) for i, g in enumerate(group)] + [F.col("_range") == F.col("_of")]
    return dealt.join(starts, same).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int").alias(into))
