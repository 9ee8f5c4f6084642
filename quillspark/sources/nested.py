"""Sources of nested JSON that may be broken or missing: what can't be read is counted, not raised."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BAD = "_unreadable"
STATUS = "source string, rows long, broken long, used boolean, reason string"


def parse(table: DataFrame, body: str, schema: str, into: str = "record") -> DataFrame:
    """table with `into`, the record in the JSON text of body by the declared schema (DDL), null where it can't
    be read, and `readable`. A null body is unreadable; what the schema doesn't name is ignored."""
    parsed = F.from_json(F.col(body), f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    rows = table.withColumn(into, parsed)
    readable = F.col(into).isNotNull() & F.col(f"{into}.{_BAD}").isNull()
    return rows.withColumn("readable", readable).withColumn(into, F.when(F.col("readable"), F.col(into).dropFields(_BAD)))


def gather(spark: SparkSession, paths: dict[str, str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, status): the readable records of all sources under each other, with their source, and a row for
    each source: how many records it has, how many are broken, whether it is used, and why not. A path that
    isn't there or holds nothing readable makes a status, and the others stay. Files that end too early give what comes before."""
    parts, failed = [], []
    for name, path in paths.items():
        try:
            lines = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").text(path)
        except AnalysisException as e:
            failed.append((name, 0, 0, False, e.getCondition() or type(e).__name__))
            continue
        parts.append(parse(lines.where("trim(value) <> ''"), "value", schema).withColumn("source", F.lit(name)))
    empty = spark.createDataFrame([], f"source string, record struct<{schema}>, readable boolean")
    every = reduce(DataFrame.unionByName, [p.select("source", "record", "readable") for p in parts], empty)
    names = spark.createDataFrame([(n,) for n in paths if n not in {f[0] for f in failed}], "source string")
    counts = every.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("readable")).alias("broken"))
    good = F.coalesce(F.col("rows") > F.col("broken"), F.lit(False))
    reason = F.when(good, None).when(F.col("rows").isNull(), "EMPTY").otherwise("UNREADABLE")
    status = names.join(counts, "source", "left").select("source", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("broken", F.lit(0)).alias("broken"), good.alias("used"), reason.alias("reason"))
    return every.where("readable").select("source", "record.*"), status.unionByName(spark.createDataFrame(failed, STATUS))
