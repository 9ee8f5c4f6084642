"""Tables between the steps of a query, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it gets a folder of its own, a cluster has to set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Stage:
    """Writes tables that a query reads more than once, and deletes them when it is done:

    with Stage(spark) as stage:
        words = stage(...)
        return stage.keep(...)

    What is kept is written, too, and stays until its reader deletes it. A lost executor costs its running
    tasks only."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def keep(self, table: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/quillspark-stage/{uuid.uuid4().hex}"
        table.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)

    def __call__(self, table: DataFrame) -> DataFrame:
        out = self.keep(table)
        self.paths += {f.rsplit("/", 1)[0] for f in out.inputFiles()}
        return out
