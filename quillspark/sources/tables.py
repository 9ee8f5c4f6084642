"""Tables of the driver, and the bibliographic inputs derived from them by fixed expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as works: the first line is the title, the text the abstract, the source the journal."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("work_id"),
        T.first_line(F.col("text")).alias("title"),
        F.col("text").alias("abstract"),
        F.col("source").alias("container"),
        (F.col("doc_id") % 25 + 1995).cast("int").alias("year"),
        F.col("n_chars").alias("cited"),
        F.lit(1).alias("n_sources"),
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase"), T.search_mode(F.col("text")).alias("mode"), F.lit(None).cast("int").alias("year_hint"))


def sentences(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """(conv_id, turn, pos, sentence) of every conversation turn; whole as in T.sentences()."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"), whole=whole)).alias("pos", "sentence"))


def libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as works of five libraries, by what the tables say of them. Bits tell which libraries hold a
    work (all of them; English and German ones; labelled ones; those of 1000 characters or more; those of
    less than 4000), which know its DOI, and which its abstract."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("work_id")).distinct().withColumn("labelled", F.lit(True))
    w = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("work_id"), T.first_line(F.col("text")).alias("title"), "text", "lang", F.col("n_chars").alias("cited"), (F.col("doc_id") % 25 + 1995).cast("int").alias("year")).join(labels, "work_id", "left")
    held = (F.lit(True), F.col("lang").isin("en", "de"), F.col("labelled"), F.col("cited") >= 1000, F.col("cited") < 4000)
    english = F.when(F.col("lang") == "en", 8).otherwise(0)
    mask = sum((F.when(h, 1 << i).otherwise(0) for i, h in enumerate(held)), F.lit(0))
    return w.select("work_id", mask.alias("mask"), (F.lit(1 + 2 + 16) + english).alias("dois"), F.lit(1 + 4 + 8 + 16).alias("abstracts"), F.concat(F.lit("10.1000/w."), F.col("work_id").cast("string")).alias("doi"), "title", "text", "year", "cited")
