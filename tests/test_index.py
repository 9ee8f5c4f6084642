"""Inverted index of a document, made where it lies."""

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.plans import matching


def test_index_has_every_place_of_every_word(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "B", "b"]), (2, ["x"]), (3, [])], "id int, w array<string>")
    got = {r["id"]: r["i"] for r in rows.select("id", T.inverted(F.col("w")).alias("i")).collect()}
    assert got == {1: {"a": [1], "b": [0, 2, 4], "B": [3]}, 2: {"x": [0]}, 3: {}}


def test_rebuild_shuffles_nothing(spark):
    plan = matching.inverted_index_rebuild(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
