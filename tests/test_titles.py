"""Similarity of titles from numbers: the same as from texts, which only pairs that may hold each other meet."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import similarity as sim
from quillspark.functions import text as T
from quillspark.operators import linkage as L

TITLES = ["alpha beta gamma delta", "lpha beta gamma delt", "beta gamma", "alpha", "alpha alpha beta", "Alpha, beta gamma delta!", "the of alpha", "gamma delta epsilon zeta eta theta", "a b c d e alpha", "蛋白质组 alpha beta", "蛋白质组", "质组 alpha", "", "zeta beta alpha omega"]


def _side(spark, key, name):
    t = F.col("t")
    return spark.createDataFrame(list(enumerate(TITLES)), f"{key} long, t string").select(key, T.normalize(t).alias(name), T.tokens(t).alias("bag"), t.alias(f"{key}_t"))


@pytest.mark.parametrize("strict", [False, True])
def test_similarities_are_those_of_the_texts(spark, strict):
    a, b = _side(spark, "query_id", "na"), _side(spark, "work_id", "nb")
    wanted = a.drop("na").crossJoin(b.drop("nb").withColumnRenamed("bag", "other")).where(F.arrays_overlap("bag", "other"))
    wanted = wanted.select("query_id", "work_id", sim.title_similarity(F.col("query_id_t"), F.col("work_id_t"), strict).alias("s")).collect()
    got = L.title_similarities(a, b, "query_id", "work_id", strict).collect()
    assert len(wanted) > 40 and sorted(map(tuple, got)) == sorted(map(tuple, wanted))


def test_pairs_that_lack_tokens_do_not_meet_texts(spark):
    pairs = spark.createDataFrame([(0, 0, 0.5, 0.5, 8, 8), (0, 1, 1.0, 0.1, 8, 80), (1, 1, 0.7, 0.2, 6, 20)], "query_id long, work_id long, precision double, recall double, ls int, rs int")
    none = spark.createDataFrame([], "work_id long, nb string")
    a = spark.createDataFrame([(0, "x"), (1, "y")], "query_id long, na string")
    assert [tuple(r)[:2] for r in L.with_parts(pairs, a, none, "query_id", "work_id").collect()] == [(0, 0)]
