"""Few queries against many works: pairs are added up where the work lies."""

import re

from quillspark.operators import linkage as L


def _texts(spark):
    queries = spark.createDataFrame([(i, f"frequent word{i} {'twin ' * (i % 3)}word{i // 2}", ("title", "body")[i % 2], None) for i in range(8)], "query_id long, phrase string, mode string, year_hint int")
    works = spark.createDataFrame([(i, f"frequent word{i % 9}", f"frequent frequent twin word{i % 5} other{i}", 2000, 3, 1) for i in range(60)], "work_id long, title string, abstract string, year int, cited long, n_sources int")
    return queries, works


def test_pairs_are_not_dealt_out_again(spark):
    queries, works = _texts(spark)
    pairs = L.token_f1_pairs(queries, works, "query_id", "work_id", "phrase", "abstract", few=True)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(work_id" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, work_id", plan)
    assert L.parts_for(queries.crossJoin(spark.range(50_000)), works) == -(-8 * 50_000 * 60 // 500_000)


def test_few_queries_give_the_same_rows(spark):
    queries, works = _texts(spark)
    for rows in (lambda few: L.token_f1_pairs(queries, works, "query_id", "work_id", "phrase", "abstract", few), lambda few: L.ranked_matches(queries, works, few=few)):
        some, every = ([tuple(r) for r in rows(few).orderBy("query_id", "work_id").collect()] for few in (True, False))
        assert some == every and len(some) > 20
