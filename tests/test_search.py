"""Relevance search: equal questions are searched for once, and sums stay where documents lie."""

from quillspark.functions import text as T
from quillspark.operators import linkage, search, topk
from quillspark.plans import records
from quillspark.sources.staging import Stage


def _tables(spark, n_asks: int, n_docs: int):
    asks = spark.createDataFrame([(i, "alpha Beta" if i % 2 else "beta, alpha; beta") for i in range(n_asks)] + [(n_asks, ""), (n_asks + 1, None), (n_asks + 2, "nowhere")], "ask long, said string")
    docs = spark.createDataFrame([(i, "alpha " * (i % 4) + "beta gamma") for i in range(n_docs)] + [(n_docs, ""), (n_docs + 1, None)], "doc long, body string")
    return asks, docs


def test_equal_questions_are_scored_once(spark, monkeypatch):
    """F2: scored pairs grow with the documents, not with documents times equal asks."""
    seen, top = [], search.top
    monkeypatch.setattr(search, "top", lambda table, *a: seen.append(table.count()) or top(table, *a))
    asks, docs = _tables(spark, 40, 20)
    found = search.bm25(asks, docs, "ask", "doc", "said", "body", k=2).collect()
    assert seen == [20]
    rows = {}
    for r in found:
        rows.setdefault(r["ask"], []).append((r["rank"], r["doc"], r["score"]))
    assert set(rows) == set(range(40)) and len({tuple(sorted(x)) for x in rows.values()}) == 1
    assert [doc for _, doc, _ in sorted(rows[0])] == [3, 7]


def test_sums_are_dealt_out_in_proportion_to_pairs(spark, monkeypatch):
    """a task adds up a bounded number of pairs, however many documents there are."""
    seen, top = [], search.top
    monkeypatch.setattr(search, "top", lambda table, *a: seen.append(table.rdd.getNumPartitions()) or top(table, *a))
    monkeypatch.setattr(linkage, "_PAIRS_EACH", 5)
    asks, docs = _tables(spark, 2, 20)
    search.bm25(asks, docs, "ask", "doc", "said", "body", k=2)
    assert seen == [7]


def test_many_terms_give_the_same(spark, monkeypatch):
    asks, docs = _tables(spark, 3, 12)
    few = sorted(search.bm25(asks, docs, "ask", "doc", "said", "body").collect())
    monkeypatch.setattr(search, "SENT", 0)
    assert sorted(search.bm25(asks, docs, "ask", "doc", "said", "body").collect()) == few


def test_words_are_what_anything_else_separates(spark):
    """as replacing all else by a space and trimming gave them."""
    texts = ["", None, "  a b 　 C\n", "Ünïcode ÄÖ İstanbul", "中文 abc中文def 一", "\t", "-x-", "KK ſ s", "a\x0bb\x1cc\x85d", "\U0001f600 hi \U00020000 中"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", r"trim(regexp_replace(lower(coalesce(t, '')), '[^a-z0-9\\u4E00-\\u9FFF]+', ' ')) as old").withColumn("new", T.normalize(T.F.col("t"))).collect()
    assert all(r["old"] == r["new"] for r in got)


def test_lists_are_dealt_out_in_proportion_to_pairs(spark, monkeypatch):
    """What a task adds up doesn't grow with the documents."""
    seen, ranked = [], topk._ranked
    monkeypatch.setattr(topk, "_ranked", lambda table, *a: seen.append(table.rdd.getNumPartitions()) or ranked(table, *a))
    monkeypatch.setattr(linkage, "_PAIRS_EACH", 5)
    terms = spark.createDataFrame([(q, 0, "a", 0, 1.0, 2) for q in range(3)], "q int, space int, token string, library int, factor double, k int")
    postings = spark.createDataFrame([(0, "a", i, 1, 1.0 + i) for i in range(15)], "space int, token string, doc long, mask int, weight double")
    with Stage(spark) as stage:
        found = topk.best(terms, postings, ["q"], stage).collect()
    assert seen == [9] and sorted((r["q"], r["rank"], r["doc"]) for r in found) == [(q, r, 15 - r) for q in range(3) for r in (1, 2)]


def test_sorted_rows_are_dealt_out_in_proportion(spark, monkeypatch):
    """What a task sorts doesn't grow with orders or lines."""
    data = "/root/testdata/sf0.001"
    plans = lambda: [records.QUERIES[n](spark, data).rdd.getNumPartitions() for n in ("papers_sort", "graph_stats")]
    few = plans()
    monkeypatch.setattr(linkage, "SORTED_EACH", 100)
    orders, lines = (spark.read.parquet(f"{data}/{t}.parquet").count() for t in ("orders", "lineitem"))
    assert few == [4, 4] and plans() == [-(-orders // 100), -(-lines // 100)]


def test_an_edge_needs_no_lookup(spark):
    """both ends come from the edge's own row."""
    graph, edges = (records.QUERIES[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("Join ") for n in ("graph_one_hop", "edge_coordinates"))
    assert graph == edges
