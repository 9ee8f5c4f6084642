"""Search over several sources, phrases, places, nested sources and enrichment on small inputs."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.functions.titles import likely_title
from quillspark.operators import branches as B
from quillspark.operators import enrich as E
from quillspark.operators import federated as O
from quillspark.operators import graph as G
from quillspark.operators import topk
from quillspark.operators.ranking import places
from quillspark.plans import linking
from quillspark.sources.nested import gather, parse
from quillspark.sources.staging import Stage, shared_dir

DATA = "/root/testdata/sf0.001"


class Counted(Stage):
    """A stage that remembers how many rows it wrote, by columns."""

    def __init__(self, spark):
        super().__init__(spark)
        self.rows = {}

    def __call__(self, table):
        out = super().__call__(table)
        self.rows[tuple(out.columns)] = out.count()
        return out


def stored(spark):
    return set(Path(shared_dir(spark).removeprefix("file://"), "quillspark-stage").glob("*"))


@pytest.mark.parametrize(("probe", "seed", "sent"), [(1, 1, 0), (40, 2, 0), (10_000, 3, 0), (1, 4, 500_000)])
def test_best_against_all_sums(spark, monkeypatch, probe, seed, sent):
    monkeypatch.setattr(topk, "_SENT", sent)
    r = random.Random(seed)
    tokens = [f"t{i}" for i in range(30)]
    postings = [(s, t, doc, round(r.random() * 10 / (1 + i), 3)) for s in (0, 3) for i, t in enumerate(tokens) for doc in range(200) if r.random() < (i + 1) / 30]
    postings += [(0, "tie", doc, 1.0) for doc in range(50)]
    asked = [(q, "x", s, t, k) for q, s, k in ((1, 0, 5), (2, 3, 3), (3, 0, 1)) for t in r.sample(tokens, 8)] + [(4, "x", 0, "tie", 4), (5, "x", 0, "nowhere", 4)]
    before = stored(spark)
    with Counted(spark) as stage:
        terms = spark.createDataFrame(asked, "q long, list string, space int, token string, k int").withColumns({"library": F.lit(1), "factor": F.lit(2.0)})
        lists = spark.createDataFrame(postings, "space int, token string, doc long, weight double").withColumns({"mask": F.when(F.col("doc") % 9 > 0, 6).otherwise(1), "weight": F.col("weight") / 2})
        found = topk.best(terms, stage(lists), ["q", "list"], stage, probe).collect()
        candidates = stage.rows.get(("q", "list", "doc", "k", "sure"), 0)
    assert stored(spark) == before
    sums, wanted = Counter(), []
    for q, _, s, t, k in asked:
        for s2, t2, doc, w in postings:
            if (s, t) == (s2, t2) and doc % 9:
                sums[q, k, doc] += w
    for q, k in {(q, k) for q, _, _, _, k in asked}:
        best = sorted((-math.floor(v * 1e6 + 0.5) / 1e6, doc) for (a, _, doc), v in sums.items() if a == q)[:k]
        wanted += [(q, "x", doc, -v, i) for i, (v, doc) in enumerate(best, 1)]
    assert sorted(map(tuple, found)) == sorted(wanted)
    assert candidates < 0.6 * len(sums)


def test_phrases(spark):
    texts = ["a b a b a", "x a\nB, c d", "", None, "a-b a b", "the end", "d c b a", "ab"]
    asked = ["a b a", "A b. c", "the the", "", "!!", None, "b", "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    with Stage(spark) as stage:
        got = topk.phrases(spark.createDataFrame(list(enumerate(asked)), "pos long, phrase string"), docs, ["pos"], stage).collect()
    words = lambda t: re.findall("[a-z]+", (t or "").lower())
    wanted = []
    for i, p in enumerate(map(words, asked)):
        for j, t in enumerate(map(words, texts)):
            n = sum(t[k : k + len(p)] == p for k in range(len(t) - len(p) + 1)) if p else 0
            wanted += [(i, j, len(t), n)] * (n > 0)
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_places_of_hot_and_null_groups(spark):
    r = random.Random(4)
    rows = [(r.choice([None, "a", "hot", "hot", "hot"]), r.choice([None, 1, 2, 3]), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, n int, id long")
    with Stage(spark) as stage:
        got = places(frame, ["g"], [F.desc_nulls_last("n"), F.asc("id")], stage).collect()
        every = places(frame, [], [F.desc_nulls_last("n"), F.asc("id")], stage, "rank").collect()
        assert places(frame.where("false"), ["g"], [F.asc("id")], stage).count() == 0
    by = lambda x: (-(x[1] or 0), x[2])
    wanted = [(*x, i) for g in {x[0] for x in rows} for i, x in enumerate(sorted((x for x in rows if x[0] == g), key=by), 1)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))
    assert sorted(map(repr, map(tuple, every))) == sorted(map(repr, ((*x, i) for i, x in enumerate(sorted(rows, key=by), 1))))


def test_a_corrupt_source_is_a_status(spark, tmp_path):
    schema = "doi string, locations array<struct<url: string>>"
    (tmp_path / "good.json").write_text('{"doi": "10.1/a", "locations": [{"url": "u"}, {"url": null}], "more": 1}\n\n{"doi": "10.1/b"}\n')
    (tmp_path / "half.json").write_text('{"doi": "10.1/c"}\n{"doi": "10.1/d", "loc\n[1, 2\n')
    (tmp_path / "bad.json").write_text("<html>\n")
    (tmp_path / "empty.json").write_text("")
    names = ("good", "half", "bad", "empty", "missing")
    rows, status = gather(spark, {n: f"{tmp_path}/{n}.json" for n in names}, schema)
    assert sorted((r["source"], r["doi"], None if r["locations"] is None else [x["url"] for x in r["locations"]]) for r in rows.collect()) == [("good", "10.1/a", ["u", None]), ("good", "10.1/b", None), ("half", "10.1/c", None)]
    got = {r["source"]: (r["rows"], r["broken"], r["used"], r["reason"]) for r in status.collect()}
    assert got == {"good": (2, 0, True, None), "half": (3, 2, True, None), "bad": (1, 1, False, "UNREADABLE"), "empty": (0, 0, False, "EMPTY"), "missing": (0, 0, False, "PATH_NOT_FOUND")}


def test_parse_tells_missing_from_broken(spark):
    frame = spark.createDataFrame([("{}",), (None,), ("{",), ('{"a": 3}',)], "body string")
    assert [(r["record"] and r["record"]["a"], r["readable"]) for r in parse(frame, "body", "a int").collect()] == [(None, True), (None, False), (None, False), (3, True)]


def test_open_links(spark):
    place = "struct<url_for_pdf: string, url: string, host_type: string>"
    rows = [
        (None, None, None),
        (False, ("p", "u", "h"), [("q", "v", "i")]),
        (None, ("", "", ""), [(None, "v", "i"), ("q", "w", "j")]),
        (True, None, []),
        (False, None, [("", "", "")]),
    ]
    got = spark.createDataFrame(rows, f"o boolean, best {place}, all array<{place}>").select(E.open_links(F.col("best"), F.col("all"), F.col("o")).alias("x")).collect()
    assert [tuple(r["x"]) for r in got] == [(False, None, None, None), (True, "p", "u", "h"), (True, "q", "v", None), (True, None, None, None), (False, None, None, None)]


def test_enrichment_goes_by_precedence(spark):
    papers = spark.createDataFrame([(1, "10.1/A", 7, False), (2, "", 8, True), (3, None, None, True), (4, "10.1/x", 9, False)], "id long, doi string, pmid long, need_abstract boolean")
    metric = "mean_cited double, h_index long, issn string, publisher string"
    index = spark.createDataFrame(
        [("10.1/a", 70, 5, "oa", "ia", "it", 1, 1.0, 2, "i", "p"), ("10.1/q", 8, 6, None, "ib", "", 2, None, 2, "i", "p"), ("10.1/q", 8, 6, None, "ib", "", 2, None, 2, "i", "p"), ("10.1/z", 9, 1, "no", "no", "no", 1, 1.0, 1, "no", "no")],
        f"doi string, pmid long, cited long, oa_url string, abstract string, title string, source_key long, {metric}",
    )
    links = spark.createDataFrame([("10.1/A", None, "pdf", "land"), ("10.1/x", None, None, "land")], "doi string, pmid long, pdf string, landing string")
    library = spark.createDataFrame([(None, 7, "c7", "h7", "a7", "t7"), ("10.1/q", 8, "c8", None, "a8", "t8"), ("10.1/x", 1, None, "h1", "a1", "t1")], "doi string, pmid long, pdf string, html string, abstract string, title string")
    metrics = spark.createDataFrame([(1, 9.0, 9, "no", "no"), (2, 5.0, None, "j", "q")], f"source_key long, {metric}")
    got = {r["id"]: tuple(r)[1:] for r in E.enrich(papers, index, links, library, metrics).collect()}
    page = "https://europepmc.org/article/MED/"
    assert got[1] == (5, 1.0, 2, "i", "p", "pdf", "oa", page + "7", "ia", "it", False)
    assert got[2] == (6, 5.0, None, "j", "q", "c8", page + "8", page + "8", "a8", "t8", True)
    assert got[3] == (None, None, None, None, None, None, None, None, None, None, False)
    assert got[4] == (None, None, None, None, None, None, "land", page + "1", "a1", "t1", False)
    assert len(got) == 4


def test_neighbours_that_fail_are_counted(spark):
    seeds = spark.createDataFrame([(1,), (2,)], "seed long")
    rows = lambda *x: spark.createDataFrame([(1, n, i) for i, n in enumerate(x, 1)], "seed long, node long, place int")
    works = spark.createDataFrame([(n, n) for n in (1, 10, 12, 13, 14, 15)], "node long, cited long")
    asked = G.planned(seeds, [("related", rows(10, 11, 1, 12), 3), ("reference", rows(10, 13, 98, 14), 4), ("cited-by", rows(99, 15), 2)], works, most=6)
    assert [(r["node"], r["relation"], r["loaded"]) for r in asked.orderBy("pos").collect()] == [(10, "related", True), (11, "related", False), (13, "reference", True), (98, "reference", False), (14, "reference", True), (99, "cited-by", False)]
    got = {r["seed"]: r.asDict() for r in G.loaded_stats(seeds, asked).collect()}
    assert (got[1]["nodes"], got[1]["edges"], got[1]["failed"], got[1]["mode"]) == (4, 3, 3, "sparse-neighborhood") and "3" in got[1]["warning"]
    assert (got[2]["nodes"], got[2]["failed"], got[2]["warning"]) == (1, 0, None)


def test_a_type_reads_its_own_branches_only(spark):
    def unread():
        raise AssertionError("this branch isn't wanted")

    schema = "request int, id string, kind string, doi string, url string, title string, year int, cited long, pos long"
    trial = lambda: spark.createDataFrame([(1, "n1", "trial", None, None, "t", None, None, 1), (1, "n1", "trial", None, "", "t", None, None, 2)], schema)
    with Stage(spark) as stage:
        hits, facets = B.search([B.Branch("data", unread, unread), B.Branch("paper", unread), B.Branch("trial", trial)], "trial", 2000, "date", stage)
        assert [(r["id"], r["place"]) for r in hits.collect()] == [("n1", 1)]
        assert [tuple(r) for r in facets.collect()] == [(1, 0, 0, 1)]
        empty = lambda: spark.createDataFrame([], schema)
        both = B.Branch("data", empty, lambda: spark.createDataFrame([(1, "a", "data", "10.1/X", "u", "t", 1999, 3, 1), (2, "b", "data", "10.1/x", "v", "t", 0, None, 1)], schema))
        other = B.Branch("data", lambda: spark.createDataFrame([(1, "c", "data", "10.1/x", None, "t", 2001, 9, 1), (1, "d", "data", "", "U", "t", 2002, 1, 2), (1, "e", "data", None, "u", "t", 2003, 1, 3)], schema))
        hits, _ = B.search([both, other], "data", 1999, "citations", stage)
        assert sorted((r["request"], r["place"], r["id"]) for r in hits.collect()) == [(1, 1, "a"), (1, 2, "d"), (2, 1, "b")]
    plan = linking._branches(spark, DATA)[4].hits()._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "c_custkey" not in plan and "s_suppkey" not in plan


def test_likely_titles(spark):
    cases = [
        ("Harris P, Taylor R (2009). Research electronic data capture. J Biomed Inform.", "Research electronic data capture"),
        ("Smith JA, et al. A randomised trial of early treatment. Lancet. 2010;1:2.", "A randomised trial of early treatment"),
        ("PMID: 123456 A study https://x.org/1 doi:10.1000/abc", "A study"),
        ("2010 was a very long year in the end. Short. The last sentence is the title here", "The last sentence is the title here"),
        ("One. Two. Three", "One. Two. Three"),
        ("A (2010). Short one. rest", "A (2010). Short one. rest"),
        (None, ""),
        ("x" * 300, "x" * 220),
    ]
    got = spark.createDataFrame([(a,) for a, _ in cases], "line string").select(likely_title(F.col("line"))).collect()
    assert [r[0] for r in got] == [b for _, b in cases]


def test_sources_agree_and_merge(spark):
    """By DOI where a library knows it, else by title; fallbacks and the second search add what they find."""
    title = "A trial of early treatment in adults"
    body = "Long prose. " + "about kidneys and hearts and other organs " * 8 + "rareword."
    works = [(1, 31, 19, title, "treatment text"), (2, 31, 19, "Another title", "kidneys hearts organs rareword"), (3, 4, 19, title, "early treatment of adults"), (4, 1, 19, "", "trial treatment adults early"), (5, 8, 19, "Zebra", "only text says quagga")]
    frame = spark.createDataFrame(works, "work_id long, mask int, dois int, title string, text string").withColumns({"abstracts": F.lit(29), "doi": F.concat(F.lit("10.1/"), F.col("work_id").cast("string")), "year": F.lit(2000), "cited": F.col("work_id") * 10})
    queries = spark.createDataFrame([(1, "title", title, title, 2000), (2, "body", "unrelated words", body, None), (3, "title", "quagga", "quagga", None), (4, "title", "", "", None)], "query_id long, mode string, phrase string, text string, year_hint int")
    with Stage(spark) as stage:
        found = stage(O.candidates(queries, frame, stage))
        rows = O.merged(found, frame)
        merged = {(r["query_id"], r["key"]): r.asDict() for r in rows.collect()}
        hits = O.ranked(queries, rows, frame, stage).collect()
        third = [(r["work_id"], r["list"]) for r in found.where("query_id = 3").collect()]
    by_doi, by_title = merged[1, "10.1/1"], merged[1, "a trial of early treatment in adults"]
    assert by_doi["work_id"] == 1 and by_doi["sources"] == "文献库,登记库,欧洲库" and by_doi["n_sources"] == 3 and by_doi["cited"] == 10
    assert by_title["work_id"] in (1, 3) and by_title["sources"] == "语义索引,医学库" and by_title["cited"] == 30
    assert third == [(5, 3)]  # the title of none, the text of one
    late = [r for r in merged.values() if r["query_id"] == 2 and r["first_list"] >= 5]
    assert late and late[0]["work_id"] == 2
    assert not [k for k in merged if k[0] == 4 or k[1] == ""]
    first = next(r for r in hits if r["query_id"] == 1 and r["rank"] == 1)
    assert first["title_score"] == 1.0 and first["score"] > 0.99
