"""Rows as they are shown: literal cases; pairs of matching against a plain count."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.functions import rows as R
from quillspark.operators import linkage


def _one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("day, year", [("2011 Mar", 2011), ("Spring 2011", None), ("0000", None), ("", None), (None, None), ("98", 98)])
def test_year_of_the_index(spark, day, year):
    assert _one(spark, day, R.search_year) == year


def test_year_buckets(spark):
    assert [_one(spark, y, R.year_bucket, "int") for y in (2022, 2021, 2018, 2012, 1999, 0, None)] == ["2022", "2018", "2018", "2012", "older", "unknown", "unknown"]


@pytest.mark.parametrize("given, wanted", [("https://pubmed.ncbi.nlm.nih.gov/123/", "123"), ("PMID: 45", "45"), ("none", None), ("", None), (None, None)])
def test_digits_of_a_pmid(spark, given, wanted):
    assert _one(spark, given, R.pmid_digits) == wanted


def test_links_of_records(spark):
    assert _one(spark, " https://DOI.org/10.1/a", R.doi_link) is not None
    assert _one(spark, "https://doi.org/ ", R.doi_link) is None and _one(spark, None, R.doi_link) is None
    assert _one(spark, "", lambda c: R.record_link(c, F.lit("http://x"))) == "http://x" and _one(spark, "", lambda c: R.record_link(c, c)) is None
    assert [_one(spark, x, R.first_named) for x in (" A B , C", ", C", "", None)] == ["A B", None, None, None]


def test_component_keeps_what_urls_keep(spark):
    assert _one(spark, "a b+c/(d)~'!*-é", R.component) == "a%20b%2Bc%2F(d)~'!*-%C3%A9"
    assert _one(spark, None, R.component) is None


def test_paper_links_leave_out_what_is_not_known(spark):
    lit = lambda *values: [F.lit(v).cast("string") for v in values]
    links = lambda *values: [tuple(r) for r in spark.range(1).select(R.paper_links(*lit(*values)).alias("x")).first()["x"]]
    assert links(None, None, None, None, None, None) == [] and links("", "", " ", "", "", "") == [("citations", "/citations?seed=%20")]
    both = links("10.1/a", "7", "T", "V", None, "https://doi.org/10.1/a")
    assert [k for k, _ in both] == ["pdf", "map", "trials", "datasets", "journals", "papers", "match", "citations"]  # the PDF is the page
    only = dict(links(None, "PMID 7", None, "J. of X", None, None))
    assert only["open"] == "https://pubmed.ncbi.nlm.nih.gov/7/" and only["map"] == "/map?q=PMID%3APMID%207" and only["datasets"] == "/datasets?q=J.%20of%20X" and "citations" not in only


def test_author_objects_without_any_name_are_dropped(spark):
    kind = "array<struct<family:string,given:string,name:string>>"
    got = _one(spark, [("A", "", None), ("", None, ""), (None, None, "Group"), None], R.named_authors, kind)
    assert [tuple(a) for a in got] == [("A", None, None), (None, None, "Group")] and _one(spark, None, R.named_authors, kind) == []


def test_adverse_events(spark):
    shown = lambda drugs, effects: spark.createDataFrame([(drugs, effects)], "d array<string>, e array<string>").select(*R.adverse_event(F.col("d"), F.col("e"), F.lit("Red x"), F.lit("9 a")).values()).first()
    assert tuple(shown(["b", "big red"], ["u", "", "v", None, "w", "x", "y"]))[:2] == ("openFDA AE · big red, b", "Reactions: u, v, w, x（打开为 openFDA JSON 记录）")
    assert tuple(shown(None, None)) == ("openFDA safety report 9 a", "Drug adverse event report metadata（打开为 openFDA JSON 记录）", "https://api.fda.gov/drug/event.json?search=safetyreportid:9%20a")


def test_any_word_in_any_field(spark):
    rows = spark.createDataFrame([(1, "Red ring", None), (2, "x", "ATLAS of bones"), (3, None, None)], "i int, a string, b string")
    found = lambda q: [r["i"] for r in rows.where(R.holds_word(F.lit(q), F.col("a"), F.col("b"))).orderBy("i").collect()]
    assert found("atlas  RING") == [1, 2] and found("") == [] and found("ring atlas-") == [1]


def test_match_pairs_are_those_that_share_a_token(spark):
    r = random.Random(5)
    word = lambda: f"w{r.randrange(12)}x"
    queries = [(i, " ".join(word() for _ in range(r.randrange(4))), "body") for i in range(8)] + [(90, None, "body")]
    works = [(i, " ".join(word() for _ in range(r.randrange(3))), " ".join(word() for _ in range(r.randrange(9)))) for i in range(12)] + [(91, None, None), (92, None, "w1x w1x"), (93, "w1x", None)]
    got = linkage.match_pairs(spark.createDataFrame(queries, "query_id int, phrase string, mode string"), spark.createDataFrame(works, "work_id int, title string, abstract string"))
    bag = lambda s: Counter((s or "").split())
    wanted = {}
    for q, phrase, _ in queries:
        for w, title, abstract in works:
            a, t, b = bag(phrase), bag(title), bag(abstract)
            if a.keys() & (t.keys() | b.keys()):
                share = lambda x, y: sum(n for k, n in x.items() if k in y) / max(sum(x.values()), 1)
                p, c = share(a, b), share(b, a)
                wanted[q, w] = (round(2 * p * c / (p + c) if p + c else 0.0, 9), round(share(t, a), 9))
    assert {(x["query_id"], x["work_id"]): (round(x["abstract_score"], 9), round(x["coverage"], 9)) for x in got.collect()} == wanted
