"""Works named by identifier, and the rows of a search box: literal cases."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import direct as O
from quillspark.operators import linkage as L
from quillspark.sources.staging import Stage

SOURCE = "kind string, value string, source_rank int, source string, work_id long, cited long, title string, abstract string, authors string, container string, year int, doi string, pmid string, volume string, issue string, pages string"
RECORDS = [
    ("doi", "10.1000/a", 0, "one", 1, 10, "Sleep in older adults", None, "—", "", 0, "10.1000/A", "11111", None, None, None),
    ("doi", "10.1000/a", 1, "two", 7, 90, "Another title", "Sleep was measured in older adults. Nothing else was done here at all.", "Harris Paul A.", "Sleep J", 2001, "10.1000/a", None, "4", "2", "1-9"),
    ("pmid", "11111", 0, "three", 1, None, "Sleep in older adults", None, None, None, 2001, "10.1000/a", "11111", None, None, None),
    ("doi", "10.1000/b", 0, "one", 2, None, "", "An abstract without a title", None, None, None, "10.1000/b", None, None, None, None),
    ("doi", "10.1000/c", 0, "one", 3, 5, "!?", None, None, None, None, "10.1000/c", None, None, None, None),
]


def _hits(spark, texts):
    with Stage(spark) as stage:
        asked = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("kind_of_row", F.lit(1))
        found = O.hits(asked.select("id", "text"), spark.createDataFrame(RECORDS, SOURCE), ["id"], stage)
        return sorted(found.collect(), key=lambda r: (r["id"], r["rank"]))


def test_records_of_sources_coalesce_and_ways_of_asking_join(spark):
    (hit,) = _hits(spark, ["see doi:10.1000/A. PMID: 11111 (2001)"])
    assert (hit["work_id"], hit["title"], hit["cited"], hit["score"]) == (1, "Sleep in older adults", 0, 1.0)  # the later of equals, with its own count
    assert hit["said"] == ["PMID：11111", "DOI：10.1000/A"]
    assert set(hit["sources"]) == {"one", "two", "three"} and hit["pmid_hit"]
    assert {"DOI 直达", "PMID 一致", "标题 100%", "年份一致", "命中 1 句"} <= set(hit["reasons"])
    assert hit["snippets"] == ["Sleep was measured in older adults."]


def test_fields_come_from_the_first_source_that_has_them(spark):
    (hit,) = _hits(spark, ["10.1000/a"])
    assert hit["cited"] == 90
    assert (hit["year"], hit["container"], hit["authors"], hit["volume"]) == (2001, "Sleep J", "Harris Paul A.", "4")
    assert hit["apa"] == "Harris, P. A. (2001). Sleep in older adults. Sleep J, 4(2), 1-9. https://doi.org/10.1000/A"
    assert [(s["text"], s["matched"]) for s in hit["title_segments"]] == [("Sleep", True), (" in ", False), ("older", True), (" ", False), ("adults", True)]


@pytest.mark.parametrize("text", [None, "", "no identifier", "10.1000/unknown PMID: 99999", "10.1000/b"])
def test_nothing_is_found_for_what_nobody_has(spark, text):
    assert _hits(spark, [text]) == []


def test_titles_without_words_are_found_by_doi_alone(spark):
    (hit,) = _hits(spark, ["10.1000/c"])
    assert hit["score"] == 0.99 and hit["title_score"] == 0.0 and hit["snippets"] == []


def test_repeated_requests_and_empty_tables(spark):
    asked = spark.createDataFrame([(1, "10.1000/a"), (1, "10.1000/a")], "id long, text string")
    empty = spark.createDataFrame([], SOURCE)
    with Stage(spark) as stage:
        assert O.hits(asked, spark.createDataFrame(RECORDS, SOURCE), ["id"], stage).count() == 1
        assert O.hits(asked, empty, ["id"], stage).count() == 0


def test_reasons_fall_back_to_weak_overlap(spark):
    row = spark.createDataFrame([("title", 0.1, 0.0, 0.1, "none", False, False, 0)], "m string, t double, c double, a double, y string, d boolean, p boolean, n int")
    cols = [F.col(c) for c in "mtcaydpn"]
    assert row.select(L.reasons(*cols).alias("r")).first()["r"] == ["弱词重叠"]
    assert row.select(L.reasons(*cols[:-1], F.lit(2)).alias("r")).first()["r"] == ["命中 2 句"]


def test_search_box_rows(spark):
    works = spark.createDataFrame([(1, "Sleep in adults", "10.1000/a", "11111"), (2, "Sleep of children", None, None), (3, "Heart failure", None, "33333"), (4, None, "10.1000/a", "44444")], "work_id long, title string, doi string, pmid string")
    asks = spark.createDataFrame([(0, " 10.1000/A "), (1, "sleep"), (2, "PMID: 55555"), (3, "x"), (4, None), (5, "heart")], "id long, query string")
    got = {(r["id"], r["place"]): (r["work_id"], r["origin"]) for r in O.quick(asks, works, works.where("work_id < 3"), works.where("pmid is not null"), "id").collect()}
    assert got == {(0, 1): (1, "index"), (1, 1): (1, "index"), (1, 2): (2, "index"), (5, 1): (3, "medical")}
