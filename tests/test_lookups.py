"""Identifiers, rows as they are shown, resolving and paging: literal cases."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import identifiers as I
from quillspark.functions import rows as R
from quillspark.operators import linkage, resolve


def _one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_identifiers_are_found_once_and_in_order(spark):
    text = "doi:10.1000/A.1). https://doi.org/10.1000/a.1; 10.123/short 10.2000/b, PMID: 12345678 pmid 12345678 XPMID:22222222 PMID:99999"
    assert _one(spark, text, I.dois) == ["10.1000/A.1", "10.2000/b"]
    assert _one(spark, text, I.pmids) == ["12345678", "99999"]
    assert len(_one(spark, " ".join(f"10.1000/{i}" for i in range(30)), I.dois)) == 10
    assert _one(spark, None, I.dois) == [] and _one(spark, None, I.pmids) == []


@pytest.mark.parametrize("text, year", [("in 1987 (2001a)", 1987), ("(2001a) 1987", 2001), ("12019 5", None), (None, None)])
def test_year_hint(spark, text, year):
    assert _one(spark, text, I.year_hint) == year


@pytest.mark.parametrize(
    "text, only",
    [("https://doi.org/10.1000/a1, doi: 10.1000/b2.", True), ("doi:10.1000/a1 and more", False), ("no identifier", False), ("", False), (None, False), ("10.1000/a1 10.1000/a1", False), ("10.1000/a1 10.1000/A1x", True)],
)
def test_lines_of_dois_only(spark, text, only):
    assert _one(spark, text, I.only_dois) is only


@pytest.mark.parametrize(
    "query, kind, value",
    [
        (" DOI: 10.1000/A ", "doi", "10.1000/a"),
        ("10.12/x", "text", "10.12/x"),
        ("PMID: 123456", "pmid", "123456"),
        ("12345", "pmid", "12345"),
        ("1234", "text", "1234"),
        ("https://example.org/W77", "work", "W77"),
        ("w77", "work", "W77"),
        ("nct01234567", "trial", "nct01234567"),
        ("NCT0123", "text", "NCT0123"),
        (" ", None, ""),
    ],
)
def test_kinds_of_queries(spark, query, kind, value):
    got = spark.createDataFrame([(query,)], "x string").select(I.kind(F.col("x")).alias("k"), I.value(F.col("x"), I.kind(F.col("x"))).alias("v")).first()
    assert tuple(got) == (kind, value)


def test_resolving_keeps_every_ask(spark):
    works = spark.createDataFrame([(1, "10.1000/A", 555555, "apple pears"), (2, "10.1000/a", None, "plums quinces"), (3, None, None, None)], "work_id long, doi string, pmid long, title string")
    asks = spark.createDataFrame([(1, "doi:10.1000/a"), (2, "10.1000/none"), (3, "PMID 555555"), (4, "PMID 999999"), (5, "quinces"), (6, "W3"), (7, None), (8, "")], "ask_id int, query string")
    got = {r["ask_id"]: (r["kind"], r["work_id"], r["found_by"]) for r in resolve.resolve_works(asks, works).collect()}
    assert got == {1: ("doi", 1, "doi"), 2: ("doi", None, None), 3: ("pmid", 1, "pmid"), 4: ("pmid", None, None), 5: ("text", 2, "search"), 6: ("work", 3, "work"), 7: (None, None, None), 8: (None, None, None)}


def test_pages_and_limits(spark):
    rows = spark.createDataFrame([(1, i, None, None) for i in range(30)] + [(2, i, 3, 1) for i in range(12)] + [(3, 1, 9, 50)], "k int, v int, page int, size int")
    got = resolve.pages(rows, "k", F.col("page"), F.col("size"), F.asc("v")).orderBy("k", "place").collect()
    assert [r["v"] for r in got if r["k"] == 1] == list(range(12)) and {r["total"] for r in got if r["k"] == 1} == {30}
    assert [r["v"] for r in got if r["k"] == 2] == [10, 11] and not [r for r in got if r["k"] == 3]


def test_first_acceptable_text(spark):
    wanted = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, None)], "k int, names array<string>")
    texts = spark.createDataFrame([("a", "short"), ("b", "X may refer to: " + "y" * 90), ("c", "z" * 2000)], "name string, extract string")
    got = {r["k"]: r["extract"] for r in resolve.first_acceptable(wanted, texts, "k", "names", "name", "extract").collect()}
    assert got == {1: "z" * 1200, 2: None, 3: None}


def test_rows_as_shown(spark):
    names = "array<string>"
    assert _one(spark, ["A", None, "B", "", "C", "D"], R.authors_line, names) == "A, B, C et al."
    assert _one(spark, None, R.authors_line, names) == "" and _one(spark, [None], R.first_authors, names) == "—"
    assert [_one(spark, x, R.year_of) for x in ("2020-01", "1800", "20", "x", None)] == [2020, None, None, None, None]
    assert [_one(spark, x, R.number, "double") for x in (3.0, 2.346, None, float("nan"), -1.5)] == ["3", "2.35", "—", "—", "-1.50"]
    assert _one(spark, ["Aspirin", None, "Red pill", "Aspirin"], lambda c: R.drug_line(c, F.lit("RED x")), names) == "Red pill, Aspirin, Aspirin"
    assert tuple(_one(spark, " Ada  B  Lovelace ", R.author_of)) == ("Ada B", "Lovelace") and tuple(_one(spark, "", R.author_of)) == (None, None)


def test_xml_and_messages(spark):
    xml = '<MedlineCitation><PMID V="1">7</PMID><AbstractText L="a">x <i>y</i> &lt;1</AbstractText>\n<AbstractText>z</AbstractText></PubmedArticle><MedlineCitation><PMID>8</PMID></PubmedArticle>'
    assert [tuple(r) for r in _one(spark, xml, R.abstracts_of)] == [("7", "x y <1 z")]
    assert _one(spark, "rate limit", R.error_text).startswith("检索繁忙") and _one(spark, None, R.warning_text) is None and _one(spark, "公开", R.warning_text) == "公开"


def test_dataset_citations_escape_once(spark):
    row = spark.createDataFrame([("a:b", "N", r"x_{1}\y", None, None, "10.1/z")], "k string, a string, t string, v string, y int, d string")
    got = row.select(*[c.alias(n) for n, c in R.dataset_citations(*[F.col(c) for c in "katvyd"]).items()]).first()
    assert got["apa"] == r"N. (n.d.). x_{1}\y. . https://doi.org/10.1/z" and r"title={x\_\{1\}\\y}" in got["bibtex"] and got["bibtex"].startswith("@misc{101z,")


def test_evidence_names_tokens_years_and_identifiers(spark):
    works = spark.createDataFrame([(1, "cardiac rhythm trial", "cardiac rhythm trial of patients", 2001, 1, 5, "10.1000/Q")], "work_id long, title string, abstract string, year int, n_sources int, cited long, doi string")
    asked = spark.createDataFrame([(9, "cardiac rhythm storms (2002)", "title", 2002, ["10.1000/q"])], "query_id long, phrase string, mode string, year_hint int, dois array<string>")
    (got,) = linkage.evidence(linkage.ranked_matches(asked, works), asked, works).collect()
    assert got["doi_hit"] and got["score"] >= 0.99 and got["year_status"] == "near"
    assert got["matched"] == ["cardiac", "rhythm"] and got["missed"] == ["storms", "2002"]
    assert got["reasons"][0] == "DOI 直达" and "年份接近" in got["reasons"]


def test_inputs_are_taken_by_priority(spark):
    from quillspark.functions import references

    rows = [(1, [f"reference {i:02}" for i in range(20)] + ["short"], "x", "y"), (2, None, " one ref ", "y"), (3, [], "", "12345678 and a reference"), (4, None, None, None), (5, [None, ""], "x", None), (6, None, "z" * 30001, None)]
    df = spark.createDataFrame(rows, "k int, l array<string>, o string, t string")
    got = {r["k"]: r["x"] for r in df.select("k", references.normalize_input(F.col("l"), F.col("o"), F.col("t")).alias("x")).collect()}
    assert got[1]["refs"] == [f"reference {i:02}" for i in range(15)] and got[1]["truncated"]
    assert got[2]["refs"] == ["one ref"] and not got[2]["truncated"]
    assert got[3]["refs"] == ["12345678 and a reference"] and got[4]["refs"] == [] and got[5]["refs"] == []
    assert len(got[6]["refs"][0]) == 30000 and got[6]["truncated"]


def test_records(spark):
    spans = spark.createDataFrame([("1", "9"), ("1", None), ("", "9"), (None, None)], "a string, b string").select(R.page_span(F.col("a"), F.col("b")).alias("x"))
    assert [r["x"] for r in spans.collect()] == ["1-9", "1", None, None]
    years = spark.createDataFrame([([0, 3], [1999], [2001]), (None, [], [2001, 2]), (None, None, None)], "a array<int>, b array<int>, c array<int>").select(R.first_year(*[F.col(c) for c in "abc"]).alias("x"))
    assert [r["x"] for r in years.collect()] == [1999, 2001, None]
    assert [_one(spark, t, R.index_title) for t in ("A title.", "Untitled", "", None)] == ["A title", None, None, None]
    assert _one(spark, "<p> a </p>b" + "c" * 999, R.short_abstract) == "a b" + "c" * 897 and _one(spark, "<p/>", R.short_abstract) is None
    assert _one(spark, ["Ada B Lovelace", None, "Plato"], R.family_first, "array<string>") == "Lovelace Ada B, Plato"
