"""Rule cases of the column functions, with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import formats, labels, references, similarity, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(("given", "wanted"), [("Étude of Things!", "tude of things"), (None, ""), ("", ""), ("受试 RCT", "受试 rct")])
def test_normalize(spark, given, wanted):
    assert one(spark, text.normalize(lit(given))) == wanted


def test_tokens_keep_repeats_and_cut_cjk_into_bigrams(spark):
    assert one(spark, text.tokens(lit("The gene and the gene x 随机对照 癌"))) == ["gene", "gene", "随机", "机对", "对照", "癌"]


def test_token_f1(spark):
    f1 = similarity.token_f1(text.tokens(lit("alpha beta beta")), text.tokens(lit("beta gamma")))
    assert one(spark, f1) == pytest.approx(2 * (2 / 3) * (1 / 2) / (2 / 3 + 1 / 2))


@pytest.mark.parametrize(
    ("a", "b", "strict", "wanted"),
    [
        ("same title", "Same  Title!", False, 1.0),
        ("genomics", "omics", False, 0.95 * 5 / 8),
        ("", "x", False, 0.0),
        ("alpha beta gamma", "alpha beta gamma delta", True, min(6 / 7, 0.9 * 16 / 22 + 0.05)),
        ("beta gamma delta epsilon", "alpha beta gamma delta epsilon zeta eta", True, None),
    ],
)
def test_title_similarity(spark, a, b, strict, wanted):
    got = one(spark, similarity.title_similarity(lit(a), lit(b), strict))
    assert 0 <= got <= 1
    if wanted is not None:
        assert got == pytest.approx(wanted)


@pytest.mark.parametrize(
    ("hint", "resolved", "wanted"),
    [("Harris PA", "Harris Paul A", 1.0), ("Harris P", "Harris Paul A", 1.0), ("Harris DD", "Harris Paul A", 0.2), ("Harris PA", "Harris", 0.85), ("Taylor R", "Harris Paul", 0.0), ("", "x", 1.0), ("Harris", None, 0.0), ("Harris", "Harris Paul", 1.0)],
)
def test_author_match(spark, hint, resolved, wanted):
    assert one(spark, similarity.author_match(lit(hint), lit(resolved))) == pytest.approx(wanted)


@pytest.mark.parametrize(("cited", "full", "wanted"), [("N Engl J Med", "New England Journal of Medicine", 0.93), ("N Engl J", "New England Journal of Medicine", 0.45), (None, "Nature", 1.0), ("Nature", "nature", 1.0)])
def test_journal_match(spark, cited, full, wanted):
    assert one(spark, similarity.journal_match(lit(cited), lit(full))) == pytest.approx(wanted)


def test_sentences(spark):
    long = "First sentence of the paragraph here. Second sentence of the paragraph! " + "word " * 40 + "end."
    got = one(spark, text.sentences(lit(f"Title line\nTITLE  line\n{long}\nno")))
    assert got[:3] == ["Title line", "First sentence of the paragraph here.", "Second sentence of the paragraph!"]
    assert len(got) == 4
    assert one(spark, text.sentences(lit(None))) == []
    chunks = one(spark, text.sentences(lit("wordy " * 80)))
    assert all(len(c) <= 180 for c in chunks) and len(chunks) == 1  # equal beginnings count once


def test_highlight_joins_neighbours(spark):
    got = one(spark, text.highlight(lit("Gene therapy, gene x"), F.array(F.lit("gene"), F.lit("therapy"))))
    assert [(r["text"], r["matched"]) for r in got] == [("Gene", True), (" ", False), ("therapy", True), (", ", False), ("gene", True), (" x", False)]


def test_references(spark):
    rows = [
        "[1] Harris PA, Taylor R. The REDCap consortium of partners. J Biomed Inform. 2019;95:103208-103220. doi:10.1016/j.jbi.2019.103208.",
        "Fan, S., & Li, X. (2024a). A long enough title of a study. Nature Medicine, 42(2), 377-381.",
        "Kirby J. Short. PMID: 28889792",
    ]
    got = references.read(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")).orderBy("i").collect()
    assert (got[0]["cited_doi"], got[0]["cited_journal"], got[0]["cited_volume"], got[0]["cited_issue"], got[0]["cited_pages"]) == ("10.1016/j.jbi.2019.103208", "J Biomed Inform", "95", None, "103208-103220")
    assert (got[1]["cited_year"], got[1]["cited_title"], got[1]["cited_author"], got[1]["cited_issue"]) == ("2024a", "A long enough title of a study", "Fan S", "2")
    assert (got[2]["cited_pmid"], got[2]["cited_year"], got[2]["cited_author"]) == ("28889792", None, "Kirby J")


def test_initials_make_no_title(spark):
    """Literal cases of what can't be a title; two initials without a space between count twice."""
    cases = {"A.B. Smith and co": True, "A. Smith and company": False, "Smith AB, Jones CD": True, "& Li, X and more": True, "short": True, "Vol 3 of something": True, "A long enough title of a study": False, "Someone et al on things": True}
    rows = spark.createDataFrame(list(cases), "string").toDF("t")
    got = {r["t"]: r["j"] for r in rows.selectExpr("t", f"{references.junk_title('t', references.Spark())} as j").collect()}
    assert got == cases
    import duckdb

    assert {t: duckdb.sql(f"SELECT {references.junk_title('t', references.Duck())} FROM (SELECT '{t}' AS t)").fetchall()[0][0] for t in cases} == cases


def test_split_list(spark):
    from quillspark.plans.outputs import LISTS

    rows = spark.createDataFrame(list(enumerate(LISTS)), "i int, t string").select("i", references.split_list(F.col("t")).alias("r")).orderBy("i").collect()
    assert [len(r["r"]) for r in rows] == [2, 2, 2, 2, 1, 0, 0]
    assert rows[2]["r"][0] == "Harris PA. A first title that wraps onto a second line. J One."
    assert rows[0]["r"][1].startswith("Taylor B.")


def test_evidence_and_garbage(spark):
    assert one(spark, labels.evidence_tags(lit("A randomized cohort: meta-analysis review"))) == ["系统综述/Meta", "RCT", "观察性"]
    assert one(spark, labels.evidence_tags(lit("A short review"))) == ["综述"]
    assert one(spark, labels.is_garbage(lit("short"))) is True
    assert one(spark, labels.is_garbage(lit("x" * 80))) is False


@pytest.mark.parametrize(("url", "wanted"), [("https://a.org/x.pdf", None), ("http://a.org/x", "insecure"), ("https://localhost/x", "private"), ("https://10.1.2.3/x", "private"), ("https://u:p@a.org/x", "credentials"), ("ftp://a.org/x", "scheme"), ("nonsense", "invalid"), (None, "invalid")])
def test_url_problem(spark, url, wanted):
    assert one(spark, labels.url_problem(lit(url))) == wanted


def test_markup(spark):
    assert one(spark, labels.strip_markup(lit("<p>a &amp;lt; b</p> &#65;&#x42; &quot;c&quot;"))) == 'a < b AB "c"'
    assert one(spark, labels.strip_markup(lit("&#99999; &#x1F600; &#9999999; &#xD7;"))) == "\U0001869f \U0001f600 &#9999999; \u00d7"


def test_citation_styles(spark):
    authors = formats.parse_authors(lit("Harris Paul A., Taylor R, Minor B, Duda S"))
    got = {k: one(spark, c) for k, c in formats.citations(authors, lit("A title."), lit("J Med"), lit("2020"), lit("4"), lit("2"), lit("pp. 1-9"), lit("https://doi.org/10.1/x_y"), lit("article")).items()}
    assert got["apa"] == "Harris, P. A., Taylor, R., Minor, B., & Duda, S. (2020). A title. J Med, 4(2), 1-9. https://doi.org/10.1/x_y"
    assert got["gbt"] == "Harris PA, Taylor R, Minor B, et al. A title.[J]. J Med, 2020, 4(2): 1-9. DOI: 10.1/x_y."
    assert "doi={10.1/x\\_y}" in got["bibtex"] and got["bibtex"].startswith("@article{Harris2020101xy,")
    assert one(spark, formats.escape_bibtex(lit("a\\b"))) == "a\\textbackslash\\{\\}b"
    many = F.array(*[F.struct(F.lit(f"F{i}").alias("family"), F.lit("A").alias("given")) for i in range(22)])
    assert one(spark, formats.apa_authors(many)).endswith("F18, A., …, F21, A.")
