"""Title candidates by rare tokens: the same as over all pairs, without meeting all of them."""

from pyspark.sql import functions as F

from quillspark.functions import similarity as sim
from quillspark.functions import text as T
from quillspark.operators import linkage as L
from quillspark.operators import verify as V

RECORD = "title string, first_author string, year int, container string, volume string, issue string, pages string, doi string, pmid string"
HINTS = "ref_id long, cited_doi string, cited_pmid string, cited_title string, cited_author string, cited_year string, cited_journal string"
WORDS = "common shared usual gamma delta kappa lambda sigma omicron epsilon theta upsilon ab cd 蛋白质组 临床试验研究".split()


def _titles():
    made = [" ".join(WORDS[(i * j + i // 3) % len(WORDS)] for j in range(1, 4 + i % 7)) for i in range(36)]
    odd = ["a b c d e f g h i j k l m n foo", "a b c d e f g h i j k l m n foo xx", "gamma of the and in on to foo", "gamma of the and in on to foox", "antidisestablishment of a wordless", "ntidisestablishment of a wordless", "临床试验研究 gamma", "临床试验研究 gamma x", "delta delta delta kappa", "delta kappa kappa kappa"]
    return made + odd


def _both(spark):
    works = [(t, ("Harris A", "Taylor B", None)[i % 3], (2000 + i % 4, None)[i % 7 == 6], ("Journal of One", None)[i % 5 == 4], None, None, None, f"10.1/{i}", None) for i, t in enumerate(_titles())]
    refs = [(i * 10 + j, ("10.9/none", None, None)[j], None, t, ("Harris A", "", None)[(i + j) % 3], (str(2000 + i % 5), None, "n.d.")[i % 3], ("J One", None)[i % 2]) for i, t in enumerate(_titles()) for j in range(3)]
    return spark.createDataFrame(refs, HINTS), spark.createDataFrame(works, RECORD)


def test_candidates_are_those_of_all_pairs(spark):
    refs, works = _both(spark)
    p, r = (sim.share(T.tokens(F.col(a)), T.tokens(F.col(b))) for a, b in (("cited_title", "title"), ("title", "cited_title")))
    title = sim.title_similarity(F.col("cited_title"), F.col("title"), strict=True)
    has_author, has_journal = F.coalesce("cited_author", F.lit("")) != "", F.coalesce("cited_journal", F.lit("")) != ""
    journal = F.when(has_journal & F.col("container").isNotNull(), sim.journal_match(F.col("cited_journal"), F.col("container"))).otherwise(1.0)
    pairs = refs.where("length(cited_title) >= 12").crossJoin(works).where((p > 0) & (p + r > 0.5)).withColumn("title_score", title).where("title_score >= 0.35")
    composite = sim.composite(F.col("title_score"), sim.author_match(F.col("cited_author"), F.col("first_author")), journal, has_author, F.col("cited_year"), F.col("year"), has_journal)
    rated = pairs.withColumn("composite", T.rounded(composite, 9)).withColumn("rating", F.expr("if(cited_doi is not null, title_score, composite)"))
    kept = rated.where("rating >= if(cited_doi is not null, 0.45, 0.5)").withColumn("work_key", F.concat(F.lit("doi:"), "doi"))
    for k in (1, 3):
        wanted = L.top(kept, "ref_id", k, F.desc("rating"), F.asc("work_key")).select("ref_id", "rank", "composite", "title_score", "doi").collect()
        got = V.title_candidates(refs, works, k).select("ref_id", "rank", "composite", "title_score", "found.doi").collect()
        assert len(wanted) > 50
        diff = set(map(tuple, got)) ^ set(map(tuple, wanted))
        assert not diff, (sorted(set(map(tuple, got)) - set(map(tuple, wanted)))[:8], sorted(set(map(tuple, wanted)) - set(map(tuple, got)))[:8], len(got), len(wanted))


def test_copies_of_a_title_do_not_meet_references_that_found_theirs(spark, monkeypatch):
    """Titles that differ by a number are similar to each other; a reference that has its own work needs no other."""
    asked, meet = [], L.rare_first
    monkeypatch.setattr(L, "rare_first", lambda left, *a: asked.append(sorted(r["ref_id"] for r in left.collect())) or meet(left, *a))
    titles = [f"{i} gamma delta kappa lambda sigma omicron epsilon theta upsilon common shared usual words here too" for i in range(100, 140)]
    works = spark.createDataFrame([(t, "Harris A", 2000, "Journal of One", None, None, None, f"10.1/{i}", None) for i, t in enumerate(titles)], RECORD)
    lost = [(50, "10.9/none", None, titles[0].replace("100", "999"), "Harris A", "2000", "J One"), (51, None, None, titles[0].replace("100", "999"), "Harris A", "2000", "Journal of One")]
    refs = [(i, ("10.9/none", None)[i % 2], None, t, "Harris A", "2000", "Journal of One") for i, t in enumerate(titles)]
    found = V.title_candidates(spark.createDataFrame(refs + lost, HINTS), works)
    assert asked == [[50, 51]]
    assert {r["ref_id"]: r["doi"] for r in found.select("ref_id", "found.doi").collect()} == {i: f"10.1/{i}" for i in range(40)} | {50: "10.1/0", 51: "10.1/0"}


def test_titles_that_share_frequent_words_only_do_not_meet(spark):
    n = 60
    refs = L.titled(spark.createDataFrame([(i, f"common shared usual word own{i} only{i} mine{i}") for i in range(n)], "ref_id long, t string"), "t", "a")
    works = L.titled(spark.createDataFrame([(i, f"common shared usual word own{i} only{i} other{i}") for i in range(n)], "work_key long, t string"), "t", "b")
    left, right = (x.withColumns({"f1": F.lit(0.75), "blocks": F.array(F.lit("every"))}) for x in L.rare_first(refs, "ref_id", "a", works, "work_key", "b"))
    l, r = L.leading(left, "ref_id"), L.leading(right, "work_key")
    assert l.join(r, "token").count() <= 10 * n
    assert sorted(map(tuple, L.likely_pairs(l, r, "ref_id", "work_key").collect())) == [(i, i) for i in range(n)]


def test_references_read_the_documents_once_and_figures_are_computed_once(spark):
    from quillspark.plans import verification

    files = verification.verify_status(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("documents" in f for f in files)
    twice = L.computed(spark.range(4), half=F.sqrt(F.col("id") + 1)).where("half > 1")
    assert twice._jdf.queryExecution().optimizedPlan().toString().upper().count("SQRT") == 1
