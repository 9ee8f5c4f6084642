"""Queries read all of their input: cases where a part of it used to be left out."""

import datetime
import hashlib

import duckdb

from quillspark.operators import verify
from quillspark.plans import federated, matching, outputs, records, verification


def save(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_sentences_of_later_turns_are_matched(spark, tmp_path):
    works = [(1, "Malaria vaccine trial outcomes", "en", "a", 5), (2, "Coastal erosion survey methods", "en", "a", 9)]
    said = [(7, 0, "user", "Malaria vaccine trial outcomes"), (7, 1, "assistant", "Coastal erosion survey methods"), (7, 2, "user", "Malaria vaccine trial outcomes"), (8, 0, "user", "Unrelated kitchen furniture")]
    d = save(spark, tmp_path, documents=(works, DOCUMENTS), conversations=(said, "conv_id long, turn long, role string, text string"))
    report = {(r["conv_id"], r["turn"], r["pos"]): (r["hits"], r["works"]) for r in matching.match_sentence_report(spark, d).collect()}
    assert report == {(7, 0, 0): (1, "1"), (7, 1, 0): (1, "2"), (7, 2, 0): (1, "1"), (8, 0, 0): (0, None)}
    merged = {(r["conv_id"], r["work_id"]): (r["rank"], r["sentences"]) for r in matching.match_hit_merge(spark, d).collect()}
    assert merged == {(7, 2): (1, "t1s0"), (7, 1): (2, "t2s0,t0s0")}


def test_hits_of_late_sentences_and_late_words_are_merged(spark, tmp_path):
    """the eleventh sentence of a turn, one that begins like another, and what comes after 500 characters count."""
    works = [(1, "Malaria vaccine trial outcomes", "en", "a", 5), (2, "Coastal erosion survey methods", "en", "a", 9), (3, "Glacier melt models. Zebrafish heart regeneration imaging", "en", "a", 2)]
    others = "\n".join(f"Nothing kitchen{i} furniture" for i in range(12))
    same = " ".join(f"preamble{i}" for i in range(20))
    late = "x" * 600 + " zebrafish heart regeneration imaging glacier melt models"
    said = [(7, 0, "user", f"{others}\nMalaria vaccine trial outcomes"), (8, 0, "user", f"{same}\n{same} coastal erosion survey methods"), (9, 0, "user", f"Kitchen furniture\n{late}")]
    d = save(spark, tmp_path, documents=(works, DOCUMENTS), conversations=(said, "conv_id long, turn long, role string, text string"))
    got = [tuple(r) for r in matching.match_hit_merge(spark, d).select("conv_id", "work_id", "rank", "sentences").orderBy("conv_id").collect()]
    assert got == [(7, 1, 1, "t0s12"), (8, 2, 1, "t0s1"), (9, 3, 1, "t0s1")]
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    wanted = con.sql(matching.ORACLES["match_hit_merge"])
    assert sorted(map(tuple, matching.match_hit_merge(spark, d).select(wanted.columns).collect())) == sorted(wanted.fetchall())


def test_late_words_and_sentences_of_an_item_are_asked(spark, tmp_path):
    """libraries are asked what comes after 220, 320 and 500 characters of a sentence, and sentences after the tenth."""
    works = [(1, "Malaria vaccine trial outcomes", "en", "a", 500), (2, "Coastal erosion survey methods", "en", "a", 900), (3, "Zebrafish heart regeneration imaging", "en", "a", 200), (4, "Glacier melt models of the north", "en", "a", 100)]
    filler = lambda n: " ".join(f"filler{chr(97 + i % 26) * (1 + i // 26)}" for i in range(n))
    others = "\n".join(f"Nothing kitchen{chr(97 + i) * 3} furniture" for i in range(12))
    late = "x" * 510 + " zebrafish heart regeneration imaging"
    items = [(1, f"{others}\nMalaria vaccine trial outcomes"), (2, f"{filler(30)} coastal erosion survey methods"), (3, f"{filler(5)}\n{late}"), (4, "y" * 165 + " glacier melt models north"), (5, "y" * 165 + " coastal erosion")]
    d = save(spark, tmp_path, documents=(works, DOCUMENTS), benchmark=(items, "item_id long, text string"), labels=([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int"))
    got = federated.match_sources_merge(spark, d)
    assert {(r["item_id"], r["pos"], r["work_id"]) for r in got.collect()} >= {(1, 12, 1), (3, 1, 3)}
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    wanted = con.sql(federated.ORACLES["match_sources_merge"])
    assert sorted(map(tuple, got.select(wanted.columns).collect())) == sorted(wanted.fetchall())


def test_words_after_the_fiftieth_are_indexed(spark, tmp_path):
    text = " ".join(f"w{i % 70}" for i in range(120))
    d = save(spark, tmp_path, documents=([(1, text.replace(" w60", "\n w60"), "en", "a", 5)], DOCUMENTS))
    assert [tuple(r) for r in matching.inverted_index_rebuild(spark, d).collect()] == [(1, 70, hashlib.md5(text.encode()).hexdigest())]


def test_evidence_after_the_first_line_counts(spark, tmp_path):
    d = save(spark, tmp_path, documents=([(7, "A title\nWe followed a cohort.\nSee the guideline.", "en", "a", 5)], DOCUMENTS))
    assert [tuple(r) for r in outputs.evidence_tags(spark, d).collect()] == [(7, "指南/共识,观察性")]


def test_dead_identifiers_are_asked_by_title_in_all_sources(spark):
    work = "title string, first_author string, year int, container string, volume string, issue string, pages string, doi string, pmid string"
    a = ("Malaria vaccine trial outcomes in children", "Harris P", 2001, "Nature", "1", "2", "3-4", "10.1/a", None)
    b = ("Coastal erosion survey methods and results", "Taylor B", 2002, "Science", "5", "6", "7-8", None, "222")
    registry, none, medical = spark.createDataFrame([a], work), spark.createDataFrame([], work), spark.createDataFrame([b], work)
    hints = "ref_id long, cited_doi string, cited_pmid string, cited_year string, cited_title string, cited_author string, cited_journal string, cited_volume string, cited_issue string, cited_pages string"
    asked = [
        (1, "10.9/x", None, "2001", a[0], "Harris P", "Nature", "1", "2", "3-4"),
        (2, "10.9/y", None, "1999", "Malaria vaccine trial outcomes in adults", "Minor C", "Nature", "1", "2", "3-4"),
        (3, None, "999", "2005", b[0], "Taylor B", "Science", "5", "6", "7-8"),
        (4, None, None, "2002", b[0], "Taylor B", "Science", "5", "6", "7-8"),
        (5, "10.9/z", None, "2002", "Nothing of the kind anywhere", "Duda S", "Cell", "5", "6", "7-8"),
        (6, "10.1/a", None, "2001", a[0], "Harris P", "Nature", "1", "2", "3-4"),
    ]
    found = verify.resolve(spark.createDataFrame(asked, hints), registry, none, none, medical).cache()
    assert {r["ref_id"]: (r["branch"], r["record"] and r["record"]["title"]) for r in found.collect()} == {1: ("dead_doi", a[0]), 2: ("dead_doi", a[0]), 3: ("dead_pmid", b[0]), 4: ("title", b[0]), 5: ("dead_doi", None), 6: ("registry", a[0])}
    checks = verify.field_checks(found)
    assert {r["field"] for r in checks.where("ref_id < 3").collect()} == {"title"} and checks.where("ref_id = 3").count() == 8
    got = {r["ref_id"]: (r["status"], r["drift"]) for r in verify.status(found, checks).collect()}
    assert got[1] == ("risk", "doi") and got[2] == ("risk", "doi,title") and got[3] == ("risk", "pmid,year") and got[4][0] != "insufficient" and got[5] == ("risk", "doi")


def test_all_data_hits_are_ranked_and_all_sources_counted(spark, tmp_path):
    customers = [(i, f"C{i}", i % 25, float(i // 2), "x") for i in range(10, 85)]
    d = save(
        spark,
        tmp_path,
        customer=(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        supplier=([(11, "S", 1, 7.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        part=([(10, "P", 1.0)], "p_partkey long, p_name string, p_retailprice double"),
        nation=([(10, "N", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        region=([(10, "R")], "r_regionkey int, r_name string"),
        orders=([(1, 9.5, datetime.datetime(2006, 1, 2)), (2, 0.5, datetime.datetime(2006, 1, 2)), (3, 9.5, datetime.datetime(1999, 1, 2))], "o_orderkey long, o_totalprice double, o_orderdate timestamp_ntz"),
    )
    hits = [("customer", k, int(n)) for k, _, _, n, _ in customers if k % 30 + 1995 >= 2005] + [("supplier", 11, 7)] + [("curated", i, 0) for i in range(1, 26)]
    order = {"customer": 0, "supplier": 1, "curated": 2}
    hits.sort(key=lambda x: (-x[2], order[x[0]], x[1]))
    got = records.datasets_since_type_sort(spark, d).orderBy("rank").collect()
    assert len(hits) > 50 and [(r["rank"], r["tag"], r["pos"]) for r in got] == [(i, t, p) for i, (t, p, _) in enumerate(hits, 1)]
    facets = {r["kind"]: (r["hits"], r["cited_hits"]) for r in records.datasets_union_facets(spark, d).collect()}
    assert facets == {"data": (len(hits), len(hits) - 25), "paper": (3, 2), "trial": (2, 2)}


def test_small_parts_are_named_too(spark, tmp_path):
    at = datetime.datetime(2020, 1, 1)
    events = [(1, at, 5, "view", 1.0, '{"k": 10}'), (2, at, 6, "view", 1.0, '{"k": 99}')]
    parts = [(10, 3, 1.0), (11, 6, 2.0), (12, 7, 3.0)]
    d = save(spark, tmp_path, events=(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"), part=(parts, "p_partkey long, p_size int, p_retailprice double"))
    assert sorted(map(tuple, records.trial_bridge(spark, d).select("user_id", "p_partkey", "pos", "how").collect())) == [(5, 10, 1, "named"), (6, 12, 1, "searched")]


def test_lists_of_all_references_are_split(spark, tmp_path):
    d = save(spark, tmp_path, documents=([(i, f"Some words about topic {chr(97 + i % 26) * 6} here", "en", "a", 5) for i in range(40)], DOCUMENTS))
    got = outputs.ref_split_list(spark, d).groupBy("list_id").count().where(f"list_id >= {len(outputs.LISTS)}").collect()
    assert sorted(r["count"] for r in got) == [8] * 5


def test_candidates_come_from_every_source(spark, tmp_path):
    d = save(spark, tmp_path, documents=([(i, f"Some words about topic {chr(97 + i % 26) * 6} here", "en", "a", 5) for i in range(240)], DOCUMENTS))
    held = {i for i in range(240) if i % 6 == 4 and (i % 7 != 6 or i % 5 != 4 or i % 11 == 0 or i % 3 == 0)}
    first = {r["ref_id"]: r["doi"] for r in verification.candidate_composite(spark, d).where("rank = 1").collect()}
    assert {i: first.get(i) for i in held} == {i: f"10.1000/doc.{i}" for i in held}
