"""Markup and white space: faster forms give what the plain ones gave."""

from pyspark.sql import functions as F

from quillspark.functions import labels as L
from quillspark.functions import text as T

ODD = [None, "", " ", "  a  b ", "a b", "a   b", "\ta \nb\r\n　c﻿", "x​ y  z", "a b c", "\u0085 a\x1c b", "\x7f \x7f", "é  ü", "\U0001f600  \U0001f600", "  ", "a\x00  b"]


def test_white_space_is_squeezed_as_by_replacing_all_of_it(spark):
    got = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", F.trim(F.regexp_replace("t", rf"{T.SPACE}+", " ")).alias("old"), T.squeeze(F.col("t")).alias("new")).collect()
    assert [r["new"] for r in got] == [r["old"] for r in got]


def test_long_runs_are_not_searched_for_references(spark):
    """whether a run is a reference shows at its start, before patterns are tried at each of its places."""
    texts = [("a &amp; b &#65;&#x42; &#x110000; &#1114112; &#; &#x; & &lt;i&gt;<b>c</b> &amp;#67; &#99999999;",), ("no reference",), ("&#39;",)]
    rows = spark.createDataFrame(texts, "t string").select(L.strip_markup(F.col("t")).alias("x"))
    assert [r["x"] for r in rows.collect()] == ["a & b AB &#x110000; &#1114112; &#; &#x; & <i> c C &#99999999;", "no reference", "'"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "startswith(" in plan and plan.index("startswith(") < plan.index("rlike") and "contains(" in plan


def test_runs_are_joined_without_copying_those_before(spark):
    """the runs of a long title are each copied once."""
    words = F.array(*[F.lit(w) for w in ("sleep", "adults")])
    texts = [("Sleep in older Adults!",), ("--",), ("sleep adults",), ("",), (None,), ("x " * 3000 + "sleep",)]
    rows = spark.createDataFrame(texts, "t string").select(T.highlight(F.col("t"), words).alias("x"), T.highlight(F.col("t"), F.lit(None).cast("array<string>")).alias("none"))
    assert "aggregate(" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()
    got = rows.collect()
    assert [r["x"] and [tuple(s) for s in r["x"]] for r in got] == [[("Sleep", True), (" in older ", False), ("Adults", True), ("!", False)], [("--", False)], [("sleep", True), (" ", False), ("adults", True)], [], None, [("x " * 3000, False), ("sleep", True)]]
    assert got[1]["none"] is not None and got[4]["none"] is None


def test_a_document_makes_its_records_in_one_pass(spark):
    """three sources read the documents once."""
    from quillspark.plans import direct

    plan = direct._sources(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 1
