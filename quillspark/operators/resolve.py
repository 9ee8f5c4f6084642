"""Resolving what is asked for, identifiers or text, to works; paging; the first row that will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import identifiers as I
from quillspark.operators.search import bm25


def resolve_works(asks: DataFrame, works: DataFrame) -> DataFrame:
    """(ask_id, kind, value, work_id, found_by) for every ask, in one equi-join on kind and identifier.

    asks: ask_id, query. works: work_id, doi, pmid, title. A DOI or work that is unknown stays unresolved;
    an unknown PMID, a trial and text are searched for, and the best work by relevance is taken. Of several
    works of one identifier the smallest work_id counts. Asks of nothing have no kind and no work."""
    kind = I.kind(F.col("query"))
    typed = asks.select("ask_id", kind.alias("kind"), I.value(F.col("query"), kind).alias("value"))
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("doi", F.lower("doi")), ("pmid", F.col("pmid").cast("string")), ("work", F.concat(F.lit("W"), F.col("work_id").cast("string"))))])
    index = works.select("work_id", F.inline(keys)).where("value is not null").groupBy("kind", "value").agg(F.min("work_id").alias("by_key"))
    known = typed.where("kind in ('doi', 'pmid', 'work')").join(index, ["kind", "value"], "left")
    others = typed.where("kind is null or kind not in ('doi', 'pmid', 'work')").withColumn("by_key", F.lit(None).cast("long"))
    rows = known.unionByName(others)
    sought = rows.where("by_key is null and kind in ('pmid', 'trial', 'text')").select("ask_id", "value")
    best = bm25(sought, works, "ask_id", "work_id", "value", "title", k=1).select("ask_id", F.col("work_id").alias("by_text"))
    out = rows.join(best, "ask_id", "left")
    found_by = F.when(F.col("by_key").isNotNull(), F.col("kind")).when(F.col("by_text").isNotNull(), "search")
    return out.select("ask_id", "kind", "value", F.coalesce("by_key", "by_text").alias("work_id"), found_by.alias("found_by"))


def multi_get(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A row for each wanted key, at its place; columns of rows are null where the key is unknown. Of rows
    that share a key, any one with all its columns is taken: the smallest by value."""
    others = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.min(F.struct(*others)).alias("_row"))
    return wanted.join(one, key, "left").select(*wanted.columns, *[F.col("_row")[c].alias(c) for c in others])


def clamp(x: Column, least: int, most: int | None, default: int) -> Column:
    """x within the limits; the default where it is missing."""
    low = F.greatest(F.coalesce(x, F.lit(default)), F.lit(least))
    return low if most is None else F.least(low, F.lit(most))


def pages(rows: DataFrame, key: str, page: Column, per_page: Column, *order: Column) -> DataFrame:
    """The page of each key's rows that is asked for, with place, page, per_page and the total of all rows.
    Pages count from 1; five to twenty rows a page, 12 by default."""
    each = Window.partitionBy(key)
    numbered = rows.withColumns({"place": F.row_number().over(each.orderBy(*order)), "total": F.count(F.lit(1)).over(each), "page": clamp(page, 1, None, 1), "per_page": clamp(per_page, 5, 20, 12)})
    offset = (F.col("page") - 1) * F.col("per_page")
    return numbered.where((F.col("place") > offset) & (F.col("place") <= offset + F.col("per_page")))


def first_acceptable(wanted: DataFrame, texts: DataFrame, key: str, names: str, name: str, text: str, most: int = 1200) -> DataFrame:
    """(key, text) by the first of each key's names that has a text of 80 characters or more that isn't a
    list of meanings; null where none has. wanted: key, names (array). texts: name, text."""
    asked = wanted.select(key, F.posexplode(names).alias("_pos", name))
    good = texts.where((F.length(text) >= 80) & ~F.contains(F.lower(text), F.lit("may refer to:")))
    best = asked.join(good, name).groupBy(key).agg(F.min_by(F.substring(text, 1, most), F.struct("_pos", text)).alias(text))
    return wanted.select(key).join(best, key, "left")
