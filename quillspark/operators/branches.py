"""Search over branches of which a request's type wants only some, and fields that an array names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.merge import fallback, first_wins, union_all
from quillspark.operators.ranking import places
from quillspark.sources.staging import Stage

#: The types that a branch of each kind is asked for.
WANTED = {"data": ("all", "data"), "paper": ("all", "paper", "data"), "trial": ("all", "trial")}


@dataclass
class Branch:
    """A source of hits (request, id, kind, doi, url, title, year, cited, pos). Requests that find nothing go on to
    `second`, if there is one. Neither is called unless the type wants the branch, so its tables aren't read."""

    kind: str
    first: Callable[[], DataFrame]
    second: Callable[[], DataFrame] | None = None

    def hits(self) -> DataFrame:
        return fallback(self.first(), self.second(), "request") if self.second else self.first()


def key_of(doi: Column, url: Column, id_: Column) -> Column:
    """By DOI, without one by address, without that by id."""
    return F.coalesce(F.concat(F.lit("doi:"), F.lower(F.nullif(doi, F.lit("")))), F.concat(F.lit("url:"), F.lower(F.nullif(url, F.lit("")))), id_)


def search(branches: list[Branch], kind: str, since: int | None, order: str, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(hits with their place, facets): of equal hits the one of the first branch, rows since a year (those without
    pass), facets before the type's own kind is picked. order: relevance (by branch), citations or date."""
    wanted = [b for b in branches if kind in WANTED[b.kind]]
    rows = union_all([b.hits() for b in wanted]).withColumn("key", key_of(F.col("doi"), F.col("url"), F.col("id")))
    once = first_wins(rows, ["request", "key"], F.asc("source_rank"), F.asc("pos"), F.asc("id"))
    if since is not None:
        once = once.where(F.coalesce("year", F.lit(0)).isin(0) | (F.col("year") >= since))
    once = stage(once.drop("key"))
    facets = once.groupBy("request").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in WANTED])
    of_kind = once if kind == "all" else once.where(F.col("kind") == kind)
    by = {"relevance": [], "citations": [F.desc("n")], "date": [F.desc("n")]}[order]
    number = F.coalesce("cited" if order == "citations" else "year", F.lit(0))
    return places(of_kind.withColumn("n", number), ["request"], [*by, F.asc("source_rank"), F.asc("pos"), F.asc("id")], stage).drop("n"), facets


def overlapping(requests: DataFrame, works: DataFrame, request: str, work: str, fields: str) -> DataFrame:
    """(request, work) of the works that share a field with the request: both arrays are taken apart, and the
    fields meet in an equi-join, works by an inverted index of fields."""
    asked = requests.select(request, F.explode(F.array_distinct(fields)).alias("field"))
    index = works.select(work, F.explode(F.array_distinct(fields)).alias("field"))
    return asked.join(index, "field").select(request, work).distinct()


def biased(words: Column, terms: tuple[str, ...]) -> Column:
    """Words of a query, widened by terms that also count."""
    return F.array_distinct(F.concat(words, F.array(*map(F.lit, terms))))


def total(only_open: Column, merged: Column, *reported: Column) -> Column:
    """How many results there are: the most that any source reports, or what is left where only open ones count."""
    return F.when(only_open, merged).otherwise(F.greatest(merged, *reported))
