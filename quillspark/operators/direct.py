"""Works that a request names by DOI or PMID: looked up in several sources, merged, scored, and shown with what
speaks for them.

Everything that depends on the work alone is computed once for each distinct identifier; requests meet it by
equi-joins on (kind, value), and only narrow rows are grouped by request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import formats as C
from quillspark.functions import identifiers as I
from quillspark.functions import similarity as sim
from quillspark.functions import text as T
from quillspark.operators import linkage as L
from quillspark.operators.merge import coalescing_merge, supplement
from quillspark.operators.search import bm25

#: Fields of a record and how a missing value shows.
FIELDS = {"title": "string", "abstract": "string", "authors": "string", "container": "string", "year": "number", "doi": "string", "pmid": "string", "volume": "string", "issue": "string", "pages": "string"}
_ID = ["kind", "value"]


def asked(requests: DataFrame, key: list[str]) -> DataFrame:
    """(key, kind, value, place, said, year_hint, pmid_hint): the distinct identifiers of each request's text, DOIs first.
    Texts without identifiers, empty and null ones give no row; equal requests are asked once."""
    known = requests.select(*key, I.dois(F.col("text")).alias("dois"), I.pmids(F.col("text")).alias("pmids"), I.year_hint(F.col("text")).alias("year_hint"))

    def rows(kind: str, at: int, hint) -> Column:
        return F.transform(f"{kind}s", lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lower(x).alias("value"), (i + at).alias("place"), F.concat(F.lit(f"{kind.upper()}："), x).alias("said"), hint(x).alias("pmid_hint")))

    first = F.get("pmids", F.lit(0))
    return known.select(*key, "year_hint", F.inline(F.concat(rows("doi", 0, lambda x: first), rows("pmid", 100, lambda x: x)))).distinct()


def records(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """The record of each wanted (kind, value), of all sources that hold it: of each field the first value that isn't
    missing, by source_rank and work_id, the largest count of citations, the distinct sources. sources: kind, value,
    source_rank, source, work_id, cited and FIELDS; rows without a title don't count."""
    held = sources.where(F.coalesce("title", F.lit("")) != "").join(wanted.select(*_ID).distinct(), _ID, "left_semi")
    place = F.struct("source_rank", "work_id")
    return coalescing_merge(held, _ID, place, {"work_id": "id", **FIELDS}, ["cited"], ["source"])


def described(found: DataFrame, most_query: int = 280) -> DataFrame:
    """records with the figures of a search for their own title, the runs of the title that count, the sentences of
    the abstract that share most with it, and citations in three styles."""
    bag = T.tokens(F.col("title"))
    rows = found.withColumns(
        {
            "title_score": F.when(T.normalize(F.col("title")) == "", 0.0).otherwise(1.0),
            "abstract_score": T.let(F.struct(bag.alias("a"), T.tokens(F.col("abstract")).alias("b")), lambda x: sim.token_f1(x["a"], x["b"])),
            "title_segments": T.let(bag, lambda b: T.highlight(F.col("title"), b)),
            "query_segments": T.let(bag, lambda b: T.highlight(F.substring("title", 1, most_query), b)),
            "snippets": T.snippets(F.col("title"), F.col("abstract")),
        }
    )
    styles = C.citations(C.parse_authors(F.col("authors")), *[F.col(c) for c in ("title", "container", "year", "volume", "issue", "pages", "doi")], F.lit("article"))
    return rows.withColumns(styles)


def hits(requests: DataFrame, sources: DataFrame, key: list[str], stage, k: int = 12) -> DataFrame:
    """The works that each request names, best first, at most k a request. A work named in several ways is one hit: the
    best score wins (the later of equals), what it was named by (up to 4), reasons (up to 8) and sources join, and the
    longer list of snippets stays."""
    named = stage(asked(requests, key))
    works = stage(described(records(named, sources)))
    slim = works.select(*_ID, "work_id", "year", "pmid", "cited", "title_score", "abstract_score", "source", F.size("snippets").alias("n_snippets"), F.coalesce(F.nullif(F.lower("doi"), F.lit("")), T.normalize(F.col("title"))).alias("work_key"))
    rows = named.join(slim, _ID).withColumns({"mode": F.lit("title"), "coverage": F.lit(0.0), "doi_hit": F.col("kind") == "doi", "pmid_hit": F.coalesce(F.col("pmid") == F.col("pmid_hint"), F.lit(False)), "year_status": L.year_status(F.col("year_hint"), F.col("year"))})
    n_sources = F.size(F.split("source", ","))
    score = L.match_score(*[F.col(c) for c in ("mode", "title_score", "abstract_score", "coverage", "year_hint", "year")], n_sources, F.col("doi_hit"), F.col("cited"))
    rows = rows.withColumn("score", score).where(F.col("score") >= L.threshold(F.col("mode")))
    rows = rows.withColumns({"score": T.rounded(F.col("score"), 2), "reasons": L.reasons(*[F.col(c) for c in ("mode", "title_score", "coverage", "abstract_score", "year_status", "doi_hit", "pmid_hit")], F.lit(1))})
    # An identifier list is bounded by twice ten, so is each group.
    one = F.struct("score", "place", "said", "reasons", F.split("source", ",").alias("sources"), F.coalesce("cited", F.lit(0)).alias("cited"), "n_snippets", *_ID, "doi_hit", "pmid_hit", "year_status")
    merged = rows.groupBy(*key, "work_key").agg(F.reverse(F.array_sort(F.collect_list(one))).alias("x"))
    first = F.get("x", F.lit(0))
    fullest = F.array_max(F.transform("x", lambda e, i: F.struct(e["n_snippets"].alias("n"), (-i).alias("late"), e["kind"].alias("kind"), e["value"].alias("value"))))
    shown = merged.select(
        *key, "work_key", *[first[c].alias(c) for c in ("score", "cited", "place", *_ID, "doi_hit", "pmid_hit", "year_status")],
        F.slice(F.array_distinct("x.said"), 1, 4).alias("said"), F.slice(F.array_distinct(F.flatten("x.reasons")), 1, 8).alias("reasons"), F.array_distinct(F.flatten("x.sources")).alias("sources"),
        fullest["kind"].alias("snippet_kind"), fullest["value"].alias("snippet_value"),
    )
    best = L.top_of(shown, key, k, F.desc("score"), F.desc("cited"), F.asc("place"), F.asc("work_key"))
    snippets = works.select(F.col("kind").alias("snippet_kind"), F.col("value").alias("snippet_value"), "snippets")
    return best.join(works.drop("snippets", "cited", "source"), _ID).join(snippets, ["snippet_kind", "snippet_value"]).drop("snippet_kind", "snippet_value")


def quick(asks: DataFrame, works: DataFrame, index: DataFrame, medical: DataFrame, key: str, most: int = 10) -> DataFrame:
    """(key, work_id, pmid, origin, place) of what is found for each query: by identifier in works, or by the titles of
    index (8), and of medical (5) where these are fewer than 3; at most 10 a query. Works have work_id, title, doi, pmid;
    of several of one identifier the smallest work_id counts."""
    query = T.strip(F.coalesce("query", F.lit("")))
    typed = asks.select(key, query.alias("query")).where(F.length("query") >= 2).withColumn("kind", I.kind(F.col("query")))
    named = typed.where("kind in ('doi', 'pmid')").select(key, "kind", I.value(F.col("query"), F.col("kind")).alias("value"))
    keys = works.select("work_id", "pmid", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lower(k).alias("value")) for k in ("doi", "pmid")]))).where("value is not null")
    one = named.join(keys, ["kind", "value"]).groupBy(key).agg(F.min(F.struct("work_id", "pmid")).alias("w")).select(key, "w.work_id", "w.pmid", F.lit("index").alias("origin"), F.lit(1).alias("pos"))
    rest = typed.join(one.select(key), key, "left_anti")

    def search(held: DataFrame, k: int, origin: str) -> DataFrame:
        best = bm25(rest, held, key, "work_id", "query", "title", k=k)
        return best.join(held.select("work_id", "pmid"), "work_id").select(key, "work_id", "pmid", F.lit(origin).alias("origin"), F.col("rank").alias("pos"))

    # An identifier that is known isn't supplemented.
    more = supplement(search(index, 8, "index"), search(medical, 5, "medical"), key, "pmid", 3, most)
    return more.select(key, "work_id", "pmid", "origin", "place").unionByName(one.withColumnRenamed("pos", "place"))
