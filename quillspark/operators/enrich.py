"""Records completed from several sources, field by field, by precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metrics that a second lookup completes where one of them is missing.
METRICS = ("mean_cited", "h_index", "issn", "publisher")


def given(c: Column) -> Column:
    """The value, null for an empty text."""
    return F.nullif(c, F.lit(""))


def keys(doi: Column, pmid: Column) -> Column:
    """Array of the keys that a record answers to: by DOI in lower case, then by PMID."""
    return F.array_compact(F.array(F.concat(F.lit("doi:"), F.lower(given(doi))), F.concat(F.lit("pmid:"), given(pmid.cast("string")))))


def by_key(source: DataFrame, *fields: str) -> DataFrame:
    """(key, found): one record a key, the smallest by value of those that share it. Aggregated before it is
    shuffled, so that a source of many rows for one key isn't a hot one."""
    rows = source.select(F.explode(keys(F.col("doi"), F.col("pmid"))).alias("key"), F.struct(*fields).alias("found"))
    return rows.groupBy("key").agg(F.min("found").alias("found"))


def lookup(asked: DataFrame, source: DataFrame, key: str, into: str) -> DataFrame:
    """asked with the source's record of its key, or null: distinct keys only go to the source."""
    hits = asked.select(key).where(F.col(key).isNotNull()).distinct().join(source.withColumnRenamed("key", key), key)
    return asked.join(hits.withColumnRenamed("found", into), key, "left")


def open_links(best: Column, locations: Column, is_open: Column) -> Column:
    """struct(is_open, pdf, landing, host): the best location's links, else the first location with a PDF and
    the first location's page. A link makes a work open."""
    pdf = F.coalesce(given(best["url_for_pdf"]), F.get(F.filter(F.transform(locations, lambda l: given(l["url_for_pdf"])), lambda u: u.isNotNull()), F.lit(0)))
    landing = F.coalesce(given(best["url"]), given(F.get(locations, F.lit(0))["url"]))
    some = F.coalesce(is_open, F.lit(False)) | pdf.isNotNull() | landing.isNotNull()
    return F.struct(some.alias("is_open"), pdf.alias("pdf"), landing.alias("landing"), given(best["host_type"]).alias("host"))


def enrich(papers: DataFrame, index: DataFrame, links: DataFrame, library: DataFrame, metrics: DataFrame) -> DataFrame:
    """papers (id, doi, pmid, need_abstract) with metrics, citations, links, abstract and title.

    index (doi, pmid, cited, oa_url, abstract, title, source_key and METRICS) is asked by DOI, by PMID only
    without one; links (doi, pmid, pdf, landing) by DOI; library (doi, pmid, pdf, html, abstract, title) by either,
    DOI first. Landing pages come from index, links, library in that order, PDFs from links, then library;
    abstracts from index unless the paper needs one and library has it; titles from index, then library.
    metrics (source_key and METRICS) is asked once a key, and only for keys some of whose metrics are missing;
    what it returns replaces all four."""
    own = papers.withColumns({"by_doi": F.concat(F.lit("doi:"), F.lower(given(F.col("doi")))), "by_pmid": F.concat(F.lit("pmid:"), F.col("pmid").cast("string"))}).withColumn("first_key", F.coalesce("by_doi", "by_pmid"))
    found = lookup(own, by_key(index, "cited", "oa_url", "abstract", "title", "source_key", *METRICS), "first_key", "a")
    found = lookup(found, by_key(links, "pdf", "landing"), "by_doi", "b")
    third = by_key(library, "pdf", "html", "abstract", "title", F.col("pmid").cast("string").alias("number"))
    found = lookup(lookup(found, third, "by_doi", "c_doi"), third, "by_pmid", "c_pmid").withColumn("c", F.coalesce("c_doi", "c_pmid"))

    short = F.greatest(*[F.col(f"a.{m}").isNull() for m in METRICS])
    found = found.withColumn("source_key", F.when(short, F.col("a.source_key")))
    full = metrics.groupBy("source_key").agg(F.min(F.struct(*METRICS)).alias("found")).withColumnRenamed("source_key", "key")
    found = lookup(found, full, "source_key", "m")
    page = F.concat(F.lit("https://europepmc.org/article/MED/"), F.col("c.number"))
    landing = F.coalesce(given(F.col("a.oa_url")), F.col("b.landing"), given(F.col("c.html")), page)
    late = F.coalesce(F.col("need_abstract"), F.lit(False)) & given(F.col("c.abstract")).isNotNull()
    abstract = F.when(late, F.col("c.abstract")).otherwise(F.coalesce(given(F.col("a.abstract")), given(F.col("c.abstract"))))
    chosen = [F.when(F.col("m").isNotNull(), F.col(f"m.{x}")).otherwise(F.col(f"a.{x}")).alias(x) for x in METRICS]
    return found.select(
        "id", F.col("a.cited").alias("cited"), *chosen, F.coalesce(F.col("b.pdf"), given(F.col("c.pdf"))).alias("pdf"), landing.alias("landing"), page.alias("library_page"),
        abstract.alias("abstract"), F.coalesce(given(F.col("a.title")), given(F.col("c.title"))).alias("title"), F.col("m").isNotNull().alias("asked_again"),
    )
