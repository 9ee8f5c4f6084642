"""Queries: merging, enriching, faceting and summarising records; graph, series and search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import graph as G
from quillspark.operators import merge as M
from quillspark.operators import linkage as L
from quillspark.operators.linkage import top
from quillspark.operators.ranking import places
from quillspark.operators.search import bm25
from quillspark.plans import duck as D
from quillspark.sources import tables as S
from quillspark.sources.staging import Stage


def _pages(spark, d, k=12):
    """Each customer's orders as two ranked lists: by price, and by date; and in how many partitions they lie, in proportion
    to the orders, so that what a task sorts doesn't grow with them."""
    o = S.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    parts = L.parts_of(o, o.count(), L.SORTED_EACH)
    o = o.repartition(parts, "o_custkey")
    by_price = top(o, "o_custkey", k, F.desc("o_totalprice"), F.asc("o_orderkey")).withColumnRenamed("rank", "pos")
    by_date = top(o, "o_custkey", k, F.desc("day"), F.asc("o_orderkey")).withColumnRenamed("rank", "pos")
    return [by_price, by_date], parts


def _interleaved(spark, d):
    lists, parts = _pages(spark, d)
    return M.interleave(lists, "o_custkey", "o_orderkey", parts)


def papers_interleave_dedupe(spark, d):
    merged = _interleaved(spark, d)
    return merged.where("place <= 12").select("o_custkey", "o_orderkey", "place", "source_rank", F.year("day").alias("year"))


_PAGES = """
a AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS pos, 0 AS source_rank FROM orders),
b AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS pos, 1 AS source_rank FROM orders),
u AS (SELECT * FROM a WHERE pos <= 12 UNION ALL SELECT * FROM b WHERE pos <= 12),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey ORDER BY pos, source_rank) AS n FROM u) WHERE n = 1),
i AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY pos, source_rank) AS place FROM k)"""


def papers_sort(spark, d):
    """The first page of each customer in all three orders."""
    page = _interleaved(spark, d).where("place <= 12").withColumn("cited", F.when(F.col("source_rank") == 0, F.floor("o_totalprice")).otherwise(0))
    w = Window.partitionBy("o_custkey")
    ranks = {"by_cited": F.row_number().over(w.orderBy(F.desc("cited"), F.asc("place"))), "by_year": F.row_number().over(w.orderBy(F.desc(F.year("day")), F.asc("place")))}
    return page.withColumns(ranks).select("o_custkey", "o_orderkey", "place", "by_cited", "by_year")


def papers_enrich(spark, d):
    """Orders with what their customer and nation add: the customer's segment replaces a missing status,
    the larger of price and balance counts, and only the first 5 orders of a customer are enriched."""
    o = S.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    first = o.withColumn("pos", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    c = S.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = S.table(spark, d, "nation").select("n_nationkey", "n_name")
    rows = first.join(c, first["o_custkey"] == c["c_custkey"], "left").join(n, F.col("c_nationkey") == n["n_nationkey"], "left")
    near = F.col("pos") <= 5
    return rows.select(
        "o_orderkey",
        F.when(near & (F.col("o_orderstatus") == "P"), F.coalesce("c_mktsegment", "o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(near, F.greatest("o_totalprice", "c_acctbal")).otherwise(F.col("o_totalprice")).alias("worth"),
        F.when(near, F.col("n_name")).alias("venue"),
        (near & (F.coalesce("c_acctbal", F.lit(0.0)) > 0)).alias("is_open"),
    ).where(F.col("is_open") | (F.col("status") != "P"))


def journal_metrics(spark, d):
    """Sales figures of suppliers beside their own row, as metrics of a journal; suppliers without sales keep nulls."""
    facts = S.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("works"), F.round(F.sum("l_quantity")).cast("long").alias("cited"), F.max(F.year("l_shipdate")).alias("last_year"))
    s = S.table(spark, d, "supplier")
    return s.join(facts, s["s_suppkey"] == facts["l_suppkey"], "left").select("s_suppkey", "s_name", "works", "cited", "last_year", T.rounded(F.try_divide(F.col("cited"), F.col("works"))).alias("mean_cited"))


#: Kind, table, columns for key, title and number of each dataset source, in order of precedence.
_SOURCES = (("data", "customer", "c_custkey", "c_name", "c_acctbal"), ("data", "supplier", "s_suppkey", "s_name", "s_acctbal"), ("paper", "part", "p_partkey", "p_name", "p_retailprice"), ("trial", "nation", "n_nationkey", "n_name", "n_regionkey"), ("trial", "region", "r_regionkey", "r_name", "r_regionkey"))


#: Titles of the curated rows, fixed values.
_CURATED = (
    "MIMIC-IV Demo",
    "PhysioNet Challenge Datasets",
    "The Cancer Genome Atlas (TCGA)",
    "GTEx Portal",
    "ENCODE Project",
    "openFDA Drug Adverse Events",
    "ClinicalTrials.gov Study Records",
    "CDC WONDER / data.cdc.gov",
    "UK Biobank Showcase (metadata)",
    "NCBI Gene Expression Omnibus (GEO)",
    "PRIDE Proteomics Archive",
    "RCSB Protein Data Bank",
    "ChEBI Chemical Entities",
    "Human Protein Atlas",
    "cBioPortal Studies",
    "NCI Genomic Data Commons (GDC)",
    "UniProt Knowledgebase",
    "ChEMBL Bioactivity Database",
    "MetaboLights",
    "Expression Atlas",
    "European Nucleotide Archive (ENA)",
    "NCBI Sequence Read Archive (SRA)",
    "WHO ICTRP Trial Search",
    "EU Clinical Trials Register",
    "dbGaP (controlled-access genomics)",
)


def _hits(spark, d, every=True):
    """Hits of all sources; without every those of _SOURCES only, which source_status reports on."""
    parts = [
        S.table(spark, d, t).select(F.lit(kind).alias("kind"), F.lit(t).alias("tag"), F.col(key).cast("long").alias("pos"), F.col(title).alias("title"), F.floor(F.col(number).cast("double")).cast("long").alias("cited"), (F.col(key) % 30 + 1995).cast("int").alias("year"))
        for kind, t, key, title, number in _SOURCES
    ]
    if every:
        o = S.table(spark, d, "orders")
        parts.append(o.select(F.lit("paper").alias("kind"), F.lit("orders").alias("tag"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.floor("o_totalprice").cast("long").alias("cited"), F.year("o_orderdate").alias("year")))
        parts.append(spark.createDataFrame([("data", "curated", i, t, None, None) for i, t in enumerate(_CURATED, 1)], "kind string, tag string, pos long, title string, cited long, year int"))
    return M.first_wins(M.union_all(parts), ["title"], F.asc("source_rank"), F.asc("pos"))


_SOURCE_HITS = " UNION ALL ".join(f"SELECT '{kind}' AS kind, '{t}' AS tag, CAST({key} AS BIGINT) AS pos, {title} AS title, CAST(floor({number}) AS BIGINT) AS cited, CAST({key} % 30 + 1995 AS INTEGER) AS year, {i} AS source_rank FROM {t}" for i, (kind, t, key, title, number) in enumerate(_SOURCES))
_OTHER_HITS = (
    f"SELECT 'paper', 'orders', o_orderkey, 'Order ' || o_orderkey, CAST(floor(o_totalprice) AS BIGINT), CAST(year(o_orderdate) AS INTEGER), {len(_SOURCES)} FROM orders UNION ALL "
    f"SELECT 'data', 'curated', CAST(i AS BIGINT), t, NULL, NULL, {len(_SOURCES) + 1} FROM (VALUES "
    + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_CURATED, 1))
    + ") c(i, t)"
)
_FIRST_HITS = "h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY source_rank, pos) AS n FROM u) WHERE n = 1)"
_HITS = f"u AS ({_SOURCE_HITS} UNION ALL {_OTHER_HITS}), {_FIRST_HITS}"


def datasets_union_facets(spark, d):
    """Facet counts by kind after the year filter; rows without year pass."""
    return _hits(spark, d).where("year is null or year = 0 or year >= 2005").groupBy("kind").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("cited") > 0).alias("cited_hits"))


def datasets_since_type_sort(spark, d):
    """All data hits with their rank by citations; no task sorts all hits."""
    found = _hits(spark, d).where("(year is null or year = 0 or year >= 2005) and kind = 'data'").withColumn("n", F.coalesce("cited", F.lit(0)))
    with Stage(spark) as stage:
        return stage.keep(places(found, [], [F.desc("n"), F.asc("source_rank"), F.asc("pos")], stage, "rank").select("tag", "pos", "title", "cited", "year", "rank"))


def source_status(spark, d):
    """Each source's hits, and whether it gave any."""
    counts = _hits(spark, d, every=False).groupBy("tag").agg(F.count(F.lit(1)).alias("hits"))
    names = spark.createDataFrame([(i, s[1]) for i, s in enumerate(_SOURCES)] + [(len(_SOURCES), "registry")], "source_rank int, tag string")
    return names.join(counts, "tag", "left").select("source_rank", "tag", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce(F.col("hits") > 0, F.lit(False)).alias("used"))


def _user_events(spark, d):
    e = S.table(spark, d, "events")
    return e.select("user_id", "event_id", "ts", "event_type", "value", F.from_json("props", "k int")["k"].alias("k")).withColumn("shelf", (F.col("k") % 4).cast("int"))


def coalesce_merge(spark, d):
    rows = _user_events(spark, d)
    pos = F.struct("ts", "event_id")
    out = M.coalescing_merge(rows.withColumn("kind", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))), ["user_id", "shelf"], pos, {"kind": "string", "k": "number"}, ["value"], ["event_type"])
    return out.select("user_id", "shelf", "kind", "k", "value", F.col("event_type").alias("kinds"))


def overlay_merge(spark, d):
    rows = _user_events(spark, d).withColumn("kind", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")))
    return M.overlay_merge(rows, ["user_id", "shelf"], F.struct("ts", "event_id"), {"kind": "string"}, {"k": "number"}, ["value"])


_EVENTS = "e AS (SELECT user_id, event_id, ts, event_type, value, CAST(props->>'$.k' AS INTEGER) AS k, CAST(CAST(props->>'$.k' AS INTEGER) % 4 AS INTEGER) AS shelf, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS kind FROM events)"


def supplement_when_thin(spark, d):
    """Suppliers of a nation, and where there are less than 4 customers too, 10 at most; of each list no
    more places are counted than can be among them."""
    s = S.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("pos")).where("pos <= 10")
    c = S.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("pos")).where("pos <= 20")
    return M.supplement(s, c, "nation", "id", 4, 10).select("nation", "id", "source_rank", "place")


def semi_anti_lookup(spark, d):
    """Customers by segment: with and without orders."""
    c, o = S.table(spark, d, "customer"), S.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    have = c.join(o, "c_custkey", "left_semi").select("c_mktsegment", F.lit("with").alias("orders"))
    lack = c.join(o, "c_custkey", "left_anti").select("c_mktsegment", F.lit("without").alias("orders"))
    return have.unionByName(lack).groupBy("c_mktsegment", "orders").agg(F.count(F.lit(1)).alias("customers"))


def _neighbours(spark, d):
    """Parts as works: cited by price; an order's earlier line cites its later ones; works of one brand
    and size are related."""
    works = S.table(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_brand", "p_size", (F.floor(F.col("p_retailprice") * 100)).cast("long").alias("cited"))
    l = S.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = L.parts_of(l, l.count(), L.SORTED_EACH)
    l = l.repartition(parts, "l_orderkey")
    later = l.select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("line"))
    edges = l.join(later, "l_orderkey").where(F.col("l_linenumber") < F.col("line")).select(F.col("l_partkey").alias("src"), "dst")
    # A group's best eleven hold the best ten others of each member.
    groups = works.withColumn("place", F.row_number().over(Window.partitionBy("p_brand", "p_size").orderBy(F.desc("cited"), F.asc("node")))).where("place <= 11")
    seeds = works.select(F.col("node").alias("seed"), "p_brand", "p_size")
    related = seeds.join(groups.select("node", "p_brand", "p_size"), ["p_brand", "p_size"]).where("seed <> node").select("seed", "node")
    return G.neighbourhood(seeds, related, edges, works.select("node", "cited"), parts=parts)


_GRAPH = """
w AS (SELECT p_partkey AS node, p_brand, p_size, CAST(floor(p_retailprice * 100) AS BIGINT) AS cited FROM part),
e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber),
c AS (SELECT a.node AS seed, b.node, 'related' AS relation, 0 AS s FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.node <> b.node
      UNION ALL SELECT src, dst, 'reference', 1 FROM e UNION ALL SELECT dst, src, 'cited-by', 2 FROM e),
r AS (SELECT c.*, w.cited, row_number() OVER (PARTITION BY seed, s ORDER BY w.cited DESC, c.node) AS rank FROM c JOIN w ON w.node = c.node),
f AS (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY s, rank) AS n FROM r WHERE rank <= CASE WHEN s = 0 THEN 10 ELSE 8 END AND seed <> node),
g AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY s, rank) AS pos FROM f WHERE n = 1),
nb AS (SELECT seed, node, relation, CAST(pos AS INTEGER) AS pos, cited FROM g WHERE pos <= 20)"""


def graph_layout(spark, d):
    out = G.layout(_neighbours(spark, d))
    return out.select("seed", "node", "i", *[T.rounded(F.col(c)).alias(c) for c in ("x", "y", "radius")])


def edge_coordinates(spark, d):
    """Edges with both ends' coordinates: the seed's is fixed, the other's from the layout."""
    nodes = G.layout(_neighbours(spark, d))
    # An edge's other end is the node of its own row, so no point is looked up.
    ends = [F.struct(F.col("seed").alias("n"), F.lit(500.0).alias("x"), F.lit(270.0).alias("y")), F.struct(F.col("node").alias("n"), "x", "y")]
    citing = F.col("relation") == "cited-by"
    rows = nodes.select("seed", F.when(citing, ends[1]).otherwise(ends[0]).alias("a"), F.when(citing, ends[0]).otherwise(ends[1]).alias("b"))
    return rows.select("seed", F.col("a.n").alias("src"), F.col("b.n").alias("dst"), *[T.rounded(F.col(f"{e}.{c}")).alias(f"{c}_{name}") for e, name in (("a", "src"), ("b", "dst")) for c in "xy"])


_LAYOUT = """
li AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY cited DESC, node) - 1 AS i, count(*) OVER (PARTITION BY seed) AS n FROM nb),
lo AS (SELECT *, 500 + (155 + 30 * (i % 4)) * cos(i * 2 * pi() / n - pi() / 2) AS x, 270 + 0.82 * (155 + 30 * (i % 4)) * sin(i * 2 * pi() / n - pi() / 2) AS y, greatest(9.0, least(30.0, 9 + 0.55 * sqrt(CASE WHEN cited = 0 THEN 1 ELSE cited END))) AS radius FROM li)"""


def _yearly(spark, d):
    o = S.table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    return o.join(c, "o_custkey").groupBy("nation", "year").agg(F.count(F.lit(1)).alias("works"))


def _series(spark, d):
    """20 years up to the last one in the table for every nation, with 0 where there is nothing."""
    counts = _yearly(spark, d)
    last = S.table(spark, d, "orders").agg(F.max(F.year("o_orderdate"))).first()[0]
    grid = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.explode(F.sequence(F.lit(last - 19), F.lit(last))).alias("year"))
    return grid.join(counts, ["nation", "year"], "left").select("nation", "year", F.coalesce("works", F.lit(0)).alias("works"))


def year_bars(spark, d):
    s = _series(spark, d)
    most = F.greatest(F.max("works").over(Window.partitionBy("nation")), F.lit(1))
    height = F.when(F.col("works") > 0, F.greatest(F.lit(6), F.floor(F.col("works") / most * 112 + 0.5).cast("int"))).otherwise(2)
    bucket = F.when(F.col("year") >= 2022, "2022").when(F.col("year") >= 2018, "2018").when(F.col("year") >= 2012, "2012").otherwise("older")
    return s.select("nation", "year", height.alias("height"), bucket.alias("bucket"))


_SERIES = """
y AS (SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS works FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
l AS (SELECT CAST(max(year(o_orderdate)) AS INTEGER) AS last FROM orders),
s AS (SELECT nation, year, coalesce(works, 0) AS works FROM (SELECT n_nationkey AS nation, CAST(unnest(range(last - 19, last + 1)) AS INTEGER) AS year FROM nation, l) LEFT JOIN y USING (nation, year))"""


def similar_excluding_self(spark, d):
    """The five suppliers of the same nation with most balance, other than the supplier."""
    s = S.table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    best = top(s, "s_nationkey", 6, F.desc("s_acctbal"), F.asc("s_suppkey")).select("s_nationkey", F.col("s_suppkey").alias("other"), F.col("rank").alias("r"))
    pairs = s.join(best, "s_nationkey").where("s_suppkey <> other")
    return top(pairs, "s_suppkey", 5, F.asc("r")).select("s_suppkey", "other", "rank")


def latest_samples_fallback(spark, d):
    """A customer's six latest orders since mid-2001, or of all time where there's none."""
    o = S.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    order = (F.desc("day"), F.asc("o_orderkey"))
    late = top(o.where("day >= date '2001-06-01'"), "o_custkey", 6, *order)
    return M.fallback(late, top(o, "o_custkey", 6, *order), "o_custkey")


def bm25_search(spark, d):
    return bm25(S.table(spark, d, "benchmark"), S.table(spark, d, "documents"), "item_id", "doc_id", "text", "text")


def trial_bridge(spark, d):
    """Parts that a user's events name, in order of first mention; for users without one in the
    catalogue the three dearest of the size that belongs to them."""
    e = _user_events(spark, d)
    named = e.groupBy("user_id", "k").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    p = S.table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    found = named.join(p, named["k"] == p["p_partkey"]).withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("at"))).select("user_id", "p_partkey", "pos", F.lit("named").alias("how"))
    users = e.select("user_id", (F.col("user_id") % 50 + 1).alias("p_size")).distinct()
    dear = top(p, "p_size", 3, F.desc("p_retailprice"), F.asc("p_partkey"))
    other = users.join(dear, "p_size").select("user_id", "p_partkey", F.col("rank").alias("pos"), F.lit("searched").alias("how"))
    return M.fallback(found.where("pos <= 5"), other, "user_id")


QUERIES = {
    "papers_interleave_dedupe": papers_interleave_dedupe,
    "papers_sort": papers_sort,
    "papers_enrich": papers_enrich,
    "journal_metrics_broadcast": journal_metrics,
    "datasets_union_facets": datasets_union_facets,
    "datasets_since_type_sort": datasets_since_type_sort,
    "source_status": source_status,
    "coalesce_merge": coalesce_merge,
    "overlay_merge": overlay_merge,
    "supplement_when_thin": supplement_when_thin,
    "semi_anti_lookup": semi_anti_lookup,
    "graph_one_hop": _neighbours,
    "graph_stats": lambda spark, d: G.stats(_neighbours(spark, d)),
    "graph_layout": graph_layout,
    "edge_coordinates": edge_coordinates,
    "year_series_zero_fill": _series,
    "year_bars": year_bars,
    "similar_excluding_self": similar_excluding_self,
    "latest_samples_fallback": latest_samples_fallback,
    "bm25_search": bm25_search,
    "trial_bridge": trial_bridge,
}

ORACLES = {
    "papers_interleave_dedupe": f"WITH {_PAGES} SELECT o_custkey, o_orderkey, CAST(place AS INTEGER) AS place, source_rank, CAST(year(day) AS INTEGER) AS year FROM i WHERE place <= 12",
    "papers_sort": f"WITH {_PAGES}, p AS (SELECT i.*, CASE WHEN source_rank = 0 THEN floor(o_totalprice) ELSE 0 END AS cited FROM i JOIN orders USING (o_orderkey) WHERE place <= 12) SELECT o_custkey, o_orderkey, CAST(place AS INTEGER) AS place, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY cited DESC, place) AS INTEGER) AS by_cited, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY year(day) DESC, place) AS INTEGER) AS by_year FROM p",
    "papers_enrich": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5 AS near FROM orders),
r AS (SELECT o_orderkey, CASE WHEN near AND o_orderstatus = 'P' THEN coalesce(c_mktsegment, o_orderstatus) ELSE o_orderstatus END AS status, CASE WHEN near THEN greatest(o_totalprice, c_acctbal) ELSE o_totalprice END AS worth,
    CASE WHEN near THEN n_name END AS venue, near AND coalesce(c_acctbal, 0) > 0 AS is_open FROM o LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey)
SELECT * FROM r WHERE is_open OR status <> 'P'""",
    "journal_metrics_broadcast": f"WITH f AS (SELECT l_suppkey, count(*) AS works, CAST(round(sum(l_quantity)) AS BIGINT) AS cited, CAST(max(year(l_shipdate)) AS INTEGER) AS last_year FROM lineitem GROUP BY ALL) SELECT s_suppkey, s_name, works, cited, last_year, {D.rounded('cited / works')} AS mean_cited FROM supplier LEFT JOIN f ON l_suppkey = s_suppkey",
    "datasets_union_facets": f"WITH {_HITS} SELECT kind, count(*) AS hits, count(*) FILTER (WHERE cited > 0) AS cited_hits FROM h WHERE year IS NULL OR year = 0 OR year >= 2005 GROUP BY kind",
    "datasets_since_type_sort": f"WITH {_HITS} SELECT tag, pos, title, cited, year, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY coalesce(cited, 0) DESC, source_rank, pos) AS rank FROM h WHERE (year IS NULL OR year = 0 OR year >= 2005) AND kind = 'data')",
    "source_status": f"WITH u AS ({_SOURCE_HITS}), {_FIRST_HITS}, c AS (SELECT tag, count(*) AS hits FROM h GROUP BY tag), n(source_rank, tag) AS (VALUES {', '.join(str((i, s[1])) for i, s in enumerate(_SOURCES))}, ({len(_SOURCES)}, 'registry')) SELECT source_rank, tag, coalesce(hits, 0) AS hits, coalesce(hits > 0, false) AS used FROM n LEFT JOIN c USING (tag)",
    "coalesce_merge": f"WITH {_EVENTS} SELECT user_id, shelf, arg_min(kind, (ts, event_id)) FILTER (WHERE kind <> '') AS kind, arg_min(k, (ts, event_id)) FILTER (WHERE k <> 0) AS k, max(value) AS value, array_to_string(list_filter(list(event_type ORDER BY ts, event_id), lambda x, i: list_position(list(event_type ORDER BY ts, event_id), x) = i), ',') AS kinds FROM e GROUP BY user_id, shelf",
    "overlay_merge": f"WITH {_EVENTS} SELECT user_id, shelf, arg_max(kind, (ts, event_id)) FILTER (WHERE kind <> '') AS kind, arg_min(k, (ts, event_id)) FILTER (WHERE k <> 0) AS k, max(value) AS value FROM e GROUP BY user_id, shelf",
    "supplement_when_thin": """WITH s AS (SELECT s_nationkey AS nation, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS pos FROM supplier),
c AS (SELECT c_nationkey AS nation, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos FROM customer),
u AS (SELECT *, 0 AS source_rank FROM s UNION ALL SELECT *, 1 FROM c WHERE (SELECT count(*) FROM s WHERE s.nation = c.nation) < 4 AND NOT EXISTS (FROM s WHERE s.nation = c.nation AND s.id = c.id))
SELECT nation, id, source_rank, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY source_rank, pos) AS place FROM u) WHERE place <= 10""",
    "semi_anti_lookup": "SELECT c_mktsegment, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'with' ELSE 'without' END AS orders, count(*) AS customers FROM customer GROUP BY ALL",
    "graph_one_hop": f"WITH {_GRAPH} SELECT * FROM nb",
    "graph_stats": f"WITH {_GRAPH} SELECT seed, count(*) + 1 AS nodes, count(*) AS edges, count(*) FILTER (WHERE relation = 'related') AS n_related, count(*) FILTER (WHERE relation = 'reference') AS n_reference, count(*) FILTER (WHERE relation = 'cited-by') AS n_cited_by, CASE WHEN count(*) >= 4 THEN 'rich' ELSE 'sparse' END AS mode FROM nb GROUP BY seed",
    "graph_layout": f"WITH {_GRAPH}, {_LAYOUT} SELECT seed, node, CAST(i AS INTEGER) AS i, {D.rounded('x')} AS x, {D.rounded('y')} AS y, {D.rounded('radius')} AS radius FROM lo",
    "edge_coordinates": f"WITH {_GRAPH}, {_LAYOUT} SELECT seed, CASE WHEN relation = 'cited-by' THEN node ELSE seed END AS src, CASE WHEN relation = 'cited-by' THEN seed ELSE node END AS dst, CASE WHEN relation = 'cited-by' THEN {D.rounded('x')} ELSE 500.0 END AS x_src, CASE WHEN relation = 'cited-by' THEN {D.rounded('y')} ELSE 270.0 END AS y_src, CASE WHEN relation = 'cited-by' THEN 500.0 ELSE {D.rounded('x')} END AS x_dst, CASE WHEN relation = 'cited-by' THEN 270.0 ELSE {D.rounded('y')} END AS y_dst FROM lo",
    "year_series_zero_fill": f"WITH {_SERIES} SELECT * FROM s",
    "year_bars": f"WITH {_SERIES} SELECT nation, year, CASE WHEN works > 0 THEN greatest(6, CAST(floor(works / greatest(max(works) OVER (PARTITION BY nation), 1) * 112 + 0.5) AS INTEGER)) ELSE 2 END AS height, CASE WHEN year >= 2022 THEN '2022' WHEN year >= 2018 THEN '2018' WHEN year >= 2012 THEN '2012' ELSE 'older' END AS bucket FROM s",
    "similar_excluding_self": "SELECT s_suppkey, other, CAST(rank AS INTEGER) AS rank FROM (SELECT a.s_suppkey, b.s_suppkey AS other, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY b.s_acctbal DESC, b.s_suppkey) AS rank FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey) WHERE rank <= 5",
    "latest_samples_fallback": """WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders),
a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey) AS rank FROM o WHERE day >= DATE '2001-06-01'), b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey) AS rank FROM o)
SELECT o_custkey, o_orderkey, day, CAST(rank AS INTEGER) AS rank FROM a WHERE rank <= 6 UNION ALL SELECT o_custkey, o_orderkey, day, CAST(rank AS INTEGER) FROM b WHERE rank <= 6 AND o_custkey NOT IN (SELECT o_custkey FROM a)""",
    "bm25_search": f"""WITH d AS (SELECT doc_id, {D.tokens('text')} AS bag FROM documents), n AS (SELECT count(*) AS n, avg(len(bag)) AS mean FROM d),
t AS (SELECT doc_id, len(bag) AS size, unnest(bag) AS token FROM d), i AS (SELECT doc_id, size, token, count(*) AS times FROM t GROUP BY ALL), f AS (SELECT token, count(*) AS df FROM i GROUP BY token),
q AS (SELECT DISTINCT item_id, unnest({D.tokens('text')}) AS token FROM benchmark),
s AS (SELECT item_id, doc_id, {D.rounded("sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * size / mean)))")} AS score FROM q JOIN i USING (token) JOIN f USING (token), n GROUP BY item_id, doc_id)
SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "trial_bridge": f"""WITH {_EVENTS}, m AS (SELECT user_id, k, min((ts, event_id)) AS seen FROM e GROUP BY ALL),
f AS (SELECT user_id, p_partkey, row_number() OVER (PARTITION BY user_id ORDER BY seen) AS pos FROM m JOIN part ON p_partkey = k),
g AS (SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part), u AS (SELECT DISTINCT user_id, user_id % 50 + 1 AS p_size FROM e)
SELECT user_id, p_partkey, CAST(pos AS INTEGER) AS pos, 'named' AS how FROM f WHERE pos <= 5 UNION ALL SELECT user_id, p_partkey, CAST(rank AS INTEGER), 'searched' FROM u JOIN g USING (p_size) WHERE rank <= 3 AND user_id NOT IN (SELECT user_id FROM f)""",
}
