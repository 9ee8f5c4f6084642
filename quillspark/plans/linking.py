"""Queries: open-access links, enrichment by precedence, neighbours that can't be loaded, journal profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import branches as B
from quillspark.operators import enrich as E
from quillspark.operators import graph as G
from quillspark.operators.linkage import top
from quillspark.plans import duck as D
from quillspark.sources import tables as S
from quillspark.sources.nested import parse
from quillspark.sources.staging import Stage

_OPEN = "is_oa boolean, best_oa_location struct<url_for_pdf: string, url: string, host_type: string>, oa_locations array<struct<url_for_pdf: string, url: string, host_type: string>>"


def _responses(spark, d):
    """(doi, body): what an open-access registry says of each order, as JSON. Lines are its locations; bodies
    of orders with status P end in the middle."""
    l = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    pdf = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("https://r.example.org/"), F.col("l_partkey").cast("string"), F.lit(".pdf"))).otherwise("")
    url = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("https://h.example.org/"), F.col("l_suppkey").cast("string")))
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", pdf.alias("url_for_pdf"), url.alias("url"), F.col("l_returnflag").alias("host_type"))
    lines = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(place)).alias("x"))
    o = S.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    rows = o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").withColumn("x", F.coalesce("x", F.array().cast(lines.schema["x"].dataType)))
    link = lambda l: F.struct(l["url_for_pdf"].alias("url_for_pdf"), l["url"].alias("url"), l["host_type"].alias("host_type"))
    best = F.get(F.filter("x", lambda l: l["l_linenumber"] == F.col("o_orderkey") % 4 + 1), F.lit(0))
    body = F.to_json(F.struct((F.col("o_orderstatus") == "O").alias("is_oa"), F.when(best.isNotNull(), link(best)).alias("best_oa_location"), F.transform("x", link).alias("oa_locations")))
    cut = F.when(F.col("o_orderstatus") == "P", body.substr(F.lit(1), (F.length(body) / 2).cast("int"))).otherwise(body)
    return rows.select("o_orderkey", F.concat(F.lit("10.5555/o."), F.col("o_orderkey").cast("string")).alias("doi"), cut.alias("body"))


def open_access_lookup(spark, d):
    """Links of every order; an answer that can't be read is failed, and the others stay."""
    rows = parse(_responses(spark, d), "body", _OPEN)
    rows = rows.withColumn("links", E.open_links(F.col("record.best_oa_location"), F.col("record.oa_locations"), F.col("record.is_oa")))
    fields = [F.when(F.col("readable"), F.col(f"links.{c}")).alias(c) for c in ("is_open", "pdf", "landing", "host")]
    return rows.select("doi", F.when(F.col("readable"), "found").otherwise("failed").alias("status"), *fields)


_OPEN_SQL = """
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS i, CASE WHEN l_returnflag = 'R' THEN 'https://r.example.org/' || l_partkey || '.pdf' END AS pdf, CASE WHEN l_linestatus = 'F' THEN 'https://h.example.org/' || l_suppkey END AS url, l_returnflag AS host FROM lineitem),
b AS (SELECT k, nullif(arg_min(coalesce(pdf, ''), i), '') AS pdf, nullif(arg_min(coalesce(url, ''), i), '') AS url, arg_min(host, i) AS host FROM l WHERE n = k % 4 + 1 GROUP BY k),
f AS (SELECT k, arg_min(pdf, i) FILTER (WHERE pdf IS NOT NULL) AS pdf, arg_min(coalesce(url, ''), i) AS url FROM l GROUP BY k),
r AS (SELECT o_orderkey, o_orderstatus, coalesce(b.pdf, f.pdf) AS pdf, coalesce(b.url, nullif(f.url, '')) AS landing, b.host FROM orders LEFT JOIN b ON b.k = o_orderkey LEFT JOIN f ON f.k = o_orderkey)
SELECT '10.5555/o.' || o_orderkey AS doi, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'found' END AS status, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'O' OR pdf IS NOT NULL OR landing IS NOT NULL END AS is_open,
    CASE WHEN o_orderstatus <> 'P' THEN pdf END AS pdf, CASE WHEN o_orderstatus <> 'P' THEN landing END AS landing, CASE WHEN o_orderstatus <> 'P' THEN host END AS host FROM r"""


def papers_enrich_sources(spark, d):
    """Parts as papers, completed from what lines, suppliers and the parts themselves say of them."""
    part = S.table(spark, d, "part").select("p_partkey", "p_size", "p_name", "p_type", "p_retailprice")
    key, text = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    doi, pmid = F.concat(F.lit("10.7000/P."), text("p_partkey")), 20_000_000 + key
    papers = part.select(key.alias("id"), F.when(F.col("p_size") > 12, doi).alias("doi"), F.when(F.col("p_size") % 3 > 0, pmid).alias("pmid"), (F.col("p_size") % 5 == 0).alias("need_abstract"))
    l = S.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_returnflag")
    of = lambda a, b: (F.concat(F.lit(a), text("l_partkey")).alias("doi"), (F.lit(b) + F.col("l_partkey")).alias("pmid"))
    s = F.col("source_key")
    index = l.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("cited"), F.max("l_discount").alias("off"), F.min("l_suppkey").alias("source_key"), F.sum("l_linenumber").alias("lines"))
    index = index.select(
        *of("10.7000/p.", 20_000_000), "cited", F.when(F.col("off") >= 0.095, F.concat(F.lit("https://oa.example.org/"), text("l_partkey"))).alias("oa_url"), F.when(F.col("lines") % 2 == 0, F.concat(F.lit("Abstract "), text("lines"))).alias("abstract"),
        F.when(F.col("lines") % 3 > 0, F.concat(F.lit("Work "), text("l_partkey"))).otherwise("").alias("title"), "source_key", F.when(s % 2 == 0, s / 8).alias("mean_cited"), F.when(s % 3 > 0, s).alias("h_index"), F.when(s % 5 > 0, F.concat(F.lit("1234-"), text("source_key"))).alias("issn"), F.concat(F.lit("P"), text("source_key")).alias("publisher"),
    )
    links = l.where("l_returnflag = 'A'").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_suppkey").alias("s"))
    links = links.select(of("10.7000/p.", 0)[0], F.lit(None).cast("long").alias("pmid"), F.when(F.col("n") >= 8, F.concat(F.lit("https://b.example.org/"), text("l_partkey"), F.lit(".pdf"))).alias("pdf"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("https://b.example.org/"), text("s"))).alias("landing"))
    library = part.where("p_partkey % 6 > 0").select(
        F.when(F.col("p_size") % 2 == 0, doi).alias("doi"), pmid.alias("pmid"), F.when(F.col("p_type").endswith("STEEL"), F.concat(F.lit("https://c.example.org/"), text("p_partkey"), F.lit(".pdf"))).alias("pdf"),
        F.when(F.col("p_retailprice") > 1200, F.concat(F.lit("https://c.example.org/"), text("p_partkey"))).alias("html"), F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("C "), F.col("p_name"))).alias("abstract"), F.col("p_name").alias("title"),
    )
    metrics = S.table(spark, d, "supplier").where("s_nationkey > 1").select(F.col("s_suppkey").alias("source_key"), F.when(F.col("s_acctbal") > 0, F.floor("s_acctbal") / 4).alias("mean_cited"), F.floor(F.col("s_acctbal") / 100).alias("h_index"), F.when(F.col("s_nationkey") % 4 > 0, F.concat(F.lit("S-"), text("s_suppkey"))).alias("issn"), F.col("s_name").alias("publisher"))
    return E.enrich(papers, index, links, library, metrics)


_ENRICH_SQL = """
WITH p AS (SELECT p_partkey AS id, p_size, p_name, p_type, p_retailprice, p_size > 12 AS d, p_size % 3 > 0 AS m FROM part),
a AS (SELECT l_partkey AS id, count(*) AS cited, max(l_discount) AS off, min(l_suppkey) AS s, sum(l_linenumber) AS lines FROM lineitem GROUP BY ALL),
b AS (SELECT l_partkey AS id, CASE WHEN count(*) >= 8 THEN 'https://b.example.org/' || l_partkey || '.pdf' END AS pdf, CASE WHEN count(*) % 2 = 0 THEN 'https://b.example.org/' || max(l_suppkey) END AS landing FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey),
c AS (SELECT p_partkey AS id, p_size % 2 = 0 AS d, CASE WHEN p_type LIKE '%STEEL' THEN 'https://c.example.org/' || p_partkey || '.pdf' END AS pdf, CASE WHEN p_retailprice > 1200 THEN 'https://c.example.org/' || p_partkey END AS html, CASE WHEN p_size % 4 = 0 THEN 'C ' || p_name END AS abstract, p_name AS title FROM part WHERE p_partkey % 6 > 0),
j AS (SELECT p.id, p_size, a.id IS NOT NULL AND (p.d OR m) AS ha, b.id IS NOT NULL AND p.d AS hb, c.id IS NOT NULL AND ((p.d AND c.d) OR m) AS hc, a.* EXCLUDE id, b.pdf AS bp, b.landing AS bl, c.pdf AS cp, c.html, c.abstract AS ca, c.title AS ct FROM p LEFT JOIN a USING (id) LEFT JOIN b USING (id) LEFT JOIN c USING (id)),
k AS (SELECT j.*, CASE WHEN ha AND s % 2 = 0 THEN s / 8 END AS m1, CASE WHEN ha AND s % 3 > 0 THEN s END AS m2, CASE WHEN ha AND s % 5 > 0 THEN '1234-' || s END AS m3, CASE WHEN ha THEN 'P' || s END AS m4 FROM j),
f AS (SELECT k.*, s_suppkey IS NOT NULL AS again, s_acctbal, s_nationkey, s_suppkey, s_name FROM k LEFT JOIN supplier ON ha AND (m1 IS NULL OR m2 IS NULL OR m3 IS NULL) AND s_suppkey = s AND s_nationkey > 1),
x AS (SELECT *, CASE WHEN hc THEN 'https://europepmc.org/article/MED/' || (20000000 + id) END AS page, CASE WHEN ha AND lines % 2 = 0 THEN 'Abstract ' || CAST(lines AS BIGINT) END AS aa FROM f)
SELECT id, CASE WHEN ha THEN cited END AS cited, CASE WHEN again THEN CASE WHEN s_acctbal > 0 THEN floor(s_acctbal) / 4 END ELSE m1 END AS mean_cited, CAST(CASE WHEN again THEN floor(s_acctbal / 100) ELSE m2 END AS BIGINT) AS h_index, CASE WHEN again THEN CASE WHEN s_nationkey % 4 > 0 THEN 'S-' || s_suppkey END ELSE m3 END AS issn, CASE WHEN again THEN s_name ELSE m4 END AS publisher,
    coalesce(CASE WHEN hb THEN bp END, CASE WHEN hc THEN cp END) AS pdf, coalesce(CASE WHEN ha AND off >= 0.095 THEN 'https://oa.example.org/' || id END, CASE WHEN hb THEN bl END, CASE WHEN hc THEN html END, page) AS landing, page AS library_page,
    CASE WHEN p_size % 5 = 0 AND hc AND ca IS NOT NULL THEN ca ELSE coalesce(aa, CASE WHEN hc THEN ca END) END AS abstract, coalesce(CASE WHEN ha AND lines % 3 > 0 THEN 'Work ' || id END, CASE WHEN hc THEN ct END) AS title, again AS asked_again FROM x"""


def graph_failed(spark, d):
    """Neighbourhoods of parts in which those of the largest sizes can't be loaded: works of one brand and size are
    related, an order's earlier line refers to its later ones; what cites a part comes by citations."""
    part = S.table(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_brand", "p_size", F.floor(F.col("p_retailprice") * 100).cast("long").alias("cited"))
    l = S.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    later = l.select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("line"))
    edges = l.join(later, "l_orderkey").where(F.col("l_linenumber") < F.col("line")).select(F.col("l_partkey").alias("src"), "dst").distinct()
    groups = part.withColumn("n", F.row_number().over(Window.partitionBy("p_brand", "p_size").orderBy("node"))).where("n <= 11")
    seeds = part.select(F.col("node").alias("seed"), "p_brand", "p_size")
    related = seeds.join(groups.select("node", "p_brand", "p_size"), ["p_brand", "p_size"]).where("seed <> node").select("seed", "node")
    ranked = lambda rows, most, *order: top(rows, "seed", most, *order).withColumnRenamed("rank", "place")
    cites = edges.select(F.col("dst").alias("seed"), F.col("src").alias("node")).join(part.select("node", "cited"), "node")
    lists = [
        ("related", ranked(related, 10, F.asc("node")), 10),
        ("reference", ranked(edges.select(F.col("src").alias("seed"), F.col("dst").alias("node")), 8, F.asc("node")), 8),
        ("cited-by", ranked(cites, 8, F.desc("cited"), F.asc("node")), 8),
    ]
    return G.loaded_stats(seeds, G.planned(seeds, lists, part.where("p_size < 44").select("node", "cited")))


_FAILED_SQL = """
WITH w AS (SELECT p_partkey AS node, p_brand, p_size, CAST(floor(p_retailprice * 100) AS BIGINT) AS cited FROM part),
e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber),
c AS (SELECT a.node AS seed, b.node, 'related' AS relation, 0 AS s, row_number() OVER (PARTITION BY a.node ORDER BY b.node) AS place FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.node <> b.node
      UNION ALL SELECT src, dst, 'reference', 1, row_number() OVER (PARTITION BY src ORDER BY dst) FROM e
      UNION ALL SELECT dst, src, 'cited-by', 2, row_number() OVER (PARTITION BY dst ORDER BY cited DESC, src) FROM e JOIN w ON node = src),
f AS (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY s, place) AS n FROM c WHERE place <= CASE WHEN s = 0 THEN 10 ELSE 8 END AND seed <> node),
g AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY s, place) AS pos FROM f WHERE n = 1),
k AS (SELECT seed, relation, w.node IS NOT NULL AS loaded FROM g LEFT JOIN (SELECT node FROM w WHERE p_size < 44) w USING (node) WHERE pos <= 20),
t AS (SELECT node AS seed, count(*) FILTER (WHERE loaded) AS edges, count(loaded) AS planned, count(*) FILTER (WHERE loaded AND relation = 'related') AS n_related, count(*) FILTER (WHERE loaded AND relation = 'reference') AS n_reference, count(*) FILTER (WHERE loaded AND relation = 'cited-by') AS n_cited_by FROM w LEFT JOIN k ON seed = node GROUP BY node)
SELECT seed, edges + 1 AS nodes, edges, n_related, n_reference, n_cited_by, planned - edges AS failed, CASE WHEN edges >= 4 THEN 'citation-neighborhood' ELSE 'sparse-neighborhood' END AS mode, CASE WHEN planned > edges THEN '有 ' || (planned - edges) || ' 个邻居节点未能加载（上游超时或限流）' END AS warning FROM t"""


def journal_profile(spark, d):
    """Suppliers as journals: the parts they deliver are their works, lines the citations, types the topics. The
    list has five topics and calls a journal open by either sign, the detail has eight and goes by one.

    Counts combine before they are shuffled, and topics are cut to eight a journal on both sides of the exchange."""
    l = S.table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    p = S.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.substring_index("p_type", " ", 1).alias("topic"), F.substring_index("p_type", " ", -1).alias("field"))
    works = l.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("cited"))
    each = Window.partitionBy("l_suppkey")
    placed = works.withColumn("place", F.row_number().over(each.orderBy(F.desc("cited"), F.asc("l_partkey"))))
    figures = placed.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("works_count"), F.sum("cited").alias("cited_by_count"), F.count_if(F.col("cited") >= F.col("place")).alias("h_index"), F.count_if(F.col("cited") >= 10).alias("i10_index"))
    counts = works.join(p, "l_partkey").groupBy("l_suppkey", F.concat_ws(" ", "topic", "field").alias("topic")).agg(F.sum("cited").alias("n"))
    best = top(counts, "l_suppkey", 8, F.desc("n"), F.asc("topic")).groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("rank", "topic"))).alias("t"))
    topics = F.coalesce(F.transform("t", lambda x: x["topic"]), F.array().cast("array<string>"))
    s = S.table(spark, d, "supplier")
    rows = s.join(figures, s["s_suppkey"] == figures["l_suppkey"], "left").drop("l_suppkey").join(best, s["s_suppkey"] == best["l_suppkey"], "left")
    is_oa, in_doaj = F.col("s_nationkey") % 2 == 0, F.col("s_acctbal") > 5000
    return rows.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.coalesce(F.nullif("s_name", F.lit("")), F.lit("Untitled journal")).alias("name"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("works_count", "cited_by_count")], "h_index", "i10_index",
        T.rounded(F.try_divide("cited_by_count", "works_count")).alias("mean_cited"), (is_oa | in_doaj).alias("open_in_list"), is_oa.alias("open_in_detail"), F.array_join(F.slice(topics, 1, 5), ",").alias("list_topics"), F.array_join(topics, ",").alias("detail_topics"),
    )


_PROFILE_SQL = f"""
WITH w AS (SELECT l_suppkey AS s, l_partkey AS p, count(*) AS cited FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY cited DESC, p) AS place FROM w),
f AS (SELECT s, count(*) AS works_count, CAST(sum(cited) AS BIGINT) AS cited_by_count, count(*) FILTER (WHERE cited >= place) AS h_index, count(*) FILTER (WHERE cited >= 10) AS i10_index FROM r GROUP BY s),
c AS (SELECT s, string_split(p_type, ' ')[1] || ' ' || string_split(p_type, ' ')[-1] AS topic, sum(cited) AS n FROM w JOIN part ON p_partkey = p GROUP BY ALL),
t AS (SELECT s, list(topic ORDER BY n DESC, topic) AS t FROM c GROUP BY s)
SELECT 'S' || s_suppkey AS id, coalesce(nullif(s_name, ''), 'Untitled journal') AS name, coalesce(works_count, 0) AS works_count, coalesce(cited_by_count, 0) AS cited_by_count, h_index, i10_index, {D.rounded("cited_by_count / works_count")} AS mean_cited,
    s_nationkey % 2 = 0 OR s_acctbal > 5000 AS open_in_list, s_nationkey % 2 = 0 AS open_in_detail, array_to_string(coalesce(t, [])[:5], ',') AS list_topics, array_to_string(coalesce(t, [])[:8], ',') AS detail_topics FROM supplier LEFT JOIN f ON f.s = s_suppkey LEFT JOIN t ON t.s = s_suppkey"""

def _branches(spark, d):
    """Each nation as a request, in five sources: suppliers in credit, or all of them where there is none;
    customers of one segment, or of another where there is none; builders; orders as papers; the region as a trial."""
    t = lambda name: S.table(spark, d, name)
    text = lambda c: F.col(c).cast("string")

    def hits(rows, request, prefix, key, kind, url, title, year, cited, doi=None):
        return rows.select(
            F.col(request).cast("int").alias("request"), F.concat(F.lit(prefix), text(key)).alias("id"), F.lit(kind).alias("kind"), (F.lit(None) if doi is None else doi).cast("string").alias("doi"), url.cast("string").alias("url"),
            F.col(title).alias("title"), year.cast("int").alias("year"), F.floor(cited).cast("long").alias("cited"), F.col(key).cast("long").alias("pos"),
        )

    def suppliers(condition):
        s = t("supplier").where(condition)
        return lambda: hits(s, "s_nationkey", "omics:", "s_suppkey", "data", F.concat(F.lit("https://S.example.org/"), text("s_suppkey")), "s_name", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") % 30 + 1995), F.col("s_acctbal"))

    def customers(prefix, condition):
        page = F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit("https://c.example.org/"), F.col("c_custkey").cast("string")))
        return lambda: hits(t("customer").where(condition), "c_nationkey", prefix, "c_custkey", "data", page, "c_name", F.col("c_custkey") % 30 + 1995, F.col("c_acctbal"))

    def orders():
        o = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
        doi = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("10.1/"), (F.col("o_orderkey") - F.col("o_orderkey") % 3).cast("string")))
        return hits(o, "c_nationkey", "W", "o_orderkey", "paper", F.lit(None), "o_orderpriority", F.year("o_orderdate"), F.col("o_totalprice"), doi)

    def regions():
        n = t("nation").join(t("region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
        return hits(n, "n_nationkey", "NCT", "n_regionkey", "trial", F.concat(F.lit("https://t.example.org/"), text("n_regionkey")), "r_name", F.lit(None), F.lit(None).cast("double"))

    return [
        B.Branch("data", lambda: suppliers("s_acctbal >= 8000")(), lambda: suppliers("true")()),
        B.Branch("data", customers("fda:", "c_mktsegment = 'MACHINERY' and c_acctbal > 9990"), customers("fda2:", "c_mktsegment = 'AUTOMOBILE'")),
        B.Branch("data", customers("doi:", "c_mktsegment = 'BUILDING' or c_acctbal > 9990")),
        B.Branch("paper", orders),
        B.Branch("trial", regions),
    ]


_BRANCH_SQL = (
    ("data", "SELECT s_nationkey AS request, 'omics:' || s_suppkey AS id, 'data' AS kind, NULL AS doi, 'https://S.example.org/' || s_suppkey AS url, s_name AS title, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 30 + 1995 END AS year, floor(s_acctbal) AS cited, s_suppkey AS pos FROM supplier s WHERE s_acctbal >= 8000 OR NOT EXISTS (FROM supplier z WHERE z.s_nationkey = s.s_nationkey AND z.s_acctbal >= 8000)"),
    ("data", "SELECT c_nationkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'fda:' ELSE 'fda2:' END || c_custkey, 'data', NULL, CASE WHEN c_custkey % 4 > 0 THEN 'https://c.example.org/' || c_custkey END, c_name, c_custkey % 30 + 1995, floor(c_acctbal), c_custkey FROM customer c WHERE (c_mktsegment = 'MACHINERY' AND c_acctbal > 9990) OR (c_mktsegment = 'AUTOMOBILE' AND NOT EXISTS (FROM customer z WHERE z.c_nationkey = c.c_nationkey AND z.c_mktsegment = 'MACHINERY' AND z.c_acctbal > 9990))"),
    ("data", "SELECT c_nationkey, 'doi:' || c_custkey, 'data', NULL, CASE WHEN c_custkey % 4 > 0 THEN 'https://c.example.org/' || c_custkey END, c_name, c_custkey % 30 + 1995, floor(c_acctbal), c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 9990"),
    ("paper", "SELECT c_nationkey, 'W' || o_orderkey, 'paper', CASE WHEN o_orderkey % 3 > 0 THEN '10.1/' || (o_orderkey - o_orderkey % 3) END, NULL, o_orderpriority, year(o_orderdate), floor(o_totalprice), o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey"),
    ("trial", "SELECT n_nationkey, 'NCT' || n_regionkey, 'trial', NULL, 'https://t.example.org/' || n_regionkey, r_name, NULL, NULL, n_regionkey FROM nation JOIN region ON r_regionkey = n_regionkey"),
)


def _search_cte(kind: str, since: int) -> str:
    wanted = [(i, sql) for i, (k, sql) in enumerate(x for x in _BRANCH_SQL if kind in B.WANTED[x[0]])]
    rows = " UNION ALL ".join(f"SELECT CAST(a AS INTEGER) AS request, b AS id, c AS kind, d AS doi, e AS url, f AS title, CAST(g AS INTEGER) AS year, CAST(h AS BIGINT) AS cited, CAST(i AS BIGINT) AS pos, {n} AS source_rank FROM ({sql}) t(a, b, c, d, e, f, g, h, i)" for n, sql in wanted)
    return f"""WITH u AS ({rows}),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request, coalesce('doi:' || lower(doi), 'url:' || lower(url), id) ORDER BY source_rank, pos, id) AS n FROM u) WHERE n = 1 AND (year IS NULL OR year = 0 OR year >= {since}))"""


def datasets_search(kind: str, since: int, order: str):
    def query(spark, d):
        """Every hit of each nation's request in its place."""
        with Stage(spark) as stage:
            hits, _ = B.search(_branches(spark, d), kind, since, order, stage)
            return stage.keep(hits.select("request", "place", "id", "kind", "title", "year", "cited"))

    return query


def _search_sql(kind: str, since: int, order: str) -> str:
    by = {"relevance": "", "citations": "coalesce(cited, 0) DESC, ", "date": "coalesce(year, 0) DESC, "}[order]
    return f"{_search_cte(kind, since)} SELECT request, CAST(row_number() OVER (PARTITION BY request ORDER BY {by}source_rank, pos, id) AS INTEGER) AS place, id, kind, title, year, cited FROM o" + ("" if kind == "all" else f" WHERE kind = '{kind}'")


def datasets_facets(spark, d):
    """Hits by kind of each nation's request, all types, since 1998."""
    with Stage(spark) as stage:
        return stage.keep(B.search(_branches(spark, d), "all", 1998, "relevance", stage)[1])


#: Fixed value: words that widen a query to medicine.
_BIAS = ("medicine", "clinical", "biomedical", "dataset")


def papers_field_filter(spark, d):
    """Parts as papers whose fields overlap with what each nation's request asks for, open ones only for some: the
    first page by price, and the total that either of two sources reports. The second source matches words,
    with words that widen the query."""
    n = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("request"), F.expr("array(element_at(array('ECONOMY', 'SMALL', 'MEDIUM', 'PROMO', 'STANDARD', 'LARGE'), n_nationkey % 6 + 1), concat('Brand#', cast(n_nationkey % 25 + 1 as string)))").alias("fields"), (F.col("n_nationkey") % 3 == 0).alias("only_open"), F.expr("element_at(array('small ring', 'red medicine', 'hot widget', 'blue'), n_nationkey % 4 + 1)").alias("q"))
    parts = S.table(spark, d, "part")
    works = parts.select(F.col("p_partkey").alias("work"), F.array("p_type", "p_brand").alias("fields"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("https://p.example.org/"), F.col("p_partkey").cast("string"))).alias("pdf"), F.col("p_retailprice").alias("price"), "p_name")
    pairs = B.overlapping(n, works, "request", "work", "fields").join(works.select("work", "pdf", "price"), "work").join(n.select("request", "only_open"), "request").where(~F.col("only_open") | F.col("pdf").isNotNull())
    words = n.select("request", B.biased(F.split("q", " "), _BIAS).alias("words"))
    named = B.overlapping(words, works.select("work", F.split("p_name", " ").alias("words")), "request", "work", "words").groupBy("request").agg(F.count(F.lit(1)).alias("named"))
    counts = pairs.groupBy("request", "only_open").agg(F.count(F.lit(1)).alias("by_field")).join(named, "request", "left")
    page = top(pairs, "request", 12, F.desc("price"), F.asc("work"))
    of = counts.select("request", B.total(F.col("only_open"), F.least("by_field", F.lit(12)), F.col("by_field"), F.coalesce("named", F.lit(0))).alias("total"))
    return page.join(of, "request").select("request", "rank", "work", "pdf", "total")


_FIELD_SQL = """
WITH n AS (SELECT n_nationkey AS request, [['ECONOMY', 'SMALL', 'MEDIUM', 'PROMO', 'STANDARD', 'LARGE'][n_nationkey % 6 + 1], 'Brand#' || (n_nationkey % 25 + 1)] AS fields, n_nationkey % 3 = 0 AS only_open, ['small ring', 'red medicine', 'hot widget', 'blue'][n_nationkey % 4 + 1] || ' medicine clinical biomedical dataset' AS q FROM nation),
w AS (SELECT p_partkey AS work, [p_type, p_brand] AS fields, CASE WHEN p_size % 2 = 0 THEN 'https://p.example.org/' || p_partkey END AS pdf, p_retailprice AS price, p_name FROM part),
p AS (SELECT request, only_open, work, pdf, price FROM n JOIN w ON list_has_any(n.fields, w.fields) WHERE NOT only_open OR pdf IS NOT NULL),
t AS (SELECT request, count(*) AS named FROM n JOIN w ON list_has_any(string_split(q, ' '), string_split(p_name, ' ')) GROUP BY request),
c AS (SELECT request, CASE WHEN only_open THEN least(count(*), 12) ELSE greatest(count(*), coalesce(any_value(named), 0)) END AS total FROM p LEFT JOIN t USING (request) GROUP BY request, only_open)
SELECT request, CAST(rank AS INTEGER) AS rank, work, pdf, total FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY price DESC, work) AS rank FROM p) JOIN c USING (request) WHERE rank <= 12"""

_SEARCHES = {"datasets_search_all": ("all", 1998, "citations"), "datasets_search_data": ("data", 2000, "date"), "datasets_search_paper": ("paper", 1999, "relevance"), "datasets_search_trial": ("trial", 1990, "relevance")}

QUERIES = {
    "open_access_lookup": open_access_lookup,
    "papers_enrich_sources": papers_enrich_sources,
    "graph_failed": graph_failed,
    "journal_profile": journal_profile,
    "datasets_facets": datasets_facets,
    "papers_field_filter": papers_field_filter,
} | {name: datasets_search(*x) for name, x in _SEARCHES.items()}
ORACLES = {
    "open_access_lookup": _OPEN_SQL,
    "papers_enrich_sources": _ENRICH_SQL,
    "graph_failed": _FAILED_SQL,
    "journal_profile": _PROFILE_SQL,
    "datasets_facets": f"{_search_cte('all', 1998)} SELECT request, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in B.WANTED) + " FROM o GROUP BY request",
    "papers_field_filter": _FIELD_SQL,
} | {name: _search_sql(*x) for name, x in _SEARCHES.items()}
