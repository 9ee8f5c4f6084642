"""Queries: rows of sources as they are shown, the links of a paper, key words over several fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import rows as R
from quillspark.functions import text as T
from quillspark.plans import duck as D
from quillspark.plans import outputs
from quillspark.sources import tables as S

_DAY = "case doc_id % 6 when 0 then concat(cast(1990 + doc_id % 30 as {s}), ' Mar 3') when 1 then 'Spring 2001' when 2 then '' when 3 then '0000' when 4 then '2011' end"
_PMID = "case doc_id % 4 when 0 then concat('https://PubMed.ncbi.nlm.nih.gov/', cast(10000000 + doc_id as {s}), '/') when 1 then concat('PMID ', cast(10000000 + doc_id as {s})) when 2 then 'none' end"
_DOI = "case doc_id % 5 when 0 then '' when 1 then null else concat('10.1000/w.', cast(doc_id as {s})) end"
_LANDING = "case doc_id % 3 when 0 then '' when 1 then concat('https://example.org/', cast(doc_id as {s})) end"
_LIST = "case doc_id % 4 when 0 then ' Lovelace A , Hopper G' when 1 then ', Hopper G' when 2 then 'Hopper G' end"


def index_rows(spark, d):
    """Documents as rows of the medical index, listed as papers and turned into records."""
    docs = S.table(spark, d, "documents").select("doc_id", T.first_line(F.col("text")).alias("title"), "text", *[F.expr(e.format(s="string")).alias(n) for n, e in (("day", _DAY), ("pmid", _PMID), ("doi", _DOI), ("landing", _LANDING), ("list", _LIST))])
    c = {n: F.col(n) for n in docs.columns}
    row = R.index_row(c["title"], c["day"], c["list"], c["doi"], c["doc_id"].cast("string"), c["text"])
    return docs.select("doc_id", *[row[n].alias(n) for n in ("year", "cited", "authors", "doi", "is_open", "url")], F.array_join(row["tags"], ",").alias("tags"), R.pmid_digits(c["pmid"]).alias("pmid"), R.record_link(c["doi"], c["landing"]).alias("link"), R.first_named(c["list"]).alias("first_author"), R.year_bucket(row["year"]).alias("bucket"))


_INDEX_ROWS_SQL = f"""WITH x AS (SELECT doc_id, text, {D.first_line("text")} AS title, {_DAY.format(s="varchar")} AS day, {_PMID.format(s="varchar")} AS pmid, {_DOI.format(s="varchar")} AS doi, {_LANDING.format(s="varchar")} AS landing, {_LIST.format(s="varchar")} AS names FROM documents),
t AS (SELECT *, lower(title || ' ' || text) AS b FROM x)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN CAST(1990 + doc_id % 30 AS INTEGER) WHEN 4 THEN 2011 END AS year, CAST(0 AS BIGINT) AS cited, coalesce(names, '—') AS authors, nullif(doi, '') AS doi, false AS is_open, 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' AS url,
    array_to_string(list_filter([{outputs._TAGS}], lambda x: x IS NOT NULL)[:4], ',') AS tags, CASE WHEN doc_id % 4 < 2 THEN CAST(10000000 + doc_id AS VARCHAR) END AS pmid,
    CASE WHEN doc_id % 5 > 1 THEN 'https://doi.org/' || doi WHEN doc_id % 3 = 1 THEN landing END AS link, CASE doc_id % 4 WHEN 0 THEN 'Lovelace A' WHEN 2 THEN 'Hopper G' END AS first_author,
    CASE WHEN doc_id % 6 = 4 OR (doc_id % 6 = 0 AND doc_id % 30 < 22) THEN 'older' WHEN doc_id % 6 = 0 AND doc_id % 30 < 28 THEN '2012' WHEN doc_id % 6 = 0 THEN '2018' ELSE 'unknown' END AS bucket FROM t"""

_AUTHORS = "transform(sequence(1, cast(c_custkey % 4 as int) + 1), i -> named_struct('family', case when (c_custkey + i) % 3 > 0 then c_name else '' end, 'given', case when (c_custkey + i) % 4 = 0 then c_mktsegment end, 'name', case when (c_custkey + i) % 6 = 0 then '' when (c_custkey + i) % 5 = 0 then 'Group' end))"


def registry_authors(spark, d):
    """Author objects of a registry that gives families, given names or names of groups; empty ones are dropped."""
    c = S.table(spark, d, "customer").select("c_custkey", R.named_authors(F.expr(_AUTHORS)).alias("x"))
    return c.select("c_custkey", F.posexplode("x").alias("pos", "a")).select("c_custkey", "pos", "a.family", "a.given", "a.name")


_AUTHORS_SQL = """WITH i AS (SELECT c_custkey, c_name, c_mktsegment, unnest(range(1, c_custkey % 4 + 2)) AS i FROM customer),
a AS (SELECT c_custkey, i, CASE WHEN (c_custkey + i) % 3 > 0 THEN c_name END AS family, CASE WHEN (c_custkey + i) % 4 = 0 THEN c_mktsegment END AS given, CASE WHEN (c_custkey + i) % 6 > 0 AND (c_custkey + i) % 5 = 0 THEN 'Group' END AS name FROM i)
SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY i) - 1 AS INTEGER) AS pos, family, given, name FROM a WHERE coalesce(family, given, name) IS NOT NULL"""

_PDF = "case doc_id % 7 when 0 then concat('https://doi.org/10.1000/w.', cast(doc_id as {s})) when 1 then '' when 2 then concat('https://example.org/', cast(doc_id as {s}), '.pdf') end"
_PAGE = "case doc_id % 9 when 0 then concat('https://example.org/', cast(doc_id as {s})) when 1 then '' end"
_VENUE = "case doc_id % 4 when 0 then '' when 1 then null else concat(' ', source, ' & Co (', lang, ') ') end"


def paper_links(spark, d):
    """What every document can be opened with, and the other searches it starts, in order; and where registries are
    searched for its title."""
    docs = S.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 6 > 0, T.first_line(F.col("text"))).alias("title"), *[F.expr(e.format(s="string")).alias(n) for n, e in (("pmid", _PMID), ("doi", _DOI), ("pdf", _PDF), ("page", _PAGE), ("venue", _VENUE))])
    links = R.paper_links(*[F.col(n) for n in ("doi", "pmid", "title", "venue", "page", "pdf")])
    search = R.registry_links(F.col("title"))
    # Titles may be whole texts: hashes of the links are enough to compare them.
    return docs.select("doc_id", F.posexplode(links).alias("pos", "x"), search["chictr"].alias("chictr"), search["ictrp"].alias("ictrp")).select("doc_id", "pos", "x.key", *[F.md5(F.coalesce(F.col(c), F.lit("")).cast("binary")).alias(n) for n, c in (("href_md5", "x.href"), ("chictr_md5", "chictr"), ("ictrp_md5", "ictrp"))])


def _component_sql(x: str) -> str:
    out = f"url_encode({x})"
    for code, char in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        out = f"replace({out}, '{code}', '{char}')"
    return out


_LINKS_SQL = f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 6 > 0 THEN {D.first_line("text")} END AS title, {_PMID.format(s="varchar")} AS pmid, nullif({_DOI.format(s="varchar")}, '') AS doi, nullif({_PDF.format(s="varchar")}, '') AS pdf, nullif({_PAGE.format(s="varchar")}, '') AS page, {_VENUE.format(s="varchar")} AS venue FROM documents),
s AS (SELECT *, nullif({D.strip("title")}, '') AS name, nullif({D.strip("venue")}, '') AS journal, nullif(coalesce(doi, 'PMID:' || pmid, {D.strip("title")}), '') AS start, coalesce(page, 'https://doi.org/' || doi, 'https://pubmed.ncbi.nlm.nih.gov/' || nullif(regexp_replace(pmid, '[^0-9]', '', 'g'), '') || '/') AS opened FROM x),
l AS (SELECT doc_id, title, list_filter([{{'key': 'pdf', 'href': pdf}}, {{'key': 'open', 'href': CASE WHEN pdf IS NULL OR pdf <> opened THEN opened END}}, {{'key': 'map', 'href': '/map?q=' || {_component_sql("start")}}}, {{'key': 'trials', 'href': '/trials?q=' || {_component_sql("start")}}},
    {{'key': 'datasets', 'href': '/datasets?q=' || {_component_sql(f"nullif({D.strip("coalesce(nullif(title, ''), journal, start)")}, '')")}}}, {{'key': 'journals', 'href': '/journals?q=' || {_component_sql("journal")}}}, {{'key': 'papers', 'href': '/papers?q=' || {_component_sql("start")}}},
    {{'key': 'match', 'href': '/match?q=' || {_component_sql("substr(name, 1, 200)")}}}, {{'key': 'citations', 'href': '/citations?seed=' || {_component_sql("coalesce(doi, nullif(title, ''))")}}}], lambda z: z.href IS NOT NULL) AS l FROM s)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, l[i].key AS key, md5(l[i].href) AS href_md5, md5(coalesce('https://www.chictr.org.cn/searchproj.html?title=' || {_component_sql(D.strip("title"))}, '')) AS chictr_md5, md5(coalesce('https://trialsearch.who.int/?Term=' || {_component_sql(D.strip("title"))}, '')) AS ictrp_md5
    FROM (SELECT doc_id, title, l, unnest(range(1, len(l) + 1)) AS i FROM l)"""


def adverse_event_hits(spark, d):
    """Orders as adverse event reports, shown as dataset hits: parts as drugs, brands as reactions, in line order."""
    li = S.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    p = S.table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("drug"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand")).otherwise("").alias("reaction"))
    named = li.join(p, li["l_partkey"] == p["p_partkey"], "left")
    # A report's drugs are the lines of one order, which are few.
    reports = named.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "drug", "reaction"))).alias("x"))
    cols = R.adverse_event(F.transform("x", lambda e: e["drug"]), F.transform("x", lambda e: e["reaction"]), F.when(F.col("l_orderkey") % 2 == 0, "RED ring").otherwise("Bolt"), F.concat(F.lit("US "), F.col("l_orderkey").cast("string")))
    return reports.select("l_orderkey", *[c.alias(n) for n, c in cols.items()])


_EVENTS_SQL = """WITH n AS (SELECT l_orderkey, list(CASE WHEN p_partkey % 3 > 0 THEN p_name END ORDER BY l_linenumber, l_partkey) AS l, list(CASE WHEN p_partkey % 4 > 0 THEN p_brand END ORDER BY l_linenumber, l_partkey) AS e FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
f AS (SELECT l_orderkey, list_filter(l, lambda x: x IS NOT NULL) AS l, list_filter(e, lambda x: x IS NOT NULL) AS e, CASE WHEN l_orderkey % 2 = 0 THEN 'red' ELSE 'bolt' END AS w FROM n),
m AS (SELECT *, list_filter(l, lambda x: contains(lower(x), w)) AS h FROM f),
s AS (SELECT l_orderkey, array_to_string(CASE WHEN len(h) > 0 THEN list_concat(h[:1], list_filter(l, lambda x: x <> h[1])) ELSE l END[:3], ', ') AS drugs, array_to_string(e[:4], ', ') AS effects FROM m)
SELECT l_orderkey, CASE WHEN drugs <> '' THEN 'openFDA AE · ' || drugs ELSE 'openFDA safety report US ' || l_orderkey END AS title,
    CASE WHEN effects <> '' THEN 'Reactions: ' || effects || '（打开为 openFDA JSON 记录）' ELSE 'Drug adverse event report metadata（打开为 openFDA JSON 记录）' END AS description, 'https://api.fda.gov/drug/event.json?search=safetyreportid:US%20' || l_orderkey AS url FROM s"""

#: What is asked of the list of parts.
_ASKS = ("steel  BRASS", "brand#12 small", "", "no such thing-")


def curated_fields(spark, d):
    """Parts as rows of a curated list, found by words in their title, description or source, for each of four requests."""
    p = S.table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    asked = p.select("*", F.posexplode(F.array(*[F.lit(a) for a in _ASKS])).alias("ask", "query"))
    return asked.where(R.holds_word(F.col("query"), F.col("p_name"), F.col("p_type"), F.col("p_brand"))).select("ask", "p_partkey")


_FIELDS_SQL = " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS ask, p_partkey FROM part WHERE " + (" OR ".join(f"contains(lower(concat_ws(' ', p_name, p_type, p_brand)), '{w}')" for w in a.lower().split()) or "false")
    for i, a in enumerate(_ASKS)
)

QUERIES = {f.__name__: f for f in (index_rows, registry_authors, paper_links, adverse_event_hits, curated_fields)}
ORACLES = {"index_rows": _INDEX_ROWS_SQL, "registry_authors": _AUTHORS_SQL, "paper_links": _LINKS_SQL, "adverse_event_hits": _EVENTS_SQL, "curated_fields": _FIELDS_SQL}
