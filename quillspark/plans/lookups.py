"""Queries: identifiers, lookups, evidence of matches, rows of sources as they are shown."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import identifiers as I
from quillspark.functions import rows as R
from quillspark.functions import text as T
from quillspark.operators import linkage as L
from quillspark.operators import resolve as O
from quillspark.plans import duck as D
from quillspark.plans import matching, outputs, records
from quillspark.sources import tables as S

_SP = D.SPACE[1:-1]


def _dois_sql(x: str) -> str:
    found = f"list_transform(regexp_extract_all({x}, '(10\\.\\d{{4,9}}/[^{_SP}|;,，；\\]>\"'']+)', 1), lambda z: regexp_replace(z, '[.)\\]}}>，；;]+$', ''))"
    return f"list_transform([{found}], lambda f: list_filter(f, lambda z, i: list_position(list_transform(f, lambda y: lower(y)), lower(z)) = i)[:10])[1]"


_MARKED = "concat(text, ' doi:10.1000/W.', cast(doc_id as {s}), '). See PMID: ', cast(10000000 + doc_id as {s}), ', https://doi.org/10.1000/w.', cast(doc_id as {s}), ' and 10.2000/', source, ']')"


def identifiers_extract(spark, d):
    """The identifiers of every document, and the year it names first."""
    docs = S.table(spark, d, "documents").select("doc_id", F.expr(_MARKED.format(s="string")).alias("text"))
    return docs.select("doc_id", F.array_join(I.dois(F.col("text")), ",").alias("dois"), F.array_join(I.pmids(F.col("text")), ",").alias("pmids"), I.year_hint(F.col("text")).alias("year_hint"))


_IDENTIFIERS_SQL = f"""WITH m AS (SELECT doc_id, {_MARKED.format(s="varchar")} AS text FROM documents)
SELECT doc_id, array_to_string({_dois_sql("text")}, ',') AS dois, array_to_string(list_distinct(regexp_extract_all(text, '(?i)\\bPMID[:{_SP}]*([0-9]{{5,9}})\\b', 1))[:10], ',') AS pmids,
    CAST(nullif(regexp_extract(regexp_extract(text, '(?i)\\((\\d{{4}})[a-z]?\\)|\\b((?:19|20)\\d{{2}})\\b', 0), '(\\d{{4}})', 1), '') AS INTEGER) AS year_hint FROM m"""

#: Ways to ask for a work, by doc_id % 10.
_ASKS = (
    "concat(' DOI:10.1000/W.', id)",
    "concat('10.1000/w.', id, ' ')",
    "concat('PMID: ', cast(10000000 + doc_id as {s}))",
    "cast(10000000 + doc_id as {s})",
    "concat('https://example.org/W', id)",
    "concat('w', id)",
    "concat('NCT', cast(10000000 + doc_id as {s}))",
    "concat('https://doi.org/10.1000/w.', id, ', doi: 10.1000/x.', id, '.')",
    "concat('pmid ', cast(90000000 + doc_id as {s}), '.')",
    "concat(source, ' ', lang)",
)
_ASK = "case " + " ".join(f"when doc_id % 10 = {i} then {a}" for i, a in enumerate(_ASKS)) + " end"


def _asks(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "source", "lang", F.col("doc_id").cast("string").alias("id"))
    return docs.select(F.col("doc_id").alias("ask_id"), F.expr(_ASK.format(s="string")).alias("query"))


_ASKED_SQL = f"(SELECT doc_id AS ask_id, {_ASK.format(s='varchar')} AS query FROM (SELECT doc_id, source, lang, CAST(doc_id AS VARCHAR) AS id FROM documents))"


def identifier_kinds(spark, d):
    """How each line asks for a work, and whether it is identifiers only."""
    q = F.col("query")
    return _asks(spark, d).select("ask_id", I.kind(q).alias("kind"), I.value(q, I.kind(q)).alias("value"), I.only_dois(q).alias("only_dois"), I.only_pmid(q).alias("only_pmid"), I.shortcut(q).alias("shortcut"))


_Q = D.strip("query")
_KIND = f"CASE WHEN {_Q} = '' THEN NULL WHEN regexp_matches({_Q}, '(?i)^10\\.\\d{{4,}}/[^{_SP}]+') OR starts_with(lower({_Q}), 'doi:') THEN 'doi' WHEN regexp_matches({_Q}, '(?i)^PMID|^[0-9]{{5,9}}$') THEN 'pmid' WHEN regexp_matches({_Q}, '(?i)^W[0-9]+|/W[0-9]+$') THEN 'work' WHEN regexp_matches({_Q}, '(?i)^NCT[0-9]{{8}}$') THEN 'trial' ELSE 'text' END"
_VALUE = f"CASE kind WHEN 'doi' THEN lower({D.strip(f'regexp_replace({_Q}, {chr(39)}(?i)^doi:{chr(39)}, {chr(39)*2})')}) WHEN 'pmid' THEN {D.strip(f'regexp_replace({_Q}, {chr(39)}(?i)^PMID[:{_SP}]*{chr(39)}, {chr(39)*2})')} WHEN 'work' THEN upper(string_split({_Q}, '/')[-1]) ELSE {_Q} END"
_REST = f"regexp_replace(regexp_replace(regexp_replace(list_reduce({_dois_sql(_Q)}, lambda r, y: CASE WHEN strpos(lower(r), lower(y)) > 0 THEN substr(r, 1, strpos(lower(r), lower(y)) - 1) || substr(r, strpos(lower(r), lower(y)) + length(y)) ELSE r END, {_Q}), '(?i)https?://(?:dx\\.)?doi\\.org/', '', 'g'), '(?i)doi[:{_SP}]*', '', 'g'), '[{_SP}.;,|:：，；\\[\\]>\"'']+', '', 'g')"
_KINDS_SQL = f"""WITH k AS (SELECT *, {_KIND} AS kind FROM {_ASKED_SQL})
SELECT ask_id, kind, {_VALUE} AS value, len({_dois_sql(_Q)}) > 0 AND {_REST} = '' AS only_dois, regexp_matches({_Q}, '(?i)^(?:PMID[:{_SP}]*)?[0-9]{{5,9}}\\.?$') AS only_pmid, regexp_matches({_Q}, '(?i)^10\\.\\d{{4,}}/[^{_SP}]+|^PMID|^[0-9]{{7,9}}$') AS shortcut FROM k"""


def work_resolve(spark, d):
    """The lines of identifier_kinds and all benchmark items as titles, resolved to works; unknown ones stay, as
    Untitled. Documents have a DOI but for each third, a PMID but for each seventh."""
    w = S.works(spark, d).withColumns({"doi": F.when(F.col("work_id") % 30 > 2, F.concat(F.lit("10.1000/w."), F.col("work_id").cast("string"))), "pmid": F.when(F.col("work_id") % 7 > 0, 10000000 + F.col("work_id"))})
    b = S.table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("ask_id"), F.concat(F.lit("re: "), T.first_line(F.col("text"))).alias("query"))
    found = O.resolve_works(_asks(spark, d).unionByName(b), w)
    return O.multi_get(found, w.select("work_id", "title"), "work_id").select("ask_id", "kind", "work_id", "found_by", R.or_else(F.col("title"), "Untitled").alias("title"))


_RESOLVE_SQL = f"""WITH a AS (SELECT ask_id, query FROM {_ASKED_SQL} UNION ALL SELECT -1 - item_id, 're: ' || {D.first_line("text")} FROM benchmark),
k AS (SELECT *, {_KIND} AS kind FROM a), v AS (SELECT ask_id, kind, {_VALUE} AS value FROM k),
w AS (SELECT doc_id, {D.first_line("text")} AS title, CASE WHEN doc_id % 30 > 2 THEN '10.1000/w.' || doc_id END AS doi, CASE WHEN doc_id % 7 > 0 THEN CAST(10000000 + doc_id AS VARCHAR) END AS pmid FROM documents),
x AS (SELECT 'doi' AS kind, doi AS value, doc_id FROM w UNION ALL SELECT 'pmid', pmid, doc_id FROM w UNION ALL SELECT 'work', 'W' || doc_id, doc_id FROM w),
r AS (SELECT v.ask_id, v.kind, v.value, min(doc_id) AS by_key FROM v LEFT JOIN x USING (kind, value) GROUP BY ALL),
d AS (SELECT doc_id, {D.tokens("title")} AS bag FROM w), n AS (SELECT count(*) AS n, avg(len(bag)) AS mean FROM d),
t AS (SELECT doc_id, len(bag) AS size, unnest(bag) AS token FROM d), i AS (SELECT doc_id, size, token, count(*) AS times FROM t GROUP BY ALL), f AS (SELECT token, count(*) AS df FROM i GROUP BY token),
q AS (SELECT DISTINCT ask_id, unnest({D.tokens("value")}) AS token FROM r WHERE by_key IS NULL AND kind IN ('pmid', 'trial', 'text')),
s AS (SELECT ask_id, doc_id, {D.rounded("sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * size / mean)))")} AS score FROM q JOIN i USING (token) JOIN f USING (token), n GROUP BY ask_id, doc_id),
b AS (SELECT ask_id, doc_id AS by_text FROM (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank = 1),
o AS (SELECT ask_id, kind, coalesce(by_key, by_text) AS work_id, CASE WHEN by_key IS NOT NULL THEN kind WHEN by_text IS NOT NULL THEN 'search' END AS found_by FROM r LEFT JOIN b USING (ask_id))
SELECT ask_id, kind, work_id, found_by, coalesce(nullif(title, ''), 'Untitled') AS title FROM o LEFT JOIN w ON work_id = doc_id"""

_HINTED = "concat({x}, ' (', cast(1995 + item_id % 30 as {s}), ')', case when item_id % 3 = 0 then concat(' doi:10.1000/W.', cast(item_id as {s})) else '' end)"


def match_evidence(spark, d):
    """The best works for each benchmark item, asked by title and by text with a year and some with a DOI,
    and what speaks for them."""
    b = S.table(spark, d, "benchmark").withColumn("short", F.substring(T.first_line(F.col("text")), 1, 160))
    parts = [b.select((F.col("item_id") * 2 + i).alias("query_id"), F.expr(_HINTED.format(x=x, s="string")).alias("phrase"), F.lit(mode).alias("mode")) for i, (x, mode) in enumerate((("short", "title"), ("text", "body")))]
    asked = parts[0].unionByName(parts[1]).withColumns({"year_hint": I.year_hint(F.col("phrase")), "dois": F.transform(I.dois(F.col("phrase")), F.lower)})
    w = S.works(spark, d).withColumn("doi", F.concat(F.lit("10.1000/w."), F.col("work_id").cast("string")))
    found = L.evidence(L.ranked_matches(asked, w, few=True), asked, w)
    figures = [T.rounded(F.col(c), 2).alias(c) for c in ("score", "title_score", "abstract_score", "coverage")]
    return found.select("query_id", "work_id", "mode", "rank", "year_status", "doi_hit", *figures, *[F.array_join(c, ",").alias(c) for c in ("matched", "missed", "reasons")])


_HINTS = f"CAST(nullif(regexp_extract(regexp_extract(phrase, '(?i)\\((\\d{{4}})[a-z]?\\)|\\b((?:19|20)\\d{{2}})\\b', 0), '(\\d{{4}})', 1), '') AS INTEGER) AS year_hint, list_transform({_dois_sql('phrase')}, lambda z: lower(z)) AS dois"
_EVIDENCE_ASKED = f"SELECT item_id * 2 AS query_id, {_HINTED.format(x='substr(' + D.first_line('text') + ', 1, 160)', s='varchar')} AS phrase, 'title' AS mode FROM benchmark UNION ALL SELECT item_id * 2 + 1, {_HINTED.format(x='text', s='varchar')}, 'body' FROM benchmark"
_FIRSTS = lambda l: f"list_filter({l}, lambda z, i: list_position({l}, z) = i)"
_EVIDENCE_SQL = f"""WITH {matching._match_cte(_EVIDENCE_ASKED, _HINTS)},
e AS (SELECT ranked.*, {_FIRSTS("q.bag")} AS asked, tbag, abs(ranked.year_hint - ranked.year) AS gap FROM ranked JOIN q USING (query_id) JOIN w USING (work_id) WHERE rank <= 8),
y AS (SELECT *, CASE WHEN gap = 0 THEN 'exact' WHEN gap <= 2 THEN 'near' WHEN gap > 2 THEN 'mismatch' ELSE 'none' END AS year_status FROM e),
z AS (SELECT *, list_filter([CASE WHEN doi_hit THEN 'DOI 直达' END, CASE WHEN title_score >= 0.45 THEN '标题 ' || CAST(floor(title_score * 100 + 0.5) AS INTEGER) || '%' END, CASE WHEN mode = 'body' AND coverage >= 0.35 THEN '标题词覆盖 ' || CAST(floor(coverage * 100 + 0.5) AS INTEGER) || '%' END,
    CASE WHEN abstract_score >= 0.2 THEN '摘要重叠 ' || CAST(floor(abstract_score * 100 + 0.5) AS INTEGER) || '%' END, CASE year_status WHEN 'exact' THEN '年份一致' WHEN 'near' THEN '年份接近' WHEN 'mismatch' THEN '年份不符' END], lambda r: r IS NOT NULL) AS why FROM y)
SELECT query_id, work_id, mode, CAST(rank AS INTEGER) AS rank, year_status, doi_hit, {", ".join(D.rounded(c, 2) + f" AS {c}" for c in ("score", "title_score", "abstract_score", "coverage"))}, array_to_string(list_filter(asked, lambda t: list_contains(tbag, t))[:24], ',') AS matched,
    CASE WHEN mode = 'title' THEN array_to_string(list_filter(asked, lambda t: NOT list_contains(tbag, t))[:16], ',') ELSE '' END AS missed, CASE WHEN len(why) > 0 THEN array_to_string(why, ',') ELSE '弱词重叠' END AS reasons FROM z"""


def dataset_cite(spark, d):
    """Every hit of the dataset sources in three styles."""
    h = records._hits(spark, d).select("kind", "tag", "pos", "year", F.concat("title", F.when(F.col("pos") % 4 == 0, F.lit(" {a} \\ 5% & b_c")).otherwise("")).alias("title"))
    key = F.concat_ws(":", "tag", F.col("pos").cast("string"))
    doi = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("10.5000/"), F.col("tag"), F.lit("."), F.col("pos").cast("string")))
    cols = R.dataset_citations(key, F.col("tag"), F.col("title"), F.when(F.col("kind") != "trial", F.col("kind")), F.col("year"), doi)
    return h.select("tag", "pos", *[c.alias(n) for n, c in cols.items()])


_ESC = lambda x: f"regexp_replace(replace({x}, '\\', '\\\\'), '([{{}}#%&_$])', '\\\\\\1', 'g')"
_CITE_SQL = f"""WITH {records._HITS}, c AS (SELECT tag, pos, kind, coalesce(CAST(year AS VARCHAR), 'n.d.') AS y, title || CASE WHEN pos % 4 = 0 THEN ' {{a}} \\ 5% & b_c' ELSE '' END AS t, CASE WHEN pos % 3 = 0 THEN '10.5000/' || tag || '.' || pos ELSE '' END AS doi, CASE WHEN kind <> 'trial' THEN kind ELSE '' END AS v FROM h)
SELECT tag, pos, tag || '. (' || y || '). ' || t || '. ' || v || CASE WHEN doi <> '' THEN '. https://doi.org/' || doi ELSE '' END AS apa, tag || '. ' || t || '[DB/OL]. ' || v || ', ' || y || '.' AS gbt,
    '@misc{{' || substr(regexp_replace(CASE WHEN doi <> '' THEN doi ELSE tag || ':' || pos END, '[^a-zA-Z0-9]', '', 'g'), 1, 20) || ',' || chr(10) || '  title={{' || {_ESC("t")} || '}},' || chr(10) || '  author={{' || tag || '}},' || chr(10) || '  year={{' || y || '}}' || chr(10) || '}}' AS bibtex FROM c"""

_NAMES = "transform(sequence(0, cast(doc_id % 8 as int)), i -> case when i = 2 then '' when i = 0 and doc_id % 5 = 0 then null else concat('Name ', cast(i + doc_id % 3 as string)) end)"
_NAMES_SQL = "list_transform(range(0, doc_id % 8 + 1), lambda i: CASE WHEN i = 2 THEN '' WHEN i = 0 AND doc_id % 5 = 0 THEN NULL ELSE 'Name ' || (i + doc_id % 3) END)"


def paper_rows(spark, d):
    """Documents as papers are listed: some without title, abstract, authors or DOI, some with a PDF."""
    p = S.works(spark, d).withColumnRenamed("work_id", "doc_id").withColumns(
        {
            "title": F.when(F.col("doc_id") % 6 > 0, F.col("title")),
            "short": F.substring("abstract", 1, 300),
            "abstract": F.when(F.col("doc_id") % 4 > 0, F.col("abstract")),
            "names": F.expr(_NAMES),
            "doi": F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("10.1000/w "), F.col("doc_id").cast("string"))),
            "pmid": F.when(F.col("doc_id") % 5 > 0, (10000000 + F.col("doc_id")).cast("string")),
            "pdf": F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("https://example.org/a b/"), F.col("doc_id").cast("string"), F.lit(".pdf"))),
        }
    )
    c = {n: F.col(n) for n in p.columns}
    cols = R.paper(c["title"], c["abstract"], c["short"], c["names"], F.array(F.when(c["doc_id"] % 2 == 0, "Review").otherwise("Clinical Trial")), c["doi"], c["pdf"], c["doc_id"] % 9 == 0, c["cited"], F.lit(None).cast("string"))
    return p.select(
        "doc_id",
        cols["title"].alias("title"),
        F.md5(cols["abstract"].cast("binary")).alias("abstract_md5"),
        F.array_join(cols["tags"], ",").alias("tags"),
        *[cols[n].alias(n) for n in ("authors", "is_open", "cited", "url")],
        R.authors_line(c["names"]).alias("short_authors"),
        R.gate_link(c["pdf"], c["doi"], "redirect", "/api/pdf").alias("jump"),
        R.gate_link(c["pdf"], c["doi"], "proxy", "/api/pdf").alias("proxy"),
        R.seed(c["doi"], c["pmid"], c["title"]).alias("seed"),
    )


_PDF_Q = "'/api/pdf?url=' || replace(url_encode(pdf), '%20', '+') || {m} || CASE WHEN doi IS NOT NULL THEN '&doi=' || replace(url_encode(doi), '%20', '+') ELSE '' END"
_PAPER_SQL = f"""WITH p AS (SELECT doc_id, n_chars AS cited, CASE WHEN doc_id % 6 > 0 THEN {D.first_line("text")} END AS title, CASE WHEN doc_id % 4 > 0 THEN text END AS abstract, substr(text, 1, 300) AS short, {_NAMES_SQL} AS names,
    CASE WHEN doc_id % 3 > 0 THEN '10.1000/w ' || doc_id END AS doi, CASE WHEN doc_id % 5 > 0 THEN CAST(10000000 + doc_id AS VARCHAR) END AS pmid, CASE WHEN doc_id % 7 = 0 THEN 'https://example.org/a b/' || doc_id || '.pdf' END AS pdf FROM documents),
s AS (SELECT *, coalesce(nullif(title, ''), 'Untitled') AS shown, substr(coalesce(nullif(abstract, ''), short, ''), 1, 2500) AS body, list_filter(names, lambda n: n <> '') AS known FROM p),
t AS (SELECT *, lower(shown || ' ' || CASE WHEN doc_id % 2 = 0 THEN 'Review' ELSE 'Clinical Trial' END || ' ' || body) AS b FROM s)
SELECT doc_id, shown AS title, md5(body) AS abstract_md5, array_to_string(list_filter([{outputs._TAGS}], lambda x: x IS NOT NULL)[:4], ',') AS tags, coalesce(nullif(array_to_string(list_filter(names[:5], lambda n: n <> ''), ', '), ''), '—') AS authors,
    doc_id % 9 = 0 OR pdf IS NOT NULL AS is_open, cited, CASE WHEN doi IS NOT NULL THEN 'https://doi.org/' || doi END AS url, array_to_string(known[:3], ', ') || CASE WHEN len(known) > 3 THEN ' et al.' ELSE '' END AS short_authors,
    CASE WHEN pdf IS NOT NULL THEN {_PDF_Q.format(m="''")} END AS jump, CASE WHEN pdf IS NOT NULL THEN {_PDF_Q.format(m="'&mode=proxy'")} END AS proxy, coalesce(doi, 'PMID:' || pmid, {D.strip("coalesce(title, '')")}) AS seed FROM t"""


def trial_rows(spark, d):
    """Parts as trials; those without a number aren't listed."""
    p = S.table(spark, d, "part").withColumn("i", F.col("p_size"))
    kinds = F.transform(F.sequence(F.lit(1), F.col("p_size") % 9 + 1), lambda i: F.concat(F.col("p_type"), F.lit(" "), i.cast("string")))
    arms = F.transform(kinds, lambda k, i: F.when(i % 3 == 1, None).otherwise(k))
    cols = R.trial(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")), F.when(F.col("p_partkey") % 3 == 1, F.col("p_brand")), kinds, arms)
    rows = p.where("p_partkey % 6 > 0").select(F.concat(F.lit("NCT"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("trial_id"), cols["title"].alias("title"), *[F.array_join(cols[n], "|").alias(n) for n in ("conditions", "interventions")])
    return rows.withColumn("url", F.concat(F.lit("https://clinicaltrials.gov/study/"), "trial_id"))


_TRIAL_SQL = """WITH k AS (SELECT *, list_transform(range(1, p_size % 9 + 2), lambda i: p_type || ' ' || i) AS kinds FROM part WHERE p_partkey % 6 > 0)
SELECT 'NCT' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS trial_id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE 'Untitled trial' END AS title, array_to_string(kinds[:6], '|') AS conditions,
    array_to_string(list_filter(kinds, lambda z, i: i % 3 <> 2)[:6], '|') AS interventions, 'https://clinicaltrials.gov/study/NCT' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS url FROM k"""


def adverse_event_rows(spark, d):
    """Orders as reports: their parts as drugs, in line order, the asked one in front."""
    li = S.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    p = S.table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 > 0, F.col("p_name")).alias("p_name"))
    named = li.join(p, li["l_partkey"] == p["p_partkey"], "left")
    # A report's drugs are the lines of one order, which are few.
    drugs = named.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))), lambda x: x["p_name"]).alias("drugs"))
    o = S.table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("day"))
    rows = o.join(drugs, o["o_orderkey"] == drugs["l_orderkey"])
    line = R.drug_line(F.col("drugs"), F.when(F.col("o_orderkey") % 2 == 0, "RED ring").otherwise("Bolt"))
    return rows.select("o_orderkey", line.alias("drugs"), R.year_of(F.col("day")).alias("year"))


_ADVERSE_SQL = """WITH n AS (SELECT l_orderkey, list(CASE WHEN p_partkey % 10 > 0 THEN p_name END ORDER BY l_linenumber, l_partkey) AS l FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
f AS (SELECT o_orderkey, o_orderdate, list_filter(l, lambda x: x IS NOT NULL) AS l, CASE WHEN o_orderkey % 2 = 0 THEN 'red' ELSE 'bolt' END AS w FROM orders JOIN n ON o_orderkey = l_orderkey),
m AS (SELECT *, list_filter(l, lambda x: contains(lower(x), w)) AS h FROM f)
SELECT o_orderkey, array_to_string(CASE WHEN len(h) > 0 THEN list_concat(h[:1], list_filter(l, lambda x: x <> h[1])) ELSE l END[:3], ', ') AS drugs, CAST(year(o_orderdate) AS INTEGER) AS year FROM m"""


def search_pages(spark, d):
    """One page of each customer's orders by price, with the total; the page numbers asked for include wrong ones."""
    o = S.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    asked = (F.col("o_custkey") % 4 - 1).cast("int")
    size = F.when(F.col("o_custkey") % 5 > 0, (F.col("o_custkey") % 30).cast("int"))
    return O.pages(o, "o_custkey", asked, size, F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey", "place", "total", "page", "per_page")


_PAGED_SQL = """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS total, greatest(1, CAST(o_custkey % 4 - 1 AS INTEGER)) AS page,
    least(20, greatest(5, CASE WHEN o_custkey % 5 > 0 THEN CAST(o_custkey % 30 AS INTEGER) ELSE 12 END)) AS per_page FROM orders)
SELECT o_custkey, o_orderkey, CAST(place AS INTEGER) AS place, total, page, per_page FROM o WHERE place > (page - 1) * per_page AND place <= page * per_page"""


def first_extract(spark, d):
    """For each benchmark item the first of three documents that has enough text."""
    n = F.col("item_id")
    asked = S.table(spark, d, "benchmark").select("item_id", F.array(n * 3, n * 5 + 1, n * 7 + 2).alias("names"))
    texts = S.table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("It May refer to: "), "text")).otherwise(F.col("text")).alias("extract"))
    return O.first_acceptable(asked, texts, "item_id", "names", "name", "extract")


_EXTRACT_SQL = """WITH a AS (SELECT item_id, unnest([1, 2, 3]) AS i FROM benchmark), b AS (SELECT item_id, i, CASE i WHEN 1 THEN item_id * 3 WHEN 2 THEN item_id * 5 + 1 ELSE item_id * 7 + 2 END AS doc_id FROM a),
e AS (SELECT item_id, i, text FROM b JOIN documents USING (doc_id) WHERE length(text) >= 80 AND doc_id % 4 <> 0 AND NOT contains(lower(text), 'may refer to:'))
SELECT item_id, extract FROM benchmark LEFT JOIN (SELECT item_id, substr(arg_min(text, i), 1, 1200) AS extract FROM e GROUP BY item_id) USING (item_id)"""

#: Messages of services, by page_id % 8.
_RAW = ("'HTTP 429 from service'", "'The operation was aborted'", "'Upstream 502'", "concat('see ', url)", "'暂时不可用'", "''", "concat(url, html)", "repeat('长', 130)")
_MESSAGE = "case " + " ".join(f"when page_id % 8 = {i} then {m}" for i, m in enumerate(_RAW)) + " end"


def user_messages(spark, d):
    rows = S.table(spark, d, "pages").select("page_id", F.expr(_MESSAGE).alias("raw"))
    return rows.select("page_id", R.error_text(F.col("raw")).alias("error"), R.warning_text(F.col("raw")).alias("warning"))


_MESSAGES_SQL = f"""SELECT page_id, CASE WHEN raw = '' THEN '请求失败，请稍后重试' WHEN regexp_matches(raw, '(?i)429|Too Many|rate limit') THEN '检索繁忙，请稍后再试或换个关键词。' WHEN regexp_matches(raw, '(?i)timeout|AbortError|aborted') THEN '请求超时，请重试。'
    WHEN regexp_matches(raw, '(?i)Upstream|ECONN|ENOTFOUND|fetch failed|https?://|api\\.|\\.org|\\.gov|\\.edu') OR length(raw) > 100 THEN '请求失败，请稍后重试' ELSE raw END AS error,
    CASE WHEN raw = '' THEN NULL WHEN regexp_matches(raw, '(?i)429|Too Many|rate') THEN '部分检索通道繁忙，已自动改用备用通道返回结果。' WHEN regexp_matches(raw, '(?i)Upstream|https?://|api\\.|\\.org|\\.gov') OR length(raw) > 160 THEN '部分通道暂时不可用，已尽量用可用结果展示。' ELSE raw END AS warning
    FROM (SELECT page_id, {_MESSAGE} AS raw FROM pages)"""


def record_panel(spark, d):
    """(label, value) rows of parts as records, empty ones left out, numbers as they are shown."""
    p = S.table(spark, d, "part")
    text = lambda c, n: F.when(F.col("p_partkey") % n > 0, F.col(c).cast("string"))
    panel = R.label_rows(("作者", text("p_brand", 3)), ("年份", text("p_size", 4)), ("期刊/来源", F.col("p_type")), ("卷期页", R.volume_line(text("p_size", 5), text("p_partkey", 2), F.lit(""))), ("被引", R.number(F.when(F.col("p_partkey") % 7 > 0, F.when(F.col("p_partkey") % 2 == 0, F.floor("p_retailprice").cast("double")).otherwise(F.col("p_retailprice"))))))
    return p.select("p_partkey", F.posexplode(panel).alias("pos", "x")).select("p_partkey", "pos", "x.label", "x.value")


_PANEL_SQL = """WITH v AS (SELECT p_partkey, list_filter([{'label': '作者', 'value': CASE WHEN p_partkey % 3 > 0 THEN p_brand END}, {'label': '年份', 'value': CASE WHEN p_partkey % 4 > 0 THEN CAST(p_size AS VARCHAR) END}, {'label': '期刊/来源', 'value': p_type},
    {'label': '卷期页', 'value': concat_ws(' · ', CASE WHEN p_partkey % 5 > 0 THEN '卷 ' || p_size END, CASE WHEN p_partkey % 2 > 0 THEN '期 ' || p_partkey END)},
    {'label': '被引', 'value': CASE WHEN p_partkey % 7 = 0 THEN '—' WHEN p_partkey % 2 = 0 OR p_retailprice = floor(p_retailprice) THEN CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) ELSE printf('%.2f', p_retailprice) END}], lambda x: coalesce(x.value, '') <> '') AS l FROM part)
SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, l[i].label AS label, l[i].value AS value FROM (SELECT p_partkey, l, unnest(range(1, len(l) + 1)) AS i FROM v)"""

_ARTICLE = "concat('<PubmedArticle><MedlineCitation Status=\"x\">', case when doc_id % 9 > 0 then concat('<PMID Version=\"1\">', cast(doc_id as {s}), '</PMID>') else '' end, case when doc_id % 6 > 0 then concat('<AbstractText Label=\"A\"><i>A</i> &lt;b&gt; &amp; c: ', text, '</AbstractText><AbstractText>end &#39;x&#39;</AbstractText>') else '<AbstractText> </AbstractText>' end, '</MedlineCitation></PubmedArticle>')"


def xml_abstracts(spark, d):
    """The abstracts of XML texts of four articles each, some without number or abstract."""
    docs = S.table(spark, d, "documents").select("doc_id", F.expr(_ARTICLE.format(s="string")).alias("article"))
    xml = docs.groupBy(F.floor(F.col("doc_id") / 4).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "article"))), lambda x: x["article"]), "\n").alias("xml"))
    return xml.select(F.inline(R.abstracts_of(F.col("xml")))).select(F.col("key").cast("long").alias("pmid"), F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"))


_XML_SQL = f"""SELECT doc_id AS pmid, md5(substr({D.squeeze("'A <b> & c: ' || replace(replace(replace(replace(replace(text, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''') || ' end ''x'''")}, 1, 2500)) AS abstract_md5 FROM documents WHERE doc_id % 9 > 0 AND doc_id % 6 > 0"""


def curated_filter(spark, d):
    """The curated titles that hold a word asked for, for each supplier's words; the list is a literal."""
    s = S.table(spark, d, "supplier").select("s_suppkey", F.expr("case s_suppkey % 5 when 0 then 'atlas  PROTEIN' when 1 then 'trial' when 2 then '' when 3 then s_name else 'data' end").alias("query"))
    words = F.filter(F.split(F.lower("query"), f"{T.SPACE}+"), lambda w: w != "")
    titles = F.array(*[F.lit(t) for t in records._CURATED])
    return s.select("s_suppkey", F.explode(T.let(words, lambda ws: F.filter(titles, lambda t: F.exists(ws, lambda w: F.contains(F.lower(t), w))))).alias("title"))


_CURATED_SQL = f"""WITH q AS (SELECT s_suppkey, lower(CASE s_suppkey % 5 WHEN 0 THEN 'atlas  PROTEIN' WHEN 1 THEN 'trial' WHEN 2 THEN '' WHEN 3 THEN s_name ELSE 'data' END) AS query FROM supplier),
w AS (SELECT s_suppkey, list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '') AS l FROM q), t AS (SELECT s_suppkey, l, unnest([{", ".join(f"'{t}'" for t in records._CURATED)}]) AS title FROM w)
SELECT s_suppkey, title FROM t WHERE len(list_filter(l, lambda w: contains(lower(title), w))) > 0"""


def author_objects(spark, d):
    """Given and family names of display names."""
    c = S.table(spark, d, "customer").select("c_custkey", F.expr("case c_custkey % 4 when 0 then c_name when 1 then concat(' Ada  ', c_mktsegment, ' ', c_name, ' ') when 2 then concat('A ', c_mktsegment) else '' end").alias("name"))
    x = R.author_of(F.col("name"))
    return c.select("c_custkey", x["given"].alias("given"), x["family"].alias("family"))


_AUTHOR_SQL = f"""WITH w AS (SELECT c_custkey, list_filter(regexp_split_to_array(CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN ' Ada  ' || c_mktsegment || ' ' || c_name || ' ' WHEN 2 THEN 'A ' || c_mktsegment ELSE '' END, '{D.SPACE}+'), lambda w: w <> '') AS l FROM customer)
SELECT c_custkey, CASE WHEN len(l) > 1 THEN array_to_string(l[:-2], ' ') END AS given, l[-1] AS family FROM w"""


def year_lists(spark, d):
    """For each source of works: the span of known years with its defaults, whether all or any are cited much, and
    the twelve newest works with a year."""
    w = S.works(spark, d).select("work_id", "container", F.when(F.col("work_id") % 3 > 0, F.col("year")).alias("year"), "cited")
    span = w.groupBy("container").agg(F.coalesce(F.min("year"), F.lit(2000)).alias("first"), F.coalesce(F.max("year"), F.lit(2026)).alias("last"), F.bool_and(F.col("cited") > 1000).alias("all_cited"), F.bool_or(F.col("cited") > 10000).alias("any_cited"))
    newest = L.top(w.where("year is not null"), "container", 12, F.desc("year"), F.asc("work_id")).groupBy("container").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "work_id"))), lambda x: x["work_id"].cast("string")), ",").alias("newest"))
    return span.join(newest, "container", "left")


_YEARS_SQL = """WITH w AS (SELECT doc_id, source AS container, n_chars AS cited, CASE WHEN doc_id % 3 > 0 THEN CAST(1995 + doc_id % 25 AS INTEGER) END AS year FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY container ORDER BY year DESC, doc_id) AS rank FROM w WHERE year IS NOT NULL), n AS (SELECT container, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS newest FROM k WHERE rank <= 12 GROUP BY container)
SELECT container, coalesce(min(year), 2000) AS first, coalesce(max(year), 2026) AS last, bool_and(cited > 1000) AS all_cited, bool_or(cited > 10000) AS any_cited, any_value(newest) AS newest FROM w LEFT JOIN n USING (container) GROUP BY container"""

_TAGGED = "case when doc_id % 6 = 0 then '<jats:p> </jats:p>' when doc_id % 6 = 1 then null else concat('<jats:p>', text, '</jats:p>') end"


def record_rows(spark, d):
    """Documents as records of registry, library and index: years by priority, pages, abstracts, titles, names."""
    x = S.table(spark, d, "documents").select("doc_id", "text", F.expr(_TAGGED).alias("tagged"))
    n = F.col("doc_id").cast("int")
    dates = [F.when(n % k > 0, F.array(F.when(n % j == 0, 0).otherwise(1990 + n % m), F.lit(1))) for k, j, m in ((2, 3, 20), (3, 5, 21), (5, 7, 22))]
    s = F.col("doc_id").cast("string")
    title = F.expr("case doc_id % 5 when 0 then 'Untitled' when 1 then '' when 2 then concat('On ', cast(doc_id as string), '.') when 3 then concat('On ', cast(doc_id as string), ' .. ') end")
    names = F.when(n % 4 > 0, F.array(F.lit("Ada B Lovelace"), F.when(n % 3 > 0, F.concat(F.lit("Name"), s)), F.lit("")))
    return x.select(
        "doc_id",
        R.first_year(*dates).alias("year"),
        R.page_span(F.when(n % 3 > 0, s), F.when(n % 2 > 0, s)).alias("pages"),
        F.md5(R.short_abstract(F.col("tagged")).cast("binary")).alias("abstract_md5"),
        R.index_title(title).alias("title"),
        R.family_first(names).alias("authors"),
    )


_RECORD_SQL = f"""WITH x AS (SELECT doc_id, CAST(doc_id AS INTEGER) AS n, CAST(doc_id AS VARCHAR) AS s, {_TAGGED} AS tagged FROM documents)
SELECT doc_id, coalesce(CASE WHEN n % 2 > 0 AND n % 3 > 0 THEN 1990 + n % 20 END, CASE WHEN n % 3 > 0 AND n % 5 > 0 THEN 1990 + n % 21 END, CASE WHEN n % 5 > 0 AND n % 7 > 0 THEN 1990 + n % 22 END) AS year,
    CASE WHEN n % 3 > 0 THEN s || CASE WHEN n % 2 > 0 THEN '-' || s ELSE '' END END AS pages, md5(nullif(substr({D.squeeze("regexp_replace(tagged, '<[^>]+>', ' ', 'g')")}, 1, 900), '')) AS abstract_md5,
    CASE n % 5 WHEN 2 THEN 'On ' || s WHEN 3 THEN 'On ' || s || ' ..' END AS title, CASE WHEN n % 4 > 0 THEN 'Lovelace Ada B' || CASE WHEN n % 3 > 0 THEN ', Name' || s ELSE '' END END AS authors FROM x"""

QUERIES = {f.__name__: f for f in (identifiers_extract, identifier_kinds, work_resolve, match_evidence, dataset_cite, paper_rows, trial_rows, adverse_event_rows, search_pages, first_extract, user_messages, record_panel, xml_abstracts, curated_filter, author_objects, year_lists, record_rows)}
ORACLES = {
    "identifiers_extract": _IDENTIFIERS_SQL,
    "identifier_kinds": _KINDS_SQL,
    "work_resolve": _RESOLVE_SQL,
    "match_evidence": _EVIDENCE_SQL,
    "dataset_cite": _CITE_SQL,
    "paper_rows": _PAPER_SQL,
    "trial_rows": _TRIAL_SQL,
    "adverse_event_rows": _ADVERSE_SQL,
    "search_pages": _PAGED_SQL,
    "first_extract": _EXTRACT_SQL,
    "user_messages": _MESSAGES_SQL,
    "record_panel": _PANEL_SQL,
    "xml_abstracts": _XML_SQL,
    "curated_filter": _CURATED_SQL,
    "author_objects": _AUTHOR_SQL,
    "year_lists": _YEARS_SQL,
    "record_rows": _RECORD_SQL,
}
