"""Queries: works that a request names by identifier, and quick search rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import labels as Lb
from quillspark.functions import rows as R
from quillspark.functions import text as T
from quillspark.operators import direct as O
from quillspark.operators import linkage as L
from quillspark.operators.federated import NAMES
from quillspark.plans import duck as D
from quillspark.plans import outputs
from quillspark.plans.federated import _LABEL, _YEAR
from quillspark.plans.lookups import _dois_sql
from quillspark.sources import tables as S
from quillspark.sources.staging import Stage

#: Identifiers that requests name: DOIs in two spellings, one of them of a number that may not exist, and a PMID.
_NAMED = "concat(text, ' doi:10.1000/W.', cast(conv_id * 3 + turn as {s}), case when turn % 2 = 0 then concat(', 10.1000/w.', cast(conv_id as {s})) else '' end, case when turn % 4 < 3 then concat(' PMID: ', cast(10000000 + conv_id as {s})) else '' end, case when conv_id % 3 = 0 then concat(' (', cast(1995 + conv_id % 30 as {s}), ')') else '' end)"
_COLUMNS = ("kind", "value", "source_rank", "source", "work_id", "title", "abstract", "authors", "container", "year", "cited", "doi", "pmid", "volume", "issue", "pages")
_LIBRARY, _REGISTRY, _MEDICAL = NAMES[0], NAMES[1], NAMES[3]
#: What the three sources say of a document, as SQL of both engines; t is its first line, a its text as an abstract.
_SOURCES = (
    ("doi", "doc_id % 30 > 2", f"0, '{_LIBRARY}', doc_id, t, a, concat('Harris Paul A., Taylor ', upper(lang)), source, 1995 + doc_id % 25, n_chars, concat('10.1000/w.', n), case when doc_id % 7 > 0 then concat(m) else null end, concat(1 + doc_id % 40), null, case when doc_id % 4 > 0 then concat(doc_id % 90, '-', doc_id % 90 + 7) else '' end"),
    ("doi", "doc_id % 5 > 0", f"1, '{_REGISTRY}', doc_id, concat(t, '.'), case when doc_id % 3 > 0 then a else null end, '—', concat(source, ' J'), case when doc_id % 11 > 0 then 1995 + doc_id % 25 else 0 end, n_chars + 5, concat('10.1000/w.', n), null, concat(1 + doc_id % 40), concat(1 + doc_id % 6), concat(doc_id % 90)"),
    ("pmid", "doc_id % 7 > 0", f"0, '{_MEDICAL}', doc_id, t, a, concat('Duda ', upper(lang)), source, 1995 + doc_id % 25, null, case when doc_id % 2 = 0 then concat('10.1000/w.', n) else null end, concat(m), null, null, null"),
)
_VALUES = {"doi": "concat('10.1000/w.', n)", "pmid": "m"}
_TYPES = dict(zip(_COLUMNS, ("string", "string", "int", "string", "bigint", *["string"] * 4, "int", "bigint", *["string"] * 5)))


def _sources(spark, d):
    """Documents as records of a library, a registry and a medical index."""
    docs = S.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", T.first_line(F.col("text")).alias("t"), F.substring(T.squeeze(F.col("text")), 1, 900).alias("a"), F.col("doc_id").cast("string").alias("n"), (10000000 + F.col("doc_id")).cast("string").alias("m"))
    # A document's records are made in one pass, so that its text is read once.
    record = "struct<" + ", ".join(f"{c}: {t}" for c, t in _TYPES.items()) + ">"
    parts = ", ".join(f"case when {held} then cast(struct('{kind}', {_VALUES[kind]}, {fields}) as {record}) end" for kind, held, fields in _SOURCES)
    return docs.selectExpr(f"inline(array({parts}))").where("kind is not null")


def _marked(segments):
    return F.array_join(F.transform(segments, lambda s: F.when(s["matched"], F.concat(F.lit("«"), s["text"], F.lit("»"))).otherwise(s["text"])), "")


def match_direct(spark, d):
    """The works that each conversation turn names by DOI or PMID, with what speaks for them and their citations."""
    with Stage(spark) as stage:
        asked = S.table(spark, d, "conversations").select("conv_id", "turn", F.expr(_NAMED.format(s="string")).alias("text"))
        found = O.hits(asked, _sources(spark, d), ["conv_id", "turn"], stage)
        md5 = lambda c: F.md5(c.cast("binary"))
        return stage.keep(
            found.select(
                "conv_id", "turn", "rank", "work_id", "score", L.score_label(F.col("score")).alias("label"), "cited", "doi_hit", "pmid_hit", "year_status", T.rounded(F.col("abstract_score")).alias("abstract_score"),
                *[F.array_join(c, ",").alias(c) for c in ("said", "reasons", "sources")], md5(_marked(F.col("title_segments"))).alias("title_md5"), md5(_marked(F.col("query_segments"))).alias("query_md5"), md5(F.array_join("snippets", "\n")).alias("snippets_md5"),
                *[md5(F.col(c)).alias(f"{c}_md5") for c in ("apa", "gbt", "bibtex")],
            )
        )


_FIRSTS = lambda l: f"list_filter({l}, lambda z, i: list_position({l}, z) = i)"
_PMIDS = _FIRSTS(f"regexp_extract_all(text, '(?i)\\bPMID[:{D.SPACE[1:-1]}]*([0-9]{{5,9}})\\b', 1)") + "[:10]"
_ORDER = "source_rank * 1000000000000 + work_id"
_PICK = lambda c, empty: f"arg_min({c}, {_ORDER}) FILTER (WHERE {c} IS NOT NULL{empty}) AS {c}"
_TEXTS = ("title", "abstract", "authors", "container", "doi", "pmid", "volume", "issue", "pages")
_ESCAPED = lambda x: "".join(["replace("] * 8) + x + ", '\\', '\\textbackslash{}')" + "".join(f", '{c}', '\\{c}')" for c in "{}#%&_$")
_DUCK = {"string": "varchar"}
_RECORDS = " UNION ALL ".join(
    f"SELECT {', '.join(f'CAST({c} AS {_DUCK.get(t, t)}) AS {c}' for c, t in _TYPES.items())} FROM (SELECT '{kind}', {_VALUES[kind]}, {fields} FROM docs WHERE {held}) x({', '.join(_COLUMNS)})" for kind, held, fields in _SOURCES
)
_SEGMENTS = lambda name, x: f"""
{name}r AS (SELECT kind, value, bag, regexp_extract_all({x}, '[A-Za-z0-9{D.CJK}]+|[^A-Za-z0-9{D.CJK}]+') AS l FROM w),
{name}e AS (SELECT kind, value, bag, l, unnest(range(1, len(l) + 1)) AS i FROM {name}r),
{name}m AS (SELECT kind, value, i, l[i] AS run, length({D.norm("l[i]")}) >= 2 AND list_contains(bag, {D.norm("l[i]")}) AS matched FROM {name}e),
{name}c AS (SELECT *, coalesce(matched <> lag(matched) OVER z, true) AS fresh FROM {name}m WINDOW z AS (PARTITION BY kind, value ORDER BY i)),
{name}g AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY kind, value ORDER BY i) AS g FROM {name}c),
{name}s AS (SELECT kind, value, g, CASE WHEN any_value(matched) THEN '«' || string_agg(run, '' ORDER BY i) || '»' ELSE string_agg(run, '' ORDER BY i) END AS s FROM {name}g GROUP BY ALL),
{name} AS (SELECT kind, value, md5(string_agg(s, '' ORDER BY g)) AS {name}_md5 FROM {name}s GROUP BY ALL)"""  # noqa: E731
_TIDY = lambda x: f"trim(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '\\.\\s*\\.', '.', 'g'))"
_DIRECT = f"""WITH req AS (SELECT conv_id, turn, {_NAMED.format(s="varchar")} AS text FROM conversations),
ids AS (SELECT DISTINCT conv_id, turn, {_YEAR.format(x="text")} AS year_hint, {_dois_sql("text")} AS ds, {_PMIDS} AS ps FROM req),
a AS (SELECT conv_id, turn, year_hint, 'doi' AS kind, lower(ds[i]) AS value, i - 1 AS place, 'DOI：' || ds[i] AS said, ps[1] AS hint FROM (SELECT *, unnest(range(1, len(ds) + 1)) AS i FROM ids)
    UNION SELECT conv_id, turn, year_hint, 'pmid', lower(ps[i]), 99 + i, 'PMID：' || ps[i], ps[i] FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM ids)),
docs AS (SELECT doc_id, lang, source, n_chars, {D.first_line("text")} AS t, substr({D.squeeze("text")}, 1, 900) AS a, CAST(doc_id AS VARCHAR) AS n, CAST(10000000 + doc_id AS VARCHAR) AS m FROM documents),
rec AS ({_RECORDS}),
held AS (SELECT * FROM rec WHERE coalesce(title, '') <> '' AND EXISTS (FROM a WHERE a.kind = rec.kind AND a.value = rec.value)),
w0 AS (SELECT kind, value, arg_min(work_id, {_ORDER}) AS work_id, {", ".join(_PICK(c, f" AND {c} NOT IN ('', '—')") for c in _TEXTS)}, {_PICK("year", " AND year <> 0")}, max(cited) AS cited, list(source ORDER BY source_rank, work_id) AS so FROM held GROUP BY ALL),
w AS MATERIALIZED (SELECT * EXCLUDE (so), {_FIRSTS("so")} AS so, {D.tokens("title")} AS bag, {D.tokens("coalesce(abstract, '')")} AS abag, {D.norm("title")} AS nt FROM w0),
f AS (SELECT *, CASE WHEN nt = '' THEN 0.0 ELSE 1.0 END AS title_score, {D.harmonic(D.share("bag", "abag"), D.share("abag", "bag"))} AS abstract_score, coalesce(nullif(lower(doi), ''), nt) AS work_key FROM w),{_SEGMENTS("title", "title")},{_SEGMENTS("query", "substr(title, 1, 280)")},
sq AS (SELECT kind, value, {D.tokens("title", 3)} AS q, list_filter(list_transform(string_split(regexp_replace(coalesce(abstract, ''), '([.。!！?？;；]){D.SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {D.strip("s")}), lambda s: length(s) > 20) AS l FROM w),
sr AS (SELECT kind, value, i, s, len(list_filter(t, lambda x: list_contains(q, x))) AS hit, len(t) AS n FROM (SELECT kind, value, q, i, l[i] AS s, {D.tokens("l[i]", 3)} AS t FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM sq)) WHERE len(q) > 0),
sk AS (SELECT *, row_number() OVER (PARTITION BY kind, value ORDER BY hit DESC, CASE WHEN n > 0 THEN hit / n ELSE 0 END DESC, i) AS rank FROM sr WHERE hit >= 2 OR (n > 0 AND hit / n >= 0.25)),
sn AS (SELECT kind, value, count(*) AS n_snippets, string_agg(CASE WHEN length(s) > 180 THEN substr(s, 1, 180) || '…' ELSE s END, chr(10) ORDER BY rank) AS snippets FROM sk WHERE rank <= 3 GROUP BY ALL),
h0 AS (SELECT a.*, work_id, year, cited, so, title_score, abstract_score, work_key, kind = 'doi' AS doi_hit, coalesce(pmid = hint, false) AS pmid_hit, abs(year_hint - year) AS gap, coalesce(n_snippets, 0) AS n_snippets FROM a JOIN f USING (kind, value) LEFT JOIN sn USING (kind, value)),
h1 AS (SELECT *, title_score * 0.88 + abstract_score * 0.08 AS s FROM h0),
h2 AS (SELECT * EXCLUDE s, CASE WHEN title_score >= 0.97 THEN greatest(s, 0.98) ELSE s END AS s FROM h1),
h3 AS (SELECT * EXCLUDE s, CASE WHEN gap = 0 THEN least(1.0, s + 0.03) WHEN gap > 2 THEN s * 0.85 ELSE s END AS s FROM h2),
h4 AS (SELECT * EXCLUDE s, CASE WHEN len(so) > 1 THEN least(1.0, s + 0.02) ELSE s END AS s FROM h3),
h5 AS (SELECT * EXCLUDE s, least(1.0, CASE WHEN doi_hit THEN greatest(s, 0.99) ELSE s END + least(0.02, log10(coalesce(cited, 0) + 1) / 200)) AS s FROM h4),
h6 AS (SELECT *, {D.rounded("s", 2)} AS score, coalesce(cited, 0) AS c, CASE WHEN gap = 0 THEN 'exact' WHEN gap <= 2 THEN 'near' WHEN gap > 2 THEN 'mismatch' ELSE 'none' END AS year_status FROM h5 WHERE s >= 0.42),
h7 AS (SELECT *, list_filter([CASE WHEN doi_hit THEN 'DOI 直达' END, CASE WHEN pmid_hit THEN 'PMID 一致' END, CASE WHEN title_score >= 0.45 THEN '标题 100%' END, CASE WHEN abstract_score >= 0.2 THEN '摘要重叠 ' || CAST(floor(abstract_score * 100 + 0.5) AS INTEGER) || '%' END,
    CASE year_status WHEN 'exact' THEN '年份一致' WHEN 'near' THEN '年份接近' WHEN 'mismatch' THEN '年份不符' END, '命中 1 句'], lambda r: r IS NOT NULL) AS why FROM h6),
g AS (SELECT conv_id, turn, work_key, max(score) AS score, {", ".join(f"arg_max({c}, round(score * 100) * 1000 + place) AS {c}" for c in ("c", "place", "kind", "value", "doi_hit", "pmid_hit", "year_status"))}, list(said ORDER BY score DESC, place DESC) AS said, flatten(list(why ORDER BY score DESC, place DESC)) AS why, flatten(list(so ORDER BY score DESC, place DESC)) AS so,
    list({{'kind': kind, 'value': value}} ORDER BY n_snippets DESC, score DESC, place DESC)[1] AS fullest FROM h7 GROUP BY conv_id, turn, work_key),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, c DESC, place, work_key) AS rank FROM g),
o AS (SELECT kind, value, {D.squeeze("title")} AS t, coalesce(container, '') AS c, coalesce(CAST(year AS VARCHAR), 'n.d.') AS y, coalesce(volume, '') AS v, coalesce(issue, '') AS n, coalesce(pages, '') AS p, coalesce(doi, '') AS d, authors, split_part(coalesce(authors, ''), ' ', 1) AS family, right(coalesce(authors, ''), 2) AS given FROM w),
e AS (SELECT *, v || CASE WHEN n <> '' THEN '(' || n || ')' ELSE '' END AS num, CASE WHEN family = 'Harris' THEN 'Harris, P. A., & Taylor, ' || given[1] || '.' WHEN family = 'Duda' THEN 'Duda, ' || given[1] || '.' ELSE 'Unknown' END AS aa, CASE WHEN family = 'Harris' THEN 'Harris PA, Taylor ' || given[1] WHEN family = 'Duda' THEN 'Duda ' || given[1] ELSE 'Unknown' END AS ag,
    CASE WHEN family = 'Harris' THEN 'Harris, Paul A. and Taylor, ' || given WHEN family = 'Duda' THEN 'Duda, ' || given ELSE 'Unknown' END AS ab FROM o),
st AS (SELECT kind, value, md5({_TIDY("aa || ' (' || y || '). ' || t || '.' || CASE WHEN c || v || p <> '' THEN ' ' || array_to_string(list_filter([c, CASE WHEN v <> '' THEN num ELSE '' END, p], lambda x: x <> ''), ', ') || '.' ELSE '' END || CASE WHEN d <> '' THEN ' https://doi.org/' || d ELSE '' END")}) AS apa_md5,
    md5({_TIDY("ag || '. ' || t || '[J]. ' || CASE WHEN c <> '' THEN c || ', ' ELSE '' END || y || CASE WHEN v <> '' THEN ', ' || num ELSE '' END || CASE WHEN p <> '' THEN ': ' || p ELSE '' END || CASE WHEN d <> '' THEN '. DOI: ' || d ELSE '' END || '.'")}) AS gbt_md5,
    md5('@article{{' || substr(CASE WHEN family <> '' THEN family ELSE 'ref' END || y || right(regexp_replace(CASE WHEN d <> '' THEN d ELSE t END, '[^a-zA-Z0-9]', '', 'g'), 8), 1, 40) || ',' || chr(10) || array_to_string(list_filter(['  title={{' || {_ESCAPED("t")} || '}}', '  author={{' || {_ESCAPED("ab")} || '}}', CASE WHEN c <> '' THEN '  journal={{' || {_ESCAPED("c")} || '}}' END, '  year={{' || y || '}}',
    CASE WHEN v <> '' THEN '  volume={{' || v || '}}' END, CASE WHEN n <> '' THEN '  number={{' || n || '}}' END, CASE WHEN p <> '' THEN '  pages={{' || p || '}}' END, CASE WHEN d <> '' THEN '  doi={{' || {_ESCAPED("d")} || '}}' END], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}}') AS bibtex_md5 FROM e)
SELECT conv_id, turn, CAST(rank AS INTEGER) AS rank, f.work_id, score, {_LABEL} AS label, b.c AS cited, doi_hit, pmid_hit, year_status, {D.rounded("abstract_score")} AS abstract_score, array_to_string({_FIRSTS("b.said")}[:4], ',') AS said, array_to_string({_FIRSTS("b.why")}[:8], ',') AS reasons, array_to_string({_FIRSTS("b.so")}, ',') AS sources,
    title_md5, query_md5, md5(coalesce(snippets, '')) AS snippets_md5, apa_md5, gbt_md5, bibtex_md5 FROM b JOIN f USING (kind, value) JOIN title USING (kind, value) JOIN query USING (kind, value) JOIN st USING (kind, value) LEFT JOIN sn ON sn.kind = fullest.kind AND sn.value = fullest.value WHERE rank <= 12"""


#: A fourth of the items is asked for by DOI, an eighth by PMID, the others by their first line.
_QUICK = "case when item_id % 4 = 0 then concat(' 10.1000/w.', cast(item_id * 3 as {s})) when item_id % 8 = 1 then concat('PMID: ', cast(10000000 + item_id * 5 as {s})) else {line} end"


def quick_search(spark, d):
    """What a search box shows for each benchmark item: the work of an identifier alone, or the 8 best works of a
    library in one language, supplemented by a medical index where they are fewer than 3."""
    asks = S.table(spark, d, "benchmark").withColumn("line", T.first_line(F.col("text"))).select("item_id", F.expr(_QUICK.format(s="string", line="line")).alias("query"))
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("work_id"), "lang", "source", F.col("n_chars").alias("cited"), "text", T.first_line(F.col("text")).alias("title"), F.when(F.col("doc_id") % 30 > 2, F.concat(F.lit("10.1000/w."), F.col("doc_id").cast("string"))).alias("doi"), F.when(F.col("doc_id") % 7 > 0, (10000000 + F.col("doc_id")).cast("string")).alias("pmid"))
    found = O.quick(asks, docs, docs.where("lang = 'de'"), docs.where("pmid is not null"), "item_id")
    rows = found.join(docs.drop("pmid"), "work_id")
    index = F.col("origin") == "index"
    title = R.or_else(F.col("title"), "Untitled")
    names = F.transform(F.sequence(F.lit(1), (F.col("work_id") % 7).cast("int") + 1), lambda i: F.concat(F.lit("Name "), i.cast("string")))
    blob = F.when(index, F.concat_ws(" ", title, F.lit("review"), F.substring("text", 1, 280))).otherwise(title)
    return rows.select(
        "item_id", "place", "origin", "work_id", F.md5(title.cast("binary")).alias("title_md5"), (F.col("work_id") % 25 + 1995).cast("int").alias("year"), F.when(index, F.col("cited")).otherwise(0).alias("cited"), F.when(index, R.first_authors(names)).otherwise("—").alias("authors"),
        F.col("source").alias("venue"), F.when(index, F.col("doi")).alias("doi"), "pmid", F.array_join(Lb.evidence_tags(blob), ",").alias("evidence"),
    )


_SEARCH = lambda name, held, k: f"""
{name}d AS (SELECT work_id, {D.tokens("title")} AS bag FROM w WHERE {held}), {name}n AS (SELECT count(*) AS n, avg(len(bag)) AS mean FROM {name}d),
{name}i AS (SELECT work_id, size, token, count(*) AS times FROM (SELECT work_id, len(bag) AS size, unnest(bag) AS token FROM {name}d) GROUP BY ALL), {name}f AS (SELECT token, count(*) AS df FROM {name}i GROUP BY token),
{name}s AS (SELECT item_id, work_id, {D.rounded("sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * size / mean)))")} AS score FROM qt JOIN {name}i USING (token) JOIN {name}f USING (token), {name}n GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT item_id, work_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, work_id) AS pos FROM {name}s) JOIN (SELECT work_id, pmid FROM w) USING (work_id) WHERE pos <= {k})"""  # noqa: E731
_QUICK_SQL = f"""WITH a AS (SELECT item_id, {D.strip(_QUICK.format(s="varchar", line=D.first_line("text")))} AS query FROM benchmark),
w AS (SELECT doc_id AS work_id, lang, source, n_chars AS cited, text, {D.first_line("text")} AS title, CASE WHEN doc_id % 30 > 2 THEN '10.1000/w.' || doc_id END AS doi, CASE WHEN doc_id % 7 > 0 THEN CAST(10000000 + doc_id AS VARCHAR) END AS pmid FROM documents),
one AS (SELECT item_id, min(work_id) AS work_id FROM a JOIN w ON query = doi OR regexp_replace(query, '^PMID: ', '') = pmid GROUP BY item_id),
qt AS (SELECT DISTINCT item_id, unnest({D.tokens("query")}) AS token FROM a WHERE item_id NOT IN (SELECT item_id FROM one) AND length(query) >= 2),{_SEARCH("x", "lang = 'de'", 8)},{_SEARCH("y", "pmid IS NOT NULL", 5)},
z AS (SELECT item_id, work_id, 'index' AS origin, pos FROM x UNION ALL SELECT item_id, work_id, 'medical', 100 + pos FROM y WHERE (SELECT count(*) FROM x WHERE x.item_id = y.item_id) < 3 AND NOT EXISTS (FROM x WHERE x.item_id = y.item_id AND x.pmid = y.pmid)),
r AS (SELECT item_id, work_id, origin, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS place FROM z UNION ALL SELECT item_id, work_id, 'index', 1 FROM one),
t AS (SELECT *, CASE WHEN title = '' THEN 'Untitled' ELSE coalesce(title, 'Untitled') END AS shown FROM r JOIN w USING (work_id)), u AS (SELECT *, lower(CASE WHEN origin = 'index' THEN shown || ' review ' || substr(text, 1, 280) ELSE shown END) AS b FROM t)
SELECT item_id, CAST(place AS INTEGER) AS place, origin, work_id, md5(shown) AS title_md5, CAST(1995 + work_id % 25 AS INTEGER) AS year, CASE WHEN origin = 'index' THEN cited ELSE 0 END AS cited, CASE WHEN origin = 'index' THEN array_to_string(list_transform(range(1, least(5, work_id % 7 + 1) + 1), lambda i: 'Name ' || i), ', ') ELSE '—' END AS authors,
    source AS venue, CASE WHEN origin = 'index' THEN doi END AS doi, pmid, array_to_string(list_filter([{outputs._TAGS}], lambda x: x IS NOT NULL)[:4], ',') AS evidence FROM u WHERE place <= 10"""


QUERIES = {"match_direct": match_direct, "quick_search": quick_search}

ORACLES = {"match_direct": _DIRECT, "quick_search": _QUICK_SQL}
