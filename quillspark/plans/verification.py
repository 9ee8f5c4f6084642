"""Queries: reading and verifying references that are generated from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import references as R
from quillspark.functions import similarity as sim
from quillspark.functions import text as T
from quillspark.operators import verify as V
from quillspark.plans import duck as D
from quillspark.sources import tables as S
from quillspark.sources.staging import Stage

_FAMILIES = ("Harris", "Taylor", "Minor", "Elliott", "Fernandez", "Duda", "Kirby", "Okafor", "Lindqvist", "Baden")

#: SQL of the works and references made of documents, for both engines; {0} is the relation.
_TITLE = "trim(regexp_replace(substr(text, 1, 90), '[^A-Za-z]+', ' '{g}))"
_WORKS = (
    "SELECT doc_id, concat('Study ', cast(doc_id as {s}), ' ', "
    + _TITLE
    + ") AS title, concat("
    + "case "
    + " ".join(f"when doc_id % 10 = {i} then '{f}'" for i, f in enumerate(_FAMILIES))
    + " end, ' ', substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(doc_id % 26 + 1 as int), 1)) AS first_author, cast(1995 + doc_id % 25 as int) AS year, concat('Journal of ', source) AS container, "
    "cast(doc_id % 90 + 1 as {s}) AS volume, cast(doc_id % 12 + 1 as {s}) AS issue, concat(cast(doc_id % 900 + 1 as {s}), '-', cast(doc_id % 900 + 9 as {s})) AS pages, "
    "concat('10.1000/doc.', cast(doc_id as {s})) AS doi, cast(doc_id + 1000000 as {s}) AS pmid FROM {t}"
)
#: doc_id % 6: as it is, a wrong year, an unknown DOI, a PMID only, no identifier, half a title.
_REFS = (
    "SELECT doc_id AS ref_id, concat('[', cast(doc_id as {s}), '] ', first_author, ', Other B. ', case when doc_id % 6 = 5 then substr(title, 1, cast(floor(length(title) / 2) as int)) else title end, '. ', container, '. ', "
    "cast(year + case when doc_id % 6 = 1 then 3 else 0 end as {s}), ';', volume, '(', issue, '):', pages, '.', "
    "case when doc_id % 6 in (0, 1, 5) then concat(' doi:', doi, '.') when doc_id % 6 = 2 then concat(' doi:10.9999/none.', cast(doc_id as {s})) when doc_id % 6 = 3 then concat(' PMID: ', pmid, '.') else '' end) AS raw FROM {t}"
)


def _works(spark, d):
    S.table(spark, d, "documents").createOrReplaceTempView("quillspark_documents")
    return spark.sql(_WORKS.format(t="quillspark_documents", s="string", g=""))


def _refs(works):
    works.createOrReplaceTempView("quillspark_works")
    return R.read(works.sparkSession.sql(_REFS.format(t="quillspark_works", s="string")))


def refs(spark, d):
    return _refs(_works(spark, d))


def _sources(w):
    thin = F.when(F.col("doc_id") % 4 == 0, F.lit(None))
    registry = w.where("doc_id % 7 <> 6").withColumns({"volume": thin.otherwise(F.col("volume")), "pmid": F.lit(None).cast("string")})
    return registry, w.where("doc_id % 5 <> 4"), w.where("doc_id % 11 = 0"), w.where("doc_id % 3 = 0")


def _resolved(spark, d):
    with Stage(spark) as stage:  # else every source reads the texts of all documents
        w = stage(_works(spark, d))
        return V.resolve(_refs(w), *_sources(w))


def verify_field_checks(spark, d):
    return V.field_checks(_resolved(spark, d))


def verify_status(spark, d):
    return V.status(_resolved(spark, d))


_DUCK_WORKS = _WORKS.format(t="documents", s="varchar", g=", 'g'")
_HINTED = R.duck(f"({_REFS.format(t='(' + _DUCK_WORKS + ')', s='varchar')})")


def verify_diffs(spark, d):
    return V.diffs(_resolved(spark, d))


def verify_lists(spark, d):
    """The summary of each list of fifteen references."""
    return V.summary(verify_status(spark, d).withColumn("list_id", F.floor(F.col("ref_id") / 15)), "list_id").withColumn("review_refs", F.array_join(F.col("review_refs").cast("array<string>"), ","))


def author_match(spark, d):
    """Customer names against the next one's: family name and number as given name."""
    c = S.table(spark, d, "customer").select("c_custkey", F.regexp_replace("c_name", "#0*", " A").alias("a"), F.regexp_replace(F.concat(F.lit("Customer B"), ((F.col("c_custkey") + 1) % 7).cast("string")), "B[0-3]", "A").alias("b"))
    return c.select("c_custkey", T.rounded(sim.author_match(F.col("a"), F.col("b"))).alias("score"))


def journal_match(spark, d):
    """Abbreviated part names against full ones."""
    p = S.table(spark, d, "part").select("p_partkey", F.concat("p_type", F.lit(" "), "p_name").alias("full"))
    short = F.array_join(F.transform(F.split("full", " "), lambda w: F.substring(w, 1, 3)), " ")
    cited = F.when(F.col("p_partkey") % 3 == 0, F.element_at(F.split("full", " "), 1)).otherwise(short)
    return p.select("p_partkey", T.rounded(sim.journal_match(cited, F.col("full"))).alias("score"))


def candidate_composite(spark, d):
    """Candidates of the references without identifiers, in all sources."""
    with Stage(spark) as stage:
        w = stage(_works(spark, d))
        asked = _refs(w).where("cited_doi is null and cited_pmid is null")
        found = V.title_candidates(asked, V.every_work(dict(zip(("registry", "library", "data", "medical"), _sources(w), strict=True))), k=3)
    return found.select("ref_id", "rank", "found.doi", T.rounded(F.col("composite")).alias("composite"), T.rounded(F.col("title_score")).alias("title_score"))


QUERIES = {
    "ref_generate_extract": lambda spark, d: refs(spark, d).select("ref_id", "cited_doi", "cited_pmid", "cited_year"),
    "ref_biblio_hints": lambda spark, d: refs(spark, d).select("ref_id", "cited_journal", "cited_volume", "cited_issue", "cited_pages"),
    "ref_title": lambda spark, d: refs(spark, d).select("ref_id", "cited_title"),
    "ref_first_author": lambda spark, d: refs(spark, d).select("ref_id", "cited_author"),
    "author_match": author_match,
    "journal_match": journal_match,
    "candidate_composite": candidate_composite,
    "verify_field_checks": verify_field_checks,
    "verify_status": verify_status,
    "verify_summary": lambda spark, d: V.summary(verify_status(spark, d)),
    "verify_lists": verify_lists,
    "verify_diffs": verify_diffs,
    "verify_sources": lambda spark, d: V.source_histogram(_resolved(spark, d)),
    "verify_drift_histogram": lambda spark, d: V.drift_histogram(verify_status(spark, d)),
}


def _author_sql(a: str, b: str) -> str:
    """Score of names of the form 'Family X..', where no given name is cited without a family name."""
    parts = lambda x: f"list_filter(string_split({D.norm(x)}, ' '), lambda p: p <> '')"
    family = f"coalesce(list_filter({parts(a)}, lambda p: length(p) > 2)[1], {parts(a)}[1], '')"
    rest = f"list_filter({parts(a)}, lambda p: p <> {family})"
    other = f"list_filter({parts(b)}, lambda p: p <> {family})"
    first = lambda l: f"array_to_string(list_transform({l}, lambda p: substr(p, 1, 1)), '')"
    compact = f"regexp_replace(array_to_string({rest}, ''), '[^a-z{D.CJK}]', '', 'g')"
    own = f"CASE WHEN len({rest}) = 0 THEN '' WHEN length({compact}) <= 4 AND len(list_filter({rest}, lambda p: length(p) > 2)) = 0 THEN {compact} ELSE {first(rest)} END"
    return f"CASE WHEN coalesce({D.strip(a)}, '') = '' THEN 1.0 WHEN coalesce({D.strip(b)}, '') = '' THEN 0.0 WHEN {family} = '' OR NOT contains({D.norm(b)}, {family}) THEN 0.0 WHEN ({own}) = '' THEN 1.0 WHEN len({other}) = 0 THEN 0.85 WHEN ({own}) = {first(other)} THEN 1.0 WHEN length({own}) = 1 AND substr({other}[1], 1, 1) = ({own}) THEN 1.0 ELSE 0.2 END"


_STOPS = ", ".join(f"'{w}'" for w in sim.JOURNAL_STOPS)


def _journal_sql(relation: str, cited: str, full: str, out: str) -> str:
    """relation with a column for how well the journal names match: the cited one's words are taken in
    order, each for the first later word of the full name that it may abbreviate."""
    words = lambda n, least: f"list_filter(string_split({n}, ' '), lambda w: length(w) >= {least} AND w NOT IN ({_STOPS}))"
    fits = "(starts_with(_wb[j + 1], t) OR (length(t) > 1 AND starts_with(t, _wb[j + 1])) OR (length(t) >= 2 AND starts_with(_wb[j + 1], substr(t, 1, 2))))"
    later = f"list_filter(range(len(_wb)), lambda j: j >= s.at AND {fits})[1]"
    named = f"(SELECT *, {D.norm(cited)} AS _na, {D.norm(full)} AS _nb, {D.tokens(cited)} AS _ta, {D.tokens(full)} AS _tb FROM {relation})"
    split = f"(SELECT *, {words('_na', 1)} AS _wa, {words('_nb', 2)} AS _wb, {D.share('_ta', '_tb')} AS _p, {D.share('_tb', '_ta')} AS _r, len(list_filter(_tb[1:2], lambda w: NOT list_contains(_ta, w))) > 0 AS _lost FROM {named})"
    counted = f"(SELECT *, {D.harmonic('_p', '_r')} AS _f1, list_reduce(_wa, lambda s, t: CASE WHEN {later} IS NULL THEN s ELSE {{'at': CAST({later} + 1 AS BIGINT), 'hits': s.hits + 1}} END, {{'at': CAST(0 AS BIGINT), 'hits': 0}}).hits AS _hits FROM {split})"
    score = (
        f"CASE WHEN _na = '' OR _nb = '' OR _na = _nb THEN 1.0 WHEN contains(_nb, _na) AND length(_na) >= least(14, floor(length(_nb) * 0.45)) THEN 0.95 WHEN contains(_na, _nb) AND length(_nb) >= 8 THEN 0.95 "
        f"WHEN len(_wa) = 0 OR len(_wb) = 0 THEN 0.0 WHEN _hits / len(_wa) >= 0.8 AND _hits / len(_wb) >= 0.8 THEN 0.93 WHEN _hits / len(_wa) >= 0.65 AND _hits / len(_wb) < 0.8 THEN 0.45 "
        f"ELSE {D.similarity('_na', '_nb', '_f1', True, '_lost', '_p', '_r')} END"
    )
    return f"(SELECT * EXCLUDE (_na, _nb, _ta, _tb, _wa, _wb, _p, _r, _lost, _f1, _hits), {score} AS {out} FROM {counted})"


_FIELDS = ("title", "first_author", "year", "container", "volume", "issue", "pages", "doi", "pmid")


def _pack(values: dict[str, str]) -> str:
    return "struct_pack(" + ", ".join(f"{f} := {values[f]}" for f in _FIELDS) + ")"


def _some(x: str, field: str) -> str:
    return x if field == "year" else f"nullif({x}, '')"


def _over(a: str, b: str) -> str:
    """Record b over record a."""
    both = {f: f"coalesce({_some(f'{a}.{f}', f)}, {b}.{f})" if f == "pmid" else f"coalesce({_some(f'{b}.{f}', f)}, {a}.{f})" for f in _FIELDS}
    return f"CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} ELSE {_pack(both)} END"


def _fill(a: str, b: str, missing: tuple[str, ...], pmid: bool = False) -> str:
    value = {f: f"coalesce({_some(f'{a}.{f}', f)}, {b}.{f})" if f in missing else f"{a}.{f}" for f in _FIELDS}
    return _pack(value | ({"pmid": f"coalesce({b}.pmid, {a}.pmid)"} if pmid else {}))


def _source(rank: int, name: str, where: str, **other: str) -> str:
    rec = _pack({f: other.get(f, f) for f in _FIELDS})
    return f"{name} AS (SELECT {rank} AS n, '{name}' AS source, {rec} AS rec, lower(doi) AS doi, {other.get('pmid', 'pmid')} AS pmid FROM w WHERE {where})"


_SOURCE_CTES = ",\n".join(
    [
        _source(0, "library", "doc_id % 5 <> 4"),
        _source(1, "medical", "doc_id % 3 = 0"),
        _source(2, "registry", "doc_id % 7 <> 6", volume="CASE WHEN doc_id % 4 <> 0 THEN volume END", pmid="CAST(NULL AS VARCHAR)"),
        _source(3, "data", "doc_id % 11 = 0"),
    ]
)
_LATEST = ", ".join(f"arg_max(rec.{f}, n) FILTER (WHERE {_some(f'rec.{f}', f)} IS NOT NULL) AS {f}" if f != "pmid" else "arg_min(rec.pmid, n) FILTER (WHERE nullif(rec.pmid, '') IS NOT NULL) AS pmid" for f in _FIELDS)
_WORK_KEY = f"coalesce('doi:' || doi, 'pmid:' || pmid, 't:' || substr({D.norm('rec.title')}, 1, 80))"
_BLANK = lambda c: f"coalesce({c}, '') = ''"

_COMPOSITE = f"""CASE WHEN title_score < 0.55 THEN 0.0
    WHEN NOT {_BLANK("cited_author")} AND author < 0.5 AND title_score < 0.93 THEN least(title_score * 0.35, 0.4)
    WHEN NOT {_BLANK("cited_year")} AND years = 0 AND title_score < 0.96 THEN least(title_score * 0.4, 0.45)
    ELSE title_score * (1 - aw - yw - jw) + author * aw + years * yw + journal * jw END"""


def _candidates_sql(asked: str, k: int) -> str:
    """CTEs that end in `best`: the k best works for the references of the relation `asked`."""
    scored = f"""(SELECT f.*, {D.similarity("na", "nb", "f1", True, "lost", "p", "r")} AS title_score FROM f)"""
    journal = _journal_sql(f"(SELECT * FROM {scored} WHERE title_score >= 0.35)", "cited_journal", "rec.container", "journal_score")
    return f"""
every AS (SELECT key, {_pack({f: f for f in _FIELDS})} AS rec, held FROM (SELECT {_WORK_KEY} AS key, {_LATEST}, list(source ORDER BY n) AS held FROM (SELECT * FROM library UNION ALL SELECT * FROM medical UNION ALL SELECT * FROM registry UNION ALL SELECT * FROM data) GROUP BY ALL)),
a AS (SELECT ref_id, cited_doi, cited_title, cited_author, cited_year, cited_journal, {D.norm("cited_title")} AS na, {D.tokens("cited_title")} AS ta FROM ({asked}) WHERE length(cited_title) >= 12),
v AS (SELECT *, {D.norm("rec.title")} AS nb, {D.tokens("rec.title")} AS tb FROM every),
ac AS (SELECT ref_id, len(ta) AS size, token, count(*) AS times FROM (SELECT ref_id, ta, unnest(ta) AS token FROM a) GROUP BY ALL),
vc AS (SELECT key, len(tb) AS size, token, count(*) AS times FROM (SELECT key, tb, unnest(tb) AS token FROM v) GROUP BY ALL),
pr AS (SELECT ref_id, key, sum(ac.times) / any_value(ac.size) AS p, sum(vc.times) / any_value(vc.size) AS r FROM ac JOIN vc USING (token) GROUP BY ALL HAVING p + r > 0.5),
f AS (SELECT a.*, v.*, p, r, {D.harmonic("p", "r")} AS f1, len(list_filter(tb[1:2], lambda x: NOT list_contains(ta, x))) > 0 AS lost FROM pr JOIN a USING (ref_id) JOIN v USING (key)),
g AS (SELECT *, {_author_sql("cited_author", "rec.first_author")} AS author, CASE WHEN {_BLANK("cited_journal")} OR rec.container IS NULL THEN 1.0 ELSE journal_score END AS journal,
    CASE WHEN {_BLANK("cited_year")} OR rec.year IS NULL THEN 1.0 WHEN TRY_CAST(cited_year AS INTEGER) IS NULL THEN 0.5 WHEN TRY_CAST(cited_year AS INTEGER) = rec.year THEN 1.0 WHEN abs(TRY_CAST(cited_year AS INTEGER) - rec.year) = 1 THEN 0.4 ELSE 0.0 END AS years,
    CASE WHEN {_BLANK("cited_author")} THEN 0.08 ELSE 0.22 END AS aw, CASE WHEN {_BLANK("cited_year")} THEN 0.08 ELSE 0.15 END AS yw, CASE WHEN {_BLANK("cited_journal")} THEN 0.04 ELSE 0.08 END AS jw FROM {journal}),
c AS (SELECT *, {D.rounded(_COMPOSITE, 9)} AS composite FROM g),
e AS (SELECT *, CASE WHEN cited_doi IS NULL THEN composite ELSE title_score END AS rating FROM c),
best AS (SELECT * FROM (SELECT ref_id, rec, held, composite, title_score, row_number() OVER (PARTITION BY ref_id ORDER BY rating DESC, key) AS rank FROM e WHERE rating >= CASE WHEN cited_doi IS NULL THEN 0.5 ELSE 0.45 END) WHERE rank <= {k})"""


_BY_DOI = ("first_author", "container", "volume", "issue", "pages")
_NONE = "CAST(NULL AS VARCHAR)"
_RESOLVED = f"""
b AS MATERIALIZED (SELECT ref_id, cited_doi, cited_pmid, cited_year, cited_title, cited_author, cited_journal, cited_volume, cited_issue, cited_pages FROM {_HINTED}),
w AS (SELECT * FROM ({_DUCK_WORKS})),
{_SOURCE_CTES},
k AS MATERIALIZED (SELECT b.*, r.rec AS r, l.rec AS l, d.rec AS d, m.rec AS m, p.rec AS p FROM b LEFT JOIN registry r ON r.doi = lower(cited_doi) LEFT JOIN library l ON l.doi = lower(cited_doi) LEFT JOIN data d ON d.doi = lower(cited_doi)
    LEFT JOIN medical m ON cited_doi IS NULL AND m.pmid = cited_pmid LEFT JOIN library p ON cited_doi IS NULL AND p.pmid = cited_pmid),
{_candidates_sql("SELECT * FROM k WHERE r IS NULL AND l IS NULL AND d IS NULL AND m IS NULL AND p IS NULL", 1)},
x AS (SELECT k.*, best.rec AS f, held, composite, title_score, {_over("k.m", "k.p")} AS pair, cited_doi IS NULL AND cited_pmid IS NULL AS named FROM k LEFT JOIN best USING (ref_id)),
y AS (SELECT *, CASE WHEN cited_doi IS NULL THEN lower(coalesce(pair.doi, CASE WHEN named THEN f.doi END)) END AS again, CASE WHEN named AND f.doi IS NULL THEN f.pmid END AS again_pmid FROM x),
z AS (SELECT y.*, r2.rec AS r2, l2.rec AS l2, m2.rec AS m2, p2.rec AS p2 FROM y LEFT JOIN registry r2 ON r2.doi = again LEFT JOIN library l2 ON named AND l2.doi = again LEFT JOIN medical m2 ON m2.pmid = again_pmid LEFT JOIN library p2 ON p2.pmid = again_pmid),
z1 AS (SELECT *, CASE WHEN cited_doi IS NOT NULL THEN CASE WHEN r IS NOT NULL THEN 'registry' WHEN d IS NOT NULL THEN 'data' WHEN l IS NOT NULL THEN 'library' ELSE 'dead_doi' END
    WHEN cited_pmid IS NOT NULL THEN CASE WHEN pair IS NOT NULL THEN 'pmid' ELSE 'dead_pmid' END WHEN coalesce(length(cited_title), 0) < 12 THEN 'no_anchor' WHEN f IS NULL OR composite < 0.55 THEN 'no_match' ELSE 'title' END AS branch,
    {_over("pair", "r2")} AS by_pmid, {_over("f", "r2")} AS f2, {_over("m2", "p2")} AS f3 FROM z),
z2 AS (SELECT *, {_over("f2", "l2")} AS f4, {_over("f", "f3")} AS f5 FROM z1),
s AS MATERIALIZED (SELECT ref_id, cited_doi, cited_pmid, cited_year, cited_title, cited_author, cited_journal, cited_volume, cited_issue, cited_pages, branch, composite, title_score,
    CASE branch WHEN 'registry' THEN l IS NOT NULL OR d IS NOT NULL WHEN 'pmid' THEN (m IS NOT NULL AND p IS NOT NULL) OR r2 IS NOT NULL WHEN 'title' THEN len(held) > 1 OR r2 IS NOT NULL OR l2 IS NOT NULL OR (m2 IS NOT NULL AND p2 IS NOT NULL) ELSE false END AS second,
    CASE branch WHEN 'registry' THEN list_filter(['registry', CASE WHEN l IS NOT NULL THEN 'library' END, CASE WHEN l IS NULL AND d IS NOT NULL THEN 'data' END], lambda i: i IS NOT NULL) WHEN 'data' THEN ['data'] WHEN 'library' THEN ['library']
        WHEN 'pmid' THEN list_filter([CASE WHEN m IS NOT NULL THEN 'medical' END, CASE WHEN p IS NOT NULL THEN 'library' END, CASE WHEN r2 IS NOT NULL THEN 'registry' END], lambda i: i IS NOT NULL)
        WHEN 'title' THEN list_distinct(list_filter(list_concat(held, [CASE WHEN r2 IS NOT NULL THEN 'registry' END, CASE WHEN l2 IS NOT NULL OR p2 IS NOT NULL THEN 'library' END, CASE WHEN m2 IS NOT NULL THEN 'medical' END]), lambda i: i IS NOT NULL))
        WHEN 'dead_pmid' THEN CASE WHEN composite >= 0.72 THEN held ELSE [] END ELSE [] END AS sources,
    CASE branch WHEN 'registry' THEN CASE WHEN l IS NOT NULL THEN {_fill("r", "l", _BY_DOI, True)} WHEN d IS NOT NULL THEN {_fill("r", "d", ("first_author", "container"))} ELSE r END
        WHEN 'data' THEN {_pack({f: f"d.{f}" if f in ("title", "first_author", "year", "container", "doi") else _NONE for f in _FIELDS})} WHEN 'library' THEN l WHEN 'pmid' THEN {_pack({f: f"by_pmid.{f}" if f != "pmid" else "cited_pmid" for f in _FIELDS})}
        WHEN 'title' THEN CASE WHEN f.doi IS NOT NULL THEN f4 ELSE f5 END WHEN 'dead_doi' THEN f WHEN 'dead_pmid' THEN CASE WHEN composite >= 0.72 THEN f END END AS rec FROM z2)"""

_PAGES_SQL = lambda c: f"lower(regexp_replace(regexp_replace(regexp_replace({c}, '[–—−]', '-', 'g'), '\\s+', '', 'g'), '(?i)^pp?\\.', ''))"
_GAP = "abs(TRY_CAST(cited_year AS INTEGER) - rec.year)"
_TITLED = "CASE WHEN length(cited_title) >= 8 THEN cited_title END"


def _same(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0 ELSE 0.0 END"


def _check(field: str, a: str, b: str, score: str, floor: str, relation: str = "t") -> str:
    return f"SELECT ref_id, branch, '{field}' AS field, nullif({D.strip(a)}, '') AS cited, nullif({D.strip(b)}, '') AS found, {score} AS score, {floor} AS floor FROM {relation}"


_RULES = (
    _check("year", "cited_year", "CAST(rec.year AS VARCHAR)", f"CASE WHEN cited_year = CAST(rec.year AS VARCHAR) THEN 1.0 WHEN {_GAP} <= 1 THEN 0.92 ELSE 0.0 END", "0.9"),
    _check("title", "titled", "rec.title", D.similarity("na", "nb", "f1", True, "lost", "p", "r"), "CASE WHEN branch = 'dead_doi' THEN 0.99 WHEN strict THEN 0.95 ELSE 0.55 END"),
    _check("first_author", "cited_author", "rec.first_author", _author_sql("cited_author", "rec.first_author"), "0.99"),
    _check("container", "cited_journal", "rec.container", "journal_score", "CASE WHEN strict THEN 0.78 ELSE 0.5 END"),
    _check("volume", "cited_volume", "rec.volume", _same("cited_volume", "rec.volume"), "0.99"),
    _check("issue", "cited_issue", "rec.issue", _same("cited_issue", "rec.issue"), "0.99"),
    _check("pages", "cited_pages", "rec.pages", _same(_PAGES_SQL("cited_pages"), _PAGES_SQL("rec.pages")), "0.99"),
    _check("pmid", "cited_pmid", "regexp_replace(rec.pmid, '\\D', '', 'g')", _same("cited_pmid", "rec.pmid"), "0.99"),
)
_TOKENED = f"(SELECT *, {_TITLED} AS titled, {D.norm(_TITLED)} AS na, {D.norm('rec.title')} AS nb, {D.tokens(_TITLED)} AS ta, {D.tokens('rec.title')} AS tb, branch <> 'dead_pmid' AND (branch <> 'title' OR rec.doi IS NOT NULL OR rec.pmid IS NOT NULL) AS strict FROM s WHERE rec IS NOT NULL)"
_SHARED = f"(SELECT *, {D.share('ta', 'tb')} AS p, {D.share('tb', 'ta')} AS r, len(list_filter(tb[1:2], lambda i: NOT list_contains(ta, i))) > 0 AS lost FROM {_TOKENED})"
_CHECKS = f"""
t AS MATERIALIZED (SELECT * FROM {_journal_sql(f"(SELECT *, {D.harmonic('p', 'r')} AS f1 FROM {_SHARED})", "cited_journal", "rec.container", "journal_score")}),
u AS ({" UNION ALL ".join(_RULES)}),
q AS (SELECT ref_id, field, cited, found, CASE WHEN cited IS NOT NULL AND found IS NOT NULL THEN score END AS score, cited IS NULL OR found IS NULL OR score >= floor AS ok FROM u WHERE (cited IS NOT NULL OR found IS NOT NULL) AND (branch <> 'dead_doi' OR field = 'title')),
checks AS (SELECT ref_id, field, cited, found, {D.rounded("score")} AS score, ok, coalesce(NOT ok AND score < 0.99, false) AS drift FROM q)"""
_STATUS = """
h AS (SELECT ref_id, list(field ORDER BY field) AS fields FROM checks WHERE drift GROUP BY ref_id),
o AS (SELECT s.*, list_concat(list_concat(CASE branch WHEN 'dead_doi' THEN ['doi'] WHEN 'dead_pmid' THEN ['pmid'] WHEN 'no_match' THEN ['doi', 'title'] ELSE [] END, coalesce(h.fields, [])), CASE WHEN branch = 'title' AND rec.doi IS NULL THEN ['doi'] ELSE [] END) AS raw_fields FROM s LEFT JOIN h USING (ref_id)),
o2 AS (SELECT *, list_filter(raw_fields, lambda i, j: list_position(raw_fields, i) = j) AS fields, rec.doi IS NOT NULL OR rec.pmid IS NOT NULL AS durable, composite >= 0.82 AND title_score >= 0.85 AS strong, composite >= 0.65 AS medium FROM o),
status AS (SELECT *, CASE WHEN branch IN ('dead_doi', 'dead_pmid', 'no_match') THEN 'risk' WHEN branch = 'no_anchor' THEN 'insufficient'
    WHEN branch IN ('registry', 'pmid') THEN CASE WHEN list_contains(fields, CASE WHEN branch = 'pmid' THEN 'pmid' ELSE 'doi' END) THEN 'risk' WHEN len(fields) = 0 AND second THEN 'ok' ELSE 'review' END
    WHEN branch IN ('data', 'library') THEN CASE WHEN len(fields) = 0 THEN 'ok' ELSE 'review' END
    WHEN len(fields) = 0 AND durable AND strong AND second THEN 'ok' WHEN strong OR (medium AND durable) THEN 'review' ELSE 'insufficient' END AS status, array_to_string(fields, ',') AS drift FROM o2)"""
_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in ("ok", "review", "risk", "insufficient"))
_JOURNALS = _journal_sql("(SELECT p_partkey, p_type || ' ' || p_name AS full_name, CASE WHEN p_partkey % 3 = 0 THEN string_split(p_type || ' ' || p_name, ' ')[1] ELSE array_to_string(list_transform(string_split(p_type || ' ' || p_name, ' '), lambda w: substr(w, 1, 3)), ' ') END AS cited FROM part)", "cited", "full_name", "raw_score")

ORACLES = {
    "journal_match": f"SELECT p_partkey, {D.rounded('raw_score')} AS score FROM {_JOURNALS}",
    "candidate_composite": f"WITH b AS MATERIALIZED (SELECT * FROM {_HINTED}), w AS (SELECT * FROM ({_DUCK_WORKS})), {_SOURCE_CTES}, {_candidates_sql('SELECT * FROM b WHERE cited_doi IS NULL AND cited_pmid IS NULL', 3)} SELECT ref_id, CAST(rank AS INTEGER) AS rank, rec.doi AS doi, {D.rounded('composite')} AS composite, {D.rounded('title_score')} AS title_score FROM best",
    "verify_field_checks": f"WITH {_RESOLVED}, {_CHECKS} SELECT * FROM checks",
    "verify_status": f"WITH {_RESOLVED}, {_CHECKS}, {_STATUS} SELECT ref_id, branch, status, drift FROM status",
    "verify_summary": f"WITH {_RESOLVED}, {_CHECKS}, {_STATUS} SELECT count(*) AS total, {_COUNTS} FROM status",
    "verify_lists": f"WITH {_RESOLVED}, {_CHECKS}, {_STATUS} SELECT ref_id // 15 AS list_id, count(*) AS total, {_COUNTS}, coalesce(string_agg(CAST(ref_id AS VARCHAR), ',' ORDER BY ref_id) FILTER (WHERE status <> 'ok'), '') AS review_refs FROM status GROUP BY ALL",
    "verify_drift_histogram": f"WITH {_RESOLVED}, {_CHECKS}, {_STATUS} SELECT field, count(*) AS refs FROM (SELECT unnest(fields) AS field FROM status) GROUP BY field",
    "verify_sources": f"WITH {_RESOLVED} SELECT source, count(*) AS refs FROM (SELECT unnest(sources) AS source FROM s) GROUP BY source",
    "verify_diffs": f"""WITH {_RESOLVED}, {_CHECKS}
SELECT ref_id, field, substr(cited, 1, 120) AS cited, substr(found, 1, 120) AS found, score FROM checks WHERE drift
UNION ALL SELECT ref_id, 'doi', cited_doi, '未找到', 0.0 FROM s WHERE branch = 'dead_doi' UNION ALL SELECT ref_id, 'pmid', cited_pmid, '未找到', 0.0 FROM s WHERE branch = 'dead_pmid'
UNION ALL SELECT ref_id, 'doi', '缺失', '未匹配', 0.0 FROM s WHERE branch = 'no_match' UNION ALL SELECT ref_id, 'title', substr(cited_title, 1, 80), '无接近匹配', 0.0 FROM s WHERE branch = 'no_match'
UNION ALL SELECT ref_id, 'doi', '缺失', '仍缺失', 0.0 FROM s WHERE branch = 'title' AND rec.doi IS NULL""",
    "ref_generate_extract": f"SELECT ref_id, cited_doi, cited_pmid, cited_year FROM {_HINTED}",
    "ref_biblio_hints": f"SELECT ref_id, cited_journal, cited_volume, cited_issue, cited_pages FROM {_HINTED}",
    "ref_title": f"SELECT ref_id, cited_title FROM {_HINTED}",
    "ref_first_author": f"SELECT ref_id, cited_author FROM {_HINTED}",
    "author_match": f"WITH c AS (SELECT c_custkey, regexp_replace(c_name, '#0*', ' A', 'g') AS a, regexp_replace('Customer B' || ((c_custkey + 1) % 7), 'B[0-3]', 'A', 'g') AS b FROM customer) SELECT c_custkey, {D.rounded(_author_sql('a', 'b'))} AS score FROM c",
}
