"""Queries: candidates of five libraries, phrases, and the result of a whole request."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import identifiers as I
from quillspark.functions import text as T
from quillspark.functions.titles import likely_title
from quillspark.operators import federated as O
from quillspark.operators import linkage as L
from quillspark.operators.topk import phrases
from quillspark.plans import duck as D
from quillspark.sources import tables as S
from quillspark.sources.staging import Stage


def _sentences(spark, d, whole=False):
    """Sentences of all benchmark items as queries. With whole they are all there, and asked in full."""
    b = S.table(spark, d, "benchmark")
    s = b.select("item_id", F.posexplode(T.sentences(F.col("text"), whole=whole)).alias("pos", "sentence")).withColumn("mode", T.search_mode(F.col("sentence")))
    title = likely_title(F.col("sentence"), most=None if whole else 220)
    said = lambda most: F.when(F.col("mode") == "title", title).otherwise(F.col("sentence") if whole else F.substring("sentence", 1, most))
    return s.select("item_id", "pos", (F.col("item_id").cast("long") * (_PLACES if whole else 100) + F.col("pos")).alias("query_id"), "mode", I.year_hint(F.col("sentence")).alias("year_hint"), said(320).alias("phrase"), said(500).alias("text"))


#: More places than a text has sentences.
_PLACES = 1_000_000_000


def _passages(spark, d):
    """Whole benchmark items as passages."""
    b = S.table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.lit("body").alias("mode"), I.year_hint(F.col("text")).alias("year_hint"), F.substring("text", 1, 320).alias("phrase"), F.substring("text", 1, 500).alias("text"))


def likely_titles(spark, d):
    """The title-like part of the first line of every document."""
    return S.works(spark, d).select("work_id", F.md5(likely_title(F.col("title")).cast("binary")).alias("title_md5"))


def _hits(spark, d, queries, stage, second=True, whole=False):
    works, asked = S.libraries(spark, d), stage(queries)
    rows = stage(O.merged(O.candidates(asked, works, stage, second, whole), works))
    return asked, rows, O.ranked(asked, rows, works, stage)


def match_sources_merge(spark, d):
    """The works that five libraries together give for each sentence of a benchmark item, asked in full."""
    with Stage(spark) as stage:
        asked, _, hits = _hits(spark, d, _sentences(spark, d, whole=True), stage, whole=True)
        rows = hits.join(asked.select("query_id", "item_id", "pos"), "query_id")
        return stage.keep(rows.select("item_id", "pos", "mode", "rank", "work_id", "abstract_of", "year", "cited", "n_sources", "sources", T.rounded(F.col("score"), 2).alias("score"), L.score_label(F.col("score")).alias("label")))


def match_second_pass(spark, d):
    """The works found for whole benchmark items, asked as passages and again by their key words;
    late is true for what only the second search finds."""
    with Stage(spark) as stage:
        _, _, hits = _hits(spark, d, _passages(spark, d), stage)
        return stage.keep(hits.select(F.col("query_id").alias("item_id"), "rank", "work_id", "n_sources", "sources", T.rounded(F.col("score"), 2).alias("score"), (F.col("first_list") >= len(O.NAMES)).alias("late")))


def phrase_search(spark, d):
    """The documents that hold a sentence of a benchmark item word for word."""
    with Stage(spark) as stage:
        asked = S.table(spark, d, "benchmark").select("item_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "phrase"))
        docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
        return stage.keep(phrases(asked, docs, ["item_id", "pos"], stage).select("item_id", "pos", F.col("doc").alias("doc_id"), "size", "times"))


def match_envelope(spark, d):
    """The result object of each benchmark item taken as a request: the best works of all its sentences, a report
    on each sentence, how many distinct candidates there were, and the warning that nothing was found."""
    with Stage(spark) as stage:
        asked, rows, hits = _hits(spark, d, _sentences(spark, d), stage)
        hits = stage(hits.join(asked.select("query_id", "item_id", "pos"), "query_id").select("item_id", "pos", "query_id", "key", "rank", "work_id", T.rounded(F.col("score"), 2).alias("score"), F.floor(F.col("score") * 100 + 0.5).cast("int").alias("percent"), "cited", L.score_label(F.col("score")).alias("label"), "sources"))
        parts = hits.select(
            F.concat_ws(" ", F.col("item_id").cast("string"), "key").alias("key"), F.struct("pos", (-F.col("rank")).alias("late"), "item_id", "work_id", "percent").alias("pos"), "score", "cited",
            F.concat(F.lit("s"), F.col("pos").cast("string")).alias("sentence"), F.array("label").alias("reasons"), F.split("sources", ",").alias("sources"),
        )
        merged = L.merge_hits(parts).select("score", "cited", F.col("winner_pos.item_id").alias("item_id"), F.col("winner_pos.work_id").alias("work_id"), F.col("winner_pos.percent").alias("percent"), "sentences", "reasons", "sources", F.split("key", " ", 2)[1].alias("key"))
        best = stage(L.top(merged, "item_id", 12, F.desc("score"), F.desc("cited"), F.asc("work_id"), F.asc("key")))
        results = best.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "work_id", "percent", "sentences", "reasons", "sources"))).alias("results"))
        left = hits.join(best.select("item_id", "key"), ["item_id", "key"], "left_semi")
        surviving = left.groupBy("item_id", "pos").agg(F.array_sort(F.collect_list(F.struct("rank", "work_id", "percent"))).alias("s"))
        counts = hits.groupBy("item_id", "pos").agg(F.count(F.lit(1)).alias("hits"))
        report = asked.select("item_id", "pos").join(counts, ["item_id", "pos"], "left").join(surviving, ["item_id", "pos"], "left")
        first = F.get("s", F.lit(0))
        line = F.struct("pos", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce(first["percent"], F.lit(0)).alias("best"), F.coalesce(first["work_id"].cast("string"), F.lit("")).alias("best_id"), F.coalesce(F.transform("s", lambda x: x["work_id"]), F.array().cast("array<bigint>")).alias("ids"))
        reports = report.groupBy("item_id").agg(F.array_sort(F.collect_list(line)).alias("reports"))
        found = rows.join(asked.select("query_id", "item_id"), "query_id").groupBy("item_id").agg(F.count_distinct("key").alias("candidates"))
        every = S.table(spark, d, "benchmark").select("item_id").join(results, "item_id", "left").join(reports, "item_id", "left").join(found, "item_id", "left")
        body = F.struct(
            F.coalesce("results", F.array().cast(results.schema["results"].dataType)).alias("results"), F.coalesce("reports", F.array().cast(reports.schema["reports"].dataType)).alias("sentenceReports"),
            F.coalesce("candidates", F.lit(0)).alias("candidates"), F.when(F.coalesce("candidates", F.lit(0)) == 0, _WARNING).otherwise("").alias("warning"),
        )
        return stage.keep(every.select("item_id", F.to_json(body).alias("result")))


#: Fixed value.
_WARNING = "所有文献检索源均未返回结果，请稍后重试或调整检索内容"

_SP = D.SPACE
_CLEAN = lambda x: D.squeeze(
    f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '(?i)https?://[^{_SP[1:-1]}]+', '', 'g'), '(?i)doi:{_SP}*10\\.[^{_SP[1:-1]}]+', '', 'g'), '10\\.[0-9]{{4,9}}/[^{_SP[1:-1]}]+', '', 'g'), '(?i)\\bPMID[:{_SP[1:-1]}]*[0-9]+', '', 'g')"
)


def _title_of(x: str, every: bool = False) -> str:
    """List-free SQL of the likely title; c is the cleaned line. With every, all of it."""
    clean = _CLEAN(x)
    dated = "trim(regexp_split_to_array(trim(regexp_extract(c, '^.+?\\s*\\([0-9]{4}\\)\\.\\s*(.+)$', 1)), '\\.\\s+')[1])"
    parts = "list_filter(list_transform(regexp_split_to_array(c, '[.。]'), lambda p: trim(p)), lambda p: p <> '')"
    good = f"list_filter({parts}, lambda p: length(p) > 20 AND NOT regexp_matches(p, '(?i)\\bet\\s+al\\b') AND NOT regexp_matches(p, '^[A-Z][a-z]+\\s+[A-Z]{{1,3}}(\\s*,|$)') AND NOT regexp_matches(p, '^(19|20)[0-9]{{2}}'))[1]"
    title = f"CASE WHEN length({dated}) > 12 THEN {dated} WHEN len({parts}) >= 2 THEN coalesce({good}, c) ELSE c END"
    return f"list_transform([{clean}], lambda c: {title if every else f'substr({title}, 1, 220)'})[1]"


_YEAR = "CAST(nullif(regexp_extract(regexp_extract({x}, '(?i)\\((\\d{{4}})[a-z]?\\)|\\b((?:19|20)\\d{{2}})\\b', 0), '(\\d{{4}})', 1), '') AS INTEGER)"
_SENTENCES = (
    f"SELECT item_id, CAST(pos AS INTEGER) AS pos, item_id * 100 + pos AS query_id, mode, {_YEAR.format(x='s')} AS year_hint, CASE WHEN mode = 'title' THEN t ELSE substr(s, 1, 320) END AS phrase, CASE WHEN mode = 'title' THEN t ELSE substr(s, 1, 500) END AS text "
    f"FROM (SELECT *, {_title_of('s')} AS t, {D.mode('s')} AS mode FROM (SELECT item_id, i - 1 AS pos, l[i] AS s FROM (SELECT item_id, {D.sentences('text')} AS l FROM benchmark), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) u))"
)
_PASSAGES = f"SELECT item_id, 0 AS pos, item_id AS query_id, 'body' AS mode, {_YEAR.format(x='text')} AS year_hint, substr(text, 1, 320) AS phrase, substr(text, 1, 500) AS text FROM benchmark"
#: The same of all sentences in full.
_ALL_SENTENCES = (
    f"SELECT item_id, CAST(pos AS INTEGER) AS pos, CAST(item_id AS BIGINT) * {_PLACES} + pos AS query_id, mode, {_YEAR.format(x='s')} AS year_hint, CASE WHEN mode = 'title' THEN t ELSE s END AS phrase, CASE WHEN mode = 'title' THEN t ELSE s END AS text "
    f"FROM (SELECT *, {_title_of('s', every=True)} AS t, {D.mode('s')} AS mode FROM (SELECT item_id, i - 1 AS pos, l[i] AS s FROM (SELECT item_id, {D.sentences('text', every=True)} AS l FROM benchmark), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) u))"
)


def _merge_cte(queries: str, every: bool = False) -> str:
    """CTEs up to hits: every list scored in full, merged, scored and ranked. With every, lists are asked phrases of any length."""
    cut = lambda most: f"substr(phrase, 1, {most})" if most and not every else "phrase"

    def asks(mode, lists, first=0, phrase=None):
        rows = []
        for i, (library, field, most) in enumerate(lists):
            said = phrase or cut(most)
            if (mode, library, field) == ("title", 0, 0):
                plain = f"trim(regexp_replace(regexp_replace(phrase, '[|:<>]', ' ', 'g'), '{_SP}+', ' ', 'g'))"
                said = plain if every else f"substr({plain}, 1, {most})"
            rows.append(f"SELECT query_id, {first + i} AS list, {library} AS library, {'NULL' if field is None else field} AS field, {said} AS phrase, {O.ROWS[library]} AS k FROM q WHERE mode = '{mode}'")
        return " UNION ALL ".join(rows)

    words = f"array_to_string({D.tokens('text', 3)}[:14], ' ')"
    again = " UNION ALL ".join(f"SELECT query_id, {l} AS list, {l} AS library, {f} AS field, {cut(m)} AS phrase, {O.ROWS[l]} AS k FROM q WHERE mode = 'title'" for l, f, m in O.AGAIN)
    second = asks("body", O.SECOND, len(O.NAMES), "kw").replace("FROM q WHERE", "FROM (SELECT *, " + f"CASE WHEN length({words}) > 24 THEN {words} END AS kw FROM q) WHERE kw IS NOT NULL AND")
    held = ("true", "lang IN ('en', 'de')", "EXISTS (FROM labels l WHERE l.doc_id = documents.doc_id)", "n_chars >= 1000", "n_chars < 4000")
    libraries = " UNION ALL ".join(f"SELECT doc_id, {i} AS library FROM documents WHERE {h}" for i, h in enumerate(held))
    names = "CASE library " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(O.NAMES)) + " END"
    search = lambda name, source: f"""
{name}t AS (SELECT DISTINCT query_id, list, library, field, k, unnest({D.tokens('phrase')}) AS token FROM ({source}) WHERE field IS NOT NULL),
{name}s AS (SELECT query_id, list, k, doc_id, {D.rounded('sum(w)')} AS score FROM {name}t JOIN wt USING (library, field, token) GROUP BY ALL),
{name} AS (SELECT query_id, list, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, doc_id) AS rank FROM {name}s) WHERE rank <= k)"""  # noqa: E731
    return f"""
q AS MATERIALIZED ({queries}),
hold AS ({libraries}),
bag AS MATERIALIZED (SELECT doc_id, 0 AS field, {D.tokens(D.first_line('text'))} AS bag FROM documents UNION ALL SELECT doc_id, 1, {D.tokens('text')} FROM documents),
sz AS (SELECT library, field, count(*) AS n, any_value(mean) AS mean FROM hold JOIN bag USING (doc_id) JOIN (SELECT field, avg(len(bag)) AS mean FROM bag GROUP BY field) USING (field) GROUP BY ALL),
tf AS (SELECT doc_id, field, size, token, count(*) AS times FROM (SELECT doc_id, field, len(bag) AS size, unnest(bag) AS token FROM bag) GROUP BY ALL),
ps AS (SELECT library, tf.* FROM tf JOIN hold USING (doc_id)),
df AS (SELECT library, field, token, count(*) AS df FROM ps GROUP BY ALL),
wt AS MATERIALIZED (SELECT library, field, token, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * size / mean)) AS w FROM ps JOIN df USING (library, field, token) JOIN sz USING (library, field)),
ti AS ({asks('title', O.TITLE)}),{search('one', 'SELECT * FROM ti')},
rest AS ({asks('body', O.BODY)} UNION ALL {second} UNION ALL SELECT * FROM ({again}) g WHERE NOT EXISTS (FROM one WHERE one.query_id = g.query_id AND one.list = g.list)),{search('two', 'SELECT * FROM rest')},
qd AS (SELECT query_id, list, k, string_split({D.norm("replace(phrase, chr(34), '')")}, ' ') AS p FROM ti WHERE field IS NULL),
nt AS (SELECT doc_id, string_split({D.norm(D.first_line('text'))}, ' ') AS t FROM documents JOIN hold USING (doc_id) WHERE library = 4),
oc AS (SELECT query_id, list, k, doc_id, len(t) AS size, len(list_filter(range(1, len(t) - len(p) + 2), lambda i: t[i:i + len(p) - 1] = p)) AS times FROM qd JOIN nt ON p <> [''] AND contains(' ' || array_to_string(t, ' ') || ' ', ' ' || array_to_string(p, ' ') || ' ')),
three AS (SELECT query_id, list, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY times DESC, size, doc_id) AS rank FROM oc) WHERE rank <= k),
al AS (SELECT *, CASE WHEN list < 5 THEN list ELSE [{', '.join(str(l) for l, _, _ in O.SECOND)}][CAST(list - 4 AS INTEGER)] END AS library FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)),
ca AS (SELECT al.*, list * 100 + rank AS place, n_chars AS cited, CAST(1995 + doc_id % 25 AS INTEGER) AS year, CASE WHEN library IN (0, 1, 4) OR (library = 3 AND lang = 'en') THEN '10.1000/w.' || doc_id ELSE {D.norm(D.first_line('text'))} END AS key, {names} AS source FROM al JOIN documents USING (doc_id) WHERE {D.first_line('text')} <> ''),
me AS MATERIALIZED (SELECT query_id, key, arg_min(doc_id, place) AS work_id, arg_min(CASE WHEN library <> 1 THEN doc_id END, place) FILTER (WHERE library <> 1) AS abstract_of, arg_min(year, place) AS year, max(cited) AS cited, min(place) AS place, min(list) AS first_list,
    list(source ORDER BY place) AS so FROM ca GROUP BY ALL),
mm AS (SELECT * EXCLUDE so, list_filter(so, lambda x, i: list_position(so, x) = i) AS so FROM me),
fg AS (SELECT mm.*, q.item_id, q.pos, q.mode, q.year_hint, {D.norm('q.text')} AS nq, {D.tokens('q.text')} AS qb, {D.norm(D.first_line('a.text'))} AS na, {D.tokens(D.first_line('a.text'))} AS tb, CASE WHEN abstract_of IS NULL THEN [] ELSE {D.tokens('b.text')} END AS ab FROM mm JOIN q USING (query_id) JOIN documents a ON a.doc_id = work_id LEFT JOIN documents b ON b.doc_id = abstract_of),
fh AS (SELECT *, {D.share('tb', 'qb')} AS tr, {D.harmonic(D.share('qb', 'tb'), D.share('tb', 'qb'))} AS f1, {D.harmonic(D.share('qb', 'ab'), D.share('ab', 'qb'))} AS abstract_score FROM fg),
f2 AS (SELECT *, CASE WHEN mode = 'body' THEN tr ELSE 0 END AS coverage, {D.similarity('nq', 'na', 'f1')} AS title_score FROM fh),
s0 AS (SELECT *, CASE WHEN mode = 'body' THEN coverage * 0.5 + abstract_score * 0.4 + title_score * 0.15 ELSE title_score * 0.88 + abstract_score * 0.08 END AS s FROM f2),
s1 AS (SELECT * EXCLUDE s, CASE WHEN title_score >= 0.97 THEN greatest(s, 0.98) WHEN title_score >= 0.9 THEN greatest(s, title_score * 0.96 + abstract_score * 0.04) ELSE s END AS s FROM s0),
s2 AS (SELECT * EXCLUDE s, CASE WHEN mode = 'body' AND abstract_score >= 0.3 THEN greatest(s, abstract_score * 0.85 + coverage * 0.2) ELSE s END AS s FROM s1),
s3 AS (SELECT * EXCLUDE s, CASE WHEN mode = 'body' AND coverage >= 0.7 THEN greatest(s, coverage * 0.82) ELSE s END AS s FROM s2),
s4 AS (SELECT * EXCLUDE s, CASE WHEN year_hint = year THEN least(1.0, s + 0.03) WHEN abs(year_hint - year) > 2 THEN s * 0.85 ELSE s END AS s FROM s3),
s5 AS (SELECT * EXCLUDE s, CASE WHEN len(so) > 1 THEN least(1.0, s + 0.02) ELSE s END AS s FROM s4),
s6 AS (SELECT * EXCLUDE s, {D.rounded('least(1.0, s + least(0.02, log10(cited + 1) / 200))', 9)} AS score FROM s5),
hits AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cited DESC, place) AS rank FROM s6 WHERE score >= CASE WHEN mode = 'title' THEN 0.42 ELSE 0.22 END) WHERE rank <= 8)"""


_LABEL = "CASE WHEN score >= 0.88 THEN '高度匹配' WHEN score >= 0.68 THEN '较可能' WHEN score >= 0.45 THEN '相关候选' ELSE '弱相关' END"
_ENVELOPE = f"""WITH {_merge_cte(_SENTENCES)},
h AS (SELECT item_id, pos, key, rank, work_id, {D.rounded('score', 2)} AS sc, CAST(floor(score * 100 + 0.5) AS INTEGER) AS percent, cited, {_LABEL} AS label, so FROM hits),
m AS (SELECT item_id, key, max(sc) AS sc, list(work_id ORDER BY sc DESC, pos DESC, rank)[1] AS work_id, list(percent ORDER BY sc DESC, pos DESC, rank)[1] AS percent, list(cited ORDER BY sc DESC, pos DESC, rank)[1] AS cited, list('s' || pos ORDER BY sc DESC, pos DESC, rank) AS s, list(label ORDER BY sc DESC, pos DESC, rank) AS r, flatten(list(so ORDER BY sc DESC, pos DESC, rank)) AS o FROM h GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sc DESC, cited DESC, work_id, key) AS place FROM m),
re AS (SELECT item_id, list({{'rank': CAST(place AS INTEGER), 'work_id': work_id, 'percent': percent, 'sentences': list_filter(s, lambda x, i: list_position(s, x) = i)[:4], 'reasons': list_filter(r, lambda x, i: list_position(r, x) = i)[:8], 'sources': list_filter(o, lambda x, i: list_position(o, x) = i)}} ORDER BY place) AS results FROM b WHERE place <= 12 GROUP BY item_id),
su AS (SELECT h.item_id, h.pos, list(h.work_id ORDER BY rank) AS ids, list(h.percent ORDER BY rank)[1] AS best FROM h JOIN b ON b.item_id = h.item_id AND b.key = h.key AND place <= 12 GROUP BY ALL),
co AS (SELECT item_id, pos, count(*) AS n FROM h GROUP BY ALL),
rp AS (SELECT q.item_id, list({{'pos': q.pos, 'hits': coalesce(n, 0), 'best': coalesce(best, 0), 'best_id': coalesce(CAST(ids[1] AS VARCHAR), ''), 'ids': coalesce(ids, CAST([] AS BIGINT[]))}} ORDER BY q.pos) AS reports FROM q LEFT JOIN co ON co.item_id = q.item_id AND co.pos = q.pos LEFT JOIN su ON su.item_id = q.item_id AND su.pos = q.pos GROUP BY q.item_id),
cn AS (SELECT item_id, count(DISTINCT key) AS n FROM mm JOIN q USING (query_id) GROUP BY item_id)
SELECT item_id, CAST(to_json({{'results': coalesce(results, []), 'sentenceReports': coalesce(reports, []), 'candidates': coalesce(n, 0), 'warning': CASE WHEN coalesce(n, 0) = 0 THEN '{_WARNING}' ELSE '' END}}) AS VARCHAR) AS result FROM benchmark LEFT JOIN re USING (item_id) LEFT JOIN rp USING (item_id) LEFT JOIN cn USING (item_id)"""

QUERIES = {"likely_titles": likely_titles, "match_sources_merge": match_sources_merge, "match_second_pass": match_second_pass, "phrase_search": phrase_search, "match_envelope": match_envelope}

ORACLES = {
    "likely_titles": f"SELECT doc_id AS work_id, md5({_title_of(D.first_line('text'))}) AS title_md5 FROM documents",
    "match_sources_merge": f"WITH {_merge_cte(_ALL_SENTENCES, every=True)} SELECT item_id, pos, mode, CAST(rank AS INTEGER) AS rank, work_id, abstract_of, year, cited, CAST(len(so) AS INTEGER) AS n_sources, array_to_string(so, ',') AS sources, {D.rounded('score', 2)} AS score, {_LABEL} AS label FROM hits",
    "match_second_pass": f"WITH {_merge_cte(_PASSAGES)} SELECT item_id, CAST(rank AS INTEGER) AS rank, work_id, CAST(len(so) AS INTEGER) AS n_sources, array_to_string(so, ',') AS sources, {D.rounded('score', 2)} AS score, first_list >= 5 AS late FROM hits",
    "phrase_search": f"""WITH p AS (SELECT item_id, i - 1 AS pos, string_split({D.norm('l[i]')}, ' ') AS p FROM (SELECT item_id, {D.sentences('text')} AS l FROM benchmark), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) u),
d AS (SELECT doc_id, {D.norm('text')} AS n, string_split({D.norm('text')}, ' ') AS t FROM documents)
SELECT item_id, CAST(pos AS INTEGER) AS pos, doc_id, CAST(len(t) AS INTEGER) AS size, len(list_filter(range(1, len(t) - len(p) + 2), lambda i: t[i:i + len(p) - 1] = p)) AS times FROM p JOIN d ON p <> [''] AND contains(' ' || n || ' ', ' ' || array_to_string(p, ' ') || ' ')""",
    "match_envelope": _ENVELOPE,
}
