"""Queries: text functions, similarity and sentence matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import similarity as sim
from quillspark.functions import text as T
from quillspark.operators import linkage as L
from quillspark.operators.blocks import best_matches
from quillspark.plans import duck as D
from quillspark.sources import tables as S
from quillspark.sources.staging import Stage


def text_normalize(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.md5(T.normalize(F.col("text")).cast("binary")).alias("normal_md5"))


def token_stats(spark, d):
    docs = S.table(spark, d, "documents").select(F.lit("documents").alias("origin"), "text")
    both = docs.unionByName(S.table(spark, d, "benchmark").select(F.lit("benchmark").alias("origin"), "text"))
    words = both.select("origin", F.explode(T.tokens(F.col("text"))).alias("token"))
    return words.groupBy("origin", "token").agg(F.count(F.lit(1)).alias("times"))


def token_f1_topk(spark, d):
    pairs = L.token_f1_pairs(S.benchmark_queries(spark, d), S.works(spark, d), "query_id", "work_id", "phrase", "abstract", few=True)
    return L.top(pairs.withColumn("f1", T.rounded(F.col("f1"), 9)), "query_id", 8, F.desc("f1"), F.asc("work_id"))


_F1_PAIRS = f"""
q AS (SELECT item_id AS query_id, {D.tokens("text")} AS bag FROM benchmark), w AS (SELECT doc_id AS work_id, {D.tokens("text")} AS bag FROM documents),
qt AS (SELECT query_id, len(bag) AS size, unnest(bag) AS token FROM q), wt AS (SELECT work_id, len(bag) AS size, unnest(bag) AS token FROM w),
qc AS (SELECT query_id, size, token, count(*) AS times FROM qt GROUP BY ALL), wc AS (SELECT work_id, size, token, count(*) AS times FROM wt GROUP BY ALL),
pairs AS (SELECT query_id, work_id, sum(qc.times) / any_value(qc.size) AS p, sum(wc.times) / any_value(wc.size) AS r FROM qc JOIN wc USING (token) GROUP BY query_id, work_id)"""


def title_similarity(strict: bool):
    def query(spark, d):
        """Each benchmark item's first line against the titles it shares a token with."""
        first, both = T.first_line(F.col("text")), lambda t, n: (T.normalize(t).alias(n), T.tokens(t).alias("bag"))
        a = S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), *both(first, "na"))
        b = S.works(spark, d).select("work_id", *both(F.col("title"), "nb"))
        return L.title_similarities(a, b, "query_id", "work_id", strict).withColumn("similarity", T.rounded(F.col("similarity")))

    return query


def _title_similarity_sql(strict: bool) -> str:
    a, b = D.first_line("text"), D.first_line("text")
    return f"""
WITH a AS (SELECT item_id AS query_id, {D.norm(a)} AS na, {D.tokens(a)} AS ta FROM benchmark), b AS (SELECT doc_id AS work_id, {D.norm(b)} AS nb, {D.tokens(b)} AS tb FROM documents),
p AS (SELECT *, {D.share("ta", "tb")} AS p, {D.share("tb", "ta")} AS r FROM a JOIN b ON list_has_any(ta, tb)),
f AS (SELECT *, {D.harmonic("p", "r")} AS f1, len(list_filter(tb[1:2], lambda w: NOT list_contains(ta, w))) > 0 AS lost FROM p)
SELECT query_id, work_id, {D.rounded(D.similarity("na", "nb", "f1", strict, "lost", "p", "r"))} AS similarity FROM f"""


def title_coverage(spark, d):
    """Share of a work's title tokens in each benchmark item, where it isn't 0."""
    asked = L.postings(S.benchmark_queries(spark, d), "query_id", "phrase")
    pairs = L.overlap(asked, L.postings(S.works(spark, d), "work_id", "title", asked=asked), "query_id", "work_id")
    return pairs.select("query_id", "work_id", T.rounded(F.col("recall")).alias("coverage"))


def match_score(mode: str):
    def query(spark, d):
        asked = S.benchmark_queries(spark, d)
        if mode == "title":
            asked = asked.withColumns({"phrase": F.substring(T.first_line(F.col("phrase")), 1, 200), "mode": F.lit(mode)})
        found = L.ranked_matches(asked.where(F.col("mode") == mode), S.works(spark, d), few=True)
        return found.select("query_id", "work_id", "rank", T.rounded(F.col("score"), 2).alias("score"), L.score_label(F.col("score")).alias("label"), T.rounded(F.col("title_score")).alias("title_score"), T.rounded(F.col("abstract_score")).alias("abstract_score"))

    return query


def _match_cte(queries: str, hints: str = "CAST(NULL AS INTEGER) AS year_hint, CAST([] AS VARCHAR[]) AS dois") -> str:
    """CTEs up to `ranked` for the relation `queries` (query_id, phrase, mode, and the hints)."""
    t = D.first_line("text")
    return f"""
q0 AS ({queries}),
q AS (SELECT query_id, mode, {hints}, {D.norm("phrase")} AS nq, {D.tokens("phrase")} AS bag FROM q0),
w AS (SELECT doc_id AS work_id, '10.1000/w.' || doc_id AS doi, {D.norm(t)} AS nt, {D.tokens(t)} AS tbag, {D.tokens("text")} AS abag, n_chars AS cited, CAST(1995 + doc_id % 25 AS INTEGER) AS year FROM documents),
qc AS (SELECT query_id, len(bag) AS size, token, count(*) AS times FROM (SELECT query_id, bag, unnest(bag) AS token FROM q) GROUP BY ALL),
tc AS (SELECT work_id, len(tbag) AS size, token, count(*) AS times FROM (SELECT work_id, tbag, unnest(tbag) AS token FROM w) GROUP BY ALL),
ac AS (SELECT work_id, len(abag) AS size, token, count(*) AS times FROM (SELECT work_id, abag, unnest(abag) AS token FROM w) GROUP BY ALL),
tp AS (SELECT query_id, work_id, sum(qc.times) / any_value(qc.size) AS tp, sum(tc.times) / any_value(tc.size) AS tr FROM qc JOIN tc USING (token) GROUP BY ALL),
ap AS (SELECT query_id, work_id, sum(qc.times) / any_value(qc.size) AS ap, sum(ac.times) / any_value(ac.size) AS ar FROM qc JOIN ac USING (token) GROUP BY ALL),
p AS (SELECT query_id, work_id, coalesce(tp, 0) AS tp, coalesce(tr, 0) AS tr, coalesce(ap, 0) AS ap, coalesce(ar, 0) AS ar FROM tp FULL JOIN ap USING (query_id, work_id)),
f AS (SELECT p.*, mode, nq, nt, cited, year, year_hint, list_contains(dois, doi) AS doi_hit, {D.harmonic("tp", "tr")} AS f1, {D.harmonic("ap", "ar")} AS abstract_score, CASE WHEN mode = 'body' THEN tr ELSE 0 END AS coverage FROM p JOIN q USING (query_id) JOIN w USING (work_id)),
g AS (SELECT *, {D.similarity("nq", "nt", "f1")} AS title_score FROM f),
s0 AS (SELECT *, CASE WHEN mode = 'body' THEN coverage * 0.5 + abstract_score * 0.4 + title_score * 0.15 ELSE title_score * 0.88 + abstract_score * 0.08 END AS s FROM g),
s1 AS (SELECT * EXCLUDE s, CASE WHEN title_score >= 0.97 THEN greatest(s, 0.98) WHEN title_score >= 0.9 THEN greatest(s, title_score * 0.96 + abstract_score * 0.04) ELSE s END AS s FROM s0),
s2 AS (SELECT * EXCLUDE s, CASE WHEN mode = 'body' AND abstract_score >= 0.3 THEN greatest(s, abstract_score * 0.85 + coverage * 0.2) ELSE s END AS s FROM s1),
s3 AS (SELECT * EXCLUDE s, CASE WHEN mode = 'body' AND coverage >= 0.7 THEN greatest(s, coverage * 0.82) ELSE s END AS s FROM s2),
s4 AS (SELECT * EXCLUDE s, CASE WHEN year_hint = year THEN least(1.0, s + 0.03) WHEN abs(year_hint - year) > 2 THEN s * 0.85 ELSE s END AS s FROM s3),
s5 AS (SELECT * EXCLUDE s, least(1.0, CASE WHEN doi_hit THEN greatest(s, 0.99) ELSE s END + least(0.02, log10(cited + 1) / 200)) AS exact FROM s4),
s6 AS (SELECT * EXCLUDE exact, {D.rounded("exact", 9)} AS score FROM s5 WHERE exact >= CASE WHEN mode = 'title' THEN 0.42 ELSE 0.22 END),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cited DESC, work_id) AS rank FROM s6)"""


_LABEL = "CASE WHEN score >= 0.88 THEN '高度匹配' WHEN score >= 0.68 THEN '较可能' WHEN score >= 0.45 THEN '相关候选' ELSE '弱相关' END"


def _match_sql(mode: str) -> str:
    asked = f"SELECT item_id AS query_id, text AS phrase, 'body' AS mode FROM benchmark WHERE {D.mode('text')} = 'body'"
    if mode == "title":
        asked = f"SELECT item_id AS query_id, substr({D.first_line('text')}, 1, 200) AS phrase, 'title' AS mode FROM benchmark"
    return f"""WITH {_match_cte(asked)}
SELECT query_id, work_id, CAST(rank AS INTEGER) AS rank, {D.rounded("score", 2)} AS score, {_LABEL} AS label, {D.rounded("title_score")} AS title_score, {D.rounded("abstract_score")} AS abstract_score FROM ranked WHERE rank <= 8"""


def sentence_split(spark, d):
    return S.sentences(spark, d).select("conv_id", "turn", "pos", F.md5(F.col("sentence").cast("binary")).alias("sentence_md5"), F.length("sentence").alias("n_chars"))


def sentence_mode(spark, d):
    return S.sentences(spark, d).select("conv_id", "turn", "pos", T.search_mode(F.col("sentence")).alias("mode"))


def query_expansion(spark, d):
    return S.sentences(spark, d).select("conv_id", "turn", "pos", T.key_words(F.col("sentence")).alias("key_words"))


def _sentences_sql(every: bool = False) -> str:
    return f"(SELECT conv_id, turn, CAST(u.i - 1 AS INTEGER) AS pos, l[u.i] AS sentence FROM (SELECT conv_id, turn, {D.sentences('text', every=every)} AS l FROM conversations), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) u)"


_SENTENCES = _sentences_sql()


_SENTENCE = ("conv_id", "turn", "pos")


def _sentence_hits(spark, d, stage, whole=False):
    """Sentences of all turns, and the works found for each. Equal sentences are matched once, under
    a number as query_id."""
    said = F.col("sentence") if whole else F.substring("sentence", 1, 500)
    asked = stage(S.sentences(spark, d, whole).select(*_SENTENCE, said.alias("phrase"), T.search_mode(F.col("sentence")).alias("mode")))
    once = stage(asked.select("phrase", "mode").distinct().withColumn("query_id", F.monotonically_increasing_id()))
    hits = stage(best_matches(once, S.works(spark, d)))
    return asked, asked.join(once, ["phrase", "mode"]).drop("phrase").join(hits, "query_id").drop("query_id")


def match_sentence_report(spark, d):
    """For each sentence: hits, best score and the works found; sentences without hits too."""
    with Stage(spark) as stage:
        asked, hits = _sentence_hits(spark, d, stage)
        report = hits.groupBy(*_SENTENCE).agg(F.count(F.lit(1)).alias("hits"), T.rounded(F.max("score"), 2).alias("best"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "work_id"))), lambda x: x["work_id"]).alias("works"))
        return stage.keep(asked.select(*_SENTENCE, "mode").join(report, list(_SENTENCE), "left").select(*_SENTENCE, "mode", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), "best", F.array_join(F.col("works").cast("array<string>"), ",").alias("works")))


#: Distinct sentences of all turns, as queries; _ASKED has every sentence.
_ASKED = f"(SELECT conv_id, turn, pos, substr(sentence, 1, 500) AS phrase, {D.mode('sentence')} AS mode FROM {_SENTENCES})"
_SENTENCE_QUERIES = f"SELECT min(conv_id * 1000000 + turn * 1000 + pos) AS query_id, phrase, mode FROM {_ASKED} GROUP BY phrase, mode"
_REPORT_SQL = f"""WITH {_match_cte(_SENTENCE_QUERIES)},
h AS (SELECT query_id, count(*) AS hits, {D.rounded('max(score)', 2)} AS best, string_agg(CAST(work_id AS VARCHAR), ',' ORDER BY rank) AS works FROM ranked WHERE rank <= 8 GROUP BY query_id)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, a.mode, coalesce(hits, 0) AS hits, best, works FROM {_ASKED} a JOIN q0 USING (phrase, mode) LEFT JOIN h USING (query_id)"""


def match_hit_merge(spark, d):
    """Works found for any sentence of a conversation, merged over its sentences: best 12. Sentences
    are named by turn and place; all of a turn are asked, in full."""
    with Stage(spark) as stage:
        _, hits = _sentence_hits(spark, d, stage, whole=True)
        rows = hits.select(
            F.concat_ws(":", "conv_id", "work_id").alias("key"),
            F.struct("turn", "pos").alias("pos"),
            T.rounded(F.col("score"), 2).alias("score"),
            "cited",
            F.concat(F.lit("t"), F.col("turn").cast("string"), F.lit("s"), F.col("pos").cast("string")).alias("sentence"),
            F.array(L.score_label(F.col("score"))).alias("reasons"),
            F.array(F.col("mode")).alias("sources"),
        )
        merged = L.merge_hits(rows).withColumns({"conv_id": F.split("key", ":")[0].cast("long"), "work_id": F.split("key", ":")[1].cast("long")})
        best = L.top(merged, "conv_id", 12, F.desc("score"), F.desc("cited"), F.asc("work_id"))
        return stage.keep(best.select("conv_id", "work_id", "rank", "score", *[F.array_join(c, ",").alias(c) for c in ("sentences", "reasons", "sources")]))


#: The same of all sentences in full.
_ALL_ASKED = f"(SELECT conv_id, turn, pos, sentence AS phrase, {D.mode('sentence')} AS mode FROM {_sentences_sql(every=True)})"
_ALL_QUERIES = f"SELECT row_number() OVER (ORDER BY phrase, mode) AS query_id, phrase, mode FROM (SELECT DISTINCT phrase, mode FROM {_ALL_ASKED})"
_HIT_MERGE_SQL = f"""WITH {_match_cte(_ALL_QUERIES)},
h AS (SELECT conv_id, work_id, turn, pos, {D.rounded("score", 2)} AS score, cited, 't' || turn || 's' || pos AS sentence, {_LABEL} AS reason, a.mode FROM {_ALL_ASKED} a JOIN q0 USING (phrase, mode) JOIN ranked USING (query_id) WHERE rank <= 8),
m AS (SELECT conv_id, work_id, max(score) AS score, max(cited) AS cited, list(sentence ORDER BY score DESC, turn DESC, pos DESC) AS s, list(reason ORDER BY score DESC, turn DESC, pos DESC) AS r, list(mode ORDER BY score DESC, turn DESC, pos DESC) AS o FROM h GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, cited DESC, work_id) AS rank FROM m)
SELECT conv_id, work_id, CAST(rank AS INTEGER) AS rank, score, array_to_string(s[:4], ',') AS sentences, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i)[:8], ',') AS reasons,
    array_to_string(list_filter(o, lambda x, i: list_position(o, x) = i), ',') AS sources FROM k WHERE rank <= 12"""


def abstract_snippets(spark, d):
    """Best sentences for the benchmark item with the document's number, of documents that have one."""
    b = S.table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    pairs = docs.withColumn("item_id", F.col("doc_id") % b.count()).join(b, "item_id")
    return pairs.select("doc_id", F.md5(F.array_join(T.snippets(F.col("query"), F.col("text")), "\n").cast("binary")).alias("snippets_md5"))


_SNIPPETS_SQL = f"""
WITH b AS (SELECT item_id, {D.tokens("text", 3)} AS q FROM benchmark), d AS (SELECT doc_id, text, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents),
s AS (SELECT doc_id, q, list_filter(list_transform(string_split(regexp_replace(text, '([.。!！?？;；]){D.SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {D.strip("s")}), lambda s: length(s) > 20) AS l FROM d JOIN b USING (item_id)),
e AS (SELECT doc_id, q, unnest(range(1, len(l) + 1)) AS i, l FROM s), t AS (SELECT doc_id, i, l[i] AS s, q, {D.tokens("l[i]", 3)} AS t FROM e),
r AS (SELECT doc_id, i, s, len(list_filter(t, lambda w: list_contains(q, w))) AS hit, len(t) AS n FROM t WHERE len(q) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hit DESC, CASE WHEN n > 0 THEN hit / n ELSE 0 END DESC, i) AS rank FROM r WHERE hit >= 2 OR (n > 0 AND hit / n >= 0.25)),
o AS (SELECT doc_id, string_agg(CASE WHEN length(s) > 180 THEN substr(s, 1, 180) || '…' ELSE s END, chr(10) ORDER BY rank) AS x FROM k WHERE rank <= 3 GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(x, '')) AS snippets_md5 FROM d LEFT JOIN o USING (doc_id)"""


def inverted_index_rebuild(spark, d):
    """The words of a document, taken apart into an inverted index and put together again."""
    words = F.filter(F.split("text", T.SPACE), lambda w: w != "")
    index = S.table(spark, d, "documents").select("doc_id", words.alias("words")).where(F.size("words") > 0).select("doc_id", F.inline(F.array(F.struct(T.inverted(F.col("words")).alias("index")))))
    return index.select("doc_id", F.size("index").alias("n_words"), F.md5(T.rebuild(F.col("index")).cast("binary")).alias("text_md5"))


_INDEX_SQL = f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{D.SPACE}'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, CAST(len(list_distinct(w)) AS INTEGER) AS n_words, md5(array_to_string(w, ' ')) AS text_md5 FROM w WHERE len(w) > 0"""


def highlight_segments(spark, d):
    """Runs of every document's title that occur in the benchmark item with its number."""
    b = S.table(spark, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("words"))
    docs = S.works(spark, d).select(F.col("work_id").alias("doc_id"), "title", (F.col("work_id") % b.count()).alias("item_id"))
    rows = docs.join(b, "item_id")
    return rows.select("doc_id", F.posexplode(T.highlight(F.col("title"), F.col("words"))).alias("pos", "run")).select("doc_id", "pos", "run.text", "run.matched")


_HIGHLIGHT_SQL = f"""
WITH b AS (SELECT item_id, {D.tokens("text")} AS words FROM benchmark), t AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id, {D.first_line("text")} AS title FROM documents),
r AS (SELECT doc_id, regexp_extract_all(title, '[A-Za-z0-9{D.CJK}]+|[^A-Za-z0-9{D.CJK}]+') AS l, words FROM t JOIN b USING (item_id)),
e AS (SELECT doc_id, l, words, unnest(range(1, len(l) + 1)) AS i FROM r),
m AS (SELECT doc_id, i, l[i] AS run, length({D.norm("l[i]")}) >= 2 AND list_contains(words, {D.norm("l[i]")}) AS matched FROM e),
c AS (SELECT *, coalesce(matched <> lag(matched) OVER w, true) AS fresh FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM c)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, string_agg(run, '' ORDER BY i) AS text, any_value(matched) AS matched FROM g GROUP BY doc_id, pos"""


QUERIES = {
    "text_normalize": text_normalize,
    "token_stats": token_stats,
    "token_f1_topk": token_f1_topk,
    "title_similarity_loose": title_similarity(False),
    "title_similarity_strict": title_similarity(True),
    "title_coverage": title_coverage,
    "match_score_title": match_score("title"),
    "match_score_body": match_score("body"),
    "sentence_split": sentence_split,
    "sentence_mode": sentence_mode,
    "query_expansion": query_expansion,
    "match_sentence_report": match_sentence_report,
    "match_hit_merge": match_hit_merge,
    "abstract_snippets": abstract_snippets,
    "inverted_index_rebuild": inverted_index_rebuild,
    "highlight_segments": highlight_segments,
}

ORACLES = {
    "text_normalize": f"SELECT doc_id, md5({D.norm('text')}) AS normal_md5 FROM documents",
    "token_stats": f"SELECT origin, token, count(*) AS times FROM (SELECT 'documents' AS origin, unnest({D.tokens('text')}) AS token FROM documents UNION ALL SELECT 'benchmark', unnest({D.tokens('text')}) FROM benchmark) GROUP BY ALL",
    "token_f1_topk": f"WITH {_F1_PAIRS}, f AS (SELECT query_id, work_id, {D.rounded(D.harmonic('p', 'r'), 9)} AS f1 FROM pairs) SELECT query_id, work_id, f1, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f1 DESC, work_id) AS rank FROM f) WHERE rank <= 8",
    "title_similarity_loose": _title_similarity_sql(False),
    "title_similarity_strict": _title_similarity_sql(True),
    "title_coverage": f"WITH a AS (SELECT item_id AS query_id, {D.tokens('text')} AS ta FROM benchmark), b AS (SELECT doc_id AS work_id, {D.tokens(D.first_line('text'))} AS tb FROM documents) SELECT query_id, work_id, {D.rounded(D.share('tb', 'ta'))} AS coverage FROM a JOIN b ON list_has_any(ta, tb)",
    "match_score_title": _match_sql("title"),
    "match_score_body": _match_sql("body"),
    "sentence_split": f"SELECT conv_id, turn, pos, md5(sentence) AS sentence_md5, CAST(length(sentence) AS INTEGER) AS n_chars FROM {_SENTENCES}",
    "sentence_mode": f"SELECT conv_id, turn, pos, {D.mode('sentence')} AS mode FROM {_SENTENCES}",
    "query_expansion": f"SELECT conv_id, turn, pos, CASE WHEN length(k) > 24 THEN k END AS key_words FROM (SELECT conv_id, turn, pos, array_to_string({D.tokens('sentence', 3)}[:14], ' ') AS k FROM {_SENTENCES})",
    "match_sentence_report": _REPORT_SQL,
    "match_hit_merge": _HIT_MERGE_SQL,
    "abstract_snippets": _SNIPPETS_SQL,
    "inverted_index_rebuild": _INDEX_SQL,
    "highlight_segments": _HIGHLIGHT_SQL,
}
