"""Candidates for a title or a passage from five libraries, merged into one list and ranked.

Every library holds a part of the works and has its own fields: how it is asked, how many rows it gives,
whether it knows DOIs and abstracts. All of them are searched over one index of the asked words. Passages are asked a second time by their key words in three libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import linkage as L
from quillspark.operators.merge import coalescing_merge
from quillspark.operators.topk import best, phrases
from quillspark.sources.staging import Stage

#: Names of the libraries, in order of precedence, and how many rows each gives.
NAMES = ("文献库", "登记库", "语义索引", "医学库", "欧洲库")
ROWS = (10, 8, 8, 8, 8)
#: Fixed values: (library, field, longest phrase) of what is asked by title, of a passage, where a title finds
#: nothing, and of the key words. Field 0 is the title, 1 the text; None is a phrase in the title.
TITLE = ((0, 0, 160), (1, 0, 200), (2, 1, 300), (3, 0, 200), (4, None, 160))
BODY = ((0, 1, 220), (1, 0, 220), (2, 1, 300), (3, 1, 220), (4, 1, 250))
AGAIN = ((0, 1, 180), (3, 1, 200))
SECOND = ((0, 1, None), (2, 1, None), (3, 1, None))
_KEY = ["query_id", "list"]


def _bit(mask: Column, library: Column | int) -> Column:
    return F.getbit(mask, F.lit(library) if isinstance(library, int) else library) == 1


def index(works: DataFrame, words: DataFrame, stage: Stage, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Postings (space, token, doc, mask, weight) of the words asked for, and their factors (library, space, token, factor)
    in each library: BM25 in two parts. A space is a field. works: work_id, mask (a bit for each library),
    title, text. One pass over the texts: each field also gives an empty token, which brings its size for count
    and mean."""
    fields = F.explode(F.array(*[F.struct(F.lit(i).alias("space"), T.tokens(F.col(c)).alias("bag")) for i, c in enumerate(("title", "text"))]))
    bags = works.select(F.col("work_id").alias("doc"), "mask", fields.alias("f")).select("doc", "mask", "f.space", F.size("f.bag").alias("size"), F.explode(F.concat("f.bag", F.array(F.lit("")))).alias("token"))
    wanted = words.select("token").distinct().unionByName(words.sparkSession.range(1).select(F.lit("").alias("token")))
    counted = stage(bags.join(wanted, "token", "left_semi").groupBy("doc", "mask", "space", "size", "token").agg(F.count(F.lit(1)).alias("times")))
    held = [F.count_if(_bit(F.col("mask"), l)).alias(f"n{l}") for l in range(len(NAMES))]
    of_library = F.inline(F.array(*[F.struct(F.lit(l).alias("library"), F.col(f"n{l}").alias("n")) for l in range(len(NAMES))]))
    size = counted.where("token = ''").groupBy("space").agg(F.avg("size").alias("mean"), *held)
    hits = counted.where("token <> ''")
    df = hits.groupBy("space", "token").agg(*held).select("space", "token", of_library).withColumnRenamed("n", "df").where("df > 0")
    factor = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (k1 + 1)
    factors = df.join(size.select("space", of_library), ["space", "library"]).select("library", "space", "token", factor.alias("factor"))
    weight = F.col("times") / (F.col("times") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return stage(hits.join(F.broadcast(size.select("space", "mean")), "space").select("space", "token", "doc", "mask", weight.alias("weight"))), stage(factors)


def _asks(queries: DataFrame, mode: str, lists, first: int = 0, text: Column | None = None, whole: bool = False) -> DataFrame:
    """One row for each query and list: query_id, list, library, field, phrase, k. whole: phrases of any length."""
    phrase = F.col("phrase") if text is None else text

    def row(i: int, library: int, field: int | None, most: int | None) -> Column:
        said = F.trim(F.regexp_replace(F.regexp_replace(phrase, r"[|:<>]", " "), rf"{T.SPACE}+", " ")) if (library, field, mode) == (0, 0, "title") else phrase
        said = F.substring(said, 1, most) if most and not whole else said
        return F.struct(F.lit(first + i).alias("list"), F.lit(library).alias("library"), F.lit(field).cast("int").alias("field"), said.alias("phrase"), F.lit(ROWS[library]).alias("k"))

    rows = F.array(*[row(i, *x) for i, x in enumerate(lists)])
    return queries.where(F.col("mode") == mode).select("query_id", F.inline(rows)).where("phrase is not null")


def _terms(asks: DataFrame, factors: DataFrame) -> DataFrame:
    words = asks.select(*_KEY, "library", F.col("field").alias("space"), "k", F.explode(F.array_distinct(T.tokens(F.col("phrase")))).alias("token"))
    return words.join(factors, ["library", "space", "token"])


def candidates(queries: DataFrame, works: DataFrame, stage: Stage, second: bool = True, whole: bool = False) -> DataFrame:
    """(query_id, list, library, work_id, rank): what each library gives, in the order of lists. queries:
    query_id, phrase, text, mode. whole: libraries are asked phrases in full, however long."""
    by_title, by_body = _asks(queries, "title", TITLE, whole=whole), _asks(queries, "body", BODY, whole=whole)
    again = _asks(queries, "title", AGAIN, whole=whole).withColumn("list", F.col("library"))
    asks = [by_body.where("field is not null")]
    if second:
        asks.append(_asks(queries, "body", SECOND, len(NAMES), T.key_words(F.col("text"))))
    titles = stage(by_title)
    every = titles.where("field is not null").unionByName(again)
    for a in asks:
        every = every.unionByName(a)
    postings, factors = index(works, stage(every.select(F.explode(T.tokens(F.col("phrase"))).alias("token")).distinct()), stage)
    found = stage(best(_terms(titles.where("field is not null"), factors), postings, _KEY, stage))
    # Titles that nothing answers to are asked for in the whole text.
    thin = again.join(found.select(*_KEY).distinct(), _KEY, "left_anti")
    for a in asks:
        thin = thin.unionByName(a)
    more = best(_terms(thin, factors), postings, _KEY, stage).withColumnRenamed("doc", "work_id")
    quoted = titles.where("field is null").select(*_KEY, "k", F.regexp_replace("phrase", '"', "").alias("phrase"))
    held = phrases(quoted.drop("k"), works.where(_bit(F.col("mask"), len(NAMES) - 1)).select(F.col("work_id").alias("doc"), F.col("title").alias("text")), _KEY, stage)
    place = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.desc("times"), F.asc("size"), F.asc("doc")))
    exact = held.withColumn("rank", place).where(F.col("rank") <= ROWS[-1]).withColumnRenamed("doc", "work_id")
    rows = found.withColumnRenamed("doc", "work_id").unionByName(more).select(*_KEY, "work_id", "rank").unionByName(exact.select(*_KEY, "work_id", "rank"))
    asked_again = F.element_at(F.array(*[F.lit(l) for l, _, _ in SECOND]), F.greatest(F.col("list") - len(NAMES) + 1, F.lit(1)))
    return rows.withColumn("library", F.when(F.col("list") < len(NAMES), F.col("list")).otherwise(asked_again))


def merged(found: DataFrame, works: DataFrame) -> DataFrame:
    """(query_id, key, work_id, abstract_of, year, cited, sources, n_sources, place, lists): candidates of one
    DOI, or without DOI of one normalised title, as one row. The first row that has a field gives it, citations are the
    largest, sources join in order. works: work_id, title, year, cited, and dois and abstracts (a bit for
    each library that knows them). Rows without title are dropped."""
    known = works.select("work_id", "year", "cited", "dois", "abstracts", F.lower("doi").alias("doi"), T.normalize(F.col("title")).alias("name"), (F.coalesce("title", F.lit("")) != "").alias("titled"))
    rows = found.join(known, "work_id").where("titled")
    key = F.when(_bit(F.col("dois"), F.col("library")), F.coalesce(F.nullif("doi", F.lit("")), F.col("name"))).otherwise(F.col("name"))
    names = F.element_at(F.array(*map(F.lit, NAMES)), F.col("library") + 1)
    rows = rows.select("query_id", key.alias("key"), F.struct("list", "rank").alias("place"), "work_id", F.when(_bit(F.col("abstracts"), F.col("library")), F.col("work_id")).alias("abstract_of"), "year", "cited", names.alias("sources"), "list")
    one = coalescing_merge(rows.withColumn("first_place", F.col("place")), ["query_id", "key"], F.col("place"), {"work_id": "id", "abstract_of": "id", "year": "number", "first_place": "place"}, ["cited"], ["sources"])
    lists = rows.groupBy("query_id", "key").agg(F.min("list").alias("first_list"))
    return one.join(lists, ["query_id", "key"]).withColumn("n_sources", F.size(F.split("sources", ",")))


def ranked(queries: DataFrame, rows: DataFrame, works: DataFrame, stage: Stage, k: int = 8) -> DataFrame:
    """The k best rows of merged() for each query, over its mode's threshold: scored against the query's
    text by the title of work_id and the abstract of abstract_of, and only those. queries: query_id, text, mode, year_hint."""
    pairs = rows.select("query_id", "work_id").distinct(), rows.where("abstract_of is not null").select("query_id", F.col("abstract_of").alias("work_id")).distinct()
    asked = stage(L.postings(queries, "query_id", "text"))
    tables = []
    for some, column, names in zip(pairs, ("title", "text"), (("tp", "tr"), ("ap", "ar")), strict=True):
        bags = L.postings(works.join(some.select("work_id").distinct(), "work_id", "left_semi"), "work_id", column)
        tables.append(L.overlap_of(some, asked, bags, "query_id", "work_id").withColumnsRenamed({"precision": names[0], "recall": names[1]}))
    title, body = tables
    joined = rows.join(title, ["query_id", "work_id"], "left").join(body.withColumnRenamed("work_id", "abstract_of"), ["query_id", "abstract_of"], "left").fillna(0.0, ["tp", "tr", "ap", "ar"])
    joined = joined.join(works.select("work_id", T.normalize(F.col("title")).alias("nt")), "work_id").join(queries.select("query_id", "mode", "year_hint", T.normalize(F.col("text")).alias("nq")), "query_id")
    parts = L.figures_of(joined, *[c for c in joined.columns if c not in ("nq", "nt", "tp", "tr", "ap", "ar")])
    score = L.match_score(*[F.col(c) for c in ("mode", "title_score", "abstract_score", "coverage", "year_hint", "year", "n_sources")], F.lit(False), F.col("cited"))
    scored = parts.withColumn("score", T.rounded(score, 9)).where(F.col("score") >= L.threshold(F.col("mode")))
    return L.top(scored, "query_id", k, F.desc("score"), F.desc("cited"), F.asc("first_place"))
