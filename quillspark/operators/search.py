"""Relevance search over an inverted index. The ranking (BM25) is this engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import rounded, tokens
from quillspark.operators.linkage import parts_of, top
from quillspark.sources.staging import Stage

#: Terms that are sent to all tasks: 40 MB at most.
SENT = 500_000


def bm25(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, query_text: str, doc_text: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score, rank) of the k best documents of each query.

    Queries of equal words are searched for once. Their distinct tokens filter the words of the documents, which are taken
    apart once: each also gives an empty token, which brings its size for count and mean. Terms that are few enough go to the
    hits, which lie by document, so that scores are added up there, and only k rows a query leave a task; partitions
    are in proportion to what is added up."""
    with Stage(docs.sparkSession) as stage:
        said = stage(queries.select(query_key, F.array_sort(F.array_distinct(tokens(F.col(query_text)))).alias("said")).where(F.size("said") > 0))
        once = said.groupBy("said").agg(F.min(query_key).alias("_once"))
        asked = once.select("_once", F.explode("said").alias("token"))
        wanted = asked.select("token").distinct().unionByName(docs.sparkSession.range(1).select(F.lit("").alias("token")))
        bags = docs.select(doc_key, tokens(F.col(doc_text)).alias("bag"))
        words = bags.select(doc_key, F.size("bag").alias("size"), F.explode(F.concat("bag", F.array(F.lit("")))).alias("token"))
        counted = stage(words.join(wanted, "token", "left_semi").groupBy(doc_key, "size", "token").agg(F.count(F.lit(1)).alias("times")))
        n, mean = counted.where("token = ''").select(F.count(F.lit(1)), F.avg("size")).first()
        hits = counted.where("token <> ''")
        terms = stage(asked.join(hits.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token"))
        n_terms, pairs = terms.select(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * F.col("times") * (k1 + 1) / (F.col("times") + k1 * (1 - b + b * F.col("size") / (mean or 1.0)))
        met = hits.repartition(parts_of(docs, pairs), doc_key).join(F.broadcast(terms), "token") if n_terms <= SENT else hits.join(terms, "token")
        scored = met.groupBy("_once", doc_key).agg(rounded(F.sum(weight)).alias("score"))
        found = top(scored, "_once", k, F.desc("score"), F.asc(doc_key))
        return stage.keep(said.join(once.join(found, "_once"), "said").select(query_key, doc_key, "score", "rank"))
