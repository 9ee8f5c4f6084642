"""The k best documents of each question, without scoring every document that shares a word with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import normalize, rounded
from quillspark.operators.linkage import parts_of
from quillspark.sources.staging import Stage

#: Scores are rounded to six digits before they are ranked, so bounds give way by as much.
_GIVE = 1e-6


#: Terms that are sent to all tasks: 40 MB at most.
_SENT = 500_000


def best(terms: DataFrame, postings: DataFrame, key: list[str], stage: Stage, probe: int = 500) -> DataFrame:
    """(key, doc, score, rank) of the k best documents of each question by the sum of factor * weight over
    the postings that a term names; ties go to the smaller doc.

    terms: key, space, token, library, factor, k. postings: space, token, doc, mask, weight, written; a term reads
    those whose mask has its library's bit. Up to 500,000 terms go to the postings, which lie by document, so that sums need no exchange
    and only k rows a question leave a task; how many partitions they lie in follows from the pairs that are added up. More terms go the way of bounds."""
    terms = stage(terms)
    n, most = terms.agg(F.count(F.lit(1)), F.coalesce(F.max("k"), F.lit(0))).first()
    if n > _SENT:
        return best_by_bounds(terms, postings, key, stage, probe)
    on = ["space", "token"]
    pairs = postings.groupBy(*on).agg(F.count(F.lit(1)).alias("df")).join(terms.select(*on), on).agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0] if n else 0
    hits = postings.repartition(parts_of(postings, pairs), "doc").join(F.broadcast(terms), on) if n else postings.join(terms, on)
    sums = hits.where(F.getbit("mask", F.col("library")) == 1).groupBy(*key, "doc", "k").agg(rounded(F.sum(F.col("factor") * F.col("weight"))).alias("score"))
    return _ranked(sums, key, most)


def _ranked(scored: DataFrame, key: list[str], most: int) -> DataFrame:
    """most, a number that no k exceeds, is what Spark cuts each task's rows to before they are shuffled."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), F.asc("doc")))
    return scored.withColumn("rank", place).where(F.col("rank") <= most).where(F.col("rank") <= F.col("k")).select(*key, "doc", "score", "rank")


def best_by_bounds(terms: DataFrame, postings: DataFrame, key: list[str], stage: Stage, probe: int = 500) -> DataFrame:
    """The same where terms are too many to be sent, in three steps: the postings of a question's rarest words
    (about `probe` of them, one word at least) name documents whose full scores the k-th best can't fall below;
    words whose largest weights together stay below that score are optional, and only documents with another
    word are candidates; of these, the ones that optional words can't lift over the score go, and the
    optional weights of the rest are fetched by document."""
    on = ["space", "token"]
    bounds = postings.groupBy(*on).agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("largest"))
    known = stage(terms.join(bounds, on).withColumn("most", F.col("factor") * F.col("largest")))
    each = Window.partitionBy(*key)
    own = F.getbit("mask", F.col("library")) == 1
    weight = F.sum(F.col("factor") * F.col("weight"))
    rare = known.withColumn("seen", F.sum("df").over(each.orderBy("df", "token"))).where((F.col("seen") <= probe) | (F.col("seen") == F.col("df")))
    early = rare.join(postings, on).where(own).groupBy(*key, "doc", "k").agg(weight.alias("sum"))
    place = F.row_number().over(each.orderBy(F.desc("sum"), F.asc("doc")))
    tried = early.withColumn("place", place).where(F.col("place") <= 4 * F.col("k")).select(*key, "doc", "k")
    full = tried.join(known.select(*key, *on, "factor"), key).join(postings, [*on, "doc"]).groupBy(*key, "doc", "k").agg(weight.alias("sum"))
    reached = full.withColumn("place", place).where("place = k").select(*key, F.col("sum").alias("reached"))
    below = F.sum("most").over(each.orderBy("most", "token"))
    ordered = known.join(reached, key, "left").withColumn("below", below).withColumn("optional", F.coalesce(F.col("below") * (1 + 1e-9) < F.col("reached") - _GIVE, F.lit(False)))
    ordered = stage(ordered.withColumn("rest", F.coalesce(F.max(F.when(F.col("optional"), F.col("below"))).over(each), F.lit(0.0))))
    some = ordered.where("not optional").join(postings, on).where(own).groupBy(*key, "doc", "k").agg(weight.alias("sure"), F.first("reached").alias("reached"), F.first("rest").alias("rest"))
    candidates = stage(some.where(F.col("reached").isNull() | (F.col("sure") + F.col("rest") * (1 + 1e-9) >= F.col("reached") - _GIVE)).select(*key, "doc", "k", "sure"))
    wanted = candidates.select(*key, "doc").join(ordered.where("optional").select(*key, *on, "factor"), key)
    more = wanted.join(postings, [*on, "doc"]).groupBy(*key, "doc").agg(weight.alias("more"))
    scored = candidates.join(more, [*key, "doc"], "left").withColumn("score", rounded(F.col("sure") + F.coalesce("more", F.lit(0.0))))
    return _ranked(scored, key, terms.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0])


def phrases(asked: DataFrame, docs: DataFrame, key: list[str], stage: Stage) -> DataFrame:
    """(key, doc, times, size) of the documents that hold a phrase, word for word, and how often; size is
    the document's number of words. Phrases and texts (asked: key, phrase; docs: doc, text) are compared in
    normal form, so that a phrase runs on over lines and punctuation. A phrase without words is nowhere.

    The places of a phrase's rarest word are its candidates; the other words have to stand at their
    distance from it, which is an equi-join on document, place and word."""

    def words(text: str):
        return F.filter(F.split(normalize(F.col(text)), " "), lambda w: w != "")

    spelled = stage(asked.select(*key, words("phrase").alias("words")).select(*key, F.size("words").alias("n"), F.posexplode("words").alias("at", "word")))
    texts = docs.select("doc", words("text").alias("words")).select("doc", F.size("words").alias("size"), F.posexplode("words").alias("spot", "word"))
    places = stage(texts.join(spelled.select("word").distinct(), "word", "left_semi"))
    often = places.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    rarest = spelled.join(often, "word", "left").groupBy(*key, "n").agg(F.min_by(F.struct("word", "at"), F.struct(F.coalesce("often", F.lit(0)), "at")).alias("r")).select(*key, "n", "r.word", "r.at")
    starts = rarest.join(places, "word").select(*key, "n", "doc", "size", (F.col("spot") - F.col("at")).alias("start")).where("start >= 0 and start + n <= size")
    wanted = starts.join(spelled.select(*key, "at", "word"), key).withColumn("spot", F.col("start") + F.col("at"))
    there = wanted.join(places.select("doc", "spot", "word"), ["doc", "spot", "word"]).groupBy(*key, "doc", "size", "n", "start").agg(F.count(F.lit(1)).alias("same")).where("same = n")
    return there.groupBy(*key, "doc", "size").agg(F.count(F.lit(1)).alias("times"))
