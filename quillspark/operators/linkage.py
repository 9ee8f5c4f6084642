"""Fuzzy linkage of queries and works by shared tokens, scored without a cross product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import similarity as sim
from quillspark.functions import text as T


def postings(table: DataFrame, key: str, text: str, least: int = 2, asked: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(key, token, times, size): each distinct token of a text, its count, and the text's token count. With asked,
    which has a column token, only tokens it has; others are dropped before they are counted. With parts, dealt out by key
    to so many partitions."""
    bags = table.select(F.col(key), T.tokens(F.col(text), least).alias("bag")).withColumn("size", F.size("bag"))
    words = only_asked(bags.select(key, "size", F.explode("bag").alias("token")), asked)
    return (words.repartition(parts, key) if parts else words).groupBy(key, "size", "token").agg(F.count(F.lit(1)).alias("times"))


#: Pairs that one task adds up.
_PAIRS_EACH = 500_000


def parts_for(queries: DataFrame, works: DataFrame) -> int:
    """How many partitions of works make _PAIRS_EACH pairs with all queries at most: in proportion to the input, so that
    what a task holds doesn't grow with it."""
    return parts_of(works, queries.count() * works.count())


#: Rows that one task sorts.
SORTED_EACH = 100_000


def parts_of(table: DataFrame, pairs: int, each: int | None = None) -> int:
    """How many partitions hold so many pairs, _PAIRS_EACH (or each) at most on average."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // (each or _PAIRS_EACH)))


def only_asked(words: DataFrame, asked: DataFrame | None) -> DataFrame:
    """Rows of words whose token asked has: with few enough tokens to broadcast, other words aren't shuffled."""
    return words if asked is None else words.join(asked.select("token").distinct(), "token", "left_semi")


def overlap(left: DataFrame, right: DataFrame, lkey: str, rkey: str, few: bool = False) -> DataFrame:
    """(lkey, rkey, precision, recall) of the pairs that share a token; both sides are postings. An
    equi-join on tokens: each side adds up its own multiplicities over the shared tokens. With few, all tasks get the left
    side, and pairs are added up where the right one lies by its key. The right side's postings of a token are the longer
    ones, so they pass by and those of the left are held."""
    l = left.select(lkey, "token", F.col("times").alias("lt"), F.col("size").alias("ls"))
    r = right.select(rkey, "token", F.col("times").alias("rt"), F.col("size").alias("rs"))
    return r.join(F.broadcast(l) if few else l, "token").groupBy(lkey, rkey).agg((F.sum("lt") / F.first("ls")).alias("precision"), (F.sum("rt") / F.first("rs")).alias("recall"))


def titled(table: DataFrame, title: str, name: str) -> DataFrame:
    """table with columns of its title that begin with name: _name, normalised; _bag, its tokens; and _core, the share of
    tokens that it shares with every title that is part of it, or that it is part of, where the shorter has 0.92 of the
    longer's length: those of the words that lie whole in the middle."""
    n, bag = F.col(f"{name}_name"), F.col(f"{name}_bag")
    edge = F.ceil(F.length(n) * 0.08).cast("int")
    middle = F.regexp_replace(F.substring(n, edge + 1, F.length(n) - 2 * edge), "^[^ ]*| [^ ]*$", "")
    rows = table.withColumns({f"{name}_name": T.normalize(F.col(title)), f"{name}_bag": T.tokens(F.col(title))})
    return rows.withColumn(f"{name}_core", F.when(F.size(bag) > 0, F.size(T.tokens(middle)) / F.size(bag)).otherwise(0.0))


def rare_first(left: DataFrame, lkey: str, lname: str, right: DataFrame, rkey: str, rname: str) -> tuple[DataFrame, DataFrame]:
    """Tokens of both sides' titles (of titled()) that the other side has: key, token, share (of the title's tokens),
    core, and often, how many titles of the right side have it."""

    def tokens_of(table: DataFrame, key: str, name: str) -> DataFrame:
        words = table.select(key, F.col(f"{name}_core").alias("core"), F.size(f"{name}_bag").alias("size"), F.explode(f"{name}_bag").alias("token"))
        return words.groupBy(key, "core", "size", "token").agg((F.count(F.lit(1)) / F.col("size")).alias("share"))

    l, r = tokens_of(left, lkey, lname), tokens_of(right, rkey, rname)
    often = r.groupBy("token").agg(F.count(F.lit(1)).alias("often")).join(l.select("token").distinct(), "token", "left_semi")
    return tuple(x.join(often, "token").select(key, "token", "share", "core", "often") for x, key in ((l, lkey), (r, rkey)))


def leading(words: DataFrame, key: str) -> DataFrame:
    """Of rare_first()'s tokens the rarest of each title, which a title that is similar has one of; how many were left out
    (n_out) with which share (out), and the largest share of one token. words also has f1, the least harmonic mean that
    counts: it takes f1 / (2 - f1) of either side's tokens, so the most frequent ones that add up to less can go."""
    least = F.least(F.col("f1") / (2 - F.col("f1")), F.col("core")) - 1e-9
    each = Window.partitionBy(key)
    frequent = F.sum("share").over(each.orderBy(F.desc("often"), "token").rowsBetween(Window.unboundedPreceding, 0))
    cut = words.withColumn("cut", frequent < least)
    out = {"out": F.sum(F.when(F.col("cut"), F.col("share")).otherwise(0.0)).over(each), "n_out": F.count_if("cut").over(each), "largest": F.max("share").over(each)}
    return cut.withColumns(out).where("not cut").drop("cut", "often")


def likely_pairs(left: DataFrame, right: DataFrame, lkey: str, rkey: str) -> DataFrame:
    """(lkey, rkey) of titles that may share tokens with a harmonic mean of the left one's f1 or more, or be parts of each other
    (see titled()). Both sides come from leading() and have blocks, of which a pair has one in common."""

    def side(words: DataFrame, key: str, s: str, *more: Column) -> DataFrame:
        return words.select(key, "token", F.explode("blocks").alias("block"), *[F.col(c).alias(f"{s}_{c}") for c in ("share", "core", "out", "n_out", "largest")], *more)

    met = side(left, lkey, "l", F.col("f1")).join(side(right, rkey, "r"), ["token", "block"])
    first = [F.first(c).alias(c) for c in ("f1", *(f"{s}_{c}" for s in "lr" for c in ("core", "out", "n_out", "largest")))]
    sums = met.groupBy(lkey, rkey).agg(F.sum("l_share").alias("l_sum"), F.sum("r_share").alias("r_sum"), *first)
    # Shared tokens that were not met come before the later of both cuts, so all of them were left out on that one's side.
    most = lambda a, b: F.col(f"{a}_sum") + F.greatest(F.col(f"{a}_out"), F.col(f"{b}_n_out") * F.col(f"{a}_largest")) + 1e-6
    rows = sums.withColumns({"p": most("l", "r"), "r": most("r", "l")})
    alike = sim.harmonic(F.col("p"), F.col("r")) >= F.col("f1")
    return rows.where(alike | ((F.col("p") >= F.col("l_core")) & (F.col("r") >= F.col("r_core")))).select(lkey, rkey)


def computed(table: DataFrame, **columns: Column) -> DataFrame:
    """table with columns that later filters read. A generator makes them, through which filters aren't pushed, so
    that a row's figures are computed once and not again in each filter."""
    return table.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def overlap_of(pairs: DataFrame, left: DataFrame, right: DataFrame, lkey: str, rkey: str) -> DataFrame:
    """The same of given pairs (lkey, rkey) only: their right postings meet the left ones by key and token."""
    r = pairs.join(right.select(rkey, "token", F.col("times").alias("rt"), F.col("size").alias("rs")), rkey)
    l = left.select(lkey, "token", F.col("times").alias("lt"), F.col("size").alias("ls"))
    return r.join(l, [lkey, "token"]).groupBy(lkey, rkey).agg((F.sum("lt") / F.first("ls")).alias("precision"), (F.sum("rt") / F.first("rs")).alias("recall"))


def with_parts(pairs: DataFrame, left: DataFrame, right: DataFrame, lkey: str, rkey: str) -> DataFrame:
    """pairs with holds, whether one normalised text is part of the other, and same. pairs: keys, and precision, recall, ls
    and rs, the shares of shared tokens and the numbers of all; left: lkey, na; right: rkey, nb. Of a text that is part of
    another all tokens but the first and the last are shared, so only pairs that lack two at most meet their texts."""
    lacks = lambda share, size: (1 - F.col(share)) * F.col(size) <= 2.001
    close = lacks("precision", "ls") | lacks("recall", "rs")
    texts = pairs.where(close).join(right.select(rkey, "nb"), rkey).join(left.select(lkey, "na"), lkey)
    near = texts.withColumns({"holds": F.contains("na", "nb") | F.contains("nb", "na"), "same": F.col("na") == F.col("nb")}).drop("na", "nb")
    return near.unionByName(pairs.where(~close).withColumns({"holds": F.lit(False), "same": F.lit(False)}))


def title_similarities(left: DataFrame, right: DataFrame, lkey: str, rkey: str, strict: bool) -> DataFrame:
    """(lkey, rkey, similarity) of all titles that share a token. left: lkey, na, normalised, and bag, its tokens; right:
    rkey, nb and bag. Texts are read once a title, and pairs carry numbers."""
    words = lambda x, key, n, *more: x.select(key, F.size("bag").alias("size"), F.length(n).alias("length"), *more, F.explode("bag").alias("token"))
    l = words(left, lkey, "na").groupBy(lkey, "size", "length", "token").agg(F.count(F.lit(1)).alias("lt")).withColumnsRenamed({"size": "ls", "length": "ll"})
    lead = F.array_distinct(F.slice("bag", 1, 2)).alias("lead")
    asked = only_asked(words(right, rkey, "nb", lead), l)
    r = asked.groupBy(rkey, "size", "length", "lead", "token").agg(F.count(F.lit(1)).alias("rt"))
    r = r.select(rkey, "token", "rt", F.col("size").alias("rs"), F.col("length").alias("rl"), F.size("lead").alias("leads"), F.array_contains("lead", F.col("token")).alias("leading"))
    sums = l.join(r, "token").groupBy(lkey, rkey, "ls", "ll", "rs", "rl", "leads").agg((F.sum("lt") / F.col("ls")).alias("precision"), (F.sum("rt") / F.col("rs")).alias("recall"), F.count_if("leading").alias("kept"))
    rows = with_parts(sums, left, right, lkey, rkey)
    figures = [F.col(c) for c in ("ll", "rl", "holds", "same", "precision", "recall")]
    return rows.select(lkey, rkey, sim.similarity_of_lengths(*figures, F.col("kept") < F.col("leads"), strict).alias("similarity"))


def token_f1_pairs(left: DataFrame, right: DataFrame, lkey: str, rkey: str, ltext: str, rtext: str, few: bool = False) -> DataFrame:
    """(lkey, rkey, f1) of the pairs that share a token; few: the left side is a list that doesn't grow with the right one."""
    l = postings(left, lkey, ltext)
    pairs = overlap(l, postings(right, rkey, rtext, asked=l, parts=parts_for(left, right) if few else None), lkey, rkey, few)
    return pairs.select(lkey, rkey, sim.harmonic(F.col("precision"), F.col("recall")).alias("f1"))


def top(table: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each key in a total order, with their rank."""
    return top_of(table, [key], k, *order)


def top_of(table: DataFrame, key: list[str], k: int, *order: Column) -> DataFrame:
    """The same for a key of several columns."""
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def match_pairs(queries: DataFrame, works: DataFrame, few: bool = False) -> DataFrame:
    """Figures of every (query, work) that share a token of the title or abstract.

    queries: query_id, phrase, mode. works: work_id, title, abstract. Returns query_id, work_id,
    title_score, abstract_score, coverage. few: the queries are a list that doesn't grow with the works, and all tasks get
    it; pairs are added up where the work lies."""
    q = postings(queries, "query_id", "phrase").withColumnsRenamed({"times": "asked", "size": "length"})
    # One row a word, marked where the title has it; both fields are counted and joined at once.
    word = lambda at: lambda w: F.struct(w.alias("token"), F.lit(at).alias("of_title"))
    bags = works.select("work_id", T.tokens(F.col("title")).alias("t"), T.tokens(F.col("abstract")).alias("a"))
    words = bags.select("work_id", F.size("t").alias("nt"), F.size("a").alias("na"), F.inline(F.concat(F.transform("t", word(1)), F.transform("a", word(0)))))
    words = only_asked(words, q)
    words = words.repartition(parts_for(queries, works), "work_id") if few else words
    w = words.groupBy("work_id", "nt", "na", "token").agg(F.sum("of_title").alias("t"), F.sum(1 - F.col("of_title")).alias("a"))
    asked_in = lambda c: F.sum(F.when(F.col(c) > 0, F.col("asked")).otherwise(0))
    sums = w.join(F.broadcast(q) if few else q, "token").groupBy("query_id", "work_id", "length", "nt", "na").agg(asked_in("t").alias("qt"), asked_in("a").alias("qa"), F.sum("t").alias("t"), F.sum("a").alias("a"))
    share = lambda part, whole: F.when(F.col(part) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    pairs = sums.select("query_id", "work_id", share("qt", "length").alias("tp"), share("t", "nt").alias("tr"), share("qa", "length").alias("ap"), share("a", "na").alias("ar"))
    # Wide columns join last, to the pairs only.
    named = works.select("work_id", T.normalize(F.col("title")).alias("nt"))
    asked = queries.select("query_id", "mode", T.normalize(F.col("phrase")).alias("nq"))
    return figures_of(pairs.join(named, "work_id").join(F.broadcast(asked) if few else asked, "query_id"), "query_id", "work_id", "mode")


def figures_of(pairs: DataFrame, *keep: str) -> DataFrame:
    """title_score, abstract_score and coverage from normalised texts nq and nt, shares of shared tokens by title
    (tp, tr) and abstract (ap, ar), and mode."""
    return pairs.select(
        *keep,
        sim.similarity_of_parts(F.col("nq"), F.col("nt"), F.col("tp"), F.col("tr")).alias("title_score"),
        sim.harmonic(F.col("ap"), F.col("ar")).alias("abstract_score"),
        F.when(F.col("mode") == "body", F.col("tr")).otherwise(0.0).alias("coverage"),
    )


def match_score(mode: Column, title: Column, abstract: Column, coverage: Column, year_hint: Column, year: Column, n_sources: Column, doi_hit: Column, cited: Column) -> Column:
    """Relevance of a work in [0, 1]; the steps apply in this order."""
    body = mode == "body"
    score = F.when(body, coverage * 0.5 + abstract * 0.4 + title * 0.15).otherwise(title * 0.88 + abstract * 0.08)
    steps = [
        lambda s: F.when(title >= 0.97, F.greatest(s, F.lit(0.98))).when(title >= 0.9, F.greatest(s, title * 0.96 + abstract * 0.04)).otherwise(s),
        lambda s: F.when(body & (abstract >= 0.3), F.greatest(s, abstract * 0.85 + coverage * 0.2)).otherwise(s),
        lambda s: F.when(body & (coverage >= 0.7), F.greatest(s, coverage * 0.82)).otherwise(s),
        lambda s: F.when(year_hint == year, F.least(F.lit(1.0), s + 0.03)).when(F.abs(year_hint - year) > 2, s * 0.85).otherwise(s),
        lambda s: F.when(n_sources > 1, F.least(F.lit(1.0), s + 0.02)).otherwise(s),
        lambda s: F.when(doi_hit, F.greatest(s, F.lit(0.99))).otherwise(s),
        lambda s: F.least(F.lit(1.0), s + F.least(F.lit(0.02), F.log10(F.coalesce(cited, F.lit(0)) + 1) / 200)),
    ]
    for step in steps:
        score = T.let(score, step)
    return score


def threshold(mode: Column) -> Column:
    """Least score of a match. Fixed values."""
    return F.when(mode == "title", 0.42).otherwise(0.22)


def score_label(score: Column) -> Column:
    #: Fixed values.
    return F.when(score >= 0.88, "高度匹配").when(score >= 0.68, "较可能").when(score >= 0.45, "相关候选").otherwise("弱相关")


def ranked_matches(queries: DataFrame, works: DataFrame, k: int = 8, few: bool = False) -> DataFrame:
    """The k best works of each query over its mode's threshold. queries also has year_hint, works also
    year, n_sources and cited. A work counts as asked by its DOI where queries have dois, in lower case,
    and works have doi. few: see match_pairs()."""
    by_doi = "dois" in queries.columns and "doi" in works.columns
    known = works.select("work_id", "year", "n_sources", "cited", *(["doi"] if by_doi else []))
    hints = queries.select("query_id", "year_hint", *(["dois"] if by_doi else []))
    pairs = match_pairs(queries, works, few).join(known, "work_id").join(F.broadcast(hints) if few else hints, "query_id")
    pairs = pairs.withColumn("doi_hit", F.coalesce(F.array_contains("dois", F.lower("doi")), F.lit(False)) if by_doi else F.lit(False)).drop("dois", "doi")
    score = match_score(*[F.col(c) for c in ("mode", "title_score", "abstract_score", "coverage", "year_hint", "year", "n_sources", "doi_hit", "cited")])
    # The threshold is on the score itself; nine decimals after it, so that the order of a float sum can't decide a rank.
    scored = pairs.withColumn("score", score).where(F.col("score") >= threshold(F.col("mode"))).withColumn("score", T.rounded(F.col("score"), 9))
    return top(scored, "query_id", k, F.desc("score"), F.desc("cited"), F.asc("work_id"))


def merge_hits(hits: DataFrame) -> DataFrame:
    """Hits of several sentences merged by key: the best score wins (the later of equals), sentences
    (up to 4) and reasons (up to 8) join in order of score, sources all. hits: key, pos, score, cited,
    sentence, reasons, sources."""
    best_first = F.reverse(F.array_sort(F.collect_list(F.struct("score", "pos", "sentence", "reasons", "sources", "cited"))))
    merged = hits.groupBy("key").agg(best_first.alias("x"))
    return merged.select(
        "key",
        F.get("x.score", F.lit(0)).alias("score"),
        F.get("x.cited", F.lit(0)).alias("cited"),
        F.get("x.pos", F.lit(0)).alias("winner_pos"),
        F.slice(F.array_distinct(F.col("x.sentence")), 1, 4).alias("sentences"),
        F.slice(F.array_distinct(F.flatten("x.reasons")), 1, 8).alias("reasons"),
        F.array_distinct(F.flatten("x.sources")).alias("sources"),
    )


def evidence(hits: DataFrame, queries: DataFrame, works: DataFrame, most: int = 24, most_missed: int = 16) -> DataFrame:
    """hits of ranked_matches with what speaks for them: year_status, matched and missed tokens of the
    title (missed for titles only), and reasons. Texts join the hits after the cut, not the pairs."""
    asked = queries.select("query_id", F.array_distinct(T.tokens(F.col("phrase"))).alias("asked"))
    titles = works.select("work_id", T.tokens(F.col("title")).alias("bag"))
    rows = hits.join(asked, "query_id").join(titles, "work_id")
    rows = rows.withColumns(
        {
            "year_status": year_status(F.col("year_hint"), F.col("year")),
            "matched": F.slice(F.array_intersect("asked", "bag"), 1, most),
            "missed": F.when(F.col("mode") == "title", F.slice(F.array_except("asked", "bag"), 1, most_missed)).otherwise(F.array().cast("array<string>")),
        }
    )
    return rows.withColumn("reasons", reasons(*[F.col(c) for c in ("mode", "title_score", "coverage", "abstract_score", "year_status", "doi_hit")])).drop("asked", "bag")


def year_status(hint: Column, year: Column) -> Column:
    """exact, near (two years apart at most), mismatch, or none where a year isn't known."""
    gap = F.abs(hint - year)
    return F.when(gap == 0, "exact").when(gap <= 2, "near").when(gap > 2, "mismatch").otherwise("none")


def reasons(mode: Column, title: Column, coverage: Column, abstract: Column, year: Column, doi_hit: Column, pmid_hit: Column | None = None, n_said: Column | None = None) -> Column:
    """What speaks for a hit, as it is shown: identifiers, shares, the year's status and how many sentences it was found
    by; a text of its own where nothing else does."""
    share = lambda name, c: F.concat(F.lit(f"{name} "), F.floor(c * 100 + 0.5).cast("string"), F.lit("%"))
    #: Fixed values.
    shown = [
        F.when(doi_hit, "DOI 直达"),
        *([] if pmid_hit is None else [F.when(pmid_hit, "PMID 一致")]),
        F.when(title >= 0.45, share("标题", title)),
        F.when((mode == "body") & (coverage >= 0.35), share("标题词覆盖", coverage)),
        F.when(abstract >= 0.2, share("摘要重叠", abstract)),
        F.when(year == "exact", "年份一致").when(year == "near", "年份接近").when(year == "mismatch", "年份不符"),
        *([] if n_said is None else [F.when(n_said > 0, F.concat(F.lit("命中 "), n_said.cast("string"), F.lit(" 句")))]),
    ]
    return T.let(F.array_compact(F.array(*shown)), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("弱词重叠"))))
