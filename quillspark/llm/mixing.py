"""Temperature mixing of sources under a token budget.

A source's weight is its share of all tokens to the power of an exponent between 0 (uniform) and 1
(as they are), normalised. The largest exponent whose entropy reaches the target is found by
bisection; where it would repeat some source more often than the limit allows, the smallest exponent
within the limit is taken instead (1 if there's none). Weights become token quotas of the budget. A
source with more quota than tokens repeats whole; for the rest of its quota its documents pass in a
pseudo-random permutation, by the hash of seed and doc_id, until the quota is spent (a document starts
while quota is left). block numbers the stretches of block_tokens tokens of that permutation.

Positions in a permutation are sums over hash buckets first and within a bucket then, so a source
that holds a third of all rows is spread over thousands of groups. Sources themselves stay in a table;
each bisection job gets back four steps' candidates of it.

Defined results: tokens are words; a null text has none; a null source counts as the empty name;
sources without tokens have no weight, and documents without tokens are passed at their place in the
permutation; repeated rows are documents of their own; an empty table gives no rows. Columns of docs
that clash with those added here are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, table

_STEPS_A_JOB, _JOBS = 4, 8
_WORD = r"[^\x20\x09-\x0D]+"


def exponent(shares: DataFrame, entropy_share: float, most_repeats: float, budget_share: float) -> float:
    """The exponent for shares (share double, positive); budget_share is the budget in units of all tokens."""
    n = shares.count()
    if n == 0:
        return 1.0
    target = entropy_share * float(shares.select(F.log(F.lit(float(n)))).first()[0])

    def figures(taus: list[float]) -> dict[float, tuple[float, float]]:
        """Entropy and most repeats at each exponent: a row for each in the end."""
        t = F.explode(F.array(*[F.lit(x) for x in taus])).alias("tau")
        power = F.pow("share", "tau")
        rows = shares.select("share", t).groupBy("tau").agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("s"), F.max(power / F.col("share")).alias("r"))
        return {r["tau"]: (float(math.log(r["z"]) - r["tau"] * r["s"] / r["z"]), r["r"] / r["z"] * budget_share) for r in rows.collect()}

    def bisect(holds_below) -> float:
        """Bisection of [0, 1]; a job evaluates the midpoints that the next steps can reach."""
        lo, hi = 0.0, 1.0
        for _ in range(_JOBS):
            parts = 1 << _STEPS_A_JOB
            grid = [lo + (hi - lo) * k / parts for k in range(1, parts)]
            seen = figures(grid)
            a, b = 0, parts
            while b - a > 1:
                mid = (a + b) // 2
                if holds_below(seen[grid[mid - 1]]):
                    a = mid
                else:
                    b = mid
            lo, hi = lo + (hi - lo) * a / parts, lo + (hi - lo) * b / parts
        return lo

    ends = figures([0.0, 1.0])
    tau = 1.0 if ends[1.0][0] >= target else bisect(lambda f: f[0] >= target)
    if figures([tau])[tau][1] > most_repeats:
        tau = 1.0 if ends[1.0][1] > most_repeats else bisect(lambda f: f[1] > most_repeats)
    return tau


def mix(docs: DataFrame, entropy_share: float = 0.95, most_repeats: float = 4.0, budget_share: float = 1.0, seed: int = 17, block_tokens: int = 100_000) -> DataFrame:
    """docs with n_tokens, weight (of the source, six decimals), repeats and block."""
    added = ("n_tokens", "weight", "repeats", "block")
    rows = docs.drop(*[c for c in docs.columns if c.lower() in (*added, "source_name", "order_key", "bucket")])
    rows = rows.withColumns(
        {
            "n_tokens": F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(_WORD)).cast("long"),
            "source_name": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "order_key": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")),
        }
    ).withColumn("bucket", F.substring("order_key", 1, 3))
    buckets = materialize(rows.groupBy("source_name", "bucket").agg(F.sum("n_tokens").alias("bucket_tokens")), "mix-buckets")
    totals = buckets.groupBy("source_name").agg(F.sum("bucket_tokens").alias("tokens")).where("tokens > 0")
    every = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shares = materialize(totals.withColumn("share", F.col("tokens") / F.lit(float(max(every, 1)))), "mix-shares")
    tau = exponent(shares, entropy_share, most_repeats, budget_share)
    z = shares.agg(F.coalesce(F.sum(F.pow("share", F.lit(tau))), F.lit(1.0))).first()[0]
    budget = int(every * budget_share)
    weight = F.pow("share", F.lit(tau)) / F.lit(z)
    quota = F.floor(weight * budget + 1e-6)
    plan = shares.select(
        "source_name", (F.floor(weight * 1e6 + 0.5) / 1e6).alias("weight"), (quota - quota % F.col("tokens")).alias("whole"), (quota % F.col("tokens")).alias("rest"), "tokens"
    ).select("source_name", "weight", (F.col("whole") / F.col("tokens")).cast("long").alias("epochs"), "rest")
    before = F.coalesce(F.sum("bucket_tokens").over(Window.partitionBy("source_name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = buckets.withColumn("bucket_before", before).join(plan, "source_name", "left").drop("bucket_tokens")
    within = Window.partitionBy("source_name", "bucket").orderBy("order_key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("tokens_before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(placed, ["source_name", "bucket"], "left")
    start = F.col("bucket_before") + F.col("tokens_before")
    out = joined.withColumns(
        {
            "repeats": F.coalesce(F.col("epochs") + F.when(start < F.col("rest"), 1).otherwise(0), F.lit(0)).cast("long"),
            "block": F.floor(start / F.lit(block_tokens)).cast("long"),
            "weight": F.coalesce("weight", F.lit(0.0)),
        }
    )
    return out.select(*[c for c in rows.columns if c not in ("source_name", "order_key", "bucket", "n_tokens")], *added)


def plan(spark, sf_dir: str) -> DataFrame:
    """Query op5_mixing: how often each document passes, and in which block."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).drop("text")


def oracle(documents: str, entropy_share: float = 0.95, most_repeats: float = 4.0, seed: int = 17, block_tokens: int = 100_000) -> str:
    """DuckDB SQL of mix() over the relation `documents` with doc_id, source, text."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS n_tokens, md5('{seed}:' || doc_id) AS k FROM {documents}),
t AS (SELECT s, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY s HAVING sum(n_tokens) > 0),
p AS (SELECT s, tokens, tokens / (SELECT sum(tokens) FROM t)::DOUBLE AS share FROM t),
l AS (SELECT list(share) AS ps, {entropy_share} * ln(count(*)) AS target FROM p),
e(i, lo, hi) AS (
    SELECT 0, CASE WHEN h >= target THEN 1.0::DOUBLE ELSE 0.0 END, 1.0::DOUBLE FROM (SELECT target, -list_sum(list_transform(ps, lambda x: x * ln(x))) AS h FROM l)
    UNION ALL
    SELECT i + 1, CASE WHEN h >= target THEN mid ELSE lo END, CASE WHEN h >= target THEN hi ELSE mid END
    FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, target, ln(list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2)))) - (lo + hi) / 2 * list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2) * ln(x)))
        / list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2))) AS h FROM e, l WHERE i < {_JOBS * _STEPS_A_JOB})),
t1 AS (SELECT lo AS tau FROM e WHERE i = {_JOBS * _STEPS_A_JOB}),
r(i, lo, hi) AS (
    SELECT 0, CASE WHEN 1 > {most_repeats} THEN 1.0::DOUBLE ELSE 0.0 END, 1.0::DOUBLE
    UNION ALL
    SELECT i + 1, CASE WHEN h > {most_repeats} THEN mid ELSE lo END, CASE WHEN h > {most_repeats} THEN hi ELSE mid END
    FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, list_max(list_transform(ps, lambda x: pow(x, (lo + hi) / 2) / x)) / list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2))) AS h FROM r, l WHERE i < {_JOBS * _STEPS_A_JOB})),
tau AS (SELECT CASE WHEN list_max(list_transform(ps, lambda x: pow(x, t1.tau) / x)) / list_sum(list_transform(ps, lambda x: pow(x, t1.tau))) > {most_repeats}
    THEN (SELECT lo FROM r WHERE i = {_JOBS * _STEPS_A_JOB}) ELSE t1.tau END AS tau FROM t1, l),
w AS (SELECT s, tokens, pow(share, tau) / sum(pow(share, tau)) OVER () AS weight, CAST(floor(pow(share, tau) / sum(pow(share, tau)) OVER () * (SELECT sum(tokens) FROM t)::DOUBLE + 1e-6) AS BIGINT) AS quota FROM p, tau),
c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY s ORDER BY k, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d)
SELECT doc_id, source, n_tokens, coalesce(floor(weight * 1e6 + 0.5) / 1e6, 0) AS weight,
    coalesce(quota // tokens + CASE WHEN start < quota % tokens THEN 1 ELSE 0 END, 0)::BIGINT AS repeats, (start // {block_tokens})::BIGINT AS block
FROM c LEFT JOIN w ON c.s = w.s"""


ORACLE = oracle("documents")
