"""One-hop citation neighbourhoods and their radial layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.linkage import top
from quillspark.operators.merge import first_wins, union_all


def neighbourhood(seeds: DataFrame, related: DataFrame, edges: DataFrame, works: DataFrame, most: int = 20, each: int = 8, most_related: int = 10, parts: int | None = None) -> DataFrame:
    """(seed, node, relation, pos, cited): related works, references and citing works of each seed,
    each node once in that priority.

    related: seed, node. edges: src cites dst. works: node, cited. Each list is cut to its length
    before it is joined to anything. With parts, edges and lists lie in so many partitions by what they are joined or cut by."""

    def dealt(rows: DataFrame, *by: str) -> DataFrame:
        return rows.repartition(parts, *by) if parts else rows

    edges = dealt(edges, "src", "dst").distinct() if parts else edges
    cited = works.select(F.col("node"), "cited")
    order = (F.desc("cited"), F.asc("node"))
    lists = [
        top(related.join(cited, "node"), "seed", most_related, *order).withColumn("relation", F.lit("related")),
        top(dealt(dealt(edges.select(F.col("src").alias("seed"), F.col("dst").alias("node")), "node").join(cited, "node"), "seed"), "seed", each, *order).withColumn("relation", F.lit("reference")),
        top(dealt(dealt(edges.select(F.col("dst").alias("seed"), F.col("src").alias("node")), "node").join(cited, "node"), "seed"), "seed", each, *order).withColumn("relation", F.lit("cited-by")),
    ]
    found = dealt(union_all(lists).where("seed <> node"), "seed").join(seeds.select("seed"), "seed", "left_semi")
    kept = first_wins(found, ["seed", "node"], F.asc("source_rank"), F.asc("rank"))
    placed = kept.withColumn("pos", F.row_number().over(Window.partitionBy("seed").orderBy("source_rank", "rank")))
    return placed.where(F.col("pos") <= most).select("seed", "node", "relation", "pos", "cited")


def stats(neighbours: DataFrame) -> DataFrame:
    """Counts of each seed's neighbourhood, the seed included in nodes."""
    kinds = [F.count_if(F.col("relation") == k).alias(f"n_{k.replace('-', '_')}") for k in ("related", "reference", "cited-by")]
    return neighbours.groupBy("seed").agg((F.count(F.lit(1)) + 1).alias("nodes"), F.count(F.lit(1)).alias("edges"), *kinds, F.when(F.count(F.lit(1)) >= 4, "rich").otherwise("sparse").alias("mode"))


def layout(neighbours: DataFrame) -> DataFrame:
    """x, y and node radius: by descending citations around the seed at (500, 270), on four rings."""
    w = Window.partitionBy("seed")
    i = F.row_number().over(w.orderBy(F.desc("cited"), F.asc("node"))) - 1
    n = F.count(F.lit(1)).over(w)
    angle = F.col("i") * 2 * F.pi() / F.col("n") - F.pi() / 2
    reach = 155 + 30 * (F.col("i") % 4)
    placed = neighbours.withColumns({"i": i, "n": n})
    return placed.select("seed", "node", "relation", "i", (500 + reach * F.cos(angle)).alias("x"), (270 + 0.82 * reach * F.sin(angle)).alias("y"), node_radius(F.col("cited")).alias("radius"))


def node_radius(cited: Column) -> Column:
    return F.greatest(F.lit(9.0), F.least(F.lit(30.0), 9 + 0.55 * F.sqrt(F.when(F.coalesce(cited, F.lit(0)) == 0, 1).otherwise(cited))))


def planned(seeds: DataFrame, lists: list[tuple[str, DataFrame, int]], works: DataFrame, most: int = 20) -> DataFrame:
    """(seed, node, relation, pos, loaded, cited) of every neighbour that is asked for, found or not.

    lists: relation, (seed, node, place) and how many places count, in order of precedence; a node that comes
    twice counts where it comes first, the seed never, and `most` are asked for. works: node, cited."""
    cut = [rows.where(F.col("place") <= n).select("seed", "node", "place", F.lit(relation).alias("relation")) for relation, rows, n in lists]
    asked = union_all(cut).where("seed <> node").join(seeds.select("seed"), "seed", "left_semi")
    once = first_wins(asked, ["seed", "node"], F.asc("source_rank"), F.asc("place"))
    placed = once.withColumn("pos", F.row_number().over(Window.partitionBy("seed").orderBy("source_rank", "place"))).where(F.col("pos") <= most)
    known = works.select("node", "cited", F.lit(True).alias("known"))
    return placed.join(known, "node", "left").select("seed", "node", "relation", "pos", F.coalesce("known", F.lit(False)).alias("loaded"), "cited")


def loaded_stats(seeds: DataFrame, asked: DataFrame) -> DataFrame:
    """Counts of what was loaded of each seed's neighbourhood, the seed included in nodes; failed are the
    neighbours that were asked for without being found. Seeds without neighbours have a row, too."""
    there = F.col("loaded")
    kinds = [F.count_if(there & (F.col("relation") == k)).alias(f"n_{k.replace('-', '_')}") for k in ("related", "reference", "cited-by")]
    counts = asked.groupBy("seed").agg(F.count_if(there).alias("edges"), F.count(F.lit(1)).alias("planned"), *kinds)
    rows = seeds.select("seed").join(counts, "seed", "left").fillna(0)
    #: Fixed value.
    warning = F.concat(F.lit("有 "), F.col("failed").cast("string"), F.lit(" 个邻居节点未能加载（上游超时或限流）"))
    rows = rows.withColumn("failed", F.col("planned") - F.col("edges"))
    return rows.select("seed", (F.col("edges") + 1).alias("nodes"), "edges", "n_related", "n_reference", "n_cited_by", "failed", F.when(F.col("edges") >= 4, "citation-neighborhood").otherwise("sparse-neighborhood").alias("mode"), F.when(F.col("failed") > 0, warning).alias("warning"))
