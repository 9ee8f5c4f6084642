"""Hard-negative mining over lists that the anchors of a cluster share.

Anchors are clustered by direction. For a cluster with centre c whose members lie within an angle r of it,
a row x can score at most |u| |x| cos(max(0, angle(c, x) - r)) with a member u: one bound for all members.
Sorted by that bound, the rows are the cluster's shared list. Every member walks it in strips and stops
when what follows can't reach its results any more, so that the results are exact whatever the clusters.

On Spark a list is never in one place. A row's bounds are stored as levels of a 32nd octave, a short for each
cluster, and a histogram of levels cuts each list into a head and a rest. Lists and members are dealt to
groups of about `CHUNK` rows by 512 members; each group sorts its rows and walks them. The head gives every
member a score to beat, and of the rest only levels that can beat it for some member are dealt at all.
Two walks find the positives (rows of the anchor's label) and then, for each of them, the negatives (rows of
other labels whose score lies in a band below the positive's).

Centres, one for `per_cluster` anchors and most_clusters at most, are fitted on at most `sample` anchors, those
of the smallest hashes; the fit moves work, not results.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part. Equal
rows count once; rows that share an id but not all else are rows of their own, none of them a positive or
negative of the anchor with their id. A shorter vector counts as filled up with zeros. Ties go to the smaller
id. Positives of a negative score have no negatives, as the band is empty. An empty table gives no rows;
extra columns are not read. Products are exact integers: in floating point while they fit 53 bits, otherwise
in whole numbers of any length; scores have to fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, release, table

CHUNK, MEMBERS = 1024, 512
_STRIP = 128
_OCTAVE = 32
_LOWEST = -32_000
_NO_LIMIT = 1 << 62
_SLACK = 1e-6


def _matrix(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column as integers, filled up with zeros to the longest, or cut or filled to width."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width or int(sizes.max(initial=0))), dtype=np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        body = flat.reshape(len(sizes), sizes[0])[:, : out.shape[1]]
        out[:, : body.shape[1]] = body
    else:
        at = np.concatenate([[0], np.cumsum(sizes)])
        for i, n in enumerate(sizes):
            part = flat[at[i] : at[i] + min(n, out.shape[1])]
            out[i, : len(part)] = part
    return out


def _norms(lists: pa.Array) -> np.ndarray:
    return np.sqrt((_matrix(lists).astype(float) ** 2).sum(axis=1))


def _angles(rows: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angles of rows and unit centres; a right angle for rows without direction."""
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(norms[:, None] > 0, (rows.astype(float) @ centres.T) / norms[:, None], 0.0)
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _bounds(angles: np.ndarray, norms: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Most that a member of length one can score, for rows (down) and clusters (across)."""
    return norms[:, None] * np.cos(np.maximum(0.0, angles - radius - _SLACK)) * (1 + 1e-12)


def _levels(bounds: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(bounds > 0, np.clip(np.floor(np.log2(bounds) * _OCTAVE), _LOWEST + 1, 32_000), _LOWEST).astype(np.int16)


def centres_of(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means: unit centres, started from the first k vectors."""
    rows = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    centres = rows[:k].copy()
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as 64-bit numbers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def _best(slot: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the first k entries of each slot by descending score, then id; equal entries once."""
    order = np.lexsort((ids, -scores, slot))
    s, i, v = slot[order], ids[order], scores[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1]) | (v[1:] != v[:-1])
    order, s = order[fresh], s[fresh]
    return order[np.arange(len(s)) - np.searchsorted(s, s) < k]


def _walker(centres: np.ndarray, radius: np.ndarray, k: int, same: bool) -> Callable:
    """A group's walk: members (with the slots to fill) and a part of their cluster's list."""

    def walk(key: tuple, members: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["anchor_id", "anchor_hash", "slot", "id", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        if not members.num_rows or not rows.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        cluster = key[0].as_py() if hasattr(key[0], "as_py") else key[0]
        a, b = _matrix(members["v"]), _matrix(rows["v"])
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
        c = np.zeros((1, width))
        c[0, : min(width, centres.shape[1])] = centres[cluster, :width]
        norms = np.sqrt((b.astype(float) ** 2).sum(axis=1))
        bound = _bounds(_angles(b, norms, c), norms, radius[cluster : cluster + 1])[:, 0]
        order = np.argsort(-bound, kind="stable")
        b, bound, ids, labels = b[order], bound[order], rows["vec_id"].to_numpy()[order], rows["label"].to_numpy()[order]
        length = np.sqrt((a.astype(float) ** 2).sum(axis=1))
        anchor, own = members["vec_id"].to_numpy(), members["label"].to_numpy()
        slots = members["slots"].combine_chunks()
        of = np.repeat(np.arange(len(a)), np.diff(slots.offsets.to_numpy()))
        no, low, high, need = (slots.flatten().field(x).to_numpy(zero_copy_only=False).copy() for x in ("slot", "low", "high", "need"))
        kept = [np.zeros(0, dtype=np.int64)] * 3
        for at in range(0, len(b), _STRIP):
            walking = np.flatnonzero(length[of] * max(bound[at], 0.0) * (1 + 1e-9) + _SLACK >= need)
            if not len(walking):
                break  # certified: nothing that follows reaches any slot
            active, place = np.unique(of[walking], return_inverse=True)
            part = slice(at, at + _STRIP)
            scores = _products(a[active], b[part])
            fits = ((own[active][:, None] == labels[part][None, :]) == same) & (anchor[active][:, None] != ids[part][None, :])
            wide = scores[place]
            i, j = np.nonzero(fits[place] & (wide >= need[walking][:, None]) & (100 * wide >= low[walking][:, None]) & (100 * wide <= high[walking][:, None]))
            if not len(i):
                continue
            kept = [np.concatenate([x, y]) for x, y in zip(kept, (walking[i], ids[part][j], wide[i, j]), strict=True)]
            best = _best(*kept, k)
            kept = [x[best] for x in kept]
            full = np.flatnonzero(np.bincount(kept[0], minlength=len(of)) >= k)
            last = np.searchsorted(kept[0], full, side="right") - 1
            need[full] = np.maximum(need[full], kept[2][last])
        slot, found, scores = kept
        hashes = members["anchor_hash"].to_numpy()
        return pa.table([pa.array(anchor[of[slot]], kinds[0]), pa.array(hashes[of[slot]], kinds[1]), pa.array(no[slot], kinds[2]), pa.array(found, kinds[3]), pa.array(scores, kinds[4])], names)

    return walk


_HITS = "anchor_id long, anchor_hash long, slot int, id long, score long"
_SLOT = ["anchor_id", "anchor_hash", "slot"]


class _Index:
    """The stored lists of all rows, and the clustered members."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, sample: int, most_clusters: int, per_cluster: int) -> None:
        chosen = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()["v"]
        vectors = _matrix(chosen).astype(float)
        total = anchors.count()
        self.centres = centres = centres_of(vectors, max(1, min(most_clusters, round(total / per_cluster), len(vectors)))) if total else np.zeros((1, 1))
        self.k = k = len(centres)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                norms = _norms(batch["v"])
                angles = _angles(_matrix(batch["v"], centres.shape[1]), norms, centres)
                near = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(angles[np.arange(len(near)), near]), pa.array(norms)], [*batch.schema.names, "cluster", "angle", "norm"])

        self.members = materialize(anchors.mapInArrow(assign, "vec_id long, label long, v array<long>, anchor_hash long, cluster int, angle double, norm double"), "anchors")
        # Under most_clusters rows.
        sizes = {r["cluster"]: r for r in self.members.groupBy("cluster").agg(F.max("angle").alias("r"), F.count(F.lit(1)).alias("n")).collect()}
        self.radius = radius = np.array([sizes[c]["r"] if c in sizes else 0.0 for c in range(k)])
        self.blocks = [-(-sizes[c]["n"] // MEMBERS) if c in sizes else 0 for c in range(k)]

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                norms = _norms(batch["v"])
                levels = _levels(_bounds(_angles(_matrix(batch["v"], centres.shape[1]), norms, centres), norms, radius))
                offsets = pa.array(np.arange(0, levels.size + 1, k), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(levels.ravel(), pa.int16()))], [*batch.schema.names, "levels"])

        self.lists = materialize(rows.mapInArrow(listed, "vec_id long, label long, v array<long>, levels array<short>"), "lists")
        self.histogram: list[dict[int, int]] = [{} for _ in range(k)]
        # A few hundred levels a cluster, 64,000 at most.
        for r in self.lists.select(F.posexplode("levels").alias("cluster", "level")).groupBy("cluster", "level").count().collect():
            self.histogram[r["cluster"]][r["level"]] = r["count"]

    def head(self, least: int) -> list[int]:
        """The level at which each list's head of `least` rows, or a 64th of them if more, ends."""
        out = []
        for levels in self.histogram:
            wanted, have, cut = max(least, sum(levels.values()) // 64), 0, _LOWEST
            for level in sorted(levels, reverse=True):
                cut, have = level, have + levels[level]
                if have >= wanted:
                    break
            out.append(cut if have >= wanted else _LOWEST)
        return out

    def walk(self, members: DataFrame, low: list[int], high: list[int], k: int, same: bool) -> DataFrame:
        """Hits among the rows of levels from low up to below high, of members with their slots."""
        inside = [sum(n for at, n in h.items() if lo <= at < hi) for h, lo, hi in zip(self.histogram, low, high, strict=True)]
        size = CHUNK * 8 if same else CHUNK  # rows of one label are few among those of a level
        chunks = [-(-n // size) if blocks else 0 for n, blocks in zip(inside, self.blocks, strict=True)]

        def of_cluster(values: list[int], cluster: Column) -> Column:
            return F.get(F.array(*map(F.lit, values)), cluster)

        clusters = F.filter(F.sequence(F.lit(0), F.lit(self.k - 1)), lambda c: (of_cluster(chunks, c) > 0) & (F.get("levels", c) >= of_cluster(low, c)) & (F.get("levels", c) < of_cluster(high, c)))
        rows = self.lists.select("vec_id", "label", "v", F.explode(clusters).alias("cluster"))
        if same:
            rows = rows.join(members.select("cluster", "label").distinct(), ["cluster", "label"], "left_semi")
        at = F.col("cluster")
        rows = rows.withColumns({"chunk": F.pmod(F.xxhash64("vec_id"), of_cluster(chunks, at)).cast("int"), "block": F.explode(F.sequence(F.lit(0), of_cluster(self.blocks, at) - 1))})
        held = members.where(of_cluster(chunks, at) > 0)
        held = held.withColumns({"block": F.pmod("anchor_hash", of_cluster(self.blocks, at)).cast("int"), "chunk": F.explode(F.sequence(F.lit(0), of_cluster(chunks, at) - 1))})
        key = ["cluster", "block", "chunk"]
        return held.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(_walker(self.centres, self.radius, k, same), _HITS)

    def search(self, members: DataFrame, k: int, same: bool, least_head: int) -> DataFrame:
        """(anchor_id, anchor_hash, slot, id, score, rank): the first k rows of each slot."""
        cut = self.head(least_head)
        hits = [materialize(self.walk(members, cut, [32_767] * self.k, k, same), "head")]
        order = Window.partitionBy(*_SLOT).orderBy(F.desc("score"), F.asc("id"))
        if any(c > _LOWEST for c in cut):
            reached = hits[0].withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(*_SLOT, F.col("score").alias("reached"))
            each = members.select("vec_id", "label", "v", "anchor_hash", "cluster", "norm", F.explode("slots").alias("s")).select("*", F.col("s.slot").alias("slot")).withColumnRenamed("vec_id", "anchor_id")
            need = F.greatest(F.col("s.need"), F.coalesce("reached", F.lit(-_NO_LIMIT)))
            raised = each.join(reached, _SLOT, "left").groupBy("anchor_id", "anchor_hash", "label", "v", "cluster", "norm")
            raised = raised.agg(F.collect_list(F.struct("slot", F.col("s.low").alias("low"), F.col("s.high").alias("high"), need.alias("need"))).alias("slots")).withColumnRenamed("anchor_id", "vec_id")
            rest = materialize(raised, "members")
            share = F.array_min(F.transform("slots", lambda s: s["need"])) / F.col("norm")
            # A member without length or with a need of zero has to see all rows.
            least = {r["cluster"]: r["share"] for r in rest.groupBy("cluster").agg(F.min(F.when(F.col("norm") > 0, share).otherwise(0.0)).alias("share")).collect()}
            floor = [int(_levels(np.array([least.get(c, np.inf)]))[0]) - 1 if 0 < least.get(c, np.inf) < np.inf else _LOWEST if c in least else 32_767 for c in range(self.k)]
            hits.append(materialize(self.walk(rest, [min(f, c) for f, c in zip(floor, cut, strict=True)], cut, k, same), "rest"))
            release(rest)
        every = hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
        best = materialize(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        for t in hits:
            release(t)
        return best


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, sample: int = 4096, most_clusters: int = 64, per_cluster: int = 128, head: int = 4096) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each
    of its best rows of its label, the best rows of other labels that score from least to most percent of
    the positive's score. rows: vec_id long, label long, v array<long>."""
    anchors = rows.where(is_anchor).select("vec_id", "label", "v", F.xxhash64("vec_id", "label", "v").alias("anchor_hash")).dropDuplicates()
    index = _Index(rows.select("vec_id", "label", "v"), anchors, sample, most_clusters, per_cluster)

    def slots(*fields: Column) -> Column:
        return F.struct(*[f.alias(n) for f, n in zip(fields, ("slot", "low", "high", "need"), strict=True)])

    zero = F.lit(0).cast("long")
    asked = index.members.withColumn("slots", F.array(slots(F.lit(0), zero, F.lit(_NO_LIMIT), zero)))
    found = index.search(asked, positives, True, head)
    low = F.col("score") * least
    bands = found.groupBy("anchor_id", "anchor_hash").agg(F.array_sort(F.collect_list(slots(F.col("rank"), low, F.col("score") * most, F.ceil(low / 100).cast("long")))).alias("slots"))
    members = materialize(index.members.join(bands.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "anchor_hash"]), "members")
    hard = index.search(members, negatives, False, head)
    named = found.select("anchor_id", "anchor_hash", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.select(*_SLOT, "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, _SLOT)
    out = materialize(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    for t in (index.lists, index.members, found, members, hard):
        release(t)
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part: each component x as floor(256 x)."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * 256)).alias("v"))


def hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Query op11_negatives: anchors are the rows whose vec_id is divisible by 100."""
    rows = usable(table(spark, sf_dir, "embeddings")).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM s WHERE same) WHERE n <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
