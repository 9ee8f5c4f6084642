"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader.

Features are frequencies of hashed one- and two-word n-grams, of the words themselves and of their
shapes (runs of lower-case letters, capitals and digits each become one mark, other characters
stay), and of a word's repetition. A score is the sparse dot product of those frequencies with the
weights, through the logistic function.

The fit sees at most max_train labelled rows (by hash of doc_id, of the rows outside the held-out
fold), in one task to which only these rows are sent; everything else covers all rows. Defined results:
a null text counts as empty and has the bias alone; without labelled rows every score is 0.5; labels that
are null are not learned from; repeated label rows count repeatedly, repeated documents each give a row;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.common import held_out, table

BITS = 18
_SIZE = 1 << BITS
_SCALE = 8.0

_SHAPE = np.arange(256, dtype=np.uint64) + np.uint64(1)
_SHAPE[ord("a") : ord("z") + 1] = 300
_SHAPE[ord("A") : ord("Z") + 1] = 301
_SHAPE[ord("0") : ord("9") + 1] = 302
_SHAPE[128:] = 300


def _shapes(words: W.Words) -> np.ndarray:
    """A hash of each word's shape."""
    kinds = _SHAPE[words.data]
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[words.starts] = True
    rank = np.cumsum(keep) - 1
    n = len(kinds)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(np.where(keep, kinds * W.powers(W._BASE, n)[rank], np.uint64(0)), out=sums[1:])
    return W.mix((sums[words.ends] - sums[words.starts]) * W.powers(W._BASE_INVERSE, n)[rank[words.starts]])


def features(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(weight index of each token's five features, offsets of each document's tokens)."""
    n = len(words.hashes)
    if n == 0:
        return np.zeros((0, 5), np.int64), words.doc
    shapes = _shapes(words)
    first = np.zeros(n, bool)
    first[words.doc[:-1][np.diff(words.doc) > 0]] = True
    before, before_shape = np.roll(words.hashes, 1), np.roll(shapes, 1)
    before[first], before_shape[first] = 0, 0
    columns = [
        words.hashes,
        words.hashes * np.uint64(3) + before,
        shapes ^ np.uint64(0x51),
        (shapes ^ np.uint64(0x52)) * np.uint64(5) + before_shape,
        np.where(words.hashes == before, np.uint64(1), np.uint64(2)),
    ]
    return np.stack([(W.mix(c + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64) for k, c in enumerate(columns)], axis=1), words.doc


def dot(weights: np.ndarray, index: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """bias + weights . frequencies of each document."""
    per_token = weights[index].sum(axis=1)
    sums = np.concatenate([[0.0], np.cumsum(per_token)])
    counts = np.diff(offsets)
    return weights[_SIZE] + _SCALE * (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(counts, 1)


def fit(examples: Iterator[tuple[np.ndarray, int]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """FTRL-proximal weights; examples are (index array, label)."""
    rows = []
    for index, label in examples:
        at, count = np.unique(index.ravel(), return_counts=True)
        x = _SCALE * count / max(len(index), 1)
        rows.append((np.append(at, _SIZE), np.append(x, 1.0), label))
    z, n = np.zeros(_SIZE + 1), np.zeros(_SIZE + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    for _ in range(epochs if rows else 0):
        for at, x, label in rows:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(_SIZE + 1))


def picked(labels: DataFrame, column: str, most: int) -> DataFrame:
    """(order, doc_id, label) of at most `most` labels outside the held-out fold."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .select(F.xxhash64("doc_id").alias("order"), "doc_id", "label")
        .orderBy("order", "doc_id", "label")
        .limit(most)
    )


def sample_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(order, label, text) of the picked labels' documents in one partition. All tasks look for them in
    the documents, by the broadcast list of bounded length; only what they find is sent to one."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(labels), "doc_id").select("order", "label", "text").repartition(1).sortWithinPartitions("order", "label", "text")


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", max_train: int = 6000) -> np.ndarray:
    """Weights, fitted in one task on the bounded sample."""
    sample = sample_of(docs, picked(labels, column, max_train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def examples():
            for batch in batches:
                truth = batch.column(1).to_pylist()
                for first, words in W.documents(batch.column(2)):
                    index, offsets = features(words)
                    for i in range(len(offsets) - 1):
                        yield index[offsets[i] : offsets[i + 1]].astype(np.int32), truth[first + i]

        yield pa.RecordBatch.from_arrays([pa.array([fit(examples()).tobytes()], pa.binary())], ["weights"])

    found = sample.mapInArrow(run, "weights binary").collect()  # one row of fixed size
    return np.frombuffer(bytes(found[0]["weights"])) if found else np.zeros(_SIZE + 1)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for _, words in W.documents(batch.column(2)):
                scores.append(1 / (1 + np.exp(-np.clip(dot(shared.value, *features(words)), -35, 35))))
            p = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(spark, sf_dir: str) -> DataFrame:
    """Query op7_quality: scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
