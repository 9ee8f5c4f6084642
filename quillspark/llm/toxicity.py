"""Toxic spans by a linear-chain conditional random field over the words of a document.

Two states, plain and toxic. A word's emission is the sum of learned weights of its hashed features
(the word, without case and outer punctuation, its prefixes of three to six bytes and its suffixes
of three and four); a transition's is the weight of its two labels. Both are learned by gradient ascent on
the conditional likelihood, transitions from the smoothed frequencies of neighbouring labels. The state
before the first word is unknown, either with equal weight. Forward-backward gives each word's marginal
probability of being toxic. A document's score is the logistic of a line, fitted to the labels, of two
figures of its marginals: the log odds that at least one word is toxic, and the log of the share of
words expected to be. Runs of words with a marginal of at least a half are its offending spans.

Labels mark documents, so the training words get theirs from the features: a word of a toxic
document is labelled toxic if one of its features occurs in more toxic documents than chance explains,
at a false discovery rate over all features, and is far commoner there than elsewhere. That rule has no
figure that depends on the number of labels. Copies of a document count once there, so that their
other words aren't taken for toxic.

The fit sees at most max_train toxic and twice as many other labelled rows (by hash of doc_id, outside
the held-out fold), in one task to which only these rows are sent; everything else covers all rows and
whole texts. Defined results: a null text counts as empty and scores as a document without toxic words;
without toxic labels all scores are below 0.5; null labels are not learned from; repeated rows each give
a row; an empty table gives no rows; extra columns are not read. reject() keeps rows whose text is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.common import held_out, table
from quillspark.llm.quality import picked, sample_of

BITS = 18
_SIZE = 1 << BITS
_PREFIXES = (3, 4, 5, 6)
_SUFFIXES = (3, 4)
_STEP = 64
_SLICE = 100_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)]] = True


def features(words: W.Words) -> np.ndarray:
    """Weight indexes of each word's features; the words must have been read in lower case."""
    n = len(words.data)
    letters = np.flatnonzero(_LETTER[words.data])
    if not len(words.starts):
        return np.zeros((0, 1 + len(_PREFIXES) + len(_SUFFIXES)), np.int32)
    if len(letters):
        opens = letters[np.minimum(np.searchsorted(letters, words.starts), len(letters) - 1)]
        closes = letters[np.maximum(np.searchsorted(letters, words.ends) - 1, 0)] + 1
    else:
        opens, closes = words.starts, words.ends
    bare = (opens < words.starts) | (opens >= words.ends) | (closes <= opens)
    opens, closes = np.where(bare, words.starts, opens), np.where(bare, words.ends, closes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((words.data.astype(np.uint64) + np.uint64(1)) * W.powers(W._BASE, n), out=sums[1:])
    back = W.powers(W._BASE_INVERSE, n)

    def piece(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
        h = (sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64)
        return (W.mix(h ^ np.uint64(kind << 40)) >> np.uint64(64 - BITS)).astype(np.int32)

    return np.stack(
        [piece(opens, closes, 1)] + [piece(opens, np.minimum(opens + k, closes), 10 + k) for k in _PREFIXES] + [piece(np.maximum(closes - k, opens), closes, 20 + k) for k in _SUFFIXES],
        axis=1,
    )


def marginals(emission: np.ndarray, offsets: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """P(word is toxic | document) by forward-backward."""
    return expectations(emission, offsets, transition, pairs=False)[0]


def expectations(emission: np.ndarray, offsets: np.ndarray, transition: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The marginals and, if asked for, the expected number of each transition, the one into a first word included. Documents are cut into blocks of _STEP words;
    all blocks advance together, first as transfer matrices, which chain the blocks of a document,
    then with the messages that enter them."""
    counts = np.diff(offsets)
    blocks = -(-counts // _STEP)
    block_at = np.concatenate([[0], np.cumsum(blocks)])
    total = int(block_at[-1])
    if total == 0:
        return np.zeros(0), np.zeros((2, 2))
    t = np.exp(transition)
    word = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts)
    slot = (np.repeat(block_at[:-1], counts) + word // _STEP) * _STEP + word % _STEP
    toxic = np.ones(total * _STEP)
    toxic[slot] = np.exp(np.clip(emission, -30, 30))
    live = np.zeros(total * _STEP, bool)
    live[slot] = True
    toxic, live = toxic.reshape(total, _STEP).T.copy(), live.reshape(total, _STEP).T.copy()

    def matrix(k: int) -> tuple[np.ndarray, ...]:
        e, on = toxic[k], live[k]
        return np.where(on, t[0, 0], 1.0), np.where(on, t[0, 1] * e, 0.0), np.where(on, t[1, 0], 0.0), np.where(on, t[1, 1] * e, 1.0)

    a, b, c, d = np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)
    for k in range(_STEP):
        p, q, r, s = matrix(k)
        a, b, c, d = a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s
        top = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / top, b / top, c / top, d / top
    into = np.full((total, 2), 0.5)
    out = np.ones((total, 2))
    for k in range(1, int(blocks.max())):
        at = block_at[:-1][blocks > k] + k
        x, y = into[at - 1, 0], into[at - 1, 1]
        u, v = x * a[at - 1] + y * c[at - 1], x * b[at - 1] + y * d[at - 1]
        into[at, 0], into[at, 1] = u / (u + v), v / (u + v)
    for k in range(1, int(blocks.max())):
        at = block_at[1:][blocks > k] - 1 - k
        x, y = out[at + 1, 0], out[at + 1, 1]
        u, v = a[at + 1] * x + b[at + 1] * y, c[at + 1] * x + d[at + 1] * y
        out[at, 0], out[at, 1] = u / (u + v), v / (u + v)
    forward = np.empty((_STEP, total))  # odds of toxic given the words so far
    x, y = into[:, 0].copy(), into[:, 1].copy()
    for k in range(_STEP):
        p, q, r, s = matrix(k)
        x, y = x * p + y * r, x * q + y * s
        z = x + y
        x, y = x / z, y / z
        forward[k] = y
    result, expected = np.empty((_STEP, total)), np.zeros((2, 2))
    x, y = out[:, 0].copy(), out[:, 1].copy()
    for k in range(_STEP - 1, -1, -1):
        f = forward[k]
        result[k] = f * y / (f * y + (1 - f) * x)
        p, q, r, s = matrix(k)
        if pairs:
            before = forward[k - 1] if k else into[:, 1]
            joint = np.array([(1 - before) * p * x, (1 - before) * q * y, before * r * x, before * s * y])
            expected += (joint / joint.sum(axis=0))[:, live[k]].sum(axis=1).reshape(2, 2)
        x, y = p * x + q * y, r * x + s * y
        z = x + y
        x, y = x / z, y / z
    return result.T.reshape(-1)[slot], expected


def emissions(weights: np.ndarray, bias: float, index: np.ndarray) -> np.ndarray:
    """bias and the sum of each word's weights, added up one column after the other: all at once they take seven times the memory."""
    total = np.zeros(len(index))
    for k in range(index.shape[1]):
        total += weights[index[:, k]]
    return total + bias


def observed(truth: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Number of each transition under the labels; one into a first word is shared by the states before it."""
    before = np.roll(truth, 1)
    counts = np.array([[np.sum((before == i) & (truth == j) & ~first) for j in (False, True)] for i in (False, True)], float)
    t = np.exp(transition)
    return counts + t / t.sum(axis=0) * [np.sum(first & ~truth), np.sum(first & truth)]


def evidence(marginal: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two figures for each document: log odds that at least one word is toxic, and the log of the share
    of words expected to be, as if ten plain words came with every document."""
    none = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(marginal, 1 - 1e-9)))])
    q = np.clip(none[offsets[1:]] - none[offsets[:-1]], -30, -1e-12)
    sums = np.concatenate([[0.0], np.cumsum(marginal)])
    share = (sums[offsets[1:]] - sums[offsets[:-1]] + 1e-4) / (np.diff(offsets) + 10)
    return np.stack([np.clip(np.log(-np.expm1(q)) - q, -12, 12), np.log(np.clip(share, 1e-6, 1))], axis=1)


def document_scores(model: dict[str, np.ndarray], marginal: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    x = model["line"][0] + evidence(marginal, offsets) @ model["line"][1:]
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def copies(index: np.ndarray, offsets: np.ndarray, bands: int = 4, rows: int = 8) -> np.ndarray:
    """A group for each document: documents whose sets of words agree in a whole band of minima are
    copies of each other. Empty documents have none."""
    count = len(offsets) - 1
    doc = np.repeat(np.arange(count), np.diff(offsets))
    group = np.arange(count)
    word = index[:, 0].astype(np.uint64)
    for band in range(bands):
        sketch = np.zeros(count, np.uint64)
        for row in range(rows):
            least = np.full(count, np.uint64(2**64 - 1), np.uint64)
            np.minimum.at(least, doc, W.mix(word + np.uint64((band * rows + row + 1) << 32)))
            sketch = W.mix(sketch * np.uint64(31) + least)
        sketch = np.where(np.diff(offsets) > 0, sketch, np.arange(count).astype(np.uint64))
        _, first, at = np.unique(sketch, return_index=True, return_inverse=True)
        for _ in range(bands):  # hands the smallest number through
            low = np.full(len(first), count)
            np.minimum.at(low, at, group)
            group = np.minimum(group, low[at])
    return group


def _chance(k1: np.ndarray, k: np.ndarray, n1: int, n: int) -> np.ndarray:
    """Probability that k1 or more of k documents are among n1 of n by chance (hypergeometric)."""
    log = np.concatenate([[0.0, 0.0], np.cumsum(np.log(np.arange(2, n + 2)))])  # of factorials

    def choose(a, b):
        return log[a] - log[b] - log[a - b]

    total, base = np.zeros(len(k)), choose(np.full(len(k), n), k)
    for more in range(n1 + 1):
        x = k1 + more
        on = np.flatnonzero((x <= np.minimum(k, n1)) & (k - x <= n - n1))
        if not len(on):
            break
        term = np.exp(choose(np.full(len(on), n1), x[on]) + choose(np.full(len(on), n - n1), k[on] - x[on]) - base[on])
        total[on] += term
        if (term <= 1e-12 * total[on]).all():
            break
    return np.minimum(total, 1.0)


def _marked(index: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, rate: float = 0.2, purity: float = 10.0) -> np.ndarray:
    """Words of toxic documents with a feature that marks them. Marks are the features that occur in
    more toxic documents than chance explains, at a false discovery rate over all features of two or
    more documents (so that few labels have to agree better, and many may differ more), and whose share
    of the words of toxic documents is at least purity times that of others. Copies count once."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(offsets))
    _, group = np.unique(copies(index, offsets) * 2 + toxic, return_inverse=True)
    of_toxic = np.zeros(group.max() + 1, bool)
    of_toxic[group] = toxic
    first = np.zeros(len(toxic), bool)
    first[np.unique(group, return_index=True)[1]] = True
    at, columns = first[doc], range(index.shape[1])
    n1, n = int(of_toxic.sum()), len(of_toxic)
    k1, every = np.zeros(_SIZE, np.int64), np.zeros(_SIZE, np.int64)
    for some in np.array_split(np.flatnonzero(first), len(index) // _SLICE + 1):  # documents: a group has one that counts
        if len(some):
            part = slice(offsets[some[0]], offsets[some[-1] + 1])
            own = doc[part][at[part]] * _SIZE
            seen = np.unique(np.concatenate([own + index[part, k][at[part]] for k in columns]))
            every += np.bincount(seen % _SIZE, minlength=_SIZE)
            k1 += np.bincount(seen[toxic[seen // _SIZE]] % _SIZE, minlength=_SIZE)
    tested = np.flatnonzero(every >= 2)
    chance = np.ones(_SIZE)
    chance[tested] = _chance(k1[tested], every[tested], n1, n)
    order = tested[np.argsort(chance[tested], kind="stable")]
    passed = np.flatnonzero(chance[order] <= rate * np.arange(1, len(order) + 1) / max(len(order), 1))
    marks = np.zeros(_SIZE, bool)
    marks[order[: passed[-1] + 1 if len(passed) else 0]] = True
    words = toxic[doc[at]]
    inside, outside = (sum(np.bincount(index[at, k][w], minlength=_SIZE) for k in columns) / max(int(w.sum()), 1) for w in (words, ~words))
    marks &= inside >= purity * outside
    marked = np.zeros(len(index), bool)
    for k in columns:
        marked |= marks[index[:, k]]
    return toxic[doc] & marked


def fit(index: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, epochs: int = 25, rate: float = 0.5, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """Model from the words' features, the documents' word offsets and labels."""
    weights, transition = np.zeros(_SIZE), np.zeros((2, 2))
    bias = -3.0
    if len(index) and toxic.any():
        truth = _marked(index, offsets, toxic)
        y = truth.astype(float)
        first = np.zeros(len(y), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        pairs = observed(truth, first & False, transition) + [[1, 0.5], [0.5, 0.5]]
        transition = prior = np.log(pairs / pairs.sum(axis=1, keepdims=True))
        sums, bias_sum, pair_sums = np.full(_SIZE, 1e-8), 1e-8, np.full((2, 2), 1e-8)
        bias = 0.0
        for _ in range(epochs):
            p, expected = expectations(emissions(weights, bias, index), offsets, transition)
            g = sum(np.bincount(index[:, k], y - p, minlength=_SIZE) for k in range(index.shape[1])) - decay * weights
            sums += g * g
            weights += rate * g / np.sqrt(sums)
            total = float((y - p).sum())
            bias_sum += total * total
            bias += rate * total / np.sqrt(bias_sum)
            turn = observed(truth, first, transition) - expected - decay * (transition - prior)
            pair_sums += turn * turn
            transition = transition + rate * turn / np.sqrt(pair_sums)
    model = {"weights": weights, "transition": transition, "bias": np.array([bias])}
    line = np.array([-2.0, 0.25, 0.0])
    if toxic.any() and not toxic.all():
        y = toxic.astype(float)
        x = evidence(marginals(emissions(weights, bias, index), offsets, transition), offsets)
        middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        design = np.concatenate([np.ones((len(x), 1)), (x - middle) / spread], axis=1)
        line = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ line, -35, 35)))
            line += np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(3), design.T @ (y - p) - 0.1 * line)
        line = np.append(line[0] - (line[1:] * middle / spread).sum(), line[1:] / spread)
    return model | {"line": line}


_PARTS = {"weights": (_SIZE,), "transition": (2, 2), "bias": (1,), "line": (3,)}


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", max_train: int = 2000) -> dict[str, np.ndarray]:
    """The model, fitted in one task on the bounded sample."""
    truth = F.col(column).cast("int")
    sample = sample_of(docs, picked(labels.where(truth == 1), column, max_train).unionByName(picked(labels.where(truth == 0), column, 2 * max_train)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, counts, toxic = [np.zeros((0, 1 + len(_PREFIXES) + len(_SUFFIXES)), np.int32)], [], []
        for batch in batches:
            toxic += batch.column(1).to_pylist()
            for _, words in W.documents(batch.column(2), lower=True):
                parts.append(features(words))
                counts.append(np.diff(words.doc))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        index = np.concatenate(parts)
        parts.clear()
        model = fit(index, offsets.astype(np.int64), np.array(toxic, bool))
        yield pa.RecordBatch.from_arrays([pa.array([model[k].tobytes()], pa.binary()) for k in _PARTS], list(_PARTS))

    found = sample.mapInArrow(run, ", ".join(f"{k} binary" for k in _PARTS)).collect()  # one row of fixed size
    if not found:
        return fit(np.zeros((0, 1 + len(_PREFIXES) + len(_SUFFIXES)), np.int32), np.zeros(1, np.int64), np.zeros(0, bool))
    return {k: np.frombuffer(bytes(found[0][k])).reshape(shape) for k, shape in _PARTS.items()}


_OUT = "doc_id long, held_out boolean, score double, predicted int, spans string"


def _runs(marginal: np.ndarray, words: W.Words) -> dict[int, list[str]]:
    """start:end, in code points, of runs of toxic words, by document; words and separators between
    them belong to the run."""
    at = np.flatnonzero(marginal >= 0.5)
    out: dict[int, list[str]] = {}
    if not len(at):
        return out
    doc = np.searchsorted(words.doc, at, side="right") - 1
    points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    firsts = np.flatnonzero(fresh)
    lasts = np.append(firsts[1:], len(at)) - 1
    for i, j in zip(firsts, lasts, strict=True):
        out.setdefault(int(doc[i]), []).append((int(points[words.starts[at[i]]]), int(points[words.ends[at[j]]])))
    return out


def score(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row of docs (doc_id, text); spans is
    start:end in code points, comma-joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, spans = [np.zeros(0)], [""] * batch.num_rows
            _, byte_offsets = W.string_buffers(batch.column(2))
            for first, words in W.documents(batch.column(2), lower=True):
                p = marginals(emissions(m["weights"], m["bias"][0], features(words)), words.doc, m["transition"])
                scores.append(document_scores(m, p, words.doc))
                origin = byte_offsets[first]
                for i, found in _runs(p, words).items():
                    begin = byte_offsets[first + i] - origin
                    base = int(np.count_nonzero((words.data[:begin] & 0xC0) != 0x80))
                    spans[first + i] = ",".join(f"{a - base}:{b - base}" for a, b in found)
            s = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(spans, pa.string())], [x.split()[0] for x in _OUT.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _OUT)


def scorer(spark: SparkSession, model: dict[str, np.ndarray]):
    """A function of a text column: the score."""
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        m, scores = shared.value, [np.zeros(0)]
        for _, words in W.documents(texts, lower=True):
            p = marginals(emissions(m["weights"], m["bias"][0], features(words)), words.doc, m["transition"])
            scores.append(document_scores(m, p, words.doc))
        return pa.array(np.concatenate(scores))

    return toxicity


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those whose score reaches the threshold."""
    score_of = scorer(docs.sparkSession, train(docs, labels))
    return docs.where(score_of(F.col("text").cast("string")) < threshold)


def classify(spark, sf_dir: str) -> DataFrame:
    """Query op4_toxicity: scores and offending spans of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
