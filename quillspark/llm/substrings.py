"""Substring dedup: words in passages of 13 words or more that an earlier document has as well.

The reference is the whole corpus, so its suffix automata can't all meet all documents. Passages are
routed instead: among the 5-grams of each window of 13 words, the one with the smallest hash is its
anchor, which equal windows share. The windows of one anchor's occurrence are a region of at most 21
words. Only anchors that two documents have are followed up, and of equal regions only the one with
the smallest doc_id: every other copy is covered whole. What is left, regions that differ from
others of their anchor, is dealt to shards of bounded size by anchor. A shard's task builds the suffix
automaton of its regions, with the smallest doc_id of each state, and streams the regions through
it for matching statistics: a window is a repeat if its state has a smaller doc_id. Anchors with
more variants than a shard holds take an exact path of their own, an aggregation by window.

Words are maximal runs of other characters than space and U+0009 to U+000D. Defined results: a null
text has no words; rows with a null doc_id lose nothing and make nothing a repeat; rows that share a
doc_id are no repeats of each other; a document's own repetitions stay; an empty table gives no
rows; extra columns are not read. Regions are told apart by 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.common import free_shuffles, materialize, partitions, release, table

_GRAM = 5
_MULTIPLIER = 0xC2B2AE3D27D4EB4F | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_SHARD_REGIONS = 2000
_WHOLE = -1


class Regions(NamedTuple):
    """Runs of windows with one anchor: document, anchor's hash, the region's hash, first window's
    position among the slice's words, and number of windows."""

    doc: np.ndarray
    anchor: np.ndarray
    region: np.ndarray
    start: np.ndarray
    count: np.ndarray


def regions(words: W.Words, n: int) -> Regions:
    counts = np.maximum(np.diff(words.doc) - n + 1, 0)
    total = int(counts.sum())
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.repeat(words.doc[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total)
    if not total:
        none = np.zeros(0, np.int64)
        return Regions(none, none, none, none, none)
    h = words.hashes
    padded = np.concatenate([h, np.zeros(_GRAM, np.uint64)])
    grams = np.zeros(len(h), np.uint64)
    for k in range(_GRAM):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + padded[k : k + len(h)]
    grams = W.mix(grams)
    least, offset = grams[at], np.zeros(total, np.int64)
    for k in range(1, n - _GRAM + 1):
        other = grams[at + k]
        less = other < least
        least[less], offset[less] = other[less], k
    place = at + offset
    fresh = np.ones(total, bool)
    fresh[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, total))
    start = at[first]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * W.powers(_MULTIPLIER, len(h)))])
    body = (sums[start + count + n - 1] - sums[start]) * W.powers(_INVERSE, len(h))[start]
    name = W.mix(W.mix(body) + (offset[first] * 64 + count).astype(np.uint64))
    return Regions(doc[first], least[first].view(np.int64), name.view(np.int64), start, count)


class Automaton:
    """Generalised suffix automaton of word sequences; each state keeps the smallest number of the
    sequences that its strings occur in."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 62]

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.least.append(1 << 62)
        return len(self.next) - 1

    def add(self, sequence: list[int], number: int) -> None:
        last = 0
        for x in sequence:
            last = self._extend(last, x)
            if number < self.least[last]:
                self.least[last] = number

    def _split(self, p: int, x: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, x: int) -> int:
        q = self.next[p].get(x)
        if q is not None:
            return q if self.length[q] == self.length[p] + 1 else self._split(p, x, q)
        new = self._new(self.length[p] + 1, {}, 0)
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, x, q)
        return new

    def close(self) -> None:
        """Hands the smallest numbers up the suffix links."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if self.least[s] < self.least[up]:
                self.least[up] = self.least[s]

    def repeats(self, sequence: list[int], number: int, n: int) -> int:
        """Bit i is set if the n words from the i-th on also occur in a sequence of a smaller number."""
        state, matched, mask = 0, 0, 0
        for i, x in enumerate(sequence):
            while state and x not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if x in self.next[state]:
                state, matched = self.next[state][x], matched + 1
            if matched >= n:
                s = state
                while self.length[self.link[s]] >= n:
                    s = self.link[s]
                if self.least[s] < number:
                    mask |= 1 << (i - n + 1)
        return mask


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def occurrences(docs: DataFrame, n: int) -> DataFrame:
    """(anchor, region, doc_id), once for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, words in W.documents(batch.column(1)):
                r = regions(words, n)
                order = np.lexsort((r.region, r.doc))
                doc, region = r.doc[order], r.region[order]
                keep = np.ones(len(order), bool)
                keep[1:] = (doc[1:] != doc[:-1]) | (region[1:] != region[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(r.anchor[order][keep]), pa.array(region[keep]), pa.array(ids[first + doc[keep]], pa.int64())], ["anchor", "region", "doc_id"])

    return _texts(docs.where("doc_id is not null")).mapInArrow(run, "anchor long, region long, doc_id long")


def _with_words(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(anchor, region, doc_id, words) of the wanted regions (region, doc_id), from their documents."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list("region").alias("regions"))  # no longer than the document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted_of = batch.column(0).to_pylist(), batch.column(2)
            rows: list[tuple] = []
            for first, words in W.documents(batch.column(1)):
                r = regions(words, n)
                bounds = np.searchsorted(r.doc, np.arange(len(words.doc)))
                for d in range(len(words.doc) - 1):
                    a, b = bounds[d], bounds[d + 1]
                    want = wanted_of[first + d].values.to_numpy()
                    _, at = np.unique(r.region[a:b], return_index=True)
                    for k in a + at[np.isin(r.region[a + at], want)]:
                        rows.append((int(r.anchor[k]), int(r.region[k]), ids[first + d], words.hashes[r.start[k] : r.start[k] + r.count[k] + n - 1].tobytes()))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["anchor", "region", "doc_id", "words"])

    return _texts(docs).join(lists, "doc_id").mapInArrow(run, "anchor long, region long, doc_id long, words binary")


def _by_automata(contested: DataFrame, shards: int, n: int) -> DataFrame:
    """(region, mask) by the suffix automaton of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []

        def close() -> tuple[list[int], list[int]]:
            automaton = Automaton()
            sequences = [(r, d, np.frombuffer(w, np.int64).tolist()) for r, d, w in rows]
            for _, d, s in sequences:
                automaton.add(s, d)
            automaton.close()
            return [r for r, _, _ in sequences], [automaton.repeats(s, d, n) for _, d, s in sequences]

        def batch_of(found: tuple[list[int], list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["region", "mask"])

        for batch in batches:
            for s, region, doc, words in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if s != shard and rows:
                    yield batch_of(close())
                    rows = []
                shard = s
                rows.append((region, doc, words))
        if rows:
            yield batch_of(close())

    dealt = contested.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "region", "doc_id", "words").repartition(partitions(contested.sparkSession), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "region long, mask long")


def _by_windows(contested: DataFrame, n: int) -> DataFrame:
    """(region, mask) by aggregation over the words of every window."""
    windows = contested.select("region", "doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.length("words") / 8) - n), lambda i: F.substring("words", i * 8 + 1, F.lit(8 * n)))).alias("at", "window"))
    least = windows.groupBy("window").agg(F.min("doc_id").alias("least"))
    repeats = windows.join(least, "window").where("least < doc_id")
    return repeats.groupBy("region").agg(F.expr("bit_or(shiftleft(1L, at))").alias("mask"))


def repeats(docs: DataFrame, n: int = 13) -> DataFrame:
    """(doc_id, regions, masks): the regions of each document with windows that an earlier one has, and
    which of their windows (bits; all at -1)."""
    spark = docs.sparkSession
    found = materialize(occurrences(docs, n), "regions")
    shared = materialize(found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"), "anchors")
    free_shuffles(spark)
    hits = materialize(found.join(shared, "anchor", "left_semi"), "hits")
    release(found)
    release(shared)
    free_shuffles(spark)
    first = materialize(hits.groupBy("anchor", "region").agg(F.min("doc_id").alias("first")), "first")
    variants = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")
    contested = first.join(variants, "anchor").select("region", F.col("first").alias("doc_id"), "variants")
    contested = materialize(contested, "contested")
    texts = _with_words(docs, contested.select("region", "doc_id"), n).join(contested.select("region", "variants").withColumnRenamed("region", "r"), F.col("region") == F.col("r")).drop("r").dropDuplicates(["region"])
    texts = materialize(texts, "contested-words")
    free_shuffles(spark)
    shards = max(1, -(-texts.count() // _SHARD_REGIONS))
    masks = _by_automata(texts.where(F.col("variants") <= _SHARD_REGIONS), shards, n).unionByName(_by_windows(texts.where(F.col("variants") > _SHARD_REGIONS), n))
    masks = materialize(masks.where("mask <> 0"), "masks")
    release(texts)
    release(contested)
    known = first.join(masks, "region", "left").select("region", "first", "mask")
    marked = hits.select("region", "doc_id").join(known, "region").select("doc_id", "region", F.when(F.col("first") < F.col("doc_id"), F.lit(_WHOLE)).otherwise(F.col("mask")).cast("long").alias("mask")).where("mask is not null")
    # The lists are no longer than the document.
    lists = marked.groupBy("doc_id").agg(F.collect_list(F.struct("region", "mask")).alias("x"))
    out = materialize(lists.select("doc_id", F.col("x.region").alias("regions"), F.col("x.mask").alias("masks")), "repeats")
    for done in (hits, first, masks):
        release(done)
    free_shuffles(spark)
    return out


_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def dedup(docs: DataFrame, n: int = 13, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row of docs (doc_id, text)."""
    rows = _texts(docs).join(repeats(docs, n), "doc_id", "left").select("doc_id", "text", "regions", "masks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, masks = batch.column(2), batch.column(3)
            n_words, n_removed, digests, kept = [], [], [], []
            for first, words in W.documents(batch.column(1)):
                r = regions(words, n)
                bounds = np.searchsorted(r.doc, np.arange(len(words.doc)))
                edges = np.zeros(len(words.hashes) + 1, np.int64)
                for d in range(len(words.doc) - 1):
                    a, b = bounds[d], bounds[d + 1]
                    if a == b or not lists[first + d].is_valid:
                        continue
                    known, mask = lists[first + d].values.to_numpy(), masks[first + d].values.to_numpy()
                    order = np.argsort(known)
                    at = np.minimum(np.searchsorted(known[order], r.region[a:b]), len(known) - 1)
                    hit = np.flatnonzero(known[order][at] == r.region[a:b])
                    m = mask[order][at[hit]]
                    start, count = r.start[a + hit], r.count[a + hit]
                    for k in range(n - _GRAM + 1):
                        s = start[(k < count) & ((m >> k) & 1 == 1)] + k
                        np.add.at(edges, s, 1)
                        np.add.at(edges, s + n, -1)
                stay = np.cumsum(edges)[:-1] == 0
                counts = np.diff(words.doc)
                removed = np.concatenate([[0], np.cumsum(~stay)])
                n_words += counts.tolist()
                n_removed += (removed[words.doc[1:]] - removed[words.doc[:-1]]).tolist()
                # Bytes of the kept words, each with the white space after it as one space.
                closes = words.ends + 1
                closes[words.doc[1:][counts > 0] - 1] -= 1
                take = np.zeros(len(words.data) + 2, np.int8)
                np.add.at(take, words.starts[stay], 1)
                np.add.at(take, closes[stay], -1)
                taken = np.cumsum(take[:-2], dtype=np.int8).astype(bool)
                text = np.where(W._SPACE[words.data], np.uint8(32), words.data)[taken]
                place = np.concatenate([[0], np.cumsum(taken)])
                for d in range(len(counts)):
                    if counts[d]:
                        body = text[place[words.starts[words.doc[d]]] : place[closes[words.doc[d + 1] - 1]]].tobytes()
                        body = body[:-1] if body.endswith(b" ") else body
                    else:
                        body = b""
                    digests.append(hashlib.sha256(body).hexdigest())
                    kept.append(body.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())], [x.split()[0] for x in _OUT.split(", ")]
            )

    return rows.mapInArrow(run, _OUT)


def deduplicate(spark, sf_dir: str) -> DataFrame:
    """Query op2_substrings: passages of 13 words that an earlier document has, removed from all documents."""
    return dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(len(w) - 12)) AS i, w FROM w WHERE len(w) >= 13),
h AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 13], ' ')) AS h FROM g),
m AS (SELECT h, min(doc_id) AS m FROM h GROUP BY h),
c AS (SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 13)) AS p FROM h JOIN m ON m.h = h.h AND m.m < h.doc_id),
r AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
    sha256(coalesce(array_to_string(list_transform(list_filter(range(len(w)), lambda p: NOT list_contains(coalesce(ps, []), p)), lambda p: w[p + 1]), ' '), '')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id"""
