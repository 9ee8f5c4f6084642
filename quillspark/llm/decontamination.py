"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set (powers of two). An item's sketch holds its
smallest shingle hashes, as many as make the search lossless: of s shingles, ceil(t s) of which must be
in a document, some one of any s - ceil(t s) + 1 is there too. So short items are sketched by one hash or
two, long ones by the share of their set that may be missing, and no item is missed in a document of
whatever length. Documents are looked up in the partitions whose items they are large enough for: a
document's shingle that equals a sketched one makes a candidate, and candidates are verified by exact
counts of shared shingles.

Items go to the tasks as an index of bounded size; where there are more, they are searched for block by
block, all documents against each block, and nothing is shuffled.

Shingles have five words, as they stand; a text of one to four words is one shingle, so a shorter
item is only found in an equal document. Defined results: null or empty texts have no shingles and
are never in a pair; repeated rows each give their pairs, a repeated item_id with other text is
another item; empty tables give no pairs, and clean() then keeps all rows, as it does rows with a null
text; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.common import materialize, table

_OUT = "doc_id long, item_id long, n_shared long, n_item long, containment double"


class Entries(NamedTuple):
    """Shingles, sorted, with the items that have them: items[starts[i]:starts[i + 1]] have values[i]."""

    values: np.ndarray
    starts: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, owner: np.ndarray) -> Entries:
        order = np.argsort(values, kind="stable")
        distinct, starts = np.unique(values[order], return_index=True)
        return cls(distinct, np.append(starts, len(order)), owner[order])

    def look_up(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in values, item) of every entry whose shingle is among values."""
        if not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        hit = np.flatnonzero(self.values[at] == values)
        first, last = self.starts[at[hit]], self.starts[at[hit] + 1]
        count = last - first
        entry = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return np.repeat(hit, count), self.items[entry]


class Index:
    """All shingles of some items, and the sketches of each size partition."""

    def __init__(self, ids: list[int], shingles: list[np.ndarray], percent: int) -> None:
        self.ids = np.array(ids, np.int64)
        self.sizes = np.array([len(s) for s in shingles], np.int64)
        #: Shingles that a document must share with an item.
        self.needed = (percent * self.sizes + 99) // 100
        owner = np.repeat(np.arange(len(ids)), self.sizes)
        values = np.concatenate([*shingles, np.zeros(0, np.uint64)])
        place = np.arange(len(values)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        sketched = place < (self.sizes - self.needed + 1)[owner]
        part = np.ceil(np.log2(self.sizes + 1)).astype(np.int64)
        self.whole = Entries.of(values, owner)
        self.parts = [(int(self.needed[part == p].min()), Entries.of(values[on], owner[on])) for p in np.unique(part) for on in [sketched & (part == p)[owner]]]


def search(index: Index, words: W.Words, n: int) -> Iterator[tuple[int, int, int]]:
    """(document, item, shared shingles) of the pairs with enough of the item in the document."""
    values, offsets = W.distinct(*W.grams(words, n))
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    m = max(len(index.ids), 1)
    found = [np.zeros(0, np.int64)]
    for least, sketches in index.parts:
        large = np.flatnonzero((sizes >= least)[owner])
        at, item = sketches.look_up(values[large])
        found.append(owner[large[at]] * m + item)
    candidates = np.unique(np.concatenate(found))
    if not len(candidates):
        return
    involved = np.isin(owner, candidates // m)
    at, item = index.whole.look_up(values[involved])
    pairs, shared = np.unique(owner[involved][at] * m + item, return_counts=True)
    enough = (shared >= index.needed[pairs % m]) & np.isin(pairs, candidates)
    for pair, count in zip(pairs[enough].tolist(), shared[enough].tolist(), strict=True):
        yield pair // m, pair % m, count


def indexes(items: DataFrame, n: int = 5, percent: int = 80, block_shingles: int = 1_000_000) -> Iterator[Index]:
    """Indexes of bounded size that hold all items between them."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for _, words in W.documents(batch.column(1)):
                values, offsets = W.distinct(*W.grams(words, n))
                lists += [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.binary())], ["item_id", "shingles"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    sketches = materialize(rows.mapInArrow(shingle, "item_id long, shingles binary").where(F.length("shingles") > 0).distinct(), "items")
    total = sketches.agg(F.coalesce(F.sum(F.length("shingles")), F.lit(0))).first()[0] // 8
    blocks = max(1, -(-total // block_shingles))
    for b in range(blocks):
        mine = sketches.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == b).orderBy("item_id", "shingles").collect()
        yield Index([-1 if r["item_id"] is None else r["item_id"] for r in mine], [np.frombuffer(bytes(r["shingles"]), np.uint64) for r in mine], percent)


def contained(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80, block_shingles: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every pair in which at least percent per
    cent of the item's distinct shingles are in the document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def against(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = index.value
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for first, words in W.documents(batch.column(1)):
                    for doc, item, shared in search(found, words, n):
                        size = int(found.sizes[item])
                        rows.append((ids[first + doc], int(found.ids[item]), shared, size, shared / size))
                if rows:
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in _OUT.split(", ")])

        return texts.mapInArrow(run, _OUT)

    out = None
    for index in indexes(items, n, percent, block_shingles):
        found = against(docs.sparkSession.sparkContext.broadcast(index))
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80, block_shingles: int = 1_000_000) -> DataFrame:
    """docs without those that contain an item; they are filtered where they lie."""

    def test(index):
        @F.arrow_udf("boolean")
        def leaking(texts: pa.Array) -> pa.Array:
            out = np.zeros(len(texts), bool)
            for first, words in W.documents(texts):
                for doc, _, _ in search(index.value, words, n):
                    out[first + doc] = True
            return pa.array(out)

        return leaking

    for index in indexes(items, n, percent, block_shingles):
        docs = docs.where(~test(docs.sparkSession.sparkContext.broadcast(index))(F.col("text").cast("string")))
    return docs


def leaks(spark, sf_dir: str) -> DataFrame:
    """Query op3_decontamination: benchmark items found in documents."""
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
wi AS (SELECT item_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS s FROM w WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS s FROM wi WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT d.doc_id, b.item_id, count(*) AS n_shared, any_value(n.n_item) AS n_item, count(*) / any_value(n.n_item) AS containment
FROM d JOIN b ON d.s = b.s JOIN n ON n.item_id = b.item_id
GROUP BY d.doc_id, b.item_id HAVING 100 * count(*) >= 80 * any_value(n.n_item)"""
