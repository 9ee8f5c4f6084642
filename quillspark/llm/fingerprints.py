"""Context-triggered piecewise hashing of documents.

A rolling hash over seven code points ends a chunk wherever it falls into one residue class of the
block size; the signature holds 12 bits (two characters) of each chunk's hash. Where four block sizes go
by without such a place, a chunk ends there too: content-defined chunking bounds its chunks so, and
without the bound a text that repeats itself has one chunk, which any edit changes. The bound depends on
content as well, since it counts from the last triggered place. The block size follows from the length
alone, and a fingerprint has the signatures at that size and at twice it, so texts whose lengths differ
by less than half always share one.
The likeness of two fingerprints is 1 - edit distance / longer signature at their common block
size, and 0 without one.

Defined results: a null text counts as empty; an empty text has the fingerprint "3::"; two equal
fingerprints have likeness 1, an empty signature against another has 0. In neighbours(): rows with
one doc_id are ordered by text, rows with a null doc_id come last; a single row is its own next;
an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import partitions, table
from quillspark.llm.words import mix, powers

_WINDOW = 7
_LEAST_BLOCK = 3
_CHUNKS = 128
_LONGEST = 4
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PAIRS = np.array([a + b for a in _ALPHABET for b in _ALPHABET])
_ROLL = 0xB5297A4D3F84D5B5
_CHUNK = 0x9E6C63D0876A9A63
_CHUNK_INVERSE = pow(_CHUNK, -1, 1 << 64)


def _signature(sums: np.ndarray, rolling: np.ndarray, block: int) -> str:
    n = len(rolling)
    ends = np.flatnonzero(rolling % np.uint64(block) == np.uint64(block - 1)) + 1
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1]])
    long = np.flatnonzero(ends - starts > _LONGEST * block)
    if len(long):  # repetitive stretches hardly trigger; there, chunks end after a fixed length too
        ends = np.concatenate([ends, *(np.arange(starts[i] + _LONGEST * block, ends[i], _LONGEST * block) for i in long)])
        ends.sort()
        starts = np.concatenate([[0], ends[:-1]])
    chunks = mix((sums[ends] - sums[starts]) * powers(_CHUNK_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))
    return "".join(_PAIRS[chunks & np.uint64(4095)])


def fingerprint(text: str | None) -> str:
    """block size : signature : signature at twice the block size."""
    if not text:
        return f"{_LEAST_BLOCK}::"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(points)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(points * powers(_CHUNK, n), out=sums[1:])
    rolling = np.zeros(n, np.uint64)
    factor = 1
    for k in range(min(_WINDOW, n)):
        rolling[k:] += points[: n - k] * np.uint64(factor)
        factor = factor * _ROLL % (1 << 64)
    rolling = mix(rolling) >> np.uint64(16)
    block = _LEAST_BLOCK
    while block * _CHUNKS < n:
        block *= 2
    return f"{block}:{_signature(sums, rolling, block)}:{_signature(sums, rolling, 2 * block)}"


def _distance(a: list[str], b: list[str]) -> int:
    """Levenshtein distance by bit-parallel columns."""
    if not a or not b:
        return max(len(a), len(b))
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    every, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = every, 0, len(a)
    for x in b:
        equal = masks.get(x, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        rise, fall = down | (~(diagonal | up) & every), up & diagonal
        score += bool(rise & top) - bool(fall & top)
        rise = (rise << 1) | 1
        up, down = ((fall << 1) | (~(diagonal | rise) & every)) & every, rise & diagonal & every
    return score


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    (x, x1, x2), (y, y1, y2) = a.split(":"), b.split(":")
    p, q = int(x), int(y)
    best = 0.0
    for s, t in [(x1, y1)] * (p == q) + [(x2, y2)] * (p == q) + [(x2, y1)] * (2 * p == q) + [(x1, y2)] * (p == 2 * q):
        if s and t:
            u, v = [s[i : i + 2] for i in range(0, len(s), 2)], [t[i : i + 2] for i in range(0, len(t), 2)]
            best = max(best, 1.0 - _distance(u, v) / max(len(u), len(v)))
    return best


def edited(text: str, following: str) -> str:
    """The last third of the text gives way to as many code points of the next one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(docs: DataFrame, ranges_a_partition: int = 4) -> DataFrame:
    """Fingerprints of every row of docs (doc_id, text) and of its edited text, and their likeness
    to each other and to the next row's, by descending doc_id; after the last comes the first.

    The rows are dealt out once, by ranges of doc_id, and sorted in each; the rows with a range's largest
    doc_id also go to the range before, as its guests, so that no task needs all rows. The driver sees
    one cut and one largest doc_id for each range, some ranges a shuffle partition."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = partitions(docs.sparkSession)
    m = n * ranges_a_partition
    cuts = rows.agg(F.percentile_approx("doc_id", [k / m for k in range(1, m)] or [0.5], 100 * m).alias("q")).first()["q"] or []
    cuts = np.unique(np.array(cuts, np.int64))

    def range_of(ids: pa.Array) -> np.ndarray:
        """0 for the largest ids; nulls are in the last range."""
        place = len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), len(cuts), place)

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, int | None] = {}
        for batch in batches:
            for place, i in zip(range_of(batch.column(0)).tolist(), batch.column(0).to_pylist(), strict=True):
                if place not in tops or tops[place] is None or (i is not None and i > tops[place]):
                    tops[place] = i
        yield pa.RecordBatch.from_arrays([pa.array(list(tops), pa.int32()), pa.array(list(tops.values()), pa.int64())], ["place", "top"])

    found = rows.select("doc_id").mapInArrow(largest, "place int, top long").groupBy("place").agg(F.max("top").alias("top")).orderBy("place").collect()  # one row a range
    if not found:
        return docs.sparkSession.createDataFrame([], _OUT)
    guests = {r["top"]: (found[k]["place"], found[k - 1]["place"]) for k, r in enumerate(found)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = range_of(batch.column(0))
            also = [(k, guests[i][1]) for k, (i, place) in enumerate(zip(batch.column(0).to_pylist(), own.tolist(), strict=True)) if i in guests and guests[i][0] == place]
            take = pa.array(list(range(len(own))) + [k for k, _ in also], pa.int64())
            to = own.tolist() + [place for _, place in also]
            guest = [0] * len(own) + [1] * len(also)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(guest, pa.int32()), batch.column(0).take(take), batch.column(1).take(take)], ["to", "guest", "doc_id", "text"])

    order = [F.desc_nulls_last("doc_id"), F.asc("text")]
    dealt = rows.mapInArrow(deal, "to int, guest int, doc_id long, text string").repartitionByRange(n, "to").sortWithinPartitions("to", "guest", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: tuple | None = None  # the row whose next one isn't known yet, with its fingerprint

        def pair(following: str, print_of_next: str) -> None:
            doc_id, text, own = held[1:]
            changed = edited(text, following)
            other = fingerprint(changed)
            out.append((doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, other, likeness(own, other), likeness(own, print_of_next)))

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            data = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in _OUT.split(", ")])
            out.clear()
            return data

        for batch in batches:
            to, guest, ids, texts = (batch.column(k).to_pylist() for k in range(4))
            for t, g, i, text in zip(to, guest, ids, texts, strict=True):
                if g and held is None:
                    continue  # the range before got its next row already
                own = fingerprint(text)
                if held is not None:
                    pair(text, own)
                held = None if g else (t, i, text, own)
            if out:
                yield flush()
        if held is not None:
            raise RuntimeError("a range lacks the first row of the next one")

    return dealt.mapInArrow(run, _OUT)


def fingerprints(spark, sf_dir: str) -> DataFrame:
    """Query op1_fingerprints: fingerprints of all documents, of their edited texts, and likeness."""
    return neighbours(table(spark, sf_dir, "documents"))
