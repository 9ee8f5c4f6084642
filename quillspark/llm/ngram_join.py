"""N-gram Jaccard join: blocked sparse matrix product of document by n-gram incidence.

Documents with the same shingle set are one node, named by a hash of the set. Of a set of n shingles
that is to share a fraction t of a union, one of the n - ceil(t n) + 1 that come first in any common
order is shared too (the size-derived bound). That order puts shingles that a sketch of fixed size
counts often last, so that passages which many documents share rarely make candidates.

These keys are dealt out once; a task passes on the nodes that share one and whose sizes are in one
class or the next, as a group with a name that follows from its members, so that groups with the same
members count once. A key with more rows than a task should hold is passed on row by row, and Spark
aggregates its groups; keys that the sketch knows to be so frequent are dealt by key and node.

Two passes then look for what hangs together in a group. The first compares small histograms of the
sets' hashes, whose overlap is never below that of the sets: pairs that fall below the bound even so
are discarded, and components of the rest are clusters. Only sets of clustered nodes are fetched, once
each. The second pass multiplies a cluster's incidence matrix with its transpose, some columns at a
time, which accumulates the overlap counts. Both compare a group's members with one of them first: what
is linked to it needs no comparison among itself, so that the block products have a row only for what
isn't, and a column for each member. Groups too large for a task are cut into slots, and pairs of slots
are the blocks. What leaves a block are the links of a spanning tree for each of its classes, not all
pairs. Classes of the whole table come from connected components over them.

Defined results: a text without words, null or empty, has no shingles and its own class; a text of
one to n - 1 words is one shingle; rows with a null doc_id have a null class and link nothing;
repeated rows each give a row and link like any; an empty table gives no rows; extra columns are
not read. one_of_each() says what it does to each of these.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.common import materialize, partitions, release, table, unused
from quillspark.llm.components import components

_CELL_BITS = 22
_CHUNKS = 64
_BLOCK_NODES, _BLOCK_SHINGLES = 2048, 1_000_000
#: Rows of one key that a task holds at once.
_HELD = 4096
_MEMBER = np.dtype([("node", "<i8"), ("n", "<i4")])


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, shingles, offsets, node of each document) of slices of a batch."""
    for first, words in W.documents(column, lower=True):
        values, offsets = W.distinct(*W.grams(words, n))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A)))])
        other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(values + np.uint64(0x1234567)))])
        nodes = W.mix(W.mix(sums[offsets[1:]] - sums[offsets[:-1]]) + (other[offsets[1:]] - other[offsets[:-1]])) + np.diff(offsets).astype(np.uint64)
        yield first, values, offsets, nodes.view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _histogram(values: np.ndarray) -> bytes:
    """A set's size and the counts of its hashes by their leading bits, in a fourth as many bins (64 at least)."""
    bits = max(6, (len(values) // 4).bit_length())
    return np.int64(len(values)).tobytes() + np.minimum(np.bincount((values >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def nodes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, node, payload) of every row; the payload is the set's histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, histograms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for _, values, offsets, node in _sets(batch.column(1), n):
                sizes.append(np.diff(offsets))
                names.append(node)
                histograms += [_histogram(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(names)), pa.array(histograms, pa.binary())], ["doc_id", "n_shingles", "node", "payload"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, node long, payload binary")


def cell_counts(docs: DataFrame, n: int) -> np.ndarray:
    """The number of documents' shingles in each of 2 ** _CELL_BITS hash cells. Tasks count their
    documents into a sketch of fixed size; sketches are added up chunk by chunk."""
    size = 1 << _CELL_BITS
    part = size // _CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size, np.uint32)
        for batch in batches:
            for _, values, _, _ in _sets(batch.column(1), n):
                cells += np.bincount((values >> np.uint64(64 - _CELL_BITS)).astype(np.int64), minlength=size).astype(np.uint32)
        if cells.any():
            small = np.minimum(cells, 255).astype(np.uint8).reshape(_CHUNKS, part)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_CHUNKS, dtype=np.int32)), pa.array([x.tobytes() for x in small], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums.setdefault(chunk, np.zeros(part, np.uint32))[:] += np.frombuffer(counts.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    summed = materialize(_texts(docs).mapInArrow(count, schema).repartition(_CHUNKS, "chunk").mapInArrow(add, schema), "sketch")
    total = np.zeros((_CHUNKS, part), np.uint32)
    for r in summed.toLocalIterator():  # _CHUNKS rows, of 2 ** _CELL_BITS counts in all
        total[r["chunk"]] = np.frombuffer(bytes(r["counts"]), np.uint32)
    release(summed)
    return total.ravel()


def keys(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(place, key, node, n, hot) for the first shingles of every document's set, rare ones first; of
    documents with one set a task takes the first. Hot keys are those that the sketch counts more often
    than a task should hold, beyond the mean cell's load; they are dealt by node too."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # of fixed size
    frequent = _HELD + 4 * int(counts.mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, values, offsets, node in _sets(batch.column(1), n):
                sizes = np.diff(offsets)
                fresh = np.zeros(len(node), bool)
                for i, x in enumerate(node.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                doc = np.repeat(np.arange(len(sizes)), sizes)
                count = shared.value[(values >> np.uint64(64 - _CELL_BITS)).astype(np.int64)]
                order = np.lexsort((values, count, doc))
                place = np.arange(len(values)) - offsets[:-1][doc]
                first = (place < (sizes - (percent * sizes + 99) // 100 + 1)[doc]) & fresh[doc]
                at, key = doc[first], values[order][first]
                hot = count[order][first] > frequent
                to = np.where(hot, W.mix(key ^ node.view(np.uint64)[at]), key)
                yield pa.RecordBatch.from_arrays([pa.array(to.view(np.int64)), pa.array(key.view(np.int64)), pa.array(node[at]), pa.array(sizes[at].astype(np.int32)), pa.array(hot)], ["place", "key", "node", "n", "hot"])

    return _texts(docs.where("doc_id is not null")).mapInArrow(run, "place long, key long, node long, n int, hot boolean")


def _size_step(percent: int) -> float:
    return -math.log(percent / 100) if percent < 100 else 1e-9


def _cells(key: np.ndarray, node: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, pa.Array]:
    """(name, members) of the groups among rows sorted by key, n and node."""
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, n = key[keep], node[keep], n[keep]
    again = np.zeros(len(key) + 1, bool)
    again[1:-1] = key[1:] == key[:-1]
    shared = again[1:] | again[:-1]
    key, node, n = key[shared], node[shared], n[shared]
    own = np.floor(np.log(np.maximum(n, 1)) / _size_step(percent) + 1e-9).astype(np.int64)
    cell, top = np.concatenate([own, own + 1]), np.arange(2 * len(own)) < len(own)
    key, node, n = np.tile(key, 2), np.tile(node, 2), np.tile(n, 2)
    order = np.lexsort((node, cell, key))
    key, cell, top, node, n = key[order], cell[order], top[order], node[order], n[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
    starts = np.flatnonzero(fresh)
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    counts = np.diff(np.append(starts, len(key)))
    names = W.mix(np.add.reduceat(W.mix(node.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)), starts) + counts.astype(np.uint64))
    good = (counts > 1) & np.logical_or.reduceat(top, starts)
    _, once = np.unique(names[good], return_index=True)
    at = np.flatnonzero(good)[once]
    members = np.zeros(len(node), _MEMBER)
    members["node"], members["n"] = node, n
    picked = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(counts[at])[:-1]]), counts[at]) + np.arange(counts[at].sum()) if len(at) else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts[at])]).astype(np.int32) * _MEMBER.itemsize
    body = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(members[picked].tobytes())])
    return names[at].view(np.int64), body


def shared_keys(prefix: DataFrame, percent: int) -> DataFrame:
    """What keys() is good for, by one shuffle: rows (name, members) of groups, and rows (key, node, n) of
    keys with more than _HELD rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["name", "members", "key", "node", "n"]
        none = np.zeros(0, np.int64)
        held = [none, none, none.astype(np.int32), none.astype(bool)]
        passing: int | None = None

        def settle(key: np.ndarray, node: np.ndarray, n: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
            _, run_of, count = np.unique(key, return_inverse=True, return_counts=True)
            on = hot | (count[run_of] > _HELD)
            if passing is not None:
                on |= key == passing
            group, members = _cells(key[~on], node[~on], n[~on], percent)
            if len(group):
                yield pa.RecordBatch.from_arrays([pa.array(group), members, *(pa.nulls(len(group), t) for t in (pa.int64(), pa.int64(), pa.int32()))], names)
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(int(on.sum()), pa.int64()), pa.nulls(int(on.sum()), pa.binary()), pa.array(key[on]), pa.array(node[on]), pa.array(n[on])], names)

        for batch in batches:
            now = [np.concatenate([h, batch.column(k + 1).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            last = int(now[0][-1])
            if len(now[0]) - cut > _HELD:  # too many to wait for the key's end
                yield from settle(*(x[:cut] for x in now))
                passing = last
                yield from settle(*(x[cut:] for x in now))
                held = [x[:0] for x in now]
                continue
            yield from settle(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
        yield from settle(*held)

    dealt = prefix.repartition(partitions(prefix.sparkSession), "place").sortWithinPartitions("key", "n", "node")
    return dealt.mapInArrow(run, "name long, members binary, key long, node long, n int")


def _slots(count, size):
    return F.greatest(F.ceil(count / _BLOCK_NODES), F.ceil(size / _BLOCK_SHINGLES), F.lit(1)).cast("int")


def _frequent_cells(rows: DataFrame, percent: int) -> DataFrame:
    """(group, slots, node) of the cells of frequent keys, by aggregates that combine before the shuffle."""
    h = [F.pmod(F.xxhash64(F.lit(k), "node"), F.lit(1 << 40)) for k in (1, 2)]
    members = [F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum(h[0]).alias("s1"), F.sum(h[1]).alias("s2"), F.sum("n").alias("size")]
    own = F.floor(F.log(F.col("n").cast("double")) / _size_step(percent) + 1e-9).cast("int")
    rows = rows.distinct().withColumn("own", own).withColumn("cell", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    groups = rows.groupBy("key", "cell").agg(*members, F.max(F.col("own") == F.col("cell")).alias("top")).where("lo <> hi and top")
    groups = groups.groupBy("lo", "hi", "m", "s1", "s2").agg(F.min(F.struct("key", "cell", "size")).alias("g")).select("g.key", "g.cell", _slots(F.col("m"), F.col("g.size")).alias("slots"))
    return rows.join(groups, ["key", "cell"]).select(F.xxhash64("key", "cell").alias("group"), "slots", "node")


def cells(prefix: DataFrame, percent: int) -> DataFrame:
    """(group, slots, node): the members of the groups that may hold a link."""
    found = materialize(shared_keys(prefix, percent), "keys")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x, _MEMBER) for x in batch.column(1).to_pylist()]
            counts = np.array([len(x) for x in lists], np.int64)
            slots = np.array([max(-(-len(x) // _BLOCK_NODES), -(-int(x["n"].sum()) // _BLOCK_SHINGLES), 1) for x in lists], np.int32)
            every = np.concatenate([x["node"] for x in lists]) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)), pa.array(np.repeat(slots, counts)), pa.array(every)], ["group", "slots", "node"])

    out = found.where("members is not null").select("name", "members").dropDuplicates(["name"]).mapInArrow(explode, "group long, slots int, node long")
    frequent = found.where("members is null").select("key", "node", "n")
    if not frequent.isEmpty():
        out = out.unionByName(_frequent_cells(frequent, percent))
    out = materialize(out, "cells")
    release(found)
    return out


def product(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, percent: int) -> np.ndarray:
    """Links between rows and columns, which are lists of positions in sets: the incidence matrices'
    product, accumulated over stretches of n-grams that two sets have. Sums of ones in single precision
    are exact up to 2 ** 24 shingles, and no text has as many."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    keep = df[column] > 1
    number = np.cumsum(df > 1) - 1
    column, owner = number[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = max(64, min(8192, (1 << 22) // max(len(sets), 1)))
    overlap = np.zeros((len(rows), len(columns)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        incidence = np.zeros((len(sets), width), np.float32)
        incidence[owner[a:b], column[a:b] - first] = 1
        overlap += incidence[rows] @ incidence[columns].T
    shared = overlap.astype(np.int64)
    return 100 * shared >= percent * (sizes[rows][:, None] + sizes[columns][None, :] - shared)


def bounds(sized: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose histograms (after their set's size, eight bytes) leave room for enough overlap: smaller
    counts of each bin, added up."""
    sizes = np.array([int(x[:8].view(np.int64)[0]) for x in sized])
    histograms = [x[8:] for x in sized]
    least = min(len(h) for h in histograms)
    folded = np.stack([h.reshape(least, -1).sum(axis=1, dtype=np.uint16) for h in histograms])
    right = folded[columns]
    out = np.zeros((len(rows), len(columns)), bool)
    for i, r in enumerate(rows):
        most = np.minimum(folded[r], right).sum(axis=1, dtype=np.int64)
        out[i] = 100 * most >= percent * (sizes[r] + sizes[columns] - most)
    return out


def _classes(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray, count: int) -> list[np.ndarray]:
    """Members of each class of the links that has two or more, by breadth-first search."""
    member = np.full(count, -1)
    row_of, column_of = np.full(count, -1), np.full(count, -1)
    row_of[rows], column_of[columns] = np.arange(len(rows)), np.arange(len(columns))
    for root in range(count):
        if member[root] >= 0:
            continue
        member[root] = root
        front = np.array([root])
        while len(front):
            reach = np.zeros(count, bool)
            r, c = row_of[front], column_of[front]
            if (r >= 0).any():
                reach[columns[linked[r[r >= 0]].any(axis=0)]] = True
            if (c >= 0).any():
                reach[rows[linked[:, c[c >= 0]].any(axis=1)]] = True
            front = np.flatnonzero(reach & (member < 0))
            member[front] = root
    order = np.argsort(member, kind="stable")
    return [m for m in np.split(order, np.flatnonzero(np.diff(member[order])) + 1) if len(m) > 1]


def _by_group(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(values of the first `parts` columns, rows of the others) of rows sorted by the former."""
    now, rows = None, []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for row in zip(*columns, strict=True):
            if row[:parts] != now:
                if rows:
                    yield now, rows
                now, rows = row[:parts], []
            rows.append(row[parts:])
    if rows:
        yield now, rows


def _tree(names: list[int], payloads: list[np.ndarray], left: np.ndarray, right: np.ndarray, test: Callable, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning tree of each class that test() finds between left and right positions."""
    linked = test(payloads, left, right, percent)
    name = np.array(names, np.int64)
    linked |= name[left][:, None] == name[right][None, :]
    return [(names[m[0]], names[x]) for m in _classes(linked, left, right, len(names)) for x in m[1:] if names[x] != names[m[0]]]


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], ["a", "b"])


def together(members: DataFrame, payloads: DataFrame, dtype: type, test: Callable, percent: int) -> DataFrame:
    """(a, b): what test() links in the groups of members (group, slots, node), a spanning tree for each
    class; payloads has (node, payload), an array of dtype."""
    count = partitions(members.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_group(batches, 1):
            once = dict(rows)  # copies of a node once
            names, sets = list(once), [np.frombuffer(x, dtype) for x in once.values()]
            every = np.arange(len(names))
            first = test(sets, every[:1], every, percent)[0]
            first[0] = True
            # What is linked to the first one needs no comparison among itself.
            rest = np.flatnonzero(~first)
            found = [(names[0], names[x]) for x in np.flatnonzero(first)[1:]]
            if len(rest):
                found += _tree(names, sets, rest, every, test, percent)
            if found:
                yield _edges(found)

    small = members.where("slots = 1").select("group", "node").join(payloads, "node").select("group", "node", "payload")
    out = small.repartition(count, "group").sortWithinPartitions("group", "node").mapInArrow(whole, "a long, b long")
    large = members.where("slots > 1")
    if large.isEmpty():
        return out
    slot = F.pmod(F.xxhash64("node"), F.col("slots")).cast("int")
    rows = materialize(large.distinct().join(payloads, "node").dropDuplicates(["group", "node"]).select("group", "slots", slot.alias("slot"), "node", "payload"), "large")
    # A leader travels once to each slot of its group, so that no task gets a whole group.
    leaders = rows.groupBy("group").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "payload")).alias("l"), F.max("slots").alias("slots"))
    leaders = leaders.select("group", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.col("l.node").alias("leader"), F.col("l.payload").alias("of_leader"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = (np.array([0]), np.array([1]))
        for batch in batches:
            held = [bool(test([np.frombuffer(a, dtype), np.frombuffer(b, dtype)], *pair, percent)[0, 0]) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(4)] + [pa.array(held, pa.bool_())], ["group", "slot", "node", "leader", "linked"])

    met = rows.join(leaders, ["group", "slot"]).select("group", "slot", "node", "leader", "payload", "of_leader")
    met = materialize(met.mapInArrow(meet, "group long, slot int, node long, leader long, linked boolean"), "leaders")
    out = out.unionByName(met.where("linked and node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")))
    rest = met.where("not linked and node <> leader").select("group", "node")
    if rest.isEmpty():
        return out
    size = rest.join(rows, ["group", "node"]).groupBy("group").agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("payload") / 8).alias("size"), F.max("slots").alias("slots"))
    size = materialize(size.select("group", "slots", _slots(F.col("m"), F.col("size")).alias("strips")), "strips")
    strip = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("strips")).cast("int")
    left = rest.join(rows.select("group", "node", "payload"), ["group", "node"]).join(size, "group").select("group", strip.alias("strip"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(0).alias("side"), "node", "payload")
    right = rows.join(size.select("group", "strips"), "group").select("group", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip"), "slot", F.lit(1).alias("side"), "node", "payload")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _by_group(batches, 3):
            side = np.array([r[0] for r in found])
            pairs = _tree([r[1] for r in found], [np.frombuffer(r[2], dtype) for r in found], np.flatnonzero(side == 0), np.flatnonzero(side == 1), test, percent)
            if pairs:
                yield _edges(pairs)

    blocks = left.unionByName(right).repartition(count, "group", "strip", "slot").sortWithinPartitions("group", "strip", "slot", "side", "node")
    return out.unionByName(blocks.mapInArrow(block, "a long, b long"))


def clusters(close: DataFrame, sizes: DataFrame) -> DataFrame:
    """(group, slots, node): components of the pairs (a, b), so that a set travels once and not for every
    group; sizes has (node, n_shingles)."""
    roots = components(close)
    members = roots.select("node", F.col("root").alias("group")).unionByName(roots.select(F.col("root").alias("node"), F.col("root").alias("group")).distinct())
    members = materialize(members.join(sizes, "node"), "clusters")
    slots = members.groupBy("group").agg(_slots(F.count(F.lit(1)), F.sum("n_shingles")).alias("slots"))
    return members.join(slots, "group").select("group", "slots", "node")


def classes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, node, component_id) of every row of docs (doc_id, text)."""
    base = materialize(nodes(docs, n), "nodes")
    members = cells(keys(docs, n, percent, cell_counts(docs, n)), percent)
    named = base.where("n_shingles > 0 and doc_id is not null")
    histograms = named.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("payload").alias("payload"))
    close = materialize(together(members, histograms, np.uint8, bounds, percent), "close")
    release(members)
    first = materialize(named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles")), "names")
    clustered = materialize(clusters(close, first.select("node", "n_shingles")), "clustered")
    release(close)
    wanted = first.join(clustered, "node", "left_semi").select("doc_id")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, values, offsets, node in _sets(batch.column(1), n):
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["node", "payload"])

    sets = materialize(_texts(docs).join(wanted, "doc_id", "left_semi").mapInArrow(shingles, "node long, payload binary"), "sets")
    found = materialize(together(clustered, sets, np.uint64, product, percent), "links")
    for done in (sets, clustered):
        release(done)
    # Nodes get the smallest doc_id of their documents as name before the classes are sought.
    names = first.select("node", F.col("doc_id").alias("name"))
    edges = found.join(names.select(F.col("node").alias("a"), F.col("name").alias("an")), "a").join(names.select(F.col("node").alias("b"), F.col("name").alias("bn")), "b")
    roots = components(edges.select(F.col("an").alias("a"), F.col("bn").alias("b")))
    release(found)
    names = names.join(roots.withColumnRenamed("node", "name"), "name", "left").select("node", F.coalesce("root", "name").alias("class_id"))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return base.drop("payload").join(names, "node", "left").select("doc_id", "n_shingles", "node", F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")).alias("component_id"))


def join(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    return classes(docs, n, percent).drop("node")


def one_of_each(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """docs with the smallest doc_id of each class only. Rows are dropped by doc_id and set, so of rows
    that share a doc_id each goes or stays by its own text; equal sets of one doc_id become one row. Rows
    with a null doc_id, and rows without words, all stay. Columns keep their names, whatever they are."""
    found = materialize(classes(docs, n, percent).where("doc_id is not null and n_shingles > 0"), "classes")
    marks = found.groupBy("doc_id", "node").agg((F.first("component_id") != F.col("doc_id")).alias("dropped"), (F.count(F.lit(1)) > 1).alias("repeated")).where("dropped or repeated")
    own, node, dropped, repeated = (unused(x, docs.columns) for x in ("own_id", "node", "dropped", "repeated"))
    marks = marks.select(F.col("doc_id").alias(own), F.col("node").alias(f"{node}_"), F.col("dropped").alias(dropped), F.col("repeated").alias(repeated))

    @F.arrow_udf("long")
    def node_of(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0, np.int64)]
        for _, _, _, names in _sets(texts, n):
            out.append(names)
        return pa.array(np.concatenate(out))

    rows = docs.withColumn(node, node_of(F.col("text").cast("string")))
    rows = rows.join(marks, (rows["doc_id"].cast("long") == marks[own]) & (rows[node] == marks[f"{node}_"]), "left").where(~F.coalesce(F.col(dropped), F.lit(False)))
    once = rows.where(F.coalesce(F.col(repeated), F.lit(False))).dropDuplicates([own, node])
    return rows.where(~F.coalesce(F.col(repeated), F.lit(False))).unionByName(once).select(*docs.columns)


def components_of_documents(spark, sf_dir: str) -> DataFrame:
    """Query op9_ngram_join: similarity classes of all documents."""
    return join(table(spark, sf_dir, "documents"))


def oracle(documents: str, n: int = 4, percent: int = 85) -> str:
    """DuckDB SQL of join() over the relation `documents`."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {documents}),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - {n - 1}), lambda i: array_to_string(w[i + 1 : i + {n}], ' ')) END) AS s FROM w WHERE len(w) > 0),
z AS (SELECT doc_id, count(*) AS z FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN z x ON x.doc_id = a.doc_id JOIN z y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (any_value(x.z) + any_value(y.z) - count(*))),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(z.z, 0) AS n_shingles, least(w.doc_id, coalesce(m.m, w.doc_id)) AS component_id
FROM w LEFT JOIN z ON z.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON m.a = w.doc_id"""


ORACLE = oracle("documents")
