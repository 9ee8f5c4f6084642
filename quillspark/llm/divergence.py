"""Source divergence audit: how far the word use of each source lies from the others of its language.

Terms are runs of ASCII letters and non-ASCII characters, with A-Z lower-cased. Tasks count terms and
the documents that hold them by (lang, source), so what is shuffled follows the vocabulary, not the
text. A language keeps the terms of `least_docs` documents or more.

Divergence of two sources adds up f(p, q) over all kept terms, where f depends on a term's two
counts only. Terms of one language that occur about equally often are numbered within shelves of
about 1024, 64 a word, and each (source, count) has a bitset a word: its term ids. For two sources,
AND and popcount of their bitsets give the number of terms in each joint cell of counts, which is
multiplied by f; cells in which one source has no occurrence follow by complement. Shelves and blocks
of 64 sources bound what a task holds: under 64 bitsets a word and source, whatever the input.

Defined results: null text, lang and source count as ''; repeated rows count again, as documents too;
ids are never read. A source of texts without terms has count 0 for each kept term; a language without
kept terms has pairs of value 0 and no term rows; the only source of a language has no pairs. Equal
values rank by item, in order of UTF-8. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, release, table

_LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _LETTERS else 0x20 for b in range(256))
_SLICE = 1 << 20
_HELD = 400_000
_SHELF = 1024
_BLOCK = 64
_CELLS = 1 << 20


def _terms(data: bytes, size: int) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text, a slice at a time; slices end between terms."""
    at = 0
    while at < len(data):
        part = data[at : at + size].translate(_TABLE)
        if at + size < len(data):
            cut = part.rfind(b" ") + 1
            while not cut:  # one term fills the slice
                more = data[at + len(part) : at + len(part) + size].translate(_TABLE)
                cut = (len(part) + more.find(b" ") + 1) if b" " in more else 0
                part += more
                if not more:
                    break
            part = part[:cut] if cut else part
        at += len(part)
        yield part.split()


def _counter(size: int, held: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a task's documents, given out whenever over held terms are held. A row without term
        names each (lang, source) that occurs."""
        counts: dict[tuple[str, str], Counter] = {}
        docs: dict[tuple[str, str], Counter] = {}

        def rows() -> pa.RecordBatch:
            keys, terms, times, of = [], [], [], []
            for key, c in counts.items():
                keys += [key] * (len(c) + 1)
                terms += [None, *c]
                times += [0, *c.values()]
                of += [0, *map(docs[key].__getitem__, c)]
            counts.clear()
            docs.clear()
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(times, pa.int64()), pa.array(of, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            texts = batch.column(2).cast(pa.large_string()).cast(pa.large_binary())
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                c, d = counts.setdefault(key, Counter()), docs.setdefault(key, Counter())
                found: set[bytes] = set()
                for part in _terms(texts[i].as_py(), size):
                    c.update(part)
                    found.update(part)
                d.update(found)
                if i % 64 == 63 and sum(map(len, counts.values())) > held:
                    yield rows()
            if sum(map(len, counts.values())) > held:
                yield rows()
        if counts:
            yield rows()

    return count


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents that hold it, of docs
    (text, lang, source); a row with a null term for each (lang, source)."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(_counter(_SLICE, _HELD), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exactly; null without terms."""
    return F.expr(f"cast(1 + (cast(1000000000 as decimal(10, 0)) * ({n} + 2)) div nullif({total} + 2 * {terms}, 0) as bigint)")


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _summer(block: int):
    def cells(bitsets: pa.Table, sources: pa.Table) -> pa.Table:
        """Sums of f over the terms of one shelf, for the pairs of sources of two blocks (or of one). bitsets:
        no, word, p, bits. sources: no, p0, terms of the shelf, lo and hi of the group."""
        no, p0, terms, lo, hi = (sources[c].to_numpy() for c in ("no", "p0", "terms", "lo", "hi"))
        order = np.argsort(no)
        no, p0, terms, lo, hi = no[order], p0[order], int(terms[0]) if len(terms) else 0, int(lo[0]) if len(lo) else 0, int(hi[0]) if len(hi) else 0
        a, b = np.flatnonzero(no // block == lo), np.flatnonzero(no // block == hi)
        total = np.zeros((len(a), len(b)), dtype=np.int64)
        either = np.zeros((len(a), len(b)), dtype=np.int64)
        of, word, p = (bitsets[c].to_numpy() for c in ("no", "word", "p"))
        bits = bitsets["bits"].to_numpy().view(np.uint64)
        side_a, side_b = of // block == lo, of // block == hi
        for w in np.unique(word):
            left, right = np.flatnonzero(side_a & (word == w)), np.flatnonzero(side_b & (word == w))
            la, lb = np.searchsorted(no[a], of[left]), np.searchsorted(no[b], of[right])
            used_a, used_b = np.zeros(len(a), dtype=np.uint64), np.zeros(len(b), dtype=np.uint64)
            np.bitwise_or.at(used_a, la, bits[left])
            np.bitwise_or.at(used_b, lb, bits[right])
            step = max(1, _CELLS // max(1, len(right)))
            for at in range(0, len(left), step):
                rows = left[at : at + step]
                both = bits[rows][:, None] & bits[right][None, :]
                i, j = np.nonzero(both)
                np.add.at(total, (la[at + i], lb[j]), np.bitwise_count(both[i, j]).astype(np.int64) * _distance(p[rows[i]], p[right[j]]))
            alone = np.bitwise_count(bits[left][:, None] & ~used_b[None, :]).astype(np.int64)
            np.add.at(total, la, alone * _distance(p[left][:, None], p0[b][None, :]))
            alone = np.bitwise_count(bits[right][:, None] & ~used_a[None, :]).astype(np.int64)
            np.add.at(total.T, lb, alone * _distance(p[right][:, None], p0[a][None, :]))
            either += np.bitwise_count(used_a[:, None] | used_b[None, :])
        if terms:
            total += (terms - either) * _distance(p0[a][:, None], p0[b][None, :])
        i, j = np.nonzero(no[a][:, None] < no[b][None, :])
        return pa.table({"lang": pa.array([sources["lang"][0].as_py() if len(sources) else ""] * len(i), pa.string()), "a": no[a][i], "b": no[b][j], "value": total[i, j]})

    return cells


def divergence(docs: DataFrame, least_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank). Part pair: each other source of the language with its
    distance, farthest first. Part term: the terms a source uses more than its language, by what each adds
    to the distance, the first top_terms."""
    counts = materialize(term_counts(docs), "term-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = kept.select("lang", "term", "total", F.floor(F.log2("total")).cast("int").alias("band"))
    sizes = kept.groupBy("lang", "band").agg(F.ceil(F.count(F.lit(1)) / _SHELF).alias("shelves"))
    placed = kept.join(sizes, ["lang", "band"]).withColumn("shelf", F.expr("pmod(xxhash64(term), shelves)")).drop("shelves")
    # Dealt by shelf, or the numbering would keep the join's partitions: all terms of a language and band in one.
    placed = placed.repartition("lang", "band", "shelf")
    placed = placed.withColumn("id", F.row_number().over(Window.partitionBy("lang", "band", "shelf").orderBy("term")) - 1)
    kept = materialize(placed, "kept-terms")

    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("sum_of_all"))
    held = counts.where("term is not null").drop("docs").join(kept, ["lang", "term"])
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = counts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left").fillna(0, ["own", "terms", "sum_of_all"])
    numbered = groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1).withColumn("blocks", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / _BLOCK))
    groups = materialize(numbered.withColumn("p0", F.coalesce(share("0", "own", "terms"), F.lit(1).cast("long"))), "term-groups")
    of_group = groups.select("lang", "source", "no", "own", "terms", "sum_of_all", "blocks")
    counted = held.join(of_group, ["lang", "source"])
    held = materialize(counted.select("lang", "source", "term", "band", "shelf", "id", "no", "blocks", "n", share("n", "own", "terms").alias("p"), share("total", "sum_of_all", "terms").alias("q")), "held-terms")
    release(counts)

    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pair = [F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi")]
    mine = F.expr(f"no div {_BLOCK}")
    bitsets = held.groupBy("lang", "band", "shelf", F.expr("id div 64").alias("word"), "no", "blocks", "p").agg(F.expr("bit_or(shiftleft(1L, cast(id % 64 as int)))").alias("bits"))
    bitsets = bitsets.withColumns({"mine": mine, "other": other}).select("lang", "band", "shelf", *pair, "word", "no", "p", "bits")
    shelves = kept.groupBy("lang", "band", "shelf").agg(F.count(F.lit(1)).alias("terms"))
    # A shelf without terms names the pairs of languages that keep none.
    shelves = shelves.unionByName(groups.select("lang", F.lit(-1).alias("band"), F.lit(0).cast("long").alias("shelf"), F.lit(0).cast("long").alias("terms")).distinct())
    sources = groups.select("lang", "no", "p0", "blocks").withColumns({"mine": mine, "other": other}).select("lang", *pair, "no", "p0").join(shelves, "lang")
    key = ["lang", "band", "shelf", "lo", "hi"]
    cells = bitsets.groupBy(*key).cogroup(sources.groupBy(*key)).applyInArrow(_summer(_BLOCK), "lang string, a long, b long, value long")
    pairs = cells.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("no"), F.col("b").alias("item_no")), F.struct(F.col("b").alias("no"), F.col("a").alias("item_no")))).alias("x")).select("lang", "x.no", "x.item_no", "value")
    names = groups.select("lang", "no", "source")
    named = both.join(names, ["lang", "no"]).join(names.select("lang", F.col("no").alias("item_no"), F.col("source").alias("item")), ["lang", "item_no"])
    far = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    marked = held.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    rank = F.row_number().over(order)
    out = far.withColumn("rank", rank).unionByName(marked.withColumn("rank", rank).where(F.col("rank") <= top_terms))
    found = materialize(out, "divergence")
    for t in (kept, groups, held):
        release(t)
    return found


def audit(spark, sf_dir: str) -> DataFrame:
    """Query op12_divergence: sources of all documents."""
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, CAST(sum(total) AS HUGEINT) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
gk AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gn AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS own FROM gk GROUP BY ALL),
p AS (SELECT gk.lang, gk.source, gk.term, gk.n, 1 + (CAST(1000000000 AS HUGEINT) * (gk.n + 2)) // (own + 2 * v.v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (gk.total + 2)) // (v.n + 2 * v.v) AS q
      FROM gk JOIN gn USING (lang, source) JOIN v ON v.lang = gk.lang),
ps AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN ps ON ps.lang = a.lang AND ps.source = a.source AND ps.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10"""
