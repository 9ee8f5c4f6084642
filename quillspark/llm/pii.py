"""Personal data by bootstrapped contextual extraction, in column expressions and joins only.

Base patterns (kind: rule) are email, ip, card and phone, leftmost and non-overlapping for each kind;
matches that fail their kind's test are dropped. They seed the search for identifiers no pattern knows:

- An instance is a base span, or a candidate: a token of 5 to 64 letters, digits and @._/+- that holds a
  digit and overlaps no base span.
- A lexical pattern is the word before an instance or the word after it, in lower case, with the colons,
  equals and number signs at its end. What stands between word and instance is white space, quotes or
  brackets.
- The graph of patterns and instances has an edge for each (pattern, value) with the times it occurs. A
  pattern's confidence in a kind is the scored share of all places where its word occurs: what counts
  against it is every occurrence of the word that no identifier follows. Patterns need `support` distinct
  values that are likely of the kind, so that copies of one document make none.
- In turn, patterns are scored by their instances (1 for seeds, otherwise the best confidence of their
  patterns from `spread` up) and instances by their patterns, `rounds` times. Patterns that end at
  `accept` or more mark their candidates, as like_email, like_ip, like_card or like_phone; of several
  patterns the surest decides, of equal ones the kind listed first.

Only spans and words are shuffled, never texts; texts are read twice. What is stored between the steps is
released when the result is written.

Positions are code points, ends exclusive. Defined results: a null text counts as empty and has no span;
repeated rows each give a row and count as occurrences; an empty table gives no rows; extra columns are
not read, whatever their names. A word longer than 40 characters is no pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, release, table
from quillspark.llm.secrets import _bind, _prefix_sums

# Possessive, so that no text makes them quadratic; a run is tried from its start or the last match's end.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"""(?<![^\x20\x09-\x0D:=#"'(<\[])(?=[A-Za-z@._/+-]*+[0-9])[A-Za-z0-9+][A-Za-z0-9@._/+-]{4,}+"""
KINDS = ("email", "ip", "card", "phone", "like_email", "like_ip", "like_card", "like_phone")
_BASE = (EMAIL, IP, CARD, PHONE)
_SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{_SPACE}:=#]++[:=#]*+"
_LEFT = rf"""(?:^|[{_SPACE}:=#])([^{_SPACE}:=#]{{1,40}}[:=#]{{0,3}})[{_SPACE}"'(<\[]{{0,40}}$"""
_RIGHT = rf"""^["')>\].,;!?]{{0,8}}[{_SPACE}]{{1,40}}([^{_SPACE}:=#]{{1,40}}(?:[:=#]{{1,3}}|(?=[{_SPACE}]|$)))"""
_NEAR = 128
#: Words of up to 40 characters: about 20 MB.
_BROADCAST = 200_000
_FOUND = "array<struct<start:bigint,end:bigint,found:string,before:string,after:string>>"
_INSTANCE = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Matches with their positions, and up to 128 characters on both sides: lengths of matches and of
    what lies between are summed up, and the sides are taken from what lies between."""

    def placed(found: Column) -> Column:
        def positions(between: Column) -> Column:
            lengths = F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(between, i))).cast("long"))

            def side(i: Column, m: Column, end: Column) -> Column:
                before = F.right(F.concat(F.coalesce(F.right(F.get(found, i - 1), F.lit(_NEAR)), F.lit("")), F.get(between, i)), F.lit(_NEAR))
                after = F.left(F.concat(F.get(between, i + 1), F.coalesce(F.left(F.get(found, i + 1), F.lit(_NEAR)), F.lit(""))), F.lit(_NEAR))
                return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("found"), before.alias("before"), after.alias("after"))

            return _bind(_prefix_sums(lengths), lambda ends: F.transform(found, lambda m, i: side(i, m, F.get(ends, i))))

        return _bind(F.split(text, pattern, -1), positions)

    return _bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(F.array().cast(_FOUND)))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a run of digits is right."""
    one = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(one, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(kind: int, found: Column) -> Column:
    if kind == 1:
        return found.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    if kind == 2:
        return F.when(F.length(_digits(found)).between(12, 19), luhn(_digits(found))).otherwise(False)
    return F.length(_digits(found)).between(9, 15) if kind == 3 else F.lit(True)


def _value(kind: int, found: Column) -> Column:
    return F.lower(found) if kind == 0 else found if kind == 1 else _digits(found)


def _instances(found: Column, value) -> Column:
    def cue(side: Column, pattern: str) -> Column:
        return F.lower(F.regexp_extract(side, pattern, 1))

    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), value(s["found"]).alias("value"), cue(s["before"], _LEFT).alias("before"), cue(s["after"], _RIGHT).alias("after")))


def base_spans(text: Column, kind: int) -> Column:
    """Spans of one base kind, in order: struct(start, end, value, before, after)."""
    return _instances(F.filter(matches(text, _BASE[kind]), lambda s: _valid(kind, s["found"])), lambda f: _value(kind, f))


def _below(ordered: Column, x: Column) -> Column:
    """How many elements of an ordered array lie below x, by halving."""
    start = F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        narrowed = F.when(F.get(ordered, mid) < x, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))
        return F.when(s["lo"] < s["hi"], narrowed).otherwise(s)

    steps = F.ceil(F.log2(F.size(ordered) + 1)).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["lo"])


def _overlaps(span: Column, base: Column) -> Column:
    """Whether a span overlaps one of the disjoint spans of base, in order."""
    last = _below(base["start"], span["end"]) - 1
    return F.when(F.size(base) > 0, _bind(last, lambda k: (k >= 0) & (F.get(base["end"], k) > span["start"]))).otherwise(False)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, doc_id, email, ip, card, phone, candidates): the base spans and candidates of every row of
    docs, stored. row numbers the rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    body = F.col("text")
    rows = rows.select("doc_id", "text", *[base_spans(body, k).alias(KINDS[k]) for k in range(4)])
    tokens = F.transform(
        matches(body, TOKEN),
        lambda s: _bind(F.regexp_replace(s["found"], r"(?<![@._/+-])[@._/+-]++$", ""), lambda v: F.struct(s["start"].alias("start"), (s["start"] + F.length(v)).alias("end"), v.alias("found"), s["before"].alias("before"), s["after"].alias("after"))),
    )
    free = F.filter(tokens, lambda s: F.length(s["found"]).between(5, 64) & ~(_overlaps(s, F.col("email")) | _overlaps(s, F.col("ip")) | _overlaps(s, F.col("card")) | _overlaps(s, F.col("phone"))))
    found = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", *KINDS[:4], _instances(free, F.lower).alias("candidates"))
    return materialize(found, "pii-scan")


def _sides(instance: str) -> Column:
    return F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col(f"{instance}.before").alias("cue")), F.struct(F.lit("after").alias("side"), F.col(f"{instance}.after").alias("cue"))))


def graph(scanned: DataFrame, docs: DataFrame, text: str = "text", support: int = 5) -> DataFrame:
    """(side, cue, value, kind, n, occurs): the edges between patterns and instances; kind is null for
    candidates, occurs counts the places where the pattern's word stands. Patterns of fewer values than
    support can't be accepted and are left out."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(KINDS[k]).alias("spans")) for k in range(4)], F.struct(F.lit(None).cast("int").alias("kind"), F.col("candidates").alias("spans")))
    spans = scanned.select(F.explode(kinds).alias("x")).select("x.kind", F.explode("x.spans").alias("s")).select("kind", "s.value", _sides("s").alias("p"))
    edges = materialize(spans.select("kind", "value", "p.side", "p.cue").where("cue <> ''").groupBy("side", "cue", "value", "kind").agg(F.count(F.lit(1)).alias("n")), "pii-edges")
    seeded = edges.groupBy("side", "cue").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") >= support).select("side", "cue")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text).cast("string")), F.lit(WORD), F.lit(0))).alias("cue"))
    # Few words stand next to as many identifiers: while they fit a broadcast, only those are counted; beyond
    # that, all words are, and combine before they are shuffled.
    cues = materialize(seeded.select("cue").distinct(), "pii-cues")
    if cues.count() <= _BROADCAST:
        words = words.join(F.broadcast(cues), "cue", "left_semi")
    occurs = words.groupBy("cue").agg(F.count(F.lit(1)).alias("occurs"))
    out = materialize(edges.join(seeded.join(occurs, "cue", "left"), ["side", "cue"]).withColumn("occurs", F.coalesce("occurs", F.lit(0))), "pii-graph")
    release(edges)
    release(cues)
    return out


def bootstrap(edges: DataFrame, support: int = 5, spread: float = 0.5, rounds: int = 3) -> DataFrame:
    """(side, cue, kind, confidence) of the patterns with a confidence of spread or more after the rounds."""
    seeds = edges.where("kind is not null").select("side", "cue", "kind", "n", "occurs", F.lit(1.0).alias("score"))
    others = edges.where("kind is null").drop("kind")
    patterns = None
    for turn in range(rounds):
        scored = seeds
        if patterns is not None:
            best = others.select("side", "cue", "value").join(patterns, ["side", "cue"]).groupBy("value", "kind").agg(F.max("confidence").alias("score"))
            scored = seeds.unionByName(others.join(best, "value").select(*seeds.columns))
        sums = scored.groupBy("side", "cue", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("good"), F.sum("n").alias("seen"), F.max("occurs").alias("occurs"), F.count_if(F.col("score") >= 0.5).alias("values"))
        # Nine decimals, so that the order of a float sum can't decide.
        sure = sums.withColumn("confidence", F.round(F.col("good") / F.greatest("seen", "occurs"), 9)).where((F.col("values") >= support) & (F.col("confidence") >= spread))
        old, patterns = patterns, materialize(sure.select("side", "cue", "kind", "confidence"), f"pii-patterns-{turn}")
        if old is not None:
            release(old)
    return patterns


def _marked(kind: int) -> Column:
    return F.transform(KINDS[kind], lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def extract(docs: DataFrame, text: str = "text", support: int = 5, spread: float = 0.5, accept: float = 0.7, rounds: int = 3) -> DataFrame:
    """(doc_id, base, found) of every row of docs: arrays of struct(start, kind, end), sorted by start, then
    kind; kind is the position in KINDS, from 4 up in found."""
    scanned = scan(docs, text)
    edges = graph(scanned, docs, text, support)
    patterns = bootstrap(edges, support, spread, rounds)
    sure = patterns.where(F.col("confidence") >= accept)
    marked = scanned.select("row", F.explode("candidates").alias("s")).select("row", "s.start", "s.end", _sides("s").alias("p")).select("row", "start", "end", "p.side", "p.cue")
    best = marked.join(sure, ["side", "cue"]).groupBy("row", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("first"))).alias("best"))
    spans = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", (4 - F.col("best.first")).alias("kind"), "end"))).alias("found"))
    base = F.array_sort(F.concat(*map(_marked, range(4))))
    rows = scanned.select("row", "doc_id", base.alias("base")).join(spans, "row", "left")
    out = materialize(rows.select("doc_id", "base", F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("found")), "pii-spans")
    for t in (scanned, edges, patterns):
        release(t)
    return out


def digest(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(spark, sf_dir: str) -> DataFrame:
    """Query op13_pii: personal data in all documents."""
    found = extract(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *map(count, range(4)), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.array_sort(F.concat("base", "found"))).alias("spans"))
