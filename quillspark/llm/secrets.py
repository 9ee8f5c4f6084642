"""Secret scan by column expressions only: patterns, and a randomness test battery for other tokens.

Patterns (kind: rule) are assign, access and hex, leftmost and non-overlapping for each kind.
Candidates of the battery are runs of 20 or more letters, digits and +/_- with = padding, of at least
two character classes. A candidate's encoding is the smallest alphabet that holds it. Three tests
ask whether it could be drawn uniformly from that alphabet: chi-squared of its symbol counts
(Wilson-Hilferty), the runs above and below the alphabet's middle, and the serial correlation of
neighbouring symbols; the smallest p-value, times three, has to reach alpha. Against it stands the
null hypothesis that the token is written language, whose chi-squared is centred by the index of
coincidence and grows with the length; its p-values are held to the Benjamini-Hochberg rule at a
false discovery rate, for each class of lengths apart. The rule works on a histogram of rounded-up
p-values, of bounded size. A found token that overlaps no pattern's span is of kind random.

Positions are code points, ends exclusive. Defined results: a null text counts as empty and has no
span; repeated rows each give a row; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import table, unused

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the same as runs of [0-9a-f] without the short ones
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (name, pattern, alphabet in code order), smallest first.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[2-7A-Z]+$", "234567" + _UPPER),
    ("base36", "^[0-9a-z]+$", _DIGITS + _LOWER),
    ("BASE36", "^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("base62", "^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", "^[0-9A-Za-z+/]+$", "+/" + _DIGITS + _UPPER + _LOWER),
    ("base64url", "^[0-9A-Za-z_-]+$", "-" + _DIGITS + _UPPER + "_" + _LOWER),
    ("base64mixed", "^[0-9A-Za-z+/_-]+$", "+-/" + _DIGITS + _UPPER + "_" + _LOWER),
)
#: Sums of squared and cubed letter shares of written language.
_COINCIDENCE, _CUBES = 0.0667, 0.0056
_LENGTHS = (32, 64)
_BINS_A_UNIT = 16


def _bind(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _prefix_sums(lengths: Column) -> Column:
    """Sums of the first 1, 2, .. elements, by way of sums of 128, so that cost isn't quadratic."""
    step = 128

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def of_blocks(values: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.expr("0") + ((F.size(values) - 1) / step).cast("int")), lambda b: total(F.slice(values, b * step + 1, F.lit(step))))
        return _bind(
            blocks,
            lambda sums: _bind(
                F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda b: total(F.slice(sums, F.lit(1), b))),
                lambda before: F.transform(
                    F.sequence(F.lit(0), F.size(values) - 1),
                    lambda i: F.get(before, (i / step).cast("int")) + total(F.slice(values, (i / step).cast("int") * step + 1, i % step + 1)),
                ),
            ),
        )

    return _bind(lengths, of_blocks)


_SPAN = "array<struct<start:bigint,kind:int,end:bigint,found:string>>"


def spans(text: Column, pattern: str, kind: int) -> Column:
    """Matches of the pattern with their positions: the lengths of matches and of what lies between
    them, summed up."""
    rx = F.lit(pattern)

    def placed(found: Column) -> Column:
        between = F.split(text, pattern, -1)
        lengths = F.transform(F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("g")), lambda z: (F.length(z["m"]) + F.length(z["g"])).cast("long"))
        return _bind(
            _prefix_sums(lengths),
            lambda ends: F.transform(found, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"), m.alias("found"))),
        )

    return _bind(F.regexp_extract_all(text, rx, F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(F.array().cast(_SPAN)))


def _upper_tail(z: Column) -> Column:
    """1 - normal distribution function, by the rational approximation of Hastings (error below 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(token: Column) -> Column:
    """struct(encoding, n, p_random, z_text) of a candidate; encoding is null where none applies.
    z_text is the chi-squared statistic in standard deviations from what written language has."""
    body = F.regexp_replace(token, "=+$", "")
    classes = F.when(token.rlike("[0-9]"), 1).otherwise(0) + F.when(token.rlike("[a-z]"), 1).otherwise(0) + F.when(token.rlike("[A-Z]"), 1).otherwise(0)
    encoding = F.lit(None).cast("struct<name:string,alphabet:string>")
    for name, pattern, alphabet in reversed(ENCODINGS):
        encoding = F.when(body.rlike(pattern), F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"))).otherwise(encoding)
    encoding = F.when(classes >= 2, encoding)

    def tests(x: Column) -> Column:
        s, k, n = x["s"], F.length(x["e"]["alphabet"]).cast("double"), F.length(x["s"]).cast("double")

        def statistics(index: Column) -> Column:
            squares = F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), lambda t, c: t + F.pow(n - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0)))
            chi = k / n * squares - n
            df = k - 1
            z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
            high = F.aggregate(index, F.lit(0.0), lambda t, v: t + F.when(v >= k / 2, 1.0).otherwise(0.0))
            pairs = F.arrays_zip(F.slice(index, F.lit(1), F.size(index) - 1).alias("a"), F.slice(index, F.lit(2), F.size(index) - 1).alias("b"))
            runs = 1 + F.aggregate(pairs, F.lit(0.0), lambda t, v: t + F.when((v["a"] >= k / 2) != (v["b"] >= k / 2), 1.0).otherwise(0.0))
            product = 2 * high * (n - high)
            spread = product * (product - n) / (n * n * (n - 1))
            z_runs = F.when(spread > 0, (runs - 1 - product / n) / F.sqrt(spread)).otherwise(99.0)
            mean = F.aggregate(index, F.lit(0.0), lambda t, v: t + v) / n
            variance = F.aggregate(index, F.lit(0.0), lambda t, v: t + (v - mean) * (v - mean))
            serial = F.aggregate(pairs, F.lit(0.0), lambda t, v: t + (v["a"] - mean) * (v["b"] - mean))
            z_serial = F.when(variance > 0, (serial / variance + 1 / (n - 1)) * F.sqrt(n)).otherwise(99.0)
            p = F.least(_upper_tail(z_chi), 2 * _upper_tail(F.abs(z_runs)), 2 * _upper_tail(F.abs(z_serial)))
            expected = k + k * (n - 1) * _COINCIDENCE - n
            deviation = k / n * F.sqrt(4 * n * n * n * (_CUBES - _COINCIDENCE**2) + 2 * n * n * _COINCIDENCE)
            return F.struct(x["e"]["name"].alias("encoding"), n.cast("int").alias("n"), F.least(F.lit(1.0), 3 * p).alias("p_random"), ((chi - expected) / deviation).alias("z_text"))

        symbols = F.transform(F.split(s, ""), lambda c: (F.instr(x["e"]["alphabet"], c) - 1).cast("double"))
        return F.when(x["e"].isNotNull() & (n >= 3), _bind(symbols, statistics))

    return _bind(F.struct(body.alias("s"), encoding.alias("e")), tests)


def _length_class(n: Column) -> Column:
    return sum((F.when(n >= at, 1).otherwise(0) for at in _LENGTHS), F.lit(0))


def _bin(z: Column) -> Column:
    """Histogram bin of a z-value; rounding up can only make p larger."""
    return F.greatest(F.lit(-20 * _BINS_A_UNIT), F.least(F.lit(20 * _BINS_A_UNIT), F.ceil(z * _BINS_A_UNIT))).cast("int")


def _accepted(tokens: DataFrame, rate: float) -> dict[int, int]:
    """The last bin that the Benjamini-Hochberg rule accepts, for each class of lengths; tokens has
    length_class and bin. The histogram has under 2000 rows, whatever the input."""
    counts: dict[int, dict[int, int]] = {}
    for r in tokens.groupBy("length_class", "bin").count().collect():
        counts.setdefault(r["length_class"], {})[r["bin"]] = r["count"]
    from statistics import NormalDist

    out = {}
    for at, bins in counts.items():
        total, rank = sum(bins.values()), 0
        for b in sorted(bins):
            rank += bins[b]
            if NormalDist().cdf(b / _BINS_A_UNIT) * total <= rate * rank:
                out[at] = b
    return out


def with_spans(docs: DataFrame, base: str, random: str, alpha: float = 0.01, rate: float = 0.05) -> DataFrame:
    """docs (with a column text) with two more columns: arrays of struct(start, kind, end, found),
    sorted by start, then kind; kind is the position in KINDS.

    A first pass over the texts makes the histogram that the false-discovery rule needs, a second one
    the spans, where the rows lie: nothing is shuffled but histogram rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    assign = F.filter(spans(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 12)
    access = F.filter(spans(text, ACCESS, 1), lambda s: F.length(s["found"]) >= 18)
    fixed = F.array_sort(F.concat(assign, access, spans(text, HEX, 2)))

    def tested(base_spans: Column) -> Column:
        candidates = F.filter(spans(text, TOKEN, 3), lambda s: ~F.exists(base_spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        results = F.transform(candidates, lambda s: _bind(battery(s["found"]), lambda t: F.struct(s.alias("span"), t.alias("test"), _length_class(t["n"]).alias("length_class"), _bin(t["z_text"]).alias("bin"))))
        return F.filter(results, lambda x: x["test"].isNotNull())

    tokens = docs.select(F.explode(_bind(fixed, tested)).alias("x")).select("x.length_class", "x.bin")
    limit = F.create_map(*[F.lit(v) for pair in (_accepted(tokens, rate) or {-1: 0}).items() for v in pair])

    def passing(base_spans: Column) -> Column:
        kept = F.filter(tested(base_spans), lambda x: (x["test"]["p_random"] >= alpha) & (x["bin"] <= F.coalesce(F.try_element_at(limit, x["length_class"]), F.lit(-(10**6)))))
        return F.struct(base_spans.alias("base"), F.transform(kept, lambda x: x["span"]).alias("random"))

    rest = [c for c in docs.columns if c.lower() not in (base.lower(), random.lower())]
    both = unused("_spans_found", docs.columns)
    found = docs.select(*rest, _bind(fixed, passing).alias(both))
    return found.select(*rest, F.col(f"{both}.base").alias(base), F.col(f"{both}.random").alias(random))


def scan(docs: DataFrame, alpha: float = 0.01, rate: float = 0.05) -> DataFrame:
    """(doc_id, base, random) of every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_spans(rows, "base", "random", alpha, rate).drop("text")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span, or run of overlapping ones, replaced by mark; n_chars follows the text. Null
    texts stay null, and columns of any name stay as they are."""
    base, random = unused("_base", docs.columns), unused("_random", docs.columns)
    rows = with_spans(docs, base, random)
    found = F.array_sort(F.concat(base, random))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        piece = F.substring("text", (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        fresh = F.struct(s["end"].alias("at"), F.concat(state["parts"], F.array(piece, F.lit(mark))).alias("parts"))
        return F.when(s["start"] >= state["at"], fresh).otherwise(F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["parts"].alias("parts")))

    def finish(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substring("text", (state["at"] + 1).cast("int"), F.length("text")))

    text = F.when(F.size(found) > 0, F.aggregate(found, start, step, finish)).otherwise(F.col("text"))
    changed = {"text": text} | ({"n_chars": F.when(F.size(found) > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return rows.withColumns(changed).select(*docs.columns)


def digest(all_spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(spark, sf_dir: str) -> DataFrame:
    """Query op10_secrets: spans of secrets in all documents."""
    found = scan(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.array_sort(F.concat("base", "random"))).alias("spans")
    )
