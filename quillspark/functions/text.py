"""Normalising and tokenising bibliographic text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in titles.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "that", "this", "were", "was", "are", "been", "have", "has", "had", "into", "onto", "over", "under", "between", "among", "using", "used", "based",
    "study", "results", "methods", "background", "conclusion", "conclusions", "objective", "objectives", "purpose", "a", "an", "of", "in", "on", "to", "by", "or", "as", "at", "is", "be", "we",
    "our", "their", "its",
)

#: White space as the inputs have it: ASCII, no-break and ideographic.
SPACE = r"[\x09-\x0D\x20\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
CJK = r"[\u4E00-\u9FFF]"
#: The characters of SPACE.
_SPACES = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def let(value: Column, body) -> Column:
    """body(value), computing value once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(_SPACES))


def squeeze(text: Column) -> Column:
    """Inner white space to one space, none at the ends. Single spaces, most of them, stay as they are, and SPACE, a class that costs
    a dozen comparisons, is only asked about what isn't a visible ASCII character."""
    return F.trim(F.regexp_replace(text, rf"[^!-~](?:(?<= )(?![!-~]){SPACE}+|(?<! )(?<={SPACE}){SPACE}*)", " "))


def words(text: Column) -> Column:
    """The parts of a text in lower case that anything but ASCII letters, digits and CJK ideographs separates. They are taken as
    they stand: to replace what is between, by a class that says what it isn't, costs five times as much."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9\u4E00-\u9FFF]+"), F.lit(0))


def normalize(text: Column) -> Column:
    """words() with a space between."""
    return F.array_join(words(text), " ")


def tokens(text: Column, least: int = 2) -> Column:
    """Bag of words: Latin words of `least` characters or more that aren't stop words, and the
    bigrams of parts with CJK characters."""

    def of_part(p: Column) -> Column:
        bigrams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(2)))
        return F.when(p.rlike(CJK), bigrams).when(counts(p), F.array(p)).otherwise(F.array().cast("array<string>"))

    counts = lambda p: (F.length(p) >= least) & ~p.isin(*STOP_WORDS)
    # Texts without ideographs, most of them, need no array for each word.
    return F.when(text.rlike(CJK), F.flatten(F.transform(words(text), of_part))).otherwise(F.filter(words(text), counts))


def first_line(text: Column) -> Column:
    return F.element_at(F.split(text, "\n", 2), 1)


def stops(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[.。!！?？]"))


def keep_first(items: Column, key) -> Column:
    """Elements whose key has not come before, in order."""
    return let(F.transform(items, key), lambda keys: F.filter(items, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1))


def sentences(text: Column, most: int = 10, whole: bool = False) -> Column:
    """Lines, or the sentences of long ones; a single long piece is cut at spaces. Pieces are clipped at
    500 characters and distinct in the first 96 normalised ones; with whole they are all there, in full and
    distinct as such."""
    name = normalize if whole else lambda s: F.substring(normalize(s), 1, 96)
    blocks = F.filter(F.transform(F.split(strip(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n")), "\n+"), strip), lambda b: b != "")

    def of_block(b: Column) -> Column:
        parts = F.filter(F.transform(F.split(b, rf"(?<=[.。!！?？]){SPACE}+|(?<=[。！？])"), strip), lambda s: F.length(s) >= 8)
        long = let(parts, lambda p: F.when(F.size(p) > 0, p).when(F.length(b) >= 8, F.array(b)).otherwise(F.array().cast("array<string>")))
        return F.when((F.length(b) <= 220) & (stops(b) < 2), F.array(b)).otherwise(long)

    def cut(whole: Column) -> Column:
        def add(done: Column, w: Column) -> Column:
            last = F.element_at(done, -1)
            joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, F.lit(" "), w)))
            return F.when(F.size(done) == 0, F.array(w)).when(F.length(last) + 1 + F.length(w) > 180, F.concat(done, F.array(w))).otherwise(joined)

        return F.aggregate(F.split(whole, rf"{SPACE}+"), F.array().cast("array<string>"), add)

    pieces = let(F.flatten(F.transform(blocks, of_block)), lambda r: F.when((F.size(r) == 1) & (F.length(F.get(r, F.lit(0))) > 320), cut(F.get(r, F.lit(0)))).otherwise(r))
    clipped = F.transform(pieces, squeeze if whole else lambda s: F.substring(squeeze(s), 1, 500))
    known = let(F.filter(clipped, lambda s: F.length(name(s)) >= 6), lambda k: keep_first(k, name))
    return known if whole else F.slice(known, 1, most)


def search_mode(sentence: Column) -> Column:
    return F.when((F.length(sentence) <= 200) & (stops(sentence) <= 1), "title").otherwise("body")


def key_words(sentence: Column) -> Column:
    """The first 14 longer tokens as a query, if they say enough; null otherwise."""
    return let(F.array_join(F.slice(tokens(sentence, 3), 1, 14), " "), lambda q: F.when(F.length(q) > 24, q))


def rounded(x: Column, digits: int = 6) -> Column:
    """Half up on the binary value."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def highlight(text: Column, words: Column) -> Column:
    """Runs of the text as struct(text, matched): a run of letters and digits is matched if its
    normal form, of two characters or more, is among words; neighbours that agree are joined."""
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9\u4E00-\u9FFF]+|[^A-Za-z0-9\u4E00-\u9FFF]+"), F.lit(0))
    flagged = F.transform(runs, lambda r: F.struct(r.alias("text"), let(normalize(r), lambda k: (F.length(k) >= 2) & F.array_contains(words, k)).alias("matched")))

    def joined(at: Column) -> Column:
        # Each run is copied once: adding one at a time would copy all before it, which is quadratic in long titles.
        follows = lambda x, i: F.coalesce(F.get(at, i - 1)["matched"] == x["matched"], F.lit(False))
        starts = F.filter(F.transform(at, lambda x, i: F.when((i == 0) | ~follows(x, i), i)), lambda i: i.isNotNull())

        def of_starts(s: Column) -> Column:
            end = lambda j: F.coalesce(F.get(s, j + 1), F.size(at))
            text = lambda i, j: F.array_join(F.transform(F.slice(at, i + 1, end(j) - i), lambda x: x["text"]), "")
            return F.transform(s, lambda i, j: F.struct(text(i, j).alias("text"), F.get(at, i)["matched"].alias("matched")))

        return let(starts, of_starts)

    return let(flagged, joined)


def snippets(query: Column, abstract: Column, most: int = 3) -> Column:
    """The abstract's sentences that share most with the query: by shared tokens, then density."""
    parts = F.filter(F.transform(F.split(F.coalesce(abstract, F.lit("")), rf"(?<=[.。!！?？;；]){SPACE}+"), strip), lambda s: F.length(s) > 20)

    def rank(q: Column) -> Column:
        def rate(s: Column, i: Column) -> Column:
            return let(tokens(s, 3), lambda t: F.struct(F.size(F.filter(t, lambda w: F.array_contains(q, w))).alias("hit"), F.size(t).alias("n"), i.alias("i"), s.alias("s")))

        rated = F.transform(F.transform(parts, rate), lambda x: F.struct((-x["hit"]).alias("a"), (-F.when(x["n"] > 0, x["hit"] / x["n"]).otherwise(0.0)).alias("b"), x["i"].alias("i"), x["s"].alias("s")))
        kept = F.filter(rated, lambda x: (x["a"] <= -2) | (x["b"] <= -0.25))
        return F.transform(F.slice(F.array_sort(kept), 1, most), lambda x: F.when(F.length(x["s"]) > 180, F.concat(F.substring(x["s"], 1, 180), F.lit("…"))).otherwise(x["s"]))

    return let(tokens(query, 3), lambda q: F.when(F.size(q) > 0, rank(q)).otherwise(F.array().cast("array<string>")))


def inverted(words: Column) -> Column:
    """Inverted index of a document's words, map of word to positions, made where the document lies: places are sorted by
    word, and each run of equal words is an entry."""

    def entries(at: Column) -> Column:
        starts = F.filter(F.transform(at, lambda x, i: F.when((i == 0) | (F.get(at, i - 1)["word"] != x["word"]), i)), lambda i: i.isNotNull())

        def of_runs(s: Column) -> Column:
            end = lambda j: F.coalesce(F.get(s, j + 1), F.size(at))
            return F.transform(s, lambda i, j: F.struct(F.get(at, i)["word"].alias("word"), F.transform(F.slice(at, i + 1, end(j) - i), lambda x: x["pos"]).alias("places")))

        return let(starts, of_runs)

    return F.map_from_entries(let(F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("pos")))), entries))


def rebuild(index: Column) -> Column:
    """Text of an inverted index, map of word to positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")
