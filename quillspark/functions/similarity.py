"""Similarity of titles, authors and journal names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import let, normalize, strip, tokens

#: Words that journal names are compared without.
JOURNAL_STOPS = ("of", "the", "and", "for", "in", "on", "a", "an", "und", "der", "die", "das", "et", "al")


def share(bag: Column, other: Column) -> Column:
    """Share of the bag's tokens, with repeats, that the other bag has."""
    return F.when(F.size(bag) == 0, 0.0).otherwise(F.size(F.filter(bag, lambda w: F.array_contains(other, w))) / F.size(bag))


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def token_f1(a: Column, b: Column) -> Column:
    """Of two token bags: harmonic mean of the shares found in each other."""
    return harmonic(share(a, b), share(b, a))


def title_similarity(a: Column, b: Column, strict: bool = False) -> Column:
    """Similarity of titles in [0, 1]; strict also marks truncated titles and lost leading words down."""
    names = F.struct(normalize(a).alias("a"), normalize(b).alias("b"), tokens(a).alias("ta"), tokens(b).alias("tb"))

    def rate(x: Column) -> Column:
        return similarity_of_parts(x["a"], x["b"], share(x["ta"], x["tb"]), share(x["tb"], x["ta"]), F.exists(F.slice(x["tb"], 1, 2), lambda w: ~F.array_contains(x["ta"], w)), strict)

    return let(names, rate)


def similarity_of_parts(na: Column, nb: Column, precision: Column, recall: Column, lost_lead: Column | None = None, strict: bool = False) -> Column:
    """The same from normalised titles and the shares of their tokens."""
    return similarity_of_lengths(F.length(na), F.length(nb), F.contains(na, nb) | F.contains(nb, na), na == nb, precision, recall, lost_lead, strict)


def similarity_of_lengths(la: Column, lb: Column, holds: Column, same: Column, precision: Column, recall: Column, lost_lead: Column | None = None, strict: bool = False) -> Column:
    """The same from the lengths of normalised titles, whether one is part of the other, and whether they are equal."""

    def rate(x: Column) -> Column:
        f1, ratio = x["f1"], x["ratio"]
        empty = (la == 0) | (lb == 0)
        if not strict:
            near = F.when(holds, F.least(F.lit(0.99), F.greatest(f1, ratio * 0.95))).when(ratio < 0.55, F.least(f1, ratio + 0.15)).otherwise(f1)
        else:
            inside = F.when(ratio < 0.92, F.least(f1, ratio * 0.9 + 0.05)).otherwise(F.least(F.lit(0.94), F.greatest(f1, ratio * 0.9)))
            near = (
                F.when(holds, inside)
                .when(lost_lead & (precision >= 0.8), F.least(f1, F.lit(0.84)))
                .when((precision >= 0.85) & (recall < 0.9), F.least(f1, F.lit(0.86)))
                .when(ratio < 0.82, F.least(f1, ratio + 0.08))
                .otherwise(f1)
            )
        return F.when(empty, 0.0).when(same, 1.0).otherwise(near)

    ratio = F.least(la, lb) / F.greatest(la, lb, F.lit(1))
    return let(F.struct(harmonic(precision, recall).alias("f1"), ratio.alias("ratio")), rate)


def _initials(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), "")


def author_match(hint: Column, resolved: Column) -> Column:
    """Whether a cited first author is the resolved one: by family name, then initials."""

    def parts(name: Column) -> Column:
        return F.filter(F.split(normalize(name), " "), lambda p: p != "")

    def rate(x: Column) -> Column:
        family = F.coalesce(F.get(F.filter(x["h"], lambda p: F.length(p) > 2), F.lit(0)), F.get(x["h"], F.lit(0)), F.lit(""))

        def compare(y: Column) -> Column:
            rest = F.filter(x["h"], lambda p: p != y)
            other = F.filter(x["r"], lambda p: p != y)
            compact = F.regexp_replace(F.array_join(rest, ""), r"[^a-z\u4E00-\u9FFF]", "")
            own = F.when(F.size(rest) == 0, "").when((F.length(compact) <= 4) & F.forall(rest, lambda p: F.length(p) <= 2), compact).otherwise(_initials(rest))
            return let(
                F.struct(own.alias("own"), other.alias("other")),
                lambda z: F.when((y == "") | ~F.contains(x["name"], y), 0.0)
                .when(z["own"] == "", 1.0)
                .when(F.size(z["other"]) == 0, 0.85)
                .when(z["own"] == _initials(z["other"]), 1.0)
                .when((F.length(z["own"]) == 1) & (F.substring(F.get(z["other"], F.lit(0)), 1, 1) == z["own"]), 1.0)
                .otherwise(0.2),
            )

        return let(family, compare)

    known = F.struct(parts(hint).alias("h"), parts(resolved).alias("r"), normalize(resolved).alias("name"))
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    return F.when(blank(hint), 1.0).when(blank(resolved), 0.0).otherwise(let(known, rate))


def journal_match(cited: Column, resolved: Column) -> Column:
    """Whether a cited journal name, often abbreviated, is the resolved one: its words have to be
    beginnings of the full name's words, in order."""

    def words(n: Column, least: int) -> Column:
        return F.filter(F.split(n, " "), lambda w: (F.length(w) >= least) & ~w.isin(*JOURNAL_STOPS))

    def fits(w: Column, t: Column) -> Column:
        return F.startswith(w, t) | ((F.length(t) > 1) & F.startswith(t, w)) | ((F.length(t) >= 2) & F.startswith(w, F.substring(t, 1, 2)))

    def align(x: Column) -> Column:
        def add(state: Column, t: Column) -> Column:
            later = F.filter(F.sequence(F.lit(0), F.size(x["wb"]) - 1), lambda j: (j >= state["at"]) & fits(F.get(x["wb"], j), t))
            return let(F.get(later, F.lit(0)), lambda j: F.struct(F.when(j.isNotNull(), j + 1).otherwise(state["at"]).alias("at"), (state["hits"] + F.when(j.isNotNull(), 1).otherwise(0)).alias("hits")))

        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("hits"))
        return F.aggregate(x["wa"], start, add, lambda s: s["hits"])

    def compare(n: Column) -> Column:
        a, b = n["a"], n["b"]
        bags = F.struct(words(a, 1).alias("wa"), words(b, 2).alias("wb"))

        def rate(x: Column) -> Column:
            return let(
                align(x),
                lambda hits: F.when((hits / F.size(x["wa"]) >= 0.8) & (hits / F.size(x["wb"]) >= 0.8), 0.93)
                .when((hits / F.size(x["wa"]) >= 0.65) & (hits / F.size(x["wb"]) < 0.8), 0.45)
                .otherwise(title_similarity(a, b, strict=True)),
            )

        aligned = let(bags, lambda x: F.when((F.size(x["wa"]) == 0) | (F.size(x["wb"]) == 0), 0.0).otherwise(rate(x)))
        return (
            F.when((a == "") | (b == ""), 1.0)
            .when(a == b, 1.0)
            .when(F.contains(b, a) & (F.length(a) >= F.least(F.lit(14), F.floor(F.length(b) * 0.45))), 0.95)
            .when(F.contains(a, b) & (F.length(b) >= 8), 0.95)
            .otherwise(aligned)
        )

    return let(F.struct(normalize(cited).alias("a"), normalize(resolved).alias("b")), compare)


def composite(title: Column, author: Column, journal: Column, has_author: Column, year_hint: Column, year: Column, has_journal: Column) -> Column:
    """Score of a candidate for a reference without identifiers; conflicts of author or year cap it."""
    gap = F.abs(year_hint.try_cast("int") - year)
    has_year = F.coalesce(year_hint, F.lit("")) != ""
    years = F.when(~has_year | year.isNull(), 1.0).when(gap.isNull(), 0.5).when(gap == 0, 1.0).when(gap == 1, 0.4).otherwise(0.0)
    author_weight, year_weight = F.when(has_author, 0.22).otherwise(0.08), F.when(has_year, 0.15).otherwise(0.08)
    journal_weight = F.when(has_journal, 0.08).otherwise(0.04)
    return (
        F.when(title < 0.55, 0.0)
        .when(has_author & (author < 0.5) & (title < 0.93), F.least(title * 0.35, F.lit(0.4)))
        .when(has_year & (years == 0) & (title < 0.96), F.least(title * 0.4, F.lit(0.45)))
        .otherwise(title * (1 - author_weight - year_weight - journal_weight) + author * author_weight + years * year_weight + journal * journal_weight)
    )
