"""Identifiers in text: finding, classifying and reading them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T

_S = T.SPACE[1:-1]
#: What ends a DOI, and what is cut off its end.
DOI_STOPS = "|;,，；\\]>\"'"
DOI_TAIL = r"[.)\]}>，；;]+$"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))


def dois(text: Column, most: int = 10) -> Column:
    """The first distinct DOIs, in any case, as they are written first."""
    found = F.transform(_all(text, rf"(10\.\d{{4,9}}/[^{_S}{DOI_STOPS}]+)"), lambda x: F.regexp_replace(x, DOI_TAIL, ""))
    return F.slice(T.let(found, lambda f: T.keep_first(f, F.lower)), 1, most)


def pmids(text: Column, most: int = 10) -> Column:
    """The first distinct numbers that are marked as PMID."""
    return F.slice(F.array_distinct(_all(text, rf"(?i)(?<![A-Za-z0-9_])PMID[:{_S}]*([0-9]{{5,9}})(?![A-Za-z0-9_])")), 1, most)


def year_hint(text: Column) -> Column:
    """The first year in parentheses, or the first bare year from 1900 on."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\((\d{4})[a-z]?\)|(?<![A-Za-z0-9_])((?:19|20)\d{2})(?![A-Za-z0-9_])", 0)
    return F.nullif(F.regexp_extract(found, r"(\d{4})", 1), F.lit("")).cast("int")


def only_dois(line: Column) -> Column:
    """Whether a line holds DOIs and punctuation, nothing else. A DOI that is repeated counts as other text."""

    def without(rest: Column, doi: Column) -> Column:
        at = F.instr(F.lower(rest), F.lower(doi))
        return F.when(at > 0, F.concat(F.substring(rest, F.lit(1), at - 1), rest.substr(at + F.length(doi), F.length(rest)))).otherwise(rest)

    def empty(t: Column) -> Column:
        rest = F.aggregate(dois(t), t, without)
        for pattern in (r"(?i)https?://(?:dx\.)?doi\.org/", rf"(?i)doi[:{_S}]*", rf"[{_S}.;,|:：，；\[\]>\"']+"):
            rest = F.regexp_replace(rest, pattern, "")
        return (F.size(dois(t)) > 0) & (rest == "")

    return T.let(T.strip(F.coalesce(line, F.lit(""))), empty)


def only_pmid(line: Column) -> Column:
    return T.strip(F.coalesce(line, F.lit(""))).rlike(rf"(?i)^(?:PMID[:{_S}]*)?[0-9]{{5,9}}\.?$")


def kind(query: Column) -> Column:
    """doi, pmid, work, trial or text: how a work is asked for; null if nothing is asked."""
    t = T.strip(F.coalesce(query, F.lit("")))
    return (
        F.when(t == "", None)
        .when(t.rlike(rf"(?i)^10\.\d{{4,}}/[^{_S}]+") | F.startswith(F.lower(t), F.lit("doi:")), "doi")
        .when(t.rlike("(?i)^PMID|^[0-9]{5,9}$"), "pmid")
        .when(t.rlike("(?i)^W[0-9]+|/W[0-9]+$"), "work")
        .when(t.rlike("(?i)^NCT[0-9]{8}$"), "trial")
        .otherwise("text")
    )


def value(query: Column, of_kind: Column) -> Column:
    """The identifier itself: DOIs in lower case, works as W and a number, other text stripped."""
    t = T.strip(query)
    return (
        F.when(of_kind == "doi", F.lower(T.strip(F.regexp_replace(t, "(?i)^doi:", ""))))
        .when(of_kind == "pmid", T.strip(F.regexp_replace(t, rf"(?i)^PMID[:{_S}]*", "")))
        .when(of_kind == "work", F.upper(F.element_at(F.split(t, "/"), -1)))
        .otherwise(t)
    )


def shortcut(query: Column) -> Column:
    """Whether a paper search is for one identifier; bare numbers need seven digits."""
    t = T.strip(F.coalesce(query, F.lit("")))
    return t.rlike(rf"(?i)^10\.\d{{4,}}/[^{_S}]+|^PMID|^[0-9]{{7,9}}$")
