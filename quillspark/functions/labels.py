"""Classifying texts and URLs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import let, strip

#: Evidence tags and what a text of each kind says, in order.
EVIDENCE = (
    ("系统综述/Meta", r"meta[-\s]?analysis|systematic review"),
    ("RCT", r"(^|[^a-z0-9_])rct([^a-z0-9_]|$)|randomized|randomised|randomly assigned"),
    ("临床试验", r"clinical trial|phase [i1v]+|phase\s*[123]"),
    ("指南/共识", r"guideline|consensus|practice recommendation"),
    ("病例报告", r"case report|case series"),
    ("基础/实验", r"in vitro|mouse|mice|murine|knockout|organoid|cell line"),
    ("观察性", r"cohort|prospective|retrospective|observational"),
    ("综述", r"review([^a-z0-9_]|$)"),
)

#: Addresses that no public document has.
PRIVATE_HOST = r"^(127\.|10\.|192\.168\.|169\.254\.|0\.|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|172\.(1[6-9]|2\d|3[01])\.)"
LOCAL_HOST = r"^(localhost|.*\.localhost|.*\.local|0\.0\.0\.0|::1|\[::1\]|metadata\.google\.internal)$"


def evidence_tags(text: Column) -> Column:
    """Up to four tags; a plain review isn't one of meta-analyses too."""
    t = F.lower(F.coalesce(text, F.lit("")))
    first = EVIDENCE[0]
    tags = [F.when(t.rlike(rx) & (F.lit(name != "综述") | ~t.rlike(first[1])), name) for name, rx in EVIDENCE]
    return F.slice(F.array_compact(F.array(*tags)), 1, 4)


def is_garbage(abstract: Column) -> Column:
    """Not an abstract: too short, or the dump of a record."""
    t = strip(F.coalesce(abstract, F.lit("")))
    marked = t.rlike(r"(?i)\[Indexed for MEDLINE\]") & ~t.rlike(r"(?i)(^|[^a-z0-9_])(Background|Objective|Methods|Results|Conclusions|Abstract)([^a-z0-9_]|$)")
    many = (F.regexp_count(t, F.lit(r"(?i)doi:\s*10\.")) >= 2) | (F.regexp_count(t, F.lit(r"(?i)PMID:\s*\d+")) >= 2)
    return (F.length(t) < 60) | t.rlike(r"(?i)^PMID:\s*\d+") | marked | many


def url_problem(url: Column, allow_http: bool = False) -> Column:
    """Why a URL must not be fetched; null if it may be."""
    parts = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)"
    scheme, authority = F.lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d+$", ""))
    return (
        F.when(url.isNull() | (host == ""), "invalid")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(F.contains(authority, F.lit("@")), "credentials")
        .when(host.rlike(LOCAL_HOST) | host.rlike(PRIVATE_HOST), "private")
        .when((scheme == "http") & F.lit(not allow_http), "insecure")
    )


def looks_like_pdf(url: Column, content_type: Column | None = None) -> Column:
    by_url = url.rlike(r"(?i)\.pdf(\?|#|$)|/pdf([^a-z0-9_]|$)|format=pdf|type=pdf")
    return by_url if content_type is None else F.lower(content_type).rlike("application/(pdf|octet-stream)") | by_url


def file_name(url: Column) -> Column:
    last = F.element_at(F.split(F.element_at(F.split(url, "/"), -1), r"\?"), 1)
    name = F.substring(F.regexp_replace(last, r"[^A-Za-z0-9_.\-]+", "_"), 1, 80)
    full = F.when(name == "", "paper.pdf").otherwise(name)
    return F.when(F.endswith(full, F.lit(".pdf")), full).otherwise(F.concat(full, F.lit(".pdf")))


def strip_markup(text: Column) -> Column:
    """Without tags; the five named and the numeric character references decoded, ampersands first."""
    out = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " ")
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(name), F.lit(char))
    runs = lambda x: F.regexp_extract_all(x, F.lit(r"&#x[0-9a-fA-F]{1,6};|&#\d{1,7};|[^&]+|&"), F.lit(0))

    def decode(r: Column) -> Column:
        code = F.when(r.rlike("^&#x"), F.conv(r.substr(F.lit(4), F.length(r) - 4), 16, 10)).otherwise(F.regexp_extract(r, r"^&#(\d+);$", 1))
        # A pattern is tried at each place of a run, and runs are as long as texts.
        known = r.startswith("&#") & r.rlike(r"^&#x[0-9a-fA-F]+;$|^&#\d+;$") & (code.cast("int") <= 0x10FFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code.cast("int")), 8, "0")), "UTF-32")).otherwise(r)

    # Few texts have numeric references; only those are taken apart.
    return strip(let(out, lambda x: F.when(F.contains(x, F.lit("&#")), F.array_join(F.transform(runs(x), decode), "")).otherwise(x)))
