"""Rows of sources as the fields that are shown: defaults, limits and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import labels as L
from quillspark.functions import text as T


def or_else(x: Column, default: str) -> Column:
    """x, or the default where it is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def _filled(names: Column) -> Column:
    return F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n.isNotNull() & (n != ""))


def authors_line(names: Column, most: int = 3) -> Column:
    """The first names, and " et al." if there are more."""
    return T.let(_filled(names), lambda n: F.concat(F.array_join(F.slice(n, 1, most), ", "), F.when(F.size(n) > most, " et al.").otherwise("")))


def first_authors(names: Column, most: int = 5) -> Column:
    """The named among the first authors, or a dash."""
    return or_else(F.array_join(_filled(F.slice(names, 1, most)), ", "), "—")


def year_of(day: Column) -> Column:
    """Year at the start of a date as text, if it is one after 1800."""
    return T.let(F.substring(day, 1, 4).try_cast("int"), lambda y: F.when(y > 1800, y))


def gate_link(pdf: Column, doi: Column, mode: str, origin: str) -> Column:
    """Link that opens a PDF by the gate at origin, by a redirect or another mode; null without a PDF."""
    shown = "" if mode == "redirect" else f"&mode={mode}"
    query = F.concat(F.lit("?url="), F.url_encode(pdf), F.lit(shown), F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("&doi="), F.url_encode(doi))).otherwise(""))
    return F.when(F.coalesce(pdf, F.lit("")) != "", F.concat(F.lit(origin), query))


def paper(title: Column, abstract: Column, short: Column, names: Column, kinds: Column, doi: Column, pdf: Column, is_open: Column, cited: Column, url: Column) -> dict[str, Column]:
    """Columns of a paper as it is listed: the abstract, or else its short form, up to 2500 characters."""
    shown = or_else(title, "Untitled")
    body = F.substring(F.coalesce(F.nullif(abstract, F.lit("")), short, F.lit("")), 1, 2500)
    has = lambda x: F.coalesce(x, F.lit("")) != ""
    return {
        "title": shown,
        "abstract": body,
        "authors": first_authors(names),
        "tags": L.evidence_tags(F.concat_ws(" ", shown, F.array_join(kinds, " "), body)),
        "is_open": F.coalesce(is_open, F.lit(False)) | has(pdf),
        "cited": F.coalesce(cited, F.lit(0)),
        "url": F.when(has(url), url).when(has(doi), F.concat(F.lit("https://doi.org/"), doi)),
    }


def seed(doi: Column, pmid: Column, title: Column) -> Column:
    """What other searches are started with: DOI, PMID or title."""
    return F.coalesce(F.nullif(doi, F.lit("")), F.concat(F.lit("PMID:"), F.nullif(pmid, F.lit(""))), T.strip(F.coalesce(title, F.lit(""))))


def trial(brief: Column, official: Column, conditions: Column, interventions: Column) -> dict[str, Column]:
    title = F.coalesce(F.nullif(brief, F.lit("")), or_else(official, "Untitled trial"))
    return {"title": title, "conditions": F.slice(conditions, 1, 6), "interventions": F.slice(_filled(interventions), 1, 6)}


def drug_line(drugs: Column, query: Column, most: int = 3) -> Column:
    """Names of drugs, the first that holds the query's first word in front and not repeated."""

    def lead(names: Column) -> Column:
        word = F.element_at(F.split(F.lower(query), T.SPACE), 1)
        hits = F.filter(names, lambda n: F.contains(F.lower(n), F.when(word == "", F.lower(query)).otherwise(word)))
        return T.let(hits, lambda h: F.when(F.size(h) > 0, F.concat(F.slice(h, 1, 1), F.array_remove(names, F.get(h, F.lit(0))))).otherwise(names))

    return F.array_join(F.slice(T.let(_filled(drugs), lead), 1, most), ", ")


def number(x: Column, digits: int = 2) -> Column:
    """Whole numbers as they are, others with decimals, a dash for none."""
    return F.when(x.isNull() | F.isnan(x), "—").when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.format_string(f"%.{digits}f", x))


def label_rows(*pairs: tuple[str, Column]) -> Column:
    """Array of struct(label, value) of the pairs whose value isn't null or empty."""
    return F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit("")) != "", F.struct(F.lit(k).alias("label"), v.alias("value"))) for k, v in pairs]))


def volume_line(volume: Column, issue: Column, pages: Column) -> Column:
    parts = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k} "), v)) for k, v in (("卷", volume), ("期", issue), ("页", pages))]
    return F.array_join(F.array_compact(F.array(*parts)), " · ")


def author_of(name: Column) -> Column:
    """struct(given, family) of a display name: the last word is the family name."""
    words = F.filter(F.split(F.coalesce(name, F.lit("")), f"{T.SPACE}+"), lambda w: w != "")
    return T.let(words, lambda w: F.struct(F.when(F.size(w) > 1, F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " ")).alias("given"), F.get(w, F.size(w) - 1).alias("family")))


def dataset_citations(key: Column, authors: Column, title: Column, venue: Column, year: Column, doi: Column) -> dict[str, Column]:
    """A dataset in three styles."""
    y, v = F.coalesce(year.cast("string"), F.lit("n.d.")), F.coalesce(venue, F.lit(""))
    d = F.coalesce(doi, F.lit(""))
    escaped = lambda x: F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), r"([{}#%&_$])", r"\\$1")
    name = F.substring(F.regexp_replace(F.when(d != "", d).otherwise(key), "[^a-zA-Z0-9]", ""), 1, 20)
    return {
        "apa": F.concat(authors, F.lit(". ("), y, F.lit("). "), title, F.lit(". "), v, F.when(d != "", F.concat(F.lit(". https://doi.org/"), d)).otherwise("")),
        "gbt": F.concat(authors, F.lit(". "), title, F.lit("[DB/OL]. "), v, F.lit(", "), y, F.lit(".")),
        "bibtex": F.concat(F.lit("@misc{"), name, F.lit(",\n  title={"), escaped(title), F.lit("},\n  author={"), escaped(authors), F.lit("},\n  year={"), y, F.lit("}\n}")),
    }


#: Patterns of errors and warnings in order, and what is shown for them.
_FALLBACK = "请求失败，请稍后重试"
_BUSY = "部分检索通道繁忙，已自动改用备用通道返回结果。"
_PARTLY = "部分通道暂时不可用，已尽量用可用结果展示。"
ERRORS = (
    ("429|Too Many|rate limit", "检索繁忙，请稍后再试或换个关键词。"),
    ("timeout|AbortError|aborted", "请求超时，请重试。"),
    ("Upstream|ECONN|ENOTFOUND|fetch failed", _FALLBACK),
    (r"https?://|api\.|\.org|\.gov|\.edu", _FALLBACK),
)
WARNINGS = (("429|Too Many|rate", _BUSY), (r"Upstream|https?://|api\.|\.org|\.gov", _PARTLY))


def _shown(raw: Column, rules, most: int, otherwise: str) -> Column:
    out = F.when(F.length(raw) > most, otherwise).otherwise(raw)
    for pattern, message in reversed(rules):
        out = F.when(raw.rlike(f"(?i){pattern}"), message).otherwise(out)
    return out


def error_text(raw: Column) -> Column:
    return F.when(F.coalesce(raw, F.lit("")) == "", _FALLBACK).otherwise(_shown(raw, ERRORS, 100, _FALLBACK))


def warning_text(raw: Column) -> Column:
    return F.when(F.coalesce(raw, F.lit("")) != "", _shown(raw, WARNINGS, 160, _PARTLY))


def abstracts_of(xml: Column) -> Column:
    """Array of struct(key, abstract) of an XML text of articles: the parts of each abstract without tags,
    joined, up to 2500 characters; articles without number or abstract are left out."""
    tag = lambda c: F.regexp_extract(c, r"(?is)<MedlineCitation.*?<PMID[^>]*>(\d+)</PMID>", 1)

    def text(c: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<AbstractText\b[^>]*>(.*?)</AbstractText>"), F.lit(1)), lambda p: L.strip_markup(F.regexp_replace(p, "<[^>]+>", "")))
        return F.substring(T.squeeze(F.array_join(F.filter(parts, lambda p: p != ""), " ")), 1, 2500)

    found = F.transform(F.split(xml, "(?i)</PubmedArticle>"), lambda c: F.struct(tag(c).alias("key"), text(c).alias("abstract")))
    return F.filter(found, lambda x: (x["key"] != "") & (x["abstract"] != ""))


def page_span(first: Column, last: Column) -> Column:
    """First and last page with a hyphen, the first page alone, or null."""
    known = F.nullif(first, F.lit(""))
    return F.when(known.isNotNull() & (last != ""), F.concat(known, F.lit("-"), last)).otherwise(known)


def first_year(printed: Column, issued: Column, online: Column) -> Column:
    """Year of the first dated form, dates being arrays that begin with the year; 0 is no year."""
    return F.coalesce(*[F.nullif(F.get(d, F.lit(0)), F.lit(0)) for d in (printed, issued, online)])


def short_abstract(text: Column, most: int = 900) -> Column:
    """Without tags, up to 900 characters; null if nothing is left."""
    return F.nullif(F.substring(T.squeeze(F.regexp_replace(text, "<[^>]+>", " ")), 1, most), F.lit(""))


def index_title(title: Column) -> Column:
    """Without its last full stop; null for rows that have no title of their own."""
    return F.when((title != "") & (title != "Untitled"), T.strip(F.regexp_replace(title, r"\.$", "")))


def family_first(names: Column) -> Column:
    """Display names as "Family Given", joined; null if there is none."""
    return F.nullif(F.array_join(F.transform(_filled(names), lambda n: T.let(author_of(n), lambda a: F.concat_ws(" ", a["family"], a["given"]))), ", "), F.lit(""))


def search_year(day: Column) -> Column:
    """Year of a date as the medical index prints it: its first four characters, if they are a number other than 0."""
    return F.nullif(F.substring(day, 1, 4).try_cast("int"), F.lit(0))


def index_row(title: Column, day: Column, authors: Column, doi: Column, pmid: Column, abstract: Column) -> dict[str, Column]:
    """Columns of a medical index row as a paper is listed. The index counts no citations and states no open access."""
    return {
        "title": title,
        "year": search_year(day),
        "cited": F.lit(0).cast("long"),
        "authors": or_else(authors, "—"),
        "doi": F.nullif(doi, F.lit("")),
        "is_open": F.lit(False),
        "tags": L.evidence_tags(F.concat_ws(" ", title, abstract)),
        "url": F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")),
    }


def year_bucket(year: Column) -> Column:
    """Span of years that colours a work; unknown for none or 0. Fixed values."""
    return F.when(F.coalesce(year, F.lit(0)) == 0, "unknown").when(year >= 2022, "2022").when(year >= 2018, "2018").when(year >= 2012, "2012").otherwise("older")


def pmid_digits(link: Column) -> Column:
    """The digits of a PMID that may be given as a link; null if there are none."""
    return F.nullif(F.regexp_replace(F.regexp_replace(link, r"(?i)^https?://pubmed\.ncbi\.nlm\.nih\.gov/", ""), r"[^0-9]", ""), F.lit(""))


def doi_link(doi: Column) -> Column:
    """Link of a DOI that may be given as one; null for none."""
    bare = T.strip(F.regexp_replace(doi, r"(?i)^https?://doi\.org/", ""))
    return F.concat(F.lit("https://doi.org/"), F.nullif(bare, F.lit("")))


def record_link(doi: Column, landing: Column) -> Column:
    """Where a record is shown: by its DOI, else its landing page."""
    return F.coalesce(F.concat(F.lit("https://doi.org/"), F.nullif(doi, F.lit(""))), F.nullif(landing, F.lit("")))


def first_named(authors: Column) -> Column:
    """The first author of a list with commas; null if nothing stands before the first one."""
    return F.nullif(T.strip(F.get(F.split(authors, ","), F.lit(0))), F.lit(""))


def named_authors(authors: Column) -> Column:
    """Author structs (family, given, name) with empty fields as null, without those that have none."""
    filled = F.transform(F.coalesce(authors, F.array().cast("array<struct<family:string,given:string,name:string>>")), lambda a: F.struct(*[F.nullif(a[c], F.lit("")).alias(c) for c in ("family", "given", "name")]))
    return F.filter(filled, lambda a: F.coalesce(a["family"], a["given"], a["name"]).isNotNull())


def component(x: Column) -> Column:
    """x as a part of a URL, a space as %20; letters, digits and -_.~!*'() stay."""
    out = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def registry_links(term: Column) -> dict[str, Column]:
    """Searches for a term in two trial registries. Their paths."""
    x = component(T.strip(term))
    return {"chictr": F.concat(F.lit("https://www.chictr.org.cn/searchproj.html?title="), x), "ictrp": F.concat(F.lit("https://trialsearch.who.int/?Term="), x)}


def paper_links(doi: Column, pmid: Column, title: Column, venue: Column, page: Column, pdf: Column) -> Column:
    """Array of struct(key, href): the PDF, the page a paper opens at (its own, by DOI, or by PMID) unless that is the
    PDF, and the other searches that its identifiers, title and venue start."""
    has = lambda x: F.nullif(x, F.lit(""))
    number = F.nullif(F.regexp_replace(pmid, "[^0-9]", ""), F.lit(""))
    opened = F.coalesce(has(page), doi_link(doi), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), number, F.lit("/")))
    start, journal, name = has(seed(doi, pmid, title)), has(T.strip(F.coalesce(venue, F.lit("")))), has(T.strip(F.coalesce(title, F.lit(""))))
    tool = lambda key, path, x: (key, F.concat(F.lit(path), component(x)))
    # Keys and paths of the searches, in the order they are listed.
    links = [
        ("pdf", has(pdf)),
        ("open", F.when(has(pdf).isNull() | (opened != pdf), opened)),
        tool("map", "/map?q=", start),
        tool("trials", "/trials?q=", start),
        tool("datasets", "/datasets?q=", has(T.strip(F.coalesce(has(title), journal, start)))),
        tool("journals", "/journals?q=", journal),
        tool("papers", "/papers?q=", start),
        tool("match", "/match?q=", F.substring(name, 1, 200)),
        tool("citations", "/citations?seed=", F.coalesce(has(doi), has(title))),
    ]
    return F.filter(F.array(*[F.struct(F.lit(k).alias("key"), href.alias("href")) for k, href in links]), lambda x: x["href"].isNotNull())


def adverse_event(drugs: Column, reactions: Column, query: Column, report: Column) -> dict[str, Column]:
    """Columns of an adverse event report as a dataset hit: up to three drugs and four reactions."""
    named = drug_line(drugs, query)
    effects = F.array_join(F.slice(_filled(reactions), 1, 4), ", ")
    # What is shown.
    return {
        "title": F.when(named != "", F.concat(F.lit("openFDA AE · "), named)).otherwise(F.concat(F.lit("openFDA safety report "), report)),
        "description": F.when(effects != "", F.concat(F.lit("Reactions: "), effects, F.lit("（打开为 openFDA JSON 记录）"))).otherwise("Drug adverse event report metadata（打开为 openFDA JSON 记录）"),
        "url": F.concat(F.lit("https://api.fda.gov/drug/event.json?search=safetyreportid:"), component(report)),
    }


def holds_word(query: Column, *fields: Column) -> Column:
    """Whether any word of the query is a part of the fields' joined text, without case. False for a query without words."""
    text = F.lower(F.concat_ws(" ", *fields))
    return F.exists(F.filter(F.split(F.lower(query), f"{T.SPACE}+"), lambda w: w != ""), lambda w: F.contains(text, w))
