"""Building blocks of the DuckDB statements that queries are checked against."""

from __future__ import annotations

from quillspark.functions.text import STOP_WORDS

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
CJK = "一-鿿"
SPACE = r"[\x09-\x0D\x20\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9{CJK}]+', ' ', 'g'), ' ')"


def tokens(x: str, least: int = 2) -> str:
    return (
        f"flatten(list_transform(list_filter(string_split({norm(x)}, ' '), lambda p: p <> ''), lambda p: CASE WHEN regexp_matches(p, '[{CJK}]') "
        f"THEN CASE WHEN length(p) = 1 THEN [p] ELSE list_transform(range(1, length(p)), lambda i: substr(p, i, 2)) END "
        f"WHEN length(p) >= {least} AND p NOT IN ({STOPS}) THEN [p] ELSE [] END))"
    )


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def first_line(x: str) -> str:
    return f"string_split({x}, chr(10))[1]"


def stops(x: str) -> str:
    return f"length(regexp_replace({x}, '[^.。!！?？]', '', 'g'))"


def mode(x: str) -> str:
    return f"CASE WHEN length({x}) <= 200 AND {stops(x)} <= 1 THEN 'title' ELSE 'body' END"


def rounded(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def share(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE len(list_filter({a}, lambda w: list_contains({b}, w))) / len({a}) END"


def harmonic(p: str, r: str) -> str:
    return f"CASE WHEN ({p}) + ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END"


def similarity(na: str, nb: str, f1: str, strict: bool = False, lost: str = "false", p: str = "0", r: str = "0") -> str:
    """From columns: normalised names, F1, and for strict whether a leading word is lost, and both shares."""
    ratio = f"(least(length({na}), length({nb})) / greatest(length({na}), length({nb}), 1))"
    holds = f"(contains({na}, {nb}) OR contains({nb}, {na}))"
    if strict:
        near = (
            f"WHEN {holds} AND {ratio} < 0.92 THEN least({f1}, {ratio} * 0.9 + 0.05) WHEN {holds} THEN least(0.94, greatest({f1}, {ratio} * 0.9)) "
            f"WHEN {lost} AND {p} >= 0.8 THEN least({f1}, 0.84) WHEN {p} >= 0.85 AND {r} < 0.9 THEN least({f1}, 0.86) WHEN {ratio} < 0.82 THEN least({f1}, {ratio} + 0.08)"
        )
    else:
        near = f"WHEN {holds} THEN least(0.99, greatest({f1}, {ratio} * 0.95)) WHEN {ratio} < 0.55 THEN least({f1}, {ratio} + 0.15)"
    return f"CASE WHEN {na} = '' OR {nb} = '' THEN 0.0 WHEN {na} = {nb} THEN 1.0 {near} ELSE {f1} END"


def sentences(x: str, most: int = 10, every: bool = False) -> str:
    """List of sentences; chr(1) marks where the text is to be cut. With every, all of them, in full."""
    blocks = f"list_filter(list_transform(regexp_split_to_array({strip(f'replace(coalesce({x}, {chr(39)*2}), chr(13) || chr(10), chr(10))')}, '\\n+'), lambda b: {strip('b')}), lambda b: b <> '')"
    cut = f"string_split(regexp_replace(regexp_replace(b, '([.。!！?？]){SPACE}+', '\\1' || chr(1), 'g'), '([。！？])', '\\1' || chr(1), 'g'), chr(1))"
    parts = f"list_filter(list_transform({cut}, lambda s: {strip('s')}), lambda s: length(s) >= 8)"
    of_block = f"CASE WHEN length(b) <= 220 AND {stops('b')} < 2 THEN [b] WHEN len({parts}) > 0 THEN {parts} WHEN length(b) >= 8 THEN [b] ELSE [] END"
    raw = f"flatten(list_transform({blocks}, lambda b: {of_block}))"
    words = f"list_transform(regexp_split_to_array(r[1], '{SPACE}+'), lambda w: [w])"
    chunks = f"list_reduce({words}, lambda acc, y: CASE WHEN length(acc[-1]) + 1 + length(y[1]) > 180 THEN list_concat(acc, y) ELSE list_concat(acc[:-2], [acc[-1] || ' ' || y[1]]) END)"
    whole = f"list_transform([{raw}], lambda r: CASE WHEN len(r) = 1 AND length(r[1]) > 320 THEN {chunks} ELSE r END)[1]"
    if every:
        named = f"list_filter(list_transform({whole}, lambda s: {{'s': {squeeze('s')}, 'n': {norm('s')}}}), lambda s: length(s.n) >= 6)"
        return f"list_transform([{named}], lambda k: list_transform(list_filter(k, lambda s, i: list_position(list_transform(k, lambda t: t.n), s.n) = i), lambda s: s.s))[1]"
    clipped = f"list_transform({whole}, lambda s: substr({squeeze('s')}, 1, 500))"
    key = f"substr({norm('s')}, 1, 96)"
    known = f"list_filter({clipped}, lambda s: length({key}) >= 6)"
    return f"list_transform([{known}], lambda k: list_filter(k, lambda s, i: list_position(list_transform(k, lambda t: substr({norm('t')}, 1, 96)), {key}) = i)[:{most}])[1]"
