"""The part of a pasted line that looks like a title."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T

_S = T.SPACE[1:-1]
_DIGITS = r"(?<![A-Za-z0-9_])PMID"


def without_identifiers(line: Column) -> Column:
    """The line without addresses, DOIs and PMIDs, white space as single spaces."""
    for pattern in (rf"(?i)https?://[^{_S}]+", rf"(?i)doi:[{_S}]*10\.[^{_S}]+", rf"10\.[0-9]{{4,9}}/[^{_S}]+", rf"(?i){_DIGITS}[:{_S}]*[0-9]+"):
        line = F.regexp_replace(line, pattern, "")
    return T.squeeze(line)


def likely_title(line: Column, most: int | None = 220) -> Column:
    """What stands between "(year)." and the next full stop, if that is longer than twelve characters;
    otherwise the first of several sentences that is longer than twenty, names no "et al", and begins with
    neither a year nor a family name with initials; otherwise the line."""

    def pick(clean: Column) -> Column:
        after = F.regexp_extract(clean, r"^.+?\s*\([0-9]{4}\)\.\s*(.+)$", 1)
        dated = T.strip(F.element_at(F.split(T.strip(after), r"\.\s+", 2), 1))
        parts = F.filter(F.transform(F.split(clean, "[.。]"), T.strip), lambda p: p != "")
        good = F.filter(parts, lambda p: (F.length(p) > 20) & ~p.rlike(r"(?i)(?<![A-Za-z0-9_])et\s+al(?![A-Za-z0-9_])") & ~p.rlike(r"^[A-Z][a-z]+\s+[A-Z]{1,3}(\s*,|$)") & ~p.rlike("^(19|20)[0-9]{2}"))
        one = F.when(F.size(parts) >= 2, F.get(good, F.lit(0)))
        title = F.when(F.length(dated) > 12, dated).otherwise(F.coalesce(one, clean))
        return F.substring(title, 1, most) if most else title

    return T.let(without_identifiers(F.coalesce(line, F.lit(""))), pick)
