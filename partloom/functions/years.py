"""The catalog's year rules. They differ on purpose; each keeps the cut-offs of its use."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from partloom.functions.text import contains_text, strip


def _two(c: Column, low: Column) -> Column:
    """A two-digit year as 19xx or 20xx."""
    return F.concat(F.when(low, "20").otherwise("19"), c)


def expand_search(c: Column) -> Column:
    """00 to 29 are 2000s."""
    return _two(c, c.cast("int") <= 29)


def expand_import(c: Column) -> Column:
    """Two-digit ends of ranges joined by ` | `: 00 to 30 are 2000s."""
    end = lambda y: F.when(y.rlike(r"^\d\d$"), _two(y, F.try_to_number(y, F.lit("99")) <= 30)).otherwise(y)
    part = lambda p: F.array_join(F.transform(F.split(p, "-"), end), "-")
    return F.array_join(F.transform(F.split(c, r" \| "), part), " | ")


_RANGE = r"^(\d{2})-(\d{2})$"


def expand_range(c: Column) -> Column:
    """`yy-yy` by the cleaning rule: falling ranges end by end at 70, rising ones share a century, 19xx if either is 70 or more."""
    s = strip(c)
    a, b = F.regexp_extract(s, _RANGE, 1), F.regexp_extract(s, _RANGE, 2)
    n1, n2 = a.try_cast("int"), b.try_cast("int")
    both = F.when(n1 > n2, F.concat(_two(a, n1 < 70), F.lit("-"), _two(b, n2 < 70)))
    old = (n1 >= 70) | (n2 >= 70)
    return F.when(s.rlike(_RANGE), both.otherwise(F.concat(_two(a, ~old), F.lit("-"), _two(b, ~old)))).otherwise(s)


def expand_audit(c: Column) -> Column:
    """`yy-yy` by the audit rule: each end is 19xx from 70 on."""
    s = strip(F.coalesce(c, F.lit("")))
    a, b = F.regexp_extract(s, _RANGE, 1), F.regexp_extract(s, _RANGE, 2)
    return F.when(s.rlike(_RANGE), F.concat(_two(a, a.try_cast("int") < 70), F.lit("-"), _two(b, b.try_cast("int") < 70))).otherwise(s)


def fix_direction(c: Column) -> Column:
    """`yyyy-yyyy` with the lower year first."""
    full = r"^(\d{4})-(\d{4})$"
    a, b = F.regexp_extract(c, full, 1), F.regexp_extract(c, full, 2)
    return F.when(c.rlike(full) & (a > b), F.concat_ws("-", b, a)).otherwise(c)


def year_filter(year: Column, raw: str) -> Column | None:
    """The predicate of a year search box; None for a blank one."""
    value = raw.strip()
    if not value:
        return None
    short = lambda y: 2000 + int(y) if int(y) <= 29 else 1900 + int(y)
    found = re.match(r"^(\d{2,4})\s*[-–]\s*(\d{2,4})$", value)
    if found and len(found[1]) == len(found[2]) == 2:
        low, high = sorted((short(found[1]), short(found[2])))
        return F.exists(F.sequence(F.lit(low), F.lit(high)), lambda y: year.contains(y.cast("string")))
    if re.match(r"^\d{2}$", value):
        value = str(short(value))
    return contains_text(year, value)
