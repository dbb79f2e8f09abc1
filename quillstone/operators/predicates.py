"""Filter builders: each returns a Column, or None where the filter is absent."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term(column: str, value: str | Sequence[str] | None) -> Column | None:
    """Equality, or membership in a list without its empty strings; a falsy value is no filter."""
    if not value:
        return None
    if isinstance(value, str):
        return F.col(column) == value
    kept = [v for v in value if v != ""]
    return F.col(column).isin(kept) if kept else None


def number_range(column: str, least: float | None, most: float | None) -> Column | None:
    """Inclusive range; there is no filter where both bounds are falsy (0 counts as falsy then)."""
    if not least and not most:
        return None
    out = F.lit(True)
    if least is not None:
        out = out & (F.col(column) >= least)
    if most is not None:
        out = out & (F.col(column) <= most)
    return out


def date_range(column: str, after: str | None, before: str | None, today: dt.date | None = None) -> Column | None:
    """From the start of ``after`` to the end of ``before``; either may be a relative date."""
    if not after and not before:
        return None
    c, out = F.col(column), F.lit(True)
    if after:
        out = out & (c >= F.lit(resolve_date(after, today)))
    if before:
        out = out & (c < F.date_add(F.lit(resolve_date(before, today)), 1))
    return out


_RELATIVE = re.compile(r"(?P<past>past )?(?P<minus>-?)(?P<n>\d+) ?(?P<unit>d|days?|m|months?|y|years?)(?P<ago> ago)?")


def resolve_date(value: str, today: dt.date | None = None) -> dt.date:
    """An ISO date, or a relative one: "-10d", "5 months ago", "past 1 year". A month is 30 days, a year 365.

    A bare "5d" is ambiguous and raises ValueError.
    """
    try:
        return dt.date.fromisoformat(value.strip())
    except ValueError:
        pass
    m = _RELATIVE.fullmatch(value.strip().lower())
    if not m or not (m["minus"] or m["ago"] or m["past"]):
        raise ValueError(f"no date: {value!r}")
    days = int(m["n"]) * {"d": 1, "m": 30, "y": 365}[m["unit"][0]]
    return (today or dt.date.today()) - dt.timedelta(days=days)


#: Lookup suffixes of listing filters.
_LOOKUPS = {
    "exact": lambda c, v: c == v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "range": lambda c, v: c.between(v[0], v[1]),
    "in": lambda c, v: c.isin(list(v)),
    "iexact": lambda c, v: F.lower(c) == v.lower(),
    "startswith": lambda c, v: c.startswith(v),
    "istartswith": lambda c, v: F.lower(c).startswith(v.lower()),
    "endswith": lambda c, v: c.endswith(v),
    "icontains": lambda c, v: F.lower(c).contains(v.lower()),
    "isnull": lambda c, v: c.isNull() if v else c.isNotNull(),
    "year": lambda c, v: F.year(c) == v,
    "month": lambda c, v: F.month(c) == v,
    "day": lambda c, v: F.dayofmonth(c) == v,
    "hour": lambda c, v: F.hour(c) == v,
    "minute": lambda c, v: F.minute(c) == v,
    "second": lambda c, v: F.second(c) == v,
}


def lookups(df: DataFrame, allowed: Sequence[str], **params) -> DataFrame:
    """Rows that pass ``column__lookup=value`` filters; unknown names and empty values are errors."""
    for key, value in params.items():
        column, _, how = key.partition("__")
        how = how or "exact"
        if column not in allowed or how not in _LOOKUPS:
            raise ValueError(f"unknown filter {key!r}")
        if value is None or value == "" or value == []:
            raise ValueError(f"empty filter {key!r}")
        df = df.where(_LOOKUPS[how](F.col(column), value))
    return df


def all_of(df: DataFrame, *filters: Column | None) -> DataFrame:
    """Rows that pass every present filter."""
    for f in filters:
        if f is not None:
            df = df.where(f)
    return df


def prefix_any(columns: Sequence[str], terms: Sequence[str], most_terms: int = 7) -> Column:
    """Whether a term begins one of the columns, letter case aside."""
    out = F.lit(False)
    for t in terms[:most_terms]:
        for c in columns:
            out = out | F.lower(F.coalesce(c, F.lit(""))).startswith(t.lower())
    return out
