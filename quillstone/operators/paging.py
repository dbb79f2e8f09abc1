"""Keyset and offset paging, sort keys, opaque cursors."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyset_batch(df: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """The next ``size`` rows after a key."""
    return df.where(F.col(key) > after).orderBy(key).limit(size)


def search_after(df: DataFrame, sort: str, unique: str, size: int, after: tuple | None = None, descending: bool = True, backward: bool = False) -> DataFrame:
    """One row more than a page after the cursor (sort value, unique value); a backward page reads the other way.

    The unique column breaks ties in the direction of the sort. Rows without a sort value come last.
    """
    down = descending != backward
    if after is not None:
        s, u = F.col(sort), F.col(unique)
        beyond = (s < after[0]) | ((s == after[0]) & (u < after[1])) if down else (s > after[0]) | ((s == after[0]) & (u > after[1]))
        df = df.where(beyond)
    order = [F.col(sort).desc_nulls_last(), F.col(unique).desc()] if down else [F.col(sort).asc_nulls_last(), F.col(unique).asc()]
    page = df.orderBy(*order).limit(size + 1)
    return page.orderBy(*([F.col(sort).desc_nulls_last(), F.col(unique).desc()] if descending else [F.col(sort).asc_nulls_last(), F.col(unique).asc()])) if backward else page


def offset_page(df: DataFrame, order: list[Column], page: int, size: int, deepest: int = 100) -> DataFrame:
    """Page ``page`` (0 is read as 1); pages beyond ``deepest`` are an error."""
    page = max(page, 1)
    if page > deepest:
        raise ValueError(f"page {page} is deeper than {deepest}")
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def encode_cursor(values: tuple, backward: bool = False) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": list(values), "b": backward}, default=str).encode()).decode()


def decode_cursor(cursor: str) -> tuple[tuple, bool]:
    got = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    return tuple(got["v"]), got["b"]


def toggled(order: str) -> str:
    """"field asc" as "field desc" and the other way."""
    return ",".join(f"{f} {'asc' if d == 'desc' else 'desc'}" for f, d in (p.split() for p in order.split(",")))


def seeded_order(key: Column, seed: int) -> Column:
    """A repeatable shuffled order: the key xor the seed, folded to 32 bits."""
    v = key.bitwiseXOR(F.lit(seed).cast("bigint"))
    return F.shiftrightunsigned(v, 32).bitwiseXOR(v).bitwiseAND(F.lit(0xFFFFFFFF))


def two_digits(n: Column) -> Column:
    """A count rounded down to its two leading digits."""
    p = F.pow(F.lit(10.0), F.greatest(F.length(n.cast("string")) - 2, F.lit(0)))
    return (F.floor(n / p) * p).cast("bigint")
