"""Text and record similarity on candidate pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching share of two texts, the larger of both directions; NULL counts as empty."""
    out = []
    for x, y in zip(a, b):
        x, y = x or "", y or ""
        out.append(1.0 if x == y else max(SequenceMatcher(None, x, y, False).ratio(), SequenceMatcher(None, y, x, False).ratio()))
    return pd.Series(out)


def strictness(ratio: Column) -> Column:
    """'strict' from 0.9 on, 'loose' above 0.7, else 'different'."""
    return F.when(ratio >= 0.9, "strict").when(ratio > 0.7, "loose").otherwise("different")


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


@F.pandas_udf(DoubleType())
def overlap_percent(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of the shorter text, in percent, that stands in the longer in blocks of more than five characters."""
    out = []
    for x, y in zip(a, b):
        x, y = sorted((x or "", y or ""), key=len)
        blocks = SequenceMatcher(None, x, y, False).get_matching_blocks() if x else []
        out.append(100.0 * sum(m.size for m in blocks if m.size > 5) / len(x) if x else 0.0)
    return pd.Series(out)


def longer(a: Column, b: Column) -> Column:
    """The longer of two strings; the first where they are as long."""
    return F.when(F.length(F.coalesce(b, F.lit(""))) > F.length(F.coalesce(a, F.lit(""))), b).otherwise(a)


def merged_case_names(short: Column, full: Column, other_short: Column, other_full: Column) -> Column:
    """struct(short, full): the longest of each, changed over where the short name turned out longer."""
    s, f = longer(short, other_short), longer(full, other_full)
    swap = F.length(F.coalesce(s, F.lit(""))) > F.length(F.coalesce(f, F.lit("")))
    return F.struct(F.when(swap, f).otherwise(s).alias("short"), F.when(swap, s).otherwise(f).alias("full"))


def transcript_suspect(seconds: Column, text: Column) -> Column:
    """Whether a transcript of 500 seconds or more has half the expected distinct words or fewer."""
    distinct = F.size(F.array_distinct(F.split(F.lower(text), r"\s+")))
    return (seconds >= 500) & (distinct <= 0.5 * (376 + 0.435 * seconds))


def token_batches(df, key: str, tokens: str, budget: int, least: int, group: str):
    """(group, batch, key): greedy batches in key order whose token sums stay within the budget; items outside [least, budget] are skipped.

    Batches restart with each group, which bounds what one task holds.
    """

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key)
        part = part[(part[tokens] >= least) & (part[tokens] <= budget)]
        batch, total, out = 1, 0, []
        for n in part[tokens]:
            if total + n > budget:
                batch, total = batch + 1, 0
            total += n
            out.append(batch)
        return pd.DataFrame({group: part[group], "batch": out, key: part[key]})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(group, key, tokens).groupBy(group).applyInPandas(fill, f"{group} {kinds[group]}, batch int, {key} {kinds[key]}")
