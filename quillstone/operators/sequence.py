"""Row numbering and order within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interleave(df: DataFrame, group: str, order: str) -> DataFrame:
    """Round robin over groups: cycle is the row's number in its group; sort by (cycle, group) to read in turn."""
    return df.withColumn("cycle", F.row_number().over(Window.partitionBy(group).orderBy(order)))


def entry_sequence(df: DataFrame, group: str, position: str, day: Column, number: Column) -> DataFrame:
    """Sequence numbers "YYYY-MM-DD.NNN" of entries listed in ascending or descending order.

    The order of each list is read from the first two neighbours with different
    numbers; a descending list is turned round. The index starts again with
    every run of one date, not with every date.
    """
    w = Window.partitionBy(group).orderBy(position)
    base = df.withColumn("__day", day).withColumn("__no", number.cast("int")).withColumn("__next", F.lead("__no").over(w))
    turn = base.where("__no <> __next").groupBy(group).agg(F.min_by(F.col("__no") > F.col("__next"), position).alias("__desc"))
    placed = base.join(turn, group, "left").withColumn("__pos", F.when(F.coalesce("__desc", F.lit(False)), -F.col(position)).otherwise(F.col(position)))
    v = Window.partitionBy(group).orderBy("__pos")
    runs = placed.withColumn("__new", (~F.lag("__day").over(v).eqNullSafe(F.col("__day"))).cast("int")).withColumn("__run", F.sum("__new").over(v))
    out = runs.withColumn("sequence_index", F.row_number().over(Window.partitionBy(group, "__run").orderBy("__pos")))
    return out.withColumn("sequence_number", F.format_string("%s.%03d", F.col("__day").cast("string"), "sequence_index")).drop("__day", "__no", "__next", "__desc", "__pos", "__new", "__run")


def first_gap_date(entries: DataFrame, group: str, number: str, day: str) -> DataFrame:
    """(group, start): date of the entry before the first missing number of each group.

    A group that misses number 1, or has no numbers, starts at 1960-01-01; one without gaps at its highest entry.
    """
    e = entries.where(F.col(number) > 0).groupBy(group, number).agg(F.min(day).alias("d"))
    w = Window.partitionBy(group).orderBy(number)
    gap = e.withColumn("__next", F.lead(number).over(w)).withColumn("__broken", F.col("__next").isNull() | (F.col("__next") != F.col(number) + 1))
    ends = gap.where("__broken").groupBy(group).agg(F.min_by("d", number).alias("d"))
    low = e.groupBy(group).agg(F.min(number).alias("low"))
    found = low.join(ends, group).select(group, F.when(F.col("low") > 1, F.lit("1960-01-01").cast("date")).otherwise(F.col("d").cast("date")).alias("start"))
    rest = entries.select(group).distinct().join(found, group, "left")
    return rest.select(group, F.coalesce("start", F.lit("1960-01-01").cast("date")).alias("start"))


def history(df: DataFrame, key: str, at: str, tracked: list[str]) -> DataFrame:
    """Versions of each key where a tracked column changed, with valid_from and valid_to."""
    w = Window.partitionBy(key).orderBy(at)
    state = F.struct(*tracked)
    changed = df.withColumn("__new", ~F.lag(state).over(w).eqNullSafe(state)).where("__new")
    return changed.select(key, *tracked, F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_to"))


def position_sessions(df: DataFrame, group: str, position: str, distance: int) -> DataFrame:
    """Runs of rows whose positions lie less than ``distance`` apart, as column run."""
    w = Window.partitionBy(group).orderBy(position)
    far = F.coalesce((F.col(position) - F.lag(position).over(w) >= distance).cast("int"), F.lit(0))
    return df.withColumn("__far", far).withColumn("run", F.sum("__far").over(w)).drop("__far")
