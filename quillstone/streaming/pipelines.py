"""Streams of records: first-seen claims, tallies, windowed digests, alert hits with a seen set.

Each function takes and returns a streaming DataFrame (all also accept a batch
one where no state is kept), so sources and sinks stay the caller's choice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstone.session import scratch_path


def open_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A stream over the Parquet files of a folder, or of one file, with the schema of those there."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        return reader.option("pathGlobFilter", hadoop.getName()).parquet(str(hadoop.getParent()))
    return reader.parquet(path)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and read its result from the shared folder (complete mode goes through memory)."""
    spark = stream.sparkSession
    state = scratch_path(spark, f"{name}-state")
    if mode == "append":
        out = scratch_path(spark, name)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    out = scratch_path(spark, name)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def claimed_once(stream: DataFrame, key: list[str], at: str, expiry: str = "2 days") -> DataFrame:
    """The first record of each key; a key may be claimed again once it has expired."""
    return stream.withWatermark(at, expiry).dropDuplicatesWithinWatermark(key)


def item_hash(*cols: str) -> F.Column:
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def tally(stream: DataFrame, at: str, labels: list[str]) -> DataFrame:
    """Counts by day and labels."""
    return stream.groupBy(F.to_date(at).alias("day"), *labels).agg(F.count("*").alias("n"))


def digests(stream: DataFrame, at: str, key: str, width: str, lateness: str = "1 day") -> DataFrame:
    """Hits of each key by window, once the window has closed; later records are dropped."""
    return stream.withWatermark(at, lateness).groupBy(F.window(at, width), key).agg(F.count("*").alias("hits")).select(F.col("window.start").alias("start"), key, "hits")


def within(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, span: str) -> DataFrame:
    """Pairs of one key whose right record follows within ``span`` (stream-stream join with bounded state)."""
    l = left.withWatermark(left_at, span).alias("l")
    r = right.withWatermark(right_at, span).alias("r")
    return l.join(r, F.expr(f"l.{key} = r.{key} AND r.{right_at} >= l.{left_at} AND r.{right_at} <= l.{left_at} + INTERVAL {span}"))


def alert_hits(stream: DataFrame, alert: str, document: str, at: str, ttl_days: int = 30, most: int | None = None) -> DataFrame:
    """Hits that an alert has not had before, at most ``most`` for each alert between expiries of its seen set.

    The set expires, in event time, ``ttl_days`` after the alert's latest hit.
    """
    out = f"{alert} bigint, {document} bigint, {at} timestamp"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, latest = (set(state.get[0]), state.get[1]) if state.exists else (set(), 0)
        for part in parts:
            fresh = part[~part[document].isin(seen)].drop_duplicates(document)
            if most is not None:
                fresh = fresh.head(max(0, most - len(seen)))
            seen.update(fresh[document].tolist())
            if len(part):
                latest = max(latest, int(part[at].max().timestamp() * 1000))
            yield fresh[[alert, document, at]]
        state.update((sorted(seen), latest))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + ttl_days * 86_400_000)

    return stream.select(alert, document, at).withWatermark(at, "1 day").groupBy(alert).applyInPandasWithState(step, out, "seen array<bigint>, latest bigint", "append", GroupStateTimeout.EventTimeTimeout)


def upsert(stream: DataFrame, path: str, key: list[str], at: str, checkpoint: str):
    """Keep the newest record of each key in a table, batch by batch; a repeated batch changes nothing."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        newest = lambda df: df.groupBy(*key).agg(F.max(F.struct(at, *[c for c in df.columns if c not in (*key, at)])).alias("v")).select(*key, "v.*")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        have = batch
        if fs.exists(hadoop):
            versions = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(hadoop))
            have = spark.read.parquet(f"{path}/v{max(v for v in versions if v < number)}").unionByName(batch) if any(v < number for v in versions) else batch
        newest(have).write.mode("overwrite").parquet(f"{path}/v{number}")
        # The version read stays, in case this batch is repeated; older ones go.
        older = [v for v in versions if v < number] if fs.exists(hadoop) and have is not batch else []
        for v in older[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}"), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def route(stream: DataFrame, checkpoint: str, **sinks: Callable[[DataFrame], None]):
    """Send every micro-batch to several sinks."""

    def send(batch: DataFrame, _: int) -> None:
        batch.persist()
        for f in sinks.values():
            f(batch)
        batch.unpersist()

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
