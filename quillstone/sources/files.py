"""File sources and sinks: CSV, tab-separated, JSON, JSON lines, XML, text, manifests.

Schemas are always given, never inferred.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: str | StructType, sep: str = ",", skip_bad: bool = True) -> DataFrame:
    """A CSV with header; malformed lines are dropped, or raise."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True, quote='"', escape="\\" if sep == "," else '"', multiLine=sep == ",", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, mode="DROPMALFORMED" if skip_bad else "FAILFAST")


def read_statistics(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Tab-separated court statistics: values trimmed, NUL characters dropped, blanks and the filler -8 as NULL."""
    raw = spark.read.csv(path, schema=", ".join(f"`{c}` string" for c in columns), sep="\t", header=True, quote="")
    clean = lambda c: F.nullif(F.nullif(F.trim(F.regexp_replace(c, "\\x00", "")), F.lit("")), F.lit("-8"))
    return raw.select(*[clean(F.col(f"`{c}`")).alias(c) for c in columns])


def as_int(c: Column) -> Column:
    """A whole number; NULL if it is none."""
    return c.try_cast("int")


def as_us_date(c: Column) -> Column:
    """A date given as month/day/year; NULL if it is none."""
    return F.try_to_timestamp(c, F.lit("M/d/yyyy")).cast("date")


def as_flag(c: Column) -> Column:
    """1, y, yes, t and true as true; 0, n, no, f and false as false; anything else NULL."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("1", "y", "yes", "t", "true"), True).when(low.isin("0", "n", "no", "f", "false"), False)


def read_cases(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One JSON case a file, by a glob such as reporter/volume/*.json, with the file's path."""
    return spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("path", F.col("_metadata.file_path"))


def embedded_xml(c: Column, **fields: str) -> list[Column]:
    """Text of XML elements inside a string column, by XPath; NULL where the XML is broken."""
    safe = F.when(c.rlike(r"^\s*<"), c)
    return [F.xpath_string(safe, F.lit(path)).alias(name) for name, path in fields.items()]


def write_quoted_csv(df: DataFrame, path: str, parts: int | None = None) -> None:
    """CSV with header, every value quoted, backslash as escape; white space around values stays."""
    out = df.repartition(parts) if parts else df
    out.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape="\\", nullValue=None, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_manifest(df: DataFrame, key: str, bucket: str, path: str, batch: int) -> None:
    """A manifest of object keys in files of about ``batch`` lines each."""
    lines = df.select(F.concat_ws(",", F.lit(bucket), F.col(key).cast("string")).alias("value"))
    lines.write.mode("overwrite").option("maxRecordsPerFile", batch).text(path)


def write_by_month(df: DataFrame, day: str, path: str) -> None:
    """Parquet in folders by year and month, one shuffle by both."""
    out = df.withColumn("year", F.year(day)).withColumn("month", F.month(day))
    out.repartition("year", "month").write.mode("overwrite").partitionBy("year", "month").parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by a key, so joins on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def flattened(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Child rows with the parent's columns; where names clash the parent's value stands."""
    mine = [c for c in child.columns if c not in parent.columns or c == on]
    return child.select(*mine).join(parent, on)


def write_feed(df: DataFrame, title: str, link: str, at: str, newest: int = 20) -> str:
    """An Atom feed of the newest rows; rows without a date are left out. The rows are at most ``newest``."""
    from xml.sax.saxutils import escape

    rows = df.where(F.col(at).isNotNull()).orderBy(F.col(at).desc()).limit(newest).collect()
    entries = "".join(f"<entry><title>{escape(str(r[title]))}</title><link href=\"{escape(str(r[link]))}\"/><updated>{r[at]}</updated></entry>" for r in rows)
    return f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">{entries}</feed>'
