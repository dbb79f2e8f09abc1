"""Exactly one copy of messages that were delivered more than once.

Three steps, none of which shuffles a payload column:

1. a narrow scan reads identifier and delivery order only, with the position
   of each row (file, row index) as Parquet readers report it; a partially
   aggregated minimum picks the winner of every identifier, so an identifier
   that holds a third of all rows is reduced before the shuffle;
2. the positions of the keyed rows that did not win become deletion vectors:
   one 4 KB bitmap for each 32,768 rows of a file, made by the JVM's bitmap
   aggregates;
3. the wide scan drops rows whose bit is set. The vectors take one bit a row;
   within a checked size they are broadcast, beyond it every task reads the
   vectors of its own file from the shared folder. Payloads are never moved.

Defined results. A NULL or blank identifier (after trimming) never has surplus
copies. NULL timestamps count as last, ties go to the smallest tie-breaker. An
empty table gives an empty table. Columns of the input that share a name with
the operator's own work columns are carried untouched.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.session import BROADCAST_BYTES, materialise

_F, _P, _B, _V = "__qs_file", "__qs_row", "__qs_bucket", "__qs_bits"
_BUCKET_ROWS = 32768
_BUCKET_BYTES = _BUCKET_ROWS // 8


def message_key(col: Column) -> Column:
    """Identifier without surrounding white space and angle brackets, lower case; NULL if nothing is left."""
    bare = F.regexp_replace(col, r"^[\s\p{Z}<>]+|[\s\p{Z}<>]+$", "")
    return F.when(F.length(bare) > 0, F.lower(bare))


class RedeliveryFilter:
    """Winners and deletion vectors of one Parquet table.

    ``key`` turns the id column into the compared identifier; ``order`` and
    ``tie`` name the columns that choose the kept row.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str, order: str, tie: str, key=message_key):
        self.spark, self.path = spark, path
        self.id_col, self.order, self.tie, self.key = id_col, order, tie, key
        self._vectors: DataFrame | None = None

    def _positions(self, *cols: Column) -> DataFrame:
        """A scan of the given columns with each row's file and row index."""
        return self.spark.read.parquet(self.path).select(
            *cols, F.col("_metadata.file_path").alias(_F), F.col("_metadata.row_index").alias(_P)
        )

    def vectors(self) -> DataFrame:
        """Deletion vectors: (file, bucket, bits), a set bit for each surplus row."""
        if self._vectors is not None:
            return self._vectors
        narrow = self._positions(
            self.key(F.col(self.id_col)).alias("k"), F.col(self.order).alias("o"), F.col(self.tie).alias("t")
        ).where(F.col("k").isNotNull())
        best = narrow.groupBy("k").agg(
            F.min(F.struct(F.col("o").isNull().alias("n"), "o", F.col("t").isNull().alias("m"), "t", _F, _P)).alias("w")
        )
        spot = F.col(_P) + 1  # the bitmap functions count from 1
        bitmap = F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")
        bucket = F.bitmap_bucket_number(spot).alias(_B)
        keyed = narrow.groupBy(_F, bucket).agg(bitmap)
        won = best.select(f"w.{_F}", f"w.{_P}").groupBy(_F, bucket).agg(bitmap)
        both = keyed.alias("a").join(won.withColumnRenamed("bits", "won"), [_F, _B], "left")

        def minus(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                bits = [
                    (np.frombuffer(x, np.uint8) & ~np.frombuffer(y, np.uint8) if y is not None else np.frombuffer(x, np.uint8))
                    for x, y in zip(b["bits"], b["won"])
                ]
                keep = [bool(x.any()) for x in bits]
                out = b.loc[keep, [_F, _B]].copy()
                out[_V] = [x.tobytes() for x, k in zip(bits, keep) if k]
                yield out

        vectors = both.mapInPandas(minus, f"{_F} string, {_B} bigint, {_V} binary")
        self._vectors = materialise(vectors, "deletion-vectors")
        return self._vectors

    def _apply(self, cols: Sequence[str] | None, surplus: bool) -> DataFrame:
        vectors = self.vectors()
        wide = self.spark.read.parquet(self.path)
        names = list(cols) if cols is not None else wide.columns
        rows = self._positions(*[F.col(f"`{c}`") for c in names])
        if vectors.count() * _BUCKET_BYTES <= BROADCAST_BYTES:
            spot = F.col(_P) + 1
            hit = rows.withColumn(_B, F.bitmap_bucket_number(spot)).join(F.broadcast(vectors), [_F, _B], "left")
            byte = f"cast(conv(hex(substring({_V}, cast(bitmap_bit_position({_P} + 1) div 8 as int) + 1, 1)), 16, 10) as int)"
            bit = F.expr(f"shiftright({byte}, cast(bitmap_bit_position({_P} + 1) % 8 as int))").bitwiseAND(F.lit(1))
            is_set = F.coalesce(bit == 1, F.lit(False))
            return hit.where(is_set if surplus else ~is_set).select(*[F.col(f"`{c}`") for c in names])
        return self._by_file(rows, vectors, names, surplus)

    def _by_file(self, rows: DataFrame, vectors: DataFrame, names: list[str], surplus: bool) -> DataFrame:
        """As ``_apply``, with each task reading only the vectors of the files it scans."""
        from quillstone.session import scratch_path

        folder = scratch_path(self.spark, "deletion-vectors-by-file")
        slots = 4096
        slot = F.pmod(F.xxhash64(_F), F.lit(slots)).alias("slot")
        (vectors.select("*", slot).repartition("slot").write.partitionBy("slot").parquet(folder))
        schema = rows.select(*[F.col(f"`{c}`") for c in names]).schema

        def mask(batches):
            import pyarrow as pa
            import pyarrow.dataset as ds
            from pyarrow import fs

            if "://" in folder or folder.startswith("file:"):
                system, base = fs.FileSystem.from_uri(folder)
            else:
                system, base = fs.LocalFileSystem(), folder
            held: dict[str, dict[int, np.ndarray]] = {}

            def bits_of(file: str, slot: int) -> dict[int, np.ndarray]:
                if file not in held:
                    held.clear()  # a task goes through its files one after another
                    where = f"{base}/slot={slot}"
                    if system.get_file_info(where).type == fs.FileType.NotFound:
                        held[file] = {}
                    else:
                        t = ds.dataset(where, filesystem=system, format="parquet").to_table(filter=ds.field(_F) == file)
                        held[file] = {b: np.frombuffer(v, np.uint8) for b, v in zip(t[_B].to_pylist(), t[_V].to_pylist())}
                return held[file]

            for batch in batches:
                files = batch.column(_F).to_pylist()
                slot_of = batch.column("slot").to_pylist()
                row = batch.column(_P).to_numpy()
                hit = np.zeros(len(row), bool)
                for file in dict.fromkeys(files):
                    at = np.flatnonzero(np.array([f == file for f in files]))
                    bits = bits_of(file, slot_of[at[0]])
                    for bucket in np.unique(row[at] // _BUCKET_ROWS):
                        if (v := bits.get(int(bucket) + 1)) is not None:
                            mine = at[row[at] // _BUCKET_ROWS == bucket]
                            p = row[mine] % _BUCKET_ROWS
                            hit[mine] = (v[p // 8] >> (p % 8).astype(np.uint8)) & 1
                keep = hit if surplus else ~hit
                yield batch.select(names).filter(pa.array(keep))

        return rows.select("*", slot).mapInArrow(mask, schema)

    def kept(self, cols: Sequence[str] | None = None) -> DataFrame:
        """The table with exactly one row of each message (rows without an id all stay)."""
        return self._apply(cols, surplus=False)

    def surplus(self, cols: Sequence[str] | None = None) -> DataFrame:
        """The rows that ``kept`` leaves out."""
        return self._apply(cols, surplus=True)
