"""Operator 11, late-arrival partition overwrite: a daily Parquet layout of the latest row of each key, amended by late rows.

Winners are the first rows of a window over the key (Spark keeps one row a key in each task before the exchange, so a hot key
sends one row a task). Late winners replace early ones by a left-anti join, and Spark's dynamic partition overwrite rewrites the
days that they touch and no others; days that they leave empty are deleted by name.

A day is cut into files by the places of its rows: rows go through a range exchange over (day, time, key), each range counts its
rows of each day, and offsets a range and day turn places in a range into places in the day. So a day of any size is dealt over
many tasks, and only a file, which is to be whole, is one task's; a task holds its files in order, and maxRecordsPerFile cuts them.
Offsets are one row a range and day; nothing else is gathered.

Cases: a row without arrival counts as late, and loses against any row that has one. Rows without time stand on day -1, before
those with one. A null key is a key like any other. Of rows that arrived at once the one greatest in (time, then the other columns
from left to right) stays, so repeated rows change nothing; columns that cannot be ordered are not compared. Times with a zone are
taken in UTC, times without one as UTC, whatever the session's zone. An empty table gives no file. Other columns are written as
they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm import common

DAY_MICROS = 86_400_000_000
#: Bits below the range's number in the places that Spark gives out.
_PLACE_BITS = 33


def micros(df: DataFrame, name: str) -> Column:
    """Epoch microseconds of a time, in UTC."""
    time = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        since = time - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")
    return F.unix_micros(time)


def day_of(time: Column) -> Column:
    """Whole days since 1970 of epoch microseconds; -1 without a time."""
    return F.coalesce(F.call_function("div", time - F.pmod(time, F.lit(DAY_MICROS)), F.lit(DAY_MICROS)), F.lit(-1).cast("long"))


class Layout:
    """A folder day=.../part-... of Parquet files, each of ``per_file`` rows but for a day's last one."""

    def __init__(self, spark: SparkSession, path: str, columns: T.StructType, key: str, time: str, per_file: int):
        self.spark, self.path, self.key, self.time, self.per_file = spark, path, key, time, per_file
        self.columns = columns
        empty = spark.createDataFrame([], columns)
        self.day, self.place, self.nth = (common.fresh(empty, name) for name in ("day", "place", "file_no"))

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """rows with the number of their file within the day."""
        order = [self.day, self.time, self.key]
        # written, so that ranges and places are settled before counts and rows are read from them
        ranged = common.written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(self.place, F.monotonically_increasing_id()))
        part = F.shiftright(F.col(self.place), _PLACE_BITS)
        counts = ranged.groupBy(F.col(self.day).alias("d"), part.alias("p")).agg(F.min(self.place).alias("first"), F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("d").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        spans = common.written(counts.select("d", "p", "first", before.alias("before")))  # its size is known, so Spark broadcasts it only while it is small
        placed = ranged.join(spans, (F.col(self.day) == F.col("d")) & (part == F.col("p")))
        return placed.select(*(F.col(c) for c in ranged.columns if c != self.place), F.floor((F.col("before") + F.col(self.place) - F.col("first")) / self.per_file).cast("long").alias(self.nth))

    def write(self, rows: DataFrame) -> None:
        """Writes whole days: those of rows (with a column ``self.day``) replace what stands there, other days stay untouched."""
        dealt = self._numbered(rows).repartition(self.day, self.nth).sortWithinPartitions(self.day, self.nth, self.time, self.key)
        out = dealt.select(*(F.col(c) for c in self.columns.names), F.col(self.day))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", self.per_file).partitionBy(self.day).parquet(self.path)

    def drop_days(self, days: list[int]) -> None:
        """Deletes the folders of days that have no rows left."""
        for day in days:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.day}={day}")
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def found_columns(self) -> list[str]:
        """The columns of all files together, from their footers."""
        return [c for c in self.spark.read.option("mergeSchema", True).parquet(self.path).columns if c != self.day]

    def exists(self) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def rows(self) -> DataFrame:
        """What the files hold, read back with Spark's reader: the columns and the day."""
        return self.spark.read.schema(T.StructType([*self.columns.fields, T.StructField(self.day, T.LongType())])).parquet(self.path)

    def paths(self) -> DataFrame:
        """(path): one row a file."""
        return self.rows().select(F.col("_metadata.file_path").alias("path")).distinct()


def latest(rows: DataFrame, key: str, time: str, arrived: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The latest-arrived row of each key, and of each value of ``by``."""
    others = [f.name for f in rows.schema.fields if f.name not in (key, time, arrived, *by) and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order = [F.col(c).desc_nulls_last() for c in (arrived, time, *others)]
    nth = common.fresh(rows, "nth")
    return rows.withColumn(nth, F.row_number().over(Window.partitionBy(key, *by).orderBy(*order))).where(F.col(nth) == 1).drop(nth)


def digests(layout: Layout, value: str, arrived: str) -> DataFrame:
    """(path, day, n_rows, cents, rows_crc, ids_sha256, first_time, first_key) of every file, read back.

    A file's rows go to one task in the file's order and pass through it as a stream.
    """
    rows = layout.rows()
    t, a, key = micros(rows, layout.time), micros(rows, arrived), F.col(layout.key).cast("string")
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    slim = rows.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), F.col(layout.day).alias("day"), F.coalesce(key, F.lit("")).alias("id"), t.alias("time"),
        F.coalesce(F.floor(100 * F.col(value) + 0.5), F.lit(0)).cast("long").alias("cents"), F.crc32(F.concat_ws(":", text(key), text(t), text(a)).cast("binary")).alias("crc"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # of the file that is passing: path, day, rows, cents, crc, digest, first time and id

        def ended() -> pa.RecordBatch:
            names = ["path", "day", "n_rows", "cents", "rows_crc", "ids_sha256", "first_time", "first_key"]
            values = [*held[:5], held[5].hexdigest(), *held[6:]]
            kinds = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            paths = batch.column("path").dictionary_encode()
            codes = paths.indices.to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi == lo:
                    continue
                part, path = batch.slice(lo, hi - lo), paths.dictionary[codes[lo]].as_py()
                if held is None or held[0] != path:
                    if held is not None:
                        yield ended()
                    held = [path, part.column("day")[0].as_py(), 0, 0, 0, hashlib.sha256(), part.column("time")[0].as_py(), part.column("id")[0].as_py()]
                ids = ",".join(part.column("id").to_pylist())
                held[5].update((ids if not held[2] else "," + ids).encode())
                held[2] += part.num_rows
                held[3] += pc.sum(part.column("cents")).as_py()
                held[4] += pc.sum(part.column("crc")).as_py()
        if held is not None:
            yield ended()

    dealt = slim.repartition("path").sortWithinPartitions("path", "at")
    return dealt.mapInArrow(run, "path string, day long, n_rows long, cents long, rows_crc long, ids_sha256 string, first_time long, first_key string")


def amended_layout(df: DataFrame, cut: str, per_file: int, path: str | None = None, key: str = "sale_id", time: str = "sold_at", arrived: str = "arrived_at") -> tuple[Layout, DataFrame]:
    """Writes the layout of the rows that arrived before ``cut`` (a time in UTC), then makes it the layout of all rows.

    Returns the layout and (path) of its starting files. ``path`` is a new folder in the shared one, where it stays.
    """
    spark = df.sparkSession
    layout = Layout(spark, path or f"{common.shared_dir(spark)}/late-{uuid.uuid4().hex}", df.schema, key, time, per_file)
    late, day, other, left = (common.fresh(df, name) for name in ("late", "day", "other_key", "other_day"))
    before = int(np.datetime64(cut, "us").astype(np.int64))
    rows = df.withColumn(late, F.coalesce(micros(df, arrived) >= before, F.lit(True))).withColumn(day, day_of(micros(df, time)))
    winners = common.written(latest(rows, key, time, arrived, (late,)))
    first, second = (winners.where(F.col(late) == x).drop(late) for x in (False, True))
    if first.isEmpty():
        start = spark.createDataFrame([], "path string")
    else:
        layout.write(first)
        start = common.written(layout.paths())

    def matched(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
        return rows.join(others.select(F.col(key).alias(other), F.col(day).alias(left)), F.col(key).eqNullSafe(F.col(other)), how)

    undated = matched(second.where(F.col(arrived).isNull()), first, "left_anti")  # any arrival is later than none
    arriving = common.written(second.where(F.col(arrived).isNotNull()).unionByName(undated))
    touched = common.written(arriving.select(F.col(day).alias(left)).union(matched(arriving, first, "inner").select(left)).distinct())
    staying = matched(first, arriving, "left_anti").join(touched, F.col(day) == F.col(left), "left_semi")
    after = common.written(staying.unionByName(arriving))
    if not after.isEmpty():
        layout.write(after)
    empty = touched.join(after.select(day).distinct(), F.col(left) == F.col(day), "left_anti")
    layout.drop_days([row[0] for row in empty.collect()])
    for table in (winners, arriving, touched, after):
        common.drop_written(table)
    return layout, start


def files(layout: Layout, start: DataFrame, value: str = "total", arrived: str = "arrived_at") -> DataFrame:
    """One row a file of the layout: day, file_no, n_rows, cents, rows_crc, path, columns, ids_sha256, rewritten."""
    if not layout.exists():
        return layout.spark.createDataFrame([], "day long, file_no long, n_rows long, cents long, rows_crc long, path string, columns string, ids_sha256 string, rewritten boolean")
    names = ",".join(layout.found_columns())
    found = digests(layout, value, arrived)
    nth = F.row_number().over(Window.partitionBy("day").orderBy("first_time", F.col("first_key").try_cast(layout.columns[layout.key].dataType), "path"))
    old = start.select(F.col("path").alias("old"))
    marked = found.join(old, F.col("path") == F.col("old"), "left")
    return marked.select("day", (nth - 1).cast("long").alias("file_no"), "n_rows", "cents", "rows_crc", "path", F.lit(names).alias("columns"), "ids_sha256", F.col("old").isNull().alias("rewritten"))
