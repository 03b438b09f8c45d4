"""What the operators share: the shared folder, Arrow batches in bounded slices, vectorised words and hashes, blocks.

Words are runs of characters other than the six ASCII white-space characters, which is what Arrow's
``ascii_split_whitespace`` cuts at. A null text has no words.
"""

from __future__ import annotations

import atexit
import inspect
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one block holds on average. A block is the unit that Python workers load whole.
BLOCK_BYTES = 8 << 20
#: Documents that one block holds on average at most.
BLOCK_DOCS = 30_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spanforge-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the shared folder's owner cleans up
        pass


def drop_written(df: DataFrame) -> None:
    """Deletes what ``written`` wrote, for intermediate tables that no returned plan reads."""
    if path := getattr(df, "_spanforge_path", None):
        _delete(df.sparkSession, path)


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the rows as Parquet into the shared folder and reads them back.

    A lost executor costs no recomputation of what stands before, and later jobs start from columns.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/spanforge-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._spanforge_path = path
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _trimmer():
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library: it gives memory back by itself or not at all
        return lambda _: 0


def trim() -> None:
    """Gives freed memory back to the machine: workers are reused, and what one stage held would count against the next."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


_TRIM = _trimmer()


def lean(fn: Callable) -> Callable:
    """The same function of one or two Arrow tables, giving memory back after each group."""

    def held(*tables: pa.Table) -> pa.Table:
        try:
            return fn(*tables)
        finally:
            trim()

    if len(inspect.signature(fn).parameters) == 1:
        return lambda table: held(table)
    return lambda left, right: held(left, right)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``most`` bytes of text at most, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            start = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, start + most, "right")))
            yield batch.slice(at, to - at)
            at = to
        trim()


def chunked(column) -> pa.Array:
    """One contiguous array of a column that may come in chunks."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def filled(column) -> pa.Array:
    """The texts, nulls as empty."""
    got = chunked(column)
    got = got.cast(pa.string()) if got.type != pa.string() else got
    return pc.fill_null(got, "")


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts)
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not real.all():
        rows = np.repeat(np.arange(len(counts)), counts)[real]
        flat, counts = flat.filter(pa.array(real)), np.bincount(rows, minlength=len(counts)).astype(np.int64)
    return flat, counts


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes and the dictionary."""
    got = flat.dictionary_encode()
    return got.indices.to_numpy(zero_copy_only=False), got.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (the public splitmix64 step); its constants are fixed values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, the same in every process."""
    if not len(strings):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.asarray(strings.to_pylist(), dtype=object), categorize=False)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each position on; empty if there are fewer than n."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    got = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        got = got * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j]
    return mixed(got)


def in_blocks(df: DataFrame, ident: str, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int, int]:
    """(doc_id, text, block): rows dealt to blocks of about ``block_bytes`` of text by a hash of id and text; the bytes of all
    texts; the count of blocks, which follows the input, so that a block stays small at any size.
    """
    slim = df.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    row = slim.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    n = max(1, math.ceil((row[0] or 0) / block_bytes), math.ceil(row[1] / BLOCK_DOCS))
    return slim.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), row[0] or 0, n


def messages(parts: np.ndarray, count: int, content) -> list[tuple]:
    """(part, *content(positions)) for every part that has positions."""
    order = np.argsort(parts, kind="stable")
    edges = np.searchsorted(parts[order], np.arange(count + 1))
    return [(k, *content(order[a:b])) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
