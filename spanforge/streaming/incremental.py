"""Incremental forms of what the batch operators do: runs that arrive, texts that are new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import ranking
from spanforge.sources import files


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each configuration over a stream of run rows: state is one row a configuration."""
    return ranking.latest(runs)


def cache_new_texts(texts: DataFrame, cache_root: str, model: str, compute: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Streams texts and appends only those that the cache lacks, batch by batch; a repeated batch adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(cache_root)
        there = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
        # without a cache all texts are new; one that cannot be read fails the batch
        cache = spark.read.parquet(cache_root) if there else compute(batch.limit(0).select(F.lit("").alias("key"), "text"))
        compute(files.cache_misses(batch, cache, model)).write.mode("append").parquet(cache_root)

    return texts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def watch_runs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(root)
