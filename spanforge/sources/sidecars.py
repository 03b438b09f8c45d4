"""Results saved beside a run, configuration by configuration, so that a stopped run goes on where it stood.

A sidecar is a folder with ``data/attempt=...``, the rows of one configuration each, and ``log``, to which one small file is added
after the data of an attempt stand. What the log does not name does not exist: rows of an attempt that was cut short are never read.
An entry serves only the question file, and as many questions, as it was made for, so a changed file begins anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG_SCHEMA = "config_id string, attempt string, qa_file string, n_questions long, n_rows long, error string, ended string"


def valid(log: DataFrame, qa_file: str, n_questions: int) -> DataFrame:
    """The last entry of each configuration among those made for this question file and so many questions."""
    own = log.where((F.col("qa_file") == qa_file) & (F.col("n_questions") == n_questions))
    nth = F.row_number().over(Window.partitionBy("config_id").orderBy(F.col("ended").desc(), F.col("attempt").desc()))
    return own.withColumn("nth", nth).where("nth = 1").drop("nth")


def left(configs: DataFrame, log: DataFrame, qa_file: str, n_questions: int) -> DataFrame:
    """Configurations that a run still has to measure: those without a valid entry, and those whose last one failed."""
    return configs.join(valid(log, qa_file, n_questions).where("error IS NULL").select("config_id"), "config_id", "left_anti")


class Sidecar:
    """One sidecar folder for one question file. A folder may hold entries for several; each Sidecar sees its own."""

    def __init__(self, spark: SparkSession, root: str, qa_file: str, n_questions: int, schema: str):
        self.spark, self.root, self.qa_file, self.n_questions, self.schema = spark, root.rstrip("/"), qa_file, n_questions, schema

    def _there(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def log(self) -> DataFrame:
        path = f"{self.root}/log"
        return self.spark.read.schema(LOG_SCHEMA).json(path) if self._there(path) else self.spark.createDataFrame([], LOG_SCHEMA)

    def commit(self, config_id: str, attempt: str, n_rows: int, error: str | None = None) -> None:
        """Adds an entry; entries are never changed."""
        ended = datetime.now(timezone.utc).isoformat(timespec="microseconds")
        entry = self.spark.createDataFrame([(config_id, attempt, self.qa_file, self.n_questions, n_rows, error, ended)], LOG_SCHEMA)
        entry.coalesce(1).write.mode("append").json(f"{self.root}/log")

    def save(self, config_id: str, rows: DataFrame) -> int:
        """Writes the rows of a configuration, then its entry."""
        attempt = uuid.uuid4().hex
        path = f"{self.root}/data/attempt={attempt}"
        rows.write.parquet(path)
        n = self.spark.read.schema(self.schema).parquet(path).count()
        self.commit(config_id, attempt, n)
        return n

    def done(self) -> list[str]:
        return sorted(row[0] for row in valid(self.log(), self.qa_file, self.n_questions).where("error IS NULL").select("config_id").collect())

    def rows(self) -> DataFrame:
        """config_id and the rows of all valid attempts; Spark reads the folders of these only."""
        entries = valid(self.log(), self.qa_file, self.n_questions).where("error IS NULL").select("config_id", "attempt")
        if not self._there(f"{self.root}/data"):
            return self.spark.createDataFrame([], f"config_id string, {self.schema}")
        data = self.spark.read.schema(f"{self.schema}, attempt string").parquet(f"{self.root}/data")
        return data.join(F.broadcast(entries), "attempt").select("config_id", *(c for c in data.columns if c != "attempt"))  # an entry a configuration

    def failures(self) -> DataFrame:
        """(config_id, error) of configurations whose last attempt failed."""
        return valid(self.log(), self.qa_file, self.n_questions).where("error IS NOT NULL").select("config_id", "error")

    def run(self, config_ids: Iterable[str], measure: Callable[[str], DataFrame]) -> tuple[list[str], list[str]]:
        """Measures what is left, in order: (configurations measured now, those that failed). A failure is noted and the rest goes on."""
        finished, now, failed = set(self.done()), [], []
        for config_id in config_ids:
            if config_id in finished:
                continue
            try:
                self.save(config_id, measure(config_id))
                now.append(config_id)
            except Exception as error:  # whatever fails costs this configuration only; KeyboardInterrupt and the like go through
                self.commit(config_id, uuid.uuid4().hex, 0, f"{type(error).__name__}: {str(error)[:300]}")
                failed.append(config_id)
        return now, failed

    def report(self, path: str, **about: str) -> None:
        """One JSON document: what was measured, on what, the rows of each configuration, and failures."""
        own = self.rows()
        names = [c for c in own.columns if c != "config_id"]
        per = own.groupBy("config_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("rows"))  # a summary row or a few a configuration
        whole = per.agg(F.sort_array(F.collect_list(F.struct("config_id", "rows"))).alias("configs"))
        bad = self.failures().agg(F.sort_array(F.collect_list(F.struct("config_id", "error"))).alias("failed"))
        head = [F.lit(value).alias(name) for name, value in {"qa_file": self.qa_file, "n_questions": self.n_questions, **about}.items()]
        whole.crossJoin(bad).select(*head, "configs", "failed").write.mode("overwrite").json(path)


def spread_picks(candidates: DataFrame, score: str, count: int) -> list[str]:
    """Configurations spread evenly over the range of a score, best and worst among them: a few dozen candidates are ordered."""
    ordered = [row[0] for row in candidates.orderBy(F.col(score).desc_nulls_last(), "config_id").select("config_id").collect()]
    n = min(count, len(ordered))
    return [ordered[round(k * (len(ordered) - 1) / max(n - 1, 1))] for k in range(n)]
