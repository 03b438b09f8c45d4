"""Session helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per application, so that Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        handle, name = tempfile.mkstemp(prefix="spanforge-", suffix=".zip")
        with os.fdopen(handle, "wb") as file, zipfile.ZipFile(file, "w") as out:
            for path in sorted(top.rglob("*.py")):
                out.write(path, path.relative_to(top.parent))
        spark.sparkContext.addPyFile(name)
        _shipped.add(app)
    return spark


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    settings = {
        "spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").config(map=settings | conf)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only on a local master without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = _own_dirs.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='spanforge-')}"
        _own_dirs[spark.sparkContext.applicationId] = found
    return found


_own_dirs: dict[str, str] = {}


def settled(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The rows, written to the shared folder and read back: computed once, with a known size, whoever reads them."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def written_once(df: DataFrame) -> Iterator[DataFrame]:
    """The rows, written to the shared folder for as long as the block runs: what is made of them inside has to be settled there."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(schema).parquet(path)
    finally:
        _drop(spark, path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the shared folder's owner cleans up
        pass
