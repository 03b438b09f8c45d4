"""Search over cells gives what reading everything gives, and skips what is far."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import cells, retrieval


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + k, row.tolist()) for k, row in enumerate(x)], "vec_id long, vector array<double>").repartition(4)


def rows(df):
    return [(r.qid, r.rank, r.vec_id, round(r.score, 8)) for r in df.orderBy("qid", "rank").collect()]


@pytest.mark.parametrize("kind", ["even", "clustered", "same"])
def test_exact_whatever_the_vectors(spark, tmp_path, kind):
    rng = np.random.default_rng(0)
    middles = unit(rng.normal(size=(20, 16)))
    x = {"even": lambda: rng.normal(size=(800, 16)), "clustered": lambda: middles[rng.integers(20, size=800)] + rng.normal(0, 0.02, (800, 16)), "same": lambda: np.repeat(middles[:2], 200, 0)}[kind]()
    vectors = frame(spark, unit(x))
    queries = vectors.where("vec_id % 40 = 0").select(F.col("vec_id").alias("qid"), "vector")
    held = cells.write(vectors, f"{tmp_path}/cells")
    for exclude in (False, True):
        got = cells.search(held, queries, 5, exclude_self=exclude)
        assert rows(got.ranked) == rows(retrieval.nearest(vectors, queries, 5, exclude_self=exclude))
        assert 0 < got.read <= got.pairs and got.rows == len(x) * queries.count()
        if kind == "clustered":
            assert got.rows_read < 0.2 * got.rows
    balls = held.balls.collect()
    assert sum(b.n for b in balls) == len(x) and all(b.radius >= 0 for b in balls)


def test_slices_of_queries_and_few_vectors(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = frame(spark, unit(rng.normal(size=(60, 8))))
    queries = frame(spark, unit(rng.normal(size=(9, 8))), 100).withColumnRenamed("vec_id", "qid")
    held = cells.write(vectors, f"{tmp_path}/cells", count=7)
    want = rows(cells.search(held, queries, 100).ranked)
    assert len(want) == 9 * 60 and want == rows(retrieval.nearest(vectors, queries, 100))
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 128)
    assert rows(cells.search(held, queries, 100).ranked) == want
    assert cells.search(held, queries.limit(0), 3).ranked.collect() == []
    assert cells.search(cells.write(vectors.limit(0), f"{tmp_path}/none"), queries, 3).ranked.collect() == []


def test_a_cell_of_any_size_is_dealt(spark, tmp_path):
    """Equal vectors fill one cell, and several files hold it."""
    vectors = spark.range(4000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    held = cells.write(vectors, f"{tmp_path}/cells", count=3)
    assert held.balls.count() == 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cells.write(vectors, f"{tmp_path}/more", count=3)
        assert len(list((tmp_path / "more" / "vectors").glob("part-*.parquet"))) > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
