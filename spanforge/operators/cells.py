"""Exact vector search that skips cells: vectors lie in cells around centroids, and a cell whose ball is too far is not read.

For unit vectors a score is 1 - d^2 / 2 of the distance d. No vector of a cell is nearer to a query than the centroid's distance less
the cell's radius, so the nearest cells of each query give a bar, and only cells whose ball reaches over it are read. Results are
those of reading everything, whatever the centroids; how much is skipped depends on how the vectors cluster.

Cells are sorted ranges in Parquet, so a cell of any size is dealt over tasks, and a search reads only the row groups of its cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanforge.operators import retrieval

#: Centroids at most (they travel with a function), cells of each query that are read before any is skipped.
MOST_CELLS, FIRST = 4096, 2
#: What rounding may take from a distance.
SPARE = 1e-6


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


@dataclass(frozen=True)
class Cells:
    """What ``write`` left in a folder, for vectors named by ``ident``."""

    spark: SparkSession
    root: str
    ident: tuple[str, ...]

    @property
    def vectors(self) -> DataFrame:
        """(cell, *ident, vector)"""
        return self.spark.read.parquet(f"{self.root}/vectors")

    @property
    def balls(self) -> DataFrame:
        """(cell, centroid, radius, n)"""
        return self.spark.read.parquet(f"{self.root}/balls")


def write(vectors: DataFrame, root: str, ident: tuple[str, ...] = ("vec_id",), count: int | None = None) -> Cells:
    """Deals unit vectors (*ident, vector) to cells around ``count`` of them, the square root of all by default, drawn by hash."""
    spark, out = vectors.sparkSession, Cells(vectors.sparkSession, root, ident)
    slim = vectors.select(*ident, F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    count = count or max(1, min(MOST_CELLS, int(slim.count() ** 0.5)))
    drawn = slim.orderBy(F.xxhash64(F.lit(7), *ident), *ident).limit(min(count, MOST_CELLS)).collect()
    centroids = np.array([row.vector for row in drawn], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch, "vector"), centroids)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns, pa.array(d[np.arange(len(cell)), cell])], ["cell", *ident, "vector", "far"])

    schema = ", ".join(["cell int", *(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields), "far double"])
    placed = slim.mapInArrow(run, schema) if drawn else slim.select(F.lit(0).cast("int").alias("cell"), "*", F.lit(0.0).alias("far"))
    placed.repartitionByRange("cell", F.xxhash64(*ident)).sortWithinPartitions("cell").write.parquet(f"{root}/vectors")
    sizes = spark.read.parquet(f"{root}/vectors").groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
    places = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(centroids)], "cell int, centroid array<double>")
    places.join(sizes, "cell").coalesce(1).write.parquet(f"{root}/balls")  # a row a cell
    return out


@dataclass
class Search:
    """Ranked rows (qid, rank, *ident, score), and the pairs of query and cell: all, and those read."""

    ranked: DataFrame
    pairs: int
    read: int
    rows: int
    rows_read: int


def search(cells: Cells, queries: DataFrame, k: int = 10, first: int = FIRST, exclude_self: bool = False) -> Search:
    """Exact cosine top-k as retrieval.nearest gives it. Queries (qid, vector) are a stated set and travel in slices."""
    spark, ident = cells.spark, list(cells.ident)
    balls = cells.balls.orderBy("cell").collect()  # a row a cell
    kind, qid_type = queries.schema["qid"].dataType.simpleString(), to_arrow_type(queries.schema["qid"].dataType)
    held = cells.vectors
    schema = ", ".join([f"qid {kind}", *(f"`{c}` {held.schema[c].dataType.simpleString()}" for c in ident), "score double"])
    found, pairs, read, rows_read = spark.createDataFrame([], schema), 0, 0, 0
    asked = queries.select("qid", F.col("vector").cast("array<double>").alias("vector"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims")).first()
    parts = max(1, -(-8 * size["n"] * max(1, size["dims"] or 1) // retrieval.QUERY_BYTES))
    total = sum(ball.n for ball in balls)

    def among(ids: list, matrix: np.ndarray, want: np.ndarray) -> DataFrame:
        """Scores of the k best of each batch and query, in the cells that ``want`` (query, cell) names."""
        numbers = np.array([ball.cell for ball in balls])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, x = batch.column("cell").to_numpy(), _matrix(batch, "vector")
                for number in np.unique(cell):
                    here, who = np.flatnonzero(cell == number), np.flatnonzero(want[:, np.searchsorted(numbers, number)])
                    if not len(who):
                        continue
                    scores = matrix[who] @ x[here].T
                    keep = min(k + exclude_self, len(here))
                    # all that tie with the last one stay, so that the final order decides
                    floor = np.partition(-scores, keep - 1, axis=1)[:, keep - 1 : keep]
                    q, c = np.nonzero(scores >= -floor - 1e-9)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[who[i]] for i in q], qid_type), *(batch.column(n).take(pa.array(here[c])) for n in ident), pa.array(scores[q, c])], ["qid", *ident, "score"])

        some = [int(n) for n, used in zip(numbers, want.any(0), strict=True) if used]
        scored = held.where(F.col("cell").isin(some)).mapInArrow(run, schema).withColumn("score", F.round("score", 9))
        return scored.where(F.col("qid") != F.col(ident[0])) if exclude_self else scored

    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part).orderBy("qid").collect()
        if not own or not balls:
            continue
        ids, matrix = [row.qid for row in own], np.array([row.vector for row in own], float)
        reach = _distances(matrix, np.array([ball.centroid for ball in balls])) - np.array([ball.radius for ball in balls])
        order = np.argsort(reach, axis=1, kind="stable")
        begun = np.zeros(reach.shape, bool)
        np.put_along_axis(begun, order[:, :first], True, 1)
        held_rows = retrieval.top(among(ids, matrix, begun), k, F.col("score").desc(), *[F.col(c) for c in ident])
        bars = {row.qid: row.score for row in held_rows.where(F.col("rank") == k).select("qid", "score").collect()}  # a row a query
        # a score s takes a distance of at most sqrt(2 - 2 s)
        widest = np.array([np.sqrt(max(0.0, 2 - 2 * bars[q])) if q in bars else np.inf for q in ids])
        want = begun | (reach <= widest[:, None] + SPARE)
        found = found.unionByName(among(ids, matrix, want))
        pairs, read = pairs + want.size, read + int(want.sum())
        rows_read += int((want * np.array([ball.n for ball in balls])).sum())
    ranked = retrieval.top(found, k, F.col("score").desc(), *[F.col(c) for c in ident]).select("qid", "rank", *ident, "score")
    return Search(ranked, pairs, read, total * size["n"], rows_read)
