"""Operator 12, centroid clustering: exact rounds of assignment and mean over integer vectors, by partial-distance search.

A distance is summed over the dimensions of the highest variance first, a stripe at a time; a centroid is abandoned for a vector
once its part is strictly above the vector's best distance so far, and only what survives reads all dimensions. Nothing but whole
numbers is added, so results do not depend on how rows are dealt. A task sends one row a cluster; the driver holds the centroids.

Cases: a vector counts only if it has exactly ``length`` components, none null, not a number, infinite, or beyond ``LARGEST`` in
size (so that squared distances fit into 64 bits); others are left out. Rows that repeat an id, or a vector, are rows of their own.
A null id is kept, but its vector is a first centroid only where there are too few others. With fewer vectors than centroids there
are as many centroids as vectors; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import common

#: A component x becomes floor(SCALE * x).
SCALE = 1024
#: Largest size of a component that counts: SCALE * LARGEST is 2^27, and 64 squared differences of such numbers are 2^62 at most.
LARGEST = 131072.0
#: Dimensions that are added before parts are compared again.
STRIPE = 8
#: Parts of distances that are held at once.
HELD = 1 << 20


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each row's nearest centroid (the smaller number of two), and how many squares were added.

    ``order`` has the dimensions in the order in which they are read.
    """
    n, (k, d) = len(x), centroids.shape
    cluster, best, read = np.zeros(n, np.int32), np.zeros(n, np.int64), 0
    c = np.ascontiguousarray(centroids[:, order])
    for at in range(0, n, rows := max(1, HELD // (k * STRIPE))):
        own = np.ascontiguousarray(x[at : at + rows][:, order]).astype(np.int64)
        found = _searched(own, c)
        cluster[at : at + rows], best[at : at + rows] = found[:2]
        read += found[2]
    return cluster, best, read


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    step = a - b
    return np.einsum("...i,...i->...", step, step)


def _searched(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    (n, d), k = x.shape, len(c)
    first = _squares(x[:, None, :STRIPE], c[None, :, :STRIPE])
    cluster = first.argmin(1).astype(np.int32)  # the likeliest is read whole before any other
    lead, read = cluster.copy(), first.size * min(STRIPE, d) + n * max(0, d - STRIPE)
    best = first[np.arange(n), lead] + _squares(x[:, STRIPE:], c[lead, STRIPE:])
    for j in range(k):
        alive = np.flatnonzero((first[:, j] <= best) & (lead != j))
        part = first[alive, j]
        for at in range(STRIPE, d, STRIPE):
            if not len(alive):
                break
            part = part + _squares(x[alive, at : at + STRIPE], c[j, at : at + STRIPE])
            read += len(alive) * min(STRIPE, d - at)
            on = part <= best[alive]
            alive, part = alive[on], part[on]
        nearer = (part < best[alive]) | (j < cluster[alive])
        best[alive[nearer]], cluster[alive[nearer]] = part[nearer], j
    return cluster, best, read


def _matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def whole_vectors(df: DataFrame, ident: str, vector: str, length: int) -> DataFrame:
    """(id, v): the vectors that count, as whole numbers."""
    v = F.col(vector)
    usable = (F.size(v) == length) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    return df.where(v.isNotNull() & usable).select(F.col(ident).alias("vec_id"), F.transform(v, lambda x: F.floor(SCALE * x.cast("double")).cast("int")).alias("v"))


def _order(kept: DataFrame, length: int) -> np.ndarray:
    """Dimensions by falling variance. Sums of floats serve: the order changes the work, never the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(length), np.zeros(length)
        for batch in batches:
            x = _matrix(batch, length).astype(np.float64)
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [s.tolist()], "q": [q.tolist()]})

    parts = kept.mapInArrow(run, "n long, s array<double>, q array<double>").select("n", F.posexplode(F.arrays_zip("s", "q")).alias("i", "x"))
    spread = {row.i: row.q / row.n - (row.s / row.n) ** 2 for row in parts.groupBy("i").agg(*(F.sum(x).alias(x[-1]) for x in ("n", "x.s", "x.q"))).collect()}  # a row a dimension
    return np.array(sorted(spread, key=lambda i: (-spread[i], i)))


def _means(kept: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids of the next round: each cluster's floored means, exactly; empty clusters keep theirs."""
    k, length = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, np.int64), np.zeros((k, length), np.int64)
        for batch in batches:
            x = _matrix(batch, length)
            cluster = nearest(x, centroids, order)[0]
            n += np.bincount(cluster, minlength=k)
            for j in np.unique(cluster):
                s[j] += x[cluster == j].sum(0, dtype=np.int64)
        if n.any():
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(held, pa.int32()), "n": n[held], "s": pa.array(s[held].tolist(), pa.list_(pa.int64()))})

    parts = kept.mapInArrow(run, "cluster int, n long, s array<long>")
    cells = parts.select("cluster", "n", F.posexplode("s").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    out = centroids.copy()
    for row in cells.collect():  # a row a cluster and dimension
        out[row.cluster, row.i] = int(row.s) // row.n
    return out


def cluster_vectors(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", length: int = 64, count: int = 8, rounds: int = 10, salt: str = "3:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that counts.

    The first centroids are the ``count`` vectors whose salted ids have the least SHA-256; after ``rounds`` rounds of assignment and
    mean, vectors are assigned once more.
    """
    kept = common.written(whole_vectors(df, ident, vector, length))
    mark = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    firsts = kept.orderBy(mark.asc_nulls_last(), "v").limit(count).collect()
    kind = kept.schema["vec_id"].dataType.simpleString()
    if not firsts:
        return kept.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids, order = np.array([row.v for row in firsts], np.int64), _order(kept, length)
    for _ in range(rounds):
        centroids = _means(kept, centroids, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = nearest(_matrix(batch, length), centroids, order)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    placed = common.written(kept.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"))
    common.drop_written(kept)
    inertia = {row[0]: int(row[1]) for row in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect()}
    digests = {j: hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest() for j in inertia}
    of = lambda values: F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("cluster"))
    return placed.select("vec_id", "cluster", "distance", of(inertia).cast("long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(digests).alias("centroid_sha256"))
