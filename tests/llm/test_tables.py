"""Operators over the shop's tables and vectors: late arrivals, clustering."""

import hashlib
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spanforge.llm import clustering, late_arrivals, queries

EPOCH = datetime(1970, 1, 1)
CUT = datetime(2024, 3, 1)
COLUMNS = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"


def micros(t):
    return None if t is None else (t - EPOCH) // timedelta(microseconds=1)


def day_of(t):
    return -1 if t is None else micros(t) // 86_400_000_000


def low(x):
    """Sorts None first."""
    return (x is not None, x if x is not None else 0)


def copied(rows):
    out = []
    for r in rows:
        out.append(r)
        if r[0] is None:
            continue
        h = zlib.crc32(str(r[0]).encode())
        if h % 3 == 0 and day_of(r[4]) % 10 == 0:
            out.append((*r[:3], None if r[3] is None else r[3] + 1, r[4] + timedelta(days=h % 2), r[5] and r[5] + timedelta(days=1 + h % 97), *r[6:]))
    return out


def winners(rows):
    best = {}
    for r in rows:
        rank = [low(r[5]), low(r[4]), *(low(x) for k, x in enumerate(r) if k not in (0, 4, 5))]
        if r[0] not in best or rank > best[r[0]][0]:
            best[r[0]] = (rank, r)
    return {k: r for k, (_, r) in best.items()}


def layout(rows, per_file):
    days = defaultdict(list)
    for r in rows:
        days[day_of(r[4])].append(r)
    out = {}
    for day, own in days.items():
        own.sort(key=lambda r: (low(r[4]), low(r[0])))
        out |= {(day, k // per_file): own[k : k + per_file] for k in range(0, len(own), per_file)}
    return out


def text(x):
    return "" if x is None else str(x)


def brute(rows, per_file):
    """The file list by its definition: (day, file_no) -> n_rows, cents, rows_crc, ids_sha256, rewritten."""
    early, final = winners([r for r in rows if r[5] is not None and r[5] < CUT]), winners(rows)
    late = {k: r for k, r in final.items() if r[5] is None or r[5] >= CUT}
    dirty = {day_of(r[4]) for r in late.values()} | {day_of(early[k][4]) for k in late if k in early}
    return {
        at: (
            len(own), sum(int(np.floor(100 * r[3] + 0.5)) for r in own if r[3] is not None), sum(zlib.crc32(f"{text(r[0])}:{text(micros(r[4]))}:{text(micros(r[5]))}".encode()) for r in own),
            hashlib.sha256(",".join(text(r[0]) for r in own).encode()).hexdigest(), at[0] in dirty,
        )
        for at, own in layout(final.values(), per_file).items()
    }


def sales(seed, n, hot=False):
    rng, rows = random.Random(seed), []
    for k in range(n):
        sold = None if rng.random() < 0.03 else EPOCH + timedelta(days=19_720 if hot and rng.random() < 0.5 else rng.randrange(19_715, 19_800), seconds=rng.choice([0, rng.randrange(86_400)]), microseconds=rng.choice([0, rng.randrange(10**6)]))
        arrived = (sold or datetime(2024, 2, 20)) + timedelta(minutes=rng.choice([0, 5, 60, 60 * 24 * rng.randrange(50)]))
        rows.append((k, rng.choice([None, 1, 1, rng.randrange(99)]), rng.choice(["done", None]), rng.choice([None, round(rng.random() * 900, 2), -3.555]), sold, arrived, rng.randrange(5)))
    return rows


def folder(tmp_path, rows, schema=COLUMNS):
    """sales.parquet as other writers store it: times without a zone."""
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "timestamp_ntz": pa.timestamp("us"), "int": pa.int32()}
    names, types = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    pq.write_table(pa.table({n: pa.array([r[k] for r in rows], kinds[t]) for k, (n, t) in enumerate(zip(names, types, strict=True))}), tmp_path / "sales.parquet")
    return str(tmp_path)


def listed(df):
    return {(r.day, r.file_no): (r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten) for r in df.collect()}


def plain(path):
    return path.removeprefix("file:").replace("///", "/")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_late_arrivals_match_brute_force(spark, tmp_path, zone):
    rows = sales(1, 2500, hot=True)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = queries.op11_late_arrivals(spark, folder(tmp_path, rows))
        want = brute(copied(rows), 1 + len(rows) // 900)
        assert listed(df) == want and {w[-1] for w in want.values()} == {True, False}
        for r in df.collect():
            got = pq.ParquetFile(plain(r.path)).read()
            assert got.column_names == [c.split(" ")[0] for c in COLUMNS.split(", ")] == r.columns.split(",")
            assert hashlib.sha256(",".join(map(str, got["sale_id"].to_pylist())).encode()).hexdigest() == r.ids_sha256
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_only_touched_days_are_rewritten_and_emptied_ones_go(spark, tmp_path):
    """Files of untouched days keep their bytes; a day whose only sale moves away leaves no file."""
    day = lambda d, s=0: EPOCH + timedelta(days=d, seconds=s)
    early = [(k, None, "a", 1.0, day(19_700 + k // 4, k), day(19_750), 1) for k in range(40)] + [(90, None, "a", 1.0, day(19_720), day(19_751), 1)]
    late = [(90, None, "b", 2.0, day(19_721), day(19_790), 1), (5, None, "b", 2.0, day(19_705, 1), day(19_790), 1), (91, None, "b", 2.0, None, None, 1)]
    df = spark.createDataFrame(early, COLUMNS)
    first = late_arrivals.amended_layout(df, "2024-03-01", 3, f"file://{tmp_path}/a")[0]
    before = {p: p.read_bytes() for p in (tmp_path / "a").rglob("part-*.parquet")}
    after, start = late_arrivals.amended_layout(spark.createDataFrame(early + late, COLUMNS), "2024-03-01", 3, f"file://{tmp_path}/b")
    got = late_arrivals.files(after, start).collect()
    assert {r.day for r in got if r.rewritten} == {-1, 19_701, 19_705, 19_721} and {r.day for r in got if not r.rewritten} == {19_700 + k for k in range(10)} - {19_701, 19_705}
    assert not list((tmp_path / "b").glob("day=19720*")) and len(list((tmp_path / "b").rglob("part-*.parquet"))) == len(got)
    # the same start written beside: equal bytes, but for the names
    same = lambda top, d: sorted(p.read_bytes() for p in (tmp_path / top / f"day={d}").glob("part-*.parquet"))
    assert before and all(same("a", r.day) == same("b", r.day) for r in got if not r.rewritten)
    assert late_arrivals.files(first, start).where("rewritten").count() == len(before)  # none of them is a starting file of the other


def test_late_arrivals_odd_cases(spark, tmp_path):
    """Null keys and arrivals, repeated rows, ties, clashing names, empty tables."""
    t = lambda d, s=0: EPOCH + timedelta(days=d, seconds=s)
    base = [
        (1, 1, "a", None, t(19_710), None, 1), (1, 1, "a", 5.0, t(19_711), t(19_712), 1), (2, 1, "a", 5.0, t(19_711), t(19_712), 1), (2, 1, "b", 5.0, t(19_711), t(19_712), 1), (2, 1, "b", 5.0, t(19_711), t(19_712), 1),
        (None, 1, "a", 5.0, t(19_713), t(19_714), 1), (None, 1, "a", 6.0, t(19_713), t(19_799), 1), (3, None, None, None, None, None, None), (4, None, None, 1.0, t(-1, 5), t(19_799), None), (5, None, None, 1.0, t(-11, 5), t(19_700), None),
    ]
    rows = [(*r, 7, "x", 1) for r in base]
    df = spark.createDataFrame(rows, COLUMNS + ", day int, place string, late int")
    layout_, start = late_arrivals.amended_layout(df, "2024-03-01", 2)
    got = late_arrivals.files(layout_, start)
    assert listed(got) == brute(rows, 2)
    assert {r.columns for r in got.collect()} == {",".join(df.columns)}
    empty = late_arrivals.files(*late_arrivals.amended_layout(df.limit(0), "2024-03-01", 2))
    assert empty.collect() == [] and empty.columns == got.columns
    for part in (df.where("arrived_at < '2024-03-01'"), df.where("arrived_at >= '2024-03-01' OR arrived_at IS NULL")):
        assert listed(late_arrivals.files(*late_arrivals.amended_layout(part, "2024-03-01", 2))) == brute([tuple(r) for r in part.collect()], 2)
    zoned = df.withColumn("sold_at", F.to_timestamp(F.col("sold_at").cast("string"))).withColumn("arrived_at", F.to_timestamp(F.col("arrived_at").cast("string")))
    assert dict(zoned.dtypes)["sold_at"] == "timestamp" and listed(late_arrivals.files(*late_arrivals.amended_layout(zoned, "2024-03-01", 2))) == brute(rows, 2)


def brute_clusters(vectors, count=8, rounds=10, salt="3:"):
    kept = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) <= 2**17 for x in v)]
    mark = lambda i: ("1", "") if i is None else ("0", hashlib.sha256(f"{salt}{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda k: (mark(k[0]), k[1]))[:count]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(centroids)]
    placed = [(i, *nearest(v)) for i, v in kept]
    of = defaultdict(int)
    for _, d, j in placed:
        of[j] += d
    return sorted(((i, j, d, of[j], sum(of.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in placed), key=lambda r: (low(r[0]), r))


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 2, (5, 64)) * np.linspace(2, 0.01, 64)
    out = [(k, (middles[rng.integers(5)] + rng.normal(0, 0.3, 64)).astype(np.float32).tolist()) for k in range(n)]
    same = out[0][1]
    odd = [None, [], same[:63], [*same, 1.0], [None, *same[1:]], [float("nan"), *same[1:]], [float("inf"), *same[1:]], [3e38, *same[1:]], [131072.0] * 64, [-131072.0] * 64]
    return [*out, *((1000 + k, v) for k, v in enumerate(odd)), *((2000 + k, same) for k in range(20)), (7, same), (7, same), (None, same)]


def clustered(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (low(r[0]), r))


@pytest.mark.parametrize("n", [0, 3, 150])
def test_clusters_match_brute_force(spark, n):
    rows = [(i, v, 1, 2) for i, v in vectors(n, n)] if n else []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int, cluster int").repartition(5)
    for kind, rounds in (("float", 10), ("double", 1)):
        got = clustering.cluster_vectors(df.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>")), rounds=rounds)
        assert clustered(got) == brute_clusters([r[:2] for r in rows], rounds=rounds)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_partial_distances_prune_and_keep_ties():
    rng = np.random.default_rng(0)
    c = rng.integers(-500, 500, (9, 64))
    c[6] = c[2]
    x = np.concatenate([c[rng.integers(0, 9, 500)] + rng.integers(-20, 20, (500, 64)), c[[2, 6]]])
    cluster, distance, read = clustering.nearest(x, c, np.argsort(-x.var(0)))
    every = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all() and 6 not in cluster
    assert read < 0.4 * x.size * len(c)
