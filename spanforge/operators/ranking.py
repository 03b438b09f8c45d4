"""Candidates: latest runs, quality, Pareto frontier, weighted ranking, explanations, transfer between corpora.

A candidate row has config_id, label, chunker, params, retriever, reranker (null without one), n_chunks, hit, recall, mrr, ndcg,
soft, chars, latency_ms. Axes compare chunkers with their parameters, so that two sizes of one chunker are two chunkers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.order import _fresh, best_before, with_positions


def quality() -> Column:
    return 0.5 * F.col("mrr") + 0.3 * F.col("ndcg") + 0.2 * F.col("hit")


def latest(runs: DataFrame, keys: tuple = ("config_id",), at: str = "run_ts") -> DataFrame:
    """The last run of each key; ties go to the larger run_id where there is one."""
    order = F.struct(at, "run_id") if "run_id" in runs.columns else F.col(at)
    rest = [c for c in runs.columns if c not in keys]
    best = runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(*keys, "r.*").select(*runs.columns)


def one_fingerprint(runs: DataFrame, column: str = "corpus_fingerprint") -> DataFrame:
    """The same rows; fails while they are read if they come from more than one corpus."""
    n = runs.agg(F.count_distinct(column).alias("_n"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("runs span "), F.col("_n").cast("string"), F.lit(" corpus fingerprints")))).otherwise(F.lit(True))
    return runs.crossJoin(F.broadcast(n)).where(checked.cast("boolean")).drop("_n")


def candidates(runs: DataFrame, metrics: DataFrame, qa_file: str, corpus: str, k: int = 5, tau: float = 0.5) -> DataFrame:
    """Latest run of each configuration of a question file, with its metrics at one cell."""
    mine = one_fingerprint(runs.where((F.col("qa_file") == qa_file) & (F.col("corpus") == corpus)))
    cell = metrics.where((F.col("k") == k) & (F.col("tau") == tau)).drop("k", "tau")
    return latest(mine).join(cell, ["run_id", "config_id"], "left")


def frontier(points: np.ndarray) -> np.ndarray:
    """Numbers of the distinct points (all axes better high) that no other matches on all axes and beats on one.

    In falling order of their sums no point can beat one before it: each block meets the frontier so far, then itself.
    """
    order = np.lexsort((*points.T[::-1], -points.sum(1)))
    held = np.zeros(0, np.int64)
    for at in range(0, len(order), 512):
        block = order[at : at + 512]
        for against in (held, block):
            p, o = points[block], points[against]
            beaten = np.zeros(len(block), bool)
            for low in range(0, len(o), 4096):
                some = o[low : low + 4096]
                beaten |= ((some[None] >= p[:, None]).all(2) & (some[None] > p[:, None]).any(2)).any(1)
            block = block[~beaten]
        held = np.concatenate([held, block])
    return held


def pareto(rows: DataFrame, ident: str = "config_id", better_high: tuple = ("quality",), better_low: tuple = ("latency_ms", "chars")) -> DataFrame:
    """Rows that no other row matches on all axes and beats on one; equal rows all stay, and rows with a null axis.

    Each task keeps the frontier of its distinct points, eight tasks the frontiers of these, one task that of the eight: points
    are never paired by a join, and what is gathered is no larger than eight frontiers.
    """
    axes = [*better_high, *better_low]
    names = [f"_axis{k}" for k in range(len(axes))]
    sign = [1.0 if c in better_high else -1.0 for c in axes]
    given = [(F.col(c).cast("double") * s).alias(n) for c, s, n in zip(axes, sign, names, strict=True)]
    points = rows.select(*given).dropna().distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(names)))
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)])
            held = held[frontier(held)]
        yield pa.RecordBatch.from_arrays([pa.array(held[:, k]) for k in range(len(names))], names)

    schema = ", ".join(f"{n} double" for n in names)
    points = points.mapInArrow(run, schema)
    for tasks in (8, 1):
        points = points.repartition(tasks).mapInArrow(run, schema)
    same = None
    for c, s, n in zip(axes, sign, names, strict=True):
        here = F.col(c).cast("double") * s == F.col(n)
        same = here if same is None else same & here
    lacking = rows.where(" OR ".join(f"`{c}` IS NULL" for c in axes))
    return rows.join(points, same, "left_semi").unionByName(lacking)


def skyline(rows: DataFrame, best_high: str, best_low: str) -> DataFrame:
    """Pareto rows on two axes by one sort and a running best: no pairwise test, for tables of any size."""
    # one row for each distinct value of the low axis
    per = best_before(rows.groupBy(F.col(best_low).alias("_x")).agg(F.max(best_high).alias("_y")), "_x", "_y", "_best")
    front = per.where(F.col("_best").isNull() | (F.col("_y") > F.col("_best"))).drop("_best")
    return rows.join(front, (F.col(best_low) == F.col("_x")) & (F.col(best_high) == F.col("_y")), "left_semi")


def norm(value: Column, low: Column, high: Column, lower_is_better: bool = False) -> Column:
    """Min-max between two bounds; 1 where the range is nil."""
    scaled = (value - low) / F.nullif(high - low, F.lit(0.0))
    return F.when(high - low < 1e-12, F.lit(1.0)).otherwise(1.0 - scaled if lower_is_better else scaled)


def weighted(rows: DataFrame, quality_w: float = 0.7, latency_w: float = 0.2, context_w: float = 0.1, normalise: bool = False, ident: str = "config_id") -> DataFrame:
    """Adds score and position; latency counts by its logarithm. Ties go by the identifier.

    Bounds come from one aggregate, a single row; positions from ranges of the order.
    """
    total = max(quality_w + latency_w + context_w, 1e-9) if normalise else 1.0
    axes = {"quality": F.col("quality"), "latency": F.log10(F.greatest(F.col("latency_ms"), F.lit(0.01))), "chars": F.col("chars")}
    bounds = rows.agg(*[f(c).alias(f"_{name}_{f.__name__}") for name, c in axes.items() for f in (F.min, F.max)])
    scaled = {name: norm(c, F.col(f"_{name}_min"), F.col(f"_{name}_max"), name != "quality") for name, c in axes.items()}
    parts = quality_w * scaled["quality"] + latency_w * scaled["latency"] + context_w * scaled["chars"]
    scored = rows.crossJoin(F.broadcast(bounds)).withColumn("score", F.round(parts / total, 9)).drop(*bounds.columns)  # one row
    return with_positions(scored, F.col("score").desc(), ident)


def best_varying(rows: DataFrame, winner: DataFrame) -> DataFrame:
    """(axis, config_id, label, mrr, delta): the best alternative that differs from the winner on one axis only."""
    w = winner.select(F.col("config_id").alias("w_id"), F.struct("chunker", "params").alias("w_c"), F.col("retriever").alias("w_r"), F.col("reranker").isNotNull().alias("w_rr"), F.col("mrr").alias("w_mrr"))
    others = rows.crossJoin(F.broadcast(w)).where((F.col("config_id") != F.col("w_id")) & (F.col("reranker").isNotNull() == F.col("w_rr")))
    same_c, same_r = F.struct("chunker", "params") == F.col("w_c"), F.col("retriever") == F.col("w_r")
    axis = F.when(~same_c & same_r, "chunker").when(same_c & ~same_r, "retriever")
    ranked = others.withColumn("axis", axis).where("axis IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy("axis").orderBy(F.col("mrr").desc(), "config_id")))
    return ranked.where("nth = 1").select("axis", "config_id", "label", F.round("mrr", 9).alias("mrr"), F.round(F.col("w_mrr") - F.col("mrr"), 9).alias("delta"))


#: Pairs of twins that one task makes about.
TASK_PAIRS = 1 << 23


def reranker_twins(rows: DataFrame) -> DataFrame:
    """(config_id, twin_id, d_mrr, d_ms, mrr_per_s): each reranked configuration against the same without; null at no time.

    Rows that agree in all but the reranker are paired each with each. What one task makes follows the pairs, not the rows: a key of
    many pairs is a grid of cells, its reranked rows dealt to the grid's lines and the others to its columns by a hash. A row is
    copied once a cell of its line or column, about the root of the key's cells, and those of other keys are not.
    """
    key = ["chunker", "params", "retriever"]
    sides = rows.groupBy(*key).agg(F.count("reranker").alias("a"), F.count(F.lit(1)).alias("n")).select(*key, "a", (F.col("n") - F.col("a")).alias("b"), (F.col("a") * (F.col("n") - F.col("a"))).alias("pairs"))
    total = sides.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("all")).first()["all"]
    with_ = rows.where("reranker IS NOT NULL").select(*key, "config_id", F.col("mrr").alias("m1"), F.col("latency_ms").alias("l1"))
    without = rows.where("reranker IS NULL").select(*key, F.col("config_id").alias("twin_id"), F.col("mrr").alias("m2"), F.col("latency_ms").alias("l2"))
    if total > TASK_PAIRS:
        tasks = 2 * -(-total // TASK_PAIRS)  # twice, as keys fall unevenly
        line, column, lines, columns = (_fresh(rows, name) for name in ("line", "column", "lines", "columns"))
        cells = F.ceil(F.col("pairs") / TASK_PAIRS)
        hot = sides.where(F.col("pairs") > TASK_PAIRS).withColumn(lines, F.greatest(F.lit(1), F.least(cells, F.round(F.sqrt(cells * F.col("a") / F.col("b"))))).cast("long"))
        hot = hot.select(*key, lines, F.ceil(cells / F.col(lines)).cast("long").alias(columns))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)) - 1))
        own = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(F.col(n), F.lit(1)))
        hot = F.broadcast(hot)  # one row a TASK_PAIRS of pairs at most
        with_ = with_.join(hot, key, "left").withColumn(line, own("config_id", lines)).withColumn(column, each(F.col(columns))).drop(lines, columns)
        without = without.join(hot, key, "left").withColumn(column, own("twin_id", columns)).withColumn(line, each(F.col(lines))).drop(lines, columns)
        key = [*key, line, column]
        # a stated number of partitions, which is not joined up by the size of its rows
        with_, without = with_.repartition(tasks, *key), without.repartition(tasks, *key)
    d_m, d_l = F.col("m1") - F.col("m2"), F.col("l1") - F.col("l2")
    return with_.join(without, key).select("config_id", "twin_id", F.round(d_m, 9).alias("d_mrr"), F.round(d_l, 9).alias("d_ms"), F.round(F.try_divide(d_m * 1000, F.nullif(d_l, F.lit(0.0))), 9).alias("mrr_per_s"))


def twins_of(rows: DataFrame, winner: DataFrame) -> DataFrame:
    """The rows that stand in a pair of twins with the winner, and the winner: no other pair is made of these."""
    key = ["chunker", "params", "retriever"]
    w = winner.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("config_id").alias("_id"), F.col("reranker").isNull().alias("_plain"))
    same = F.col("config_id") == F.col("_id")
    for c in key:
        same_key = F.col(c) == F.col(f"_{c}")
        met = same_key if c == key[0] else met & same_key
    return rows.join(F.broadcast(w), met & (same | (F.col("reranker").isNull() != F.col("_plain"))), "left_semi")  # one row


def explanation(rows: DataFrame, winner: DataFrame, ceilings: DataFrame) -> DataFrame:
    """(line_no, line): templated reasons from measured differences. ``ceilings`` has (config_id, tau, reachable)."""
    w = winner.select("config_id", "label", "mrr", "hit", "ndcg", "latency_ms", "chars", "n_chunks")
    head = w.select(F.posexplode(F.array(
        F.concat(F.lit("RECOMMENDED: "), F.col("label")),
        F.format_string("Quality  MRR %.3f | hit %.3f | nDCG %.3f", "mrr", "hit", "ndcg"),
        F.format_string("Cost     %.1f ms/query | %.0f chars of context | %d chunks indexed", "latency_ms", "chars", "n_chunks"),
    )).alias("line_no", "line"))
    axes = best_varying(rows, winner).select(
        F.when(F.col("axis") == "chunker", 3).otherwise(4).alias("line_no"),
        F.format_string("%s: %s the best alternative (%s) by %.3f MRR, all else equal", "axis", F.when(F.col("delta") >= 0, "outperforms").otherwise("trails"), "label", F.abs("delta")).alias("line"),
    )
    mine = winner.select(F.col("config_id").alias("w"))
    twins = reranker_twins(twins_of(rows, winner)).join(F.broadcast(mine), (F.col("config_id") == F.col("w")) | (F.col("twin_id") == F.col("w")))
    bought = F.format_string("Reranking: %+.3f MRR for %+.0f ms/query", "d_mrr", "d_ms")
    twins = twins.select(F.lit(5).alias("line_no"), F.when(F.col("config_id") == F.col("w"), bought).otherwise(F.concat(F.lit("Rejected: "), bought)).alias("line"))
    low = ceilings.join(F.broadcast(mine), F.col("config_id") == F.col("w")).groupBy("w").agg(F.min("reachable").alias("low")).where("low < 0.99")
    warn = low.select(F.lit(6).alias("line_no"), F.format_string("WARNING: only %.1f%% of evidence spans are within reach at the strictest threshold", F.col("low") * 100).alias("line"))
    return head.unionByName(axes).unionByName(twins).unionByName(warn).select(F.col("line_no").cast("long").alias("line_no"), "line")


def grid(chunkers: DataFrame, retrievers: DataFrame, rerankers: DataFrame) -> DataFrame:
    """All configurations: (chunker, params), retriever, reranker (nullable) -> with config_id. Dimension tables only."""
    all_ = chunkers.crossJoin(F.broadcast(retrievers)).crossJoin(F.broadcast(rerankers))
    return all_.withColumn("config_id", F.concat_ws("_", "chunker", "params", "retriever", F.when(F.col("reranker").isNotNull(), F.lit("rerank"))))


def spread_sample(rows: DataFrame, n: int, by: Column, ident: str = "config_id") -> DataFrame:
    """n rows at even places of the order by ``by``; places round half to even."""
    ordered = with_positions(rows, by, ident, out="place", first=0)
    size = ordered.agg(F.max("place").alias("last"))
    picks = rows.sparkSession.range(n).crossJoin(F.broadcast(size)).select(F.bround(F.col("id") * F.col("last") / max(1, n - 1)).cast("long").alias("place")).distinct()
    return ordered.join(F.broadcast(picks), "place").drop("place")


def transfer(rows: DataFrame) -> DataFrame:
    """Each corpus's winner on every corpus: (winner_of, label, corpus, mrr, position, n, winner_differs). Rows carry corpus, score."""
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy("corpus").orderBy(F.col("score").desc(), "label")).cast("long")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("corpus")))
    winners = ranked.where("position = 1").select(F.col("corpus").alias("winner_of"), "label")
    differs = winners.agg((F.count_distinct("label") > 1).alias("winner_differs"))
    corpora = rows.select("corpus").distinct()
    asked = winners.crossJoin(F.broadcast(corpora)).join(ranked.select("corpus", "label", F.round("mrr", 9).alias("mrr"), "position", "n"), ["corpus", "label"], "left")
    return asked.crossJoin(F.broadcast(differs)).select("winner_of", "label", "corpus", "mrr", "position", "n", "winner_differs")


def field_deltas(rows: DataFrame, axes: tuple = ("mrr", "latency_ms", "chars"), ident: str = "config_id") -> DataFrame:
    """(ident, <axis>_delta): relative distance of each row from the mean of the field, which is one aggregated row."""
    means = rows.agg(*[F.avg(a).alias(f"_{a}_mean") for a in axes])
    delta = lambda a: F.round(F.try_divide(F.col(a) - F.col(f"_{a}_mean"), F.nullif(F.col(f"_{a}_mean"), F.lit(0.0))), 9).alias(f"{a}_delta")
    return rows.crossJoin(F.broadcast(means)).select(ident, *[delta(a) for a in axes])


def family_counts(rows: DataFrame, families: DataFrame, family: str = "chunker") -> DataFrame:
    """(family, n, best_mrr): every family, also those without a candidate."""
    per = rows.groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("mrr"), 9).alias("best_mrr"))
    return families.select(family).distinct().join(per, family, "left").select(family, F.coalesce("n", F.lit(0)).alias("n"), "best_mrr")


def scatter(rows: DataFrame, intervals: DataFrame, ident: str = "config_id") -> DataFrame:
    """(ident, label, quality, latency_ms, chars, half_width, on_frontier): what a chart of candidates shows.

    ``intervals`` has (ident, low, high); half_width is null without one.
    """
    best = pareto(rows, ident).select(ident, F.lit(True).alias("on_frontier"))
    half = intervals.select(ident, F.round((F.col("high") - F.col("low")) / 2, 9).alias("half_width"))
    out = rows.join(half, ident, "left").join(best, ident, "left")
    return out.select(ident, "label", "quality", "latency_ms", "chars", "half_width", F.coalesce("on_frontier", F.lit(False)).alias("on_frontier"))
