"""Metrics over questions: the (k, tau) cube in one pass, bootstrap intervals, correlation, spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators import alignment

KS, TAUS = (1, 3, 5, 10), (0.1, 0.3, 0.5, 0.7)


def metric_cube(ranked: DataFrame, truth: DataFrame, ks: tuple = KS, taus: tuple = TAUS, by: tuple = ()) -> DataFrame:
    """(by, k, tau, n_questions, hit_at_k, recall_at_k, mrr, ndcg_at_k, soft_score, mean_chars_retrieved, unanswered).

    All cells are conditional aggregates over one alignment, by span and by ranked row; a question is one wide row until the end.
    Questions without ranked rows count as unanswered.
    """
    aligned = alignment.align(ranked, truth, by=by)
    cells = [(k, tau) for k in ks for tau in taus]
    # each span's best up to every k, then shares of spans by cell
    spans = aligned.groupBy(*by, "qid", "span_ix").agg(*[F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("overlap"))), F.lit(0.0)).alias(f"b{k}") for k in ks])
    recall = spans.groupBy(*by, "qid").agg(*[F.avg((F.col(f"b{k}") >= tau).cast("double")).alias(f"r{i}") for i, (k, tau) in enumerate(cells)], *[F.avg(f"b{k}").alias(f"soft{k}") for k in ks])
    # first hits of all cells and gains of all k from the same rows: one exchange by question
    per_rank, w = alignment.scores(aligned, by), Window.partitionBy(*by, "qid")
    places = {}
    for k in ks:
        inside = F.coalesce(F.col("rank") <= k, F.lit(False))
        places |= {f"in{k}": inside, f"here{k}": F.row_number().over(w.orderBy(inside.desc(), "rank")), f"ideal{k}": F.row_number().over(w.orderBy(inside.desc(), F.col("score").desc(), "rank"))}
    gain = lambda k, place: F.sum(F.when(F.col(f"in{k}"), F.col("score") / F.log2(F.col(f"{place}{k}") + 1)))
    share = lambda k: F.round(F.coalesce(F.try_divide(gain(k, "here"), F.nullif(gain(k, "ideal"), F.lit(0.0))), F.lit(0.0)), 9)
    hits = per_rank.withColumns(places).groupBy(*by, "qid").agg(
        *[F.min(F.when((F.col("rank") <= k) & (F.col("score") >= tau), F.col("rank"))).alias(f"f{i}") for i, (k, tau) in enumerate(cells)], *[share(k).alias(f"g{k}") for k in ks]
    )
    chars = ranked.groupBy(*by, "qid").agg(*[F.sum(F.when(F.col("rank") <= k, F.col("end") - F.col("start"))).alias(f"c{k}") for k in ks])
    wide = recall.join(hits, [*by, "qid"]).join(chars, [*by, "qid"], "left")
    cell = lambda i, k, tau: F.struct(
        F.lit(int(k)).cast("long").alias("k"), F.lit(float(tau)).alias("tau"), F.col(f"r{i}").alias("recall"), F.col(f"soft{k}").alias("soft"), F.col(f"f{i}").alias("first"), F.col(f"g{k}").alias("ndcg"), F.coalesce(F.col(f"c{k}"), F.lit(0)).alias("chars"),
    )
    rows = wide.select(*by, F.explode(F.array(*[cell(i, k, tau) for i, (k, tau) in enumerate(cells)])).alias("cell")).select(*by, "cell.*")
    r9 = lambda c, name: F.round(c, 9).alias(name)
    return rows.groupBy(*by, "k", "tau").agg(
        F.count(F.lit(1)).alias("n_questions"), r9(F.avg(F.col("first").isNotNull().cast("double")), "hit_at_k"), r9(F.avg("recall"), "recall_at_k"),
        r9(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), "mrr"), r9(F.avg("ndcg"), "ndcg_at_k"), r9(F.avg("soft"), "soft_score"), r9(F.avg("chars"), "mean_chars_retrieved"),
        F.count_if(F.col("first").isNull()).alias("unanswered"),
    )


def draw_index(seed: int, iteration: Column, slot: Column, n: Column) -> Column:
    """The resampled place in 0 .. n-1, from an md5 digest, so that any engine can repeat it."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), iteration.cast("string"), slot.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n


def bootstrap(values: DataFrame, value: str, by: tuple = (), iterations: int = 2000, confidence: float = 0.95, seed: int = 0, least: int = 1) -> DataFrame:
    """(by, n, point, low, high) of the mean of ``value`` over questions resampled with replacement.

    Under ``least`` values the interval is the point itself.

    Values (by, qid, value) become one array a configuration, bounded by the questions; each iteration folds draws from
    it inside one row, so nothing is joined and iterations spread over tasks.
    """
    spark = values.sparkSession
    arrays = values.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("qid", F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("vs"))
    runs = arrays.crossJoin(spark.range(iterations).withColumnRenamed("id", "it"))
    n = F.size("vs")
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, slot: acc + F.get("vs", draw_index(seed, F.col("it"), slot, n).cast("int")))
    means = runs.select(*by, F.size("vs").cast("long").alias("n"), F.aggregate("vs", F.lit(0.0), lambda a, x: a + x).alias("sum"), F.round(total / n, 9).alias("m"), "it")
    w = Window.partitionBy(*by).orderBy("m", "it")
    placed = means.withColumn("at", F.row_number().over(w) - 1)
    alpha = (1.0 - confidence) / 2.0
    low, high = int(alpha * (iterations - 1)), int((1.0 - alpha) * (iterations - 1))
    out = placed.groupBy(*by).agg(F.max("n").alias("n"), F.round(F.max(F.col("sum") / F.col("n")), 9).alias("point"), F.max(F.when(F.col("at") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("at") == high, F.col("m"))).alias("high"))
    bound = lambda c: F.when(F.col("n") < least, F.col("point")).otherwise(F.col(c)).alias(c)
    return out.select(*by, "n", "point", bound("low"), bound("high"))


#: The chances that a Poisson variable of mean 1 is at most 0, 1, 2, ...; the next one is 1 to nine digits.
POISSON = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.99998975080, 0.99999887480, 0.99999988857)
#: Draws that one digest gives: eight hex digits each.
DRAWS = 4


def poisson_bootstrap(values: DataFrame, value: str, by: tuple = (), iterations: int = 2000, confidence: float = 0.95, seed: int = 0, least: int = 1) -> DataFrame:
    """(by, n, point, low, high) of the mean of ``value``: each question counts as often as its own Poisson draw says.

    Draws depend on the question and the iteration alone, so each row gives its part of every iteration where it stands, and parts
    are added up before they are exchanged: what moves is one row a task, configuration and block of iterations, however many
    questions there are. For many questions this is the interval of ``bootstrap``, whose resamples have exactly n draws.
    """
    blocks = -(-iterations // DRAWS)
    rows = values.where(F.col(value).isNotNull()).select(*by, "qid", F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("block").cast("string"), F.col("qid").cast("string")))
    rows = rows.withColumn("digest", digest)

    def weight(j: int) -> Column:
        u = F.conv(F.substring("digest", 8 * j + 1, 8), 16, 10).cast("double") / float(1 << 32)
        return sum(((u >= p).cast("long") for p in POISSON[1:]), (u >= POISSON[0]).cast("long"))

    weighed = rows.select(*by, "block", "v", *[weight(j).alias(f"w{j}") for j in range(DRAWS)])
    sums = weighed.groupBy(*by, "block").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), *[F.sum(f"w{j}").alias(f"n{j}") for j in range(DRAWS)], *[F.sum(F.col(f"w{j}") * F.col("v")).alias(f"s{j}") for j in range(DRAWS)])
    runs = sums.select(*by, "n", "s", "block", F.posexplode(F.array(*[F.try_divide(F.col(f"s{j}"), F.col(f"n{j}")) for j in range(DRAWS)])).alias("j", "m"))
    runs = runs.where(DRAWS * F.col("block") + F.col("j") < iterations).withColumn("m", F.round("m", 9)).where("m IS NOT NULL")
    w = Window.partitionBy(*by)
    placed = runs.withColumn("at", F.row_number().over(w.orderBy("m")) - 1).withColumn("of", F.count(F.lit(1)).over(w))
    alpha = (1.0 - confidence) / 2.0
    end = lambda share: F.max(F.when(F.col("at") == F.floor(share * (F.col("of") - 1)), F.col("m")))
    point = F.round(F.max(F.col("s") / F.col("n")), 9)
    few = F.max("n") < least
    return placed.groupBy(*by).agg(F.max("n").alias("n"), point.alias("point"), F.when(few, point).otherwise(end(alpha)).alias("low"), F.when(few, point).otherwise(end(1.0 - alpha)).alias("high"))


def indistinguishable(intervals: DataFrame, key: str) -> DataFrame:
    """(a, b, tied) for each pair of configurations: tied if their intervals overlap."""
    a = intervals.select(F.col(key).alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    b = intervals.select(F.col(key).alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    pairs = a.join(b, F.col("a") < F.col("b"))  # one row a configuration; all pairs are what is asked for
    return pairs.select("a", "b", (~((F.col("a_high") < F.col("b_low")) | (F.col("b_high") < F.col("a_low")))).alias("tied"))


def correlation(df: DataFrame, x: str, y: str, by: tuple = ()) -> DataFrame:
    """(by, n, r): Pearson; null under three pairs or for a constant series."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    stats = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    r = F.try_divide("c", F.nullif(F.col("sx") * F.col("sy"), F.lit(0.0)))
    return stats.select(*by, "n", F.when(F.col("n") >= 3, F.round(r, 9)).alias("r"))


def family_spread(rows: DataFrame, family: str, value: str, without: str = "fixed300") -> tuple[DataFrame, DataFrame]:
    """(mean by family, one row with the range of the means outside families that begin with ``without``)."""
    means = rows.groupBy(family).agg(F.avg(value).alias("mean_value"))
    kept = means.where(~F.col(family).startswith(without))
    return means.select(family, F.round("mean_value", 9).alias("mean_value")), kept.agg(F.round(F.max("mean_value") - F.min("mean_value"), 9).alias("spread"))
