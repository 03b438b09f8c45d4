"""Operator 3, mixing sources to target weights [native]: pivotal dependent rounding.

Every source gets a target of words; a document then deserves ``target / source size`` copies. Its whole part is taken, the
rest is a copy probability. Probabilities are rounded in pairs: words are moved at random from one document to the other
until one probability is 0 or 1. A move keeps the expectation of both and the words that the source takes, so a source ends
within one document of its target. Documents are folded within bounded blocks of a source; what one block leaves over (one
document) goes up a tree of such blocks. A hot source is many blocks from the start. Documents that are a good part of their
source would need very many such moves; they are folded among themselves first, and the one left over is paired with the rest of
the source as a whole, whose probabilities move alike.

Only DataFrame functions are used. The draws are hashes of the ids in the pair: reruns agree.

Cases: a null text has size 0; a null id or source is a value like any other (null sources rank last). A source without words
has target 0 and its documents are not taken. Repeated rows are rounded each for itself. No rows give no rows. Other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm import common

#: Weights by rank of the source's name, repeating; most copies of a document; documents folded by one task's step.
WEIGHTS, MOST, FOLD = (1, 2, 3), 3.0, 128
SEED = 20240229
#: Documents over 1/GIANT of their source and GIANT_MEANS mean documents are folded apart, the last against all others of its source at once.
GIANT, GIANT_MEANS = 400, 4
#: Sources whose targets may be broadcast.
BROADCAST_SOURCES = 200_000
_ROW = "struct<doc_id:{id},source:string,size:bigint,source_size:bigint,target:double,n:bigint,whole:int,p:double,h:bigint,nth:int>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, share: float = 1.0) -> DataFrame:
    """(source, source_size, n documents, target): weights share the sizes' sum, targets are at most ``most`` times their source.

    The excess of capped sources is shared again by weight until none is above. That is the level x at which
    sum(min(most * size, weight * x)) is the whole; sources ordered by size / weight are capped from the smallest on, so
    one running sum finds it. One row a source stands in the single partition.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    level = (total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= most * F.col("source_size"))
    per = per.withColumn("nth", F.row_number().over(by_level))
    first = F.min(F.when(F.col("open"), F.struct("nth", "level"))).over(Window.partitionBy())["level"]
    target = F.least(most * F.col("source_size"), F.coalesce(first * F.col("weight"), most * F.col("source_size")))
    return per.select("source", "source_size", "n", target.cast("double").alias("target"))


def _uniform(a: Column, b: Column, step: Column) -> Column:
    """In [0, 1), from both ids and the words still at stake, so that repeated ids draw anew."""
    return F.pmod(F.xxhash64(F.lit(SEED), a, b, step), F.lit(1 << 40)).cast("double") / float(1 << 40)


def _fold(rows: Column, kind: str) -> Column:
    """Folds an array of rows: struct(done array of rows with p 0 or 1, left row or null)."""
    row = _ROW.format(id=kind)
    start = F.expr(f"cast(named_struct('done', array(), 'left', null) as struct<done:array<{row}>,left:{row}>)")

    def settled(x: Column) -> Column:
        return (x["p"] <= 0) | (x["p"] >= 1) | (x["size"] == 0)

    def with_p(x: Column, p: Column) -> Column:
        return x.withField("p", F.when(p < 1e-12, 0.0).when(p > 1 - 1e-12, 1.0).otherwise(p))

    def step(acc: Column, x: Column) -> Column:
        a = acc["left"]
        # words that can go from x to a (up) and from a to x (down)
        up = F.least((1 - a["p"]) * a["size"], x["p"] * x["size"])
        down = F.least(a["p"] * a["size"], (1 - x["p"]) * x["size"])
        gain = _uniform(a["doc_id"], x["doc_id"], a["p"]) * (up + down) < down
        moved = F.when(gain, up).otherwise(-down)
        a2, x2 = with_p(a, a["p"] + moved / a["size"]), with_p(x, x["p"] - moved / x["size"])
        pair = F.struct(a2.alias("a"), x2.alias("x"))
        both = F.transform(F.array(pair), lambda q: F.struct(
            F.concat(F.when(settled(q["a"]), F.array(q["a"])).otherwise(F.slice(F.array(q["a"]), 1, 0)), F.when(settled(q["x"]), F.array(q["x"])).otherwise(F.slice(F.array(q["x"]), 1, 0))).alias("done"),
            F.when(~settled(q["a"]), q["a"]).when(~settled(q["x"]), q["x"]).alias("left"),
        ))[0]
        only = lambda done, left: F.struct(done.alias("done"), left.alias("left"))
        return (
            F.when(settled(x), only(F.concat(acc["done"], F.array(x)), a))
            .when(a.isNull(), only(acc["done"], x))
            .otherwise(F.transform(F.array(both), lambda q: only(F.concat(acc["done"], q["done"]), q["left"]))[0])
        )

    return F.aggregate(rows, start, step)


def mix(df: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, most: float = MOST, share: float = 1.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often the mix takes each document.

    ``share`` is the part of all words that the mix has in all.
    """
    return _rounded(df, ident, text, source, weights, most, share).select("doc_id", "source", "size", "source_size", "target", "copies")


def _rounded(df: DataFrame, ident: str, text: str, source: str, weights: tuple = WEIGHTS, most: float = MOST, share: float = 1.0) -> DataFrame:
    """What ``mix`` returns, with the hash h of the text and the row's number among equal ones, by which equal rows are spread."""
    kind = df.schema[ident].dataType.simpleString()
    sized = df.select(F.col(ident).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("h"))
    sized = common.written(sized.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "h").orderBy("size"))))
    targets = source_targets(sized, weights, most, share)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    counted = targets.agg(F.max("n"), F.count(F.lit(1))).first()
    # one row a source, about 60 bytes: broadcast behind a check of their count, else joined by sorting
    targets = F.broadcast(targets) if counted[1] <= BROADCAST_SOURCES else targets
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "n", F.floor(ratio).cast("int").alias("whole"), (ratio - F.floor(ratio)).alias("p"), "h", "nth")
    rows = rows.withColumn("p", F.when(F.col("p") < 1e-9, 0.0).when(F.col("p") > 1 - 1e-9, 1.0).otherwise(F.col("p")))
    giant = (F.col("size") * GIANT > F.col("source_size")) & (F.col("size") * F.col("n") > GIANT_MEANS * F.col("source_size")) & (F.col("p") > 0)
    giants, rows = rows.where(giant), rows.where(~giant)
    largest = counted[0] or 0
    done, names = [], ["doc_id", "source", "size", "source_size", "target", "n", "whole", "p", "h", "nth"]

    def fold(rows: DataFrame, block: Column) -> DataFrame:
        # large documents first: the smaller ones that follow can take up or give the words that settle them
        packed = rows.groupBy("source", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("size", *[n for n in names if n != "size"])), asc=False).alias("rows"))
        in_order = F.transform("rows", lambda x: F.struct(*[x[n].alias(n) for n in names]).cast(_ROW.format(id=kind)))
        folded = common.written(packed.select(_fold(in_order, kind).alias("f")).select("f.done", "f.left"))
        done.append(folded.select(F.explode("done").alias("r")).select("r.*"))
        return folded.where("left IS NOT NULL").select("left.*").withColumn("n", F.ceil(F.col("n") / FOLD).cast("long"))

    # under GIANT a source: folded among themselves, and the one left over with the rest of its source as if that were one document
    held = giants.groupBy(F.col("source").alias("of")).agg(F.sum("size").alias("held"), F.first("p").alias("rest"))
    left = fold(giants, F.lit(0)).join(held, F.col("source").eqNullSafe(F.col("of")))
    others, own = F.col("source_size") - F.col("held"), F.col("p") * F.col("size")
    up, down = F.least(F.col("size") - own, F.col("rest") * others), F.least(own, (1 - F.col("rest")) * others)
    gain = _uniform(F.col("doc_id"), F.col("source"), F.lit(0.25)) * (up + down) < down
    left = left.withColumn("moved", F.when(gain, up).otherwise(-down)).withColumn("others", others)
    shift = left.select("of", (F.col("moved") / F.nullif(F.col("others"), F.lit(0))).alias("given"))
    snapped = lambda p: F.when(p < 1e-12, 0.0).when(p > 1 - 1e-12, 1.0).otherwise(p)
    rows = rows.join(shift, F.col("source").eqNullSafe(F.col("of")), "left")
    rows = rows.withColumn("p", F.when(F.col("given").isNull(), F.col("p")).otherwise(snapped(F.col("p") - F.col("given")))).select(*names)
    rows = rows.unionByName(left.withColumn("p", snapped(F.col("p") + F.col("moved") / F.col("size"))).select(*names))

    # two blocks of each source wait for the root, where their many small documents settle what the tree leaves over
    spread = lambda level: F.pmod(F.xxhash64(F.lit(SEED + level), "doc_id", "h", "nth"), F.greatest(F.lit(1), F.ceil(F.col("n") / FOLD)))
    waiting, level = None, 0
    while largest > (FOLD if waiting else 3 * FOLD):
        if waiting is None:
            waiting, rows = rows.where(spread(0) < 2), rows.where(spread(0) >= 2)
        rows = fold(rows, spread(level))
        level, largest = level + 1, math.ceil(largest / FOLD)
    rows = fold(rows.unionByName(waiting) if waiting else rows, F.lit(0))
    # the one document that a source may have left over: a draw of its own
    draw = _uniform(F.col("doc_id"), F.col("source"), F.lit(0.5))
    done.append(rows.withColumn("p", F.when(draw < F.col("p"), 1.0).otherwise(0.0)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("whole") + F.col("p").cast("int"))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), "h")


def materialised(df: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of df, each as often as the mix takes it. Rows of one id, source and text share their copies evenly."""
    key, of, total, rows, times = (common.fresh(df, name) for name in ("key", "of", "total", "rows", "times"))
    named = lambda a, b, c: F.struct(F.col(a).alias("a"), F.col(b).cast("string").alias("b"), c.alias("c"))  # noqa: E731  nulls inside are equal
    chosen = _rounded(df, ident, text, source, **how).groupBy(named("doc_id", "source", F.col("h")).alias(of)).agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(rows))
    chosen = common.written(chosen.where(F.col(total) > 0))  # read back, so that the join's sides can be split
    taken = df.withColumn(key, named(ident, source, F.xxhash64(text))).join(chosen.hint("merge"), F.col(key) == F.col(of))
    # the join has dealt and sorted the rows by this column: the numbers cost no exchange
    nth = F.row_number().over(Window.partitionBy(of).orderBy(of))
    extra = F.when(nth <= F.col(total) % F.col(rows), 1).otherwise(0)
    taken = taken.withColumn(times, (F.floor(F.col(total) / F.col(rows)) + extra).cast("int")).where(F.col(times) > 0)
    return taken.withColumn(of, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in df.columns])
