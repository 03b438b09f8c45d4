"""Interval joins by bins, and headings on all line breaks."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import splitters
from spanforge.operators import alignment, chunking

CHUNKS, TRUTHS = "doc_id long, start long, end long", "qid long, span_ix long, doc_id long, start long, end long"


@pytest.mark.parametrize("width", [1, 7, 64, 2048])
def test_pairs_match_plain_comparison(spark, width):
    """Spans of all lengths, empty and equal ones, edges on bins, documents without truths."""
    rng = random.Random(width)

    def span():
        a = rng.randrange(300)
        return a, a + rng.choice([0, 1, 7, 8, 14, 50, 250])

    chunks = [(rng.randrange(4), *span()) for _ in range(80)] + [(0, 0, 7), (0, 7, 14), (0, 0, 7)]
    truths = [(k, k % 3, rng.randrange(5), *span()) for k in range(60)]
    got = sorted(tuple(r)[:6] for r in alignment.pair_scores(spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(truths, TRUTHS), width).collect())
    want = sorted((q, s, d, a, b, max(0, min(b, e) - max(a, c))) for d, a, b in chunks for q, s, o, c, e in truths if d == o and a < e and c < b)
    assert got == want and len(got) > 100


def test_one_long_document_is_many_keys(spark):
    """200,000 chunks of one document: no task takes more than a small share of the joined rows."""
    chunks = spark.range(200_000).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 250).alias("start"), (F.col("id") * 250 + 300).alias("end"))
    truths = spark.range(20_000).select(F.col("id").alias("qid"), F.lit(0).cast("long").alias("span_ix"), F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 2500).alias("start"), (F.col("id") * 2500 + 100).alias("end"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(held, ("-1", "false", "16"), strict=True):
        spark.conf.set(k, v)
    try:
        rows = [r["count"] for r in alignment.pair_scores(chunks, truths).groupBy(F.spark_partition_id()).count().collect()]
        assert max(rows) < 0.2 * sum(rows) and sum(rows) >= 20_000
        assert alignment.reachability(chunks, truths).where("best < 1").count() == 20_000 - alignment.reachability(chunks, truths).where("best >= 1").count()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("mark", ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "])
def test_headings_on_all_line_breaks(spark, mark):
    text = mark.join(["# One", "text", "## Two ", "```", "# not", "```", "### Three", "", "# Four"])
    docs = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    got = [(r.start, r.level, r.title) for r in chunking.heading_lines(docs).orderBy("start").collect()]
    assert got == splitters.headings(text) and [t for _, _, t in got] == ["One", "Two", "Three", "Four"]
