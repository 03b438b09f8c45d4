"""The pipeline on a small fixture, stage by stage, and as a whole."""

import corpus_pipeline as pipeline
from spanforge.llm import common
from tests.llm.helpers import SCHEMA, words
from tests.llm.test_corpus_ops import brute_components
from tests.llm.helpers import frame, odd_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rows = odd_rows(7, 40)
    docs = frame(spark, rows).select(*COLUMNS)
    first = common.written(pipeline.language_id(spark, docs, ""))
    kept = {r.doc_id for r in first.collect()}
    assert first.columns == COLUMNS and {0, 1, 2}.isdisjoint(kept) and len(kept) >= len({r[0] for r in rows}) - 4
    second = common.written(pipeline.line_dedup(spark, first, ""))
    assert second.columns == COLUMNS and second.count() == first.count()
    third = common.written(pipeline.near_duplicates(spark, second, ""))
    want = brute_components([(r.doc_id, r.text) for r in second.collect()])
    got = third.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(k for k, (_, c) in want.items() if c == k) and sum(r.doc_id is None for r in got) == 1
    fourth = common.written(pipeline.source_mix(spark, third, ""))
    assert fourth.columns == COLUMNS and all(words(r.text) for r in fourth.collect())
    last = pipeline.tokens(spark, fourth, "")
    assert last.count() == fourth.count() and all(r.n_tokens * 4 == len(r.ids) for r in last.collect())


def test_line_dedup_leaves_other_columns_alone(spark):
    rows = [(k, f"a line that all of them have\nown {'abcdefg'[k]} line", "mine", "keepme", 5) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, n_dropped string, n_chars int")
    got = pipeline.line_dedup(spark, docs, "")
    assert got.dtypes == docs.dtypes
    assert {(r.n_lines, r.n_dropped) for r in got.collect()} == {("mine", "keepme")} and all(r.n_chars == len(r.text) for r in got.collect()) and sum("all of them" in r.text for r in got.collect()) == 1
    named = pipeline.line_dedup(spark, docs.withColumn("n_chars", docs.n_lines), "")
    assert {r.n_chars for r in named.collect()} == {"mine"}


def test_run_over_a_folder_and_an_empty_table(spark, tmp_path):
    frame(spark, odd_rows(8, 20)).select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() > 0
    spark.createDataFrame([], SCHEMA).select(*COLUMNS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").collect() == []
