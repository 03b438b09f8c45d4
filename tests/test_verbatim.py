"""Verbatim search against plain search, whatever quotes and documents look like."""

import random

import numpy as np
import pyarrow as pa
import pytest

from spanforge.operators import truth, verbatim


def test_fingerprints_are_those_of_the_bytes():
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 256, 3000).astype(np.uint8)
    for width in verbatim.WIDTHS:
        all_ = verbatim.fingerprints(raw, width)
        assert len(all_) == len(raw) - width + 1
        assert [int(x) for x in all_[:50]] == [int(verbatim.fingerprints(raw[k : k + width], width)[0]) for k in range(50)]
        assert len(np.unique(all_)) == len({raw[k : k + width].tobytes() for k in range(len(all_))})
    assert len(verbatim.fingerprints(raw[:3], 6)) == 0


def test_filter_has_no_false_negatives_and_few_positives(spark):
    rng = np.random.default_rng(1)
    inside, outside = (rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) for n in (5000, 200_000))
    keep = verbatim.Filter.of(spark.createDataFrame([(int(x.view(np.int64)), 24) for x in inside], "fp long, width int"))
    assert len(keep.may_hold(inside)) == len(inside) and len(keep.may_hold(outside)) < 0.01 * len(outside) and keep.widths == [24]
    assert verbatim.Filter.of(spark.createDataFrame([], "fp long, width int")).may_hold(outside).size == 0


def test_hits_at_strides_and_edges(monkeypatch):
    monkeypatch.setattr(verbatim, "STRIDE", 64)
    texts = ["x" * 50 + "needle in the hay, long enough" + "y" * 90, None, "", "needle in the hay, long enough", "needle in the hay, long", "n"]
    fp = verbatim.fingerprints(np.frombuffer(b"needle in the hay, long enough"[:24], np.uint8), 24)

    class One:
        widths = [24]

        def may_hold(self, h):
            return np.flatnonzero(h == fp[0])

    rows, found = verbatim.hits(pa.array(texts), One())
    assert rows.tolist() == [0, 3] and set(found.tolist()) == {int(fp[0].view(np.int64))}


@pytest.mark.parametrize("seed", range(3))
def test_located_quotes_match_plain_search(spark, seed):
    """Short and long quotes, parts of words, overlapping and repeated ones, letters of several bytes, common windows."""
    rng = random.Random(seed)
    letters = "ab é語😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 300))) for _ in range(40)] + [None, "", "the same words again and again " * 20, "the same words again and again and a rare end"]
    quotes = ["é", "ab", "", "語😀", "zzz", "the same words again and again and a rare end", "the same words again and again ", "x" * 40]
    for _ in range(40):
        text = rng.choice([t for t in texts if t])
        a = rng.randrange(len(text))
        quotes.append(text[a : a + rng.choice([1, 3, 7, 15, 30, 80])])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([*enumerate(quotes), (999, None)], "item_id long, quote string")
    got = sorted(tuple(r) for r in truth.locate_quotes(items, docs).collect())
    want = sorted((i, d, t.index(q), t.index(q) + len(q)) for i, q in enumerate(quotes) for d, t in enumerate(texts) if q and t and q in t)
    assert got == want


def test_rarest_window_is_the_anchor(spark):
    docs = spark.createDataFrame([(k, "a passage that stands in every single document of all, and more" + (" with a tail that only one has at its end" if k == 7 else "")) for k in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a passage that stands in every single document of all, and more with a tail that only one has at its end"), (2, "a passage that stands in every single document but is not there")], "item_id long, quote string")
    chosen = {r.item_id: r.fp for r in verbatim.anchors(items, docs).collect()}
    counts = {r.fp: r.n for r in verbatim.document_counts(docs, verbatim.Filter.of(verbatim.windows(items).select("fp", "width"))).collect()}
    assert set(chosen) == {1} and counts[chosen[1]] == 1 and max(counts.values()) == 30


def test_no_join_without_keys(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "me te")], "item_id long, quote string")
    plan = truth.locate_quotes(items, docs)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_an_empty_quote_fails_no_job(spark):
    items = spark.createDataFrame([("a", [(1, "", 0)]), ("b", [(1, "text", 0)])], "item_id string, quotes array<struct<doc:long,quote:string,occurrence:int>>")
    got = {r.item_id: r.error for r in truth.resolve_quotes(items, spark.createDataFrame([(1, "some text")], "doc_id long, text string")).collect()}
    assert got == {"a": "unresolved_quote", "b": None}
