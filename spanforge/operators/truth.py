"""Ground truth: verbatim quotes -> character spans, with the reasons why items are rejected."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import splitters, text
from spanforge.operators import chunking, verbatim

#: Least characters of a quote; line starts that mark structure, not prose.
MIN_QUOTE = 25
SKIP_PREFIX = ("#", "|", "!!!", "///", "```", "~~~", "CHAPTER", "SECTION", "BOOK", "PART", "FOOTNOTE", "Appendices", "* * *", "---", "===")


def resolve_quotes(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Items (item_id, quotes array<struct<doc, quote, occurrence>>) -> one row a quote with its span or error.

    (item_id, quote_ix, doc_id, start, end, error); errors in the order unknown_doc, ambiguous_quote, unresolved_quote. An empty
    quote is unresolved.
    """
    refs = items.select("item_id", F.posexplode("quotes").alias("quote_ix", "q")).select("item_id", F.col("quote_ix").cast("long").alias("quote_ix"), F.col("q.doc").alias("doc_id"), F.col("q.quote").alias("quote"), F.coalesce(F.col("q.occurrence"), F.lit(0)).alias("occurrence"))
    joined = refs.join(docs.select("doc_id", "text"), "doc_id", "left")
    # non-overlapping count, as counting does; all starts, as searching does
    count = F.when(F.col("text").isNotNull(), (F.length("text") - F.length(F.replace(F.col("text"), F.col("quote"), F.lit("")))) / F.nullif(F.length("quote"), F.lit(0))).cast("long")
    nth = nth_start("text", "quote", "occurrence")
    error = F.when(F.col("text").isNull(), "unknown_doc").when((F.col("occurrence") == 0) & (count > 1), "ambiguous_quote").when((nth == 0) | (F.length("quote") == 0), "unresolved_quote")
    return joined.select("item_id", "quote_ix", "doc_id", (nth - 1).cast("long").alias("start"), (nth - 1 + F.length("quote")).cast("long").alias("end"), error.alias("error"))


def nth_start(body: str, quote: str, nth: str):
    """1-based start of the nth (0-based) occurrence, overlapping ones counted; 0 if there are fewer."""
    step = f"(at, i) -> if(i > 0 and at = 0, 0, locate({quote}, {body}, at + 1))"
    return F.expr(f"aggregate(sequence(0, cast({nth} as int)), 0, {step})")


def judged_items(items: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(truth spans of accepted items, rejections (item_id, reason)). Items come in ``item_ix`` order; ids may repeat.

    A repeated id is rejected even if its first use was; otherwise an item's first failing quote decides.
    """
    w = Window.partitionBy("item_id").orderBy("item_ix")
    numbered = items.withColumn("nth", F.row_number().over(w))
    again = numbered.where("nth > 1").select("item_ix", "item_id", F.lit("duplicate_id").alias("reason"))
    once = numbered.where("nth = 1")
    resolved = resolve_quotes(once, docs)
    failed = resolved.where("error IS NOT NULL").groupBy("item_id").agg(F.min_by("error", "quote_ix").alias("reason"))
    rejected = again.unionByName(once.join(failed, "item_id").select("item_ix", "item_id", "reason"))
    truth = resolved.join(failed.select("item_id"), "item_id", "left_anti").select("item_id", F.col("quote_ix").alias("span_ix"), "doc_id", "start", "end")
    return truth, rejected


def short_quotes(items: DataFrame) -> DataFrame:
    """Items that break the form: no quote, or one under MIN_QUOTE characters once stripped."""
    return items.where((F.size("quotes") < 1) | F.exists("quotes", lambda q: F.length(text.strip(q["quote"])) < MIN_QUOTE)).select("item_id")


def locate_quotes(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """Quotes (item_id, quote) found verbatim in any document: (item_id, doc_id, start, end), the first place of each.

    Documents are found by the quotes' rarest windows (verbatim.holding). An empty quote is found nowhere.
    """
    spans = verbatim.holding(quotes, docs).withColumn("at", F.expr("locate(quote, text)"))
    return spans.select("item_id", "doc_id", (F.col("at") - 1).cast("long").alias("start"), (F.col("at") - 1 + F.length("quote")).cast("long").alias("end"))


def truth_spans(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, span_ix, doc_id, start, end) of located quotes; an item's spans are numbered in document order."""
    w = Window.partitionBy("item_id").orderBy("doc_id", "start")
    return locate_quotes(quotes, docs).select(F.col("item_id").alias("qid"), (F.row_number().over(w) - 1).cast("long").alias("span_ix"), "doc_id", "start", "end")


def truth_stats(truth: DataFrame) -> DataFrame:
    """One row: spans, documents, least, upper median and largest length, items with several spans."""
    w = Window.orderBy("len")
    lengths = truth.groupBy((F.col("end") - F.col("start")).alias("len")).agg(F.count(F.lit(1)).alias("c"))
    ranked = lengths.select("len", F.sum("c").over(w).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("n"))
    middle = ranked.agg(F.max("n").alias("n_spans"), F.min("len").alias("min_len"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("len"))).alias("median_len"), F.max("len").alias("max_len"))
    per = truth.groupBy("qid").agg(F.count(F.lit(1)).alias("c"))
    return middle.crossJoin(truth.agg(F.countDistinct("doc_id").alias("n_docs"))).crossJoin(per.agg(F.count_if(F.col("c") > 1).alias("n_multi")))


def passages(docs: DataFrame, low: int = 300, high: int = 700, blocks: int = 3, counted: bool = False) -> DataFrame:
    """(doc_id, start, end, passage): runs of one to three neighbouring paragraphs that read as prose evidence.

    A paragraph that begins with a fence opens or closes one and is dropped with all inside; so are structural ones. One map over
    the documents: no text is exchanged, and only runs of the right size become rows. With ``counted``, ``times`` says how often the
    document holds the passage.
    """

    def cut(body: str) -> list[tuple]:
        runs = splitters.paragraph_runs(body, low, high, blocks, SKIP_PREFIX)
        return [(a, b, body.count(body[a:b])) for a, b in runs] if counted else runs

    spans = chunking._mapped(docs, cut, [("times", "long", pa.int64())] if counted else []).withColumnRenamed("chunk_text", "passage")
    p = F.col("passage")
    bullets = F.size(F.filter(F.split(p, "\n"), lambda line: text.strip(line).startswith("*") | text.strip(line).startswith("-")))
    ends_ = F.regexp_count(p, F.lit(r"[.!?][\"')\]]*(\s|$)"))
    first = F.substring(p, 1, 1)
    return spans.where(((ends_ >= 2) | (bullets >= 3)) & ((first != F.lower(first)) | (bullets >= 3)))


def sampled_passages(candidates: DataFrame, docs: DataFrame, used_docs: DataFrame, used_quotes: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """One unused passage a document, from documents in a hashed order; only passages that their document holds once.

    Candidates that are counted bring this with them; without, they are joined with their documents' texts.
    """
    once = candidates.where("times = 1") if "times" in candidates.columns else candidates
    once = once.join(used_docs.select("doc_id").distinct(), "doc_id", "left_anti").join(used_quotes.select(F.col("quote").alias("passage")).distinct(), "passage", "left_anti")
    if "times" not in candidates.columns:
        once = once.join(docs.select("doc_id", "text"), "doc_id").where((F.length("text") - F.length(F.replace(F.col("text"), F.col("passage"), F.lit("")))) == F.length("passage"))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("start").cast("string"), F.col("end").cast("string")))
    w = Window.partitionBy("doc_id").orderBy(draw)
    per = once.select("doc_id", "start", "end", F.row_number().over(w).alias("nth")).where("nth = 1")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    return per.select("doc_id", "start", "end").orderBy(order, "doc_id").limit(count)


def evidence_text(truth: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, evidence): an item's span texts joined by a space, in span order."""
    cut = truth.join(docs.select("doc_id", "text"), "doc_id").select("qid", "span_ix", F.expr("substring(text, cast(start as int) + 1, cast(`end` - start as int))").alias("part"))
    return cut.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_ix", "part"))), lambda x: x["part"]), " ").alias("evidence"))
