"""The corpus pipeline: language identification, line dedup, near-duplicate removal, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. ``run`` writes what a stage returns as
Parquet into the shared folder and reads it again as the next stage's documents.

Cases: null and empty texts have no letters, so the first stage rejects them. Without any labelled row, it rejects only texts
without letters. A null id is linked with nothing and stays; rows that repeat an id are rows of their own. Columns that documents has
beyond the usual ones are carried to the last stage. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import byte_bpe, common, jaccard, langid, line_templates, mixing
from spanforge.llm.queries import held_out, vocabulary

#: Pooled probability below which no language is recognised: the best one must outweigh all others together.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those in which no learned language stands out."""
    model = langid.fit(docs, ~held_out(F.col("doc_id"), 3))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.filtered(docs, model, LEAST_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates from all documents but the first that holds them.

    A column n_chars of whole numbers is made to fit what is left, in its own type; all other columns stay as they are.
    """
    got = line_templates.dedup_lines(docs)
    kind = dict(docs.dtypes).get("n_chars")
    if kind in ("bigint", "int"):
        got = got.withColumn("n_chars", F.length("text").cast(kind))
    return got.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the least id (then text hash) of each group of near duplicates; rows without words or id stay."""
    rows = common.written(jaccard.jaccard_rows(docs))
    of, mark, h = (common.fresh(docs, name) for name in ("of", "mark", "h"))
    first = rows.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("f")).select(F.col("f.doc_id").alias(of), F.col("f.h").alias(mark))
    alone = rows.where("component IS NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias(of), F.col("h").alias(mark))
    kept = docs.withColumn(h, F.xxhash64("text")).join(first.unionByName(alone).distinct().hint("merge"), (F.col("doc_id") == F.col(of)) & (F.col(h) == F.col(mark)), "left_semi")
    return kept.dropDuplicates(["doc_id", h]).select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources does."""
    return mixing.materialised(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every row; ids are little-endian unsigned 32-bit integers."""
    got = byte_bpe.encode(docs, *vocabulary())
    return got.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("tokens", tokens)]

#: The trained network, the template tree and the byte merges cannot be expressed in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs)
    return docs
