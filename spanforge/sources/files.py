"""Sources and sinks: text corpora, question files, run manifests, content-keyed caches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators.order import ranged

#: A question file: an array of items.
QA_SCHEMA = "id string, question string, answer string, quotes array<struct<doc:string,quote:string,occurrence:int>>, tags array<string>"
#: A run manifest, as far as rankings read it.
RUN_SCHEMA = (
    "config struct<id:string,chunker:string,chunker_params:map<string,string>,retriever:string,retriever_params:map<string,string>,reranker:string,embed_model:string>, corpus string, "
    "corpus_fingerprint string, qa_file string, n_chunks long, index_chars long, build_seconds double, query_ms_mean double, query_ms_p90 double, "
    "metrics map<string,struct<threshold:double,k:int,n_questions:long,hit_at_k:double,recall_at_k:double,mrr:double,ndcg_at_k:double,soft_score:double,mean_chars_retrieved:double,unanswered:long>>, "
    "oracle_reachability map<string,double>, per_question map<string,struct<rank:int,reachable:double,max_achievable:double,best_coverage:double,soft:double>>"
)


@dataclass(frozen=True)
class Corpus:
    """A named folder of texts."""

    name: str
    root: str
    pattern: str = "*.md"
    description: str = ""
    structure: str = ""


#: Bytes of a text file at most: a text is one value, which has to fit into a row.
FILE_BYTES = 256 << 20


def load_documents(spark: SparkSession, root: str, pattern: str = "*.md", most: int = FILE_BYTES) -> DataFrame:
    """(doc_id, path, text) of all files below root: whole, UTF-8, line ends untouched; ids are paths below root.

    A file over ``most`` bytes, or with bytes that are no UTF-8, fails the read by its name; so does an empty match. Sizes come from
    the listing, so a file that is too large is never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    large = files.where(F.col("length") > most).select("path", "length").orderBy("path").limit(3).collect()
    if large:
        raise ValueError(f"files over {most} bytes: " + ", ".join(f"{row.path} ({row.length})" for row in large))
    raw, base = files.where(F.col("length") <= most), "/" + root.split("://")[-1].strip("/") + "/"
    plain = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(plain), plain).otherwise(F.raise_error(F.concat(F.lit("no UTF-8: "), F.col("path"))))
    docs = raw.select(F.element_at(F.split("path", base, 2), -1).alias("doc_id"), "path", text.alias("text"))
    if docs.isEmpty():
        raise FileNotFoundError(f"no {pattern} below {root}")
    return docs


def load_corpus(spark: SparkSession, registry: dict[str, Corpus], name: str) -> DataFrame:
    if name not in registry:
        raise KeyError(f"unknown corpus {name!r}; known: {', '.join(sorted(registry))}")
    return load_documents(spark, registry[name].root, registry[name].pattern)


def fingerprint(docs: DataFrame) -> DataFrame:
    """(fingerprint, n): 16 hex digits over ids and texts in the order of ids as text, then of texts.

    The digest of a concatenation has no parts that could be computed apart, so one task hashes all rows; it holds one batch at a
    time, however large the corpus is. Rows come to it sorted, from ranges that many tasks have sorted. ``wide_fingerprint`` is
    dealt over tasks throughout.
    """
    rows, place = ranged(docs.select(F.col("doc_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t")), "i", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n = hashlib.sha256(), 0
        for batch in batches:
            n += batch.num_rows
            for row in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist(), strict=True):
                if row[0] is not None:  # a row without an id counts, as in the SQL, but gives nothing to the digest
                    digest.update("".join(row).encode())
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()[:16] if n else None], pa.string()), pa.array([n], pa.int64())], ["fingerprint", "n"])

    # one partition sorted by place: written ranges are merged from disk, none is held whole
    return rows.repartition(1).sortWithinPartitions(place).select("i", "t").mapInArrow(run, "fingerprint string, n long")


def wide_fingerprint(docs: DataFrame) -> DataFrame:
    """(fingerprint, n): sums of two 32-bit lanes of each row's digest, which any order and partitioning gives alike."""
    digest = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))), 256)
    lane = lambda a: F.sum(F.conv(F.substring(digest, a, 8), 16, 10).cast("long"))
    return docs.agg(F.concat_ws("-", lane(1).cast("string"), lane(9).cast("string")).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """(item_ix, item_id, question, answer, quotes, tags) of a JSON array of items."""
    rows = spark.read.schema(QA_SCHEMA).option("multiLine", True).json(path)
    return rows.select(F.monotonically_increasing_id().alias("item_ix"), F.col("id").alias("item_id"), "question", "answer", "quotes", F.coalesce("tags", F.expr("cast(array() as array<string>)")).alias("tags"))


def default_question_file(names: list[str], mark: str = "longspan") -> str:
    """The first file in order whose name holds the mark, else the first."""
    ordered = sorted(n for n in names if n.endswith(".json"))
    if not ordered:
        raise FileNotFoundError("no question file")
    return next((n for n in ordered if mark in n), ordered[0])


def save_run(run: DataFrame, root: str) -> None:
    """Appends rows of runs, partitioned as they are read: by corpus and question file."""
    run.write.mode("append").partitionBy("corpus", "qa_file").parquet(root)


def load_runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def load_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests from JSON, one file each; files without config, fingerprint and metrics are something else and left out."""
    rows = spark.read.schema(RUN_SCHEMA).option("multiLine", True).json(path).withColumn("run_id", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.where("config IS NOT NULL AND corpus_fingerprint IS NOT NULL AND metrics IS NOT NULL")


def manifest_cells(manifests: DataFrame) -> DataFrame:
    """(run_id, config_id, k, tau, ...): the metric map as rows."""
    cells = manifests.select("run_id", F.col("config.id").alias("config_id"), F.explode("metrics").alias("key", "m"))
    k, tau = F.regexp_extract("key", r"k=(\d+)", 1).cast("long"), F.regexp_extract("key", r"tau=([0-9.]+)", 1).cast("double")
    m = F.col("m")
    return cells.select("run_id", "config_id", k.alias("k"), tau.alias("tau"), m["hit_at_k"].alias("hit"), m["recall_at_k"].alias("recall"), m["mrr"].alias("mrr"), m["ndcg_at_k"].alias("ndcg"), m["soft_score"].alias("soft"), m["mean_chars_retrieved"].alias("chars"))


def metric_at(cells: DataFrame, name: str, k: int, tau: float) -> DataFrame:
    """(config_id, value): null, not 0, for a configuration that lacks the cell."""
    return cells.groupBy("config_id").agg(F.max(F.when((F.col("k") == k) & (F.col("tau") == tau), F.col(name))).alias("value"))


def content_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model), F.lit("\x00").cast("string"), text), 256)


def cache_misses(wanted: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(key, text) of distinct texts that the cache (key, ...) lacks."""
    keyed = wanted.select(content_key(model, F.col("text")).alias("key"), "text").where("text IS NOT NULL").dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")


def through_cache(wanted: DataFrame, cache: DataFrame, model: str, compute) -> tuple[DataFrame, DataFrame]:
    """(rows of the cache that serve, new rows to append); ``compute`` maps (key, text) to (key, value)."""
    missing = compute(cache_misses(wanted, cache, model))
    keys = wanted.select(content_key(model, F.col("text")).alias("key")).distinct()
    return cache.join(keys, "key", "left_semi").unionByName(missing), missing


def reply_key(model: str, prompt: Column, **options) -> Column:
    """The key of a model's reply: the digest of the request's body as JSON with sorted keys; options are its other fields."""
    fixed = {name: F.lit(json.dumps(value)) for name, value in {"model": model, **options}.items()}
    quoted = F.regexp_extract(F.to_json(F.struct(prompt.alias("p"))), r"(?s)^\{\"p\":(.*)\}$", 1)
    fields = {**fixed, "prompt": quoted}
    body = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(json.dumps(name) + ": "), fields[name]) for name in sorted(fields)]), F.lit("}"))
    return F.sha2(body, 256)


def through_replies(prompts: DataFrame, cache: DataFrame, model: str, call, **options) -> tuple[DataFrame, DataFrame]:
    """(prompts with their replies, new cache rows (key, reply) to append). ``call`` maps (key, prompt) to (key, reply) and sees
    each distinct prompt that the cache lacks once."""
    keyed = prompts.withColumn("key", reply_key(model, F.col("prompt"), **options))
    missing = call(keyed.select("key", "prompt").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti"))
    return keyed.join(cache.select("key", "reply").unionByName(missing.select("key", "reply")), "key", "left").drop("key"), missing


def save_manifests(runs: DataFrame, root: str) -> None:
    """Appends manifests (RUN_SCHEMA, run_ts) as JSON, below a folder for each corpus."""
    runs.withColumn("folder", F.col("corpus")).write.mode("append").partitionBy("folder").json(root)


def pending(configs: DataFrame, done: DataFrame, keys: tuple = ("config_id",)) -> DataFrame:
    """Configurations without a finished row: where a stopped run resumes."""
    return configs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def question_files_with_runs(authored: DataFrame, runs: DataFrame) -> DataFrame:
    """Authored files (corpus, qa_file) that some run used; all of a corpus's files if none was."""
    used = authored.join(runs.select("corpus", "qa_file").distinct(), ["corpus", "qa_file"], "left_semi")
    unused = authored.join(used.select("corpus").distinct(), "corpus", "left_anti")
    return used.unionByName(unused)
