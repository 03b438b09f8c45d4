"""The measuring plan: corpus x questions x grid -> runs, metric cells, ceilings and per-question records.

Chunks are built once a chunker and ranked rows once a configuration at the largest k; every k and tau comes from one
alignment. The loop is over the grid's few dozen configurations; it builds plans and reads no rows.
"""

from __future__ import annotations

import platform
import time
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators import alignment, chunking, retrieval
from spanforge.operators.metrics import KS, TAUS, metric_cube
from spanforge.session import settled


@dataclass(frozen=True)
class Config:
    """One configuration; its id names all that tells it apart."""

    chunker: str
    params: dict = field(default_factory=dict, hash=False)
    retriever: str = "bm25"
    reranked: bool = False

    @property
    def chunk_id(self) -> str:
        return "_".join([self.chunker, *(str(v) for v in self.params.values())])

    @property
    def config_id(self) -> str:
        return "_".join([self.chunk_id, self.retriever, *(["rerank"] if self.reranked else [])])


#: Fixed values, the usual grid: five chunkers, three retrievers, with and without the second stage.
CHUNKERS = (("fixed", {"size": 300, "overlap": 50}), ("fixed", {"size": 800, "overlap": 100}), ("recursive", {"size": 800, "overlap": 100}), ("heading", {"max_size": 1200, "min_size": 200}), ("semantic", {"percentile": 90.0}))
GRID = tuple(Config(c, p, r, rr) for c, p in CHUNKERS for r in ("bm25", "dense", "hybrid") for rr in (False, True))


@dataclass
class Experiment:
    """Fluent front: ``Experiment(docs, questions, truth).over(GRID)`` and then metrics, ceilings, records."""

    docs: DataFrame
    questions: DataFrame
    truth: DataFrame
    k: int = 10
    _chunks: dict[str, DataFrame] = field(default_factory=dict)
    _idf: dict[str, DataFrame] = field(default_factory=dict)
    _pools: dict[tuple, DataFrame] = field(default_factory=dict)
    _bodies: dict[tuple, DataFrame] = field(default_factory=dict)
    ranked: DataFrame | None = None
    configs: tuple[Config, ...] = ()
    build_seconds: dict[str, float] = field(default_factory=dict)
    latency: dict[str, list[float]] = field(default_factory=dict)

    def chunks(self, config: Config) -> DataFrame:
        if config.chunk_id not in self._chunks:
            built = chunking.build_chunks(self.docs, config.chunker, **config.params)
            # fixed windows are cut anew as cheaply as they are read; the other chunkers' rows are written once
            self._chunks[config.chunk_id] = retrieval.distinct_written(built if config.chunker == "fixed" else settled(built, "zstd"))
        return self._chunks[config.chunk_id]

    def idf(self, config: Config) -> DataFrame:
        """Token weights, once a chunker."""
        if config.chunk_id not in self._idf:
            self._idf[config.chunk_id] = retrieval.weights(self.chunks(config))
        return self._idf[config.chunk_id]

    def pool(self, config: Config, retriever: str) -> DataFrame:
        """The first rows of a retriever, once a chunker: shorter lists, fusion and the second stage all begin with them."""
        key = (config.chunk_id, retriever)
        if key not in self._pools:
            n = max(self.k, retrieval.POOL, retrieval.RERANK_POOL)
            self._pools[key] = settled(retrieval.retrieve(retriever, self.chunks(config), self.questions, n, idf=self.idf(config) if retriever == "bm25" else None))
        return self._pools[key]

    def bodies(self, config: Config) -> DataFrame:
        """The chunks that the second stage may read: those in the pools of this retriever, with their texts."""
        key = (config.chunk_id, config.retriever)
        if key not in self._bodies:
            names, spans = ("dense", "bm25") if config.retriever == "hybrid" else (config.retriever,), None
            for name in names:
                own = self.pool(config, name).select("doc_id", "start", "end")
                spans = own if spans is None else spans.unionByName(own)
            self._bodies[key] = settled(self.chunks(config).join(settled(spans.distinct()), ["doc_id", "start", "end"], "left_semi"))
        return self._bodies[key]

    def retrieved(self, config: Config) -> DataFrame:
        """The same rows as retrieval.retrieve, from the pools."""
        n = retrieval.RERANK_POOL if config.reranked else self.k
        if config.retriever == "hybrid":
            pools = [self.pool(config, name).where(F.col("rank") <= retrieval.POOL) for name in ("dense", "bm25")]
            rows = retrieval.fuse(*pools, n)
        else:
            rows = self.pool(config, config.retriever).where(F.col("rank") <= n)
        return retrieval.rerank(rows, self.bodies(config), self.questions, self.k) if config.reranked else rows

    def over(self, configs: tuple[Config, ...] = GRID) -> Experiment:
        """Ranks all questions under all configurations; rows carry config_id."""
        out = None
        for config in configs:
            rows = self.retrieved(config).withColumn("config_id", F.lit(config.config_id))
            out = rows if out is None else out.unionByName(rows)
        self.configs, self.ranked = configs, settled(out)
        return self

    def metrics(self, ks: tuple = KS, taus: tuple = TAUS) -> DataFrame:
        return metric_cube(self.ranked, self.truth, ks, taus, ("config_id",))

    def reach(self) -> DataFrame:
        """(chunk_id, qid, span_ix, best) for each chunker."""
        out = None
        for name, chunks in self._chunks.items():
            part = alignment.reachability(chunks, self.truth).withColumn("chunk_id", F.lit(name))
            out = part if out is None else out.unionByName(part)
        return out

    def ceilings(self, taus: tuple = TAUS) -> DataFrame:
        """(chunk_id, tau, n_spans, reachable)."""
        out = None
        for name, chunks in self._chunks.items():
            part = alignment.ceiling(alignment.reachability(chunks, self.truth), taus).withColumn("chunk_id", F.lit(name))
            out = part if out is None else out.unionByName(part)
        return out

    def records(self, config: Config) -> DataFrame:
        """Per-question records of one configuration."""
        ranked = self.ranked.where(F.col("config_id") == config.config_id)
        return alignment.per_question(alignment.align(ranked, self.truth), alignment.reachability(self.chunks(config), self.truth), self.k)

    def timed(self, config: Config, count: int = 5) -> list[float]:
        """Milliseconds of answering each of ``count`` single questions, the first by id, over chunks that are at hand.

        Build seconds of the chunks are taken first. Questions are asked one after the other, as a user would.
        """
        began = time.perf_counter()
        self.chunks(config).count()
        self.build_seconds[config.config_id] = time.perf_counter() - began
        taken = []
        for row in self.questions.select("qid").distinct().orderBy("qid").limit(count).collect():
            began = time.perf_counter()
            one = self.questions.where(F.col("qid") == row.qid)
            retrieval.retrieve(config.retriever, self.chunks(config), one, self.k, config.reranked, None if config.retriever == "dense" else self.idf(config)).collect()
            taken.append(1000 * (time.perf_counter() - began))
        self.latency[config.config_id] = taken
        return taken

    def manifests(self, corpus: str, qa_file: str, fingerprint: DataFrame, ks: tuple = KS, taus: tuple = TAUS) -> DataFrame:
        """One row a configuration in the shape of RUN_SCHEMA, with run_id, run_ts and env: what files.save_manifests writes.

        Measured times are null for configurations that ``timed`` has not run.
        """
        spark = self.docs.sparkSession
        text_map = lambda d: F.create_map(*[F.lit(str(x)) for pair in d.items() for x in pair]) if d else F.expr("cast(map() as map<string,string>)")
        name = F.concat(F.lit("k="), F.col("k").cast("string"), F.lit(",tau="), F.col("tau").cast("string"))
        cell = F.struct(F.col("tau").alias("threshold"), F.col("k").cast("int").alias("k"), *[F.col(c) for c in ("n_questions", "hit_at_k", "recall_at_k", "mrr", "ndcg_at_k", "soft_score", "mean_chars_retrieved", "unanswered")])
        cells = self.metrics(ks, taus).groupBy("config_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("key"), cell.alias("value"))))).alias("metrics"))
        oracle = self.ceilings(taus).groupBy("chunk_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("tau").cast("string").alias("key"), F.col("reachable").alias("value"))))).alias("oracle_reachability"))
        out = None
        for config in self.configs:
            ms = sorted(self.latency.get(config.config_id, []))
            size = self.chunks(config).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length(retrieval.indexed_text(self.chunks(config)))).alias("index_chars"))
            found = F.struct(F.col("rank").cast("int").alias("rank"), "reachable", "max_achievable", "best_coverage", "soft")
            per = self.records(config).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("qid").cast("string").alias("key"), found.alias("value"))))).alias("per_question"))
            own = F.struct(
                F.lit(config.config_id).alias("id"), F.lit(config.chunker).alias("chunker"), text_map(config.params).alias("chunker_params"), F.lit(config.retriever).alias("retriever"), text_map({}).alias("retriever_params"),
                F.lit("shared_tokens" if config.reranked else None).cast("string").alias("reranker"), F.lit(None if config.retriever == "bm25" else "hashed_bag").cast("string").alias("embed_model"),
            )
            rounded = lambda x: F.lit(None if x is None else round(x, 3)).cast("double")
            row = size.crossJoin(per).select(
                F.lit(config.config_id).alias("config_id"), F.lit(config.chunk_id).alias("chunk_id"), own.alias("config"), F.lit(corpus).alias("corpus"), F.lit(qa_file).alias("qa_file"), "n_chunks", "index_chars",
                rounded(self.build_seconds.get(config.config_id)).alias("build_seconds"), rounded(sum(ms) / len(ms) if ms else None).alias("query_ms_mean"), rounded(ms[int(0.9 * (len(ms) - 1))] if ms else None).alias("query_ms_p90"), "per_question",
            )
            out = row if out is None else out.unionByName(row)
        now = datetime.now(timezone.utc)
        env = text_map({"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version})
        out = out.crossJoin(F.broadcast(fingerprint.select(F.col("fingerprint").alias("corpus_fingerprint")))).join(cells, "config_id", "left").join(oracle, "chunk_id", "left")
        return out.withColumns({"run_id": F.concat(F.lit(now.strftime("%Y%m%dT%H%M%S_")), F.col("config_id")), "run_ts": F.lit(now.isoformat()), "env": env}).drop("config_id", "chunk_id")
