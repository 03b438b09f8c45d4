"""Queries over the test tables, each with SQL that computes the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import alignment, cells, chunking, diagnosis, generation, metrics, postings, ranking, retrieval, study, truth
from spanforge.queries.splitting import recover_sql, recursive_sql
from spanforge.session import settled, shared_dir, written_once
from spanforge.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) as the scan splits it; dealt anew only where it gives fewer splits than there are cores (a small file is one
    row group), which no large table does."""
    docs, cores = table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(truth.truth_spans(quotes(spark, sf_dir), documents(spark, sf_dir)))


# ---------------------------------------------------------------- chunks

def fixed_sql(size: int, overlap: int, name: str = "chunks") -> str:
    step = size - overlap
    return f"""{name} AS (
        SELECT doc_id, s AS "start", least(s + {size}, n) AS "end", substr(text, s + 1, {size}) AS chunk_text
        FROM (SELECT doc_id, text, length(text) AS n, unnest(range(0, greatest(length(text), 1), {step})) AS s FROM documents WHERE text IS NOT NULL)
        WHERE (s = 0 OR s - {step} + {size} < n) AND regexp_matches(substr(text, s + 1, {size}), '\\S'))"""


@query(f"WITH {fixed_sql(800, 100)} SELECT * FROM chunks")
def chunk_fixed_800_100(spark, sf_dir):
    return chunking.fixed_chunks(documents(spark, sf_dir), 800, 100)


@query(f"WITH {fixed_sql(300, 50)} SELECT * FROM chunks")
def chunk_fixed_300_50(spark, sf_dir):
    return chunking.fixed_chunks(documents(spark, sf_dir), 300, 50)


@query(f"""WITH {fixed_sql(800, 100)}, bent AS (SELECT CASE doc_id % 7 WHEN 3 THEN -doc_id ELSE doc_id END AS doc_id, CASE doc_id % 7 WHEN 1 THEN "start" + 1 ELSE "start" END AS "start", "end",
        CASE doc_id % 7 WHEN 2 THEN chunk_text || '~' ELSE chunk_text END AS chunk_text FROM chunks)
    SELECT b.* FROM bent b LEFT JOIN documents d USING (doc_id) WHERE d.text IS NULL OR substr(d.text, (b."start" + 1)::BIGINT, (b."end" - b."start")::BIGINT) <> b.chunk_text""")
def bent_chunks(spark, sf_dir):
    """Chunks of which some are shifted, changed, or of no document: what the invariants find."""
    docs, kind = documents(spark, sf_dir), F.col("doc_id") % 7
    bent = chunking.fixed_chunks(docs, 800, 100).select(
        F.when(kind == 3, -F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), F.when(kind == 1, F.col("start") + 1).otherwise(F.col("start")).alias("start"), "end",
        F.when(kind == 2, F.concat("chunk_text", F.lit("~"))).otherwise(F.col("chunk_text")).alias("chunk_text"),
    )
    return chunking.invariant_violations(docs, bent)


@query(f"""WITH {fixed_sql(800, 100)} SELECT c.* FROM chunks c JOIN documents d USING (doc_id)
    WHERE substr(d.text, (c."start" + 1)::BIGINT, (c."end" - c."start")::BIGINT) <> c.chunk_text""")
def chunk_invariant_violations(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return chunking.invariant_violations(docs, chunking.fixed_chunks(docs, 800, 100))


@query("SELECT doc_id, 0::BIGINT AS n_bad FROM documents WHERE text IS NOT NULL")
def chunker_invariants(spark, sf_dir):
    """Violations of the slice invariant by any of the sequential chunkers, for every document."""
    docs = documents(spark, sf_dir)
    marked = markdown(spark, sf_dir)
    bad = None
    for chunks, source in ((chunking.recursive_chunks(docs), docs), (chunking.semantic_chunks(docs), docs), (chunking.heading_chunks(marked), marked)):
        found = chunking.invariant_violations(source, chunks.select("doc_id", "start", "end", "chunk_text")).select("doc_id")
        bad = found if bad is None else bad.unionByName(found)
    per = bad.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    return docs.select("doc_id").join(per, "doc_id", "left").select("doc_id", F.coalesce("c", F.lit(0)).cast("long").alias("n_bad"))


COVERAGE_SQL = """per AS (
        SELECT doc_id, sum(greatest(0, "end" - greatest("start", coalesce(prev, 0)))) AS covered
        FROM (SELECT doc_id, "start", "end", max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM chunks)
        GROUP BY doc_id),
    cover AS (SELECT d.doc_id, CASE WHEN length(d.text) = 0 THEN 1.0::DOUBLE ELSE coalesce(covered, 0)::DOUBLE / length(d.text) END AS coverage
        FROM documents d LEFT JOIN per USING (doc_id) WHERE d.text IS NOT NULL)"""


@query(f"WITH {fixed_sql(300, 50)}, {COVERAGE_SQL} SELECT doc_id, round(coverage, 9) AS coverage FROM cover")
def chunk_coverage(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return chunking.coverage(docs, chunking.fixed_chunks(docs, 300, 50)).select("doc_id", F.round("coverage", 9).alias("coverage"))


@query(f"""WITH {fixed_sql(800, 100)} SELECT doc_id, count(*)::BIGINT AS n, sum("end" - "start")::BIGINT AS n_chars FROM (SELECT DISTINCT doc_id, "start", "end" FROM (SELECT * FROM chunks UNION ALL SELECT * FROM chunks WHERE doc_id % 2 = 0)) GROUP BY 1""")
def distinct_spans(spark, sf_dir):
    """Chunks of which those of every second document are given twice, each span once."""
    chunks = chunking.fixed_chunks(documents(spark, sf_dir), 800, 100)
    once = retrieval.distinct_chunks(chunks.unionByName(chunks.where("doc_id % 2 = 0")))
    return once.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("n_chars"))


@query(f"""WITH {fixed_sql(800, 100)}, {COVERAGE_SQL},
    o AS (SELECT "end" - "start" AS len, row_number() OVER (ORDER BY "end" - "start") - 1 AS i, count(*) OVER () AS n FROM chunks)
    SELECT count(*)::BIGINT AS n_chunks, round(avg(len), 6) AS mean_len, max(CASE WHEN i = n // 10 THEN len END)::BIGINT AS p10, max(CASE WHEN i = 9 * n // 10 THEN len END)::BIGINT AS p90,
        (SELECT round(avg(coverage), 6) FROM cover) AS mean_coverage FROM o""")
def chunk_stats(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return chunking.chunk_stats(docs, chunking.fixed_chunks(docs, 800, 100))


@query(rf"""WITH RECURSIVE c_src AS (SELECT doc_id AS sid, text FROM documents WHERE text <> ''), {recursive_sql('c_', 800, 100)}
    SELECT sid AS doc_id, a AS "start", b AS "end", substr(text, a + 1, b - a) AS chunk_text FROM c_cut JOIN c_src USING (sid) WHERE regexp_matches(substr(text, a + 1, b - a), '\S')""")
def chunk_recursive(spark, sf_dir):
    return chunking.recursive_chunks(documents(spark, sf_dir))


@query(f"""WITH RECURSIVE o_src AS (SELECT doc_id AS sid, text FROM documents WHERE text IS NOT NULL),
    o_words AS (SELECT doc_id AS sid, unnest(string_split(text, ' ')) AS piece, generate_subscripts(string_split(text, ' '), 1) AS k FROM documents WHERE text IS NOT NULL),
    o_told AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY k) AS i, piece, k FROM o_words WHERE piece <> '' AND k % 5 = 0), {recover_sql('o_')}
    SELECT sid AS doc_id, k::BIGINT AS ix, a AS "start", b AS "end" FROM o_cut JOIN o_told USING (sid, i)""")
def recovered_offsets(spark, sf_dir):
    """Every fifth word of each document found again, none before the one ahead of it."""
    docs = documents(spark, sf_dir)
    words = docs.select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("ix", "piece")).select("doc_id", (F.col("ix") + 1).cast("long").alias("ix"), "piece")
    return chunking.recovered_offsets(words.where("ix % 5 = 0"), docs)


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with headings: every sixth line of level 1, other third ones of level 2."""
    head = lambda line, i: F.when(i % 6 == 0, F.concat(F.lit("# "), line)).when(i % 3 == 0, F.concat(F.lit("## "), line)).otherwise(line)
    return documents(spark, sf_dir).withColumn("text", F.array_join(F.transform(F.split("text", "\n", -1), head), "\n"))


def headings_sql(marked: bool) -> str:
    """Headings of the documents as ``markdown`` marks them, or as they stand."""
    return _HEADINGS if marked else _HEADINGS.replace("CASE WHEN i % 6 = 0 THEN '# ' || raw WHEN i % 3 = 0 THEN '## ' || raw ELSE raw END AS line", "raw AS line")


_HEADINGS = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
    marked AS (SELECT doc_id, i, CASE WHEN i % 6 = 0 THEN '# ' || raw WHEN i % 3 = 0 THEN '## ' || raw ELSE raw END AS line FROM lines),
    placed AS (SELECT doc_id, i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "start" FROM marked),
    heads AS (SELECT doc_id, "start", length(regexp_extract(line, '^(#+)', 1))::BIGINT AS level, trim(regexp_extract(line, '^#{1,6}[ \t]+(.+?)[ \t]*$', 1)) AS title FROM placed WHERE regexp_matches(line, '^#{1,6}[ \t]+[^ \t]')),
    up AS (SELECT *, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t1 FROM heads),
    headed AS (SELECT doc_id, "start", level, title, CASE WHEN level = 1 OR t1 IS NULL THEN title ELSE t1 || ' > ' || title END AS path FROM up)"""


HEADINGS = headings_sql(True)


@query(f"WITH {HEADINGS} SELECT * FROM headed")
def heading_paths(spark, sf_dir):
    return chunking.heading_lines(markdown(spark, sf_dir))


@query(rf"""WITH {HEADINGS}, body AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM marked GROUP BY 1),
    cuts AS (SELECT doc_id, 0::BIGINT AS "start", '' AS path, 0 AS nth FROM body UNION ALL SELECT doc_id, "start", path, 1 FROM headed),
    sections AS (SELECT c.doc_id, "start", lead("start", 1, length(text)) OVER (PARTITION BY c.doc_id ORDER BY "start", nth) AS "end", path, text FROM cuts c JOIN body b ON b.doc_id = c.doc_id),
    real AS (SELECT *, lag("end") OVER (PARTITION BY doc_id ORDER BY "start", "end") AS before FROM sections WHERE regexp_matches(substr(text, "start" + 1, "end" - "start"), '\S')),
    grouped AS (SELECT *, sum(CASE WHEN "end" - "start" < 200 AND before = "start" THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS g FROM real),
    joined AS (SELECT doc_id, min("start") AS a, max("end") AS b, min_by(path, "start") AS path, any_value(text) AS text FROM grouped GROUP BY doc_id, g)
    SELECT doc_id, a::BIGINT AS "start", b::BIGINT AS "end", substr(text, a + 1, b - a) AS chunk_text, path AS context_prefix, false AS sub_split FROM joined""")
def chunk_heading_sections(spark, sf_dir):
    """Sections of any length: headings, paths and the joining of runts, without the recursive split of long ones."""
    return chunking.heading_chunks(markdown(spark, sf_dir), max_size=1 << 30)


def heading_chunks_sql(headings: str) -> str:
    return rf"""WITH RECURSIVE {headings}, body AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM marked GROUP BY 1),
    cuts AS (SELECT doc_id, 0::BIGINT AS "start", '' AS path, 0 AS nth FROM body UNION ALL SELECT doc_id, "start", path, 1 FROM headed),
    sections AS (SELECT c.doc_id, "start", lead("start", 1, length(text)) OVER (PARTITION BY c.doc_id ORDER BY "start", nth) AS "end", path, text FROM cuts c JOIN body b ON b.doc_id = c.doc_id),
    real AS (SELECT row_number() OVER () AS sid, doc_id, "start", "end", path, substr(text, "start" + 1, "end" - "start") AS text FROM sections WHERE regexp_matches(substr(text, "start" + 1, "end" - "start"), '\S')),
    h_src AS (SELECT sid, text FROM real WHERE length(text) > 1200), {recursive_sql('h_', 1200, 100)},
    parts AS (SELECT doc_id, r."start" AS sec, i, r."start" + a AS "start", r."start" + b AS "end", path, true AS sub_split FROM real r JOIN h_cut USING (sid)
        UNION ALL SELECT doc_id, "start", 1, "start", "end", path, false FROM real WHERE length(text) <= 1200),
    after AS (SELECT *, lag("end") OVER (PARTITION BY doc_id ORDER BY sec, i) AS before FROM parts),
    grouped AS (SELECT *, sum(CASE WHEN "end" - "start" < 200 AND before = "start" THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY sec, i ROWS UNBOUNDED PRECEDING) AS g FROM after),
    joined AS (SELECT doc_id, arg_min("start", (sec, i)) AS a, arg_max("end", (sec, i)) AS b, arg_min(path, (sec, i)) AS path, arg_min(sub_split, (sec, i)) AS sub_split FROM grouped GROUP BY doc_id, g)
    SELECT doc_id, a::BIGINT AS "start", b::BIGINT AS "end", substr(text, a + 1, b - a) AS chunk_text, path AS context_prefix, sub_split FROM joined JOIN body USING (doc_id)"""


@query(heading_chunks_sql(HEADINGS))
def chunk_heading(spark, sf_dir):
    return chunking.heading_chunks(markdown(spark, sf_dir))


@query(f"""SELECT doc_id, "start", "end", md5(CASE WHEN context_prefix = '' THEN chunk_text ELSE context_prefix || chr(10) || chr(10) || chunk_text END) AS digest FROM ({heading_chunks_sql(HEADINGS)})""")
def indexed_texts(spark, sf_dir):
    """What is indexed of each heading chunk: its path, an empty line, and itself."""
    chunks = chunking.heading_chunks(markdown(spark, sf_dir))
    return chunks.select("doc_id", "start", "end", F.md5(retrieval.indexed_text(chunks)).alias("digest"))


LEX = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9_\\-.]*'), lambda x: lower(x))"

SENTENCES = r"""marked AS (SELECT doc_id, regexp_replace(text, '([.!?]["'')\]]*\s+)', '\1' || chr(63743), 'g') AS m FROM documents WHERE text <> ''),
    parts AS (SELECT doc_id, unnest(string_split(m, chr(63743))) AS part, generate_subscripts(string_split(m, chr(63743)), 1) AS i FROM marked),
    sentences AS (SELECT doc_id, (row_number() OVER w - 1)::BIGINT AS sentence_ix, (sum(length(part)) OVER w - length(part))::BIGINT AS "start", (sum(length(part)) OVER w)::BIGINT AS "end"
        FROM parts WHERE part <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {SENTENCES} SELECT * FROM sentences")
def sentence_spans(spark, sf_dir):
    return chunking.sentences(documents(spark, sf_dir))


@query(f"""WITH {SENTENCES}, wide AS (SELECT doc_id, sentence_ix, min("start") OVER w AS a, max("end") OVER w AS b FROM sentences WINDOW w AS (PARTITION BY doc_id ORDER BY sentence_ix ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
    SELECT doc_id, sentence_ix, substr(text, a + 1, b - a) AS window_text FROM wide JOIN documents USING (doc_id)""")
def buffered_sentences(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return chunking.buffered_windows(docs, chunking.sentences(docs), 1)


HASH_DIM = "((ascii(tok) * 131 + ascii(substr(tok, -1)) * 31 + length(tok) * 7 + CASE WHEN length(tok) > 1 THEN ascii(substr(tok, 2, 1)) ELSE 0 END * 17) % 64)"


@query(rf"""WITH RECURSIVE {SENTENCES},
    body AS (SELECT s.doc_id, sentence_ix AS i, text, substr(text, "start" + 1, "end" - "start") AS sentence FROM sentences s JOIN documents USING (doc_id)),
    bag AS (SELECT doc_id, i, {HASH_DIM} AS dim, count(*)::DOUBLE AS v FROM (SELECT doc_id, i, unnest({LEX.format('sentence')}) AS tok FROM body) GROUP BY ALL),
    norms AS (SELECT doc_id, i, sqrt(sum(v * v)) AS nv FROM bag GROUP BY ALL),
    dots AS (SELECT a.doc_id, b.i, sum(a.v * b.v) AS dot FROM bag a JOIN bag b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND a.dim = b.dim GROUP BY ALL),
    far AS (SELECT doc_id, i, round(1 - coalesce(dot / (x.nv * y.nv), 0), 9) AS f FROM body LEFT JOIN dots USING (doc_id, i) LEFT JOIN norms y USING (doc_id, i) LEFT JOIN norms x ON x.doc_id = body.doc_id AND x.i = body.i - 1 WHERE i > 0),
    bars AS (SELECT doc_id, quantile_cont(f, 0.9) AS bar FROM far GROUP BY 1 HAVING count(*) >= 2),
    edges AS (SELECT doc_id, list_append(list("start" ORDER BY sentence_ix), max("end")) AS e, count(*)::BIGINT AS n FROM sentences GROUP BY 1),
    marks AS (SELECT doc_id, 0::BIGINT AS m FROM edges UNION SELECT doc_id, n FROM edges UNION SELECT doc_id, i FROM far JOIN bars USING (doc_id) WHERE f >= bar),
    halves(doc_id, a, b, m) AS (
        SELECT doc_id, a, b, CASE WHEN b - a > 1 AND e[b + 1] - e[a + 1] > 1200 THEN len(list_filter(e, lambda x: x < e[a + 1] + (e[b + 1] - e[a + 1]) // 2)) END
        FROM (SELECT doc_id, m AS a, lead(m) OVER (PARTITION BY doc_id ORDER BY m) AS b FROM marks) JOIN edges USING (doc_id) WHERE b IS NOT NULL
        UNION ALL SELECT doc_id, a, b, CASE WHEN b - a > 1 AND e[b + 1] - e[a + 1] > 1200 THEN len(list_filter(e, lambda x: x < e[a + 1] + (e[b + 1] - e[a + 1]) // 2)) END
        FROM (SELECT doc_id, unnest([a, cut]) AS a, unnest([cut, b]) AS b FROM (
            SELECT doc_id, a, b, CASE WHEN (e[a + 1] + (e[b + 1] - e[a + 1]) // 2) - e[before + 1] <= e[after + 1] - (e[a + 1] + (e[b + 1] - e[a + 1]) // 2) THEN before ELSE after END AS cut
            FROM (SELECT *, greatest(after - 1, a + 1) AS before FROM (SELECT doc_id, a, b, least(greatest(m, a + 1), b - 1) AS after FROM halves WHERE m IS NOT NULL)) JOIN edges USING (doc_id))) JOIN edges USING (doc_id)),
    groups AS (SELECT doc_id, a, b, e[a + 1] AS "start", e[b + 1] AS "end" FROM halves JOIN edges USING (doc_id) WHERE m IS NULL),
    joined AS (SELECT *, sum(CASE WHEN "end" - "start" < 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a ROWS UNBOUNDED PRECEDING) + CASE WHEN first_value("end" - "start") OVER (PARTITION BY doc_id ORDER BY a) < 200 THEN 1 ELSE 0 END AS g FROM groups),
    spans AS (SELECT doc_id, min("start") AS "start", max("end") AS "end", (max(b) - min(a))::BIGINT AS n_sentences FROM joined GROUP BY doc_id, g)
    SELECT doc_id, "start"::BIGINT AS "start", "end"::BIGINT AS "end", substr(text, "start" + 1, "end" - "start") AS chunk_text, n_sentences FROM spans JOIN documents USING (doc_id) WHERE regexp_matches(substr(text, "start" + 1, "end" - "start"), '\S')""")
def chunk_semantic(spark, sf_dir):
    return chunking.semantic_chunks(documents(spark, sf_dir))


@query("""SELECT substr(sha256(string_agg(doc_id::VARCHAR || coalesce(text, ''), '' ORDER BY doc_id::VARCHAR)), 1, 16) AS fingerprint, count(*)::BIGINT AS n FROM documents""")
def corpus_fingerprint(spark, sf_dir):
    return files.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"))


# ---------------------------------------------------------------- tokens

ANS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


@query(f"WITH t AS (SELECT doc_id, unnest({LEX.format('text')}) AS tok FROM documents) SELECT doc_id, tok, count(*)::BIGINT AS tf FROM t GROUP BY 1, 2")
def tokens_bm25(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.explode(T.lexical_tokens(F.col("text"))).alias("tok")).groupBy("doc_id", "tok").agg(F.count(F.lit(1)).alias("tf"))


@query(f"SELECT conv_id, turn, len({ANS.format('text')})::BIGINT AS n_tokens, array_to_string({ANS.format('text')}, ' ') AS tokens FROM conversations")
def tokens_answer(spark, sf_dir):
    toks = T.answer_tokens(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(toks).cast("long").alias("n_tokens"), F.array_join(toks, " ").alias("tokens"))


# ---------------------------------------------------------------- truth

TRUTH = """found AS (SELECT b.item_id, d.doc_id, strpos(d.text, b.text) - 1 AS p, length(b.text) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    truth AS (SELECT item_id AS qid, (row_number() OVER (PARTITION BY item_id ORDER BY doc_id, p) - 1)::BIGINT AS span_ix, doc_id, p::BIGINT AS "start", (p + n)::BIGINT AS "end" FROM found)"""


@query(f"WITH {TRUTH} SELECT * FROM truth")
def quote_spans(spark, sf_dir):
    return spans(spark, sf_dir)


@query("""SELECT item_id, CASE WHEN EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) THEN 'accepted' ELSE 'unresolved_quote' END AS outcome FROM benchmark b""")
def quote_outcomes(spark, sf_dir):
    q = quotes(spark, sf_dir)
    found = spans(spark, sf_dir).select(F.col("qid").alias("item_id"), F.lit("accepted").alias("outcome")).distinct()
    return q.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("outcome", F.lit("unresolved_quote")).alias("outcome"))


@query("""SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) THEN 1.0::DOUBLE ELSE 0 END), 9) AS acceptance_rate, count(*)::BIGINT AS n FROM benchmark b""")
def quote_acceptance(spark, sf_dir):
    return quote_outcomes(spark, sf_dir).agg(F.round(F.avg((F.col("outcome") == "accepted").cast("double")), 9).alias("acceptance_rate"), F.count(F.lit(1)).alias("n"))


def authored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question items over the documents: a verbatim quote each, with each kind of defect by the id's rest modulo 6."""
    docs = table(spark, sf_dir, "documents").where("length(text) >= 60").select("doc_id", "text")
    kind = F.col("doc_id") % 6
    body = F.substring("text", 1, 40)
    quote = F.when(kind == 1, F.concat(body, F.lit("~"))).when(kind == 2, F.substring("text", 1, 1)).otherwise(body)
    ident = F.when(kind == 3, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    doc = F.when(kind == 4, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id"))
    occurrence = F.when(kind == 5, 7).otherwise(0)
    return docs.select(F.col("doc_id").alias("item_ix"), ident.alias("item_id"), F.array(F.struct(doc.alias("doc"), quote.alias("quote"), occurrence.alias("occurrence"))).alias("quotes"))


@query("""WITH raw AS (SELECT doc_id, doc_id % 6 AS kind, text, substr(text, 1, 40) AS body FROM documents WHERE length(text) >= 60),
    items AS (SELECT doc_id AS item_ix, CASE WHEN kind = 3 THEN doc_id - 1 ELSE doc_id END AS item_id, kind, text, CASE WHEN kind = 1 THEN body || '~' WHEN kind = 2 THEN substr(text, 1, 1) ELSE body END AS quote FROM raw),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY item_ix) AS nth FROM items),
    checked AS (SELECT item_ix, item_id, CASE WHEN nth > 1 THEN 'duplicate_id' WHEN kind = 4 THEN 'unknown_doc'
        WHEN kind <> 5 AND (length(text) - length(replace(text, quote, ''))) / length(quote) > 1 THEN 'ambiguous_quote'
        WHEN kind = 5 AND len(list_filter(range(1, length(text) - length(quote) + 2), lambda i: substr(text, i, length(quote)) = quote)) < 8 OR strpos(text, quote) = 0 THEN 'unresolved_quote' END AS reason FROM numbered)
    SELECT item_ix, item_id, reason FROM checked WHERE reason IS NOT NULL""")
def quote_rejections(spark, sf_dir):
    return truth.judged_items(authored_items(spark, sf_dir), documents(spark, sf_dir))[1]


@query(r"""WITH items AS (SELECT CASE WHEN doc_id % 6 = 3 THEN doc_id - 1 ELSE doc_id END AS item_id, CASE doc_id % 6 WHEN 1 THEN substr(text, 1, 40) || '~' WHEN 2 THEN substr(text, 1, 1) ELSE substr(text, 1, 40) END AS quote FROM documents WHERE length(text) >= 60)
    SELECT item_id FROM items WHERE length(regexp_replace(quote, '^\s+|\s+$', '', 'g')) < 25""")
def short_quote_items(spark, sf_dir):
    """Items that break a question file's form: a quote under 25 characters once stripped."""
    return truth.short_quotes(authored_items(spark, sf_dir))


@query(f"""WITH {TRUTH}, o AS (SELECT "end" - "start" AS len, row_number() OVER (ORDER BY "end" - "start") - 1 AS i, count(*) OVER () AS n FROM truth)
    SELECT count(*)::BIGINT AS n_spans, min(len)::BIGINT AS min_len, max(CASE WHEN i = n // 2 THEN len END)::BIGINT AS median_len, max(len)::BIGINT AS max_len,
        (SELECT count(DISTINCT doc_id) FROM truth)::BIGINT AS n_docs, (SELECT count(*) FROM (SELECT qid FROM truth GROUP BY qid HAVING count(*) > 1))::BIGINT AS n_multi FROM o""")
def truth_stats(spark, sf_dir):
    return truth.truth_stats(spans(spark, sf_dir))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with an empty line after each line."""
    return documents(spark, sf_dir).withColumn("text", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))


PASSAGES = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS ix FROM documents WHERE text IS NOT NULL),
    placed AS (SELECT *, coalesce(sum(length(part) + 2) OVER (PARTITION BY doc_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p, regexp_replace(part, '^\s+|\s+$', '', 'g') AS body FROM lines),
    kept AS (SELECT doc_id, ix, p + length(part) - length(regexp_replace(part, '^\s+', '')) AS a, body, row_number() OVER (PARTITION BY doc_id ORDER BY ix) AS nth FROM placed
        WHERE body <> '' AND NOT regexp_matches(body, '^(#|\||!!!|///|```|~~~|CHAPTER|SECTION|BOOK|PART|FOOTNOTE|Appendices|\* \* \*|---|===)')),
    docs2 AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
    runs AS (SELECT x.doc_id, x.a, y.a + length(y.body) AS b FROM kept x JOIN kept y ON x.doc_id = y.doc_id AND y.nth BETWEEN x.nth AND x.nth + 2),
    cut AS (SELECT doc_id, a::BIGINT AS "start", b::BIGINT AS "end", substr(text, (a + 1)::BIGINT, (b - a)::BIGINT) AS passage FROM runs JOIN docs2 USING (doc_id)),
    judged AS (SELECT *, len(regexp_extract_all(passage, '[.!?]["'')\]]*(\s|$)')) AS ends, len(list_filter(string_split(passage, chr(10)), lambda x: starts_with(trim(x), '*') OR starts_with(trim(x), '-'))) AS bullets FROM cut),
    passages AS (SELECT doc_id, "start", "end", passage FROM judged WHERE length(passage) > 300 AND length(passage) < 700 AND (ends >= 2 OR bullets >= 3) AND (substr(passage, 1, 1) <> lower(substr(passage, 1, 1)) OR bullets >= 3))"""


@query(f"WITH {PASSAGES} SELECT * FROM passages")
def candidate_passages(spark, sf_dir):
    return truth.passages(paragraphs(spark, sf_dir))


@query(f"""WITH {PASSAGES}, {TRUTH}, fresh AS (SELECT p.*, d.text FROM passages p JOIN docs2 d USING (doc_id) WHERE p.doc_id NOT IN (SELECT doc_id FROM truth) AND p.passage NOT IN (SELECT text FROM benchmark)
        AND length(d.text) - length(replace(d.text, p.passage, '')) = length(p.passage)),
    per AS (SELECT doc_id, "start", "end", row_number() OVER (PARTITION BY doc_id ORDER BY md5('0:' || doc_id || ':' || "start" || ':' || "end")) AS nth FROM fresh)
    SELECT doc_id, "start", "end" FROM per WHERE nth = 1 ORDER BY md5('0:' || doc_id), doc_id LIMIT 30""")
def sampled_passages(spark, sf_dir):
    docs = paragraphs(spark, sf_dir)
    return truth.sampled_passages(truth.passages(docs, counted=True), docs, spans(spark, sf_dir), quotes(spark, sf_dir), 30)


@query(f"""WITH {TRUTH} SELECT qid, string_agg(substr(d.text, t."start" + 1, t."end" - t."start"), ' ' ORDER BY span_ix) AS evidence FROM truth t JOIN documents d USING (doc_id) GROUP BY qid""")
def evidence_texts(spark, sf_dir):
    return truth.evidence_text(spans(spark, sf_dir), documents(spark, sf_dir))


# ---------------------------------------------------------------- overlap and ceilings

PAIRS = """pairs AS (SELECT t.qid, t.span_ix, c.doc_id, c."start", c."end", greatest(0, least(c."end", t."end") - greatest(c."start", t."start"))::BIGINT AS overlap_chars, t."end" - t."start" AS tl, c."end" - c."start" AS cl
        FROM chunks c JOIN truth t ON c.doc_id = t.doc_id AND c."start" < t."end" AND t."start" < c."end")"""
REACH = """reach AS (SELECT t.qid, t.span_ix, coalesce(max(round(p.overlap_chars::DOUBLE / p.tl, 9)), 0) AS best FROM truth t LEFT JOIN pairs p USING (qid, span_ix) GROUP BY 1, 2)"""
FIVE = (0.1, 0.3, 0.5, 0.7, 0.999)


@query(f"""WITH {fixed_sql(300, 50)}, {TRUTH}, {PAIRS} SELECT qid, span_ix, doc_id, "start", "end", overlap_chars, round(overlap_chars::DOUBLE / tl, 9) AS coverage, round(overlap_chars::DOUBLE / cl, 9) AS "precision",
        round(overlap_chars::DOUBLE / (cl + tl - overlap_chars), 9) AS iou FROM pairs""")
def overlap_modes(spark, sf_dir):
    return alignment.pair_scores(chunking.fixed_chunks(documents(spark, sf_dir), 300, 50), spans(spark, sf_dir))


@query(f"""WITH {fixed_sql(300, 50)}, {TRUTH}, {PAIRS}, {REACH} SELECT tau::DOUBLE AS tau, (SELECT count(*) FROM reach)::BIGINT AS n_spans,
        (SELECT round(coalesce(avg(CASE WHEN best >= tau THEN 1.0::DOUBLE ELSE 0 END), 0), 6) FROM reach) AS reachable FROM (SELECT unnest([{', '.join(map(str, FIVE))}]::DOUBLE[]) AS tau)""")
def oracle_reachability(spark, sf_dir):
    """Segmentation ceiling: chunks -> truth spans -> what the best chunk could reach."""
    docs = documents(spark, sf_dir)
    return alignment.ceiling(alignment.reachability(chunking.fixed_chunks(docs, 300, 50), truth.truth_spans(quotes(spark, sf_dir), docs)), FIVE)


@query(f"""WITH {fixed_sql(300, 50)}, {TRUTH}, {PAIRS}, {REACH} SELECT qid, round(avg(CASE WHEN best >= 0.5 THEN 1.0::DOUBLE ELSE 0 END), 4) AS reachable, round(max(best), 4) AS max_achievable FROM reach GROUP BY qid""")
def per_question_reach(spark, sf_dir):
    reach = alignment.reachability(chunking.fixed_chunks(documents(spark, sf_dir), 300, 50), spans(spark, sf_dir))
    return reach.groupBy("qid").agg(F.round(F.avg((F.col("best") >= 0.5).cast("double")), 4).alias("reachable"), F.round(F.max("best"), 4).alias("max_achievable"))


# ---------------------------------------------------------------- retrieval

class Run:
    """What several operators of one query read, each made once: spans, questions (the whole quotes), chunks, token weights, ranks."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def docs(self) -> DataFrame:
        return documents(self.spark, self.sf_dir)

    @cached_property
    def spans(self) -> DataFrame:
        return spans(self.spark, self.sf_dir)

    @cached_property
    def questions(self) -> DataFrame:
        """(qid, question) of all items whose evidence stands in some document."""
        found = self.spans.select(F.col("qid").alias("item_id")).distinct()
        return settled(quotes(self.spark, self.sf_dir).join(found, "item_id").select(F.col("item_id").alias("qid"), F.col("quote").alias("question")))

    @cached_property
    def chunks(self) -> DataFrame:
        """Not kept: cutting the text anew costs less than what a copy of it takes."""
        return chunking.fixed_chunks(self.docs, 300, 50)

    @cached_property
    def idf(self) -> DataFrame:
        return retrieval.weights(self.chunks)

    @cached_property
    def pool(self) -> DataFrame:
        """The lexical ranking, as deep as any query reads it."""
        return settled(retrieval.bm25(self.chunks, self.questions, retrieval.POOL, idf=self.idf))

    @cached_property
    def ranked(self) -> DataFrame:
        return settled(retrieval.bm25(self.chunks, self.questions, 10, idf=self.idf))

    @cached_property
    def reach(self) -> DataFrame:
        return settled(alignment.reachability(self.chunks, self.spans))

    @property
    def flow(self) -> tuple[DataFrame, DataFrame]:
        """(ranked, truth) of the lexical retriever."""
        return self.ranked, self.spans


def bm25_sql(mark: str = "", k: int = 50) -> str:
    """Common tables of the lexical ranking of chunks{mark} for all questions; qtok is shared."""
    return f"""post{mark} AS (SELECT doc_id, "start", "end", tok, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, "start", "end", len(toks) AS dl, unnest(toks) AS tok FROM (SELECT *, {LEX.format('chunk_text')} AS toks FROM chunks{mark})) GROUP BY ALL),
    stats{mark} AS (SELECT count(*) AS n, avg(len({LEX.format('chunk_text')})) AS avgdl FROM chunks{mark}),
    raw{mark} AS (SELECT tok, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post{mark}, stats{mark} GROUP BY tok, n),
    idf{mark} AS (SELECT tok, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw{mark}) ELSE r END AS idf FROM raw{mark}),
    hit{mark} AS (SELECT qid, doc_id, "start", "end", round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM post{mark} JOIN qtok USING (tok) JOIN idf{mark} USING (tok), stats{mark} GROUP BY 1, 2, 3, 4),
    scored{mark} AS (SELECT * FROM hit{mark} UNION ALL SELECT q.qid, f.doc_id, f."start", f."end", 0.0 FROM (SELECT DISTINCT qid FROM qtok) q, (SELECT doc_id, "start", "end" FROM chunks{mark} ORDER BY ALL LIMIT 200) f
        WHERE NOT EXISTS (SELECT 1 FROM hit{mark} h WHERE h.qid = q.qid AND h.doc_id = f.doc_id AND h."start" = f."start")),
    lexical{mark} AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, "start") AS rank, doc_id, "start", "end", score FROM scored{mark} QUALIFY rank <= {k})"""


QTOK = f"""qtok AS (SELECT qid, tok, count(*) AS qtf FROM (SELECT t.qid, unnest({LEX.format('b.text')}) AS tok FROM benchmark b JOIN (SELECT DISTINCT qid FROM truth) t ON b.item_id = t.qid) GROUP BY 1, 2)"""
BM25 = f"{QTOK}, {bm25_sql()}"
HEAD = f"WITH {fixed_sql(300, 50)}, {TRUTH}, {BM25}"
RANKED = 'ranked AS (SELECT * FROM lexical WHERE rank <= 10)'


@query(f"{HEAD} SELECT * FROM lexical WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return Run(spark, sf_dir).ranked


@query(f"{HEAD} SELECT * FROM lexical WHERE rank <= 10")
def bm25_index_topk(spark, sf_dir):
    """The same ranking from a written index, blocks below each question's bar unread."""
    run = Run(spark, sf_dir)
    index = postings.write(run.chunks, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    return postings.search(index, run.questions, 10).ranked


DIM = HASH_DIM
DENSE = f"""cvec AS (SELECT doc_id, "start", "end", {DIM} AS dim, sum(tf)::DOUBLE AS v FROM post GROUP BY ALL),
    cnorm AS (SELECT doc_id, "start", "end", sqrt(sum(v * v)) AS nv FROM cvec GROUP BY ALL),
    qvec AS (SELECT qid, {DIM} AS dim, sum(qtf)::DOUBLE AS v FROM qtok GROUP BY ALL),
    qnorm AS (SELECT qid, sqrt(sum(v * v)) AS nv FROM qvec GROUP BY qid),
    dots AS (SELECT qid, doc_id, "start", "end", sum(q.v * c.v) AS dot FROM qvec q JOIN cvec c USING (dim) GROUP BY 1, 2, 3, 4),
    densed AS (SELECT qid, doc_id, "start", "end", round(dot / (q.nv * c.nv), 9) AS score FROM dots JOIN cnorm c USING (doc_id, "start", "end") JOIN qnorm q USING (qid)),
    dense AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, "start", "end") AS rank, doc_id, "start", "end", score FROM densed QUALIFY rank <= 50)"""


@query(f"{HEAD}, {DENSE} SELECT * FROM dense WHERE rank <= 10")
def dense_chunks_topk(spark, sf_dir):
    run = Run(spark, sf_dir)
    return retrieval.dense(run.chunks, run.questions, 10)


FUSED = """pools AS (SELECT qid, doc_id, "start", "end", min(d) AS d, min(l) AS l FROM (SELECT qid, doc_id, "start", "end", rank AS d, NULL AS l FROM dense UNION ALL SELECT qid, doc_id, "start", "end", NULL, rank FROM lexical) GROUP BY ALL),
    fused AS (SELECT qid, doc_id, "start", "end", d, l, round(coalesce(1.0::DOUBLE / (60 + d), 0) + coalesce(1.0::DOUBLE / (60 + l), 0), 9) AS score FROM pools),
    hybrid AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, d NULLS LAST, l NULLS LAST) AS rank, doc_id, "start", "end", score FROM fused QUALIFY rank <= 10)"""


@query(f"{HEAD}, {DENSE}, {FUSED} SELECT * FROM hybrid")
def hybrid_rrf_topk(spark, sf_dir):
    run = Run(spark, sf_dir)
    return retrieval.hybrid(run.chunks, run.questions, 10, idf=run.idf)


RERANKED = """asked AS (SELECT qid, count(*) AS n FROM qtok GROUP BY qid),
    joint AS (SELECT l.qid, l.rank AS base, l.doc_id, l."start", l."end", round(count(p.tok)::DOUBLE / any_value(a.n), 9) AS score FROM lexical l JOIN asked a USING (qid) JOIN qtok q USING (qid)
        LEFT JOIN post p ON p.doc_id = l.doc_id AND p."start" = l."start" AND p."end" = l."end" AND p.tok = q.tok WHERE l.rank <= 30 GROUP BY 1, 2, 3, 4, 5),
    reranked AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, base) AS rank, doc_id, "start", "end", score FROM joint QUALIFY rank <= 10)"""


@query(f"{HEAD}, {RERANKED} SELECT * FROM reranked")
def lexical_rerank_topk(spark, sf_dir):
    run = Run(spark, sf_dir)
    return retrieval.rerank(run.pool, run.chunks, run.questions, 10)


NEAREST = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS qid, v.vec_id, round(list_dot_product(q.e, v.e), 9) AS score FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s QUALIFY rank <= 10"""


@query(NEAREST)
def dense_topk(spark, sf_dir):
    """The stated queries are the vectors whose id is divisible by 100, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return retrieval.nearest(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "vector"), 10, exclude_self=True)


@query(NEAREST)
def dense_cells_topk(spark, sf_dir):
    """The same rows from written cells; cells that cannot reach a query's bar are not read."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    held = cells.write(vectors, f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}")
    return cells.search(held, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "vector"), 10, exclude_self=True).ranked


# ---------------------------------------------------------------- alignment and metrics

ALIGNED = """aligned AS (SELECT r.qid, t.span_ix, r.rank, CASE WHEN r.doc_id = t.doc_id THEN greatest(0, least(r."end", t."end") - greatest(r."start", t."start")) ELSE 0 END::DOUBLE / (t."end" - t."start") AS overlap, r."end" - r."start" AS chunk_len
        FROM ranked r JOIN truth t USING (qid)),
    best AS (SELECT qid, rank, max(overlap) AS score FROM aligned GROUP BY 1, 2)"""
FLOW = f"{HEAD}, {RANKED}, {ALIGNED}"


@query(f"{FLOW} SELECT qid, span_ix, rank, round(overlap, 9) AS overlap, chunk_len FROM aligned")
def aligned_matrix(spark, sf_dir):
    return alignment.align(*Run(spark, sf_dir).flow).withColumn("overlap", F.round("overlap", 9))


@query(f"{FLOW} SELECT qid, min(CASE WHEN score >= 0.5 THEN rank END) AS first_rank FROM best GROUP BY qid")
def first_hit_rank(spark, sf_dir):
    return alignment.first_hits(alignment.align(*Run(spark, sf_dir).flow), 10, 0.5)


@query(f"""{FLOW}, sb AS (SELECT qid, span_ix, max(overlap) AS b FROM aligned WHERE rank <= 5 GROUP BY 1, 2)
    SELECT qid, round(avg(CASE WHEN b >= 0.5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS span_recall, round(avg(b), 9) AS soft_score FROM sb GROUP BY qid""")
def span_recall_soft(spark, sf_dir):
    return alignment.span_recall(alignment.align(*Run(spark, sf_dir).flow), 5, 0.5).select("qid", F.round("span_recall", 9).alias("span_recall"), F.round("soft_score", 9).alias("soft_score"))


@query(f"""{FLOW} SELECT qid, sum(CASE WHEN rank <= 5 THEN "end" - "start" ELSE 0 END)::BIGINT AS chars FROM ranked GROUP BY qid""")
def chars_retrieved(spark, sf_dir):
    return alignment.chars_retrieved(Run(spark, sf_dir).ranked, 5)


NDCG = """placed AS (SELECT qid, rank, score, k, row_number() OVER (PARTITION BY qid, k ORDER BY rank) AS h, row_number() OVER (PARTITION BY qid, k ORDER BY score DESC, rank) AS i FROM best, (SELECT unnest([1, 3, 5, 10]) AS k) WHERE rank <= k),
    gains AS (SELECT qid, k, CASE WHEN sum(score / log2(i + 1)) > 0 THEN round(sum(score / log2(h + 1)) / sum(score / log2(i + 1)), 9) ELSE 0 END AS ndcg FROM placed GROUP BY 1, 2)"""


@query(f"{FLOW}, {NDCG} SELECT qid, ndcg::DOUBLE AS ndcg FROM gains WHERE k = 10")
def ndcg_at_10(spark, sf_dir):
    return alignment.ndcg(alignment.align(*Run(spark, sf_dir).flow), 10)


CUBE = f"""cells AS (SELECT k::BIGINT AS k, tau::DOUBLE AS tau FROM (SELECT unnest([1, 3, 5, 10]) AS k), (SELECT unnest([0.1, 0.3, 0.5, 0.7]) AS tau)),
    firsts AS (SELECT qid, k, tau, min(CASE WHEN score >= tau THEN rank END) AS first FROM best, cells WHERE rank <= k GROUP BY 1, 2, 3),
    sb AS (SELECT qid, span_ix, k, tau, max(CASE WHEN rank <= k THEN overlap ELSE 0 END) AS b FROM aligned, cells GROUP BY 1, 2, 3, 4),
    recalls AS (SELECT qid, k, tau, avg(CASE WHEN b >= tau THEN 1.0::DOUBLE ELSE 0 END) AS recall, avg(b) AS soft FROM sb GROUP BY 1, 2, 3),
    chars AS (SELECT qid, k, tau, sum("end" - "start") AS chars FROM ranked, cells WHERE rank <= k GROUP BY 1, 2, 3),
    {NDCG}"""


@query(f"""{FLOW}, {CUBE} SELECT f.k, f.tau, count(*)::BIGINT AS n_questions, round(avg(CASE WHEN first IS NULL THEN 0.0::DOUBLE ELSE 1 END), 9) AS hit_at_k, round(avg(recall), 9) AS recall_at_k,
        round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mrr, round(avg(ndcg), 9)::DOUBLE AS ndcg_at_k, round(avg(soft), 9) AS soft_score, round(avg(chars), 9) AS mean_chars_retrieved, count(*) FILTER (WHERE first IS NULL)::BIGINT AS unanswered
    FROM firsts f JOIN recalls USING (qid, k, tau) JOIN chars USING (qid, k, tau) JOIN gains g ON g.qid = f.qid AND g.k = f.k GROUP BY 1, 2""")
def metric_cube(spark, sf_dir):
    return metrics.metric_cube(*Run(spark, sf_dir).flow)


GAPS = f"{HEAD}, ranked AS (SELECT * FROM lexical WHERE rank <= 10 AND qid % 3 <> 0), {ALIGNED}"


@query(f"""{GAPS}, {CUBE}, every AS (SELECT qid, span_ix, k, tau FROM truth, cells), q AS (SELECT DISTINCT qid, k, tau FROM every),
        rec AS (SELECT e.qid, e.k, e.tau, avg(CASE WHEN coalesce(s.b, 0) >= e.tau THEN 1.0::DOUBLE ELSE 0 END) AS recall, avg(coalesce(s.b, 0)) AS soft FROM every e LEFT JOIN sb s USING (qid, span_ix, k, tau) GROUP BY 1, 2, 3)
    SELECT q.k, q.tau, count(*)::BIGINT AS n_questions, round(avg(CASE WHEN first IS NULL THEN 0.0::DOUBLE ELSE 1 END), 9) AS hit_at_k, round(avg(recall), 9) AS recall_at_k, round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mrr,
        round(avg(coalesce(ndcg, 0)), 9)::DOUBLE AS ndcg_at_k, round(avg(soft), 9) AS soft_score, round(avg(coalesce(chars, 0)), 9) AS mean_chars_retrieved, count(*) FILTER (WHERE first IS NULL)::BIGINT AS unanswered
    FROM q JOIN rec USING (qid, k, tau) LEFT JOIN firsts USING (qid, k, tau) LEFT JOIN chars USING (qid, k, tau) LEFT JOIN gains USING (qid, k) GROUP BY 1, 2""")
def metric_cube_gaps(spark, sf_dir):
    """A third of the questions retrieve nothing: they count as unanswered, with recall and gain 0."""
    ranked, spans_ = Run(spark, sf_dir).flow
    return metrics.metric_cube(ranked.where("qid % 3 <> 0"), spans_)


RECORDS = f"""{PAIRS}, {REACH}, first5 AS (SELECT qid, min(CASE WHEN score >= 0.5 THEN rank END) AS rank FROM best GROUP BY qid),
    sb10 AS (SELECT qid, span_ix, max(overlap) AS b FROM aligned GROUP BY 1, 2),
    records AS (SELECT f.qid, f.rank, round(r.reachable, 4) AS reachable, round(r.m, 4) AS max_achievable, round(s.b, 4) AS best_coverage, round(s.soft, 4) AS soft FROM first5 f
        JOIN (SELECT qid, avg(CASE WHEN best >= 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS reachable, max(best) AS m FROM reach GROUP BY qid) r USING (qid) JOIN (SELECT qid, max(b) AS b, avg(b) AS soft FROM sb10 GROUP BY qid) s USING (qid))"""


def records(run: Run) -> DataFrame:
    ranked = run.pool.where(F.col("rank") <= 10)
    return alignment.per_question(alignment.align(ranked, run.spans), run.reach)


@query(f"{FLOW}, {RECORDS} SELECT * FROM records")
def per_question_records(spark, sf_dir):
    return records(Run(spark, sf_dir))


BOOT = """firsts10 AS (SELECT qid, coalesce(1.0::DOUBLE / min(CASE WHEN score >= 0.5 THEN rank END), 0) AS rr FROM best GROUP BY qid),
    arr AS (SELECT list(rr ORDER BY qid) AS vs, count(*) AS n FROM firsts10),
    draws AS (SELECT it, round(avg(vs[1 + (('0x' || substr(md5('0:' || it || ':' || slot), 1, 8))::BIGINT % n)]), 9) AS m FROM arr, range(0, 2000) t(it), (SELECT unnest(range(0, n)) AS slot FROM arr) GROUP BY it),
    placed_ AS (SELECT m, row_number() OVER (ORDER BY m, it) - 1 AS p FROM draws)"""


@query(f"{FLOW}, {BOOT} SELECT (SELECT n FROM arr)::BIGINT AS n, (SELECT round(avg(rr), 9) FROM firsts10) AS point, max(CASE WHEN p = 49 THEN m END) AS low, max(CASE WHEN p = 1949 THEN m END) AS high FROM placed_")
def bootstrap_mrr_ci(spark, sf_dir):
    """2,000 resamples of the questions; places 49 and 1949 bound 95 per cent."""
    hits = alignment.first_hits(alignment.align(*Run(spark, sf_dir).flow), 10, 0.5)
    return metrics.bootstrap(hits.withColumn("rr", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), "rr")


@query(f"""WITH d AS (SELECT o_orderpriority, floor(o_totalprice)::DOUBLE AS v, block, md5('0:' || block || ':' || o_orderkey) AS g FROM orders, range(0, 100) t(block) WHERE o_totalprice IS NOT NULL),
    u AS (SELECT o_orderpriority, v, 4 * block + j AS it, ('0x' || substr(g, 8 * j + 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d, range(0, 4) y(j)),
    w AS (SELECT o_orderpriority, it, v, {' + '.join(f'(u >= {p})::BIGINT' for p in metrics.POISSON)} AS w FROM u),
    m AS (SELECT o_orderpriority, it, round(sum(w * v) / sum(w), 9) AS m FROM w GROUP BY 1, 2),
    placed AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY m) - 1 AS place FROM m)
    SELECT o_orderpriority, (SELECT count(*) FROM orders o WHERE o.o_orderpriority = p.o_orderpriority AND o_totalprice IS NOT NULL)::BIGINT AS n, (SELECT round(avg(floor(o_totalprice)::DOUBLE), 9) FROM orders o WHERE o.o_orderpriority = p.o_orderpriority) AS point,
        max(CASE WHEN place = 9 THEN m END) AS low, max(CASE WHEN place = 389 THEN m END) AS high FROM placed p GROUP BY 1""")
def bootstrap_poisson(spark, sf_dir):
    """400 Poisson resamples of all orders of each priority."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_orderkey").alias("qid"), F.floor("o_totalprice").alias("v"))
    return metrics.poisson_bootstrap(orders, "v", ("o_orderpriority",), 400)


@query("""WITH c AS (SELECT p_brand AS config, avg(p_retailprice) - 2 * stddev_pop(p_retailprice) / sqrt(count(*)) AS low, avg(p_retailprice) + 2 * stddev_pop(p_retailprice) / sqrt(count(*)) AS high FROM part GROUP BY 1)
    SELECT a.config AS a, b.config AS b, NOT (a.high < b.low OR b.high < a.low) AS tied FROM c a JOIN c b ON a.config < b.config""")
def ci_indistinguishable(spark, sf_dir):
    half = 2 * F.stddev_pop("p_retailprice") / F.sqrt(F.count(F.lit(1)))
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("config")).agg((F.avg("p_retailprice") - half).alias("low"), (F.avg("p_retailprice") + half).alias("high"))
    return metrics.indistinguishable(rows, "config")


@query("""SELECT o_custkey, count(*)::BIGINT AS n, round(avg(o_totalprice), 6) AS point, round(avg(o_totalprice), 6) AS low, round(avg(o_totalprice), 6) AS high FROM orders GROUP BY 1 HAVING count(*) < 6""")
def bootstrap_degenerate(spark, sf_dir):
    """Customers of less than six orders: no resampling, the interval is the mean."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("qid"), F.col("o_totalprice").cast("double").alias("v"))
    got = metrics.bootstrap(rows, "v", ("o_custkey",), iterations=40, least=6).where("n < 6")
    return got.select("o_custkey", "n", *[F.round(c, 6).alias(c) for c in ("point", "low", "high")])


@query("""WITH x AS (SELECT event_type, value, CASE WHEN event_type = 'click' THEN 1.0 ELSE user_id END::DOUBLE AS u FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL)
    SELECT event_type, count(*)::BIGINT AS n, CASE WHEN count(*) >= 3 AND stddev_pop(value) * stddev_pop(u) > 0 THEN round(covar_pop(value, u) / (stddev_pop(value) * stddev_pop(u)), 9) END AS r FROM x GROUP BY 1""")
def pearson_guarded(spark, sf_dir):
    """One of the event types has a constant series, whose correlation is null."""
    rows = table(spark, sf_dir, "events").withColumn("u", F.when(F.col("event_type") == "click", F.lit(1.0)).otherwise(F.col("user_id").cast("double")))
    return metrics.correlation(rows, "value", "u", ("event_type",))


@query("SELECT p_type AS family, round(avg(p_retailprice), 9) AS mean_value FROM part GROUP BY 1")
def family_means(spark, sf_dir):
    return metrics.family_spread(table(spark, sf_dir, "part").withColumnRenamed("p_type", "family"), "family", "p_retailprice")[0]


@query("SELECT round(max(m) - min(m), 9) AS spread FROM (SELECT p_type, avg(p_retailprice) AS m FROM part GROUP BY 1) WHERE NOT starts_with(p_type, 'STANDARD')")
def family_spread(spark, sf_dir):
    return metrics.family_spread(table(spark, sf_dir, "part").withColumnRenamed("p_type", "family"), "family", "p_retailprice", "STANDARD")[1]


# ---------------------------------------------------------------- candidates

#: A candidate for each part: axes from its price, size and name.
CANDIDATES = """cand AS (SELECT p_partkey AS config_id, p_brand || '/' || p_type AS label, p_brand AS chunker, (p_size % 3)::VARCHAR AS params, p_type AS retriever, CASE WHEN p_partkey % 2 = 0 THEN 'rr' END AS reranker,
        p_size::BIGINT AS n_chunks, round((p_partkey * 7919 % 1000) / 1000.0, 9)::DOUBLE AS mrr, round((p_partkey * 104729 % 1000) / 1000.0, 9)::DOUBLE AS hit, round((p_partkey * 1299709 % 1000) / 1000.0, 9)::DOUBLE AS ndcg,
        round(p_retailprice / 10, 2) AS latency_ms, (p_size * 100)::DOUBLE AS chars FROM part),
    cq AS (SELECT *, round(0.5 * mrr + 0.3 * ndcg + 0.2 * hit, 9) AS quality FROM cand)"""


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rest = lambda m: F.round(F.col("p_partkey") * m % 1000 / 1000.0, 9)
    rows = p.select(
        F.col("p_partkey").alias("config_id"), F.concat_ws("/", "p_brand", "p_type").alias("label"), F.col("p_brand").alias("chunker"), (F.col("p_size") % 3).cast("string").alias("params"), F.col("p_type").alias("retriever"),
        F.when(F.col("p_partkey") % 2 == 0, "rr").alias("reranker"), F.col("p_size").cast("long").alias("n_chunks"), rest(7919).alias("mrr"), rest(104729).alias("hit"), rest(1299709).alias("ndcg"),
        F.round(F.col("p_retailprice") / 10, 2).alias("latency_ms"), (F.col("p_size") * 100).cast("double").alias("chars"),
    )
    return rows.withColumn("quality", F.round(ranking.quality(), 9))


@query(f"WITH {CANDIDATES} SELECT config_id, quality FROM cq")
def quality_score(spark, sf_dir):
    return candidate_rows(spark, sf_dir).select("config_id", "quality")


@query(f"""WITH {CANDIDATES} SELECT config_id, quality, latency_ms, chars FROM cq c WHERE NOT EXISTS (SELECT 1 FROM cq o WHERE o.quality >= c.quality AND o.latency_ms <= c.latency_ms AND o.chars <= c.chars
        AND (o.quality > c.quality OR o.latency_ms < c.latency_ms OR o.chars < c.chars))""")
def pareto_frontier(spark, sf_dir):
    return ranking.pareto(candidate_rows(spark, sf_dir)).select("config_id", "quality", "latency_ms", "chars")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem l WHERE l_extendedprice = (SELECT max(l_extendedprice) FROM lineitem o WHERE o.l_quantity = l.l_quantity)
    AND l_extendedprice > coalesce((SELECT max(l_extendedprice) FROM lineitem o WHERE o.l_quantity < l.l_quantity), -1)""")
def skyline_two_axes(spark, sf_dir):
    """Rows that no row beats on price up and quantity down, by one sort: the frontier of a large table."""
    return ranking.skyline(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


def weighted_sql(quality: str, latency: str, context: str) -> str:
    return f"""WITH {CANDIDATES}, b AS (SELECT min(quality) q0, max(quality) q1, min(log10(greatest(latency_ms, 0.01))) l0, max(log10(greatest(latency_ms, 0.01))) l1, min(chars) c0, max(chars) c1 FROM cq),
    s AS (SELECT config_id, round({quality} * (quality - q0) / (q1 - q0) + {latency} * (1 - (log10(greatest(latency_ms, 0.01)) - l0) / (l1 - l0)) + {context} * (1 - (chars - c0) / (c1 - c0)), 9) AS score FROM cq, b)
    SELECT config_id, score, row_number() OVER (ORDER BY score DESC, config_id) AS position FROM s"""


@query(weighted_sql("0.7", "0.2", "0.1"))
def weighted_rank(spark, sf_dir):
    return ranking.weighted(candidate_rows(spark, sf_dir)).select("config_id", "score", "position")


@query(weighted_sql("0.375::DOUBLE", "0.5::DOUBLE", "0.125::DOUBLE"))
def weighted_rank_normalised(spark, sf_dir):
    """Weights 3, 4 and 1 count by their shares of eight."""
    return ranking.weighted(candidate_rows(spark, sf_dir), 3.0, 4.0, 1.0, normalise=True).select("config_id", "score", "position")


BEST = f"WITH {CANDIDATES}, win AS (SELECT * FROM cq ORDER BY quality DESC, config_id LIMIT 1)"


def winner(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("quality").desc(), "config_id").limit(1)


@query(f"""{BEST}, alt AS (SELECT CASE WHEN (c.chunker, c.params) <> (w.chunker, w.params) AND c.retriever = w.retriever THEN 'chunker' WHEN (c.chunker, c.params) = (w.chunker, w.params) AND c.retriever <> w.retriever THEN 'retriever' END AS axis,
        c.config_id, c.label, c.mrr, w.mrr - c.mrr AS delta FROM cq c, win w WHERE c.config_id <> w.config_id AND (c.reranker IS NULL) = (w.reranker IS NULL))
    SELECT axis, config_id, label, mrr, round(delta, 9) AS delta FROM alt WHERE axis IS NOT NULL QUALIFY row_number() OVER (PARTITION BY axis ORDER BY mrr DESC, config_id) = 1""")
def best_varying_axis(spark, sf_dir):
    rows = candidate_rows(spark, sf_dir)
    return ranking.best_varying(rows, winner(rows))


@query(f"""WITH {CANDIDATES} SELECT a.config_id, b.config_id AS twin_id, round(a.mrr - b.mrr, 9) AS d_mrr, round(a.latency_ms - b.latency_ms, 9) AS d_ms,
        CASE WHEN a.latency_ms <> b.latency_ms THEN round((a.mrr - b.mrr) * 1000 / (a.latency_ms - b.latency_ms), 9) END AS mrr_per_s
    FROM cq a JOIN cq b USING (chunker, params, retriever) WHERE a.reranker IS NOT NULL AND b.reranker IS NULL""")
def reranker_twin(spark, sf_dir):
    return ranking.reranker_twins(candidate_rows(spark, sf_dir))


@query(f"""{BEST}, alt AS (SELECT CASE WHEN (c.chunker, c.params) <> (w.chunker, w.params) AND c.retriever = w.retriever THEN 'chunker' WHEN (c.chunker, c.params) = (w.chunker, w.params) AND c.retriever <> w.retriever THEN 'retriever' END AS axis,
        c.config_id, c.label, c.mrr, round(w.mrr - c.mrr, 9) AS delta FROM cq c, win w WHERE c.config_id <> w.config_id AND (c.reranker IS NULL) = (w.reranker IS NULL)),
    first_alt AS (SELECT * FROM alt WHERE axis IS NOT NULL QUALIFY row_number() OVER (PARTITION BY axis ORDER BY mrr DESC, config_id) = 1),
    twins AS (SELECT a.config_id, b.config_id AS twin_id, round(a.mrr - b.mrr, 9) AS d_mrr, round(a.latency_ms - b.latency_ms, 9) AS d_ms FROM cq a JOIN cq b USING (chunker, params, retriever) WHERE a.reranker IS NOT NULL AND b.reranker IS NULL)
    SELECT 0::BIGINT AS line_no, 'RECOMMENDED: ' || label AS line FROM win
    UNION ALL SELECT 1, printf('Quality  MRR %.3f | hit %.3f | nDCG %.3f', mrr, hit, ndcg) FROM win
    UNION ALL SELECT 2, printf('Cost     %.1f ms/query | %.0f chars of context | %d chunks indexed', latency_ms, chars, n_chunks) FROM win
    UNION ALL SELECT CASE axis WHEN 'chunker' THEN 3 ELSE 4 END, printf('%s: %s the best alternative (%s) by %.3f MRR, all else equal', axis, CASE WHEN delta >= 0 THEN 'outperforms' ELSE 'trails' END, label, abs(delta)) FROM first_alt
    UNION ALL SELECT 5, CASE WHEN t.twin_id = w.config_id THEN 'Rejected: ' ELSE '' END || printf('Reranking: %+.3f MRR for %+.0f ms/query', d_mrr, d_ms) FROM twins t JOIN win w ON t.config_id = w.config_id OR t.twin_id = w.config_id
    UNION ALL SELECT 6, printf('WARNING: only %.1f%% of evidence spans are within reach at the strictest threshold', hit * 100) FROM win WHERE hit < 0.99""")
def explanation_lines(spark, sf_dir):
    rows = candidate_rows(spark, sf_dir)
    ceilings = rows.select("config_id", F.lit(0.999).alias("tau"), F.col("hit").alias("reachable"))
    return ranking.explanation(rows, winner(rows), ceilings)


@query("""SELECT c_nationkey::VARCHAR AS config_id, c_custkey AS run_id, c_acctbal AS mrr FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) = 1""")
def latest_run_per_config(spark, sf_dir):
    """Customers as runs of their nation's configuration, the balance as their time."""
    runs = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("config_id"), F.col("c_custkey").alias("run_id"), F.col("c_acctbal").alias("mrr"))
    return ranking.latest(runs, at="mrr")


@query("""WITH c AS (SELECT DISTINCT p_brand AS chunker, (p_size % 3)::VARCHAR AS params FROM part), r AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS retriever FROM part), k(reranker) AS (VALUES (NULL), ('rr'))
    SELECT chunker, params, retriever, reranker, concat_ws('_', chunker, params, retriever, CASE WHEN reranker IS NOT NULL THEN 'rerank' END) AS config_id FROM c, r, k""")
def config_grid(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    chunkers = p.select(F.col("p_brand").alias("chunker"), (F.col("p_size") % 3).cast("string").alias("params")).distinct()
    return ranking.grid(chunkers, p.select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("retriever")).distinct(), spark.createDataFrame([(None,), ("rr",)], "reranker string"))


@query(f"WITH {CANDIDATES} SELECT config_id, label, mrr, hit FROM cq ORDER BY mrr DESC, hit DESC, config_id LIMIT 12")
def leaderboard(spark, sf_dir):
    return candidate_rows(spark, sf_dir).orderBy(F.col("mrr").desc(), F.col("hit").desc(), "config_id").limit(12).select("config_id", "label", "mrr", "hit")


@query(f"""WITH {CANDIDATES}, o AS (SELECT config_id, mrr, row_number() OVER (ORDER BY mrr DESC, config_id) - 1 AS place, count(*) OVER () - 1 AS last FROM cq)
    SELECT config_id, mrr FROM o WHERE place IN (SELECT round_even(i * last / 7.0, 0)::BIGINT FROM range(0, 8) t(i), (SELECT max(last) AS last FROM o))""")
def spread_sample(spark, sf_dir):
    return ranking.spread_sample(candidate_rows(spark, sf_dir), 8, F.col("mrr").desc()).select("config_id", "mrr")


@query(f"""WITH {CANDIDATES}, x AS (SELECT chunker AS corpus, retriever AS label, round(avg(mrr), 9) AS mrr FROM cq GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY mrr DESC, label) AS position, count(*) OVER (PARTITION BY corpus) AS n FROM x), w AS (SELECT corpus AS winner_of, label FROM r WHERE position = 1)
    SELECT winner_of, w.label, c.corpus, r.mrr, r.position, r.n, (SELECT count(DISTINCT label) > 1 FROM w) AS winner_differs FROM w CROSS JOIN (SELECT DISTINCT corpus FROM x) c LEFT JOIN r ON r.corpus = c.corpus AND r.label = w.label""")
def transfer_test(spark, sf_dir):
    rows = candidate_rows(spark, sf_dir).groupBy(F.col("chunker").alias("corpus"), F.col("retriever").alias("label")).agg(F.round(F.avg("mrr"), 9).alias("mrr"))
    return ranking.transfer(rows.withColumn("score", F.col("mrr")))


@query(f"""WITH {CANDIDATES} SELECT config_id, CASE WHEN avg(mrr) OVER () <> 0 THEN round((mrr - avg(mrr) OVER ()) / avg(mrr) OVER (), 9) END AS mrr_delta, round((latency_ms - avg(latency_ms) OVER ()) / avg(latency_ms) OVER (), 9) AS latency_ms_delta,
        round((chars - avg(chars) OVER ()) / avg(chars) OVER (), 9) AS chars_delta FROM cq""")
def field_deltas(spark, sf_dir):
    return ranking.field_deltas(candidate_rows(spark, sf_dir))


@query(f"""WITH {CANDIDATES} SELECT f.chunker, count(c.config_id)::BIGINT AS n, round(max(c.mrr), 9) AS best_mrr FROM (SELECT DISTINCT p_brand AS chunker FROM part UNION SELECT 'none') f
    LEFT JOIN (SELECT * FROM cq WHERE n_chunks > 40) c USING (chunker) GROUP BY 1""")
def family_counts(spark, sf_dir):
    """Families of chunkers with the candidates of over 40 chunks; one family has none."""
    rows = candidate_rows(spark, sf_dir)
    families = rows.select("chunker").unionByName(spark.createDataFrame([("none",)], "chunker string"))
    return ranking.family_counts(rows.where("n_chunks > 40"), families)


@query(f"""WITH {CANDIDATES} SELECT config_id, label, quality, latency_ms, chars, CASE WHEN config_id % 3 = 0 THEN round(hit / 2, 9) END AS half_width,
        NOT EXISTS (SELECT 1 FROM cq o WHERE o.quality >= c.quality AND o.latency_ms <= c.latency_ms AND o.chars <= c.chars AND (o.quality > c.quality OR o.latency_ms < c.latency_ms OR o.chars < c.chars)) AS on_frontier FROM cq c""")
def candidate_scatter(spark, sf_dir):
    """Every candidate with the half width of its interval, where it has one, and whether it is on the frontier."""
    rows = candidate_rows(spark, sf_dir)
    return ranking.scatter(rows, rows.where("config_id % 3 = 0").select("config_id", F.lit(0.0).alias("low"), F.col("hit").alias("high")))


@query("""WITH authored AS (SELECT DISTINCT o_orderpriority AS corpus, o_orderstatus AS qa_file FROM orders), runs AS (SELECT DISTINCT o_orderpriority AS corpus, o_orderstatus AS qa_file FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority < '3'),
    used AS (SELECT * FROM authored INTERSECT SELECT * FROM runs) SELECT * FROM used UNION ALL SELECT * FROM authored WHERE corpus NOT IN (SELECT corpus FROM used)""")
def question_files(spark, sf_dir):
    authored = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("corpus"), F.col("o_orderstatus").alias("qa_file")).distinct()
    return files.question_files_with_runs(authored, authored.where("qa_file = 'F' AND corpus < '3'"))


# ---------------------------------------------------------------- diagnosis

DIAGNOSED = """found_ AS (SELECT qid, CASE WHEN reachable < 0.999 THEN 'chunker_destroyed' WHEN rank IS NULL AND max_achievable < 0.999 THEN 'chunker_degraded' WHEN rank IS NULL AND b_rank IS NOT NULL THEN 'reranker_demoted'
        WHEN rank IS NULL THEN 'retriever_missed' WHEN rank > 1 THEN 'ranked_low' ELSE 'ok' END AS cause FROM judged_)"""
RERANK_RECORDS = f"""{RERANKED}, best_rr AS (SELECT r.qid, r.rank, max(CASE WHEN r.doc_id = t.doc_id THEN greatest(0, least(r."end", t."end") - greatest(r."start", t."start")) ELSE 0 END::DOUBLE / (t."end" - t."start")) AS score FROM reranked r JOIN truth t USING (qid) WHERE r.rank <= 5 GROUP BY 1, 2),
    judged_ AS (SELECT x.qid, f.rank, x.reachable, x.max_achievable, x.rank AS b_rank FROM records x JOIN (SELECT qid, min(CASE WHEN score >= 0.5 THEN rank END) AS rank FROM best_rr GROUP BY qid) f USING (qid))"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reranked configuration, cut at 5, against the same without its reranker."""
    run = Run(spark, sf_dir)
    base = records(run)
    reranked = retrieval.rerank(run.pool, run.chunks, run.questions, 5)
    after = alignment.per_question(alignment.align(reranked, run.spans), run.reach)
    return settled(diagnosis.diagnose(after, base))


@query(f"{FLOW}, {RECORDS}, {RERANK_RECORDS}, {DIAGNOSED} SELECT * FROM found_")
def diagnose_questions(spark, sf_dir):
    return findings(spark, sf_dir).select("qid", "cause")


ALL_CAUSES = "causes_(priority, cause, fix) AS (VALUES " + ", ".join(f"({k}, '{c}', '{f}')" for k, (c, f) in enumerate(diagnosis.CAUSES)) + ")"
COUNTED = f"{ALL_CAUSES}, counted AS (SELECT priority, cause, fix, (SELECT count(*) FROM found_ f WHERE f.cause = c.cause) AS n, (SELECT count(*) FROM found_) AS t FROM causes_ c)"


@query(f"{FLOW}, {RECORDS}, {RERANK_RECORDS}, {DIAGNOSED}, {COUNTED} SELECT cause, n::BIGINT AS n, round(n::DOUBLE / t, 6) AS share FROM counted WHERE t > 0")
def cause_totals(spark, sf_dir):
    return diagnosis.summary(findings(spark, sf_dir))


@query(f"""{FLOW}, {RECORDS}, {RERANK_RECORDS}, {DIAGNOSED}, {COUNTED} SELECT coalesce((SELECT n || '/' || t || ' questions: ' || fix FROM counted WHERE n > 0 AND cause <> 'ok' ORDER BY priority LIMIT 1), '') AS action WHERE (SELECT count(*) FROM found_) > 0""")
def recommended_action(spark, sf_dir):
    return diagnosis.recommended(findings(spark, sf_dir))


# ---------------------------------------------------------------- the ground-truth study

#: The authors of the study: a chunker each.
AUTHORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "fixed800": lambda docs: chunking.fixed_chunks(docs, 800, 100), "recursive800": chunking.recursive_chunks, "heading1200": chunking.heading_chunks, "semantic90": chunking.semantic_chunks,
}
_AUTHOR_SQL = {"fixed800": ORACLE_SQL["chunk_fixed_800_100"], "recursive800": ORACLE_SQL["chunk_recursive"], "heading1200": heading_chunks_sql(headings_sql(False)), "semantic90": ORACLE_SQL["chunk_semantic"]}
_INDEXED = {"heading1200": "CASE WHEN context_prefix = '' THEN chunk_text ELSE context_prefix || chr(10) || chr(10) || chunk_text END"}
AUTHORED = ", ".join(f'ch_{name} AS MATERIALIZED (SELECT DISTINCT doc_id, "start", "end", {_INDEXED.get(name, "chunk_text")} AS chunk_text FROM ({sql}))' for name, sql in _AUTHOR_SQL.items())
AUTHORED += ", author_chunks AS (" + " UNION ALL ".join(f"SELECT '{name}' AS author, doc_id, \"start\", \"end\" FROM ch_{name}" for name in AUTHORS) + ")"
GOLD = """gold AS (SELECT author, qid, span_ix, doc_id, "start", "end", coverage FROM (SELECT c.author, t.qid, t.span_ix, c.doc_id, c."start", c."end", round((least(c."end", t."end") - greatest(c."start", t."start"))::DOUBLE / (t."end" - t."start"), 9) AS coverage
        FROM author_chunks c JOIN truth t ON c.doc_id = t.doc_id AND c."start" < t."end" AND t."start" < c."end") QUALIFY row_number() OVER (PARTITION BY author, qid, span_ix ORDER BY coverage DESC, "start", "end") = 1)"""


def author_chunks(docs: DataFrame) -> DataFrame:
    """(author, doc_id, start, end); what picks one of them does not mind a span that comes twice."""
    out = None
    for name, chunker in AUTHORS.items():
        part = chunker(docs).select(F.lit(name).alias("author"), "doc_id", "start", "end")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {AUTHORED}, {TRUTH}, {GOLD} SELECT * FROM gold")
def chunk_id_gold(spark, sf_dir):
    return study.gold_chunks(author_chunks(documents(spark, sf_dir)), spans(spark, sf_dir), ("author",))


#: What each configuration retrieves in the study: the lexical ranking over its own chunks of all documents.
STUDY_RANKED = f"{QTOK}, " + ", ".join(f"chunks_{name} AS (SELECT * FROM ch_{name}), {bm25_sql(f'_{name}', 5)}" for name in AUTHORS) + ", sranked AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS config_id, qid, rank, doc_id, \"start\", \"end\" FROM lexical_{name}" for name in AUTHORS) + ")"


def study_inputs(run: Run) -> tuple[DataFrame, DataFrame]:
    """The first five chunks of each configuration for all questions, and the authors' gold chunks.

    Each chunker runs once; its chunks are written, read for weights, ranks and gold, and dropped before the next one runs.
    """
    ranked = gold = None
    for name, chunker in AUTHORS.items():
        with written_once(chunker(run.docs)) as kept:
            chunks = retrieval.distinct_written(kept)
            got = settled(retrieval.bm25(chunks, run.questions, 5).select(F.lit(name).alias("config_id"), "qid", "rank", "doc_id", "start", "end"))
            own = settled(study.gold_chunks(kept.select(F.lit(name).alias("author"), "doc_id", "start", "end"), run.spans, ("author",)))
        ranked, gold = (got, own) if ranked is None else (ranked.unionByName(got), gold.unionByName(own))
    return ranked, gold


def rotation_sql(ious: str) -> str:
    return f"""WITH {AUTHORED}, {TRUTH}, {GOLD}, {STUDY_RANKED},
    sa AS (SELECT r.config_id, r.qid, r.rank, max(CASE WHEN r.doc_id = t.doc_id THEN greatest(0, least(r."end", t."end") - greatest(r."start", t."start")) ELSE 0 END::DOUBLE / (t."end" - t."start")) AS score FROM sranked r JOIN truth t USING (qid) GROUP BY 1, 2, 3),
    qs AS (SELECT DISTINCT qid FROM truth), al AS (SELECT c.config_id, qs.qid, min(CASE WHEN score >= 0.5 THEN rank END) AS f FROM (SELECT DISTINCT config_id FROM sranked) c CROSS JOIN qs LEFT JOIN sa ON sa.config_id = c.config_id AND sa.qid = qs.qid GROUP BY 1, 2),
    alm AS (SELECT config_id, round(avg(CASE WHEN f IS NULL THEN 0.0::DOUBLE ELSE 1 END), 9) AS aligned_hit, round(avg(coalesce(1.0::DOUBLE / f, 0)), 9) AS aligned_mrr FROM al GROUP BY 1),
    io AS (SELECT g.author, r.config_id, r.qid, r.rank, max(CASE WHEN r.doc_id = g.doc_id THEN greatest(0, least(r."end", g."end") - greatest(r."start", g."start")) ELSE 0 END::DOUBLE
        / ((r."end" - r."start") + (g."end" - g."start") - CASE WHEN r.doc_id = g.doc_id THEN greatest(0, least(r."end", g."end") - greatest(r."start", g."start")) ELSE 0 END)) AS iou FROM sranked r JOIN gold g USING (qid) GROUP BY 1, 2, 3, 4),
    lim AS (SELECT unnest({ious}::DOUBLE[]) AS iou),
    nv AS (SELECT a.author, c.config_id, lim.iou, qs.qid, min(CASE WHEN io.iou >= lim.iou THEN io.rank END) AS f FROM (SELECT DISTINCT author FROM gold) a CROSS JOIN (SELECT DISTINCT config_id FROM sranked) c CROSS JOIN lim CROSS JOIN qs
        LEFT JOIN io ON io.author = a.author AND io.config_id = c.config_id AND io.qid = qs.qid GROUP BY 1, 2, 3, 4),
    rot AS (SELECT author, config_id, iou, round(avg(CASE WHEN f IS NULL THEN 0.0::DOUBLE ELSE 1 END), 9) AS naive_hit, round(avg(coalesce(1.0::DOUBLE / f, 0)), 9) AS naive_mrr FROM nv GROUP BY 1, 2, 3),
    study AS (SELECT rot.*, aligned_hit, aligned_mrr, round(aligned_hit - naive_hit, 9) AS hit_delta FROM rot JOIN alm USING (config_id))"""


IOUS = (0.9, 0.7, 0.5, 0.3)


def study_rows(spark: SparkSession, sf_dir: str, ious: tuple) -> DataFrame:
    run = Run(spark, sf_dir)
    return study.rotation(*study_inputs(run), run.spans, ious=ious)


@query(rotation_sql("[0.9]") + " SELECT * FROM study")
def author_rotation(spark, sf_dir):
    return study_rows(spark, sf_dir, (0.9,))


@query(rotation_sql("[0.9]") + """, n AS (SELECT author, config_id FROM study QUALIFY row_number() OVER (PARTITION BY author ORDER BY naive_hit DESC, naive_mrr DESC, config_id) = 1),
    a AS (SELECT author, config_id FROM study QUALIFY row_number() OVER (PARTITION BY author ORDER BY aligned_hit DESC, aligned_mrr DESC, config_id) = 1)
    SELECT author, 0.9::DOUBLE AS iou, n.config_id AS naive_winner, a.config_id AS aligned_winner, n.config_id = a.config_id AS agree FROM n JOIN a USING (author)""")
def study_winners(spark, sf_dir):
    return study.winners(study_rows(spark, sf_dir, (0.9,)))


BIAS = """ SELECT author, iou, round(avg(naive_hit) FILTER (WHERE author = config_id) - avg(naive_hit) FILTER (WHERE author <> config_id), 9) AS naive_bias,
        round(avg(aligned_hit) FILTER (WHERE author = config_id) - avg(aligned_hit) FILTER (WHERE author <> config_id), 9) AS aligned_bias FROM study GROUP BY 1, 2"""


@query(rotation_sql("[0.9]") + BIAS)
def self_preference(spark, sf_dir):
    return study.self_preference(study_rows(spark, sf_dir, (0.9,)), "config_id")


@query(rotation_sql(str(list(IOUS))) + BIAS)
def iou_sensitivity(spark, sf_dir):
    return study.self_preference(study_rows(spark, sf_dir, IOUS), "config_id")


# ---------------------------------------------------------------- answers

TURNS = """turns AS (SELECT u.conv_id, u.turn, u.text AS answer, a.text AS gold FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)"""
BAGS = f"""ga AS (SELECT conv_id, turn, tok, count(*) AS c FROM (SELECT conv_id, turn, unnest({ANS.format('answer')}) AS tok FROM turns) GROUP BY ALL),
    gg AS (SELECT conv_id, turn, tok, count(*) AS c FROM (SELECT conv_id, turn, unnest({ANS.format('gold')}) AS tok FROM turns) GROUP BY ALL),
    ov AS (SELECT conv_id, turn, sum(least(ga.c, gg.c)) AS o FROM ga JOIN gg USING (conv_id, turn, tok) GROUP BY 1, 2),
    sc AS (SELECT conv_id, turn, answer, coalesce(len({ANS.format('answer')}), 0) AS na, coalesce(len({ANS.format('gold')}), 0) AS ng, coalesce(o, 0) AS o FROM turns LEFT JOIN ov USING (conv_id, turn))"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as the answer, the next turn of its conversation as the reference."""
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return c.select("conv_id", "turn", F.col("text").alias("answer")).join(after, ["conv_id", "turn"])


@query(f"WITH {TURNS}, {BAGS} SELECT conv_id, turn, CASE WHEN na = 0 OR ng = 0 THEN 0 ELSE round(2.0::DOUBLE * o / (na + ng), 9) END::DOUBLE AS token_f1 FROM sc")
def token_f1(spark, sf_dir):
    return generation.overlap_columns(turns(spark, sf_dir)).select("conv_id", "turn", F.round("token_f1", 9).alias("token_f1"))


@query(f"WITH {TURNS}, {BAGS} SELECT conv_id, turn, CASE WHEN ng = 0 THEN 0 ELSE round(o::DOUBLE / ng, 9) END::DOUBLE AS gold_recall FROM sc")
def gold_recall(spark, sf_dir):
    return generation.overlap_columns(turns(spark, sf_dir)).select("conv_id", "turn", F.round("gold_recall", 9).alias("gold_recall"))


REFUSED = "(trim(lower({0})) = '' OR " + " OR ".join("contains(lower({0}), '" + p.replace("'", "''") + "')" for p in T.REFUSALS) + ")"


@query(f"SELECT conv_id, turn, {REFUSED.format('text')} AS refused FROM conversations WHERE text IS NOT NULL")
def refusals(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", T.is_refusal(F.col("text")).alias("refused"))


@query(f"""{HEAD} SELECT q.qid, coalesce(substr(regexp_replace(chunk_text, '^\\s+|\\s+$', '', 'g'), 1, 900), '') AS answer FROM (SELECT DISTINCT qid FROM truth) q
    LEFT JOIN (SELECT * FROM lexical JOIN chunks USING (doc_id, "start", "end") WHERE rank = 1) USING (qid)""")
def extractive_answers(spark, sf_dir):
    run = Run(spark, sf_dir)
    return generation.extractive_answers(run.ranked, run.chunks, run.questions)


@query(f"""{HEAD}, blocks AS (SELECT qid, rank, '[' || rank || '] ' || regexp_replace(chunk_text, '^\\s+|\\s+$', '', 'g') AS block FROM lexical JOIN chunks USING (doc_id, "start", "end") WHERE rank <= 30),
    fit AS (SELECT *, sum(length(block)) OVER (PARTITION BY qid ORDER BY rank) AS used FROM blocks QUALIFY used <= 6000),
    ctx AS (SELECT qid, count(*) AS n, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS c FROM fit GROUP BY qid)
    SELECT q.qid, coalesce(n, 0)::BIGINT AS n_blocks, md5('Context:' || chr(10) || coalesce(c, '(no context retrieved)') || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || chr(10) || 'Answer:') AS prompt_md5
    FROM (SELECT DISTINCT qid FROM truth) q JOIN benchmark b ON b.item_id = q.qid LEFT JOIN ctx USING (qid)""")
def prompt_context(spark, sf_dir):
    """The first 30 chunks, as far as 6,000 characters hold them, and the whole question."""
    run = Run(spark, sf_dir)
    got = generation.prompts(run.questions, run.pool.where(F.col("rank") <= 30), run.chunks)
    return got.select("qid", "n_blocks", F.md5("prompt").alias("prompt_md5"))


@query("""WITH p AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN (event_id % 100) / 100.0 WHEN 1 THEN event_id % 101 WHEN 2 THEN 5 WHEN 3 THEN -3 WHEN 4 THEN 1 WHEN 5 THEN (event_id % 50) / 50.0 WHEN 6 THEN (event_id % 10) / 10.0 END AS v FROM events)
    SELECT event_id, CASE WHEN v IS NULL THEN NULL ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN v >= 10 THEN v::DOUBLE / 100 ELSE v::DOUBLE END)), 9) END AS score FROM p""")
def judge_score_parse(spark, sf_dir):
    """Replies of many shapes: plain, nested under names made from the event, in lists, per cent, out of range, boolean, in prose,
    without a score, and with one that is nested too deep."""
    i = F.col("event_id")
    name, tenth = F.concat(F.lit("k"), (i % 13).cast("string")), (i % 10 / 10.0).cast("string")
    wrapped = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kinds = (
        F.format_string('{"score":%s}', (i % 100 / 100.0).cast("string")), wrapped('{"', name, '":{"score":"', (i % 101).cast("string"), '%"}}'), wrapped('[{"note":1},{"', name, '":[{"score":5}]}]'),
        wrapped('{"', name, '":{"b":{"score":-3}}}'), F.lit('{"score":true}'), wrapped('Verdict: {"', name, '":{"score":', (i % 50 / 50.0).cast("string"), '}} as asked.'),
        wrapped('{"first":{"x":[]},"', name, '":[[{"score":', tenth, '}]]}'), F.lit('{"verdict":"good"}'), wrapped('{"a":{"b":{"c":{"', name, '":{"score":1}}}}}'),
    )
    payload = F.coalesce(*[F.when(i % 9 == k, c) for k, c in enumerate(kinds)])
    return table(spark, sf_dir, "events").select("event_id", F.round(T.judged_score(payload), 9).alias("score"))


@query("""WITH r AS (SELECT conv_id * 1000 + turn AS qid, length(text) + 7 + i AS n FROM conversations, range(0, 3) t(i) WHERE text IS NOT NULL),
    g AS (SELECT qid, CASE WHEN n % 4 = 3 THEN NULL ELSE n % 11 / 10.0::DOUBLE END AS s FROM r)
    SELECT qid, round(avg(s), 9) AS score, round(stddev_pop(s), 9) AS spread, count(*) FILTER (WHERE s IS NULL)::BIGINT AS failures FROM g GROUP BY 1""")
def judge_repeats(spark, sf_dir):
    """A judge that answers by the length of what it is asked, three times with three seeds; every fourth length gets no score."""

    def reply(asked: list[str]) -> list[str]:
        number = lambda ask: len(ask) - 1 + int(ask[-1])  # noqa: E731  the text, "\nseed: " and the seed itself
        return ['{"verdict": "none"}' if number(a) % 4 == 3 else f'{{"seen": {{"score": {number(a) % 11 / 10}}}}}' for a in asked]

    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    got = generation.judge(rows, "text", reply, 3)
    return got.select("qid", F.round("score", 9).alias("score"), F.round("spread", 9).alias("spread"), "failures")


@query(f"""WITH {TURNS}, {BAGS}, s AS (SELECT conv_id % 7 AS config_id, {REFUSED.format('answer')} AS refused, CASE WHEN na = 0 OR ng = 0 THEN 0 ELSE 2.0::DOUBLE * o / (na + ng) END AS f1, CASE WHEN ng = 0 THEN 0 ELSE o::DOUBLE / ng END AS rc,
        CASE WHEN turn % 3 = 0 THEN NULL ELSE (conv_id * 31 % 101) / 100.0::DOUBLE END AS f, CASE WHEN turn % 2 = 0 THEN (conv_id * 17 % 101) / 100.0::DOUBLE END AS r FROM sc)
    SELECT config_id, count(*)::BIGINT AS n, round(avg(refused::INT), 4) AS refusal_rate, round(avg(round(f1, 4)), 4) AS token_f1, round(avg(round(rc, 4)), 4) AS gold_recall, round(avg(round(rc, 4)), 4) AS span_grounding,
        round(avg(f) FILTER (WHERE NOT refused), 4) AS faithfulness, round(avg(r) FILTER (WHERE NOT refused), 4) AS relevance, count(f) FILTER (WHERE NOT refused)::BIGINT AS n_judged,
        round(avg(f) FILTER (WHERE NOT refused) * (1 - avg(refused::INT)), 4) AS faithful_coverage, round(avg(r) FILTER (WHERE NOT refused) * (1 - avg(refused::INT)), 4) AS relevant_coverage FROM s GROUP BY 1""")
def generation_summary(spark, sf_dir):
    rows = generation.overlap_columns(turns(spark, sf_dir), evidence="gold").withColumn("config_id", F.col("conv_id") % 7)
    rows = rows.withColumn("faithfulness", F.when(F.col("turn") % 3 != 0, F.col("conv_id") * 31 % 101 / 100.0)).withColumn("relevance", F.when(F.col("turn") % 2 == 0, F.col("conv_id") * 17 % 101 / 100.0))
    return generation.generation_summary(rows)


@query("""SELECT DISTINCT sha256('model' || chr(0) || text) AS key FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)""")
def embedding_cache_misses(spark, sf_dir):
    """The texts of rows with an even id are in the cache already."""
    docs = documents(spark, sf_dir)
    cache = docs.where("doc_id % 2 = 0").select(files.content_key("model", F.col("text")).alias("key")).distinct()
    return files.cache_misses(docs, cache, "model").select("key")


@query("""SELECT DISTINCT sha256('{"model": "m", "prompt": ' || to_json(text)::VARCHAR || ', "temperature": 0}') AS key FROM conversations WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM conversations WHERE conv_id % 2 = 0 AND text IS NOT NULL)""")
def reply_cache_misses(spark, sf_dir):
    """Replies to the turns of even conversations are in the cache already."""
    turns_ = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    cache = turns_.where("conv_id % 2 = 0").select(files.reply_key("m", F.col("text"), temperature=0).alias("key"), F.lit("r").alias("reply")).distinct()
    return files.through_replies(turns_.select(F.col("text").alias("prompt")), cache, "m", lambda new: new.select("key", F.lit("r").alias("reply")), temperature=0)[1].select("key")


@query("SELECT o_orderkey AS config_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending_configs(spark, sf_dir):
    """Where a stopped run resumes: orders without a returned line."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("config_id"))
    return files.pending(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("config_id")), done)


# ---------------------------------------------------------------- runs and the whole plan

@query("""SELECT concat_ws('-', sum(('0x' || substr(h, 1, 8))::BIGINT)::BIGINT::VARCHAR, sum(('0x' || substr(h, 9, 8))::BIGINT)::BIGINT::VARCHAR) AS fingerprint, count(*)::BIGINT AS n
    FROM (SELECT sha256(doc_id::VARCHAR || ':' || coalesce(text, '')) AS h FROM documents)""")
def wide_fingerprint(spark, sf_dir):
    return files.wide_fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"))


RUNS = "runs AS (SELECT o_orderkey AS run_id, (o_custkey % 40)::BIGINT AS config_id, o_orderdate AS run_ts, 'f' AS corpus_fingerprint, o_orderpriority AS corpus, o_orderstatus AS qa_file FROM orders)"


def run_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as runs of 40 configurations, their lines as metric cells."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 40).alias("config_id"), F.col("o_orderdate").alias("run_ts"), F.lit("f").alias("corpus_fingerprint"), F.col("o_orderpriority").alias("corpus"), F.col("o_orderstatus").alias("qa_file"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("mrr"))
    cells = lines.join(runs.select("run_id", "config_id"), F.col("l_orderkey") == F.col("run_id")).select("run_id", "config_id", F.col("l_linenumber").cast("long").alias("k"), F.lit(0.5).alias("tau"), "mrr")
    return runs, cells


@query(f"""WITH {RUNS}, last AS (SELECT * FROM runs WHERE qa_file = 'F' AND corpus = '1-URGENT' QUALIFY row_number() OVER (PARTITION BY config_id ORDER BY run_ts DESC, run_id DESC) = 1)
    SELECT l.run_id, l.config_id, c.mrr FROM last l LEFT JOIN (SELECT l_orderkey, max(l_discount) AS mrr FROM lineitem WHERE l_linenumber = 3 GROUP BY 1) c ON c.l_orderkey = l.run_id""")
def candidates_at_cell(spark, sf_dir):
    """The latest run of each configuration with one cell's metrics, null where it lacks the cell."""
    runs, cells = run_rows(spark, sf_dir)
    return ranking.candidates(runs, cells, "F", "1-URGENT", 3, 0.5).select("run_id", "config_id", "mrr")


@query(f"""WITH {RUNS}, c AS (SELECT r.config_id, l_linenumber AS k, l_discount AS mrr FROM runs r JOIN lineitem ON l_orderkey = run_id)
    SELECT config_id, max(mrr) FILTER (WHERE k = 1) AS value FROM c GROUP BY config_id""")
def metric_at_cell(spark, sf_dir):
    return files.metric_at(run_rows(spark, sf_dir)[1], "mrr", 1, 0.5)


@query()
def experiment_grid(spark, sf_dir):
    """Chunk, index, search, fuse, re-rank, align and reduce for all 30 configurations of the grid in one plan."""
    from spanforge.plans.experiment import GRID, Experiment

    run = Run(spark, sf_dir)
    return Experiment(run.docs, run.questions, run.spans).over(GRID).metrics()


@query()
def run_manifests(spark, sf_dir):
    """Manifests of two configurations, as they are saved, but for what is measured by the clock."""
    from spanforge.plans.experiment import Config, Experiment

    params = {"size": 800, "overlap": 100}
    made = Run(spark, sf_dir)
    run = Experiment(made.docs, made.questions, made.spans).over((Config("fixed", params, "bm25"), Config("fixed", params, "dense")))
    return run.manifests("documents", "benchmark", fingerprint=files.wide_fingerprint(table(spark, sf_dir, "documents"))).drop("build_seconds", "query_ms_mean", "query_ms_p90", "run_ts", "env")
