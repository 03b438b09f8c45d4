"""The queries opN_... over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import byte_bpe, clustering, common, ctw, jaccard, langid, late_arrivals, line_templates, media, mixing, pii, quality_bands, substrings, url_rules

#: The rules of op2: host, path, verdict.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(ident, folds: int):
    """crc32(id as text) mod folds is 1; a null id is not held out."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % folds == 1, F.lit(False))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 3)
    got = langid.identify(docs, langid.fit(docs, ~out))
    return got.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op3_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op4_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ctw.score_texts(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5))
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op5_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substrings.drop_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bands.quality_bands(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def vocabulary() -> tuple[bytes, str]:
    """The rank file's bytes and the pattern, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = byte_bpe.encode(table(spark, sf_dir, "documents"), *vocabulary())
    return got.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.text_images(table(spark, sf_dir, "documents"))
    got = media.media_tiles(stored, "doc_id", "media", ("n_bytes", "media"))
    last = F.expr("substring(samples, greatest(1, octet_length(samples) - 63), 64)")
    return got.select(
        F.col("id").alias("doc_id"), "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(last).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.col("dhash").alias("feature"), F.col("npy").alias("tile"),
    )


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_templates.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: What arrives before is op11's starting layout.
LATE_FROM = "2024-03-01"


def with_copies(sales: DataFrame) -> DataFrame:
    """op11's rows: a third of the sales of every tenth day come again, later and dearer."""
    h, day = F.crc32(F.col("sale_id").cast("string").cast("binary")), late_arrivals.day_of(late_arrivals.micros(sales, "sold_at"))
    again = F.coalesce((h % 3 == 0) & (day % 10 == 0), F.lit(False))
    copy, hash_ = common.fresh(sales, "copy"), common.fresh(sales, "hash")
    rows = sales.withColumn(hash_, h).withColumn(copy, F.explode(F.when(again, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    new = {
        "total": F.col("total") + F.col(copy),
        "sold_at": F.when(F.col(copy) == 0, F.col("sold_at")).otherwise(F.col("sold_at") + F.make_dt_interval((F.col(hash_) % 2).cast("int"))),
        "arrived_at": F.when(F.col(copy) == 0, F.col("arrived_at")).otherwise(F.col("arrived_at") + F.make_dt_interval((1 + F.col(hash_) % 97).cast("int"))),
    }
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in sales.columns))


def op11_late_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = table(spark, sf_dir, "sales")
    layout, start = late_arrivals.amended_layout(with_copies(sales), LATE_FROM, 1 + sales.count() // 900)
    return late_arrivals.files(layout, start)


def op12_partial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"), pii.fit(pii.labelled_table(spark)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_langid, op2_url_rules, op3_pivotal_mix, op4_ctw, op5_fm_substrings, op6_quality_bands, op7_jaccard_join, op8_byte_bpe, op9_media_tiles, op10_line_templates, op11_late_arrivals, op12_partial_distance, op13_pii_crf)
}

_HOST = "coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"

#: Words as DuckDB finds them.
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_RUN = lambda n: "concat_ws(' ', word, " + ", ".join(f"lead(word, {j}) OVER w" for j in range(1, n)) + ")"
_PLACED = "SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM t"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _little(value: str) -> str:
    """A 32-bit number's bytes in hex, the low one first."""
    return "(" + " || ".join(f"printf('%02X', ({value}) >> {8 * k} & 255)" for k in range(4)) + ")"


def _crc_table() -> str:
    """The 256 remainders of the reflected polynomial EDB88320."""
    out = list(range(256))
    for _ in range(8):
        out = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in out]
    return str(out)


def _crc(numbers: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {numbers}), lambda c, x: xor(remainders[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)"


#: Rounds that the SQL of op10 writes out: more than it takes on any table here until no template moves.
_ROUNDS = 8


def _round(j: int) -> str:
    """A round of the template tree: templates r{j} (tp, room) and those of the masked lines o{j} (ms, tp) to r{j + 1}, o{j + 1}."""
    return f"""
        w{j} AS (SELECT tp, tp AS made, 0 AS k, 0 AS room FROM r{j} UNION ALL SELECT tp, list_transform(tp, lambda x, i: CASE WHEN i = k THEN '<*>' ELSE x END), k, room FROM (SELECT tp, unnest(range(3, len(tp) + 1)) AS k, room FROM r{j} WHERE room > 0) WHERE tp[k] <> '<*>'),
        c{j} AS (SELECT made, count(*) AS c FROM w{j} GROUP BY 1 HAVING count(*) > 1),
        v{j} AS (SELECT tp, list(k) AS ks FROM (SELECT tp, k FROM w{j} JOIN c{j} USING (made) WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY tp ORDER BY c DESC, k) <= room) GROUP BY 1),
        o{j + 1} AS MATERIALIZED (SELECT ms, list_transform(tp, lambda x, i: CASE WHEN list_contains(ks, i) THEN '<*>' ELSE x END) AS tp FROM o{j} LEFT JOIN v{j} USING (tp)),
        r{j + 1} AS MATERIALIZED (SELECT list_transform(tp, lambda x, i: CASE WHEN list_contains(ks, i) THEN '<*>' ELSE x END) AS tp, max(room - coalesce(len(ks), 0)) AS room FROM r{j} LEFT JOIN v{j} USING (tp) GROUP BY 1),"""


def _lloyd(j: int) -> str:
    """A round of op12: the assignment to the centroids c{j} (c, v), and those of the next round."""
    return f"""
        a{j} AS MATERIALIZED (SELECT k.rid, any_value(k.v) AS v, min([list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c.c]) AS d FROM kept k, c{j} c GROUP BY 1),
        s{j} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT d[2] AS c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{j}) GROUP BY 1, 2),
        m{j} AS (SELECT c, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{j} GROUP BY 1),
        c{j + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{j} c LEFT JOIN m{j} m USING (c)),"""


ORACLE_SQL: dict[str, str] = {
    "op2_url_rules": f"""
        WITH rules(rhost, rpath, verdict) AS (VALUES {', '.join(map(repr, URL_RULES))}),
        urls AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
        best AS (
            SELECT u.page_id, u.host, u.path, r.rhost || r.rpath AS rule, r.verdict,
                   row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS rn
            FROM urls u LEFT JOIN rules r
              ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE rn = 1""",
    "op5_fm_substrings": f"""
        WITH t AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS ws FROM documents),
        runs AS (SELECT doc_id, k AS i, {_RUN(20)} AS s, lead(word, 19) OVER w AS last FROM ({_PLACED}) WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
        windows AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM runs WHERE last IS NOT NULL),
        edges AS (SELECT doc_id, i AS k, 1 AS d FROM windows WHERE nth > 1 UNION ALL SELECT doc_id, i + 20, -1 FROM windows WHERE nth > 1),
        steps AS (SELECT doc_id, k, sum(d) AS d FROM edges GROUP BY 1, 2),
        words AS (SELECT doc_id, k, word, sum(coalesce(d, 0)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) > 0 AS gone FROM ({_PLACED}) LEFT JOIN steps USING (doc_id, k)),
        cut AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT gone) AS kept FROM words GROUP BY 1)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN cut USING (doc_id)""",
    "op7_jaccard_join": f"""
        WITH RECURSIVE t AS (SELECT doc_id, coalesce({_WORDS.format(_LOWER)}, []) AS ws FROM documents),
        shingles AS (SELECT DISTINCT doc_id, s FROM (
            SELECT doc_id, s FROM (SELECT doc_id, {_RUN(5)} AS s, lead(word, 4) OVER w AS last FROM ({_PLACED}) WINDOW w AS (PARTITION BY doc_id ORDER BY k)) WHERE last IS NOT NULL
            UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM t WHERE len(ws) BETWEEN 1 AND 4)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
        shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
        reached(doc_id, other) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.doc_id, l.v FROM reached r JOIN links l ON l.u = r.other)
        SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY 1""",
    "op10_line_templates": f"""
        WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
        w AS (SELECT doc_id, i, line, {_WORDS.format('line')} AS ws FROM l),
        f AS (SELECT *, len(ws) AS n, len(list_filter(ws, lambda x: regexp_matches(x, '[0-9]'))) AS figures FROM w),
        m AS (SELECT *, CASE WHEN 2 * figures <= n THEN list_transform(ws, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) ELSE ws END AS ms FROM f),
        held AS (SELECT ms, count(DISTINCT doc_id) AS docs FROM m WHERE n >= {line_templates.LEAST_WORDS} GROUP BY 1),
        cells AS (SELECT ms, len(ms) AS n, generate_subscripts(ms, 1) AS k, unnest(ms) AS word, docs FROM held),
        counted AS (SELECT *, k > 2 AND word <> '<*>' AND sum(docs) OVER (PARTITION BY n, ms[1], ms[2], k, word) < {line_templates.DOCS} AS rare FROM cells),
        t0 AS (SELECT ms, any_value(n) // 4 - count(*) FILTER (WHERE rare) AS room, list(CASE WHEN rare THEN '<*>' ELSE word END ORDER BY k) AS tp FROM counted GROUP BY 1),
        o0 AS (SELECT ms, tp FROM t0 WHERE room >= 0), r0 AS (SELECT tp, max(room) AS room FROM t0 WHERE room >= 0 GROUP BY 1),{''.join(map(_round, range(_ROUNDS)))}
        placed AS (SELECT m.*, o.tp FROM m LEFT JOIN o{_ROUNDS} o ON o.ms = m.ms AND m.n >= {line_templates.LEAST_WORDS}),
        common AS (SELECT tp, min(doc_id) AS first FROM placed WHERE tp IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) >= {line_templates.DOCS}),
        judged AS (SELECT p.doc_id, p.i, p.line, coalesce(c.first <> p.doc_id, false) AS gone FROM placed p LEFT JOIN common c ON c.tp = p.tp),
        cut AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM judged GROUP BY 1)
        SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256 FROM documents LEFT JOIN cut USING (doc_id)""",
    "op9_media_tiles": f"""
        WITH tables AS (SELECT {_crc_table()}::BIGINT[] AS remainders),
        t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT doc_id, len(h) // 2 AS n, greatest(1, (len(h) + 127) // 128) AS rows_, rpad(h, (greatest(1, (len(h) + 127) // 128) * 128)::INT, '0') AS h FROM t),
        lines AS (SELECT doc_id, rows_, r, substr(h, 128 * r + 1, 128) AS line FROM (SELECT *, unnest(range(0, rows_)) AS r FROM p)),
        flipped AS (SELECT doc_id, string_agg(line, '' ORDER BY r DESC) AS h FROM lines GROUP BY 1),
        bytes AS (SELECT doc_id, rows_, r, unnest(range(0, 64)) AS c, unnest(list_transform(range(0, 64), lambda i: ('0x' || substr(line, 2 * i + 1, 2))::BIGINT)) AS x FROM lines),
        lasts AS (SELECT doc_id, list(x ORDER BY c) AS v FROM bytes WHERE r = rows_ - 1 GROUP BY 1),
        c AS (SELECT p.*, ('0x' || right(sha256(unhex(h)), 1))::INT % 2 AS odd, {_crc('v')} AS tail FROM p JOIN lasts USING (doc_id), tables),
        stored AS (SELECT c.*, unhex(CASE WHEN odd = 0 THEN hex(encode('P5' || chr(10) || '64 ' || rows_ || chr(10) || '255' || chr(10))) || c.h
            ELSE '424D' || {_little('1078 + rows_ * 64')} || '00000000' || {_little('1078')} || {_little('40')} || {_little('64')} || {_little('rows_')} || '01000800' || {_little('0')} || {_little('rows_ * 64')}
                || {_little('2835')} || {_little('2835')} || {_little('256')} || {_little('0')} || (SELECT string_agg(printf('%02X', g) || printf('%02X', g) || printf('%02X', g) || '00', '' ORDER BY g) FROM range(0, 256) x(g)) || f.h END) AS media
            FROM c JOIN flipped f USING (doc_id)),
        across AS (SELECT doc_id, any_value(rows_) AS rows_, r, j, sum(x * (least(c + 1, (j + 1) * 64 / 9.0::DOUBLE) - greatest(c, j * 64 / 9.0::DOUBLE))) AS s
            FROM bytes JOIN (SELECT c, j FROM range(0, 64) a(c), range(0, 9) t(j) WHERE c + 1 > j * 64 / 9.0::DOUBLE AND c < (j + 1) * 64 / 9.0::DOUBLE) USING (c) GROUP BY doc_id, r, j),
        cells AS (SELECT doc_id, j, k, round(sum(s * (least(r + 1, (k + 1) * rows_ / 8.0::DOUBLE) - greatest(r, k * rows_ / 8.0::DOUBLE))) / (any_value(rows_) / 8.0::DOUBLE * 64 / 9), 6) AS m
            FROM across, range(0, 8) t(k) WHERE r + 1 > k * rows_ / 8.0::DOUBLE AND r < (k + 1) * rows_ / 8.0::DOUBLE GROUP BY 1, 2, 3),
        steps AS (SELECT *, lead(m) OVER (PARTITION BY doc_id, k ORDER BY j) AS after FROM cells),
        marks AS (SELECT doc_id, k, sum(CASE WHEN after > m THEN 1 << (7 - j) ELSE 0 END)::BIGINT AS bits, string_agg(printf('%02X', round_even(m, 0)::BIGINT), '' ORDER BY j) AS tile FROM steps GROUP BY 1, 2),
        features AS (SELECT doc_id, string_agg(printf('%02x', bits), '' ORDER BY k) AS feature, unhex('{media.npy_head()}' || string_agg(tile, '' ORDER BY k)) AS tile FROM marks GROUP BY 1)
        SELECT doc_id, n::BIGINT AS n_bytes, (rows_ * 64)::BIGINT AS payload_bytes, sha256(unhex(h)) AS payload_sha256, tail::BIGINT AS tail_crc32, octet_length(media)::BIGINT AS media_bytes, sha256(media) AS media_sha256, feature, tile
        FROM stored JOIN features USING (doc_id)""",
    "op12_partial_distance": f"""
        WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({clustering.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < 8),{''.join(map(_lloyd, range(10)))}
        placed AS (SELECT k.vec_id, min([list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c.c]) AS d FROM kept k, c10 c GROUP BY k.rid, k.vec_id)
        SELECT vec_id, d[2]::INTEGER AS cluster, d[1] AS distance, sum(d[1]) OVER (PARTITION BY d[2])::BIGINT AS cluster_inertia, sum(d[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c10.v, ',')) AS centroid_sha256
        FROM placed JOIN c10 ON c10.c = d[2]""",
}
