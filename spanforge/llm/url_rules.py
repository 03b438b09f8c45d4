"""Operator 2, URL filters: a sort-merge range join of URLs with host and path rules.

A host is written with its labels reversed and each closed by a separator (``blog.example.org`` -> ``org.example.blog.``),
so that a rule's host and all its subdomains are exactly the keys with a common prefix: an interval in sorted order, and
intervals of two rules are nested or disjoint. Cut points taken from a bounded sample split the key space, each rule is
copied to the spans that its interval meets, and every span is swept in order with a stack of the rules that are active.
Nothing is broadcast, so neither rules nor URLs have a size limit; URLs under one hot host are cut by path and id too.

Cases: a null URL or one without ``://`` has an empty host and path; no rule fits an empty host. Of the rules that fit, the
longest (code points of host and path) wins, ties go to the longer host, then to ``block``. Repeated rules and repeated pages
are fine. Without rules, or where none fits, the verdict is the default. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of the sample a span from which the cut points come (80 keys for a million URLs), and URLs that a span holds about.
SAMPLE_KEYS, SPAN_ROWS = 8, 100_000
COLUMNS = "page_id {id}, host string, path string, rule string, verdict string"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty for null or without ``://``."""
    got = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(got, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    """Labels reversed, each closed by a dot; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def sweep(rows: Iterator[tuple], default: str) -> Iterator[tuple]:
    """Rows (span, key, kind, path, id, host, verdict) in order, a rule (kind 0) before what it covers.

    The stack holds one level for each active host key: its rules by path, and the lengths of these paths.
    """
    span, stack = None, []
    for at, key, kind, path, ident, host, verdict in rows:
        if at != span:
            span, stack = at, []
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if kind == 0:
            if not stack or stack[-1][0] != key:
                stack.append((key, host, {}))
            rules = stack[-1][2]
            rules[path] = "block" if "block" in (verdict, rules.get(path)) else verdict
            continue
        best = None
        for level, (_, of, rules) in enumerate(stack if key else ()):
            for n in {len(p) for p in rules} if len(rules) < 8 else range(len(path) + 1):
                if len(path) >= n and (v := rules.get(path[:n])) is not None and (best is None or (len(of) + n, level) >= best[0]):
                    best = ((len(of) + n, level), of + path[:n], v)
        yield ident, host, path, *(best[1:] if best else (None, default))


def _spanned(df: DataFrame, cuts: list[str], low: Column, high: Column) -> DataFrame:
    """df with the numbers ``low`` and ``high`` of the spans that two keys fall into, by binary search among the cut points."""
    if not cuts:
        return df.select("*", F.lit(0).alias("low"), F.lit(0).alias("high"))
    keyed, names = df.select("*", low.alias("low"), high.alias("high")), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.array([bisect_right(cuts, key) for key in batch.column(name).to_pylist()], pa.int32()) for name in ("low", "high")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], [*names, "low", "high"])

    return keyed.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", low int, high int")


def judge_urls(pages: DataFrame, rules: DataFrame, ident: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``rules`` has host, path and verdict."""
    kind = pages.schema[ident].dataType
    # a path is compared with rules only, so the hash, not the path, spreads a hot host over the spans
    urls = pages.select(F.col(ident).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = urls.select("id", "host", "path", key_of(F.col("host")).alias("key"), F.substring(F.lpad(F.hex(F.xxhash64("id", "path")), 16, "0"), 1, 8).alias("salt"))
    said = F.lower(F.col("host"))
    asked = rules.select(said.alias("host"), F.col("path"), F.col("verdict"), key_of(said).alias("key")).where("key <> '' AND path IS NOT NULL AND verdict IS NOT NULL").distinct()
    n = urls.count()
    spans = -(-n // SPAN_ROWS)
    cuts: list[str] = []
    at = F.concat("key", F.lit("\0"), "salt")
    if spans > 1:
        some = sorted(r[0] for r in urls.sample(min(1.0, SAMPLE_KEYS * spans / n), seed=7).select(at).collect())
        cuts = sorted({some[len(some) * k // spans] for k in range(1, spans)}) if some else []
    placed = _spanned(urls, cuts, at, at).select(F.col("low").alias("span"), "key", F.lit(1).alias("kind"), "path", "id", "host", F.lit(None).cast("string").alias("verdict"))
    # the interval of a rule: from its key to the key with the last dot raised to the next character
    last = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    reach = _spanned(asked, cuts, F.col("key"), last).withColumn("span", F.explode(F.sequence("low", "high")))
    reach = reach.select("span", "key", F.lit(0).alias("kind"), "path", F.lit(None).cast(kind).alias("id"), "host", "verdict")
    ordered = placed.unionByName(reach).repartition(F.col("span")).sortWithinPartitions("span", "key", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        types = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(types)], ["page_id", "host", "path", "rule", "verdict"])

        def noted():
            nonlocal types
            for batch in batches:
                types = types or [batch.schema.field("id").type, *[pa.string()] * 4]
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for row in sweep(noted(), default):
            held.append(row)
            if len(held) == 10_000:
                yield out()
                held.clear()
        if held:
            yield out()

    return ordered.mapInArrow(run, COLUMNS.format(id=kind.simpleString()))
