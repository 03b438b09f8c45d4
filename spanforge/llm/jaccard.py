"""Operator 7, n-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Shingles are ordered globally from rare to frequent (document frequency, then hash). Two sets of similarity t share a shingle
among the first ``n - ceil(t n) + 1`` of each, and two of them one place further on whenever they need an overlap of two, which
only equal sets do without. So small sets enumerate the subsets of two shingles of that longer prefix and meet in a common
subset, while large sets, whose subsets would be too many, are scanned through the inverted lists of their prefix. The size
that divides them minimises the summed cost of both; sets up to 4/3 of it do both, so no pair falls between. Frequencies travel
between blocks of documents and parts of the key space as packed arrays; shingles met in one document only are never indexed.

Equal sets form a class first, and its least id stands for it. Within a bucket (a subset's or a list's sets) every set is
compared with a centre, and in further rounds with other centres what is not yet connected, then what is left of the bucket
pair by pair: links within one component need no test, so a group of many near copies costs a few comparisons a copy, and no
link between different components is left out. Pairs are tested only if their sizes, the places of the common shingle and
bitmaps of the sets leave room for the overlap that a link needs. Similarities are exact over 64-bit shingle hashes.

Cases: without words (or text) a set is empty and linked with nothing; fewer words than a shingle has are one shingle. A null
id is linked with nothing and has no component. Rows that repeat an id are rows of their own, told apart by their texts; equal
rows are linked as equal sets. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm import common
from spanforge.llm.components import components

#: Shingle width, least similarity in hundredths, shingles that one part of the key space holds about.
WIDTH, LEAST, PART_KEYS = 5, 75, 2_000_000
#: Rows that an entry of a list costs (itself and about one test against a centre), where a subset costs its own row.
SCAN_COST = 2.0
#: Of each round, the orders by which a bucket picks its centre, dealt by the bucket's key; bits of a set's bitmap.
ROUNDS, BITS = (1, 8, 8), 1024
_U = np.uint64


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text): the distinct shingles of each text, by text and hash."""
    flat, counts = common.words(pc.ascii_lower(texts))
    n = len(counts)
    codes, vocabulary = common.coded(flat)
    h = common.hashes(vocabulary)[codes]
    doc = np.repeat(np.arange(n), counts)
    got = common.grams(h, width)
    real = doc[: len(got)] == doc[width - 1 :] if len(got) else np.zeros(0, bool)
    keys, docs = [got[real]], [doc[: len(got)][real]]
    starts = np.cumsum(counts) - counts
    for size in range(1, width):
        short = np.flatnonzero(counts == size)
        if len(short):
            value = np.full(len(short), size, np.uint64)
            for j in range(size):
                value = common.mixed(value * _U(0x9E3779B97F4A7C15) + h[starts[short] + j])
            keys.append(value)
            docs.append(short)
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    if len(key):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        key, doc = key[new], doc[new]
    return key, doc


def _place(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, 32 bits) of a key: enough to order keys, as a collision changes the order alike everywhere."""
    return ((keys >> _U(32)) % _U(parts)).astype(np.int64), (keys & _U(0xFFFFFFFF)).astype(np.uint32)


def _ask(parts: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        keys, _ = shingle_sets(common.filled(table.column("text")), width)
        part, low = _place(keys, parts)
        rows = common.messages(part, parts, lambda pick: (np.sort(low[pick]).astype("<u4").tobytes(),))
        block = table.column("block")[0].as_py()
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _count(table: pa.Table) -> pa.Table:
    """One part: how many documents hold each key, told to each block for its distinct keys, in their order."""
    asked = [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
    distinct, n = np.unique(np.concatenate(asked), return_counts=True)
    n = np.minimum(n, 65535).astype("<u2")
    told = [np.unique(x) for x in asked]
    return pa.table({
        "block": table.column("block"), "part": table.column("part"),
        "keys": pa.array([x[f > 1].tobytes() for x, f in ((x, n[np.searchsorted(distinct, x)]) for x in told)], pa.binary()),
        "often": pa.array([f[f > 1].tobytes() for f in (n[np.searchsorted(distinct, x)] for x in told)], pa.binary()),
    })


SET = "doc_id {id}, h long, n_shingles long, sig_a long, sig_b long, prefix array<long>, in_base int, first int, bitmap array<long>, shingles binary"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary())
_NAMES = ("doc_id", "h", "n_shingles", "sig_a", "sig_b", "prefix", "in_base", "first", "bitmap", "shingles")


def _bitmaps(key: np.ndarray, doc: np.ndarray, wanted: np.ndarray) -> pa.Array:
    """Of each wanted text, the parity of its shingles by their last bits, as longs: two sets differ in as many shingles at
    least as their bitmaps in bits."""
    rows = np.flatnonzero(wanted)
    out = np.zeros((len(rows), BITS // 64), np.int64)
    where = np.full(len(wanted), -1)
    where[rows] = np.arange(len(rows))
    mine = where[doc]
    for at in range(0, len(rows), 1024):
        here = (mine >= at) & (mine < at + 1024)
        n = min(1024, len(rows) - at)
        odd = np.bincount((mine[here] - at) * BITS + (key[here] & _U(BITS - 1)).astype(np.int64), minlength=n * BITS) & 1
        out[at : at + n] = np.packbits(odd.astype(np.uint8).reshape(n, BITS), axis=1, bitorder="little").view("<i8")
    ends = np.cumsum(np.where(wanted, BITS // 64, 0))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out.ravel()))


def _index(parts: int, width: int, least: int):
    """Block of texts and the keys met in two documents or more -> each set's size, signature and shared prefix."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        n = texts.num_rows
        if not n:
            return pa.table([pa.array([], t) for t in (texts.schema.field("doc_id").type, *_TYPES)], names=list(_NAMES))
        key, doc = shingle_sets(common.filled(texts.column("text")), width)
        part, low = _place(key, parts)
        place = part.astype(np.uint64) << _U(32) | low
        rows = told.to_pylist()
        known = np.concatenate([np.frombuffer(r["keys"], "<u4").astype(np.uint64) | _U(r["part"]) << _U(32) for r in rows] or [np.zeros(0, np.uint64)])
        often = np.concatenate([np.frombuffer(r["often"], "<u2") for r in rows] or [np.zeros(0, "<u2")]).astype(np.int64)
        order = np.argsort(known)
        known, often = known[order], often[order]
        at = np.minimum(np.searchsorted(known, place), max(0, len(known) - 1))
        df = np.where(known[at] == place, often[at], 1) if len(known) else np.ones(len(key), np.int64)
        size = np.bincount(doc, minlength=n)
        starts = np.cumsum(size) - size
        add = lambda x: np.array([int(v) for v in np.add.reduceat(np.append(x, _U(0)), np.minimum(starts, len(x)))], np.uint64).astype(np.int64) * (size > 0)
        sig_a, sig_b = add(key), add(common.mixed(key ^ _U(0x5851F42D4C957F2D)))
        ranked = np.lexsort((key, df, doc))
        nth = np.arange(len(key)) - starts[doc]
        base = size - -(-size * least // 100) + 1
        shared = (nth <= base[doc]) & (df[ranked] > 1)  # one more than the base prefix
        kept, kept_doc, kept_nth = key[ranked][shared], doc[shared], nth[shared]
        many = np.bincount(kept_doc, minlength=n)
        in_base = np.bincount(kept_doc, weights=kept_nth < base[kept_doc], minlength=n).astype(np.int32)
        first = np.full(n, 1 << 30, np.int32)  # place of the first shared shingle: all that follow in order are shared too
        np.minimum.at(first, kept_doc, kept_nth.astype(np.int32))
        prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(kept.view(np.int64)))
        maps = _bitmaps(key, doc, many > 0)
        raw, edges = key.astype("<u8"), np.cumsum(size)
        held = [raw[b - s : b].tobytes() if m else None for s, b, m in zip(size, edges, many, strict=True)]
        return pa.table([texts.column("doc_id"), texts.column("h"), pa.array(size, pa.int64()), pa.array(sig_a), pa.array(sig_b), prefix, pa.array(in_base), pa.array(first), maps, pa.array(held, pa.binary())], names=list(_NAMES))

    return run


def _similar(least: int):
    """Pairs with both sets -> the pairs that link."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()
            fine = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(a, b, strict=True)):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.sort(np.concatenate([x, y]))
                common_ = int((both[1:] == both[:-1]).sum())
                fine[k] = 100 * common_ >= least * (len(x) + len(y) - common_)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(fine)), batch.column("v").filter(pa.array(fine))], ["u", "v"])

    return run


def boundary(costs: list[tuple[int, int, float, float]]) -> int:
    """Largest size to treat as small: costs are (size class, its largest size, rows of subsets, rows of lists)."""
    costs = sorted(costs)
    options = [(sum(c[3] for c in costs), 0)]
    for k, (_, most, _, _) in enumerate(costs):
        options.append((sum(c[2] for c in costs[: k + 1]) + sum(c[3] for c in costs[k + 1 :]), most))
    return min(options)[1]


def _fits(a: Column, b: Column, least: int) -> Column:
    return 100 * F.least(a, b) >= least * F.greatest(a, b)


def jaccard_classes(df: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WIDTH, least: int = LEAST, block_bytes: int = common.BLOCK_BYTES // 2) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; ``least`` is the similarity in hundredths."""
    return jaccard_rows(df, ident, text, width, least, block_bytes).select("doc_id", "n_shingles", "component_id")


def jaccard_rows(df: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WIDTH, least: int = LEAST, block_bytes: int = common.BLOCK_BYTES // 2) -> DataFrame:
    """(doc_id, h, n_shingles, component_id, component): h is the text's xxhash64, which tells rows of one id apart, component
    names the group of linked rows (null for a row that no other can be linked with: without words or id)."""
    spark = df.sparkSession
    blocks, total, _ = common.in_blocks(df, ident, text, block_bytes)
    blocks = blocks.withColumn("h", F.xxhash64("text"))
    kind = blocks.schema["doc_id"].dataType.simpleString()
    parts = max(4, min(1 << 20, total // (6 * PART_KEYS)))
    asked = blocks.groupBy("block").applyInArrow(common.lean(_ask(parts, width)), "part int, block int, keys binary")
    told = asked.groupBy("part").applyInArrow(common.lean(_count), "block int, part int, keys binary, often binary")
    sets = common.written(blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(common.lean(_index(parts, width, least)), SET.format(id=kind)))
    del blocks, asked, told
    common.release(spark)
    key = ["n_shingles", "sig_a", "sig_b"]
    # a class of equal sets is a node, named by a hash, as ids may repeat
    classes = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("rep")).withColumn("node", F.xxhash64(*key))
    classes = common.written(classes)  # read back, so that a large class can be split in the join
    members = common.written(sets.select("doc_id", "h", *key).join(classes, key, "left").select("doc_id", "h", "n_shingles", "rep", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")))
    # what stands for a class and shares a rare shingle with some other row
    ones = classes.select(F.col("rep").alias("doc_id"), *key, "node")
    indexed = sets.where(F.size("prefix") > 0).join(ones, ["doc_id", *key]).dropDuplicates(["doc_id", *key])
    indexed = common.written(indexed.drop("doc_id", "h").withColumn("n", F.col("n_shingles")))
    common.drop_written(sets)
    common.release(spark)
    cost = indexed.select("n", F.floor(4 * F.log2("n")).alias("class"), (F.size("prefix") * (F.size("prefix") - 1) / 2).alias("subsets"), (SCAN_COST * F.col("in_base")).alias("lists"))
    limit = boundary([tuple(r) for r in cost.groupBy("class").agg(F.max("n"), F.sum("subsets").cast("double"), F.sum("lists").cast("double")).collect()])
    # room: how large the overlap can be if this shingle (the second of this subset) is the first (second) common one
    room = lambda at: (F.col("n") - F.col("first") - at).cast("long").alias("room")
    pairs_of = F.flatten(F.transform("prefix", lambda x, i: F.transform(F.slice("prefix", i + 2, F.size("prefix")), lambda y, j: F.struct(F.xxhash64(x, y).alias("sig"), room(i + j)))))
    listed = F.transform(F.slice("prefix", 1, F.greatest(F.lit(1), "in_base")), lambda x, i: F.struct(x.alias("sig"), room(i)))
    small = indexed.where(F.col("n") * least <= 100 * limit).select(F.col("node").alias("d"), "n", F.explode(pairs_of).alias("e"), F.lit(0).alias("way"))
    large = indexed.where(F.col("n") > limit).select(F.col("node").alias("d"), "n", F.explode(listed).alias("e"), F.lit(1).alias("way"))
    entries = small.unionByName(large).select("e.sig", "way", "d", "n", "e.room")
    often = entries.groupBy("sig", "way").count().where("count > 1").drop("count")
    entries = common.written(entries.join(often, ["sig", "way"]))
    tested = edges = comps = None
    bytes_of = indexed.select(F.col("node").alias("d"), "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs.join(bytes_of.select(F.col("d").alias("u"), F.col("shingles").alias("set_a")), "u")
        both = left.join(bytes_of.select(F.col("d").alias("v"), F.col("shingles").alias("set_b")), "v").select("u", "v", "set_a", "set_b")
        return common.written(both.mapInArrow(_similar(least), "u long, v long"))

    def may_link(n1: Column, room1: Column, n2: Column, room2: Column) -> Column:
        """Sizes fit, and the overlap that this bucket leaves room for is enough. Linked sets meet so in their first bucket."""
        return _fits(n1, n2, least) & ((100 + least) * F.least(room1, room2) >= least * (n1 + n2))

    for step in range(len(ROUNDS) + 1):
        open_ = entries.withColumn("c", F.col("d")) if comps is None else entries.join(comps.select(F.col("node").alias("d"), F.col("component")), "d", "left").select("sig", "way", "d", "n", "room", F.coalesce("component", "d").alias("c"))
        last = step == len(ROUNDS)
        order = F.xxhash64(F.lit(step), F.pmod("sig", F.lit(1 if last else ROUNDS[step])), "d")
        mixed = open_.groupBy("sig", "way").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min(F.struct(order.alias("h"), "d", "n", "room", "c")).alias("centre")).where("low <> high")
        if not last:
            met = open_.join(mixed, ["sig", "way"]).where((F.col("c") != F.col("centre.c")) & may_link(F.col("n"), F.col("room"), F.col("centre.n"), F.col("centre.room")))
            pairs = met.select(F.least("d", "centre.d").alias("u"), F.greatest("d", "centre.d").alias("v")).distinct()
        else:
            maps = indexed.select(F.col("node").alias("d"), *[F.get("bitmap", F.lit(k)).alias(f"m{k}") for k in range(BITS // 64)])
            still = open_.join(mixed.select("sig", "way"), ["sig", "way"]).join(maps, "d")
            other = still.select("sig", "way", *[F.col(c).alias(f"{c}_") for c in ("d", "n", "room", "c", *maps.columns[1:])])
            differ = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"{m}_"))) for m in maps.columns[2:]), F.bit_count(F.col("m0").bitwiseXOR(F.col("m0_"))))
            close = (100 + least) * differ <= (100 - least) * (F.col("n") + F.col("n_"))  # else too few can be common
            met = still.join(other, ["sig", "way"]).where((F.col("d") < F.col("d_")) & (F.col("c") != F.col("c_")) & may_link(F.col("n"), F.col("room"), F.col("n_"), F.col("room_")) & close)
            pairs = met.select(F.col("d").alias("u"), F.col("d_").alias("v")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = common.written(pairs)
        if pairs.isEmpty():
            continue
        found = verified(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        edges = found if edges is None else edges.unionByName(found)
        comps = components(edges)
    if comps is None:
        return members.select("doc_id", "h", "n_shingles", F.coalesce("rep", "doc_id").alias("component_id"), F.col("node").alias("component"))
    # the least id of each component, whose node is only a hash
    linked = comps.join(classes.select("node", "rep"), "node")
    first = linked.groupBy("component").agg(F.min("rep").alias("first"))
    named = linked.select("node", "component").join(first, "component")
    out = members.join(named, "node", "left")
    return out.select("doc_id", "h", "n_shingles", F.coalesce("first", "rep", "doc_id").alias("component_id"), F.coalesce("component", "node").alias("component"))
