"""Operator 4, language-model scoring: context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions. Each decision has a tree over the bytes before it, most recent first, down to ``DEPTH`` of
them; a node holds a Krichevsky-Trofimov estimate, and every node mixes its own estimate with what its deeper contexts say,
by the weights of context-tree weighting: the block probability of a node is half its own and half the product of its
children's. Where the deeper context was never met in training, the mixture ends. The code length of a text sums over its
bytes and its end.

Training is counting: the counts of (context, byte) in the training texts are all that the trees need. Texts are dealt to
blocks of bounded size; a block sends its distinct grams, cut by the two most recent context bytes, to parts that build the
subtrees below these bytes; the few nodes above are merged from sums by context byte, of which there are 65,280 at most; each
part answers each block with the log probability of the grams that it asked for. Words and their counts travel the same way. A
block's messages are as large as its distinct grams and words, so the traffic follows the input. What goes to one part is
merged in a tree of ``FAN`` messages a step, and the answers come down the same tree: a task holds at most ``FAN`` lists of
distinct grams, however many blocks there are and however common its context bytes are.

Cases: a null text is an empty one, which has the end only. Without training rows every bit has probability 1/2 and every word
count is 0. Repeated rows are scored each for itself. A null id is not held out. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm import common

#: Context bytes; END closes a text and stands before it (no UTF-8 text holds it).
DEPTH, END = 5, 255
#: Bytes of messages that one part holds about.
PART_BYTES = 8 << 20
#: Messages to one part that a task merges.
FAN = 32
_U = np.uint64


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series after a shift by 8."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = x.copy()
    for k in range(1, 8):
        shift *= x + k
    return series - np.log(shift)


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - math.log(math.pi) - log_gamma(n0 + n1 + 1.0)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal neighbours, and the run of each element."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


class Tree:
    """The subtrees over sorted distinct grams; a gram is c1 c2 .. cD next, c1 the most recent context byte.

    ``levels[d][b]``: for the nodes (context of d bytes, first b bits of the next byte) in order of their keys.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, low: int, depth: int = DEPTH):
        self.grams, self.depth, self.low = grams, depth, low
        self.below = {}
        below = None  # (index of the parent gram, nodes by bit) of the level underneath
        keys, n = grams, counts.astype(np.float64)
        self.levels: dict[int, list[dict]] = {}
        self.up: dict[int, np.ndarray] = {}
        for d in range(depth, low - 1, -1):
            if d < depth:
                shorter = (keys >> _U(16)) << _U(8) | (keys & _U(255))
                order = np.argsort(shorter, kind="stable")
                ordered = shorter[order]
                starts, run = _runs(ordered)
                self.up[d + 1] = np.empty(len(keys), np.int64)
                self.up[d + 1][order] = run
                n = np.add.reduceat(n[order], starts) if len(starts) else n[:0]
                keys = ordered[starts]
            nodes = []
            for b in range(8):
                starts, run = _runs(keys >> _U(8 - b))
                ones = n * ((keys >> _U(7 - b)) & _U(1)).astype(np.float64)
                n1 = np.add.reduceat(ones, starts) if len(starts) else n[:0]
                total = np.add.reduceat(n, starts) if len(starts) else n[:0]
                own = kt_log(total - n1, n1)
                node = {"start": starts, "run": run, "n": total, "p1": (n1 + 0.5) / (total + 1.0), "own": own}
                if below is None:
                    node["w"] = own
                else:
                    child = below[b]
                    kids = np.bincount(run[self.up[d + 1][child["start"]]], weights=child["w"], minlength=len(starts))
                    node["kids"] = kids
                    node["w"] = np.logaddexp(own, kids) - math.log(2)
                nodes.append(node)
            self.levels[d] = nodes
            below = nodes
            self.keys, self.n = keys, n

    def summary(self) -> tuple[np.ndarray, ...]:
        """Of the lowest level kept: context's first byte, bit, prefix, n0, n1, ln of the weighted probability, per node."""
        out = [[] for _ in range(6)]
        for b, node in enumerate(self.levels[self.low]):
            key = self.keys[node["start"]]
            out[0].append((key >> _U(8 * self.low)).astype(np.int64) & 255)
            out[1].append(np.full(len(key), b))
            out[2].append(((key & _U(255)) >> _U(8 - b)).astype(np.int64))
            n1 = node["p1"] * (node["n"] + 1.0) - 0.5
            out[3].append(node["n"] - n1)
            out[4].append(n1)
            out[5].append(node["w"])
        return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)

    def gram_log(self, top: Top) -> np.ndarray:
        """ln probability of each gram's next byte after its context."""
        where = np.arange(len(self.grams))
        index = {self.depth: where}
        for d in range(self.depth, self.low, -1):
            index[d - 1] = self.up[d][index[d]]
        out = np.zeros(len(self.grams))
        nxt, c1 = (self.grams & _U(255)).astype(np.int64), (self.grams >> _U(8 * self.depth)).astype(np.int64)
        for b in range(8):
            bit = (nxt >> (7 - b)) & 1
            p = met = None
            for d in range(self.depth, self.low - 1, -1):
                node = self.levels[d][b]
                at = node["run"][index[d]]
                own = np.where(bit == 1, node["p1"][at], 1 - node["p1"][at])
                p, met = (own, node["n"][at] > 0) if p is None else (_mix(own, p, met, node["own"][at] - node["kids"][at]), node["n"][at] > 0)
            out += np.log(top.mixed(c1, b, nxt >> (8 - b), bit, p, met))
        return out


def _mix(own: np.ndarray, deeper: np.ndarray, met: np.ndarray, log_odds: np.ndarray) -> np.ndarray:
    """The node's estimate, weighed against the deeper one where that context was met."""
    share = 1 / (1 + np.exp(-np.clip(log_odds, -700, 700)))
    return np.where(met, share * own + (1 - share) * deeper, own)


class Top:
    """The nodes of contexts of no and of one byte, dense: [context byte, bit, prefix]."""

    def __init__(self, c1: np.ndarray, bit: np.ndarray, prefix: np.ndarray, n0: np.ndarray, n1: np.ndarray, kids: np.ndarray):
        shape = (256, 8, 128)
        zeros, ones, below = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        np.add.at(zeros, (c1, bit, prefix), n0)
        np.add.at(ones, (c1, bit, prefix), n1)
        np.add.at(below, (c1, bit, prefix), kids)
        own = kt_log(zeros, ones)
        self.n1, self.odds1, self.p1 = zeros + ones, own - below, (ones + 0.5) / (zeros + ones + 1)
        weighted = np.where(self.n1 > 0, np.logaddexp(own, below) - math.log(2), 0.0).sum(0)
        zeros, ones = zeros.sum(0), ones.sum(0)
        self.n0, self.odds0, self.p0 = zeros + ones, kt_log(zeros, ones) - weighted, (ones + 0.5) / (zeros + ones + 1)

    def mixed(self, c1: np.ndarray, b: int, prefix: np.ndarray, bit: np.ndarray, deeper: np.ndarray, met: np.ndarray) -> np.ndarray:
        side = lambda p: np.where(bit == 1, p, 1 - p)
        one = _mix(side(self.p1[c1, b, prefix]), deeper, met, self.odds1[c1, b, prefix])
        return _mix(side(self.p0[b, prefix]), one, self.n1[c1, b, prefix] > 0, self.odds0[b, prefix])


def gram_stream(raws: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(gram, text) at every byte and end of the texts."""
    if not raws:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat = np.frombuffer(b"".join(bytes([END]) * depth + raw + bytes([END]) for raw in raws), np.uint8)
    sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + depth + 1
    n = len(flat) - depth
    got = np.zeros(n, np.uint64)
    for j in range(depth):  # c1 is the byte just before
        got |= flat[depth - 1 - j : depth - 1 - j + n].astype(np.uint64) << _U(8 * (depth - j))
    got |= flat[depth:]
    ends = np.cumsum(sizes)
    place = np.arange(depth, depth + n)
    doc = np.searchsorted(ends, place, "right")
    real = place - (ends - sizes)[doc] >= depth
    return got[real], doc[real]


def _by_text(raws: list[bytes], most: int = 1 << 21):
    """Texts in runs of about ``most`` bytes and 60,000 texts at most; one longer text stands alone."""
    at, size = 0, 0
    for k, raw in enumerate(raws):
        if k > at and (size + len(raw) > most or k - at >= 60_000):
            yield at, k
            at, size = k, 0
        size += len(raw)
    if len(raws) > at:
        yield at, len(raws)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    starts, _ = _runs(flat[order])
    return flat[order][starts], np.add.reduceat(n[order], starts) if len(starts) else n[:0]


def _block_grams(raws: list[bytes], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a block in order, and their counts in its training texts."""
    keys, counts = [], []
    for at, to in _by_text(raws):
        for want in (True, False):  # grams of training texts count, others are asked for
            got = np.sort(gram_stream([raw for raw, t in zip(raws[at:to], train[at:to], strict=True) if t == want])[0])
            starts, _ = _runs(got)
            keys.append(got[starts])
            counts.append(np.diff(np.append(starts, len(got))) * want)
    return _merged(keys, counts)


def _block_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a block with the end (an empty word), in an order that rows don't matter to; their hashes; the
    code of every word; words of each text."""
    flat, per = common.words(texts)
    codes, vocabulary = common.coded(flat)
    vocabulary = pa.concat_arrays([vocabulary, pa.array([""])])
    h = common.hashes(vocabulary)
    order = np.argsort(h, kind="stable")
    if (h[order][1:] == h[order][:-1]).any():  # equal hashes: the words themselves decide
        order = np.asarray(sorted(order.tolist(), key=lambda k: (h[k], vocabulary[k].as_py())))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return vocabulary.take(pa.array(order)), h[order], place[codes], per


def _parts_of(grams: np.ndarray, count: int) -> np.ndarray:
    return (common.mixed(grams >> _U(8 * (DEPTH - 1))) % _U(count)).astype(np.int64)


def packed(values: np.ndarray, kind: str, ordered: bool = False) -> bytes:
    """Integers as compressed byte planes, in order as differences: two or three bytes for a gram of eight."""
    import zstandard

    values = np.diff(values, prepend=values.dtype.type(0)) if ordered else values
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(raw: bytes, kind: str, ordered: bool = False) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(values, dtype=values.dtype) if ordered else values


MESSAGE = "part int, unit int, words array<string>, grams binary, counts binary"


def _message(unit: int, rows: list[tuple]) -> pa.Table:
    """Rows (part, words or None, grams or None, counts) of a unit (a block, or a group of units)."""
    words = pa.array([None if r[1] is None else r[1].to_pylist() for r in rows], pa.list_(pa.string()))
    return pa.table({
        "part": pa.array([r[0] for r in rows], pa.int32()), "unit": pa.array([unit] * len(rows), pa.int32()), "words": words,
        "grams": pa.array([None if r[2] is None else packed(r[2], "<u8", True) for r in rows], pa.binary()), "counts": pa.array([packed(r[3], "<u8") for r in rows], pa.binary()),
    })


def _ask(part_count: int):
    """Block of texts -> messages of grams or words with training counts; parts of words follow those of grams."""

    def run(table: pa.Table) -> pa.Table:
        texts = pc.ascii_lower(common.filled(table.column("text")))
        train = ~table.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        grams, n = _block_grams(texts.cast(pa.binary()).to_pylist(), train)
        rows = common.messages(_parts_of(grams, part_count), part_count, lambda pick: (None, grams[pick], n[pick]))
        vocabulary, h, codes, per = _block_words(texts)
        m = np.bincount(codes, weights=np.repeat(train, per), minlength=len(vocabulary)).astype(np.int64)
        m[np.flatnonzero(pc.equal(vocabulary, "").to_numpy(zero_copy_only=False))] = train.sum()
        parts = (h % _U(part_count)).astype(np.int64)
        rows += [(part + part_count, *rest) for part, *rest in common.messages(parts, part_count, lambda pick: (vocabulary.take(pa.array(pick)), None, m[pick]))]
        return _message(table.column("block")[0].as_py(), rows)

    return run


def _combined(fan: int):
    """One part's messages of ``fan`` units -> one message with the sums of their counts."""

    def run(table: pa.Table) -> pa.Table:
        part, unit = table.column("part")[0].as_py(), table.column("unit")[0].as_py() // fan
        if table.column("grams")[0].as_py() is None:
            vocabulary, n, _, _ = _word_counts(table)
            return _message(unit, [(part, vocabulary, None, n)])
        return _message(unit, [(part, None, *_grams_of(table))])

    return run


NODE = "c1 int, bit int, prefix int, n0 double, n1 double, kids double"


def _grams_of(table: pa.Table, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """The sums of all messages, merged whenever ``most`` grams have come, so that not all are held at once."""
    keys, counts, held = [], [], 0
    for grams, n in zip(table.column("grams"), table.column("counts"), strict=True):
        keys.append(unpacked(grams.as_py(), "<u8", True))
        counts.append(unpacked(n.as_py(), "<u8").astype(np.int64))
        held += len(keys[-1])
        if held > most and len(keys) > 1:
            one = _merged(keys, counts)
            keys, counts, held = [one[0]], [one[1]], 0
    return _merged(keys, counts)


def _word_counts(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, list[int]]:
    """Distinct words in order, their counts, the code of each message's words, and the messages' lengths.

    A group's messages come in another order each time they are fetched, so the words are sorted: an answer to their sum is read by
    place."""
    lists = common.chunked(table.column("words"))
    codes, vocabulary = common.coded(lists.flatten())
    order = pc.sort_indices(vocabulary).to_numpy(zero_copy_only=False)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes, vocabulary = place[codes], vocabulary.take(pa.array(order))
    n = np.concatenate([unpacked(x, "<u8") for x in table.column("counts").to_pylist()]).astype(np.int64)
    sums = np.zeros(len(vocabulary), np.int64)
    np.add.at(sums, codes, n)
    return vocabulary, sums, codes, pc.list_value_length(lists).to_pylist()


def _summed(table: pa.Table) -> pa.Table:
    """One part's messages -> nodes above it; words give (-1, 0, 0, all tokens, distinct tokens, 0)."""
    if table.column("grams")[0].as_py() is None:
        _, n, _, _ = _word_counts(table)
        columns = [np.array([x]) for x in (-1, 0, 0, float(n.sum()), float((n > 0).sum()), 0.0)]
    else:
        grams, n = _grams_of(table)
        seen = n > 0
        columns = Tree(grams[seen], n[seen], 2).summary()
        if len(columns[0]):  # nodes of one context byte: add up what the second byte parts
            key = (columns[0] * 8 + columns[1]) * 128 + columns[2]
            distinct, at = np.unique(key, return_inverse=True)
            columns = [distinct // 1024, distinct // 128 % 8, distinct % 128, *(np.bincount(at, weights=c, minlength=len(distinct)) for c in columns[3:])]
    kinds = [pa.int32()] * 3 + [pa.float64()] * 3
    return pa.table([pa.array(np.asarray(c), t) for c, t in zip(columns, kinds, strict=True)], names=["c1", "bit", "prefix", "n0", "n1", "kids"])


ANSWER = "unit int, part int, value binary"


def _answer(asked: pa.Table, values: list[np.ndarray]) -> pa.Table:
    return pa.table({"unit": asked.column("unit"), "part": asked.column("part"), "value": pa.array([x.tobytes() for x in values], pa.binary())})


def _answered(asked: pa.Table, top: pa.Table) -> pa.Table:
    """One part's messages and the nodes above -> for each unit what it asked for, in the order asked.

    Grams are told log10 probabilities as 32-bit floats, words their training counts.
    """
    if not asked.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.binary())], names=["unit", "part", "value"])
    nodes = {k: np.concatenate([np.asarray(x) for x in top.column(k).to_pylist()]) if top.num_rows else np.zeros(0) for k in ("c1", "bit", "prefix", "n0", "n1", "kids")}
    said = nodes["c1"] < 0
    if asked.column("grams")[0].as_py() is None:
        _, n, codes, lengths = _word_counts(asked)
        return _answer(asked, np.split(n[codes].astype("<u8"), np.cumsum(lengths)[:-1]))
    part = {k: v[~said] for k, v in nodes.items()}
    above = Top(part["c1"].astype(int), part["bit"].astype(int), part["prefix"].astype(int), part["n0"], part["n1"], part["kids"])
    distinct, n = _grams_of(asked)
    value = Tree(distinct, n, 2).gram_log(above) / math.log(10)
    return _answer(asked, [value[np.searchsorted(distinct, unpacked(x.as_py(), "<u8", True))].astype("<f4") for x in asked.column("grams")])


def _passed_on(asked: pa.Table, told: pa.Table) -> pa.Table:
    """One part's messages of FAN units and the answer to their sum -> the answer to each unit."""
    if not asked.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.binary())], names=["unit", "part", "value"])
    answer = told.column("value")[0].as_py()
    if asked.column("grams")[0].as_py() is None:
        _, _, codes, lengths = _word_counts(asked)
        return _answer(asked, np.split(np.frombuffer(answer, "<u8")[codes], np.cumsum(lengths)[:-1]))
    distinct, value = _grams_of(asked)[0], np.frombuffer(answer, "<f4")
    return _answer(asked, [value[np.searchsorted(distinct, unpacked(x.as_py(), "<u8", True))] for x in asked.column("grams")])


SCORE = "doc_id {id}, held_out boolean, n_tokens long, n_known long, log_counts double, score double, n_bytes long"


def _scored(part_count: int):
    """One block's texts and the values of its grams and words -> scores. The block finds its grams again, in order."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        n = texts.num_rows
        names = ["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "score", "n_bytes"]
        if not n:
            return pa.table([pa.array([], t) for t in (texts.schema.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())], names=names)
        lower = pc.ascii_lower(common.filled(texts.column("text")))
        raws = lower.cast(pa.binary()).to_pylist()
        answers = dict(zip(told.column("part").to_pylist(), told.column("value").to_pylist(), strict=True))

        def in_order(parts: np.ndarray, first: int, kind: str) -> np.ndarray:
            out = np.empty(len(parts), kind)
            order = np.argsort(parts, kind="stable")
            out[order] = np.concatenate([np.frombuffer(answers[first + k], kind) for k in np.unique(parts).tolist()])
            return out

        grams, _ = _block_grams(raws, np.ones(n, bool))
        value = in_order(_parts_of(grams, part_count), 0, "<f4").astype(np.float64)
        score = np.zeros(n)
        for at, to in _by_text(raws):
            got, doc = gram_stream(raws[at:to])
            both = np.sort(got << _U(16) | doc.astype(np.uint64))
            got, doc = both >> _U(16), (both & _U(0xFFFF)).astype(np.int64)
            starts, run_ = _runs(got)
            each = value[np.searchsorted(grams, got[starts])]
            score[at:to] = np.bincount(doc, weights=each[run_], minlength=to - at)
        vocabulary, h, codes, per = _block_words(lower)
        counts = in_order((h % _U(part_count)).astype(np.int64), part_count, "<u8").astype(np.float64)
        end = counts[np.flatnonzero(pc.equal(vocabulary, "").to_numpy(zero_copy_only=False))[0]]
        doc, of = np.repeat(np.arange(n), per), counts[codes]
        logs = np.bincount(doc, weights=np.log10(of + 0.5), minlength=n) + np.log10(end + 0.5)
        known = np.bincount(doc, weights=of > 0, minlength=n).astype(np.int64) + int(end > 0)
        return pa.table([texts.column("doc_id"), texts.column("held_out"), pa.array(per + 1), pa.array(known), pa.array(logs), pa.array(score), pa.array(np.fromiter(map(len, raws), np.int64, n))], names=names)

    return run


def score_texts(df: DataFrame, held: Column, ident: str = "doc_id", text: str = "text", block_bytes: int = common.BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every whole text.

    ``held`` is an expression over the id (named doc_id); the other rows train. Nothing is collected but two totals.
    """
    blocks, total, units = common.in_blocks(df, ident, text, block_bytes)
    blocks = blocks.withColumn("held_out", held)
    kind = blocks.schema["doc_id"].dataType.simpleString()
    parts = max(4, min(1 << 20, total // (2 * PART_BYTES)))
    levels = [blocks.groupBy("block").applyInArrow(common.lean(_ask(parts)), MESSAGE)]
    group = F.floor(F.col("unit") / FAN).cast("int").alias("group")
    while units > FAN:
        levels.append(levels[-1].groupBy("part", group).applyInArrow(common.lean(_combined(FAN)), MESSAGE))
        units = -(-units // FAN)
        if len(levels) > 2:  # few and merged: no further step repeats what made them
            levels[-1] = common.written(levels[-1])
    nodes = levels[-1].groupBy("part").applyInArrow(common.lean(_summed), NODE)
    # at most 65,280 nodes and one row of totals, whatever the corpus
    nodes = nodes.groupBy("c1", "bit", "prefix").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "kids")])
    names = ("c1", "bit", "prefix", "n0", "n1", "kids")
    one = nodes.agg(F.sort_array(F.collect_list(F.struct(*names))).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in names])
    tops = one.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(2 * parts - 1))))
    told = levels[-1].groupBy("part").cogroup(tops.groupBy("part")).applyInArrow(common.lean(_answered), ANSWER)
    for level in levels[-2::-1]:
        told = level.groupBy("part", group).cogroup(told.groupBy("part", F.col("unit").alias("group"))).applyInArrow(common.lean(_passed_on), ANSWER)
    scored = blocks.groupBy("block").cogroup(told.withColumnRenamed("unit", "block").groupBy("block")).applyInArrow(common.lean(_scored(parts)), SCORE.format(id=kind))
    tokens = nodes.where("c1 < 0").agg(F.coalesce(F.sum("n0"), F.lit(0)).cast("long").alias("train_tokens"), F.coalesce(F.sum("n1"), F.lit(0)).alias("distinct"))
    out = scored.crossJoin(F.broadcast(tokens))  # one row
    base = F.col("log_counts") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.5 * (F.col("distinct") + 1))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score", "n_bytes", (-F.col("score") * math.log2(10) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"))
