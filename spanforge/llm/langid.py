"""Operator 1, language identification: a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time on a bounded sample of labelled rows. It labels every
byte position; a document's probabilities are the mean over the positions of letters. Texts are read whole, in spans of
``SPAN`` bytes that form the rows of a matrix; each direction starts ``AROUND`` bytes outside its span, so that positions at
the edges have seen their neighbours too.

Cases: a null text, an empty one, and one without letters (Unicode category L) is ``und`` with score 0; so is every text if
no labelled row could be learned from. Repeated rows and very long texts are ordinary. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm import common

#: Labelled rows in the training sample at most, and bytes of their texts; both are shared evenly by the languages.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 64 << 20
#: Units of a direction, bytes of a training row, rows of a batch, steps.
UNITS, WINDOW, BATCH, STEPS = 12, 40, 192, 260
#: When predicting: bytes of a row, bytes read on either side of it, rows at once.
SPAN, AROUND, ROWS = 96, 8, 1024
_ASCII_LETTER = np.array([chr(b).isalpha() for b in range(128)] + [False] * 128)
_LETTER = _ASCII_LETTER | (np.arange(256) >= 128)
#: The network sees A-Z lower-cased.
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Direction:
    """One gated recurrent layer; gates stand in the order update, reset, candidate."""

    def __init__(self, units: int, rng: np.random.Generator):
        self.units = units
        self.w = {
            "x": rng.normal(0, 0.1, (256, 3 * units)).astype(np.float32),
            "u": rng.normal(0, units**-0.5, (units, 3 * units)).astype(np.float32),
            "b": np.zeros(3 * units, np.float32),
        }

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, list]:
        """States (time, row, unit) of codes (time, row), and what the way back needs."""
        n, k = codes.shape[1], self.units
        h, states, tape = np.zeros((n, k), np.float32), [], []
        for row in codes:
            into, rec = self.w["x"][row] + self.w["b"], h @ self.w["u"]
            gates = _sigmoid(into[:, : 2 * k] + rec[:, : 2 * k])
            z, r = gates[:, :k], gates[:, k:]
            c = np.tanh(into[:, 2 * k :] + r * rec[:, 2 * k :])
            tape.append((row, h, z, r, c, rec[:, 2 * k :]))
            h = z * h + (1 - z) * c
            states.append(h)
        return np.stack(states), tape

    def backward(self, tape: list, d_states: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients by backpropagation through time."""
        k, grads = self.units, {name: np.zeros_like(w) for name, w in self.w.items()}
        dh = np.zeros_like(d_states[0])
        for (row, before, z, r, c, rec_c), d in zip(reversed(tape), d_states[::-1], strict=True):
            dh = dh + d
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (before - c) * z * (1 - z)
            dr = dc * rec_c * r * (1 - r)
            d_in = np.concatenate([dz, dr, dc], 1)
            d_rec = np.concatenate([dz, dr, dc * r], 1)
            np.add.at(grads["x"], row, d_in)
            grads["b"] += d_in.sum(0)
            grads["u"] += before.T @ d_rec
            dh = dh * z + d_rec @ self.w["u"].T
        return grads

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights for prediction, (gate, byte) and (gate, unit and a constant 1).

        A state h is kept as g = (1 + h) / 2, so that tanh is a sigmoid too; signs and factors are those of 1 / (1 + exp(x)).
        """
        factor = np.concatenate([np.full(2 * self.units, -1.0), np.full(self.units, -2.0)]).astype(np.float32)
        u = np.concatenate([2 * self.w["u"], -self.w["u"].sum(0, keepdims=True)])
        return np.ascontiguousarray(((self.w["x"] + self.w["b"]) * factor).T), np.ascontiguousarray((u * factor).T)


class Network:
    """Both directions and a softmax over languages at every position."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.languages, self.rng = languages, rng
        self.sides = [Direction(units, rng), Direction(units, rng)]
        self.out = {"v": rng.normal(0, 0.1, (2 * units, len(languages))).astype(np.float32), "c": np.zeros(len(languages), np.float32)}

    def loss(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[dict[str, np.ndarray]]]:
        """Mean cross-entropy over all positions of codes (time, row), and gradients of [forward, backward, output]."""
        k = self.sides[0].units
        ahead, tape_a = self.sides[0].forward(codes)
        back, tape_b = self.sides[1].forward(codes[::-1])
        both = np.concatenate([ahead, back[::-1]], 2)
        logits = both @ self.out["v"] + self.out["c"]
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        rows = np.arange(codes.shape[1])
        value = float(-np.log(p[:, rows, labels] + 1e-9).mean())
        p[:, rows, labels] -= 1
        p /= codes.size
        d_both = p @ self.out["v"].T
        flat = p.reshape(-1, p.shape[2])
        out = {"v": both.reshape(-1, 2 * k).T @ flat, "c": flat.sum(0)}
        return value, [self.sides[0].backward(tape_a, d_both[:, :, :k]), self.sides[1].backward(tape_b, d_both[::-1, :, k:]), out]

    def train(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, rate: float = 0.02) -> float:
        """Adam on random windows; every language is drawn as often. Returns the last smoothed loss."""
        by = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        slots = [side.w for side in self.sides] + [self.out]
        first, second = ([{n: np.zeros_like(w) for n, w in slot.items()} for slot in slots] for _ in range(2))
        smooth = 0.0
        for step in range(1, steps + 1):
            y = self.rng.integers(0, len(by), BATCH)
            picked = [texts[by[k][self.rng.integers(len(by[k]))]] for k in y]
            codes = np.full((BATCH, WINDOW), 32, np.uint8)
            for k, text in enumerate(picked):
                at = int(self.rng.integers(0, max(1, len(text) - WINDOW + 1)))
                piece = text[at : at + WINDOW]
                codes[k, : len(piece)] = _LOWER[np.frombuffer(piece, np.uint8)]
            value, grads = self.loss(np.ascontiguousarray(codes.T), y)
            smooth = value if step == 1 else 0.95 * smooth + 0.05 * value
            size = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for slot, grad, m, v in zip(slots, grads, first, second, strict=True):
                for name, w in slot.items():
                    g = np.clip(grad[name], -1, 1)
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    w -= size * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
        return smooth

    def frozen(self) -> Predictor:
        v = self.out["v"].reshape(2, -1, len(self.languages))
        ends = [np.concatenate([2 * own, -own.sum(0, keepdims=True)]) for own in v]
        ends[0][-1] += self.out["c"]
        return Predictor(self.languages, [(*side.folded(), np.ascontiguousarray(own.T)) for side, own in zip(self.sides, ends, strict=True)])


class Predictor:
    """The trained weights, small enough to travel with a function."""

    def __init__(self, languages: list[str], sides: list):
        self.languages, self.sides = languages, sides

    @staticmethod
    def _add_logits(codes: np.ndarray, table: np.ndarray, u: np.ndarray, v: np.ndarray, out: np.ndarray) -> None:
        """Adds what one direction says of codes (time, row) to out (time, language, row).

        Rows are the last axis throughout, so every step is a pass over whole contiguous arrays.
        """
        k, n = u.shape[1] - 1, codes.shape[1]
        state, into, rec, told = np.full((k + 1, n), 0.5, np.float32), np.empty((3 * k, n), np.float32), np.empty((3 * k, n), np.float32), np.empty((len(v), n), np.float32)
        state[k] = 1
        h, gates, c = state[:k], rec[: 2 * k], rec[2 * k :]
        for t in range(len(codes)):
            np.take(table, codes[t].astype(np.intp), axis=1, out=into, mode="clip")
            np.dot(u, state, out=rec)
            gates += into[: 2 * k]
            np.exp(gates, out=gates)
            gates += 1
            np.divide(1, gates, out=gates)
            c *= gates[k:]
            c += into[2 * k :]
            np.exp(c, out=c)
            c += 1
            np.divide(1, c, out=c)
            h -= c
            h *= gates[:k]
            h += c
            out[t] += np.dot(v, state, out=told)

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities (time, language, row) at every position of codes (time, row)."""
        p = np.zeros((len(codes), len(self.languages), codes.shape[1]), np.float32)
        with np.errstate(over="ignore"):  # a gate that is shut: 1 / (1 + inf)
            self._add_logits(codes, *self.sides[0], p)
            self._add_logits(codes[::-1], *self.sides[1], p[::-1])
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p

    def pooled(self, raws: list[bytes]) -> np.ndarray:
        """Mean probabilities of each text's letter positions; zeros where it has none."""
        n, classes = len(raws), len(self.languages)
        sizes = np.fromiter((-(-len(x) // SPAN) for x in raws), np.int64, n)
        total = int(sizes.sum())
        flat = np.frombuffer(b" " * AROUND + b"".join(x.ljust(s * SPAN) for x, s in zip(raws, sizes, strict=True)) + b" " * AROUND, np.uint8)
        rows = np.lib.stride_tricks.as_strided(flat, (total, SPAN + 2 * AROUND), (SPAN, 1), writeable=False)
        last = np.zeros(total + 1, bool)
        last[np.cumsum(sizes)] = True  # the row after a text's last one: nothing of another text is seen
        sums, letters = np.zeros((total, classes)), np.zeros(total)
        for at in range(0, total, ROWS):
            codes = rows[at : at + ROWS].copy()
            codes[last[at : at + len(codes)], :AROUND] = 32
            codes[last[at + 1 : at + 1 + len(codes)], -AROUND:] = 32
            codes = np.ascontiguousarray(codes.T)
            mask = _LETTER[codes].astype(np.float32)
            mask[:AROUND], mask[-AROUND:] = 0, 0
            sums[at : at + ROWS] = np.einsum("tcn,tn->nc", self.positions(_LOWER[codes]), mask)
            letters[at : at + ROWS] = mask.sum(0)
        doc = np.repeat(np.arange(n), sizes)
        held = np.bincount(doc, weights=letters, minlength=n)
        return np.stack([np.bincount(doc, weights=sums[:, k], minlength=n) for k in range(classes)], 1) / np.maximum(held, 1)[:, None]


def has_letter(raw: bytes, text: str) -> bool:
    return bool(_ASCII_LETTER[np.frombuffer(raw, np.uint8)].any()) or any(ch.isalpha() for ch in text)


def fit(df: DataFrame, learn: Column, ident: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> Predictor | None:
    """Trains on whole texts of at most ``rows`` labelled rows among those where ``learn`` holds.

    Each language gives as many, the first by a hash of their ids whose texts fit into its share of ``most`` bytes, and one at
    least. None if there is no row to learn from.
    """
    own = df.where(learn & F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.xxhash64(F.lit(11), F.col(ident)).alias("mark"), F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"))
    counts = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return None
    share = max(1, rows // len(counts))
    # a threshold on the hash first, so that what is dealt does not grow with the table
    below = {name: min((1 << 63) - 1, -(1 << 63) + int(min(1.0, (1.25 * share + 20) / n) * (1 << 64))) for name, n in counts.items()}
    limit = F.create_map(*[F.lit(x) for pair in below.items() for x in pair])
    some = own.where(F.col("mark") <= F.element_at(limit, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("mark", "text")
    some = some.select("*", F.row_number().over(order).alias("nth"), F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("bytes"))
    some = some.where((F.col("nth") == 1) | (F.col("nth") <= share) & (F.col("bytes") <= most // len(counts)))
    got = [(r.lang, r.text.encode()) for r in some.orderBy("mark", "lang", "text").collect()]
    got = [(lang, raw) for lang, raw in got if has_letter(raw, raw.decode())]
    if not got:
        return None
    languages = sorted({lang for lang, _ in got})
    network = Network(languages)
    network.train([raw for _, raw in got], np.array([languages.index(lang) for lang, _ in got]))
    return network.frozen()


def labelled(model: Predictor | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    raws = texts.cast(pa.binary()).to_pylist()
    real = np.array([has_letter(raw, "") or (not raw.isascii() and has_letter(raw, raw.decode())) for raw in raws], bool)
    names, scores = ["und"] * len(raws), np.zeros(len(raws))
    if model is not None and real.any():
        where = np.flatnonzero(real)
        p = model.pooled([raws[k] for k in where])
        best = p.argmax(1)
        scores[where] = np.clip(p[np.arange(len(where)), best], 0, 1)
        for k, b in zip(where, best, strict=True):
            names[k] = model.languages[b]
    return names, scores


def identify(df: DataFrame, model: Predictor | None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    slim = df.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text"):
            names, scores = labelled(model, common.filled(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def filtered(df: DataFrame, model: Predictor | None, least: float, text: str = "text") -> DataFrame:
    """The rows of df, all columns, in which a language is recognised with ``least`` probability or more; one map, no join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, text):
            names, scores = labelled(model, common.filled(part.column(text)))
            yield part.filter(pa.array([name != "und" and score >= least for name, score in zip(names, scores, strict=True)]))

    return df.mapInArrow(run, df.schema)
