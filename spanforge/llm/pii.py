"""Operator 13, personal data: exact patterns, and a linear-chain conditional random field over word shapes that adds spans.

The field is trained here, in numpy, on a small labelled table that rules write (``labelled_rows``). Words without a digit, ``@``,
``+`` or a written-out at sign beside them are never personal data, in training as in prediction, so a text falls into short runs
of the other words between fixed ends, and a batch of runs is decoded at once by Viterbi steps over padded matrices. Added spans
are of the same four kinds; they have to look whole (``_trimmed``) and may not touch a span that is known already.

Cases: a null text is empty; it has no spans. Very long texts and words, also of digits alone, take time in proportion to their
length. Repeated rows are rows of their own, ids may be null, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import common

#: The kinds in the order in which equal starts are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Text bytes that are looked at together; rows of the labelled table that are read at most.
SLICE_BYTES, MOST_ROWS = 1 << 20, 5000
#: Passes over the labelled table, step size and weight of the squared norm.
STEPS, RATE, NORM = 100, 0.15, 1e-4
LABELS = ("O", *(f"{edge}-{kind}" for kind in KINDS for edge in "BI"))
_WORD = re.compile(common.WORD)
_TRIGGER = re.compile(r"[0-9@+]")
#: An at sign or a dot written out between brackets.
_SIGN, _OPEN = re.compile(r"[\[({<](?:at|dot)[\])}>]", re.IGNORECASE), frozenset("[({<")
_AT_SIGNS, _DOTS = frozenset({"[at]", "(at)", "{at}", "<at>"}), frozenset({"[dot]", "(dot)", "{dot}", "<dot>"})
_EDGES = "\"'`.,;:!?%$&*#|<>[]{}=_~\\^/"
_CUES = {
    **dict.fromkeys("tel telephone phone call fax mobile cell telefon handy téléphone teléfono llame".split(), "phone"),
    **dict.fromkeys("card visa mastercard amex credit debit karte kreditkarte carte tarjeta".split(), "card"),
    **dict.fromkeys("ip host server address client login".split(), "ip"), **dict.fromkeys("mail email e-mail contact write correo courriel".split(), "email"),
    **dict.fromkeys("order invoice isbn id no nr number ref version sku part page token serial rechnung pedido facture".split(), "other"),
}


def _digits(text: str) -> int:
    return sum(map(text.count, "0123456789"))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _small_parts(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in text.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An address belongs to one at sign: what stands before it as far as its characters reach, and a domain after it."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            free = domain.end()
            yield start, free
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the patterns find, in order."""
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _small_parts(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(number := re.sub("[ -]", "", m[0])) <= 19 and luhn(number):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= _digits(m[0]) <= 15]
    return sorted(found)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


# Word shapes


def _core(word: str) -> tuple[int, int]:
    """Where a word stands without marks at its ends."""
    start, end = len(word) - len(word.lstrip(_EDGES)), len(word.rstrip(_EDGES))
    return (start, end) if start < end else (0, len(word))


def _bucket(n: int) -> str:
    return str(n) if n < 5 or n in (12, 15, 16) else next(name for most, name in ((6, "5+"), (8, "7+"), (11, "9+"), (14, "13+"), (19, "17+"), (1 << 62, "20+")) if n <= most)


def _shape(word: str, exact: bool) -> str:
    """Runs of letters as a, of digits as d (with their length if exact), of other characters as their first."""
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|(.)\1*", word[:80], re.DOTALL):
        if m[0][0] in "0123456789":
            out.append(f"d{min(len(m[0]), 20)}" if exact else "d")
        else:
            out.append(m[0][0] if m[1] else "a")
        if len(out) == 12:
            break
    return "".join(out)


def _cue(word: str) -> str:
    return _CUES.get(word.strip(_EDGES + "()-").lower(), "")


def _own(word: str) -> list[str]:
    """Features of a word that may be personal data."""
    low = word.lower()
    if low in _AT_SIGNS or low in _DOTS:
        return ["is:at" if low in _AT_SIGNS else "is:dot", "bias"]
    a, b = _core(word)
    core, n = word[a:b], _digits(word)
    kinds = [f"at:{min(core.count('@'), 2)}", f"plus:{core.startswith('+')}", f"colons:{min(core.count(':'), 3)}", f"hex:{bool(re.fullmatch('[0-9a-fA-F:]+', core)) and core.count(':') > 1}"]
    signs = any(s in low for s in _AT_SIGNS)
    return ["bias", "s:" + _shape(core, True), "c:" + _shape(core, False), f"n:{_bucket(n)}", f"letters:{any(map(str.isalpha, core))}:{n > 0}", f"written:{signs}", *kinds]


def _beside(word: str) -> str:
    """A neighbour in short: its written sign, its cue, or its coarse shape and digits."""
    low = word.lower()
    if low in _AT_SIGNS or low in _DOTS:
        return "at" if low in _AT_SIGNS else "dot"
    if _TRIGGER.search(word):
        a, b = _core(word)
        return f"{_shape(word[a:b], False)[:6]}:{_bucket(_digits(word))}"
    return "cue:" + _cue(word) if _cue(word) else "w"


class Runs:
    """The runs of candidate words in some texts: features of each word, by column of ``names``."""

    def __init__(self, texts: list[str]):
        words, self.text, self.start = [""], [-1], [0]  # an empty word stands between texts
        for k, text in enumerate(texts):
            for m in _WORD.finditer(text):
                words.append(m[0])
                self.text.append(k)
                self.start.append(m.start())
            words.append("")
            self.text.append(-1)
            self.start.append(0)
        self.words = words
        marked = np.fromiter((bool(_TRIGGER.search(w)) or bool(_SIGN.search(w)) for w in words), bool, len(words))
        signs = np.fromiter((w[:1] in _OPEN and bool(_SIGN.fullmatch(w)) for w in words), bool, len(words))
        real = np.fromiter(map(bool, words), bool, len(words))
        candidates = real & (marked | signs | np.r_[signs[1:], False] | np.r_[False, signs[:-1]])
        self.at = np.flatnonzero(candidates)
        first = np.r_[True, np.diff(self.at) > 1] if len(self.at) else np.zeros(0, bool)
        self.begins = np.flatnonzero(first)
        self.sizes = np.diff(np.r_[self.begins, len(self.at)])

    def features(self) -> Iterator[list[str]]:
        own, beside = {}, {}
        for i in self.at.tolist():
            word, before, after = self.words[i], self.words[i - 1], self.words[i + 1]
            far = self.words[i - 2] if i > 1 and before else ""
            if word not in own:
                own[word] = _own(word)
            for w in (before, after, far):
                if w not in beside:
                    beside[w] = _beside(w)
            yield [*own[word], f"end:{word[-1] in ',;.'}", f"ended:{before[-1:] in ',;.' and before != ''}", "p:" + beside[before], "q:" + beside[after], "pp:" + (beside[far] if beside[far][:4] == "cue:" else "")]


class Field:
    """A linear-chain conditional random field: weights of features by label, and of pairs of labels. Runs begin and end beside O."""

    def __init__(self, names: list[str]):
        self.names = {name: k for k, name in enumerate(names)}
        self.w, self.t = np.zeros((len(names) + 1, len(LABELS))), np.zeros((len(LABELS), len(LABELS)))  # the last row is for what was never met
        self.legal = np.array([[not b.startswith("I") or a[2:] == b[2:] and a != "O" for b in LABELS] for a in LABELS])

    def emissions(self, runs: Runs) -> np.ndarray:
        """(word, label): summed weights; words that look alike in all features share one sum."""
        known: dict[tuple, int] = {}
        codes = np.fromiter((known.setdefault(tuple(f), len(known)) for f in runs.features()), np.int64, len(runs.at))
        sums = np.array([self.w[[self.names.get(x, -1) for x in f]].sum(0) for f in known]) if known else np.zeros((0, len(LABELS)))
        return sums[codes]

    def pairs(self) -> np.ndarray:
        return np.where(self.legal, self.t, -1e9)

    def decoded(self, runs: Runs, emissions: np.ndarray) -> np.ndarray:
        """The best labels of all words, run by run: Viterbi over runs of like length, padded."""
        out, t = np.zeros(len(runs.at), np.int64), self.pairs()
        for rows, width in buckets(runs.sizes):
            sizes = runs.sizes[rows]
            where = runs.begins[rows][:, None] + np.minimum(np.arange(width), sizes[:, None] - 1)
            e, back = emissions[where], np.zeros((len(rows), width, len(LABELS)), np.int8)
            best, ends = t[0] + e[:, 0], np.zeros((len(rows), len(LABELS)))
            ends[sizes == 1] = best[sizes == 1]
            for k in range(1, width):
                into = best[:, :, None] + t
                back[:, k] = into.argmax(1)
                best = into.max(1) + e[:, k]
                ends[sizes == k + 1] = best[sizes == k + 1]
            label = (ends + t[:, 0]).argmax(1)
            for k in range(width - 1, -1, -1):
                live = sizes > k
                out[where[live, k]] = label[live]
                if k:
                    label = np.where(live, back[np.arange(len(rows)), k, label], label)
        return out

    def loss(self, e: np.ndarray, sizes: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Negative log-likelihood of padded runs (run, step, label), and its gradients by emission and by pair."""
        t, (n, width, m) = self.pairs(), e.shape
        rows, live = np.arange(n), np.arange(width) < sizes[:, None]
        sums = lambda x, axis: (top := x.max(axis)) + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))
        ahead, behind = np.zeros((n, width, m)), np.zeros((n, width, m))
        ahead[:, 0] = t[0] + e[:, 0]
        for k in range(1, width):
            ahead[:, k] = sums(ahead[:, k - 1, :, None] + t, 1) + e[:, k]
        for k in range(width - 1, -1, -1):
            last = sizes == k + 1
            behind[last, k] = t[:, 0]
            inner = sizes > k + 1
            if inner.any():
                behind[inner, k] = sums(t + (e[inner, k + 1] + behind[inner, k + 1])[:, None, :], 2)
        z = sums(ahead[:, 0] + behind[:, 0], 1)
        p = np.exp(ahead + behind - z[:, None, None]) * live[:, :, None]
        one = np.eye(m)[gold] * live[:, :, None]
        g = np.zeros((m, m))
        for k in range(1, width):
            on = sizes > k
            both = ahead[on, k - 1, :, None] + t + (e[on, k] + behind[on, k])[:, None, :] - z[on][:, None, None]
            g += np.exp(both).sum(0) - np.einsum("ra,rb->ab", one[on, k - 1], one[on, k])
        g[0] += p[:, 0].sum(0) - one[:, 0].sum(0)
        g[:, 0] += p[rows, sizes - 1].sum(0) - one[rows, sizes - 1].sum(0)
        steps = np.where(live[:, 1:], t[gold[:, :-1], gold[:, 1:]], 0.0)
        path = (e * one).sum() + steps.sum() + t[0, gold[:, 0]].sum() + t[gold[rows, sizes - 1], 0].sum()
        return float(z.sum() - path), p - one, np.where(self.legal, g, 0.0)

    def train(self, runs: Runs, gold: np.ndarray, steps: int = STEPS) -> float:
        """Adam on the whole table. Returns the mean loss of a run."""
        width, n = int(runs.sizes.max()), len(runs.sizes)
        where = runs.begins[:, None] + np.minimum(np.arange(width), runs.sizes[:, None] - 1)
        ids = [[self.names[x] for x in f] for f in runs.features()]
        hot = np.zeros((len(ids), len(self.w)))
        for k, own in enumerate(ids):
            hot[k, own] = 1
        slots, first, second, value = [self.w, self.t], [0.0, 0.0], [0.0, 0.0], 0.0
        for step in range(1, steps + 1):
            value, ge, gt = self.loss((hot @ self.w)[where], runs.sizes, gold[where])
            flat = np.zeros((len(ids), len(LABELS)))
            np.add.at(flat, where.ravel(), ge.reshape(-1, len(LABELS)))
            for k, (slot, grad) in enumerate(zip(slots, (hot.T @ flat, gt), strict=True)):
                grad = grad / n + NORM * slot
                first[k], second[k] = 0.9 * first[k] + 0.1 * grad, 0.99 * second[k] + 0.01 * grad * grad
                slot -= RATE * (1 - step / (steps + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return value / n


def buckets(sizes: np.ndarray, cells: int = 1 << 16) -> Iterator[tuple[np.ndarray, int]]:
    """Runs of like length together: (numbers of runs, the longest's length), about ``cells`` words or one run at a time."""
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        least = max(int(sizes[order[at]]), 1)
        to = int(np.searchsorted(sizes[order], 2 * least, "left"))
        to = max(at + 1, min(to, at + cells // (2 * least)))
        yield order[at:to], int(sizes[order[to - 1]])
        at = to


# The labelled table

_TEMPLATES = (
    "{p} said the rest", "see {p} for more", "und dann {p} oder nicht", "la suite {p} est là", "el resto {p} sigue", "{p}", "({p})", "| {p} | {p} |", "{p}, {p}.", "{p} {p} follow", "seen {phone} {p} here", "{phone} {ip}", "{card} {card} both", "{email}, {email}", "met {email} and {email}", "dinner (at) home, late", "all [at] once", "line one\n{p} line two", "they met {n} and left {p}", "{n} {p}",
    "in {n} it was {n} of {n}", "about {n}, not {n}.", "{n} {n} {n} {n} {n}", "table: {n} | {n} | {n}", "see {n}", "{n}", "call {phone}", "tel: {phone} or write {email}", "fax {phone}", "card {card} is valid", "credit card: {card}", "visa {card}",
    "login from {ip}", "server {ip} and {ip}", "mail to {email}", "contact {email}, {phone}", "write {email}.", "order {o} came", "invoice no {o}", "isbn {o}", "page {n} of {n}", "version {v} and {v}", "token = \"{hex}\"", "id {hex}", "on {date} at {time}", "{date} - {date}", "costs {money}, up {pct}", "{money} {pct} {n}", "follow @{name} now", "© {year} all", "since {year}, {year} and {year}", "{n}. item\n{n}. item", "{v} {date}",
)


def _labelled(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    user = lambda: rng.choice([letters(2, 9), f"{letters(2, 7)}.{letters(2, 8)}", f"{letters(2, 9)}.{d(2)}", f"{letters(3, 6)}{d(2)}", f"{letters(2, 5)}_{letters(2, 5)}"])
    tld = lambda: rng.choice(["com", "org", "net", "de", "fr", "es", "example"])
    host = lambda: rng.choice([letters(3, 9), f"mail{d(1)}.example", f"{letters(2, 5)}-{letters(2, 5)}"])
    byte = lambda: str(rng.randrange(256))
    group = lambda: f"{rng.randrange(1, 65536):x}"
    v6 = lambda: rng.choice([":".join(group() for _ in range(8)), f"{group()}:{group()}::{group()}", f"fe80::{group()}:{group()}:{group()}"])
    makers = {
        "email": lambda: rng.choice([f"{user()}@{host()}.{tld()}", f"{user()}@{host()}.{tld()}", f"{user()}@localhost", f"{user()} [at] {letters(3, 8)} [dot] {tld()}", f"{user()} (at) {letters(3, 8)} (dot) {tld()}", f"{user()}(at){letters(3, 8)}.{tld()}", f"{user()}[at]{letters(3, 8)}.{tld()}", f"{user()} [at] {letters(3, 8)}.{tld()}"]),
        "ip": lambda: rng.choice([".".join(byte() for _ in range(4)), ".".join(byte() for _ in range(4)), v6()]),
        "card": lambda: rng.choice([d(16), d(16), d(16), " ".join(d(4) for _ in range(4)), "-".join(d(4) for _ in range(4)), f"{d(4)} {d(6)} {d(5)}"]),
        "phone": lambda: rng.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"+{d(2)} {d(2)} {d(3)} {d(4)}", f"+{d(2)}{d(9)}", f"00{d(2)} {d(2)} {d(7)}", f"+{d(2)}-{d(3)}-{d(6)}"]),
        "n": lambda: rng.choice([d(1), d(2), d(3), d(4), d(5), d(6), d(8), d(10), f"{d(1)}.{d(2)}", f"{d(2)},{d(3)}", f"{d(1)},{d(3)},{d(3)}", f"{d(2)}-{d(2)}", f"{d(1)}st", f"{letters(1, 2).upper()}-{d(4)}", f"{d(2)}:{d(1)}", f"x{d(2)}", f"#{d(3)}", f"{letters(3, 6)}{d(2)}", f"{d(1)}.", f"+{d(1)}", f"{d(1)}.{d(1)}.", f"{d(1)}+{d(1)}", d(7), d(20), d(24)]),
        "o": lambda: rng.choice([d(8), d(9), d(10), d(11), d(13), f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(4)}-{d(4)}", f"{letters(2, 2).upper()}{d(9)}"]),
        "v": lambda: rng.choice([f"{d(1)}.{d(1)}.{d(1)}", f"v{d(1)}.{d(2)}", f"{d(1)}.{d(2)}.{d(3)}", f"{d(1)}.{d(1)}.{d(1)}-rc{d(1)}"]),
        "hex": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 12, 32, 40]))), "date": lambda: rng.choice([f"{rng.randrange(1950, 2030)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{rng.randrange(1950, 2030)}", f"{d(1)}.{d(1)}.{rng.randrange(1950, 2030)}", f"{d(2)}.{d(2)}.{d(2)}"]),
        "time": lambda: f"{d(2)}:{d(2)}", "money": lambda: rng.choice([f"${d(2)}.{d(2)}", f"{d(3)}€", f"{d(1)},{d(3)}.{d(2)}"]), "pct": lambda: f"{rng.choice(['', '+'])}{d(2)}%", "name": lambda: letters(3, 9), "year": lambda: str(rng.randrange(1900, 2040)),
    }
    text, spans = "", []
    for piece in re.split(r"(\{\w+\})", rng.choice(_TEMPLATES)):
        if piece[:1] == "{":
            kind = rng.choice(KINDS) if piece == "{p}" else piece[1:-1]
            made = makers[kind]()
            if kind in KINDS:
                spans.append((len(text), KINDS.index(kind), len(text) + len(made)))
            piece = made
        text += piece
    return text, spans


def labelled_rows(n: int = 1500, seed: int = 13) -> list[tuple[str, str]]:
    """(text, spans): the small labelled table, written by templates and rules for each kind and for what only looks like it."""
    rng = random.Random(seed)
    return [(text, listed(spans)) for text, spans in (_labelled(rng) for _ in range(n))]


def labelled_table(spark: SparkSession, n: int = 1500, seed: int = 13) -> DataFrame:
    return spark.createDataFrame(labelled_rows(n, seed), "text string, spans string")


def gold_labels(runs: Runs, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Labels of the runs' words: a word belongs to the span that it meets."""
    out = np.zeros(len(runs.at), np.int64)
    for j, i in enumerate(runs.at.tolist()):
        a = runs.start[i]
        for start, kind, end in spans[runs.text[i]]:
            if a < end and a + len(runs.words[i]) > start:
                out[j] = 1 + 2 * kind + (a > start)
                break
    return out


def unlisted(spans: str) -> list[tuple[int, int, int]]:
    return [(int(a), KINDS.index(kind), int(b)) for kind, a, b in (x.split(":") for x in spans.split(",") if x)]


def fit(table: DataFrame, most: int = MOST_ROWS) -> Field:
    """Trains on at most ``most`` rows (text, spans) of a labelled table."""
    rows = [(r.text, unlisted(r.spans or "")) for r in table.where("text IS NOT NULL").orderBy("text", "spans").limit(most).collect()]
    runs = Runs([text for text, _ in rows])
    field = Field(sorted({x for f in runs.features() for x in f}))
    if len(runs.at):
        field.train(runs, gold_labels(runs, [spans for _, spans in rows]))
    return field


# Prediction

#: An address whose at sign or dots may be written out.
_WRITTEN = re.compile(r"[\w.%+-]+\s?(@|[\[({<]at[\])}>])\s?([\w-]+(?:(?:\.|\s?[\[({<]dot[\])}>]\s?)[\w-]+)*)", re.IGNORECASE)
_V6 = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")


def _trimmed(text: str, start: int, kind: int, end: int) -> tuple[int, int, int] | None:
    """The span without marks at its ends, or None if it is not a whole value of its kind."""
    piece = text[start:end]
    if kind == 0:
        a, b = len(piece) - len(piece.lstrip("\"'<([{.,;:|*#")), len(piece.rstrip("\"'>)]}.,;:!?|%$&*#"))
        found = _WRITTEN.fullmatch(piece, a, max(a, b))
        return (start + a, 0, start + b) if found and (found[1] == "@" or re.search(r"\.|dot", found[2], re.IGNORECASE)) else None
    if kind == 1:
        found = _IP.search(piece)
        if found and not _small_parts(found[0]):
            found = None
        found = found or next((m for m in _V6.finditer(piece) if re.search("[0-9]", m[0])), None)
        return (start + found.start(), 1, start + found.end()) if found else None
    marks = [k for k, ch in enumerate(piece) if ch in "0123456789"]
    n = len(marks)
    if not (12 <= n <= 19 if kind == 2 else 9 <= n <= 15):
        return None
    a, b = marks[0], marks[-1] + 1
    if kind == 2:
        return (start + a, 2, start + b) if re.fullmatch(r"[0-9 -]+", piece[a:b]) else None
    while a and piece[a - 1] in "+(" and (piece[a - 1] == "+" or piece.count(")", a, b) > piece.count("(", a, b)):
        a -= 1
    return (start + a, 3, start + b) if re.fullmatch(r"[0-9 +().-]+", piece[a:b]) else None


def added_spans(field: Field, texts: list[str], known: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """The spans that the field adds to those known of each text; they touch neither these nor each other."""
    runs, out = Runs(texts), [[] for _ in texts]
    if not len(runs.at):
        return out
    labels = field.decoded(runs, field.emissions(runs))
    kinds, inside = (labels - 1) // 2, (labels > 0) & (labels % 2 == 0)
    begins = np.flatnonzero((labels > 0) & ~inside)
    for j in begins.tolist():
        to = j + 1
        while to < len(labels) and inside[to] and kinds[to] == kinds[j] and runs.at[to] == runs.at[to - 1] + 1:
            to += 1
        i, last = int(runs.at[j]), int(runs.at[to - 1])
        k = runs.text[i]
        if found := _trimmed(texts[k], runs.start[i], int(kinds[j]), runs.start[last] + len(runs.words[last])):
            out[k].append(found)
    for k, own in enumerate(out):
        if own:
            starts, reached, free = [a for a, _, _ in known[k]], np.maximum.accumulate([0, *(b for _, _, b in known[k])]), []
            for span in own:
                if reached[bisect.bisect_left(starts, span[2])] <= span[0] and (not free or free[-1][2] <= span[0]):
                    free.append(span)
            out[k] = free
    return out


def personal_data(df: DataFrame, field: Field, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every whole text; one map, no exchange."""
    slim = df.select(df[ident].alias("doc_id"), df[text].cast("string").alias("text"))
    names = ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", SLICE_BYTES):
            texts = common.filled(part.column("text"))
            some = np.flatnonzero(pc.match_substring_regex(texts, r"[0-9@+]|(?i)[\[({<](at|dot)[\])}>]").to_numpy(zero_copy_only=False))
            picked = texts.take(pa.array(some)).to_pylist()
            base = [base_spans(x) for x in picked]
            more = added_spans(field, picked, base)
            counts, sums, spans = np.zeros((len(KINDS), len(texts)), np.int64), [hashlib.sha256(b"").hexdigest()] * len(texts), [""] * len(texts)
            for k, own, new in zip(some.tolist(), base, more, strict=True):
                for _, kind, _ in own:
                    counts[kind, k] += 1
                sums[k], spans[k] = hashlib.sha256(listed(own).encode()).hexdigest(), listed(sorted(own + new))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in counts), pa.array(sums), pa.array(spans)], names)

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{kind} long" for kind in KINDS) + ", base_sha256 string, spans string")
