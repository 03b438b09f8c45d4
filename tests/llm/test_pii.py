"""Operator 13 against its patterns as they stand, against enumeration, and on labelled rows that it has not seen."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from spanforge.llm import pii
from tests.llm.helpers import frame, odd_rows

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    """The patterns by themselves, one after another."""
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            fits = (
                True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True,
                12 <= len(digits) <= 19 and sum(x // 10 + x % 10 for x in doubled) % 10 == 0, 9 <= len(digits) <= 15,
            )[kind]
            if fits:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(5))
def test_base_spans_are_the_patterns(seed):
    rng = random.Random(seed)
    pieces = ["a.b", "@", "@x", ".", ".de", "-", " ", "+", "+1", "(", ")", "1.2.3.4", "255", "256.", "0000255.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+49 30 1234567", "é", "\n", "x@y.z@w.v", "%"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) if rng.random() < 0.6 else rng.choice("0123456789.@+ -ab") for _ in range(rng.randrange(25)))
        assert pii.base_spans(text) == plain_base(text), text


def test_long_texts_take_linear_time():
    began = time.time()
    for text in ("1" * 300_000, "x" * 300_000, "x" * 300_000 + "@", "+1" + " " * 300_000, "1." * 150_000, "a@b." * 70_000, "1 " * 150_000, "0" * 200_000 + ".1.1.1", "@" * 200_000):
        pii.base_spans(text)
    assert time.time() - began < 10


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(pii.labelled_table(spark))


def test_held_out_rows(field):
    rows = [(text, set(pii.unlisted(spans))) for text, spans in pii.labelled_rows(1500, seed=99)]
    got = [set(x) for x in pii.added_spans(field, [text for text, _ in rows], [[] for _ in rows])]
    hits = sum(len(g & want) for g, (_, want) in zip(got, rows, strict=True))
    assert hits >= 0.97 * sum(map(len, got)) and hits >= 0.95 * sum(len(want) for _, want in rows)


def test_spans_beyond_the_patterns(field):
    found = lambda text: [(pii.KINDS[k], text[a:b]) for a, k, b in pii.added_spans(field, [text], [pii.base_spans(text)])[0]]
    assert found("write to anna.may [at] example [dot] org today") == [("email", "anna.may [at] example [dot] org")]
    assert found("ring (030) 555-7713, or not") == [("phone", "(030) 555-7713")]
    assert found("the card 9807915762804490 here") == [("card", "9807915762804490")]
    assert found("le +1 (826) 555-4081 190.137.223.204 du") == [("phone", "+1 (826) 555-4081")]
    for clean in ("in 2001 it was 3.14 of 12,500", "1. one\n2. two\n1.2. three", "version 1.2.3 on 2024-05-01 at 12:30", 'token = "5d190bd7c06284de91015a36974748794293dd8a"', "1 2 3 4 5 6 7 8 9 10 11 12", "no numbers at all, (at) home", "follow @anna now"):
        assert found(clean) == [] and pii.base_spans(clean) == []


def random_field(rng, m):
    field = pii.Field(["a"])
    field.t = rng.normal(0, 1, field.t.shape)
    return field, rng.normal(0, 2, (m, len(pii.LABELS)))


class Chain:
    """Runs of given sizes, without texts."""

    def __init__(self, sizes):
        self.sizes = np.array(sizes)
        self.begins = np.cumsum([0, *sizes[:-1]])
        self.at = np.arange(sum(sizes))


def scored(field, e):
    """All labellings of a run with their scores."""
    t = field.pairs()
    for y in itertools.product(range(len(pii.LABELS)), repeat=len(e)):
        yield t[0, y[0]] + sum(e[k, y[k]] for k in range(len(e))) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)) + t[y[-1], 0], y


def test_viterbi_and_likelihood_against_enumeration():
    rng = np.random.default_rng(0)
    sizes = [1, 3, 2, 4, 1, 3]
    field, e = random_field(rng, sum(sizes))
    got, want, z = field.decoded(Chain(sizes), e), [], []
    for a, n in zip(Chain(sizes).begins, sizes, strict=True):
        every = list(scored(field, e[a : a + n]))
        want += max(every)[1]
        z.append(np.log(np.exp([s for s, _ in every]).sum()))
    assert got.tolist() == want
    chain = Chain(sizes)
    where = chain.begins[:, None] + np.minimum(np.arange(4), chain.sizes[:, None] - 1)
    gold = got[where]
    value = field.loss(e[where], chain.sizes, gold)[0]
    assert np.isclose(value, sum(z) - sum(max(scored(field, e[a : a + n]))[0] for a, n in zip(chain.begins, sizes, strict=True)))


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    chain = Chain([3, 1, 2])
    field, e = random_field(rng, 6)
    where = chain.begins[:, None] + np.minimum(np.arange(3), chain.sizes[:, None] - 1)
    gold = np.array([0, 1, 2, 0, 5, 6])[where]
    _, ge, gt = field.loss(e[where], chain.sizes, gold)
    flat = np.zeros_like(e)
    np.add.at(flat, where.ravel(), ge.reshape(-1, e.shape[1]))
    at = lambda: field.loss(e[where], chain.sizes, gold)[0]
    for table, grad in ((e, flat), (field.t, gt)):
        for _ in range(25):
            i, j = rng.integers(table.shape[0]), rng.integers(table.shape[1])
            held = table[i, j]
            table[i, j] = held + 1e-5
            up = at()
            table[i, j] = held - 1e-5
            down = at()
            table[i, j] = held
            assert np.isclose((up - down) / 2e-5, grad[i, j], atol=1e-5)


def test_long_and_short_runs_decode_alike(field):
    """Padding and buckets change nothing: texts together give what each gives alone."""
    texts = [text for text, _ in pii.labelled_rows(200, seed=5)] + ["12 34 " * 2000, "", "+1 (030) 555-1234 " * 50]
    together = pii.added_spans(field, texts, [[] for _ in texts])
    assert together == [pii.added_spans(field, [text], [[]])[0] for text in texts]


def test_query_rows_match_the_parts(spark, field):
    personal = ["a@b.example", "call +1 (017) 555-7713 or (017) 555-7714", "127.0.0.1 and 4111 1111 1111 1111", "ünï 😀 card 1234567812345678, x [at] y [dot] com", "+1 (826) 555-4081 " * 30, "9" * 5000]
    rows = [*odd_rows(n=12), *((3000 + k, t, *[None] * 10) for k, t in enumerate(personal * 2))]
    got = pii.personal_data(frame(spark, rows).repartition(3), field).collect()
    want = []
    for ident, text, *_ in rows:
        text = text or ""
        base = plain_base(text)
        spans = sorted(base + pii.added_spans(field, [text], [base])[0])
        counts = [sum(kind == k for _, kind, _ in base) for k in range(4)]
        want.append((ident if ident is not None else -1, *counts, hashlib.sha256(pii.listed(base).encode()).hexdigest(), pii.listed(spans)))
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got) == sorted(want)
    assert pii.personal_data(frame(spark, []), field).collect() == [] and pii.fit(pii.labelled_table(spark, 0 + 1)).names
