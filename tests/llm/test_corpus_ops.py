"""Operators that compare rows of a corpus, against brute force."""

import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanforge.llm import common, ctw, jaccard, line_templates, mixing, substrings, url_rules
from spanforge.llm.components import components
from spanforge.llm.fm_index import FMIndex, WaveletMatrix, suffix_array
from spanforge.llm.queries import URL_RULES, held_out
from tests.llm.helpers import LOWER, SCHEMA, frame, odd_rows, prose, words


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_components(spark, seed):
    rows = odd_rows(seed, 40)
    rng = random.Random(seed)
    base = prose(rng, 90, 10_000).split()  # a group of near copies, some too far from others
    for k in range(60):
        copy = list(base)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(1000)}"
        rows.append((500 + k, " ".join(copy), *[None] * 10))
    for k in range(30):  # short sets, around the smallest overlaps
        short = base[:6] + [f"s{rng.randrange(4)}" for _ in range(rng.randrange(0, 4))]
        rows.append((700 + k, " ".join(short), *[None] * 10))
    got = jaccard.jaccard_classes(frame(spark, rows), block_bytes=4096).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_rows_that_repeat_an_id_keep_their_own_links(spark):
    rng = random.Random(9)
    a, b = prose(rng, 60, 10_000), prose(rng, 60, 10_000)
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (9, prose(rng, 30, 10_000))]
    for size in (1 << 20, 64):
        got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=size).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (9, 9)]


def test_boundary_weighs_both_ways():
    assert jaccard.boundary([(0, 10, 5.0, 50.0), (1, 100, 5000.0, 60.0)]) == 10
    assert jaccard.boundary([(0, 10, 500.0, 50.0)]) == 0 and jaccard.boundary([]) == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 20)] + [(300, 301), (301, 300), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[100 + k] for k in range(20)} == {100} and got[301] == 300


@pytest.mark.parametrize("edges", [[(1, 10), (3, 10), (3, 11), (2, 11)], [e for k in range(12) for e in ((k, 100 + k), (k, 101 + k))]])
def test_components_of_zigzags(spark, edges):
    """After one round no end that is pointed at points on, but an end may still hang on two nodes."""
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    least = min(min(e) for e in edges)
    assert sorted((r.node, r.component) for r in got) == [(k, least) for k in sorted({k for e in edges for k in e})]


def test_substrings_against_brute_force(spark):
    rows = odd_rows(3, 50)
    rows += [(800, " ".join(["p q"] * 40), *[None] * 10), (801, " ".join(["r"] * 25), *[None] * 10)]
    rng = random.Random(5)
    distinct = [f"q{k}" for k in range(60)]
    rows += [(900, " ".join(["a"] * 60), *[None] * 10), (900, " ".join(distinct), *[None] * 10), (900, " ".join(distinct[30:] + distinct[:30]), *[None] * 10)]
    df = frame(spark, rows)
    kept = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.drop_repeats(df, block_bytes=4096).collect()), key=str)
    assert kept == sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.drop_repeats(df).collect()), key=str)
    first = {}
    order = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, str(r[1])))
    for ident, text in order:
        w = words(text)
        for k in range(len(w) - 19):
            place = (ident is not None, ident or 0, k)
            first[tuple(w[k : k + 20])] = min(place, first.get(tuple(w[k : k + 20]), place))
    want = []
    for ident, text, *_ in rows:
        w = words(text)
        gone = {j for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] != (ident is not None, ident or 0, k) for j in range(k, k + 20)}
        want.append((ident, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert kept == sorted(want, key=str)


def test_fm_index_counts_and_statistics():
    rng = np.random.default_rng(0)
    codes, lengths = rng.integers(0, 5, 300), np.array([100, 1, 0, 150, 49])
    index = FMIndex(codes, lengths, 5)
    text = index.text
    assert sorted(index.order.tolist()) == list(range(len(text)))
    matrix = WaveletMatrix(codes, 5)
    for c in range(5):
        assert (matrix.rank(np.full(301, c), np.arange(301)) == np.concatenate([[0], np.cumsum(codes == c)])).all()
    ends = np.arange(300)
    length, low, high = index.statistics(codes, ends, 6)
    pieces = np.split(codes, np.cumsum(lengths)[:-1])
    for e in range(0, 300, 7):
        best = 0
        for n in range(1, 7):
            if e - n + 1 < 0:
                break
            pattern = codes[e - n + 1 : e + 1].tolist()
            hits = sum(p[k : k + n].tolist() == pattern for p in pieces for k in range(len(p) - n + 1))
            if not hits:
                break
            best, count = n, hits
        assert (length[e], high[e] - low[e]) == (best, count)
    assert suffix_array(np.array([2, 1, 2, 1, 0])).tolist() == [4, 3, 1, 2, 0]


@pytest.mark.parametrize("collide", [False, True])
def test_places_of_equal_windows_share_one_search(monkeypatch, collide):
    """Against all windows; also where every window has one hash."""
    if collide:
        monkeypatch.setattr(common, "grams", lambda h, n: np.zeros(len(h) - n + 1, np.uint64))
    rng = np.random.default_rng(4)
    lengths = np.array([60, 3, 40, 0, 80])
    codes = rng.integers(0, 3, lengths.sum())
    codes[-40:] = codes[:40]
    index = FMIndex(codes, lengths, 3, 4)
    ends = np.concatenate([s + np.arange(3, n) for s, n in zip(index.starts, lengths, strict=True) if n > 3])
    found, low, high = index.rows_of(ends, 4)
    at = defaultdict(set)
    for e in ends:
        at[tuple(index.text[e - 3 : e + 1])].add(e - 3)
    for e, f, a, b in zip(ends, found, low, high, strict=True):
        same = at[tuple(index.text[e - 3 : e + 1])]
        assert f == (len(same) > 1) and (not f or set(index.order[a:b]) == same)


def test_repeated_minimisers_cost_what_a_block_asks():
    """As many keys in fifty times the blocks take about as long, not fifty times."""
    keys = np.random.default_rng(5).integers(0, 60_000, 200_000).astype("<u4")

    def seconds(blocks):
        lists = [np.sort(x).tobytes() for x in np.split(keys, blocks)]
        table = pa.table({"part": pa.array([0] * blocks, pa.int32()), "block": pa.array(range(blocks), pa.int32()), "keys": pa.array(lists, pa.binary())})
        began = time.thread_time()
        got = substrings._repeated(table)
        took = time.thread_time() - began
        again = np.flatnonzero(np.bincount(keys) > 1)
        assert [np.frombuffer(x, "<u4").tolist() for x in got.column("keys").to_pylist()] == [np.intersect1d(np.frombuffer(x, "<u4"), again).tolist() for x in lists]
        return took

    assert seconds(1000) < 5 * seconds(20) + 0.2


def ctw_brute(train, text, depth=ctw.DEPTH):
    """The definition, by recursion over dictionaries."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def steps(raw):
        padded = bytes([255]) * depth + raw + bytes([255])
        for k in range(depth, len(padded)):
            context = padded[k - depth : k][::-1]
            for b in range(8):
                yield context, b, padded[k] >> (8 - b), padded[k] >> (7 - b) & 1

    for raw in train:
        for context, b, prefix, bit in steps(raw):
            for d in range(depth + 1):
                counts[context[:d], b, prefix][bit] += 1
                if d:
                    children[context[: d - 1], b, prefix].add(context[:d])
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(n) + 1)
    memo = {}

    def weighted(context, b, prefix):
        key = context, b, prefix
        if key not in memo:
            own = kt(counts[key])
            memo[key] = own if len(context) == depth else np.logaddexp(own, sum(weighted(c, b, prefix) for c in children[key])) - math.log(2)
        return memo[key]

    total = 0.0
    for context, b, prefix, bit in steps(text):
        p = None
        for d in range(depth, -1, -1):
            key = context[:d], b, prefix
            n = counts[key] if key in counts else [0, 0]
            own = (n[bit] + 0.5) / (sum(n) + 1)
            deeper = p is not None and (context[: d + 1], b, prefix) in counts
            if deeper:
                odds = kt(n) - sum(weighted(c, b, prefix) for c in children[key])
                share = 1 / (1 + math.exp(-max(-700, min(700, odds))))
                p = share * own + (1 - share) * p
            else:
                p = own
        total += math.log10(p)
    return total


@pytest.mark.parametrize("fan", [32, 2])
def test_context_trees_against_the_definition(spark, monkeypatch, fan):
    """Four blocks and more; with two messages a step they are merged, and answered, over several levels."""
    monkeypatch.setattr(ctw, "FAN", fan)
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["the", "then", "Other", "é", "a"]) for _ in range(12)), *[None] * 10) for k in range(25)]
    rows += [(100, None, *[None] * 10), (101, "", *[None] * 10), (102, "zzz unseen", *[None] * 10), rows[3]]
    got = ctw.score_texts(frame(spark, rows), held_out(F.col("doc_id"), 5), block_bytes=200).collect()
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows}
    lower = lambda t: (t or "").translate(LOWER)
    train = [lower(r[1]).encode() for r in rows if not held[r[0]]]
    tokens = Counter(t for r in rows if not held[r[0]] for t in [*words(lower(r[1])), ""])
    n, v = sum(tokens.values()), len(tokens)
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        mine = [*words(lower(texts[r.doc_id])), ""]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(mine), sum(tokens[t] > 0 for t in mine), n)
        assert math.isclose(r.base_score, sum(math.log10((tokens[t] + 0.5) / (n + 0.5 * (v + 1))) for t in mine), rel_tol=1e-9)
        assert math.isclose(r.score, ctw_brute(train, lower(texts[r.doc_id]).encode()), rel_tol=1e-5), r.doc_id


def test_probabilities_of_all_next_bytes_sum_to_one():
    raws = [b"abracadabra", b"abacus"]
    grams, _ = ctw.gram_stream(raws)
    seen, counts = np.unique(grams, return_counts=True)
    context = grams[3] >> np.uint64(8)
    asked = np.unique(np.concatenate([seen, (context << np.uint64(8)) + np.arange(256, dtype=np.uint64)]))
    n = np.zeros(len(asked), np.int64)
    n[np.searchsorted(asked, seen)] = counts
    tree = ctw.Tree(seen, counts, 2)
    c1, bit, prefix, n0, n1, kids = tree.summary()
    top = ctw.Top(c1.astype(int), bit.astype(int), prefix.astype(int), n0, n1, kids)
    value = ctw.Tree(asked, n, 2).gram_log(top)
    assert np.isclose(np.exp(value[(asked >> np.uint64(8)) == context]).sum(), 1.0)


def test_mix_reaches_targets(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, rng.randrange(1, 60)), None, ("a", "b", "c", "d", None)[min(4, k * 7 % 11 // 2)], *[None] * 8) for k in range(1500)]
    rows += [(9000, None, None, "a", *[None] * 8), (9001, "", None, "empty", *[None] * 8), rows[5], (None, "no id here", None, "a", *[None] * 8)]
    df = frame(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        assert r.copies <= 3
    ordered = [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(ordered)}
    total, capped = sum(sizes.values()), set()
    while True:  # the excess of capped sources is shared again until none is above
        free = total - sum(3 * sizes[s] for s in capped)
        level = free / max(1, sum(weight[s] for s in ordered if s not in capped))
        over = {s for s in ordered if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in ordered:
        want = 3 * sizes[s] if s in capped else weight[s] * level
        assert math.isclose(target[s], want, rel_tol=1e-9, abs_tol=1e-6) and abs(taken[s] - want) <= 60, s
    again = mixing.materialised(df.withColumnsRenamed({"block": "_size", "part": "_nth", "n": "_copy", "score": "h", "mark": "total"}).repartition(3))
    assert again.columns[5:] == ["_size", "_nth", "size", "_copy", "h", "copies", "total"] and again.count() == sum(r.copies for r in got)
    mixed, named = Counter(), Counter()
    for r in got:
        named[r.doc_id] += r.copies
    mixed.update(r.doc_id for r in again.collect())
    assert mixed == +named


def test_few_large_documents_and_equal_rows(spark):
    """Two large documents and twenty words meet within one document; a thousand equal rows are spread and share their copies."""
    rows = [(k, "w " * (1000 if k < 2 else 1), None, "a", *[None] * 8) for k in range(22)] + [(77, "x y z", None, "b", *[None] * 8)] * 1000
    df = frame(spark, rows)
    got = mixing.mix(df, weights=(1,), share=0.6).collect()
    taken = {s: sum(r.size * r.copies for r in got if r.source == s) for s in "ab"}
    target = {r.source: r.target for r in got}
    assert abs(taken["a"] - target["a"]) <= 1000 and abs(taken["b"] - target["b"]) <= 3
    assert mixing.materialised(df, weights=(1,), share=0.6).count() == sum(r.copies for r in got)


def test_rounding_keeps_expectations(spark):
    """Over many sources of equal documents, each place is taken as often as its probability says."""
    rows = [(s * 10 + k, "w " * (k + 1), None, f"s{s:03d}", *[None] * 8) for s in range(300) for k in range(10)]
    got = mixing.mix(frame(spark, rows), weights=(1,), share=0.4).collect()
    share = np.mean([r.copies for r in got])
    assert abs(share - 0.4) < 0.03
    for k in (0, 9):
        assert abs(np.mean([r.copies for r in got if r.doc_id % 10 == k]) - 0.4) < 0.12


@pytest.mark.parametrize("share", [0.5, 0.35])
def test_large_documents_are_paired_with_each_other(spark, share):
    """Ten documents hold nearly all words of a source, more than its 40 others can make up for."""
    rows = [(s * 100 + k, "w " * (200 if k < 10 else 3), None, f"s{s:03d}", *[None] * 8) for s in range(60) for k in range(50)]
    got = mixing.mix(frame(spark, rows), weights=(1,), share=share).collect()
    taken, target = Counter(), {r.source: r.target for r in got}
    for r in got:
        taken[r.source] += r.size * r.copies
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= (3 if share == 0.5 else 200) for s in target)
    for large in (True, False):
        assert abs(np.mean([r.copies for r in got if (r.size == 200) == large]) - share) < 0.06


def test_url_rules_against_brute_force(spark):
    rng = random.Random(2)
    hosts = ["example.org", "a.example.org", "b.a.example.org", "example.com", "notexample.org", "org", "x.com", "EXAMPLE.ORG", "u@example.org:80", ""]
    paths = ["", "/", "/es/", "/es/1", "/en/1", "/en/12", "/fr/", "/de/x", "/fr", "?q=/es/", "#/es/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "no scheme/es/", "://example.org/es/", "http://a://b/es/"]
    rules = [*URL_RULES, ("a.example.org", "/", "block"), ("a.example.org", "/es/", "allow"), ("x.com", "", "block"), ("x.com", "", "block"), ("org", "/es/1", "allow")]
    pages = spark.createDataFrame([(k, u, "h", 1, "r") for k, u in enumerate(urls)], "page_id long, url string, host string, span int, rule string")
    url_rules.SPAN_ROWS, old = 50, url_rules.SPAN_ROWS
    try:
        got = {r.page_id: tuple(r)[1:] for r in url_rules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    finally:
        url_rules.SPAN_ROWS = old
    for k, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host = rest[:cut].translate(LOWER)
            path = rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit) if fit else None
        assert got[k] == (host, path, best[3] if best else None, best[4] if best else "allow"), url


def test_word_hashes_tell_words_apart():
    rng = random.Random(0)
    words_ = list({"".join(rng.choice("abé語0") for _ in range(rng.randrange(0, 12))) for _ in range(20_000)}) + ["x" * 5000, "x" * 5001, "ab" * 3000, "ba" * 3000]
    whole = pa.array(words_)
    got = line_templates.word_hashes(whole)
    assert len(set(got.tolist())) == len(words_)
    assert (line_templates.word_hashes(whole.slice(7, 100)) == got[7:107]).all() and (line_templates.word_hashes(pa.array(words_[::-1])) == got[::-1]).all()
    assert len(line_templates.word_hashes(pa.array([], pa.string()))) == 0 and len(line_templates.word_hashes(pa.array([""]))) == 1


def test_recurring_lines_go_and_others_stay(spark):
    rows = []
    for k in range(20):
        rows.append((k, f"unique line of document number{k} {prose(random.Random(k), 6)}\nPage {k} of 20 printed today\n\nok\nAll rights reserved forever", "x", *[None] * 9))
    rows += [(50, None, *[None] * 10), (51, "", *[None] * 10), (52, "just prose here and there", *[None] * 10), rows[4], (None, "Page 9 of 20 printed today", *[None] * 10)]
    df = frame(spark, rows).withColumn("n_lines", F.lit("mine")).withColumn("N_dropped", F.lit(7))
    got = line_templates.dedup_lines(df)
    assert got.columns == [*df.columns, "_n_lines", "_n_dropped"] and {(r.n_lines, r.N_dropped) for r in got.collect()} == {("mine", 7)}
    texts = {r.doc_id: (r.text, r._n_lines, r._n_dropped) for r in got.collect()}
    assert got.count() == len(rows)
    assert texts[0][0].count("\n") == 4 and "Page 0" in texts[0][0]  # the first keeps them
    for k in range(1, 20):
        assert texts[k][1:] == (5, 2) and texts[k][0].split("\n")[1:] == ["", "ok"] and texts[k][0].startswith("unique line")
    assert texts[50] == (None, 0, 0) and texts[51] == ("", 1, 0) and texts[52][2] == 0 and texts[None][2] == 0


def brute_lines(rows, docs=line_templates.DOCS):
    """The definition of the tree over plain tuples: (id, masked line) that goes."""
    held = defaultdict(list)
    for ident, text in rows:
        if ident is None or text is None:
            continue
        seen = set()
        for line in text.split("\n"):
            w = words(line)
            if len(w) < line_templates.LEAST_WORDS:
                continue
            digits = [any(c in "0123456789" for c in x) for x in w]
            masked = tuple("<*>" if d and 2 * sum(digits) <= len(w) else x for x, d in zip(w, digits, strict=True))
            if masked not in seen:
                held[masked].append(ident)
            seen.add(masked)
    cells = Counter()
    for m, ids in held.items():
        for k in range(2, len(m)):
            cells[len(m), m[:2], k, m[k]] += len(ids)
    own, room = {}, {}
    for m in held:
        t = tuple("<*>" if k >= 2 and cells[len(m), m[:2], k, x] < docs else x for k, x in enumerate(m))
        left = len(m) // 4 - sum(x != y for x, y in zip(m, t, strict=True))
        if left >= 0:
            own[m] = t
            room[t] = max(left, room.get(t, 0))
    while True:
        ways = {t: {k: t[:k] + ("<*>",) + t[k + 1 :] for k in range(2, len(t)) if room[t] and t[k] != "<*>"} for t in room}
        often = Counter(to for way in ways.values() for to in way.values()) + Counter(room.keys())
        picks = {t: sorted((-often[to], k) for k, to in way.items() if often[to] > 1)[: room[t]] for t, way in ways.items()}
        moves = {t: tuple("<*>" if k in {p for _, p in pick} else x for k, x in enumerate(t)) for t, pick in picks.items() if pick}
        if not moves:
            break
        own = {m: moves.get(t, t) for m, t in own.items()}
        after = {}
        for t, left in room.items():
            to = moves.get(t, t)
            after[to] = max(after.get(to, 0), left - len(picks[t]))
        room = after
    met = defaultdict(set)
    for m, t in own.items():
        met[t].update(held[m])
    return {(k, m) for m, t in own.items() if len(met[t]) >= docs for k in met[t] if k != min(met[t])}


def brute_kept(rows):
    gone = brute_lines(rows)
    out = []
    for ident, text in rows:
        kept = []
        for line in (text or "").split("\n"):
            w = words(line)
            digits = [any(c in "0123456789" for c in x) for x in w]
            masked = tuple("<*>" if d and 2 * sum(digits) <= len(w) else x for x, d in zip(w, digits, strict=True))
            if not (len(w) >= line_templates.LEAST_WORDS and (ident, masked) in gone):
                kept.append(line)
        out.append((ident, None if text is None else "\n".join(kept)))
    return out


def log_rows(seed, n=90):
    """Lines of few templates with one to three variable fields, of all lengths, in few leaves."""
    rng = random.Random(seed)
    shapes = [["the", "user", *(rng.choice("abcde") * 2 for _ in range(k))] for k in (1, 2, 4, 6, 10, 30, 45) for _ in range(2)]
    rows = []
    for k in range(n):
        lines = []
        for _ in range(rng.randrange(1, 7)):
            line = list(rng.choice(shapes))
            for _ in range(rng.randrange(0, 4)):
                line[rng.randrange(2, len(line))] = rng.choice([rng.choice(["anna", "berta", "carl"]), f"v{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}", str(rng.randrange(50))])
            lines.append(" ".join(line))
        rows.append((k % (n - 5), "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_line_templates_against_the_definition(spark, seed):
    rows = [*log_rows(seed), (None, "the user aa\nthe user bb"), (500, None), (501, "")]
    wide = [(*r, *[None] * 10) for r in rows]
    df = frame(spark, wide).withColumnsRenamed({"block": "_of", "part": "_marks", "size": "of", "n": "marks", "mark": "salt", "copies": "same"})
    got = line_templates.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    texts = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(texts, key=str) == sorted(brute_kept(rows), key=str)
    assert sorted(rows, key=str) != sorted(texts, key=str)


def test_lines_of_any_length_generalise(spark, monkeypatch):
    """Five lines that differ in their last word, of 9, 34, 44 and 200 words; batches of a line or two."""
    monkeypatch.setattr(common.slices, "__defaults__", (100,))
    rows = [(k, "\n".join(" ".join([f"word{'abcd'[j]}"] * n + [f"last{'abcde'[k]}"]) for j, n in enumerate((8, 33, 43, 199))), *[None] * 10) for k in range(5)]
    assert {r.doc_id: r.n_dropped for r in line_templates.dedup_lines(frame(spark, rows)).collect()} == {k: 4 * (k > 0) for k in range(5)}


def test_a_large_leaf_changes_nothing(spark):
    """A template of four lines that vary in a word without digits, alone and in a leaf with thousands of other lines."""
    few = [(10_000 + k, f"the user {name} logged in from home today") for k, name in enumerate(("anna", "berta", "carl", "dora"))]
    many = [(k, "the user " + " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}{c}" for c in "cdefgh")) for k in range(3000)]
    rows = few + many
    got = {r.doc_id: r.n_dropped for r in line_templates.dedup_lines(frame(spark, [(*r, *[None] * 10) for r in rows])).collect()}
    assert got == {r[0]: int(r[0] > 10_000) for r in rows}


@pytest.mark.parametrize("run", [ctw.score_texts, jaccard.jaccard_classes, substrings.drop_repeats, mixing.mix, mixing.materialised, line_templates.dedup_lines])
def test_empty_tables(spark, run):
    df = spark.createDataFrame([], SCHEMA)
    assert (run(df, F.lit(False)) if run is ctw.score_texts else run(df)).collect() == []


def test_empty_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_rules.judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).collect() == []
    one = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [tuple(r) for r in url_rules.judge_urls(one, rules).collect()] == [(1, "a", "/b", None, "allow")]


@pytest.mark.parametrize("n", [40, 41, 60])
def test_one_rule_at_any_length(spark, n):
    """A line that two or three documents share stays, one that four share goes from all but the first, whatever its length."""
    line = lambda k: " ".join([f"{'abcdefgh'[k]}word"] * n)
    texts = ["\n".join(line(k) for k, docs in enumerate((2, 3, 4, 5)) if j < docs) for j in range(5)]
    got = {r.doc_id: r.n_dropped for r in line_templates.dedup_lines(frame(spark, [(k, t, *[None] * 10) for k, t in enumerate(texts)])).collect()}
    assert got == {0: 0, 1: 2, 2: 2, 3: 2, 4: 1}


def test_rounds_go_on_until_no_template_moves(spark):
    """32 lines of 27 words, all combinations of two common words in five places: one template."""
    rows = [(k, " ".join(["the", "user", *(f"{'abcde'[j]}{'xy'[k >> j & 1]}" for j in range(5)), *["word"] * 20])) for k in range(32)]
    got = line_templates.dedup_lines(frame(spark, [(*r, *[None] * 10) for r in rows]))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(brute_kept(rows)) and {r.doc_id: r.n_dropped for r in got.collect()} == {k: int(k > 0) for k in range(32)}


def test_ctw_answers_do_not_follow_the_order_of_messages():
    asked = [(0, pa.array(["b", "a", ""]), [3, 1, 2]), (1, pa.array(["c", "a"]), [5, 7])]
    table = lambda rows: pa.concat_tables([ctw._message(unit, [(9, words, None, np.array(n))]) for unit, words, n in rows])
    merged = ctw._combined(2)(table(asked))
    (unit, part, value), = ((r["unit"], r["part"], r["value"]) for r in ctw._answered(merged, pa.table({c: [[]] for c in ("c1", "bit", "prefix", "n0", "n1", "kids")})).to_pylist())
    told = pa.table({"unit": [unit], "part": [part], "value": [value]})
    for rows in (asked, asked[::-1]):
        got = {r["unit"]: np.frombuffer(r["value"], "<u8").tolist() for r in ctw._passed_on(table(rows), told).to_pylist()}
        assert got == {0: [3, 8, 2], 1: [5, 8]}
