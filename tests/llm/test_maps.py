"""Operators that map texts one by one: language, quality, tokens, media."""

import hashlib
import io
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import byte_bpe, langid, media, quality_bands, queries
from spanforge.llm.queries import held_out, vocabulary
from tests.llm.helpers import SCHEMA, frame, odd_rows, words


def test_quality_counts_match_brute_force(spark):
    rows = odd_rows()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_bands.quality_bands(frame(spark, rows)).collect())
    want = []
    for row in rows:
        text = row[1] or ""
        w, seen, dup = words(text), set(), 0
        for line in text.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        want.append((row[0] if row[0] is not None else -1, len(w), sum(map(len, w)), sum(text.count(s) for s in "#*$%&|<>"), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
    assert got == sorted(want)


def test_compression_bands_reject_both_ends():
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    rng = np.random.default_rng(0)
    assert not quality_bands.compression(b"abc " * 5000, z)[0]
    assert not quality_bands.compression(rng.bytes(20_000), z)[0]
    prose = " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(3000)).encode()
    assert quality_bands.compression(prose, z)[0]
    # a repetitive stretch inside good text fails by its chunk
    assert not quality_bands.compression(prose + b"spam " * 2000, z)[0]


def brute_kept(text):
    """Whole text and 4 KiB chunks, the last one its last 4 KiB, each within the band of its length."""
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    raw = (text or "").encode()
    ratio = lambda x: len(z.compress(x)) / len(x)
    if not raw:
        return False
    low, high = next((a, b) for most, a, b in quality_bands.WHOLE_BANDS if len(raw) < most)
    chunks = [raw[k : k + 4096] for k in range(0, len(raw) - 4095, 4096)] + [raw[-4096:]] if len(raw) > 4096 else []
    return low <= ratio(raw) <= high and all(0.10 <= ratio(c) <= 0.85 for c in chunks)


def test_kept_over_rows(spark):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(n))
    texts = [None, "", prose(30), prose(3000), prose(800) + " " + "ab cd " * 60, prose(700) + "z" * 300, prose(900) + " " + "z" * 4000, rng.bytes(9000).hex(), prose(1200) + " " + " ".join(rng.bytes(40).hex() for _ in range(100))]
    rows = [*odd_rows(n=10), *((2000 + k, t, *[None] * 10) for k, t in enumerate(texts))]
    got = [(r.doc_id, r.base_failed, r.kept) for r in quality_bands.quality_bands(frame(spark, rows)).collect()]
    assert sorted((k, kept) for k, failed, kept in got if k is not None and not failed) == sorted((r[0], brute_kept(r[1])) for r, g in zip(rows, got, strict=True) if g[0] is not None and not g[1])
    assert not any(kept for _, failed, kept in got if failed) and {kept for _, failed, kept in got if not failed} == {True, False}


@pytest.mark.parametrize("seed", range(6))
def test_windows_join_to_what_one_row_gives(seed, monkeypatch):
    """Any order of ranks: joined tokens may have lesser ranks than their halves. Tokens of up to six letters may span windows."""
    rng = np.random.default_rng(seed)
    tokens = [bytes([b]) for b in range(256)]
    letters = b"abc"[: 2 + seed % 2]
    while len(tokens) < 330:
        token = rng.choice(list(letters), rng.integers(2, 7)).astype(np.uint8).tobytes()
        if token not in tokens:
            tokens.append(token)
    order = np.concatenate([np.arange(256), 256 + rng.permutation(len(tokens) - 256)])
    import base64

    table = byte_bpe.Merges(b"\n".join(base64.b64encode(tokens[t]) + b" %d" % k for k, t in enumerate(order)))
    for window in (2, 9, 32):
        for name, value in (("WINDOW", window), ("OVERLAP", window // 2), ("STRIDE", window - window // 2)):
            monkeypatch.setattr(byte_bpe, name, value)
        for n in (1, 2, 60, 250):
            for _ in range(3):
                piece = rng.choice(list(letters), n).astype(np.uint8).tobytes()
                for own in (piece, b"z" + piece[:1] * n + piece):
                    assert table.merge_windows(own, {}).tolist() == table.merge_rows([own], 512)[0].tolist()


def test_a_very_long_piece_is_quick():
    table = byte_bpe.merges(vocabulary()[0])
    rng = np.random.default_rng(0)
    for piece in (b"x" * 300_000, b"-x" + b"=" * 300_000, rng.choice(list(b"abcdefghijklmnopqrstuvwxyz"), 60_000).astype(np.uint8).tobytes()):
        assert table.decode(table.encode_pieces([piece])[0]) == piece


def test_bpe_equals_the_library_and_decodes(spark):
    import tiktoken

    data, pattern = vocabulary()
    table = byte_bpe.merges(data)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table.ranks, special_tokens={})
    letters = np.random.default_rng(5).choice(list("etaoinshrdlu"), 3_000)
    long = ["a" * 700 + " " + "ab" * 400 + "\r\n\n  tail <|endoftext|>", "x" + "a" * 999, " ." + "=" * 901 + "-" * 640, " " * 1_001 + "x", "".join(letters), "é" * 300]
    rows = [*odd_rows(n=10), *((900 + k, text, *[None] * 10) for k, text in enumerate(long))]
    got = {r.doc_id: (bytes(r.ids), bytes(r.decoded)) for r in byte_bpe.encode(frame(spark, rows), data, pattern).collect()}
    for ident, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        assert got[ident] == (np.array(ids, "<u4").tobytes(), (text or "").encode()), ident


def test_media_round_trips(spark):
    rng = np.random.default_rng(1)
    for shape in ((1, 64), (7, 64), (5, 3), (64, 1)):
        image = rng.integers(0, 256, shape, np.uint8)
        assert (media.decode(media.encode_pgm(image)) == image).all() and (media.decode(media.encode_bmp(image)) == image).all()
    assert media.decode(b"P2\n# c\n2 2\n255\n0 1 2 3\n").tolist() == [[0, 1], [2, 3]]
    assert media.decode(b"P1\n2 1\n1 0\n").tolist() == [[0, 255]]
    assert media.decode(b"P3 1 1 255 9 8 7\n").tolist() == [[[9, 8, 7]]]
    assert media.decode(b"P4\n9 1\n\x80\x80").tolist() == [[0, 255, 255, 255, 255, 255, 255, 255, 0]]
    rows = odd_rows(n=10)
    for form in ("pgm", "bmp", None):
        stored = media.text_images(frame(spark, rows).coalesce(1), form=form)
        for r, (_, text, *_) in zip(media.media_tiles(stored, "doc_id", "media", ("n_bytes", "media")).collect(), rows, strict=True):
            raw = (text or "").encode()
            padded = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
            assert (r.n_bytes, bytes(r.samples), r.error) == (len(raw), padded, None)
            assert bytes(r.media[:2]) == {"pgm": b"P5", "bmp": b"BM", None: (b"P5", b"BM")[hashlib.sha256(padded).digest()[-1] & 1]}[form]
            assert np.load(io.BytesIO(bytes(r.npy))).shape == (8, 9) and len(r.dhash) == 16


def test_columns_of_op9(spark, tmp_path):
    """Each column from the text alone; the feature by plain means over fractions of samples."""
    rows = odd_rows(n=8)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_bytes): r for r in queries.op9_media_tiles(spark, str(tmp_path)).collect()}
    for ident, text, *_ in rows:
        raw = (text or "").encode()
        r = got[ident, len(raw)]
        padded = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        plane = np.frombuffer(padded, np.uint8).reshape(-1, 64)
        stored = (media.encode_pgm, media.encode_bmp)[hashlib.sha256(padded).digest()[-1] & 1](plane)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        fine = np.kron(plane.astype(float), np.ones((8, 9)))  # a multiple of 8 x 9 cells
        small = np.round(fine.reshape(8, len(fine) // 8, 9, 64).mean((1, 3)), 6)
        assert r.feature == np.packbits((small[:, 1:] > small[:, :-1]).ravel()).tobytes().hex()
        assert (np.load(io.BytesIO(bytes(r.tile))) == np.rint(small)).all()


def test_impossible_headers_and_samples_are_errors():
    image = np.arange(60, dtype=np.uint8).reshape(6, 10)
    bmp = media.encode_bmp(image)
    resized = lambda width, height: bmp[:18] + struct.pack("<ii", width, height) + bmp[26:]
    assert (media.decode(resized(10, -6)) == image[::-1]).all()  # rows from the top
    for width, height in ((-8, 6), (0, 6), (10, 0), (-(1 << 31), -(1 << 31)), (1 << 30, 1)):
        with pytest.raises(ValueError):
            media.decode(resized(width, height))
    for raw in (b"P2 2 1 255 7 300", b"P2 1 1 15 16", b"P5 1 1 15 \x10", b"P2 1 1 255 -1", b"P5 1 1 300 \xff\xff"):
        with pytest.raises(ValueError):
            media.decode(raw)
    assert media.decode(b"P2 3 1 15 0 8 15").tolist() == [[0, 136, 255]] and media.decode(b"P5 2 1 1 \0\1").tolist() == [[0, 255]]
    assert media.decode(b"P2 2 1 1000 500 1000").tolist() == [[32768, 65535]] and media.decode(b"P6 1 1 65535 \0\1\0\2\xff\xff").tolist() == [[[1, 2, 65535]]]


@pytest.mark.parametrize("seed", range(3))
def test_signed_header_fields(seed):
    """Any numbers in the header give an error or an image of positive sizes, never a tile out of nothing."""
    rng = np.random.default_rng(seed)
    bmp = media.encode_bmp(rng.integers(0, 256, (6, 10), np.uint8))
    for _ in range(300):
        sizes = [int(x) for x in rng.choice([-10, -8, -1, 0, 1, 6, 8, 10, 11, 2**31 - 1, -(2**31)], 2)]
        height, width, planes, npy, mark, samples, error = media._tiled(bmp[:18] + struct.pack("<ii", *sizes) + bmp[26:])
        assert error if height is None else height > 0 and width > 0 and len(samples) == height * width * planes and not np.isnan(np.load(io.BytesIO(npy)).astype(float)).any()


def test_no_bytes_break_the_decoder(spark):
    """Headers with impossible sizes, and images with some bytes changed, cut or doubled, give an error or an image."""
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (6, 10), np.uint8)
    raws = [b"P5\n99999999999 99999999999\n255\n", b"P5 0 0 255 ", b"P2 1 1 255 99999999999999999999999999", b"P6 4 4 70000 ", b"BM", b"P4", b"P5 2 2 255 \0", b"P3 1 1 255 1 2", b"P1 2 2 1"]
    big = bytearray(media.encode_bmp(image))
    big[18:26] = b"\xff\xff\xff\x7f" * 2
    raws.append(bytes(big))
    for whole in (media.encode_pgm(image), media.encode_bmp(image)):
        for _ in range(300):
            raw = bytearray(whole)
            for _ in range(rng.integers(1, 5)):
                raw[rng.integers(min(60, len(raw)))] = rng.integers(256)
            raws.append(bytes(raw[: rng.integers(1, len(raw) + 1)] if rng.random() < 0.3 else raw))
    for raw in raws:
        got = media._tiled(raw)
        assert (got[6] is None) != (got[3] is None)
    assert all(media._tiled(raw)[6] for raw in raws[:10])


def test_area_resize_is_the_mean_over_cells():
    rng = np.random.default_rng(2)
    plane = rng.integers(0, 256, (5, 7))
    fine = np.kron(plane, np.ones((3, 2)))  # 15 x 14 cells: 3 x 2 of them make one of 5 x 7
    assert np.allclose(media.area_resize(plane, 15, 14), fine)
    assert np.allclose(media.area_resize(fine, 5, 7), plane)
    assert np.isclose(media.area_resize(plane, 1, 1)[0, 0], plane.mean())


def test_media_tiles_report_what_is_no_image(spark):
    df = spark.createDataFrame([(1, bytearray(b"P5\n2 2\n255\n\0\1\2\3")), (2, bytearray(b"nonsense")), (3, None), (4, bytearray(b"P5\n9 9\n255\n\0"))], "image_id long, image binary")
    got = {r.id: r for r in media.media_tiles(df).collect()}
    assert (got[1].height, got[1].width, got[1].planes, got[1].error) == (2, 2, 1, None)
    assert got[2].error and got[2].npy is None and got[3].npy is None and got[3].error is None and got[4].error


def test_prediction_is_the_mean_over_letters_of_a_plain_run(monkeypatch):
    """Position by position, one byte and one text at a time, over the span and the bytes around it."""
    net = langid.Network(["a", "b", "c"], units=4, seed=2)
    rng = np.random.default_rng(1)
    raws = [bytes(rng.integers(32, 128, n, np.uint8)) for n in (1, 5, 96, 97, 300)] + ["Ünïcode 語 text".encode()]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def run(side, codes):
        w, k, h, out = side.w, side.units, np.zeros(side.units), []
        for c in codes:
            into, rec = w["x"][c] + w["b"], h @ w["u"]
            z, r = sigmoid(into[:k] + rec[:k]), sigmoid(into[k : 2 * k] + rec[k : 2 * k])
            h = z * h + (1 - z) * np.tanh(into[2 * k :] + r * rec[2 * k :])
            out.append(h)
        return out

    for raw, got in zip(raws, net.frozen().pooled(raws), strict=True):
        sums, letters = np.zeros(3), 0
        size = -(-len(raw) // langid.SPAN) * langid.SPAN
        padded = b" " * langid.AROUND + raw.ljust(size) + b" " * langid.AROUND
        for at in range(0, size, langid.SPAN):
            codes = list(padded[at : at + langid.SPAN + 2 * langid.AROUND].lower())
            ahead, back = run(net.sides[0], codes), run(net.sides[1], codes[::-1])[::-1]
            for k in range(langid.AROUND, langid.AROUND + langid.SPAN):
                byte = padded[at + k]
                if byte >= 128 or chr(byte).isalpha():
                    logits = np.concatenate([ahead[k], back[k]]) @ net.out["v"] + net.out["c"]
                    p = np.exp(logits - logits.max())
                    sums, letters = sums + p / p.sum(), letters + 1
        assert np.allclose(got, sums / max(1, letters), atol=1e-4)


def test_prediction_takes_less_time_than_a_plain_layout():
    """Against the same steps with a row for each text and a tanh for each gate, which the prediction once was."""
    k, rows, times = langid.UNITS, 1024, langid.SPAN + 2 * langid.AROUND
    model = langid.Network(["a", "b", "c"], seed=3).frozen()
    rng = np.random.default_rng(3)
    codes, table, u = rng.integers(97, 123, (times, rows)).astype(np.uint8), rng.random((256, 3 * k), np.float32), rng.random((k, 3 * k), np.float32)

    def plain():
        for _ in range(2):
            h = np.zeros((rows, k), np.float32)
            for row in codes:
                into, rec = table[row], h @ u
                gates = np.tanh(into[:, : 2 * k] + rec[:, : 2 * k]) * 0.5 + 0.5
                c = np.tanh(into[:, 2 * k :] + gates[:, k:] * rec[:, 2 * k :])
                h = (h - c) * gates[:, :k] + c

    def seconds(run):
        began = time.thread_time()
        run()
        return time.thread_time() - began

    assert min(seconds(lambda: model.positions(codes)) for _ in range(5)) < 0.85 * min(seconds(plain) for _ in range(5))


def test_rare_languages_are_in_the_sample(spark):
    """Two rows in five thousand, and the bound on bytes leaves one row a language at least."""
    rows = [(k, "the usual words of it " * 2, "aa") for k in range(5000)] + [(9000, "zzz qqq xxx " * 4, "rare"), (9001, "qqq zzz " * 6, "rare")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(df, F.lit(True), rows=40).languages == ["aa", "rare"]
    assert langid.fit(df, F.lit(True), rows=40, most=10).languages == ["aa", "rare"]


def test_backpropagation_matches_numeric_gradients():
    net = langid.Network(["a", "b", "c"], units=3, seed=5)
    rng = np.random.default_rng(0)
    codes, labels = rng.integers(0, 256, (6, 4)).astype(np.uint8), rng.integers(0, 3, 4)
    slots = [net.sides[0].w, net.sides[1].w, net.out]
    for slot in slots:
        for name in slot:
            slot[name] = slot[name].astype(np.float64)
    _, grads = net.loss(codes, labels)
    for slot, grad in zip(slots, grads, strict=True):
        for name, w in slot.items():
            where = tuple(np.argwhere(np.abs(grad[name]) > 1e-6)[0])
            old = w[where]
            values = []
            for step in (1e-4, -1e-4):
                w[where] = old + step
                values.append(net.loss(codes, labels)[0])
            w[where] = old
            assert np.isclose((values[0] - values[1]) / 2e-4, grad[name][where], rtol=2e-2, atol=1e-5), name


def test_languages_are_learned_and_odd_texts_have_none(spark):
    rng = np.random.default_rng(3)
    parts = {"aa": ["the", "ing", "and", "wh"], "bb": ["eau", "oux", "ment", "é"], "cc": ["sch", "ung", "ä", "keit"]}
    rows = []
    for k in range(600):
        lang = list(parts)[k % 3]
        rows.append((k, " ".join("".join(rng.choice(parts[lang], 2)) for _ in range(20)), lang, None, *[None] * 8))
    rows += [(1001, None, "aa", *[None] * 9), (1002, "123 !!", "aa", *[None] * 9), (1003, "", None, *[None] * 9), (1004, "語語", None, *[None] * 9)]
    df = frame(spark, rows)
    model = langid.fit(df, ~held_out(F.col("doc_id"), 3), rows=300)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, model).collect()}
    tested = [k for k in range(600) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([got[k][0] == rows[k][2] for k in tested]) > 0.97
    assert all(got[k] == ("und", 0.0) for k in (1001, 1002, 1003)) and got[1004][0] in parts
    assert all(0 <= s <= 1 for _, s in got.values())
    kept = langid.filtered(df, model, 0.3)
    assert kept.columns == df.columns and {1001, 1002, 1003}.isdisjoint(r.doc_id for r in kept.collect())
    assert langid.fit(df.where("doc_id > 5000"), F.lit(True)) is None
    assert [tuple(r) for r in langid.identify(df.limit(1), None).collect()][0][1:] == ("und", 0.0)


@pytest.mark.parametrize("run", [quality_bands.quality_bands, media.text_images, lambda d: byte_bpe.encode(d, *vocabulary()), lambda d: langid.identify(d, None)])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_beyond_a_slice(spark):
    """Five megabytes in one text, between small ones: each is whole in what comes out."""
    data, pattern = vocabulary()
    rng = np.random.default_rng(7)
    long = " ".join(f"w{k}" for k in rng.integers(0, 300, 1_200_000))
    rows = [(1, "small one"), (2, long), (3, None), (4, "the last of them")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert len(long) > 4 << 20
    assert {r.doc_id: r.n_words for r in quality_bands.quality_bands(df).collect()} == {1: 2, 2: 1_200_000, 3: 0, 4: 4}
    assert {r.doc_id: bytes(r.decoded) for r in byte_bpe.encode(df, data, pattern).collect()} == {k: (t or "").encode() for k, t in rows}
    stored = media.media_tiles(media.text_images(df), "doc_id", "media", ("n_bytes",))
    assert {r.id: bytes(r.samples)[: r.n_bytes] for r in stored.collect()} == {k: (t or "").encode() for k, t in rows}
    model = langid.Network(["a", "b"], units=2).frozen()
    assert {r.doc_id: r.lang_pred != "und" for r in langid.identify(df, model).collect()} == {1: True, 2: True, 3: False, 4: True}
