import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwell.llm import media, packing, token_shards
from driftwell.llm._util import shared_dir
from driftwell.llm.tokens import encoder, public_vocabulary

ODD = ["", " ", "a   b", "a \n b  ", "  x", "don't we'll 12345 ²³ x y  z", "naïve Ünïcode ＡＢ 漢字 é İ ﬁ", "<|endoftext|> hi", "a\t\tb \t c", "x́ ́y", "Straße.\nÉan!!"]
ROWS = [(3, "plain words here"), (1, None), (2, ""), (2, ""), (None, "no id"), (4, "long " * 9000), (5, "plain words here")] + [(10 + i, t) for i, t in enumerate(ODD)]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, media string, part int")


@given(st.binary(max_size=3000), st.sampled_from([24, 576]))
@settings(max_examples=40, deadline=None)
def test_png_round_trip(data, width):
    payload = media.pad(data, width)
    assert media.decode_png(media.encode_png(payload, width)).tobytes() == payload


@pytest.mark.parametrize("kind", range(5))
def test_every_filter_is_undone(kind):
    image = np.random.default_rng(kind).integers(0, 256, (5, 7), dtype=np.uint8)
    wide = np.zeros((6, 8), int)
    wide[1:, 1:] = image
    a, b, c = wide[1:, :-1], wide[:-1, 1:], wide[:-1, :-1]
    guess = [0 * a, a, b, (a + b) // 2, np.vectorize(media._paeth)(a, b, c)][kind]
    lines = np.concatenate([np.full((5, 1), kind), (image - guess) % 256], axis=1).astype(np.uint8)
    assert (media.unfilter(lines) == image).all()


def test_damage_is_noticed():
    good = media.encode_png(media.pad(b"hello" * 400))
    for at in (20, len(good) // 2, len(good) - 6):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(bad))
    for cut in range(1, len(good)):
        with pytest.raises(ValueError):
            media.decode_png(good[:-cut])
    for at in (26, 27, 28):  # compression, filter and interlace methods, with a right checksum
        bad = bytearray(good)
        bad[at] = 1
        bad[29:33] = zlib.crc32(bytes(bad[12:29])).to_bytes(4, "big")
        with pytest.raises(ValueError):
            media.decode_png(bytes(bad))


def plain_hash(image):
    """The feature by definition: sums over cosines of a 32 x 32 mean image."""
    h, w = image.shape
    small = np.zeros((32, 32))
    for i in range(32):
        for j in range(32):
            rows = range(i * h // 32, (i + 1) * h // 32) if h >= 32 else [i * h // 32]
            cols = range(j * w // 32, (j + 1) * w // 32) if w >= 32 else [j * w // 32]
            small[i, j] = np.mean([[float(image[y, x]) for x in cols] for y in rows])
    low = np.zeros((8, 8))
    for u in range(8):
        for v in range(8):
            low[u, v] = sum(small[i, j] * np.cos(np.pi * u * (2 * i + 1) / 64) * np.cos(np.pi * v * (2 * j + 1) / 64) for i in range(32) for j in range(32))
    low = np.round(low, 4).ravel()
    bits = "".join("01"[int(k > 0 and x > np.median(low[1:]))] for k, x in enumerate(low))
    return f"{int(bits, 2):016x}"


@pytest.mark.parametrize("height", [1, 5, 32, 70])
def test_feature_equals_its_definition(height):
    image = np.random.default_rng(height).integers(0, 256, (height, 576), dtype=np.uint8)
    assert media.cosine_hash(image) == plain_hash(image)


def test_media_columns(spark):
    out = media.media_features(media.with_media(docs(spark))).collect()
    assert len(out) == len(ROWS)
    want = sorted(repr((i, len((t or "").encode()), hashlib.sha256(media.pad((t or "").encode())).hexdigest())) for i, t in ROWS)
    assert sorted(repr((r.doc_id, r.n_bytes, r.payload_sha256)) for r in out) == want
    stored = {(r.doc_id, r.n_bytes): r.media for r in media.with_media(docs(spark)).collect()}
    for r in out:
        png = stored[r.doc_id, r.n_bytes]
        payload = media.decode_png(bytes(png)).tobytes()
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        assert (r.payload_bytes, r.tail_crc32, r.feature) == (len(payload), zlib.crc32(payload[-32:]), plain_hash(np.frombuffer(payload, np.uint8).reshape(-1, 576)))
    by = {}
    for r in out:
        by.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature, r.tail_crc32, r.media_bytes))
    assert all(len(v) == 1 for v in by.values())
    assert media.media_features(media.with_media(docs(spark, []))).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    e = encoder(public_vocabulary(name))
    for t in ODD + ["Then the long-ish words, 3.14 and (more)... it's  fine "]:
        assert np.frombuffer(e.encode(t), "<u2").tolist() == e.library.encode(t, add_special_tokens=False).ids


@given(st.text(max_size=60))
@settings(max_examples=60, deadline=None)
def test_encoder_equals_library_on_any_text(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = encoder(public_vocabulary(name))
        assert np.frombuffer(e.encode(text), "<u2").tolist() == e.library.encode(text, add_special_tokens=False).ids


def ids_of(name, text, end):
    return encoder(public_vocabulary(name)).library.encode(text or "", add_special_tokens=False).ids + [end]


def test_token_shards(spark):
    folder = shared_dir(spark, "test")
    token_shards.write_shards(docs(spark), folder, token_shards.Spec("byte_bpe_50k.json", 0))
    out = token_shards.read_shards(spark, folder).collect()
    assert len(out) == len(ROWS)
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == sorted((i for i, _ in ROWS), key=lambda i: -1 if i is None else i)
    rows = [(i, ids_of("byte_bpe_50k.json", t, 0)) for i, t in ROWS]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in out) == sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in rows)
    wide = shared_dir(spark, "test")
    token_shards.write_shards(docs(spark), wide, token_shards.Spec("byte_bpe_50k.json", 0, id_bytes=4))
    assert sorted(map(repr, token_shards.read_shards(spark, wide).collect())) == sorted(map(repr, out))
    for i in {i for i, _ in ROWS}:
        assert sorted(x.tolist() for x in token_shards.lookup(wide, i)) == sorted(x for j, x in rows if j == i)
    want = ids_of("byte_bpe_50k.json", ROWS[0][1], 0)
    (got,) = token_shards.lookup(folder, 3)
    assert got.tolist() == want and token_shards.lookup(folder, 999) == [] and len(token_shards.lookup(folder, 2)) == 2
    assert next(r.ids_crc32 for r in out if r.doc_id == 3) == zlib.crc32(np.array(want, "<u4").tobytes())
    empty = shared_dir(spark, "test")
    assert token_shards.write_shards(docs(spark, []), empty, token_shards.Spec("byte_bpe_50k.json", 0)) == []
    assert token_shards.read_shards(spark, empty).count() == 0


def check_packing(pieces, rows):
    by, seqs = {}, {}
    for r in pieces:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in seqs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    want = {}
    for i, t in rows:
        ids = ids_of("word_bpe_49k.json", t, 2)
        want.setdefault((i, len(ids)), []).append(ids)
    assert set(by) == set(want)
    for k, found in by.items():
        assert sum(r.length for r in found) == k[1] * len(want[k])
        for r in found:
            assert any(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for ids in want[k])
    return sum(packing.WINDOW - n for n in (sum(x for _, x in s) for s in seqs.values()) if n & (n - 1))


def test_packing(spark):
    rows = ROWS + [(100 + i, "word " * (i * 37 % 1900)) for i in range(60)]
    assert check_packing(packing.pack(docs(spark, rows), "word_bpe_49k.json", 2).collect(), rows) < packing.WINDOW
    assert packing.pack(docs(spark, []), "word_bpe_49k.json", 2).count() == 0


@given(st.dictionaries(st.integers(1, 63), st.integers(1, 500), min_size=1, max_size=20))
@settings(max_examples=30, deadline=None)
def test_plan_never_overdraws_and_fills(hist):
    used, before = {}, 0
    for made in (packing.solve(hist, 64), packing.fills(hist, 64)):
        used = {}
        for fill, times in made:
            assert sum(fill) == 64 and times > 0
            for c in fill:
                used[c] = used.get(c, 0) + times
        assert all(used[c] <= hist[c] for c in used)
        ids = sum(c * n for c, n in used.items())
        assert ids >= before
        before = ids


def test_greedy_residuals_leave_little_to_cut():
    hist = {c: 9000 // c + c % 7 for c in range(1, 64)}  # short pieces are plenty, as in texts
    total = sum(c * n for c, n in hist.items())
    placed = [sum(sum(f) * t for f, t in made) / total for made in (packing.solve(hist, 64), packing.fills(hist, 64))]
    assert placed[0] <= placed[1] and placed[1] >= 0.98


def test_nnls():
    a = np.array([[1.0, 0, 1], [0, 1, 1], [1, 1, 0]])
    x = packing.nnls(a, np.array([1.0, 2, 3]))
    assert np.allclose(a @ x, [1, 2, 3]) and (x >= 0).all()
    assert packing.nnls(np.eye(2), np.array([-1.0, 2.0])).tolist() == [0, 2]


def test_pieces_are_merged_once_while_they_are_kept():
    from driftwell.llm.tokens import Encoder

    path, text = public_vocabulary("byte_bpe_50k.json"), " ".join("abcdefghijklmnopqrst")
    for kept, most in ((40, 20), (5, 40)):
        e, merged = Encoder(path, kept), []
        e.pieces.make = lambda piece, make=e._piece, merged=merged: merged.append(piece) or make(piece)
        assert e.encode(text) == e.encode(text) == e.whole(text) and len(merged) == most
    assert encoder(path, 7).pieces.most >= 7 and encoder(path, 200_000).pieces.most == 200_000 and encoder(path) is encoder(path, 200_000)
