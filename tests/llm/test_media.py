from __future__ import annotations

import hashlib
import io
import zlib
from fractions import Fraction

import numpy as np
import pytest

from framewright.llm import media as M


def test_netpbm_kinds():
    assert M.decode(b"P1\n# c\n3 2\n1 0 1\n010").tolist() == [[1, 0, 1], [0, 1, 0]]
    assert M.decode(b"P2 2 1 9\n3 9").tolist() == [[3, 9]]
    assert M.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert M.decode(b"P4 9 1\n" + bytes([0b10000001, 0b10000000])).tolist() == [[1, 0, 0, 0, 0, 0, 0, 1, 1]]
    assert M.decode(b"P5\n#x\n2 1 65535\n" + bytes([1, 0, 0, 2])).tolist() == [[256, 2]]
    assert M.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    for bad in (b"P7 1 1", b"P5 x", b"P5 2 2 255\n\0", b"JPEG"):
        with pytest.raises((ValueError, IndexError)):
            M.decode(bad)


def test_bmp_round_trip():
    pixels = np.arange(3 * 5 * 3, dtype=np.uint8).reshape(3, 5, 3)
    assert (M.decode(M.encode_bmp(pixels)) == pixels).all()


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (17, 9), (8, 64)])
def test_area_resize_by_fractions(shape):
    image = np.random.default_rng(1).integers(0, 256, shape)
    out = M.area_resize(image, 4, 3)
    for i, j in np.ndindex(4, 3):
        y0, y1, x0, x1 = (Fraction(a * n, m) for a, n, m in ((i, shape[0], 4), (i + 1, shape[0], 4), (j, shape[1], 3), (j + 1, shape[1], 3)))
        part = lambda k, a, b: max(Fraction(0), min(b, k + 1) - max(a, k))
        mean = sum(part(y, y0, y1) * part(x, x0, x1) * int(image[y, x]) for y, x in np.ndindex(shape)) / ((y1 - y0) * (x1 - x0))
        assert out[i, j] == pytest.approx(float(mean), abs=1e-7)


def test_tiles_and_errors(spark):
    ramp = np.tile(np.arange(64, dtype=np.uint8), (8, 1))
    rows = [(1, M.encode_pgm(ramp)), (2, None), (3, b"P5 bad"), (4, M.encode_bmp(np.full((2, 2, 3), 9, np.uint8)))]
    found = {r.id: r for r in M.tiles(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()}
    assert found[1].hash == "f" * 16 and np.load(io.BytesIO(bytes(found[1].tile))).shape == (16, 16)
    assert found[2].error == "no file" and found[3].tile is None and found[3].error and found[4].hash == "0" * 16


def test_samples_of_any_depth_are_scaled():
    def tile(data):
        return np.load(io.BytesIO(M.npy_tile(M.light(data), 2))).tolist()

    half = 32768
    assert tile(b"P5 2 2 65535\n" + np.array([0, half, half, 65535], ">u2").tobytes()) == [[0, 128], [128, 255]]
    assert tile(b"P2 2 2 15\n0 5 10 15") == [[0, 85], [170, 255]]
    assert tile(b"P1 2 2\n1 0 0 1") == tile(b"P4 2 2\n" + bytes([0b10000000, 0b01000000])) == [[0, 255], [255, 0]]
    assert tile(b"P5 2 2 255\n" + bytes([0, 7, 200, 255])) == [[0, 7], [200, 255]]
    assert tile(M.encode_bmp(np.full((2, 2, 3), 9, np.uint8))) == [[9, 9], [9, 9]]


def test_query_rows(spark):
    texts = {1: "é" * 40, 2: "", 3: None, 4: "x" * 200_000, 5: "a" * 64}
    docs = spark.createDataFrame([*texts.items(), (1, "é" * 40)], "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS n_bytes", "3 AS tile")
    rows = M.media_digest(docs).collect()
    assert len(rows) == 6
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        padded = data + b"\0" * (-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored = M.store(texts[r.doc_id] or "")
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and M.decode(stored).tobytes() == padded
        assert np.load(io.BytesIO(r.tile)).shape == (16, 16) and hashlib.sha256(r.tile).hexdigest() == r.tile_sha256
    assert M.media_digest(docs.limit(0)).count() == 0 and M.stored_media(docs).count() == 6


def exact_hash(text: str) -> str:
    """The feature by its definition: exact means of the 8 x 9 cells, each compared with its right neighbour."""
    data = text.encode()
    rows = [list(data[i : i + 64].ljust(64, b"\0")) for i in range(0, max(1, len(data)), 64)]

    def part(k: int, a: Fraction, b: Fraction) -> Fraction:
        return max(Fraction(0), min(b, Fraction(k + 1)) - max(a, Fraction(k)))

    h, bits = len(rows), ""
    for i in range(8):
        across = [sum(part(y, Fraction(i * h, 8), Fraction((i + 1) * h, 8)) * rows[y][x] for y in range(h)) for x in range(64)]
        cells = [sum(part(x, Fraction(j * 64, 9), Fraction((j + 1) * 64, 9)) * across[x] for x in range(64)) for j in range(9)]
        bits += "".join("01"[b > a] for a, b in zip(cells, cells[1:]))
    return f"{int(bits, 2):016x}"


def test_feature_is_the_exact_one(spark):
    draw = np.random.default_rng(5)
    texts = ["", "a", "abc" * 50, "x" * 64, *("".join(map(chr, draw.integers(32, 500, n))) for n in (7, 63, 64, 65, 700, 3000))]
    rows = M.media_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.feature for r in rows} == {i: exact_hash(t) for i, t in enumerate(texts)}
