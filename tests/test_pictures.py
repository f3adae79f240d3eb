"""PNG decoding against pixels put in, by all filters, kinds, orientations and faults."""

import zlib

import numpy as np
import pytest

from scoreloom.sources import pictures as P


def part(kind, content):
    return len(content).to_bytes(4, "big") + kind + content + zlib.crc32(kind + content).to_bytes(4, "big")


def filtered(pixels, kind):
    """The rows as a writer would filter them."""
    h, w, n = pixels.shape
    rows = np.zeros((h + 1, (w + 1) * n), int)
    rows[1:, n:] = pixels.reshape(h, -1)
    out = []
    for y in range(1, h + 1):
        line = []
        for x in range(n, (w + 1) * n):
            a, b, c = rows[y, x - n], rows[y - 1, x], rows[y - 1, x - n]
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((rows[y, x] - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        out.append(bytes([kind, *line]))
    return b"".join(out)


def png(pixels, colour, kind=0, extra=b"", interlace=0):
    h, w, _ = pixels.shape
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, colour, 0, 0, interlace])
    data = zlib.compress(filtered(pixels, kind))
    return P._SIGNATURE + part(b"IHDR", head) + extra + part(b"IDAT", data[:7]) + part(b"IDAT", data[7:]) + part(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_filters_and_kinds(kind, colour):
    n = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    pixels = np.random.default_rng(kind).integers(0, 256, (5, 7, n)).astype(np.uint8)
    data = png(pixels, colour, kind)
    got = P.decode(data, P.header_of(data))
    rgb = np.repeat(pixels[..., :1], 3, 2) if n < 3 else pixels[..., :3]
    alpha = pixels[..., -1:] / 255 if n in (2, 4) else 1.0
    assert np.array_equal(got, np.floor(rgb * alpha + np.array(P.MEAN_FILL) * (1 - alpha) + 0.5 + 1e-9))


def test_palette_with_clear_colours():
    index = np.array([[[0], [1], [2]]], np.uint8)
    data = png(index, 3, extra=part(b"PLTE", bytes([9, 9, 9, 1, 2, 3, 200, 100, 0])) + part(b"tRNS", bytes([255, 0])))
    assert P.decode(data, P.header_of(data)).tolist() == [[[9, 9, 9], list(P.MEAN_FILL), [200, 100, 0]]]


def test_orientations():
    """Where the first pixel stands, and which way the first row runs, in each orientation."""
    pixels = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    seen = {k: P.oriented(pixels, k)[..., 0].tolist() for k in range(1, 9)}
    assert seen == {1: [[0, 1, 2], [3, 4, 5]], 2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]], 5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]]}
    assert P.header_of(P.png_of(pixels, 6)).orientation == 6 and P.orientation_of(b"II\x2a\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x08\0\0\0") == 8
    assert P.orientation_of(b"MM\0\x2a\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x09\0\0") == 1 and P.orientation_of(b"") == 1


def test_files_of_a_folder(spark, tmp_path):
    good = np.random.default_rng(1).integers(0, 256, (4, 6, 3)).astype(np.uint8)
    (tmp_path / "deep").mkdir()
    for name, data in {"a.png": P.png_of(good), "deep/b.PNG": P.png_of(good, 8), "cut.png": P.png_of(good)[:60], "text.png": b"no picture", "empty.png": b"", "large.png": P.png_of(np.zeros((20, 20, 1))), "laced.png": png(good, 2, interlace=1), "other.jpg": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in P.read_pictures(spark, str(tmp_path), 100).collect()}
    assert {k: r.status for k, r in rows.items()} == {"a.png": "ok", "b.PNG": "ok", "cut.png": "corrupt", "text.png": "corrupt", "large.png": "too-large", "laced.png": "corrupt"}  # not the empty file
    assert bytes(rows["a.png"].rgb) == good.tobytes() and (rows["b.PNG"].width, rows["b.PNG"].height) == (4, 6)
    assert bytes(rows["b.PNG"].rgb) == P.oriented(good, 8).tobytes() and rows["large.png"].rgb is None and rows["large.png"].width == 20
