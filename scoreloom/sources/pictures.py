"""PNG files of any store as rows of pixels: headers first, a pixel budget, orientation and transparency."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Colour that shows through transparent pixels, and pixels of the largest picture that is decoded (fixed values).
MEAN_FILL, MOST_PIXELS = (124, 116, 104), 64_000_000
SCHEMA = "path string, sha256 string, stored_bytes long, status string, width int, height int, orientation int, rgb binary"

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


@dataclass
class Header:
    width: int
    height: int
    depth: int
    colour: int
    interlaced: bool
    orientation: int = 1


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(_SIGNATURE)
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def orientation_of(exif: bytes) -> int:
    """The orientation, 1 to 8, that EXIF data tell; 1 if they tell none."""
    order = {b"II": "little", b"MM": "big"}.get(exif[:2])
    if order is None or len(exif) < 8:
        return 1
    number = lambda at, n: int.from_bytes(exif[at : at + n], order)
    first = number(4, 4)
    for k in range(number(first, 2)):
        at = first + 2 + 12 * k
        if number(at, 2) == 0x0112:
            value = number(at + 8, 2)
            return value if 1 <= value <= 8 else 1
    return 1


def header_of(data: bytes) -> Header:
    """What the file says before its pixels; ValueError if it is no PNG of a known kind."""
    parts = dict((k, v) for k, v in chunks(data) if k in (b"IHDR", b"eXIf")) if data.startswith(_SIGNATURE) else {}
    ihdr = parts.get(b"IHDR", b"")
    if len(ihdr) != 13 or ihdr[9] not in _CHANNELS:
        raise ValueError("not a PNG file")
    return Header(int.from_bytes(ihdr[:4], "big"), int.from_bytes(ihdr[4:8], "big"), ihdr[8], ihdr[9], bool(ihdr[12]), orientation_of(parts.get(b"eXIf", b"")))


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes after undoing each row's filter against the byte before and the row above."""
    rows = np.frombuffer(raw, np.uint8)
    if len(rows) != height * (stride + 1):
        raise ValueError("the pixel data are not complete")
    rows = rows.reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + step), np.int32)
    for y in range(height):
        kind, line, above, now = int(rows[y, 0]), rows[y, 1:].astype(np.int32), out[y], out[y + 1]
        if kind == 0:
            now[step:] = line
        elif kind == 1:  # running sums of each channel
            now[step:] = np.cumsum(line.reshape(-1, step), axis=0).ravel() & 255
        elif kind == 2:
            now[step:] = (line + above[step:]) & 255
        elif kind in (3, 4):
            for x in range(step, stride + step, step):
                left, up, corner = now[x - step : x], above[x : x + step], above[x - step : x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                now[x : x + step] = (line[x - step : x] + guess) & 255
        else:
            raise ValueError("an unknown filter")
    return out[1:, step:].astype(np.uint8)


def oriented(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """The picture as it is meant to be seen: mirrored for 2, 4, 5 and 7, turned for the others over 1."""
    if orientation >= 5:
        pixels = pixels.swapaxes(0, 1)
    if orientation in (3, 4, 7, 8):
        pixels = pixels[::-1]
    if orientation in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    return pixels


def decode(data: bytes, header: Header) -> np.ndarray:
    """Upright RGB pixels; transparent ones show ``MEAN_FILL``. Eight bits a channel, not interlaced."""
    if header.depth != 8 or header.interlaced:
        raise ValueError("only 8 bits a channel and no interlacing")
    parts: dict[bytes, bytes] = {}
    for kind, content in chunks(data):
        parts[kind] = parts.get(kind, b"") + content if kind == b"IDAT" else content
    n = _CHANNELS[header.colour]
    pixels = _unfiltered(zlib.decompress(parts.get(b"IDAT", b"")), header.height, header.width * n, n).reshape(header.height, header.width, n)
    clear = parts.get(b"tRNS")
    alpha = None
    if header.colour == 3:
        index, palette = pixels[..., 0], np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)
        if clear is not None:
            shown = np.full(len(palette), 255, np.uint8)
            shown[: len(clear)] = np.frombuffer(clear, np.uint8)
            alpha = shown[index]
        rgb = palette[index]
    else:
        if header.colour in (4, 6):
            alpha = pixels[..., -1]
        elif clear is not None:
            alpha = np.where((pixels == np.frombuffer(clear, ">u2")).all(2), 0, 255).astype(np.uint8)
        rgb = pixels[..., :3] if header.colour in (2, 6) else np.repeat(pixels[..., :1], 3, axis=2)
    if alpha is not None:
        a = alpha[..., None].astype(np.int32)
        rgb = (2 * (rgb * a + np.array(MEAN_FILL) * (255 - a)) + 255) // 510
    return np.ascontiguousarray(oriented(rgb.astype(np.uint8), header.orientation))


def read_pictures(spark: SparkSession, path: str, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """A row for each PNG file below ``path``: its hash and size, and upright RGB pixels row by row.

    Files are listed and read by Spark, so any store will do, and in any order.
    The header is read first: a picture of over ``most_pixels`` is ``too-large``
    and never decoded; files that are no PNG or broken are ``corrupt``. These
    rows have no pixels; files of no bytes have no row, as Spark does not read
    them. Width and height are those of the upright picture.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, sha, size, content in zip(*batch.columns, strict=True):
                data, status, w, h, turn, rgb = content.as_py(), "corrupt", None, None, None, None
                try:
                    header = header_of(data)
                    w, h, turn = header.width, header.height, header.orientation
                    w, h = (h, w) if turn >= 5 else (w, h)
                    status = "too-large" if w * h > most_pixels else "corrupt"
                    if status != "too-large":
                        rgb, status = decode(data, header).tobytes(), "ok"
                except (ValueError, KeyError, IndexError, zlib.error):
                    pass
                values = [path.as_py(), sha.as_py(), size.as_py(), status, w, h, turn, rgb]
                yield pa.record_batch([pa.array([v], t) for v, t in zip(values, _TYPES, strict=True)], _NAMES)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][nN][gG]").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("stored_bytes"), "content").mapInArrow(run, SCHEMA)


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def png_of(pixels: np.ndarray, orientation: int = 1) -> bytes:
    """A PNG file of ``pixels`` (height, width, channels: 1, 2, 3 or 4), rows as they are."""
    height, width, n = pixels.shape
    part = lambda kind, content: len(content).to_bytes(4, "big") + kind + content + zlib.crc32(kind + content).to_bytes(4, "big")
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0])
    exif = b"MM\0\x2a\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01" + orientation.to_bytes(2, "big") + b"\0\0\0\0\0\0"
    rows = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    return _SIGNATURE + part(b"IHDR", head) + (part(b"eXIf", exif) if orientation != 1 else b"") + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def write_pictures(rows: DataFrame, folder: str) -> None:
    """A file ``<name>.png`` in ``folder`` for each of ``rows(name, width, height, channels, orientation, pixels array<int>, kept)``.

    ``kept`` bytes are written, as of a file that did not come whole; all if null.

    ``folder`` must be one that all executors see as a mounted folder: Spark has
    no sink for files of this kind. A task that runs again writes the same file.
    """
    import os

    if ":" in folder and not folder.startswith("file:"):
        raise ValueError("the folder must be a mounted one")
    local = folder.removeprefix("file://").removeprefix("file:")
    os.makedirs(local, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = png_of(np.array(row["pixels"], np.uint8).reshape(row["height"], row["width"], row["channels"]), row["orientation"])
                with open(f"{local}/{row['name']}.tmp", "wb") as f:
                    f.write(data[: row["kept"]])
                os.replace(f"{local}/{row['name']}.tmp", f"{local}/{row['name']}.png")
            yield pa.record_batch([pa.array([batch.num_rows])], ["n"])

    rows.select("name", "width", "height", "channels", "orientation", "pixels", "kept").mapInArrow(run, "n long").agg(F.sum("n")).collect()
