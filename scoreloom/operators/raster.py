"""Features of decoded rasters in Arrow batches: spectra, blockiness, appearance and flat-graphic statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Luma weights, band edges and gradient bounds (fixed values).
LUMA = np.array([0.299, 0.587, 0.114])
LUMA_709 = np.array([0.2126, 0.7152, 0.0722])
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
FFT_EDGES = (0.0, 0.15, 0.30, 0.45, 0.60, 0.75, 1.00, 2**0.5)
DCT_EDGES = (0.0, 0.25, 0.50, 0.75, 1.01)
FLAT, HARD, PATCH, GRID, TOP, MOST_COLOURS = 2, 24, 96, 3, 8, 4096
#: Numbers of a batch of vectors that a worker sends back: 8 MB.
MOST_VALUES = 1 << 20

_COSINE = np.sqrt(2 / 8) * np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(8) + 1) / 16)
_COSINE[0] /= np.sqrt(2)


def log10_floor(x: float, least: float = 1e-12) -> float:
    return float(np.log10(max(x, least)))


def _radius(h: int, w: int) -> np.ndarray:
    y, x = ((np.arange(n) - n // 2) / (n / 2) for n in (h, w))
    return np.hypot(*np.meshgrid(y, x, indexing="ij"))


@lru_cache(8)
def _rings(h: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What spectra of a size share: the places but the mean's, their radius, and which are low and high."""
    r = _radius(h, w)
    r[h // 2, w // 2] = np.nan  # the mean's place counts nowhere
    good = ~np.isnan(r)
    return good, r[good], r <= 0.2, r >= 0.7


@lru_cache(8)
def _window(h: int, w: int) -> np.ndarray:
    return np.outer(np.hanning(h), np.hanning(w))


def spectrum(luma: np.ndarray) -> np.ndarray:
    """Centred magnitudes under a Hann window, mean removed."""
    return np.abs(np.fft.fftshift(np.fft.fft2((luma - luma.mean()) * _window(*luma.shape))))


def _bands(values: np.ndarray, radius: np.ndarray, edges: tuple[float, ...]) -> list[float]:
    which = np.digitize(radius.ravel(), edges) - 1
    n = np.bincount(which, minlength=len(edges))[: len(edges) - 1]
    total = np.bincount(which, values.ravel(), len(edges))[: len(edges) - 1]
    return [log10_floor(t / k + 1e-12) if k else float("nan") for t, k in zip(total, n, strict=True)]


def spectral(luma: np.ndarray) -> tuple[float | None, list[float] | None]:
    """Ratio of high to low frequencies and seven radial bands; none for a side under 64."""
    if min(luma.shape) < 64:
        return None, None
    s, (good, r, inner, outer) = spectrum(luma), _rings(*luma.shape)
    low, high = s[inner].mean(), s[outer].mean()
    return float(np.log10((high + 1e-12) / (low + 1e-12))), _bands(s[good], r, FFT_EDGES)


def blockiness(luma: np.ndarray, grid: int = 8) -> float | None:
    """Steps over block edges against steps inside blocks; none for a side under 24."""
    if min(luma.shape) < 24:
        return None
    on, off = [], []
    for axis in (0, 1):
        d = np.moveaxis(np.abs(np.diff(luma, axis=axis)), axis, 0)
        edge = np.arange(len(d)) % grid == grid - 1
        on.append(d[edge].ravel())
        off.append(d[~edge].ravel())
    return float(np.log10((np.concatenate(on).mean() + 1e-6) / (np.concatenate(off).mean() + 1e-6)))


def dct_bands(luma: np.ndarray, most: int = 512) -> list[float] | None:
    """Energy of 8 x 8 blocks of the centre in four radial bands, and high less low."""
    h, w = (min(n, most) for n in luma.shape)
    top, left = (luma.shape[0] - h) // 2, (luma.shape[1] - w) // 2
    h, w = h - h % 8, w - w % 8
    if min(luma.shape) < 24 or min(h, w) < 16:
        return None
    tiles = luma[top : top + h, left : left + w].reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2)
    energy = np.abs(_COSINE @ tiles @ _COSINE.T).mean((0, 1))
    r = np.hypot(*np.meshgrid(np.arange(8) / 7, np.arange(8) / 7, indexing="ij"))
    return [*_bands(energy, r, DCT_EDGES), log10_floor(energy[r >= 0.75].mean() + 1e-12) - log10_floor(energy[r <= 0.25].mean() + 1e-12)]


def _range(pixels: np.ndarray) -> np.ndarray:
    r, g, b = pixels.T
    return np.maximum(np.maximum(r, g), b) - np.minimum(np.minimum(r, g), b)


def appearance(rgb: np.ndarray, luma: np.ndarray) -> dict[str, float]:
    flat = rgb.reshape(-1, 3).astype(float)
    dx, dy = (np.abs(np.diff(luma, axis=a)).mean() if luma.shape[a] > 1 else 0.0 for a in (1, 0))
    around = sum(np.roll(luma, s, a) for a in (0, 1) for s in (1, -1))
    share = np.histogram(luma, 32, (0.0, 255.0))[0] / max(luma.size, 1)
    share = share[share > 0]
    out = {f"mean_{c}": m for c, m in zip("rgb", flat.mean(0), strict=True)} | {f"std_{c}": s for c, s in zip("rgb", flat.std(0), strict=True)}
    out |= {"luma_mean": luma.mean(), "luma_std": luma.std(), "contrast_range": np.ptp(luma), "noise_lapvar": (around - 4 * luma).var(), "edge_x": dx, "edge_y": dy, "edge_energy": dx + dy}
    out |= {"saturation_mean": _range(flat).mean(), "clipped_fraction": ((flat <= 1) | (flat >= 254)).mean(), "luma_entropy": -(share * np.log2(share)).sum()}
    return {k: float(v) for k, v in out.items()}


def box_resize(rgb: np.ndarray, n: int = 32) -> np.ndarray:
    return box_resize_to(rgb, n, n)


def box_resize_to(rgb: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of equal areas (values differ from bilinear resizing); a shorter side keeps its length."""
    ys, xs = (np.unique(np.linspace(0, s, n + 1).astype(int)[:-1].clip(max=s - 1)) for s, n in zip(rgb.shape[:2], (rows, columns), strict=True))
    total = np.add.reduceat(np.add.reduceat(rgb.astype(float), ys, 0), xs, 1)
    area = np.diff([*ys, rgb.shape[0]])[:, None] * np.diff([*xs, rgb.shape[1]])[None, :]
    return total / area[..., None]


def thumbnail(rgb: np.ndarray, n: int = 32) -> list[float]:
    """Pixels of an ``n`` by ``n`` copy as fractions, row by row, three to a pixel; short sides repeat their last pixel."""
    return _thumbnail(rgb, n).tolist()


def _thumbnail(rgb: np.ndarray, n: int = 32) -> np.ndarray:
    small = box_resize(rgb, n)
    small = np.pad(small, [(0, n - small.shape[0]), (0, n - small.shape[1]), (0, 0)], mode="edge")
    return (small / 255).ravel()


def weak_statistics(rgb: np.ndarray, most: int = 64) -> dict[str, float]:
    """Low-capacity pixel statistics of a copy of at most ``most`` pixels a side: what a shortcut could use."""
    h, w = rgb.shape[:2]
    shrink = max(h, w) / most
    small = rgb.astype(float) if shrink <= 1 else box_resize_to(rgb, max(1, round(h / shrink)), max(1, round(w / shrink)))
    part = small.reshape(-1, 3) / 255
    luma = (small / 255) @ LUMA_709
    range_ = _range(part)
    share = np.histogram(luma, 32, (0.0, 1.0))[0] / luma.size
    share = share[share > 0]
    dx, dy = (np.abs(np.diff(luma, axis=a)).mean() if luma.shape[a] > 1 else 0.0 for a in (1, 0))
    out = {f"pixel_{k}_{c}": v for k, each in (("mean", part.mean(0)), ("std", part.std(0))) for c, v in zip("rgb", each, strict=True)}
    out |= {"pixel_luma_mean": luma.mean(), "pixel_luma_std": luma.std(), "pixel_luma_entropy": -(share * np.log2(share)).sum(), "pixel_edge_x": dx, "pixel_edge_y": dy}
    out |= {"pixel_saturation_mean": range_.mean(), "pixel_near_gray_fraction": (range_ < 2 / 255).mean(), "pixel_clipped_fraction": ((part <= 1 / 255) | (part >= 254 / 255)).mean()}
    return {k: float(v) for k, v in out.items()}


def _origins(n: int) -> list[int]:
    if n <= PATCH:
        return [0]
    count = min(GRID, -(-n // PATCH))
    return [int((n - PATCH) / 2 + 0.5)] if count == 1 else [int((n - PATCH) * i / (count - 1) + 0.5) for i in range(count)]


def graphic_statistics(rgb: np.ndarray) -> dict[str, float]:
    """Flat, soft and hard gradients, palette mass and the most photographic patch over a grid of patches."""
    pixels, kinds, worst, colours = 0, np.zeros(3, int), 0.0, {}
    for y in _origins(rgb.shape[0]):
        for x in _origins(rgb.shape[1]):
            part = rgb[y : y + PATCH, x : x + PATCH].astype(int)
            luma = (part @ np.array([77, 150, 29])) >> 8
            step = np.concatenate([np.abs(np.diff(luma, axis=a)).ravel() for a in (0, 1)])
            own = np.array([(step <= FLAT).sum(), ((step > FLAT) & (step < HARD)).sum(), (step >= HARD).sum()])
            kinds += own
            worst = max(worst, own[1] / own.sum()) if own.sum() else worst
            pixels += luma.size
            keys, first, n = np.unique((part >> 3) @ np.array([1024, 32, 1]), return_index=True, return_counts=True)
            for i in np.argsort(first):
                if keys[i] in colours or len(colours) < MOST_COLOURS:
                    colours[keys[i]] = colours.get(keys[i], 0) + int(n[i])
    share = kinds / max(kinds.sum(), 1)
    return {"flat": share[0], "soft": share[1], "hard": share[2], "top8": sum(sorted(colours.values())[-TOP:]) / max(pixels, 1), "maxpatchsoft": worst, "colors": float(len(colours)), "pixels": float(pixels)}


def dct_hash(luma: np.ndarray) -> int:
    """64 bits: which of the lowest 8 x 8 cosine coefficients of a 32 x 32 copy exceed their median without the mean's."""
    n = 32
    small = box_resize(luma[..., None], n)[..., 0]
    small = np.pad(small, [(0, n - s) for s in small.shape], mode="edge")
    basis = np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(n) + 1) / (2 * n))
    low = (basis @ small @ basis.T).ravel()
    return int("".join("01"[c] for c in (low > np.median(low[1:])).astype(int)), 2)


def features(rgb: np.ndarray, stored_bytes: int | None) -> dict:
    luma = rgb.astype(float) @ LUMA
    area = float(luma.size)
    ratio, bands = spectral(luma)
    size = None if stored_bytes is None else float(stored_bytes)
    known = {"log_pixels": log10_floor(area), "log_bytes": None if size is None else log10_floor(size), "log_density": None if size is None else log10_floor(size / max(area, 1)), "spectral_ratio": ratio, "blockiness": blockiness(luma), "fft_bands": bands, "dct_bands": dct_bands(luma), "phash": f"{dct_hash(luma):016x}"}
    return known | appearance(rgb, luma) | weak_statistics(rgb) | {f"graphic_{k}": float(v) for k, v in graphic_statistics(rgb).items()}


#: Names of the weak statistics (fixed values).
WEAK = (
    *("pixel_mean_r", "pixel_mean_g", "pixel_mean_b", "pixel_std_r", "pixel_std_g", "pixel_std_b", "pixel_luma_mean", "pixel_luma_std", "pixel_luma_entropy"),
    *("pixel_edge_x", "pixel_edge_y", "pixel_saturation_mean", "pixel_near_gray_fraction", "pixel_clipped_fraction"),
)
_NAMES = [*(f"{k}_{c}" for k in ("mean", "std") for c in "rgb"), "luma_mean", "luma_std", "contrast_range", "noise_lapvar", "edge_x", "edge_y", "edge_energy", "saturation_mean", "clipped_fraction", "luma_entropy", *WEAK, *(f"graphic_{k}" for k in ("flat", "soft", "hard", "top8", "maxpatchsoft", "colors", "pixels"))]
SCHEMA = "log_pixels double, log_bytes double, log_density double, spectral_ratio double, blockiness double, fft_bands array<double>, dct_bands array<double>, phash string, " + ", ".join(f"{n} double" for n in _NAMES)


def _pixels(images: pa.StructArray) -> Iterator[np.ndarray]:
    for h, w, c, data in zip(*(images.field(k) for k in ("height", "width", "nChannels", "data")), strict=True):
        raw = np.frombuffer(data.as_buffer(), np.uint8).reshape(h.as_py(), w.as_py(), c.as_py())
        yield np.repeat(raw, 3, 2) if raw.shape[2] == 1 else raw[..., 2::-1]


def vectors_of(batches: Iterator[pa.Array], one: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.Array]:
    """What ``one`` makes of each image, as arrays: a batch goes out as soon as it has ``MOST_VALUES`` numbers, whatever came in."""

    def lists(part: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, part)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(part), pa.float64()))

    for batch in batches:
        part, held = [], 0
        for rgb in _pixels(batch):
            part.append(one(rgb))
            held += len(part[-1])
            if held >= MOST_VALUES:
                yield lists(part)
                part, held = [], 0
        if part:
            yield lists(part)


def _vectors(image: Column, one: Callable[[np.ndarray], np.ndarray]) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from vectors_of(batches, one)

    return F.arrow_udf(run, "array<double>")(image)


def thumbnails(image: Column) -> Column:
    """The 32 by 32 copy of a Spark image struct as a vector of 3,072 fractions."""
    return _vectors(image, _thumbnail)


def normalised_planes(image: Column, mean: tuple[float, ...] = MEAN, std: tuple[float, ...] = STD) -> Column:
    """Pixels of a Spark image struct plane after plane, less ``mean`` and over ``std``: what a model is fed."""
    return _vectors(image, lambda rgb: ((rgb / 255 - mean) / std).transpose(2, 0, 1).ravel())


def _extract(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    fields = [pa.field(n, _FEATURES[t]) for n, t in (x.split() for x in SCHEMA.split(", "))]
    for image, sizes in batches:
        made = [features(rgb, size) for rgb, size in zip(_pixels(image), sizes.to_pylist(), strict=True)]
        yield pa.StructArray.from_arrays([pa.array([m[f.name] for m in made], f.type) for f in fields], fields=fields)


_FEATURES = {"double": pa.float64(), "array<double>": pa.list_(pa.float64()), "string": pa.string()}


def extract(image: Column, stored_bytes: Column) -> Column:
    """All features of a Spark image struct; null where a probe is undefined for the size."""
    return F.arrow_udf(_extract, SCHEMA)(image, stored_bytes)


CODEC_SCHEMA = "is_jpeg boolean, is_png boolean, is_webp boolean, jpeg_qmean double, jpeg_quality_proxy double, chroma_h int, chroma_v int, has_exif boolean, has_icc boolean, has_software boolean, has_comment boolean, has_xmp boolean"


def _segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Marker and content of each JPEG segment before the image data."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        yield data[at + 1], data[at + 4 : at + 2 + size]
        at += 2 + size


def _chunks(data: bytes, at: int, order: str) -> Iterator[tuple[bytes, bytes]]:
    """Kind and content of each chunk of a PNG (length first) or WebP file (kind first, even lengths)."""
    while at + 8 <= len(data):
        head, other = data[at : at + 4], data[at + 4 : at + 8]
        size, kind = (int.from_bytes(head, "big"), other) if order == "big" else (int.from_bytes(other, "little"), head)
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + (4 if order == "big" else size % 2)


def codec_flags(data: bytes | None) -> dict:
    """What the stored bytes tell beside the pixels: codec, first quantisation table, chroma sampling, metadata."""
    data, exif, icc, software, comment, xmp = data or b"", False, False, False, False, False
    table, chroma = None, None
    jpeg, png, webp = data[:3] == b"\xff\xd8\xff", data[:8] == b"\x89PNG\r\n\x1a\n", data[:4] == b"RIFF" and data[8:12] == b"WEBP"
    for mark, part in _segments(data) if jpeg else ():
        exif |= mark == 0xE1 and part.startswith(b"Exif\0")
        xmp |= mark == 0xE1 and part.startswith(b"http://ns.adobe.com/xap/")
        icc |= mark == 0xE2 and part.startswith(b"ICC_PROFILE\0")
        comment |= mark == 0xFE and len(part) > 0
        if mark == 0xDB and table is None:
            wide = part[:1] >= b"\x10"
            table = np.frombuffer(part[1 : 129 if wide else 65], ">u2" if wide else "u1")
        if mark in (0xC0, 0xC1, 0xC2) and len(part) >= 12:
            chroma = part[10] >> 4, part[10] & 15
    for kind, part in _chunks(data, 8, "big") if png else _chunks(data, 12, "little") if webp else ():
        exif |= kind in (b"eXIf", b"EXIF")
        icc |= kind in (b"iCCP", b"ICCP")
        software |= kind == b"tEXt" and part.startswith(b"Software\0") and len(part) > 9
        comment |= kind == b"tEXt" and part.startswith(b"Comment\0") and len(part) > 8
        xmp |= kind == b"XMP " or kind == b"iTXt" and part.startswith(b"XML:com.adobe.xmp\0")
    mean = None if table is None or not len(table) else float(table.mean())
    h, v = chroma or ((1, 1) if jpeg else (None, None))
    proxy = None if mean is None else min(max(100 - mean * 100 / 255, 1.0), 100.0)
    flags = {"has_exif": exif, "has_icc": icc, "has_software": software, "has_comment": comment, "has_xmp": xmp}
    return {"is_jpeg": jpeg, "is_png": png, "is_webp": webp, "jpeg_qmean": mean, "jpeg_quality_proxy": proxy, "chroma_h": h, "chroma_v": v} | flags


def codec(content: Column) -> Column:
    """:func:`codec_flags` of a column of file contents; nulls count as no known codec."""

    def run(content: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([codec_flags(x) for x in content], columns=[x.split()[0] for x in CODEC_SCHEMA.split(", ")])
        return out.astype({"chroma_h": "Int32", "chroma_v": "Int32"})

    return F.pandas_udf(run, CODEC_SCHEMA)(content)


def read_images(spark, path: str) -> DataFrame:
    """Decoded images below a folder with path, byte count and file hash; corrupt files are left out, not fatal."""
    decoded = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg,bmp,gif}").load(path)
    sizes = files.select("path", F.col("length").alias("stored_bytes"), F.sha2("content", 256).alias("sha256"))
    return decoded.select(F.col("image.origin").alias("path"), "image").join(sizes, "path", "left")
