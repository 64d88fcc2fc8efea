"""Images: dimensions and pixel statistics, and 64-bit perceptual hashes in four orientations.

The JVM's image reader decodes; Arrow batches carry pixels to one function that works on whole images.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Side of the grey thumbnail that is transformed, and of the block of low frequencies kept.
SIDE, LOW = 32, 8
#: Least side of a valid image.
LEAST = 32
FIELDS = "pixel_std double, dark_share double, border_mean array<double>, border_std array<double>, hash array<long>"


def read_images(spark: SparkSession, root: str, least: int = LEAST) -> DataFrame:
    """``(path, width, height, channels, data, valid)``: files that do not decode have width -1, and these and such with
    a side below ``least`` are not valid."""
    i = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root).select("image.*")
    return i.select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data", ((F.col("width") >= least) & (F.col("height") >= least)).alias("valid"))


def _window(n: int, m: int, taps: float, kernel) -> np.ndarray:
    """Weights that bring n samples to m, in 22-bit fixed point: a kernel that widens with the reduction, over whole
    samples, as common image libraries compute them for 8-bit pictures."""
    scale = n / m
    wide = max(scale, 1.0)
    out = np.zeros((m, n))
    for i in range(m):
        centre = (i + 0.5) * scale
        lo, hi = max(int(centre - taps * wide + 0.5), 0), min(int(centre + taps * wide + 0.5), n)
        w = kernel((np.arange(lo, hi) - centre + 0.5) / wide)
        out[i, lo:hi] = w / w.sum()
    return np.trunc(out * (1 << 22) + np.copysign(0.5, out))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _bilinear(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(x), 0.0)


def resized(a: np.ndarray, side: int | tuple[int, int], kernel=_lanczos, taps: float = 3.0) -> np.ndarray:
    """An 8-bit plane or picture at ``side`` (height, width): rows first, then columns, rounded to 8 bits after each."""
    height, width = (side, side) if isinstance(side, int) else side

    def step(x: np.ndarray, m: int) -> np.ndarray:  # along the last axis
        if x.shape[-1] == m:
            return x
        return np.clip(np.floor((x @ _window(x.shape[-1], m, taps, kernel).T + (1 << 21)) / (1 << 22)), 0, 255)

    planes = a[None] if a.ndim == 2 else np.moveaxis(a, 2, 0)
    planes = step(planes.astype(np.float64), width)
    planes = np.swapaxes(step(np.swapaxes(planes, 1, 2), height), 1, 2)
    return planes[0] if a.ndim == 2 else np.moveaxis(planes, 0, 2)


def small(a: np.ndarray, side: int = 64) -> np.ndarray:
    return resized(a, side, _bilinear, 1.0)


def grey_of(rgb: np.ndarray) -> np.ndarray:
    """Luma in whole numbers."""
    r, g, b = (rgb[:, :, i].astype(np.int64) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.float64)


def dct_basis(n: int) -> np.ndarray:
    """Type II cosines; row k is frequency k."""
    return np.cos(np.pi * (np.arange(n) + 0.5)[None, :] * np.arange(n)[:, None] / n)


def packed(block: np.ndarray) -> int:
    """Bits (coefficient above the median) of a block, the first one highest, as a signed 64-bit integer."""
    bits = (block > np.median(block)).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >> 63 else value


def perceptual_hashes(grey: np.ndarray) -> list[int]:
    """Hashes of the image as it is, mirrored, upside down, and both: mirroring changes the sign of odd frequencies."""
    basis = dct_basis(SIDE)[:LOW]
    c = basis @ resized(grey, SIDE) @ basis.T
    sign = np.where(np.arange(LOW) % 2, -1.0, 1.0)
    return [packed(x) for x in (c, c * sign[None, :], c * sign[:, None], c * sign[None, :] * sign[:, None])]


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Red, green, blue of a row of ``read_images``, which stores blue, green, red (and alpha), or grey."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]


def exif_orientation(data: bytes) -> int:
    """How a JPEG's header says the picture is turned (1 to 8); 1 for all else."""
    at = 2
    if data[:2] != b"\xff\xd8":
        return 1
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        part = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and part[:6] == b"Exif\0\0" and len(part) > 14:
            order = {b"II": "little", b"MM": "big"}.get(part[6:8])
            if not order:
                return 1
            tiff = part[6:]
            number = lambda i, n: int.from_bytes(tiff[i : i + n], order)
            first = number(4, 4)
            for i in range(number(first, 2)):
                entry = first + 2 + 12 * i
                if number(entry, 2) == 0x0112:
                    turn = number(entry + 8, 2)
                    return turn if 1 <= turn <= 8 else 1
            return 1
        at += 2 + size
    return 1


def upright(a: np.ndarray, orientation: int) -> np.ndarray:
    """The picture as it is meant to be seen."""
    if orientation in (2, 3, 6, 7):
        a = a[:, ::-1] if orientation == 2 else a[::-1, ::-1] if orientation == 3 else np.rot90(a, 3) if orientation == 6 else np.swapaxes(a[::-1, ::-1], 0, 1)
    elif orientation in (4, 5, 8):
        a = a[::-1] if orientation == 4 else np.swapaxes(a, 0, 1) if orientation == 5 else np.rot90(a, 1)
    return a


def fitted(a: np.ndarray, side: int, fill: int | None = None) -> np.ndarray:
    """A square picture that contains the whole one, its proportions kept: the rest is of one value, or without one
    mirrored at the edge (repeated where there is one row or column)."""
    h, w = a.shape[:2]
    scale = min(side / h, side / w)
    nh, nw = max(1, min(side, round(h * scale))), max(1, min(side, round(w * scale)))
    a = resized(a, (nh, nw), _bilinear, 1.0)
    top, left = (side - nh) // 2, (side - nw) // 2
    pads = ((top, side - nh - top), (left, side - nw - left))
    if fill is not None:
        return np.pad(a, (*pads, (0, 0)), constant_values=fill)
    for axis, pad in enumerate(pads):
        spec = [(0, 0)] * 3
        spec[axis] = pad
        a = np.pad(a, spec, mode="reflect" if a.shape[axis] > 1 else "edge")
    return a


def ring(a: np.ndarray, width: int = 8) -> np.ndarray:
    """Pixels of the border, once each."""
    edge = np.ones(a.shape[:2], bool)
    edge[width:-width, width:-width] = False
    return a[edge]


def border_bands(a: np.ndarray, width: int = 8) -> np.ndarray:
    """Pixels of the four bands of the border, those of corners twice."""
    return np.concatenate([x.reshape(-1, 3) for x in (a[:width], a[-width:], a[:, :width], a[:, -width:])])


def _measured(height: int, width: int, channels: int, data: bytes, orientation: int = 1) -> tuple:
    rgb = upright(pixels(height, width, channels, data), orientation)
    tile = small(rgb).astype(np.float32)
    band = border_bands(tile)
    return float(tile.std()), float((tile < 4).all(2).mean()), [float(x) for x in band.mean(0)], [float(x) for x in band.std(0)], perceptual_hashes(grey_of(rgb))


def with_orientation(images: DataFrame, root: str) -> DataFrame:
    """Rows of ``read_images`` with ``orientation`` from the files' headers, however far into a file they stand: segments are
    walked from the start to the picture."""
    turn = F.pandas_udf(lambda xs: xs.map(exif_orientation), "int", F.PandasUDFType.SCALAR)
    files = images.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    heads = files.select(F.col("path"), turn(F.col("content")).alias("orientation"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    read = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))  # the image reader escapes paths
    return images.join(heads.select(plain(F.col("path")).alias("_p"), "orientation"), plain(read) == F.col("_p"), "left").drop("_p")


def with_statistics(images: DataFrame) -> DataFrame:
    """Rows of ``read_images`` without pixels, with the deviation and the share of dark pixels of the picture at 64 x 64,
    mean and deviation of red, green and blue in its border, and hashes; null for images that did not decode. With a
    column ``orientation`` pictures are turned upright first."""
    turned = "orientation" in images.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            turns = pdf["orientation"].fillna(1).astype(int) if turned else [1] * len(pdf)
            got = [_measured(h, w, c, d, o) if w > 0 and h > 0 else (None,) * 5 for h, w, c, d, o in zip(pdf["height"], pdf["width"], pdf["channels"], pdf["data"], turns)]
            stats = pd.DataFrame(got, columns=["pixel_std", "dark_share", "border_mean", "border_std", "hash"], index=pdf.index)
            yield pd.concat([pdf[["path", "width", "height", "channels", "valid"]], stats], axis=1)

    return images.mapInPandas(run, f"path string, width int, height int, channels int, valid boolean, {FIELDS}")


def border_pixels(images: DataFrame, side: int = 48, width: int = 8) -> DataFrame:
    """``(path, pixels)``: the border of each picture at ``side``, as features that should tell nothing about its class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, ring(small(pixels(h, w, c, d), side), width).ravel().tolist()) for p, h, w, c, d in zip(pdf["path"], pdf["height"], pdf["width"], pdf["channels"], pdf["data"]) if w > 0 and h > 0]
            yield pd.DataFrame(rows, columns=["path", "pixels"])

    return images.mapInPandas(run, "path string, pixels array<double>")


def degenerate(std: float = 3.0, dark: float = 0.97):
    """Whether an image is blank or black."""
    return (F.col("pixel_std") < std) | (F.col("dark_share") > dark)


def inventory(files: DataFrame, images: DataFrame, suspicious: Column, key: str = "name") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(manifest, invalid, suspicious)``: usable files with digests and statistics, those left out with the reason, and
    usable ones whose names have telltale words. ``files`` are labelled with digests, ``images`` have statistics; both
    know a file by ``key``."""
    both = files.where("kept").join(images.drop("path", "size"), key, "left")
    reason = F.when(F.coalesce("width", F.lit(-1)) <= 0, "does not decode").when(~F.col("valid"), "too small").when(degenerate(), "blank or black")
    both = both.withColumn("reason", reason)
    ok = both.where("reason is null").drop("reason")
    found = ok.withColumn("matched", suspicious)
    return ok, both.where("reason is not null").select("relative_path", "reason"), found.where(F.size("matched") > 0).select("relative_path", "class", F.array_join("matched", ";").alias("matched_tokens"))
