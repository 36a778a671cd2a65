"""Pixels: portable pixmaps, arrays of colours, samples."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drumlin.schema import cloud_from_rows, with_point_index


def parse_ppm(data: bytes) -> np.ndarray:
    """The pixels of a binary P6 file, (height, width, 3)."""
    m = re.match(rb"P6(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
    if not m or m[3] != b"255":
        raise ValueError("not a P6 pixmap with 255 levels")
    width, height = int(m[1]), int(m[2])
    return np.frombuffer(data, np.uint8, width * height * 3, m.end()).reshape(height, width, 3)


def read_ppm_points(spark: SparkSession, path: str) -> DataFrame:
    """(path, x): a point (column, row) for each pixel that isn't white."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows, cols = np.nonzero((parse_ppm(bytes(content)) != 255).any(axis=2))
                yield pd.DataFrame({"path": name, "x": [[float(c), float(r)] for r, c in zip(rows, cols, strict=True)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, x array<double>")


def read_images(spark: SparkSession, path: str, max_dim: int | None = None) -> DataFrame:
    """(path, point_id, r, g, b): the pixels of images in any format that Spark's image source
    reads (PNG, JPEG, GIF, BMP), numbered within each image; what it can't read is dropped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, h, w, channels, data in zip(*(frame[c] for c in frame.columns), strict=True):
                a = np.frombuffer(bytes(data), np.uint8).reshape(h, w, channels)
                bgr = np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, :3]
                px = as_pixels(bgr, bgr=True, max_dim=max_dim).astype(int)
                yield pd.DataFrame({"path": name, "point_id": np.arange(len(px)), "r": px[:, 0], "g": px[:, 1], "b": px[:, 2]})

    files = spark.read.format("image").option("dropInvalid", True).load(path)
    return files.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, "path string, point_id long, r int, g int, b int")


def as_pixels(image: np.ndarray, *, bgr: bool = False, max_dim: int | None = None) -> np.ndarray:
    """Nx3 bytes from (H, W, 3) or (N, 3): nearest-neighbour downscale to `max_dim`, floats up
    to 1 scaled by 255, clipped, channels swapped if blue comes first."""
    a = np.asarray(image)
    if a.ndim not in (2, 3) or a.shape[-1] != 3:
        raise ValueError("an image is (H, W, 3) or (N, 3)")
    if a.ndim == 3 and max_dim and max(a.shape[:2]) > max_dim:
        scale = max_dim / max(a.shape[:2])
        h, w = (max(1, round(s * scale)) for s in a.shape[:2])
        a = a[np.minimum(((np.arange(h) + 0.5) * a.shape[0] / h).astype(int), a.shape[0] - 1)][:, np.minimum(((np.arange(w) + 0.5) * a.shape[1] / w).astype(int), a.shape[1] - 1)]
    if np.issubdtype(a.dtype, np.floating):
        a = a * 255 if a.size and a.max() <= 1.0 else a
        a = np.clip(a, 0, 255)
    a = np.clip(a, 0, 255).astype(np.uint8).reshape(-1, 3)
    return a[:, ::-1] if bgr else a


def pixel_frame(spark: SparkSession, image: np.ndarray, **options) -> DataFrame:
    """(point_id, r, g, b) of an image in memory."""
    px = as_pixels(image, **options)
    return spark.createDataFrame(pd.DataFrame({"point_id": np.arange(len(px)), "r": px[:, 0].astype(int), "g": px[:, 1].astype(int), "b": px[:, 2].astype(int)}))


def cloud_from_array(spark: SparkSession, array: np.ndarray) -> DataFrame:
    a = np.asarray(array)
    if a.ndim != 2:
        raise ValueError("points must be a two-dimensional array")
    return cloud_from_rows(spark, a.tolist())


def sample_points(points: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """`n` points without replacement, renumbered; the draw depends on ids and the seed only."""
    drawn = points.orderBy(F.xxhash64(F.lit(seed), "point_id")).limit(n)
    return with_point_index(drawn.select("point_id", "x"), ["point_id"])
