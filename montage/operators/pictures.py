"""Measures of decoded pictures as columns: perceptual hashes, sharpness, watermark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .dedupe import picture_hashes
from .rank import sharpness, watermark

#: Pixels a side at most for the scores; larger pictures are shrunk to this by the means of their blocks.
SIDE = 256
MEASURES = StructType([StructField("phash", StringType()), StructField("dhash", StringType()), StructField("sharpness", DoubleType()), StructField("watermark", DoubleType())])


def shrink(grey: np.ndarray, side: int = SIDE) -> np.ndarray:
    """The picture with its longer side at most `side`, its shape kept; smaller ones as they are."""
    if max(grey.shape) <= side:
        return grey
    edges = [np.linspace(0, n, max(1, round(n * side / max(grey.shape))) + 1).astype(int) for n in grey.shape]
    sums = np.add.reduceat(np.add.reduceat(grey.astype(float), edges[0][:-1], 0), edges[1][:-1], 1)
    return sums / np.outer(*(np.diff(e) for e in edges))


def measure(grey: bytes | None, width: int | None, height: int | None) -> tuple[str | None, str | None, float, float]:
    """phash, dhash, sharpness and watermark; null hashes and scores of 0 for what is no picture (nothing, or not width * height samples)."""
    if grey is None or pd.isna(width) or pd.isna(height) or min(width, height) < 1 or len(grey) != width * height:
        return None, None, 0.0, 0.0
    pixels = np.frombuffer(grey, "u1").reshape(int(height), int(width))
    small = shrink(pixels)
    return *picture_hashes(pixels), sharpness(small), watermark(small)


@F.pandas_udf(MEASURES)
def _measured(grey: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(*row) for row in zip(grey, width, height, strict=True)], columns=["phash", "dhash", "sharpness", "watermark"])


def picture_measures(pictures: DataFrame, grey: Column, width: Column, height: Column) -> DataFrame:
    """Adds phash, dhash, sharpness and watermark of 8-bit grey samples (binary, row by row), a batch of rows at a time."""
    return pictures.withColumn("measured_", _measured(grey, width, height)).select(*[F.col(f"`{c}`") for c in pictures.columns], "measured_.*")
