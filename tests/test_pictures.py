"""Measures of pictures: columns equal a plain computation, odd rows have defined values."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from montage.operators import pictures, rank
from montage.plans import catalog


def _watermark(g):
    h, w = g.shape
    e = np.zeros((h, w))
    for i in range(h):
        for j in range(w):
            a, b = max(i - 1, 0), min(i + 1, h - 1)
            c, d = max(j - 1, 0), min(j + 1, w - 1)
            e[i, j] = abs(g[b, j] - g[a, j]) / (b - a) + abs(g[i, d] - g[i, c]) / (d - c)
    y, x = max(2, h // 8), max(2, w // 8)
    border = [*e[:y].ravel(), *e[-y:].ravel(), *e[:, :x].ravel(), *e[:, -x:].ravel()]
    ratio = np.mean(border) / (e[y:-y, x:-x].mean() or 1e-6)
    return 0.0 if ratio <= 1.3 else min(1.0, (ratio - 1.3) / 1.7)


def test_watermark_is_that_of_single_pixels():
    rng = np.random.default_rng(5)
    for shape in ((32, 32), (40, 70), (65, 33)):
        g = rng.integers(0, 20, shape).astype(float)
        g[:5] = rng.integers(0, 60, g[:5].shape)
        assert rank.watermark(g) == pytest.approx(_watermark(g))
        assert 0 < rank.watermark(g) < 1
    assert rank.watermark(np.zeros((31, 90))) == 0


def test_shrink_keeps_means_and_shape():
    g = np.random.default_rng(1).integers(0, 255, (1024, 512))
    small = pictures.shrink(g)
    assert small.shape == (256, 128) and small[3, 5] == g[12:16, 20:24].mean()
    assert pictures.shrink(g[:200, :200]).shape == (200, 200) and pictures.shrink(np.zeros((5000, 1))).shape == (256, 1)


def test_columns_equal_the_functions(spark):
    rng = np.random.default_rng(2)
    made = [(i, rng.integers(0, 255, h * w, "u1").tobytes(), w, h) for i, (w, h) in enumerate([(64, 64), (300, 40), (1, 1), (2, 900)])]
    odd = [(10, None, 4, 4), (11, b"abc", 2, 2), (12, b"", 0, 0), (13, b"ab", None, 1)]
    frame = spark.createDataFrame(made + odd, "id long, grey binary, width int, height int")
    got = {r.id: (r.phash, r.dhash, r.sharpness, r.watermark) for r in pictures.picture_measures(frame, F.col("grey"), F.col("width"), F.col("height")).collect()}
    assert got == {i: pictures.measure(g, w, h) for i, g, w, h in made} | {i: (None, None, 0.0, 0.0) for i, *_ in odd}
    assert pictures.picture_measures(frame.limit(0), F.col("grey"), F.col("width"), F.col("height")).count() == 0


def test_query_measures_whole_texts(spark, data):
    want = {}
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall():
        raw = (text or "").encode()
        rows = -(-len(raw) // 64)
        p, d, s, w = pictures.measure(raw.ljust(rows * 64, b"\0"), 64, rows)
        want[i] = (p, d, pytest.approx(s, abs=1e-6), pytest.approx(w, abs=1e-6))
    assert {r.doc_id: tuple(r)[1:] for r in catalog.QUERIES["picture_measures"](spark, data).collect()} == want
