"""Quality rules: text statistics, and robust multivariate outliers by minimum covariance determinant per language and source.

The estimate is the regularised minimum covariance determinant: covariances are drawn to a fixed diagonal, since most texts hold no symbol
at all and a plain one would be singular. Each group has several deterministic starts, each is concentrated until its determinant stops
falling, and the least determinant is kept. Every step is two aggregates over all rows, combined before their shuffles; quantiles come
from counts in narrow bins.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, map_batches, materialize, pick

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The statistic vector: log of the mean word length, and square roots of the shares of symbols, capitals and exclamation marks,
#: repeated lines, repeated words. SPREAD is the least standard deviation that an estimate may have in each: the diagonal drawn to.
STATS, SPREAD = ("x0", "x1", "x2", "x3", "x4"), (0.08, 0.05, 0.08, 0.15, 0.12)
#: Share of rows whose covariance determinant is made small; rows by which a source is drawn to its language, and that to all; probability
#: that a clean vector lies beyond the cutoff.
KEEP, PRIOR_ROWS, TAIL = 0.75, 200, 1e-8
#: Starts of a group; fall of a determinant's logarithm that counts as one; concentration steps at most; widths of bins of statistics and of
#: logarithms of distances.
STARTS, FALL, MOST_STEPS, BIN, LOG_BIN = 3, 1e-3, 20, 0.002, 0.02

_WORD = re.compile(WORD)
_BLANK = " \t\n\r\x0b\x0c"


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = _WORD.findall(text)
    n = len(words)
    symbols = sum(map(text.count, "#*$%&|<>"))
    duplicates = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if x.strip(_BLANK)]
        duplicates = len(lines) - len(set(lines))
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        often, last = Counter(windows), -1
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, last)
                last = i + 3
    return n, sum(map(len, words)), symbols, duplicates, repeated


def _statistics(text: str, n: int, chars: int, symbols: int, duplicates: int, repeated: int) -> tuple[float, ...]:
    if not n:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    raw = np.bincount(np.frombuffer(text.encode(), "u1"), minlength=256)
    loud = int(raw[65:91].sum() + raw[33])
    lines = text.count("\n") + 1
    return math.log(chars / n), math.sqrt(symbols / chars), math.sqrt(loud / chars), math.sqrt(duplicates / lines), math.sqrt(repeated / n)


def text_statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, COUNTS, base_failed, STATS, and the columns to carry; one row for each row of docs."""
    names = list(dict.fromkeys(["doc_id", "text", "lang", "source", *carry]))
    source = pick(docs, *names)
    kept = [c for c in names if c != "text" or "text" in carry]
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept) + ", " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, " + ", ".join(f"{c} double" for c in STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                counts = text_counts(text)
                n, repeated = counts[0], counts[4]
                rows.append((*counts, n < 50 or 100 * repeated > 50 * n, *_statistics(text, *counts)))
            columns = list(zip(*rows, strict=True)) or [()] * 11
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(names.index(c)) for c in kept] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*kept, *COUNTS, "base_failed", *STATS])

    return map_batches(source, run, schema)


def chi2_cdf(x: float, p: int) -> float:
    """The chi-square distribution function, by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= z / k
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return high


def _matrix(upper: np.ndarray) -> np.ndarray:
    p = len(STATS)
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = upper
    return out + np.triu(out, 1).T


def _regular(cov: np.ndarray) -> np.ndarray:
    return cov + np.diag(np.square(SPREAD))


def concentrated(n: int, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the nearest KEEP of a group's rows, made consistent for normal rows and drawn to the diagonal."""
    p = len(STATS)
    factor = KEEP / chi2_cdf(chi2_quantile(KEEP, p), p + 2)
    mean = np.asarray(sums) / n
    return mean, _regular((_matrix(np.asarray(products) / n) - np.outer(mean, mean)) * factor)


def first_estimates(n: int, sums: np.ndarray, products: np.ndarray, signs: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The starts: medians with deviations; all rows' mean and covariance; medians with the covariance of directions from them."""
    p = len(STATS)
    middle, scale = np.asarray(middle), np.sqrt(np.square(np.asarray(spread) * 1.4826) + np.square(SPREAD))
    mean = np.asarray(sums) / n
    directions = _matrix(np.asarray(signs) / n) * p * np.outer(scale, scale)
    return [(middle, np.diag(scale**2)), (mean, _regular(_matrix(np.asarray(products) / n) - np.outer(mean, mean))), (middle, _regular(directions))]


def mixture(own: tuple[int, np.ndarray, np.ndarray], wider: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A group's estimate drawn to that of a wider one as by PRIOR_ROWS rows of it: mean and covariance of the mixture of both."""
    n, mean, cov = own
    w, apart = n / (n + PRIOR_ROWS), mean - wider[0]
    return w * mean + (1 - w) * wider[0], w * cov + (1 - w) * wider[1] + w * (1 - w) * np.outer(apart, apart)


_ESTIMATE = "mean array<double>, cov array<double>, inverse array<double>, logdet double"
_ESTIMATE_ARROW = pa.struct([("mean", pa.list_(pa.float64())), ("cov", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64())), ("logdet", pa.float64())])


def _estimate(mean: np.ndarray, cov: np.ndarray) -> dict:
    return {"mean": mean.tolist(), "cov": cov.ravel().tolist(), "inverse": np.linalg.inv(cov).ravel().tolist(), "logdet": float(np.linalg.slogdet(cov)[1])}


_FITS = f"array<struct<{_ESTIMATE.replace(' ', ':').replace(',:', ',')}>>"


def _fits(rows: DataFrame, run: Callable[[dict], list[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """g and fits (an estimate for each start) from a row of sums for each group."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[_estimate(*e) for e in run(r)] for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("g")), pa.array(out, pa.list_(_ESTIMATE_ARROW))], names=["g", "fits"])

    return map_batches(rows, all_of, f"g string, fits {_FITS}")


def quantile_place(counts: np.ndarray, share: float) -> int:
    """The place of the bin, of ascending bins with these counts, up to which at least the share of all lies."""
    upto = np.cumsum(counts)
    return int(np.searchsorted(upto, share * upto[-1]))


def _medians(values: DataFrame) -> DataFrame:
    """g, middle (array over the statistics) of values: g, v (array). A task holds a group's counts by bin, which its rows do not make more."""
    counts = values.select("g", F.posexplode(F.transform("v", lambda x: F.floor(x / BIN))).alias("i", "bin")).groupBy("g", "i", "bin").agg(F.count("*").alias("n"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("i", "ascending"), ("bin", "ascending")])
        i, at, n = (table.column(c).to_numpy() for c in ("i", "bin", "n"))
        middle = [(float(at[i == k][quantile_place(n[i == k], 0.5)]) + 0.5) * BIN for k in range(len(STATS))]
        return pa.table({"g": table.column("g").slice(0, 1), "middle": pa.array([middle], pa.list_(pa.float64()))})

    return counts.groupBy("g").applyInArrow(run, "g string, middle array<double>")


def _distance(mean: Column, inverse: Column) -> Column:
    p = len(STATS)
    centred = [F.col(c) - mean[i] for i, c in enumerate(STATS)]
    return sum((centred[i] * centred[j] * inverse[i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))


def _moments() -> list[Column]:
    p = len(STATS)
    return [F.count("*").alias("n"), F.array(*[F.sum(c) for c in STATS]).alias("sums"), F.array(*[F.sum(F.col(STATS[i]) * F.col(STATS[j])) for i in range(p) for j in range(i, p)]).alias("products")]


def _nearest(table: pa.Table) -> pa.Table:
    """A group's sums by start and bin of distance (as many as there are bins, not rows) -> each start's next estimate."""
    table = table.sort_by([("start", "ascending"), ("bin", "ascending")])
    start, n = table.column("start").to_numpy(), table.column("n").to_numpy()
    sums, products = (np.array(table.column(c).to_pylist()) for c in ("sums", "products"))
    out = []
    for s in range(STARTS):
        near = np.flatnonzero(start == s)
        near = near[: quantile_place(n[near], KEEP) + 1]
        out.append(_estimate(*concentrated(int(n[near].sum()), sums[near].sum(axis=0), products[near].sum(axis=0))))
    return pa.table({"g": table.column("g").slice(0, 1), "after": pa.array([out], pa.list_(_ESTIMATE_ARROW))})


def minimum_determinants(cases: DataFrame) -> DataFrame:
    """g, n, mean, cov of each group of cases (g and STATS): of its starts' ends the one with the least determinant."""
    p = len(STATS)
    middle = materialize(_medians(cases.select("g", F.array(*STATS).alias("v"))), "medians")
    beside = cases.join(middle, "g").select("g", F.array(*[F.abs(F.col(c) - F.col("middle")[i]) for i, c in enumerate(STATS)]).alias("v"))
    scales = materialize(middle.join(_medians(beside).withColumnRenamed("middle", "spread"), "g"), "scales")
    with_scales = cases.join(scales, "g")
    z = [(F.col(c) - F.col("middle")[i]) / F.sqrt(F.pow(F.col("spread")[i] * 1.4826, 2) + SPREAD[i] ** 2) for i, c in enumerate(STATS)]
    with_scales = with_scales.select("g", *STATS, F.array(*z).alias("z")).withColumn("r2", sum((F.col("z")[i] * F.col("z")[i] for i in range(p)), F.lit(0.0)))
    signs = [F.sum(F.when(F.col("r2") > 0, F.col("z")[i] * F.col("z")[j] / F.col("r2")).otherwise(0.0)) for i in range(p) for j in range(i, p)]
    sums = with_scales.groupBy("g").agg(*_moments(), F.array(*signs).alias("signs")).join(scales, "g")
    fits = materialize(_fits(sums, lambda r: first_estimates(r["n"], r["sums"], r["products"], r["signs"], r["middle"], r["spread"])), "fits")
    done, todo = [], fits.select("g", "fits", F.array_repeat(F.lit(True), STARTS).alias("going"))
    for _ in range(MOST_STEPS):
        each = F.array(*[_distance(F.col("fits")[s]["mean"], F.col("fits")[s]["inverse"]) for s in range(STARTS)])
        bins = F.transform(each, lambda d: F.floor(F.log(F.greatest(d, F.lit(1e-9))) / LOG_BIN))
        apart = cases.join(todo, "g").select("g", *STATS, F.posexplode(bins).alias("start", "bin"))
        after = apart.groupBy("g", "start", "bin").agg(*_moments()).groupBy("g").applyInArrow(_nearest, f"g string, after {_FITS}")
        # a start whose determinant no longer falls stays as it is
        falls = F.zip_with("fits", "after", lambda a, b: a["logdet"] - b["logdet"] > FALL)
        going = F.zip_with("going", falls, lambda a, b: a & b)
        moved = todo.join(after, "g").withColumn("going", going)
        chosen = F.transform("fits", lambda x, i: F.when(F.get("going", i), F.get("after", i)).otherwise(x))
        moved = materialize(moved.select("g", chosen.alias("fits"), "going"), "fits")
        any_going = F.exists("going", lambda x: x)
        done.append(moved.where(~any_going).select("g", "fits"))
        todo = moved.where(any_going)
        if not todo.limit(1).count():
            break
    fits = functools.reduce(DataFrame.union, done, todo.select("g", "fits"))
    best = F.array_min(F.transform("fits", lambda x, i: F.struct(x["logdet"].alias("logdet"), i.alias("i"), x["mean"].alias("mean"), x["cov"].alias("cov"))))
    totals = cases.groupBy("g").agg(F.count("*").alias("n"))
    return materialize(fits.select("g", best.alias("b")).join(totals, "g").select("g", "n", "b.mean", "b.cov"), "estimates")


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Estimates of a pair, its language and all -> the pair's mean and inverse covariance, each level drawn to the wider one."""
    p = len(STATS)
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            own, lang, whole = ((r[k]["n"], np.array(r[k]["mean"]), np.array(r[k]["cov"]).reshape(p, p)) for k in ("own", "wider", "whole"))
            mean, cov = mixture(own, mixture(lang, whole[1:]))
            out.append((mean.tolist(), np.linalg.inv(cov).ravel().tolist()))
        columns = list(zip(*out, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.list_(pa.float64())) for c in columns]], names=["pair", "mean", "inverse"])


def quality_rules(docs: DataFrame, carry: tuple[str, ...] = (), tail: float = TAIL) -> DataFrame:
    """Per document: doc_id, COUNTS, base_failed, kept, distance, and the columns to carry.

    base_failed rejects texts of under 50 words and those with more than half of their words in repeated 3-word windows. Over all others,
    each language and source, each language, and all rows get a minimum-covariance-determinant estimate of their statistic vectors. A
    pair's is drawn to its language's as by PRIOR_ROWS rows of it, and that to the one of all: a group counts by its rows, and no number of
    them switches the rule. A vector whose squared Mahalanobis distance exceeds the chi-square quantile of `tail` is rejected.
    A null text has no words and fails; a null language or source is a value of its own; repeated rows count each; ties at a quantile are
    all within; an empty table gives none. A text is held with its words, a batch at a time. Other columns are ignored, whatever their names.
    """
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    pair = F.concat_ws("\x1f", F.lit("pair"), part("lang"), part("source"))
    wider = F.concat_ws("\x1f", F.lit("lang"), part("lang"))
    rows = materialize(text_statistics(docs, carry).select("*", pair.alias("pair_"), wider.alias("wider_")), "statistics")
    fit_on = rows.where("not base_failed")
    cases = fit_on.select(F.explode(F.array("pair_", "wider_", F.lit("all"))).alias("g"), *STATS)
    found = minimum_determinants(cases)
    estimate = lambda name: F.struct("n", "mean", "cov").alias(name)
    pairs = fit_on.groupBy("pair_", "wider_").agg(F.lit("all").alias("all_"))
    pairs = pairs.join(found.select(F.col("g").alias("pair_"), estimate("own")), "pair_").join(found.select(F.col("g").alias("wider_"), estimate("wider")), "wider_")
    pairs = pairs.join(found.select(F.col("g").alias("all_"), estimate("whole")), "all_").select("pair_", "own", "wider", "whole")
    fits = materialize(map_batches(pairs, _drawn, "pair string, mean array<double>, inverse array<double>"), "drawn")
    scored = rows.join(fits, F.col("pair_") == F.col("pair"), "left").withColumn("distance", _distance(F.col("mean"), F.col("inverse")))
    far = F.col("distance") > chi2_quantile(1 - tail, len(STATS))
    kept = ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))
    return scored.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "distance", *[c for c in carry if c != "doc_id"])
