"""Optimal segmentation of timed words, and grouping where there are none."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params
from .words import boundaries

SCHEMA = "project {kind}, index int, start double, end double, duration double, narration string, words int, kind string"


def solve(times: np.ndarray, penalty: np.ndarray, params: Params, last_min: float | None) -> list[int] | None:
    """Cuts (from 0 to the number of words) of least cost, or None if no cutting keeps within the bounds.

    times[k] is the cut before word k, the last one the end. A segment costs its end's penalty and the weighted square of its relative
    deviation from the target; of equally good starts the latest wins. last_min loosens the least length of the last segment alone.
    Starts further back than the longest segment are never tried, so the work is words times words in a segment.
    """
    n = len(times) - 1
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = 0.0
    low = 0
    for k in range(1, n + 1):
        while times[k] - times[low] > params.max_s:
            low += 1
        span = times[k] - times[low:k]
        least = last_min if last_min is not None and k == n else params.min_s
        x = (span - params.target_s) / params.target_s
        cost = np.where(span >= least, best[low:k] + (penalty[k] + params.duration_weight * (x * x)), np.inf)
        if len(cost):
            j = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[j] < np.inf:
                best[k], back[k] = cost[j], low + j
    if not np.isfinite(best[n]):
        return None
    cuts = [n]
    while cuts[-1]:
        cuts.append(int(back[cuts[-1]]))
    return cuts[::-1]


def _cuts(times: np.ndarray, penalty: np.ndarray, params: Params) -> list[int]:
    n = len(times) - 1
    if times[n] - times[0] <= params.max_s:
        return [0, n]
    return solve(times, penalty, params, None) or solve(times, penalty, params, params.last_min_s) or [0, n]


def optimal_segments(words: DataFrame, order: list[str], params: Params = DEFAULTS) -> DataFrame:
    """project, words with start_ms and end_ms -> project, index (from 1), start, end, duration, narration, words, kind of its end.

    Boundaries are native; the dynamic programme runs once for each project, whose words are a narration's, not a corpus's.
    """
    cut = boundaries(words, order, params).select("project", "n", "word", "start_ms", "end_ms", "kind", "penalty", "cut_ms")
    kind = words.schema["project"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        times = np.append(rows.cut_ms.to_numpy(), float(rows.end_ms.iloc[-1])) / 1000.0
        penalty = np.append(rows.penalty.to_numpy(), params.penalties["sentence"])
        kinds, text = [*rows.kind, "sentence"], rows.word.tolist()
        cuts = _cuts(times, penalty, params)
        parts = list(zip(cuts[:-1], cuts[1:]))
        return pd.DataFrame(
            {
                "project": rows.project.iloc[0], "index": range(1, len(parts) + 1), "start": [times[i] for i, _ in parts], "end": [times[j] for _, j in parts],
                "duration": [times[j] - times[i] for i, j in parts], "narration": [" ".join(text[i:j]) for i, j in parts], "words": [j - i for i, j in parts], "kind": [kinds[j] for _, j in parts],
            }
        )

    return cut.groupBy("project").applyInPandas(run, SCHEMA.format(kind=kind))


def fallback_segments(parts: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """project, pos, start, end, text (no words) -> greedy buckets, closed before a part that would make one longer than the bound.

    A bucket then starts where the one before it ended; its duration stays that of its own parts.
    """
    kind = parts.schema["project"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, bucket = [], []
        for r in rows.sort_values("pos").itertuples(index=False):
            if bucket and r.end - bucket[0].start > params.max_s:
                out.append(bucket)
                bucket = []
            bucket.append(r)
        out.append(bucket)
        ends = [b[-1].end for b in out]
        return pd.DataFrame(
            {
                "project": rows.project.iloc[0], "index": range(1, len(out) + 1), "start": [out[0][0].start, *ends[:-1]], "end": ends,
                "duration": [b[-1].end - b[0].start for b in out], "narration": [" ".join(x.text.strip() for x in b) for b in out],
            }
        )

    return parts.groupBy("project").applyInPandas(run, f"project {kind}, index int, start double, end double, duration double, narration string")


def with_batches(segments: DataFrame, size: int = DEFAULTS.batch_size) -> DataFrame:
    """Adds the number of the batch that a segment is analysed in: chunks of `size` in order."""
    return segments.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("project").orderBy("index")) - 1) / size).cast("int"))


def map_batches(segments: DataFrame, analyse, schema: str, size: int = DEFAULTS.batch_size) -> DataFrame:
    """One call of analyse(pandas frame) for each batch; a batch whose call fails comes back with status degraded and a note.

    schema must hold status string and notes array<string>.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="batch")
        try:
            return analyse(rows)
        except Exception as e:  # a failed call spoils its own batch alone
            return rows.assign(status="degraded", notes=[[f"analysis failed: {type(e).__name__}"]] * len(rows))

    return with_batches(segments, size).groupBy("project", "batch").applyInPandas(run, schema)
