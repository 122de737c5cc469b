"""Segmentation: bounds, contiguity, ties, the published figures of the synthetic narration."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from montage.operators import segment, words
from montage.params import DEFAULTS


def _words(spark, spans, text=None):
    rows = [("p", 0, i, (text or {}).get(i, f"w{i}"), int(a), int(b)) for i, (a, b) in enumerate(spans)]
    return spark.createDataFrame(rows, "project string, part int, pos int, word string, start_ms long, end_ms long")


def _even(n, step=400, long=300):
    return [(i * step, i * step + long) for i in range(n)]


def test_segments_are_contiguous_and_in_bounds(spark):
    marks = {i: f"w{i}." for i in range(6, 200, 7)}
    out = sorted(segment.optimal_segments(_words(spark, _even(200), marks), ["part", "pos"]).collect(), key=lambda r: r["index"])
    assert all(a.end == b.start for a, b in itertools.pairwise(out))
    assert all(DEFAULTS.min_s <= r.duration <= DEFAULTS.max_s for r in out)
    assert sum(r.words for r in out) == 200
    assert " ".join(r.narration for r in out).split()[0] == "w0"


@pytest.mark.parametrize(("n", "parts"), [(22, 1), (27, 2), (3, 1)])
def test_short_and_awkward_narrations(spark, n, parts):
    assert segment.optimal_segments(_words(spark, _even(n)), ["part", "pos"]).count() == parts


def test_solver_equals_exhaustive_search():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(4, 11))
        times = np.cumsum(np.append(0.0, rng.uniform(1.0, 4.5, n)))
        penalty = rng.choice([0.0, 0.35, 0.7, 1.2], n + 1)
        best = None
        for k in range(n):
            for inner in itertools.combinations(range(1, n), k):
                cuts = [0, *inner, n]
                spans = np.diff(times[cuts])
                if (spans >= 6).all() and (spans <= 10).all():
                    cost = sum(penalty[c] + 0.35 * ((s - 8) / 8) ** 2 for c, s in zip(cuts[1:], spans))
                    best = cost if best is None else min(best, cost)
        cuts = segment.solve(times, penalty, DEFAULTS, None)
        assert (cuts is None) == (best is None)
        if cuts:
            spans = np.diff(times[cuts])
            assert sum(penalty[c] + 0.35 * ((s - 8) / 8) ** 2 for c, s in zip(cuts[1:], spans)) == pytest.approx(best)


def test_monotonic_repair(spark):
    broken = _words(spark, [(0, 500), (300, 200), (100, 900), (1000, 1200)])
    out = sorted(words.enforce_monotonic(broken, ["part", "pos"]).collect(), key=lambda r: r.pos)
    cursor, want = 0, []
    for a, b in [(0, 500), (300, 200), (100, 900), (1000, 1200)]:
        a = max(a, cursor)
        b = max(b, a)
        cursor = b
        want.append((a, b))
    assert [(r.start_ms, r.end_ms) for r in out] == want


def test_partitions_do_not_matter(spark):
    w = _words(spark, _even(150))
    assert sorted(segment.optimal_segments(w, ["part", "pos"]).collect()) == sorted(segment.optimal_segments(w.repartition(7), ["part", "pos"]).collect())


def test_batches_fail_alone(spark):
    seg = spark.createDataFrame([("p", i, "ok", []) for i in range(1, 46)], "project string, index int, status string, notes array<string>")

    def analyse(rows):
        if rows["index"].min() == 21:
            raise ValueError("no answer")
        return rows

    out = segment.map_batches(seg, analyse, seg.schema).collect()
    assert {r["index"] for r in out if r.status == "degraded"} == set(range(21, 41))
    assert len(out) == 45
