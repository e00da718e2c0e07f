"""Greedy suppression in blocks of time, and joins by slots, against plain versions."""

import datetime as dt

import numpy as np
import pytest

from quillbar.operators import relational as R

CONFLICTS = {
    "half": (R.nms_half_width, lambda a, b, c, d: abs(a - c) < max(b - a, d - c) / 2),
    "overlap": (R.nms_overlap, lambda a, b, c, d: min(b, d) - max(a, c) > 0.5 * min(b - a, d - c)),
}


def greedy(rows, conflict):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[1])):
        if not any(k[0] == r[0] and conflict(r[3], r[4], k[3], k[4]) for k in kept):
            kept.append(r)
    return sorted(kept, key=str)


@pytest.mark.parametrize("kind", CONFLICTS)
@pytest.mark.parametrize("scores", ["random", "rising", "falling", "equal"])
def test_blocks_of_time_decide_like_one_pass(spark, monkeypatch, kind, scores):
    """Sliding windows whose stride is below their size bridge all time: several blocks and rounds, chains of any direction."""
    monkeypatch.setattr(R, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    rows = []
    for key, n, size in (("a", 300, 16), ("b", 60, 64), (None, 50, 8)):
        for i in range(n):
            score = {"random": float(rng.integers(0, 1000)), "rising": float(i), "falling": float(-i), "equal": 1.0}[scores]
            rows.append((key, len(rows), score, 3 * i, 3 * i + size + (0 if scores == "equal" else int(rng.integers(0, 5)))))
    df = spark.createDataFrame(rows, "k string, id long, score double, start long, end long").repartition(3)
    make, conflict = CONFLICTS[kind]
    assert sorted(map(tuple, make(df, ["k"]).collect()), key=str) == greedy(rows, conflict)


def test_a_block_keeps_what_depends_on_others_open():
    """Rows near the edge of a block are not kept before their neighbours are known, but may be dropped."""
    start, end = np.array([50, 52, 98, 10]), np.array([60, 62, 108, 20])
    inside = np.array([True, True, False, True])
    assert R._decided(start, end, inside, CONFLICTS["half"][1]).tolist() == [1, -1, 0, 1]
    near = np.array([False, True, True, True])
    assert R._decided(start, end, near, CONFLICTS["half"][1]).tolist() == [0, 0, 1, 1]


def test_points_meet_spans_of_any_length(spark):
    rng = np.random.default_rng(7)
    t0 = dt.datetime(2024, 1, 1)
    points = [(i, "ab"[i % 2], t0 + dt.timedelta(seconds=int(rng.integers(0, 5 * 86400)))) for i in range(300)]
    for longest in (30, 7200, 3 * 86400):
        spans = []
        for i in range(60):
            start = t0 + dt.timedelta(seconds=int(rng.integers(0, 5 * 86400)))
            spans.append((i, "ab"[i % 2], start, start + dt.timedelta(seconds=int(rng.integers(-5, longest)))))
        spans += [(99, "a", points[0][2], points[0][2]), (98, "b", None, t0)]
        p = spark.createDataFrame(points, "id long, k string, at timestamp_ntz")
        s = spark.createDataFrame(spans, "span long, k string, start timestamp_ntz, end timestamp_ntz")
        got = sorted((r.id, r.span) for r in R.interval_join(p, s, ["k"], "at").collect())
        assert got == sorted((i, j) for i, k, at in points for j, x, a, b in spans if k == x and a is not None and a <= at <= b)
    assert R.interval_join(p, s.limit(0), ["k"], "at").count() == 0
