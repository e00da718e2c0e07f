"""The best window of a sweep, found by bounds, against the whole sweep."""

import numpy as np
import pytest

from quillbar.operators import shapes


def walk(rng, n, wild=0.0):
    close = 100 + np.cumsum(rng.normal(size=n))
    opened = np.concatenate([[100.0], close[:-1]])
    out = np.stack([opened, np.maximum(opened, close) + rng.random(n), np.minimum(opened, close) - rng.random(n), close], 1)
    out[rng.random(n) < wild] = np.nan
    return out


def whole_sweep(query, series):
    n = len(query)
    found = [x for q in (query, shapes.flipped(query)) for x in shapes.sweep(q, series, n * 85 // 100, n * 115 // 100, 4)[:1]]
    return max(found, key=lambda x: x[0], default=None)


@pytest.mark.parametrize("seed", range(8))
def test_bounds_find_the_best_window_of_the_sweep(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(shapes, "WINDOWS", 50)
    monkeypatch.setattr(shapes, "WARPED", 8)
    series = walk(rng, 260, 0.01 if seed % 2 else 0.0)
    query = [walk(rng, 40), series[100:140] * 1.5 + 3, shapes.flipped(series[60:99]), np.repeat(walk(rng, 10), 4, axis=0)][seed % 4]
    if not np.isfinite(query).all():
        query = walk(rng, 30)
    if seed == 7:
        series = np.concatenate([series, series])  # equal windows
    got, want = shapes.best_window(query, series), whole_sweep(query, series)
    assert (got is None) == (want is None)
    if want:
        assert got[0] == pytest.approx(want[0], abs=1e-12) and (got[1:] == want[1:] or seed == 7)


def test_windows_are_normalised_together():
    rng = np.random.default_rng(5)
    series = walk(rng, 200, 0.01)
    series[50:90] = 7.0  # flat
    for n in (16, 33, 64):
        starts, found = shapes.normalize_all(series, n)
        want = []
        for start in range(len(series) - n + 1):
            try:
                want.append((start, shapes.normalize(series[start : start + n])))
            except ValueError:
                continue
        assert starts.tolist() == [s for s, _ in want]
        assert np.allclose(found, np.array([x for _, x in want]))
    assert len(shapes.normalize_all(series, 15)[0]) == 0 and len(shapes.normalize_all(series[:10], 16)[0]) == 0


def test_bounds_are_above_scores_and_spare_warps():
    rng = np.random.default_rng(6)
    series = walk(rng, 1500)
    q = shapes.normalize(walk(rng, 60))
    _, many = shapes.normalize_all(series, 60)
    assert (shapes._most_scores(q, many) + 1e-9 >= shapes.warped_all(q, many)).all()
    counted = []
    assert shapes.best_window(series[700:760], series, counted)[1:] != (0, 0)
    seen, done = counted[0]
    assert done < seen / 10
