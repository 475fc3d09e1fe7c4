import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators.moments import window_deviation


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 70), st.integers(0, 40), st.integers(0, 10_000))
def test_equals_numpy_on_every_window(n, windows, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n) * 10.0 ** rng.integers(-6, 4)
    first = rng.integers(0, n + 1, windows)
    end = np.minimum(first + rng.integers(-3, n + 1, windows), n)
    got = window_deviation(x, first, end)
    for g, a, b in zip(got, first, end):
        want = np.std(x[a:b], ddof=1) if b - a > 1 else np.nan
        assert g == pytest.approx(want, rel=1e-9, abs=1e-300, nan_ok=True)


def test_small_moves_after_a_large_history_keep_their_digits():
    x = np.concatenate([np.full(50_000, 1e6), 1e-6 * np.arange(10)])
    got = window_deviation(x, np.array([50_000]), np.array([50_010]))
    assert got[0] == pytest.approx(np.std(x[50_000:], ddof=1), rel=1e-12)
