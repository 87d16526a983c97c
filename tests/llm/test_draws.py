"""Exact hypergeometric draws of any size, and shard counts from them."""

import math

import numpy as np
import pytest

from tickertide.llm import mixing


@pytest.mark.parametrize(("good", "bad", "draws"), [(7, 30, 11), (40, 60, 50), (500, 5000, 1200)])
def test_draws_follow_the_distribution(good, bad, draws):
    rng = np.random.default_rng(3)
    n = 6000
    got = np.bincount([mixing._by_ratio_of_uniforms(rng, good, bad, draws) for _ in range(n)], minlength=good + 1)
    p = np.array(
        [math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) if k <= draws else 0.0 for k in range(good + 1)]
    )
    seen = p * n >= 5
    chi = ((got[seen] - p[seen] * n) ** 2 / (p[seen] * n)).sum()
    assert chi < seen.sum() + 5 * (2 * seen.sum()) ** 0.5 and got[p == 0].sum() == 0


@pytest.mark.parametrize(
    ("good", "bad", "draws"),
    [(10**9, 10**9, 10**9), (3 * 10**11, 7 * 10**9, 2 * 10**11), (5, 10**12, 10**11), (10**12, 3, 10**12), (10**10, 0, 10**9)],
)
def test_large_draws(good, bad, draws):
    rng = np.random.default_rng(8)
    got = [mixing._hypergeometric(rng, good, bad, draws) for _ in range(300)]
    n = good + bad
    mean, var = draws * good / n, draws * (good / n) * (bad / n) * (n - draws) / (n - 1)
    assert all(max(0, draws - bad) <= k <= min(good, draws) for k in got)
    assert abs(float(np.mean([k - mean for k in got]))) <= 5 * (var / 300) ** 0.5 + 1e-3
    if var > 1:
        assert 0.6 < float(np.mean([(k - mean) ** 2 for k in got])) / var < 1.5


def test_log_factorials_meet():
    for n in (999, 1000, 1001, 10**6):
        assert abs(float(mixing._log_factorial(n)) - math.lgamma(n + 1)) < 1e-9 * math.lgamma(n + 1)
    step = mixing._log_factorial(1000) - mixing._log_factorial(999)
    assert abs(float(step) - math.log(1000)) < 1e-12
