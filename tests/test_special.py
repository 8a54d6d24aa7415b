"""p-values at points whose values are well known."""

import math

import pytest

from limpid.functions import special as S


@pytest.mark.parametrize("statistic, df, p", [
    (3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05),
    (124.34211340400407, 100, 0.05), (0.0, 3, 1.0)])
def test_chi2(statistic, df, p):
    assert S.chi2_p(statistic, df) == pytest.approx(p, rel=1e-9)


def test_chi2_with_one_category_per_row_is_never_significant():
    assert S.chi2_p(1_000_000, 999_999) > 0.4


@pytest.mark.parametrize("t, df, p", [(2.2281388519649385, 10, 0.05), (12.706204736432095, 1, 0.05), (1.959963984540054, 10**7, 0.05)])
def test_correlation_p_is_the_t_test(t, df, p):
    r = t / math.sqrt(df + t * t)
    assert S.correlation_p(r, df + 2) == pytest.approx(p, rel=1e-5)


def test_correlation_limits():
    assert S.correlation_p(1.0, 10) == 0.0
    assert math.isnan(S.correlation_p(float("nan"), 10))
    assert S.correlation_p(0.0, 10) == pytest.approx(1.0)


def test_correlations_of_very_many_pairs():
    from limpid.functions.special import beta_inc, correlation_p

    for n in (1_000_001, 2_000_000):
        for t in (0.5, 1.96, 4.0):
            r = t / math.sqrt(n - 2 + t * t)
            exact = beta_inc((n - 2) / 2.0, 0.5, (n - 2) / (n - 2 + t * t))
            assert abs(correlation_p(r, n) - exact) < 1e-6
    # the limit is the normal distribution
    r = 1.96 / math.sqrt(1e13)
    assert abs(correlation_p(r, 10 ** 13) - math.erfc(1.96 / math.sqrt(2))) < 1e-9
