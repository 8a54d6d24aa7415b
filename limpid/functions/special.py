"""p-values of the missingness tests, from a handful of sums already reduced by Spark."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    floor = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > floor else floor)
    value = d
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > floor else floor)
            c = 1.0 + term / c
            c = c if abs(c) > floor else floor
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"incomplete beta function not settled for a={a}, b={b}, x={x}")


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x).

    Beyond a = 10^5 by the normal approximation of the cube root (Wilson and Hilferty); its error
    there is below 10^-6.
    """
    if x <= 0.0:
        return 1.0
    if a > 1e5:  # Wilson-Hilferty: the series below would need ~sqrt(a) terms
        z = ((x / a) ** (1.0 / 3.0) - (1.0 - 1.0 / (9.0 * a))) * 3.0 * math.sqrt(a)
        return 0.5 * math.erfc(z / math.sqrt(2.0))
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    floor = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / floor, 1.0 / b
    value = d
    for i in range(1, 100000):
        step = -i * (i - a)
        b += 2.0
        d = step * d + b
        d = 1.0 / (d if abs(d) > floor else floor)
        c = b + step / c
        c = c if abs(c) > floor else floor
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return front * value
    raise ArithmeticError(f"incomplete gamma function not settled for a={a}, x={x}")


def chi2_p(statistic: float, df: int) -> float:
    return gamma_upper(df / 2.0, statistic / 2.0)


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation coefficient from n pairs.

    Beyond a million pairs the beta function would lose digits to cancellation. There Student's t is
    turned into a normal deviate (Wallace's transformation), whose error falls with 1 / n^2.
    """
    if n <= 2 or math.isnan(r):
        return math.nan
    if abs(r) >= 1.0:
        return 0.0
    t2 = r * r * (n - 2) / (1.0 - r * r)
    if n > 1_000_000:
        df = n - 2.0
        z = (8 * df + 1) / (8 * df + 3) * math.sqrt(df * math.log1p(t2 / df))
        return math.erfc(z / math.sqrt(2.0))
    return beta_inc((n - 2) / 2.0, 0.5, (n - 2) / (n - 2 + t2))
