"""Does the absence of one column depend on the content of another?"""

from __future__ import annotations

import math
from dataclasses import dataclass

from limpid.functions.constants import MISSINGNESS_ALPHA
from limpid.functions.special import chi2_p, correlation_p
from limpid.operators.values import SlotSummary


@dataclass
class Association:
    """Missingness of ``column`` is associated with ``correlated_with``."""

    column: str
    correlated_with: str
    test: str
    statistic: float
    p_value: float


def point_biserial(
    n: int, mean: float | None, std_pop: float | None, n_missing: int, mean_missing: float | None
) -> tuple[float, float]:
    """(r, p) between a missing indicator and a numeric column, over rows where the column is present."""
    if not n or not std_pop or n_missing in (0, n) or mean_missing is None or mean is None:
        return math.nan, math.nan
    share = n_missing / n
    r = share * (mean_missing - mean) / (math.sqrt(share * (1 - share)) * std_pop)
    r = max(-1.0, min(1.0, r))
    return r, correlation_p(r, n)


def chi_square(summary: SlotSummary, flag: str) -> tuple[float, float]:
    """(statistic, p) of independence between a missing indicator and a categorical column.

    With n_j rows and m_j missing rows per category, the statistic needs only the sum of m_j^2/n_j.
    Two categories have one degree of freedom and get the continuity correction, recovered from
    the uncorrected statistic and the two group sizes.
    """
    n, m = summary.rows, summary.missing[flag]
    if summary.distinct < 2 or m in (0, n):
        return math.nan, math.nan
    p = m / n
    statistic = max(0.0, (summary.missing_share[flag] - m * p) / (p * (1 - p)))
    df = summary.distinct - 1
    if df == 1:
        inverse = n / (summary.smallest_group * summary.largest_group) / (p * (1 - p))
        deviation = math.sqrt(statistic / inverse)
        deviation -= min(0.5, deviation)
        statistic = deviation * deviation * inverse
    return statistic, chi2_p(statistic, df)


def first_associations(
    columns: list[str], candidates: list[str], tests: dict[tuple[str, str], tuple[str, float, float]],
    alpha: float = MISSINGNESS_ALPHA,
) -> list[Association]:
    """For each candidate the first other column, in table order, with p below ``alpha``."""
    found = []
    for column in candidates:
        for other in columns:
            test = tests.get((column, other))
            if test and not math.isnan(test[2]) and test[2] < alpha:
                found.append(Association(column, other, test[0], test[1], round(test[2], 4)))
                break
    return found
