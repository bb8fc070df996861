"""Sharpe ratio and precision algebra as column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normal import norm_cdf

EULER_GAMMA = 0.5772156649015329
_NORMAL = NormalDist()


def probabilistic_sharpe_ratio(observed: Column, benchmark: Column, n: Column, skew: Column, kurtosis: Column) -> Column:
    """Probability that the true Sharpe ratio exceeds the benchmark; `kurtosis` is not the excess."""
    return norm_cdf((observed - benchmark) * F.sqrt(n - 1) / F.sqrt(1 - skew * observed + (kurtosis - 1) / 4 * observed * observed))


def expected_max_sharpe(std: Column, n_trials: Column | int) -> Column:
    """Expected largest Sharpe ratio of independent trials without skill."""
    if isinstance(n_trials, int):
        a, b = _NORMAL.inv_cdf(1 - 1 / n_trials), _NORMAL.inv_cdf(1 - 1 / (n_trials * 2.718281828459045))
        return std * ((1 - EULER_GAMMA) * a + EULER_GAMMA * b)
    raise ValueError("the number of trials has to be known when the plan is made")


def minimum_track_record_length(observed: Column, benchmark: Column, skew: Column, kurtosis: Column, alpha: float = 0.05) -> Column:
    z = _NORMAL.inv_cdf(1 - alpha)
    return 1 + (1 - skew * observed + (kurtosis - 1) / 4 * observed * observed) * F.pow(z / (observed - benchmark), 2)


def sharpe_symmetric(precision: Column, frequency: Column) -> Column:
    """Sharpe ratio of bets that win or lose the same."""
    return (2 * precision - 1) / (2 * F.sqrt(precision * (1 - precision))) * F.sqrt(frequency)


def implied_precision_symmetric(target: Column, frequency: Column) -> Column:
    return 0.5 * (1 + target / F.sqrt(target * target + frequency))


def implied_frequency_symmetric(precision: Column, target: Column) -> Column:
    return 4 * target * target * precision * (1 - precision) / F.pow(2 * precision - 1, 2)


def sharpe_asymmetric(precision: Column, frequency: Column, win: Column, loss: Column) -> Column:
    """`win` and `loss` are signed payouts."""
    return ((win - loss) * precision + loss) / (F.abs(win - loss) * F.sqrt(precision * (1 - precision))) * F.sqrt(frequency)


def implied_precision_asymmetric(target: Column, frequency: Column, win: Column, loss: Column) -> Column:
    """Smallest precision in [0, 1] that reaches the target; null if there is none."""
    d = win - loss
    a = (frequency + target * target) * d * d
    b = (2 * frequency * loss - target * target * d) * d
    c = frequency * loss * loss
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    roots = F.array((-b - root) / (2 * a), (-b + root) / (2 * a))

    def fits(p: Column) -> Column:
        mean = d * p + loss
        return (p >= 0) & (p <= 1) & ((mean >= 0) == (target >= 0))

    return F.when(b * b - 4 * a * c >= 0, F.array_min(F.filter(roots, fits)))


def implied_frequency_asymmetric(precision: Column, target: Column, win: Column, loss: Column) -> Column:
    d = win - loss
    return target * target * d * d * precision * (1 - precision) / F.pow(d * precision + loss, 2)


def bagging_ensemble_variance(variance: Column, correlation: Column, n_estimators: Column) -> Column:
    return variance * (correlation + (1 - correlation) / n_estimators)


def recommend_bagging_vs_boosting(accuracy: Column, correlation: Column, redundancy: Column) -> Column:
    """Boosting for weak or redundant learners, bagging otherwise."""
    return F.when((accuracy < 0.55) | (correlation >= 0.75) | (redundancy >= 0.70), "boosting").otherwise("bagging")
