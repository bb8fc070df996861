"""Bet sizing as column expressions. Every function takes columns (or numbers) and returns a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normal import norm_cdf

Value = Column | float


def _c(v: Value) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def get_signal(prob: Column, num_classes: int, side: Column | None = None) -> Column:
    """2 * Phi((p - 1/K) / sqrt(p (1 - p))) - 1, times the side; p of 0 or 1 gives -1 or 1."""
    if num_classes < 2:
        raise ValueError("num_classes must be at least 2")
    z = F.try_divide(prob - 1 / num_classes, F.sqrt(prob * (1 - prob)))
    signal = F.when(prob >= 1, 1.0).when(prob <= 0, -1.0).otherwise(2 * norm_cdf(z) - 1)
    return signal if side is None else side * signal


def discrete_signal(signal: Column, step_size: float) -> Column:
    """Rounded half away from zero to multiples of the step, within [-1, 1]; a step of 0 or less changes nothing."""
    if step_size <= 0:
        return signal
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(signal / step_size) * step_size))


def bet_size(w: Value, price_div: Value, func: str = "sigmoid") -> Column:
    w, x = _c(w), _c(price_div)
    if func == "sigmoid":
        return x / F.sqrt(w + x * x)
    if func == "power":
        inside = F.abs(x) <= 1
        size = F.when(x == 0, 0.0).otherwise(F.signum(x) * F.pow(F.abs(x), w))
        return F.when(inside, size).otherwise(F.raise_error(F.lit("price divergence must be within [-1, 1]")).cast("double"))
    raise ValueError(f"unknown bet sizing function {func!r}")


def inv_price(forecast: Value, w: Value, m: Value, func: str = "sigmoid") -> Column:
    """Price at which the bet size is m."""
    f, w, m = _c(forecast), _c(w), _c(m)
    if func == "sigmoid":
        return f - m * F.sqrt(w / (1 - m * m))
    if func == "power":
        return f - F.when(m == 0, 0.0).otherwise(F.signum(m) * F.pow(F.abs(m), 1 / w))
    raise ValueError(f"unknown bet sizing function {func!r}")


def get_w(price_div: Value, m: Value, func: str = "sigmoid") -> Column:
    """Width parameter for which the divergence gives the bet size m."""
    x, m = _c(price_div), _c(m)
    if func == "sigmoid":
        return x * x * (1 / (m * m) - 1)
    if func == "power":
        return F.greatest(F.lit(0.0), F.ln(m / F.signum(x)) / F.ln(F.abs(x)))
    raise ValueError(f"unknown bet sizing function {func!r}")


def get_target_pos(w: Value, forecast: Value, market: Value, max_pos: Value, func: str = "sigmoid") -> Column:
    """Bet size times the largest position, cut towards zero."""
    return (bet_size(w, _c(forecast) - _c(market), func) * _c(max_pos)).cast("long").cast("double")


def limit_price(target: Value, pos: Value, forecast: Value, w: Value, max_pos: Value, func: str = "sigmoid") -> Column:
    """Mean inverse price over the units from the current to the target position; null when they are equal."""
    t, p = _c(target), _c(pos)
    sgn = F.when(t >= p, 1).otherwise(-1)
    first, last = F.abs(p + sgn).cast("long"), F.abs(t).cast("long")
    units = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(units, F.lit(0.0), lambda acc, j: acc + inv_price(forecast, w, j / _c(max_pos), func))
    return F.when(t != p, total / F.abs(t - p))


def dynamic_width(price_div: float = 10.0, m: float = 0.95) -> float:
    """The width that the dynamic bet size uses."""
    return price_div**2 * (m**-2 - 1)


def bet_size_dynamic(pos: Column, max_pos: Column, market: Column, forecast: Column) -> tuple[Column, Column, Column]:
    """(bet size, target position, limit price) with the sigmoid of width (10, 0.95)."""
    w = dynamic_width()
    target = get_target_pos(w, forecast, market, max_pos)
    return bet_size(w, forecast - market), target, limit_price(target, pos, forecast, w, max_pos)


def cdf_mixture(mu1: Value, mu2: Value, sigma1: Value, sigma2: Value, p1: Value, x: Value) -> Column:
    """Distribution function of two normals; sigmas are at least 1e-8."""
    parts = [norm_cdf((_c(x) - _c(m)) / F.greatest(_c(s), F.lit(1e-8))) for m, s in ((mu1, sigma1), (mu2, sigma2))]
    return _c(p1) * parts[0] + (1 - _c(p1)) * parts[1]


def single_bet_size_mixed(c: Column, fit: tuple[float, float, float, float, float]) -> Column:
    """Bet size of the signed concurrency c under a fitted mixture (mu1, mu2, sigma1, sigma2, p1)."""
    at, zero = cdf_mixture(*fit, c), cdf_mixture(*fit, 0.0)
    return F.when(c >= 0, (at - zero) / (1 - zero)).otherwise((at - zero) / zero)


def aligned(**inputs: float | list[float]) -> list[dict[str, float]]:
    """Rows of inputs of one length; a single number goes to every row. Empty and ragged inputs are errors."""
    lists = {k: list(v) if hasattr(v, "__len__") else [float(v)] for k, v in inputs.items()}
    n = max((len(v) for v in lists.values()), default=0)
    if odd := {k: len(v) for k, v in lists.items() if len(v) not in (1, n) or not v}:
        raise ValueError(f"inputs of length {odd} beside {n}")
    return [{k: float(v[i if len(v) > 1 else 0]) for k, v in lists.items()} for i in range(n)]
