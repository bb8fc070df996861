"""The normal distribution as SQL expressions. The same text runs on Spark and on any engine with exp, ln and sqrt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of published approximations (Hart / West for the distribution, Acklam for its inverse).
_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _number(v: float) -> str:
    return f"{v:.16e}"


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    out = _number(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {_number(c)})"
    return out


def norm_cdf_sql(x: str) -> str:
    """SQL text of the standard normal distribution function of the expression `x`."""
    z = f"abs({x})"
    e = f"exp(-{z} * {z} / 2e0)"
    near = f"{e} * {_horner(_NUM, z)} / {_horner(_DEN, z)}"
    far = f"{e} / ({z} + 1e0 / ({z} + 2e0 / ({z} + 3e0 / ({z} + 4e0 / ({z} + 0.65e0))))) / 2.506628274631e0"
    tail = f"CASE WHEN {z} > 37 THEN 0e0 WHEN {z} < 7.07106781186547e0 THEN {near} ELSE {far} END"
    return f"(CASE WHEN {x} > 0 THEN 1e0 - ({tail}) ELSE {tail} END)"


def norm_ppf_sql(p: str) -> str:
    """SQL text of the inverse (absolute error about 1e-9); NULL outside (0, 1)."""
    q, low, high = f"({p} - 0.5e0)", f"sqrt(-2e0 * ln({p}))", f"sqrt(-2e0 * ln(1e0 - {p}))"
    r = f"({q} * {q})"
    return (
        f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL "
        f"WHEN {p} < 0.02425e0 THEN {_horner(_C, low)} / {_horner(_D, low)} "
        f"WHEN {p} > 0.97575e0 THEN -({_horner(_C, high)}) / {_horner(_D, high)} "
        f"ELSE {q} * {_horner(_A, r)} / {_horner(_B, r)} END)"
    )


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function; stays in whole-stage code."""
    z = F.abs(x)
    e = F.exp(-z * z / 2)

    def poly(coefficients: tuple[float, ...]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * z + F.lit(c)
        return out

    far = e / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / F.lit(2.506628274631)
    tail = F.when(z > 37, 0.0).when(z < 7.07106781186547, e * poly(_NUM) / poly(_DEN)).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_ppf(p: str) -> Column:
    """Inverse of the distribution function for a column name or SQL text."""
    return F.expr(norm_ppf_sql(p))
