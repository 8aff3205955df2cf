"""Loan, normal-curve and yield formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: published coefficients (Abramowitz and Stegun 7.1.26; Acklam's inverse) and index constants. ----
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
INV_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
INV_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
INV_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
INV_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
POVERTY_LINE, ADULTS_PER_PERSON, HOUSING_SHARE = 87_000.0, 0.787, 0.174
BASE_TERMS = {"rate": 0.18293, "deposit": 0.30, "term": 20, "cap": 0.35}
# ---- End of fixed values. ----


def monthly_payment(principal: Column, annual_rate: Column | float, years: Column | float) -> Column:
    r = (F.lit(annual_rate) if not isinstance(annual_rate, Column) else annual_rate) / 12
    n = (F.lit(years) if not isinstance(years, Column) else years) * 12
    return principal * r / (1 - F.pow(1 + r, -n))


def qualifying_income(price: Column, rate, deposit, term, cap) -> Column:
    """Income at which the repayment of a loan on the price takes the lender's cap."""
    return monthly_payment(price * (1 - deposit), rate, term) / cap


def phi(z: Column) -> Column:
    """Normal distribution function, within 1e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF):
        poly = (poly + a) * t
    return 0.5 * (1 + F.signum(z) * (1 - poly * F.exp(-x * x)))


def phi_inverse(p: Column) -> Column:
    """Inverse of the normal distribution function for 0 < p < 1."""

    def ratio(x: Column, top: tuple, bottom: tuple, by: Column | None = None) -> Column:
        a, b = F.lit(0.0), F.lit(0.0)
        for c in top:
            a = a * x + c
        for c in bottom:
            b = b * x + c
        return (a * by if by is not None else a) / (b * x + 1)

    q = p - 0.5
    tail = lambda y: ratio(F.sqrt(-2 * F.ln(y)), INV_C, INV_D)
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(ratio(q * q, INV_A, INV_B, q))


def sigma_from_gini(gini: Column) -> Column:
    """Log standard deviation of the lognormal with this Gini coefficient."""
    return math.sqrt(2) * phi_inverse((gini + 1) / 2)


def share_affording(rent: Column, median_income: Column, sigma: Column, threshold: float = 0.30) -> Column:
    return 1 - phi((F.ln(rent / threshold) - F.ln(median_income)) / sigma)


# The same formulas as DuckDB text.
def phi_sql(z: str) -> str:
    x = f"(abs({z}) / {math.sqrt(2)!r}e0)"
    t = f"(1 / (1 + 0.3275911e0 * {x}))"
    poly = "0e0"
    for a in reversed(ERF):
        poly = f"({poly} + {a!r}e0) * {t}"
    return f"(0.5e0 * (1 + sign({z}) * (1 - {poly} * exp(-{x} * {x}))))"


def phi_inverse_sql(p: str) -> str:
    def ratio(x: str, top: tuple, bottom: tuple, by: str = "1") -> str:
        a, b = "0e0", "0e0"
        for c in top:
            a = f"({a} * {x} + ({c!r}))"
        for c in bottom:
            b = f"({b} * {x} + ({c!r}))"
        return f"({a} * {by} / ({b} * {x} + 1))"

    tail = lambda y: ratio(f"sqrt(-2 * ln({y}))", INV_C, INV_D)
    q = f"(({p}) - 0.5e0)"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(p)} WHEN {p} > 0.97575 THEN -{tail(f'(1 - {p})')} ELSE {ratio(f'({q} * {q})', INV_A, INV_B, q)} END"


def payment_sql(principal: str, rate: str, years: str) -> str:
    return f"({principal} * ({rate} / 12) / (1 - pow(1 + {rate} / 12, -({years}) * 12)))"
