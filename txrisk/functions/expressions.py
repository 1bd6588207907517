"""Column-level expressions (JVM-side, codegen-friendly; no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
DEFAULT_LOW_RISK_THRESHOLD = 0.20
DEFAULT_HIGH_RISK_THRESHOLD = 0.60
RISK_LEVELS = ["Low Risk", "Medium Risk", "High Risk"]
WEEKEND_DAYS = [5, 6]          # Monday = 0
DOMESTIC_SUFFIX = "us"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c, digits: int) -> Column:
    """NumPy ``round``: scale by 10**digits, round half to even (``rint``), scale back.

    Same IEEE operations as ``np.round`` and as SQL ``round_even`` on doubles.
    """
    scale = F.lit(float(10 ** digits))
    return F.rint(col(c) * scale) / scale


def hour_of_day(ts) -> Column:
    return F.hour(col(ts))


def day_of_week(ts) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(col(ts))


def is_weekend(ts) -> Column:
    return F.weekday(col(ts)).isin(WEEKEND_DAYS).cast("int")


def is_international(location) -> Column:
    """1 unless the lower-cased location ends with the domestic suffix (a suffix test)."""
    return (~F.lower(col(location)).endswith(DOMESTIC_SUFFIX)).cast("int")


def log_amount(amount) -> Column:
    return F.log10(col(amount) + F.lit(1.0))


def risk_score(probability) -> Column:
    """0-100 score, half-even at two decimals."""
    return round_half_even(col(probability) * F.lit(100.0), 2)


def risk_level(probability, low=DEFAULT_LOW_RISK_THRESHOLD, high=DEFAULT_HIGH_RISK_THRESHOLD) -> Column:
    """Tier of the *unrounded* probability: [0, low) Low, [low, high) Medium, else High."""
    p = col(probability)
    lo = col(low) if not isinstance(low, (int, float)) else F.lit(float(low))
    hi = col(high) if not isinstance(high, (int, float)) else F.lit(float(high))
    return (F.when(p < lo, F.lit(RISK_LEVELS[0]))
             .when(p < hi, F.lit(RISK_LEVELS[1]))
             .otherwise(F.lit(RISK_LEVELS[2])))


def churn_score(monthly_charges, tenure) -> Column:
    """min(monthly / max(tenure, 1) * 0.1, 0.99)."""
    return F.least(col(monthly_charges) / F.greatest(col(tenure), F.lit(1)) * F.lit(0.1), F.lit(0.99))


def strip_lower(c) -> Column:
    """Python ``str.strip().lower()``: trims any leading/trailing whitespace."""
    return F.lower(F.regexp_replace(col(c), r"^\s+|\s+$", ""))
