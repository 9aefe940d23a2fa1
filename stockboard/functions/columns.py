"""Column expressions.

Every function returns a ``Column`` built from ``pyspark.sql.functions`` only,
so the expressions stay inside whole-stage codegen and need no Python worker.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the risk score, the delay cap in days and the class
# thresholds (score >= 60 hoch, >= 30 mittel, else niedrig).
WEIGHT_DELAY = 0.5
WEIGHT_PUNCTUALITY = 0.3
WEIGHT_COMPLAINTS = 0.2
DELAY_CAP_DAYS = 14.0
CLASS_HIGH = ("hoch", 60.0)
CLASS_MEDIUM = ("mittel", 30.0)
CLASS_LOW = "niedrig"

# The two text formats of a change date.
DATE_FORMATS = ("dd.MM.yyyy", "yyyy-MM-dd")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def col_exact(name: str) -> Column:
    """A column by its exact name: dots and other characters are not paths
    (``MATERIAL-NR.`` after ``label_columns``)."""
    return F.col("`" + name.replace("`", "``") + "`")


def blank_to_null(c: Column | str) -> Column:
    """The empty string becomes null; whitespace stays as it is."""
    return F.nullif(_col(c), F.lit(""))


def lenient_long(c: Column | str) -> Column:
    """Cast to bigint, a value that does not convert becomes null."""
    return _col(c).try_cast("bigint")


def nullable_long(c: Column | str) -> Column:
    """Integer cast that keeps null."""
    return _col(c).cast("bigint")


def nullable_double(c: Column | str) -> Column:
    """Float cast that keeps null."""
    return _col(c).cast("double")


def no_negative_zero(c: Column) -> Column:
    """Adding +0.0 turns -0.0 into 0.0 and leaves every other value alone."""
    return c + F.lit(0.0)


def stock_value(stock: Column | str = "bestand", price: Column | str = "preis") -> Column:
    """P5: round(stock * price, 2); null when either side is null (unknown is not 0).

    Spark rounds HALF_UP on the decimal text of the double.
    """
    return F.round(_col(stock).cast("double") * _col(price).cast("double"), 2)


def delay_days(delivered: Column | str = "geliefert_am",
               promised: Column | str = "zugesagt_am") -> Column:
    """Whole days delivered minus promised; negative when early."""
    return F.datediff(_col(delivered), _col(promised))


def clip(c: Column | str, low: float, high: float) -> Column:
    """Bound a value to [low, high]; null stays null."""
    return F.greatest(F.least(_col(c), F.lit(high)), F.lit(low))


def risk_score(mean_delay: Column | str, punctual_share: Column | str,
               complaint_share: Column | str) -> Column:
    """Weighted score 0..100, rounded to one place; uses the unrounded delay."""
    delay_part = clip(mean_delay, 0.0, DELAY_CAP_DAYS) / F.lit(DELAY_CAP_DAYS) * F.lit(100)
    punct_part = (F.lit(1) - _col(punctual_share)) * F.lit(100)
    complaint_part = _col(complaint_share) * F.lit(100)
    raw = (F.lit(WEIGHT_DELAY) * delay_part + F.lit(WEIGHT_PUNCTUALITY) * punct_part
           + F.lit(WEIGHT_COMPLAINTS) * complaint_part)
    return no_negative_zero(F.round(raw, 1))


def percent(share: Column | str, places: int = 1) -> Column:
    """P10: a share 0..1 as a rounded percentage."""
    return no_negative_zero(F.round(_col(share) * F.lit(100), places))


def rounded(c: Column | str, places: int) -> Column:
    """P10: round and remove -0.0."""
    return no_negative_zero(F.round(_col(c), places))


def risk_class(score: Column | str) -> Column:
    """Band of the (already rounded) score."""
    s = _col(score)
    return (F.when(s >= F.lit(CLASS_HIGH[1]), F.lit(CLASS_HIGH[0]))
             .when(s >= F.lit(CLASS_MEDIUM[1]), F.lit(CLASS_MEDIUM[0]))
             .otherwise(F.lit(CLASS_LOW)))


def format_thousands(c: Column | str) -> Column:
    """1234567 -> '1.234.567' (German grouping); null stays null."""
    return F.translate(F.format_number(_col(c), 0), ",", ".")


def lookup_constant(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Constant dictionary lookup; an unknown key gives null."""
    pairs = []
    for key, value in mapping.items():
        pairs += [F.lit(key), F.lit(value)]
    return F.try_element_at(F.create_map(*pairs), _col(c))


def normalize_change_date(c: Column | str) -> Column:
    """Text date in 'dd.MM.yyyy' or ISO 'yyyy-MM-dd' -> DateType; else null."""
    tries = [F.try_to_date(_col(c), fmt) for fmt in DATE_FORMATS]
    return F.coalesce(*tries)
