"""Unit conversions as Catalyst column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import JOULES_PER_KWH


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_watts(value="value", units="units") -> Column:
    """mW -> /1000, kW -> x1000, W / unknown / null -> unchanged (per row)."""
    v, u = _c(value).cast("double"), F.lower(_c(units))
    return F.when(u == "mw", v / 1000.0).when(u == "kw", v * 1000.0).otherwise(v)


def with_power_w(df, value="value", units="units", out="power_w"):
    """Add ``power_w``; watts assumed when the frame has no unit column."""
    if units in df.columns:
        return df.withColumn(out, to_watts(value, units))
    return df.withColumn(out, F.col(value).cast("double"))


def unit_info(units="units"):
    """(original_unit, converted_unit, conversion_applied) for a unit column."""
    u = F.lower(_c(units))
    original = (
        F.when(u == "mw", F.lit("mW"))
        .when(u == "kw", F.lit("kW"))
        .when(u == "w", F.lit("W"))
        .otherwise(F.coalesce(_c(units), F.lit("Unknown")))
    )
    return [
        original.alias("original_unit"),
        F.lit("W").alias("converted_unit"),
        u.isin("mw", "kw").alias("conversion_applied"),
    ]


def convert_temperature(value, from_unit: str, to_unit: str = "C") -> Column:
    """C/F/K -> C/F/K through Celsius."""
    v = _c(value).cast("double")
    if from_unit == to_unit:
        return v
    fu, tu = from_unit.upper(), to_unit.upper()
    c = (v - 32) * 5 / 9 if fu == "F" else (v - 273.15 if fu == "K" else v)
    if tu == "F":
        return c * 9 / 5 + 32
    if tu == "K":
        return c + 273.15
    return c


def joules_to_kwh(c) -> Column:
    """B7."""
    return _c(c) / JOULES_PER_KWH


def kwh_to_joules(c) -> Column:
    """B7."""
    return _c(c) * JOULES_PER_KWH


def kwh_to_wh(c) -> Column:
    """B7."""
    return _c(c) * 1000.0
