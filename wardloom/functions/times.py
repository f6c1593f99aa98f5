"""Admission-time features as Column expressions.

All inputs are naive wall-clock times. The expressions never go through the
session time zone, so a daylight-saving change cannot move a length of stay.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400


def naive(moment: Column) -> Column:
    return moment.cast("timestamp_ntz")


def parsed_time(text: Column, strict: bool = True) -> Column:
    """Text to naive timestamp; bad text raises unless ``strict`` is off."""
    return text.cast("timestamp_ntz") if strict else text.try_cast("timestamp_ntz")


def elapsed_days(start: Column, end: Column) -> Column:
    """Fractional days from start to end; negative when end comes first."""
    gap = (naive(end) - naive(start)).cast("interval second")
    return gap.cast("decimal(20,6)").cast("double") / F.lit(SECONDS_PER_DAY)


def is_weekend(moment: Column) -> Column:
    """1 on Saturday and Sunday; a missing time counts as a weekday."""
    return F.coalesce(F.weekday(moment).isin(5, 6).cast("int"), F.lit(0))


def is_night(moment: Column) -> Column:
    """1 from 22:00 until 06:59; a missing time counts as day."""
    hour = F.hour(moment)
    return F.coalesce(((hour >= 22) | (hour <= 6)).cast("int"), F.lit(0))


def admission_features(admit: Column, discharge: Column, month: bool = True) -> dict[str, Column]:
    """Named feature columns, ready for ``df.withColumns``."""
    features = {
        "los_days": elapsed_days(admit, discharge),
        "admit_hour": F.hour(admit),
        "admit_dayofweek": F.weekday(admit),
        "is_weekend": is_weekend(admit),
        "is_night_admission": is_night(admit),
    }
    if month:
        features["admit_month"] = F.month(admit)
    return features
