"""Column builders shared by the operators. None of them turns a missing measurement into zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def band(value: Column, bands: Sequence[tuple[float | None, str]]) -> Column:
    """First label whose upper bound (exclusive; None = no bound) exceeds the value; null stays null."""
    out = F.when(value.isNull(), None)
    for high, label in bands:
        out = out.otherwise(F.lit(label)) if high is None else out.when(value < high, label)
    return out


def guarded_band(value: Column, bands: Sequence[tuple[float | None, str]], labels: Sequence[str]) -> Column:
    """``band``, after a check that the bounds ascend, the last has none and the labels are those agreed on: a
    ValueError otherwise, so that a changed configuration cannot shift labels silently."""
    highs = [high for high, _ in bands]
    if [label for _, label in bands] != list(labels) or highs[-1] is not None or None in highs[:-1] or sorted(highs[:-1]) != highs[:-1]:
        raise ValueError(f"bands {list(bands)} do not fit the labels {list(labels)}")
    return band(value, bands)


def day_period(hour: Column, periods: Sequence[tuple[int, int, str]]) -> Column:
    """Label of the first period (from, to, label; both hours inclusive) that holds the hour."""
    out = F.when(hour.isNull(), None)
    for low, high, label in periods:
        out = out.when(hour.between(low, high), label)
    return out


PERIODS = ((0, 6, "early"), (7, 9, "am_peak"), (10, 15, "midday"), (16, 18, "pm_peak"), (19, 23, "evening"))


def share(condition: Column, measured: Column) -> Column:
    """Share of measured rows that meet the condition; unmeasured rows count on neither side."""
    return F.avg(F.when(condition, F.lit(1.0)).when(measured.isNotNull(), F.lit(0.0)))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))) / F.lit(60.0)


def day_class(day: Column) -> Column:
    return F.when(F.dayofweek(day) == 1, "sunday").when(F.dayofweek(day) == 7, "saturday").when(day.isNotNull(), "weekday")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value.cast("string")) == "")


def failed_columns(tests: dict[str, Column]) -> Column:
    """Names, in order and joined by ',', of the columns whose test is true; '' if none."""
    return F.concat_ws(",", *[F.when(test, name) for name, test in tests.items()])


def median_of(history: Column, lower: bool = False) -> Column:
    """Median of an array of numbers without nulls; null if it is empty. lower: no averaging of the middle two."""
    h, n = F.array_sort(history), F.size(history)
    low, high = F.get(h, F.floor((n - 1) / 2).cast("int")), F.get(h, F.floor(n / 2).cast("int"))
    return F.when(n > 0, low if lower else (low + high) / 2)
