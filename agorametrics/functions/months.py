"""Month keys: two INT columns ``year`` and ``month``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_MICROS = 86_400_000_000


def shift_month(year: int, month: int, offset: int) -> tuple[int, int]:
    """The month ``offset`` months away, for report parameters."""
    year, zero_based = divmod(year * 12 + month - 1 + offset, 12)
    return year, zero_based + 1


def month_start(year: Column | str, month: Column | str) -> Column:
    return F.make_date(_col(year), _col(month), F.lit(1))


def shifted(year: Column | str, month: Column | str, offset: Column | int) -> Column:
    """First day of the month ``offset`` months away."""
    return F.add_months(month_start(year, month), offset).cast("date")


def utc_date(ts: Column) -> Column:
    """The UTC day of a timestamp, whatever the session's time zone."""
    days = F.floor(F.unix_micros(ts.cast("timestamp")) / _DAY_MICROS)
    return F.date_from_unix_date(days.cast("int"))


def utc_wall(ts: Column) -> Column:
    """The UTC clock reading of a timestamp, as a timestamp without a time zone."""
    clock = F.pmod(F.unix_micros(ts), F.lit(_DAY_MICROS))
    time = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), clock.cast("decimal(18,0)") / 1_000_000)
    return utc_date(ts).cast("timestamp_ntz") + time


def month_keys(ts: Column) -> list[Column]:
    """UTC months of a timestamp."""
    day = utc_date(ts)
    return [F.year(day).cast("int").alias("year"), F.month(day).cast("int").alias("month")]


def month_number(year: Column | str = "year", month: Column | str = "month") -> Column:
    """Consecutive month number, for comparing months of different years."""
    return _col(year) * 12 + _col(month)


def in_month(year: int, month: int) -> Column:
    """Plain equality on both keys, so month partitions are pruned."""
    return (F.col("year") == year) & (F.col("month") == month)


def from_month(year: int, month: int) -> Column:
    return (F.col("year") > year) | ((F.col("year") == year) & (F.col("month") >= month))


def until_month(year: int, month: int) -> Column:
    return (F.col("year") < year) | ((F.col("year") == year) & (F.col("month") <= month))


def month_label(pattern: str, year: Column | str = "year", month: Column | str = "month") -> Column:
    return F.date_format(month_start(year, month), pattern)


def year_month(year: Column | str = "year", month: Column | str = "month") -> Column:
    """``2024-05`` style label."""
    return month_label("yyyy-MM", year, month)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
