"""Cleaning expressions: numbers, sentinels, keys, ranges, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what rasters and series write where they have no data.
NO_DATA = -9999.0


def number(c: Column) -> Column:
    """c as a double; what is no number becomes null, as does NaN."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def no_data(c: Column, value: float = NO_DATA) -> Column:
    return F.nullif(c, F.lit(value))


def normalize_key(c: Column) -> Column:
    """Trimmed, white space collapsed to single blanks, upper case; null becomes the empty string."""
    return F.coalesce(F.upper(F.trim(F.regexp_replace(c, "\\s+", " "))), F.lit(""))


def in_range(c: Column, low: float, high: float) -> Column:
    """c, or null outside [low, high]."""
    return F.when(c.between(low, high), c)


def range_flags(bounds: dict[str, tuple[float, float]], prefix: str = "range:") -> Column:
    """Array of prefix + column for each column with a value outside its inclusive bounds, in the order given."""
    marks = [F.when(F.col(c).isNotNull() & ~F.col(c).between(lo, hi), F.lit(prefix + c)) for c, (lo, hi) in bounds.items()]
    return F.array_compact(F.array(*marks))


def joined_flags(flags: Column) -> Column:
    """Flags as a comma list; the empty string without any."""
    return F.concat_ws(",", flags)


def coalesce_date(c: Column) -> Column:
    """A date from YYYY-MM-DD, or 1 January from YYYY; null otherwise."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"), F.when(c.rlike("^[0-9]{4}$"), F.make_date(c.try_cast("int"), F.lit(1), F.lit(1))))
