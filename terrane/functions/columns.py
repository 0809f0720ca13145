"""Scalar functions on columns, with the null rules that every operator shares.

Missing is always null, never NaN; text that is not a number or a date becomes null; dividing by zero gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: str | Column) -> Column:
    """Text to double, null if it is none; NaN to null."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def integer(c: str | Column) -> Column:
    """Text to whole number by way of double (``'5.7'`` gives 5); null if it is none."""
    return number(c).try_cast("long")


def timestamp(c: str | Column) -> Column:
    """ISO 8601 text to a timestamp, the compact form ``yyyyMMdd`` included; null if it is none."""
    return F.coalesce(F.when(~col(c).rlike(r"^\d{8}$"), col(c).try_cast("timestamp")), F.try_to_timestamp(col(c), F.lit("yyyyMMdd")))


def ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def truth(c: Column) -> Column:
    """A predicate whose unknown counts as false."""
    return F.coalesce(c, F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [truth(c) for c in conditions], F.lit(False))


def title_case(c: str | Column) -> Column:
    """Upper case after every character that is no letter, lower case elsewhere."""
    parts = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), "")


def round_to_significant(c: str | Column, digits: int = 3, direction: str = "nearest") -> Column:
    """To ``digits`` significant ones, half to even; directions nearest, up and down. Zero stays, null stays."""
    ways = {"nearest": F.rint, "up": F.ceil, "down": F.floor}
    if direction not in ways:
        raise ValueError(f"direction must be one of {', '.join(ways)}")
    x = col(c).cast("double")
    factor = F.pow(F.lit(10.0), F.lit(digits - 1.0) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(ways[direction](x * factor).cast("double") / factor)


def date_parts(c: str | Column) -> dict[str, Column]:
    """year, month, day and day_of_year of a text date."""
    t = timestamp(c)
    return {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "day_of_year": F.dayofyear(t)}


def clean_scientific_name(c: str | Column) -> Column:
    """A name of three words whose second is repeated loses the third; others are unchanged."""
    words = F.split(F.trim(col(c)), r"\s+")
    twice = (F.size(words) == 3) & (F.lower(F.get(words, F.lit(1))) == F.lower(F.get(words, F.lit(2))))
    return F.when(truth(twice), F.concat_ws(" ", F.slice(words, 1, 2))).otherwise(col(c))


def department_codes(c: str | Column) -> Column:
    """Codes in a text: both halves of Corsica, one of them, or all numbers up to 900 joined by ``, ``."""
    numbers = F.filter(F.regexp_extract_all(col(c), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long") <= 900)
    return F.when(col(c) == "2A | 2B", F.lit("2A, 2B")).when(col(c).contains("2A"), F.lit("2A")).when(col(c).contains("2B"), F.lit("2B")).otherwise(F.array_join(numbers, ", "))


def period_label(bounds: list[int], k: int) -> str:
    return f"Période {k + 1}: {bounds[k] + 1} à {bounds[k + 1]}"


def period(year: str | Column, bounds: list[int]) -> Column:
    """The label of the period that holds a year: open to the left, closed to the right, null outside."""
    out = F.lit(None).cast("string")
    for k in range(len(bounds) - 1):
        out = F.when((col(year) > bounds[k]) & (col(year) <= bounds[k + 1]), F.lit(period_label(bounds, k))).otherwise(out)
    return out


def site_name(c: str | Column) -> Column:
    """A site's name without the remark that it is a buffer zone."""
    return F.regexp_replace(col(c), r"(?i)\s*\[aire d'adhésion\]\s*", "")


def first_part(c: str | Column, separator: str) -> Column:
    """What stands before the first separator, trimmed."""
    return F.trim(F.split_part(col(c), F.lit(separator), F.lit(1)))


def degrees_per_km(latitude: str | Column) -> tuple[Column, Column]:
    """Degrees of latitude and of longitude that a kilometre spans at a latitude."""
    return F.lit(1 / 111.32), 1 / (111.32 * F.cos(F.radians(col(latitude))))


def clamped(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Within the given bounds; null stays null."""
    out = col(c)
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return out


def thousands(c: str | Column) -> Column:
    return F.format_number(col(c).cast("double"), 0)


def run_date() -> Column:
    """Today as ddMMyy, as it names output folders."""
    return F.date_format(F.current_date(), "ddMMyy")
