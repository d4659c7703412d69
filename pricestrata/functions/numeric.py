"""Numbers, bins and dates: nothing here throws on odd input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(c: Column) -> Column:
    """A text as a double; null if it is no plain decimal number."""
    return F.when(c.cast("string").rlike(NUMBER), F.trim(c.cast("string")).try_cast("double"))


def no_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def count_number(c: Column) -> Column:
    """A printed count: white space within it, a decimal comma, or a dash for none."""
    plain = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", ""), ",", ".")
    return to_number(F.when(plain == "-", None).otherwise(plain))


def decimal_number(c: Column) -> Column:
    """A price with a decimal comma or point."""
    return to_number(F.regexp_replace(c, ",", "."))


def within(c: Column, low: float, high: float) -> Column:
    """c, or null outside [low, high]."""
    return F.when(c.between(low, high), c)


# The bounds of a vehicle register's columns.
REGISTER_BOUNDS = {"engine_cc": (500, 10_000), "power_kw": (20, 1000), "cylinders": (2, 16), "mass_kg": (500, 5000), "mileage": (0, 1_000_000), "doors": (2, 6), "seats": (1, 9), "vehicle_year": (1950, 2025), "vehicle_age": (0, 80)}


def above(c: Column, least: float) -> Column:
    """c, or null at least or below."""
    return F.when(c > least, c)


def share(condition: Column) -> Column:
    """The share of rows for which a condition holds; a null counts as no, and its row counts."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def half_even(c: Column, digits: int = 2) -> Column:
    return F.bround(c, digits)


def fixed_bins(c: Column, edges: list[float], labels: list[str], right: bool = True) -> Column:
    """The label of the bin between edges: (low, high], the lowest edge included, or [low, high); else null."""
    out = F.lit(None).cast("string")
    for i in reversed(range(len(labels))):
        low, high = edges[i], edges[i + 1]
        inside = (c > low) & (c <= high) if right else (c >= low) & (c < high)
        out = F.when(inside | (c == low) if right and i == 0 else inside, labels[i]).otherwise(out)
    return out


# The bands of registration years.
YEAR_EDGES = [1949, 2004, 2009, 2014, 2019, 2025]
YEAR_LABELS = ["pre_2005", "2005_2009", "2010_2014", "2015_2019", "2020_2025"]


def year_band(c: Column) -> Column:
    return fixed_bins(c, YEAR_EDGES, YEAR_LABELS)


def quantile_edges(c: Column, q: int = 5) -> Column:
    """The distinct inner and outer edges of q bins of equal counts (an aggregate)."""
    return F.array_distinct(F.percentile(c, [i / q for i in range(q + 1)]))


def bin_of(c: Column, edges: Column) -> Column:
    """The bin, from 0, of right-closed bins between edges; the lowest edge is in the first."""
    return F.when(c.isNotNull(), F.greatest(F.size(F.filter(edges, lambda e: e < c)) - 1, F.lit(0)))


def finnish_date(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("d.M.yyyy")).cast("date")


def compact_date(c: Column) -> Column:
    """A date of eight digits. A trailing .0 goes, and a year without month and day is its first day."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\.0$", ""), r"^(\d{4})0000$", "$10101")
    return F.when(plain.rlike(r"^\d{8}$"), F.try_to_timestamp(plain, F.lit("yyyyMMdd")).cast("date"))


def iso_date(c: Column) -> Column:
    return c.try_cast("date")


def day_offset(c: Column, origin: Column) -> Column:
    return F.datediff(c, origin)


def local_stamp(c: Column | None = None, zone: str = "Europe/Helsinki") -> tuple[Column, Column]:
    """The date, and the time to the second with its offset (ISO 8601), that clocks of a zone show at a moment; none: now."""
    at = F.date_trunc("second", F.current_timestamp() if c is None else c).cast("timestamp_ntz")
    there, utc = (F.convert_timezone(F.current_timezone(), F.lit(z), at) for z in (zone, "UTC"))
    minutes = F.timestamp_diff("MINUTE", utc, there)
    sign = F.when(minutes < 0, "-").otherwise("+")
    offset = F.format_string("%s%02d:%02d", sign, F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60)
    return F.date_format(there, "yyyy-MM-dd"), F.concat(F.date_format(there, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def to_euros(prediction: Column, logged: bool, largest: float) -> Column:
    """Predictions as prices: of logarithms, bounded before exp; nothing not a number, nothing below 0."""
    finite = (prediction == prediction) & ~F.isnan(prediction) & (F.abs(prediction) < float("inf"))
    plain = F.when(finite, prediction)
    if not logged:
        return F.greatest(F.coalesce(plain, F.lit(0.0)), F.lit(0.0))
    low, high = F.ln(F.lit(1e-3)), F.ln(F.lit(10.0 * largest))
    kept = F.coalesce(plain, F.when(prediction == float("inf"), high).otherwise(low))
    return F.exp(F.least(F.greatest(kept, low), high))


def sorted_quantile(values: Column, q: float) -> Column:
    """The linearly interpolated quantile of an array."""
    own = F.array_sort(values)
    at = F.lit(q) * (F.size(own) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(own, low), F.get(own, F.least(low + 1, F.size(own) - 1))
    return a + (b - a) * (at - low)
