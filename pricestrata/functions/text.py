"""Text columns. White space is Unicode's throughout, as in the data's own tools."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "__missing__"

# Spellings of brands.
BRAND_ALIASES = {"vw": "volkswagen", "volkswagen, vw": "volkswagen", "skd": "skoda", "skida": "skoda"}

# What a location label says of (side, position).
LOCATIONS = {
    "right rear": ("Right", "Rear"),
    "left rear": ("Left", "Rear"),
    "right front": ("Right", "Front"),
    "left front": ("Left", "Front"),
    "either side front": ("Either side", "Front"),
    "either side rear": ("Either side", "Rear"),
    "either side": ("Either side", None),
    "right": ("Right", None),
    "left": ("Left", None),
    "rear": (None, "Rear"),
    "front": (None, "Front"),
    "centre": (None, "Centre"),
}

# Labels that name no part.
GENERIC_LABELS = ("all", "general", "any", "either side", "left", "right", "front", "rear", "centre")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def null_if(c: Column, *values: str) -> Column:
    return F.when(c.isin(*values), None).otherwise(c)


def key(c: Column) -> Column:
    """A join key: stripped, lower case, one space between words; empty and "nan" are null."""
    return null_if(collapse(F.lower(strip(c))), "", "nan")


def replaced(c: Column, values: dict[str, str]) -> Column:
    """Whole values replaced by a map."""
    return reduce(lambda out, kv: F.when(c == kv[0], kv[1]).otherwise(out), values.items(), c)


def brand_key(c: Column) -> Column:
    return replaced(key(c), BRAND_ALIASES)


def group_value(c: Column) -> Column:
    """A value as part of an identity: lower case and stripped; null or empty is `__missing__`."""
    return F.coalesce(null_if(F.lower(strip(c.cast("string"))), ""), F.lit(MISSING))


def identity(*columns: Column) -> Column:
    """Group values joined by bars. A bar within a value is escaped, so different values stay different."""
    return F.concat_ws("|", *(F.regexp_replace(group_value(c), r"([\\|])", r"\\$1") for c in columns))


def fingerprint(*columns: Column) -> Column:
    """A digest of a row: every value with its length, null apart from everything else."""
    part = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return F.md5(F.concat_ws(",", *map(part, columns)).cast("binary"))


def literal_pattern(c: Column) -> Column:
    """A column's text as a pattern in which spaces and hyphens stand for runs of either."""
    return F.regexp_replace(F.regexp_replace(c, r"([\\\[\](){}.*+?^$|])", r"\\$1"), r"[ -]", "[- ]+")


def without_prefix(c: Column, prefix: Column) -> Column:
    """c without the words of prefix at its start and without the separators left over; empty is null."""
    rest = F.regexp_replace(c, F.concat(F.lit("^"), literal_pattern(prefix), F.lit("(?:[- ]+|$)")), F.lit(""))
    return F.when(prefix.isNull(), c).otherwise(null_if(F.btrim(collapse(rest), F.lit(" -")), ""))


def split_range(c: Column) -> tuple[Column, Column]:
    """The parts of a text on both sides of its first hyphen; a missing part is null."""
    parts = F.split(c, "-")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def contains_word(c: Column, pattern: str) -> Column:
    """Case-insensitive search; a null holds nothing."""
    return F.coalesce(c.rlike(f"(?iu){pattern}"), F.lit(False))


def is_total(c: Column, ending: str = "yhteensä") -> Column:
    """Whether a label is that of a total row."""
    return contains_word(c, f"{ending}$")


def clean_part_name(name: Column, brand: Column, model: Column) -> Column:
    """A part's name without brand and base model wherever they stand, years in brackets and a trailing "to"."""
    base = strip(F.get(F.split(F.get(F.split(model, ","), F.lit(0)), "-"), F.lit(0)))

    def drop(c: Column, what: Column) -> Column:
        quoted = F.concat(F.lit("(?iu)"), F.regexp_replace(what, r"([\\\[\](){}.*+?^$|])", r"\\$1"))
        return F.when(F.coalesce(what, F.lit("")) == "", c).otherwise(F.regexp_replace(c, quoted, F.lit("")))

    out = drop(drop(name, brand), base)
    out = F.regexp_replace(out, r"\(\d{4}[^)]*\)", "")
    out = strip(F.regexp_replace(collapse(out), r"(?iu)\s+to\s*$", ""))
    return F.coalesce(null_if(out, ""), F.lit("Unknown Part"))


# Labels that are shown under other names.
SHOWN_LABELS = {
    "abs": "ABS",
    "ac": "AC",
    "vw": "VW",
    "airbag control unit": "Airbag control unit",
    "airbag krocksensor": "Airbag impact sensor",
    "contact roll airbag": "Airbag contact roll",
    "fuse box / electricity central": "Fuse box / electrical central",
    "gear box / drive axle / middle axle": "Drivetrain",
    "parkeringshjälp frontsensor": "Parking assist front sensor",
    "kamera utvändig": "Exterior camera",
    "dörr styrenhet": "Door control unit",
    "ljusinställning lägesgivare": "Headlight level sensor",
    "komfort styrdon": "Comfort control unit",
}


def label_key(c: Column) -> Column:
    """A label as shown, without trailing remarks in brackets, in lower case."""
    return F.lower(strip(F.regexp_replace(display_label(c), r"(\s*(\[[^\]]*\]|\([^)]*\)))+\s*$", "")))


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.expr("''"), F.substring(c, F.lit(2), F.length(c)))


def display_label(c: Column) -> Column:
    """A label as shown: without dangling separators and "- ,e-" tails, known ones spelt out, the first letter large; a null is empty."""
    plain = F.btrim(collapse(F.regexp_replace(strip(c), r"(?iU)(\s*-(\s*,?\s*e-)?|\s*,)+\s*$", "")), F.lit(" -"))
    shown = SHOWN_LABELS | {k: " ".join(x for x in v if x) for k, v in LOCATIONS.items()}
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in shown.items() for x in kv)), F.lower(plain))
    return F.coalesce(known, capitalised(plain), F.lit(""))


def side_and_position(*columns: Column) -> tuple[Column, Column]:
    """(side, position): of each, the first that a whole label, or a part of it in brackets, gives."""
    sides = F.create_map(*(F.lit(x) for k, (s, _) in LOCATIONS.items() if s for x in (k, s)))
    places = F.create_map(*(F.lit(x) for k, (_, p) in LOCATIONS.items() if p for x in (k, p)))
    labels = []
    for c in columns:
        own = F.coalesce(c, F.lit(""))
        labels += [F.array(F.lower(strip(own))), F.transform(F.regexp_extract_all(own, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda x: F.lower(strip(x)))]
    every = F.concat(*labels)
    first = lambda table: F.get(F.filter(F.transform(every, lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull()), F.lit(0))
    return first(sides), first(places)


def part_type(part_name: Column, subcategory: Column, category: Column) -> Column:
    """The part's name as shown, without remarks in round brackets, unless that is only a place; then the subcategory, then the category.

    If all are places, the first that is not empty; if all are empty, `Unknown part`.
    """
    labels = [display_label(F.regexp_replace(part_name, r"\([^)]*\)", "")), display_label(subcategory), display_label(category)]
    usable = [null_if(label, "") for label in labels]
    return F.coalesce(*(F.when(~label_key(c).isin("", *GENERIC_LABELS), c) for c in usable), *usable, F.lit("Unknown part"))


def part_options(df: DataFrame) -> DataFrame:
    """The distinct parts of (subcategory, part_name) as they are offered: their raw labels, type, side and position."""
    own = df.select("subcategory", "part_name").distinct()
    side, position = side_and_position(F.col("part_name"), F.col("subcategory"))
    kind = part_type(F.col("part_name"), F.col("subcategory"), F.lit(None).cast("string"))
    return own.select(F.col("subcategory").alias("raw_subcategory"), F.col("part_name").alias("raw_part_name"), kind.alias("display_part_type"), side.alias("display_side"), position.alias("display_position"))


def shown_number(c: Column, digits: int = 0) -> Column:
    """A number with spaces between thousands."""
    return F.regexp_replace(F.format_number(c, digits), ",", " ")


# Features under other names than their own.
FEATURE_LABELS = {
    "subcategory": "Part type / placement",
    "part_name": "Specific part label",
    "category": "Part group",
    "year_start": "Compatible year start",
    "year_end": "Compatible year end",
    "year_mid": "Vehicle generation midpoint",
    "year_span": "Compatible year span",
    "oem_number": "OEM number",
    "mileage": "Mileage",
    "model": "Vehicle model",
    "brand": "Vehicle brand",
    "quality_grade": "Quality grade",
}


def feature_label(c: Column) -> Column:
    """A feature's name as shown; a null is the empty text."""
    known = F.create_map(*(F.lit(x) for kv in FEATURE_LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, c), display_label(F.replace(c, F.lit("_"), F.lit(" "))), F.lit(""))


def feature_value(feature: Column, value: Column) -> Column:
    """A feature's value, a text, as shown: whole years, half a year at most, kilometres with spaces, labels, `Missing`.

    A number that is none is shown as it is.
    """
    number = value.try_cast("double")
    whole = F.format_string("%d", number.cast("long"))
    middle = F.when(number == F.floor(number), whole).otherwise(F.format_string("%.1f", number))
    kilometres = F.concat(shown_number(number.cast("long")), F.lit(" km"))
    special = F.when(feature.isin("year_start", "year_end"), whole).when(feature == "year_mid", middle).when(feature == "mileage", kilometres)
    plain = F.when(feature.isin("year_start", "year_end", "year_mid", "mileage"), value).otherwise(display_label(value))
    return F.when(value.isNull() | F.coalesce(F.isnan(number), F.lit(False)), "Missing").otherwise(F.coalesce(special, plain))


def url_key(c: Column) -> Column:
    return F.lower(F.coalesce(F.try_url_decode(c), c))


def url_join(base: str, href: Column) -> Column:
    root = re.match(r"https?://[^/]+", base)[0]
    return F.when(href.rlike("^https?://"), href).when(href.startswith("/"), F.concat(F.lit(root), href)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), href))
