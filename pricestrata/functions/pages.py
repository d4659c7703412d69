"""Fields of a listing's page, each by the first of several patterns that matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numeric import decimal_number
from .text import clean_part_name, null_if, strip, url_key

# The patterns of the site's texts, in the order in which they are tried.
QUALITY = [
    r"Laatu:\s*([A-C][1-3]?)",
    r"Quality(?:\s*grade)?\s*:?\s*([A-C][1-3]?)",
    r"Condition\s*:?\s*([A-C][1-3]?)",
]
OEM = [
    r"(?:alkuperäinen|oem)\s*(?:nro|numero|num)\s*:?\s*([A-Z0-9\-/]{6,20})",
    r"(?:original|oem)\s*(?:no|number|num)\s*:?\s*([A-Z0-9\-/]{6,20})",
    r"oem[:\-]?\s*([A-Z0-9\-/]{6,20})",
    r"pn[:\-]?\s*([A-Z0-9\-/]{6,20})",
    r"([A-Z]{2,4}\d{4,8}[A-Z\-]?)",
]
ENGINE = [
    r"Moottorin\s+koodi\s*:?\s*([A-Z0-9-]+)",
    r"moottorik[oö]{2}di\s*:?\s*([A-Z0-9-]+)",
    r"Moottori\s*:?\s*([A-Z]{1,2}\d{1,2}[A-Z]{0,3})",
    r"Engine\s+code\s*:?\s*([A-Z0-9-]+)",
    r"Engine\s*:?\s*code\s*([A-Z0-9-]+)",
]
MILEAGE = [
    r"lukema(?:t)?\s*\(km\)\s*[:\-]?\s*([0-9][0-9\s\.,]{0,12})",
    r"lukema(?:t)?\s*([0-9][0-9\s\.,]{0,12})\s*km?",
    r"(\d{1,3}(?:\s|\.)?\d{3})\s*km",
    r"(\d{1,7})\s*km",
    r"matkamittari\s*[:\-]?\s*([0-9][0-9\s\.,]{0,12})",
    r"Mileage\s*\(km\)\s*[:\-]?\s*([0-9][0-9\s\.,]{0,12})",
    r"Mileage\s*[:\-]?\s*([0-9][0-9\s\.,]{0,12})\s*km?",
    r"Odometer\s*[:\-]?\s*([0-9][0-9\s\.,]{0,12})\s*km?",
]
# The categories that are followed.
CATEGORIES = (
    "Brakes",
    "Engine",
    "Airbag",
    "Gear box / Drive axle / Middle axle",
    "Fuel",
    "Electric / Transmitter / Databox / Sensor",
    "Vehicle exterior / Suspension",
)


def found(text: Column, pattern: str) -> Column:
    return null_if(F.regexp_extract(text, f"(?iU){pattern}", 1), "")


def page_text(html: Column) -> Column:
    """A page without its tags."""
    plain = F.regexp_replace(html, "<[^>]*>", "")
    for entity, c in (("&nbsp;", "\xa0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(c))
    return plain


def part_name(html: Column) -> Column:
    """The first heading; without one the title before a bar, or else before a hyphen."""
    heading = null_if(strip(page_text(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))), "")
    title = page_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    cut = F.when(F.contains(title, F.lit("|")), F.get(F.split(title, r"\|"), F.lit(0))).otherwise(F.get(F.split(title, "-"), F.lit(0)))
    return F.coalesce(heading, null_if(strip(cut), ""))


def price(html: Column) -> Column:
    """The price of the page's embedded offer."""
    body = F.regexp_extract(html, r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1)
    return decimal_number(F.get_json_object(body, "$.offers.price"))


def quality(text: Column) -> Column:
    return F.coalesce(*(found(text, p) for p in QUALITY))


def years(text: Column) -> Column:
    one = lambda i: F.regexp_extract(text, r"\((\d{4})\s*-\s*(\d{4})\)", i)
    return F.when(one(1) != "", F.concat(one(1), F.lit("-"), one(2)))


def first_oem(*matches: Column) -> Column:
    """The first of OEM's matches that is fine."""

    def one(match: Column) -> Column:
        c = F.regexp_replace(F.upper(match), r"(?U)[^\w\-/]", "")
        return F.when(F.length(c).between(6, 20), c)

    return F.coalesce(*map(one, matches))


def first_engine(*matches: Column) -> Column:
    """The first of ENGINE's matches that is fine."""

    def one(match: Column) -> Column:
        c = strip(match)
        fine = F.length(c).between(3, 8) & c.rlike("[A-Za-z]") & c.rlike("[0-9]") & ~c.rlike("^(19|20)")
        return F.when(fine, F.upper(F.replace(c, F.lit("-"), F.lit(""))))

    return F.coalesce(*map(one, matches))


def oem_number(text: Column) -> Column:
    return first_oem(*(found(text, p) for p in OEM))


def engine_code(text: Column) -> Column:
    return first_engine(*(found(text, p) for p in ENGINE))


def mileage(text: Column) -> Column:
    return F.coalesce(*(null_if(F.regexp_replace(found(text, p), r"[^\d]", ""), "").try_cast("bigint") for p in MILEAGE))


def parsed(pages: DataFrame, brand: Column | None = None, model: Column | None = None) -> DataFrame:
    """pages (page_id, url, html) with the fields of each; pages that were refused have none.

    A part's name is cleaned of brand and model where these are given (columns of pages, or literals).
    The page's text, and then every pattern's match, are columns of projections of their own, so each is
    worked out once a page.
    """
    refused = F.coalesce(F.col("html").rlike(r"(?is)<title[^>]*>\s*403"), F.lit(False)) | (F.coalesce(strip(F.col("html")), F.lit("")) == "")
    none = F.lit(None).cast("string")
    own = pages.where(~refused).select(
        "page_id", "url", price(F.col("html")).alias("price"), page_text(F.col("html")).alias("text"),
        part_name(F.col("html")).alias("name"), (none if brand is None else brand).alias("brand"), (none if model is None else model).alias("model"))
    oem, engine = ([found(F.col("text"), p).alias(f"{kind}_{i}") for i, p in enumerate(patterns)] for kind, patterns in (("oem", OEM), ("engine", ENGINE)))
    text = F.col("text")
    own = own.select("page_id", "url", "price", "name", "brand", "model", quality(text).alias("quality_grade"), years(text).alias("year"), mileage(text).alias("mileage"), *oem, *engine)
    cleaned = F.when(F.coalesce("brand", "model").isNull(), F.col("name")).otherwise(clean_part_name(F.col("name"), F.col("brand"), F.col("model")))
    at = lambda kind, patterns: [F.col(f"{kind}_{i}") for i in range(len(patterns))]
    return own.select("page_id", "url", cleaned.alias("part_name"), "price", "quality_grade", "year", first_oem(*at("oem", OEM)).alias("oem_number"), first_engine(*at("engine", ENGINE)).alias("engine_code"), "mileage")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, href): every link of every page."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"""(?is)<a\s[^>]*href=["']([^"']+)["']"""), F.lit(1))).alias("href"))


def product_links(found_links: DataFrame) -> DataFrame:
    """(product_id, page_id, href): the first link, by page and then text, of each product."""
    own = found_links.withColumn("product_id", null_if(F.regexp_extract("href", r"ID-(\d+)", 1), "")).where("product_id is not null")
    order = F.row_number().over(Window.partitionBy("product_id").orderBy("page_id", "href"))
    return own.withColumn("order", order).where("order = 1").select("product_id", "page_id", "href")


def category_links(found_links: DataFrame, brand: str, model: str, blacklist: list[str] = ()) -> DataFrame:
    """Links to a vehicle's part categories: not on the blacklist, no filter suffix, naming brand or model."""
    u = url_key(F.col("href"))
    bad = F.lit(False)
    for word in blacklist:
        bad = bad | F.contains(u, F.lit(word.lower()))
    named = F.contains(u, F.lit(brand.lower())) | F.contains(u, F.lit(model.lower()))
    return found_links.where(~bad & ~u.rlike(r"/s\d+$") & F.contains(u, F.lit("car-parts")) & named).distinct()


def wanted_category(c: Column) -> Column:
    return F.lower(strip(c)).isin(*(x.lower() for x in CATEGORIES))


def capped_crawl(listings: DataFrame, most: int = 5) -> DataFrame:
    """Of each (category, subcategory) the first `most` products by page, each product only where it was first seen."""
    seen = F.row_number().over(Window.partitionBy("product_id").orderBy("page_id"))
    order = F.row_number().over(Window.partitionBy("category", "subcategory").orderBy("page_id", "product_id"))
    return listings.withColumn("seen", seen).where("seen = 1").drop("seen").withColumn("place", order).where(F.col("place") <= most)
