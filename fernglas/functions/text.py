"""Text, identifiers and presentation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exif import clean

#: Fixed values of the presentation layer.
STRONG, DECENT, WEAK_PAGE = 0.28, 0.24, 0.26


def tokenize(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, single characters dropped."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: F.length(t) > 1)


def caption(ai: Column, photo: Column) -> Column:
    return F.concat(F.coalesce(ai, F.lit("")), F.lit(" "), F.coalesce(photo, F.lit("")))


def short_caption(ai: Column, photo: Column, length: int = 64) -> Column:
    return F.substring(F.coalesce(F.nullif(ai, F.lit("")), F.nullif(photo, F.lit("")), F.lit("")), 1, length)


def photographer(one: Column | None, first: Column, last: Column) -> Column:
    """The named photographer, else first and last name (either may lack), else 'Unknown'."""
    names = F.nullif(F.concat_ws(" ", clean(first), clean(last)), F.lit(""))
    return F.coalesce(*([clean(one)] if one is not None else []), names, F.lit("Unknown"))


def slim_photographer(first: Column, last: Column) -> Column:
    """For the slim export: joined first, trimmed then."""
    return F.coalesce(clean(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))), F.lit("Unknown"))


def photo_id_for(path: Column) -> Column:
    """The first 16 hex digits of the path's SHA-1."""
    return F.substring(F.sha1(path.cast("binary")), 1, 16)


def parse_numbers(raw: Column) -> Column:
    """'1,4,7-9' -> sorted distinct integers; a range that runs down is empty."""

    def expand(part: Column) -> Column:
        ends = F.transform(F.split(part, "-"), lambda x: F.trim(x).try_cast("int"))
        low, high = F.get(ends, F.lit(0)), F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0)))
        return F.when((low <= high), F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(F.split(raw, ","), lambda p: F.trim(p) != ""), expand))))


def verdict(score: Column) -> Column:
    return F.when(score >= STRONG, "strong").when(score >= DECENT, "decent").otherwise("weak")


def aspect(width: Column, height: Column) -> Column:
    """Height as a percentage of width, from 40 to 160; unknown: 66.7."""
    share = F.try_divide(height * 100.0, width)
    return F.when(share.isNull(), F.lit(66.7)).otherwise(F.greatest(F.lit(40.0), F.least(F.lit(160.0), share)))


def plain_number(x: Column) -> Column:
    """A number as %g prints it (six significant digits, no trailing zeros); for values from 1e-4 to 1e6."""
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.abs(x))).cast("int"))
    rounded = F.round(x * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    return F.when(x.isNotNull(), F.regexp_replace(F.regexp_replace(F.format_string("%.9f", rounded), r"0+$", ""), r"\.$", ""))


def shutter(seconds: Column) -> Column:
    return F.when(seconds >= 1, F.concat(plain_number(seconds), F.lit("s"))).when(seconds > 0, F.concat(F.lit("1/"), F.bround(1 / seconds).cast("int").cast("string"), F.lit("s")))


def exif_line(make: Column, model: Column, focal: Column, aperture: Column, exposure: Column, iso: Column) -> Column:
    return F.concat_ws(" · ", clean(F.concat_ws(" ", make, model)), F.concat(plain_number(focal), F.lit("mm")), F.concat(F.lit("f/"), plain_number(aperture)), shutter(exposure), F.concat(F.lit("ISO "), iso.cast("string")))


def cli_line(rank: Column, score: Column, who: Column, focal: Column, aperture: Column, iso: Column) -> Column:
    """A fixed-width line of the command line's list."""
    values = F.concat_ws(" ", F.concat(F.lit("f/"), plain_number(aperture)), F.concat(plain_number(focal), F.lit("mm")), F.concat(F.lit("ISO"), iso.cast("string")))
    return F.concat_ws("  ", F.lpad(rank.cast("string"), 2, " "), F.format_string("%.3f", score), F.rpad(F.substring(who, 1, 22), 22, " "), values)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def sized_url(url: Column, width: int) -> Column:
    """Size parameters only for web addresses."""
    return F.when(url.rlike("^https?:"), F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit(f"w={width}&q=80&fm=jpg"))).otherwise(url)


def credited_url(url: Column, source: str) -> Column:
    return F.when(url.rlike("^https?:"), F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit(f"utm_source={source}&utm_medium=referral"))).otherwise(url)


def score_text(score: Column) -> Column:
    return F.regexp_replace(F.format_string("%.3f", score), "^0", "")


def parent_folder(path: Column) -> Column:
    return F.coalesce(F.nullif(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit("")), F.lit("Local library"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
