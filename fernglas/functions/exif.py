"""Messy camera strings to typed values, as Column expressions. Dirty input gives NULL, never an error or NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first number in a string, and what counts as one whole number.
NUMBER = r"[-+]?\d*\.?\d+"
WHOLE_NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
_EDGES = r"(?U)^\s+|\s+$"


def clean(raw: Column) -> Column:
    """Without white space at the ends; blank: NULL."""
    return F.nullif(F.regexp_replace(raw, _EDGES, ""), F.lit(""))


def first_number(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(clean(raw), NUMBER, 0), F.lit("")).try_cast("double")


def _positive(number: Column) -> Column:
    return F.when((number > 0) & ~F.isnan(number), number)


def parse_aperture(raw: Column) -> Column:
    """'f/1.8', 'F2.0', '1.8' -> DOUBLE."""
    return _positive(first_number(raw))


def parse_focal_length(raw: Column) -> Column:
    """'35', '35.0mm', '135 mm' -> DOUBLE."""
    return _positive(first_number(raw))


def parse_iso(raw: Column) -> Column:
    """Rounded half to even; tested for being positive before it is rounded."""
    return F.bround(_positive(first_number(raw))).cast("int")


def _whole(raw: Column) -> Column:
    return F.when(raw.rlike(WHOLE_NUMBER), F.trim(raw).try_cast("double"))


def parse_exposure(raw: Column) -> Column:
    """'1/250', '0.5', '1/250 s' -> seconds; only a trailing s is a unit."""
    text = F.regexp_replace(F.regexp_replace(clean(raw), "[sS]+$", ""), _EDGES, "")
    parts = F.split(text, "/", 2)
    fraction = F.try_divide(_whole(F.get(parts, F.lit(0))), F.nullif(_whole(F.get(parts, F.lit(1))), F.lit(0.0)))
    return _positive(F.when(F.contains(text, F.lit("/")), fraction).otherwise(_whole(text)))


def title_case(text: Column) -> Column:
    """Upper case after every non-letter, not only after spaces."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2), F.length(r))))), "")


def normalize_model(raw: Column) -> Column:
    return F.regexp_replace(clean(raw), r"(?U)\s+", " ")


def normalize_make(raw: Column) -> Column:
    return title_case(normalize_model(raw))


def fraction(num: Column, den: Column) -> Column:
    """A rational; NULL where the denominator is 0."""
    return F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0)))


def rational(values: Column) -> Column:
    """array<double>: two numbers are a fraction, else the first one counts."""
    return F.when(F.size(values) == 2, fraction(F.get(values, F.lit(0)), F.get(values, F.lit(1)))).otherwise(F.get(values, F.lit(0)))


def pick_tag(sub: Column, main: Column, tag: int) -> Column:
    """A tag of the sub-directory, else of the main one (maps by tag number)."""
    return F.coalesce(F.try_element_at(sub, F.lit(tag)), F.try_element_at(main, F.lit(tag)))


def tag_text(raw: Column) -> Column:
    """Text of a tag without NUL bytes."""
    return clean(F.regexp_replace(raw, "\\x00", ""))


def parse_taken_at(raw: Column) -> Column:
    """Zone-less text '2024-07-14 18:32:01' of '2024:07:14 18:32:01' or '2024-07-14 18:32:01'; parts but the year may have
    one digit."""
    text = F.regexp_replace(tag_text(raw), r"\s+", " ")
    clock = r" \d{1,2}:\d{1,2}:\d{1,2}$"
    stamp = lambda mark: F.when(text.rlike(rf"^\d{{4}}{mark}\d{{1,2}}{mark}\d{{1,2}}{clock}"), F.try_to_timestamp(text, F.lit(f"yyyy{mark}M{mark}d H:m:s")).cast("timestamp_ntz"))
    return F.date_format(F.coalesce(stamp(":"), stamp("-")), "yyyy-MM-dd HH:mm:ss")


def number_or_null(value: Column) -> Column:
    """NaN becomes NULL, so that no comparison lets a missing number through."""
    return F.when(~F.isnan(value), value)


#: Typed column of each raw one.
PARSERS = {
    "aperture": ("exif_aperture_value", parse_aperture),
    "focal_length": ("exif_focal_length", parse_focal_length),
    "exposure_s": ("exif_exposure_time", parse_exposure),
    "iso": ("exif_iso", parse_iso),
    "camera_make": ("exif_camera_make", normalize_make),
    "camera_model": ("exif_camera_model", normalize_model),
}
