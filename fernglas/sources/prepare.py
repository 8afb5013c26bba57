"""Raw metadata to typed rows and the slim export."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exif import PARSERS
from ..functions.text import slim_photographer
from ..schema import PHOTOS, SLIM


def parse_exif(raw: DataFrame) -> DataFrame:
    """``raw`` with typed camera columns in place of its camera strings."""
    return raw.withColumns({name: parse(F.col(source)) for name, (source, parse) in PARSERS.items()}).drop(*(s for s, _ in PARSERS.values()))


def clean(raw: DataFrame) -> DataFrame:
    """The photos table: ten display columns and six typed camera columns."""
    typed = parse_exif(raw)
    return typed.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in PHOTOS.fields))


def slim(photos: DataFrame) -> DataFrame:
    who = slim_photographer(F.col("photographer_first_name"), F.col("photographer_last_name"))
    return photos.withColumn("photographer", who).select(*SLIM)
