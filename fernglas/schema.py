"""Frozen schemas. Missing values are SQL NULL, never NaN."""

from pyspark.sql import types as T

_TEXT = ["photo_id", "photo_image_url", "photo_url", "photographer_first_name", "photographer_last_name"]
_CAPTIONS = ["blur_hash", "photo_description", "ai_description"]
EXIF_FIELDS = [T.StructField("aperture", T.DoubleType()), T.StructField("focal_length", T.DoubleType()), T.StructField("exposure_s", T.DoubleType()), T.StructField("iso", T.IntegerType()), T.StructField("camera_make", T.StringType()), T.StructField("camera_model", T.StringType())]
EXIF = [f.name for f in EXIF_FIELDS]


def _strings(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


#: Display columns and typed camera data.
PHOTOS = T.StructType([*_strings(_TEXT), T.StructField("photo_width", T.IntegerType()), T.StructField("photo_height", T.IntegerType()), *_strings(_CAPTIONS), *EXIF_FIELDS])
#: The raw table as it comes: display columns and camera strings.
RAW_EXIF = ["exif_aperture_value", "exif_focal_length", "exif_exposure_time", "exif_iso", "exif_camera_make", "exif_camera_model"]
RAW_PHOTOS = T.StructType([*PHOTOS.fields[:10], *_strings(RAW_EXIF)])
#: What the display tier needs: one photographer column, no captions.
SLIM = ["photo_id", "photo_image_url", "photo_url", "photographer", "photo_width", "photo_height", "blur_hash", *EXIF]
RESULT = ["photo_id", "score", "photo_image_url", "photo_url", "photographer", "width", "height", "blur_hash", "description", "ai_description", *EXIF]
SCANNED = T.StructType([T.StructField("path", T.StringType()), T.StructField("mtime", T.DoubleType()), T.StructField("size", T.LongType()), T.StructField("photo_id", T.StringType())])
MANIFEST = T.StructType(
    [
        T.StructField("photo_id", T.StringType()),
        *SCANNED.fields[:3],
        *_strings(["photo_image_url", "photo_url", "photographer"]),
        T.StructField("photo_width", T.LongType()),
        T.StructField("photo_height", T.LongType()),
        *_strings(_CAPTIONS),
        *EXIF_FIELDS,
        T.StructField("taken_at", T.StringType()),
    ]
)
JUDGMENTS = T.MapType(T.StringType(), T.StructType([T.StructField("query", T.StringType()), T.StructField("bucket", T.StringType()), T.StructField("judged", T.ArrayType(T.StringType())), T.StructField("relevant", T.ArrayType(T.StringType()))]))
QUERIES = T.StructType([T.StructField("id", T.StringType()), T.StructField("bucket", T.StringType()), T.StructField("query", T.StringType()), T.StructField("rephrasings", T.ArrayType(T.StringType()))])

#: Where the service's paths begin, in the URLs of rows and on the server.
API = "/api"
