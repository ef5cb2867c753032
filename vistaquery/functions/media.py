"""Small functions about media files, requests and descriptions."""

from __future__ import annotations

import hashlib
import json
import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blank_to_null

#: Extensions by kind, MIME types, and those that a browser of the gallery shows.
IMAGES = ["jpg", "jpeg", "png", "webp", "heic", "heif", "avif", "tif", "tiff", "bmp", "svg"]
VIDEOS = ["mp4", "mpeg", "mov", "avi", "x-flv", "mpg", "webm", "wmv", "3gpp"]
MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "bmp": "image/bmp", "heic": "image/heic",
    "heif": "image/heif", "avif": "image/avif", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml", "mp4": "video/mp4",
    "mpeg": "video/mpeg", "mov": "video/quicktime", "avi": "video/x-msvideo", "x-flv": "video/x-flv", "mpg": "video/mpeg",
    "webm": "video/webm", "wmv": "video/x-ms-wmv", "3gpp": "video/3gpp",
}
GALLERY_IMAGES = ["avif", "jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff", "heic", "heif"]
GALLERY_VIDEOS = ["mp4", "mpeg", "mov", "avi", "mpg", "webm", "wmv", "3gpp"]
COMPATIBLE = ["jpg", "jpeg", "png", "webp", "heic", "heif", *VIDEOS]
#: Descriptions in a request by rigor, request limits and overheads in bytes.
BATCH_SIZES = {"very low": 50, "low": 20, "medium": 10, "high": 5, "very high": 2, "extreme": 1}
MAX_INLINE_BYTES = 18 * 1024 * 1024
TEXT_OVERHEAD, PART_OVERHEAD, CONTAINER_OVERHEAD = 64, 128, 512
#: Embedded metadata that is kept.
EXIF_KEYS = [
    "Filename", "Ext", "MimeType", "DateItems", "DateTime", "DateTimeOriginal", "DateTimeDigitized", "OffsetTime", "OffsetTimeOriginal",
    "OffsetTimeDigitized", "SubsecTime", "SubsecTimeOriginal", "SubsecTimeDigitized", "GPSDateStamp", "GPSTimeStamp", "GPSLatitude", "GPSLatitudeRef",
    "GPSLongitude", "GPSLongitudeRef", "GPSAltitude", "GPSAltitudeRef", "GPSImgDirection", "GPSImgDirectionRef", "GPSDestBearing",
    "GPSDestBearingRef", "GPSAreaInformation", "DigitalZoomRatio", "XResolution", "YResolution", "ExifImageWidth", "ExifImageHeight",
    "SceneCaptureType", "Make", "Model", "LensMake", "LensModel", "Orientation", "FNumber", "FocalLength", "ApertureValue", "Flash", "ExposureTime",
    "ShutterSpeedValue", "Software", "ImageDescription", "UserComment", "SceneType", "SubjectArea", "SubjectLocation", "AmbientTemperature",
    "Humidity", "Pressure", "SubjectDistance", "Artist", "Copyright", "Rating", "ISO", "ISOSpeedRatings", "XPTitle", "XPComment", "XPAuthor",
    "XPKeywords", "XPSubject",
]


def media_type(ext: Column) -> Column:
    return F.when(ext.isin(IMAGES), "image").when(ext.isin(VIDEOS), "video").otherwise("")


def mime_type(ext: Column, kind: Column) -> Column:
    """By table, else what Python's own table has for the extension, else kind/ext, else empty."""
    known = {e[1:]: t for e, t in mimetypes.MimeTypes(()).types_map[1].items()} | MIME
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.try_element_at(table, ext), F.when((kind != "") & (ext != ""), F.concat_ws("/", kind, ext)), F.lit(""))


def compatible(ext: Column) -> Column:
    """Whether a model takes files of that kind as they are."""
    return F.coalesce(ext.isin(COMPATIBLE), F.lit(False))


def model_hash(api: str, model: str) -> str:
    return hashlib.sha1(f"{api}{model}".encode()).hexdigest()


def entry_id(file_hash: Column, api: str, model: str) -> Column:
    return F.concat_ws("_", file_hash, F.sha1(F.lit(f"{api}{model}").cast("binary")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.]\.([^./]+)$", 1))


def fit_size(width: Column, height: Column, max_width: int, max_height: int) -> tuple[Column, Column]:
    """Width and height within the bounds (0 or less: 10,000; both: no bound), never larger and at least 1."""
    if max_width <= 0 and max_height <= 0:
        return width, height
    scale = F.least((max_width if max_width > 0 else 10000) / width, (max_height if max_height > 0 else 10000) / height, F.lit(1.0))
    return tuple(F.greatest(F.lit(1), F.floor(x * scale)).cast("int") for x in (width, height))


def base64_size(n: Column) -> Column:
    return F.floor((n + 2) / 3) * 4


def item_bytes(prompt: Column, payload: Column, mime: Column) -> Column:
    """What an item adds to a request."""
    return prompt + TEXT_OVERHEAD + base64_size(payload) + mime + PART_OVERHEAD


def base_bytes(admin: int, prompt: int) -> int:
    return admin + prompt + 2 * TEXT_OVERHEAD + CONTAINER_OVERHEAD


def rigor(c: Column) -> Column:
    """A known rigor, else very low."""
    name = F.lower(F.trim(c))
    return F.when(name.isin(list(BATCH_SIZES)), name).otherwise("very low")


def batch_size(c: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in BATCH_SIZES.items() for x in pair))[rigor(c)]


def display_name(name: Column, path: Column, entry: Column) -> Column:
    return F.coalesce(blank_to_null(name), blank_to_null(base_name(path)), entry)


def display_ext(ext: Column, path: Column) -> Column:
    return F.lower(F.coalesce(blank_to_null(ext), extension(base_name(path))))


def search_key(query, filters: dict | None, ids: list | None) -> str:
    """Of a search, whatever the order of its filters' names."""
    return hashlib.sha256(json.dumps({"filters": filters, "ids": ids, "query": query}, sort_keys=True, default=str).encode()).hexdigest()


def whitelisted(tags: Column, kind: T.MapType) -> Column:
    """The tags whose names are EXIF_KEYS, at any depth of nested maps; nested maps that keep nothing go."""
    if isinstance(kind.valueType, T.MapType):
        return F.map_filter(F.transform_values(tags, lambda _, v: whitelisted(v, kind.valueType)), lambda _, v: F.size(v) > 0)
    return F.map_filter(tags, lambda k, _: k.isin(EXIF_KEYS))


def merge_embedded(exif: Column, png: Column, xmp: Column) -> Column:
    """Embedded tags as one map: PNG text before EXIF, XMP where neither has the tag.  Blank PNG and XMP texts don't count."""
    texts = lambda m: F.map_filter(F.transform_values(m, lambda _, v: F.trim(v)), lambda _, v: F.length(v) > 0)
    either = lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, y))
    merged = either(either(texts(png), F.map_filter(exif, lambda _, v: v.isNotNull())), texts(xmp))
    return F.map_filter(merged, lambda _, v: v.isNotNull())
