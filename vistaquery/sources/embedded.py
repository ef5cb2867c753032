"""Embedded metadata of images: PNG text, EXIF directories and XMP packets, read from the files' bytes.

A small reader takes the raw tags out of each file's chunks or segments, in batches of rows; which
names count, what the dates are and which source wins are column expressions."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import embedded_forms, exif_text, format_datetime, gps_text
from ..functions.media import EXIF_KEYS, mime_type
from ..functions.text import strip
from ..operators.zones import degrees, local_time, zone_of
from .shared import written

#: Names of the tags of an image's first directory, of its EXIF and of its GPS directory.
IMAGE_TAGS = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist",
    0x4746: "Rating", 0x8298: "Copyright", 0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9D: "XPAuthor", 0x9C9E: "XPKeywords", 0x9C9F: "XPSubject",
}
EXIF_TAGS = {
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime", 0x9011: "OffsetTimeOriginal",
    0x9012: "OffsetTimeDigitized", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9206: "SubjectDistance", 0x9209: "Flash", 0x920A: "FocalLength", 0x9286: "UserComment",
    0x9290: "SubsecTime", 0x9291: "SubsecTimeOriginal", 0x9292: "SubsecTimeDigitized", 0x9400: "AmbientTemperature", 0x9401: "Humidity", 0x9402: "Pressure", 0xA002: "ExifImageWidth",
    0xA003: "ExifImageHeight", 0xA214: "SubjectLocation", 0xA301: "SceneType", 0xA404: "DigitalZoomRatio", 0xA406: "SceneCaptureType", 0xA433: "LensMake", 0xA434: "LensModel",
}
GPS_TAGS = {
    0x01: "GPSLatitudeRef", 0x02: "GPSLatitude", 0x03: "GPSLongitudeRef", 0x04: "GPSLongitude", 0x05: "GPSAltitudeRef", 0x06: "GPSAltitude", 0x07: "GPSTimeStamp", 0x10: "GPSImgDirectionRef",
    0x11: "GPSImgDirection", 0x17: "GPSDestBearingRef", 0x18: "GPSDestBearing", 0x1C: "GPSAreaInformation", 0x1D: "GPSDateStamp",
}
EXIF_DIRECTORY, GPS_DIRECTORY = 0x8769, 0x8825
#: Where PNG texts and XMP properties go, and which of them are dates, with their priority.
PNG_TEXTS = {"author": "Artist", "comment": "UserComment", "copyright": "Copyright", "description": "ImageDescription", "software": "Software"}
PNG_DATES = {
    "creation time": ("DateTimeOriginal", 100), "date:create": ("DateTimeOriginal", 90), "date:modify": ("DateTime", 90),
    "modification time": ("DateTime", 100), "modify time": ("DateTime", 95), "date:timestamp": ("DateTimeDigitized", 80),
}
XMP_TEXTS = {"artist": "Artist", "creator": "Artist", "copyright": "Copyright", "description": "ImageDescription", "rights": "Copyright", "title": "ImageDescription"}
XMP_DATES = {
    "createdate": ("DateTimeOriginal", 100), "datecreated": ("DateTimeOriginal", 95), "datetimeoriginal": ("DateTimeOriginal", 100),
    "modifydate": ("DateTime", 100), "metadatadate": ("DateTimeDigitized", 90),
}
READABLE = ("jpg", "jpeg", "png", "heif", "heic")

#: TIFF types: bytes of a value, and its struct code (rationals are two numbers).
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
RAW = "png array<struct<key:string,value:string>>, image map<string,string>, exif map<string,string>, gps map<string,string>, xmp array<struct<key:string,value:string>>"


def decode(data: bytes) -> str:
    """Text of unknown encoding; UTF-16 is likely where there are zeros."""
    for encoding in ("utf-16le", "utf-8", "latin-1") if b"\0" in data else ("utf-8", "utf-16le", "latin-1"):
        try:
            return data.decode(encoding).strip("\0").strip()
        except UnicodeDecodeError:
            continue
    return ""


def _directory(data: bytes, order: str, at: int, names: dict[int, str]) -> dict[str, str]:
    """The named tags of the directory at an offset, as text; several numbers are a JSON list.  Tags that point outside are left out."""
    out: dict[str, str] = {}
    if at + 2 > len(data):
        return out
    (n,) = struct.unpack_from(f"{order}H", data, at)
    for k in range(min(n, (len(data) - at - 2) // 12)):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        if tag not in names or kind not in _TYPES:
            continue
        size, code = _TYPES[kind]
        place = at + 10 + 12 * k
        if size * count > 4:
            (place,) = struct.unpack_from(f"{order}I", data, place)
        if place + size * count > len(data):
            continue
        if kind == 2:
            text = data[place : place + count].decode("latin-1").strip("\0").strip()
        elif kind == 7 or (kind == 1 and names[tag].startswith("XP")):
            text = decode(data[place : place + count])
        else:
            flat = struct.unpack_from(f"{order}{len(code) * count}{code[0]}", data, place)
            values = [a / b if b else None for a, b in zip(flat[::2], flat[1::2])] if len(code) == 2 else list(flat)
            text = json.dumps(values if len(values) > 1 else values[0]) if values and None not in values else ""
        if text:
            out[names[tag]] = text
    return out


def read_tiff(data: bytes) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """The tags of the image, of EXIF and of GPS."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if not order or len(data) < 8:
        return {}, {}, {}
    (first,) = struct.unpack_from(f"{order}I", data, 4)
    image = _directory(data, order, first, IMAGE_TAGS | {EXIF_DIRECTORY: "exif", GPS_DIRECTORY: "gps"})
    below = lambda name, names: _directory(data, order, int(at), names) if (at := image.pop(name, "")).isdigit() else {}
    return image, below("exif", EXIF_TAGS), below("gps", GPS_TAGS)


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        if at + 12 + n > len(data):
            return
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def jpeg_segments(data: bytes) -> Iterator[bytes]:
    """The application segments before the picture."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
        (n,) = struct.unpack_from(">H", data, at + 2)
        if data[at + 1] == 0xE1:
            yield data[at + 4 : at + 2 + n]
        at += 2 + max(n, 2)


def _png_text(kind: bytes, body: bytes, limit: int = 1 << 20) -> tuple[str, str] | None:
    """Key and value of a text chunk; compressed ones of up to limit bytes."""
    key, _, rest = body.partition(b"\0")
    inflate = lambda x: zlib.decompressobj().decompress(x, limit)
    try:
        if kind == b"tEXt":
            value = rest.decode("latin-1")
        elif kind == b"zTXt":
            value = inflate(rest[1:]).decode("latin-1")
        else:
            text = rest[2:].split(b"\0", 2)[2]
            value = (inflate(text) if rest[:1] == b"\1" else text).decode()
    except (zlib.error, UnicodeDecodeError, IndexError):
        return None
    return key.decode("latin-1"), value


def read_xmp(packet: bytes) -> list[tuple[str, str]]:
    """Name (without its namespace, lower-case) and text of each attribute and each plain element, in order; none if it is no XML, or has a DTD."""
    packet = packet.strip(b"\0 \t\r\n")
    if b"<!DOCTYPE" in packet or b"<!ENTITY" in packet:
        return []
    try:
        root = ElementTree.fromstring(packet)
    except (ElementTree.ParseError, ValueError, LookupError):
        return []
    out: list[tuple[str, str]] = []
    name = lambda x: x.rpartition("}")[2].rpartition(":")[2].lower()
    for node in root.iter():
        out += [(name(k), v.strip()) for k, v in node.attrib.items()]
        if len(node) == 0 and (node.text or "").strip():
            out.append(("text" if node.attrib else name(node.tag), node.text.strip()))
    return [(k, v) for k, v in out if v]


def read_raw(content: bytes) -> dict:
    """The raw tags of a PNG or JPEG file; of others, and of damaged ones, what can be read."""
    png, xmp, tiff = [], [], ({}, {}, {})
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        for kind, body in png_chunks(content):
            if kind in (b"tEXt", b"zTXt", b"iTXt") and (pair := _png_text(kind, body)):
                png.append(pair)
                if pair[0] == "XML:com.adobe.xmp":
                    xmp = read_xmp(pair[1].encode())
            elif kind == b"eXIf":
                tiff = read_tiff(body)
    elif content[:2] == b"\xff\xd8":
        for body in jpeg_segments(content):
            if body.startswith(b"Exif\0\0"):
                tiff = read_tiff(body[6:])
            elif body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
                xmp = read_xmp(body[29:])
    pairs = lambda x: [{"key": k, "value": v} for k, v in x]
    return {"png": pairs(png), "image": tiff[0], "exif": tiff[1], "gps": tiff[2], "xmp": pairs(xmp)}


def raw_tags(files: DataFrame) -> DataFrame:
    """files (file_hash, content) with the columns of RAW."""

    def run(frames):
        for pdf in frames:
            found = [read_raw(bytes(c) if c is not None else b"") for c in pdf["content"]]
            yield pd.DataFrame({"file_hash": pdf["file_hash"].to_numpy()} | {k: [x[k] for x in found] for k in ("png", "image", "exif", "gps", "xmp")})

    return files.select("file_hash", "content").mapInPandas(run, f"file_hash string, {RAW}")


def _texts(pairs: Column, names: dict[str, str], first: bool) -> Column:
    """Tag to text of the named keys; of several a PNG's last and an XMP's first value of a key counts, and of keys that share a tag the later one in names (XMP) or in the file (PNG)."""
    found = []
    for tag in dict.fromkeys(names.values()):
        keys = [k for k, t in names.items() if t == tag]
        if first:
            options = [F.try_element_at(F.filter(pairs, _named(k)), F.lit(1))["value"] for k in reversed(keys)]
        else:
            options = [F.try_element_at(F.filter(pairs, _named(*keys)), F.lit(-1))["value"]]
        found.append(F.struct(F.lit(tag).alias("key"), F.nullif(strip(F.coalesce(*options)), F.lit("")).alias("value")))
    return F.map_from_entries(F.filter(F.array(*found), lambda x: x["value"].isNotNull()))


def _named(*keys: str):
    return lambda p: F.lower(F.trim(p["key"])).isin(*keys) & (F.trim(p["value"]) != "")


#: The tags that date an image, with those of their fraction and offset.
_EXIF_DATES = {"DateTime": ("SubsecTime", "OffsetTime"), "DateTimeOriginal": ("SubsecTimeOriginal", "OffsetTimeOriginal"), "DateTimeDigitized": ("SubsecTimeDigitized", "OffsetTimeDigitized")}


def _dates(raw: DataFrame, latest: Column | None) -> DataFrame:
    """file_hash and dates, an array of source, tag and date: of keys that share a tag the one of the highest priority
    that holds a date counts, then the last.  Every text is a row, so each is read by one expression."""
    tagged = lambda pairs, source: F.transform(pairs, lambda p, i: F.named_struct(F.lit("name"), F.concat(F.lit(f"{source}:"), F.lower(F.trim(p["key"]))), F.lit("value"), p["value"], F.lit("i"), i))
    pairs = raw.select("file_hash", F.explode(F.concat(tagged("png", "png"), tagged("xmp", "xmp"))).alias("x"))
    named = [(f"{source}:{key}", F.struct(F.lit(source).alias("source"), F.lit(tag).alias("tag"), F.lit(priority).alias("priority"))) for source, names in (("png", PNG_DATES), ("xmp", XMP_DATES)) for key, (tag, priority) in names.items()]
    known = F.try_element_at(F.create_map(*(x for k, v in named for x in (F.lit(k), v))), F.col("x.name"))
    rows = pairs.withColumn("t", known).where("t is not null").select("file_hash", "t.source", "t.tag", "t.priority", "x.i", F.posexplode(F.array(*embedded_forms(F.col("x.value")))).alias("form", "text"))
    exif, gps = (lambda k: F.try_element_at("exif", F.lit(k))), (lambda k: F.try_element_at("gps", F.lit(k)))
    clock = F.coalesce(_numbers(gps("GPSTimeStamp")), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    texts = {k: exif_text(exif(k), exif(fraction), exif(offset)) for k, (fraction, offset) in _EXIF_DATES.items()}
    texts["GPSDateStamp"] = gps_text(gps("GPSDateStamp"), *(F.try_element_at(clock, F.lit(i)) for i in (1, 2, 3)))
    own = raw.select("file_hash", F.explode(F.array(*(F.struct(F.lit(k).alias("tag"), v.alias("text")) for k, v in texts.items()))).alias("x"))
    zero = lambda n: F.lit(0).alias(n)
    every = rows.unionByName(own.select("file_hash", F.lit("exif").alias("source"), "x.tag", zero("priority"), zero("i"), zero("form"), "x.text"))
    read = every.withColumn("date", format_datetime(F.col("text"), latest)).where("date is not null")
    best = read.groupBy("file_hash", "source", "tag").agg(F.max_by("date", F.struct("priority", "i", -F.col("form"))).alias("date"))
    return best.groupBy("file_hash").agg(F.collect_list(F.struct("source", "tag", "date")).alias("dates"))  # a few for each file


def _numbers(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def _first_of(*maps: Column) -> Column:
    """Of maps the first one's value of each key."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_zip_with(out, m, lambda _, a, b: F.coalesce(a, b))
    return out


def embedded_metadata(files: DataFrame, zones: DataFrame | None = None, latest: Column | None = None) -> DataFrame:
    """file_hash, tags, exif, gps and date_items (maps of text) of files (file_hash, file_name, ext, content).

    PNG text comes before the image's own tags, XMP after them; a PNG's dates replace those of EXIF,
    XMP's fill what is left.  GPS times are local where zones (zones.zone_of) hold their position.
    file_hash is unique; files of other kinds and unreadable ones have no tags but, if of a known
    kind, their name, extension and MIME type."""
    known = files.where(F.col("ext").isin(*READABLE))
    raw = raw_tags(known).join(known.select("file_hash", "file_name", "ext"), "file_hash")
    raw = written(raw, "tags")  # dates, positions and tags are taken from it, the files are read once
    gps = lambda k: F.try_element_at("gps", F.lit(k))
    raw = raw.join(_dates(raw, latest), "file_hash", "left").withColumn("dates", F.coalesce("dates", F.array()))
    if zones is None:
        zone = F.lit(None).cast("string")
    else:
        part = lambda k: _numbers(gps(k)).cast("array<string>")
        placed = raw.select(F.col("file_hash").alias("point_id"), degrees(part("GPSLongitude"), gps("GPSLongitudeRef"), "W").alias("lon"), degrees(part("GPSLatitude"), gps("GPSLatitudeRef"), "S").alias("lat"))
        raw = raw.join(zone_of(placed.where("lon is not null and lat is not null"), zones).select(F.col("point_id").alias("file_hash"), "zone"), "file_hash", "left")
        zone = F.col("zone")
    local = lambda d: F.when((d["tag"] == "GPSDateStamp") & zone.isNotNull(), local_time(F.try_to_timestamp(d["date"]), zone)).otherwise(d["date"])
    of = lambda source: F.map_from_entries(F.transform(F.filter("dates", lambda d: d["source"] == source), lambda d: F.named_struct(F.lit("key"), d["tag"], F.lit("value"), local(d))))
    dates = _first_of(F.when(F.size(of("png")) > 0, of("png")).otherwise(of("exif")), of("xmp"))
    file = F.create_map(F.lit("Filename"), "file_name", F.lit("Ext"), "ext", F.lit("MimeType"), mime_type(F.col("ext"), F.lit("image")))
    tags = _first_of(_texts(F.col("png"), PNG_TEXTS, first=False), F.col("image"), file, _texts(F.col("xmp"), XMP_TEXTS, first=True))
    listed = lambda m: F.map_filter(m, lambda k, v: k.isin(EXIF_KEYS) & v.isNotNull())
    return raw.select("file_hash", listed(tags).alias("tags"), listed(F.col("exif")).alias("exif"), listed(F.col("gps")).alias("gps"), dates.alias("date_items"))
