"""Date functions on ISO texts.  Offsets stay in the text: parts are those that are written,
the timestamp is UTC.  Texts are compared as texts where dates are resolved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, strip

#: Extended ISO date-times: date, and perhaps time, fraction and offset.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"
PARTS = {"year": (1, 4), "month": (6, 2), "day": (9, 2), "hour": (12, 2), "minute": (15, 2), "second": (18, 2)}


def offset_minutes(c: Column) -> Column:
    """Of the offset that is written; none or Z: 0."""
    text = F.regexp_extract(c, r"([+-]\d{2}:?\d{2})$", 1)
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(c) < 17, 0).when(text == "", 0).otherwise(sign * (F.expr("0") + F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")))


def epoch_seconds(c: Column) -> Column:
    """UTC seconds with their fraction; a text without an offset is UTC."""
    return F.unix_micros(F.try_to_timestamp(c)) / 1e6


def date_part_columns(c: Column, name: str) -> dict[str, Column]:
    """name_year ... name_second, name_microsecond, name_ts, name_tz_offset_minutes of an ISO text."""
    ok = c.rlike(ISO)
    out = {f"{name}_{part}": F.when(ok, F.coalesce(F.substring(c, at, n).try_cast("int"), F.lit(0))) for part, (at, n) in PARTS.items()}
    fraction = F.rpad(F.regexp_extract(c, r"[.,](\d{1,6})", 1), 6, "0")
    out[f"{name}_microsecond"] = F.when(ok, fraction.try_cast("int"))
    out[f"{name}_ts"] = F.when(ok, epoch_seconds(c))
    out[f"{name}_tz_offset_minutes"] = F.when(ok, offset_minutes(c))
    return out


def format_datetime(c: Column, latest: Column | None = None) -> Column:
    """The text with a UTC offset where it has none, if its year is 1980 or later and it is no later than tomorrow; else null."""
    latest = latest if latest is not None else F.current_timestamp() + F.expr("INTERVAL 1 DAY")
    t = F.try_to_timestamp(c)
    text = F.concat(F.substring(c, 1, 10), F.lit("T"), F.when(F.length(c) > 10, F.substring(c, 12, 100)).otherwise("00:00:00"))
    text = F.regexp_replace(text, "Z$", "+00:00")
    text = F.when(text.rlike(r"T\d{2}:\d{2}([+-]|$)"), F.regexp_replace(text, r"T(\d{2}:\d{2})", "T$1:00")).otherwise(text)
    text = F.when(text.rlike(r"[+-]\d{2}:\d{2}$"), text).otherwise(F.concat(text, F.lit("+00:00")))
    return F.when(c.rlike(ISO) & t.isNotNull() & (F.substring(c, 1, 4).try_cast("int") >= 1980) & (t <= latest), text)


def format_epoch(c: Column, latest: Column | None = None) -> Column:
    """Seconds since 1970 as text in UTC, with their fraction to the microsecond, if the year is 1980 or later and it is no later than tomorrow; else null."""
    latest = latest if latest is not None else F.current_timestamp() + F.expr("INTERVAL 1 DAY")
    t = F.timestamp_micros(F.round(c.cast("double") * 1e6).cast("long"))
    micros = F.date_format(t, "SSSSSS")
    text = F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))
    return F.when((F.year(t) >= 1980) & (t <= latest), text)


def format_datetimes(c: Column, latest: Column | None = None) -> Column:
    """format_datetime() of each element of a list; what can't be read is null."""
    return F.transform(c, lambda x: format_datetime(x, latest))


def parse_embedded(c: Column, latest: Column | None = None) -> Column:
    """Date-times as files embed them: ISO, 2021:05:01 08:15:00, with offsets, and two forms with the names of weekday and month."""
    return F.coalesce(*(format_datetime(x, latest) for x in embedded_forms(c)))


def embedded_forms(c: Column) -> list[Column]:
    """How an embedded date-time may read in ISO; the first that does counts."""
    raw = strip(c)
    colons = F.regexp_replace(raw, r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3")
    spaced = F.regexp_replace(F.regexp_replace(colons, r"^(\d{4}-\d{2}-\d{2}) ", "$1T"), r" ([+-]\d{2}:?\d{2})$", "$1")
    wide = F.regexp_replace(spaced, r"([+-]\d{2})(\d{2})$", "$1:$2")
    bare = F.regexp_replace(raw, r"^[A-Za-z]{3} ", "")
    named = F.coalesce(
        F.date_format(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
        F.date_format(F.try_to_timestamp(bare, F.lit("MMM d HH:mm:ss yyyy")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
    )
    return [raw, colons, spaced, wide, named]


def resolve_dates(v: dict[str, Column]) -> dict[str, Column]:
    """One creation and one modification date, flags and a reliability from the dates of file and image.

    v: creation_date, modification_date, index_date, DateTime, DateTimeOriginal, DateTimeDigitized, GPSDateStamp."""
    v = {k: blank_to_null(c) for k, c in v.items()}
    os_late = F.coalesce(v["creation_date"] > v["modification_date"], F.lit(False))
    os_created = F.when(os_late, v["modification_date"]).otherwise(v["creation_date"])
    created = F.coalesce(v["DateTimeOriginal"], v["DateTimeDigitized"], v["GPSDateStamp"], os_created)
    modified = F.coalesce(v["DateTime"], v["modification_date"])
    early = F.coalesce(modified < created, F.lit(False))
    down = early & F.coalesce(created == os_created, F.lit(False)) & v["DateTime"].isNotNull()
    final = F.when(down, modified).otherwise(created)
    flag = lambda name, when: F.when(when, F.lit(name))
    reliability = (
        F.when(F.coalesce(final, modified).isNull(), "invalid")
        .when(v["DateTimeOriginal"].isNotNull() & ~early, "high")
        .when(F.coalesce(v["DateTimeDigitized"], v["GPSDateStamp"]).isNotNull() & ~early, "medium")
        .otherwise("low")
    )
    return {
        "master_date": F.coalesce(final, modified),
        "true_creation_date": final,
        "true_modification_date": modified,
        "index_date": v["index_date"],
        "creation_date": os_created,
        "modification_date": v["modification_date"],
        "date_reliability": reliability,
        "flags": F.array_compact(F.array(flag("os_creation_after_modification_corrected", os_late), flag("modification_before_creation", early), flag("os_creation_downgraded_to_modification", down))),
    }


def exif_date(date: Column, subsec: Column, offset: Column, latest: Column | None = None) -> Column:
    """An EXIF date with its fraction (none: 000) and offset (none: UTC)."""
    return format_datetime(exif_text(date, subsec, offset), latest)


def exif_text(date: Column, subsec: Column, offset: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(strip(date), r"^(\d{4}):(\d{2}):", "$1-$2-"), " ", "T")
    return F.concat(base, F.lit("."), strip(F.coalesce(subsec, F.lit("000"))), strip(F.coalesce(offset, F.lit("+00:00"))))


def gps_date(date: Column, hour: Column, minute: Column, second: Column, latest: Column | None = None) -> Column:
    """A GPS date stamp with its time, in UTC."""
    return format_datetime(gps_text(date, hour, minute, second), latest)


def gps_text(date: Column, hour: Column, minute: Column, second: Column) -> Column:
    micro = F.round((second % 1) * 1_000_000).cast("int")
    return F.format_string("%sT%02d:%02d:%02d.%06d+00:00", F.regexp_replace(date, ":", "-"), hour.cast("int"), minute.cast("int"), second.cast("int"), micro)


def filter_date(c: Column) -> Column:
    """The day of a text's first ten characters; 2021:05:01 counts as 2021-05-01."""
    return F.try_to_date(F.regexp_replace(F.substring(c, 1, 10), r"^(\d{4}):(\d{2}):", "$1-$2-"), "yyyy-MM-dd")


def entry_date(dates: list[Column]) -> Column:
    """The first that can be read."""
    return F.coalesce(*map(filter_date, dates))
