"""Time zones of positions: a spatial join of points and polygons by grid cells.

A polygon is dealt to the cells that its bounding box touches, a point lies in one cell, and only
points and polygons of a cell are tested against each other.  Large polygons can be cut by the
caller, as several rows may name one zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Degrees of a cell's side.
CELL = 2.0


def degrees(dms: Column, ref: Column, negative: str) -> Column:
    """Decimal degrees of an array of degrees, minutes and seconds; ref negative: south or west.  Null unless all are there."""
    numbers = F.transform(dms, lambda v: v.try_cast("double"))
    part = lambda k: F.try_element_at(numbers, F.lit(k))
    x = part(1) + part(2) / 60 + part(3) / 3600
    return F.when(ref != "", F.when(F.upper(strip(ref)) == negative, -x).otherwise(x))


def _cell(x: Column) -> Column:
    return F.floor(x / CELL).cast("int")


def contains(ring: Column, lon: Column, lat: Column) -> Column:
    """Whether a ring (array of lon and lat, closed or not) holds a point, by the crossings of a ray to the east."""
    ahead = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, ahead, lambda a, b: F.named_struct(F.lit("x"), a["lon"], F.lit("y"), a["lat"], F.lit("u"), b["lon"], F.lit("v"), b["lat"]))
    spans = lambda e: (e["y"] > lat) != (e["v"] > lat)  # noqa: E731  so the edge is not level
    crossings = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(spans(e) & (lon < (e["u"] - e["x"]) * (lat - e["y"]) / F.when(spans(e), e["v"] - e["y"]).otherwise(1.0) + e["x"]), 1).otherwise(0))
    return crossings % 2 == 1


def zone_of(points: DataFrame, zones: DataFrame) -> DataFrame:
    """points (point_id, lon, lat) with the zone of the polygon (zones: zone, ring) that holds it, null where none does.

    Of several the first by name.  point_id is unique; points without a position have no zone."""
    edge = lambda pick, name: _cell(pick(F.transform("ring", lambda p: p[name])))
    span = lambda name: F.sequence(edge(F.array_min, name), edge(F.array_max, name))
    dealt = zones.where(F.size("ring") >= 3).withColumn("cell_x", F.explode(span("lon"))).withColumn("cell_y", F.explode(span("lat"))).select("zone", "ring", "cell_x", "cell_y")
    placed = points.where("lon is not null and lat is not null").select("point_id", "lon", "lat", _cell(F.col("lon")).alias("cell_x"), _cell(F.col("lat")).alias("cell_y"))
    inside = placed.join(dealt, ["cell_x", "cell_y"]).where(contains(F.col("ring"), F.col("lon"), F.col("lat")))
    return points.join(inside.groupBy("point_id").agg(F.min("zone").alias("zone")), "point_id", "left")


def local_time(utc: Column, zone: Column) -> Column:
    """A UTC timestamp as ISO text in the zone's local time with its offset; without a zone in UTC."""
    known = F.coalesce(zone, F.lit("UTC"))
    local = F.from_utc_timestamp(utc, known)
    minutes = F.floor((F.unix_seconds(local) - F.unix_seconds(utc)) / 60)
    sign = F.when(minutes < 0, "-").otherwise("+")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    offset = F.concat(sign, two(F.floor(F.abs(minutes) / 60)), F.lit(":"), two(F.abs(minutes) % 60))
    micros = F.date_format(local, "SSSSSS")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), offset)


def gps_local_times(images: DataFrame, zones: DataFrame) -> DataFrame:
    """images (file_hash, utc, GPSLatitude, GPSLatitudeRef, GPSLongitude, GPSLongitudeRef) with lat, lon, zone and local_time."""
    placed = images.withColumns({"lat": degrees(F.col("GPSLatitude"), F.col("GPSLatitudeRef"), "S"), "lon": degrees(F.col("GPSLongitude"), F.col("GPSLongitudeRef"), "W")})
    one = placed.where("lat is not null and lon is not null").groupBy("file_hash").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"))
    zone = zone_of(one.withColumnRenamed("file_hash", "point_id"), zones).select(F.col("point_id").alias("file_hash"), "zone")
    return placed.join(zone, "file_hash", "left").withColumn("local_time", local_time(F.col("utc"), F.col("zone")))
