"""Filters of results."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import entry_date
from ..functions.media import GALLERY_IMAGES, GALLERY_VIDEOS

#: The keys that may hold an entry's date, by precedence, and of a nested record; results that a filter may widen to.
DATE_KEYS = ("master_date", "estimated_date", "creation_date", "true_creation_date", "modification_date", "true_modification_date", "index_date")
NESTED_KEYS = ("master_date", "date", "value", "iso", "datetime")
WIDEN, MAX_CANDIDATES = 5, 100


def _day(text: str) -> date | None:
    try:
        return datetime.strptime(text.strip()[:10].replace(":", "-"), "%Y-%m-%d").date()
    except ValueError:
        return None


@dataclass(frozen=True)
class ActiveFilters:
    media_type: str = "All"
    extensions: tuple[str, ...] = field(default=())
    min_score: float = 0.0
    date_from: str = ""
    date_to: str = ""

    @property
    def active(self) -> bool:
        return self.media_type != "All" or bool(self.extensions) or self.min_score > 0 or bool(self.date_from or self.date_to)

    def candidates(self, n: int) -> int:
        """Results to ask for, so that n may be left."""
        return min(n * WIDEN, MAX_CANDIDATES) if self.active else n

    def media(self, ext: Column) -> Column:
        known = {"image": GALLERY_IMAGES, "video": GALLERY_VIDEOS}.get(self.media_type.lower().rstrip("s"))
        return F.coalesce(ext.isin(known), F.lit(False)) if known else F.lit(True)

    def extension(self, ext: Column) -> Column:
        own = [x.lower().lstrip(".") for x in self.extensions]
        return F.coalesce(ext.isin(own), F.lit(False)) if own else F.lit(True)

    def score(self, c: Column) -> Column:
        return F.coalesce(c >= self.min_score, F.lit(False)) if self.min_score > 0 else F.lit(True)

    def dates(self, day: Column) -> Column:
        low, high = _day(self.date_from), _day(self.date_to)
        if not low and not high:
            return F.lit(True)
        ok = F.lit(True)
        if low:
            ok = ok & (day >= F.lit(low))
        if high:
            ok = ok & (day <= F.lit(high))
        return F.coalesce(ok, F.lit(False))


def dates_of(entries: DataFrame, metadata: str = "metadata") -> Column:
    """An entry's day: the first of DATE_KEYS that can be read in metadata.dates, then in the metadata itself, as old records have it.

    A key may be absent from the schema, and may hold a nested record with the date in one of NESTED_KEYS."""

    def readings(kind: T.StructType, path: str, keys: tuple[str, ...]) -> list[Column]:
        found = []
        for key in (k for k in keys if k in kind.names):
            value = kind[key].dataType
            found += readings(value, f"{path}.{key}", NESTED_KEYS) if isinstance(value, T.StructType) else [F.col(f"{path}.{key}").cast("string")]
        return found

    kind = entries.schema[metadata].dataType
    dates = kind["dates"].dataType if "dates" in kind.names else None
    nested = readings(dates, f"{metadata}.dates", DATE_KEYS) if isinstance(dates, T.StructType) else []
    return entry_date([*nested, *readings(kind, metadata, DATE_KEYS), F.lit(None).cast("string")])


def filtered(results: DataFrame, entries: DataFrame, f: ActiveFilters, n: int) -> DataFrame:
    """results (query_id, entry_id, score, rank) whose entry passes, the first n by rank, with the new position.

    The filter works on the candidates that the search returned, so what lies beyond them is not seen."""
    e = entries.select("entry_id", F.col("metadata.ext").alias("ext"), dates_of(entries).alias("day"))
    ok = results.join(e, "entry_id").where(f.media(F.col("ext")) & f.extension(F.col("ext")) & f.score(F.col("score")) & f.dates(F.col("day")))
    ranked = ok.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return ranked.where(F.col("position") <= n).select("query_id", "entry_id", "score", "rank", "position")


def uploaded(path: Column, root: str) -> Column:
    """Paths that start with the root's text, whatever follows it."""
    return F.regexp_replace(path, r"\\", "/").startswith(root.replace("\\", "/").rstrip("/"))
