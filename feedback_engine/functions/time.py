"""Dates, months and version codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats of change-log dates, in the order they are tried.
DATE_FORMATS = ("yyyy-MM-dd", "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy")


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def from_epoch(seconds: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss") -> Column:
    """Epoch seconds as text in UTC; empty for null and 0."""
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "").otherwise(F.date_format(F.timestamp_seconds(seconds), pattern))


def parse_date(text: Column) -> Column:
    """A date in one of DATE_FORMATS as yyyy-MM-dd; the text itself if none fits."""
    tidy = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.coalesce(*[F.date_format(F.try_to_timestamp(tidy, F.lit(f)), "yyyy-MM-dd") for f in DATE_FORMATS], text)


def extract_date(text: Column, within: int = 500) -> Column:
    """The first date near the start of a page, normalised; empty if none."""
    head = F.substring(text, 1, within)
    named, plain = F.regexp_extract(head, r"(\w+ \d{1,2},? \d{4})", 1), F.regexp_extract(head, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.when(named != "", parse_date(named)).when(plain != "", parse_date(plain)).otherwise("")


def season_code(version: Column) -> Column:
    """4.6.0 -> S4; Season_1 and 1.2.0 -> S1; empty otherwise."""
    major = F.regexp_extract(version, r"^(\d+)\.", 1)
    return F.when(version.isin("Season_1", "1.2.0"), "S1").when(major != "", F.concat(F.lit("S"), major)).otherwise("")
