"""Pages: links and plain text, on native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedback_engine.functions.time import season_code
from feedback_engine.operators.rank import first_per_key

DROPPED = ("script", "style", "nav", "footer", "head")
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def links(pages: DataFrame, pattern: str | None = None, exclude: str | None = None) -> DataFrame:
    """Distinct targets with the first page that links to each."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    if pattern:
        rows = rows.filter(F.col("href").rlike(pattern))
    if exclude:
        rows = rows.filter(~F.col("href").rlike(exclude))
    return first_per_key(rows, "href", [F.asc("page_id"), F.asc("pos")])


def plain_text(html: Column, longest: int | None = None) -> Column:
    """A page without DROPPED elements, comments and tags; blanks collapse; optionally cut."""
    out = F.coalesce(html, F.lit(""))
    for name in DROPPED:
        out = F.regexp_replace(out, f"(?is)<{name}[ >].*?</{name}>", " ")
    out = F.regexp_replace(F.regexp_replace(out, "(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    for name, char in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.btrim(F.regexp_replace(out, "[ \\t\\n\\r\\f]+", " "))
    return F.substring(out, 1, longest) if longest else out


def plain_text_sql(html: str) -> str:
    out = f"coalesce({html}, '')"
    for name in DROPPED:
        out = f"regexp_replace({out}, '(?is)<{name}[ >].*?</{name}>', ' ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for name, char in REFERENCES:
        out = f"replace({out}, '{name}', '{char}')"
    return f"trim(regexp_replace({out}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


def fetched(pages: DataFrame, cached: DataFrame, longest: int | None = None) -> DataFrame:
    """(page_id, text) of every page: from the cache where it is there, else read now; a page that failed (null html) is empty."""
    new = pages.join(cached.select("page_id"), "page_id", "left_anti").select("page_id", plain_text(F.col("html"), longest).alias("text"))
    return cached.select("page_id", "text").unionByName(new)


def released(pages: DataFrame, exclude: str | None = None, longest: int | None = None) -> DataFrame:
    """page_id, version, season, text of pages (page_id, version, html) with a text and a season; versions that match `exclude` go unread."""
    known = pages.withColumn("season", season_code(F.col("version"))).filter(F.col("season") != "")
    if exclude:
        known = known.filter(~F.col("version").rlike(exclude))
    return known.select("page_id", "version", "season", plain_text(F.col("html"), longest).alias("text")).filter(F.col("text") != "")
