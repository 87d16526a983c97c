"""Landed feed entries of the three sources to article rows and raw headline rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickertide.functions.dates import normalize_ts, parse_feed_date
from tickertide.functions.text import is_blank, strip, strip_html_snippet
from tickertide.operators.dedup import limit_per_source

# Source systems: stored pipeline name, and outlet name where the entry gives none (fixed values).
SOURCES = {
    "techcrunch": ("TechCrunch", "TechCrunch"),
    "google_news": ("Google News RSS", "google_news_ai"),
    "newsapi": ("NewsAPI Tech", "newsapi_tech"),
}


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def normalize_feed(
    entries: DataFrame,
    source_system: str,
    limit: int = 50,
    now: str | Column = "1970-01-01T00:00:00Z",
    snippet_chars: int | None = 500,
) -> DataFrame:
    """Entries of one source system as articles.

    Title and link are trimmed and must not be blank.  The two RSS sources cap by the
    entry's position, counting entries that are then skipped; the API source caps the
    articles it keeps, in position order.  An RSS entry without summary shows its ``description``,
    where ``entries`` has that column.
    """
    pipeline, outlet = SOURCES[source_system]
    rows = entries.where(F.col("source_system") == source_system)
    titled = ~is_blank(F.col("title")) & ~is_blank(F.col("link"))
    if source_system == "newsapi":
        rows = limit_per_source(rows.where(titled), limit, "position", "source_system")
        name = F.coalesce(F.nullif(strip(F.col("source_title")), F.lit("")), F.lit(outlet))
        stamp = normalize_ts(F.col("published"), now)
        snippet = F.coalesce(strip(F.col("summary")), F.lit(""))
    else:
        rows = rows.where((F.col("position") < limit) & titled)
        name = F.lit(outlet)
        if source_system == "google_news":
            name = F.coalesce(_filled("source_title"), name)
        stamp = parse_feed_date(
            F.coalesce(_filled("published"), _filled("updated"), _filled("created")), now
        )
        bodies = [_filled(c) for c in ("summary", "description") if c in entries.columns]
        snippet = F.coalesce(strip_html_snippet(F.coalesce(*bodies), snippet_chars), F.lit(""))
    return rows.select(
        strip(F.col("link")).alias("url"),
        strip(F.col("title")).alias("headline"),
        stamp.alias("timestamp"),
        name.alias("source"),
        snippet.alias("snippet"),
        F.lit(pipeline).alias("pipeline_source"),
        F.col("position"),
    )


def articles_to_raw(articles: DataFrame, fetched_at: str | Column) -> DataFrame:
    """Articles in the stored raw layout: the outlet is the reporter, the snippet is dropped."""
    stamp = F.lit(fetched_at) if isinstance(fetched_at, str) else fetched_at
    return articles.select(
        F.coalesce(_filled("pipeline_source"), F.lit("unknown")).alias("source"),
        stamp.alias("fetched_at"),
        F.col("headline"),
        F.col("timestamp").alias("posted_at"),
        F.col("source").alias("reporter"),
        F.col("url"),
    )
