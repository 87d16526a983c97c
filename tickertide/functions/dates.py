"""Date strings of feeds, files and stored rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickertide.functions.text import is_blank, strip

ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# Layouts a feed date may have, tried in this order (fixed values).
FEED_LAYOUTS = [
    "d MMM yyyy H:m:s",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d'T'H:m:s'Z'",
    "yyyy-M-d H:m:s",
    "yyyy-M-d",
]
WEEKDAY_PREFIX = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun),\s*"


def _parse(text: Column, layout: str) -> Column:
    return F.try_to_timestamp(text, F.lit(layout))


def parse_posted_at(col: Column) -> Column:
    """Strict ``yyyy-MM-ddTHH:mm:ssZ`` to a timestamp; every other form becomes null."""
    return _parse(col, ISO_Z)


def posted_date(col: Column) -> Column:
    """UTC calendar day of a stored ``posted_at`` string."""
    return F.to_date(parse_posted_at(col))


def parse_feed_date(col: Column, now: Column | str) -> Column:
    """Feed date to ISO text.

    A trailing ``GMT`` or numeric offset is dropped without shifting the clock.  What no
    layout fits is read as a day from its first ten characters, else replaced by ``now``.
    """
    now = F.lit(now) if isinstance(now, str) else now
    text = F.regexp_replace(strip(col), r"(?U)\s*GMT$", "")
    text = strip(F.regexp_replace(text, r"(?U)\s*[+-]\d{4}$", ""))
    dated = F.regexp_replace(text, WEEKDAY_PREFIX, "")
    # The month-name layout needs its weekday; the numeric ones must not have one.
    named = F.when(text != dated, _parse(dated, FEED_LAYOUTS[0]))
    numeric = [_parse(text, layout) for layout in FEED_LAYOUTS[1:]]
    day = _parse(F.substring(text, 1, 10), "yyyy-M-d")
    parsed = F.date_format(F.coalesce(named, *numeric, day), ISO_Z)
    return F.when(is_blank(col), now).otherwise(F.coalesce(parsed, now))


def normalize_ts(col: Column, now: Column | str) -> Column:
    """Article time to text ending in ``Z``; a bare date and time keeps only its day, at noon."""
    now = F.lit(now) if isinstance(now, str) else now
    text = strip(col)
    return (
        F.when(is_blank(col), now)
        .when(text.endswith("Z"), text)
        .when(text.rlike(r"[+-]\d{2}:?\d{2}$"), F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z")))
        .when(F.contains(text, F.lit("T")), F.concat(text, F.lit("Z")))
        .otherwise(F.concat(F.substring(text, 1, 10), F.lit("T12:00:00Z")))
    )


def file_date_key(stem: Column) -> Column:
    """``headlines_YYYYMMDD`` or ``headlines_YYYYMMDD_N`` to ``YYYYMMDD``, else null."""
    return F.nullif(F.regexp_extract(stem, r"^headlines_(\d{8})(?:_\d+)?$", 1), F.lit(""))


# A landed file, or a folder written by Spark under that name.
LANDED_NAME = r"(?:^|[/=])(headlines_(\d{8})(?:_\d+)?\.csv)(?:/|$)"


def landed_file_name(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, LANDED_NAME, 1), F.lit(""))


def landed_day(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, LANDED_NAME, 2), F.lit(""))
