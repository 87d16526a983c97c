"""Price tables: wide to long, and the date range a study needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickertide.schemas import PRICE_FIELDS


def price_column(field: str) -> str:
    return field.lower().replace(" ", "_")


def prices_long(
    wide: DataFrame,
    tickers: list[str] | None = None,
    fields: list[str] = PRICE_FIELDS,
    date_col: str = "Date",
    sep: str = "|",
) -> DataFrame:
    """One row per date with columns ``<ticker>|<field>`` to one row per (ticker, date).

    Every input row unfolds in place, so nothing is shuffled and one pass reads the table.
    """
    if tickers is None:
        tickers = sorted({c.split(sep)[0] for c in wide.columns if sep in c})
    rows = []
    for ticker in tickers:
        cells = [F.lit(ticker).alias("ticker")]
        for field in fields:
            name = f"{ticker}{sep}{field}"
            kind = "long" if field == "Volume" else "double"
            col = F.col(f"`{name}`") if name in wide.columns else F.lit(None)
            cells.append(col.cast(kind).alias(price_column(field)))
        rows.append(F.struct(*cells))
    return wide.select(
        F.to_date(F.col(date_col)).alias("trade_date"), F.inline(F.array(*rows))
    ).select("ticker", "trade_date", *[price_column(f) for f in fields])


def price_range(
    events: DataFrame, prices: DataFrame, pad_days: int = 5, date_col: str = "date"
) -> DataFrame:
    """Prices from ``pad_days`` before the first event to ``pad_days`` after the last (excluded).

    The two bounds are scalar subqueries: no join, and the scan gets plain comparisons.
    """
    lo = events.agg(F.date_sub(F.min(date_col), pad_days)).scalar()
    hi = events.agg(F.date_add(F.max(date_col), pad_days)).scalar()
    return prices.where((F.col("trade_date") >= lo) & (F.col("trade_date") < hi))
