"""Price returns and market-excess returns.

Price tables hold one row per (ticker, trading day) and daily tables one per (ticker, day).
A window over a ticker is therefore bounded by the calendar, and one over a date by the
number of tickers, whatever the volume of headlines behind them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickertide.schemas import HORIZONS, RETURN_COLUMNS


def _by_ticker():
    return Window.partitionBy("ticker").orderBy("trade_date")


def trailing_return(prices: DataFrame, close: str = "close") -> DataFrame:
    """Add ``ret_eod``: close over the previous row's close, minus one."""
    previous = F.lag(close).over(_by_ticker())
    return prices.withColumn("ret_eod", F.try_divide(F.col(close), previous) - 1)


def forward_returns(
    prices: DataFrame, horizons: tuple[int, ...] = HORIZONS, close: str = "close"
) -> DataFrame:
    """Add ``ret_<h>d``: close ``h`` trading rows ahead over close, minus one."""
    window = _by_ticker()
    return prices.withColumns(
        {
            f"ret_{h}d": F.try_divide(F.lead(close, h).over(window), F.col(close)) - 1
            for h in horizons
        }
    )


def with_returns(prices: DataFrame) -> DataFrame:
    """All five return columns; both windows share one sort."""
    return forward_returns(trailing_return(prices))


def market_excess(daily_q: DataFrame, ret_cols: list[str] = RETURN_COLUMNS) -> DataFrame:
    """Add ``market_avg`` and ``excess_<ret>``: each return less the mean of its date's rows.

    The mean covers the tickers that have headlines on that date, nulls ignored.
    """
    day = Window.partitionBy("date")
    columns = {"market_avg": F.avg("ret_1d").over(day)} if "ret_1d" in ret_cols else {}
    columns.update({f"excess_{c}": F.col(c) - F.avg(c).over(day) for c in ret_cols})
    return daily_q.withColumns(columns)
