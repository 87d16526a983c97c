"""Scored rows and prices to correlation, quintile and hit-rate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickertide.operators.daily import daily_features, daily_sentiment
from tickertide.operators.dedup import drop_missing_keys
from tickertide.operators.joins import asof_forward, date_join_prices
from tickertide.operators.returns import market_excess, with_returns
from tickertide.operators.stats import (
    corr_by_ticker,
    corr_delta_block,
    corr_matrix,
    hit_rate_by_ticker,
    hit_rate_overall,
    quintile_change,
    quintile_excess,
)
from tickertide.schemas import AVERAGE_COLUMNS, DELTA_COLUMNS, RETURN_COLUMNS
from tickertide.session import cut_lineage
from tickertide.sources.prices import price_range

EXCESS_COLUMNS = [f"excess_{c}" for c in RETURN_COLUMNS]
FEATURE_COLUMNS = DELTA_COLUMNS + ["delta_sum", "llm_spread"]


def daily_table(scored: DataFrame) -> DataFrame:
    return daily_features(daily_sentiment(scored))


def aligned_table(daily: DataFrame, prices: DataFrame) -> DataFrame:
    """Daily rows with the returns of the first trading day at or after their date."""
    events = drop_missing_keys(daily, ["date", "ticker"])
    priced = with_returns(price_range(events, prices))
    priced = priced.select("ticker", "trade_date", *RETURN_COLUMNS)
    return asof_forward(events, priced, unique_left=True)


def excess_table(daily: DataFrame, prices: DataFrame) -> DataFrame:
    """Daily rows with same-date returns only, and returns in excess of the date's mean."""
    priced = with_returns(price_range(daily, prices))
    joined = date_join_prices(daily, priced.select("ticker", "trade_date", *RETURN_COLUMNS))
    return market_excess(joined)


def return_study(scored: DataFrame, prices: DataFrame, tickers: list[str] | None = None) -> dict[str, DataFrame]:
    """All tables of the study.

    The two aligned tables feed every statistic.  They are written to the shared folder
    once, so each statistic is a small scan and survives lost executors.
    """
    daily = cut_lineage(daily_table(scored), "daily")
    aligned = cut_lineage(aligned_table(daily, prices), "aligned")
    daily_q = cut_lineage(excess_table(daily, prices), "daily_q")
    base = AVERAGE_COLUMNS[0]
    tables = {
        "daily": daily,
        "aligned": aligned,
        "daily_q": daily_q,
        "corr_matrix": corr_matrix(aligned, AVERAGE_COLUMNS + RETURN_COLUMNS),
        "corr_by_ticker": corr_by_ticker(aligned, AVERAGE_COLUMNS, RETURN_COLUMNS, tickers),
        "corr_delta_block": corr_delta_block(aligned, RETURN_COLUMNS, FEATURE_COLUMNS),
        "hit_rate_overall": hit_rate_overall(daily_q, base),
        "hit_rate_by_ticker": hit_rate_by_ticker(daily_q, AVERAGE_COLUMNS, RETURN_COLUMNS, tickers),
    }
    for col in AVERAGE_COLUMNS:
        tables[f"quintile_excess_{col}"] = quintile_excess(daily_q, col, EXCESS_COLUMNS)
        tables[f"quintile_change_{col}"] = quintile_change(daily_q, col, EXCESS_COLUMNS)
    return tables
