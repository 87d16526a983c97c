"""Daily sentiment per ticker, its features, summaries and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickertide.functions.dates import posted_date
from tickertide.functions.scores import llm_spread, model_deltas, no_nan, row_mean, signs_differ
from tickertide.operators.dedup import ai_only_filter, dedup_headline
from tickertide.schemas import AVERAGE_COLUMNS, DELTA_COLUMNS, HORIZON_LABELS, SENTIMENT_COLUMNS


def daily_sentiment(
    scored: DataFrame, score_cols: dict[str, str] | None = None, date: str | None = None
) -> DataFrame:
    """Per (ticker, UTC day): headlines and the mean of each score, nulls ignored.

    Rows without ticker or readable date are left out.  ``score_cols`` maps output to input
    columns; ``date`` names a ready date column instead of ``posted_at``.
    """
    names = score_cols or dict(zip(AVERAGE_COLUMNS, SENTIMENT_COLUMNS))
    day = F.col(date) if date else posted_date(F.col("posted_at"))
    rows = scored.select("ticker", day.alias("date"), "headline", *dict.fromkeys(names.values()))
    return (
        rows.where(F.col("ticker").isNotNull() & F.col("date").isNotNull())
        .groupBy("ticker", "date")
        .agg(
            F.count("headline").alias("headline_count"),
            *[F.avg(no_nan(F.col(col))).alias(name) for name, col in names.items()],
        )
    )


def ffill_by_ticker(
    df: DataFrame, cols: list[str] = AVERAGE_COLUMNS, by: str = "ticker", order: str = "date"
) -> DataFrame:
    """Carry the last known value of each column forward within a ticker.

    Works on the daily table, where a ticker has at most one row per calendar day.
    """
    past = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in cols})


def daily_features(daily: DataFrame) -> DataFrame:
    """Forward-fill, then model deltas and the spread between the three LLM means."""
    filled = ffill_by_ticker(daily)
    base, *others = AVERAGE_COLUMNS
    deltas = model_deltas(filled, base, dict(zip(DELTA_COLUMNS, others)))
    return deltas.withColumn("llm_spread", llm_spread(*[F.col(c) for c in others]))


def sentiment_change(daily: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Difference to the ticker's previous row; gaps between days are not filled."""
    window = Window.partitionBy("ticker").orderBy("date")
    return daily.withColumn(name or f"{col}_change", F.col(col) - F.lag(col).over(window))


def ticker_summary(scored: DataFrame) -> DataFrame:
    """Per ticker: headlines and the mean of every ``sentiment_`` column."""
    cols = [c for c in scored.columns if c.startswith("sentiment_")]
    return (
        scored.where(F.col("ticker").isNotNull())
        .groupBy("ticker")
        .agg(F.count("headline").alias("count"), *[F.avg(no_nan(F.col(c))).alias(c) for c in cols])
    )


def ticker_summary_ai(scored: DataFrame) -> DataFrame:
    return ticker_summary(ai_only_filter(scored))


def melt_models(summary: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per-ticker means to (ticker, model, value) rows."""
    cols = cols or [c for c in summary.columns if c.startswith("sentiment_")]
    return summary.unpivot("ticker", cols, "model", "value")


def horizon_relabel(df: DataFrame) -> DataFrame:
    """Rename return columns (also ``excess_`` and ``hit_`` ones) to EOD, 1D, 3D, 5D, 7D."""
    names = {}
    for c in df.columns:
        bare = c.removeprefix("excess_").removeprefix("hit_")
        if bare in HORIZON_LABELS:
            names[c] = HORIZON_LABELS[bare]
    return df.withColumnsRenamed(names)


def null_audit(df: DataFrame) -> DataFrame:
    """Nulls per column, as (column, nulls) rows from one pass."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], list(df.columns), "column", "nulls")


def null_score_count(df: DataFrame, score_col: str) -> DataFrame:
    return df.agg(F.count_if(no_nan(F.col(score_col)).isNull()).alias("null_rows"))


def null_score_triage(df: DataFrame, score_col: str, ord: str, n: int = 10) -> DataFrame:
    """First ``n`` distinct headlines, in ``ord`` order, whose score is missing."""
    return (
        df.where(no_nan(F.col(score_col)).isNull())
        .groupBy("headline")
        .agg(F.min(ord).alias("first_ord"), F.count(F.lit(1)).alias("null_rows"))
        .orderBy("first_ord")
        .limit(n)
    )


def contrarian_rows(
    df: DataFrame,
    model: str,
    others: list[str],
    tickers: list[str] | None = None,
    ord: str | None = None,
) -> DataFrame:
    """Headlines where a model's sign differs from that of the other models' mean.

    With ``tickers`` and ``ord`` the rows are first cut to those tickers and to the first
    row per headline.  A missing score counts as a different sign.
    """
    rows = df if tickers is None else df.where(F.col("ticker").isin(tickers))
    if ord is not None:
        rows = dedup_headline(rows, ord)
    rows = rows.withColumn("other_mean", row_mean(*[F.col(c) for c in others]))
    return rows.where(signs_differ(F.col(model), F.col("other_mean")))


def contrarian_topn(df: DataFrame, ord: str, n: int = 3) -> DataFrame:
    return df.orderBy(ord).limit(n)
