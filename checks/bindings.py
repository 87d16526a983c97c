"""The given tables as headlines, scores, prices and feed entries.

Every binding covers its whole table and its whole texts; values the tables do not hold,
such as a posting time, are computed from their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickertide.operators.daily import daily_features, daily_sentiment
from tickertide.operators.joins import asof_forward, date_join_prices
from tickertide.operators.returns import market_excess, with_returns
from tickertide.schemas import (
    AI_TERMS,
    AVERAGE_COLUMNS,
    CONTEXTS,
    LEXICON,
    RETURN_COLUMNS,
    SENTIMENT_COLUMNS,
)

LEXICON_ROWS = [
    ("A", "the", "identity"),
    ("A", "of the", "partners"),
    ("A", "der", "competitors"),
    ("B", "de la", "identity"),
    ("B", "und", "partners"),
    ("B", "in the", "suppliers"),
    ("C", "que", "identity"),
    ("C", "The ", "lab_partners"),
    ("C", "2.0", "products"),
    ("D", "by-nc", "products"),
    ("D", "thble", "identity"),
    ("D", "th th", "infra_partners"),
    ("D", " ", "subsidiaries"),
]
AI_ROWS = [
    ("avec", "ai_buzz_entities"),
    ("By-NC", "ai_buzz_entities"),
    ("ch e", "ai_buzz_phrases"),
    ("thor", "ai_buzz_phrases"),
]
CONTEXT_ROWS = [
    ("A", "the", "note on the", 0),
    ("A", "of the", "note on of the", 1),
    ("B", "de la", "note on de la", 0),
    ("C", "que", "note on que", 0),
]
POSITIVE = ["the", "que", "in the", "by-nc"]
NEGATIVE = ["und", "der", "de la", "to"]
EXCESS_COLUMNS = [f"excess_{c}" for c in RETURN_COLUMNS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON_ROWS, LEXICON)


def ai_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AI_ROWS, AI_TERMS)


def contexts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTEXT_ROWS, CONTEXTS)


def _iso(expr: str) -> str:
    return f"date_format({expr}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"


def raw_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: whole text as headline; neighbours share posting times and addresses."""
    posted = "timestamp_ntz'2024-01-01 00:00:00' + (doc_id div 3) * interval '37' minute"
    return table(spark, sf_dir, "documents").select(
        "source",
        F.expr(_iso(f"{posted} + interval '1' hour")).alias("fetched_at"),
        F.col("text").alias("headline"),
        F.expr(_iso(posted)).alias("posted_at"),
        F.col("lang").alias("reporter"),
        F.expr("concat('https://example.org/', doc_id div 2)").alias("url"),
        F.col("doc_id").alias("ord"),
    )


def _score(factor: int, gap: int | None) -> F.Column:
    value = f"cast(((event_id * {factor}) % 201 - 100) as double) / 100"
    return F.expr(value if gap is None else f"if(event_id % {gap} = 0, null, {value})")


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: event type as ticker, four scores with gaps computed from the id."""
    factors = [(37, None), (53, 11), (71, 13), (89, 17)]
    return table(spark, sf_dir, "events").select(
        F.expr(_iso("ts")).alias("posted_at"),
        F.expr(_iso("ts + interval '1' hour")).alias("fetched_at"),
        F.expr("concat(event_type, '-', user_id)").alias("headline"),
        F.expr("concat('https://example.org/', user_id)").alias("url"),
        F.lit("feed").alias("source"),
        F.expr("concat('desk', event_id % 7)").alias("reporter"),
        F.col("event_type").alias("ticker"),
        F.expr("event_id % 3 <> 0").alias("is_ai_related"),
        F.expr("event_id % 5 = 0").alias("is_proxy_partnership"),
        *[_score(f, gap).alias(c) for c, (f, gap) in zip(SENTIMENT_COLUMNS, factors)],
        F.col("event_id").alias("ord"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means, rounded so that sums in another order give the same signs and buckets."""
    rows = daily_sentiment(processed(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 9) for c in AVERAGE_COLUMNS})


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_features(daily(spark, sf_dir))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events on weekdays: one price row per (event type, day)."""
    day = F.to_date("ts")
    return (
        table(spark, sf_dir, "events")
        .where(F.weekday(day) < 5)
        .groupBy(F.col("event_type").alias("ticker"), day.alias("trade_date"))
        .agg(
            F.round(F.avg("value"), 6).alias("close"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.count(F.lit(1)).alias("volume"),
        )
    )


def order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders on weekdays: mean order value per (priority, day) as close."""
    day = F.to_date("o_orderdate")
    return (
        table(spark, sf_dir, "orders")
        .where(F.weekday(day) < 5)
        .groupBy(F.col("o_orderpriority").alias("ticker"), day.alias("trade_date"))
        .agg(F.round(F.avg("o_totalprice"), 6).alias("close"))
    )


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = with_returns(prices(spark, sf_dir).select("ticker", "trade_date", "close"))
    return asof_forward(features(spark, sf_dir), priced.drop("close"), unique_left=True)


def daily_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = with_returns(prices(spark, sf_dir).select("ticker", "trade_date", "close"))
    return market_excess(date_join_prices(features(spark, sf_dir), priced.drop("close")))


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages: title and markup as entries of three sources, with dates in several layouts."""
    when = "(timestamp_ntz'2026-02-01 00:00:00' + page_id * interval '41' minute)"
    published = f"""
        CASE page_id % 8
          WHEN 0 THEN date_format({when}, "E, d MMM yyyy HH:mm:ss 'GMT'")
          WHEN 1 THEN date_format({when}, "E, dd MMM yyyy HH:mm:ss '+0500'")
          WHEN 2 THEN date_format({when}, "yyyy-MM-dd'T'HH:mm:ss'Z'")
          WHEN 3 THEN date_format({when}, "yyyy-MM-dd HH:mm:ss")
          WHEN 4 THEN date_format({when}, "yyyy-MM-dd")
          WHEN 5 THEN date_format({when}, "yyyy-MM-dd'T'HH:mm:ss'.5Z'")
          WHEN 6 THEN 'soon'
          ELSE '' END"""
    return table(spark, sf_dir, "pages").select(
        F.expr("element_at(array('techcrunch', 'google_news', 'newsapi'), cast(page_id % 3 + 1 as int))").alias(
            "source_system"
        ),
        F.expr("cast(page_id div 3 as int)").alias("position"),
        F.expr("if(page_id % 10 = 0, ' ', concat(' ', regexp_extract(html, '<title>(.*?)</title>', 1), ' '))").alias(
            "title"
        ),
        F.col("url").alias("link"),
        F.col("html").alias("summary"),
        F.expr(published).alias("published"),
        F.expr(f"if(page_id % 2 = 0, '', date_format({when}, 'yyyy-MM-dd'))").alias("updated"),
        F.lit("2026-01-31").alias("created"),
        F.expr("if(page_id % 4 = 0, '', concat('site', page_id % 5))").alias("source_title"),
        "page_id",
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: whole text, most with a number after it, as raw model answers."""
    number = "concat('Score: ', (conv_id * 31 + turn * 17) % 7 - 3, '.', (conv_id + turn) % 10, '.')"
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.expr(f"if(conv_id % 9 = 0, text, concat(text, chr(10), {number}))").alias("response"),
    )
