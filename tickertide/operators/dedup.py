"""First-row-kept deduplication, ordered sets, sorts and per-group limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickertide.functions.text import normalize_headline
from tickertide.schemas import BASE_KEYS


# Groups in which a source is limited before it meets as a whole.
SPREAD = 1024


def _cols(ord: str | Column | list) -> list[Column]:
    items = ord if isinstance(ord, list) else [ord]
    return [F.col(c) if isinstance(c, str) else c for c in items]


def first_keep_dedup(df: DataFrame, keys: list[str | Column], ord: str | Column | list) -> DataFrame:
    """Keep the first row per key in ``ord`` order.

    ``row_number() = 1`` is planned with a group limit before the shuffle: every task first
    reduces its own rows to one per key, so a key that holds a third of all rows sends one
    row per task and no task ever sees the whole group.
    """
    window = Window.partitionBy(*_cols(list(keys))).orderBy(*_cols(ord))
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def dedup_canonical(df: DataFrame, ord: str | Column | list) -> DataFrame:
    """First row per (reporter, day text, normalised headline)."""
    day = F.substring("posted_at", 1, 10)
    return first_keep_dedup(df, [F.col("reporter"), day, normalize_headline(F.col("headline"))], ord)


def dedup_headline_url(df: DataFrame, ord: str | Column | list) -> DataFrame:
    return first_keep_dedup(df, ["headline", "url"], ord)


def dedup_base(df: DataFrame, ord: str | Column | list) -> DataFrame:
    return first_keep_dedup(df, list(BASE_KEYS), ord)


def dedup_headline(df: DataFrame, ord: str | Column | list) -> DataFrame:
    return first_keep_dedup(df, ["headline"], ord)


def limit_per_source(
    df: DataFrame, n: int, ord: str | Column | list, source: str = "source"
) -> DataFrame:
    """First ``n`` rows per source.

    Two steps for any ``n``: the first keeps ``n`` rows of each source in each of up to ``SPREAD``
    groups of input partitions, so a source that holds a third of all rows is sorted by many tasks;
    the second sees at most ``n * SPREAD`` rows of a source.
    """
    part = F.pmod(F.spark_partition_id(), F.lit(SPREAD))
    rows = df.withColumn("_part", part)
    for keys in ([source, "_part"], [source]):
        window = Window.partitionBy(*keys).orderBy(*_cols(ord))
        rows = rows.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")
    return rows.drop("_part")


def distinct_ordered(df: DataFrame, col: str, ord: str) -> DataFrame:
    """Distinct values with the ``ord`` of their first row, in that order."""
    return df.groupBy(col).agg(F.min(ord).alias("first_ord")).orderBy("first_ord")


def union_all(dfs: list[DataFrame], ord: str | None = None) -> DataFrame:
    """Concatenate by name; ``part`` numbers the inputs so that the order stays known."""
    parts = [df.withColumn("part", F.lit(i)) for i, df in enumerate(dfs)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if ord is None:
        return both
    return both.withColumn("ord", F.struct("part", ord)).drop("part")


def sort_raw(df: DataFrame, ord: str | None = None) -> DataFrame:
    return df.orderBy("posted_at", "headline", *([ord] if ord else []))


def sort_base(df: DataFrame) -> DataFrame:
    return df.orderBy(*BASE_KEYS)


def sort_daily(df: DataFrame) -> DataFrame:
    return df.orderBy("ticker", "date")


def ai_only_filter(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_ai_related"))


def ticker_subset(df: DataFrame, tickers: list[str]) -> DataFrame:
    return df.where(F.col("ticker").isin(tickers))


def drop_missing_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)
