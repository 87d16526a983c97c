"""Joins: new rows only, exact date, and the next trading day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anti_join_new_rows(batch: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Batch rows whose key is not in the table.

    Two steps, because the table is the big side.  A semi-join first finds which batch keys
    are stored: there the batch is the build side, so a small batch is broadcast by its
    measured size and the table is only scanned for its key columns, never shuffled.  The
    anti-join then meets just those hits.
    """
    wanted = batch.select(*keys)
    stored = table.select(*keys).join(wanted, keys, "left_semi")
    return batch.join(stored, keys, "left_anti")


def date_join_prices(daily: DataFrame, prices: DataFrame) -> DataFrame:
    """Exact (ticker, date); a day without trading keeps null returns."""
    right = prices.withColumnRenamed("ticker", "_ticker")
    cond = (F.col("ticker") == F.col("_ticker")) & (F.col("date") == F.col("trade_date"))
    return daily.join(right, cond, "left").drop("_ticker")


def asof_forward(
    left: DataFrame,
    right: DataFrame,
    by: str = "ticker",
    left_on: str = "date",
    right_on: str = "trade_date",
    bucket_days: int = 32,
    unique_left: bool = False,
) -> DataFrame:
    """For each left row the first right row of the same key at or after its date.

    Left join, no tolerance; where several right rows share key and date, any one of them.

    A window per key alone would run on as many tasks as there are keys and hold a hot key
    in one of them.  Time is therefore cut into buckets of ``bucket_days``, and the window
    runs per (key, bucket).  So that it always finds a row, the first right row of every
    bucket is copied into the buckets before it, back to the last one that has right rows;
    these copies number at most one per key and bucket.

    Many left rows may share key and date.  Unless the caller knows better (``unique_left``,
    as for the daily table), the window sees each (key, date) once, reduced in every task,
    and the result is joined back: by broadcast where it is small, else by a join whose hot
    partitions adaptive execution splits.
    """
    values = [c for c in right.columns if c != by]
    clash = [c for c in values if c in left.columns]
    if clash:
        raise ValueError(f"columns on both sides: {clash}")

    if not unique_left:
        known = left.where(F.col(by).isNotNull() & F.col(left_on).isNotNull())
        keys = known.select(by, left_on).distinct()
        mapped = asof_forward(keys, right, by, left_on, right_on, bucket_days, unique_left=True)
        mapped = mapped.withColumnsRenamed({by: "_by", left_on: "_at"})
        same = (F.col(by) == F.col("_by")) & (F.col(left_on) == F.col("_at"))
        return left.join(mapped, same, "left").drop("_by", "_at")

    def bucket(col: str) -> Column:
        return F.floor(F.unix_date(F.to_date(F.col(col))) / F.lit(bucket_days)).cast("long")

    r = right.where(F.col(right_on).isNotNull() & F.col(by).isNotNull()).select(
        F.col(by).alias("_by"),
        F.col(right_on).alias("_at"),
        bucket(right_on).alias("_b"),
        F.struct(*values).alias("_r"),
    )
    lefts = left.select(
        F.col(by).alias("_by"),
        F.col(left_on).alias("_at"),
        bucket(left_on).alias("_b"),
        F.struct(*left.columns).alias("_l"),
    )

    # Left rows older than all right rows share one bucket ahead of them.
    oldest = r.agg(F.min("_b") - 1).scalar()
    lefts = lefts.withColumn("_b", F.greatest("_b", oldest))

    # One row per key and bucket, reduced in every task before the shuffle.
    firsts = r.groupBy("_by", "_b").agg(F.min("_at").alias("_at"), F.min_by("_r", "_at").alias("_r"))
    by_bucket = Window.partitionBy("_by").orderBy("_b")
    copies = firsts.withColumn("_from", F.coalesce(F.lag("_b").over(by_bucket), oldest)).select(
        "_by", "_at", F.explode(F.sequence("_from", F.col("_b") - 1)).alias("_b"), "_r"
    )

    both = (
        r.unionByName(copies)
        .withColumn("_side", F.lit(1))
        .unionByName(lefts.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    )
    # Latest first, so that the frame grows row by row.  At equal dates the right row is
    # seen before the left ones, so an exact match counts.
    seen = (
        Window.partitionBy("_by", "_b")
        .orderBy(F.desc("_at"), F.desc("_side"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = both.withColumn("_hit", F.last("_r", ignorenulls=True).over(seen)).where("_side = 0")
    # A row without key or date has nothing to be aligned with.
    hit = F.when(F.col("_by").isNotNull() & F.col("_at").isNotNull(), F.col("_hit"))
    return found.select("_l.*", *[hit[c].alias(c) for c in values])
