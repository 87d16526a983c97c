"""Sinks, and the jobs that rewrite landed files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickertide.functions.dates import landed_day, landed_file_name
from tickertide.operators.dedup import dedup_headline_url, first_keep_dedup
from tickertide.schemas import RAW, RAW_COLUMNS, SCORE_KEYS, SCORES
from tickertide.session import cut_lineage
from tickertide.sources.headlines import existing_paths, read_headlines_csv
from tickertide.sources.keyed import insert_new, read_keyed

CSV_WRITE = {"header": True, "escape": '"', "emptyValue": "", "encoding": "UTF-8"}


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls written out, earlier content replaced."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv_full_rebuild(df: DataFrame, path: str, sort_cols: list[str | Column]) -> None:
    """Replace the CSV table by ``df`` in global ``sort_cols`` order, with a header.

    The sort is range-partitioned; part files in name order hold the rows in order.
    """
    df.orderBy(*sort_cols).write.mode("overwrite").options(**CSV_WRITE).csv(path)


def jsonl_to_csv(
    spark: SparkSession, in_paths: str | list[str], out_dir: str, extras: list[str] | None = None
) -> None:
    """JSON lines to CSV: canonical columns first, then ``extras`` sorted.

    Without ``extras`` they are discovered from the files' keys (one distributed pass).
    """
    paths = existing_paths(spark, in_paths)
    lines = spark.read.text(paths).where(F.trim("value") != "")
    # Valid lines only: what does not parse to an object has no keys.
    parsed = F.from_json("value", "map<string,string>")
    if extras is None:
        keys = lines.select(F.explode(F.map_keys(parsed)).alias("k")).distinct()
        # The names of the output's columns.
        extras = [r.k for r in keys.where(~F.col("k").isin(RAW_COLUMNS)).collect()]
    rows = lines.select(parsed.alias("m")).where(F.col("m").isNotNull())
    cols = RAW_COLUMNS + sorted(extras)
    rows = rows.select(*[F.try_element_at("m", F.lit(c)).alias(c) for c in cols])
    rows.write.mode("overwrite").options(**CSV_WRITE).csv(out_dir)


def jsonl_files_to_csv(spark: SparkSession, in_paths: str | list[str], out_dir: str) -> None:
    """Each JSON-lines file to CSV of its own, with the columns that the file itself has.

    ``x.jsonl`` becomes the folder ``out_dir/source_file=x.csv``, whose part files in name order hold the
    rows in the file's order: canonical columns first, then the others sorted; canonical columns
    that no line has stay away.  (Where a field has the folder's name, that gets an underscore.)  Lines that aren't objects are left out, as are files without any.
    Files are grouped by their columns, and every group is one distributed write, which splits a
    large file over tasks; the driver gets the different layouts, not the files.
    """
    place = F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    lines = spark.read.text(existing_paths(spark, in_paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("name"),
        place.alias("place"),
        F.from_json("value", "map<string,string>").alias("m"),
    )
    rows = cut_lineage(lines.where(F.col("m").isNotNull()), "lines")
    names = rows.select("path", "name").distinct().groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    if twice := names.limit(1).collect():
        raise ValueError(f"several input files are called {twice[0].name}")
    keys = rows.select("path", F.explode(F.map_keys("m")).alias("key")).distinct()
    layouts = keys.groupBy("path").agg(F.to_json(F.array_sort(F.collect_set("key"))).alias("layout"))
    laid = cut_lineage(rows.join(layouts, "path"), "lines")
    for (layout,) in laid.select("layout").distinct().collect():
        found = json.loads(layout)
        cols = [c for c in RAW_COLUMNS if c in found] + [c for c in found if c not in RAW_COLUMNS]
        values = [F.try_element_at("m", F.lit(c)).alias(c) for c in cols]
        folder = "source_file"
        while folder in [c.lower() for c in cols]:
            folder = f"_{folder}"
        (
            laid.where(F.col("layout") == layout)
            .orderBy("name", "place")
            .select(*values, F.concat("name", F.lit(".csv")).alias(folder))
            .write.mode("append")
            .options(**CSV_WRITE)
            .partitionBy(folder)
            .csv(out_dir)
        )


def daily_merge(existing: DataFrame, batch: DataFrame, ord: str | None = None) -> DataFrame:
    """Old rows of a day, then the batch: first row per (headline, url), sorted.

    Column ``ord`` orders the rows of the batch; stored rows have unique keys already and
    only need to rank before it.  Rows come out in (posted_at, headline) order.
    """
    if ord is None:
        ord = "_row"
        batch = batch.withColumn(ord, F.monotonically_increasing_id())
    kind = batch.schema[ord].dataType
    new_rank = F.struct(F.lit(1).alias("side"), F.lit(None).cast("long").alias("row"), F.col(ord).alias("ord"))
    old_rank = F.struct(
        F.lit(0).alias("side"),
        F.monotonically_increasing_id().alias("row"),
        (F.col(ord) if ord in existing.columns else F.lit(None)).cast(kind).alias("ord"),
    )

    def ranked(df: DataFrame, rank: Column) -> DataFrame:
        have = set(df.columns)
        return df.select(
            *[(F.col(c) if c in have else F.lit("")).alias(c) for c in RAW_COLUMNS], rank.alias("rank")
        )

    both = ranked(existing, old_rank).unionByName(ranked(batch, new_rank))
    order = ["rank.side", "rank.ord", "rank.row"]
    return dedup_headline_url(both, order).orderBy("posted_at", "headline", *order).drop("rank")


def merge_into_day(
    spark: SparkSession, table_path: str, batch: DataFrame, day: str, ord: str | None = None
) -> None:
    """Upsert a batch into partition ``day`` of the raw table; other days are not touched.

    Only that partition is read, and dynamic overwrite swaps it in at commit, so a lost
    executor or a failed run leaves the old rows in place.  An empty batch changes nothing.
    """
    if batch.isEmpty():
        return
    path = f"{table_path}/day={day}"
    stored = existing_paths(spark, path)
    old = spark.read.schema(RAW).parquet(path) if stored else spark.createDataFrame([], RAW)
    (
        daily_merge(old, batch, ord)
        .withColumn("day", F.lit(day))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(table_path)
    )


def compacted(rows: DataFrame) -> DataFrame:
    """Rows of landed files (with file columns) to one sorted, duplicate-free set per day.

    Days come from the file name; other names are skipped.  A day that already consists of
    its daily file only is passed through as it is.
    """
    rows = rows.withColumns(
        {"day": landed_day(F.col("file_path")), "name": landed_file_name(F.col("file_path"))}
    ).where(F.col("day").isNotNull())
    ordered = rows.select(
        *RAW_COLUMNS, "day", F.struct("name", "file_path", "file_row").alias("ord"), "name"
    )
    # One row per day: at most one per calendar day, so the join below moves no data rows.
    days = (
        rows.groupBy("day")
        .agg(F.min("name").alias("lo"), F.max("name").alias("hi"))
        .select(
            "day",
            (
                (F.col("lo") == F.col("hi"))
                & (F.col("lo") == F.concat(F.lit("headlines_"), "day", F.lit(".csv")))
            ).alias("daily_only"),
        )
    )
    flagged = ordered.join(days, "day")
    # A row of a finished day is its own key, so it never meets a duplicate.
    own = F.when(F.col("daily_only"), F.col("ord"))
    kept = first_keep_dedup(flagged.withColumn("own", own), ["day", "headline", "url", "own"], "ord")
    return kept.select("day", *RAW_COLUMNS, "ord")


def compact_daily(spark: SparkSession, in_paths: str | list[str], out_dir: str) -> None:
    """Per-run CSV files to one folder per day, in a new place.

    Range partitioning on (day, posted_at, headline) splits a day that holds most rows over
    several tasks and still leaves each day's part files in order.  Only the days present are
    replaced, whatever the session's overwrite mode.
    """
    rows = read_headlines_csv(spark, in_paths, with_file=True, recursive=True)
    (
        compacted(rows)
        .orderBy("day", "posted_at", "headline", "ord")
        .drop("ord")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**CSV_WRITE)
        .partitionBy("day")
        .csv(out_dir)
    )


def to_score_rows(processed: DataFrame) -> DataFrame:
    """Processed rows in the stored layout: key text never null, flags as 0/1/null."""
    have = set(processed.columns)
    out = []
    for field in SCORES.fields:
        col = F.col(field.name) if field.name in have else F.lit(None)
        col = col.cast(field.dataType)
        if field.name in SCORE_KEYS:
            col = F.coalesce(col, F.lit(""))
        out.append(col.alias(field.name))
    return processed.select(*out, *[c for c in ["ord"] if c in have])


def read_score_table(spark: SparkSession, path: str) -> DataFrame:
    return read_keyed(spark, path, SCORES)


def insert_or_ignore(
    spark: SparkSession, table_path: str, batch: DataFrame, keys: tuple[str, ...] = tuple(SCORE_KEYS)
) -> int:
    """Append the batch rows whose key is not stored yet; return how many were added.

    The first duplicate within the batch wins, by column ``ord`` where it is given.  Running
    the same batch again adds nothing, so a retried batch is harmless, and writers that overlap
    store each key once (see ``tickertide.sources.keyed``).
    """
    rows = to_score_rows(batch)
    if "ord" not in rows.columns:
        rows = rows.withColumn("ord", F.monotonically_increasing_id())
    return insert_new(spark, table_path, rows, keys, order="ord")


def read_scores_ordered(spark: SparkSession, path: str) -> DataFrame:
    """The whole score table by ``fetched_at``."""
    return read_score_table(spark, path).orderBy("fetched_at")
