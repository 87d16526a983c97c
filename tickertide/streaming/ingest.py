"""Micro-batch ingestion of landed headline files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickertide.operators.matching import ticker_matcher
from tickertide.schemas import MATCHED_COLUMNS, RAW, RAW_COLUMNS
from tickertide.sources.headlines import CSV_OPTIONS
from tickertide.sources.keyed import insert_new, read_keyed
from tickertide.sources.writers import insert_or_ignore


def read_stream(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    """Raw headline files of a folder as a stream, with the fixed schema."""
    reader = spark.readStream.schema(RAW).format(format)
    if format == "csv":
        reader = reader.options(**CSV_OPTIONS)
    return reader.options(**options).load(path)


def dedup_stream(raw: DataFrame, delay: str = "3 days") -> DataFrame:
    """Drop repeats of (headline, url) that arrive within ``delay`` of each other.

    The watermark follows arrival time, so no row ever counts as late and backfilled files
    lose nothing, while the state is bounded by ``delay``.  Repeats further apart pass; the sink
    of ``stream_ingest_headlines`` stops them.
    """
    return (
        raw.withColumn("arrived", F.current_timestamp())
        .withWatermark("arrived", delay)
        .dropDuplicatesWithinWatermark(["headline", "url"])
        .select(*RAW_COLUMNS)
    )


def read_raw_table(spark: SparkSession, path: str) -> DataFrame:
    """The raw table that ``stream_ingest_headlines`` writes."""
    return read_keyed(spark, path, RAW)


def stream_ingest_headlines(
    spark: SparkSession,
    path: str,
    out_path: str,
    checkpoint: str,
    delay: str = "3 days",
    format: str = "parquet",
    available_now: bool = True,
) -> StreamingQuery:
    """Landed files to the raw table, each (headline, url) once however far apart it repeats.

    Repeats within ``delay`` are dropped in the stream; each micro-batch then adds only rows
    whose key is not stored, reading the keys of those buckets alone that it falls into (see
    ``tickertide.sources.keyed``; ``read_raw_table`` reads the result).  A batch that is run again
    finds its rows stored.
    """
    stream = dedup_stream(read_stream(spark, path, format), delay)

    def add(batch: DataFrame, batch_id: int) -> None:
        insert_new(batch.sparkSession, out_path, batch.select(*RAW_COLUMNS), ("headline", "url"))

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_match_upsert(
    stream: DataFrame,
    lex: DataFrame,
    ai_terms: DataFrame,
    table: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Match each micro-batch, keep AI rows, and add those whose key is not stored.

    A batch that is run again after a failure finds its rows stored and adds nothing.  A run over
    what is there (``available_now``) reads the keyword tables once, a stream without end at every batch.
    A landed file may be one row group, which one task reads: its rows are dealt over all tasks.
    """
    once = ticker_matcher(lex, ai_terms, ai_only=True) if available_now else None

    def upsert(batch: DataFrame, batch_id: int) -> None:
        # In the stream's own session: what a batch shuffles goes with it, not when the driver collects garbage.
        batch.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        matched = (once or ticker_matcher(lex, ai_terms, ai_only=True))(batch.hint("rebalance"))
        # Within a batch files have no order: the earliest fetch is kept.
        order = F.struct("fetched_at", "posted_at", "source", "reporter").alias("ord")
        insert_or_ignore(batch.sparkSession, table, matched.select(*MATCHED_COLUMNS, order))

    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
