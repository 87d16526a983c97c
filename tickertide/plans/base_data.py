"""Raw headline files to the matched, AI-related, duplicate-free base table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickertide.operators.dedup import dedup_base
from tickertide.operators.matching import match_tickers
from tickertide.schemas import BASE_KEYS, MATCHED_COLUMNS
from tickertide.sources.headlines import raw_file_order, union_headline_files
from tickertide.sources.lexicon import MatchingTables
from tickertide.sources.writers import write_csv_full_rebuild


def base_data(raw: DataFrame, tables: MatchingTables, ord: str = "ord", strategy: str = "auto") -> DataFrame:
    """Matched AI rows, first row kept per (posted_at, url, ticker).

    ``raw`` carries its order in ``ord``.  Matching needs no shuffle; the dedupe is the only one.
    """
    matched = match_tickers(raw, tables.lexicon, tables.ai_terms, strategy, ai_only=True)
    return dedup_base(matched, ord).select(*MATCHED_COLUMNS)


def base_data_counts(raw: DataFrame, tables: MatchingTables) -> DataFrame:
    """Rows matched, AI-related among them, and left after the dedupe, as (stage, rows).

    One aggregate: the texts are searched once.  Where ``raw`` carries the file columns in
    ``ord``, a stage ``files_read`` counts the files with rows; that reads no texts.
    """
    matched = match_tickers(raw, tables.lexicon, tables.ai_terms)
    per_key = matched.groupBy(*BASE_KEYS).agg(
        F.count(F.lit(1)).alias("matched"), F.count_if("is_ai_related").alias("ai_related")
    )
    none = F.lit(0).cast("long")
    totals = per_key.agg(
        F.coalesce(F.sum("matched"), none).alias("matched"),
        F.coalesce(F.sum("ai_related"), none).alias("ai_related"),
        F.count_if(F.col("ai_related") > 0).alias("deduped"),
    )
    stages = [F.struct(F.lit(s).alias("stage"), F.col(s).alias("rows")) for s in totals.columns]
    counts = totals.select(F.inline(F.array(*stages)))
    if not isinstance(raw.schema["ord"].dataType, StructType) or "file_path" not in raw.schema["ord"].dataType.names:
        return counts
    files = raw.agg(F.count_distinct("ord.file_path").alias("rows"))
    return files.select(F.lit("files_read").alias("stage"), "rows").unionByName(counts)


def build_base_data(
    spark: SparkSession, raw_paths: list[str], tables: MatchingTables, out_path: str
) -> None:
    """Full rebuild of the base table from all raw files, oldest file first."""
    raw = raw_file_order(union_headline_files(spark, raw_paths, with_file=True))
    write_csv_full_rebuild(base_data(raw, tables), out_path, [F.col(c) for c in BASE_KEYS])
