"""Readers for raw headline files: CSV, JSON lines and mixed lists."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickertide.schemas import RAW, RAW_COLUMNS, strings

# Quotes inside a field are doubled, blanks stay blanks, and no text reads as null.  A file
# whose header differs from the schema fails instead of filling the wrong columns.
CSV_OPTIONS = {
    "header": True,
    "multiLine": True,
    "escape": '"',
    "emptyValue": "",
    "nullValue": "\u0000",
    "enforceSchema": False,
}

# Bytes read first to find a file's header, and files read at a time.
HEAD_BYTES, HEAD_READERS = 8192, 32

FILE_COLUMNS = ["file_time", "file_path", "file_row"]


def _as_list(paths: str | Iterable[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else [str(p) for p in paths]


def existing_paths(spark: SparkSession, paths: str | Iterable[str]) -> list[str]:
    """The paths and globs that match at least one file; reads file metadata only."""
    found = []
    for path in _as_list(paths):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        matches = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
        if matches is not None and len(matches) > 0:
            found.append(path)
    return found


def backfill_columns(df: DataFrame, cols: list[str] = RAW_COLUMNS, fill: str = "") -> DataFrame:
    """Exactly ``cols``, in that order; a missing column or value becomes ``fill``."""
    have = set(df.columns)
    return df.select(
        *[(F.coalesce(F.col(c), F.lit(fill)) if c in have else F.lit(fill)).alias(c) for c in cols]
    )


def _file_columns() -> list:
    return [
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_path").alias("file_path"),
        F.monotonically_increasing_id().alias("file_row"),
    ]


def _union(spark: SparkSession, frames: list[DataFrame], with_file: bool) -> DataFrame:
    if not frames:
        empty = spark.createDataFrame([], RAW)
        if with_file:
            empty = empty.withColumns(
                {
                    "file_time": F.lit(None).cast("timestamp"),
                    "file_path": F.lit(None).cast("string"),
                    "file_row": F.lit(None).cast("long"),
                }
            )
        return empty
    return reduce(lambda a, b: a.unionByName(b), frames)


def _head(spark: SparkSession, path: str) -> tuple[str, ...] | None:
    """First record of a CSV file that isn't blank; reads the file's first bytes, more only if needed.

    Compressed files are unpacked by their suffix.  A quoted line break belongs to the record.
    """
    hadoop = spark._jvm.org.apache.hadoop
    place = hadoop.fs.Path(spark._jvm.java.net.URI(path))
    conf = spark._jsc.hadoopConfiguration()
    codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
    raw = place.getFileSystem(conf).open(place)
    stream = raw if codec is None else codec.createInputStream(raw)
    data = b""
    try:
        while True:
            size = max(HEAD_BYTES, len(data))
            more = bytes(stream.readNBytes(size))
            data += more
            whole = len(more) < size
            text = data.decode("utf-8-sig", errors="replace" if whole else "ignore")
            records = csv.reader(io.StringIO(text, newline=""))
            filled = (r for r in records if "".join(r).strip())
            head = next(filled, None)
            # A record is complete when another one follows it, or nothing is left.
            if whole or head is not None and next(filled, None) is not None:
                return None if head is None else tuple(head)
    finally:
        stream.close()


def _files_by_header(spark: SparkSession, paths: list[str], recursive: bool) -> dict[tuple[str, ...], list[str]]:
    """Single files by their header.  Heads alone are read, by HEAD_READERS threads of the driver.

    Spark's reader lists the files on the driver in any case; this adds one short read for each.
    """
    if not paths:
        return {}
    files = sorted(spark.read.option("recursiveFileLookup", recursive).text(paths).inputFiles())
    with ThreadPoolExecutor(HEAD_READERS) as pool:
        heads = list(pool.map(lambda path: _head(spark, path), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, header in zip(files, heads, strict=True):
        if header is not None:
            groups.setdefault(header, []).append(re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(path)))
    return groups


def read_headlines_csv(
    spark: SparkSession, paths: str | Iterable[str], with_file: bool = False, recursive: bool = False
) -> DataFrame:
    """UTF-8 CSV files with a header, all columns text; a missing or empty file has no rows.

    Every file has its own header, also within one folder or glob: files with the same header
    share one scan, and absent columns are filled with ``""``.  ``with_file`` keeps file time,
    path and row for ordering.
    """
    frames = []
    for header, group in _files_by_header(spark, existing_paths(spark, paths), recursive).items():
        df = spark.read.options(**CSV_OPTIONS).schema(strings(list(header))).csv(group)
        if with_file:
            df = df.select("*", *_file_columns())
            keep = [F.col(c) for c in FILE_COLUMNS]
            frames.append(
                df.select(
                    *[(F.col(c) if c in header else F.lit("")).alias(c) for c in RAW_COLUMNS], *keep
                )
            )
        else:
            frames.append(backfill_columns(df))
    return _union(spark, frames, with_file)


def read_headlines_jsonl(
    spark: SparkSession, paths: str | Iterable[str], with_file: bool = False, recursive: bool = False
) -> DataFrame:
    """JSON-lines files; blank and invalid lines are skipped."""
    group = existing_paths(spark, paths)
    if not group:
        return _union(spark, [], with_file)
    df = (
        spark.read.schema(RAW)
        .option("mode", "DROPMALFORMED")
        .option("recursiveFileLookup", recursive)
        .json(group)
    )
    if not with_file:
        return backfill_columns(df)
    df = df.select("*", *_file_columns())
    return df.fillna("", subset=RAW_COLUMNS)


def union_headline_files(
    spark: SparkSession, paths: str | Iterable[str], with_file: bool = False
) -> DataFrame:
    """Mixed ``.csv`` and ``.jsonl`` files as one table; any other suffix is an error."""
    tables, lines = [], []
    for path in _as_list(paths):
        suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
        if suffix == "csv":
            tables.append(path)
        elif suffix == "jsonl":
            lines.append(path)
        else:
            raise ValueError(f"unsupported headline file format: {path}")
    frames = []
    if tables:
        frames.append(read_headlines_csv(spark, tables, with_file))
    if lines:
        frames.append(read_headlines_jsonl(spark, lines, with_file))
    return _union(spark, frames, with_file)


def raw_file_order(df: DataFrame) -> DataFrame:
    """Add ``ord``: oldest file first, then file name, then row in the file.

    Needs the file columns of a reader called with ``with_file=True``.  A multi-line CSV
    file is never split, so the row number follows the file.
    """
    return df.select(
        *[c for c in df.columns if c not in FILE_COLUMNS], F.struct(*FILE_COLUMNS).alias("ord")
    )
