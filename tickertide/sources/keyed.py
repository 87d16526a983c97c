"""Parquet tables with a unique key: rows in buckets of the key's hash, batches listed in a log.

Layout below the table's folder::

    batch=<name>/bucket=<n>/part-*.parquet    rows; bucket is the key's hash modulo the number of buckets
    _log/<version>                            JSON: number of buckets, key columns, names of the live batches

A reader takes the batches that the highest version lists.  Rows are stored with a digest of their
key; an insert reads the digests of those buckets alone that its rows fall into, writes a new batch
and then the next version.  Keys of older batches without digests are read themselves.  A
version can be written once only; whoever comes second finds it taken, drops its batch and starts
again from the new version.  So each key is stored once however many writers there are, and a run
that dies leaves an unlisted batch, which no reader sees.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tickertide.session import staged

# Choose about a bucket for each gigabyte of key columns where a table grows large.
BUCKETS = 16
# Batches of a level (rows inserted, merged once, twice ...) after which an insert merges them into
# one of the next, so that a row is written anew once a level and not by every merge.
MERGE_AT = 32
# Digests of so many rows at most are sent to the tasks that scan the stored ones, and dealt
# over as few tasks as their number asks for: a shuffle to many costs a file for each, a batch.
SENT_ROWS = 500_000
TASK_ROWS = 100_000
# A merge's task takes about so many bytes of a bucket's files; so many buckets are one job.
MERGED_BYTES = 64 << 20
MERGED_BUCKETS = 64
DIGEST = "_key_digest"
ATTEMPTS = 50


@dataclass(frozen=True)
class State:
    """One version of a table."""

    version: int = 0
    buckets: int = BUCKETS
    keys: tuple[str, ...] = ()
    batches: tuple[str, ...] = field(default=())


def _hadoop(spark: SparkSession, path: str) -> tuple[object, object]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def table_state(spark: SparkSession, path: str) -> State:
    """The table's newest version; version 0 where there is none.

    A folder of plain Parquet files is no keyed table: it is refused, not taken for an empty one.
    """
    fs, log = _hadoop(spark, f"{path}/_log")
    if not fs.exists(log):
        _, place = _hadoop(spark, path)
        if fs.exists(place) and any(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(place)):
            raise ValueError(f"{path} holds Parquet files without a log: insert their rows into a new table")
        return State()
    names = [f.getPath().getName() for f in fs.listStatus(log)]
    versions = [int(n) for n in names if n.isdigit()]
    if not versions:
        return State()
    newest = max(versions)
    fs, place = _hadoop(spark, f"{path}/_log/{newest:012d}")
    stream = fs.open(place)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    said = json.loads(text)
    return State(newest, said["buckets"], tuple(said["keys"]), tuple(said["batches"]))


def _commit(spark: SparkSession, path: str, state: State) -> bool:
    """Writes a version unless someone else has written it.

    The text is written aside first, so a version is there whole or not at all.  Renaming onto an
    existing name fails on HDFS and its like; on a local disk it doesn't, so a hard link is made.
    """
    text = json.dumps({"buckets": state.buckets, "keys": state.keys, "batches": state.batches})
    aside, target = f"{path}/_log/.{uuid.uuid4().hex}", f"{path}/_log/{state.version:012d}"
    fs, place = _hadoop(spark, aside)
    stream = fs.create(place, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    _, end = _hadoop(spark, target)
    if fs.getUri().getScheme() != "file":
        return bool(fs.rename(place, end))
    try:
        os.link(place.toUri().getPath(), end.toUri().getPath())
    except FileExistsError:
        return False
    finally:
        fs.delete(place, False)
    return True


def _drop_batch(spark: SparkSession, path: str, name: str) -> None:
    fs, place = _hadoop(spark, f"{path}/batch={name}")
    fs.delete(place, True)


def _rows_of(spark: SparkSession, path: str, schema: StructType, state: State) -> DataFrame:
    full = StructType([*schema.fields]).add("bucket", IntegerType())
    if not state.batches:
        return spark.createDataFrame([], full)
    places = [f"{path}/batch={name}" for name in state.batches]
    return spark.read.schema(full).option("basePath", path).parquet(*places).select(*full.names)


def read_keyed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All stored rows; an absent table is empty."""
    return _rows_of(spark, path, schema, table_state(spark, path)).drop("bucket")


def bucket_of(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def stored_keys(
    spark: SparkSession, path: str, schema: StructType, state: State, buckets: list[int]
) -> DataFrame:
    """Key columns of the stored rows of some buckets; the other buckets' folders are not opened."""
    rows = _rows_of(spark, path, schema, state)
    return rows.where(F.col("bucket").isin(buckets)).select(*state.keys, "bucket")


def key_digest(keys: tuple[str, ...]) -> Column:
    """128 bits that name a key; a null differs from any value."""
    parts = [F.col(k).cast("string") for k in keys]
    sized = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.unhex(F.substring(F.sha2(F.concat(*sized), 256), 1, 32))


def _name(level: int = 0) -> str:
    return f"k{level}-{uuid.uuid4().hex}"


def _level(name: str) -> int | None:
    """How often a batch's rows were merged; None for a batch without digests."""
    return int(name[1:].split("-")[0]) if name.startswith("k") else None


def _stored_digests(
    spark: SparkSession, path: str, schema: StructType, state: State, buckets: list[int]
) -> DataFrame:
    """Key digests of the stored rows of some buckets."""
    own = tuple(n for n in state.batches if _level(n) is not None)
    older = tuple(n for n in state.batches if _level(n) is None)
    rows = _rows_of(spark, path, StructType().add(DIGEST, "binary"), replace(state, batches=own))
    found = rows.where(F.col("bucket").isin(buckets)).select(DIGEST)
    if older:
        keys = stored_keys(spark, path, schema, replace(state, batches=older), buckets)
        found = found.unionAll(keys.select(key_digest(state.keys)))
    return found


def _dealt(digests: DataFrame, rows: int) -> DataFrame:
    """By digest over a task for each ``TASK_ROWS``; left alone where there may be more than are sent."""
    return digests.repartition(math.ceil(rows / TASK_ROWS), DIGEST) if rows <= SENT_ROWS else digests


def _unstored(firsts: DataFrame, stored: DataFrame, rows: int) -> DataFrame:
    """Of ``rows`` digests at most those that aren't stored; the table is only scanned."""
    wanted = firsts.select(DIGEST)
    wanted = F.broadcast(wanted) if rows <= SENT_ROWS else wanted
    hits = _dealt(stored.join(wanted, DIGEST, "left_semi"), rows).distinct()
    return firsts.join(hits, DIGEST, "left_anti")


def _write(rows: DataFrame, path: str, name: str) -> int:
    """Writes a batch; returns its rows.  A bucket with most rows is split, small ones share tasks."""
    place = f"{path}/batch={name}"
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(place)
    # From the files' footers.
    return rows.sparkSession.read.schema(rows.schema).parquet(place).count()


def insert_new(
    spark: SparkSession,
    path: str,
    rows: DataFrame,
    keys: tuple[str, ...],
    buckets: int = BUCKETS,
    merge_at: int = MERGE_AT,
    order: str | None = None,
) -> int:
    """Adds the rows whose key the table doesn't have; returns their number.

    ``rows`` have distinct keys (null is a value), or a column ``order``, which isn't stored: of
    the rows of a key the first in that order counts.  ``buckets`` and ``keys`` are fixed by the first
    insert.  At most ``ATTEMPTS`` other writers may get in between.

    What is compared, between the rows and with the table, are digests; whole rows are written
    once aside, and those that are new move once, to their buckets.
    """
    state = table_state(spark, path)
    keys, buckets = (state.keys, state.buckets) if state.version else (tuple(keys), buckets)
    schema = StructType([f for f in rows.schema.fields if f.name != order])
    # What led to the batch runs once, however often a version is taken by another writer.
    marked = rows.withColumns(
        {"bucket": bucket_of(keys, buckets), DIGEST: key_digest(keys), "_row": F.monotonically_increasing_id()}
    )
    with staged(marked, "batch", compression="zstd") as batch:
        return _insert(spark, path, batch, state, schema, keys, buckets, merge_at, order)


def _insert(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    state: State,
    schema: StructType,
    keys: tuple[str, ...],
    buckets: int,
    merge_at: int,
    order: str | None,
) -> int:
    """Adds those rows of a batch written aside, with bucket, digest and number, that are new."""
    # At most one number for each bucket.
    counted = batch.groupBy("bucket").count().collect()
    touched, size = sorted(r["bucket"] for r in counted), sum(r["count"] for r in counted)
    if not touched:
        return 0
    firsts = batch.select(DIGEST, "_row")
    if order is not None:
        rank = F.min(F.struct(order, "_row")).alias("first")
        firsts = _dealt(batch.select(DIGEST, order, "_row"), size).groupBy(DIGEST).agg(rank)
        firsts = firsts.select(DIGEST, F.col("first._row").alias("_row"))
    for attempt in range(ATTEMPTS):
        if state.version and (state.keys, state.buckets) != (keys, buckets):
            raise ValueError(f"{path} has keys {state.keys} in {state.buckets} buckets")
        known = State(state.version, buckets, keys, state.batches)
        new = firsts
        if state.batches:
            new = _unstored(firsts, _stored_digests(spark, path, schema, known, touched), size)
        name = _name()
        with staged(new.select("_row"), "new") as new:
            adding = new.count()
            if not adding:
                return 0
            fresh = batch
            if adding < size:
                fresh = batch.join(F.broadcast(new) if adding <= SENT_ROWS else new, "_row", "left_semi")
            added = _write(fresh.select(*schema.names, DIGEST, "bucket"), path, name)
        if _commit(spark, path, State(state.version + 1, buckets, keys, (*state.batches, name))):
            _merge_levels(spark, path, schema, merge_at)
            return added
        _drop_batch(spark, path, name)
        time.sleep(min(1.0, 0.01 * 2**attempt))
        state = table_state(spark, path)
    raise RuntimeError(f"{path}: {ATTEMPTS} attempts were overtaken by other writers")


def _merge_levels(spark: SparkSession, path: str, schema: StructType, merge_at: int) -> None:
    """Merges the batches of every level that has ``merge_at`` of them, lowest first."""
    level = 0
    while True:
        names = table_state(spark, path).batches
        own = tuple(n for n in names if (_level(n) or 0) == level)
        if len(own) >= max(merge_at, 2):
            if not merge_batches(spark, path, schema, own):
                return
        elif not any((_level(n) or 0) > level for n in names):
            return
        level += 1


def _bucket_bytes(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[int, int]:
    """Bytes of some batches' files by bucket."""
    sizes: dict[int, int] = {}
    for name in names:
        fs, files = _hadoop(spark, f"{path}/batch={name}/bucket=*/*.parquet")
        for f in fs.globStatus(files):
            bucket = int(f.getPath().getParent().getName().removeprefix("bucket="))
            sizes[bucket] = sizes.get(bucket, 0) + f.getLen()
    return sizes


def merge_batches(
    spark: SparkSession, path: str, schema: StructType, names: tuple[str, ...] | None = None
) -> bool:
    """Writes live batches (all, or those of ``names``) as one; False if another writer came in between.

    The old batches are no longer listed but stay for those who read them; ``remove_unlisted``
    deletes them later.
    """
    state = table_state(spark, path)
    own = tuple(n for n in state.batches if names is None or n in names)
    if len(own) < 2:
        return True
    name = _name(1 + max(_level(n) or 0 for n in own))
    sizes = _bucket_bytes(spark, path, own)
    rows = _rows_of(spark, path, StructType([*schema.fields]).add(DIGEST, "binary"), replace(state, batches=own))
    rows = rows.withColumn(DIGEST, F.coalesce(DIGEST, key_digest(state.keys)))
    for k in range(0, len(sizes), MERGED_BUCKETS):
        # A bucket's files are read by tasks of their own, so no row is shuffled.
        parts = [
            rows.where(F.col("bucket") == b).coalesce(max(1, math.ceil(size / MERGED_BYTES)))
            for b, size in sorted(sizes.items())[k : k + MERGED_BUCKETS]
        ]
        merged = reduce(DataFrame.unionAll, parts).write.mode("append").partitionBy("bucket")
        merged.option("compression", "zstd").parquet(f"{path}/batch={name}")
    kept = tuple(n for n in state.batches if n not in own)
    if _commit(spark, path, State(state.version + 1, state.buckets, state.keys, (name, *kept))):
        return True
    _drop_batch(spark, path, name)
    return False


def remove_unlisted(spark: SparkSession, path: str, older_than_hours: float = 24.0) -> list[str]:
    """Deletes batches that no version lists any more (or never did) and that are old enough."""
    fs, place = _hadoop(spark, path)
    before = (time.time() - 3600 * older_than_hours) * 1000
    # Listed before the state is read: a batch committed meanwhile is in the state.
    found = [f for f in fs.listStatus(place) if f.getPath().getName().startswith("batch=")]
    live = set(table_state(spark, path).batches)
    gone = []
    for f in found:
        name = f.getPath().getName().removeprefix("batch=")
        if name not in live and f.getModificationTime() <= before:
            _drop_batch(spark, path, name)
            gone.append(name)
    return gone
