"""Token-id files: independent zstandard frames, a trailing seek table and a checksum a frame.

A file is a sequence of records, each followed by a newline, as Spark's text writer puts them::

    record    = zstandard frame, skippable frame of one byte (that byte is the newline)
    file      = record of documents ..., record of the directory, seek table, newline
    documents = u32 n, u32 bytes per id, n x i64 doc_id, n x u8 (1: null doc_id), n x u64 number
                of ids, then the ids of all n documents, little-endian
    directory = per record of documents: i64 first and last doc_id, u64 documents, u64 ids
    table     = skippable frame of the seekable zstandard format: per record its u32 compressed
                and uncompressed sizes and u32 checksum (low bits of XXH64 of the content), then
                u32 number of records, descriptor byte 0x80, u32 0x8F92EAB1

Any zstandard decoder reads a file but for its last byte.  Files are written by Spark's own
committed writer, so a lost executor or a second attempt of a task leaves no part behind, and a
store that only Spark reaches will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickertide.llm.chunk_ids import ChunkIds, byte_pair_ids, ship_vocabulary, text_slices, worker_coder

# Ids after which a frame ends, and bytes after which a file ends.
FRAME_IDS = 1 << 16
FILE_BYTES = 1 << 25
LEVEL = 3
# Characters of a text by which documents of one id are ranged; within a task they sort by all.
TIE_CHARS = 200
# Files of a task are numbered from the task's own multiple of this.
TASK_FILES = 1_000_000
# Fixed values of the seekable zstandard format.
SKIPPABLE, SEEK_TABLE, SEEKABLE, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_NEWLINE = struct.pack("<II", SKIPPABLE, 1)
_ENTRY, _PLACE = struct.Struct("<III"), struct.Struct("<qqQQ")


class FrameWriter:
    """Records of one file; ``take`` returns finished ones, ``finish`` the rest."""

    def __init__(self, width: int, frame_ids: int = FRAME_IDS):
        self.width, self.frame_ids = width, frame_ids
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.entries: list[bytes] = []
        self.places: list[bytes] = []
        self.bytes = 0
        self._clear()

    def _clear(self) -> None:
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.ids: list[np.ndarray] = []
        self.held = 0

    def _record(self, content: bytes) -> bytes:
        frame = self.zip.compress(content) + _NEWLINE
        self.entries.append(_ENTRY.pack(len(frame) + 1, len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.bytes += len(frame) + 1
        return frame

    def _documents(self) -> bytes:
        known = [0 if d is None else d for d in self.docs]
        self.places.append(_PLACE.pack(known[0], known[-1], len(known), self.held))
        ids = np.concatenate(self.ids).astype(f"<u{self.width}")
        content = b"".join(
            [
                struct.pack("<II", len(known), self.width),
                np.array(known, dtype="<i8").tobytes(),
                np.array([d is None for d in self.docs], dtype="u1").tobytes(),
                np.array(self.sizes, dtype="<u8").tobytes(),
                ids.tobytes(),
            ]
        )
        self._clear()
        return self._record(content)

    def take(self, doc: int | None, ids: np.ndarray) -> list[bytes]:
        self.docs.append(doc)
        self.sizes.append(len(ids))
        self.ids.append(ids)
        self.held += len(ids)
        return [self._documents()] if self.held >= self.frame_ids else []

    def finish(self) -> list[bytes]:
        out = [self._documents()] if self.docs else []
        out.append(self._record(b"".join(self.places)))
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), HAS_CHECKSUMS, SEEKABLE)
        return [*out, struct.pack("<II", SEEK_TABLE, len(table)) + table]


class FrameReader:
    """Random access to a file's records; a wrong checksum or seek table is an error."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        self.unzip = zstandard.ZstdDecompressor()
        self.unpacked = 0
        if len(data) < 10 or bytes(self.data[-5:-1]) != struct.pack("<I", SEEKABLE):
            raise ValueError("no seek table")
        n, kind, _ = struct.unpack("<IBI", self.data[-10:-1])
        first = len(data) - 10 - _ENTRY.size * n
        if kind != HAS_CHECKSUMS or first < 8:
            raise ValueError("seek table that can't be read")
        self.entries = list(_ENTRY.iter_unpack(self.data[first:-10]))
        self.starts = np.concatenate([[0], np.cumsum([e[0] for e in self.entries], dtype=np.int64)])
        if struct.unpack("<II", self.data[first - 8 : first]) != (SEEK_TABLE, _ENTRY.size * n + 9) or self.starts[
            -1
        ] != first - 8:
            raise ValueError("seek table that doesn't fit the file")
        self.places = list(_PLACE.iter_unpack(self.content(n - 1)))

    def content(self, record: int) -> bytes:
        _, size, check = self.entries[record]
        lo, hi = int(self.starts[record]), int(self.starts[record + 1])
        content = self.unzip.decompress(self.data[lo : hi - 9], max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"record {record} is damaged")
        self.unpacked += 1
        return content

    def documents(self, record: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """doc_ids, which are null, bounds of the documents in the ids, and the ids."""
        content = self.content(record)
        n, width = struct.unpack_from("<II", content)
        docs = np.frombuffer(content, "<i8", n, 8)
        nulls = np.frombuffer(content, "u1", n, 8 + 8 * n) == 1
        sizes = np.frombuffer(content, "<u8", n, 8 + 9 * n).astype(np.int64)
        ids = np.frombuffer(content, f"<u{width}", int(sizes.sum()), 8 + 17 * n)
        return docs, nulls, np.concatenate([[0], np.cumsum(sizes)]), ids

    def records_with(self, wanted: np.ndarray) -> list[int]:
        """The records whose range of doc_ids meets one of the sorted ``wanted`` ids."""
        return [
            k
            for k, (low, high, _, _) in enumerate(self.places)
            if np.searchsorted(wanted, low) < np.searchsorted(wanted, high, side="right")
        ]


def _coder(vocabulary: bytes) -> ChunkIds:
    from tokenizers import Tokenizer

    code = byte_pair_ids(Tokenizer.from_str(vocabulary.decode()))
    return ChunkIds(lambda texts: ([code(texts)], np.ones(len(texts), dtype=bool)))


def _id_bytes(vocabulary: bytes, end_id: int) -> int:
    from tokenizers import Tokenizer

    return 2 if max(end_id + 1, Tokenizer.from_str(vocabulary.decode()).get_vocab_size()) <= 1 << 16 else 4


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary_path: str,
    end_id: int,
    frame_ids: int = FRAME_IDS,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Encodes ``doc_id, text`` and writes token files to the new folder ``path``.

    Documents are in ascending order of doc_id (null first), those of one id by text, in each
    file, and files by number; rows that repeat are documents of their own.  Null and empty texts
    have ``end_id`` alone.  An empty table gives a folder without token files.  Other columns are
    ignored.  ``vocabulary_path`` names a byte-level BPE file of the tokenizers library.  Texts
    are ranged by id and the beginning of the text, so an id that a third of the rows share is
    spread over tasks; a task holds the ids of one slice of texts and one frame.
    """
    spark = docs.sparkSession
    vocabulary = ship_vocabulary(spark, vocabulary_path)
    width = _id_bytes(vocabulary.value, end_id)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    ranged = rows.repartitionByRange(F.asc_nulls_first("doc_id"), F.substring("text", 1, TIE_CHARS))
    ranged = ranged.sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder("byte-level", _coder, vocabulary.value)
        shard = TaskContext.get().partitionId() * TASK_FILES
        writer, seq = None, 0
        end = np.array([end_id], dtype=np.uint32)

        def batch(records: list[bytes]) -> pa.RecordBatch:
            nonlocal seq
            places = list(range(seq, seq + len(records)))
            seq += len(records)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * len(records), pa.int64()),
                    pa.array(places, pa.int64()),
                    pa.array(records, pa.binary()),
                ],
                names=["shard", "seq", "body"],
            )

        for b in batches:
            ids_of = b.column(0).to_pylist()
            for data, offsets, first in text_slices(b.column(1)):
                ((ids, bounds),), _ = coder.encode(data, offsets)
                for k in range(len(offsets) - 1):
                    writer = writer or FrameWriter(width, frame_ids)
                    own = np.append(ids[bounds[k] : bounds[k + 1]], end)
                    records = writer.take(ids_of[first + k], own)
                    if writer.bytes >= file_bytes:
                        yield batch(records + writer.finish())
                        writer, shard = None, shard + 1
                    elif records:
                        yield batch(records)
        if writer is not None:
            yield batch(writer.finish())

    frames = ranged.mapInArrow(write, "shard long, seq long, body binary").sortWithinPartitions("shard", "seq")
    (
        frames.select("shard", F.col("body").cast("string").alias("value"))
        .write.mode("errorifexists")
        .option("compression", "none")
        .partitionBy("shard")
        .text(path)
    )


READ = "shard long, seq long, doc_id long, at long, n_tokens long, ids binary"


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    # The folder of an empty table has no file and so no shard.
    shard = F.col("shard") if "shard" in files.columns else F.lit(None)
    return files.select(shard.cast("long").alias("shard"), "content")


def file_directory(spark: SparkSession, path: str) -> DataFrame:
    """``shard, frame, first_id, last_id, n_docs, n_ids``: where documents lie; no document is unpacked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                places = FrameReader(b.column(1)[k].as_buffer()).places
                columns = [list(c) for c in zip(*places, strict=True)] or [[]] * 4
                arrays = [pa.array(c, pa.int64()) for c in ([b.column(0)[k].as_py()] * len(places), range(len(places)))]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, *(pa.array(c, pa.int64()) for c in columns)],
                    names=["shard", "frame", "first_id", "last_id", "n_docs", "n_ids"],
                )

    types = "shard long, frame long, first_id long, last_id long, n_docs long, n_ids long"
    return _files(spark, path).mapInArrow(read, types)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``shard, seq, doc_id, at, n_tokens, ids, ids_crc32`` of all documents, or of those in ``doc_ids``.

    ``at`` is the number of ids before the document in its file, ``ids`` little-endian as stored.
    With ``doc_ids`` only files and frames that can hold one of them are opened and unpacked.
    """
    wanted = None if doc_ids is None else np.array(sorted(set(doc_ids)), dtype=np.int64)
    files = _files(spark, path)
    if wanted is not None:
        near = F.exists(
            F.lit(wanted.tolist()).cast("array<long>"), lambda d: d.between(F.col("first_id"), F.col("last_id"))
        )
        # At most a file for each wanted id and its ties.
        shards = [r.shard for r in file_directory(spark, path).where(near).select("shard").distinct().collect()]
        files = files.where(F.col("shard").isin(shards))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                reader = FrameReader(b.column(1)[k].as_buffer())
                before = np.concatenate([[0], np.cumsum([p[3] for p in reader.places], dtype=np.int64)])
                earlier = np.concatenate([[0], np.cumsum([p[2] for p in reader.places], dtype=np.int64)])
                records = range(len(reader.places)) if wanted is None else reader.records_with(wanted)
                for record in records:
                    docs, nulls, bounds, ids = reader.documents(record)
                    rows = np.arange(len(docs))
                    if wanted is not None:
                        rows = np.flatnonzero(np.isin(docs, wanted) & ~nulls)
                    parts = [ids[bounds[r] : bounds[r + 1]] for r in rows.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([b.column(0)[k].as_py()] * len(rows), pa.int64()),
                            pa.array(rows + earlier[record]),
                            pa.array(docs[rows], pa.int64(), mask=nulls[rows]),
                            pa.array(bounds[rows] + before[record], pa.int64()),
                            pa.array([len(p) for p in parts], pa.int64()),
                            pa.array([p.tobytes() for p in parts], pa.binary()),
                            pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                        ],
                        names=["shard", "seq", "doc_id", "at", "n_tokens", "ids", "ids_crc32"],
                    )

    return files.mapInArrow(read, READ + ", ids_crc32 long")


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """``shard, file_start``: the ids of all files before each, summed by task and then within it."""
    totals = (
        file_directory(spark, path)
        .groupBy("shard", F.floor(F.col("shard") / TASK_FILES).alias("task"))
        .agg(F.sum("n_ids").alias("n"))
    )
    before = (Window.unboundedPreceding, -1)
    tasks = totals.groupBy("task").agg(F.sum("n").alias("n"))
    tasks = tasks.select("task", F.sum("n").over(Window.orderBy("task").rowsBetween(*before)).alias("task_start"))
    inside = F.sum("n").over(Window.partitionBy("task").orderBy("shard").rowsBetween(*before))
    zero = F.lit(0)
    return (
        totals.withColumn("inside", inside)
        .join(tasks, "task")
        .select("shard", (F.coalesce("task_start", zero) + F.coalesce("inside", zero)).alias("file_start"))
    )


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files."""
    docs = read_token_files(spark, path).select("shard", "doc_id", "at", "n_tokens", "ids_crc32")
    return docs.join(file_starts(spark, path), "shard").select(
        "doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
