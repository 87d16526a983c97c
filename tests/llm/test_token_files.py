"""Token files: round trip against the tokenizers library, random access, damage."""

import glob
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from tickertide.llm import token_files as tf
from tickertide.llm.chunk_ids import ChunkIds, byte_pair_ids, text_slices
from tickertide.llm.queries import public_path
from tickertide.session import scratch_path

END = 2


def path_of():
    return public_path("byte_bpe_50k.json")


def encoded(texts):
    found = Tokenizer.from_file(path_of()).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array([*e.ids, END], dtype="<u4") for e in found]


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out, start = [], 0
    for (doc, _), ids in zip(rows, encoded([t for _, t in rows]), strict=True):
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def read_back(spark, rows, **sizes):
    frame = spark.createDataFrame([(*r, 7, "s") for r in rows], "doc_id long, text string, shard int, body string")
    path = scratch_path(spark, "token-files")
    tf.write_token_files(frame.repartition(3), path, path_of(), END, **sizes)
    found = sorted([tuple(r) for r in tf.token_digests(spark, path).collect()], key=lambda r: r[1])
    return path, found


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    _, found = read_back(spark, rows, frame_ids=3000, file_bytes=50_000)
    assert found == expected(rows)


ODD = [None, "", " ", "  a  b ", "x\n\ny\t z", "a<|endoftext|> b", "\x1c x", "一　 二", "x\x85 y\xa0 z", "it's I'll", "é" * 5]


def test_odd_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "n"), (None, "m"), (3, "b"), (3, "a"), (3, "a"), (-5, "q")]
    rows += [(50, "word " * 300_000 + "end"), (51, "y" * 20_000)]
    for sizes in ({}, {"frame_ids": 1, "file_bytes": 1}):
        assert read_back(spark, rows, **sizes)[1] == expected(rows)


def test_empty_table(spark):
    assert read_back(spark, [])[1] == []


def test_only_requested_documents_are_unpacked(spark):
    rows = [(k, f"text number {k}") for k in range(3000)]
    path, _ = read_back(spark, rows, frame_ids=500, file_bytes=2000)
    found = tf.read_token_files(spark, path, [5, 2900, 99999]).collect()
    ids = dict(zip([5, 2900], encoded(["text number 5", "text number 2900"]), strict=True))
    assert {r.doc_id: np.frombuffer(bytes(r.ids), "<u2").tolist() for r in found} == {k: v.tolist() for k, v in ids.items()}
    file = max(glob.glob(f"{path}/*/part-*"))
    reader = tf.FrameReader(open(file, "rb").read())
    first = reader.unpacked
    assert len(reader.records_with(np.array([reader.places[0][0]]))) == 1
    reader.documents(0)
    assert (first, reader.unpacked) == (1, 2)


def test_any_decoder_reads_a_file_and_damage_is_found(spark):
    path, _ = read_back(spark, [(k, f"text {k}") for k in range(400)], frame_ids=300)
    data = open(glob.glob(f"{path}/*/part-*")[0], "rb").read()
    reader = tf.FrameReader(data)
    whole = b"".join(reader.content(k) for k in range(len(reader.entries)))
    stream = zstandard.ZstdDecompressor().stream_reader(data[:-1], read_across_frames=True)
    assert stream.read() == whole
    for at in (20, int(reader.starts[1]) + 30, len(data) - 20):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises((ValueError, zstandard.ZstdError)):
            damaged = tf.FrameReader(bytes(bad))
            for k in range(len(damaged.entries)):
                damaged.content(k)


def test_chunks_are_exact_with_a_small_table():
    code = byte_pair_ids(Tokenizer.from_file(path_of()))
    coder = ChunkIds(lambda x: ([code(x)], np.ones(len(x), dtype=bool)), limit=20)
    pick = np.random.default_rng(1)
    letters = ["a", "b", " ", "\n", "\t", "\xa0", "　", "\x85", "\x1c", "'s", "é", "1", "!", "<|endoftext|>", "᠎", "”"]
    texts = ["".join(pick.choice(letters, pick.integers(0, 12))) for _ in range(2000)]
    for _ in range(2):
        for data, offsets, _first in text_slices(pa.array(texts)):
            ((ids, bounds),), fits = coder.encode(data, offsets)
            found = [[*ids[a:b].tolist(), END] for a, b in zip(bounds, bounds[1:])]
            assert fits.all() and found == [e.tolist() for e in encoded(texts)]


def test_equal_hashes_are_told_apart(monkeypatch):
    from tickertide.llm import chunk_ids

    monkeypatch.setattr(chunk_ids, "_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    code = byte_pair_ids(Tokenizer.from_file(path_of()))
    coder = ChunkIds(lambda x: ([code(x)], np.ones(len(x), dtype=bool)))
    texts = ["one two six", "two one ten"]
    for data, offsets, _ in text_slices(pa.array(texts)):
        ((ids, bounds),), _ = coder.encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e[:-1].tolist() for e in encoded(texts)]
