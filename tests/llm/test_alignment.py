"""Cross-tokenizer alignment against a plain walk over both token lists."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tickertide.llm import alignment as al
from tickertide.llm.queries import public_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [None, "", " ", "  a  b ", "é ½ ﬁ", "x▁y", "a\n\n b\tc", "<|endoftext|> <s> </s><unk> <0x41>", "日本語 テ", "\x00", "\n", "a  "]


def expected(rows):
    a_coder = Tokenizer.from_file(public_path(A_FILE))
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=public_path(B_FILE))
    a_bytes, b_bytes = al.token_bytes(a_coder, b_coder)

    def spans(ids, entries):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(entries[i]), i))
            at += len(entries[i])
        return out

    per, texts = [], Counter()
    for doc, text in rows:
        a = a_coder.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_coder.encode(text) if text else []
        given = f" {text}".encode()
        if b"".join(a_bytes[i] for i in a) != given or b"".join(b_bytes[i] for i in b) != given:
            per.append((doc, [], [], []))
            continue
        a, b = spans(a, a_bytes), spans(b, b_bytes)
        links, j = [], 0
        for low, high, x in a:
            while b[j][1] <= low:
                j += 1
            k = j
            while k < len(b) and b[k][0] < high:
                links.append((x, b[k][2]))
                k += 1
        texts.update(set(links))
        per.append((doc, a, b, links))
    top = defaultdict(int)
    for (x, _), n in texts.items():
        top[x] = max(top[x], n)
    out = []
    for doc, a, b, links in per:
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        sides = [defaultdict(list), defaultdict(list)]
        for side, tokens in zip(sides, (a, b), strict=True):
            for _, e, x in tokens:
                side[bisect_left(ends, e)].append(str(x))
        said = ";".join(",".join(sides[0][k]) + "|" + ",".join(sides[1][k]) for k in range(len(ends)))
        digest = hashlib.sha256(said.encode()).hexdigest() if a else ""
        best = sum(texts[x] == top[x[0]] for x in links)
        out.append((doc, len(a), len(b), len(ends), len(links), best, sum(texts[x] for x in links), digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("work, common", [(al.PIECE_ENDS, al.COMMON_PAIRS), (7, 100), (64, 0)])
def test_texts_equal_a_plain_walk(spark, work, common):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(120)
    rows = [tuple(r) for r in docs.collect()]
    rows += [(900_000 + k, t) for k, t in enumerate(ODD)] + [(None, "n"), (900_003, "b"), (900_003, "b")]
    rows += [(910_000, "a" * 3000), (910_001, "long text, " * 50_000)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, pairs string")
    aligned = al.align_texts(frame.repartition(3), public_path(A_FILE), public_path(B_FILE), work)
    found = al.alignment_report(aligned, common)
    assert sorted([tuple(r) for r in found.collect()], key=repr) == expected(rows)


def test_empty_table(spark):
    aligned = al.align_texts(
        spark.createDataFrame([], "doc_id long, text string"), public_path(A_FILE), public_path(B_FILE)
    )
    assert al.alignment_report(aligned).collect() == []


def test_no_token_crosses_a_chunk():
    """Chunks are exact because no piece holds a blank behind another character."""
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_path(B_FILE))
    assert not any("▁" in pieces.id_to_piece(i).lstrip("▁") for i in range(pieces.get_piece_size()))


def test_pieces_have_equal_work_and_stitch():
    pick = np.random.default_rng(2)
    for _ in range(200):
        n = int(pick.integers(1, 60))
        ea = np.sort(pick.choice(np.arange(1, 100), size=min(n, 60), replace=False))
        eb = np.sort(pick.choice(np.arange(1, 100), size=int(pick.integers(1, 60)), replace=False))
        ea, eb = np.unique(np.append(ea, 100)), np.unique(np.append(eb, 100))
        for work in (1, 2, 5, 1000):
            i, j = al.merge_cuts(ea, eb, work)
            size = np.diff(i) + np.diff(j)
            assert (size[:-1] == work).all() and size[-1] <= work and (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()
            links, closed = al.merged_links(ea, eb, work)
            ends = np.union1d(ea, eb)
            assert links[0].tolist() == ends.tolist()
            assert links[1].tolist() == np.searchsorted(ea, ends).tolist()
            assert links[2].tolist() == np.searchsorted(eb, ends).tolist()
            assert ends[closed].tolist() == np.intersect1d(ea, eb).tolist()
