"""Each stage of the pipeline against plain Python over what its predecessor kept."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import tokenizers

import corpus_pipeline
from tickertide.llm import mixing, quality, toxicity
from tickertide.llm.queries import vocabulary_path
from tickertide.session import cut_lineage

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall((text or "").encode().lower().decode())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def one_of_each_class(rows):
    sets = [shingles(r.text) for r in rows]
    low = list(range(len(rows)))

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and len(a & b) / len(a | b) >= 0.8):
                low[max(root(i), root(j))] = min(root(i), root(j))
    best = {}
    for k, r in enumerate(rows):
        best[root(k)] = min(best.get(root(k), r.doc_id), r.doc_id)
    return set(best.values())


@pytest.mark.skipif(not Path(DATA).exists(), reason="given tables absent")
def test_stages_equal_plain_python(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        kept.append(docs)
        docs = cut_lineage(stage(spark, docs, DATA), "stage")
    raw, good, clean, single, mixed = [sorted(d.collect(), key=lambda r: r.doc_id) for d in kept]
    names = kept[0].columns
    assert all(d.columns == names for d in kept)

    model = quality.train_quality(kept[0], labels)
    x = quality.document_statistics(pa.array([r.text for r in raw], pa.string()))
    assert good == [r for r, s in zip(raw, model.score(x), strict=True) if s >= 0.7] and 0 < len(good) < len(raw)

    grammar = toxicity.train_toxicity(kept[1], labels)
    scores = grammar.score([r.text or "" for r in good], toxicity.Lexicon(grammar.insults))
    assert clean == [r for r, s in zip(good, scores, strict=True) if s < 0.5]

    ids = one_of_each_class(clean)
    assert single == [r for r in clean if r.doc_id in ids]

    sizes = Counter()
    for r in single:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    taken = Counter()
    words = {r.doc_id: Counter(WORD.findall(r.text or "")) for r in single}
    got = {}
    for r in mixed:
        taken[r.source] += len(WORD.findall(r.text))
        got.setdefault(r.doc_id, Counter()).update(WORD.findall(r.text))
    for source, target in mixing.targets(dict(sizes)).items():
        assert abs(taken[source] - float(target)) <= 2
    # A document's words come from it, none more than three times as often.
    assert all(n <= 3 * words[d][w] for d, c in got.items() for w, n in c.items())

    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    library.no_truncation()
    library.no_padding()
    want = Counter()
    for r in mixed:
        code = library.encode(r.text or "", add_special_tokens=False).ids
        said = library.decode(code, skip_special_tokens=False)
        want[r.doc_id, len(code), np.array(code, "<u4").tobytes(), hashlib.sha256(said.encode()).hexdigest()] += 1
    assert want == Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in docs.collect())
