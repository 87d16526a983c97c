"""The language model against plain loops, and what it learns from."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tickertide.llm import lm

DOCS = [
    (1, "the cat sat on the mat . the cat ran"),
    (2, ""),
    (3, None),
    (4, "a dog and a cat \t met The MAT"),
    (5, "unseen1 unseen2 the"),
    (6, "ein Hund läuft und läuft " * 40),
    (7, "the cat sat on the mat . the cat ran"),
    (None, "rows without an id are learned from"),
]


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_states(net, places):
    """States before each token, one token and one text at a time, in double precision."""
    h, out, s = np.zeros(lm.STATE), [], lm.STATE
    for p in places:
        out.append(h)
        x = net.emb[p].astype(float) @ net.wx + net.b
        a = h @ net.wh
        z, r = sigmoid(x[:s] + a[:s]), sigmoid(x[s : 2 * s] + a[s : 2 * s])
        c = np.tanh(x[2 * s :] + r * a[2 * s :])
        h = (1 - z) * h + z * c
    return out


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def plain_probability(net, voc, counts, h, word):
    """P(word | h); None is the text end."""
    classes = softmax(h @ net.wc + net.bc)
    if word is None or word in voc.head:
        k, m = divmod(0 if word is None else voc.head[word], lm.CLASS_WORDS)
        return classes[k] * softmax(h @ net.wm[k] + net.bm[k])[m]
    t = lm.tail_class(word)
    return classes[lm.HEAD_CLASSES + t] * (counts.get(word, 0) + 1) / (voc.tail_tokens[t] + voc.tail_words[t] + 1)


@pytest.fixture
def fitted(spark, monkeypatch):
    """The scores of DOCS with a head of 7 words, with the network and vocabulary behind them."""
    monkeypatch.setattr(lm, "HEAD_WORDS", 7)
    monkeypatch.setattr(lm, "KNOWN_WORDS", 9)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 20)
    caught = {}
    train = lm.train_network

    def caught_train(docs, voc):
        caught.update(voc=voc, net=train(docs, voc), learned=docs.select("text").collect())
        return caught["net"]

    monkeypatch.setattr(lm, "train_network", caught_train)
    rows = lm.lm_scores(spark.createDataFrame(DOCS, "doc_id long, text string")).collect()
    counts = {}
    for i, t in DOCS:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            for w in lm.tokens_of(t):
                counts[w] = counts.get(w, 0) + 1
    return rows, caught, counts


def test_scores_equal_a_plain_loop(fitted):
    rows, caught, counts = fitted
    net, voc = caught["net"], caught["voc"]
    base, want = lm.HEAD_CLASSES * lm.CLASS_WORDS, []
    for i, t in DOCS:
        words = [*lm.tokens_of(t), None]
        places = [0 if w is None else voc.head.get(w, base + lm.tail_class(w)) for w in words]
        states = plain_states(net, places)
        want.append((i or -1, sum(math.log10(plain_probability(net, voc, counts, h, w)) for h, w in zip(states, words, strict=True))))
    got = sorted((r.doc_id or -1, r.score) for r in rows)
    for (i, a), (j, b) in zip(got, sorted(want), strict=True):
        assert i == j and a == pytest.approx(b, rel=1e-4)


def test_probabilities_add_up_to_one(fitted):
    _, caught, counts = fitted
    net, voc = caught["net"], caught["voc"]
    assert len(voc.head) == 7 and len(counts) > 9
    for h in plain_states(net, [64, 128, 2050, 0]):
        known = sum(plain_probability(net, voc, counts, h, w) for w in [None, *counts])
        # What a tail class keeps for words never seen.
        classes = softmax(h @ net.wc + net.bc)[lm.HEAD_CLASSES :]
        unseen = (classes / (voc.tail_tokens + voc.tail_words + 1)).sum()
        # Head classes without words.
        empty = [k for k in range(lm.HEAD_CLASSES) if k and all(p // lm.CLASS_WORDS != k for p in voc.head.values())]
        spare = softmax(h @ net.wc + net.bc)[empty].sum()
        assert known + unseen + spare == pytest.approx(1, abs=1e-6) and spare < 1e-6


def test_every_training_text_is_learned_from_once(spark, monkeypatch):
    """All tokens of the training texts, and no others, pass through backpropagation."""
    texts = [f"word{k % 11} " * (k % 17) for k in range(300)] + ["same text here"] * 150
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(lm, "SHARD_TOKENS", 200)
    counts = lm.count_tokens(docs)
    voc = lm.build_vocabulary(counts, len(texts))
    path = []
    scratch = lm.scratch_path
    monkeypatch.setattr(lm, "scratch_path", lambda s, n: path.append(scratch(s, n)) or path[-1])
    net = lm.train_network(docs, voc)
    dealt = spark.read.parquet(path[0])
    assert sorted(r.text for r in dealt.collect()) == sorted(texts)
    assert dealt.select("round").distinct().count() == lm.ROUNDS
    copies = dealt.where("text = 'same text here'").groupBy("round", "shard").count()
    assert copies.agg({"count": "max"}).first()[0] < 30
    again = lm.train_network(docs, voc)
    assert all((a == b).all() for a, b in zip(net.weights(), again.weights(), strict=True))
    assert any((a != b).any() for a, b in zip(net.weights(), lm.Network(voc).weights(), strict=True))


def test_long_texts_do_not_run_on_alone(monkeypatch):
    """A long text that comes last still shares its windows with the others; all tokens are learned from."""
    rng = np.random.default_rng(0)
    sizes = [*rng.integers(1, 60, 2000), 50 * lm.WINDOW]
    texts = [rng.integers(0, 2144, k).astype(np.int16) for k in sizes]
    seen = []

    def window(self, ids, klass, member, on, h, rate, memory):
        seen.append(ids[on])
        return h

    monkeypatch.setattr(lm.Network, "train_window", window)
    net = lm.Network.__new__(lm.Network)
    assert lm._train(texts, net, 0.1, {}) == sum(sizes)
    assert sorted(np.concatenate(seen)) == sorted(np.concatenate(texts))
    assert len(seen) <= 55


def test_words_of_batches_are_the_tokens():
    texts = [None, "", " a  B\t", "\n", "x\x1cy \x0b z\x0c", "Ä Ö q ÀB", "\x00 \x00A", "a\x85b"]
    texts += [f"P{chr(c)}q R" for c in range(1, 400)]
    words, sizes = lm.words_of(pa.array(texts))
    assert words.to_pylist() == [w for t in texts for w in lm.tokens_of(t)]
    assert sizes.tolist() == [len(lm.tokens_of(t)) for t in texts]


def test_slices_and_repeated_rare_words(spark, monkeypatch):
    """Batches cut into slices give the counts and scores of one."""
    docs = spark.createDataFrame(
        [(k, f"the rare{k % 7} rare{k % 7} word{k % 3} {'new' * (k % 4)} ") for k in range(60)] + [(None, None), (3, "")],
        "doc_id long, text string",
    )
    monkeypatch.setattr(lm, "KNOWN_WORDS", 4)

    def rows():
        # Keys of a text repeat where texts do, so rows are compared as a multiset.
        return sorted(tuple(-1 if x is None else round(x, 4) for x in r) for r in lm.lm_scores(docs).collect())

    whole = rows()
    monkeypatch.setattr(lm, "SLICE_BYTES", 50)
    assert rows() == whole


def test_logits_beyond_the_range_of_exponentials():
    """Weights whose logits overflow give finite losses and steps."""
    voc = lm.Vocabulary({b"a": 5}, {b"a": 64}, 10, 3, 2, np.ones(lm.TAIL_CLASSES), np.ones(lm.TAIL_CLASSES))
    net = lm.Network(voc)
    net.wc, net.bc = net.wc * 0, net.bc + 500
    ids = np.array([[64, 0], [0, 2050]])
    klass, member = lm._targets(ids)
    states, _ = net.run(ids, np.zeros((2, lm.STATE), np.float32))
    got = net.log_probs(states[:-1].reshape(-1, lm.STATE), klass.ravel(), member.ravel())
    assert np.isfinite(got).all() and (got < 0).all()
    net.train_window(ids, klass, member, np.ones_like(ids, bool), np.zeros((2, lm.STATE), np.float32), 0.01, {})
    assert all(np.isfinite(w).all() for w in net.weights())


def test_known_words_with_ties(spark, monkeypatch):
    """The most frequent words, ties by the word itself, wherever the limit falls among equal counts."""
    texts = ["a a a b b c c d d e e f g h", "i"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = lm.count_tokens(docs)
    words = sorted(((r.word, r.n) for r in counts.collect()), key=lambda x: (-x[1], x[0]))
    for limit in (1, 3, 5, 7, 100):
        monkeypatch.setattr(lm, "KNOWN_WORDS", limit)
        voc = lm.build_vocabulary(counts, 2)
        assert list(voc.known.items()) == [(bytes(w), n) for w, n in words[:limit]]
        assert (voc.tokens, voc.words) == (15 + 2, 9 + 1)
