"""LM scoring: a gated recurrent language model with class-factored output, in numpy.

Vocabulary: the HEAD_WORDS most frequent words of the training texts have embeddings and output
weights of their own; every other word belongs to one of TAIL_CLASSES classes by its letters.
A token's probability is that of its class given the state, times that of the word within its
class: a softmax over the class's members given the state (head), or its smoothed relative
frequency within the class (tail).  Counts cover all training texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickertide.llm.common import held_out
from tickertide.session import cut_lineage, scratch_path

HEAD_CLASSES, CLASS_WORDS, TAIL_CLASSES = 32, 64, 96
HEAD_WORDS = HEAD_CLASSES * CLASS_WORDS - 1  # the end of a text takes one place
STATE = 16
WINDOW = 24
# Scoring needs no gradients and takes longer windows of more texts at once.
SCORE_WINDOW, SCORE_TEXTS = 48, 8192
# Weights travel in pieces of so many numbers.
PIECE = 4096
# Documents that run through the network side by side, in scoring and in training.
LANES, TRAIN_LANES = 512, 128
# All training texts are dealt to so many rounds; each is learned from once, in its round.
ROUNDS = 4
# A shard of a round holds about so many tokens: its longest texts then take about as many windows
# as all lanes need for the rest.  In shards of a quarter of that most windows held a few lanes only.
SHARD_TOKENS = 1_400_000
# Rows whose logits are held at once when scoring; they stay in the processor's cache.
BLOCK = 2048
# Rows of a training window whose class logits are held at once.
TRAIN_BLOCK = 256
# Counts of the most frequent words are sent to every task; the others are joined.
KNOWN_WORDS = 150_000
# Bytes of text split into words at once; a longer text is handled alone.
SLICE_BYTES = 1 << 23


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, in UTF-8."""
    return (text or "").encode().lower().split()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (as in ``tokens_of``) of all texts, one text after the other, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    # White space at either end of a text leaves an empty word there.
    some = pc.binary_length(words).to_numpy() > 0
    if not some.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[some], minlength=len(sizes))
        words = words.filter(pa.array(some))
    return words.cast(pa.binary()), sizes


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64))
    for lo, hi in _runs(ends // SLICE_BYTES):
        yield texts.slice(lo, hi - lo)


def tail_class(word: bytes) -> int:
    """Classes of rare words: by their first letters, which differ between languages."""
    return _head_class(word[:3]) + (not word.isascii())


@lru_cache(maxsize=50_000)
def _head_class(head: bytes) -> int:
    return (int.from_bytes(head, "big") * 0x9E3779B1 >> 7) % (TAIL_CLASSES // 2) * 2


def count_tokens(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts of ``docs.text``; each batch is counted before any row moves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in batches:
            for texts in _slices(b.column(0)):
                found = words_of(texts)[0].value_counts()
                for w, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True):
                    seen[w] = seen.get(w, 0) + n
            if len(seen) > 200_000:
                yield emit(seen)
                seen = {}
        yield emit(seen)

    def emit(seen: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
        )

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What the tasks need to know of the corpus counts: bounded by KNOWN_WORDS."""

    known: dict[bytes, int]  # count of each frequent word
    head: dict[bytes, int]  # word -> place; place // CLASS_WORDS is its class
    tokens: int  # N, text ends included
    words: int  # V, the text end included
    ends: int  # training texts
    tail_tokens: np.ndarray  # by tail class
    tail_words: np.ndarray

    def start_bias(self) -> tuple[np.ndarray, np.ndarray]:
        """Log frequencies of the classes, and of the members within their head class."""
        # Places that a small vocabulary leaves empty get next to nothing.
        members = np.full(HEAD_CLASSES * CLASS_WORDS, 1e-20)
        members[0] = self.ends + 0.5
        for w, place in self.head.items():
            members[place] = self.known[w] + 0.5
        members = members.reshape(HEAD_CLASSES, CLASS_WORDS)
        classes = np.concatenate([members.sum(axis=1), self.tail_tokens + 0.5])
        return np.log(classes / classes.sum()), np.log(members / members.sum(axis=1, keepdims=True))


def build_vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """From ``word, n`` of all training tokens and the number of training texts."""
    klass = F.arrow_udf(lambda w: pa.array([tail_class(x) for x in w.to_pylist()], pa.int32()), "int")
    # How many words occur how often; there are few different counts.
    often = counts.groupBy("n").agg(F.count("*").alias("m")).toArrow().sort_by([("n", "descending")])
    times, many = often["n"].to_numpy(), often["m"].to_numpy()
    # The count of the last known word, so that only such words are ordered.
    least = int(times[min(np.searchsorted(np.cumsum(many), KNOWN_WORDS), len(times) - 1)]) if len(times) else 0
    # At most KNOWN_WORDS rows.
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).toArrow()
    known = dict(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True))
    order = [w for w, _ in zip(known, range(HEAD_WORDS), strict=False)]
    # Dealt round, so that every class holds frequent and rare words; place 0 is the text end.
    head = {}
    for k, w in enumerate(order, start=1):
        head[w] = (k % HEAD_CLASSES) * CLASS_WORDS + k // HEAD_CLASSES
    tail_tokens, tail_words = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    grouped = counts.select(klass("word").alias("k"), "n").groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    for r in grouped.collect():  # TAIL_CLASSES rows
        tail_tokens[r["k"]], tail_words[r["k"]] = r["n"], r["m"]
    for w in order:
        tail_tokens[tail_class(w)] -= known[w]
        tail_words[tail_class(w)] -= 1
    return Vocabulary(
        known, head, int(times @ many) + texts, int(many.sum()) + (texts > 0), texts, tail_tokens, tail_words
    )


class Network:
    """Gated recurrent units of width STATE over token embeddings; float32 throughout."""

    NAMES = ["emb", "wx", "wh", "b", "wc", "bc", "wm", "bm"]

    def __init__(self, vocabulary: Vocabulary, seed: int = 7):
        rng = np.random.default_rng(seed)
        n_in = HEAD_CLASSES * CLASS_WORDS + TAIL_CLASSES

        def small(*shape: int) -> np.ndarray:
            return rng.normal(0, 0.1, shape).astype(np.float32)

        classes, members = vocabulary.start_bias()
        self.emb, self.wx, self.wh = small(n_in, STATE), small(STATE, 3 * STATE), small(STATE, 3 * STATE)
        self.b = np.zeros(3 * STATE, np.float32)
        self.wc, self.bc = small(STATE, len(classes)), classes.astype(np.float32)
        self.wm, self.bm = small(HEAD_CLASSES, STATE, CLASS_WORDS), members.astype(np.float32)
        self.wm *= 0.1

    def weights(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def load(self, weights: list[np.ndarray]) -> Network:
        for n, w in zip(self.NAMES, weights, strict=True):
            setattr(self, n, w)
        return self

    def __getstate__(self) -> dict:
        return {n: getattr(self, n) for n in self.NAMES}

    def run(self, ids: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """States after each of the steps of ``ids`` (steps x lanes) from state ``h``.

        With ``keep`` also the gates, candidates and recurrent inputs of all steps.
        """
        # Gates and candidate lie apart, so that every array below is one block.
        table, wh = np.matmul(self.emb, _by_gate(self.wx)), _by_gate(self.wh)
        table += self.b.reshape(3, 1, STATE)
        shape = (len(ids), *h.shape)
        states = np.empty((len(ids) + 1, *h.shape), np.float32)
        states[0] = h
        gates = np.empty((2, *shape), table.dtype) if keep else None
        cands, pulls = np.empty((2, *shape), table.dtype) if keep else (None, None)
        for t in range(len(ids)):
            x = table.take(ids[t], axis=1)
            a = np.matmul(h, wh)
            g = x[:2]
            g += a[:2]
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            z, r = g
            c = np.multiply(r, a[2])
            c += x[2]
            np.tanh(c, out=c)
            if keep:
                gates[:, t], cands[t], pulls[t] = g, c, a[2]
            c -= h
            c *= z
            c += h
            states[t + 1] = h = c
        return states, (gates, cands, pulls)

    def _outputs(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Weights of classes and members, biases as their last row; whether logits may be exponentiated as they are."""
        wc = np.concatenate([self.wc, self.bc[None]])
        wm = np.concatenate([self.wm, self.bm[:, None]], axis=1)
        return wc, wm, _tame(wc) and _tame(wm)

    def log_probs(self, h: np.ndarray, klass: np.ndarray, member: np.ndarray) -> np.ndarray:
        """log P(class | h), and + log P(member | class, h) for head words."""
        wc, wm, tame = self._outputs()
        order = np.argsort(klass.astype(np.int16), kind="stable")
        kb, mb = klass[order], member[order]
        hb = _with_ones(h, order)
        cuts = np.searchsorted(kb, np.arange(HEAD_CLASSES + 1)).tolist()
        got = np.empty(len(h))
        room = np.empty(BLOCK * max(wc.shape[1], CLASS_WORDS), hb.dtype)

        def logs(weights: np.ndarray, at: np.ndarray, lo: int, hi: int) -> Iterator[tuple[slice, np.ndarray]]:
            for k in range(lo, hi, BLOCK):
                part = slice(k, min(k + BLOCK, hi))
                x = room[: (part.stop - k) * weights.shape[1]].reshape(-1, weights.shape[1])
                np.matmul(hb[part], weights, out=x)
                yield part, _log_softmax_at(x, at[part], tame)

        for part, found in logs(wc, kb, 0, len(h)):
            got[part] = found
        for k in range(HEAD_CLASSES):
            for part, found in logs(wm[k], mb, cuts[k], cuts[k + 1]):
                got[part] += found
        out = np.empty(len(h))
        out[order] = got
        return out

    def train_window(self, ids: np.ndarray, klass: np.ndarray, member: np.ndarray, on: np.ndarray, h: np.ndarray,
                     rate: float, memory: dict) -> np.ndarray:
        """One step of truncated backpropagation over a window; returns the state to carry on."""
        steps, lanes = ids.shape
        states, (gates, c, a) = self.run(ids, h, keep=True)
        # The state before a token predicts it.
        before = states[:-1].reshape(-1, STATE)
        live = np.flatnonzero(on.ravel())
        n = max(len(live), 1)
        # By class and member, so that a head class's tokens are one slice, and a word's within it.
        place = (klass * CLASS_WORDS + member).ravel()[live].astype(np.int16)
        order = np.argsort(place, kind="stable")
        live, place = live[order], place[order]
        kb, mb = np.divmod(place, CLASS_WORDS)
        firsts, starts = _starts(kb), _starts(place)
        hb = _with_ones(before, live)
        wc, wm, tame = self._outputs()
        # Exponentials are divided by their sums only where few numbers are left of them; the ones of
        # the true classes and members are taken off in the sums.
        dh, gc = np.empty((len(live), STATE), hb.dtype), np.zeros(wc.shape, hb.dtype)
        back_c = np.concatenate([wc[:STATE], np.ones_like(wc[:1])]).T
        for k in range(0, len(live), TRAIN_BLOCK):
            mine = slice(k, k + TRAIN_BLOCK)
            p = _exp(hb[mine] @ wc, tame)
            d = p @ back_c
            over = 1 / d[:, STATE:]
            np.multiply(d[:, :STATE], over, out=dh[mine])
            gc += (hb[mine] * over).T @ p
        dh -= wc.T[kb, :STATE]
        gc[:, kb[firsts]] -= np.add.reduceat(hb, firsts, axis=0).T
        cuts = np.searchsorted(kb, np.arange(HEAD_CLASSES + 1)).tolist()
        heads = cuts[-1]
        gm = np.zeros(wm.shape, hb.dtype)
        if heads:
            slices = [(k, slice(cuts[k], cuts[k + 1])) for k in range(HEAD_CLASSES) if cuts[k] < cuts[k + 1]]
            q = np.empty((heads, CLASS_WORDS), hb.dtype)
            for k, mine in slices:
                np.matmul(hb[mine], wm[k], out=q[mine])
            _exp(q, tame)
            over = 1 / (q @ np.ones((CLASS_WORDS, 1), q.dtype))
            scaled, dm = hb[:heads] * over, np.empty((heads, STATE), hb.dtype)
            for k, mine in slices:
                np.matmul(scaled[mine].T, q[mine], out=gm[k])
                np.matmul(q[mine], self.wm[k].T, out=dm[mine])
            dm *= over
            dm -= self.wm.transpose(0, 2, 1)[kb[:heads], mb[:heads]]
            dh[:heads] += dm
            mine = starts[: np.searchsorted(starts, heads)]
            gm[kb[mine], :, mb[mine]] -= np.add.reduceat(hb[:heads], mine, axis=0)
        grads = {"wc": gc[:STATE] / n, "bc": gc[STATE] / n, "wm": gm[:, :STATE] / n, "bm": gm[:, STATE] / n}
        into = np.zeros_like(before)
        into[live] = dh / n
        into = into.reshape(steps, lanes, STATE)
        # What a step's gradient is multiplied by on its way to candidate, gates and state.
        (z, r), h0 = gates, states[:-1]
        stay = 1 - z
        to_c, to_z, to_r = z * (1 - c * c), (c - h0) * z * stay, a * r * (1 - r)
        back = np.zeros((lanes, STATE), np.float32)
        da, dc = np.empty((3, steps, lanes, STATE), np.float32), np.empty((steps, lanes, STATE), np.float32)
        wh, wx = _by_gate(self.wh).transpose(0, 2, 1), _by_gate(self.wx).transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            np.multiply(back, to_c[t], out=dc[t])
            np.multiply(back, to_z[t], out=da[0, t])
            np.multiply(dc[t], to_r[t], out=da[1, t])
            np.multiply(dc[t], r[t], out=da[2, t])
            back = back * stay[t]
            for own in np.matmul(da[:, t], wh):
                back += own
            back += into[t]
        grads["wh"] = _side_by_side(np.matmul(h0.reshape(-1, STATE).T, da.reshape(3, -1, STATE)))
        # Candidates meet their inputs unweighted.
        da[2] = dc
        flat, used = da.reshape(3, -1, STATE), ids.ravel()
        grads["b"] = np.matmul(np.ones((1, flat.shape[1]), flat.dtype), flat).ravel()
        grads["wx"] = _side_by_side(np.matmul(self.emb.take(used, axis=0).T, flat))
        # What follows the end of a text has no gradient, so the live tokens' are all.
        words = np.matmul(flat, wx).sum(axis=0).take(live, axis=0)
        grads["emb"] = np.zeros_like(self.emb)
        grads["emb"][used[live[starts]]] = np.add.reduceat(words, starts, axis=0)
        self._adam(grads, rate, memory)
        return states[-1]

    def _adam(self, grads: dict, rate: float, memory: dict) -> None:
        memory["t"] = memory.get("t", 0) + 1
        t = memory["t"]
        g = np.concatenate([grads[k].ravel() for k in self.NAMES])
        g *= min(1.0, 1.0 / max(math.sqrt(float(g @ g)), 1e-9))
        m, v = memory.setdefault("moments", (np.zeros_like(g), np.zeros_like(g)))
        m *= 0.9
        m += 0.1 * g
        g *= g
        g *= 0.01
        v *= 0.99
        v += g
        step = np.sqrt(v, out=g)
        step *= 1 / math.sqrt(1 - 0.99**t)
        step += 1e-8
        np.divide(m, step, out=step)
        step *= rate / (1 - 0.9**t)
        flat = np.concatenate([w.ravel() for w in self.weights()])
        flat -= step
        self.load(_unpack(flat, self.weights()))


def _unpack(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    """Views of ``flat`` in the shapes of ``like``, one after the other."""
    cuts = np.cumsum([w.size for w in like])[:-1]
    return [part.reshape(w.shape) for part, w in zip(np.split(flat, cuts), like, strict=True)]


def _by_gate(w: np.ndarray) -> np.ndarray:
    """Columns of gates z and r and of the candidate apart: 3 x rows x STATE."""
    return np.ascontiguousarray(w.reshape(len(w), 3, STATE).transpose(1, 0, 2))


def _side_by_side(w: np.ndarray) -> np.ndarray:
    return w.transpose(1, 0, 2).reshape(w.shape[1], -1)


def _with_ones(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rows ``at`` of ``h`` with a last column of ones, which meets the biases."""
    out = np.ones((len(at), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h[at]
    return out


def _starts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]])


def _tame(weights: np.ndarray) -> bool:
    """Whether exponentials of all logits of states within [-1, 1] stay finite, and some above zero."""
    reach, bias = np.abs(weights[..., :-1, :]).sum(axis=-2), weights[..., -1, :]
    return bool((bias + reach).max() < 60 and (bias - reach).max(axis=-1).min() > -60)


def _exp(x: np.ndarray, tame: bool) -> np.ndarray:
    """Exponentials in place; a row's are scaled by a common factor unless ``tame``."""
    if not tame:
        x -= x.max(axis=1, keepdims=True)
    return np.exp(x, out=x)


def _log_softmax_at(x: np.ndarray, at: np.ndarray, tame: bool) -> np.ndarray:
    if not tame:
        x -= x.max(axis=1, keepdims=True)
    own = x[np.arange(len(x)), at].astype(np.float64)
    return own - np.log(_exp(x, True) @ np.ones(x.shape[1], x.dtype))


@dataclass
class Coded:
    """Texts as places; what is kept word by word lies one text after the other."""

    sizes: np.ndarray  # words of each text
    index: np.ndarray  # of each word in the known ones (-1: not there)
    places: np.ndarray  # of each word
    lost: np.ndarray  # where words are not known
    rare: pa.DictionaryArray  # those words

    def texts(self) -> list[np.ndarray]:
        """The places of each text with its end (0)."""
        ends = np.cumsum(self.sizes + 1)
        out = np.zeros(len(self.places) + len(ends), np.int16)
        word = np.ones(len(out), bool)
        word[ends - 1] = False
        out[word] = self.places
        return np.split(out, ends[:-1])


class Coder:
    """Texts to places: one look-up a word, for many texts at once."""

    def __init__(self, vocabulary: Vocabulary):
        known = vocabulary.known
        self.words = pa.array(list(known), pa.binary())
        self.logs = np.log10(np.array(list(known.values()), dtype=np.float64) + 1)
        base = HEAD_CLASSES * CLASS_WORDS
        self.place = np.array([vocabulary.head.get(w, base + tail_class(w)) for w in known], dtype=np.int16)

    def encode(self, texts: pa.Array) -> Coded:
        words, sizes = words_of(texts)
        index = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy()
        places = self.place[index] if len(self.place) else np.zeros(len(words), np.int16)
        lost = np.flatnonzero(index < 0)
        rare = words.take(pa.array(lost)).dictionary_encode()
        classes = np.array([tail_class(w) for w in rare.dictionary.to_pylist()], dtype=np.int16)
        places[lost] = HEAD_CLASSES * CLASS_WORDS + classes[rare.indices.to_numpy()]
        return Coded(sizes, index, places, lost, rare)


def _targets(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    base = HEAD_CLASSES * CLASS_WORDS
    tail = ids >= base
    return np.where(tail, HEAD_CLASSES + ids - base, ids // CLASS_WORDS), np.where(tail, 0, ids % CLASS_WORDS)


def _lanes(
    texts: list[np.ndarray], window: int, lanes: int, most: int = 1
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of side-by-side texts: places (steps x lanes), text of each lane, fresh, on.

    A lane takes the next text when its own ends, so texts of any length share one stream and a
    text's state is carried from window to window.  Texts start at the start of a window.  When
    texts have run out, windows of fewer lanes take more steps, up to ``most`` times as many.
    """
    if not texts:
        return
    flat = np.concatenate(texts)
    ends = np.cumsum([len(t) for t in texts])
    lane = np.full(lanes, -1)
    at, end = np.zeros((2, lanes), dtype=np.int64)
    given = 0
    while True:
        free = np.flatnonzero(lane < 0)
        fresh = lane < 0
        take = free[: len(texts) - given]
        lane[take] = np.arange(given, given + len(take))
        given += len(take)
        end[take] = ends[lane[take]]
        at[take] = end[take] - [len(texts[k]) for k in lane[take]]
        if (lane < 0).all():
            return
        steps = window
        if given == len(texts):
            left = (end - at)[lane >= 0]
            steps = min(window * min(most, lanes // len(left)), max(window, int(left.max())))
        places = at + np.arange(steps)[:, None]
        on = places < end
        yield np.where(on, flat[np.minimum(places, len(flat) - 1)], 0), lane.copy(), fresh, on
        at += steps
        lane[at >= end] = -1


def network_scores(texts: list[np.ndarray], net: Network) -> np.ndarray:
    """Natural log-likelihood of whole texts under the network (tail words: of their class)."""
    total = np.zeros(len(texts))
    h = np.zeros((LANES, STATE), np.float32)
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    for ids, lane, fresh, on in _lanes([texts[k] for k in order], SCORE_WINDOW, LANES, most=16):
        h[fresh] = 0
        used = np.flatnonzero(lane >= 0)
        ids, on = ids[:, used], on[:, used]
        states, _ = net.run(ids, h[used])
        h[used] = states[-1]
        klass, member = _targets(ids)
        live = np.flatnonzero(on.ravel())
        got = np.zeros(on.size)
        got[live] = net.log_probs(states[:-1].reshape(-1, STATE)[live], klass.ravel()[live], member.ravel()[live])
        total[lane[used]] += got.reshape(on.shape).sum(axis=0)
    out = np.zeros(len(texts))
    out[order] = total
    return out


def _long_first(texts: list[np.ndarray], lanes: int) -> list[np.ndarray]:
    """Texts above half a lane's share of the tokens first, the longest ahead; the others as given.

    Started late, a long text would run on in windows that all other lanes have left.
    """
    half = sum(len(t) for t in texts) / lanes / 2
    long = sorted((t for t in texts if len(t) > half), key=len, reverse=True)
    return long + [t for t in texts if len(t) <= half]


def _train(texts: list[np.ndarray], net: Network, rate: float, memory: dict) -> int:
    h = np.zeros((TRAIN_LANES, STATE), np.float32)
    tokens = 0
    for ids, lane, fresh, on in _lanes(_long_first(texts, TRAIN_LANES), WINDOW, TRAIN_LANES):
        h[fresh] = 0
        used = np.flatnonzero(lane >= 0)
        ids, on = ids[:, used], on[:, used]
        klass, member = _targets(ids)
        h[used] = net.train_window(ids, klass, member, on, h[used], rate, memory)
        tokens += int(on.sum())
    return tokens


def train_network(docs: DataFrame, vocabulary: Vocabulary) -> Network:
    """Backpropagation through every text of ``docs.text`` once, in ROUNDS rounds.

    The texts are dealt by a hash to rounds and shards and written down, so a round reads its
    own part only and reruns see the same shards.  A shard trains from the last round's weights;
    the shards' weights are averaged by tokens, in shard order.  Weights have a fixed size (under
    1 MB), whatever the corpus.  Copies of a text fall into shards of their own by row number of
    their task, so a text that many rows repeat is spread as well.
    """
    net = Network(vocabulary)
    coder = Coder(vocabulary)
    shards = max(1, min(math.ceil(vocabulary.tokens / ROUNDS / SHARD_TOKENS), 4096))
    hashed = F.pmod(F.xxhash64(F.lit(3), "text", F.monotonically_increasing_id()), F.lit(ROUNDS * shards))
    path = scratch_path(docs.sparkSession, "dealt")
    (
        docs.select("text", hashed.alias("h"))
        .select("text", (F.col("h") % shards).cast("int").alias("shard"), F.floor(F.col("h") / shards).cast("int").alias("round"))
        .write.partitionBy("round")
        .parquet(path)
    )
    dealt = docs.sparkSession.read.schema("text string, shard int, round int").parquet(path)
    for k in range(ROUNDS):
        rate = 0.02 * 0.5**k

        def fit(batches: Iterator[pa.RecordBatch], net: Network = net, rate: float = rate) -> Iterator[pa.RecordBatch]:
            texts, shard = [], -1

            def result() -> pa.RecordBatch:
                own = Network.__new__(Network).load(start)
                tokens = _train(texts, own, rate, {})
                flat = np.concatenate([w.ravel() for w in own.weights()])
                pieces = [flat[k : k + PIECE].astype("<f4").tobytes() for k in range(0, len(flat), PIECE)]
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(len(pieces))),
                        pa.array(np.full(len(pieces), shard)),
                        pa.array(pieces, pa.binary()),
                        pa.array(np.full(len(pieces), tokens)),
                    ],
                    names=["part", "shard", "weights", "tokens"],
                )

            start = net.weights()
            for b in batches:
                shards_of = b.column(1).to_numpy()
                for lo, hi in _runs(shards_of):
                    if shards_of[lo] != shard:
                        if texts:
                            yield result()
                        texts, shard = [], int(shards_of[lo])
                    for part in _slices(b.column(0).slice(lo, hi - lo)):
                        texts += coder.encode(part).texts()
            if texts:
                yield result()

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for b in batches:
                for part, _, weights, tokens in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                    own = sums.setdefault(part, [0.0, 0])
                    own[0] = own[0] + np.frombuffer(weights, "<f4").astype(np.float64) * tokens
                    own[1] += tokens
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(sums), pa.int64()),
                    pa.array([(v / n).astype("<f4").tobytes() for v, n in sums.values()], pa.binary()),
                ],
                names=["part", "weights"],
            )

        # One small row per shard and piece; the averages together are one set of weights.
        means = (
            dealt.where(F.col("round") == k)
            .select("text", "shard")
            .repartition(shards, "shard")
            .sortWithinPartitions("shard", F.xxhash64("text"))
            .mapInArrow(fit, "part long, shard long, weights binary, tokens long")
            .repartition("part")
            .sortWithinPartitions("part", "shard")
            .mapInArrow(average, "part long, weights binary")
            .toArrow()
            .sort_by("part")
        )
        if len(means):
            flat = np.frombuffer(b"".join(means["weights"].to_pylist()), "<f4")
            net = Network(vocabulary).load(_unpack(flat, net.weights()))
    return net


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]) if len(values) else [0]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def lm_scores(docs: DataFrame, learnable: Column | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every text.

    Texts are learned from where ``learnable`` (default: crc32(doc_id as text) mod 7 is not 2; a
    null doc_id is learned from).  Null and empty texts consist of the text end alone.  Repeated
    rows are scored each; other columns are ignored; an empty table gives no rows.  If nothing
    is learned (N = 0), base scores are 0 for every token (log10(1/1)).

    Words outside the KNOWN_WORDS most frequent ones travel once per document as (row, word)
    and meet the counts in a join; everything else is summed where the text is read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out_ = held_out("doc_id", 7, 2) if learnable is None else ~learnable
    training = docs.where(~out_)
    counts = cut_lineage(count_tokens(training), "counts")
    texts = training.count()
    voc = build_vocabulary(counts, texts)
    net = train_network(training, voc)
    n, v, ends, coder = voc.tokens, voc.words, voc.ends, Coder(voc)
    log_total = math.log10(n + v + 1) if n + v + 1 > 0 else 0.0
    end_base = math.log10(ends + 1)
    # By known word, and 0 for the others: all logs, and those of the words outside the head, which
    # are the first of the known ones.  By place: what a tail word's share of its class divides by.
    logs = np.append(coder.logs, 0.0)
    tail_logs = np.where(np.arange(len(logs)) < len(voc.head), 0.0, logs)
    shares = np.zeros(HEAD_CLASSES * CLASS_WORDS + TAIL_CLASSES)
    shares[-TAIL_CLASSES:] = np.log10(np.maximum(voc.tail_tokens, 0) + voc.tail_words + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, SCORE_TEXTS):
                texts, sizes, knowns, bases, extra, rare, times = [], [], [], [], [], [], []
                for part in _slices(b.column(1).slice(lo, SCORE_TEXTS)):
                    coded = coder.encode(part)
                    rows = len(part)
                    doc = np.repeat(np.arange(rows), coded.sizes)
                    texts += coded.texts()
                    sizes.append(coded.sizes + 1)
                    knowns.append(coded.sizes - np.bincount(doc[coded.lost], minlength=rows) + int(ends > 0))
                    sums = np.bincount(doc, logs[coded.index], minlength=rows)
                    bases.append(end_base + sums - sizes[-1] * log_total)
                    extra.append(np.bincount(doc, tail_logs[coded.index] - shares[coded.places], minlength=rows))
                    kinds = len(coded.rare.dictionary)
                    keys, often = np.unique(doc[coded.lost] * kinds + coded.rare.indices.to_numpy(), return_counts=True)
                    cuts = np.searchsorted(keys, np.arange(rows + 1) * kinds).astype(np.int32)
                    words = coded.rare.dictionary.take(pa.array(keys % max(kinds, 1)))
                    rare.append(pa.ListArray.from_arrays(cuts, words))
                    times.append(pa.ListArray.from_arrays(cuts, pa.array(often, pa.int32())))
                net_scores = network_scores(texts, net) / math.log(10) + np.concatenate(extra)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, len(texts)),
                        pa.array(np.concatenate(sizes), pa.int64()),
                        pa.array(np.concatenate(knowns), pa.int64()),
                        pa.array(np.concatenate(bases), pa.float64()),
                        pa.array(net_scores, pa.float64()),
                        pa.concat_arrays(rare),
                        pa.concat_arrays(times),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "base", "network", "words", "times"],
                )

    scored = docs.mapInArrow(
        score,
        "doc_id long, n_tokens long, n_known long, base double, network double, "
        "words array<binary>, times array<int>",
    )
    # Numbered as they are written, so a row's words find back to it.
    scored = cut_lineage(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # The counts of the other words: joined by word, summed by row before they move again.
    lost = (
        scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w"))
        .select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
        .join(counts, "word")
        .groupBy("row")
        .agg(F.sum("times").alias("found"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("lift"))
    )
    sure = F.coalesce(F.col("lift"), F.lit(0.0))
    return (
        scored.drop("words", "times")
        .join(lost, "row", "left")
        .select(
            "doc_id",
            out_.alias("held_out"),
            "n_tokens",
            (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + sure).alias("base_score"),
            (F.col("network") + sure).alias("score"),
        )
    )
