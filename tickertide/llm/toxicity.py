"""Toxicity: transducers for insults, threats, targets, negation and reported speech, composed."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickertide.llm.common import label_sample, mix64, remainder, row_key, word_slices
from tickertide.session import cut_lineage

# At most so many labelled documents are used to fit the grammar; scoring covers all.
FIT_ROWS = 60_000
# At most so many different toxic texts of them are searched for insults.
TOXIC_ROWS = 8_000
# A task hands on its pattern counts when it holds so many.
COUNTED = 200_000
THRESHOLD = 0.5

# Fixed word lists of the grammar.
TARGETS = (
    "you your yours yourself u ur he him his she her they them their these those people everyone "
    "du dich dir dein deine ihr euch ihn ihm sie er tu te toi ton ta tes vous votre vos il elle "
    "ils elles tú ti usted ustedes vosotros él ella ellos ellas"
).split()
NEGATIONS = (
    "not no never none isn aren wasn weren don doesn didn cannot nor "
    "nicht kein keine keinen niemals nie pas jamais aucun aucune ni nunca jamás ningún ninguna tampoco"
).split()
SAYING = (
    "said says say told tells wrote writes claimed claims quoted called calls shouted reported "
    "sagte sagt schrieb meinte nannte dit disait écrit appelé dijo dice escribió llamó"
).split()
THREATS = (
    "kill murder hurt destroy stab shoot strangle beat burn hang "
    "töten umbringen verletzen tuer tuerai frapper matar mataré golpear"
).split()

OTHER, INSULT, THREAT, TARGET, NEGATION, SAYS, QUOTE, STOP = range(8)
TAG_NAMES = ["other", "insult", "threat", "target", "negation", "says", "quote", "stop"]
TOKEN = re.compile(r"\w+|[.!?;:\n\"“”«»„]")
STOPS, QUOTES = set(".!?;:\n"), set("\"“”«»„")
NEGATION_REACH = 3


class Transducer:
    """A deterministic machine: (state, symbol) -> (state, output, weight)."""

    def __init__(self, start: object, step: callable):
        self.start, self.step = start, step


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Runs ``second`` on the outputs of ``first``; weights add up."""

    def step(state: tuple, symbol: object) -> tuple:
        a, mid, w1 = first.step(state[0], symbol)
        b, out, w2 = second.step(state[1], mid)
        return (a, b), out, w1 + w2

    return Transducer((first.start, second.start), step)


def compile_table(machine: Transducer, symbols: list) -> tuple[list[list[int]], list[list[tuple]]]:
    """All reachable states of a machine as dense tables of next states and outputs."""
    index, order = {machine.start: 0}, [machine.start]
    after: list[list[int]] = []
    outputs: list[list[tuple]] = []
    for state in order:
        row, out = [], []
        for symbol in symbols:
            to, emitted, weight = machine.step(state, symbol)
            if to not in index:
                index[to] = len(order)
                order.append(to)
            row.append(index[to])
            out.append((emitted, weight))
        after.append(row)
        outputs.append(out)
    return after, outputs


def negation() -> Transducer:
    """Marks insults and threats that stand within NEGATION_REACH words of a negation."""

    def step(left: int, tag: int) -> tuple:
        if tag == NEGATION:
            return NEGATION_REACH, (tag, False), 0.0
        if tag == STOP:
            return 0, (tag, False), 0.0
        return max(0, left - 1), (tag, left > 0 and tag in (INSULT, THREAT)), 0.0

    return Transducer(0, step)


def reported() -> Transducer:
    """Marks what stands in quotation marks or after a verb of saying, to the end of the clause."""

    def step(state: tuple[bool, bool], symbol: tuple[int, bool]) -> tuple:
        quoted, said = state
        tag, negated = symbol
        if tag == QUOTE:
            quoted = said and not quoted
        elif tag == SAYS:
            said = True
        elif tag == STOP:
            quoted = said = False
        return (quoted, said), (tag, negated, quoted or said), 0.0

    return Transducer((False, False), step)


# What the last machine emits: kinds of matched clauses.
EVENTS = [
    "insult",
    "insult at a target",
    "negated insult",
    "reported insult",
    "threat at a target",
    "hedged threat at a target",
]


def clauses() -> Transducer:
    """Turns marked insults and threats into events, knowing whether the clause named a target."""

    def step(target: bool, symbol: tuple[int, bool, bool]) -> tuple:
        tag, negated, said = symbol
        if tag == STOP:
            return False, None, 0.0
        if tag == TARGET:
            return True, None, 0.0
        if tag == INSULT:
            kind = 2 if negated else 3 if said else 1 if target else 0
            return target, kind, 1.0
        if tag == THREAT:
            return target, (5 if negated or said else 4) if target else None, 1.0
        return target, None, 0.0

    return Transducer(False, step)


GRAMMAR = compose(compose(negation(), reported()), clauses())
AFTER, OUTPUT = compile_table(GRAMMAR, list(range(8)))


class Lexicon(dict):
    """word -> (tag, weight): a trie of whole words and word beginnings, longest match first.

    A dict of the words seen so far stands before the trie; it is emptied when large.
    """

    END = ""

    def __init__(self, insults: dict[str, float]):
        super().__init__()
        self.insults = insults
        self.trie: dict = {}
        for words, tag in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (SAYING, SAYS), (THREATS, THREAT)):
            for w in words:
                self._add(w + "$", tag, 1.0)
        for q in QUOTES:
            self._add(q + "$", QUOTE, 0.0)
        for q in STOPS:
            self._add(q + "$", STOP, 0.0)
        for pattern, weight in insults.items():
            self._add(pattern, INSULT, weight)

    def _add(self, pattern: str, tag: int, weight: float) -> None:
        node = self.trie
        for c in pattern:
            node = node.setdefault(c, {})
        node[self.END] = (tag, weight)

    def __missing__(self, word: str) -> tuple[int, float]:
        node, found = self.trie, (OTHER, 0.0)
        for c in word + "$":
            node = node.get(c)
            if node is None:
                break
            found = node.get(self.END, found)
        if len(self) > 500_000:
            self.clear()
        self[word] = found
        return found

    def __reduce__(self):
        return Lexicon, (self.insults,)


def clause_events(text: str, lexicon: Lexicon) -> list[float]:
    """Summed weights of each kind of event, the heaviest clause, and the number of insults."""
    sums = [0.0] * (len(EVENTS) + 2)
    tags = [lexicon[t] for t in TOKEN.findall(text.lower())]
    if not any(t[0] in (INSULT, THREAT) for t in tags):
        return sums
    state, clause = 0, 0.0
    for tag, weight in tags:
        kind, unit = OUTPUT[state][tag]
        state = AFTER[state][tag]
        if kind is not None:
            sums[kind] += weight * unit
            clause += weight * unit
            sums[-2] = max(sums[-2], clause)
            sums[-1] += tag == INSULT
        if tag == STOP:
            clause = 0.0
    return sums


def event_features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    if not texts:
        return np.zeros((0, len(EVENTS) + 2))
    return np.log1p(np.array([clause_events(t, lexicon) for t in texts]))


@dataclass
class Grammar:
    """The learned insults with their weights, and the weights of the kinds of clauses."""

    insults: dict[str, float]
    weights: np.ndarray
    offset: float

    def score(self, texts: list[str], lexicon: Lexicon) -> np.ndarray:
        t = event_features(texts, lexicon) @ self.weights + self.offset
        return 1.0 / (1.0 + np.exp(-np.clip(t, -500, 500)))


def patterns_of(word: str) -> list[str]:
    """The whole word, and its beginnings of four to twelve letters."""
    return [word + "$", *(word[:k] for k in range(4, min(len(word), 12) + 1))]


def _words(text: str) -> set[str]:
    return {w for w in TOKEN.findall(text.lower()) if len(w) > 2 and not w.isdigit()}


def _sketches(texts: pa.Array, perms: int = 8) -> np.ndarray:
    """Eight minima of salted word hashes a text, to tell near copies."""
    out = []
    for w in word_slices(texts):
        h = w.hashes()
        sketch = np.full((w.rows, perms), np.iinfo(np.uint64).max, dtype=np.uint64)
        have = np.flatnonzero(w.counts())
        at = np.searchsorted(w.doc, have)
        for p in range(perms):
            if len(at):
                sketch[have, p] = np.minimum.reduceat(mix64(h ^ np.uint64(0x5851F42D * (p + 1))), at)
        out.append(sketch)
    return np.concatenate(out) if out else np.zeros((0, perms), np.uint64)


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        marks = pa.array(_sketches(b.column(1)).astype(np.int64).tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), marks], names=["key", "marks"])


def count_patterns(texts: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """``p, n``: in how many of ``texts.text`` each pattern (of ``wanted``) occurs; '' counts all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen[""] += 1
                found = {p for w in _words(t or "") for p in patterns_of(w)}
                seen.update(found if wanted is None else found & wanted)
                if len(seen) > COUNTED:
                    yield emit(seen)
                    seen = Counter()
        yield emit(seen)

    def emit(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["p", "n"]
        )

    return texts.select("text").mapInArrow(count, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))


def learn_insults(
    sample: DataFrame, least: float = 0.004, odds: float = 4.0, toxic_rows: int = TOXIC_ROWS
) -> dict[str, float]:
    """Words and word beginnings that mark toxic texts: pattern -> log odds.

    ``sample`` has ``text, toxic``.  At most ``toxic_rows`` different toxic texts are searched; of
    those that are near copies of each other one counts.  A pattern needs a share ``least`` of them
    (5 at least) and ``odds`` in its favour; one whose beginning is already taken adds nothing and
    is left out.  Patterns are counted in the tasks.  The driver holds eight numbers for each toxic
    text, and the patterns above the least share: at most 1 / ``least`` times the mean number of
    different patterns in a toxic text, however many texts there are.
    """
    toxic = (
        sample.where("toxic = 1")
        .select("text")
        .distinct()
        .orderBy(F.xxhash64("text"), "text")
        .limit(toxic_rows)
        .select(row_key(F.col("text")).alias("key"), "text")
    )
    rows = sorted(toxic.mapInArrow(_sketch_rows, "key string, marks array<bigint>").collect())
    known, kept = np.zeros((len(rows), 8), np.int64), []
    for row in rows:
        # Four marks of eight shared with one text that is kept: about half of the words.
        marks = np.array(row["marks"])
        if not ((known[: len(kept)] == marks).sum(axis=1) >= 4).any():
            known[len(kept)] = marks
            kept.append((row["key"],))
    n = len(kept)
    # At most toxic_rows keys.
    chosen = F.broadcast(sample.sparkSession.createDataFrame(kept, "key string"))
    counts = count_patterns(toxic.join(chosen, "key", "left_semi")).where(F.col("p") != "")
    seen = {r["p"]: r["n"] for r in counts.where(F.col("n") >= max(5, least * n)).collect()}
    if not seen:
        return {}
    against = {r["p"]: r["n"] for r in count_patterns(sample.where("toxic = 0"), set(seen)).collect()}
    m = against.pop("", 0)
    weights = {
        p: math.log((c + 0.5) / (n + 1)) - math.log((against.get(p, 0) + 0.5) / (m + 1)) for p, c in seen.items()
    }
    taken: dict[str, float] = {}
    for p in sorted(weights, key=lambda p: (len(p.rstrip("$")), p)):
        if weights[p] >= odds and not any(p[:k] in taken for k in range(4, len(p))):
            taken[p] = min(weights[p], 10.0)
    return dict(sorted(taken.items(), key=lambda x: (-x[1], x[0])))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    keep = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + keep @ w
        hess = (a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + keep
        move = np.linalg.solve(hess, g)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train_toxicity(
    docs: DataFrame, labels: DataFrame, learnable: Column | None = None, rows: int = FIT_ROWS
) -> Grammar:
    """Learns insults and clause weights from at most ``rows`` learnable labelled documents.

    By default those whose crc32(doc_id as text) mod 5 is not 0.  Null labels and ids are left
    out; of contradicting labels the smallest counts; repeated documents and null or empty texts
    are learned from like others; other columns are ignored.  Without labels or documents no
    insult is known and every text scores 0.5 or less.
    """
    learnable = remainder("doc_id", 5) != 0 if learnable is None else learnable
    # At most ``rows`` documents: written once, so the passes below don't search the whole corpus again.
    sample = cut_lineage(label_sample(docs, labels, "toxic", learnable, rows).select("text", "toxic"), "toxic-sample")
    insults = learn_insults(sample)
    lexicon = Lexicon(insults)

    def events(texts: pa.Array) -> pa.Array:
        x = event_features([t or "" for t in texts.to_pylist()], lexicon)
        return pa.array(x.tolist(), pa.list_(pa.float64()))

    got = sample.select("toxic", F.arrow_udf(events, "array<double>")("text").alias("x")).groupBy("toxic", "x").count()
    # Texts without any event share one row; the rest is bounded by the sample.
    got = got.orderBy(F.desc("count"), "toxic", "x").limit(rows).collect()
    if not got or not insults:
        return Grammar(insults, np.ones(len(EVENTS) + 2), -2.0)
    x = np.repeat(np.array([r["x"] for r in got]), [r["count"] for r in got], axis=0)
    y = np.repeat(np.array([float(r["toxic"]) for r in got]), [r["count"] for r in got])
    weights, offset = _logistic(x, y)
    return Grammar(insults, weights, offset)


def toxicity_score(grammar: Grammar) -> callable:
    """A column function: text -> score between 0 and 1, higher for more toxic texts.

    Null and empty texts hold no clause and get the score of a text without matches.
    """
    lexicon = Lexicon(grammar.insults)

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(grammar.score([t or "" for t in texts.to_pylist()], lexicon))

    return F.arrow_udf(score, "double")
