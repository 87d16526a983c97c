"""BPE encoding and decoding with a memory-mapped minimal transducer of frequent words."""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickertide.llm.chunk_ids import ChunkIds, Coded, take_runs, text_slices
from tickertide.session import scratch_path

# Words compiled into the transducer; all others are merged exactly where they occur.
LEXICON_WORDS = 50_000
# Distinct chunks a task counts before it hands some on.
HELD_CHUNKS = 400_000
END = "</w>"
NO_MERGE = 1 << 40
# Fixed values of the vocabulary's normaliser and splitter.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
# Letters of Unicode 16 and lower cases of Unicode 16 and 17, which Python lacks.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
]
NEW_LOWER = {
    0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5,
    0xA7DA: 0xA7DB, 0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},
    **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


def _ranges(kind: str) -> str:
    """A character class of all characters of a general category."""
    newer = {c for a, b in NEW_LETTERS for c in range(a, b + 1)} if kind == "L" else set()
    ranges: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == kind or c in newer:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


_LETTER, _NUMBER = _ranges("L"), _ranges("N")
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{WHITE}{_LETTER}{_NUMBER}]+")
_GAPS = re.compile(f"[{WHITE}]+")
# Characters that str.split() takes for white space and the vocabulary doesn't.
_ODD = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, others from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """Merges, ids and special tokens of a byte-letter BPE with word ends."""

    ids: dict[str, int]
    tokens: list[str]
    ranks: dict[tuple[str, str], int]
    special: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        ids = dict(spec["model"]["vocab"])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
        for token, k in {**ids, **special}.items():
            tokens[k] = token
        ranks = {tuple(m): k for k, m in enumerate(spec["model"]["merges"])}
        return cls(ids, tokens, ranks, special)


class Merger:
    """Exact merging of one word: the pair of lowest rank first, leftmost first."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.letters = byte_letters()

    def ids(self, word: str) -> tuple[int, ...]:
        letters = self.letters
        parts = [letters[b] for b in word.encode()]
        parts[-1] += END
        rank = self.v.ranks.get
        # The rank of each part with the next one; a merge changes its two neighbours' alone.
        ranks = [rank(p, NO_MERGE) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < NO_MERGE:
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NO_MERGE)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NO_MERGE)
        return tuple(self.v.ids[p] for p in parts)


def normalised(chunk: str) -> str:
    """Composed and lower-cased letter by letter (no special case for a final sigma)."""
    composed = unicodedata.normalize("NFC", chunk)
    return (composed if composed.isascii() else composed.translate(NEW_LOWER)).lower()


def chunks_of(text: str | None) -> list[str]:
    """The text between white space."""
    if not text:
        return []
    if _ODD.search(text):
        return [c for c in _GAPS.split(text) if c]
    return text.split()


def compile_lexicon(words: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """A minimal acyclic transducer: word bytes in, number of the word out.

    Built from sorted words by merging equal tails as soon as a common beginning ends.  The
    output of an arc is the number of words that its elder arcs lead to; outputs along a
    path add up to the word's number, which names its ids.
    """
    ordered = sorted(words, key=lambda w: w.encode())
    register: dict[tuple, int] = {}
    arcs: list[list[tuple[int, int]]] = []
    final: list[bool] = []
    sizes: list[int] = []

    def frozen(node: dict) -> int:
        edges = [(b, t) for b, t in node["arcs"]]
        key = (node["final"], tuple(edges))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(edges)
            final.append(node["final"])
            sizes.append(node["final"] + sum(sizes[t] for _, t in edges))
        return register[key]

    def new() -> dict:
        return {"arcs": [], "final": False}

    path, last = [new()], b""
    for word in (w.encode() for w in ordered):
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        while len(path) > common + 1:
            node = path.pop()
            path[-1]["arcs"][-1] = (path[-1]["arcs"][-1][0], frozen(node))
        for b in word[common:]:
            path[-1]["arcs"].append((b, -1))
            path.append(new())
        path[-1]["final"] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1]["arcs"][-1] = (path[-1]["arcs"][-1][0], frozen(node))
    start = frozen(path[0])
    keys, targets, outputs = [], [], []
    for state, edges in enumerate(arcs):
        before = int(final[state])
        for b, t in edges:
            keys.append(state * 256 + b)
            targets.append(t)
            outputs.append(before)
            before += sizes[t]
    flat = [words[w] for w in ordered]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in flat])])
    return {
        "meta": np.array([start, max([len(w.encode()) for w in ordered], default=0)]),
        "keys": np.array(keys, dtype=np.int64),
        "targets": np.array(targets, dtype=np.int64),
        "outputs": np.array(outputs, dtype=np.int64),
        "final": np.array(final, dtype=np.int64),
        "bounds": bounds.astype(np.int64),
        "ids": np.array([i for x in flat for i in x], dtype=np.int64),
    }


PARTS = ["meta", "keys", "targets", "outputs", "final", "bounds", "ids"]


def packed(lexicon: dict[str, np.ndarray]) -> bytes:
    """The arrays one after the other behind their lengths, as little-endian 64-bit numbers."""
    head = np.array([len(lexicon[p]) for p in PARTS], dtype="<i8")
    return b"".join([head.tobytes(), *(lexicon[p].astype("<i8").tobytes() for p in PARTS)])


class Transducer:
    """Looks up many words at once in a packed lexicon, which is mapped and not read."""

    def __init__(self, path: str):
        flat = np.memmap(path, dtype="<i8", mode="r")
        at = len(PARTS)
        for name, n in zip(PARTS, flat[:at].tolist(), strict=True):
            setattr(self, name, flat[at : at + n])
            at += n

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word, or -1."""
        data = [w.encode() for w in words]
        start, longest = self.meta.tolist()
        size = np.array([len(d) for d in data], dtype=np.int64)
        state = np.where(size <= longest, start, -1)
        number = np.zeros(len(data), dtype=np.int64)
        if not len(self.keys):
            return np.full(len(data), -1)
        flat = np.frombuffer(b"".join(data), dtype=np.uint8)
        offset = np.concatenate([[0], np.cumsum(size)])[:-1]
        for k in range(longest):
            live = np.flatnonzero((state >= 0) & (size > k))
            if not len(live):
                break
            key = state[live] * 256 + flat[offset[live] + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[live] = np.where(hit, self.targets[at], -1)
            number[live] += np.where(hit, self.outputs[at], 0)
        known = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        return np.where(known, number, -1)

    def ids_of(self, number: int) -> tuple[int, ...]:
        return tuple(self.ids[self.bounds[number] : self.bounds[number + 1]].tolist())


class Encoder:
    """Texts to ids: frequent words by the transducer, others by merging; chunks are remembered."""

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer):
        self.v, self.t, self.merger = vocabulary, transducer, Merger(vocabulary)
        self.special = re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")")
        self.chunks = ChunkIds(self._code)
        # Every token with a blank behind it.
        written = [f"{t} ".encode() for t in vocabulary.tokens]
        self.written = np.frombuffer(b"".join(written), dtype=np.uint8)
        self.written_size = np.array([len(w) for w in written], dtype=np.int64)
        self.written_at = np.cumsum(self.written_size) - self.written_size

    def _code(self, chunks: list[str]) -> Coded:
        """Numbers of ids and ids of chunks; all their words are looked up in the transducer at once."""
        pieces: list[list] = []
        words: dict[str, None] = {}
        for c in chunks:
            parts: list = []
            for k, segment in enumerate(self.special.split(c) if "<|" in c else [c]):
                if k % 2:
                    parts.append(self.v.special[segment])
                    continue
                for word in chunks_of(segment):
                    found = PIECES.findall(normalised(word))
                    parts += found
                    words.update(dict.fromkeys(found))
            pieces.append(parts)
        order = list(words)
        ids: dict[object, tuple[int, ...]] = {}
        for w, n in zip(order, self.t.numbers(order).tolist(), strict=True):
            ids[w] = self.t.ids_of(n) if n >= 0 else self.merger.ids(w)
        sizes, flat = [], []
        for parts in pieces:
            own = [i for p in parts for i in ((p,) if isinstance(p, int) else ids[p])]
            sizes.append(len(own))
            flat += own
        coded = np.array(sizes, dtype=np.int64), np.array(flat, dtype=np.uint32)
        return [coded], np.ones(len(chunks), dtype=bool)

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of a slice of texts and the texts' bounds in them, slice by slice."""
        for data, offsets, _ in text_slices(texts):
            (coded,), _ = self.chunks.encode(data, offsets)
            yield coded

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the tokens, special ones included, with blanks between; and the texts' bounds."""
        sizes = self.written_size[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        return take_runs(self.written, self.written_at[ids], sizes), ends


def count_words(docs: DataFrame, words: int) -> DataFrame:
    """``word, n`` of the most frequent normalised pieces over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(chunks_of(text))
                if len(seen) > HELD_CHUNKS:
                    # Those met once make room; the others stay and go on adding up.
                    yield emit({c: 1 for c, n in seen.items() if n == 1})
                    seen = Counter({c: n for c, n in seen.items() if n > 1})
                    if len(seen) > HELD_CHUNKS // 2:
                        yield emit(seen)
                        seen = Counter()
        yield emit(seen)

    def emit(seen: dict[str, int]) -> pa.RecordBatch:
        total: dict[str, int] = {}
        for c, n in seen.items():
            for w in PIECES.findall(normalised(c)):
                total[w] = total.get(w, 0) + n
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
        )

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.desc("n"), "word").limit(words)


def share_file(spark: SparkSession, data: bytes, name: str) -> str:
    """Puts bytes into the shared folder and has every executor fetch them; returns the file's name."""
    path = f"{scratch_path(spark, name)}.bin"
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(sc._jsc.hadoopConfiguration()).create(place, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    sc.addFile(path)
    return path.rsplit("/", 1)[-1]


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, words: int = LEXICON_WORDS) -> str:
    """Compiles the most frequent words of all texts; returns the name under which tasks find them."""
    merger = Merger(vocabulary)
    top = count_words(docs, words).toArrow()["word"].to_pylist()
    lexicon = compile_lexicon({w: merger.ids(w) for w in top})
    return share_file(docs.sparkSession, packed(lexicon), "lexicon")


ENCODED = "ids binary, decoded string"


def encode_texts(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded`` of each whole text appended (such columns are replaced).

    ``ids`` holds little-endian unsigned 32-bit numbers, ``decoded`` what decoding these gives.
    With ``digests`` the columns are ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` instead.
    ``path`` is a vocabulary file.  Null and empty texts have no ids and decode to an empty
    text; repeated rows are encoded each; an empty table gives no rows.
    """
    vocabulary = Vocabulary.read(path)
    name = build_lexicon(docs, vocabulary)

    def encoder() -> Encoder:
        # One for the worker and lexicon: what is remembered outlives a task.
        if _encoders.get("name") != name:
            _encoders.clear()
            _encoders.update(name=name, encoder=Encoder(vocabulary, Transducer(SparkFiles.get(name))))
        return _encoders["encoder"]

    new = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    kept = [c for c in docs.columns if c not in new]
    types = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else ENCODED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        for b in batches:
            lo = 0
            for ids, bounds in enc.encode(b.column(b.schema.get_field_index("__text"))):
                part = b.slice(lo, len(bounds) - 1)
                lo += len(bounds) - 1
                written, ends = enc.decode(ids, bounds)
                coded, text = ids.astype("<u4", copy=False).tobytes(), written.tobytes()
                own = [coded[4 * x : 4 * y] for x, y in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
                # Without the blank behind the last token.
                said = [text[x : max(x, y - 1)] for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                if digests:
                    out = [
                        pa.array(np.diff(bounds)),
                        pa.array([hashlib.sha256(i).hexdigest() for i in own], pa.string()),
                        pa.array([hashlib.sha256(d).hexdigest() for d in said], pa.string()),
                    ]
                else:
                    out = [pa.array(own, pa.binary()), pa.array(said, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(len(kept))), *out], names=[*kept, *new]
                )

    schema = docs.select(*kept).schema
    for f in _fields(types):
        schema = schema.add(*f)
    return docs.select(*kept, F.col("text").alias("__text")).mapInArrow(run, schema)


_encoders: dict[str, object] = {}


def _fields(types: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in types.split(", ")]
