"""Token ids of whole texts through the ids of their chunks, which each worker remembers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import SparkSession

from tickertide.llm.common import _power_tables, mix64

# Bytes of text handled at once.
SLICE_BYTES = 1 << 19
# Chunks a worker remembers; beyond that those go that didn't occur again.
REMEMBERED = 1 << 19
# Characters after which chunks that are encoded together are a text.
JOINED_CHARS = 2_000
# A vocabulary file larger than this isn't a vocabulary.
VOCABULARY_BYTES = 1 << 26

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[0x20] = True

# For a list of chunks: per vocabulary the numbers of ids and all ids, and which chunks have ids.
Coded = tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]
Coder = Callable[[list[str]], Coded]


def ship_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a vocabulary file of the driver, for all tasks; refused above a fixed size."""
    with open(path, "rb") as file:
        data = file.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def take_runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``flat[start : start + size]`` of all runs, one after the other."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def text_slices(column: pa.Array, prefix: bytes = b"") -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes, row offsets and first row of slices of about SLICE_BYTES; nulls are empty.

    ``prefix`` is put before every text that isn't empty.
    """
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, where, bytes_ = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(bytes_, dtype=np.uint8) if bytes_ is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1
        j = min(max(j, i + 1), n)
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if prefix:
            sizes = np.diff(own)
            full = np.flatnonzero(sizes)
            part = np.insert(part, np.repeat(own[full], len(prefix)), np.frombuffer(prefix * len(full), np.uint8))
            own = np.concatenate([[0], np.cumsum(sizes + (sizes > 0) * len(prefix))])
        yield part, own, i
        i = j


def _odd_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True where the character that ends before ``at`` is white space beyond ASCII."""
    one, two = data[at - 1], data[np.maximum(at - 2, 0)]
    odd = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    three = data[np.maximum(at - 3, 0)]
    general = (three == 0xE2) & (two == 0x80)
    odd |= general & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    odd |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
    odd |= (three == 0xE1) & (((two == 0x9A) & (one == 0x80)) | ((two == 0xA0) & (one == 0x8E)))
    return odd | ((three == 0xE3) & (two == 0x80) & (one == 0x80))


def chunk_starts(data: np.ndarray, offsets: np.ndarray, blanks_only: bool) -> np.ndarray:
    """Where chunks begin: at each text, and where white space follows another character.

    No vocabulary here has a token across such a place, and no splitter looks beyond it, so the
    ids of a text are those of its chunks.  ``blanks_only`` takes blanks alone for white space to
    begin at.
    """
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    begins = (_BLANK if blanks_only else _WHITE)[data]
    begins[1:] &= ~_WHITE[data[:-1]]
    rows = offsets[:-1][np.diff(offsets) > 0]
    begins[rows] = False
    at = np.flatnonzero(begins)
    at = at[~_odd_white(data, at)]
    begins[:] = False
    begins[at] = True
    begins[rows] = True
    return np.flatnonzero(begins)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * inverse[starts]
    return mix64(value + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


class _Runs:
    """A growing list of number runs in one flat array."""

    def __init__(self, dtype: type):
        self.flat, self.end = np.zeros(1 << 16, dtype), 0
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def room(self, entries: int) -> None:
        for name in ("at", "size"):
            old = getattr(self, name)
            new = np.zeros(entries, np.int64)
            new[: min(len(old), entries)] = old[:entries]
            setattr(self, name, new)

    def put(self, first: int, sizes: np.ndarray, flat: np.ndarray) -> None:
        while self.end + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.end : self.end + len(flat)] = flat
        self.at[first : first + len(sizes)] = self.end + np.cumsum(sizes) - sizes
        self.size[first : first + len(sizes)] = sizes
        self.end += len(flat)

    def of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.size[entries]
        return sizes, take_runs(self.flat, self.at[entries], sizes)


class ChunkIds:
    """Ids of texts by a hash table of chunks already seen; hits are compared byte by byte."""

    def __init__(self, code: Coder, streams: int = 1, blanks_only: bool = False, limit: int = REMEMBERED):
        self.code, self.streams, self.blanks_only, self.limit = code, streams, blanks_only, limit
        self._clear(1 << 12)

    def _clear(self, room: int) -> None:
        self.n = 0
        self.slots = np.full(4 * room, -1, dtype=np.int32)
        self.keys = np.zeros(room, np.uint64)
        self.valid, self.used = np.zeros(room, bool), np.zeros(room, bool)
        self.text, self.ids = _Runs(np.uint8), [_Runs(np.uint32) for _ in range(self.streams)]
        for runs in (self.text, *self.ids):
            runs.room(room)

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        mask = np.uint64(len(self.slots) - 1)
        at = (keys & mask).astype(np.int64)
        entry = self.slots[at].astype(np.int64)
        open_ = np.flatnonzero((entry >= 0) & (self.keys[entry] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(mask)
            entry[open_] = self.slots[at[open_]]
            found = entry[open_]
            open_ = open_[(found >= 0) & (self.keys[found] != keys[open_])]
        return entry

    def _place(self, first: int, last: int) -> None:
        """Puts entries into free slots."""
        entry = np.arange(first, last)
        at = (self.keys[first:last] & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(entry):
            free = self.slots[at] < 0
            self.slots[at[free]] = entry[free]
            left = self.slots[at] != entry
            entry, at = entry[left], (at[left] + 1) & (len(self.slots) - 1)

    def _room(self, more: int) -> None:
        """Makes room for entries; beyond the limit those unused since the last time go."""
        if self.n + more > self.limit and self.n:
            keep = np.flatnonzero(self.used[: self.n])
            self._rebuild(keep if len(keep) + more <= self.limit else keep[:0], len(self.keys))
        size = len(self.keys)
        while self.n + more > size:
            size *= 2
        if size > len(self.keys):
            self._rebuild(np.arange(self.n), size)

    def _rebuild(self, keep: np.ndarray, room: int) -> None:
        keys, valid, used = self.keys[keep], self.valid[keep], self.used[keep]
        runs = [r.of(keep) for r in (self.text, *self.ids)]
        forgets = len(keep) < self.n
        self._clear(room)
        self.n = len(keep)
        self.keys[: self.n], self.valid[: self.n] = keys, valid
        self.used[: self.n] = False if forgets else used
        for r, (sizes, flat) in zip((self.text, *self.ids), runs, strict=True):
            r.put(0, sizes, flat)
        self._place(0, self.n)

    def _learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        """Adds chunks; ``keys`` are new and distinct."""
        ids, valid = self.code([t.decode() for t in texts])
        self._room(len(keys))
        first, self.n = self.n, self.n + len(keys)
        self.keys[first : self.n], self.valid[first : self.n], self.used[first : self.n] = keys, valid, False
        self.text.put(first, np.array([len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8))
        for r, (sizes, flat) in zip(self.ids, ids, strict=True):
            r.put(first, sizes, flat)
        self._place(first, self.n)

    def _of_chunks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple:
        """For each chunk its numbers of ids, the ids of all, and whether it has any."""
        keys = _hashes(data, starts, ends)
        entry = self._lookup(keys)
        self.used[entry[entry >= 0]] = True
        new = np.flatnonzero(entry < 0)
        if len(new):
            distinct, first = np.unique(keys[new], return_index=True)
            self._learn(distinct, [data[starts[i] : ends[i]].tobytes() for i in new[first].tolist()])
            entry = self._lookup(keys)
            if (entry < 0).any():
                return self._afresh(data, starts, ends)
        sizes, text = self.text.of(entry)
        if not np.array_equal(sizes, ends - starts) or not np.array_equal(text, data):
            return self._afresh(data, starts, ends)
        return [r.of(entry) for r in self.ids], self.valid[entry]

    def _afresh(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple:
        """The same without the table, for chunks that share a hash or exceed its limit."""
        texts = [data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        order = {t: k for k, t in enumerate(dict.fromkeys(texts))}
        ids, valid = self.code(list(order))
        entry = np.array([order[t] for t in texts], dtype=np.int64)
        out = [
            (sizes[entry], take_runs(flat, (np.cumsum(sizes) - sizes)[entry], sizes[entry])) for sizes, flat in ids
        ]
        return out, valid[entry]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Per stream the ids of all rows and the rows' bounds in them; and which rows have ids.

        A long text is handled in parts of SLICE_BYTES, so only its ids are held as a whole.
        """
        rows = len(offsets) - 1
        starts = chunk_starts(data, offsets, self.blanks_only)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        row = np.searchsorted(offsets, starts, side="right") - 1
        counts = [np.zeros(rows, dtype=np.int64) for _ in range(self.streams)]
        flat: list[list[np.ndarray]] = [[np.zeros(0, np.uint32)] for _ in range(self.streams)]
        fits = np.ones(rows, dtype=bool)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, side="right")))
            lo, hi = starts[i], ends[j - 1]
            streams, valid = self._of_chunks(data[lo:hi], starts[i:j] - lo, ends[i:j] - lo)
            for k, (sizes, ids) in enumerate(streams):
                counts[k] += np.bincount(row[i:j], weights=sizes, minlength=rows).astype(np.int64)
                flat[k].append(ids)
            fits[row[i:j][~valid]] = False
            i = j
        return [
            (np.concatenate(flat[k]), np.concatenate([[0], np.cumsum(counts[k])])) for k in range(self.streams)
        ], fits


_coders: dict[str, ChunkIds] = {}


def worker_coder(kind: str, make: Callable[..., ChunkIds], *vocabularies: bytes) -> ChunkIds:
    """The worker's own table for these vocabularies; it outlives a task."""
    name = "-".join([kind, *(hashlib.md5(v, usedforsecurity=False).hexdigest() for v in vocabularies)])
    if name not in _coders:
        _coders[name] = make(*vocabularies)
    return _coders[name]


def byte_pair_ids(tokenizer: object) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Numbers of ids and all ids of some chunks, by a byte-level tokenizer of the tokenizers library.

    Chunks that begin with white space are given to it several together, as no token crosses
    them; the bytes of the tokens tell which are whose.
    """
    entries = tokenizer.get_vocab(with_added_tokens=True)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    # A letter of a token stands for a byte, but in special tokens for itself.
    bytes_of = np.zeros(max(entries.values()) + 1, dtype=np.int64)
    for token, i in entries.items():
        bytes_of[i] = len(token.encode()) if token in special else len(token)

    def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes, flat = [], []
        for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = e.ids
            sizes.append(len(ids))
            flat += ids
        return np.array(sizes, dtype=np.int64), np.array(flat, dtype=np.uint32)

    def code(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts: list[str] = []
        own: list[str] = []
        held, joins = 0, False
        for c in chunks:
            if own and not (joins and c[0] in " \t\n\r\x0b\x0c" and held < JOINED_CHARS):
                texts.append("".join(own))
                own, held = [], 0
            own.append(c)
            held += len(c)
            joins = not c[-1].isspace()
        if own:
            texts.append("".join(own))
        _, flat = encoded(texts)
        ends = np.cumsum([len(c.encode()) for c in chunks], dtype=np.int64)
        token_ends = np.cumsum(bytes_of[flat])
        upto = np.searchsorted(token_ends, ends, side="right")
        if len(flat) and np.array_equal(token_ends[np.maximum(upto - 1, 0)], ends):
            return np.diff(upto, prepend=0), flat
        return encoded(chunks)

    return code
