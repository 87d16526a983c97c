"""All keywords of a table found in one pass over a text, by an automaton with failure links."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

# Letters of all keywords together that an automaton may have: about 100 MB in each worker.
AUTOMATON_LETTERS = 2_000_000

# The worker's automata by name; a new one takes the place of the oldest.
_built: dict[str, object] = {}
KEPT = 4
# The one slice of a larger table that a worker holds.
_slice: dict[str, object] = {}


def _letters(entries: DataFrame) -> int:
    letters = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + 1 for c in entries.columns), F.lit(0))
    return entries.agg(F.sum(letters).alias("n")).first().n or 0


def fits(entries: DataFrame) -> bool:
    """Whether the entries' text (first column: the keyword) stays within the bound.

    Measured, not assumed: one aggregate over the table.
    """
    return _letters(entries) <= AUTOMATON_LETTERS


def slices_for(entries: DataFrame) -> int:
    """Into how many automata a table must be dealt whose owners alone are found, by measured size."""
    keyword, *owner = entries.columns
    letters = _letters(entries.select(keyword).distinct()) + _letters(entries.select(*owner).distinct())
    return max(1, math.ceil(letters / AUTOMATON_LETTERS))


def _is_word(letter: str) -> bool:
    return letter == "_" or letter.isalnum()


def _compiled(rows: list[tuple], words: bool) -> object | None:
    """Automaton of the rows' keywords; a find gives its length, its boundary rule and its rows.

    The rule holds for keywords without a blank: a letter at an end must not stand next to a
    letter, any other character must.
    """
    import ahocorasick

    of: dict[str, list[tuple]] = {}
    for keyword, *rest in rows:
        of.setdefault(keyword, []).append((keyword, *rest))
    automaton = ahocorasick.Automaton()
    for keyword, own in of.items():
        rule = None if not words or " " in keyword else (not _is_word(keyword[0]), not _is_word(keyword[-1]))
        automaton.add_word(keyword, (len(keyword), rule, own))
    automaton.make_automaton()
    return automaton if of else None


def _stands(text: str, start: int, end: int, rule: tuple[bool, bool]) -> bool:
    before = start > 0 and _is_word(text[start - 1])
    after = end < len(text) and _is_word(text[end])
    return before == rule[0] and after == rule[1]


def _finds(automaton: object, text: str) -> list[list[tuple]]:
    """The rows of each keyword that occurs, every keyword once."""
    seen: dict[int, list[tuple]] = {}
    for last, (size, rule, own) in automaton.iter(text):
        if id(own) not in seen and (rule is None or _stands(text, last + 1 - size, last + 1, rule)):
            seen[id(own)] = own
    return list(seen.values())


def _rows_type(schema: StructType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.list_(pa.struct(list(to_arrow_schema(schema))))


def _rows_automaton(name: str, sent: object, words: bool) -> object | None:
    # Here, as what a nested function names is sent with it, and each task would get new dictionaries.
    if name not in _built:
        while len(_built) >= KEPT:
            _built.pop(next(iter(_built)))
        _built[name] = _compiled(sent.value, words)
    return _built[name]


def keyword_finder(entries: DataFrame, words: bool = True) -> Callable[[Column], Column]:
    """A function from a text column to the array of all rows of ``entries`` whose keyword occurs.

    ``entries`` has the keyword, lower-case and not empty, as first column and must pass ``fits``;
    its rows are sent to the tasks once and compiled once in each worker.  With ``words`` a keyword
    without a blank must stand between word boundaries, else any substring counts.  A null text
    finds nothing.  Python's letters and digits make words.
    """
    schema = entries.schema
    sent = entries.sparkSession.sparkContext.broadcast([tuple(r) for r in entries.distinct().collect()])
    name, kind = uuid.uuid4().hex, _rows_type(schema)

    @F.arrow_udf(ArrayType(schema))
    def find(texts: pa.Array) -> pa.Array:
        automaton = _rows_automaton(name, sent, words)
        if automaton is None:
            return pa.array([[]] * len(texts), kind)
        out = [
            [] if text is None else [dict(zip(schema.names, row)) for own in _finds(automaton, text) for row in own]
            for text in texts.to_pylist()
        ]
        return pa.array(out, kind)

    # Not copied into filters: the text is searched once.
    return find.asNondeterministic()


class _Owners:
    """Automaton of a table's keywords; a find gives the numbers of the rows' other columns.

    Keywords alike in owners and boundary rule share one entry, so a keyword costs its letters only.
    """

    def __init__(self, entries: pa.Table, words: bool):
        import ahocorasick

        keyword, *owner = entries.column_names
        numbers: dict[tuple, int] = {}
        of: dict[str, set[int]] = {}
        for row in zip(*(entries[c].to_pylist() for c in entries.column_names), strict=True):
            of.setdefault(row[0], set()).add(numbers.setdefault(row[1:], len(numbers)))
        types = [entries.schema.field(c) for c in owner]
        self.rows = pa.StructArray.from_arrays(
            [pa.array([n[k] for n in numbers], f.type) for k, f in enumerate(types)], fields=types
        )
        codes: dict[tuple, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS) if of else None
        while of:
            word, own = of.popitem()
            rule = None if not words or " " in word else (len(word), (not _is_word(word[0]), not _is_word(word[-1])))
            self.automaton.add_word(word, codes.setdefault((rule, frozenset(own)), len(codes)))
        self.codes = list(codes)
        if self.automaton is not None:
            self.automaton.make_automaton()

    def found(self, text: str | None) -> list[int]:
        """Numbers of the owners of all keywords in the text, ascending."""
        if not text or self.automaton is None:
            return []
        seen, out = set(), set()
        for last, code in self.automaton.iter(text):
            if code not in seen:
                rule, own = self.codes[code]
                if rule is None or _stands(text, last + 1 - rule[0], last + 1, rule[1]):
                    seen.add(code)
                    out |= own
        return sorted(out)

    def of_texts(self, texts: pa.Array) -> pa.Array:
        found = [self.found(text) for text in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, found)])
        flat = pa.array([n for own in found for n in own], pa.int64())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.rows.take(flat))


def _owners(name: str, entries: object, words: bool, in_slices: bool = False) -> _Owners:
    kept, most = (_slice, 1) if in_slices else (_built, KEPT)
    if name not in kept:
        while len(kept) >= most:
            kept.pop(next(iter(kept)))
        kept[name] = _Owners(entries.value, words)
    return kept[name]


def _sent(entries: DataFrame) -> tuple[str, object]:
    return uuid.uuid4().hex, entries.sparkSession.sparkContext.broadcast(entries.distinct().toArrow())


def owner_finder(entries: DataFrame, words: bool = True) -> Callable[[Column], Column]:
    """Like ``keyword_finder``, but for the distinct rows of the columns after the keyword."""
    name, sent = _sent(entries)

    @F.arrow_udf(ArrayType(StructType(entries.schema.fields[1:])))
    def find(texts: pa.Array) -> pa.Array:
        return _owners(name, sent, words).of_texts(texts)

    return find.asNondeterministic()


def owners_by_id(texts: DataFrame, entries: DataFrame, words: bool = True) -> DataFrame:
    """``_id, _own`` of those ``texts`` (id, text) that hold a keyword of ``entries``, a slice of a table."""
    name, sent = _sent(entries)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _owners(name, sent, words, True).of_texts(b.column(1))
            hit = pa.compute.greater(pa.compute.list_value_length(own), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), own], names=["_id", "_own"]).filter(hit)

    kind = ArrayType(StructType(entries.schema.fields[1:]))
    return texts.mapInArrow(find, StructType().add("_id", texts.schema[0].dataType).add("_own", kind))
