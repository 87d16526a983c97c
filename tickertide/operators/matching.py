"""Headlines to tickers: keyword search, AI relevance, partnerships and context notes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from tickertide.functions.text import (
    WORD,
    contains_keyword,
    is_blank,
    let,
    normalize_headline,
    strip,
    word_tokens,
)
from tickertide.operators import automaton, windows
from tickertide.schemas import PARTNER_ROLES
from tickertide.session import cut_lineage

# Marks that tell which keys a large table may hold: at most this many bytes in the plan.
SLOTS = 1 << 18
# Characters on each side of a phrase's blank that serve as its key.
STRETCH = 3


def _keyword_rows(lex: DataFrame | None, ai_terms: DataFrame | None) -> DataFrame:
    """Both keyword tables in one layout, lower-case; a keyword may have several rows."""
    frames = []
    if lex is not None:
        kw = F.lower(strip(F.col("keyword"))).alias("keyword")
        partner = F.col("role").isin(PARTNER_ROLES).alias("partner")
        frames.append(lex.select(kw, "ticker", partner, F.lit(False).alias("ai")))
    if ai_terms is not None:
        kw = F.lower(strip(F.col("term"))).alias("keyword")
        frames.append(
            ai_terms.select(
                kw, F.lit(None).cast("string").alias("ticker"), F.lit(False).alias("partner"), F.lit(True).alias("ai")
            )
        )
    rows = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    return rows.where("keyword <> ''")


def _once(col: Column) -> Column:
    """A one-element generator around an expensive column.

    The optimizer copies a plain column into every filter on it; a generator's output it
    computes exactly once per row.
    """
    return F.explode(F.array(col))


def _slot(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SLOTS)).cast("int")


def _may_hold(slots: list[int]) -> Callable[..., Column]:
    """Test whether a table with keys in ``slots`` can hold a key; it may say yes wrongly.

    As many bytes as sixteen times the keys, but never more than ``SLOTS``; a longer table only
    makes more false hits, which the join on the key removes.
    """
    size = min(SLOTS, 1 << max(8, (16 * len(slots) - 1).bit_length()))
    marks = bytearray(size)
    for slot in slots:
        marks[slot % size] = 1
    held = F.lit(bytes(marks))
    return lambda *key: F.substring(held, F.pmod(_slot(*key), F.lit(size)) + 1, F.lit(1)) == F.lit(b"\x01")


def _keyword_key(kw: Column) -> Column:
    """Equi-join key of a keyword: the text around its first blank, its first word, or itself.

    A phrase is a plain substring, so its first and last word may be parts of longer words;
    what surely occurs in the text is the stretch around its blank, up to ``STRETCH`` characters
    on each side.  A keyword of punctuation only must fill the whole gap between two words.
    """
    at = F.instr(kw, " ")
    before = F.least(at - 1, F.lit(STRETCH))
    after = F.least(F.length(kw) - at, F.lit(STRETCH))
    stretch = F.substring(kw, at - before, before + F.lit(1) + after)
    word = F.try_element_at(word_tokens(kw), F.lit(1))
    return F.when(at > 0, stretch).otherwise(F.coalesce(word, kw))


def _text_keys(text: Column, shapes: list[Row]) -> Column:
    """The keys a text can share with keywords: words, gaps between words, stretches around blanks.

    ``shapes`` are the numbers of characters before and after the blank that keys have.
    """
    gaps = F.regexp_extract_all(text, F.lit(f"(?<={WORD})[^ {WORD[1:-1]}]+(?={WORD})"), F.lit(0))
    around = [
        F.regexp_extract_all(text, F.lit(f"(?s)(?=([^ ]{{{s.before}}} .{{{s.after}}}))"), F.lit(1)) for s in shapes
    ]
    return F.concat(word_tokens(text), gaps, *around)


def _text_id(*cols: str) -> Column:
    """128 bits that name a text, or a row of several columns."""
    value = F.col(cols[0]) if len(cols) == 1 else F.to_json(F.struct(*cols))
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


def _found_by_key(df: DataFrame, text: str, keywords: DataFrame) -> DataFrame:
    """Keyword hits per row for a large keyword table, by an equi-join on shared keys.

    Keys that no keyword has are dropped in the scan.  Only (text id, key) pairs travel to the
    join, and each distinct text comes back as one row of candidates, so a text that makes up a
    third of all rows costs one row per task.  Words need no further test; other candidates are
    verified in the row itself.  Which side is broadcast, or split, is decided by measured size.
    """
    kw = F.col("keyword")
    exact = kw.rlike(f"^{WORD}+$") | ~kw.rlike(f" |{WORD}")
    keyed = keywords.withColumns({"_key": _keyword_key(kw), "exact": exact})
    before = F.instr("_key", " ") - 1
    shape = F.struct(before.alias("before"), (F.length("_key") - before - 1).alias("after"))
    # Both sets are bounded: by SLOTS, and by the square of STRETCH.
    held = keyed.agg(
        F.collect_set(_slot(F.col("_key"))).alias("slots"), F.collect_set(F.when(before > 0, shape)).alias("shapes")
    ).first()
    may_hold = _may_hold(held.slots)
    shapes = sorted(held.shapes)

    rows = df.withColumn("_id", _text_id(text))
    own = let(F.col(text), lambda t: F.array_distinct(F.filter(_text_keys(t, shapes), lambda k: may_hold(k))))
    hits = rows.select("_id", F.explode(own).alias("_key")).join(keyed, "_key")
    entry = F.struct("keyword", "ticker", "partner", "ai", "exact")
    # Grouped by one column more than joined on: the join then has its own shuffle, whose
    # oversized partitions adaptive execution can split.
    candidates = (
        hits.groupBy("_id", F.xxhash64("_id").alias("_hash"))
        .agg(F.collect_set(entry).alias("_cands"))
        .drop("_hash")
    )
    verified = F.filter(
        F.col("_cands"),
        lambda c: F.when(c["exact"], F.lit(True))
        .when(F.contains(c["keyword"], F.lit(" ")), F.contains(F.col(text), c["keyword"]))
        .otherwise(contains_keyword(F.col(text), c["keyword"])),
    )
    joined = rows.join(candidates, "_id", "left")
    return joined.select("*", _once(verified).alias("_found")).drop("_id", "_cands")


def find_keywords(df: DataFrame, text: str, keywords: DataFrame, strategy: str = "auto") -> DataFrame:
    """Add ``_found``: the keyword entries present in the normalised column ``text``.

    ``auto`` (or ``broadcast``) searches each text once with an automaton of all keywords, without
    a shuffle, as long as their measured size stays within ``AUTOMATON_LETTERS``; beyond that, and
    for ``token``, keywords are joined by key.  Both give the same result.
    """
    if strategy not in ("auto", "broadcast", "token"):
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy != "token" and automaton.fits(keywords):
        return df.withColumn("_found", automaton.keyword_finder(keywords)(F.col(text)))
    return _found_by_key(df, text, keywords)


def _owners_in_slices(
    df: DataFrame, text: str, keywords: DataFrame, slices: int, words: bool = True
) -> DataFrame:
    """Owners per row for a keyword table of any size: its slices are searched for one after another.

    Texts stay where they are: what moves is an id and the owners found, per text and slice, not
    a row per keyword that a text holds.  A worker has one slice in memory, whatever the table's size.
    """
    rows = df.withColumn("_id", _text_id(text))
    texts = cut_lineage(rows.select("_id", text).where(F.col(text) != ""), "texts")
    dealt = keywords.withColumn("_slice", F.pmod(F.xxhash64("keyword"), F.lit(slices)))
    dealt = cut_lineage(dealt.distinct(), "keywords")
    parts = [
        automaton.owners_by_id(texts, dealt.where(F.col("_slice") == k).drop("_slice"), words) for k in range(slices)
    ]
    # A text that many rows repeat gives each slice the same array: a set keeps one.
    found = (
        reduce(DataFrame.unionAll, parts)
        .groupBy("_id", F.xxhash64("_id").alias("_hash"))
        .agg(F.array_distinct(F.flatten(F.collect_set("_own"))).alias("_found"))
        .drop("_hash")
    )
    return rows.join(found, "_id", "left").drop("_id")


def owner_search(keywords: DataFrame, strategy: str = "auto") -> Callable[[DataFrame, str], DataFrame]:
    """A function that adds ``_found``: the distinct ticker, partner and ai of the keywords present in a text column.

    As ``find_keywords``, but the keywords themselves are left out, so that a table beyond the
    bound needs no join on keys: the windows of a text are looked up in tables of any size.  The
    keywords are measured and sent to the tasks here, once for all frames that are searched.
    """
    if strategy == "token":
        return lambda df, text: find_keywords(df, text, keywords, strategy)
    if strategy not in ("auto", "broadcast"):
        raise ValueError(f"unknown strategy: {strategy}")
    slices = automaton.slices_for(keywords)
    if slices == 1:
        find = automaton.owner_finder(keywords)
        return lambda df, text: df.withColumn("_found", find(F.col(text)))
    return windows.owner_search(keywords, slices)


def find_owners(df: DataFrame, text: str, keywords: DataFrame, strategy: str = "auto") -> DataFrame:
    """Add ``_found`` to one frame, see ``owner_search``."""
    return owner_search(keywords, strategy)(df, text)


def _found_in(h: DataFrame, search: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    return search(h.withColumn("_text", normalize_headline(F.col("headline"))), "_text").drop("_text")


def _with_found(
    df: DataFrame, lex: DataFrame | None, ai_terms: DataFrame | None, strategy: str
) -> DataFrame:
    return _found_in(df, owner_search(_keyword_rows(lex, ai_terms), strategy))


def match_tickers(
    h: DataFrame,
    lex: DataFrame,
    ai_terms: DataFrame,
    strategy: str = "auto",
    ai_only: bool = False,
) -> DataFrame:
    """One row per headline row and ticker with at least one keyword in the headline.

    Headlines without a ticker disappear, and a row that occurs twice yields its rows twice.
    ``ai_only`` leaves headlines without an AI term out before rows are unfolded.
    """
    return ticker_matcher(lex, ai_terms, strategy, ai_only)(h)


def ticker_matcher(
    lex: DataFrame, ai_terms: DataFrame, strategy: str = "auto", ai_only: bool = False
) -> Callable[[DataFrame], DataFrame]:
    """``match_tickers`` for many frames: the keyword tables are read once, here."""
    search = owner_search(_keyword_rows(lex, ai_terms), strategy)
    return lambda h: _unfolded(h, _found_in(h, search), ai_only)


def _unfolded(h: DataFrame, found: DataFrame, ai_only: bool) -> DataFrame:
    """A row per ticker found."""
    is_ai = F.exists("_found", lambda e: e["ai"])
    named = F.filter("_found", lambda e: ~e["ai"])
    tickers = F.array_sort(F.array_distinct(F.transform(named, lambda e: e["ticker"])))
    partners = F.array_distinct(F.transform(F.filter("_found", lambda e: e["partner"]), lambda e: e["ticker"]))
    # The flags are part of the unfolded rows, so a later filter on them stays above and
    # does not search the text again; they are worked out once for all tickers of a text.
    rows = let(
        F.struct(is_ai.alias("ai"), partners.alias("partners"), tickers.alias("tickers")),
        lambda s: F.transform(
            s["tickers"],
            lambda t: F.struct(
                t.alias("ticker"),
                s["ai"].alias("is_ai_related"),
                F.array_contains(s["partners"], t).alias("is_proxy_partnership"),
            ),
        ),
    )
    return found.select(*h.columns, F.inline(F.when(is_ai, rows) if ai_only else rows))


def ai_flag(h: DataFrame, ai_terms: DataFrame, strategy: str = "auto") -> DataFrame:
    """Add ``is_ai_related``: any AI term occurs in the headline."""
    found = _with_found(h, None, ai_terms, strategy)
    flag = F.coalesce(F.size("_found") > 0, F.lit(False))
    return found.select(*h.columns, flag.alias("is_ai_related"))


def partnership_flag(h: DataFrame, lex: DataFrame, strategy: str = "auto") -> DataFrame:
    """Add ``is_proxy_partnership`` to (headline, ticker) rows: a partner of that ticker occurs."""
    partners = lex.where(F.col("role").isin(PARTNER_ROLES))
    found = _with_found(h, partners, None, strategy)
    names = F.transform("_found", lambda e: e["ticker"])
    flag = F.coalesce(F.array_contains(names, F.col("ticker")), F.lit(False))
    return found.select(*h.columns, flag.alias("is_proxy_partnership"))


def headline_tickers(matched: DataFrame) -> DataFrame:
    """Each headline with its distinct non-blank tickers, in ticker order."""
    ticker = strip(F.col("ticker"))
    return (
        matched.where(~is_blank(F.col("ticker")))
        .groupBy("headline")
        .agg(F.array_sort(F.collect_set(ticker)).alias("tickers"))
    )


def _context_text(parts: Column) -> Column:
    text = F.concat(F.lit("This news relates to "), F.array_join(parts, "; "), F.lit("."))
    return F.when(F.size(parts) > 0, text)


def _context_by_key(h_tickers: DataFrame, notes: DataFrame) -> DataFrame:
    """Context notes by an equi-join on ticker and keyword.

    The keywords in a headline come from one pass over it (in slices, where they are very many), and
    only a row's id travels to the join, with those pairs that notes may have.  Texts don't move.
    """
    columns = ["ticker", "position", "keyword", "context"]
    keyed = notes.groupBy(columns).agg(F.count(F.lit(1)).cast("int").alias("times"))
    # Bounded by SLOTS.
    slots = keyed.agg(F.collect_set(_slot(F.col("ticker"), F.col("keyword"))).alias("slots")).first().slots
    may_hold = _may_hold(slots)
    words = notes.select("keyword", F.col("keyword").alias("word")).distinct()
    slices = automaton.slices_for(words)
    text = F.lower(strip(F.col("headline")))
    if slices == 1:
        found = h_tickers.withColumn("_found", automaton.owner_finder(words, words=False)(text))
    else:
        found = _owners_in_slices(h_tickers.withColumn("_h", text), "_h", words, slices, words=False).drop("_h")

    row_id = _text_id("headline", "tickers").alias("_id")
    own = F.transform("_found", lambda f: f["word"])
    keys = found.select(row_id, own.alias("_own"), F.posexplode("tickers").alias("at", "ticker")).select(
        "_id", "at", "ticker", F.explode(F.filter("_own", lambda k: may_hold(F.col("ticker"), k))).alias("keyword")
    )
    entry = F.struct("at", "position", "keyword", "context", "times")
    # Rows alike have the same notes: a set keeps them once.
    candidates = (
        keys.join(keyed, ["ticker", "keyword"])
        .groupBy("_id", F.xxhash64("_id").alias("_hash"))
        .agg(F.collect_set(entry).alias("_notes"))
        .drop("_hash")
    )
    joined = h_tickers.withColumn("_id", row_id).join(candidates, "_id", "left")
    parts = F.flatten(F.transform(F.array_sort("_notes"), lambda c: F.array_repeat(c["context"], c["times"])))
    return joined.withColumn("context", _context_text(parts)).drop("_id", "_notes")


def headline_context(h_tickers: DataFrame, contexts: DataFrame, strategy: str = "auto") -> DataFrame:
    """Add ``context``: the notes of all context keywords of the row's tickers, or null.

    Keywords are raw substrings, and a note is repeated for every keyword that leads to it.
    Notes come in the order of the row's tickers, then of their position.  Keywords are found by
    an automaton, in one pass over a headline; notes beyond its measured size (or
    ``strategy="token"``) are joined by key, with the same result.
    """
    text = F.lower(strip(F.col("headline")))
    notes = contexts.where("keyword <> '' and context <> ''").withColumn("keyword", F.lower("keyword"))
    notes = notes.select("keyword", "ticker", "position", "context")
    if strategy == "token" or not automaton.fits(notes):
        return _context_by_key(h_tickers, notes)
    found = h_tickers.withColumn("_notes", automaton.keyword_finder(notes, words=False)(text))

    def of_ticker(ticker: Column) -> Column:
        own = F.filter("_notes", lambda n: n["ticker"] == ticker)
        ordered = F.transform(own, lambda n: F.struct(n["position"], n["keyword"], n["context"]))
        return F.transform(F.array_sort(ordered), lambda n: n["context"])

    parts = F.flatten(F.transform("tickers", of_ticker))
    return found.withColumn("context", _context_text(parts)).drop("_notes")
