"""Text columns: normalising, keyword tests, HTML snippets and prompts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickertide.functions.markup import html_text

# Character classes.  WORD is what Python's \w accepts, common letters named first for speed;
# SPACE is what str.split() splits on.
WORD = r"[a-z0-9_\p{L}\p{N}]"
SPACE = r"[\s\x1c-\x1f]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row.

    An expression named several times, above all inside a lambda, would be evaluated each
    time; as a lambda variable it is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sql_value(value: str | bool | None) -> str:
    """A text, flag or null as SQL text."""
    if value is None:
        return "string(null)"
    if isinstance(value, bool):
        return str(value).lower()
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values: list[str] | list[dict]) -> Column:
    """A small list of texts or of records as one constant column."""
    items = []
    for value in values:
        if isinstance(value, dict):
            cells = (f"'{name}', {sql_value(cell)}" for name, cell in value.items())
            items.append(f"named_struct({', '.join(cells)})")
        else:
            items.append(sql_value(value))
    return F.expr(f"array({', '.join(items)})")


def strip(col: Column) -> Column:
    """Trim any Unicode white space, not only blanks."""
    return F.regexp_replace(col, f"(?U)^{SPACE}+|{SPACE}+$", "")


def is_blank(col: Column) -> Column:
    return F.coalesce(strip(col), F.lit("")) == ""


def normalize_headline(col: Column) -> Column:
    """Lower-case, trim, and fold every white-space run to one blank."""
    return F.trim(F.regexp_replace(F.lower(col), f"(?U){SPACE}+", " "))


def normalize_url(col: Column) -> Column:
    """Trim, then drop all trailing slashes."""
    return F.regexp_replace(strip(col), "/+$", "")


def word_tokens(col: Column) -> Column:
    """Maximal runs of word characters."""
    return F.regexp_extract_all(col, F.lit(f"{WORD}+"), F.lit(0))


def word_boundary_pattern(keyword: str) -> str:
    """Regex for one lower-case keyword between word boundaries.

    Lookarounds on an explicit class instead of ``\\b``, whose Unicode meaning changes
    between Java versions.  A keyword that starts (ends) with punctuation needs a word
    character before (after) it, which is what ``\\b`` asks for.
    """
    def is_word(ch: str) -> bool:
        return ch == "_" or ch.isalnum()

    left = f"(?<!{WORD})" if is_word(keyword[0]) else f"(?<={WORD})"
    right = f"(?!{WORD})" if is_word(keyword[-1]) else f"(?={WORD})"
    quoted = "\\Q" + keyword.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return left + quoted + right


def contains_keyword(text: Column, keyword: Column | str) -> Column:
    """True if ``keyword`` occurs in the normalised ``text``.

    A keyword with a blank is a plain substring test, so "gen ai" is found in
    "oxygen air"; any other keyword must stand between word boundaries.
    """
    if isinstance(keyword, str):
        kw = keyword.lower().strip()
        if not kw:
            return F.lit(False)
        if " " in kw:
            return F.contains(text, F.lit(kw))
        return F.contains(text, F.lit(kw)) & text.rlike(word_boundary_pattern(kw))

    kw = F.lower(strip(keyword))
    quoted = F.concat(F.lit("\\Q"), F.replace(kw, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    left = F.when(kw.rlike(f"^{WORD}"), F.lit(f"(?<!{WORD})")).otherwise(F.lit(f"(?<={WORD})"))
    right = F.when(kw.rlike(f"{WORD}$"), F.lit(f"(?!{WORD})")).otherwise(F.lit(f"(?={WORD})"))
    return (
        F.when(kw == "", F.lit(False))
        .when(~F.contains(text, kw), F.lit(False))
        .when(F.contains(kw, F.lit(" ")), F.lit(True))
        .otherwise(F.rlike(text, F.concat(left, quoted, right)))
    )


def keywords_present(text: Column, keywords: list[str]) -> Column:
    """The distinct ``keywords`` (already lower-case) found in the normalised ``text``.

    One pass per text, all inside the JVM: words by a hash-set intersection with the
    text's tokens, phrases by substring search, and words with inner punctuation by a
    boundary pattern that only runs where the plain substring is present.
    """
    words, phrases, punctuated = [], [], []
    for kw in sorted(set(keywords)):
        if not kw:
            continue
        if " " in kw:
            phrases.append(kw)
        elif re.fullmatch(r"\w+", kw):
            words.append(kw)
        else:
            punctuated.append(kw)

    def found(t: Column) -> Column:
        parts = []
        if words:
            parts.append(F.array_intersect(word_tokens(t), literal_array(words)))
        if phrases:
            table = literal_array(phrases)
            parts.append(F.filter(table, lambda k: F.contains(t, k)))
        if punctuated:
            checks = [F.when(contains_keyword(t, k), F.lit(k)) for k in punctuated]
            parts.append(F.array_compact(F.array(*checks)))
        return F.concat(*parts) if parts else F.array().cast("array<string>")

    return let(text, found)


def strip_html_snippet(col: Column, n: int | None = 500) -> Column:
    """Feed summary as plain text, cut to ``n`` characters (``None``: uncut).

    Markup and character references are only interpreted where the summary holds a ``<``; only
    such summaries go through the tokenizer (``functions/markup.py``).
    """
    marked = F.contains(col, F.lit("<"))
    text = strip(F.when(marked, html_text(F.when(marked, col))).otherwise(col))
    return text if n is None else F.substring(text, 1, n)


# Prompt sent to a scoring model (fixed value: scores depend on the exact wording).
PROMPT_HEAD = """### SYSTEM PROMPT ###
You are a Senior Equity Research Analyst specializing in the AI Sector.
Your task is to analyze the sentiment of a financial headline on a scale of [-1.0, 1.0].

SCORING CRITERIA:
- [-1.0 to -0.6]: Critical negative impact (e.g., massive fine, model failure, key partner loss).
- [-0.5 to -0.1]: Minor headwinds (e.g., supply chain delays, increased competition).
- [0.0]: Neutral/Routine corporate news.
- [0.1 to 0.5]: Incremental positives (e.g., routine software update, minor partnership).
- [0.6 to 1.0]: Major breakthroughs (e.g., AGI milestone, huge CapEx expansion, new chip lead).

### EXAMPLES ###
Headline: "FTC launches antitrust investigation into Microsoft's OpenAI partnership."
Score: -0.8

Headline: "Nvidia announces new Blackwell shipment delays due to server rack overheating."
Score: -0.5

Headline: "Apple integrates OpenAI's ChatGPT into iOS 18 with local processing."
Score: 0.7

Headline: "Meta releases Llama 4 with 10x efficiency gains over previous generation."
Score: 0.9

### TASK ###
"""
PROMPT_TAIL = """
Score:

Response must be a single float value only. No prose."""


def build_prompt(headline: Column, context: Column | None = None) -> Column:
    """Prompt for one headline; null for a blank headline."""
    block = F.lit("")
    if context is not None:
        block = F.when(is_blank(context), F.lit("")).otherwise(
            F.concat(F.lit("Context: "), context, F.lit("\n\n"))
        )
    prompt = F.concat(
        F.lit(PROMPT_HEAD), block, F.lit('Headline: "'), strip(headline), F.lit('"'), F.lit(PROMPT_TAIL)
    )
    return F.when(~is_blank(headline), prompt)
