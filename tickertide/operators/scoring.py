"""Pluggable scorers, each unique headline scored once, scores copied back to all rows."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickertide.functions.scores import clamp, no_nan, parse_score, prob_score
from tickertide.functions.text import (
    build_prompt,
    is_blank,
    keywords_present,
    let,
    literal_array,
    normalize_headline,
    strip,
)
from tickertide.operators.matching import headline_context
from tickertide.session import cut_lineage
from tickertide.sources.keyed import insert_new, read_keyed

# Backend id to output column (fixed values).
BACKENDS = {
    "finbert": "sentiment_finbert",
    "phi3": "sentiment_llm_phi3",
    "llama3.2:3b": "sentiment_llm_llama3_2",
    "deepseek-r1:1.5b": "sentiment_llm_deepseek_r1",
}

# A scorer maps the headline and its context note to a score column.
Scorer = Callable[[Column, Column], Column]


# Stored answers: one row for each model and text (headline and context).
ANSWERS = StructType().add("model", "string").add("text_key", "string").add("score", "double")
ANSWER_KEYS = ("model", "text_key")


def bounded(load: Callable[[], Callable[..., Any]], deadline: float | None = None, pause: float = 0.0) -> Callable[[], Callable[..., Any]]:
    """``load`` for a model whose calls end within ``deadline`` seconds, ``pause`` seconds apart.

    A call that takes longer counts as failed; its thread is left behind and a later answer is
    dropped.  The pause follows every answer and holds for a task, so a server that several tasks
    share is asked by as many callers.
    """

    def load_bounded() -> Callable[..., Any]:
        call = load()

        def ask(*args: Any) -> Any:
            answer: queue.SimpleQueue = queue.SimpleQueue()

            def work() -> None:
                try:
                    answer.put((call(*args), None))
                except Exception as exc:
                    answer.put((None, exc))

            threading.Thread(target=work, daemon=True).start()
            try:
                value, failure = answer.get(timeout=deadline)
            except queue.Empty:
                raise TimeoutError(f"no answer within {deadline} seconds") from None
            if failure is not None:
                raise failure
            time.sleep(pause)
            return value

        return ask

    return load_bounded if deadline is not None or pause else load


def _safe(call: Callable[..., Any], *args: Any) -> Any:
    """One failing headline gets no score; the job goes on."""
    try:
        return call(*args)
    except Exception:
        return None


def _answers(call: Callable[..., Any], rows: list[tuple], batch: bool) -> list:
    """The model's answer for every row.

    A batch model takes one list per argument and is called once for all rows; only when
    that fails are the rows tried one by one.
    """
    if not batch:
        return [_safe(call, *row) for row in rows]
    answers = _safe(call, *[list(arg) for arg in zip(*rows)]) if rows else []
    if answers is not None and len(answers) == len(rows):
        return list(answers)
    single = [_safe(call, *[[arg] for arg in row]) for row in rows]
    return [None if a is None or len(a) != 1 else a[0] for a in single]


def model_scorer(load: Callable[[], Callable[..., Any]], batch: bool = False, **limits: float) -> Scorer:
    """Scorer around a Python model; ``load`` runs once per Python worker and task.

    The model maps a headline and its context to a number or, with ``batch``, a list of
    headlines and a list of contexts to a list of numbers.  ``limits`` are those of ``bounded``
    (``deadline``, ``pause``), for a call.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = bounded(load, **limits)()
        for headlines, contexts in batches:
            values = _answers(score, list(zip(headlines, contexts)), batch)
            yield pd.Series(values, dtype="float64")

    return lambda headline, context: clamp(no_nan(run(headline, context)))


def prompt_scorer(load: Callable[[], Callable[..., Any]], batch: bool = False, **limits: float) -> Scorer:
    """Scorer around a text model: prompt and answer are handled in the JVM.

    A blank headline gets no prompt and a null score.  With ``batch`` the model maps a list of
    prompts to a list of answers.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        complete = bounded(load, **limits)()
        for prompts in batches:
            asked = [(p,) for p in prompts if p is not None]
            answers = iter(_answers(complete, asked, batch))
            yield pd.Series([None if p is None else next(answers) for p in prompts], dtype="object")

    return lambda headline, context: parse_score(run(build_prompt(headline, context)))


def class_scorer(load: Callable[[], Callable[..., Any]], labels: list[str], batch: bool = False, **limits: float) -> Scorer:
    """Scorer around a classifier that returns logits; a blank headline scores 0.

    With ``batch`` the classifier maps a list of texts to a list of logit rows.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        logits = bounded(load, **limits)()
        for texts in batches:
            yield pd.Series(_answers(logits, [(t,) for t in texts], batch), dtype="object")

    return lambda headline, context: prob_score(run(strip(headline)), labels, headline)


def lexicon_scorer(pos_terms: list[str], neg_terms: list[str], scale: float = 4.0) -> Scorer:
    """Stand-in scorer: positive minus negative terms present, over ``scale``, clamped."""
    pos = [t.lower().strip() for t in pos_terms]
    neg = [t.lower().strip() for t in neg_terms]

    def among(hits: Column, terms: list[str]) -> Column:
        return F.size(F.array_intersect(hits, literal_array(terms))) if terms else F.lit(0)

    def score(headline: Column, context: Column) -> Column:
        # One search for both lists; the hits are named several times below.
        hits = keywords_present(normalize_headline(headline), pos + neg)
        return let(hits, lambda h: clamp((among(h, pos) - among(h, neg)).cast("double") / F.lit(scale)))

    return score


def score_backends(
    headlines: DataFrame,
    backends: dict[str, Scorer],
    registry: dict[str, str] = BACKENDS,
    partitions: int | None = None,
    store: str | None = None,
    slices: int = 16,
) -> DataFrame:
    """Score rows with columns ``headline`` and (optionally) ``context``.

    One column per requested backend; ids the registry does not know are ignored.
    ``partitions`` spreads the rows before a costly model runs: they are small in bytes,
    and adaptive coalescing would otherwise put them into a few tasks.

    ``store`` names a keyed table of answers.  A model is then asked at once, and only for texts
    without a stored answer, each once however many rows share it.  The texts go in ``slices``;
    each slice's answers are stored before the next is asked, so a run that dies asks the slice
    again at most that it was at (a lost task, its own part of it).  Failed and unreadable answers
    aren't stored: a later run asks again.
    """
    if "context" not in headlines.columns:
        headlines = headlines.withColumn("context", F.lit(None).cast("string"))
    if store is not None:
        return _score_stored(headlines, backends, registry, partitions, store, slices)
    if partitions:
        headlines = headlines.repartition(partitions, F.xxhash64("headline"))
    head, note = F.col("headline"), F.col("context")
    return headlines.withColumns(
        {column: backends[name](head, note) for name, column in registry.items() if name in backends}
    )


def _score_stored(
    headlines: DataFrame,
    backends: dict[str, Scorer],
    registry: dict[str, str],
    partitions: int | None,
    store: str,
    slices: int,
) -> DataFrame:
    spark = headlines.sparkSession
    # to_json leaves nulls out, so that null and empty texts differ.
    key = F.sha2(F.to_json(F.struct("headline", "context")), 256)
    keyed = cut_lineage(headlines.withColumn("_text_key", key), "to-score")
    texts = keyed.select(F.col("_text_key").alias("text_key"), "headline", "context").dropDuplicates(["text_key"])
    part = F.pmod(F.xxhash64("text_key", F.lit(7)), F.lit(slices))
    names = [name for name in registry if name in backends]
    for name in names:
        known = read_keyed(spark, store, ANSWERS).where(F.col("model") == name)
        todo = cut_lineage(texts.join(known, "text_key", "left_anti").withColumn("_slice", part), "unanswered")
        for k in sorted(r["_slice"] for r in todo.select("_slice").distinct().collect()):
            asked = todo.where(F.col("_slice") == k)
            if partitions:
                asked = asked.repartition(partitions, F.xxhash64("text_key"))
            score = backends[name](F.col("headline"), F.col("context"))
            answers = asked.select(F.lit(name).alias("model"), "text_key", score.cast("double").alias("score"))
            # Written first: a filter on the score would be evaluated ahead of it, by a second call.
            answers = cut_lineage(answers, "answers")
            insert_new(spark, store, answers.where("score IS NOT NULL"), ANSWER_KEYS)
    wide = (
        read_keyed(spark, store, ANSWERS)
        .where(F.col("model").isin(names))
        .groupBy(F.col("text_key").alias("_text_key"))
        .agg(*[F.max(F.when(F.col("model") == name, F.col("score"))).alias(registry[name]) for name in names])
    ) if names else None
    scored = keyed if wide is None else keyed.join(wide, "_text_key", "left")
    return scored.select(*headlines.columns, *[registry[name] for name in names])


def score_unique_join(
    df: DataFrame,
    backends: dict[str, Scorer],
    contexts: DataFrame | None = None,
    registry: dict[str, str] = BACKENDS,
    partitions: int | None = None,
    store: str | None = None,
) -> DataFrame:
    """Add a score column per backend, computed once per distinct headline.

    ``store`` keeps the models' answers for later runs, see ``score_backends``.

    Distinct headlines are reduced in every task before the shuffle.  Where one headline
    makes up much of ``df``, adaptive execution splits its partition of the join; it can do
    so only for a side that comes straight from a join shuffle.  The distinct step is
    therefore keyed by the headline and its hash, so that its result is shuffled once more.
    """
    keys = [F.col("headline"), F.xxhash64("headline").alias("_hash")]
    if contexts is None:
        unique = df.select(*keys).distinct()
    else:
        ticker = F.when(~is_blank(F.col("ticker")), strip(F.col("ticker")))
        tickers = F.array_sort(F.collect_set(ticker)).alias("tickers")
        unique = headline_context(df.groupBy(*keys).agg(tickers), contexts)
    scored = score_backends(unique, backends, registry, partitions, store)
    columns = [column for name, column in registry.items() if name in backends]
    return df.join(scored.select("headline", *columns), "headline", "left").select(
        *df.columns, *columns
    )
