"""Base rows to scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickertide.operators.scoring import Scorer, score_unique_join
from tickertide.session import cut_lineage
from tickertide.sources.lexicon import MatchingTables
from tickertide.sources.writers import write_jsonl


def process(
    base: DataFrame,
    backends: dict[str, Scorer],
    tables: MatchingTables | None = None,
    partitions: int | None = None,
    store: str | None = None,
) -> DataFrame:
    """Add the score columns; context notes reach the scorers where ``tables`` is given.

    ``base`` is written to the shared folder first: scoring reads it twice, and the search of
    the texts behind it must not run twice.  ``store`` is the keyed table of the models' answers.
    """
    base = cut_lineage(base, "base")
    contexts = tables.contexts if tables is not None else None
    return score_unique_join(base, backends, contexts, partitions=partitions, store=store)


def run_process(
    base: DataFrame,
    backends: dict[str, Scorer],
    out_path: str,
    tables: MatchingTables | None = None,
    partitions: int | None = None,
    store: str | None = None,
) -> None:
    write_jsonl(process(base, backends, tables, partitions, store), out_path)
