"""Keyword configuration: YAML files to the tables lexicon, ai_terms and contexts."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession

from tickertide.schemas import AI_TERMS, CONTEXTS, ECOSYSTEM_ROLES, LEXICON

try:
    import yaml
except ImportError:  # the loader then needs parsed mappings
    yaml = None


class MatchingTables(NamedTuple):
    lexicon: DataFrame
    ai_terms: DataFrame
    contexts: DataFrame


class Part(NamedTuple):
    """Where keywords of one role stand in a company file, and under which fields of an entry."""

    path: tuple[str, ...]
    role: str
    aliases: tuple[str, ...] | None = None  # None: plain texts, no named entries


PARTS = [
    *[Part(("identity", field), "identity") for field in ("company_name", "aliases", "key_people")],
    Part(("subsidiaries",), "subsidiaries", ("aliases",)),
    Part(("products",), "products", ("aliases",)),
    *[Part(("ecosystem", role), role, ("aliases", "keywords")) for role in ECOSYSTEM_ROLES],
]
# Roles whose entries carry notes; a later one overrides an earlier one for the same keyword.
NOTED_ROLES = ("products", "subsidiaries")


def _texts(value: Any) -> list[str]:
    """All non-blank strings of a scalar, a list, or the named parts of a mapping.

    A part that is itself a mapping gives its aliases or keywords, or else its name.
    """
    found, waiting = [], [value]
    while waiting:
        item = waiting.pop(0)
        if isinstance(item, str):
            found.append(item.strip())
        elif isinstance(item, list):
            waiting[:0] = item
        elif isinstance(item, dict):
            waiting[:0] = [
                next((part[k] for k in ("aliases", "keywords") if k in part), str(part["name"]) if "name" in part else None)
                if isinstance(part, dict)
                else part
                for part in item.values()
            ]
    return [text for text in found if text]


def _entries(data: dict, part: Part) -> Iterator[tuple[list[str], str]]:
    """(keywords, note) of every entry of one part; ``_`` in a mapping's names reads as a blank."""
    node: Any = data
    for key in part.path:
        node = node.get(key) if isinstance(node, dict) else None
    if part.aliases is None:
        yield _texts(node), ""
        return
    if isinstance(node, dict):
        named = [(str(name).replace("_", " "), fields) for name, fields in node.items()]
    else:
        named = [(str(fields.get("name", "")), fields) for fields in node or [] if isinstance(fields, dict)]
    for name, fields in named:
        fields = fields if isinstance(fields, dict) else {}
        other = next((fields[key] for key in part.aliases if key in fields), None)
        note = fields.get("context") or fields.get("catalyst") or ""
        yield [kw for kw in (name.strip(), *_texts(other)) if kw], str(note).strip()


def _ticker(data: dict) -> str:
    return str((data.get("metadata") or {}).get("target_ticker") or "").upper()


def relationship_rows(data: dict) -> tuple[list[tuple], list[tuple]]:
    """One company file to lexicon rows and context rows; a file without ticker has none."""
    ticker = _ticker(data)
    if not ticker:
        return [], []
    walked = [(part.role, kws, note) for part in PARTS for kws, note in _entries(data, part)]
    lexicon = dict.fromkeys((ticker, kw, role) for role, kws, _ in walked for kw in kws)
    notes: dict[str, str] = {}
    for noted in NOTED_ROLES:
        for role, kws, note in walked:
            if role == noted and note:
                notes |= dict.fromkeys(kws, note)
    return list(lexicon), [(ticker, kw, note, i) for i, (kw, note) in enumerate(notes.items())]


def tables_from_mappings(
    spark: SparkSession, entities: dict, relationships: list[dict]
) -> MatchingTables:
    """Parsed files to tables; of several files for one ticker the last one counts."""
    by_ticker = {_ticker(data or {}): relationship_rows(data or {}) for data in relationships}
    lexicon = [row for words, _ in by_ticker.values() for row in words]
    contexts = [row for _, notes in by_ticker.values() for row in notes]
    terms = [
        (term, kind)
        for kind in ("ai_buzz_phrases", "ai_buzz_entities")
        for term in _texts((entities or {}).get(kind))
    ]
    return MatchingTables(
        spark.createDataFrame(lexicon, LEXICON),
        spark.createDataFrame(terms, AI_TERMS),
        spark.createDataFrame(contexts, CONTEXTS),
    )


def load_lexicon(
    spark: SparkSession, entities_yaml: str | Path, relationship_dir: str | Path
) -> MatchingTables:
    """Read the global term file and every company file of a folder, in name order.

    Configuration is written by hand and read once on the driver; what grows with the data
    is matched against it in the tasks.
    """
    if yaml is None:
        raise ImportError("PyYAML is needed to read YAML files; use tables_from_mappings instead")

    def read(path: Path) -> dict:
        return yaml.safe_load(path.read_text(encoding="utf-8")) or {}

    files = sorted(Path(relationship_dir).glob("*.yaml"))
    return tables_from_mappings(spark, read(Path(entities_yaml)), [read(p) for p in files])
