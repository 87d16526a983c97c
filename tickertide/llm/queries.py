"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickertide.llm import (
    alignment,
    ann,
    bpe,
    chat,
    lm,
    mixing,
    near_vectors,
    ngram_join,
    quality,
    repair,
    token_files,
    toxicity,
    url_filter,
)
from tickertide.llm.common import held_out, table
from tickertide.session import scratch_path

PROBE = "\\### Assistant: </turn> ok"
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], given.schema)
    return chat.chat_digests(chat.format_chats(given.union(probe)))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_verdicts(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    score = quality.quality_score(model)
    return docs.select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), score("text").alias("score")
    ).withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_texts(docs, vocabulary_path(), digests=True)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_join(table(spark, sf_dir, "documents"))
    rows = found.select("*", F.explode(F.sequence(F.lit(1), F.col("n_same"))).alias("copy"))
    stays = F.col("kept") & ((F.col("copy") == 1) | (F.col("n_links") == 0))
    return rows.select("doc_id", "class_id", "n_links", stays.alias("kept"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    score = toxicity.toxicity_score(grammar)
    return docs.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), score("text").alias("score")
    ).withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    docs = table(spark, sf_dir, "documents")
    token_files.write_token_files(docs, path, public_path("byte_bpe_50k.json"), end_id=2)
    return token_files.token_digests(spark, path)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    damaged = repair.damaged_turns(given)
    return repair.repair_report(damaged, given.select("conv_id").distinct())


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = alignment.align_texts(docs, public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))
    return alignment.alignment_report(aligned)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_url_filters": op2_url_filters,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_source_mix": op4_source_mix,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_toxicity": op8_toxicity,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_nearest_vectors": op10_nearest_vectors,
    "op11_token_files": op11_token_files,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE: dict[str, str] = {
    "op1_chat_formatting": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), marked AS (
            SELECT *,
                replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS body,
                CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: '
                    WHEN 'assistant' THEN '### Assistant: ' ELSE '### Other ' || replace(replace(replace(replace(
                        role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') || ': ' END AS header,
                lag(role) OVER w AS before,
                lead(role) OVER w IS NULL AS last
            FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
                AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(header) + length(body) + length('</turn>' || chr(10))) AS BIGINT) AS formatted_chars,
            coalesce(bool_and(CASE role WHEN 'system' THEN before IS NULL
                WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                WHEN 'assistant' THEN coalesce(before, '') = 'user' ELSE false END), true)
                AND bool_or(last AND role = 'assistant') AS valid
        FROM marked GROUP BY conv_id
    """,
    "op2_url_filters": r"""
        WITH parts AS (
            SELECT page_id,
                translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
            FROM pages
        ), rules(h, p, v) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
        ), judged AS (
            SELECT page_id, host, path,
                (SELECT max(lpad(CAST(length(h || p) AS VARCHAR), 6, '0') || h || p || '>' || v) FROM rules
                 WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best
            FROM parts
        )
        SELECT page_id, host, path, split_part(substr(best, 7), '>', 1) AS rule,
            coalesce(split_part(best, '>', 2), 'allow') AS verdict
        FROM judged
    """,
}
