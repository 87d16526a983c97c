"""Streams over landed files give the batch result."""

import time

from pyspark.sql import functions as F

from tickertide import session
from tickertide.operators.matching import match_tickers
from tickertide.schemas import AI_TERMS, LEXICON, RAW_COLUMNS
from tickertide.sources.writers import read_score_table
from tickertide.streaming import ingest


def rows(*names):
    return [("s", f"2026-01-0{i + 1}T00:00:00Z", n, "2026-01-01T00:00:00Z", "r", f"u-{n}") for i, n in enumerate(names)]


def land(spark, path, *names):
    schema = ", ".join(f"{c} string" for c in RAW_COLUMNS)
    spark.createDataFrame(rows(*names), schema).write.mode("append").parquet(path)


def test_ingest_keeps_each_headline_once_over_runs(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    for names in (("alpha", "beta", "alpha"), ("beta", "gamma")):
        land(spark, src, *names)
        ingest.stream_ingest_headlines(spark, src, out, mark).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r.headline for r in got.collect()) == ["alpha", "beta", "gamma"]


def test_ingest_stops_repeats_further_apart_than_the_delay(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    for names in (("alpha", "beta"), ("gamma",), ("alpha", "beta", "delta")):
        land(spark, src, *names)
        ingest.stream_ingest_headlines(spark, src, out, mark, delay="0 seconds").awaitTermination()
        time.sleep(1)
    got = spark.read.parquet(out)
    # rows() dates by place, so "alpha" of the last run has the same key with another time
    assert sorted(r.headline for r in got.collect()) == ["alpha", "beta", "delta", "gamma"]


def test_stream_upsert_equals_batch(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    lex = spark.createDataFrame([("A", "alpha", "identity"), ("B", "beta", "partners")], LEXICON)
    ai = spark.createDataFrame([("ai", "ai_buzz_phrases")], AI_TERMS)
    for names in (("alpha ai", "alpha beta ai", "beta"), ("alpha ai", "beta ai")):
        land(spark, src, *names)
        stream = ingest.read_stream(spark, src)
        ingest.stream_match_upsert(stream, lex, ai, out, mark).awaitTermination()
    stored = read_score_table(spark, out)
    got = sorted((r.headline, r.ticker, r.is_proxy_partnership) for r in stored.collect())
    batch = match_tickers(spark.read.parquet(src), lex, ai, ai_only=True)
    want = {(r.headline, r.ticker, int(r.is_proxy_partnership)) for r in batch.collect()}
    assert got == sorted(want)


def test_upsert_deals_one_file_over_tasks_and_reads_keywords_once(spark, tmp_path, monkeypatch):
    """A landed file may be one row group: its texts are matched by several tasks, with tables sent once."""
    src, mark = str(tmp_path / "src"), str(tmp_path / "mark")
    lex = spark.createDataFrame([("A", "alpha", "identity")], LEXICON)
    ai = spark.createDataFrame([("ai", "ai_buzz_phrases")], AI_TERMS)
    words = "concat_ws(' ', 'alpha ai', id, transform(sequence(1, 60), x -> sha2(concat(id, '-', x), 256)))"
    for k in range(2):
        rows = spark.range(3000 * k, 3000 * (k + 1), numPartitions=1)
        rows = rows.selectExpr(*(f"{words if c == 'headline' else repr('x')} as {c}" for c in RAW_COLUMNS))
        rows.write.mode("append").parquet(src)
    made, batches = [], []
    matcher = ingest.ticker_matcher
    monkeypatch.setattr(ingest, "ticker_matcher", lambda *a, **b: made.append(1) or matcher(*a, **b))

    def seen(session, table, batch):
        at = batch.groupBy(F.spark_partition_id().alias("at")).count().collect()
        batches.append([r["count"] for r in at])

    monkeypatch.setattr(ingest, "insert_or_ignore", seen)
    stream = ingest.read_stream(spark, src, maxFilesPerTrigger="1")
    ingest.stream_match_upsert(stream, lex, ai, "", mark).awaitTermination()
    assert len(made) == 1
    assert [sum(b) for b in batches] == [3000, 3000] and all(len(b) > 1 and max(b) < 2000 for b in batches)


def test_upsert_leaves_no_files_of_its_batches_behind(spark, tmp_path, monkeypatch):
    """Rows written aside and shuffled go with their batch; the caller's session keeps its settings."""
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path / "shared"))
    lex = spark.createDataFrame([("A", "alpha", "identity")], LEXICON)
    ai = spark.createDataFrame([("ai", "ai_buzz_phrases")], AI_TERMS)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    for names in (("alpha ai", "beta"), ("alpha ai", "alpha ai too")):
        land(spark, src, *names)
        stream = ingest.read_stream(spark, src, maxFilesPerTrigger="1")
        ingest.stream_match_upsert(stream, lex, ai, out, mark).awaitTermination()
    assert sorted(r.headline for r in read_score_table(spark, out).collect()) == ["alpha ai", "alpha ai too"]
    assert (tmp_path / "shared").exists() and list((tmp_path / "shared").iterdir()) == []
    assert spark.conf.get(name, None) == before
