"""Dedupe, joins, windows and statistics against pandas."""

import os
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickertide.operators import daily, dedup, joins, matching, returns, scoring, stats
from tickertide.plans.study import return_study
from tickertide.schemas import AI_TERMS, LEXICON
from tickertide.session import cut_lineage
from tickertide.sources.keyed import insert_new, read_keyed


def to_spark(spark, frame, schema):
    rows = frame.astype(object).where(frame.notna(), None).values.tolist()
    return spark.createDataFrame(rows, schema)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_keep_dedup_is_idempotent_and_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([("k", i) for i in range(50, 0, -1)] + [("j", 3)], "k string, o int")
    once = dedup.first_keep_dedup(df, ["k"], "o")
    assert sorted(tuple(r) for r in once.collect()) == [("j", 3), ("k", 1)]
    assert sorted(tuple(r) for r in dedup.first_keep_dedup(once, ["k"], "o").collect()) == [("j", 3), ("k", 1)]
    plan = plan_of(once)
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_distinct_ordered_and_union_order(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "v string, n int")
    both = dedup.union_all([a, a.select("v", (F.col("n") - 5).alias("n"))], "n")
    assert [r.v for r in dedup.distinct_ordered(both, "v", "ord").collect()] == ["x", "y"]


@pytest.mark.parametrize("bucket_days, unique", [(1, True), (7, True), (32, True), (32, False)])
def test_asof_forward_equals_merge_asof(spark, bucket_days, unique):
    rng = np.random.default_rng(3)
    days = pd.date_range("2025-12-01", periods=120)
    left = pd.DataFrame({"ticker": rng.choice(list("abcz"), 300), "date": rng.choice(days, 300)})
    left["id"] = range(300)
    right = pd.DataFrame(
        [(t, d) for t in "abcy" for d in days[10:90] if rng.random() < 0.2], columns=["ticker", "trade_date"]
    )
    right["px"] = rng.random(len(right))
    want = pd.merge_asof(
        left.sort_values("date"), right.sort_values("trade_date"),
        by="ticker", left_on="date", right_on="trade_date", direction="forward",
    ).set_index("id").sort_index()
    ls = spark.createDataFrame(left.assign(date=left.date.dt.date)[["ticker", "date", "id"]], "ticker string, date date, id int")
    rs = spark.createDataFrame(right.assign(trade_date=right.trade_date.dt.date), "ticker string, trade_date date, px double")
    got = joins.asof_forward(ls, rs, bucket_days=bucket_days, unique_left=unique).toPandas().set_index("id").sort_index()
    assert len(got) == 300
    np.testing.assert_allclose(got.px.to_numpy(float), want.px.to_numpy(float))
    empty = joins.asof_forward(ls, rs.limit(0), bucket_days=bucket_days, unique_left=unique)
    assert empty.where("px is null").count() == 300


def test_asof_forward_keeps_rows_without_key_or_date(spark):
    left = spark.sql("select * from values ('a', date'2026-01-01'), (null, date'2026-01-01'), ('a', null) t(ticker, date)")
    right = spark.sql("select 'a' ticker, date'2026-01-05' trade_date, 1.0D px union all select null, date'2026-01-05', 2.0D")
    for unique in (True, False):
        rows = joins.asof_forward(left, right, unique_left=unique).collect()
        assert sorted(((r.ticker, str(r.date), r.px) for r in rows), key=str) == [
            ("a", "2026-01-01", 1.0), ("a", "None", None), (None, "2026-01-01", None),
        ]


def test_anti_join_new_rows(spark):
    batch = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    table = spark.createDataFrame([("b", 9), ("c", 9)], "k string, w int")
    assert [tuple(r) for r in joins.anti_join_new_rows(batch, table, ["k"]).collect()] == [("a", 1)]


def price_frame():
    rng = np.random.default_rng(5)
    days = pd.bdate_range("2026-01-01", periods=30)
    frame = pd.DataFrame([(t, d, 50 + 50 * rng.random()) for t in "ab" for d in days], columns=["ticker", "trade_date", "close"])
    return frame.drop([4, 40]).reset_index(drop=True)


def test_returns_equal_pandas(spark):
    px = price_frame()
    by = px.groupby("ticker").close
    want = pd.DataFrame({"ret_eod": px.close / by.shift(1) - 1, **{f"ret_{h}d": by.shift(-h) / px.close - 1 for h in (1, 3, 5, 7)}})
    df = spark.createDataFrame(px.assign(trade_date=px.trade_date.dt.date), "ticker string, trade_date date, close double")
    got = returns.with_returns(df).toPandas().sort_values(["ticker", "trade_date"])
    for col in want:
        np.testing.assert_allclose(got[col].to_numpy(float), want[col].to_numpy(float), rtol=1e-12)


def test_ffill(spark):
    rows = [("a", 1, 1.0), ("a", 2, None), ("a", 3, 3.0), ("b", 1, None), ("b", 2, 5.0)]
    df = daily.ffill_by_ticker(spark.createDataFrame(rows, "ticker string, date int, x double"), ["x"])
    assert [r.x for r in df.orderBy("ticker", "date").collect()] == [1.0, 1.0, 3.0, None, 5.0]


def test_corr_matrix_equals_pandas(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame(rng.random((60, 3)), columns=list("xyz"))
    frame["z"] = frame.z.where(rng.random(60) > 0.4)
    frame["k"] = 2.0
    want = frame.corr()
    df = to_spark(spark, frame, "x double, y double, z double, k double")
    got = {(r.x, r.y): r.r for r in stats.corr_matrix(df, list("xyzk")).collect()}
    assert len(got) == 16
    for (x, y), r in got.items():
        if np.isnan(want.loc[x, y]):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[x, y])


def test_corr_by_ticker_lists_absent_tickers(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0)], "ticker string, s double, ret_1d double")
    got = {r.ticker: r.r for r in stats.corr_by_ticker(df, ["s"], ["ret_1d"], ["a", "b", "zz"]).collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] is None and got["zz"] is None


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 51, 1000, 6000])
def test_buckets_equal_qcut(spark, n, small, monkeypatch):
    if not small:
        # Never read before all 64 bits are found.
        monkeypatch.setattr(stats, "SPAN_ROWS", 0)
    rng = np.random.default_rng(n)
    for values in (rng.normal(size=n), np.round(rng.normal(size=n), 1), np.where(rng.random(n) < 0.4, 0.0, rng.random(n))):
        edges = np.quantile(values, [0.2, 0.4, 0.6, 0.8])
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(-1, None), (-2, float("nan"))], "i int, x double")
        np.testing.assert_allclose(stats.quantile_edges(df, "x"), edges, rtol=1e-12, atol=1e-15)
        got = stats.bucketed(df, "x").toPandas().sort_values("i")
        assert len(got) == n
        if len(set(edges)) == 4 and min(values) < edges[0] and n > 4:
            want = pd.qcut(pd.Series(values), 5, labels=False) + 1
            assert got.quintile.tolist() == want.tolist()


def test_quantiles_of_constant_and_skewed_columns(spark):
    def edges(values):
        return stats.quantile_edges(spark.createDataFrame([(v,) for v in values], "x double"), "x")

    assert edges([7.5] * 9000) == [7.5] * 4
    assert edges([-0.0, 0.0] * 50) == [0.0] * 4
    assert edges([float("-inf")] * 5000 + [-5e-324] * 5000 + [1e308] * 5000) == [float("-inf"), -5e-324, -5e-324, 1e308]
    assert edges([]) == []
    rng = np.random.default_rng(3)
    skewed = [1.0] * 7000 + np.exp(rng.normal(size=9000) * 5).tolist() + [float("inf")] * 10
    np.testing.assert_allclose(edges(skewed), np.quantile(skewed, [0.2, 0.4, 0.6, 0.8]), rtol=1e-12)


def test_batch_models_see_lists_and_fall_back_to_rows(spark):
    def load():
        def score(headlines, contexts):
            if "bad" in headlines:
                raise ValueError("bad")
            return [len(h) / 10 for h in headlines]

        return score

    rows = spark.createDataFrame([("bad",), ("ab",), ("abc",)], "headline string").coalesce(1)
    got = scoring.score_backends(rows, {"phi3": scoring.model_scorer(load, batch=True)})
    assert {r.headline: r.sentiment_llm_phi3 for r in got.collect()} == {"bad": None, "ab": 0.2, "abc": 0.3}
    answer = scoring.prompt_scorer(lambda: lambda prompts: ["0.5"] * len(prompts), batch=True)
    got = scoring.score_backends(spark.createDataFrame([("x",), (" ",)], "headline string"), {"phi3": answer})
    assert {r.headline: r.sentiment_llm_phi3 for r in got.collect()} == {"x": 0.5, " ": None}


def test_lexicon_scorer_searches_once(spark):
    score = scoring.lexicon_scorer(["hot", "very good"], ["bad", "Worse"])
    rows = spark.createDataFrame([("Hot and very good, bad",), ("worse bad",), ("none",), (None,)], "h string")
    got = rows.select("h", score(F.col("h"), F.lit(None)).alias("s"))
    assert {r.h: r.s for r in got.collect()} == {"Hot and very good, bad": 0.25, "worse bad": -0.5, "none": 0.0, None: None}
    assert got._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == 1


def test_strict_buckets_raise_on_ties(spark):
    df = spark.createDataFrame([(0.0,)] * 8 + [(1.0,), (2.0,)], "x double")
    with pytest.raises(ValueError):
        stats.bucketed(df, "x", strict=True)
    assert stats.bucketed(df, "x").count() == 10


def test_hit_rates_count_missing_as_miss(spark):
    df = spark.createDataFrame([("a", 0.2, 0.1), ("a", 0.2, None), ("b", -0.1, -0.3)], "ticker string, s double, ret_1d double")
    assert stats.hit_rate_overall(df, "s", ["ret_1d"]).first().hit_rate == pytest.approx(2 / 3)
    got = {r.ticker: r.hit_rate for r in stats.hit_rate_by_ticker(df, ["s"], ["ret_1d"], ["a", "b", "c"]).collect()}
    assert got == {"a": 0.5, "b": 1.0, "c": None}


def test_scorers_see_each_headline_once_and_survive_failures(spark):
    counter = spark.sparkContext.accumulator(0)

    def load():
        def score(headline, context):
            counter.add(1)
            if headline == "bad":
                raise RuntimeError("no answer")
            return 7.0

        return score

    rows = spark.createDataFrame([("x", 1), ("x", 2), ("bad", 3), ("y", 4)], "headline string, i int")
    backends = {"phi3": scoring.model_scorer(load), "nobody": scoring.model_scorer(load)}
    scored = scoring.score_unique_join(rows, backends)
    assert scored.columns == ["headline", "i", "sentiment_llm_phi3"]
    got = {r.i: r.sentiment_llm_phi3 for r in scored.collect()}
    assert got == {1: 1.0, 2: 1.0, 3: None, 4: 1.0}
    assert counter.value == 3


def test_context_reaches_the_prompt(spark):
    rows = spark.createDataFrame([("GB200 ships", "N"), ("GB200 ships", " "), ("other", "N")], "headline string, ticker string")
    notes = spark.createDataFrame([("N", "B200", "big", 0)], "ticker string, keyword string, context string, position int")
    scorer = scoring.prompt_scorer(lambda: lambda prompt: "0.5" if "Context: This news relates to big." in prompt else "0.1")
    got = scoring.score_unique_join(rows, {"phi3": scorer}, notes, partitions=2).collect()
    assert sorted((r.headline, r.ticker, r.sentiment_llm_phi3) for r in got) == [
        ("GB200 ships", " ", 0.5), ("GB200 ships", "N", 0.5), ("other", "N", 0.1),
    ]


SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
}


def scored_rows(spark, rows):
    return scoring.score_unique_join(rows, {"phi3": scoring.lexicon_scorer(["hot"], [])})


def matched_rows(spark, rows):
    lex = spark.createDataFrame([("A", "hot", "identity"), ("A", "cold", "identity")], LEXICON)
    ai = spark.createDataFrame([("ai", "ai_buzz_phrases")], AI_TERMS)
    return matching.match_tickers(rows, lex, ai, strategy="token")


@pytest.mark.parametrize("job", [scored_rows, matched_rows])
def test_hot_headline_is_split_in_the_join(spark, job):
    """One headline with nearly all rows: the adaptive join splits its partition."""
    for key, value in SKEW_CONF.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(0, 60000, 1, 8).selectExpr(
            "if(id % 50 <> 0, 'hot', concat('cold ', id)) as headline", "sha2(string(id), 256) as payload"
        )
        qe = job(spark, rows)._jdf.queryExecution()
        assert qe.toRdd().count() == 60000
        assert "skew=true" in qe.executedPlan().toString()
    finally:
        for key in SKEW_CONF:
            spark.conf.unset(key)


def test_return_study_tables(spark):
    px = price_frame()
    prices = spark.createDataFrame(px.assign(trade_date=px.trade_date.dt.date), "ticker string, trade_date date, close double")
    rng = np.random.default_rng(2)
    rows = [
        (t, f"{d:%Y-%m-%d}T10:00:00Z", f"h{i}", *map(float, rng.normal(size=4)))
        for t in "ab" for i, d in enumerate(pd.date_range("2026-01-05", periods=20))
    ]
    names = "ticker string, posted_at string, headline string, sentiment_finbert double, sentiment_llm_phi3 double, sentiment_llm_llama3_2 double, sentiment_llm_deepseek_r1 double"
    tables = return_study(spark.createDataFrame(rows, names), prices, ["a", "b", "c"])
    sizes = {name: df.count() for name, df in tables.items() if name in ("daily", "aligned", "daily_q", "corr_matrix", "corr_by_ticker", "hit_rate_by_ticker")}
    assert sizes == {"daily": 40, "aligned": 40, "daily_q": 40, "corr_matrix": 81, "corr_by_ticker": 60, "hit_rate_by_ticker": 60}
    assert tables["quintile_excess_finbert_avg"].count() == 5
    assert tables["daily_q"].where("dayofweek(date) in (1, 7) and ret_1d is not null").count() == 0
    assert tables["aligned"].where("dayofweek(trade_date) in (1, 7)").count() == 0


def test_cut_lineage_reads_written_rows(spark):
    df = cut_lineage(spark.range(5), "t")
    assert df.count() == 5 and "Scan parquet" in plan_of(df)


def test_a_hanging_model_gives_null_within_the_deadline(spark):
    def load():
        def score(headline, context):
            if headline == "hangs":
                time.sleep(600)
            if headline == "fails":
                raise ValueError(headline)
            return len(headline) / 10

        return score

    rows = spark.createDataFrame([("hangs",), ("fails",), ("abc",)], "headline string").coalesce(1)
    start = time.monotonic()
    scorer = scoring.model_scorer(load, deadline=0.5, pause=0.2)
    got = scoring.score_backends(rows, {"phi3": scorer}).collect()
    assert {r.headline: r.sentiment_llm_phi3 for r in got} == {"hangs": None, "fails": None, "abc": 0.3}
    assert 0.7 < time.monotonic() - start < 60


def test_answers_are_stored_and_asked_once(spark, tmp_path, monkeypatch):
    log = tmp_path / "asked"
    log.mkdir()

    def load():
        def score(headline, context):
            with open(log / str(os.getpid()), "a") as f:
                f.write(f"{headline}/{context}\n")
            return None if headline == "unread" else len(headline) / 100

        return score

    def asked():
        return sorted(line for p in log.iterdir() for line in p.read_text().splitlines())

    texts = [(f"headline {k % 40}", "note" if k % 2 else None) for k in range(80)]
    rows = spark.createDataFrame([*texts, ("unread", None), ("", None), (None, None)], "headline string, context string")
    backends = {"phi3": scoring.model_scorer(load)}
    store = str(tmp_path / "answers")
    inserts = []

    def dies_at_the_third(*args):
        inserts.append(args)
        if len(inserts) == 3:
            raise RuntimeError("lost")
        return insert_new(*args)

    monkeypatch.setattr(scoring, "insert_new", dies_at_the_third)
    with pytest.raises(RuntimeError):
        scoring.score_backends(rows, backends, store=store, slices=4)
    first, kept = asked(), read_keyed(spark, store, scoring.ANSWERS).count()
    # Two slices are stored, the third was asked when the run died.
    assert 0 < kept < len(first) < 43
    # The rest only; rows that share a text share its answer, null and empty texts differ.
    monkeypatch.setattr(scoring, "insert_new", insert_new)
    got = scoring.score_backends(rows, backends, store=store, slices=4).collect()
    times = Counter(asked())
    assert len(got) == 83 and len(times) == 43 and max(times.values()) == 2
    assert sum(n == 2 for n in times.values()) <= len(first) - kept
    scores = {(r.headline, r.context): r.sentiment_llm_phi3 for r in got}
    assert scores["headline 7", "note"] == 0.1 and scores["unread", None] is None and scores["", None] == 0.0
    # Nothing is left to ask but what failed.
    scoring.score_backends(rows, backends, store=store, slices=4).collect()
    assert set((Counter(asked()) - times).elements()) == {"unread/None", "None/None"}
    more = scoring.score_unique_join(rows.select("headline"), backends, store=store)
    assert more.where("headline = 'headline 8'").first().sentiment_llm_phi3 == 0.1
