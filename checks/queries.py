"""Registered Spark queries, by operator name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import bindings as b
from tickertide.functions import dates, scores, text
from tickertide.operators import daily as dly
from tickertide.operators import dedup, joins, matching, returns, scoring, stats
from tickertide.plans.base_data import base_data, base_data_counts
from tickertide.plans.process import process
from tickertide.schemas import (
    AVERAGE_COLUMNS,
    DELTA_COLUMNS,
    RAW_COLUMNS,
    RETURN_COLUMNS,
    SENTIMENT_COLUMNS,
)
from tickertide.session import cut_lineage, scratch_path
from tickertide.sources import feeds, headlines, lexicon, prices, writers
from tickertide.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TICKERS = ["click", "view", "purchase", "absent"]
NOW = "2026-03-01T00:00:00Z"
ENTITIES = {"ai_buzz_phrases": ["ch e", "thor"], "ai_buzz_entities": ["avec", "By-NC"]}
RELATIONSHIPS = [
    {
        "metadata": {"target_ticker": "a"},
        "identity": {"company_name": "the"},
        "ecosystem": {"partners": [{"name": "of the"}], "competitors": {"der": {}}},
    },
    {
        "metadata": {"target_ticker": "b"},
        "identity": {"aliases": ["de la"]},
        "ecosystem": {"partners": [{"name": "x_y", "keywords": ["und"]}], "suppliers": {"in_the": {}}},
    },
    {"identity": {"company_name": "no ticker"}},
]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Six decimals, and no negative zero."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


def _tables(spark: SparkSession) -> lexicon.MatchingTables:
    return lexicon.MatchingTables(b.lexicon(spark), b.ai_terms(spark), b.contexts(spark))


def _lexicon_scorer() -> scoring.Scorer:
    return scoring.lexicon_scorer(b.POSITIVE, b.NEGATIVE)


def _matched(spark: SparkSession, d: str, **kw) -> DataFrame:
    return matching.match_tickers(b.raw_headlines(spark, d), b.lexicon(spark), b.ai_terms(spark), **kw)


def _flags(df: DataFrame) -> DataFrame:
    return df.select("ord", "ticker", "is_ai_related", "is_proxy_partnership")


# --- sources, sinks, maintenance -----------------------------------------------------------


def _landed(spark: SparkSession, d: str, kind: str, suffix: str = "") -> str:
    """documents as landed headline files in a new folder."""
    path = scratch_path(spark, "headlines") + suffix
    rows = b.raw_headlines(spark, d).select(*RAW_COLUMNS)
    if kind == "csv":
        rows.write.options(**writers.CSV_WRITE).csv(path)
    else:
        writers.write_jsonl(rows, path)
    return path


@query
def read_headlines_csv(spark, d):
    return headlines.read_headlines_csv(spark, _landed(spark, d, "csv"))


@query
def read_headlines_jsonl(spark, d):
    return headlines.read_headlines_jsonl(spark, _landed(spark, d, "jsonl"))


@query
def union_headline_files(spark, d):
    paths = [_landed(spark, d, "csv", ".csv"), _landed(spark, d, "jsonl", ".jsonl")]
    rows = headlines.union_headline_files(spark, paths)
    return rows.groupBy("source", "reporter").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("headline")).alias("chars")
    )


@query
def raw_file_order(spark, d):
    """Two scrapes of the same headlines: the older file's row is kept."""
    paths = []
    for scrape in ("first", "second"):
        path = scratch_path(spark, scrape) + ".csv"
        rows = b.raw_headlines(spark, d).withColumn("source", F.lit(scrape))
        rows.select(*RAW_COLUMNS).write.options(**writers.CSV_WRITE).csv(path)
        paths.append(path)
    rows = headlines.raw_file_order(headlines.union_headline_files(spark, paths[::-1], with_file=True))
    return dedup.dedup_headline_url(rows, "ord").select("headline", "url", "source")


@query
def write_jsonl(spark, d):
    path = scratch_path(spark, "processed")
    rows = b.processed(spark, d)
    writers.write_jsonl(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query
def write_csv_full_rebuild(spark, d):
    path = scratch_path(spark, "base") + ".csv"
    writers.write_csv_full_rebuild(b.raw_headlines(spark, d).select(*RAW_COLUMNS), path, ["posted_at", "url"])
    return headlines.read_headlines_csv(spark, path)


@query
def jsonl_to_csv(spark, d):
    src, out = scratch_path(spark, "lines"), scratch_path(spark, "converted")
    rows = b.raw_headlines(spark, d).withColumn("desk", F.col("ord") % 5)
    writers.write_jsonl(rows, src)
    writers.jsonl_to_csv(spark, src, out)
    cols = ["source", "fetched_at", "headline", "posted_at", "reporter", "url", "desk", "ord"]
    schema = ", ".join(f"{c} string" for c in cols)
    return spark.read.options(**headlines.CSV_OPTIONS).schema(schema).csv(out)


@query
def daily_merge(spark, d):
    """Half of the rows are stored; the batch brings all of them from another outlet."""
    raw = b.raw_headlines(spark, d)
    stored = raw.where("reporter = 'en'")
    batch = raw.withColumn("reporter", F.concat(F.lit("new-"), "reporter"))
    return writers.daily_merge(stored, batch, "ord")


@query
def merge_into_day(spark, d):
    path = scratch_path(spark, "raw")
    raw = b.raw_headlines(spark, d)
    for stamp, part in (("1", raw.where("reporter = 'en'")), ("2", raw)):
        batch = part.withColumn("fetched_at", F.concat("fetched_at", F.lit(stamp)))
        writers.merge_into_day(spark, path, batch, "20240101", "ord")
    return spark.read.schema(raw.select(*RAW_COLUMNS).schema).parquet(path).select(*RAW_COLUMNS)


@query
def compact_daily(spark, d):
    """Two runs per day of the posting date, landed per file name, compacted per day."""
    src, out = scratch_path(spark, "runs"), scratch_path(spark, "days")
    raw = b.raw_headlines(spark, d)
    day = F.regexp_replace(F.substring("posted_at", 1, 10), "-", "")
    runs = F.explode(F.array(F.lit("08"), F.lit("15"))).alias("run")
    rows = raw.select(*RAW_COLUMNS, day.alias("day"), runs).withColumn("source", F.col("run"))
    named = rows.withColumn("file", F.format_string("headlines_%s_%s.csv", "day", "run"))
    (
        named.select(*RAW_COLUMNS, "file")
        .write.partitionBy("file")
        .options(**writers.CSV_WRITE)
        .csv(src)
    )
    writers.compact_daily(spark, src, out)
    schema = ", ".join(f"{c} string" for c in [*RAW_COLUMNS, "day"])
    return spark.read.options(**headlines.CSV_OPTIONS).schema(schema).csv(out)


@query
def insert_or_ignore(spark, d):
    """Clicks are stored first; inserting everything twice adds each key once."""
    path = scratch_path(spark, "scores")
    rows = b.processed(spark, d)
    first = writers.insert_or_ignore(spark, path, rows.where("ticker = 'click'"))
    second = writers.insert_or_ignore(spark, path, rows)
    third = writers.insert_or_ignore(spark, path, rows)
    stored = writers.read_score_table(spark, path)
    return rounded(
        stored.select(
            "headline", "url", "ticker", "posted_at", "is_ai_related", "sentiment_llm_phi3",
            F.lit(first).cast("long").alias("added_first"),
            F.lit(second).cast("long").alias("added_second"),
            F.lit(third).cast("long").alias("added_third"),
        ),
        "sentiment_llm_phi3",
    )


@query
def read_scores_ordered(spark, d):
    path = scratch_path(spark, "scores")
    writers.insert_or_ignore(spark, path, b.processed(spark, d))
    return writers.read_scores_ordered(spark, path).select("fetched_at", "headline", "url", "ticker")


@query
def anti_join_new_rows(spark, d):
    rows = b.table(spark, d, "events").select("event_type", "user_id", "value")
    batch = rows.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    stored = rows.where("value > 150")
    return joins.anti_join_new_rows(batch, stored, ["event_type", "user_id"])


@query
def prices_long(spark, d):
    fields = {"Close": "close", "High": "high", "Low": "low", "Volume": "volume"}
    names = ["click", "error", "purchase", "signup", "view"]
    wide = (
        b.prices(spark, d)
        .groupBy(F.col("trade_date").alias("Date"))
        .pivot("ticker", names)
        .agg(*[F.first(c).alias(f) for f, c in fields.items()])
    )
    wide = wide.withColumnsRenamed({f"{t}_{f}": f"{t}|{f}" for t in names for f in fields})
    return rounded(prices.prices_long(wide, names, list(fields)), "close", "high", "low")


@query
def price_range(spark, d):
    """Prices of the order table around the ship dates of all items."""
    shipped = b.table(spark, d, "lineitem")
    events = shipped.select(F.to_date("l_shipdate").alias("date"))
    return prices.price_range(events, b.order_prices(spark, d))


def _feed(spark: SparkSession, d: str, limit: int, snippet_chars: int | None) -> DataFrame:
    entries = b.feed_entries(spark, d)
    parts = [
        feeds.normalize_feed(entries, name, limit, NOW, snippet_chars) for name in feeds.SOURCES
    ]
    return dedup.union_all(parts).drop("part")


@query
def normalize_feed(spark, d):
    return _feed(spark, d, 50, 500)


@query
def articles_to_raw(spark, d):
    return feeds.articles_to_raw(_feed(spark, d, 50, 500), NOW)


@query
def load_lexicon(spark, d):
    """Hits of every loaded keyword in the documents."""
    tables = lexicon.tables_from_mappings(spark, ENTITIES, RELATIONSHIPS)
    words = [r.keyword for r in tables.lexicon.select("keyword").distinct().collect()]
    docs = b.raw_headlines(spark, d).select(text.normalize_headline(F.col("headline")).alias("h"))
    hits = docs.select(F.explode(text.keywords_present(F.col("h"), words)).alias("keyword"))
    counts = hits.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    return tables.lexicon.join(counts, "keyword", "left").select(
        "ticker", "keyword", "role", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


# --- projections and predicates ------------------------------------------------------------


@query
def normalize_headline(spark, d):
    return b.raw_headlines(spark, d).select("ord", text.normalize_headline(F.col("headline")).alias("norm"))


@query
def contains_keyword(spark, d):
    h = F.col("h")
    docs = b.raw_headlines(spark, d).select(
        "ord", "reporter", text.normalize_headline(F.col("headline")).alias("h")
    )
    by_lang = F.when(F.col("reporter") == "en", "of the").when(F.col("reporter") == "fr", "La").otherwise("2.0")
    return docs.select(
        "ord",
        text.contains_keyword(h, "The").alias("word"),
        text.contains_keyword(h, "th th").alias("phrase"),
        text.contains_keyword(h, "by-nc").alias("hyphen"),
        text.contains_keyword(h, "  ").alias("blank"),
        text.contains_keyword(h, by_lang).alias("by_lang"),
    )


@query
def ai_flag(spark, d):
    return matching.ai_flag(b.raw_headlines(spark, d), b.ai_terms(spark)).select("ord", "is_ai_related")


@query
def partnership_flag(spark, d):
    rows = b.raw_headlines(spark, d).withColumn(
        "ticker", F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("ord") % 4 + 1).cast("int"))
    )
    return matching.partnership_flag(rows, b.lexicon(spark)).select("ord", "ticker", "is_proxy_partnership")


@query
def ai_only_filter(spark, d):
    return dedup.ai_only_filter(_matched(spark, d)).select("ord", "ticker")


@query
def ticker_subset(spark, d):
    return dedup.ticker_subset(b.processed(spark, d), TICKERS).select("ord", "ticker")


@query
def drop_missing_keys(spark, d):
    rows = b.processed(spark, d).select(
        "ord",
        F.when(F.col("ord") % 10 != 0, F.col("ticker")).alias("ticker"),
        dates.posted_date(F.when(F.col("ord") % 7 == 0, "junk").otherwise(F.col("posted_at"))).alias("date"),
    )
    return dedup.drop_missing_keys(rows, ["ticker", "date"])


@query
def null_score_triage(spark, d):
    return dly.null_score_triage(b.processed(spark, d), "sentiment_llm_deepseek_r1", "ord")


@query
def null_score_count(spark, d):
    return dly.null_score_count(b.processed(spark, d), "sentiment_llm_deepseek_r1")


@query
def backfill_columns(spark, d):
    rows = b.table(spark, d, "events").select(
        F.col("event_type").alias("source"), F.when(F.col("value") > 50, F.col("props")).alias("headline")
    )
    return headlines.backfill_columns(rows)


@query
def normalize_url(spark, d):
    messy = F.concat(F.lit(" "), "url", F.expr("repeat('/', cast(page_id % 4 as int))"), F.lit("\t"))
    return b.table(spark, d, "pages").select("page_id", text.normalize_url(messy).alias("url"))


# --- joins ---------------------------------------------------------------------------------


@query
def match_tickers(spark, d):
    return _flags(_matched(spark, d))


@query
def match_tickers_token(spark, d):
    return _flags(_matched(spark, d, strategy="token"))


@query
def match_tickers_many(spark, d):
    """Three stretches of every text as keywords, far more than are planned into a scan."""
    raw = b.raw_headlines(spark, d)
    stretches = text.let(
        text.normalize_headline(F.col("headline")),
        lambda h: F.array(*(F.trim(F.substring(h, at, size)) for at, size in ((1, 12), (13, 9), (40, 7)))),
    )
    lex = (
        raw.select(F.explode(stretches).alias("keyword"))
        .where(r"keyword like '% %' or keyword rlike '^[\\p{L}\\p{N}_]+$'")
        .distinct()
        .select(
            F.left("keyword", F.lit(1)).alias("ticker"),
            "keyword",
            F.expr("if(length(keyword) % 2 = 0, 'partners', 'identity')").alias("role"),
        )
    )
    return _flags(matching.match_tickers(raw, cut_lineage(lex, "keywords"), b.ai_terms(spark)))


@query
def score_unique_join(spark, d):
    backends = {
        "finbert": _lexicon_scorer(),
        "phi3": lambda h, c: F.least(F.length(h) / F.lit(20000.0), F.lit(1.0)),
        "unknown": _lexicon_scorer(),
    }
    scored = scoring.score_unique_join(b.raw_headlines(spark, d), backends)
    cols = ["sentiment_finbert", "sentiment_llm_phi3"]
    return rounded(scored.select("ord", *cols), *cols)


@query
def headline_tickers(spark, d):
    rows = matching.headline_tickers(_matched(spark, d))
    return rows.select("headline", F.array_join("tickers", ",").alias("tickers"))


@query
def headline_context(spark, d):
    rows = matching.headline_tickers(_matched(spark, d))
    return matching.headline_context(rows, b.contexts(spark)).select("headline", "context")


@query
def headline_context_token(spark, d):
    """One row per text and ticker, so that texts repeat with other tickers."""
    rows = _matched(spark, d).select("ord", "headline", "ticker", F.array("ticker").alias("tickers"))
    noted = matching.headline_context(rows, b.contexts(spark), strategy="token")
    return noted.select("ord", "ticker", "context")


@query
def asof_forward(spark, d):
    px = b.prices(spark, d).select("ticker", "trade_date", "close")
    days = b.daily(spark, d).select("ticker", "date", "headline_count")
    return joins.asof_forward(days, px, unique_left=True)


@query
def asof_forward_orders(spark, d):
    orders = b.table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("date")
    )
    return joins.asof_forward(orders, b.order_prices(spark, d)).select("o_orderkey", "trade_date", "close")


@query
def date_join_prices(spark, d):
    px = b.prices(spark, d).select("ticker", "trade_date", "close")
    return joins.date_join_prices(b.daily(spark, d).select("ticker", "date", "headline_count"), px)


# --- aggregations --------------------------------------------------------------------------


@query
def daily_sentiment(spark, d):
    return rounded(b.daily(spark, d), *AVERAGE_COLUMNS)


@query
def ticker_summary(spark, d):
    return rounded(dly.ticker_summary(b.processed(spark, d)), *SENTIMENT_COLUMNS)


@query
def ticker_summary_ai(spark, d):
    return rounded(dly.ticker_summary_ai(b.processed(spark, d)), *SENTIMENT_COLUMNS)


@query
def null_audit(spark, d):
    return dly.null_audit(b.features(spark, d))


@query
def corr_matrix(spark, d):
    return rounded(stats.corr_matrix(b.aligned(spark, d), AVERAGE_COLUMNS + RETURN_COLUMNS), "r")


@query
def corr_by_ticker(spark, d):
    table = stats.corr_by_ticker(b.aligned(spark, d), AVERAGE_COLUMNS, RETURN_COLUMNS, TICKERS)
    return rounded(table, "r")


@query
def corr_delta_block(spark, d):
    features = DELTA_COLUMNS + ["delta_sum", "llm_spread"]
    return rounded(stats.corr_delta_block(b.aligned(spark, d), RETURN_COLUMNS, features), "r")


@query
def safe_corr(spark, d):
    """Per return flag, with a constant column among the pairs."""
    rows = b.table(spark, d, "lineitem").select(
        "l_returnflag", "l_quantity", "l_extendedprice", F.lit(1.0).alias("one")
    )
    return rounded(
        rows.groupBy("l_returnflag").agg(
            stats.safe_corr(F.col("l_quantity"), F.col("l_extendedprice")).alias("r"),
            stats.safe_corr(F.col("l_quantity"), F.col("one")).alias("r_constant"),
        ),
        "r",
    )


@query
def quintile_excess(spark, d):
    daily_q = cut_lineage(b.daily_q(spark, d), "daily_q")
    table = stats.quintile_excess(daily_q, "finbert_avg", b.EXCESS_COLUMNS)
    return rounded(table, *b.EXCESS_COLUMNS)


@query
def quintile_change(spark, d):
    daily_q = cut_lineage(b.daily_q(spark, d), "daily_q")
    table = stats.quintile_change(daily_q, "phi3_avg", b.EXCESS_COLUMNS)
    return rounded(table, *b.EXCESS_COLUMNS)


@query
def quintile_lineitem(spark, d):
    """Buckets of a large table with many equal values."""
    rows = b.table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    by_price = stats.quintile_excess(rows, "l_extendedprice", ["l_quantity", "l_discount"])
    by_count = stats.quintile_excess(rows, "l_quantity", ["l_extendedprice", "l_discount"])
    price = by_price.select("label", F.lit("price").alias("of"), "l_discount")
    count = by_count.select("label", F.lit("quantity").alias("of"), "l_discount")
    return rounded(price.unionByName(count), "l_discount")


@query
def hit_rate_overall(spark, d):
    return rounded(stats.hit_rate_overall(b.daily_q(spark, d), "finbert_avg"), "hit_rate")


@query
def hit_rate_by_ticker(spark, d):
    table = stats.hit_rate_by_ticker(b.daily_q(spark, d), AVERAGE_COLUMNS, RETURN_COLUMNS, TICKERS)
    return rounded(table, "hit_rate")


@query
def stage_counts(spark, d):
    return base_data_counts(b.raw_headlines(spark, d), _tables(spark))


@query
def source_counts(spark, d):
    raw = b.raw_headlines(spark, d)
    return stats.source_counts(raw, dedup.dedup_canonical(raw, "ord"))


# --- windows -------------------------------------------------------------------------------


def _with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Daily means with a gap wherever a day has an odd number of headlines."""
    gap = F.col("headline_count") % 2 == 1
    return b.daily(spark, d).withColumns({c: F.when(~gap, F.col(c)) for c in AVERAGE_COLUMNS})


@query
def ffill_by_ticker(spark, d):
    return rounded(dly.ffill_by_ticker(_with_gaps(spark, d)), *AVERAGE_COLUMNS)


@query
def trailing_return(spark, d):
    return rounded(returns.trailing_return(b.order_prices(spark, d)), "ret_eod")


@query
def forward_returns(spark, d):
    return rounded(returns.forward_returns(b.order_prices(spark, d)), *RETURN_COLUMNS[1:])


@query
def market_excess(spark, d):
    cols = ["market_avg", *b.EXCESS_COLUMNS]
    return rounded(b.daily_q(spark, d).select("ticker", "date", *cols), *cols)


@query
def sentiment_change(spark, d):
    rows = dly.sentiment_change(b.daily(spark, d), "phi3_avg")
    return rounded(rows.select("ticker", "date", "phi3_avg_change"), "phi3_avg_change")


@query
def first_keep_dedup(spark, d):
    rows = b.table(spark, d, "lineitem")
    return dedup.first_keep_dedup(rows, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select(
        "l_partkey", "l_orderkey", "l_linenumber"
    )


# --- sorts, limits, sets -------------------------------------------------------------------


@query
def sort_raw(spark, d):
    return dedup.sort_raw(b.raw_headlines(spark, d).select(*RAW_COLUMNS, "ord"), "ord")


@query
def sort_base(spark, d):
    return dedup.sort_base(_matched(spark, d).select("posted_at", "url", "ticker", "ord"))


@query
def sort_daily(spark, d):
    return dedup.sort_daily(b.daily(spark, d).select("ticker", "date", "headline_count"))


@query
def limit_per_source(spark, d):
    return dedup.limit_per_source(b.raw_headlines(spark, d), 10, "ord").select("source", "ord")


@query
def union_all(spark, d):
    raw = b.raw_headlines(spark, d)
    parts = [raw, raw.drop("reporter"), raw]
    return dedup.union_all(parts, "ord").select("source", "reporter", "ord.part", F.col("ord.ord").alias("ord"))


@query
def dedup_canonical(spark, d):
    return dedup.dedup_canonical(b.raw_headlines(spark, d), "ord").select("ord", "reporter", "posted_at")


@query
def dedup_headline_url(spark, d):
    raw = b.raw_headlines(spark, d)
    twice = dedup.union_all([raw, raw.withColumn("reporter", F.lit("again"))], "ord")
    return dedup.dedup_headline_url(twice, "ord").select("headline", "url", "reporter", F.col("ord.ord").alias("ord"))


@query
def dedup_base(spark, d):
    return dedup.dedup_base(_matched(spark, d, ai_only=True), "ord").select("posted_at", "url", "ticker", "ord")


@query
def dedup_headline(spark, d):
    rows = dedup.ticker_subset(b.processed(spark, d), TICKERS)
    return dedup.dedup_headline(rows, "ord").select("headline", "ticker", "ord")


@query
def distinct_ordered(spark, d):
    return dedup.distinct_ordered(b.raw_headlines(spark, d), "headline", "ord")


# --- row functions -------------------------------------------------------------------------


@query
def parse_posted_at(spark, d):
    rows = b.feed_entries(spark, d)
    parsed = dates.parse_posted_at(F.col("published"))
    return rows.select(
        "page_id",
        F.date_format(parsed, dates.ISO_Z).alias("posted_ts"),
        dates.posted_date(F.col("published")).alias("date"),
    )


@query
def parse_feed_date(spark, d):
    rows = b.feed_entries(spark, d)
    return rows.select("page_id", dates.parse_feed_date(F.col("published"), NOW).alias("parsed"))


@query
def normalize_ts(spark, d):
    rows = b.feed_entries(spark, d)
    return rows.select("page_id", dates.normalize_ts(F.col("published"), NOW).alias("normalized"))


@query
def file_date_key(spark, d):
    stem = F.expr("concat(if(event_id % 4 = 0, 'lines_', 'headlines_'), 20240000 + event_id % 10000, "
                  "if(event_id % 3 = 0, '', concat('_', user_id)))")
    rows = b.table(spark, d, "events")
    return rows.select("event_id", dates.file_date_key(stem).alias("day"))


@query
def strip_html_snippet(spark, d):
    """The whole visible text of every page."""
    rows = b.table(spark, d, "pages")
    return rows.select("page_id", text.strip_html_snippet(F.col("html"), None).alias("snippet"))


@query
def build_prompt(spark, d):
    matched = matching.headline_tickers(_matched(spark, d))
    noted = matching.headline_context(matched, b.contexts(spark))
    return noted.select("headline", text.build_prompt(F.col("headline"), F.col("context")).alias("prompt"))


@query
def parse_score(spark, d):
    rows = b.responses(spark, d)
    return rounded(rows.select("conv_id", "turn", scores.parse_score(F.col("response")).alias("score")), "score")


@query
def prob_score(spark, d):
    """Every component of a vector is the logit of a class."""
    rows = b.table(spark, d, "embeddings")
    classes = rows.select(F.max(F.size("embedding"))).first()[0] or 2
    labels = ["Positive", "negative", *[f"class {k}" for k in range(2, classes)]]
    score = scores.prob_score(F.col("embedding").cast("array<double>"), labels)
    return rounded(rows.select("vec_id", score.alias("score")), "score")


@query
def model_deltas(spark, d):
    base, *others = SENTIMENT_COLUMNS
    rows = scores.model_deltas(b.processed(spark, d), base, dict(zip(DELTA_COLUMNS, others)))
    cols = [*DELTA_COLUMNS, "delta_sum", "delta_mean_signed"]
    return rounded(rows.select("ord", *cols), *cols)


@query
def llm_spread(spark, d):
    spread = scores.llm_spread(*[F.col(c) for c in SENTIMENT_COLUMNS[1:]])
    return rounded(b.processed(spark, d).select("ord", spread.alias("llm_spread")), "llm_spread")


@query
def daily_features(spark, d):
    cols = [*DELTA_COLUMNS, "delta_sum", "delta_mean_signed", "llm_spread"]
    return rounded(b.features(spark, d).select("ticker", "date", *cols), *cols)


@query
def row_mean(spark, d):
    mean = scores.row_mean(*[F.col(c) for c in SENTIMENT_COLUMNS[1:]])
    return rounded(b.processed(spark, d).select("ord", mean.alias("row_mean")), "row_mean")


def _contrarian(spark: SparkSession, d: str) -> DataFrame:
    *others, model = SENTIMENT_COLUMNS
    return dly.contrarian_rows(b.processed(spark, d), model, others, TICKERS, "ord")


@query
def contrarian_rows(spark, d):
    return _contrarian(spark, d).select("ord", "headline")


@query
def contrarian_topn(spark, d):
    return dly.contrarian_topn(_contrarian(spark, d), "ord").select("ord", "headline")


@query
def hit_flag(spark, d):
    s, r = F.col("sentiment_llm_phi3"), F.col("sentiment_llm_llama3_2")
    return b.processed(spark, d).select(
        "ord", scores.hit_flag(s, r).alias("hit"), scores.hit_flag(s, r, strict=True).alias("strict_hit")
    )


@query
def quintile_label(spark, d):
    rows = b.table(spark, d, "events")
    return rows.select("event_id", scores.quintile_label((F.col("event_id") % 5 + 1).cast("int")).alias("label"))


@query
def bool_to_int(spark, d):
    flag = F.when(F.col("ord") % 4 != 0, F.col("is_ai_related"))
    return b.processed(spark, d).select("ord", scores.bool_to_int(flag).alias("flag"))


# --- reshape -------------------------------------------------------------------------------


@query
def melt_models(spark, d):
    return rounded(dly.melt_models(dly.ticker_summary_ai(b.processed(spark, d))), "value")


@query
def horizon_relabel(spark, d):
    rows = returns.with_returns(b.order_prices(spark, d)).select("ticker", "trade_date", *RETURN_COLUMNS)
    return rounded(dly.horizon_relabel(rows), "EOD", "1D", "3D", "5D", "7D")


# --- scoring -------------------------------------------------------------------------------


@query
def lexicon_scorer(spark, d):
    score = _lexicon_scorer()(F.col("headline"), F.lit(None))
    return rounded(b.raw_headlines(spark, d).select("ord", score.alias("score")), "score")


def _length_model():
    """Stand-in model: text length to a score; fails on the shortest texts."""

    def score(headline: str, context: str | None) -> float | None:
        if len(headline) < 100:
            raise ValueError("too short")
        return ((len(headline) * 37) % 201 - 100) / 100

    return score


def _answer_model():
    return lambda prompt: f"thinking 1 2 3\nScore: {(len(prompt) * 53) % 7 - 3}.5"


def _logit_model():
    return lambda headline: [len(headline) % 7 / 7.0, len(headline) % 5 / 5.0, 0.25]


@query
def score_backends(spark, d):
    """Python models behind Arrow batches, one per kind of scorer."""
    backends = {
        "finbert": scoring.class_scorer(_logit_model, ["positive", "negative", "neutral"]),
        "phi3": scoring.prompt_scorer(_answer_model),
        "llama3.2:3b": scoring.model_scorer(_length_model),
    }
    unique = b.raw_headlines(spark, d).select("headline").distinct()
    scored = scoring.score_backends(unique, backends, partitions=spark.sparkContext.defaultParallelism)
    cols = SENTIMENT_COLUMNS[:3]
    return rounded(scored.select("headline", *cols), *cols)


# --- streaming -----------------------------------------------------------------------------


@query
def stream_ingest_headlines(spark, d):
    """Two landed scrapes of the documents: every (headline, url) is stored once."""
    src, out, mark = (scratch_path(spark, n) for n in ("landing", "raw", "mark"))
    for _ in range(2):
        b.raw_headlines(spark, d).select(*RAW_COLUMNS).write.mode("append").parquet(src)
    ingest.stream_ingest_headlines(spark, src, out, mark).awaitTermination()
    return ingest.read_raw_table(spark, out).select("headline", "url")


@query
def stream_match_upsert(spark, d):
    src, out, mark = (scratch_path(spark, n) for n in ("landing", "scores", "mark"))
    for _ in range(2):
        b.raw_headlines(spark, d).select(*RAW_COLUMNS).write.mode("append").parquet(src)
    stream = ingest.read_stream(spark, src, maxFilesPerTrigger="1")
    ingest.stream_match_upsert(stream, b.lexicon(spark), b.ai_terms(spark), out, mark).awaitTermination()
    return writers.read_score_table(spark, out).select("headline", "url", "ticker", "is_proxy_partnership")


# --- whole jobs ----------------------------------------------------------------------------


@query
def base_data_plan(spark, d):
    return base_data(b.raw_headlines(spark, d), _tables(spark))


@query
def process_plan(spark, d):
    base = base_data(b.raw_headlines(spark, d), _tables(spark))
    scored = process(base, {"finbert": _lexicon_scorer()}, _tables(spark))
    return rounded(scored, "sentiment_finbert")


@query
def daily_ai_sentiment(spark, d):
    """Average daily score per ticker over AI headlines, from raw headlines."""
    base = base_data(b.raw_headlines(spark, d), _tables(spark))
    scored = process(base, {"finbert": _lexicon_scorer()})
    daily = dly.daily_sentiment(scored, {"score_avg": "sentiment_finbert"})
    return rounded(daily, "score_avg")
