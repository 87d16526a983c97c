"""Table contracts.  Every read names its schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed column names and order of the stored tables.
RAW_COLUMNS = ["source", "fetched_at", "headline", "posted_at", "reporter", "url"]
MATCHED_COLUMNS = [
    "posted_at",
    "fetched_at",
    "headline",
    "url",
    "source",
    "reporter",
    "ticker",
    "is_ai_related",
    "is_proxy_partnership",
]
SENTIMENT_COLUMNS = [
    "sentiment_finbert",
    "sentiment_llm_phi3",
    "sentiment_llm_llama3_2",
    "sentiment_llm_deepseek_r1",
]
AVERAGE_COLUMNS = ["finbert_avg", "phi3_avg", "llama3_avg", "deepseek_avg"]
DELTA_COLUMNS = ["phi_delta", "llama_delta", "deepseek_delta"]
HORIZONS = (1, 3, 5, 7)
RETURN_COLUMNS = ["ret_eod", "ret_1d", "ret_3d", "ret_5d", "ret_7d"]
HORIZON_LABELS = {"ret_eod": "EOD", "ret_1d": "1D", "ret_3d": "3D", "ret_5d": "5D", "ret_7d": "7D"}
PRICE_FIELDS = ["Open", "High", "Low", "Close", "Adj Close", "Volume"]
SCORE_KEYS = ["headline", "url", "ticker"]
BASE_KEYS = ["posted_at", "url", "ticker"]


def strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RAW = strings(RAW_COLUMNS)

MATCHED = T.StructType(
    [
        T.StructField(n, T.BooleanType() if n.startswith("is_") else T.StringType())
        for n in MATCHED_COLUMNS
    ]
)

PROCESSED = T.StructType(
    MATCHED.fields + [T.StructField(n, T.DoubleType()) for n in SENTIMENT_COLUMNS]
)

# Stored table: flags as 0/1/null.
SCORES = T.StructType(
    [
        T.StructField(f.name, T.IntegerType() if f.name.startswith("is_") else f.dataType)
        for f in PROCESSED.fields
    ]
)

FEED_ENTRIES = T.StructType(
    [
        T.StructField("source_system", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("published", T.StringType()),
        T.StructField("updated", T.StringType()),
        T.StructField("created", T.StringType()),
        T.StructField("source_title", T.StringType()),
    ]
)

ARTICLE_COLUMNS = ["url", "headline", "timestamp", "source", "snippet", "pipeline_source"]

LEXICON = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("role", T.StringType()),
    ]
)
AI_TERMS = T.StructType([T.StructField("term", T.StringType()), T.StructField("kind", T.StringType())])
CONTEXTS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("position", T.IntegerType()),
    ]
)

# Roles whose mention marks a partnership, and all roles that attribute a headline.
PARTNER_ROLES = ["lab_partners", "partners", "infra_partners"]
ECOSYSTEM_ROLES = PARTNER_ROLES + ["suppliers", "competitors"]
