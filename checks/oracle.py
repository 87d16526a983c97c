"""The same results in SQL, run on the same tables by another engine."""

from __future__ import annotations

from checks.bindings import (
    AI_ROWS,
    CONTEXT_ROWS,
    EXCESS_COLUMNS,
    LEXICON_ROWS,
    NEGATIVE,
    POSITIVE,
)
from checks.queries import NOW, TICKERS
from tickertide.functions.text import PROMPT_HEAD, PROMPT_TAIL
from tickertide.schemas import (
    AVERAGE_COLUMNS,
    DELTA_COLUMNS,
    HORIZON_LABELS,
    PARTNER_ROLES,
    RAW_COLUMNS,
    RETURN_COLUMNS,
    SENTIMENT_COLUMNS,
)

ORACLE: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(items: list[str]) -> str:
    return ", ".join(q(i) for i in items)


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def r6(col: str, name: str | None = None) -> str:
    return f"round({col}, 6) + 0.0 AS {name or col}"


SPACES = r"[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]+"
ISO = "'%Y-%m-%dT%H:%M:%SZ'"


def norm(col: str) -> str:
    return f"trim(regexp_replace(lower({col}), '{SPACES}', ' ', 'g'))"


def stripped(col: str) -> str:
    return f"regexp_replace({col}, '^{SPACES}|{SPACES}$', '', 'g')"


def hit(h: str, kw: str) -> str:
    word = r"[^\p{L}\p{N}_]"
    return (
        f"CASE WHEN {kw} = '' THEN false WHEN contains({kw}, ' ') THEN contains({h}, {kw}) "
        f"ELSE regexp_matches({h}, '(^|{word})' || regexp_escape({kw}) || '({word}|$)') END"
    )


RAW = f"""raw AS (
  SELECT source, strftime(TIMESTAMP '2024-01-01' + (doc_id // 3) * INTERVAL 37 MINUTE + INTERVAL 1 HOUR, {ISO}) AS fetched_at,
         text AS headline,
         strftime(TIMESTAMP '2024-01-01' + (doc_id // 3) * INTERVAL 37 MINUTE, {ISO}) AS posted_at,
         lang AS reporter, 'https://example.org/' || (doc_id // 2) AS url, doc_id AS ord
  FROM documents)"""

LEX = f"""lex AS (
  SELECT ticker, lower(trim(keyword)) AS kw, role, role IN ({listed(PARTNER_ROLES)}) AS partner
  FROM (VALUES {values(LEXICON_ROWS)}) t(ticker, keyword, role)),
ait AS (SELECT lower(trim(term)) AS kw FROM (VALUES {values(AI_ROWS)}) t(term, kind)),
ctx AS (SELECT * FROM (VALUES {values(CONTEXT_ROWS)}) t(ticker, kw, context, pos))"""

MATCHED = f"""{RAW}, {LEX},
normed AS (SELECT *, {norm('headline')} AS h FROM raw),
flagged AS (SELECT *, EXISTS (SELECT 1 FROM ait WHERE {hit('h', 'kw')}) AS is_ai_related FROM normed),
matched AS (
  SELECT ord, ticker, any_value(is_ai_related) AS is_ai_related, bool_or(partner) AS is_proxy_partnership,
         any_value(headline) AS headline, any_value(posted_at) AS posted_at, any_value(fetched_at) AS fetched_at,
         any_value(url) AS url, any_value(source) AS source, any_value(reporter) AS reporter
  FROM flagged, lex WHERE {hit('h', 'kw')} GROUP BY ord, ticker)"""


def score_sql(factor: int, gap: int | None) -> str:
    value = f"((event_id * {factor}) % 201 - 100) / 100.0::DOUBLE"
    return value if gap is None else f"CASE WHEN event_id % {gap} = 0 THEN NULL ELSE {value} END"


FACTORS = [(37, None), (53, 11), (71, 13), (89, 17)]
PROCESSED = f"""processed AS (
  SELECT strftime(ts, {ISO}) AS posted_at, strftime(ts + INTERVAL 1 HOUR, {ISO}) AS fetched_at,
         event_type || '-' || user_id AS headline, 'https://example.org/' || user_id AS url,
         'feed' AS source, 'desk' || (event_id % 7) AS reporter, event_type AS ticker,
         event_id % 3 <> 0 AS is_ai_related, event_id % 5 = 0 AS is_proxy_partnership,
         {', '.join(f'{score_sql(f, g)} AS {c}' for c, (f, g) in zip(SENTIMENT_COLUMNS, FACTORS))},
         event_id AS ord, CAST(ts AS DATE) AS day
  FROM events)"""

DAILY = f"""{PROCESSED},
daily AS (
  SELECT ticker, day AS date, count(headline) AS headline_count,
         {', '.join(f'round(avg({c}), 9) AS {a}' for a, c in zip(AVERAGE_COLUMNS, SENTIMENT_COLUMNS))}
  FROM processed GROUP BY ticker, day)"""


def fill(cols: list[str]) -> str:
    return ", ".join(
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}"
        for c in cols
    )


LLM = AVERAGE_COLUMNS[1:]
FEATURES = f"""{DAILY},
filled AS (SELECT ticker, date, headline_count, {fill(AVERAGE_COLUMNS)} FROM daily),
deltas AS (SELECT *, {', '.join(f'{o} - finbert_avg AS {n}' for n, o in zip(DELTA_COLUMNS, LLM))} FROM filled),
features AS (
  SELECT *, abs(phi_delta) + abs(llama_delta) + abs(deepseek_delta) AS delta_sum,
         (phi_delta + llama_delta + deepseek_delta) / 3 AS delta_mean_signed,
         CASE WHEN (phi3_avg IS NOT NULL)::INT + (llama3_avg IS NOT NULL)::INT + (deepseek_avg IS NOT NULL)::INT >= 2
              THEN list_stddev_samp([phi3_avg, llama3_avg, deepseek_avg]) END AS llm_spread
  FROM deltas)"""

PRICES = """prices AS (
  SELECT event_type AS ticker, CAST(ts AS DATE) AS trade_date, round(avg(value), 6) AS close,
         max(value) AS high, min(value) AS low, count(*) AS volume
  FROM events WHERE isodow(ts) <= 5 GROUP BY 1, 2)"""
ORDER_PRICES = """prices AS (
  SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS trade_date, round(avg(o_totalprice), 6) AS close
  FROM orders WHERE isodow(o_orderdate) <= 5 GROUP BY 1, 2)"""
RETURNS = """rets AS (
  SELECT ticker, trade_date, close / lag(close) OVER w - 1 AS ret_eod,
         lead(close, 1) OVER w / close - 1 AS ret_1d, lead(close, 3) OVER w / close - 1 AS ret_3d,
         lead(close, 5) OVER w / close - 1 AS ret_5d, lead(close, 7) OVER w / close - 1 AS ret_7d
  FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY trade_date))"""
ALIGNED = f"""{FEATURES}, {PRICES}, {RETURNS},
aligned AS (
  SELECT f.*, r.trade_date, {', '.join(f'r.{c}' for c in RETURN_COLUMNS)}
  FROM features f ASOF LEFT JOIN rets r ON f.ticker = r.ticker AND f.date <= r.trade_date)"""
DAILY_Q = f"""{FEATURES}, {PRICES}, {RETURNS},
joined AS (
  SELECT f.*, {', '.join(f'r.{c}' for c in RETURN_COLUMNS)}
  FROM features f LEFT JOIN rets r ON f.ticker = r.ticker AND f.date = r.trade_date),
daily_q AS (
  SELECT *, avg(ret_1d) OVER (PARTITION BY date) AS market_avg,
         {', '.join(f'{c} - avg({c}) OVER (PARTITION BY date) AS excess_{c}' for c in RETURN_COLUMNS)}
  FROM joined)"""


def corr(x: str, y: str) -> str:
    return f"CASE WHEN isnan(corr({x}, {y})) THEN NULL ELSE corr({x}, {y}) END"


def first_rows(source: str, keys: str, order: str, cols: str = "*") -> str:
    return (
        f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn "
        f"FROM {source}) WHERE rn = 1"
    )


RAW_LIST = ", ".join(RAW_COLUMNS)

# --- sources, sinks, maintenance
for name in ("read_headlines_csv", "read_headlines_jsonl", "write_csv_full_rebuild"):
    ORACLE[name] = f"WITH {RAW} SELECT {RAW_LIST} FROM raw"
ORACLE["union_headline_files"] = f"""WITH {RAW} SELECT source, reporter, 2 * count(*) AS rows,
  CAST(2 * sum(length(headline)) AS BIGINT) AS chars FROM raw GROUP BY source, reporter"""
ORACLE["raw_file_order"] = f"WITH {RAW} SELECT DISTINCT headline, url, 'first' AS source FROM raw"
ORACLE["write_jsonl"] = f"WITH {PROCESSED} SELECT * EXCLUDE (day) FROM processed"
ORACLE["jsonl_to_csv"] = f"""WITH {RAW} SELECT {RAW_LIST}, CAST(ord % 5 AS VARCHAR) AS desk,
  CAST(ord AS VARCHAR) AS ord FROM raw"""
ORACLE["daily_merge"] = f"""WITH {RAW}, both_sides AS (
  SELECT 0 AS side, * FROM raw WHERE reporter = 'en'
  UNION ALL SELECT 1, * REPLACE ('new-' || reporter AS reporter) FROM raw)
  {first_rows('both_sides', 'headline, url', 'side, ord', RAW_LIST)}"""
ORACLE["merge_into_day"] = f"""WITH {RAW}, both_sides AS (
  SELECT 0 AS side, * REPLACE (fetched_at || '1' AS fetched_at) FROM raw WHERE reporter = 'en'
  UNION ALL SELECT 1, * REPLACE (fetched_at || '2' AS fetched_at) FROM raw)
  {first_rows('both_sides', 'headline, url', 'side, ord', RAW_LIST)}"""
ORACLE["compact_daily"] = f"""WITH {RAW} SELECT DISTINCT ON (day, headline, url)
  '08' AS source, {', '.join(RAW_COLUMNS[1:])}, replace(posted_at[1:10], '-', '') AS day
  FROM raw ORDER BY ord"""
ORACLE["insert_or_ignore"] = f"""WITH {PROCESSED},
  unique_rows AS ({first_rows('processed', 'headline, url, ticker', 'ord')})
  SELECT headline, url, ticker, posted_at, CAST(is_ai_related AS INT) AS is_ai_related,
         {r6('sentiment_llm_phi3')},
         (SELECT count(*) FROM unique_rows WHERE ticker = 'click') AS added_first,
         (SELECT count(*) FROM unique_rows WHERE ticker <> 'click') AS added_second,
         CAST(0 AS BIGINT) AS added_third
  FROM unique_rows"""
ORACLE["read_scores_ordered"] = f"""WITH {PROCESSED}
  {first_rows('processed', 'headline, url, ticker', 'ord', 'fetched_at, headline, url, ticker')}"""
ORACLE["anti_join_new_rows"] = """
  SELECT event_type, user_id, count(*) AS n FROM events e
  WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.value > 150 AND s.event_type = e.event_type AND s.user_id = e.user_id)
  GROUP BY event_type, user_id"""
ORACLE["prices_long"] = f"""WITH {PRICES},
  grid AS (SELECT ticker, trade_date FROM (SELECT DISTINCT trade_date FROM prices), (SELECT DISTINCT ticker FROM prices))
  SELECT ticker, trade_date, {r6('close')}, {r6('high')}, {r6('low')}, volume
  FROM grid LEFT JOIN prices USING (ticker, trade_date)"""
ORACLE["price_range"] = f"""WITH {ORDER_PRICES},
  span AS (SELECT min(CAST(l_shipdate AS DATE)) - 5 AS lo, max(CAST(l_shipdate AS DATE)) + 5 AS hi
           FROM lineitem)
  SELECT prices.* FROM prices, span WHERE trade_date >= lo AND trade_date < hi"""

WHEN = "(TIMESTAMP '2026-02-01' + page_id * INTERVAL 41 MINUTE)"
FEED = f"""entries AS (
  SELECT (['techcrunch', 'google_news', 'newsapi'])[page_id % 3 + 1] AS source_system,
         page_id // 3 AS position,
         CASE WHEN page_id % 10 = 0 THEN ' ' ELSE ' ' || regexp_extract(html, '<title>(.*?)</title>', 1) || ' ' END AS title,
         url AS link, html AS summary,
         CASE page_id % 8
           WHEN 0 THEN strftime({WHEN}, '%a, %-d %b %Y %H:%M:%S GMT')
           WHEN 1 THEN strftime({WHEN}, '%a, %d %b %Y %H:%M:%S +0500')
           WHEN 2 THEN strftime({WHEN}, {ISO})
           WHEN 3 THEN strftime({WHEN}, '%Y-%m-%d %H:%M:%S')
           WHEN 4 THEN strftime({WHEN}, '%Y-%m-%d')
           WHEN 5 THEN strftime({WHEN}, '%Y-%m-%dT%H:%M:%S.5Z')
           WHEN 6 THEN 'soon' ELSE '' END AS published,
         CASE WHEN page_id % 2 = 0 THEN '' ELSE strftime({WHEN}, '%Y-%m-%d') END AS updated,
         '2026-01-31' AS created,
         CASE WHEN page_id % 4 = 0 THEN '' ELSE 'site' || (page_id % 5) END AS source_title, page_id
  FROM pages)"""


def feed_date(col: str) -> str:
    clean = f"trim(regexp_replace(regexp_replace(trim({col}), '\\s*GMT$', ''), '\\s*[+-]\\d{{4}}$', ''))"
    return (
        f"CASE WHEN trim({col}) = '' THEN {q(NOW)} ELSE coalesce(strftime(coalesce("
        f"try_strptime({clean}, ['%a, %d %b %Y %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M:%SZ', "
        f"'%Y-%m-%d %H:%M:%S', '%Y-%m-%d']), try_strptime({clean}[1:10], '%Y-%m-%d')), {ISO}), {q(NOW)}) END"
    )


def fixed_ts(col: str) -> str:
    t = f"trim({col})"
    return (
        f"CASE WHEN {t} = '' THEN {q(NOW)} WHEN ends_with({t}, 'Z') THEN {t} "
        f"WHEN regexp_matches({t}, '[+-]\\d{{2}}:?\\d{{2}}$') THEN replace({t}, ' ', 'T') || 'Z' "
        f"WHEN contains({t}, 'T') THEN {t} || 'Z' ELSE {t}[1:10] || 'T12:00:00Z' END"
    )


# Named character references in the given pages (fixed values); "&amp;" comes last.
NAMED_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&nbsp;": "\u00a0",
    "&copy;": "©",
    "&reg;": "®",
    "&trade;": "™",
    "&middot;": "·",
    "&bull;": "•",
    "&hellip;": "…",
    "&mdash;": "—",
    "&ndash;": "–",
    "&lsquo;": "‘",
    "&rsquo;": "’",
    "&ldquo;": "“",
    "&rdquo;": "”",
    "&laquo;": "«",
    "&raquo;": "»",
    "&euro;": "€",
    "&pound;": "£",
}


def snippet(col: str) -> str:
    text = f"regexp_replace({col}, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<template\\b.*?</template\\s*>', chr(1), 'g')"
    text = f"regexp_replace({text}, '</?[A-Za-z!?][^>]*>', chr(1), 'g')"
    text = f"regexp_replace({text}, '\\x{{01}}+', ' ', 'g')"
    for name, char in NAMED_ENTITIES.items():
        text = f"replace({text}, {q(name)}, {q(char)})"
    return stripped(f"replace({text}, '&amp;', '&')")


FIRST_FILLED = "CASE WHEN published <> '' THEN published WHEN updated <> '' THEN updated ELSE created END"
ARTICLES = f"""{FEED}, titled AS (
  SELECT *, row_number() OVER (PARTITION BY source_system ORDER BY position) AS kept
  FROM entries WHERE {stripped('title')} <> '' AND {stripped('link')} <> ''),
articles AS (
  SELECT {stripped('link')} AS url, {stripped('title')} AS headline,
         CASE source_system WHEN 'newsapi' THEN {fixed_ts('published')} ELSE {feed_date(FIRST_FILLED)} END AS timestamp,
         CASE source_system WHEN 'techcrunch' THEN 'TechCrunch'
           WHEN 'google_news' THEN coalesce(nullif(source_title, ''), 'google_news_ai')
           ELSE coalesce(nullif(source_title, ''), 'newsapi_tech') END AS source,
         CASE source_system WHEN 'newsapi' THEN {stripped('summary')} ELSE substring({snippet('summary')}, 1, 500) END AS snippet,
         CASE source_system WHEN 'techcrunch' THEN 'TechCrunch' WHEN 'google_news' THEN 'Google News RSS'
           ELSE 'NewsAPI Tech' END AS pipeline_source, position
  FROM titled WHERE CASE WHEN source_system = 'newsapi' THEN kept <= 50 ELSE position < 50 END)"""
ORACLE["normalize_feed"] = f"WITH {ARTICLES} SELECT * REPLACE (CAST(position AS INT) AS position) FROM articles"
ORACLE["articles_to_raw"] = f"""WITH {ARTICLES} SELECT pipeline_source AS source, {q(NOW)} AS fetched_at,
  headline, timestamp AS posted_at, source AS reporter, url FROM articles"""
ORACLE["load_lexicon"] = f"""WITH {RAW}, lx AS (SELECT * FROM (VALUES
    ('A', 'the', 'identity'), ('A', 'of the', 'partners'), ('A', 'der', 'competitors'),
    ('B', 'de la', 'identity'), ('B', 'x_y', 'partners'), ('B', 'und', 'partners'), ('B', 'in the', 'suppliers'))
    t(ticker, keyword, role)),
  normed AS (SELECT {norm('headline')} AS h FROM raw)
  SELECT ticker, keyword, role, (SELECT count(*) FROM normed WHERE {hit('h', 'keyword')}) AS n FROM lx"""

# --- projections and predicates
ORACLE["normalize_headline"] = f"WITH {RAW} SELECT ord, {norm('headline')} AS norm FROM raw"
ORACLE["contains_keyword"] = f"""WITH {RAW}, normed AS (SELECT *, {norm('headline')} AS h,
    CASE reporter WHEN 'en' THEN 'of the' WHEN 'fr' THEN 'la' ELSE '2.0' END AS kw FROM raw)
  SELECT ord, {hit('h', "'the'")} AS word, {hit('h', "'th th'")} AS phrase, {hit('h', "'by-nc'")} AS hyphen,
         false AS blank, {hit('h', 'kw')} AS by_lang FROM normed"""
ORACLE["ai_flag"] = f"WITH {MATCHED} SELECT ord, is_ai_related FROM flagged"
ORACLE["partnership_flag"] = f"""WITH {MATCHED}, rows4 AS (SELECT *, chr(CAST(65 + ord % 4 AS INT)) AS t FROM normed)
  SELECT ord, t AS ticker, EXISTS (SELECT 1 FROM lex WHERE lex.ticker = t AND partner AND {hit('h', 'kw')})
         AS is_proxy_partnership FROM rows4"""
ORACLE["ai_only_filter"] = f"WITH {MATCHED} SELECT ord, ticker FROM matched WHERE is_ai_related"
ORACLE["ticker_subset"] = f"WITH {PROCESSED} SELECT ord, ticker FROM processed WHERE ticker IN ({listed(TICKERS)})"
ORACLE["drop_missing_keys"] = f"""WITH {PROCESSED} SELECT ord, ticker, day AS date FROM processed
  WHERE ord % 10 <> 0 AND ord % 7 <> 0"""
ORACLE["null_score_triage"] = f"""WITH {PROCESSED} SELECT headline, min(ord) AS first_ord, count(*) AS null_rows
  FROM processed WHERE sentiment_llm_deepseek_r1 IS NULL GROUP BY headline ORDER BY first_ord LIMIT 10"""
ORACLE["null_score_count"] = f"""WITH {PROCESSED}
  SELECT count(*) FILTER (sentiment_llm_deepseek_r1 IS NULL) AS null_rows FROM processed"""
ORACLE["backfill_columns"] = """SELECT event_type AS source, '' AS fetched_at,
  CASE WHEN value > 50 THEN props ELSE '' END AS headline, '' AS posted_at, '' AS reporter, '' AS url FROM events"""
ORACLE["normalize_url"] = "SELECT page_id, rtrim(url, '/') AS url FROM pages"

# --- joins
for name in ("match_tickers", "match_tickers_token"):
    ORACLE[name] = f"WITH {MATCHED} SELECT ord, ticker, is_ai_related, is_proxy_partnership FROM matched"

ORACLE["match_tickers_many"] = f"""WITH {MATCHED}, kws AS (
    SELECT DISTINCT trim(substring(h, s, n)) AS kw FROM normed, (VALUES (1, 12), (13, 9), (40, 7)) c(s, n)),
  hits AS (SELECT ord, is_ai_related, kws.kw FROM flagged f
    JOIN (SELECT ord AS o, h AS txt FROM normed) t ON t.o = f.ord
    JOIN kws ON CASE WHEN kws.kw = '' OR NOT contains(txt, kws.kw) THEN false WHEN contains(kws.kw, ' ') THEN true
      WHEN NOT regexp_full_match(kws.kw, '[\\p{{L}}\\p{{N}}_]+') THEN false ELSE {hit('txt', 'kws.kw')} END)
  SELECT ord, left(kw, 1) AS ticker, is_ai_related, bool_or(length(kw) % 2 = 0) AS is_proxy_partnership
  FROM hits GROUP BY ALL"""


def balance(h: str) -> str:
    def total(terms: list[str]) -> str:
        return " + ".join(f"({hit(h, q(t))})::INT" for t in terms)

    return f"greatest(-1.0, least(1.0, (({total(POSITIVE)}) - ({total(NEGATIVE)})) / 4.0::DOUBLE))"


ORACLE["score_unique_join"] = f"""WITH {RAW}, normed AS (SELECT *, {norm('headline')} AS h FROM raw)
  SELECT ord, {r6(balance('h'), 'sentiment_finbert')},
         {r6('least(length(headline) / 20000.0::DOUBLE, 1.0)', 'sentiment_llm_phi3')} FROM normed"""
ORACLE["headline_tickers"] = f"""WITH {MATCHED}
  SELECT headline, string_agg(DISTINCT ticker, ',' ORDER BY ticker) AS tickers FROM matched GROUP BY headline"""
NOTED = f"""{MATCHED},
noted AS (
  SELECT m.headline, 'This news relates to ' || string_agg(c.context, '; ' ORDER BY m.ticker, c.pos)
         FILTER (c.context IS NOT NULL) || '.' AS context
  FROM (SELECT DISTINCT headline, ticker FROM matched) m
  LEFT JOIN ctx c ON c.ticker = m.ticker AND contains(lower({stripped('m.headline')}), c.kw)
  GROUP BY m.headline)"""
ORACLE["headline_context"] = f"WITH {NOTED} SELECT headline, context FROM noted"
ORACLE["headline_context_token"] = f"""WITH {MATCHED}
  SELECT ord, m.ticker, 'This news relates to ' || string_agg(c.context, '; ' ORDER BY c.pos)
         FILTER (c.context IS NOT NULL) || '.' AS context
  FROM matched m LEFT JOIN ctx c ON c.ticker = m.ticker AND contains(lower({stripped('m.headline')}), c.kw)
  GROUP BY ord, m.ticker"""
ORACLE["asof_forward"] = f"""WITH {DAILY}, {PRICES}
  SELECT d.ticker, d.date, headline_count, p.trade_date, p.close
  FROM daily d ASOF LEFT JOIN prices p ON d.ticker = p.ticker AND d.date <= p.trade_date"""
ORACLE["asof_forward_orders"] = f"""WITH {ORDER_PRICES}
  SELECT o_orderkey, p.trade_date, p.close FROM orders o
  ASOF LEFT JOIN prices p ON o.o_orderpriority = p.ticker AND CAST(o.o_orderdate AS DATE) <= p.trade_date"""
ORACLE["date_join_prices"] = f"""WITH {DAILY}, {PRICES}
  SELECT d.ticker, d.date, headline_count, p.trade_date, p.close
  FROM daily d LEFT JOIN prices p ON d.ticker = p.ticker AND d.date = p.trade_date"""

# --- aggregations
ORACLE["daily_sentiment"] = f"""WITH {DAILY} SELECT ticker, date, headline_count,
  {', '.join(r6(c) for c in AVERAGE_COLUMNS)} FROM daily"""
MEANS = ", ".join(r6(f"avg({c})", c) for c in SENTIMENT_COLUMNS)
ORACLE["ticker_summary"] = f"WITH {PROCESSED} SELECT ticker, count(headline) AS count, {MEANS} FROM processed GROUP BY ticker"
ORACLE["ticker_summary_ai"] = f"""WITH {PROCESSED} SELECT ticker, count(headline) AS count, {MEANS}
  FROM processed WHERE is_ai_related GROUP BY ticker"""
FEATURE_LIST = ["ticker", "date", "headline_count", *AVERAGE_COLUMNS, *DELTA_COLUMNS, "delta_sum", "delta_mean_signed", "llm_spread"]
ORACLE["null_audit"] = f"WITH {FEATURES} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM features" for c in FEATURE_LIST
)
GRID = AVERAGE_COLUMNS + RETURN_COLUMNS
ORACLE["corr_matrix"] = f"WITH {ALIGNED} " + " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, {r6(corr(x, y), 'r')} FROM aligned" for x in GRID for y in GRID
)
ORACLE["corr_by_ticker"] = f"WITH {ALIGNED}, wanted AS (SELECT unnest([{listed(TICKERS)}]) AS ticker) " + " UNION ALL ".join(
    f"SELECT w.ticker, '{s}' AS model, '{HORIZON_LABELS[r]}' AS horizon, {r6(corr(s, r), 'r')} "
    f"FROM wanted w LEFT JOIN aligned a ON a.ticker = w.ticker GROUP BY w.ticker"
    for s in AVERAGE_COLUMNS
    for r in RETURN_COLUMNS
)
ORACLE["corr_delta_block"] = f"WITH {ALIGNED} " + " UNION ALL ".join(
    f"SELECT '{HORIZON_LABELS[r]}' AS horizon, '{f}' AS feature, {r6(corr(f, r), 'r')} FROM aligned"
    for r in RETURN_COLUMNS
    for f in [*DELTA_COLUMNS, "delta_sum", "llm_spread"]
)
ORACLE["safe_corr"] = f"""SELECT l_returnflag, {r6(corr('l_quantity', 'l_extendedprice'), 'r')},
  CAST(NULL AS DOUBLE) AS r_constant FROM lineitem GROUP BY l_returnflag"""


def buckets(source: str, col: str) -> str:
    return f"""edges AS (SELECT quantile_cont({col}, [0.2, 0.4, 0.6, 0.8]) AS e FROM {source}),
bucketed AS (SELECT *, 1 + CAST(len(list_filter(e, lambda v: v < {col})) AS INT) AS quintile
  FROM {source}, edges WHERE {col} IS NOT NULL)"""


EXCESS_MEANS = ", ".join(r6(f"avg({c})", c) for c in EXCESS_COLUMNS)
ORACLE["quintile_excess"] = f"""WITH {DAILY_Q}, {buckets('daily_q', 'finbert_avg')}
  SELECT quintile, 'Q' || quintile AS label, {EXCESS_MEANS} FROM bucketed GROUP BY quintile"""
ORACLE["quintile_change"] = f"""WITH {DAILY_Q},
  changed AS (SELECT *, phi3_avg - lag(phi3_avg) OVER (PARTITION BY ticker ORDER BY date) AS change FROM daily_q),
  {buckets('changed', 'change')}
  SELECT quintile, 'Q' || quintile AS label, {EXCESS_MEANS} FROM bucketed GROUP BY quintile"""
ORACLE["quintile_lineitem"] = " UNION ALL ".join(
    f"""SELECT 'Q' || (1 + len(list_filter(e, lambda v: v < {col}))) AS label, '{name}' AS "of",
    {r6('avg(l_discount)', 'l_discount')} FROM lineitem,
    (SELECT quantile_cont({col}, [0.2, 0.4, 0.6, 0.8]) AS e FROM lineitem) GROUP BY label"""
    for name, col in (("price", "l_extendedprice"), ("quantity", "l_quantity"))
)


def hit_case(s: str, r: str) -> str:
    return f"CASE WHEN ({s} > 0 AND {r} > 0) OR ({s} < 0 AND {r} < 0) THEN 1 ELSE 0 END"


ORACLE["hit_rate_overall"] = f"WITH {DAILY_Q} " + " UNION ALL ".join(
    f"SELECT '{HORIZON_LABELS[r]}' AS horizon, {r6(f'avg({hit_case('finbert_avg', r)})', 'hit_rate')} FROM daily_q"
    for r in RETURN_COLUMNS
)
ORACLE["hit_rate_by_ticker"] = f"WITH {DAILY_Q}, wanted AS (SELECT unnest([{listed(TICKERS)}]) AS ticker) " + " UNION ALL ".join(
    f"SELECT w.ticker, '{s}' AS model, '{HORIZON_LABELS[r]}' AS horizon, "
    f"{r6(f'avg(CASE WHEN q.ticker IS NOT NULL THEN {hit_case(s, r)} END)', 'hit_rate')} "
    f"FROM wanted w LEFT JOIN daily_q q ON q.ticker = w.ticker GROUP BY w.ticker"
    for s in AVERAGE_COLUMNS
    for r in RETURN_COLUMNS
)
ORACLE["stage_counts"] = f"""WITH {MATCHED}
  SELECT 'matched' AS stage, count(*) AS rows FROM matched
  UNION ALL SELECT 'ai_related', count(*) FROM matched WHERE is_ai_related
  UNION ALL SELECT 'deduped', count(DISTINCT (posted_at, url, ticker)) FROM matched WHERE is_ai_related"""
ORACLE["source_counts"] = f"""WITH {RAW},
  kept AS ({first_rows('raw', f"reporter, posted_at[1:10], {norm('headline')}", 'ord')})
  SELECT source, count(*) AS rows_before,
         (SELECT count(*) FROM kept k WHERE k.source = raw.source) AS rows_after FROM raw GROUP BY source"""

# --- windows
ORACLE["ffill_by_ticker"] = f"""WITH {DAILY}, gappy AS (SELECT ticker, date, headline_count,
    {', '.join(f'CASE WHEN headline_count % 2 <> 1 THEN {c} END AS {c}' for c in AVERAGE_COLUMNS)} FROM daily),
  filled AS (SELECT ticker, date, headline_count, {fill(AVERAGE_COLUMNS)} FROM gappy)
  SELECT ticker, date, headline_count, {', '.join(r6(c) for c in AVERAGE_COLUMNS)} FROM filled"""
ORACLE["trailing_return"] = f"""WITH {ORDER_PRICES}, {RETURNS}
  SELECT ticker, trade_date, close, {r6('ret_eod')} FROM prices JOIN rets USING (ticker, trade_date)"""
ORACLE["forward_returns"] = f"""WITH {ORDER_PRICES}, {RETURNS} SELECT ticker, trade_date, close,
  {', '.join(r6(c) for c in RETURN_COLUMNS[1:])} FROM prices JOIN rets USING (ticker, trade_date)"""
ORACLE["market_excess"] = f"""WITH {DAILY_Q} SELECT ticker, date,
  {', '.join(r6(c) for c in ['market_avg', *EXCESS_COLUMNS])} FROM daily_q"""
ORACLE["sentiment_change"] = f"""WITH {DAILY} SELECT ticker, date,
  {r6('phi3_avg - lag(phi3_avg) OVER (PARTITION BY ticker ORDER BY date)', 'phi3_avg_change')} FROM daily"""
ORACLE["first_keep_dedup"] = first_rows(
    "lineitem", "l_partkey", "l_shipdate, l_orderkey, l_linenumber", "l_partkey, l_orderkey, l_linenumber"
)

# --- sorts, limits, sets
ORACLE["sort_raw"] = f"WITH {RAW} SELECT {RAW_LIST}, ord FROM raw ORDER BY posted_at, headline, ord"
ORACLE["sort_base"] = f"WITH {MATCHED} SELECT posted_at, url, ticker, ord FROM matched ORDER BY 1, 2, 3"
ORACLE["sort_daily"] = f"WITH {DAILY} SELECT ticker, date, headline_count FROM daily ORDER BY 1, 2"
ORACLE["limit_per_source"] = f"""WITH {RAW} SELECT source, ord FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS rn FROM raw) WHERE rn <= 10"""
ORACLE["union_all"] = f"""WITH {RAW} SELECT source, CASE part WHEN 1 THEN NULL ELSE reporter END AS reporter,
  CAST(part AS INT) AS part, ord FROM raw, range(3) t(part)"""
ORACLE["dedup_canonical"] = f"""WITH {RAW}
  {first_rows('raw', f"reporter, posted_at[1:10], {norm('headline')}", 'ord', 'ord, reporter, posted_at')}"""
ORACLE["dedup_headline_url"] = f"""WITH {RAW} {first_rows('raw', 'headline, url', 'ord', 'headline, url, reporter, ord')}"""
ORACLE["dedup_base"] = f"""WITH {MATCHED}, ai AS (SELECT * FROM matched WHERE is_ai_related)
  {first_rows('ai', 'posted_at, url, ticker', 'ord', 'posted_at, url, ticker, ord')}"""
ORACLE["dedup_headline"] = f"""WITH {PROCESSED}, chosen AS (SELECT * FROM processed WHERE ticker IN ({listed(TICKERS)}))
  {first_rows('chosen', 'headline', 'ord', 'headline, ticker, ord')}"""
ORACLE["distinct_ordered"] = f"WITH {RAW} SELECT headline, min(ord) AS first_ord FROM raw GROUP BY headline"

# --- row functions
ORACLE["parse_posted_at"] = f"""WITH {FEED} SELECT page_id,
  CASE WHEN page_id % 8 = 2 THEN published END AS posted_ts,
  CASE WHEN page_id % 8 = 2 THEN CAST(published[1:10] AS DATE) END AS date FROM entries"""
ORACLE["parse_feed_date"] = f"WITH {FEED} SELECT page_id, {feed_date('published')} AS parsed FROM entries"
ORACLE["normalize_ts"] = f"WITH {FEED} SELECT page_id, {fixed_ts('published')} AS normalized FROM entries"
ORACLE["file_date_key"] = """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL
  ELSE CAST(20240000 + event_id % 10000 AS VARCHAR) END AS day FROM events"""
ORACLE["strip_html_snippet"] = f"SELECT page_id, {snippet('html')} AS snippet FROM pages"
ORACLE["build_prompt"] = f"""WITH {NOTED} SELECT headline, CASE WHEN {stripped('headline')} <> '' THEN
  {q(PROMPT_HEAD)} || coalesce('Context: ' || context || chr(10) || chr(10), '') || 'Headline: "'
  || {stripped('headline')} || '"' || {q(PROMPT_TAIL)} END AS prompt FROM noted"""
ANSWER = """CASE WHEN conv_id % 9 = 0 THEN text ELSE text || chr(10) || 'Score: ' ||
  ((conv_id * 31 + turn * 17) % 7 - 3) || '.' || ((conv_id + turn) % 10) || '.' END"""
ORACLE["parse_score"] = f"""WITH found AS (SELECT conv_id, turn,
    TRY_CAST(list_last(regexp_extract_all({ANSWER}, '-?\\d+\\.?\\d*')) AS DOUBLE) AS v FROM conversations)
  SELECT conv_id, turn, round(CASE WHEN v > 1 THEN 1.0 WHEN v < -1 THEN -1.0 ELSE v END, 6) + 0.0 AS score FROM found"""
ORACLE["prob_score"] = f"""WITH parts AS (SELECT vec_id, exp(embedding[1]::DOUBLE) AS p, exp(embedding[2]::DOUBLE) AS n,
    list_sum([exp(v::DOUBLE) for v in embedding]) AS total FROM embeddings)
  SELECT vec_id, {r6('(p - n) / total', 'score')} FROM parts"""
ORACLE["model_deltas"] = f"""WITH {PROCESSED}, deltas AS (SELECT ord,
    {', '.join(f'{c} - sentiment_finbert AS {n}' for n, c in zip(DELTA_COLUMNS, SENTIMENT_COLUMNS[1:]))} FROM processed)
  SELECT ord, {', '.join(r6(c) for c in DELTA_COLUMNS)},
         {r6('abs(phi_delta) + abs(llama_delta) + abs(deepseek_delta)', 'delta_sum')},
         {r6('(phi_delta + llama_delta + deepseek_delta) / 3', 'delta_mean_signed')} FROM deltas"""
LLM_LIST = f"[{', '.join(SENTIMENT_COLUMNS[1:])}]"
ORACLE["llm_spread"] = f"WITH {PROCESSED} SELECT ord, {r6(f'list_stddev_samp({LLM_LIST})', 'llm_spread')} FROM processed"
ORACLE["daily_features"] = f"""WITH {FEATURES} SELECT ticker, date,
  {', '.join(r6(c) for c in [*DELTA_COLUMNS, 'delta_sum', 'delta_mean_signed', 'llm_spread'])} FROM features"""
ORACLE["row_mean"] = f"WITH {PROCESSED} SELECT ord, {r6(f'list_avg({LLM_LIST})', 'row_mean')} FROM processed"
CONTRARIAN = f"""{PROCESSED}, chosen AS (SELECT * FROM processed WHERE ticker IN ({listed(TICKERS)})),
kept AS ({first_rows('chosen', 'headline', 'ord')}),
contrarian AS (SELECT ord, headline FROM kept WHERE NOT coalesce(
  sign(sentiment_llm_deepseek_r1) = sign(list_avg([{', '.join(SENTIMENT_COLUMNS[:3])}])), false))"""
ORACLE["contrarian_rows"] = f"WITH {CONTRARIAN} SELECT ord, headline FROM contrarian"
ORACLE["contrarian_topn"] = f"WITH {CONTRARIAN} SELECT ord, headline FROM contrarian ORDER BY ord LIMIT 3"
S, R = "sentiment_llm_phi3", "sentiment_llm_llama3_2"
ORACLE["hit_flag"] = f"""WITH {PROCESSED} SELECT ord, {hit_case(S, R)} AS hit,
  CASE WHEN {S} IS NOT NULL AND {R} IS NOT NULL THEN {hit_case(S, R)} END AS strict_hit FROM processed"""
ORACLE["quintile_label"] = "SELECT event_id, 'Q' || (event_id % 5 + 1) AS label FROM events"
ORACLE["bool_to_int"] = f"""WITH {PROCESSED}
  SELECT ord, CASE WHEN ord % 4 <> 0 THEN CAST(is_ai_related AS INT) END AS flag FROM processed"""

# --- reshape
ORACLE["melt_models"] = f"WITH {PROCESSED} " + " UNION ALL ".join(
    f"SELECT ticker, '{c}' AS model, {r6(f'avg({c})', 'value')} FROM processed WHERE is_ai_related GROUP BY ticker"
    for c in SENTIMENT_COLUMNS
)
ORACLE["horizon_relabel"] = f"WITH {ORDER_PRICES}, {RETURNS} SELECT ticker, trade_date, " + ", ".join(
    f'round({c}, 6) + 0.0 AS "{HORIZON_LABELS[c]}"' for c in RETURN_COLUMNS
) + " FROM rets"

# --- scoring
ORACLE["lexicon_scorer"] = f"""WITH {RAW}, normed AS (SELECT ord, {norm('headline')} AS h FROM raw)
  SELECT ord, {r6(balance('h'), 'score')} FROM normed"""
PROMPT_CHARS = len(PROMPT_HEAD) + len('Headline: ""') + len(PROMPT_TAIL)
ORACLE["score_backends"] = f"""WITH sized AS (
    SELECT DISTINCT text AS headline, length(text) AS n, length({stripped('text')}) AS m FROM documents),
  logits AS (SELECT *, exp((m % 7) / 7.0::DOUBLE) AS p, exp((m % 5) / 5.0::DOUBLE) AS g, exp(0.25::DOUBLE) AS z,
    ((m + {PROMPT_CHARS}) * 53) % 7 - 3 AS a FROM sized)
  SELECT headline, {r6('(p - g) / (p + g + z)', 'sentiment_finbert')},
    CASE WHEN a >= 1 THEN 1.0 WHEN a = 0 THEN 0.5 ELSE -1.0 END::DOUBLE AS sentiment_llm_phi3,
    CASE WHEN n >= 100 THEN round(((n * 37) % 201 - 100) / 100.0::DOUBLE, 6) + 0.0 END AS sentiment_llm_llama3_2
  FROM logits"""

# --- streaming
ORACLE["stream_ingest_headlines"] = f"WITH {RAW} SELECT DISTINCT headline, url FROM raw"
ORACLE["stream_match_upsert"] = f"""WITH {MATCHED}
  SELECT DISTINCT headline, url, ticker, CAST(is_proxy_partnership AS INT) AS is_proxy_partnership
  FROM matched WHERE is_ai_related"""

# --- whole jobs
BASE = f"""{MATCHED}, ai AS (SELECT * FROM matched WHERE is_ai_related),
base AS ({first_rows('ai', 'posted_at, url, ticker', 'ord')})"""
BASE_LIST = "posted_at, fetched_at, headline, url, source, reporter, ticker, is_ai_related, is_proxy_partnership"
ORACLE["base_data_plan"] = f"WITH {BASE} SELECT {BASE_LIST} FROM base"
ORACLE["process_plan"] = f"""WITH {BASE}, normed2 AS (SELECT *, {norm('headline')} AS nh FROM base)
  SELECT {BASE_LIST}, {r6(balance('nh'), 'sentiment_finbert')} FROM normed2"""
ORACLE["daily_ai_sentiment"] = f"""WITH {BASE}, normed2 AS (SELECT *, {norm('headline')} AS nh FROM base)
  SELECT ticker, CAST(posted_at[1:10] AS DATE) AS date, count(headline) AS headline_count,
         {r6(f"avg({balance('nh')})", 'score_avg')} FROM normed2 GROUP BY ALL"""
