"""Common table expressions of the comparison SQL (DuckDB dialect)."""

from newsflow import params
from newsflow.functions.text import WHITE_SPACE

EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"


def norm(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WHITE_SPACE}+', ' ', 'g'))"


def strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '\\A{WHITE_SPACE}+', ''), '{WHITE_SPACE}+\\z', '')"


def stamp(at: str) -> str:
    return f"strftime({at}, '%Y-%m-%d %H:%M:%S')"


def exact(at: str) -> str:
    return f"strftime({at}, '%Y-%m-%d %H:%M:%S.%f')"


def listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


RAW = f"""raw AS (
  SELECT CAST(doc_id AS VARCHAR) AS raw_id, doc_id, source AS source_name,
    source || '/' || CAST(n_chars AS VARCHAR) AS source_url,
    regexp_extract(text, '^([^.\\n]*)', 1) AS title, text AS body,
    CASE WHEN doc_id % 7 <> 0 THEN {EPOCH} + to_minutes(doc_id - doc_id % 90) END AS published_at,
    {EPOCH} + to_minutes(doc_id) AS created_at,
    sha256({norm("regexp_extract(text, '^([^.' || chr(10) || ']*)', 1)")}) AS raw_hash
  FROM documents)"""

ASSESSED = f"""assessed AS (
  SELECT *, {norm('title')} AS title_cleaned, {norm('body')} AS body_cleaned,
    CASE WHEN title = '' OR body = '' THEN 'EMPTY_FIELD'
         WHEN length({norm('body')}) < {params.BODY_MIN_LENGTH} THEN 'BODY_TOO_SHORT' END AS reject_reason
  FROM raw)"""



def first_accepted(table: str) -> str:
    """The sequential rule itself: one row at a time, with the keys taken so far."""
    return f"""arriving AS (SELECT raw_id, source_url, raw_hash, row_number() OVER (ORDER BY created_at, raw_id) AS n FROM {table}),
taken(n, ids, urls, hashes) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
  UNION ALL
  SELECT n, CASE WHEN ok THEN list_append(ids, raw_id) ELSE ids END,
    CASE WHEN ok THEN list_append(urls, source_url) ELSE urls END,
    CASE WHEN ok THEN list_append(hashes, raw_hash) ELSE hashes END
  FROM (SELECT b.n, b.raw_id, b.source_url, b.raw_hash, t.ids, t.urls, t.hashes,
          NOT list_contains(t.urls, b.source_url) AND NOT list_contains(t.hashes, b.raw_hash) AS ok
        FROM taken t JOIN arriving b ON b.n = t.n + 1) x),
accepted AS (SELECT unnest(ids) AS raw_id FROM taken WHERE n = (SELECT max(n) FROM arriving))"""


REPORTS = f"""reports AS (
  SELECT CAST(event_id AS VARCHAR) AS entity_event_id, event_id AS eid, 'HKEX' AS exchange,
    'https://news.example/' || event_id AS source_url,
    {listed(params.SOURCE_AUTHORITY)}[event_id % 4 + 1] AS source_name,
    CASE WHEN event_id % 11 <> 0 THEN ts END AS published_at,
    lpad(CAST(user_id % 50 AS VARCHAR), 5, '0') || '.HK' AS stock_code,
    CASE event_type WHEN 'purchase' THEN 'EARNINGS' WHEN 'error' THEN 'REGULATORY'
      WHEN 'signup' THEN 'MANAGEMENT_CHANGE' WHEN 'view' THEN 'ANALYST_RATING'
      WHEN 'click' THEN 'GENERAL_ANNOUNCEMENT' END AS event_type_primary,
    CASE WHEN event_id % 3 <> 0 THEN {listed(params.EVENT_TYPES)}[(event_id * 5) % 8 + 1] END AS event_type_secondary,
    ['POSITIVE', 'NEGATIVE', 'NEUTRAL'][event_id % 3 + 1] AS sentiment_label,
    [1, -1, 0][event_id % 3 + 1] AS sign,
    (CAST(round(value * 100) AS BIGINT) % 100 + 100) % 100 / 100.0 AS sentiment_score,
    event_type || ' ' || event_id AS headline,
    left(repeat(event_type || ' ' || props || ' ', CAST(event_id % 9 + 1 AS INT)), 100) AS entity_summary,
    ts + to_seconds(event_id % 60) AS created_at,
    epoch_us(CASE WHEN event_id % 11 <> 0 THEN ts ELSE ts + to_seconds(event_id % 60) END) AS us
  FROM events)"""

_ONE_KEY = "CASE WHEN eid % 3 = 0 THEN '00001.HK' ELSE stock_code END AS stock_code, CASE WHEN eid % 3 = 0 THEN 'EARNINGS' ELSE event_type_primary END AS event_type_primary"


def _changed_reports(changes: str) -> str:
    return f"{REPORTS.replace('reports AS', 'plain_reports AS', 1)}, reports AS (SELECT * REPLACE ({changes}) FROM plain_reports)"


HOT_REPORTS = _changed_reports(_ONE_KEY)
# thirty days of one key become half a minute
BURST_REPORTS = _changed_reports(f"{_ONE_KEY}, CASE WHEN eid % 3 = 0 THEN epoch_us({EPOCH}) + (us - epoch_us({EPOCH})) // 86400 ELSE us END AS us")

KEY = "exchange, stock_code, event_type_primary"


def merged(window_hours: float, cap_hours: float) -> str:
    """Sessions by gap, then openings one after the other within each session."""
    window, cap = int(window_hours * 3_600_000_000), int(cap_hours * 3_600_000_000)
    return f"""gaps AS (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY {KEY} ORDER BY us, eid) <= {window} THEN 0 ELSE 1 END AS begins FROM reports),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY {KEY} ORDER BY us, eid ROWS UNBOUNDED PRECEDING) AS sno FROM gaps),
sessioned AS (SELECT *, min(us) OVER (PARTITION BY {KEY}, sno) AS session_start FROM numbered),
lists AS (SELECT {KEY}, session_start, list_sort(list(DISTINCT us)) AS ats FROM sessioned GROUP BY ALL),
chain({KEY}, session_start, ats, opening) AS (
  SELECT {KEY}, session_start, ats, session_start FROM lists
  UNION ALL
  SELECT {KEY}, session_start, ats, nxt FROM (
    SELECT *, list_min(list_filter(ats, lambda x: x >= opening + {cap})) AS nxt FROM chain) t
  WHERE nxt IS NOT NULL),
merged AS MATERIALIZED (
  SELECT s.*, c.opening AS first, sha256(concat_ws(chr(1), s.exchange, s.stock_code, s.event_type_primary, CAST(c.opening AS VARCHAR))) AS event_id
  FROM sessioned s ASOF JOIN (SELECT {KEY}, session_start, opening FROM chain) c
    ON s.exchange = c.exchange AND s.stock_code = c.stock_code AND s.event_type_primary = c.event_type_primary
   AND s.session_start = c.session_start AND s.us >= c.opening)"""


AUTHORITY = f"""authority(source_name, w) AS (VALUES {', '.join(f"('{n}', {w}e0)" for n, w in params.SOURCE_AUTHORITY.items() if n != 'YAHOO_HK')})"""

EVENT_ROWS = f"""by_source AS MATERIALIZED (
  SELECT event_id, {KEY}, source_name, count(*) AS articles, min(us) AS first_at, max(us) AS last_at,
    arg_min(source_url, (us, source_url)) AS first_url, count(sentiment_score) AS scored,
    CAST(sum(CAST(sentiment_score * sign AS DECIMAL(20, 10))) AS DOUBLE) AS signed_sum, CAST(sum(CAST(sentiment_score AS DECIMAL(20, 10))) AS DOUBLE) AS strength_sum
  FROM merged GROUP BY ALL),
weighted AS (SELECT b.*, coalesce(a.w, {params.DEFAULT_AUTHORITY['P3']}e0) AS weight FROM by_source b LEFT JOIN authority a USING (source_name)),
sentiment AS (
  SELECT event_id, CAST(sum(CAST(weight * signed_sum AS DECIMAL(30, 10))) AS DOUBLE) / CAST(sum(CAST(weight * scored AS DECIMAL(30, 10))) AS DOUBLE) AS weighted_sentiment,
    CAST(sum(CAST(weight * strength_sum AS DECIMAL(30, 10))) AS DOUBLE) / CAST(sum(CAST(weight * scored AS DECIMAL(30, 10))) AS DOUBLE) AS sentiment_strength, max(weight) AS authority
  FROM weighted GROUP BY event_id),
labelled AS (SELECT *, CASE WHEN weighted_sentiment > 0.1 THEN 'POSITIVE' WHEN weighted_sentiment < -0.1 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment_label FROM sentiment),
event_rows AS MATERIALIZED (
  SELECT event_id, {KEY}, count(*) AS source_count, sum(articles) AS article_count, min(first_at) AS first_us, max(last_at) AS last_us
  FROM by_source GROUP BY ALL)"""

_TYPE_CASE = " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in params.EVENT_TYPE_SCORE.items())
_W = params.DIMENSION_WEIGHT

# Impact exists for two events of three, without a reason for one of five of those.
SCORED = f"""impact AS (
  SELECT event_id, (first_us // 1000000 % 13) - 6e0 AS imp FROM event_rows
  WHERE first_us // 1000000 % 3 <> 0 AND first_us // 1000000 % 5 <> 0),
ruled AS (
  SELECT e.*, l.weighted_sentiment, l.sentiment_strength, l.authority, l.sentiment_label,
    CASE event_type_primary {_TYPE_CASE} ELSE {params.UNKNOWN_TYPE_SCORE}e0 END AS event_type_score,
    l.sentiment_strength * 10 AS sentiment_strength_score, least(10e0, 2e0 * source_count) AS source_heat_score
  FROM event_rows e JOIN labelled l USING (event_id)),
based AS (
  SELECT *, event_type_score * {_W['event_type']}e0 + authority * {_W['authority']}e0 + sentiment_strength_score * {_W['sentiment']}e0
    + source_heat_score * {_W['heat']}e0 AS base_rule_score FROM ruled),
fused AS MATERIALIZED (
  SELECT b.*, CASE WHEN i.imp IS NULL THEN 0e0 ELSE greatest(-5e0, least(5e0, i.imp)) END AS stock_impact_score, i.imp IS NULL AS llm_fallback,
    CASE WHEN coalesce(i.imp, 0) > 0 THEN 1 WHEN coalesce(i.imp, 0) < 0 THEN -1
      WHEN sentiment_label = 'POSITIVE' THEN 1 WHEN sentiment_label = 'NEGATIVE' THEN -1 ELSE 0 END AS direction
  FROM based b LEFT JOIN impact i USING (event_id)),
scored AS (
  SELECT *, abs(base_rule_score * direction * 0.67e0 + stock_impact_score * 0.66e0) AS abs_final_score,
    10 * exp(-0.1e0 * (1706659200000000 - last_us) / 3600000000e0) AS recency_score FROM fused),
final AS MATERIALIZED (
  SELECT *, base_rule_score + recency_score * 0.2e0 AS final_base,
    abs((base_rule_score + recency_score * 0.2e0) * direction * 0.67e0 + stock_impact_score * 0.66e0) AS final_abs FROM scored)"""


def event_chain(window: float = params.WINDOW_HOURS, cap: float = params.MAX_SPAN_HOURS, reports: str = REPORTS) -> str:
    return f"WITH RECURSIVE {reports}, {merged(window, cap)}"


def scored_chain(window: float = params.WINDOW_HOURS, cap: float = params.MAX_SPAN_HOURS) -> str:
    return f"{event_chain(window, cap)}, {AUTHORITY}, {EVENT_ROWS}, {SCORED}"
