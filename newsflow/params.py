"""Fixed values and defaults.  Everything here can be overridden by argument."""

from __future__ import annotations

# --- fixed values: names of news sources and their seeded authority weights ---
SOURCE_AUTHORITY = {"HKEX": 9.0, "MINGPAO": 9.0, "AASTOCKS": 6.0, "YAHOO_HK": 6.0}
# --- fixed values: authority by priority class, used when a source has no weight ---
DEFAULT_AUTHORITY = {"P1": 9.0, "P2": 6.0, "P3": 4.0}

# --- fixed values: enumerations ---
EVENT_TYPES = [
    "EARNINGS", "BUYBACK", "MA", "REGULATORY", "MANAGEMENT_CHANGE",
    "ANALYST_RATING", "DIVIDEND", "GENERAL_ANNOUNCEMENT",
]
SECTORS = [
    "TECHNOLOGY", "FINANCIALS", "HEALTHCARE", "CONSUMER",
    "ENERGY", "PROPERTY", "UTILITIES", "INDUSTRIALS",
]
SENTIMENT_SIGN = {"POSITIVE": 1, "NEUTRAL": 0, "NEGATIVE": -1}

# --- fixed values: reject reasons and outcomes ---
EMPTY_FIELD = "EMPTY_FIELD"
BODY_TOO_SHORT = "BODY_TOO_SHORT"
DUPLICATE_TITLE = "DUPLICATE_TITLE"
NO_PDF_LINK = "no_pdf_link"
NO_HREF = "no_href"
ROW_OK = "ok"

# --- fixed values: failure catalogue (numeric part; the service prefix is an argument) ---
FAILURES = [
    # failure          type     code
    ("fetch_failed",   "CRAWL", "6101"),
    ("browser_failed", "CRAWL", "6104"),
    ("parse_error",    "PARSE", "6201"),
    ("pdf_encrypted",  "PARSE", "6202"),
    ("pdf_unreadable", "PARSE", "6203"),
]

# --- fixed values: addresses and selectors of the four sources ---
YAHOO_ARTICLE_MARK = "hk.finance.yahoo.com/news/"
AASTOCKS_ARTICLE_MARK = "/aafn-con/NOW."
AASTOCKS_BASE = "https://www.aastocks.com"
HKEX_BASE = "https://www1.hkexnews.hk"

# --- fixed values: cleaning, merging, scoring and serving parameters ---
BODY_MIN_LENGTH = 50
WINDOW_HOURS = 4.0
MAX_SPAN_HOURS = 24.0
SENTIMENT_THRESHOLD = 0.1
RULE_WEIGHT = 0.67
IMPACT_WEIGHT = 0.33 * 2
RECENCY_WEIGHT = 0.20
RECENCY_DECAY = 0.1
NOISE_FLOOR = 3.0
TOP_K_DEFAULT = 20
TOP_K_MAX = 50
LOOKUP_MAX_IDS = 50
PER_SOURCE_ARTICLES = 3
SUMMARY_BUDGET = 200
MAX_DELIVERIES = 3
CHINESE_RATIO = 0.3

# --- fixed values: text limits in code points ---
TEXT_LIMITS = {
    "headline": 20,
    "entity_summary": 100,
    "summary_short": 30,
    "summary_full": 150,
    "adjustment_reason": 80,
}
KEY_NUMBERS_MAX = 3
SECONDARY_TYPES_MAX = 2

# Event-type scores: EARNINGS, REGULATORY and GENERAL_ANNOUNCEMENT are given values,
# the others are our own defaults.  So are the weights below, except type and recency.
EVENT_TYPE_SCORE = {
    "EARNINGS": 9.0, "REGULATORY": 8.0, "GENERAL_ANNOUNCEMENT": 4.0,
    "MA": 8.0, "MANAGEMENT_CHANGE": 7.0, "BUYBACK": 6.0, "ANALYST_RATING": 6.0, "DIVIDEND": 6.0,
}
UNKNOWN_TYPE_SCORE = 4.0
DIMENSION_WEIGHT = {"event_type": 0.30, "authority": 0.20, "sentiment": 0.15, "heat": 0.15}
SENTIMENT_SCALE = 10.0
HEAT_PER_SOURCE = 2.0
HEAT_MAX = 10.0

# Largest dimension table, in rows, for which a broadcast is asked for.  Beyond it the
# same equi-join is left to the optimiser, which shuffles both sides.
BROADCAST_MAX_ROWS = 100_000

# Bytes of an Arrow batch between the JVM and Python, about.
ARROW_BATCH_BYTES = 4 << 20
