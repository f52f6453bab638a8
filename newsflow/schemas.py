"""Declared schemas of the stored tables.  Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _TS, _D, _B, _I, _L = (
    T.StringType(), T.TimestampType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.LongType(),
)


def _table(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns])


METADATA = _table(("stock_code", T.ArrayType(_S)))

RAW_NEWS = _table(
    ("raw_id", _S), ("source_name", _S), ("source_url", _S), ("title", _S), ("body", _S),
    ("published_at", _TS), ("created_at", _TS), ("raw_hash", _S), ("extra_metadata", METADATA),
    ("is_deleted", _B), ("deleted_reason", _S),
)

CLEANED_NEWS = _table(
    ("cleaned_id", _S), ("raw_id", _S), ("title_cleaned", _S), ("body_cleaned", _S), ("created_at", _TS),
)

CRAWL_ERROR_LOG = _table(
    ("error_id", _S), ("execution_id", _S), ("source_name", _S), ("url", _S), ("error_type", _S),
    ("error_code", _S), ("attempt_count", _I), ("created_at", _TS),
)

ENTITY_EVENTS = _table(
    ("entity_event_id", _S), ("exchange", _S), ("source_url", _S), ("source_name", _S),
    ("published_at", _TS), ("stock_code", _S), ("event_type_primary", _S), ("event_type_secondary", _S),
    ("sentiment_label", _S), ("sentiment_score", _D), ("headline", _S), ("entity_summary", _S),
    ("created_at", _TS),
)

SOURCE_ENTRY = _table(("source_name", _S), ("url", _S), ("published_at", _TS))

EVENTS = _table(
    ("event_id", _S), ("exchange", _S), ("stock_code", _S), ("event_type_primary", _S),
    ("event_type_secondary", T.ArrayType(_S)), ("source_count", _L), ("source_list", T.ArrayType(SOURCE_ENTRY)),
    ("first_seen_at", _TS), ("last_seen_at", _TS), ("aggregation_updated_at", _TS),
)

EVENT_ENTITY_MAP = _table(("event_id", _S), ("entity_event_id", _S), ("created_at", _TS))

RULE_DETAIL = _table(
    ("event_type_score", _D), ("source_authority_score", _D),
    ("sentiment_strength_score", _D), ("source_heat_score", _D),
)

EVENT_SCORES = _table(
    ("event_id", _S), ("abs_final_score", _D), ("base_rule_score", _D), ("stock_impact_score", _D),
    ("llm_fallback", _B), ("rule_score_detail", RULE_DETAIL), ("scored_at", _TS),
)

DATA_SOURCES = _table(("source_name", _S), ("authority_weight", _D), ("is_active", _B))

STOCK_MASTER = _table(("stock_code", _S), ("company_name_zh", _S), ("company_name_en", _S), ("sector", _S))

FEED_ITEM = _table(("title", _S), ("link", _S), ("pubDate", _S))

LLM_CALL = _table(
    ("call_index", _I), ("purpose", _S), ("input_tokens", _L), ("output_tokens", _L),
    ("latency_ms", _L), ("instructor_retries", _I),
)
LLM_ERROR = _table(("call_index", _I), ("error_type", _S), ("error_detail", _S), ("retried", _B))

SKILL_LOG = _table(
    ("event", _S), ("entity_event_id", _S), ("event_id", _S), ("skill_version", _S), ("fallback", _B),
    ("fallback_reason", _S), ("input_from_fallback", _B),
    ("fc_summary", _table(("rounds", _I), ("max_rounds_reached", _B))),
    ("llm_calls", T.ArrayType(LLM_CALL)), ("llm_errors", T.ArrayType(LLM_ERROR)), ("timestamp", _TS),
)
