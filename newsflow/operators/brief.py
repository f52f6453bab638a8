"""The ranked brief: summary inputs, incremental merge, order and watchlist selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsflow import params
from newsflow.functions import stocks as stock_fn
from newsflow.functions import text
from newsflow.operators.ranges import ranked


def latest_per_source(members: DataFrame, limit: int = params.PER_SOURCE_ARTICLES) -> DataFrame:
    """At most ``limit`` latest articles of each (event, source).

    The rank filter is applied inside each partition before the shuffle, so a hot event sends
    at most ``limit`` rows per source and partition.
    """
    order = W.partitionBy("event_id", "source_name").orderBy(F.col("at").desc(), "entity_event_id")
    return members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def within_budget(entries: DataFrame, budget: int = params.SUMMARY_BUDGET) -> DataFrame:
    """Summaries of each event that fit the character budget.

    Ordered by authority, then latest.  An entry that would overflow is skipped and later ones
    are still tried, so this is a fold, not a prefix sum.  The array holds the capped entries
    of one event: a few per source.
    """
    entry = F.struct(
        (-F.col("weight")).alias("a"), (-F.col("at")).alias("b"), F.col("entity_event_id").alias("id"),
        "source_name", text.or_empty(F.col("entity_summary")).alias("summary"),
    )
    ordered = F.array_sort(F.collect_list(entry))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"), F.lit(0).alias("skipped"))
    step = lambda s, e: F.when(
        s["used"] + F.length(e["summary"]) <= budget,
        F.struct(
            (s["used"] + F.length(e["summary"])).alias("used"),
            F.concat(s["kept"], F.array(F.concat(F.lit("["), e["source_name"], F.lit("] "), e["summary"]))).alias("kept"),
            s["skipped"].alias("skipped"),
        ),
    ).otherwise(F.struct(s["used"].alias("used"), s["kept"].alias("kept"), (s["skipped"] + 1).alias("skipped")))
    return (
        entries.groupBy("event_id")
        .agg(F.aggregate(ordered, start, step).alias("_b"), F.count(F.lit(1)).alias("entry_count"))
        .select(
            "event_id", "entry_count",
            F.col("_b.kept").alias("summaries"), F.col("_b.used").alias("total_chars"),
            (F.col("_b.skipped") > 0).alias("truncated_by_char_cap"),
        )
    )


def fallback_headline(members: DataFrame) -> DataFrame:
    """Headline of the member with the greatest authority, then the latest, then by identifier."""
    best = F.max_by("headline", F.struct("weight", "at", "entity_event_id"))
    return members.groupBy("event_id").agg(best.alias("headline"))


def fallback_brief(headline: Column) -> Column:
    short = text.truncate(text.or_empty(headline), params.TEXT_LIMITS["summary_short"])
    return F.struct(
        short.alias("summary_short"), short.alias("summary_full"), F.array().cast("array<string>").alias("key_numbers")
    )


def checked_brief(short: Column, full: Column, numbers: Column) -> Column:
    """A supplied brief cut to its limits, with a flag when anything was cut."""
    limits, most = params.TEXT_LIMITS, params.KEY_NUMBERS_MAX
    return F.struct(
        text.truncate(short, limits["summary_short"]).alias("summary_short"),
        text.truncate(full, limits["summary_full"]).alias("summary_full"),
        F.slice(numbers, 1, most).alias("key_numbers"),
        (text.exceeds(short, limits["summary_short"]) | text.exceeds(full, limits["summary_full"])
         | F.coalesce(F.size(numbers) > most, F.lit(False))).alias("violation"),
    )


def above_noise(scored: DataFrame, floor: float = params.NOISE_FLOOR) -> DataFrame:
    return scored.where(F.col("final_abs_final_score") >= floor)


def merge_actions(cached: DataFrame, updated: DataFrame, floor: float = params.NOISE_FLOOR) -> DataFrame:
    """(event_id, action) for every updated event: replace, insert, remove or ignore."""
    keep = F.col("final_abs_final_score") >= floor
    in_cache = F.col("_cached").isNotNull()
    action = (
        F.when(keep & in_cache, "replace").when(keep, "insert").when(in_cache, "remove").otherwise("ignore")
    )
    known = cached.select("event_id", F.lit(True).alias("_cached"))
    return updated.select("event_id", "final_abs_final_score").join(known, "event_id", "left").select(
        "event_id", action.alias("action")
    )


def merge_cache(cached: DataFrame, updated: DataFrame, floor: float = params.NOISE_FLOOR) -> DataFrame:
    """Cached rows untouched by the update, plus the updated rows above the floor."""
    untouched = cached.join(updated.select("event_id"), "event_id", "left_anti")
    return untouched.unionByName(above_noise(updated, floor))


def order() -> list[Column]:
    """Total order of the brief."""
    return [
        F.col("final_abs_final_score").desc(), F.col("final_base_rule_score").desc(),
        F.col("last_seen_at").desc(), F.col("first_seen_at").asc(), F.col("event_id").asc(),
    ]


def ordered(scored: DataFrame) -> DataFrame:
    return scored.orderBy(*order())


def ranked_brief(scored: DataFrame, *columns: str) -> DataFrame:
    """The whole brief with its rank, ranked range by range.

    Only the columns of the order and ``columns`` (all if none are named) are moved.
    """
    needed = ["event_id", "final_abs_final_score", "final_base_rule_score", "last_seen_at", "first_seen_at"]
    rows = above_noise(scored)
    return ranked(rows.select(*dict.fromkeys([*needed, *columns])) if columns else rows, order())


def check_request(codes: list[str], k: int) -> None:
    if not codes:
        raise ValueError("at least one stock code is required")
    if not 1 <= k <= params.TOP_K_MAX:
        raise ValueError(f"k must be between 1 and {params.TOP_K_MAX}, got {k}")


def watchlist(scored: DataFrame, codes: list[str], k: int = params.TOP_K_DEFAULT) -> DataFrame:
    """Watchlist events first, best others until ``k``; one distributed top-k, no full sort.

    ``rank`` is the selection order, ``position`` the order by score in which they are shown.
    """
    check_request(codes, k)
    wanted = F.array(*[stock_fn.standardise(F.lit(c)) for c in codes])
    chosen = (
        scored.withColumn("is_match", F.coalesce(F.array_contains(wanted, F.col("stock_code")), F.lit(False)))
        .orderBy(F.col("is_match").desc(), *order())
        .limit(k)
    )
    # At most 50 rows are left here.
    return chosen.withColumn(
        "rank", F.row_number().over(W.orderBy(F.col("is_match").desc(), *order()))
    ).withColumn("position", F.row_number().over(W.orderBy(*order())))


def response(rows: DataFrame) -> DataFrame:
    """Scored events in their nested serving shape."""
    return rows.select(
        "event_id", "exchange", "stock_code", "event_type_primary",
        F.col("final_abs_final_score").alias("abs_final_score"),
        F.col("final_base_rule_score").alias("base_rule_score"),
        "first_seen_at", "last_seen_at",
        F.struct(
            "event_type_secondary", "source_count", "source_list",
            F.col("brief.summary_short").alias("summary_short"),
            F.col("brief.summary_full").alias("summary_full"),
            F.col("brief.key_numbers").alias("key_numbers"),
        ).alias("event"),
        F.struct(
            "stock_impact_score", "llm_fallback",
            F.struct(
                "event_type_score", "source_authority_score", "sentiment_strength_score", "source_heat_score"
            ).alias("rule_score_detail"),
            F.struct("adjustment_reason", F.lit("v1.0.0").alias("score_version"), "scored_at").alias("llm_score_detail"),
        ).alias("score"),
        *[c for c in ("is_match", "rank", "position") if c in rows.columns],
    )
