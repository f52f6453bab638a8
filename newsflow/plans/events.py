"""Queries on event merging, roll-up, scores and the brief."""

import uuid

from pyspark.sql import functions as F

from newsflow import params
from newsflow.functions import scores
from newsflow.operators import brief, dedup, merging, rollup, scoring
from newsflow.operators.merging import KEY, Span
from newsflow.plans import sql_parts as sp
from newsflow.plans.registry import exact, r6, register, stamp
from newsflow.session import materialise, shared_dir, small
from newsflow.sources import driver_tables as dt
from newsflow.sources import tables
from newsflow.sources.buckets import Buckets

AS_OF = "2024-01-31 00:00:00"
WATCHLIST = ["00007", "9", "00021.HK"]
_AS_OF = lambda: F.lit(AS_OF).cast("timestamp")


# --- reusable steps ------------------------------------------------------------------------


def merged_reports(spark, sf, window=params.WINDOW_HOURS, cap=params.MAX_SPAN_HOURS):
    return merging.merge(dt.events_as_reports(spark, sf), Span.hours(window, cap))


def impact_of(event_rows):
    """Impact for two events of three, without a reason for one of five."""
    second = F.floor(F.unix_micros("first_seen_at") / 1_000_000)
    return event_rows.where(second % 3 != 0).select(
        "event_id", (second % 13 - 6.0).alias("stock_impact_score"),
        F.when(second % 5 == 0, " ").otherwise("reason").alias("adjustment_reason"),
    )


def score_events(by_source, sources):
    """Per-source rows to scored events; an event's version is the time of its last report."""
    event_rows = materialise(rollup.events_with_sentiment(rollup.with_authority(by_source, sources)), "event-rows")
    event_rows = event_rows.withColumn("aggregation_updated_at", F.col("last_seen_at"))
    ruled = scoring.rule_scores(event_rows, None)
    return scoring.fuse(scoring.with_impact(ruled, impact_of(event_rows)), F.col("last_seen_at"))


def scored_events(spark, sf):
    by_source = materialise(rollup.per_source(merged_reports(spark, sf)), "by-source")
    return score_events(by_source, dt.sources(spark))


def final_events(spark, sf, apply_direction=True):
    return scoring.final_scores(scored_events(spark, sf), _AS_OF(), apply_direction)


# --- windows -------------------------------------------------------------------------------


@register("w1_gap_sessions", f"""WITH {sp.REPORTS}, gaps AS (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY {sp.KEY} ORDER BY us, eid) <= 14400000000 THEN 0 ELSE 1 END AS begins FROM reports),
  numbered AS (SELECT *, sum(begins) OVER (PARTITION BY {sp.KEY} ORDER BY us, eid ROWS UNBOUNDED PRECEDING) AS sno FROM gaps)
  SELECT {sp.KEY}, min(us) AS session_start, max(us) AS session_end FROM numbered GROUP BY {sp.KEY}, sno""")
def w1(spark, sf):
    reports = dt.events_as_reports(spark, sf).withColumn("at", merging.micros(F.coalesce("published_at", "created_at")))
    slots = merging.sessions(reports, Span.hours())
    return slots.groupBy(*KEY, "session_start").agg(F.max("hi").alias("session_end"))


@register("w2_capped_events", f"{sp.event_chain()} SELECT entity_event_id, event_id, first FROM merged")
def w2(spark, sf):
    return merged_reports(spark, sf).select("entity_event_id", "event_id", "first")


@register("w2_long_sessions", f"{sp.event_chain(24, 48)} SELECT entity_event_id, event_id, first FROM merged")
def w2_long(spark, sf):
    return merged_reports(spark, sf, 24, 48).select("entity_event_id", "event_id", "first")


@register("w2_hot_key", f"{sp.event_chain(reports=sp.HOT_REPORTS)} SELECT entity_event_id, event_id, first FROM merged")
def w2_hot(spark, sf):
    """A third of all reports on one key."""
    reports = dt.on_one_key(dt.events_as_reports(spark, sf))
    return merging.merge(reports).select("entity_event_id", "event_id", "first")


_BURST = (2 / 3600, 5 / 3600)


@register("w2_burst", f"{sp.event_chain(*_BURST, reports=sp.BURST_REPORTS)} SELECT entity_event_id, event_id, first FROM merged")
def w2_burst(spark, sf):
    """A third of all reports on one key and within half a minute; window and cap of seconds."""
    reports = dt.on_one_key(dt.events_as_reports(spark, sf)).withColumn("at", dt.burst_time())
    placed = merging.assign(reports, Span.hours(*_BURST)).withColumn("event_id", merging.event_key(F.col("first")))
    return placed.select("entity_event_id", "event_id", "first")


@register("w3_effective_time", f"WITH {sp.REPORTS} SELECT entity_event_id, us FROM reports")
def w3(spark, sf):
    at = merging.micros(F.coalesce("published_at", "created_at"))
    return dt.events_as_reports(spark, sf).select("entity_event_id", at.alias("us"))


# --- roll-up -------------------------------------------------------------------------------

_ROWS = f"{sp.event_chain()}, {sp.AUTHORITY}, {sp.EVENT_ROWS}"


@register("a6_event_rollup", f"""{_ROWS}, sourced AS (
  SELECT event_id, array_to_string(list_sort(list(source_name || '|' || first_url || '|' || {sp.exact('make_timestamp(first_at)')})), ' ') AS source_list FROM by_source GROUP BY event_id)
  SELECT event_id, {sp.KEY}, source_count, CAST(article_count AS BIGINT) AS article_count, source_list,
    {sp.exact('make_timestamp(first_us)')} AS first_seen_at, {sp.exact('make_timestamp(last_us)')} AS last_seen_at FROM event_rows JOIN sourced USING (event_id)""")
def a6(spark, sf):
    rows = rollup.events(rollup.per_source(merged_reports(spark, sf)))
    entry = lambda s: F.concat_ws("|", s["source_name"], s["url"], exact(s["published_at"]))
    return rows.select(
        "event_id", *KEY, "source_count", "article_count",
        F.array_join(F.transform("source_list", entry), " ").alias("source_list"),
        exact("first_seen_at").alias("first_seen_at"), exact("last_seen_at").alias("last_seen_at"),
    )


@register("a6_source_articles", f"{sp.event_chain()} SELECT DISTINCT event_id, source_name, source_url AS url, us FROM merged")
def a6_articles(spark, sf):
    return rollup.source_articles(merged_reports(spark, sf)).withColumnRenamed("at", "us")


@register("a7_secondary_types", f"""{sp.event_chain()}, tallied AS (
    SELECT event_id, event_type_secondary AS t, count(*) AS n FROM merged WHERE event_type_secondary <> event_type_primary GROUP BY ALL),
  counted AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, t) AS place FROM tallied)
  SELECT event_id, string_agg(t, ',' ORDER BY place) AS event_type_secondary FROM counted WHERE place <= 2 GROUP BY event_id""")
def a7(spark, sf):
    types = rollup.secondary_types(merged_reports(spark, sf))
    return types.select("event_id", F.array_join("event_type_secondary", ",").alias("event_type_secondary"))


@register("a8_a9_sentiment", f"""{_ROWS} SELECT event_id, round(weighted_sentiment + 1e-9, 6) AS weighted_sentiment, round(sentiment_strength + 1e-9, 6) AS sentiment_strength, authority, sentiment_label FROM labelled""")
def a8(spark, sf):
    mood = rollup.sentiment(rollup.with_authority(rollup.per_source(merged_reports(spark, sf)), dt.sources(spark)))
    return mood.select("event_id", r6("weighted_sentiment").alias("weighted_sentiment"), r6("sentiment_strength").alias("sentiment_strength"), "authority", "sentiment_label")


@register("j8_authority_lookup", f"WITH {sp.REPORTS}, {sp.AUTHORITY} SELECT source_name, coalesce(w, 4.0) AS weight, count(*) AS n FROM reports LEFT JOIN authority USING (source_name) GROUP BY ALL")
def j8(spark, sf):
    rows = rollup.with_authority(dt.events_as_reports(spark, sf), dt.sources(spark))
    return rows.groupBy("source_name", "weight").agg(F.count(F.lit(1)).alias("n"))


@register("s11_active_sources", f"WITH {sp.REPORTS}, {sp.AUTHORITY} SELECT source_name, w AS authority_weight, count(*) AS n FROM reports JOIN authority USING (source_name) GROUP BY ALL")
def s11(spark, sf):
    active = rollup.active_sources(dt.sources(spark))
    return dt.events_as_reports(spark, sf).join(small(active), "source_name").groupBy("source_name", "authority_weight").agg(F.count(F.lit(1)).alias("n"))


@register("j6_event_members", f"""{_ROWS} SELECT event_id, entity_event_id, headline, first_us FROM merged JOIN event_rows USING (event_id)""")
def j6(spark, sf):
    merged = materialise(merged_reports(spark, sf), "merged")
    event_rows = materialise(rollup.events(rollup.per_source(merged)), "events")
    pairs = merging.entity_map(merged, _AS_OF())
    rows = rollup.members(event_rows, pairs, dt.events_as_reports(spark, sf))
    return rows.select("event_id", "entity_event_id", "headline", F.unix_micros("first_seen_at").alias("first_us"))


@register("s14_map_insert", f"""{sp.event_chain()} SELECT event_id, entity_event_id FROM merged WHERE eid % 4 <> 0""")
def s14(spark, sf):
    pairs = merging.entity_map(merged_reports(spark, sf), _AS_OF()).select("event_id", "entity_event_id")
    pairs = materialise(pairs, "map")
    stored = pairs.where(F.col("entity_event_id").cast("long") % 4 == 0)
    return dedup.absent(pairs, stored, ["event_id", "entity_event_id"])


@register("s12_entity_insert", f"""WITH {sp.REPORTS}, old AS (SELECT DISTINCT stock_code, source_url FROM reports WHERE eid % 3 = 0)
  SELECT source_url, stock_code, min(entity_event_id) AS entity_event_id FROM reports WHERE (stock_code, source_url) NOT IN (SELECT (stock_code, source_url) FROM old) GROUP BY ALL""")
def s12(spark, sf):
    rows = dt.events_as_reports(spark, sf).select("source_url", "stock_code", "entity_event_id")
    stored = rows.where(F.col("entity_event_id").cast("long") % 3 == 0)
    return dedup.absent(rows, stored, ["source_url", "stock_code"])


@register("s13_upsert", f"""WITH {sp.REPORTS} SELECT stock_code, event_type_primary, max(us) AS us, arg_max(entity_event_id, (us, eid)) AS entity_event_id FROM reports GROUP BY ALL""")
def s13(spark, sf):
    rows = dt.events_as_reports(spark, sf).select(
        "stock_code", "event_type_primary", merging.micros(F.coalesce("published_at", "created_at")).alias("us"),
        F.col("entity_event_id").cast("long").alias("eid"), "entity_event_id",
    )
    early = F.col("us") < 1705000000000000
    return tables.upsert(rows.where(early), rows.where(~early), ["stock_code", "event_type_primary"], "us", "eid").drop("eid")


@register("s13_touched_buckets", f"""WITH {sp.REPORTS} SELECT stock_code, event_type_primary, source_url, us, entity_event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY stock_code, event_type_primary, substr(source_url, 1, 22) ORDER BY us DESC, eid DESC) AS n FROM reports) WHERE n = 1""")
def s13_buckets(spark, sf):
    """The latest report per stock, type and leading digit of the address, kept by three upserts of touched buckets."""
    rows = dt.events_as_reports(spark, sf).select(
        "stock_code", "event_type_primary", F.left("source_url", F.lit(22)).alias("address"), "source_url",
        merging.micros(F.coalesce("published_at", "created_at")).alias("us"), F.col("entity_event_id").cast("long").alias("eid"), "entity_event_id",
    )
    rows = materialise(rows, "reports")
    table = Buckets(f"{shared_dir(spark)}/newsflow/latest-{uuid.uuid4().hex}", rows.schema, ("stock_code", "event_type_primary", "address"), 64)
    for low, high in ((0, 1704900000000000), (1704900000000000, 1705900000000000), (1705900000000000, 1 << 62)):
        table.upsert(rows.where((F.col("us") >= low) & (F.col("us") < high)), "us", "eid")
    return table.read(spark).drop("eid", "address")


# --- scores --------------------------------------------------------------------------------

_SCORED = sp.scored_chain()


@register("a10_rule_score", f"{_SCORED} SELECT event_id, event_type_score, authority AS source_authority_score, round(sentiment_strength_score + 1e-9, 6) AS sentiment_strength_score, source_heat_score, round(base_rule_score + 1e-9, 6) AS base_rule_score FROM based")
def a10(spark, sf):
    return scored_events(spark, sf).select(
        "event_id", "event_type_score", "source_authority_score", r6("sentiment_strength_score").alias("sentiment_strength_score"),
        "source_heat_score", r6("base_rule_score").alias("base_rule_score"),
    )


@register("c22_c23_fusion", f"{_SCORED} SELECT event_id, direction, round(abs_final_score + 1e-9, 6) AS abs_final_score FROM scored")
def c23(spark, sf):
    return scored_events(spark, sf).select("event_id", "direction", r6("abs_final_score").alias("abs_final_score"))


@register("e5_impact_input", f"{_SCORED} SELECT event_id, stock_impact_score, llm_fallback FROM fused")
def e5(spark, sf):
    return scored_events(spark, sf).select("event_id", "stock_impact_score", "llm_fallback")


@register("c24_w7_final_score", f"{_SCORED} SELECT event_id, round(recency_score + 1e-9, 6) AS recency_score, round(final_base + 1e-9, 6) AS final_base, round(final_abs + 1e-9, 6) AS final_abs, round(abs(final_base * 0.67 + stock_impact_score * 0.66) + 1e-9, 6) AS unsigned_abs FROM final")
def c24(spark, sf):
    rows = final_events(spark, sf)
    unsigned = scores.fused(F.col("final_base_rule_score"), F.col("stock_impact_score"))
    return rows.select(
        "event_id", r6("recency_score").alias("recency_score"), r6("final_base_rule_score").alias("final_base"),
        r6("final_abs_final_score").alias("final_abs"), r6(unsigned).alias("unsigned_abs"),
    )


@register("f14_current_versions", f"{_ROWS} SELECT event_id, last_us AS version FROM event_rows WHERE last_us % 3 <> 0")
def f14(spark, sf):
    rows = materialise(rollup.events(rollup.per_source(merged_reports(spark, sf))), "events")
    rows = rows.withColumn("aggregation_updated_at", F.col("last_seen_at"))
    stale = F.col("last_seen_at") - F.expr("INTERVAL 1 SECOND")
    work = rows.select("event_id", F.when(F.unix_micros("last_seen_at") % 3 == 0, stale).otherwise(F.col("last_seen_at")).alias("aggregation_updated_at"))
    return scoring.current_only(work, rows).select("event_id", F.unix_micros("aggregation_updated_at").alias("version"))


@register("e6_custom_scorer", f"{_SCORED} SELECT event_id, base_rule_score > 5.0001 AS strong FROM based")
def e6(spark, sf):
    step = lambda rows: rows.withColumn("strong", F.col("base_rule_score") > 5.0001)
    return scoring.apply_scorer(scored_events(spark, sf), step).select("event_id", "strong")


# --- brief ---------------------------------------------------------------------------------

_ORDER = "final_abs DESC, final_base DESC, last_us DESC, first_us, event_id"


@register("j7_event_scores", f"{_SCORED} SELECT event_id, stock_code, round(abs_final_score + 1e-9, 6) AS abs_final_score, source_count FROM scored")
def j7(spark, sf):
    by_source = materialise(rollup.per_source(merged_reports(spark, sf)), "by-source")
    score_rows = score_events(by_source, dt.sources(spark)).select("event_id", "abs_final_score")
    rows = rollup.events(by_source).join(score_rows, "event_id")
    return rows.select("event_id", "stock_code", r6("abs_final_score").alias("abs_final_score"), "source_count")


@register("f12_noise_filter", f"{_SCORED} SELECT event_id, round(final_abs + 1e-9, 6) AS final_abs FROM final WHERE final_abs >= 3.0")
def f12(spark, sf):
    return brief.above_noise(final_events(spark, sf)).select("event_id", r6("final_abs_final_score").alias("final_abs"))


@register("t1_ranked_brief", f"{_SCORED} SELECT row_number() OVER (ORDER BY {_ORDER}) AS rank, event_id, round(final_abs + 1e-9, 6) AS final_abs FROM final WHERE final_abs >= 3.0")
def t1(spark, sf):
    return brief.ranked_brief(final_events(spark, sf), "event_id").select("rank", "event_id", r6("final_abs_final_score").alias("final_abs"))


@register("t2_watchlist_brief", f"""{_SCORED}, kept AS (SELECT *, stock_code IN ('00007.HK', '00009.HK', '00021.HK') AS is_match FROM final WHERE final_abs >= 3.0),
  chosen AS (SELECT *, row_number() OVER (ORDER BY is_match DESC, {_ORDER}) AS rank FROM kept),
  top AS (SELECT * FROM chosen WHERE rank <= 20)
  SELECT rank, row_number() OVER (ORDER BY {_ORDER}) AS position, is_match, event_id, stock_code, event_type_primary, round(final_abs + 1e-9, 6) AS abs_final_score,
    round(final_base + 1e-9, 6) AS base_rule_score, {sp.stamp('make_timestamp(first_us)')} AS first_seen_at, {sp.stamp('make_timestamp(last_us)')} AS last_seen_at FROM top""")
def t2(spark, sf):
    rows = brief.watchlist(brief.above_noise(final_events(spark, sf)), WATCHLIST, 20)
    return rows.select(
        F.col("rank").cast("long").alias("rank"), F.col("position").cast("long").alias("position"), "is_match", "event_id", "stock_code", "event_type_primary", r6("final_abs_final_score").alias("abs_final_score"),
        r6("final_base_rule_score").alias("base_rule_score"), stamp("first_seen_at").alias("first_seen_at"), stamp("last_seen_at").alias("last_seen_at"),
    )


_CACHE = f"""{_SCORED}, updated AS (SELECT * FROM final WHERE last_us >= 1705622400000000),
  cached AS (SELECT event_id FROM final WHERE final_abs >= 1.5 AND first_us % 3 <> 0)"""


def _cache(spark, sf):
    rows = materialise(final_events(spark, sf), "final")
    updated = rows.where(F.unix_micros("last_seen_at") >= 1705622400000000)
    cached = rows.where((F.col("final_abs_final_score") >= 1.5) & (F.unix_micros("first_seen_at") % 3 != 0))
    return cached, updated


@register("j11_merge_actions", f"""{_CACHE} SELECT event_id, CASE WHEN final_abs >= 3.0 THEN CASE WHEN event_id IN (SELECT event_id FROM cached) THEN 'replace' ELSE 'insert' END
  WHEN event_id IN (SELECT event_id FROM cached) THEN 'remove' ELSE 'ignore' END AS action FROM updated""")
def j11(spark, sf):
    return brief.merge_actions(*_cache(spark, sf))


@register("u4_cache_merge", f"""{_CACHE} SELECT event_id FROM cached WHERE event_id NOT IN (SELECT event_id FROM updated) UNION ALL SELECT event_id FROM updated WHERE final_abs >= 3.0""")
def u4(spark, sf):
    return brief.merge_cache(*_cache(spark, sf)).select("event_id")


def _members(spark, sf):
    return rollup.with_authority(merged_reports(spark, sf, 24, 48), dt.sources(spark))


_MEMBERS = f"""{sp.event_chain(24, 48)}, {sp.AUTHORITY}, members AS (SELECT m.*, coalesce(a.w, 4.0) AS weight FROM merged m LEFT JOIN authority a USING (source_name)),
  latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, source_name ORDER BY us DESC, entity_event_id) AS place FROM members) WHERE place <= 3)"""


@register("w4_latest_per_source", f"{_MEMBERS} SELECT event_id, source_name, entity_event_id, place FROM latest")
def w4(spark, sf):
    return brief.latest_per_source(_members(spark, sf)).select("event_id", "source_name", "entity_event_id", F.col("place").cast("long").alias("place"))


@register("w5_summary_budget", f"""{_MEMBERS},
  arrays AS (SELECT event_id, list(struct_pack(s := source_name, t := entity_summary) ORDER BY weight DESC, us DESC, entity_event_id) AS es FROM latest GROUP BY event_id),
  budget(event_id, es, i, used, kept) AS (
    SELECT event_id, es, CAST(1 AS BIGINT), CAST(0 AS BIGINT), '' FROM arrays
    UNION ALL
    SELECT event_id, es, i + 1, CASE WHEN used + length(es[i].t) <= 200 THEN used + length(es[i].t) ELSE used END,
      CASE WHEN used + length(es[i].t) <= 200 THEN kept || '#[' || es[i].s || '] ' || es[i].t ELSE kept END FROM budget WHERE i <= len(es))
  SELECT event_id, kept AS summaries, used AS total_chars, CAST(len(es) AS BIGINT) AS entry_count FROM budget WHERE i = len(es) + 1""")
def w5(spark, sf):
    rows = brief.within_budget(brief.latest_per_source(_members(spark, sf)))
    joined = F.array_join(F.transform("summaries", lambda s: F.concat(F.lit("#"), s)), "")
    return rows.select("event_id", joined.alias("summaries"), F.col("total_chars").cast("long").alias("total_chars"), "entry_count")


@register("w6_fallback_headline", f"{_MEMBERS} SELECT event_id, arg_max(headline, (weight, us, entity_event_id)) AS headline FROM members GROUP BY event_id")
def w6(spark, sf):
    return brief.fallback_headline(_members(spark, sf))


@register("e4_fallback_brief", f"""{_MEMBERS} SELECT event_id, left(arg_max(headline, (weight, us, entity_event_id)), 30) AS summary_short,
  left(arg_max(headline, (weight, us, entity_event_id)), 30) AS summary_full, CAST(0 AS INT) AS key_numbers FROM members GROUP BY event_id""")
def e4(spark, sf):
    rows = brief.fallback_headline(_members(spark, sf)).withColumn("b", brief.fallback_brief(F.col("headline")))
    return rows.select("event_id", "b.summary_short", "b.summary_full", F.size("b.key_numbers").alias("key_numbers"))


@register("t3_c20_brief_limits", """SELECT doc_id, left(text, 30) AS summary_short, left(text, 150) AS summary_full, least(3, len(regexp_split_to_array(text, ' '))) AS numbers,
  length(text) > 30 OR len(regexp_split_to_array(text, ' ')) > 3 AS violation FROM documents""")
def t3(spark, sf):
    words = F.split("text", " ")
    rows = dt.worked(spark, sf, "documents").withColumn("b", brief.checked_brief(F.col("text"), F.col("text"), words))
    return rows.select("doc_id", "b.summary_short", "b.summary_full", F.size("b.key_numbers").cast("long").alias("numbers"), "b.violation")


@register("c27_nested_response", f"""{_SCORED}, top AS (SELECT * FROM final WHERE final_abs >= 3.0 ORDER BY {_ORDER} LIMIT 50),
  headlines AS (SELECT event_id, arg_max(headline, (coalesce(a.w, 4.0), us, entity_event_id)) AS headline FROM merged LEFT JOIN authority a USING (source_name) GROUP BY event_id)
  SELECT event_id, round(final_abs + 1e-9, 6) AS abs_final_score, source_count, left(headline, 30) AS summary_short, event_type_score, llm_fallback FROM top JOIN headlines USING (event_id)""")
def c27(spark, sf):
    merged = materialise(merged_reports(spark, sf), "merged")
    sources = dt.sources(spark)
    scored = scoring.final_scores(score_events(materialise(rollup.per_source(merged), "by-source"), sources), _AS_OF())
    top = materialise(brief.above_noise(scored).orderBy(*brief.order()).limit(50), "top")
    chosen = merged.join(F.broadcast(top.select("event_id")), "event_id", "left_semi")
    heads = brief.fallback_headline(rollup.with_authority(chosen, sources))
    types = rollup.secondary_types(chosen)
    rows = top.join(heads, "event_id").join(types, "event_id", "left").withColumn("brief", brief.fallback_brief(F.col("headline")))
    shaped = brief.response(rows)
    return shaped.select(
        "event_id", r6("abs_final_score").alias("abs_final_score"), "event.source_count", "event.summary_short",
        "score.rule_score_detail.event_type_score", "score.llm_fallback",
    )


@register("s15_published_brief", f"{_SCORED} SELECT event_id, round(final_abs + 1e-9, 6) AS final_abs FROM final WHERE final_abs >= 3.0")
def s15(spark, sf):
    root = f"{shared_dir(spark)}/newsflow/published-{uuid.uuid4().hex}"
    rows = materialise(brief.above_noise(final_events(spark, sf)), "kept")
    tables.publish(rows.where(F.col("stock_code") < "00025"), root, 1)
    tables.publish(rows, root, 2)
    return tables.published(spark, root).select("event_id", r6("final_abs_final_score").alias("final_abs"))
