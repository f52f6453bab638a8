"""The stage tables, derived from the given test tables by fixed formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow import params, schemas
from newsflow.functions import stocks, text
from newsflow.session import spread

EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def worked(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table that needs much work per row and is given in one or few row groups."""
    return spread(table(spark, folder, name))


def raw_news(spark: SparkSession, folder: str) -> DataFrame:
    return raw_of(worked(spark, folder, "documents"))


def raw_of(docs: DataFrame) -> DataFrame:
    """The same for any frame with the columns of the document table, streaming included."""
    created = F.expr(f"timestampadd(MINUTE, doc_id, {EPOCH})")
    return docs.select(
        F.col("doc_id").cast("string").alias("raw_id"),
        F.col("source").alias("source_name"),
        F.concat_ws("/", "source", F.col("n_chars").cast("string")).alias("source_url"),
        F.regexp_extract("text", r"^([^.\n]*)", 1).alias("title"),
        F.col("text").alias("body"),
        F.when(F.col("doc_id") % 7 != 0, F.expr(f"timestampadd(MINUTE, doc_id - doc_id % 90, {EPOCH})")).alias("published_at"),
        created.alias("created_at"),
        F.lit(False).alias("is_deleted"),
        F.lit(None).cast("string").alias("deleted_reason"),
    ).withColumn("raw_hash", text.title_hash(F.col("title")))


def events_as_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Entity events from the event stream; 50 stocks, 5 types, 4 sources."""
    return reports_of(worked(spark, folder, "events"))


def reports_of(events: DataFrame) -> DataFrame:
    """The same for any frame with the columns of the event table, streaming included."""
    eid, value = F.col("event_id"), F.col("value")
    types = ["EARNINGS", "REGULATORY", "MANAGEMENT_CHANGE", "ANALYST_RATING", "GENERAL_ANNOUNCEMENT"]
    names = ["purchase", "error", "signup", "view", "click"]
    primary = F.element_at(F.create_map(*[F.lit(v) for pair in zip(names, types) for v in pair]), F.col("event_type"))
    pick = lambda options, index: F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))
    seen = F.col("ts").cast("timestamp")
    return events.select(
        eid.cast("string").alias("entity_event_id"),
        F.lit("HKEX").alias("exchange"),
        F.concat(F.lit("https://news.example/"), eid.cast("string")).alias("source_url"),
        pick(list(params.SOURCE_AUTHORITY), eid % 4).alias("source_name"),
        F.when(eid % 11 != 0, seen).alias("published_at"),
        stocks.standardise((F.col("user_id") % 50).cast("string")).alias("stock_code"),
        primary.alias("event_type_primary"),
        F.when(eid % 3 != 0, pick(params.EVENT_TYPES, (eid * 5) % 8)).alias("event_type_secondary"),
        pick(["POSITIVE", "NEGATIVE", "NEUTRAL"], eid % 3).alias("sentiment_label"),
        (F.pmod(F.round(value * 100).cast("long"), F.lit(100)) / 100).alias("sentiment_score"),
        F.concat_ws(" ", "event_type", eid.cast("string")).alias("headline"),
        F.left(F.repeat(F.concat_ws(" ", "event_type", "props", F.lit("")), (eid % 9 + 1).cast("int")), F.lit(100)).alias("entity_summary"),
        (seen + F.make_dt_interval(secs=(eid % 60))).alias("created_at"),
    )


def on_one_key(reports: DataFrame) -> DataFrame:
    """The reports with every third one on one stock and event type."""
    third = F.col("entity_event_id").cast("bigint") % 3 == 0
    return reports.withColumn("stock_code", F.when(third, "00001.HK").otherwise(F.col("stock_code"))).withColumn(
        "event_type_primary", F.when(third, "EARNINGS").otherwise(F.col("event_type_primary"))
    )


def burst_time() -> Column:
    """Effective time of a report in microseconds; that of every third one is 86400 times as fast, so that days become seconds."""
    at, begin = F.unix_micros(F.coalesce("published_at", "created_at")), F.unix_micros(F.expr(EPOCH))
    third = F.col("entity_event_id").cast("bigint") % 3 == 0
    return F.when(third, begin + F.call_function("div", at - begin, F.lit(86400))).otherwise(at)


def sources(spark: SparkSession) -> DataFrame:
    """The seeded source dimension, with one source switched off so that defaults show."""
    rows = [(n, w, n != "YAHOO_HK") for n, w in params.SOURCE_AUTHORITY.items()]
    return spark.createDataFrame(rows, schemas.DATA_SOURCES)


def master_from_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """A stock master whose company names are the benchmark texts."""
    sector = F.element_at(F.array(*[F.lit(s) for s in params.SECTORS]), (F.col("item_id") % 8 + 1).cast("int"))
    return table(spark, folder, "benchmark").select(
        stocks.standardise((F.col("item_id") + 1).cast("string")).alias("stock_code"),
        F.lit(None).cast("string").alias("company_name_zh"),
        F.col("text").alias("company_name_en"),
        sector.alias("sector"),
    )


def master_from_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.concat(F.lpad((F.col("s_suppkey") + 1).cast("string"), 5, "0"), F.lit(".HK")).alias("stock_code"),
        F.lit(None).cast("string").alias("company_name_zh"),
        F.col("s_name").alias("company_name_en"),
        F.element_at(F.array(*[F.lit(s) for s in params.SECTORS]), (F.col("s_nationkey") % 8 + 1).cast("int")).alias("sector"),
    )


def site_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages spread over three sources, with the date cells and scopes those sources use."""
    pid, html = F.col("page_id"), F.col("html")
    source = F.element_at(F.array(F.lit("MINGPAO"), F.lit("AASTOCKS"), F.lit("YAHOO_HK")), (pid % 3 + 1).cast("int"))
    day = (pid % 28 + 1).cast("int")
    mingpao = F.format_string(
        "<div class=\"date color2nd\">2026年4月%d日 星期一　%d:%02d%s</div><article>",
        day, (pid % 12 + 1).cast("int"), (pid % 60).cast("int"), F.when(pid % 2 == 0, "AM").otherwise("PM"),
    )
    aastocks = F.format_string(
        "<div class=\"newstime5 newshead-Source\">AA 2020/01/01 00:00</div>"
        "<div class=\"newstime5\">write({dt:'2026/04/%02d %02d:%02d'})</div><div class=\"fix newscon1\">",
        day, (pid % 24).cast("int"), (pid % 60).cast("int"),
    )
    page = (
        F.when(source == "MINGPAO", F.replace(html, F.lit("<article>"), mingpao))
        .when(
            source == "AASTOCKS",
            F.replace(F.replace(html, F.lit("<article>"), aastocks), F.lit("</article>"), F.lit("</div>")),
        )
        .otherwise(html)
    )
    return worked(spark, folder, "pages").select("page_id", F.col("url").alias("source_url"), source.alias("source_name"), page.alias("html"))


def feed_items(spark: SparkSession, folder: str) -> DataFrame:
    """Feed items as XML text, one per document: some without a title, some advertisements."""
    docs = table(spark, folder, "documents")
    did = F.col("doc_id")
    title = F.regexp_replace(F.regexp_extract("text", r"^([^.\n]*)", 1), r"[^\p{L} ]", "")
    host = F.when(did % 5 == 0, "https://ads.example/").otherwise("https://hk.finance.yahoo.com/news/")
    stamp = F.expr(f"timestampadd(MINUTE, doc_id, {EPOCH})")
    pub = F.concat(
        F.date_format(stamp, "EEE, d MMM yyyy HH:mm:ss"), F.when(did % 2 == 0, " GMT").otherwise(" +0800")
    )
    return docs.select(
        "doc_id", "source",
        F.concat(
            F.lit("<item><title> "), F.when(did % 13 == 0, "").otherwise(title), F.lit(" </title><link>"), host,
            did.cast("string"), F.lit("</link>"),
            F.when(did % 4 == 0, "").otherwise(F.concat(F.lit("<pubDate>"), pub, F.lit("</pubDate>"))),
            F.lit("</item>"),
        ).alias("xml"),
    )


def listing_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Filing tables of up to 20 rows each, one row per order."""
    key = F.col("o_orderkey")
    link = F.when(key % 5 == 0, "<span>none</span>").when(key % 5 == 1, F.format_string('<a href="https://pdf.example/%d.pdf">x</a>', key)).when(
        key % 5 == 2, '<a href="">x</a>').otherwise(F.format_string('<a target="_blank" href="/listed/%d.pdf">x</a>', key))
    when = F.when(key % 17 == 0, "soon").otherwise(F.concat(F.lit("Release Time: "), F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")))
    code = F.lpad((F.col("o_custkey") % 9000).cast("string"), 5, "0")
    cell = F.format_string(
        "<tr><td class=\"release-time\">%s</td><td class=\"stock-short-code\">%s<br/>%s</td>"
        "<td><div class=\"headline\"> %s &amp; filing </div><div class=\"doc-link\">%s</div></td></tr>",
        when, code, F.when(key % 3 == 0, ", 00388").otherwise(""), F.col("o_orderpriority"), link,
    )
    rows = table(spark, folder, "orders").select(F.floor(key / 20).alias("listing_id"), F.struct(key.alias("k"), cell.alias("c")).alias("r"))
    # Twenty consecutive keys at most in one page, by construction.
    return rows.groupBy("listing_id").agg(F.sort_array(F.collect_list("r")).alias("rs")).select(
        "listing_id",
        F.concat(F.lit("<table><thead><tr><th>x</th></tr></thead><tbody>"), F.array_join(F.col("rs.c"), ""), F.lit("</tbody></table>")).alias("html"),
    )


def filing_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of filings: a document is that of the order with its number, under either address form.

    Neither parser fails on a document without text.
    """
    did, textless = F.col("doc_id"), text.is_blank(F.col("text"))
    address = F.when(did % 5 == 1, F.format_string("https://pdf.example/%d.pdf", did)).otherwise(
        F.format_string(f"{params.HKEX_BASE}/listed/%d.pdf", did))
    primary = F.when((did % 4 == 0) | textless, " ").otherwise(F.concat(F.lit("parsed "), "text"))
    fallback = F.when((did % 6 == 5) & ~textless, "").otherwise(F.col("text"))
    return table(spark, folder, "documents").select(
        address.alias("pdf_url"), primary.alias("primary"), fallback.alias("fallback"), (did % 9 == 0).alias("encrypted"), textless.alias("textless")
    )


def skill_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Skill logs as JSON lines: one log per conversation and block of four turns."""
    turns = table(spark, folder, "conversations")
    size = F.length("text").cast("long")
    call = F.struct(
        (F.col("turn") % 4 + 1).cast("int").alias("call_index"),
        F.when(F.col("turn") % 4 == 3, "structured_output").otherwise("fc_round").alias("purpose"),
        size.alias("input_tokens"), F.floor(size / 4).cast("long").alias("output_tokens"),
        (size * 3 % 5000).alias("latency_ms"), (F.col("turn") % 2).cast("int").alias("instructor_retries"),
    )
    logs = turns.groupBy("conv_id", F.floor(F.col("turn") / 4).alias("block")).agg(F.sort_array(F.collect_list(call)).alias("llm_calls"))
    cid = F.col("conv_id")
    record = F.struct(
        F.element_at(F.array(F.lit("entity_analysis_completed"), F.lit("brief_summary_completed")), (cid % 2 + 1).cast("int")).alias("event"),
        cid.cast("string").alias("entity_event_id"), cid.cast("string").alias("event_id"),
        F.concat(F.lit("v1."), (cid % 3).cast("string")).alias("skill_version"),
        (cid % 5 == 0).alias("fallback"),
        F.struct(F.size("llm_calls").alias("rounds"), (F.size("llm_calls") >= 3).alias("max_rounds_reached")).alias("fc_summary"),
        "llm_calls",
        F.when(cid % 7 == 0, F.array(F.struct(F.lit(1).alias("call_index"), F.lit("BusinessValidationError").alias("error_type"),
                                              F.lit("headline").alias("error_detail"), F.lit(False).alias("retried"))))
        .otherwise(F.array().cast("array<struct<call_index:int,error_type:string,error_detail:string,retried:boolean>>")).alias("llm_errors"),
        F.expr(f"timestampadd(HOUR, conv_id % 72, {EPOCH})").alias("timestamp"),
    )
    return logs.select(F.to_json(record).alias("line"))


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.cast("string").alias("job_id"),
        (key * 37 % 1440).cast("int").alias("start_minute"),
        F.when(key % 3 == 0, 60).when(key % 3 == 1, 1440).alias("interval_minutes"),
        (key % 5 != 0).alias("is_active"),
    )


def days(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.to_date("ts").alias("day")).distinct()

