"""Stock lookup and entity match."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow import params
from newsflow.functions import scores, stocks, text
from newsflow.session import materialise, small

# The ideograph blocks.  Ranges, since a script test per character is slow.
HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2fa1f}"
# Everything between words; Chinese runs part words as well.
BETWEEN_WORDS = rf"[^\p{{L}}\p{{N}}]+|[{HAN}]+"
# Two Chinese characters, taken at every offset.
HAN_PAIRS = rf"(?=([{HAN}]{{2}}))"
# Bits that tell which words, pairs of words and codes can begin a known name: 16 KB, whatever the master.
MARKS = 1 << 17


def lookup_by_code(queries: DataFrame, master: DataFrame, query: str = "query") -> DataFrame:
    """Exact lookup of ``700``, ``00700`` or ``00700.HK``; ``found`` is false without a match."""
    wanted = F.when(stocks.looks_like_code(F.col(query)), stocks.standardise(F.col(query)))
    return (
        queries.withColumn("stock_code", wanted)
        .join(small(master.withColumn("found", F.lit(True))), "stock_code", "left")
        .withColumn("found", F.coalesce("found", F.lit(False)))
        .withColumn("stock_code", F.when(F.col("found"), F.col("stock_code")))
    )


def _names(master: DataFrame) -> DataFrame:
    """(stock_code, name): both names of every stock, lower case."""
    both = F.array(F.col("company_name_zh"), F.col("company_name_en"))
    return (
        master.select("stock_code", F.explode(both).alias("name"))
        .where(text.or_empty(F.col("name")) != "")
        .select("stock_code", text.collapse(F.lower("name")).alias("name"))
        .distinct()
    )


def _deletions(word: Column, distance: int) -> Column:
    """The word and every string left after deleting up to ``distance`` characters."""
    forms = F.array(word)
    for _ in range(distance):
        shorter = lambda w: F.when(
            F.length(w) > 0,
            F.transform(
                F.sequence(F.lit(1), F.length(w)),
                lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.length(w))),
            ),
        ).otherwise(F.array().cast("array<string>"))
        forms = F.array_distinct(F.concat(forms, F.flatten(F.transform(forms, shorter))))
    return forms


def lookup_by_name(queries: DataFrame, master: DataFrame, query: str = "query", distance: int = 1) -> DataFrame:
    """(query, stock_code, name, edits): the closest company name within an edit distance.

    Two names are within d edits only if deleting at most d characters from each can give the
    same string, so an equi-join on these forms finds every candidate; the distance is then
    checked.  Ties go to the smaller code.  Repeated queries are looked up once.
    """
    asked = queries.select(query).distinct().withColumn("_q", text.collapse(F.lower(F.col(query))))
    left = asked.withColumn("_form", F.explode(_deletions(F.col("_q"), distance)))
    right = _names(master).withColumn("_form", F.explode(_deletions(F.col("name"), distance)))
    edits = F.levenshtein(F.col("_q"), F.col("name"))
    best = F.min(F.struct("edits", "stock_code", "name"))
    return (
        left.join(small(right), "_form")
        .withColumn("edits", edits)
        .where(F.col("edits") <= distance)
        .groupBy(query)
        .agg(best.alias("_b"))
        .select(query, "_b.stock_code", "_b.name", "_b.edits")
    )


def verified_only(entities: DataFrame, master: DataFrame) -> DataFrame:
    return entities.join(small(master.select("stock_code").distinct()), "stock_code", "left_semi")


def _anchor(name: Column) -> Column:
    """First two characters of a Chinese name, first two words of any other, or its only word; blank-parted."""
    han = F.regexp_extract(name, rf"^([{HAN}]{{2}})", 1)
    return F.when(han != "", han).otherwise(F.array_join(F.slice(F.split(F.trim(_padded(name)), " "), 1, 2), " "))


def _anchors(lowered: Column, words: Column, known: Callable[..., Column]) -> Column:
    """What a known name may begin with: words, words side by side, and pairs of Chinese characters where the text has any."""
    beside = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    beside = F.filter(beside, lambda p: p["b"].isNotNull() & known(p["a"], p["b"]))
    pairs = F.when(lowered.rlike(f"[{HAN}]"), F.regexp_extract_all(lowered, F.lit(HAN_PAIRS), F.lit(1)))
    return F.concat(
        F.filter(words, lambda w: known(w)), F.transform(beside, lambda p: F.concat_ws(" ", p["a"], p["b"])),
        F.coalesce(F.filter(pairs, lambda p: known(p)), F.array().cast("array<string>")),
    )


def _padded(words: Column) -> Column:
    """Letters and digits only, words parted and framed by single blanks."""
    return _framed(F.regexp_replace(words, BETWEEN_WORDS, " "))


def _framed(words: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def _occurs(lowered: Column, padded: Column, name: Column) -> Column:
    """The name occurs; a name of words must not be part of a longer word."""
    return F.when(name.rlike(f"^[{HAN}]"), F.contains(lowered, name)).otherwise(F.contains(padded, _padded(name)))


def mentioned_stocks(articles: DataFrame, master: DataFrame, article: str = "cleaned_id",
                     body: str = "body_cleaned") -> DataFrame:
    """Distinct (article, stock_code) whose code or name occurs in the text."""
    tagged = _with_codes(articles.select(article, body), master, article, body, keep_body=False)
    return _one_row_per_code(tagged).select(article, "stock_code").distinct()


def _known(master: DataFrame) -> DataFrame:
    """(key, name, stock_code): what a text is looked up by, anchors of names and written codes (without a name)."""
    names = _names(master).withColumn("anchor", _anchor(F.col("name"))).where(F.col("anchor") != "")
    codes = master.select("stock_code").where(F.col("stock_code").isNotNull()).distinct()
    return names.select(F.col("anchor").alias("key"), "name", "stock_code").unionByName(
        codes.select(F.col("stock_code").alias("key"), F.lit(None).cast("string").alias("name"), "stock_code")
    )


def _places(*parts: Column) -> list[Column]:
    """The two bits of a key."""
    h, last = F.xxhash64(*parts), F.lit(MARKS - 1).cast("bigint")
    return [h.bitwiseAND(last), F.shiftright(h, 32).bitwiseAND(last)]


def key_marks(known: DataFrame) -> Column:
    """A fixed number of bits, as an array of 64-bit words, with both bits of every key set."""
    parts = F.split("key", " ")
    placed = F.when(F.size(parts) > 1, F.array(*_places(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))).otherwise(F.array(*_places(F.get(parts, F.lit(0)))))
    placed = known.select(F.explode(placed).alias("p"))
    placed = placed.select(F.expr("p div 64").alias("at"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"))
    rows = placed.groupBy("at").agg(F.bit_or("bit").alias("word")).collect()  # at most MARKS / 64
    words = dict.fromkeys(range(MARKS // 64), 0) | {r["at"]: r["word"] for r in rows}
    # one literal to the optimiser, which folds it to an array
    return F.from_json(F.lit(str([words[i] for i in range(MARKS // 64)])), "array<bigint>")


def _with_codes(articles: DataFrame, master: DataFrame, article: str, body: str, keep_body: bool = True) -> DataFrame:
    """The articles with a stock, with ``_codes``, the distinct stocks of each text.

    Each text is read once: its words, pairs of words, pairs of Chinese characters and written codes are tested in the
    row against the bits of the known keys, and only texts with a hit are stored, with their hits: the form that names
    of words are compared with, and the text itself only if it has Chinese characters.  The hits meet
    names and codes in one join, and each text gets its own candidates back as one array to compare.  The plan is
    the same for a master of any size; a large one sets more bits, and more texts are compared.
    """
    known = _known(master)
    marks = key_marks(known)
    bit = lambda at: F.getbit(F.get(marks, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1
    may_be = lambda *parts: bit(_places(*parts)[0]) & bit(_places(*parts)[1])
    worded = articles.withColumn("_text", F.lower(F.col(body))).withColumn("_words", F.split("_text", BETWEEN_WORDS))
    hits = F.concat(_anchors(F.col("_text"), F.col("_words"), may_be), F.filter(stocks.codes_in_text(F.col(body)), lambda c: may_be(c)))
    # the outer form keeps the optimiser from repeating the text work in a filter pushed down
    texts = worded.withColumn("_hits", F.explode_outer(F.array(F.nullif(F.array_distinct(hits), F.array().cast("array<string>")))))
    texts = texts.where(F.col("_hits").isNotNull()).withColumn("_padded", _framed(F.array_join("_words", " "))).drop("_words")
    texts = texts.withColumn("_text", F.when(F.col("_text").rlike(f"[{HAN}]"), F.col("_text")))
    texts = texts if keep_body else texts.drop(body)
    texts = materialise(texts, "texts-with-hits")
    met = texts.select(article, F.explode("_hits").alias("key")).join(small(known), "key")
    candidates = met.groupBy(article).agg(F.collect_set(F.struct("name", "stock_code")).alias("_candidates"))
    named = F.filter(
        "_candidates", lambda c: c["name"].isNull() | F.coalesce(_occurs(F.col("_text"), F.col("_padded"), c["name"]), F.lit(False))
    )
    codes = F.array_distinct(F.transform(named, lambda c: c["stock_code"]))
    return texts.join(candidates, article).withColumn("_codes", codes).drop("_text", "_padded", "_candidates", "_hits")


def _one_row_per_code(rows: DataFrame) -> DataFrame:
    """The outer form keeps the optimiser from repeating the text work in an inferred filter."""
    return rows.withColumn("stock_code", F.explode_outer("_codes")).where(F.col("stock_code").isNotNull())


def keyword_words(body: Column, *lists: list[str]) -> Column:
    """The words of the text that occur in any of the lists, repeats kept: one pass over the text."""
    wanted = sorted({k for words in lists for k in words})
    return F.filter(F.split(F.trim(_padded(F.lower(body))), " "), lambda w: w.isin(wanted))


def _hits(body: Column, found: Column, keywords: list[str]) -> Column:
    """Occurrences of the keywords; Chinese ones are counted in the text, as they are not parted."""
    han = [k for k in keywords if re.search("[\u3400-\u9fff]", k)]
    count = F.size(F.filter(found, lambda w: w.isin(keywords)))
    return count + F.regexp_count(body, F.lit("|".join(han))) if han else count


def classify_types(body: Column, found: Column, keywords: dict[str, list[str]]) -> Column:
    """Struct (primary, secondary) by keyword counts; ties in the order of the types.

    ``found`` is the column of ``keyword_words``.  No keyword at all gives
    GENERAL_ANNOUNCEMENT.  Stands in for a model's answer.
    """
    counted = F.array(*[
        F.struct((-_hits(body, found, keywords[name])).alias("n"), F.lit(place).alias("place"), F.lit(name).alias("name"))
        for place, name in enumerate(params.EVENT_TYPES) if keywords.get(name)
    ])
    hit = F.filter(F.array_sort(counted), lambda t: t["n"] < 0)
    primary = F.coalesce(F.get(hit, F.lit(0))["name"], F.lit("GENERAL_ANNOUNCEMENT"))
    return F.struct(
        primary.alias("primary"), scores.secondary_type(primary, F.get(hit, F.lit(1))["name"]).alias("secondary")
    )


def classify_sentiment(body: Column, found: Column, positive: list[str], negative: list[str]) -> Column:
    """Struct (label, score): balance of positive and negative keywords over their sum."""
    up, down = _hits(body, found, positive), _hits(body, found, negative)
    balance = F.coalesce((up - down) / F.nullif(up + down, F.lit(0)), F.lit(0.0))
    return F.struct(
        F.when(balance > 0, "POSITIVE").when(balance < 0, "NEGATIVE").otherwise("NEUTRAL").alias("label"),
        F.abs(balance).alias("score"),
    )


def checked_entities(found: DataFrame) -> DataFrame:
    """Limits of the extracted fields, with one flag per correction."""
    limits = params.TEXT_LIMITS
    score, head, summary = F.col("sentiment_score"), F.col("headline"), F.col("entity_summary")
    repeated = F.coalesce(F.col("event_type_secondary") == F.col("event_type_primary"), F.lit(False))
    flags = F.array_compact(F.array(
        F.when(scores.out_of_range(score, 0.0, 1.0), "sentiment_score"),
        F.when(text.exceeds(head, limits["headline"]), "headline"),
        F.when(text.exceeds(summary, limits["entity_summary"]), "entity_summary"),
        F.when(repeated, "event_type_secondary"),
    ))
    return (
        found.withColumn("violations", flags)
        .withColumn("sentiment_score", scores.clip(score, 0.0, 1.0))
        .withColumn("headline", text.truncate(head, limits["headline"]))
        .withColumn("entity_summary", text.truncate(summary, limits["entity_summary"]))
        .withColumn(
            "event_type_secondary", scores.secondary_type(F.col("event_type_primary"), F.col("event_type_secondary"))
        )
    )


def entity_events(articles: DataFrame, master: DataFrame, keywords: dict[str, list[str]],
                  positive: list[str], negative: list[str], exchange: str = "HKEX") -> DataFrame:
    """One row per article and stock, in the stored entity-event shape.

    ``articles`` is the cleaned table with its raw columns.  An article without a stock gives
    no row; ``articles`` itself is the record of what was analysed.
    """
    body = F.col("body_cleaned")
    tagged = _with_codes(articles, master, "cleaned_id", "body_cleaned")
    # Once per article with a stock, before it is repeated for each of its stocks.
    has_stock = F.size("_codes") > 0
    analysed = (
        tagged.withColumn("_found", F.when(has_stock, keyword_words(body, *keywords.values(), positive, negative)))
        .withColumn("_t", F.when(has_stock, classify_types(body, F.col("_found"), keywords)))
        .withColumn("_s", F.when(has_stock, classify_sentiment(body, F.col("_found"), positive, negative)))
        .withColumn("_summary", F.left(body, F.lit(params.TEXT_LIMITS["entity_summary"] + 1)))
        .drop("body_cleaned", "_found")
    )
    return checked_entities(
        _one_row_per_code(analysed).select(
            text.derived_id(F.col("source_url"), F.col("stock_code")).alias("entity_event_id"),
            F.lit(exchange).alias("exchange"),
            "source_url", "source_name", "published_at", "stock_code",
            F.col("_t.primary").alias("event_type_primary"),
            F.col("_t.secondary").alias("event_type_secondary"),
            F.col("_s.label").alias("sentiment_label"),
            F.col("_s.score").alias("sentiment_score"),
            F.col("title_cleaned").alias("headline"),
            F.col("_summary").alias("entity_summary"),
            "created_at",
        )
    )
