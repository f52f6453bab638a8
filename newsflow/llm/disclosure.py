"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are e-mail addresses, IP addresses, card numbers and telephone numbers, found by
pattern in whole texts.  The words of a text outside its entities are its terms; they are counted with all
its entities over the whole corpus, a text counting once however often it is repeated.  A term
leaves an observer -log2 P(entity | term) bits short of naming the entity; P is estimated as texts with both
over texts with the term anywhere.  Terms of entities seen once are judged like all others, but a pair counts
only if chance does not explain it: texts with the term times the divergence of P(entity | term) from
P(entity), the share of all texts that hold the entity, must give ``EVIDENCE_BITS``.  In texts
that hold the entity, terms that leave at most ``REMOVE_BITS`` are removed and terms that leave at most
``GENERALISE_BITS`` are generalised.  Texts without an entity are never changed.

Defined results: a null text counts as empty and has no span; null ids are kept; equal rows give equal
results; a failing match (address part over 255, wrong check digit, wrong number of digits) is dropped and
not retried; an empty table gives no rows; further columns are ignored (``sanitised`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.names import unused
from newsflow.session import is_small, materialise

KINDS = ("email", "ip", "card", "phone")
REMOVE_BITS, GENERALISE_BITS = 0.5, 1.0
#: Evidence that a term and an entity belong together: chance gives such a pair in at most one of 2**EVIDENCE_BITS.
EVIDENCE_BITS = 5.0
#: Words of fewer letters are terms only if a text with an entity has them with a character other than a small letter.
TERM_LENGTH = 4
BROADCAST_ROWS = 500_000

# The patterns of the four kinds.  Each begins only where a run begins or a match ended,
# and never gives characters back, so that long runs take linear time; the matches are the same.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_TERM = r"[\p{L}\p{N}]++"
_NAMING = rf"[^\p{{Ll}}]|.{{{TERM_LENGTH}}}"

_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _matches(text: Column, pattern: Column, kind: str) -> Column:
    """Spans of all matches: what lies between them is split off, and lengths are added up."""
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda b, h: F.struct(F.length(b).alias("gap"), h.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(_SPAN).alias("found"))

    def add(so_far: Column, pair: Column) -> Column:
        low = so_far["at"] + pair["gap"]
        high = low + F.length(pair["hit"])
        span = F.struct(F.lit(kind).alias("kind"), low.alias("start"), high.alias("end"), pair["hit"].alias("value"))
        return F.struct(high.alias("at"), F.concat(F.coalesce(so_far["found"], _none()), F.array(span)).alias("found"))

    return F.coalesce(F.aggregate(pairs, start, add)["found"], _none())


def _none() -> Column:
    return F.array().cast(_SPAN)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(digits, i, F.lit(1)).cast("int")
        doubled = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The valid spans of each kind, by start.  Rare patterns are tried only where a cheap test allows."""
    count = lambda value: F.length(_digits(value))
    tried = {
        "email": (F.contains(text, F.lit("@")), _EMAIL, None),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), _IP, lambda s: s["value"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
        "card": (text.rlike("[0-9](?:[ -]?[0-9]){15}"), _CARD, lambda s: (count(s["value"]) <= 19) & _luhn(s["value"])),
        "phone": (F.contains(text, F.lit("+")), _PHONE, lambda s: count(s["value"]).between(8, 15)),
    }
    spans = {}
    for kind, (possible, pattern, valid) in tried.items():
        found = _matches(text, F.lit(pattern), kind)
        spans[kind] = F.when(possible, F.filter(found, valid) if valid else found).otherwise(_none())
    return spans


def _keyed(docs: DataFrame) -> DataFrame:
    """Text and the key of a row: equal keys mean equal rows."""
    return docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("_key", F.xxhash64("_text"))


def _apart(text: Column, base: Column) -> Column:
    """The text with blanks in place of its base spans, so that positions stay."""
    ordered = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(so_far: Column, span: Column) -> Column:
        low, high = F.greatest(so_far["at"], span["start"]), F.greatest(so_far["at"], span["end"])
        gap = F.substr(text, so_far["at"] + 1, low - so_far["at"])
        return F.struct(high.alias("at"), F.concat(so_far["out"], gap, F.repeat(F.lit(" "), high - low)).alias("out"))

    end = F.aggregate(ordered, begin, step)
    return F.concat(end["out"], F.substr(text, end["at"] + 1, F.length(text)))


def _terms(text: Column, naming: bool = False) -> Column:
    """Distinct lower-case words of a text; ``naming``: those that may name an entity."""
    words = F.regexp_extract_all(text, F.lit(_TERM), F.lit(0))
    words = F.filter(words, lambda w: w.rlike(_NAMING)) if naming else words
    return F.array_distinct(F.transform(words, F.lower))


def protected(docs: DataFrame) -> DataFrame:
    """Stored: one row per document with its base spans and, where it has any, its entities and the text apart from them."""
    rows = _keyed(docs)
    spans = base_spans(F.col("_text"))
    rows = rows.select("doc_id", "_key", "_text", *(spans[k].alias(k) for k in KINDS))
    base = F.concat(*KINDS)
    rows = rows.select("doc_id", "_key", "_text", base.alias("base"))
    entity = lambda s: F.concat(s["kind"], F.lit(":"), F.lower(s["value"]))
    some = F.size("base") > 0
    rows = rows.select(
        "doc_id", "_key", "base", F.when(some, F.array_distinct(F.transform("base", entity))).alias("entities"),
        F.when(some, _apart(F.col("_text"), F.col("base"))).alias("apart"),
    )
    return materialise(rows, "protected")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df, BROADCAST_ROWS) else df


def _evidence(together: Column, texts: Column, holding: Column, total: int) -> Column:
    """Bits of evidence against chance: texts with the term times the divergence of the two shares."""
    given, share = together / texts, holding / F.lit(total)
    rest = F.when(together < texts, (1 - given) * F.log2((1 - given) / (1 - share))).otherwise(0.0)
    return F.when(given > share, texts * (given * F.log2(given / share) + rest)).otherwise(0.0)


def _holders(found: DataFrame) -> DataFrame:
    """Stored: distinct texts with entities."""
    return materialise(found.where("entities is not null").select("_key", "entities", "apart").dropDuplicates(["_key"]), "holders")


def _classes(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored: the class and number of texts of each entity, and the classes of each text; entities of the same texts are one class."""
    each = held.select("_key", F.explode("entities").alias("entity"))
    both = [F.bit_xor(F.xxhash64("_key", F.lit(k))) for k in (1, 2)]
    classes = each.groupBy("entity").agg(F.count("*").alias("holding"), *(b.alias(f"x{k}") for k, b in enumerate(both)))
    classes = materialise(classes.select("entity", "holding", F.struct("x0", "x1").alias("class")), "classes")
    return classes, materialise(each.join(_small(classes), "entity").select("_key", "class", "holding").distinct(), "of_text")


def _disclosing(found: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of entities; class, term and ``bits`` at or under the threshold per text with both; texts with entities."""
    held = _holders(found)
    classes, of_text = _classes(held)
    keys = held.select("_key")
    keys = F.broadcast(keys) if is_small(held, BROADCAST_ROWS) else keys
    plain = _keyed(docs).select("_key", "_text").join(keys, "_key", "left_anti").dropDuplicates(["_key"])
    used = plain.select(F.explode(_terms(F.col("_text"))).alias("term"), F.lit(0).alias("held"))
    used = used.unionByName(held.select(F.explode(_terms(F.col("apart"))).alias("term"), F.lit(1).alias("held")))
    used = used.groupBy("term").agg(F.count("*").alias("texts"), F.sum("held").alias("held"))
    # no entity can be in more texts with the term than all entities are
    open_bits = F.log2(F.col("texts") / F.col("held"))
    used = used.where("held > 0").where(open_bits <= GENERALISE_BITS).select("term", "texts")
    naming = held.select(F.explode(_terms(F.col("apart"), naming=True)).alias("term")).distinct()
    terms = materialise(used.join(naming, "term", "left_semi"), "terms")
    pairs = held.select("_key", F.explode(_terms(F.col("apart"))).alias("term")).join(_small(terms), "term")
    pairs = materialise(pairs, "pairs").join(of_text, "_key")
    total = found.select("_key").distinct().count()
    judged = pairs.groupBy("class", "term").agg(
        F.count("*").alias("together"), F.first("texts").alias("texts"), F.first("holding").alias("holding")
    )
    evidence = _evidence(F.col("together"), F.col("texts"), F.col("holding"), total)
    bits = F.greatest(F.log2(F.col("texts") / F.col("together")), F.lit(0.0))
    judged = judged.where(evidence >= EVIDENCE_BITS).select("class", "term", bits.alias("bits")).where(F.col("bits") <= GENERALISE_BITS)
    judged = materialise(judged, "disclosing")
    return classes, pairs.select("_key", "class", "term").join(_small(judged), ["class", "term"]), held


def disclosing(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Per entity and term: ``bits`` that the term leaves open, for terms at or under the threshold."""
    classes, named, _ = _disclosing(found, docs)
    return named.select("class", "term", "bits").distinct().join(classes, "class").select("entity", "term", "bits")


def added_spans(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Per text, spans of disclosing terms in the texts that hold their entity (kinds ``removed``, ``generalised``)."""
    _, named, held = _disclosing(found, docs)
    kind = F.when(F.min("bits") <= REMOVE_BITS, "removed").otherwise("generalised")
    named = materialise(named.groupBy("_key", "term").agg(kind.alias("kind")), "named")
    words = F.regexp_extract_all("apart", F.lit(_TERM), F.lit(0))
    pieces = F.zip_with(F.slice(F.split("apart", F.lit(_TERM), -1), 1, F.size(words)), words, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("value")))
    at = held.join(named.select("_key").distinct(), "_key", "left_semi").select("_key", F.posexplode(pieces).alias("pos", "p"))
    end = F.sum(F.col("p.gap") + F.length("p.value")).over(Window.partitionBy("_key").orderBy("pos")).cast("int")
    at = at.select("_key", F.lower("p.value").alias("term"), "p.value", end.alias("end"))
    marked = at.join(named, ["_key", "term"]).select("_key", F.struct((F.col("end") - F.length("value")).alias("start"), "kind", "end", "value").alias("a"))
    ordered = F.array_sort(F.collect_list("a"))
    span = lambda a: F.struct(a["kind"].alias("kind"), a["start"].alias("start"), a["end"].alias("end"), a["value"].alias("value"))
    return marked.groupBy("_key").agg(F.transform(ordered, span).alias("added"))


def spans(docs: DataFrame) -> DataFrame:
    """Each document's ``base`` and ``added`` spans; an added span never overlaps a base one."""
    found = protected(docs)
    added = materialise(added_spans(found, docs), "added")
    joined = found.select("doc_id", "_key", "base").join(F.broadcast(added) if is_small(added, BROADCAST_ROWS // 10) else added, "_key", "left")
    apart = F.filter(F.coalesce("added", _none()), lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    return joined.select("doc_id", "_key", "base", apart.alias("added"))


def listed(spans: Column | str) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts per kind, checksum of the base spans and all spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return spans(docs).select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("bigint").alias("n_terms"),
    )


def masked(text: Column, marks: Column) -> Column:
    """The text with its spans replaced: kinds in brackets, removed terms by nothing; overlaps become one."""
    ordered = F.array_sort(F.transform(marks, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(so_far: Column, span: Column) -> Column:
        label = F.when(span["kind"] == "removed", "").when(span["kind"] == "generalised", "[TERM]").otherwise(
            F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        )
        apart = span["start"] >= so_far["at"]
        gap = F.substr(text, so_far["at"] + 1, F.greatest(span["start"] - so_far["at"], F.lit(0)))
        return F.struct(
            F.greatest(so_far["at"], span["end"]).alias("at"),
            F.when(apart, F.concat(so_far["out"], gap, label)).otherwise(so_far["out"]).alias("out"),
        )

    end = F.aggregate(ordered, begin, step)
    return F.concat(end["out"], F.substr(text, end["at"] + 1, F.length(text)))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with masked texts and ``n_chars`` to match, if it has that column; other columns as they were."""
    key, doc, text_key, found = unused(docs, "_key", "_doc", "_text_key", "_marks")
    marks = spans(docs).where((F.size("base") > 0) | (F.size("added") > 0)).select(
        F.col("doc_id").alias(doc), F.col("_key").alias(text_key), F.concat("base", "added").alias(found)
    ).dropDuplicates([doc, text_key])
    marks = materialise(marks, "marks")
    marks = F.broadcast(marks) if is_small(marks, BROADCAST_ROWS // 10) else marks
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = rows.join(marks, (F.col(key) == F.col(text_key)) & F.col("doc_id").eqNullSafe(F.col(doc)), "left")
    changed = F.col(found).isNotNull()
    text = F.when(changed, masked(F.col("text"), F.col(found))).otherwise(F.col("text")).alias("text")
    sanitised_columns = [text if c == "text" else F.col(c) for c in docs.columns]
    out = joined.select(*sanitised_columns, changed.alias(found))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
