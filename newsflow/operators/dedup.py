"""Duplicate removal and insert-if-absent.

Groups of copies may be large, so every rule is an aggregate that combines before the
shuffle; no group is ever held as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow import params
from newsflow.session import distinct_keys, materialise, small


def first_links(links: DataFrame, *page: str, link: str = "link", position: str = "position") -> DataFrame:
    """Distinct links of each page, each at its first position."""
    return links.groupBy(*page, link).agg(F.min(position).alias(position))


def latest_version(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row with the greatest ``order`` values of each key."""
    payload = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*payload), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def title_keepers(raw: DataFrame) -> DataFrame:
    """Per title hash the identifier of the earliest row (ties by identifier)."""
    first = F.min(F.struct("created_at", "raw_id"))
    return raw.groupBy("raw_hash").agg(first["raw_id"].alias("raw_id"), F.count(F.lit(1)).alias("copies"))


def duplicate_titles(raw: DataFrame) -> DataFrame:
    """(raw_id, reject_reason) of every row whose title was published earlier."""
    keep = title_keepers(raw).select("raw_id")
    return (
        raw.select("raw_id")
        .join(keep, "raw_id", "left_anti")
        .withColumn("reject_reason", F.lit(params.DUPLICATE_TITLE))
    )


def hash_seen_live(candidates: DataFrame, raw: DataFrame) -> DataFrame:
    """Candidates whose title hash belongs to a live stored row."""
    known = distinct_keys(raw.where(~F.col("is_deleted")), "raw_hash")
    return candidates.join(known, "raw_hash", "left_semi")


def absent(candidates: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose key is not stored yet, one row per key (smallest row wins)."""
    fresh = candidates.join(distinct_keys(stored, *keys), keys, "left_anti")
    payload = [c for c in candidates.columns if c not in keys]
    if not payload:
        return fresh.distinct()
    return fresh.groupBy(*keys).agg(F.min(F.struct(*payload)).alias("_row")).select(*keys, "_row.*")


def absent_on_url_and_hash(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates whose address and title hash are both unknown to the stored table."""
    return candidates.join(distinct_keys(stored, "source_url"), "source_url", "left_anti").join(
        distinct_keys(stored, "raw_hash"), "raw_hash", "left_anti"
    )


# A key with more rows than this is joined by broadcast.  There are at most (all rows / HOT_ROWS)
# such keys.
HOT_ROWS = 1_000_000


def _with_first(rows: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """Adds ``first_<key>``, the earliest ``o`` of the row's key, and ``n_<key>``, its rows.

    The minimum combines before the shuffle.  Rows of hot keys get it by broadcast, where they
    are; only the others are shuffled to meet it.  ``rows`` is a stored table.
    """
    first = materialise(
        rows.groupBy(key).agg(F.min("o").alias(f"first_{key}"), F.count(F.lit(1)).alias(f"n_{key}")), "first"
    )
    hot = first.where(F.col(f"n_{key}") > hot_rows)
    if hot.isEmpty():
        return rows.join(first, key)
    cold = first.where(F.col(f"n_{key}") <= hot_rows)
    return rows.join(small(hot), key).unionByName(
        rows.join(small(hot.select(key)), key, "left_anti").join(cold, key)
    )


def first_accepted(rows: DataFrame, arrival: Column, key_a: str = "source_url", key_b: str = "raw_hash",
                   row_id: str = "raw_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Identifiers of the rows that two unique constraints would let in, in arrival order.

    A row is accepted unless its address or its hash belongs to an *accepted* earlier row.
    Deduplicating on one key after the other is wrong: of A(u1,h1), B(u2,h1), C(u2,h3) both
    A and C are accepted, as B never was stored.

    Of the rows sharing both keys only the first can be accepted, so copies collapse first,
    before the shuffle.  Each round then accepts the rows that come first for both of their
    keys and drops the rows that share a key with one of them.  At least the earliest
    undecided row is settled each time; the loop runs until none is left.
    """
    order = F.struct(arrival.alias("at"), F.col(row_id).alias("id"))
    undecided = materialise(
        rows.groupBy(F.col(key_a).alias("a"), F.col(key_b).alias("b")).agg(F.min(order).alias("o")), "undecided"
    )
    done = []
    while not undecided.isEmpty():
        seen = materialise(_with_first(undecided, "a", hot_rows), "seen")
        seen = materialise(_with_first(seen, "b", hot_rows), "seen")
        wins = (F.col("o") == F.col("first_a")) & (F.col("o") == F.col("first_b"))
        winners = seen.where(wins)
        done.append(winners.select(F.col("o.id").alias(row_id)))
        # A winner without rivals takes no other row with it.
        rivals = winners.where((F.col("n_a") > 1) | (F.col("n_b") > 1))
        undecided = materialise(
            seen.where(~wins)
            .select("a", "b", "o")
            .join(rivals.select("a"), "a", "left_anti")
            .join(rivals.select("b"), "b", "left_anti"),
            "undecided",
        )
    if not done:
        return undecided.select(F.col("o.id").alias(row_id))
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def insert_if_absent(candidates: DataFrame, stored: DataFrame | None, arrival: Column) -> DataFrame:
    """Rows of a batch that the raw table takes in, given what it already holds.

    All decisions are made on the keys alone; whole rows meet the result once.
    """
    keys = candidates.select("raw_id", "source_url", "raw_hash", arrival.alias("_arrival"))
    fresh = keys if stored is None else absent_on_url_and_hash(keys, stored)
    return candidates.join(first_accepted(fresh, F.col("_arrival")), "raw_id", "left_semi")


def insert_if_absent_in(candidates: DataFrame, addresses, hashes, arrival: Column) -> DataFrame:
    """The same against stores of addresses and hashes in buckets (``sources.buckets``), to which the accepted keys are added.

    Reads only the buckets in which a candidate's key may be, so a batch's cost does not grow with the store.
    """
    keys = materialise(candidates.select("raw_id", "source_url", "raw_hash", arrival.alias("_arrival")), "candidates")
    fresh = hashes.absent(addresses.absent(keys))
    accepted = materialise(candidates.join(first_accepted(fresh, F.col("_arrival")), "raw_id", "left_semi"), "accepted")
    for store in (addresses, hashes):
        store.append(accepted)
    return accepted
