"""Secrets in whole texts: fixed patterns, and a token-efficiency test for random strings.

Three base kinds are found by pattern: ``assign`` (a key word, ``:`` or ``=``, a value), ``access`` (access
key ids) and ``hex`` (runs of hexadecimal digits).  The fourth, ``random``, needs no pattern.  A byte-pair
vocabulary spends few tokens on strings that people write and many on strings drawn at random, so a run
of ``RUN`` or more characters of the secret alphabet whose characters per token are at most ``RATIO`` is
taken for random.  Known digests and identifiers are excluded first, as they are random or terse but no
secrets: digests of the usual lengths, UUIDs, and names, that is words of one case (with a capital at
most) and numbers, alone or joined by punctuation, which takes in dates, versions, host and file names.
A run that lies within a base span is not reported again.

The work is local to a row: one pass over the texts, no shuffle.

Defined results: a null or empty text has no span; null ids and repeated rows are kept as they come; a run of
any length is tested whole; a match of a base pattern that fails its length rule is dropped and not
retried; an empty table gives no rows; further columns are ignored (``redacted`` keeps them).
Positions are code points, the end exclusive.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.llm import arrow

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Shortest run that is tested, and the most characters per token of a random one.
RUN, RATIO = 16, 2.0
#: Runs are encoded in parts of this length, so that the time stays in proportion to it.
PART = 4096
KINDS = ("assign", "access", "hex")

# The patterns of the base kinds and their least lengths (of group 2, of the match, of the match).
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# the same matches as [0-9a-f]+ of 16 characters or more, since a run is always taken whole
_HEX = re.compile(r"[0-9a-f]{16,}")
_LEAST = {"assign": 12, "access": 18}

# What is known and therefore no secret.
_DIGEST = re.compile(r"(?i:(?:(?:md5|sha[0-9]{1,3})[-=_])?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{48}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}))[.=_/-]*")
_INTEGRITY = re.compile(r"sha(?:256|384|512)-[A-Za-z0-9+/]+={0,2}")
_UUID = re.compile(r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})[.=_/-]*")
_PIECE = r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"
_NAME = re.compile(rf"[._/=+-]*(?:[a-zA-Z]{{1,2}}[0-9]+|{_PIECE})(?:[._/=+-]+(?:[a-zA-Z]{{1,2}}[0-9]+|{_PIECE}))*[._/=+-]*")

_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def characters_per_token(run: str, path: str) -> float:
    coder = encoding(path)
    return len(run) / sum(len(coder.encode_ordinary(run[k : k + PART])) for k in range(0, len(run), PART))


def known(run: str) -> bool:
    """Digests, UUIDs and names."""
    return any(p.fullmatch(run) for p in (_NAME, _DIGEST, _UUID, _INTEGRITY))


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Spans of the base kinds by start, then kind."""
    spans = [("assign", m.start(), m.end(), m[0]) for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST["assign"]]
    spans += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= _LEAST["access"]]
    spans += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


@functools.lru_cache(maxsize=4)
def _runs(least: int) -> re.Pattern:
    return re.compile(rf"[A-Za-z0-9+/_.=-]{{{least},}}")


def random_spans(text: str, base: list[tuple[str, int, int, str]], path: str, least: int = RUN, ratio: float = RATIO) -> list[tuple[str, int, int, str]]:
    """Spans of runs that the vocabulary cannot shorten, outside base spans, without what is known."""
    spans, begun, reach = [], 0, 0
    for match in _runs(least).finditer(text):
        low, high = match.span()
        while begun < len(base) and base[begun][1] <= low:
            reach = max(reach, base[begun][2])
            begun += 1
        if high > reach and not known(match[0]) and characters_per_token(match[0], path) <= ratio:
            spans.append(("random", low, high, match[0]))
    return spans


def found(docs: DataFrame, path: str, least: int = RUN, ratio: float = RATIO) -> DataFrame:
    """doc_id with its ``base`` and ``added`` spans, for every row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def listed(rows: list[list[tuple]]) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end", "value"), s)) for s in spans] for spans in rows], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches):
            texts = arrow.texts(batch).to_pylist()
            base = [base_spans(t) for t in texts]
            added = [random_spans(t, b, path, least, ratio) for t, b in zip(texts, base)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), listed(base), listed(added)], ["doc_id", "base", "added"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, base {_SPANS}, added {_SPANS}")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    order = F.array(*(F.lit(k) for k in (*KINDS, "random")))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def report(docs: DataFrame, path: str) -> DataFrame:
    """Counts per kind, checksum of the base spans and all spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found(docs, path).select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(_ordered(F.concat("base", "added"))).alias("spans"), F.size("added").cast("bigint").alias("n_random"),
    )


def masked(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become the first."""
    out, at = [], 0
    for kind, low, high, _ in sorted(spans, key=lambda s: (s[1], (*KINDS, "random").index(s[0]))):
        if low >= at:
            out += [text[at:low], f"[{kind.upper()}]"]
        at = max(at, high)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with secrets masked in ``text``; all other columns as they were, a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches):
            changed = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                changed.append(text and masked(text, base + random_spans(text, base, path)))
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(changed, pa.string()))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
