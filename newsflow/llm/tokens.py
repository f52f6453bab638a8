"""Token ids of whole texts with a public tokenizer, encoded once per distinct word.

The tokenizer drops white space and never joins text across it, so the ids of a text are the ids
of its words one after another.  Each worker keeps the ids of the words it has seen.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from newsflow.llm import arrow

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Words whose ids a worker remembers, in two generations: the older one is dropped when the newer is full.
KNOWN_WORDS = 800_000
#: Text bytes encoded at a time: the more, the fewer distinct words per word.
TEXT_BYTES = 8 << 20
#: Letters then punctuation: two units that the tokenizer always separates.
_PLAIN = "^[a-zß-öø-ÿ]+[!-&(-/:-@\\[-`{-~]*$"
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = "^[a-zß-öø-ÿ]+"
_MARK = "\x01"
_JOINED = 1000


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _units(words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The units of each word: number of the first and of the second one (-1 for none), and the distinct units."""
    plain = pc.match_substring_regex(words, _PLAIN)
    letters = pc.if_else(plain, pc.ascii_rtrim(words, characters=_PUNCTUATION), words)
    closed = np.flatnonzero(np.asarray(pc.binary_length(letters)) < np.asarray(pc.binary_length(words)))
    closing = pc.replace_substring_regex(words.take(pa.array(closed)), _LETTERS, "")
    coded = pa.concat_arrays([letters, closing]).dictionary_encode()
    number = np.asarray(coded.indices).astype(np.int64)
    second = np.full(len(words), -1, dtype=np.int64)
    second[closed] = number[len(words) :]
    return number[: len(words)], second, coded.dictionary.to_pylist()


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """The pieces of an array one after another, by their numbers among all pieces."""
    counts = lengths[pieces]
    ends = np.cumsum(counts)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[pieces] - (ends - counts), counts)]


class WordEncoder:
    """Ids of texts, the same as ``Tokenizer.encode(text, add_special_tokens=False)``.

    For tokenizers that lower-case and split at white space, as ``word_bpe_49k.json``.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.vocabulary = self.tokenizer.get_vocab_size()
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, units: list[str]) -> None:
        plain = [u for u in units if _MARK not in u] if self.mark is not None else []
        for low in range(0, len(plain), _JOINED):
            part = plain[low : low + _JOINED]
            joined = self.tokenizer.encode_batch_fast([f" {_MARK} ".join(part)], add_special_tokens=False)[0]
            ids = np.array(joined.ids, dtype=np.uint32)
            ends, raw = (4 * np.flatnonzero(ids == self.mark)).tolist(), ids.tobytes()
            for unit, start, end in zip(part, [0, *(e + 4 for e in ends)], [*ends, len(raw)]):
                self.known[unit] = raw[start:end]
        for unit in units:
            if unit not in self.known:
                self.known[unit] = self.whole(unit).tobytes()

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each."""
        first, second, units = _units(words)
        if len(self.known) > KNOWN_WORDS // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [u for u in units if u not in known]
        known.update((u, older[u]) for u in new if u in older)
        self._learn([u for u in new if u not in known])
        coded = [known[u] for u in units]
        flat = np.frombuffer(b"".join(coded), dtype=np.uint32)
        lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // 4
        parts = np.stack([first, second], axis=1).ravel()
        parts = parts[parts >= 0]
        ids = _gathered(flat, np.cumsum(lengths) - lengths, lengths, parts)
        counts = lengths[first]
        counts[second >= 0] += lengths[second[second >= 0]]
        return ids, counts

    def encode(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, each text closed by the end id, and the texts' offsets in it."""
        values = values.cast(pa.string())
        special = np.asarray(pc.match_substring(values, "<|"))  # may hold a special token: encoded whole
        plain = pc.if_else(pa.array(special), "", values) if special.any() else values
        number, words, offsets = arrow.distinct_words(pc.ascii_lower(plain))
        flat, lengths = self._words(words)
        flat, lengths = np.append(flat, np.uint32(END_ID)), np.append(lengths, 1)
        number = np.insert(number.astype(np.int64), offsets[1:], len(words))
        ends = np.cumsum(lengths[number])
        ids = _gathered(flat, np.cumsum(lengths) - lengths, lengths, number)
        cuts = np.concatenate([[0], ends[offsets[1:] + np.arange(len(values))]]) if len(values) else np.zeros(1, np.int64)
        if special.any():
            parts = [
                np.append(self.whole(values[i].as_py()), np.uint32(END_ID)) if odd else ids[cuts[i] : cuts[i + 1]]
                for i, odd in enumerate(special.tolist())
            ]
            ids = np.concatenate(parts).astype(np.uint32)
            cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, cuts


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their texts' ids and offsets."""
    coder = encoder(path)
    for batch in arrow.slices(batches, limit=TEXT_BYTES):
        yield batch, *coder.encode(arrow.texts(batch))


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").data)
