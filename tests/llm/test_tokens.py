import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from newsflow.llm import packing, tokenfile, tokens

PATH = tokens.tokenizer_path()
PLAIN = Tokenizer.from_file(PATH)
TEXTS = [
    "", " ", "Hello, WORLD!!! don't it's 12 3x4 a--b c'est", "É è ÀÉß ñ İI ı ΑΣ ς ﬁ ǆ", "<|startoftext|> a <|endoftext|>b <|STARTOFTEXT|>", "a\x01b \x01 \x01\x01",
    "é É ́x K Å", "  x\u0085y z\x1cw", "日本語 テスト한국어", "\U0001F600\U0001F1E9\U0001F1EA", "the,*** the.%%% &&& ''' 's'm", "a" * 5000,
]


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check(values):
    ids, cuts = tokens.encoder(PATH).encode(pa.array(values, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [plain(v) for v in values]


def test_word_ids_are_the_tokenizers(spark, sf):
    check(TEXTS)
    check([])
    check([r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=40), max_size=4))
def test_any_text(values):
    check(values)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 70_000), max_size=30), max_size=5))
def test_coding_round_trip(rows):
    cuts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    coded = tokenfile.encode_ranks(np.array([v for r in rows for v in r], dtype=np.uint32), cuts)
    assert [tokenfile.decode_ranks(c, d, len(r)).tolist() for (c, d), r in zip(coded, rows)] == rows


def test_coded_sizes():
    (control, data), = tokenfile.encode_ranks(np.array([0, 255, 256, 65_536, 1 << 24], dtype=np.uint32), np.array([0, 5]))
    assert (len(control), len(data)) == (2, 1 + 1 + 2 + 3 + 4)


def test_files_of_awkward_rows(spark, tmp_path):
    rows = AWKWARD + [(20 + i, t) for i, t in enumerate(TEXTS)]
    tokenfile.write(documents(spark, rows), str(tmp_path / "files"), PATH)
    got = sorted(tokenfile.read(spark, str(tmp_path / "files")).collect(), key=lambda r: r["start"])
    want = sorted((i is not None, i or 0, crc(plain(t)), len(plain(t))) for i, t in rows)
    assert [(r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"], r["n_tokens"]) for r in got] == want
    starts = np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert [r["start"] for r in got] == starts


def test_empty_tables(spark, tmp_path):
    empty = documents(spark, [])
    tokenfile.write(empty, str(tmp_path / "none"), PATH)
    assert tokenfile.read(spark, str(tmp_path / "none")).count() == 0
    assert packing.packed_documents(empty, PATH).count() == 0


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing(spark, capacity):
    rows = AWKWARD + [(100 + i, "word " * (i * 7 % 23)) for i in range(60)]
    got = packing.packed_documents(documents(spark, rows), PATH, capacity).collect()
    total = sum(len(plain(t)) for _, t in rows)
    assert sum(r["length"] for r in got) == total
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["start"] == capacity * r["piece"]
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) <= 1.1 * total / capacity + 1


def test_best_fit_is_bounded():
    places, offsets = packing.best_fit([3, 3, 3, 1, 1, 1, 4], 4, 2)
    # two are open: the third 3 closes one with a free place of 1
    assert places[:3] == [0, 1, 2] and offsets == [0, 0, 0, 3, 3, 0, 0]
    assert len(set(places)) == 5


def test_sequences_hold_the_ids(spark):
    rows = [(i, "some words here " * i) for i in range(20)]
    frame = documents(spark, rows)
    made = {r["sequence_id"]: r["ids"] for r in packing.sequences(frame, PATH, 64).collect()}
    assert sorted(v for ids in made.values() for v in ids) == sorted(v for _, t in rows for v in plain(t))
    assert max(map(len, made.values())) <= 64


def test_words_sharing_units_are_looked_up_once():
    words = ["word,", "word", "word.", "don't", "straße,", "'word'", "...", "É,", "x1,"]
    first, second, units = tokens._units(pa.array(words))
    assert [units[a] + (units[b] if b >= 0 else "") for a, b in zip(first, second)] == words
    assert sorted(units) == sorted({"word", ",", ".", "don't", "straße", "'word'", "...", "É,", "x1,"})
