"""Packing against the tokenizer itself and a plain walk over the stream."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from moraine.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def test_words_give_the_ids_of_the_whole_text(tokenizer):
    rnd, words = random.Random(5), packing.WordIds(VOCABULARY)
    bits = ["a", "Don't", "'s", "été", "É", "İ", "ß", "é", "́", "x1", "42", ".", ",", "|", "...", " ", "\n", "\t",
            " ", " ", "\x1c", "\x0b", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "日本", "😀", "Σ", "ς", "_"]
    for _ in range(400):
        texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(10)]
        for text, ids in zip(texts, words.encode([t.encode() for t in texts], b""), strict=True):
            got = np.frombuffer(ids, "<u4").tolist()
            assert got == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_real_texts_and_a_small_cache(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 500)
    words = packing.WordIds(VOCABULARY)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for lo in range(0, len(texts), 20):
        some = texts[lo:lo + 20]
        for text, ids in zip(some, words.encode([t.encode() for t in some], b""), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_slice_gives_the_ids_of_its_texts():
    rnd, words = random.Random(6), packing.WordIds(VOCABULARY)
    bits = ["a", "Don't", "'s", "Été", "ß", "x1", "42", ".", "...", " ", "\n", "\t\x0b", "\x1c", "日本", "Σ", " word "]
    for _ in range(100):
        texts = [rnd.choice([None, "", "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))]) for _ in range(rnd.randint(0, 9))]
        ids, n = words.encode_slice(pa.array(texts, pa.string()), 1)
        want = words.encode([(t or "").encode() for t in texts], np.array([1], "<u4").tobytes())
        assert ids.to_pylist() == want and n.tolist() == [len(w) // 4 for w in want]


@pytest.mark.parametrize("total", [0, 1, 7, 8, 9, 40, 47])
def test_edges_leave_no_padding(total):
    edges = packing.window_edges(total, 8)
    sizes = np.diff(edges)
    assert edges[0] == total // 8 * 8 and edges[-1] == total
    assert all(n & (n - 1) == 0 for n in sizes.tolist())


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("window", [4, 2048])
def test_pieces_tile_the_stream(spark, tokenizer, window):
    texts = ["one two three", None, "", "a b c d e f g h i j k l m n o p " * 30, "one two three", "x"]
    docs = rows_of(spark, texts).repartition(3).unionAll(spark.createDataFrame([(None, "no id")], "doc_id long, text string"))
    got = packing.pack(docs, VOCABULARY, window, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in [*enumerate(texts), (None, "no id")]:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted(by_doc[doc_id])
        assert sum((p[1] for p in parts), []) == want and {p[2] for p in parts} == {len(want)}
    sizes = []
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(n == window or (n < window and n & (n - 1) == 0) for n in sizes)
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_empty_table_and_clashing_columns(spark):
    assert packing.pack(rows_of(spark, []), VOCABULARY).collect() == []
    odd = spark.createDataFrame([(1, "hi", 5, "z")], "doc_id long, text string, n long, part string")
    assert packing.pack(odd, VOCABULARY).count() == 1
