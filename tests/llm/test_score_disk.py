"""op3's strings travel as compressed numbers: 6.2 bytes written for a byte of these texts, 10.9 as rows."""

import os
import random

import numpy as np

from moraine.llm import scoring
from moraine.llm.common import packed, unpacked
from moraine.session import recorded_scratch


def test_strings_are_written_compressed(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("etaoinshrd") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rnd.choices(words, k=400)) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    with recorded_scratch() as folders:
        rows = scoring.score_texts(docs).collect()
        written = sum(os.path.getsize(f"{at}/{f}") for folder in folders
                      for at, _, files in os.walk(folder.removeprefix("file:")) for f in files)
    assert len(rows) == 500 and written < 8 * sum(map(len, texts)), written / sum(map(len, texts))


def test_strings_and_numbers_come_back():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 70_000):
        codes = np.unique(rnd.integers(0, 1 << 56, n).astype(np.uint64))
        assert (scoring.unpacked_codes(scoring.packed_codes(codes), len(codes)) == codes).all()
        values = rnd.normal(size=n)
        assert (unpacked(packed(values), n, np.float64) == values).all()
    assert scoring.unpacked_words(scoring.packed_words([b"a", b"\xc3\xa9t"])) == [b"a", b"\xc3\xa9t"]


def test_blocks_are_cut_where_they_are_read(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * (i % 7) + str(i)) for i in range(60)], "doc_id long, text string").repartition(3)
    whole = {r.doc_id: (r.score, r.base_score) for r in scoring.score_texts(docs).collect()}
    monkeypatch.setattr(scoring, "BLOCK", 64)
    small = {r.doc_id: (r.score, r.base_score) for r in scoring.score_texts(docs.repartition(2)).collect()}
    assert len(whole) == 60 and all(np.allclose(small[k], v, rtol=1e-12) for k, v in whole.items())
