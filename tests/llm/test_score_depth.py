"""The default model of op3 uses contexts past four bytes."""

import math
import random
import zlib

import brute

from moraine.llm import scoring


def test_default_equals_the_recursion_six_bytes_deep(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(("north wind ", "south wins ", "é")) for _ in range(rnd.randint(0, 4))) for _ in range(20)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in scoring.score_texts(docs).collect()}
    raw = [(t or "").encode() for t in texts]
    train = [t for i, t in enumerate(raw) if zlib.crc32(str(i).encode()) % 5 != 1]
    want = brute.ctw_log2(train, raw, 6)
    assert all(math.isclose(got[i], w * math.log10(2), rel_tol=1e-9) for i, w in enumerate(want))
    four = brute.ctw_log2(train, raw, 4)
    assert any(not math.isclose(a, b, rel_tol=1e-6) for a, b in zip(want, four, strict=True))
