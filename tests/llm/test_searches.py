"""Top products, phrase mining and ranked search against plain versions, on odd tables too."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from moraine.llm import collocations, pivots, ranked_search

VECTORS = "vec_id long, embedding array<double>, row string, score int, cell string"
TEXTS = "doc_id long, text string, lang string, n int, row string"


def plain_products(rows, k, every):
    usable = [(i, v, [math.floor(64 * c) for c in e]) for i, (v, e) in enumerate(rows)
              if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    out = []
    for qi, qid, q in usable:
        if qid is None or qid % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, x)), vid is None, vid or 0, i) for i, vid, x in usable if i != qi)
        out += [(qid, rank, None if null else vid, -s) for rank, (s, null, vid, _) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def products(spark, rows, k=5, every=5, parts=3, **more):
    table = spark.createDataFrame([(i, e, "x", 1, "c") for i, e in rows], VECTORS).repartition(parts)
    got = pivots.top_products(table, k, every, **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def test_top_products_equal_full_comparison(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CANDIDATES", 16)
    monkeypatch.setattr(pivots, "QUERIES", 8)
    monkeypatch.setattr(pivots, "TASK_BLOCKS", 3)
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in centres[i % 4]]) for i in range(300)]
    rows += [(1000 + i, centres[0]) for i in range(60)]  # one vector many times
    assert products(spark, rows) == plain_products(rows, 5, 5)


def test_top_products_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (5, [0.0, 0.0]), (10, []), (15, None), (20, [1.0, None]), (25, [float("nan"), 1.0]),
            (30, [float("inf"), 0.0]), (None, [1.0, 2.0]), (None, [0.5, 2.0]), (35, [3.0]), (40, [-1.0, -2.0, 4.0]),
            (0, [1.0, 2.0]), (-5, [0.25, -0.25]), (3, [1e6, 1e6]), (45, [3e6, 2e6])]
    assert products(spark, rows) == plain_products(rows, 5, 5)


def test_top_products_past_64_bits_rank_exactly(spark):
    rows = [(0, [1e12, 1.0]), (1, [1e12, 2.0]), (2, [1e12, 1.0]), (3, [2e12, 1.0])]
    got = products(spark, rows, 3)
    assert [r[2] for r in got] == [3, 1, 2] and {r[3] for r in got} == {2**63 - 1}


def test_top_products_of_few_or_no_rows(spark):
    assert products(spark, []) == []
    assert products(spark, [(0, [1.0])]) == []
    assert products(spark, [(0, [0.0]), (1, [0.0])]) == [(0, 1, 1, 0)]


def plain_phrases(rows, least=10, share=50):
    f, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(" ".join(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: n for p, n in counts.items() if " " in p and n >= least}
        found = []
        for p, a in kept.items():
            w = p.split(" ")
            cuts = [(10**6 * a * a // (counts[" ".join(w[:k])] * counts[" ".join(w[k:])]), k) for k in range(1, len(w))]
            if any(f" {p} " in f" {longer} " and 100 * b >= share * a for longer, b in kept.items() if longer != p):
                continue
            score, k = min(cuts)
            found.append((-score, -a, p.encode(), p, counts[" ".join(w[:k])], counts[" ".join(w[k:])]))
        out += [(lang, rank, p, -a, left, right, totals[lang], -s)
                for rank, (s, a, _, p, left, right) in enumerate(sorted(found), 1)]
    return sorted(out)


def phrases(spark, rows, least=10, parts=4, **more):
    table = spark.createDataFrame([(i, t, g, 0, "r") for i, (t, g) in enumerate(rows)], TEXTS).repartition(parts)
    got = collocations.mine_phrases(table, least, **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("shards", [1, 3])
def test_phrases_equal_plain_counts(spark, monkeypatch, shards):
    monkeypatch.setattr(collocations, "BLOCK", 200)  # many blocks and so many shards with text
    rng = random.Random(3)
    words = ["New", "york", "city", "the", "of", "ÉTÉ", "a", "x1", "　wide"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",\n"]) for _ in range(rng.randint(0, 60))),
             rng.choice(["en", "de", None, "und", ""])) for _ in range(150)]
    rows += [("late pair words " * 12, "en"), (None, "en"), ("", None), (" \t.;", "fr"), ("only", "one")]
    assert phrases(spark, rows, shards=shards) == plain_phrases(rows)


def test_phrases_of_a_hot_text_and_of_no_text(spark):
    rows = [("same words here. Same words there", "en")] * 40
    assert phrases(spark, rows) == plain_phrases(rows)
    assert phrases(spark, []) == [] and phrases(spark, [(None, None), ("", "en")]) == []


def test_bloom_filter_size_does_not_grow(spark):
    small, large = (spark.range(n).selectExpr("'en' lang", "concat('w', id, ' v', id) phrase") for n in (1, 2000))
    bits = collocations.bloom_of(large)
    assert len(collocations.bloom_of(small)) == len(bits) == 1 << (collocations.BLOOM_BITS - 3)


def plain_search(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(text):
        return term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    held = [(i, d, Counter(terms(t))) for i, (d, t) in enumerate(docs)]
    full = [x for x in held if x[2]]
    count, length = len(full), sum(sum(x[2].values()) for x in full)
    df = Counter(t for x in full for t in x[2])
    out = []
    for item, text in items:
        scored = []
        for i, d, tf in full:
            m = 100 - 90 + (90 * sum(tf.values()) * count) // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                        for t in set(terms(text)) if tf[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, i))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d, _) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, parts=3, k=10):
    left = spark.createDataFrame([(d, t, "en", 0, "r") for d, t in docs], TEXTS).repartition(parts)
    right = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    got = ranked_search.search_items(left, right, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def test_ranked_search_equals_full_scoring(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "CHUNK", 20)
    monkeypatch.setattr(ranked_search, "LISTED", 4)
    monkeypatch.setattr(ranked_search, "SEEDS", 3)
    monkeypatch.setattr(ranked_search, "ITEMS", 4)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)] + ["Ünïts", "x-y", "A1"]
    docs = [(i, " ".join(rng.choices(words[i % 3::3], k=rng.randint(0, 40)))) for i in range(200)]
    docs += [(500 + i, "w1 w2 w3") for i in range(50)]  # ties and copies
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(15)]
    assert searched(spark, docs, items) == plain_search(docs, items)


@pytest.mark.parametrize("cells,listed", [(30, 2), (1, 32), (1 << 20, 4)])
def test_wide_chunks_are_cut_and_bounds_hold(monkeypatch, cells, listed):
    """The visit of a chunk by blocks gives the best rows of a full scoring, however the chunk is cut."""
    monkeypatch.setattr(ranked_search, "CELLS", cells)
    monkeypatch.setattr(ranked_search, "LISTED", listed)
    rng = random.Random(cells)
    docs = [dict.fromkeys(rng.sample(range(30), rng.randint(0, 12)), 0) for _ in range(60)]
    docs = [{t: rng.choice([5, 5, rng.randint(1, 90)]) for t in sorted(d)} for d in docs]
    bounds = np.cumsum([0, *map(len, docs)])
    chunk = ranked_search.Chunk({
        "rows": np.arange(60, dtype=np.int64).tobytes(), "ids": (np.arange(60, dtype=np.int64) // 2).tobytes(),
        "null_ids": np.zeros(60, bool).tobytes(), "bounds": bounds.astype("<i8").tobytes(),
        "t": np.array([t for d in docs for t in d], "<i8").tobytes(), "v": np.array([v for d in docs for v in d.values()], "<i8").tobytes()})
    items = [np.array(sorted(rng.sample(range(35), rng.randint(1, 9)))) for _ in range(20)]
    best, floor = [[] for _ in items], [1] * len(items)
    ranked_search._visit(chunk, 0, 60, items, best, floor, 5)
    for item, own in zip(items, best, strict=True):
        scores = [(-sum(d.get(t, 0) for t in item.tolist()), False, i // 2, i) for i, d in enumerate(docs)]
        assert own == sorted(x for x in scores if x[0] < 0)[:5]


def test_ranked_search_on_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "alpha beta"), (3, "alpha"), (3, "alpha"), (4, "... ---  "), (5, "word " * 3000 + "alpha")]
    items = [(None, "ALPHA"), (7, None), (8, ""), (9, "nowhere"), (7, "beta beta alpha"), (7, "beta beta alpha")]
    assert searched(spark, docs, items) == plain_search(docs, items)
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == [] and searched(spark, [(1, None)], items) == []
