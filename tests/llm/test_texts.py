"""Text operators against plain versions, and on odd tables: nulls, empty and very long texts, ties, clashing names."""

import hashlib
import math
import random
import re
import zlib

import brute
import numpy as np
import pytest

from moraine.llm import exact_dedup, fingerprints, jaccard, mixing, pii, scoring, toxicity, url_rules

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, id string, n long, block long, kept_columns int"
WORDS = "the of stone river light under old north wind paper green idle".split()


def odd_rows():
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    texts += [texts[0], texts[0] + " ", texts[1].upper(), "\t" + texts[2], None, "", " \n", "a", "été ÉTÉ 日本 😀", texts[3] + " extra"]
    texts += ["long " * 60_000, "long " * 60_000, "x" * 200_000]
    ids = [*range(len(texts) - 4), 3, 3, None, None]  # repeated and null ids
    rows = [(i, t, None, rnd.choice(["a", "b", "c", None]) if k % 3 else "hot", k, 7, "z", 1, 2, 3)
            for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return rows + [rows[5], rows[5]]  # whole rows repeated


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).coalesce(2)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return (x is None, x or 0)


# ------------------------------------------------------------------ exact copies

def test_exact_groups(odd, none):
    rows = odd_rows()
    body = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    want = sorted((key(r[0]), hashlib.sha256(b.encode()).hexdigest(), body.count(b),
                   key(min((x[0] for x, y in zip(rows, body, strict=True) if y == b), key=key)))
                  for r, b in zip(rows, body, strict=True))
    got = exact_dedup.exact_groups(odd).collect()
    assert sorted((key(g.doc_id), g.text_sha256, g.group_size, key(g.keep_id)) for g in got) == want
    assert sum(g.kept for g in got) == len(set(body))
    assert exact_dedup.exact_groups(none).collect() == []


def test_rounds_tell_late_differences_apart(spark):
    texts = ["p" * n + tail for n in (0, 63, 64, 65, 127, 128, 4095, 4160, 9000) for tail in ("a", "b", "a", "")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {i: texts.index(t) for i, t in enumerate(texts)}


def test_drop_copies_keeps_columns(odd):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in odd_rows()})


# ------------------------------------------------------------------ mixing

def test_mix_counts(odd, none):
    rows = odd_rows()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    totals = {s: sum(n for r, n in zip(rows, size, strict=True) if r[3] == s) for s in sources}
    want = brute.targets(totals, {s: i % 3 + 1 for i, s in enumerate(sources)})
    got = mixing.mix_counts(odd).collect()
    assert sorted((key(g.doc_id), g.size) for g in got) == sorted((key(r[0]), n) for r, n in zip(rows, size, strict=True))
    taken = {}
    for g in got:
        assert g.taken <= 3 * g.size and g.taken == g.size * g.times
        (source,) = [s for s in sources if totals[s] == g.source_size]
        assert math.isclose(g.target, want[source])
        taken[source] = taken.get(source, 0) + g.taken
    for s in sources:
        largest = max(n for r, n in zip(rows, size, strict=True) if r[3] == s)
        assert abs(taken[s] - want[s]) <= largest / 2 + 1e-6
    assert sorted(map(tuple, mixing.mix_counts(odd).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mix_counts(none).collect() == []


def test_mix_shards_share_the_quotas():
    quotas = np.array([1000, 1, 0, 333])
    leaves = [mixing._tree_leaf(i, 13, quotas, 5) for i in range(13)]
    for k, q in enumerate(quotas.tolist()):
        stretches = sorted((int(s[k]), int(s[k] + n[k])) for s, n in leaves if n[k])
        assert sum(b - a for a, b in stretches) == q
        assert all(x[1] == y[0] for x, y in zip(stretches, stretches[1:], strict=False))
    totals = [int(n.sum()) for _, n in leaves]
    assert max(totals) - min(totals) <= 4


def test_mixed_rows_repeat_whole_documents(odd):
    out = mixing.mixed(odd, shard_words=5000)
    assert out.columns[:len(odd.columns)] == odd.columns
    rows = out.collect()
    by_text = {}
    for g in mixing.mix_counts(odd).collect():
        by_text[g.doc_id] = by_text.get(g.doc_id, 0) + g.times
    seen = {}
    for r in rows:
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {k: v for k, v in by_text.items() if v}
    places = {}
    for r in rows:
        places.setdefault(r.mix_shard, []).append(r.mix_place)
    assert len(places) > 3 and all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())


# ------------------------------------------------------------------ scoring

def test_scores_equal_the_recursion(spark, none):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab c\né") for _ in range(rnd.randint(0, 40))) for _ in range(25)] + ["", None, "zq"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in scoring.score_texts(docs, depth=3).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    raw = [(t or "").encode() for t in texts]
    train = [t for i, t in enumerate(raw) if not held[i]]
    want = brute.ctw_log2(train, raw, 3)
    words = [t.lower().split() + [None] for t in raw]
    counts = {}
    for i, ws in enumerate(words):
        for w in ws if not held[i] else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, r in got.items():
        assert r.held_out == held[i] and r.train_tokens == n and r.n_tokens == len(words[i])
        assert r.n_known == sum(w in counts for w in words[i])
        assert math.isclose(r.base_score, sum(math.log10((counts.get(w, 0) + .5) / (n + .5 * (v + 1))) for w in words[i]))
        assert math.isclose(r.score, want[i] * math.log10(2), rel_tol=1e-9)
    assert scoring.score_texts(none).collect() == []


def test_scores_on_odd_rows(odd):
    got = scoring.score_texts(odd).collect()
    assert len(got) == len(odd_rows()) and all(g.score < 0 and math.isfinite(g.score) for g in got)
    alone = scoring.score_texts(odd.filter("doc_id = 1")).collect()  # one row, learned or held out
    assert len(alone) == 1 and math.isfinite(alone[0].score)


def test_places_find_every_key():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(0, 1 << 41, 50_000).astype(np.uint64))
    at = rnd.integers(0, len(keys), 200_000)
    assert (scoring.Places(keys).find(keys[at]) == at).all()


# ------------------------------------------------------------------ toxicity

def chain_by_enumeration(scores, begins, chain):
    out, lo = [], 0
    starts = [*np.flatnonzero(begins), len(scores)]
    for lo, hi in zip(starts, starts[1:], strict=False):
        total, mass = 0.0, np.zeros(hi - lo)
        for tags in np.ndindex(*(2,) * (hi - lo)):
            s = tags[0] * chain.start + sum(t * scores[lo + i] for i, t in enumerate(tags))
            s += sum(chain.moves[a, b] for a, b in zip(tags, tags[1:], strict=False))
            total += math.exp(s)
            mass += math.exp(s) * np.array(tags)
        out += list(mass / total)
    return np.array(out)


def test_marginals_equal_enumeration():
    rnd = np.random.default_rng(4)
    for _ in range(20):
        sizes = rnd.integers(1, 9, 12)
        begins = np.zeros(sizes.sum(), bool)
        begins[np.cumsum(sizes) - sizes] = True
        scores = rnd.normal(0, 3, len(begins))
        chain = toxicity.Chain(rnd.normal(0, 2, (2, 2)), float(rnd.normal()))
        got = chain.marginals(scores, begins)[0]
        assert np.allclose(got, chain_by_enumeration(scores, begins, chain), atol=1e-9)


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs, labels)
    got = {r.doc_id: r for r in scored.collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= .5) for r in got.values())
    known = [(got[r.doc_id], r.toxic) for r in labels.collect()]
    assert all(r.predicted == 0 for r, y in known if y == 0)
    assert np.mean([r.predicted for r, y in known if y == 1]) > 0.55
    a = {r.score for r in got.values()}
    assert len(a) > 100


def test_toxicity_on_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 1, 1), (3, 1, None), (1, 1, 0), (2, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    assert len(toxicity.score_toxicity(odd, labels).collect()) == len(odd_rows())
    assert toxicity.score_toxicity(none, labels).collect() == []
    unlabelled = toxicity.score_toxicity(odd, labels.limit(0)).collect()
    assert all(r.score < 0.01 and r.predicted == 0 for r in unlabelled)
    assert toxicity.without_toxic(odd, labels.limit(0)).columns == odd.columns


# ------------------------------------------------------------------ fingerprints

def test_fingerprints(odd, none):
    rows = [r for r in odd_rows() if r[0] is not None]
    got = fingerprints.fingerprint_edits(odd.filter("doc_id IS NOT NULL AND doc_id <> 3 AND doc_id <> 5")).collect()
    line = sorted({(r[0], r[1] or "") for r in rows if r[0] not in (3, 5)}, reverse=True)
    assert [r.doc_id for r in sorted(got, key=lambda r: -r.doc_id)] == [i for i, _ in line]
    by = {r.doc_id: r for r in got}
    for k, (i, text) in enumerate(line):
        after, n = line[(k + 1) % len(line)][1], len(text)
        edit = text[:n - n // 2] + after[:n // 2]
        assert by[i].n_chars == n and by[i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert by[i].edited_fingerprint == fingerprints.Parsed(edit.encode()).signature.hex()
        assert by[i].fingerprint == fingerprints.Parsed(text.encode()).signature.hex()
        assert 0 <= by[i].near_edited <= 1 and 0 <= by[i].near_next <= 1
    assert len(fingerprints.fingerprint_edits(odd).collect()) == len(odd_rows())
    assert len(fingerprints.fingerprint_edits(odd.filter("doc_id = 1")).collect()) == 1
    assert fingerprints.fingerprint_edits(none).collect() == []


def test_phrases_are_those_of_the_plain_parse():
    rnd = random.Random(3)
    for _ in range(50):
        data = bytes(rnd.choice(b"abc ") for _ in range(rnd.randint(0, 300)))
        seen, start = set(), 0
        for end in range(1, len(data) + 1):
            if data[start:end] not in seen:
                seen.add(data[start:end])
                start = end
        ends, _ = fingerprints.parse(data, {})
        starts = [0, *ends[:-1]] if ends else []
        assert {data[a:b] for a, b in zip(starts, ends, strict=True)} == seen
        hashes = fingerprints.phrase_hashes(data, ends, starts) if ends else []
        assert len(set(map(int, hashes))) == len(seen)
    estimate = fingerprints.likeness(fingerprints.signature(np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)),
                                     fingerprints.signature(np.arange(501, 1501, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    assert abs(estimate - 1 / 3) < 0.15


# ------------------------------------------------------------------ shingle join

def test_jaccard_components(spark, odd, none):
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = sorted((tuple(r) for r in jaccard.jaccard_components(odd).collect()), key=str)
    assert got == sorted(brute.jaccard_components(rows), key=str)
    assert jaccard.jaccard_components(none).collect() == []


def test_a_large_group_of_near_copies(spark):
    rnd = random.Random(8)
    base = [rnd.choice(WORDS) + str(rnd.randint(0, 50)) for _ in range(120)]
    texts = []
    for _ in range(300):
        words = list(base)
        for _ in range(rnd.randint(0, 5)):
            words[rnd.randrange(len(words))] = "new" + str(rnd.randint(0, 10_000))
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((4, 85), (5, 80)):
        got = sorted(tuple(r) for r in jaccard.jaccard_components(docs, k, percent).collect())
        assert got == sorted(brute.jaccard_components(rows, k, percent))
    kept = {r.doc_id for r in jaccard.keep_one(docs).collect()}
    assert kept == {c for _, _, c in brute.jaccard_components(rows)}


# ------------------------------------------------------------------ urls

def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, kind) for kind, h, p in url_rules.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, kind = max(fits, key=lambda x: len(x[0])) if fits else (None, None)
    return host, path, rule, kind


def test_urls(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url")
    urls = ["HTTP://WWW.Example.COM/en/", "x://a.com", "x://a.com/", "x://com/", "noscheme", "", None, "a://b://c/d?e#f",
            "http://example.com/en", "http://ÀB.net/fr/x#y?z", "http://h.net?/es/", "http://xcom/", "\nhttp://n.com/\nq"]
    more = spark.createDataFrame([(-1 - i, u) for i, u in enumerate(urls)] + [(None, "http://q.org/a")], "page_id long, url string")
    every = pages.unionAll(more)
    got = url_rules.judge_urls(every).collect()
    given = {(r.page_id, r.url) for r in every.collect()}
    assert len(got) == len(given)
    by = {r.page_id: r for r in got}
    for page_id, url in given:
        host, path, rule, kind = plain_verdict(url)
        r = by[page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == kind if kind else r.verdict in ("allow", "block")
    assert any(r.mined for r in got)
    assert url_rules.judge_urls(every.limit(0)).collect() == []
    assert url_rules.judge_urls(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")).first().verdict == "allow"


def test_mined_rules_equal_counting(spark):
    rnd = random.Random(6)
    rows = [(sorted({rnd.choice("abcd") for _ in range(3)}), rnd.choice(["allow", "block", "block"])) for _ in range(200)]
    mined = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, known string"), 0.05, 0.6, 2).collect()
    want = set()
    sets = [set(t) for t, _ in rows]
    for size in (1, 2):
        from itertools import combinations
        for items in combinations("abcd", size):
            inside = [k for s, (_, k) in zip(sets, rows, strict=True) if set(items) <= s]
            for kind in ("allow", "block"):
                if inside and inside.count(kind) >= 0.05 * len(rows) and inside.count(kind) / len(inside) >= 0.6:
                    want.add((items, kind, round(inside.count(kind) / len(inside), 9)))
    assert {(tuple(sorted(r["items"])), r.verdict, round(r.confidence, 9)) for r in mined} == want


def test_a_site_of_one_template_is_mined_at_once(spark):
    """24 tokens that stand in the same urls are one item, not 2^24 item sets; other urls of the site follow their rule."""
    one = "http://a.b.c.d.e.example.com/en/p1/q/r/s?t=1&u=2&v=3&w=4"
    other = [(f"https://shop{i % 7}.net/es/x{i}", None) for i in range(60)]
    open_urls = ["http://a.b.c.d.e.example.org/q/r", "https://elsewhere.io/", "https://shop3.io/y"]
    urls = [one] * 200 + [u for u, _ in other] + open_urls
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judge_urls(pages).collect()}
    assert len(got) == len(urls) and got[0].verdict == "block" and got[0].rule == "example.com/en/"
    assert all(got[i].verdict in ("allow", "block") for i in range(260, 263))
    labelled = spark.createDataFrame([(["a", "b", "c"], "allow"), (["a", "b"], "block"), (["d"], "allow")] * 2, "tokens array<string>, known string")
    assert {r.token: r["item"] for r in url_rules.alike(labelled).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}


# ------------------------------------------------------------------ personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                    "card": lambda: 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}
            if good[name]():
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rnd = random.Random(1)
    for _ in range(20_000):
        text = "".join(rnd.choice("a1@.-+ 29(%é\n") for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("4111 1111 1111 1111") == [(2, 0, 19)]
    assert pii.base_spans("1" * 100_000 + "@" * 100_000 + "+" * 100_000) == []


def test_personal_data(spark, odd, none):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find_personal_data(docs).collect():
        base = plain_spans(texts[r.doc_id])
        line = pii.written(base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        spans = r.spans.split(",") if r.spans else []
        assert set(line.split(",") if line else []) <= set(spans) and len(spans) == len(base) + r.n_added
    assert len(pii.find_personal_data(odd).collect()) == len(odd_rows())
    assert pii.find_personal_data(none).collect() == []


def test_repeats_are_found_through_skip_edges():
    rnd = random.Random(9)
    def phone():
        return f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"
    texts = [" ".join(["word"] * 5 + [phone()] + ["text"] * 5) for _ in range(200)] + [f"room {i} of 12" for i in range(200)]
    field = pii.fit(texts)
    text = "call +1 (555) 555-0100 now. " + "word " * 50 + "again (555) 555-0100 please, room 7 of 12"
    (added,) = pii.added_spans([text], [pii.base_spans(text)], field)
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in added] == [("phone", "(555) 555-0100")]


# ------------------------------------------------------------------ all together

def test_pipeline(spark):
    import corpus_pipeline

    from moraine.llm.common import table

    docs = table(spark, FOLDER, "documents")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        n = docs.count()
        assert n > 0
        if name != "packing":
            assert docs.columns == columns
        if name in ("toxicity", "exact_dedup", "jaccard_join"):
            assert before * 0.5 < n <= before
        before = n
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


def test_exact_dedup_equals_sql(spark):
    import __spark_entry__ as entry
    from compare import compare, duck

    name = "op2_exact_dedup"
    assert compare(spark, duck(FOLDER), FOLDER, entry.queries()[name], entry.oracle_sql()[name]) is None
