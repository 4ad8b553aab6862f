"""Personal data by patterns, and by a skip-chain conditional random field around them.

Patterns give the base spans.  The field runs over a document's sites, the words
with a digit or an at sign.  Each has one of five states (none, or a kind), with
a log-linear score from its shape; neighbours share a potential, and so do
repeated sites: a word with the same letters or digits as an earlier one is tied
to its last occurrence, however far.  Loopy message passing over the whole batch
gives marginals; sites inside base spans are observed.  What is then almost
surely of a kind, though no pattern matches it, becomes a span too.

The scores are fitted piecewise on a bounded sample (``SAMPLE`` documents), where
the patterns are the labels.  Every document is read whole, in place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

SAMPLE = 3000  # documents the field is fitted on
SAMPLE_BYTES = 16 << 20  # and bytes of their texts, by whole documents
SLOTS = 1 << 14
SURE = 0.95  # marginal from which a site is taken
ROUNDS = 12
KINDS = ("email", "ip", "card", "phone")

# ------------------------------------------------------------------ patterns

#: The patterns of the contract.  A run of digits is entered at its start only, which finds the same.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
SITE = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
GAP = frozenset(" \t\n\v\f\r")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Every match has one at sign; what precedes it is one run of local characters, back to the last match."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    spans = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    spans += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_octet, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, m.start(), m.end()))
    if "+" in text:
        spans += [(3, m.start(), m.end()) for m in PHONE.finditer(text)
                  if 8 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return spans


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# ------------------------------------------------------------------ sites

def sites(text: str) -> list[tuple[int, int]]:
    """Words with a digit or an at sign, without marks at their edges."""
    found, done = [], 0
    for m in SITE.finditer(text):
        a, b = m.start(), m.end()
        while a > done and text[a - 1] not in GAP:
            a -= 1
        done = b
        while b > a and text[b - 1] in ".,;:!?\"'|":
            b -= 1
        while a < b and text[a] in "\"'|":
            a += 1
        if a < b:
            found.append((a, b))
    return found


def shape(word: str) -> str:
    """Digits as 0 and letters as a, runs of letters as one."""
    out = re.sub("[0-9]", "0", word[:256])
    return re.sub(r"[^\W0-9_]+", "a", out)


def features(word: str) -> list[int]:
    form = shape(word)
    digits = "".join(c for c in word[:256] if c in "0123456789")
    names = [f"f{form[:48]}", f"s{re.sub('0+', '0', form)[:48]}", f"n{min(len(digits), 24)}", f"a{word.count('@')}",
             f"o{word[:1] in '+('}"]
    if len(digits) >= 12:
        names.append(f"l{luhn(digits)}{len(digits) in range(16, 20)}")
    if form.count(".") == 3 and not form.strip("0."):
        names.append(f"i{all(map(_octet, word.split('.')))}")
    return [xxhash.xxh3_64_intdigest(n) % SLOTS for n in names]


def tie_keys(word: str) -> list[str]:
    """What makes two distant sites alike: the same letters, or the same digits if there are four or more."""
    digits = "".join(c for c in word if c in "0123456789")
    return ["=" + word.lower()] + (["#" + digits] if len(digits) >= 4 else [])


@dataclass
class Graph:
    """Sites of a batch of documents in one line, their observed states (-1: open) and edges."""

    doc: np.ndarray
    words: list[str]
    spans: list[tuple[int, int]]
    seen: np.ndarray
    edges: np.ndarray  # columns: from, to, kind of edge (0 touching, 1 further, 2 tied)


def graph(texts: list[str], bases: list[list[tuple[int, int, int]]], only_open: bool) -> Graph:
    doc, words, spans, seen, edges = [], [], [], [], []
    for d, (text, base) in enumerate(zip(texts, bases, strict=True)):
        own = sites(text)
        state, b = [0] * len(own), sorted(base, key=lambda s: (s[1], s[0]))
        at = 0
        for i, (x, y) in enumerate(own):
            while at < len(b) and b[at][2] <= x:
                at += 1
            for k, p, q in b[at:at + 4]:
                if p < y and x < q:
                    state[i] = k + 1
                    break
        if only_open and all(state):
            continue
        last: dict[str, int] = {}
        first = len(words)
        for i, (x, y) in enumerate(own):
            n = first + i
            if i:
                edges.append((n - 1, n, 0 if x - own[i - 1][1] <= 1 else 1))
            word = text[x:y]
            for key in tie_keys(word):
                if key in last:
                    edges.append((last[key], n, 2))
                last[key] = n
            doc.append(d)
            words.append(word)
            spans.append((x, y))
        seen += state
    return Graph(np.array(doc, np.int64), words, spans, np.array(seen, np.int64), np.array(edges, np.int64).reshape(-1, 3))


# ------------------------------------------------------------------ the field

@dataclass
class Field:
    weights: np.ndarray  # SLOTS x 5
    bias: np.ndarray
    pairs: np.ndarray  # 3 x 5 x 5, log potentials by kind of edge

    def scores(self, words: list[str]) -> np.ndarray:
        cache: dict[str, np.ndarray] = {}
        out = np.zeros((len(words), 5))
        for i, w in enumerate(words):
            if w not in cache:
                cache[w] = self.weights[features(w)].sum(0) + self.bias
            out[i] = cache[w]
        return out

    def marginals(self, g: Graph, observed: np.ndarray) -> np.ndarray:
        """Loopy sum-product over all documents of the batch at once; messages start even and are damped."""
        local = self.scores(g.words)
        local[observed > 0] = -40.0
        local[observed > 0, observed[observed > 0]] = 0.0
        if len(g.edges):
            a = np.concatenate([g.edges[:, 0], g.edges[:, 1]])
            b = np.concatenate([g.edges[:, 1], g.edges[:, 0]])
            one = self.pairs[g.edges[:, 2]]
            between = np.exp(np.concatenate([one, one.transpose(0, 2, 1)]))
            back = np.roll(np.arange(len(a)), len(g.edges))
            messages = np.zeros((len(a), 5))
            for _ in range(ROUNDS):
                total = local.copy()
                np.add.at(total, b, messages)
                out = total[a] - messages[back]
                out = np.exp(out - out.max(1, keepdims=True))
                new = np.log(np.einsum("ei,eij->ej", out, between) + 1e-300)
                new -= new.max(1, keepdims=True)
                moved = np.abs(new - messages).max()
                messages = 0.5 * messages + 0.5 * new
                if moved < 1e-4:
                    break
            np.add.at(local, b, messages)
        p = np.exp(local - local.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit(texts: list[str]) -> Field:
    """Site scores by penalised softmax regression, edge potentials from how often states meet; patterns are the labels."""
    g = graph(texts, [base_spans(t) for t in texts], False)
    weights, bias, pairs = np.zeros((SLOTS, 5)), np.array([0.0, -9, -9, -9, -9]), np.zeros((3, 5, 5))
    if not (g.seen > 0).any():
        return Field(weights, bias, pairs)
    lists = [features(w) for w in g.words]
    row = np.repeat(np.arange(len(lists)), list(map(len, lists)))
    slot = np.concatenate([np.array(x) for x in lists])
    target = np.eye(5)[g.seen]
    first, second, bias = np.zeros((SLOTS + 1, 5)), np.zeros((SLOTS + 1, 5)), np.zeros(5)
    for t in range(1, 121):
        z = np.zeros((len(lists), 5))
        np.add.at(z, row, weights[slot])
        z += bias
        p = np.exp(z - z.max(1, keepdims=True))
        miss = target - p / p.sum(1, keepdims=True)
        grad = np.zeros((SLOTS + 1, 5))
        np.add.at(grad, slot, miss[row])
        grad[:SLOTS] -= 0.05 * weights
        grad[SLOTS] = miss.sum(0)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        move = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        weights += move[:SLOTS]
        bias += move[SLOTS]
    share = (np.bincount(g.seen, minlength=5) + 1.0) / (len(g.seen) + 5.0)
    for kind in range(3):
        e = g.edges[g.edges[:, 2] == kind]
        met = np.full((5, 5), 0.0) + 2.0 * np.outer(share, share)
        np.add.at(met, (g.seen[e[:, 0]], g.seen[e[:, 1]]), 1.0)
        pairs[kind] = np.clip(np.log(met / met.sum() / np.outer(share, share)), -3, 3)
    return Field(weights, bias, pairs)


def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """Per document, spans of sites that no pattern covers; touching sites of one kind are one span."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    g = graph(texts, bases, True)
    if not len(g.words):
        return out
    p = field.marginals(g, g.seen)
    state = p.argmax(1)
    for i in np.flatnonzero((g.seen == 0) & (state > 0) & (p.max(1) >= SURE)).tolist():
        (a, b), kind, own = g.spans[i], int(state[i]) - 1, out[g.doc[i]]
        if own and own[-1][0] == kind and a - own[-1][2] <= 1:
            own[-1] = (kind, own[-1][1], b)
        else:
            own.append((kind, a, b))
    return out


FOUND = ("id {key}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base spans by kind, their digest, all spans as kind:start:end, and how many were added.

    Offsets are code points, ends exclusive; spans are ordered by kind, then
    start.  Null and empty texts have none.  Rows do not touch each other, so
    null and repeated ids are rows like any other.
    """
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    order = F.xxhash64(F.lit(31), "id")
    picked = rows.select("id").distinct().orderBy(order, "id").limit(SAMPLE)
    got, size = [], 0
    for row in rows.join(F.broadcast(picked), "id").orderBy(order, "id", "text").limit(SAMPLE).toLocalIterator():
        got.append(bytes(row.text).decode("utf-8", "replace"))
        size += len(row.text)
        if size > SAMPLE_BYTES:
            break
    shared = docs.sparkSession.sparkContext.broadcast(fit(got))

    def find(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [(t or b"").decode("utf-8", "replace") for t in part.column("text").to_pylist()]
                bases = [base_spans(t) if MARK.search(t) else [] for t in texts]
                more = added_spans(texts, bases, shared.value)
                counts = np.zeros((len(texts), 4), np.int64)
                for i, base in enumerate(bases):
                    for k, _, _ in base:
                        counts[i, k] += 1
                yield pa.record_batch({"id": part.column("id")} | {
                    f"n_{kind}": pa.array(counts[:, k]) for k, kind in enumerate(KINDS)} | {
                    "base_sha256": pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in bases]),
                    "spans": pa.array([written(sorted({*b, *m})) for b, m in zip(bases, more, strict=True)], pa.string()),
                    "n_added": pa.array([len(m) for m in more], pa.int64())})

    return rows.mapInArrow(find, FOUND.format(key=key)).withColumnRenamed("id", id_col)
