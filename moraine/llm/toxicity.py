"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Only documents carry labels.  On a bounded sample of them, words whose parts
(whole word, first four and five bytes) occur significantly more often in toxic
documents than in clean ones are the labelled tokens.  A two-state chain is
trained on all tokens of the sample by its exact gradient; its marginals give
spans, and the expected number of toxic tokens and the largest marginal give the
document's probability through a small logistic regression.

The sample (``SAMPLE`` documents and half of ``SAMPLE_BYTES`` for either label) and the model stay small at
any size of the input; every document is scored in place, by its whole text.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from moraine.llm.common import fold
from moraine.llm.words import GAP_BYTE, split_words
from moraine.session import staged

SAMPLE = 2000  # documents of either label that the model is fitted on
SAMPLE_BYTES = 8 << 20  # and bytes of their texts, half for either label, by whole documents
SHARE = 64  # a text over this part of its label's bytes comes after all others
SLOTS = 1 << 18  # hashed weights
WORDS_HELD = 500_000
KINDS = np.zeros(256, np.uint8)
KINDS[list(b" \t\n\x0b\x0c\r")] = GAP_BYTE
EDGES = b".,;:!?|\"'()[]{}<>*_#"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def parts(word: bytes) -> list[bytes]:
    """A word without marks at its edges, and its first four and five bytes."""
    core = word.strip(EDGES)
    return [b"=" + core, b"4" + core[:4], b"5" + core[:5]] if core else [b"="]


def slots(word: bytes) -> list[int]:
    return [xxhash.xxh3_64_intdigest(p) % SLOTS for p in parts(word)]


# ------------------------------------------------------------------ the chain

@dataclass
class Chain:
    """Log weights of the second state against the first: moves [from][to], and the start."""

    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0

    def _ratios(self, odds: np.ndarray, begins: np.ndarray, back: bool) -> np.ndarray:
        """Running odds of the two states at every token, all documents in one line.

        The line is folded into columns.  Each column's steps multiply to one 2x2
        matrix, these are chained over the columns, and a second walk with the
        right entries gives every value; all steps are exact.
        """
        a = np.exp(self.moves)
        n = len(odds)
        columns = max(1, int(math.sqrt(n)) // 2)
        length = -(-n // columns)
        g = np.ones(columns * length)
        new = np.ones(columns * length, bool)
        if back:  # from the end; a document's last token has nothing after it
            g[:n], new[:n] = np.append(1.0, odds[::-1][:-1]), np.append(begins[1:], True)[::-1]
        else:
            g[:n], new[:n] = odds, begins
        g, new = g.reshape(columns, length).T, new.reshape(columns, length).T
        s = 1.0 if back else math.exp(self.start)

        def step(i: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if back:
                x2, y2 = a[0, 0] * x + a[0, 1] * g[i] * y, a[1, 0] * x + a[1, 1] * g[i] * y
                x2, y2 = np.where(new[i], 1.0, x2), np.where(new[i], 1.0, y2)
            else:
                x2, y2 = a[0, 0] * x + a[1, 0] * y, (a[0, 1] * x + a[1, 1] * y) * g[i]
                x2, y2 = np.where(new[i], 1.0, x2), np.where(new[i], s * g[i], y2)
            total = x2 + y2
            return x2 / total, y2 / total

        # what a column makes of either pure entry, with its scale against the other
        x, y = np.ones((2, columns)), np.zeros((2, columns))
        x[1], y[1] = 0.0, 1.0
        scale = np.zeros((2, columns))
        for i in range(length):
            if back:
                x2, y2 = a[0, 0] * x + a[0, 1] * g[i] * y, a[1, 0] * x + a[1, 1] * g[i] * y
                fresh = (np.ones(columns), np.ones(columns))
            else:
                x2, y2 = a[0, 0] * x + a[1, 0] * y, (a[0, 1] * x + a[1, 1] * y) * g[i]
                fresh = (np.ones(columns), s * g[i])
            x2, y2 = np.where(new[i], fresh[0], x2), np.where(new[i], fresh[1], y2)
            scale = np.where(new[i], 0.0, scale)
            total = x2 + y2
            scale += np.log(total)
            x, y = x2 / total, y2 / total
        u, v, entry = 1.0, 0.0, np.zeros((2, columns))
        relative = np.exp(np.clip(scale[1] - scale[0], -700, 700))
        for c in range(columns):
            entry[:, c] = u, v
            u, v = u * x[0, c] + v * relative[c] * x[1, c], u * y[0, c] + v * relative[c] * y[1, c]
            u, v = u / (u + v), v / (u + v)
        out = np.zeros((length, columns))
        x, y = entry
        for i in range(length):
            x, y = step(i, x, y)
            out[i] = y / np.maximum(x, 1e-300)
        line = out.T.reshape(-1)[:n]
        return line[::-1] if back else line

    def marginals(self, scores: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(second state) per token; odds from the left and from the right."""
        odds = np.exp(np.clip(scores, -30, 30))
        left, right = self._ratios(odds, begins, False), self._ratios(odds, begins, True)
        both = left * right
        return both / (1 + both), left, right


def fit_chain(words: list[bytes], token: np.ndarray, begins: np.ndarray, tags: np.ndarray,
              rounds: int = 40, rate: float = 0.3) -> tuple[np.ndarray, Chain]:
    """Weights and chain by Adam on the penalised log-likelihood of all tokens at once."""
    flat, sizes = array("q"), array("q")  # one list an attribute of all words, not a list a word
    for w in words:
        own = slots(w)
        flat.extend(own)
        sizes.append(len(own))
    owner, slot = np.repeat(np.arange(len(words)), np.frombuffer(sizes, np.int64)), np.frombuffer(flat, np.int64)
    weights, bias, chain = np.zeros(SLOTS), -3.0, Chain()
    heavy = 1.0 + 4.0 * tags  # rare state
    state = np.zeros((2, SLOTS + 6))
    inner = ~begins
    prev, cur = tags[:-1][inner[1:]], tags[1:][inner[1:]]
    seen = np.array([[np.sum((prev == i) & (cur == j)) for j in (0, 1)] for i in (0, 1)], float)
    for t in range(1, rounds + 1):
        per_word = np.bincount(owner, weights[slot], len(words)) + bias
        p, left, right = chain.marginals(per_word[token], begins)
        miss = (tags - p) * heavy
        a = np.exp(chain.moves)
        odds = np.exp(np.clip(per_word[token], -30, 30))
        l, r = left[:-1][inner[1:]], (odds * right)[1:][inner[1:]]
        z = a[0, 0] + a[0, 1] * r + a[1, 0] * l + a[1, 1] * l * r
        expected = np.array([[np.sum(a[0, 0] / z), np.sum(a[0, 1] * r / z)],
                             [np.sum(a[1, 0] * l / z), np.sum(a[1, 1] * l * r / z)]])
        by_word = np.bincount(token, miss, len(words))
        grad = np.concatenate([np.bincount(slot, by_word[owner], SLOTS) - 0.02 * weights, [miss.sum()],
                               (seen - expected).ravel() - 0.1 * chain.moves.ravel(),
                               [np.sum(tags[begins]) - np.sum(p[begins]) - 0.1 * chain.start]])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        weights += move[:SLOTS]
        bias += move[SLOTS]
        chain.moves = np.clip(chain.moves + move[SLOTS + 1:SLOTS + 5].reshape(2, 2), -6, 6)
        chain.start = float(np.clip(chain.start + move[-1], -6, 6))
    return np.append(weights, bias), chain


# ------------------------------------------------------------------ the model

def suspicious(words: list[bytes], token: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Of each distinct word, whether a part of it is significantly commoner in toxic documents (likelihood ratio, over all parts)."""
    number: dict[bytes, int] = {}
    flat, sizes = array("q"), array("q")
    for w in words:
        own = {number.setdefault(p, len(number)) for p in parts(w)}
        flat.extend(own)
        sizes.append(len(own))
    of_word, size = np.frombuffer(flat, np.int64), np.frombuffer(sizes, np.int64)
    first = np.cumsum(size) - size
    seen = np.unique(owner * len(words) + token)  # a word counts once a document, and so does a part
    doc, word = seen // len(words), seen % len(words)
    n_parts = size[word]
    at = np.arange(int(n_parts.sum())) + np.repeat(first[word] - (np.cumsum(n_parts) - n_parts), n_parts)
    seen = np.unique(np.repeat(doc, n_parts) * len(number) + of_word[at])
    doc, part_ids = seen // len(number), seen % len(number)
    in_clean, in_toxic = (np.bincount(part_ids[toxic[doc] == y], minlength=len(number)).tolist() for y in (0, 1))
    n = [int((toxic == y).sum()) for y in (0, 1)]
    bar = 2 * math.log(1 + len(number))

    def strong(part: bytes, at: int) -> bool:
        b, a = in_clean[at], in_toxic[at]
        rate = (a + b) / (n[0] + n[1])
        if part == b"=" or a / n[1] <= 3 * rate * n[1] / (n[0] + n[1]) or a * n[0] <= 20 * b * n[1]:
            return False
        terms = ((a, n[1] * rate), (b, n[0] * rate), (n[1] - a, n[1] * (1 - rate)), (n[0] - b, n[0] * (1 - rate)))
        return 2 * sum(k * math.log(k / e) for k, e in terms if k) >= bar

    bad = np.array([bool(in_toxic[i]) and strong(p, i) for p, i in number.items()])
    return np.bincount(np.repeat(np.arange(len(words)), size), bad[of_word], len(words)) > 0


@dataclass
class Model:
    weights: np.ndarray
    chain: Chain
    head: np.ndarray  # of 1, log(1 + expected toxic tokens), largest marginal

    def probability(self, expected: np.ndarray, largest: np.ndarray) -> np.ndarray:
        x = np.stack([np.ones_like(expected), np.log1p(expected), largest], 1)
        return 1 / (1 + np.exp(-np.clip(x @ self.head, -500, 500)))


def lined_up(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words per document, first token of each document, the token's document)."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    owner = np.repeat(np.arange(len(lists)), n)
    begins = np.zeros(len(owner), bool)
    begins[(np.cumsum(n) - n)[n > 0]] = True
    return n, begins, owner


def summary(p: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    largest = np.zeros(n)
    np.maximum.at(largest, owner, p)
    return np.bincount(owner, p, n).astype(float), largest  # of no words numpy counts in whole numbers


def fit(texts: pa.Array, toxic: np.ndarray, in_all: tuple[int, int]) -> Model:
    """``in_all``: clean and toxic documents among all labelled ones, which the sample stands for."""
    none = Model(np.append(np.zeros(SLOTS), -30.0), Chain(), np.array([-30.0, 0.0, 0.0]))
    if not toxic.any():
        return none
    documents = len(texts)
    split = split_words(texts, KINDS)
    token, owner, words = split.code, split.doc, split.dictionary.cast(pa.large_binary()).to_pylist()
    begins = np.ones(len(owner), bool)
    begins[1:] = owner[1:] != owner[:-1]
    bad = suspicious(words, token, owner, toxic) if not toxic.all() and words else np.zeros(len(words), bool)
    del split, texts  # only numbers are needed from here on
    weights, chain = none.weights, none.chain
    if bad.any() and len(token) > 1:
        tags = bad[token] & (toxic[owner] == 1)
        weights, chain = fit_chain(words, token, begins, tags.astype(float))
    model = Model(weights, chain, none.head)
    scores = np.array([weights[slots(w)].sum() for w in words]) + weights[-1]
    p = chain.marginals(scores[token], begins)[0] if len(token) else np.zeros(0)
    expected, largest = summary(p, owner, documents)
    x = np.stack([np.ones(documents), np.log1p(expected), largest], 1)
    weight = np.where(toxic == 1, in_all[1] / max(1, toxic.sum()), in_all[0] / max(1, (toxic == 0).sum()))
    weight = weight / weight.mean()
    head = np.zeros(3)
    for _ in range(30):  # Newton steps, lightly penalised
        q = 1 / (1 + np.exp(-np.clip(x @ head, -30, 30)))
        grad = x.T @ (weight * (toxic - q)) - 0.05 * head
        curve = (x * (weight * q * (1 - q) + 1e-9)[:, None]).T @ x + 0.05 * np.eye(3)
        head = head + np.clip(np.linalg.solve(curve, grad), -2, 2)
    model.head = head
    return model


class Emissions(dict):
    """Score of a word for the toxic state."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= WORDS_HELD:
            self.clear()
        out = self[word] = float(self.weights[slots(word)].sum() + self.weights[-1])
        return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Model:
    """Fit on ``SAMPLE`` labelled documents of either kind; held-out rows and null labels are left out.

    Sizes and hashes are sampled first, so each label goes on until it has its
    documents or its bytes, whatever the other one has; only picked texts are fetched.
    """
    known = labels.filter((fold(F.col(id_col)) != 0) & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)) \
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic"))
    in_all = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64(F.lit(29), "id")
    bound = SAMPLE_BYTES // 2
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    sizes = texts.select("id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("body"))
    # one row an id, a short one if there is any; copies of a text would make its words look significant
    sizes = sizes.join(known, "id").groupBy("id", "toxic").agg(
        F.min(F.struct((F.col("size") > bound // SHARE).alias("long"), "body", "size")).alias("row"))
    sizes = staged(sizes.groupBy("row.size", "row.body").agg(
        F.min(F.struct("row.long", order.alias("place"), "id", "toxic")).alias("row")).select("size", "body", "row.*"), "toxic-sizes")
    picked = []
    for label in (0, 1):
        left, first = bound, True
        for row in sizes.filter(F.col("toxic") == label).orderBy("long", "place", "id").limit(SAMPLE).collect():
            if row.size <= left or first:  # a text that does not fit is skipped; a label has one at least
                picked.append((row.id, row.toxic, row.size, row.body))
                left, first = left - row.size, False
    rows = docs.sparkSession.createDataFrame(
        picked, docs.select(F.col(id_col).alias("id")).schema.add("toxic", "integer").add("size", "integer").add("body", "long"))
    rows = texts.join(F.broadcast(rows), "id").filter("octet_length(text) = size AND xxhash64(text) = body") \
        .dropDuplicates(["id"]).orderBy(order, "id")
    got = rows.select("toxic", F.col("text").cast("string").alias("text")).toArrow().combine_chunks()
    toxic, raw = got.column("toxic").to_numpy().astype(np.int64), got.column("text")
    raw = pa.concat_arrays(raw.chunks) if raw.num_chunks else pa.array([], pa.string())
    return fit(raw, toxic, (in_all.get(0, 0), in_all.get(1, 0)))


SCORED = "id {key}, held_out boolean, score double, predicted int, toxic_tokens double, spans string"


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", keep: bool = False) -> DataFrame:
    """Per row: held_out, score, predicted, expected toxic tokens, and the spans tagged (start:end in code points).

    With ``keep``, the columns of ``docs`` instead of the id.  The score depends
    on the text alone; null and empty texts get what a text without any toxic
    token gets.  Without toxic labels every score is about 0.
    """
    key = docs.schema[id_col].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, label_col))

    def score(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        emit = Emissions(m.weights)
        for batch in source:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                texts = rows.column("text").to_pylist()
                lists = [t.lower().split() if t else [] for t in texts]
                n, begins, owner = lined_up(lists)
                scores = np.fromiter((emit[w] for ws in lists for w in ws), float, int(n.sum()))
                p = m.chain.marginals(scores, begins)[0] if len(scores) else scores
                expected, largest = summary(p, owner, len(texts))
                spans, ends = [""] * len(texts), np.cumsum(n)
                for i in np.flatnonzero(largest >= 0.5).tolist():
                    mine = p[ends[i] - n[i]:ends[i]]
                    spans[i] = ",".join(f"{w.start()}:{w.end()}" for w, q in zip(
                        WORD.finditer(texts[i].decode("utf-8", "replace")), mine.tolist(), strict=False) if q >= 0.5)
                probability = m.probability(expected, largest)
                out = {c: rows.column(c) for c in rows.schema.names if c != "text"}
                yield pa.record_batch(out | {
                    "score": pa.array(probability), "predicted": pa.array((probability >= 0.5).astype(np.int32)),
                    "toxic_tokens": pa.array(expected), "spans": pa.array(spans, pa.string())})

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    held = (fold(F.col(id_col)) == 0).alias("held_out")
    if keep:
        rows = docs.select(F.struct(*docs.columns).alias("kept_columns"), held, text)
        schema = T.StructType([rows.schema["kept_columns"], *T.StructType.fromDDL(SCORED.format(key=key)).fields[1:]])
        return rows.mapInArrow(score, schema)
    rows = docs.select(F.col(id_col).alias("id"), held, text)
    return rows.mapInArrow(score, SCORED.format(key=key)).withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they are."""
    return score_toxicity(docs, labels, keep=True, **columns).filter("predicted = 0").select("kept_columns.*")
