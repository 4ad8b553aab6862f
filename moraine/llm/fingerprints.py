"""Lempel-Ziv phrase fingerprints and their likeness.

A text is parsed into the phrases that a growing dictionary has not seen (LZ78,
over bytes).  The phrase set stands for what a compressor would learn from the
text; its minimum hashes, one per bin of a single permutation and eight bits
each, are the fingerprint.  Texts that compress each other well share phrases,
so the share of equal bins, corrected for chance, is their likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from moraine.llm.common import executor_slots
from moraine.llm.jaccard import mix
from moraine.session import staged

BINS = 128
CHANCE = 1 / 256  # that eight bits agree by accident
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse mod 2^64
_BACK = pow(_BASE, -1, 1 << 64)


def parse(data: bytes, known: dict[int, int], at: int = 0, node: int = 0) -> tuple[list[int], int]:
    """Ends of the new phrases of ``data``, which begins at ``at`` in its text; the node the parse is left in."""
    ends, get = [], known.get
    for c in data:
        at += 1
        child = get(node | c)
        if child is None:
            known[node | c] = (len(known) + 1) << 8
            node = 0
            ends.append(at)
        else:
            node = child
    return ends, node


class Powers:
    """Powers of a number mod 2^64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, np.uint64)

    def to(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = np.uint64(pow(self.base, len(self.table), 1 << 64))
            self.table = np.concatenate([self.table, self.table * step])
        return self.table[:n]


_UP, _DOWN = Powers(_BASE), Powers(_BACK)


def phrase_hashes(data: bytes, ends: list[int], starts: list[int]) -> np.ndarray:
    """A hash of each phrase by its bytes alone, from prefix sums of one polynomial."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * _UP.to(n), out=sums[1:])
    a, b = np.array(starts, np.int64), np.array(ends, np.int64)
    return mix((sums[b] - sums[a]) * _DOWN.to(n + 1)[a] + (b - a).astype(np.uint64))


def signature(hashes: np.ndarray) -> bytes:
    """Eight bits of the least hash of every bin; an empty bin borrows from the next one that has any."""
    if not len(hashes):
        return b""
    hashes = np.sort(hashes)
    bins = (hashes >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    filled = bins[first]
    at = np.searchsorted(filled, np.arange(BINS)) % len(filled)
    away = (filled[at] - np.arange(BINS)) % BINS
    return (mix(hashes[first][at] + away.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bins less what chance gives, 0 to 1; two empty texts are alike, an empty one and another are not."""
    if not a or not b:
        return float(a == b)
    same = np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8))
    return float(max(0.0, (same - CHANCE) / (1 - CHANCE)))


class Parsed:
    """A text parsed in two parts, so that an edit of the second one reuses the first."""

    def __init__(self, raw: bytes | None):
        self.text = (raw or b"").decode("utf-8", "replace")
        self.n = len(self.text)
        self.left = self.text[:self.n - self.n // 2].encode()
        self.known: dict[int, int] = {}
        self.ends, self.node = parse(self.left, self.known)
        whole = self.text.encode()
        known = self.known.copy() if self.n > 1 else {}
        more, _ = parse(whole[len(self.left):], known, len(self.left), self.node)
        self.signature = self._signed(whole, more)

    def _signed(self, data: bytes, more: list[int]) -> bytes:
        ends = self.ends + more
        return signature(phrase_hashes(data, ends, [0, *ends[:-1]])) if ends else b""

    def edited(self, after: str) -> tuple[bytes, bytes]:
        """The text with its last half replaced by the head of another, and that text's fingerprint."""
        head = after[:self.n // 2].encode()
        more, _ = parse(head, self.known, len(self.left), self.node)  # the last use of what is known
        return self.left + head, self._signed(self.left + head, more)


def _descending_chunks(docs: DataFrame, chunks: int) -> tuple[Column, list[float]]:
    """A column that numbers stretches of falling ids, about equal in rows; null ids come last.

    The bounds are approximate quantiles, as many as there are chunks.  A row
    finds its chunk by two short scans, of every g-th bound and of g bounds.
    """
    bounds = sorted(set(docs.approxQuantile("id", [i / chunks for i in range(1, chunks)], 0.2 / chunks) if chunks > 1
                        else []), reverse=True)
    if not bounds:
        return F.when(F.col("id").isNull(), F.lit(1)).otherwise(F.lit(0)), bounds
    g = int(len(bounds) ** 0.5) + 1

    def constant(values: list[float]) -> Column:
        return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")

    value = F.col("id").cast("double")
    coarse = F.size(F.filter(constant(bounds[::g]), lambda b: b >= value))
    fine = F.size(F.filter(F.slice(constant(bounds), F.greatest(coarse - 1, F.lit(0)) * g + 1, g), lambda b: b >= value))
    number = F.greatest(coarse - 1, F.lit(0)) * g + fine
    return F.when(F.col("id").isNull(), F.lit(len(bounds) + 1)).otherwise(number), bounds


FOUND = ("id {key}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
         "near_edited double, near_next double")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint, that of its edited text, and the likeness to it and to the next document.

    The next document is the one with the next smaller id (ids descending, null
    ids last, equal ids by a hash of their texts), after the last the first.
    Texts move once: into chunks of neighbouring ids, each of which also gets the
    first row of the chunk after it.  Null texts are empty; one row alone is its
    own next.
    """
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    number, _ = _descending_chunks(rows.select("id"), 4 * executor_slots(docs.sparkSession))
    rows = rows.withColumn("chunk", number).withColumn("tie", F.xxhash64("text"))
    # one row per chunk
    heads = rows.groupBy("chunk").agg(F.max("id").alias("id"), F.min(F.when(F.col("id").isNull(), F.col("tie"))).alias("tie")) \
        .orderBy("chunk").collect()
    before = [(h.chunk, h.id, h.tie, heads[i - 1].chunk) for i, h in enumerate(heads)]
    first = staged(docs.sparkSession.createDataFrame(
        before, f"chunk int, head_id {key}, head_tie long, before int"), "fingerprint-heads")
    lead = F.coalesce(F.col("id") == F.col("head_id"), F.col("tie") == F.col("head_tie"), F.lit(False))
    place = F.explode(F.when(lead, F.array(
        F.struct("chunk", F.lit(False).alias("guest")), F.struct(F.col("before").alias("chunk"), F.lit(True).alias("guest"))))
        .otherwise(F.array(F.struct("chunk", F.lit(False).alias("guest")))))
    dealt = rows.join(F.broadcast(first), "chunk").select("id", "text", "tie", place.alias("p")) \
        .select("id", "text", "tie", "p.chunk", "p.guest") \
        .repartition("chunk").sortWithinPartitions("chunk", "guest", F.col("id").desc_nulls_last(), "tie")

    def follow(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # chunk, id, parsed text that waits for its next one
        for batch in source:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, found = [], []
                for key_, text, chunk, guest in zip(*(part.column(c).to_pylist() for c in (
                        "id", "text", "chunk", "guest")), strict=True):
                    if held is None and guest:
                        continue  # further rows with the id of a guest that was used
                    mine = Parsed(text)
                    if held is not None:
                        data, sign = held[2].edited(mine.text)
                        own = held[2].signature
                        ids.append(held[1])
                        found.append((held[2].n, hashlib.sha256(data).hexdigest(), own.hex(), sign.hex(),
                                      likeness(own, sign), likeness(own, mine.signature)))
                    held = None if guest else (chunk, key_, mine)
                columns = zip(*found, strict=True) if found else ((),) * 6
                names = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.record_batch({"id": pa.array(ids, part.schema.field("id").type)} | {
                    n: pa.array(list(c), k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return dealt.mapInArrow(follow, FOUND.format(key=key)).withColumnRenamed("id", id_col)
