"""Scoring texts with a context-tree-weighted byte model.

Every byte is eight binary decisions along a byte tree; each decision has a
context tree over the preceding bytes, whose nodes hold Krichevsky-Trofimov
counts, and the weighted mixture over all depths is the prediction.  A text ends
with the byte 0xFF, which UTF-8 never uses and which also stands before the
start, so the probabilities of all texts sum to one.

The counts of all nodes follow from those of (context, next byte) strings.  The
probability of a byte depends on that string alone, so it is worked out once per
distinct string, not per occurrence:

1. Documents form blocks of about ``BLOCK`` bytes where they are read.  A block
   reports its distinct words and strings with their training counts, dealt into
   slots by a hash.  What a block has in a slot is one row of sorted, compressed
   numbers, about two bytes a string.
2. Counts are summed slot by slot over all blocks.  Context trees below two bytes
   are weighted in one group per two bytes; the levels above have at most
   256 * 255 nodes.
3. Each block gets back the values of its own words and strings, never more than
   its text holds, and sums them per document.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from moraine.llm.common import executor_slots, fold, packed, run_starts, tokens, unpacked
from moraine.session import staged

BLOCK = 32 << 20  # bytes of text in a block
PIECE = 1 << 20  # bytes of a block that are laid out as numbers at a time
END = 0xFF
STRINGS = 50_000  # distinct strings of a block in a group of context trees, four times as many, about
SLOTS = 4  # slots for each block: a slot holds this part of a block's size, whatever the number of blocks
HELD = 2_000_000  # strings that a block keeps unsummed
LN2 = math.log(2.0)


# ------------------------------------------------------------------ the model

def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight; for x > 0."""
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


def gate(log_own: np.ndarray, log_below: np.ndarray) -> np.ndarray:
    """Weight of a node's own estimate against what its children say."""
    return 1.0 / (1.0 + np.exp(np.clip(log_below - log_own, -700, 700)))


def weigh(codes: np.ndarray, counts: np.ndarray, depth: int, top: int) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """Nodes at depth ``top`` and, per bit, the mixture of depths ``depth`` to ``top`` for each string.

    ``codes`` are context bytes, oldest first, and the byte that follows; all
    strings below a node of depth ``top`` have to be present.
    """
    symbol, context = (codes & np.uint64(255)).astype(np.int64), (codes >> np.uint64(8)).astype(np.int64)
    counts = counts.astype(np.float64)
    nodes: dict[str, list[np.ndarray]] = {"node": [], "n0": [], "n1": [], "lpw": []}
    mixtures = []
    for bit in range(8):
        prefix, ones = (1 << bit) | (symbol >> (8 - bit)), (symbol >> (7 - bit)) & 1
        below = mixture = None
        for d in range(depth, top - 1, -1):
            keys, at = np.unique(((context & ((1 << (8 * d)) - 1)) << 8) | prefix, return_inverse=True)
            n = np.bincount(at, counts, len(keys))
            n1 = np.bincount(at, counts * ones, len(keys))
            own = kt(n - n1, n1)
            estimate = (np.where(ones, n1[at], (n - n1)[at]) + 0.5) / (n[at] + 1.0)
            if below is None:
                weighted, mixture = own, estimate
            else:
                child, child_weight = below
                parent = np.searchsorted(keys, (((child >> 8) & ((1 << (8 * d)) - 1)) << 8) | (child & 255))
                inner = np.bincount(parent, child_weight, len(keys))
                weighted = np.logaddexp(own, inner) - LN2
                mixture = mixture + (estimate - mixture) * gate(own, inner)[at]
            below = keys, weighted
        for name, column in zip(nodes, (keys, n - n1, n1, weighted), strict=True):
            nodes[name].append(column)
        mixtures.append(mixture)
    return {k: np.concatenate(v) for k, v in nodes.items()}, mixtures


class Crown:
    """The two levels above: last byte known, and nothing known.  At most 256 * 255 nodes."""

    def __init__(self, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, inner: np.ndarray):
        full = np.zeros((3, 256, 256))
        full[:, node >> 8, node & 255] = n0, n1, inner
        self.byte = self._level(*full)
        own = kt(full[0], full[1])
        weighted = np.logaddexp(own, full[2]) - LN2
        self.none = self._level(full[0].sum(0), full[1].sum(0), weighted.sum(0))

    @staticmethod
    def _level(n0: np.ndarray, n1: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (n0 + 0.5) / (n0 + n1 + 1), (n1 + 0.5) / (n0 + n1 + 1), gate(kt(n0, n1), inner)

    def log10(self, codes: np.ndarray, mixtures: list[np.ndarray]) -> np.ndarray:
        symbol = (codes & np.uint64(255)).astype(np.int64)
        last = ((codes >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
        total = np.zeros(len(codes))
        for bit, w in enumerate(mixtures):
            prefix, one = (1 << bit) | (symbol >> (8 - bit)), ((symbol >> (7 - bit)) & 1).astype(bool)
            for (p0, p1, own), place in ((self.byte, (last, prefix)), (self.none, (prefix,))):
                w = w + (np.where(one, p1[place], p0[place]) - w) * own[place]
            total += np.log10(w)
        return total


# ------------------------------------------------------------------ texts as numbers

def laid_out(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(code of each byte with the bytes before it, its text's number), end bytes included."""
    gap = bytes([END]) * depth
    line = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    codes = np.zeros(len(line) - depth, np.uint64)
    for j in range(depth + 1):
        codes <<= np.uint64(8)
        codes |= line[j:len(codes) + j]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + depth) - depth  # place of each text's end byte
    owner = np.repeat(np.arange(len(texts)), sizes + depth)
    real = np.ones(len(codes) + depth, bool)
    for k in range(1, depth):
        real[ends + k] = False
    real = real[:len(codes)]
    return codes[real], owner[:len(codes)][real]


def pieces(texts: pa.ChunkedArray) -> Iterator[tuple[slice, list[bytes]]]:
    """Texts in stretches of about ``PIECE`` bytes, so that few of them are Python objects at a time."""
    lo, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        held += n
        if held >= PIECE:
            yield slice(lo, i + 1), texts.slice(lo, i + 1 - lo).to_pylist()
            lo, held = i + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts)), texts.slice(lo).to_pylist()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def block_symbols(texts: pa.ChunkedArray, held: np.ndarray, depth: int) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Words and strings of a block with their counts in its training texts (0 where they are only held out)."""
    words: Counter = Counter()
    codes, counts, unsummed = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for part, some in pieces(texts):
        out = held[part]
        words.update(tokens(b" ".join([t for t, h in zip(some, out.tolist(), strict=True) if not h])))
        for w in set(tokens(b" ".join([t for t, h in zip(some, out.tolist(), strict=True) if h]))):
            words.setdefault(w, 0)
        code, owner = laid_out(some, depth)
        code = (code << np.uint64(1)) | out[owner]
        code.sort()
        starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        n = np.diff(np.append(starts, len(code)))
        code = code[starts]
        codes.append(code >> np.uint64(1))
        counts.append(np.where(code & np.uint64(1), 0, n))
        unsummed += len(code)
        if unsummed > HELD:
            codes, counts = ([x] for x in summed(np.concatenate(codes), np.concatenate(counts)))
            unsummed = 0
    return words, *summed(np.concatenate(codes), np.concatenate(counts))


def slots_of(codes: np.ndarray, depth: int, slots: int) -> np.ndarray:
    """Strings that begin alike, up to four bytes, share a slot, so that sorted neighbours stay neighbours."""
    begin = codes >> np.uint64(max(0, 8 * (depth + 1) - 32))
    return ((begin * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(slots)).astype(np.int64)


def runs_of(groups: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """A stable order by group, and each group's number and stretch of it."""
    order = np.argsort(groups, kind="stable")
    ordered = groups[order]
    starts = run_starts(ordered).tolist()
    return order, [(int(ordered[a]), slice(a, b)) for a, b in zip(starts, starts[1:])]


def packed_codes(codes: np.ndarray) -> bytes:
    return packed(np.diff(codes, prepend=np.uint64(0)))


def unpacked_codes(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(raw, n, np.uint64), dtype=np.uint64)


def packed_words(words: list[bytes]) -> bytes:
    return zlib.compress(b" ".join(words), 4)


def cut(raw: bytes, sizes: list[int]) -> list[bytes]:
    """The texts of a piece."""
    whole, at, out = pa.decompress(raw, sum(sizes), "zstd", asbytes=True) if any(sizes) else b"", 0, []
    for n in sizes:
        out.append(whole[at:at + n])
        at += n
    return out


def unpacked_words(raw: bytes) -> list[bytes]:
    return zlib.decompress(raw).split(b" ")


class Places:
    """Where known 64-bit keys lie in an array; a few rounds of hashing, all in numpy."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.rounds = keys, []
        left, salt = np.arange(len(keys)), 0x9E3779B97F4A7C15
        while len(left):
            bits = max(4, int(len(left)).bit_length() + 2)
            table = np.zeros(1 << bits, np.int32)
            slot = (keys[left] * np.uint64(salt)) >> np.uint64(64 - bits)
            table[slot] = left
            self.rounds.append((np.uint64(salt), np.uint64(64 - bits), table))
            left = left[table[slot] != left]
            salt = (salt * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1

    def find(self, wanted: np.ndarray) -> np.ndarray:
        out = np.zeros(len(wanted), np.int32)
        left = None
        for salt, shift, table in self.rounds:
            want = wanted if left is None else wanted[left]
            at = table[(want * salt) >> shift]
            if left is None:
                out, left = at, np.flatnonzero(self.keys[at] != want)
            else:
                out[left] = at
                left = left[self.keys[at] != want]
            if not len(left):
                break
        return out


# ------------------------------------------------------------------ the jobs

#: A row is a piece of texts, the words, or the strings of a block in a slot.
BLOCKS = ("block long, slot long, n long, codes binary, words binary, counts binary, "
          "ids array<{key}>, held array<boolean>, sizes array<int>, text binary")
KNOWN = "block long, n long, codes binary, words binary, numbers binary"
SCORES = ("id {key}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")


def score_texts(docs: DataFrame, depth: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The model learns from documents whose crc32(id as text) mod 5 is not 1.
    ``score`` is log10 of the text's probability, its end included; bits_per_byte
    the code length over bytes and end.  Null texts are empty, null ids count as
    empty text in the fold.  Without training texts every bit has probability
    one half.  Repeated rows are scored, and learned, as often as they occur.
    """
    spark = docs.sparkSession
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
        (fold(F.col(id_col)) == 1).alias("held"))
    size, n_train = rows.agg(F.sum(F.octet_length("text") + 1), F.sum(F.when(~F.col("held"), 1).otherwise(0))).first()
    n_train = n_train or 0
    blocks = max(executor_slots(spark), -(-(size or 0) // BLOCK))
    slots = SLOTS * blocks

    def block_rows(number: int, some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(some)
        ids, texts, held = group.column("id").combine_chunks(), group.column("text"), group.column("held").combine_chunks()

        def batch(count: int, **have: pa.Array) -> pa.RecordBatch:
            lists = {"ids": pa.list_(ids.type), "held": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int32())}
            one = {"block": pa.array([number] * count, pa.int64())} | have
            return pa.record_batch({c: one[c] if c in one else pa.nulls(count, lists.get(c, pa.int64() if c in ("slot", "n") else pa.binary()))
                                    for c in ("block", "slot", "n", "codes", "words", "counts", "ids", "held", "sizes", "text")})

        for part, raw in pieces(texts):
            ends = pa.array([0, len(raw)], pa.int32())
            lengths = pa.array([len(t) for t in raw], pa.int32())
            yield batch(1, ids=pa.ListArray.from_arrays(ends, ids[part]), held=pa.ListArray.from_arrays(ends, held[part]),
                        sizes=pa.ListArray.from_arrays(ends, lengths),
                        text=pa.array([pa.Codec("zstd", 3).compress(b"".join(raw), asbytes=True)], pa.binary()))
        words, codes, counts = block_symbols(texts, held.to_numpy(zero_copy_only=False).astype(np.uint64), depth)
        order, runs = runs_of(slots_of(codes, depth, slots))
        codes, counts = codes[order], counts[order]
        if runs:
            yield batch(len(runs), slot=pa.array([k for k, _ in runs], pa.int64()),
                        n=pa.array([r.stop - r.start for _, r in runs], pa.int64()),
                        codes=pa.array([packed_codes(codes[r]) for _, r in runs], pa.binary()),
                        counts=pa.array([packed(counts[r]) for _, r in runs], pa.binary()))
        kinds = sorted(words)
        counts = np.fromiter((words[w] for w in kinds), np.int64, len(kinds))
        order, runs = runs_of(np.fromiter((zlib.crc32(w) % slots for w in kinds), np.int64, len(kinds)))
        if runs:
            yield batch(len(runs), slot=pa.array([k for k, _ in runs], pa.int64()),
                        n=pa.array([r.stop - r.start for _, r in runs], pa.int64()),
                        words=pa.array([packed_words([kinds[i] for i in order[r].tolist()]) for _, r in runs], pa.binary()),
                        counts=pa.array([packed(counts[order[r]]) for _, r in runs], pa.binary()))

    def deal(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, some, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in source:
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + BLOCK - size, "right")))
                some.append(batch.slice(at, to - at))
                size, at = size + int(ends[to - 1]) - before, to
                if at < batch.num_rows or size >= BLOCK:
                    yield from block_rows(number, some)
                    number, some, size = number + 1, [], 0
        if some:
            yield from block_rows(number, some)

    symbols = staged(rows.coalesce(blocks).mapInArrow(deal, BLOCKS.format(key=key)), "score-blocks")

    def sum_words(group: pa.Table) -> pa.Table:
        lists = [unpacked_words(w) for w in group.column("words").to_pylist()]
        totals: Counter = Counter()
        for ws, raw in zip(lists, group.column("counts").to_pylist(), strict=True):
            for w, n in zip(ws, unpacked(raw, len(ws), np.int64).tolist(), strict=True):
                totals[w] += n
        none = [0] * (len(lists) - 1)
        return pa.table({
            "block": group.column("block"), "n": group.column("n"), "codes": pa.nulls(len(lists), pa.binary()),
            "words": group.column("words"),
            "numbers": pa.array([packed(np.fromiter((totals[w] for w in ws), np.int64, len(ws))) for ws in lists], pa.binary()),
            "known": pa.array([sum(totals.values()), *none], pa.int64()),
            "kinds": pa.array([sum(n > 0 for n in totals.values()), *none], pa.int64())})

    words = staged(symbols.filter("words IS NOT NULL").select("block", "slot", "n", "words", "counts")
                   .repartition(slots, "slot").groupBy("slot").applyInArrow(sum_words, KNOWN + ", known long, kinds long"),
                   "score-words")
    n_words, distinct = words.agg(F.sum("known"), F.sum("kinds")).first()
    n_all, n_kinds = (n_words or 0) + n_train, (distinct or 0) + (n_train > 0)
    denominator = n_all + 0.5 * (n_kinds + 1)

    lists = symbols.filter("codes IS NOT NULL").select("block", "slot", "n", "codes", "counts")
    most = lists.groupBy("block").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    # Strings with the same two bytes before the last one share a group; a group holds one or more such pairs.
    groups = min(1 << 16, max(executor_slots(spark), 4 * most // STRINGS))

    def decoded(group: pa.Table) -> list[np.ndarray]:
        return [unpacked_codes(c, n) for c, n in zip(group.column("codes").to_pylist(), group.column("n").to_pylist(), strict=True)]

    def numbers(group: pa.Table, column: str, dtype: type) -> list[np.ndarray]:
        return [unpacked(c, n, dtype) for c, n in zip(group.column(column).to_pylist(), group.column("n").to_pylist(), strict=True)]

    def by(name: str, of: np.ndarray, codes: np.ndarray, column: str, values: np.ndarray) -> pa.Table:
        order, runs = runs_of(of)
        codes, values = codes[order], values[order]
        return pa.table({
            name: pa.array([k for k, _ in runs], pa.int64()), "n": pa.array([r.stop - r.start for _, r in runs], pa.int64()),
            "codes": pa.array([packed_codes(codes[r]) for _, r in runs], pa.binary()),
            column: pa.array([packed(values[r]) for _, r in runs], pa.binary())})

    def sum_codes(group: pa.Table) -> pa.Table:
        codes, n = summed(np.concatenate(decoded(group)), np.concatenate(numbers(group, "counts", np.int64)))
        pair = ((codes >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        return by("pair", (pair % np.uint64(groups)).astype(np.int64), codes, "counts", n)

    strings = staged(lists.repartition(slots, "slot").groupBy("slot").applyInArrow(
        sum_codes, "pair long, n long, codes binary, counts binary"), "score-strings")
    trees = strings.repartition(groups, "pair").groupBy("pair")

    def lower_nodes(group: pa.Table) -> pa.Table:
        nodes, _ = weigh(np.concatenate(decoded(group)), np.concatenate(numbers(group, "counts", np.int64)), depth, 2)
        return pa.table(nodes)

    upper = F.shiftright("node", 8).bitwiseAND(F.lit(0xFF)) * 256 + F.col("node").bitwiseAND(F.lit(0xFF))
    crown_rows = trees.applyInArrow(lower_nodes, "node long, n0 double, n1 double, lpw double") \
        .groupBy(upper.alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lpw").alias("inner")) \
        .toPandas()  # 256 * 255 rows at most
    crown = Crown(crown_rows["node"].to_numpy(np.int64), *(crown_rows[c].to_numpy(float) for c in ("n0", "n1", "inner")))

    def predict(group: pa.Table) -> pa.Table:
        codes = np.concatenate(decoded(group))
        _, mixtures = weigh(codes, np.concatenate(numbers(group, "counts", np.int64)), depth, 2)
        order = np.argsort(codes)
        codes, values = codes[order], crown.log10(codes, mixtures)[order]
        return by("slot", slots_of(codes, depth, slots), codes, "numbers", values)

    predicted = staged(trees.applyInArrow(predict, "slot long, n long, codes binary, numbers binary"), "score-values")

    def spread(group: pa.Table, known: pa.Table) -> pa.Table:
        codes, values = np.concatenate(decoded(known)), np.concatenate(numbers(known, "numbers", np.float64))
        order = np.argsort(codes)
        codes, values = codes[order], values[order]
        return pa.table({
            "block": group.column("block"), "n": group.column("n"), "codes": group.column("codes"),
            "words": pa.nulls(group.num_rows, pa.binary()),
            "numbers": pa.array([packed(values[np.searchsorted(codes, c)]) for c in decoded(group)], pa.binary())})

    values = lists.select("block", "slot", "n", "codes").repartition(slots, "slot").groupBy("slot").cogroup(
        predicted.repartition(slots, "slot").groupBy("slot")).applyInArrow(spread, KNOWN)
    values = values.unionByName(words.drop("known", "kinds")).repartition(blocks, "block")
    texts = symbols.filter("text IS NOT NULL").select("block", "ids", "held", "sizes", "text").repartition(blocks, "block")

    def score(group: pa.Table, known: pa.Table) -> pa.Table:
        of_words, of_codes = (known.filter(known.column(c).is_valid()) for c in ("words", "codes"))
        kinds = [w for raw in of_words.column("words").to_pylist() for w in unpacked_words(raw)]
        place = {w: i for i, w in enumerate(kinds)}
        seen = np.concatenate([*numbers(of_words, "numbers", np.int64), [n_train]]).astype(np.int64)
        term = np.log10((seen + 0.5) / denominator)
        found = Places(np.concatenate(decoded(of_codes)))
        logs = np.concatenate(numbers(of_codes, "numbers", np.float64))
        out: dict[str, list[np.ndarray]] = {n: [] for n in ("n_tokens", "n_known", "base_score", "score", "n_bytes")}
        for raw, sizes in zip(group.column("text"), group.column("sizes"), strict=True):
            some = cut(raw.as_py(), sizes.as_py())
            lists = [tokens(t) for t in some]
            n = np.fromiter(map(len, lists), np.int64, len(some))
            at = np.fromiter((place[w] for ws in lists for w in ws), np.int64, int(n.sum()))
            owner = np.repeat(np.arange(len(some)), n)
            out["n_tokens"].append(n + 1)
            out["n_known"].append(np.bincount(owner, seen[at] > 0, len(some)).astype(np.int64) + (n_train > 0))
            out["base_score"].append(np.bincount(owner, term[at], len(some)) + term[-1])
            codes, owner = laid_out(some, depth)
            out["score"].append(np.bincount(owner, logs[found.find(codes)], len(some)))
            out["n_bytes"].append(np.fromiter(map(len, some), np.int64, len(some)) + 1)
        return pa.table({
            "id": pc.list_flatten(group.column("ids")), "held_out": pc.list_flatten(group.column("held"))} | {
            k: np.concatenate(v) for k, v in out.items()})

    scored = texts.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(score, SCORES.format(key=key))
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"),
        "base_score", "score", (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"))
