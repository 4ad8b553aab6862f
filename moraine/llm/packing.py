"""Packing by concatenate and cut: token streams laid end to end and cut at fixed windows.

First pass: every task encodes its documents and keeps a running offset; the
token totals of the tasks are a table of one row per input partition, whose
prefix sums give each task its global start.  Second pass: a document knows its
global start, so where the window borders fall inside it is arithmetic, and a
document across a border gives one record per window it touches.  No row needs
another row.  Only the last stretch is shorter than a window; it is cut into
powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from moraine.llm.words import GAP_BYTE, raw_bytes, slices, split_words
from moraine.session import staged

CACHE = 400_000  # distinct words of a generation, of which a Python worker remembers two
MARKS = b".,;:!?|"
SLICE = 4 << 20  # bytes of text whose distinct words are encoded together
KINDS = np.zeros(256, np.uint8)
KINDS[list(b" \t\n\x0b\x0c\r")] = GAP_BYTE
LETTERS = re.compile("[a-zÀ-ÖØ-öø-ÿ]{1,60}")  # composed letters, which no normal form changes
_WORDS: dict[str, "WordIds"] = {}
STREAM = "part int, id {key}, local_start long, n long, ids binary"
PIECES = "id {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds(dict):
    """Bytes of the token ids of a white-space-free word, lower case.

    The vocabulary lower-cases, drops white space and never joins across it, nor
    across the end of a run of letters, so a text's ids are its words' ids one
    after another, and a word's are those of its letters and of the marks behind
    them.  Two generations of words are held: when the young one is full it
    becomes the old one, and the old one goes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.old = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def learn(self, words: set[bytes]) -> None:
        """Encode the new words that are letters alone many at a time: each ends at a token that ends a word."""
        cores = {w.rstrip(MARKS) for w in words if w not in self}
        new = [u for u in (c.decode("utf-8", "replace") for c in cores if c not in self and c not in self.old)
               if LETTERS.fullmatch(u)]
        for lo in range(0, len(new), 1000):
            some = new[lo:lo + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                data, starts = ids.tobytes(), [0, *ends[:-1].tolist()]
                for u, a, b in zip(some, starts, ends.tolist(), strict=True):
                    self.keep(u.encode(), data[4 * a:4 * b])

    def keep(self, word: bytes, ids: bytes) -> None:
        if len(word) < 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[word] = ids

    def __missing__(self, word: bytes) -> bytes:
        out = self.old.get(word)
        if out is None:
            core = word.rstrip(MARKS)
            if core and len(core) < len(word) and core.isalpha():
                out = self[core] + self[word[len(core):]]
            else:
                ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
                out = np.array(ids, "<u4").tobytes()
        self.keep(word, out)
        return out

    def encode(self, texts: list[bytes | None], end: bytes) -> list[bytes]:
        """The ids of each text, then ``end``."""
        # special tokens are told apart by case
        lists = [(t if b"<|" in t else t.lower()).split() if t else [] for t in texts]
        self.learn(set().union(*lists))
        return [b"".join([*map(self.__getitem__, words), end]) for words in lists]

    def encode_slice(self, texts: pa.Array, end_id: int) -> tuple[pa.Array, np.ndarray]:
        """The same for texts without special tokens, as one array: (ids of each text with ``end_id`` behind them, as bytes; their number), each distinct word looked up once."""
        words = split_words(texts, KINDS)
        distinct = words.dictionary.cast(pa.large_binary()).to_pylist()
        self.learn(set(distinct))
        ids = [self[w] for w in distinct]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        n = size[words.code]
        before = np.cumsum(n) - n
        at = np.arange(int(n.sum()))
        per_text = np.bincount(words.doc, n, len(texts)).astype(np.int64) + 1
        out = np.full(int(per_text.sum()), end_id, "<u4")
        # every text before a word has put one end before it
        out[at + np.repeat(words.doc, n)] = flat[at + np.repeat(begin[words.code] - before, n)]
        bounds = np.concatenate([[0], np.cumsum(per_text)]) * 4
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds), pa.py_buffer(out)]), per_text


def word_ids(path: str) -> WordIds:
    """The worker's words: they outlive a task where Spark keeps its Python workers."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def token_stream(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """part, id, local_start, n and ids of every document, written to files."""
    key = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def encode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, at = word_ids(vocabulary), TaskContext.get().partitionId(), 0
        for batch in source:
            texts = batch.column("text")
            special = pa.compute.fill_null(pa.compute.match_substring(texts, "<|"), False)
            plain = pa.compute.if_else(special, pa.scalar("", texts.type), texts)
            for lo, hi in slices(np.diff(raw_bytes(plain)[1]), SLICE):
                ids, n = words.encode_slice(plain.slice(lo, hi - lo), end_id)
                cased = np.flatnonzero(special.slice(lo, hi - lo).to_numpy(zero_copy_only=False))
                if len(cased):
                    own = ids.to_pylist()
                    for i in cased.tolist():  # special tokens may stand in these
                        own[i] = words.encode([texts[lo + i].as_py().encode()], end)[0]
                        n[i] = len(own[i]) // 4
                    ids = pa.array(own, pa.large_binary())
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.record_batch({
                    "part": pa.array(np.full(len(ids), part, np.int32)), "id": batch.column("id").slice(lo, hi - lo),
                    "local_start": pa.array(starts), "n": pa.array(n), "ids": ids.cast(pa.binary())})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return staged(rows.mapInArrow(encode, STREAM.format(key=key)), "pack-stream")


def window_edges(total: int, window: int) -> np.ndarray:
    """Where sequences begin: every ``window`` tokens, then the rest by falling powers of two."""
    full = total // window
    edges, rest = [full * window], total - full * window
    while rest:
        edges.append(edges[-1] + (1 << (rest.bit_length() - 1)))
        rest -= 1 << (rest.bit_length() - 1)
    return np.array(edges, np.int64)


def cut(starts: np.ndarray, ids: list[bytes], total: int, window: int) -> Iterator[tuple]:
    """(document, start in it, length, crc32, sequence, offset) of every piece."""
    edges = window_edges(total, window)
    tail, full = int(edges[0]), int(edges[0]) // window
    for doc, (begin, data) in enumerate(zip(starts.tolist(), ids, strict=True)):
        at, stop = begin, begin + len(data) // 4
        while at < stop:
            if at < tail:
                sequence = at // window
                low, high = sequence * window, (sequence + 1) * window
            else:
                k = int(np.searchsorted(edges, at, "right")) - 1
                sequence, low, high = full + k, int(edges[k]), int(edges[k + 1])
            to = min(stop, high)
            piece = data[4 * (at - begin):4 * (to - begin)]
            yield doc, at - begin, to - at, zlib.crc32(piece), sequence, at - low
            at = to


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``with_ids`` adds the token ids of each piece as little-endian 32-bit numbers.
    A null or empty text is its end token alone; null and repeated ids are rows
    like any other.  Sequences hold ``window`` tokens; the tokens after the last
    full one form sequences whose lengths are powers of two, so nothing is
    padded.  An empty table gives no pieces.
    """
    key = docs.schema[id_col].dataType.simpleString()
    stream = token_stream(docs, vocabulary, end_id, id_col, text_col)
    # one row per partition of the input: small enough for one task and for every task
    parts = staged(stream.groupBy("part").agg(F.sum("n").alias("tokens")).withColumn(
        "part_start", F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")), "pack-parts")
    total = parts.agg(F.sum("tokens")).first()[0] or 0
    placed = stream.join(F.broadcast(parts.select("part", "part_start")), "part").select(
        "id", (F.col("part_start") + F.col("local_start")).alias("begin"), "n", "ids")

    def pieces(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for lo in range(0, batch.num_rows, 1024):
                rows = batch.slice(lo, 1024)
                ids = rows.column("ids").to_pylist()
                found = list(cut(rows.column("begin").to_numpy(), ids, total, window))
                if not found:
                    continue
                doc, *numbers = (np.array(x, np.int64) for x in zip(*found, strict=True))
                out = {"id": rows.column("id").take(pa.array(doc))}
                out |= {n: pa.array(x) for n, x in zip(("start", "length", "ids_crc32"), numbers, strict=False)}
                out["doc_tokens"] = rows.column("n").take(pa.array(doc))
                out |= {"sequence_id": pa.array(numbers[3]), "offset": pa.array(numbers[4])}
                if with_ids:
                    out["ids"] = pa.array([ids[d][4 * s:4 * (s + n)] for d, s, n, *_ in found], pa.binary())
                yield pa.record_batch(out)

    made: Callable = pieces
    return placed.mapInArrow(made, PIECES.format(key=key) + (", ids binary" if with_ids else "")) \
        .withColumnRenamed("id", id_col)
