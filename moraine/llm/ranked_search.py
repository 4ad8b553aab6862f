"""Ranked lexical search over posting lists that are blocked by similarity, exact.

Every document is a vector of impacts, one for each term that some item asks
for.  Documents are dealt in order of a signature, the signs of their vectors on
random hyperplanes, so neighbours resemble each other; a chunk is a bounded run
of them.  Within a chunk each term's posting list is cut into blocks of
neighbours, and a block's summary is the coordinatewise maximum of its
documents' vectors.  The summary's score for an item is at least that of every
document in the block.  An item visits the blocks of its terms by falling
summary score and stops when that is below its k-th score; a document met again
in another term's block is not scored again.

A first run over a few chunks gives every item a k-th score, where the run over
all other chunks starts, so most of their blocks fail their bound at once.
Items are packed into blocks as well; a task holds a chunk and a block of items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from moraine.llm.common import executor_slots
from moraine.llm.words import GAP_BYTE, raw_bytes, slices, split_words
from moraine.session import staged

SLICE = 4 << 20  # bytes of text whose words are numbered together
CHUNK = 1024  # documents of a chunk
CHUNK_TERMS = 1 << 18  # postings of a chunk, unless one document has more
LISTED = 32  # documents of a block of a posting list
ITEMS = 256  # items of a block of items
CELLS = 1 << 22  # documents x terms that are laid out as a matrix at once
PLANES = 16  # bits of a signature
SEEDS = 16  # one chunk in so many is searched first
KINDS = np.full(256, GAP_BYTE, np.uint8)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    KINDS[_low:_high + 1] = 0
LIMIT_SCALE, SMOOTH, LENGTH_PART = 1_000_000_000, 8, 90


def term_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, n (terms with repeats), terms and tf (distinct terms and their counts) of every text of ``rows``."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = batch.column("text")
            for lo, hi in slices(np.diff(raw_bytes(texts)[1]), SLICE):
                words = split_words(texts.slice(lo, hi - lo), KINDS)
                size = max(1, len(words.dictionary))
                key, tf = np.unique(words.doc * size + words.code, return_counts=True)
                bounds = np.searchsorted(key, np.arange(hi - lo + 1) * size).astype(np.int32)
                terms = words.dictionary.take(pa.array(key % size)).cast(pa.string())
                out = {c: batch.column(c).slice(lo, hi - lo) for c in columns}
                out["n"] = pa.array(np.bincount(words.doc, minlength=hi - lo).astype(np.int64))
                out["terms"] = pa.ListArray.from_arrays(pa.array(bounds), terms)
                out["tf"] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(tf.astype(np.int64)))
                yield pa.record_batch(out)

    made: Callable = count
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(made, f"{kinds}, n long, terms array<string>, tf array<long>")


def impacts(postings: DataFrame, weights: DataFrame, documents: int, length: int) -> DataFrame:
    """row, id, term number and impact of every posting, by the document's length and the term's weight."""
    m = F.expr(f"100 - {LENGTH_PART} + ({LENGTH_PART} * n * {documents}L) div {max(1, length)}L")
    return postings.join(weights, "term").select("row", "id", "t", m.alias("m"), "tf", "w").select(
        "row", "id", "t", F.expr(f"w * (({LIMIT_SCALE}L * tf) div (1000 * tf + {SMOOTH} * m))").alias("impact")).filter("impact > 0")


def _planes(terms: np.ndarray) -> np.ndarray:
    """Signs of the coordinates of ``PLANES`` hyperplanes at the terms, by a mix of the term's number."""
    with np.errstate(over="ignore"):
        x = (terms.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return ((x[:, None] >> np.arange(PLANES, dtype=np.uint64)) & np.uint64(1)).astype(np.float64) * 2 - 1


def signed(vectors: DataFrame) -> DataFrame:
    """The vectors, terms ascending, with their signature."""

    def sign(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            t, v = batch.column("t"), batch.column("v")
            offsets = t.offsets.to_numpy()
            terms = t.values.to_numpy()[offsets[0]:offsets[-1]]
            values = v.values.to_numpy()[offsets[0]:offsets[-1]].astype(np.float64)
            sums = np.zeros((len(t), PLANES))
            parts = _planes(terms) * values[:, None]
            full = np.flatnonzero(np.diff(offsets))
            if len(full):
                sums[full] = np.add.reduceat(parts, offsets[:-1][full] - offsets[0], axis=0)
            bits = ((sums > 0) << np.arange(PLANES)).sum(1).astype(np.int32)
            yield pa.record_batch([*batch.columns, pa.array(bits)], names=[*batch.schema.names, "sign"])

    made: Callable = sign
    return vectors.mapInArrow(made, "row long, id long, t array<long>, v array<long>, sign int")


def chunked(vectors: DataFrame) -> DataFrame:
    """Chunks of documents in order of their signatures; written once."""

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def chunks(rows: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], list[dict]]:
            rows = rows.combine_chunks()
            size = np.cumsum(np.asarray(pa.compute.list_value_length(rows.column("t")).to_numpy()))
            at, out = 0, []
            while at < rows.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_TERMS, "right")))
                to = min(to, at + CHUNK, rows.num_rows)
                if to == rows.num_rows and not last:
                    break
                out.append(one(rows.slice(at, to - at)))
                at = to
            return rows.slice(at).to_batches(), out

        def one(rows: pa.Table) -> dict:
            lists = {c: pa.concat_arrays(rows.column(c).chunks) for c in ("t", "v")}
            offsets = lists["t"].offsets.to_numpy()
            return {"n": rows.num_rows, "rows": rows.column("row").to_numpy().tobytes(),
                    "ids": rows.column("id").fill_null(0).to_numpy().tobytes(),
                    "null_ids": rows.column("id").is_null().to_numpy().astype(bool).tobytes(),
                    "bounds": (offsets - offsets[0]).astype("<i8").tobytes(),
                    **{c: x.values.to_numpy()[offsets[0]:offsets[-1]].astype("<i8").tobytes() for c, x in lists.items()}}

        for batch in source:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * CHUNK:
                held, found = chunks(pa.Table.from_batches(held), False)
                yield from (pa.RecordBatch.from_pylist([f], schema) for f in found)
        if held:
            yield from (pa.RecordBatch.from_pylist([f], schema) for f in chunks(pa.Table.from_batches(held), True)[1])

    names = ("rows", "ids", "null_ids", "bounds", "t", "v")
    schema = pa.schema([("n", pa.int64()), *((c, pa.binary()) for c in names)])
    made: Callable = pack
    dealt = vectors.repartitionByRange(F.col("sign"), F.col("row")).sortWithinPartitions("sign", "row")
    return staged(dealt.mapInArrow(made, "n long, " + ", ".join(f"{c} binary" for c in names)).withColumn(
        "chunk", F.monotonically_increasing_id()), "search-chunks")


class Chunk:
    """Vectors of a run of similar documents: rows, ids, and terms with impacts between ``bounds``."""

    def __init__(self, row: dict):
        self.rows, self.ids = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids"))
        self.null = np.frombuffer(row["null_ids"], bool)
        self.bounds, self.t, self.v = (np.frombuffer(row[c], "<i8") for c in ("bounds", "t", "v"))


def _visit(chunk: Chunk, lo: int, hi: int, items: list[np.ndarray], best: list[list[tuple]], floor: list[int], k: int) -> None:
    """Documents lo..hi of a chunk for all items; ``items`` are sorted term numbers, ``best`` and ``floor`` move on."""
    a, b = int(chunk.bounds[lo]), int(chunk.bounds[hi])
    terms, place = np.unique(chunk.t[a:b], return_inverse=True)
    if (hi - lo) * len(terms) > CELLS and hi - lo > 1:
        mid = (lo + hi) // 2
        _visit(chunk, lo, mid, items, best, floor, k)
        _visit(chunk, mid, hi, items, best, floor, k)
        return
    doc = np.repeat(np.arange(hi - lo), np.diff(chunk.bounds[lo:hi + 1]))
    matrix = np.zeros((hi - lo, len(terms)), np.int64)
    matrix[doc, place] = chunk.v[a:b]
    asked: list[list[int]] = [[] for _ in terms]
    wanted = []
    for i, item in enumerate(items):
        own = np.searchsorted(terms, item)
        own = own[(own < len(terms)) & (terms[np.minimum(own, len(terms) - 1)] == item)] if len(terms) else own[:0]
        wanted.append(own)
        for t in own.tolist():
            asked[t].append(i)
    # blocks of each term's list: neighbours in the order of signatures
    order = np.lexsort((doc, place))
    listed, lists = doc[order], np.searchsorted(place[order], np.arange(len(terms) + 1))
    visits: list[list[tuple]] = [[] for _ in items]
    for t, asking in enumerate(asked):
        if not asking:
            continue
        docs = listed[lists[t]:lists[t + 1]]
        cuts = np.arange(0, len(docs), LISTED)
        columns = np.unique(np.concatenate([wanted[i] for i in asking]))
        summary = np.maximum.reduceat(matrix[docs][:, columns], cuts, axis=0)
        mine = np.zeros((len(columns), len(asking)), np.int64)
        for j, i in enumerate(asking):
            mine[np.searchsorted(columns, wanted[i]), j] = 1
        # whole numbers below 2^53 add up exactly in floats, which multiply faster
        exact = int(summary.max(initial=0)) * max(1, len(columns)) < 1 << 53
        bounds = summary.astype(np.float64) @ mine.astype(np.float64) if exact else summary @ mine
        for j, i in enumerate(asking):
            for block in np.flatnonzero(bounds[:, j] >= max(floor[i], 1)).tolist():
                visits[i].append((int(bounds[block, j]), t, block))
    for i, found in enumerate(visits):
        if not found:
            continue
        found.sort(key=lambda x: -x[0])
        seen = np.zeros(hi - lo, bool)
        for bound, t, block in found:
            if bound < floor[i]:
                break
            docs = listed[lists[t]:lists[t + 1]][block * LISTED:(block + 1) * LISTED]
            docs = docs[~seen[docs]]
            if not len(docs):
                continue
            seen[docs] = True
            scores = matrix[docs][:, wanted[i]].sum(1)
            good = np.flatnonzero((scores >= floor[i]) & (scores > 0))
            if len(good):
                at = docs[good] + lo
                best[i] = sorted(best[i] + [(-int(s), bool(chunk.null[d]), int(chunk.ids[d]), int(chunk.rows[d]))
                                            for s, d in zip(scores[good], at.tolist(), strict=True)])[:k]
                if len(best[i]) == k:
                    floor[i] = max(floor[i], -best[i][-1][0])


def _search(chunks: DataFrame, items: DataFrame, blocks: int, floors: DataFrame | None, k: int) -> DataFrame:
    """The best rows of each chunk for every item: item row, row, id, score."""
    if floors is not None:
        items = items.join(floors, "item_row", "left")
    else:
        items = items.withColumn("floor", F.lit(None).cast("long"))
    # copies of a block of items meet chunks in many tasks, whatever join Spark picks
    salts = executor_slots(chunks.sparkSession)
    packed = items.groupBy("block").agg(F.collect_list(F.struct("item_row", "asked", "floor")).alias("items")) \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = chunks.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))),
                                "salt": F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int")}).join(packed, ["block", "salt"])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                chunk, items = Chunk(row), row["items"]
                best: list[list[tuple]] = [[] for _ in items]
                floor = [max(1, x["floor"] or 1) for x in items]
                _visit(chunk, 0, len(chunk.rows), [np.array(x["asked"], np.int64) for x in items], best, floor, k)
                found = [(x["item_row"], r, None if null else v, -s) for x, own in zip(items, best, strict=True)
                         for s, null, v, r in own]
                if found:
                    yield pa.record_batch({c: pa.array(x, pa.int64()) for c, x in zip(
                        ("item_row", "row", "id", "score"), zip(*found, strict=True), strict=True)})

    made: Callable = run
    return pairs.drop("block", "salt").mapInArrow(made, "item_row long, row long, id long, score long")


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_items(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents that score highest for each item, scores above 0.

    Terms are runs of ASCII letters and digits and of all other characters
    beyond ASCII, A-Z lower-cased; a null text has none and is never found.  An
    item's terms count once each.  Every row of ``items`` is a search of its own
    and every row of ``docs`` a document, repeated rows included.  Equal scores
    come by id (nulls last), then row.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                        F.col(text_col).cast("string").alias("text"))
    found = staged(term_counts(texts, ["row", "id"]), "search-terms")
    asked = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")) \
        .withColumn("item_row", F.monotonically_increasing_id())
    asked = staged(term_counts(asked.select("item_row", "text", "item_id"), ["item_row", "item_id"]), "search-asked")
    totals = found.filter("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    documents, length = totals["documents"], totals["length"] or 0
    wanted = staged(asked.select(F.explode("terms").alias("term")).distinct(), "search-wanted")
    postings = staged(found.select("row", "id", "n", F.explode(F.arrays_zip("terms", "tf")).alias("x"))
                      .select("row", "id", "n", F.col("x.terms").alias("term"), F.col("x.tf").alias("tf"))
                      .join(wanted, "term"), "search-postings")
    weights = staged(postings.groupBy("term").agg(F.count("*").alias("df")).select(
        "term", F.monotonically_increasing_id().alias("t"),
        F.expr(f"cast(floor(1000 * ln((2 * {documents}L + 2) / (2 * df + 1))) as bigint)").alias("w")), "search-weights")
    vectors = impacts(postings, weights, documents, length).groupBy("row", "id").agg(
        F.array_sort(F.collect_list(F.struct("t", "impact"))).alias("x")).select(
        "row", "id", F.col("x.t").alias("t"), F.col("x.impact").alias("v"))
    chunks = chunked(staged(signed(vectors), "search-vectors"))
    # items with any term that stands in a document, numbered into blocks
    known = asked.select("item_row", F.explode("terms").alias("term")).join(weights.select("term", "t"), "term") \
        .groupBy("item_row").agg(F.sort_array(F.collect_list("t")).alias("asked"))
    blocks = max(1, -(-known.count() // ITEMS))
    known = staged(known.withColumn("block", F.pmod(F.xxhash64("item_row"), F.lit(blocks)).cast("int")), "search-known")
    first = F.pmod(F.xxhash64("chunk"), F.lit(SEEDS)) == 0
    early = staged(_search(chunks.filter(first), known, blocks, None, k), "search-first")
    floors = staged(_best(early, k).filter(F.col("rank") == k).select("item_row", F.col("score").alias("floor")), "search-floors")
    hits = early.unionByName(_search(chunks.filter(~first), known, blocks, floors, k))
    return _best(hits, k).join(asked.select("item_row", "item_id"), "item_row").select(
        "item_id", F.col("rank").cast("int"), F.col("id").alias(id_col), "score")
