"""Phrase mining by dynamic itemset counting over cyclic scans of shards.

The words of all texts are coded once, in blocks dealt to ``shards`` shards.
Step t scans shard t mod ``shards`` and counts phrases of all lengths together:
words from step 0; a pair of words from the step after both have reached the
threshold; three words from the step after both of their pairs have.  A phrase
is counted for as many steps as there are shards, one full cycle, so its count
is that of the whole corpus; every part of a frequent phrase is frequent, so
none is missed.  What is counted late in one scan needs no scan of its own.

The step at which a word was reached comes to each block by a join on the
block's own dictionary.  Reached pairs come as Bloom filters of fixed size, one
for each step that reached any: a pair counts as reached at the first step whose
filter holds it after its words.  That never changes later and is never after the true step, so
every triple of frequent pairs is counted for exactly one cycle; a triple let in
by chance cannot be frequent and falls away by its exact count.  Counts are
pre-aggregated by block and keyed by (lang, phrase) text, so no hash decides a
count and a language that holds most texts is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from moraine.llm.common import executor_slots
from moraine.llm.words import BREAK_BYTE, GAP_BYTE, Words, raw_bytes, slices, split_words
from moraine.session import dropped, staged

SHARDS = 2
BLOCK = 8 << 20  # bytes of text coded together; a longer text is a block of its own
BLOOM_BITS = 25  # a filter of reached pairs has 2^25 bits, 4 MiB, whatever the input
EMIT = 1 << 16  # rows of an Arrow batch
NEVER = 1 << 30
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = GAP_BYTE
KINDS[list(b".,;:!?\n\x0b\x0c\r")] = BREAK_BYTE
BLOCKS = "shard int, lang string, words array<string>, n long, codes binary"
COUNTS = "lang string, phrase string, since int, n long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def pair_hashes(lang: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit hash of a pair of words by their own hashes."""
    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    with np.errstate(over="ignore"):
        return _mix(_mix(left + seed) + right * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in words), np.uint64, len(words))


def bloom_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << BLOOM_BITS) - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def packed_codes(words: Words) -> tuple[pa.Array, bytes]:
    """(dictionary by falling count, codes): codes byte plane by byte plane, then the bits of first words, compressed.

    Common words have small codes, so the upper planes are nearly empty.
    """
    order = np.argsort(-np.bincount(words.code, minlength=len(words.dictionary)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    planes = rank[words.code].astype("<u4").view(np.uint8).reshape(-1, 4).T
    body = np.ascontiguousarray(planes).tobytes() + np.packbits(words.first).tobytes()
    return words.dictionary.take(pa.array(order)), zstandard.ZstdCompressor(level=1).compress(body)


def unpacked_codes(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, whether each word is the first of a piece)."""
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    codes = np.ascontiguousarray(body[:4 * n].reshape(4, n).T).view("<u4").reshape(n).astype(np.int32)
    return codes, np.unpackbits(body[4 * n:], count=n).astype(bool)


def coded_blocks(docs: DataFrame, shards: int, text_col: str, lang_col: str) -> DataFrame:
    """One row per block of one language: its distinct words and their codes in order, dealt to shards in turn."""

    def code(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, held, size = 0, [], 0

        def blocks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal turn
            rows = rows.sort_by("lang").combine_chunks()
            if not rows.num_rows:
                return
            langs = rows.column("lang").combine_chunks().dictionary_encode()
            at = langs.indices.to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                texts = rows.column("text").slice(lo, hi - lo).combine_chunks()
                texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
                for a, b in slices(np.diff(raw_bytes(texts)[1]), BLOCK):
                    words = split_words(texts.slice(a, b - a), KINDS)
                    if len(words.code):
                        dictionary, codes = packed_codes(words)
                        yield pa.RecordBatch.from_pylist([{
                            "shard": turn % shards, "lang": langs.dictionary[int(at[lo])].as_py(),
                            "words": dictionary.to_pylist(), "n": len(words.code), "codes": codes}], schema)
                        turn += 1

        for batch in source:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK:
                yield from blocks(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from blocks(pa.Table.from_batches(held))

    schema = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("n", pa.int64()),
                        ("codes", pa.binary())])
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    made: Callable = code
    return staged(rows.mapInArrow(made, BLOCKS).withColumn("block", F.monotonically_increasing_id()), "phrase-blocks")


def _counted(lang: str, parts: list[pa.Array], since: np.ndarray | int, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(n), EMIT):
        some = [p.slice(lo, EMIT) for p in parts]
        phrase = (pc.binary_join_element_wise(*some, " ") if len(some) > 1 else some[0]).cast(pa.string())
        when = pa.repeat(pa.scalar(since, pa.int32()), len(phrase)) if isinstance(since, int) else pa.array(since[lo:lo + EMIT], pa.int32())
        yield pa.record_batch({"lang": pa.repeat(lang, len(phrase)), "phrase": phrase,
                               "since": when, "n": pa.array(n[lo:lo + EMIT], pa.int64())})


def _phrases(lang: str, words: pa.Array, ids: list[np.ndarray], since: np.ndarray | int) -> Iterator[pa.RecordBatch]:
    """Distinct phrases among aligned word codes, with counts; ``since`` belongs to the phrase."""
    if not len(ids[0]):
        return
    size = len(words)
    key = ids[0].astype(np.int64)
    for more in ids[1:]:
        if int(key.max()) >= (1 << 62) // size:  # keys too wide: number the distinct beginnings first
            key = np.unique(key, return_inverse=True)[1]
        key = key * size + more
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    del key
    yield from _counted(lang, [words.take(pa.array(i[at])) for i in ids], since if isinstance(since, int) else since[at], n)


def _block(batch: pa.RecordBatch, i: int) -> tuple[str, pa.Array, np.ndarray, np.ndarray]:
    """(language, distinct words, codes, steps) of a block: of each pair of neighbours, the step since when both are frequent."""
    codes, first = unpacked_codes(batch.column("codes")[i].as_py(), batch.column("n")[i].as_py())
    words = batch.column("words")[i].values
    when = np.full(len(words), NEVER, np.int32)
    when[batch.column("at")[i].values.to_numpy()] = batch.column("reached")[i].values.to_numpy()
    since = np.maximum(when[codes[1:]], when[codes[:-1]])
    since[first[1:]] = NEVER  # a new piece begins between the two
    return batch.column("lang")[i].as_py(), words, codes, since


def scan_pairs(blocks: DataFrame, step: int, shards: int) -> DataFrame:
    """Pairs of words that the step counts, by block; ``since`` is the step at which the later word reached the threshold."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                lang, words, codes, since = _block(batch, i)
                at = np.flatnonzero((since < step) & (since >= step - shards))
                yield from _phrases(lang, words, [codes[at], codes[at + 1]], since[at])

    made: Callable = count
    return blocks.mapInArrow(made, COUNTS)


def scan_triples(blocks: DataFrame, step: int, shards: int, filters: list[tuple[int, object]]) -> DataFrame:
    """Three words both of whose pairs count as reached, the later one within the last cycle, by block.

    ``filters``: (step, Bloom filter of the pairs reached in it), steps rising.
    """

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                lang, words, codes, since = _block(batch, i)
                pair = np.flatnonzero(since < step)
                hashes = word_hashes(words.to_pylist())
                one, two = bloom_places(pair_hashes(lang, hashes[codes[pair]], hashes[codes[pair + 1]]))
                found = np.full(len(pair), NEVER, np.int32)
                for reached, name in reversed(filters):
                    bits = np.frombuffer(name.value, np.uint8)
                    both = (bits[one >> 3] >> (one & 7).astype(np.uint8)) & (bits[two >> 3] >> (two & 7).astype(np.uint8)) & 1
                    # a pair is counted only after its words are reached, so it cannot be before that
                    found[(both == 1) & (since[pair] < reached)] = reached
                when = np.full(len(codes), NEVER, np.int32)
                when[pair] = found
                later = np.maximum(when[:-1], when[1:])
                three = np.flatnonzero((later < step) & (later >= step - shards))
                yield from _phrases(lang, words, [codes[three], codes[three + 1], codes[three + 2]], later[three])

    made: Callable = count
    return blocks.mapInArrow(made, COUNTS)


def bloom_of(pairs: DataFrame) -> bytes:
    """Bits of the pairs (lang, phrase), set in tasks and joined by or; the result has 2^(BLOOM_BITS - 3) bytes."""

    def places(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            lang = batch.column("lang").to_pylist()
            two = [p.split(" ") for p in batch.column("phrase").to_pylist()]
            if not two:
                continue
            left, right = (word_hashes([t[k] for t in two]) for k in (0, 1))
            out = np.zeros(len(two), np.uint64)
            for name in set(lang):
                own = np.array([x == name for x in lang])
                out[own] = pair_hashes(name, left[own], right[own])
            both = np.concatenate(bloom_places(out))
            yield pa.record_batch({"word": pa.array(both >> 6), "bit": pa.array((both & 63).astype(np.int32))})

    made: Callable = places
    words = pairs.select("lang", "phrase").mapInArrow(made, "word long, bit int").groupBy("word").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.astype("<i8").tobytes()


def word_counts(blocks: DataFrame) -> DataFrame:
    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                words = batch.column("words")[i].values
                codes, _ = unpacked_codes(batch.column("codes")[i].as_py(), batch.column("n")[i].as_py())
                yield from _counted(batch.column("lang")[i].as_py(), [words], -1, np.bincount(codes, minlength=len(words)))

    made: Callable = count
    return blocks.select("lang", "words", "n", "codes").mapInArrow(made, COUNTS).select("lang", "phrase", "n")


def _with_words(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """The blocks with the codes of their words among ``words``, and the steps at which those reached the threshold."""
    known = words.select("lang", F.col("phrase").alias("word"), "reached")
    held = blocks.select("block", "lang", F.posexplode("words").alias("at", "word")).join(known, ["lang", "word"]) \
        .groupBy("block").agg(F.collect_list(F.struct("at", "reached")).alias("held"))
    return blocks.join(held, "block").select("shard", "lang", "words", "n", "codes", F.col("held.at").alias("at"),
                                             F.col("held.reached").alias("reached"))


def _merged(state: DataFrame | None, found: DataFrame) -> DataFrame:
    """State and the counts of a step by phrase: since, n before, ``more`` of this step, reached."""
    zero = F.lit(0).cast("bigint")
    both = found.select("lang", "phrase", "since", zero.alias("n"), F.col("n").alias("more"), F.lit(None).cast("int").alias("reached"))
    if state is not None:
        both = state.select("lang", "phrase", "since", "n", zero.alias("more"), "reached").unionAll(both)
    return both.groupBy("lang", "phrase").agg(F.max("since").alias("since"), F.sum("n").alias("n"), F.sum("more").alias("more"),
                                              F.min("reached").alias("reached"))


def _kept(now: DataFrame, step: int, shards: int, least: int, label: str) -> DataFrame:
    """lang, phrase, since, n, reached after a step.

    Counts still open are kept whole; of those that have seen their full cycle
    only the frequent ones, so what is carried from step to step is small once
    most phrases have been counted.
    """
    total = F.col("n") + F.col("more")
    return staged(now.filter((F.col("since") > step - shards) | (total >= least)).select(
        "lang", "phrase", "since", total.alias("n"),
        F.coalesce("reached", F.when(total >= least, F.lit(step))).alias("reached")), label)


def phrase_counts(docs: DataFrame, least: int = 10, shards: int = SHARDS, text_col: str = "text",
                  lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, pairs, triples): lang, phrase, n of all words and of the frequent phrases, n over all texts."""
    spark: SparkSession = docs.sparkSession
    blocks = coded_blocks(docs, shards, text_col, lang_col)
    words: DataFrame | None = None
    pairs: DataFrame | None = None
    triples: DataFrame | None = None
    filters: list[tuple[int, object]] = []
    final: DataFrame | None = None  # blocks with the steps of their words, once all words are counted
    step, last, pair_steps = 0, shards - 1, 2 * shards
    while step <= last:
        here = F.col("shard") == step % shards
        if step:
            ready = final.filter(here) if final is not None else _with_words(
                blocks.filter(here), words.filter(F.col("reached").isNotNull()))
            if pairs is not None:
                # pairs that the step before has brought to the threshold
                fresh = pairs.filter(F.col("reached") == step - 1)
                if not fresh.isEmpty():
                    filters.append((step - 1, spark.sparkContext.broadcast(bloom_of(fresh))))
                before = triples
                triples = _kept(_merged(triples, scan_triples(ready, step, shards, filters)), step, shards, least, "phrase-triples")
                dropped(before)
            if step < pair_steps:
                before = pairs
                pairs = _kept(_merged(pairs, scan_pairs(ready, step, shards)), step, shards, least, "phrase-pairs")
                dropped(before)
        if step < shards:
            more = word_counts(blocks.filter(here)).withColumn("reached", F.lit(None).cast("int"))
            before = words
            more = words.unionByName(more) if words is not None else more
            words = staged(more.groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.min("reached").alias("reached"))
                           .withColumn("reached", F.coalesce("reached", F.when(F.col("n") >= least, F.lit(step)))), "phrase-words")
            dropped(before)
        # a phrase that becomes countable at step s is done after step s + shards - 1
        if step == shards - 1:
            reached = words.agg(F.max("reached")).first()[0]
            if reached is not None:
                pair_steps = reached + 1 + shards
                last = max(last, pair_steps - 1)
                final = staged(_with_words(blocks, words.filter(F.col("reached").isNotNull())), "phrase-ready")
                dropped(blocks)
        elif step == pair_steps - 1 and pairs is not None:
            reached = pairs.agg(F.max("reached")).first()[0]
            last = max(last, reached + shards) if reached is not None else last
        step += 1
    for _, bits in filters:
        bits.unpersist()
    dropped(final)
    none = words.limit(0)
    return tuple((x if x is not None else none).select("lang", "phrase", "n") for x in (words, pairs, triples))


def mine_phrases(docs: DataFrame, least: int = 10, top: int | None = 2000, shards: int = SHARDS, share: int = 50,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases of two and three words, best first in each language.

    A phrase counts from ``least`` occurrences.  Its score is the least over its
    cuts of floor(1000000 a a / (l r)), exact in 38 digits.  One that stands in a
    longer phrase with at least ``share`` percent of its count is left out.
    Null texts hold no word, a null language is ``und``; repeated rows count as
    often as they stand; an empty table gives no row.  Ranks are ordered by
    score, count (both falling) and the phrase's UTF-8 bytes, which decide ties.
    ``top=None`` returns all phrases.
    """
    words, pairs, triples = phrase_counts(docs, least, shards, text_col, lang_col)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    one, pair, triple = (x.filter(F.col("n") >= least) for x in (words, pairs, triples))
    two, three = (x.withColumnRenamed("n", "a") for x in (pair, triple))

    def parts(source: DataFrame, name: str, value: str) -> DataFrame:
        return source.select("lang", F.col("phrase").alias(name), F.col("n").alias(value))

    def cut_score(l: str, r: str):  # noqa: E741
        big = "decimal(38,0)"
        return F.expr(f"cast(1000000 as {big}) * cast(a as decimal(13,0)) * cast(a as decimal(13,0)) div "
                      f"(cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))")

    two = two.withColumns({"w1": F.substring_index("phrase", " ", 1), "w2": F.substring_index("phrase", " ", -1)}) \
        .join(parts(one, "w1", "l"), ["lang", "w1"]).join(parts(one, "w2", "r"), ["lang", "w2"]) \
        .select("lang", "phrase", "a", "l", "r", cut_score("l", "r").alias("score"))
    three = three.withColumns({
        "head": F.substring_index("phrase", " ", 2), "tail": F.substring_index("phrase", " ", -2),
        "w1": F.substring_index("phrase", " ", 1), "w3": F.substring_index("phrase", " ", -1)}) \
        .join(parts(one, "w1", "l1"), ["lang", "w1"]).join(parts(pair, "tail", "r1"), ["lang", "tail"]) \
        .join(parts(pair, "head", "l2"), ["lang", "head"]).join(parts(one, "w3", "r2"), ["lang", "w3"]) \
        .withColumns({"s1": cut_score("l1", "r1"), "s2": cut_score("l2", "r2")})
    second = F.col("s2") < F.col("s1")
    three = staged(three.select("lang", "phrase", "a", F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"),
                                F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"),
                                F.least("s1", "s2").alias("score"), "head", "tail"), "phrase-three")
    inside = three.select("lang", F.explode(F.array_distinct(F.array("head", "tail"))).alias("phrase"),
                          F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    two = two.join(inside, ["lang", "phrase"], "left") \
        .filter(F.coalesce(F.col("longer") * 100 < F.col("a") * share, F.lit(True))).drop("longer")
    best_first = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = two.unionByName(three.drop("head", "tail"))
    if top is not None:
        # the best of each part of a language first, so one language's phrases are not sorted in one task
        part = F.pmod(F.xxhash64("phrase"), F.lit(executor_slots(docs.sparkSession)))
        some = Window.partitionBy("lang", "_part").orderBy(*best_first)
        found = found.withColumn("_part", part).withColumn("_rank", F.row_number().over(some)).filter(F.col("_rank") <= top) \
            .drop("_part", "_rank")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first)))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("int"), "phrase", "a", "l", "r", "n",
                                              F.col("score").cast("long"))
