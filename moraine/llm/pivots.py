"""Exact top-k by inner product, with a pivot table that rules candidates out.

A vector's angles to a fixed set of pivots are computed once and kept beside it.
For a query q, a candidate x and any pivot p, the angle between q and x is at
least |angle(q, p) - angle(x, p)|; the greatest of these lower bounds gives the
highest inner product that x can still have, |q| |x| cos(bound).  Candidates are
evaluated by falling bound until the bound is below the k-th score found.

Vectors are packed into blocks of bounded size, dealt by nearest pivot, so a
block knows the range of its angles to each pivot and its greatest length.  The
same bound between two blocks orders them: each block of queries first meets its
most promising blocks of candidates, whose k-th scores are where every later
task starts, and then only the blocks that can still hold a better row.  Packed
blocks are joined by block number; a task holds one block of queries and a
bounded number of candidate blocks, however many rows share a vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from moraine.llm.common import executor_slots, numbered
from moraine.session import staged

PIVOTS = 32
SAMPLE = 2048  # distinct vectors among which pivots are chosen
CANDIDATES = 1024  # rows of a block of candidates
QUERIES = 1024  # rows of a block of queries
TOGETHER = 64  # query rows whose bounds are computed together
TASK_BLOCKS = 16  # candidate blocks that one task reads for a block of queries
FIRST = 2  # candidate blocks that a block of queries meets before all others
SLACK = 4e-6  # radians, over the rounding of angles kept in 32 bits
BLOCK = ("kind int, n int, dim int, wide int, norm double, low array<float>, high array<float>, "
         "rows binary, ids binary, null_ids binary, data binary, angles binary")
HITS = "q_block long, query_row long, query_id long, row long, vec_id long, score long, past string"
LIMIT = (1 << 63) - 1
NINES = str.maketrans("0123456789", "9876543210")
LARGEST = 1e100  # components beyond count as this much


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled with zeros."""
    offsets = vectors.offsets.to_numpy()
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), max(1, int(lengths.max(initial=1)))))
    values = vectors.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.clip(np.floor(values), -LARGEST, LARGEST)
    return out


def _column(rows: pa.Table, name: str) -> pa.Array:
    column = rows.column(name).combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def angles_to(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angles to the pivots, lengths); a vector of zeros has angle 0, and no inner product but 0."""
    scale = np.abs(x).max(1, initial=1.0)
    unit = x / scale[:, None]
    size = np.sqrt((unit * unit).sum(1))
    dim = max(x.shape[1], pivots.shape[1])
    cosine = np.pad(unit, ((0, 0), (0, dim - x.shape[1]))) @ np.pad(pivots, ((0, 0), (0, dim - pivots.shape[1]))).T
    cosine /= np.where(size > 0, size, 1)[:, None]
    angle = np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)
    angle[size == 0] = 0
    return angle, size * scale


def choose_pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """Unit vectors far apart: each next one is the sampled row whose nearest pivot is farthest."""
    some = vectors.filter(F.exists("v", lambda c: (c < 0) | (c >= 1))).select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toArrow()
    if not some.num_rows:
        return np.zeros((0, 1))
    x = np.unique(_matrix(_column(some, "v")), axis=0)
    x = x[np.abs(x).max(1) > 0]
    if not len(x):
        return np.zeros((0, 1))
    x /= np.abs(x).max(1)[:, None]
    x /= np.sqrt((x * x).sum(1))[:, None]
    picked, closest = [0], x @ x[0]
    while len(picked) < min(count, len(x)):
        picked.append(int(closest.argmin()))
        closest = np.maximum(closest, x @ x[picked[-1]])
    return x[picked]


def celled(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The vectors with ``cell``, the number of the nearest pivot; written once."""

    def cells(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for lo in range(0, batch.num_rows, 4096):
                rows = batch.slice(lo, 4096)
                x = _matrix(rows.column("v"))
                angle = angles_to(x, pivots)[0]
                cell = angle.argmin(1).astype(np.int32) if len(pivots) else np.zeros(len(x), np.int32)
                yield pa.record_batch([*rows.columns, pa.array(cell)], names=[*rows.schema.names, "cell"])

    made: Callable = cells
    return staged(vectors.mapInArrow(made, "row long, id long, is_query boolean, v array<double>, cell int"), "pivot-cells")


def packed(rows: DataFrame, pivots: np.ndarray, size: int, within: bool, kind: int) -> DataFrame:
    """Blocks of up to ``size`` rows in order of (cell, row), with angles; ``within``: each of one cell only."""

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks(rows: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], list[dict]]:
            """Cuts full blocks off the front; the last, unfinished run stays."""
            rows = rows.combine_chunks()
            cell = rows.column("cell").to_numpy()
            edges = [0, *((np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist() if within else []), len(cell)]
            out, kept = [], len(cell)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                for a in range(lo, hi, size):
                    b = min(a + size, hi)
                    if b == len(cell) and b - a < size and not last:
                        kept = a
                        break
                    out.append(one(rows.slice(a, b - a)))
            return rows.slice(kept).to_batches(), out

        def one(rows: pa.Table) -> dict:
            x = _matrix(_column(rows, "v"))
            angle, norm = angles_to(x, pivots)
            most = np.abs(x).max(initial=0)
            wide = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
            ids = _column(rows, "id")
            return {"kind": kind, "n": len(x), "dim": x.shape[1], "wide": wide,
                    "norm": float(norm.max(initial=0)), "low": angle.min(0), "high": angle.max(0),
                    "rows": rows.column("row").to_numpy().tobytes(),
                    "ids": ids.fill_null(0).to_numpy().astype(np.int64).tobytes(),
                    "null_ids": ids.is_null().to_numpy(zero_copy_only=False).tobytes(),
                    "data": x.astype({2: "<i2", 4: "<i4", 8: "<f8"}[wide]).tobytes(), "angles": angle.tobytes()}

        def emit(found: list[dict]) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(found), 16):
                yield pa.RecordBatch.from_pylist(found[lo:lo + 16], schema)

        for batch in source:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= 8 * size:
                held, found = blocks(pa.Table.from_batches(held), False)
                yield from emit(found)
        if held:
            yield from emit(blocks(pa.Table.from_batches(held), True)[1])

    schema = pa.schema([
        ("kind", pa.int32()), ("n", pa.int32()), ("dim", pa.int32()), ("wide", pa.int32()),
        ("norm", pa.float64()), ("low", pa.list_(pa.float32())), ("high", pa.list_(pa.float32())),
        *((c, pa.binary()) for c in ("rows", "ids", "null_ids", "data", "angles"))])
    made: Callable = pack
    # ranges of (cell, row): a cell that holds most rows is spread over many tasks
    dealt = rows.repartitionByRange(F.col("cell"), F.col("row"))
    if not within:  # few queries: fewer, fuller blocks
        dealt = dealt.coalesce(max(1, -(-rows.count() // (8 * size))))
    return staged(dealt.sortWithinPartitions("cell", "row").mapInArrow(made, BLOCK)
                  .withColumn("block", F.monotonically_increasing_id()), "pivot-blocks")


class _Block:
    """A packed block read back."""

    def __init__(self, row: dict, prefix: str):
        n, dim, wide = row[prefix + "n"], row[prefix + "dim"], row[prefix + "wide"]
        data = np.frombuffer(row[prefix + "data"], {2: "<i2", 4: "<i4", 8: "<f8"}[wide]).reshape(n, dim)
        self.x = data.astype(np.float64)
        self.angles = np.frombuffer(row[prefix + "angles"], np.float32).reshape(n, -1)
        self.size = np.sqrt((self.x * self.x).sum(1))
        self.rows = np.frombuffer(row[prefix + "rows"], np.int64)
        self.ids = np.frombuffer(row[prefix + "ids"], np.int64)
        self.null = np.frombuffer(row[prefix + "null_ids"], bool)


def _scores(q: np.ndarray, x: np.ndarray, sizes: float) -> np.ndarray:
    """Exact inner products of whole numbers: 32-bit or 64-bit floats while they are exact, else Python's integers."""
    dim = min(q.shape[1], x.shape[1])
    q, x = q[:, :dim], x[:, :dim]
    if sizes < 1 << 24:
        return (q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if sizes < 1 << 53:
        return (q @ x.T).astype(np.int64)
    whole = [[int(c) for c in r] for r in x.tolist()]
    return np.array([[sum(int(a) * b for a, b in zip(r, c, strict=True)) for c in whole] for r in q.tolist()], object)


def past_long(score: int) -> str | None:
    """A text that sorts as the score does, for scores that a long can not tell apart."""
    if -LIMIT - 1 < score < LIMIT:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):04d}{digits}"
    return f"{9999 - len(digits):04d}" + digits.translate(NINES)


class TopK:
    """The best k of each query so far: score falling, id rising, null ids last, row rising."""

    def __init__(self, queries: int, k: int, floor: list[int | None]):
        self.k, self.floor = k, list(floor)
        self.best: list[list[tuple]] = [[] for _ in range(queries)]
        # the score a row must reach at least
        self.least = np.array([-np.inf if f is None else float(f) for f in floor])

    def add(self, query: int, found: list[tuple]) -> None:
        self.best[query] = sorted(self.best[query] + found)[:self.k]
        if len(self.best[query]) == self.k:
            least = float(-self.best[query][-1][0])
            self.least[query] = max(self.least[query], least if abs(least) < 1 << 53 else np.nextafter(least, -np.inf))


def search(q: _Block, lo: int, hi: int, x: _Block, top: TopK) -> None:
    """Queries lo..hi of a block against a block of candidates: by falling bound, until no bound reaches the k-th score."""
    size = q.size[lo:hi, None] * x.size[None, :]
    apart = np.zeros(size.shape, np.float32)
    for p in range(q.angles.shape[1]):
        np.maximum(apart, np.abs(q.angles[lo:hi, p, None] - x.angles[None, :, p]), out=apart)
    bound = size * (np.cos(np.maximum(apart - np.float32(SLACK), 0)).astype(np.float64) + SLACK)
    alive = bound >= top.least[lo:hi, None]
    if not alive.any():
        return
    most = float(size.max(initial=0)) + 1
    whole = _scores(q.x[lo:hi], x.x, most) if alive.mean() > 0.25 else None  # one product for all where most are needed
    for i in np.flatnonzero(alive.any(1)).tolist():
        order = np.flatnonzero(alive[i])
        order = order[np.argsort(-bound[i, order], kind="stable")]
        at, step = 0, 64
        while at < len(order) and bound[i, order[at]] >= top.least[lo + i]:
            some = order[at:at + step]
            score = whole[i, some] if whole is not None else _scores(q.x[lo + i:lo + i + 1], x.x[some], most)[0]
            good = np.flatnonzero((score >= top.least[lo + i]) & (x.rows[some] != q.rows[lo + i]))
            if len(good):
                top.add(lo + i, [(-int(score[g]), bool(x.null[some[g]]), int(x.ids[some[g]]), int(x.rows[some[g]]))
                                 for g in good.tolist()])
            at, step = at + step, step * 4


def _evaluate(pairs: DataFrame, asks: DataFrame, blocks: DataFrame, floors: DataFrame | None, k: int) -> DataFrame:
    """Hits of the pairs (q_block, x_block, bound, part); a task reads a block of queries and a part of its candidates."""
    sides = ["block", "n", "dim", "wide", "rows", "ids", "null_ids", "data", "angles"]
    left = asks.select(*(F.col(c).alias("q_" + c) for c in sides)).join(pairs.select("q_block", "part").distinct(), "q_block")
    left = left.join(floors.select("q_block", "floors"), "q_block", "left") if floors is not None else \
        left.withColumn("floors", F.lit(None).cast("map<bigint,bigint>"))
    right = blocks.select(*(F.col(c).alias("x_" + c) for c in sides)).join(
        pairs.select(F.col("q_block").alias("for_block"), "x_block", "bound", F.col("part").alias("for_part")), "x_block")

    def run(asked: pa.Table, given: pa.Table) -> pa.Table:
        found: list[dict] = []
        for row in asked.to_pylist():
            q = _Block(row, "q_")
            floors = dict(row["floors"] or [])
            top = TopK(len(q.rows), k, [floors.get(r) for r in q.rows.tolist()])
            for i in np.argsort(-given.column("bound").to_numpy(), kind="stable").tolist():
                x = _Block({c: given.column(c)[i].as_py() for c in given.column_names if c.startswith("x_")}, "x_")
                for lo in range(0, len(q.rows), TOGETHER):
                    search(q, lo, min(lo + TOGETHER, len(q.rows)), x, top)
            for i, best in enumerate(top.best):
                found += [{"q_block": row["q_block"], "query_row": int(q.rows[i]), "query_id": int(q.ids[i]), "row": r,
                           "vec_id": None if null else v, "score": max(-LIMIT - 1, min(LIMIT, -s)), "past": past_long(-s)} for s, null, v, r in best]
        return pa.Table.from_pylist(found, schema)

    schema = pa.schema([*((c, pa.int64()) for c in ("q_block", "query_row", "query_id", "row", "vec_id", "score")), ("past", pa.string())])
    made: Callable = run
    return left.groupBy("q_block", "part").cogroup(right.groupBy("for_block", "for_part")).applyInArrow(made, HITS)


def block_pairs(asks: DataFrame, blocks: DataFrame, groups: int) -> DataFrame:
    """q_block, x_block, bound, part of all pairs of blocks, part 0 the most promising; by summaries alone.

    Query blocks are dealt to ``groups`` buckets and each candidate summary goes to every bucket.
    """
    def side(frame: DataFrame, prefix: str) -> DataFrame:
        return frame.select(*(F.col(c).alias(prefix + c) for c in ("block", "norm", "low", "high")))

    left = side(asks, "q_").withColumn("bucket", F.pmod(F.xxhash64("q_block"), F.lit(groups)).cast("int"))
    right = side(blocks, "x_").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    gap = F.array_max(F.zip_with(F.zip_with("q_low", "x_high", lambda a, b: a - b),
                                 F.zip_with("x_low", "q_high", lambda a, b: a - b), lambda a, b: F.greatest(a, b)))
    apart = F.greatest(F.coalesce(gap, F.lit(0.0)).cast("double") - SLACK, F.lit(0.0))
    pairs = left.join(right, "bucket").select(
        "q_block", "x_block", (F.col("q_norm") * F.col("x_norm") * (F.cos(apart) + SLACK)).alias("bound"))
    place = F.row_number().over(Window.partitionBy("q_block").orderBy(F.desc("bound"), "x_block")) - 1
    return staged(pairs.withColumn("place", place).select("q_block", "x_block", "bound", F.when(
        F.col("place") < FIRST, F.lit(0)).otherwise(1 + F.floor((F.col("place") - FIRST) / TASK_BLOCKS)).cast("int").alias("part")),
        "pivot-pairs")


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc("past"), F.asc_nulls_last("vec_id"), F.asc("row"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_products(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, pivots: int = PIVOTS,
                 id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the k best of all other rows.

    Components become floor(scale * x).  Rows whose vector is null or holds a
    null or a non-finite component take no part; an empty vector is one of
    zeros, and of two lengths the shorter vector goes on with zeros.  A row is
    never its own answer, but a repeated row, or one with the same id, is.  Rows
    with a null id are candidates, last among equal scores, and never queries.
    Equal scores and ids come in row order.  Scores past 64 bits are ranked
    exactly and shown as the largest or smallest long.  An empty table gives no rows.
    """
    rows = numbered(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), "pivot-rows")
    finite = F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(finite).select("row", "id", F.coalesce(F.pmod("id", F.lit(every)) == 0, F.lit(False)).alias("is_query"),
                                      F.transform("v", lambda c: c.cast("double") * scale).alias("v"))
    points = choose_pivots(rows, pivots)
    rows = celled(rows, points)
    blocks = packed(rows, points, CANDIDATES, True, 0)
    asks = packed(rows.filter("is_query"), points, QUERIES, False, 1)
    pairs = block_pairs(asks, blocks, executor_slots(vectors.sparkSession))
    first = staged(_evaluate(pairs.filter("part = 0"), asks, blocks, None, k), "pivot-first")
    # the k-th score of every query so far; a block of queries all of which have one needs no candidates below the least
    known = _best(first, k).filter((F.col("rank") == k) & F.col("score").between(1 - (1 << 53), (1 << 53) - 1)).groupBy("q_block").agg(
        F.map_from_entries(F.collect_list(F.struct("query_row", "score"))).alias("floors"),
        F.count("*").alias("known"), F.min("score").alias("least"))
    floors = staged(known.join(asks.select(F.col("block").alias("q_block"), "n"), "q_block").withColumn(
        "least", F.when(F.col("known") == F.col("n"), F.col("least"))), "pivot-floors")
    rest = pairs.filter("part > 0").join(floors.select("q_block", "least"), "q_block", "left") \
        .filter(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).drop("least")
    hits = first.unionByName(_evaluate(rest, asks, blocks, floors, k))
    return _best(hits, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
