"""N-gram Jaccard self-join by grouped prefixes, down to connected components.

1. Shingle counts over all documents put the frequent shingles last in a global
   order (only those are looked up: a bounded table); any order that all share is
   a right one, so shingles seen seldom follow their hash.
2. A set's prefix is its first n - ceil(t n) + 1 shingles.  Sets alike are one
   class; classes with the same size and prefix are one group, which meets
   others once however many members it has.
3. Posting lists of prefix shingles give group pairs past the size and position
   filters.  First every group meets only the most central group of its list;
   verified links join most near copies.  Then the lists are read again and only
   pairs that are not yet connected are tested.  So no link between components
   is lost, and a large group of near copies never becomes all its pairs.
4. Group pairs expand into their members, whose texts meet and are compared as
   whole sets.

Shingles are compared as 64-bit hashes.  Nothing but counts and the table of
frequent shingles reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from moraine.llm.common import run_starts, small_batches, tokens, whole_runs
from moraine.llm.components import components
from moraine.session import staged

FREQUENT = 1 << 19  # shingles whose order is looked up, at most
FLUSH = 1 << 20  # shingles a task counts together
WORDS_HELD = 100_000  # word hashes a task remembers
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


class Shingles:
    """Sorted distinct shingle hashes of texts: ``k`` words each, or the whole of a shorter text."""

    def __init__(self, k: int):
        self.k, self.words = k, WordHashes()
        self.factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)

    def of(self, text: bytes | None) -> np.ndarray:
        words = tokens(text)
        if not words:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        k, n = min(self.k, len(w)), max(1, len(w) - self.k + 1)
        total = np.full(n, k, np.uint64)
        for j in range(k):
            total += w[j:n + j] * self.factors[j]
        return np.unique(mix(total))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set, which name it whatever its order."""
    a, b = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(), mix(s ^ np.uint64(0x14057B7EF767814F)).sum()
    return int(a.view(np.int64)), int(b.view(np.int64))


class Frequent:
    """Counts of the frequent shingles; 0 for all others."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.keys >> np.uint64(42)] = True

    def of(self, s: np.ndarray) -> np.ndarray | None:
        maybe = np.flatnonzero(self.seen[s >> np.uint64(42)])
        if not len(maybe):
            return None
        at = np.minimum(np.searchsorted(self.keys, s[maybe]), len(self.keys) - 1)
        out = np.zeros(len(s), np.int64)
        out[maybe] = np.where(self.keys[at] == s[maybe], self.counts[at], 0)
        return out


class Rule:
    """100 * |A and B| >= percent * |A or B|, and what follows from it."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def sizes(self, small: np.ndarray, large: np.ndarray) -> np.ndarray:
        return 100 * small >= self.percent * large

    def can(self, n1, p1, n2, p2) -> np.ndarray:
        """Sizes fit, and enough shingles are left after the first one in common at these positions."""
        most = 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1)
        return self.sizes(np.minimum(n1, n2), np.maximum(n1, n2)) & \
            ((100 + self.percent) * most >= self.percent * (n1 + n2))

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if not self.sizes(min(len(a), len(b)), max(len(a), len(b))):
            return False
        both = np.concatenate([a, b])
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        return 100 * shared >= self.percent * (len(both) - shared)


def _rows(source: Iterator[pa.RecordBatch], step: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


def frequent_shingles(texts: DataFrame, k: int, most: int = FREQUENT) -> Frequent:
    """The shingles with the highest counts over all documents, ``most`` at most.

    A task reports what occurs at least twice among some millions of shingles,
    so what it leaves out is rare there.
    """

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, n = Shingles(k), [], 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(held) if held else np.zeros(0, np.uint64)
            every.sort()
            starts = run_starts(every)
            times = np.diff(starts)
            often = times > 1
            return pa.record_batch({"shingle": pa.array(every[starts[:-1][often]].view(np.int64)),
                                    "times": pa.array(times[often])})

        for batch in _rows(source):
            for text in batch.column("text").to_pylist():
                held.append(shingles.of(text))
                n += len(held[-1])
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        yield flush()

    counts = staged(texts.select("text").mapInArrow(count, "shingle long, times long").groupBy("shingle").agg(
        F.sum("times").alias("times")), "jaccard-counts")
    octave = F.floor(F.log2("times") * 4)
    least, so_far = None, 0
    for row in sorted(counts.groupBy(octave.alias("o")).count().collect(), key=lambda r: -r.o):  # under 300 rows
        so_far += row["count"]
        if so_far > most:
            break
        least = row.o
    if least is None:
        return Frequent(np.zeros(1, np.uint64), np.zeros(1, np.int64))
    table = counts.filter(octave >= least).toPandas()  # ``most`` rows at most
    return Frequent(table["shingle"].to_numpy(np.int64).view(np.uint64), table["times"].to_numpy(np.int64))


def marked_sets(texts: DataFrame, k: int, rule: Rule, frequent: Frequent, key: str) -> DataFrame:
    """id, n, s1, s2 and prefix (hashes in the global order) of every text."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)  # bounded by FREQUENT

    def mark(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, order = Shingles(k), shared.value
        for batch in _rows(source):
            sizes, keys, prefixes = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles.of(text)
                sizes.append(len(s))
                keys.append(set_key(s))
                if len(s):
                    often = order.of(s)
                    s = s if often is None else s[np.argsort(often, kind="stable")]
                    s = s[:rule.prefix(len(s))]
                prefixes.append(s.view(np.int64))
            yield pa.record_batch({
                "id": batch.column("id"), "n": pa.array(sizes, pa.int64()),
                "s1": pa.array([a for a, _ in keys], pa.int64()), "s2": pa.array([b for _, b in keys], pa.int64()),
                "prefix": pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()),
                    pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))})

    return staged(texts.mapInArrow(mark, f"id {key}, n long, s1 long, s2 long, prefix array<long>"), "jaccard-sets")


POSTING = "shingle long, n long, pos long, gid long"


def _posting_arrays(table: pa.Table, *more: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in ("shingle", "n", "pos", "gid", *more)]


def _by_list(postings: DataFrame) -> DataFrame:
    return postings.repartition("shingle").sortWithinPartitions("shingle", "n", "pos", "gid")


def shared_postings(groups: DataFrame) -> DataFrame:
    """Postings of the prefix shingles that at least two groups have."""

    def keep(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, and whether it is out already
        for batch in source:
            if not batch.num_rows:
                continue
            rows = batch if last is None else pa.Table.from_batches([last[0], batch]).combine_chunks().to_batches()[0]
            shingle = rows.column("shingle").to_numpy()
            same = shingle[1:] == shingle[:-1]
            wanted = np.append(False, same) | np.append(same, False)
            if last is not None and last[1]:
                wanted[0] = False
            out = bool(wanted[-1]) or (len(wanted) == 1 and last is not None and last[1])
            yield rows.filter(pa.array(wanted))
            last = rows.slice(rows.num_rows - 1), out

    postings = groups.select(F.posexplode("prefix").alias("pos", "shingle"), "n", "gid").select(
        "shingle", "n", F.col("pos").cast("long").alias("pos"), "gid")
    return staged(_by_list(postings).mapInArrow(keep, POSTING), "jaccard-lists")


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs, the smaller number first."""
    two = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)
    two = two[two[:, 0] != two[:, 1]]
    if len(two):
        two = two[np.lexsort((two[:, 1], two[:, 0]))]
        starts = run_starts(two[:, 0], two[:, 1])[:-1]
        two = two[starts]
    return pa.record_batch({"g1": pa.array(two[:, 0]), "g2": pa.array(two[:, 1])})


def central_pairs(postings: DataFrame, rule: Rule) -> DataFrame:
    """Each group with the first of its size in every list, and these with the next size's: linear in the lists."""

    def pair(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the first group of the size that the batch before ended in
        for batch in source:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            shingle, n, pos, gid = _posting_arrays(rows)
            starts = run_starts(shingle, n)
            first = np.repeat(starts[:-1], np.diff(starts))
            heads = starts[1:-1]
            heads = heads[shingle[heads] == shingle[heads - 1]]
            a = np.concatenate([first, first[heads - 1]])
            b = np.concatenate([np.arange(len(n)), heads])
            fit = (a != b) & rule.can(n[a], pos[a], n[b], pos[b])
            yield _pairs(gid[a[fit]], gid[b[fit]])
            last = rows.slice(int(first[-1]), 1).to_batches()[0]

    return _by_list(postings).mapInArrow(pair, "g1 long, g2 long").distinct()


def open_pairs(postings: DataFrame, rule: Rule) -> DataFrame:
    """Group pairs of all lists that may link and are not known to be connected (low, high: components in a group)."""

    def pair(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(source, "shingle"):
            shingle, n, pos, gid, low, high = _posting_arrays(rows.combine_chunks(), "low", "high")
            starts = run_starts(shingle)
            mixed = np.minimum.reduceat(low, starts[:-1]) != np.maximum.reduceat(high, starts[:-1])
            size = np.diff(starts)
            two = starts[:-1][mixed & (size == 2)]
            fit = rule.can(n[two], pos[two], n[two + 1], pos[two + 1])
            yield _pairs(gid[two[fit]], gid[two[fit] + 1])
            found, held = [], 0
            for at, m in zip(starts[:-1][mixed & (size > 2)].tolist(), size[mixed & (size > 2)].tolist(), strict=True):
                ends = at + np.searchsorted(n[at:at + m], n[at:at + m] * 100 // rule.percent, "right")
                for i in range(at, at + m - 1):
                    others = slice(i + 1, int(ends[i - at]))
                    fit = rule.can(n[i], pos[i], n[others], pos[others]) & \
                        ((low[others] != high[i]) | (high[others] != low[i]))
                    near = gid[others][fit]
                    if len(near):
                        found.append((np.full(len(near), gid[i]), near))
                        held += len(near)
                    if held > 1_000_000:
                        yield _pairs(*map(np.concatenate, zip(*found, strict=True)))
                        found, held = [], 0
            if found:
                yield _pairs(*map(np.concatenate, zip(*found, strict=True)))

    return _by_list(postings).mapInArrow(pair, "g1 long, g2 long").distinct()


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


class Join:
    """The steps over one table of texts (id, text)."""

    def __init__(self, texts: DataFrame, k: int, percent: int):
        self.texts, self.k, self.rule = texts, k, Rule(percent)
        self.key = texts.schema["id"].dataType.simpleString()
        frequent = frequent_shingles(texts, k)
        self.sets = marked_sets(texts, k, self.rule, frequent, self.key)
        alike = self.sets.filter("n > 0").groupBy("n", "s1", "s2").agg(
            F.min("id").alias("id"), F.first("prefix").alias("prefix"))
        self.classes = staged(alike.select(
            F.monotonically_increasing_id().alias("cid"), "n", "s1", "s2", "id",
            F.xxhash64("n", "prefix").alias("gid"), "prefix"), "jaccard-classes")
        self.members = self.classes.select("cid", "gid")
        self.groups = self.classes.groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        self.heads = staged(self.members.groupBy("gid").agg(F.min("cid").alias("head")), "jaccard-heads")

    def verified(self, pairs: DataFrame, many: bool = True) -> DataFrame:
        """a, b of the class pairs whose whole sets link; with ``many``, texts move by the same plan at every size."""
        k, rule = self.k, self.rule
        pairs = staged(pairs, "jaccard-pairs")
        wanted = staged(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(
            self.classes.select("cid", "n", "s1", "s2", F.col("id").alias("rep")), "cid"), "jaccard-wanted")

        def own(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles = Shingles(k)  # ids may repeat: only rows of the class itself stay
            for batch in _rows(source):
                keys = [set_key(shingles.of(t)) for t in batch.column("text").to_pylist()]
                fit = [key == want for key, want in zip(
                    keys, zip(batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), strict=True), strict=True)]
                yield batch.select(["cid", "text"]).filter(pa.array(fit, pa.bool_()))

        wanted = wanted.hint("merge") if many else wanted
        bodies = staged(self.texts.join(wanted, _same("id", "rep")).select("cid", "text", "s1", "s2").mapInArrow(
            own, "cid long, text binary"), "jaccard-bodies")

        def compare(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles, held = Shingles(k), {}

            def set_of(cid: int, text: bytes) -> np.ndarray:
                if cid not in held:
                    if len(held) >= 128:
                        held.clear()
                    held[cid] = shingles.of(text)
                return held[cid]

            for batch in _rows(source):
                a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
                fit = [rule.linked(set_of(x, tx), set_of(y, ty)) for x, y, tx, ty in zip(a, b, ta, tb, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(fit, pa.bool_()))

        met = pairs.join(bodies.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a") \
            .join(bodies.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b") \
            .select("a", "b", "text_a", "text_b")
        return staged(met.mapInArrow(compare, "a long, b long"), "jaccard-links")

    def links(self) -> DataFrame:
        """Verified links between classes that connect all that is connected."""
        postings = shared_postings(self.groups)
        met = staged(central_pairs(postings, self.rule), "jaccard-central")
        h = self.heads
        central = met.join(h.select(F.col("gid").alias("g1"), F.col("head").alias("a")), "g1").join(
            h.select(F.col("gid").alias("g2"), F.col("head").alias("b")), "g2").select("a", "b")
        inside = self.members.join(h, "gid").filter("cid <> head").select(F.col("head").alias("a"), F.col("cid").alias("b"))
        first = self.verified(central.unionByName(inside).distinct())

        at = components(first)
        member = staged(self.members.join(at.withColumnRenamed("node", "cid"), "cid", "left").select(
            "cid", "gid", F.coalesce("component", "cid").alias("component")), "jaccard-members")
        spans = staged(member.groupBy("gid").agg(
            F.min("component").alias("low"), F.max("component").alias("high")), "jaccard-spans")
        apart = staged(open_pairs(postings.join(spans, "gid").select("shingle", "n", "pos", "gid", "low", "high"),
                                  self.rule), "jaccard-open")
        m1 = member.select(F.col("gid").alias("g1"), F.col("cid").alias("a"), F.col("component").alias("ca"))
        m2 = member.select(F.col("gid").alias("g2"), F.col("cid").alias("b"), F.col("component").alias("cb"))
        across = apart.join(m1, "g1").join(m2, "g2").filter("ca <> cb").select("a", "b")
        split = spans.filter("low <> high").select("gid")
        within = m1.join(split.withColumnRenamed("gid", "g1"), "g1").join(m2, F.col("g1") == F.col("g2")) \
            .filter("a < b AND ca <> cb").select("a", "b")
        tested = central.unionByName(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        again = across.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return first.unionByName(self.verified(again.join(tested, ["a", "b"], "left_anti"), many=False))


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (smallest id reachable by links, its own included) of every row.

    A text's set is its distinct shingles of ``words`` words, the whole sequence
    if it has fewer; null and empty texts have no shingle, link with nothing and
    are their own component.  Rows with equal sets are linked even where their
    ids are equal or null; null ids count only where a component has no other.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    with small_batches(docs.sparkSession):  # whatever reads texts is written inside
        join = Join(texts, words, percent)
        links = join.links()
    at = components(links)
    classes = join.classes.select("cid", "n", "s1", "s2", "id").join(at.withColumnRenamed("node", "cid"), "cid", "left") \
        .select("n", "s1", "s2", "id", F.coalesce("component", "cid").alias("component"))
    classes = staged(classes, "jaccard-placed")
    least = classes.groupBy("component").agg(F.min("id").alias("component_id"))
    named = staged(classes.join(least, "component").select("n", "s1", "s2", "component_id"), "jaccard-named")
    return join.sets.select("id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The row with the smallest id of every component (null ids last), all columns as they are."""
    from moraine.llm.common import numbered

    rows = numbered(docs.select(F.struct(*docs.columns).alias("kept_columns")), "jaccard-docs")
    kept = F.col("kept_columns")
    parts = jaccard_components(rows.select("row", kept[text_col].alias("text")), words, percent, "row", "text")
    named = staged(rows.select("row", kept[id_col].alias("id")).join(parts, "row"), "jaccard-rows")
    stays = named.groupBy("component_id").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("least")).select(
        F.col("least.row").alias("row"))
    return rows.join(staged(stays, "jaccard-stays"), "row", "left_semi").select("kept_columns.*")
