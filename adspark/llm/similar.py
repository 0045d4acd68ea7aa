"""Near copies by SimHash and exact Jaccard similarity of word shingles.

Large groups of near copies would make pairs by the square. They are linked first: texts whose SimHash
fingerprints differ in few bits, found by the byte-position index of ``simhash``, and texts that share a
MinHash key are verified against the least text of their group, and then those that share a list of
the prefix filter against one text of the list.

SimHash alone misses copies with more than a few changed words, so the rest is found by the prefix
filter: with the shingles of all texts in one common order, two texts of similarity t or more share
one of the first n - ceil(t n) + 1 shingles of each, n being the text's own number. Shingles that a
sample of texts finds frequent come last in the order, the others go by their hash; any order gives
the same links. Texts that meet in a list, and are not in one component yet, are compared by size and by
a short bitmap in which each shingle flips one bit: texts whose bitmaps differ in more bits than their
sets may differ in shingles are no pair. Pairs that are left are compared by a bitmap that grows with
the text, which lets little but true pairs pass; only these are verified on the texts themselves. Links
are those of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import parts, written
from .components import components
from .simhash import majority, near_links, one_of_each_root, tag_of

#: MinHash keys of a text for the first links, and minima in a key.
BANDS, ROWS = 8, 4
#: Texts in the sample for frequent shingles, texts of it that make one frequent, and the most of them.
SAMPLE, FREQUENT, MOST_FREQUENT = 5000, 3, 100_000
#: Longest list that is compared row against row at once, and longest one that a single task compares.
SHORT, LONG = 64, 4000
#: Times that the texts of a list are compared with one of them before all are with each other.
TURNS = 2
#: SimHash bits in which texts of the first links differ at most.
NEAR_BITS = 2
#: Bits of the long bitmap for each shingle, at least, and the fewest of a bitmap.
BITS_EACH, FEWEST_BITS = 4, 256
ROWS_PER_PART = 200_000

_FACTORS = np.random.default_rng(42).integers(1, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int) -> list[bytes]:
    """Runs of ``size`` words, lower case for A-Z; fewer words are one run, no words none."""
    words = (text or "").encode().lower().split()
    n = min(size, len(words))
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def all_hashes(text: str | None, size: int) -> np.ndarray:
    """Hashes of all shingles, repeated ones too."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in shingles(text, size)], dtype=np.uint64)


def hashes(text: str | None, size: int) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    return np.unique(all_hashes(text, size))


def similarity(a: frozenset, b: frozenset) -> float:
    """Jaccard similarity; two texts without words are equal."""
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared) if a or b else 1.0


def prefix(values: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The shingles one of which any text of that similarity shares; a text without words has the shingle 0."""
    n = len(values)
    if not n:
        return np.zeros(1, dtype=np.uint64)
    known, count = frequent
    rank = np.zeros(n, dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        rank = np.where(known[at] == values, count[at], 0)
    return values[np.lexsort((values, rank))[: n - math.ceil(least * n - 1e-9) + 1]]


def bitmap(values: np.ndarray) -> np.ndarray:
    """256 bits as four numbers: each shingle flips one."""
    odd = np.bincount((values >> np.uint64(20)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def long_bitmap(values: np.ndarray) -> bytes:
    """As ``bitmap``, with a power of two of bits that follows the number of shingles."""
    bits = 1 << max(FEWEST_BITS, BITS_EACH * len(values)).bit_length() - 1
    odd = np.bincount((values >> np.uint64(8)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def bitmaps_differ(a: bytes, b: bytes) -> int:
    """Bits in which two long bitmaps differ, the longer one folded to the length of the other."""
    x, y = sorted((np.frombuffer(v, dtype=np.uint64) for v in (a, b)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def minima(values: np.ndarray) -> np.ndarray:
    """MinHash keys: each of several minima of the remixed hashes."""
    if not len(values):
        return np.zeros(BANDS, dtype=np.int64)
    x = values[None, :] ^ (values[None, :] >> np.uint64(29))
    least = ((x * _FACTORS) >> np.uint64(16)).min(axis=1).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes()) for row in least], dtype=np.uint64).view(np.int64)


def _possible(rows: np.ndarray, i, j, least: float) -> np.ndarray:
    """Whether pairs of rows (k, key, component, n, four of bitmap) may be similar and are not linked yet."""
    n, m = rows[3][i], rows[3][j]
    ok = (rows[2][i] != rows[2][j]) & (np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9)
    differ = sum(np.bitwise_count((rows[4 + w][i] ^ rows[4 + w][j]).view(np.uint64)).astype(np.int64) for w in range(4))
    return ok & (differ <= (n + m) * (1 - least) / (1 + least) + 1e-9)


def pairs_in_lists(rows: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the pairs that may be similar in a run of lists, sorted by k and component."""
    starts = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]]) if rows.shape[1] else np.empty(0, dtype=np.int64)
    lengths = np.diff(np.r_[starts, rows.shape[1]])
    # sorted by component: a list whose ends agree has one only
    open_ = rows[2][starts] != rows[2][starts + lengths - 1]
    for s, n in zip(starts[open_ & (lengths > SHORT)].tolist(), lengths[open_ & (lengths > SHORT)].tolist()):
        own = rows[:, s : s + n]
        cut = np.flatnonzero(np.r_[True, own[2][1:] != own[2][:-1]])
        size = np.diff(np.r_[cut, n])
        # the largest component is only compared against
        own = own[:, np.lexsort((own[2], np.repeat(size, size)))]
        for i in range(n - int(size.max())):
            j = np.arange(i + 1, n)
            near = j[_possible(own, i, j, least)]
            if len(near):
                yield np.full(len(near), own[1][i]), own[1][near]
    short = open_ & (lengths <= SHORT)
    own = rows[:, np.repeat(short, lengths)]
    i, d = np.arange(own.shape[1]), 1
    while len(i):
        i = i[i + d < own.shape[1]]
        i = i[own[0][i] == own[0][i + d]]
        near = i[_possible(own, i, i + d, least)]
        if len(near):
            yield own[1][near], own[1][near + d]
        d += 1


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _frequent(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample hold, in order, and how many do."""
    share = max(1, math.ceil(texts.count() / SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(hashes(text.as_py(), size).view(np.int64))], names=["h"])

    sample = texts.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).select("text")
    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    found = counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).collect()
    known, n = np.array([r["h"] for r in found], dtype=np.int64).view(np.uint64), np.array([r["n"] for r in found], dtype=np.int64)
    order = np.argsort(known)
    return known[order], n[order]


def _sketches(texts: DataFrame, size: int, least: float) -> DataFrame:
    """(key, n, fp, bitmap, bands, prefix, long) of each different text."""
    shared = texts.sparkSession.sparkContext.broadcast(_frequent(texts, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, lists, long = [], [], ([], [], []), []
            for text in batch.column(1):
                every = all_hashes(text.as_py(), size)
                values = np.unique(every)
                n.append(len(values))
                prints.append(majority(every) if len(every) else 0)
                long.append(long_bitmap(values))
                for column, x in zip(lists, (bitmap(values), minima(values), prefix(values, shared.value, least).view(np.int64))):
                    column.append(x)
            fp = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            arrays = [pa.array(n, pa.int64()), fp, *[pa.array(column, pa.list_(pa.int64())) for column in lists], pa.array(long, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["key", "n", "fp", "bitmap", "bands", "prefix", "long"])

    schema = "key long, n long, fp long, bitmap array<long>, bands array<long>, prefix array<long>, long binary"
    return texts.select("key", "text").mapInArrow(run, schema).dropDuplicates(["key"])


def _likely(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose long bitmaps differ in no more bits than similar sets may differ in shingles."""
    sides = pairs
    for c in "ab":
        sides = sides.join(sketches.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("long").alias(f"long_{c}")), c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            differ = np.array([bitmaps_differ(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5))], dtype=np.int64)
            yield batch.select([0, 1]).filter(pa.array(differ <= n * (1 - least) / (1 + least) + 1e-9))

    return sides.select("a", "b", "n_a", "n_b", "long_a", "long_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Pairs (a, b) of keys whose texts are similar."""
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    needed = written(texts.join(keys, "key", "left_semi").dropDuplicates(["key"]), "candidate-texts")
    sides = pairs
    for c in "ab":
        sides = sides.join(needed.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}")), c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(256)(lambda text: frozenset(shingles(text, size)))
        for batch in batches:
            ta, tb = batch.column(2), batch.column(3)
            ok = [similarity(known(x.as_py()), known(y.as_py())) >= least - 1e-9 for x, y in zip(ta, tb)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return sides.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _first_pairs(sketches: DataFrame) -> DataFrame:
    """Pairs of texts with a MinHash key or a group of near fingerprints in common, each with the least of its list."""
    prints = written(sketches.select("fp").distinct(), "prints")
    near = components(near_links(prints, NEAR_BITS))
    groups = sketches.join(near, sketches["fp"] == near["node"], "left")
    index = sketches.select("key", F.posexplode("bands").alias("t", "k"))
    index = index.unionByName(groups.select("key", F.lit(-1).alias("t"), F.coalesce("component", "fp").alias("k")))
    lists = index.groupBy("t", "k").agg(F.min("key").alias("a"), F.count("*").alias("n")).where("n > 1")
    return index.join(lists, ["t", "k"]).where("key != a").select("a", F.col("key").alias("b")).distinct()


def _open_lists(sketches: DataFrame, joined: DataFrame) -> DataFrame:
    """(k, key): shingles of the prefixes with their texts, of those lists that hold texts of several components."""
    index = sketches.select(F.explode("prefix").alias("k"), "key")
    named = _named(index, joined)
    lists = named.groupBy("k").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("k")
    return index.join(written(lists, "lists"), "k")


def _named(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows of (key, ...) with the component of the text."""
    return rows.join(joined, rows["key"] == joined["node"], "left").withColumn("component", F.coalesce("component", "key")).drop("node")


def _sizes(sketches: DataFrame, suffix: str = "") -> DataFrame:
    """What tells quickly whether two texts may be similar: (key, n, b0..b3), the names with a suffix."""
    return sketches.select(F.col("key").alias(f"key{suffix}"), F.col("n").alias(f"n{suffix}"), *[F.col("bitmap")[w].alias(f"b{w}{suffix}") for w in range(4)])


def _star_pairs(lists: DataFrame, sketches: DataFrame, joined: DataFrame, least: float, turn: int) -> DataFrame:
    """Pairs of texts in the same list and different components, each with one text of the list: no more than the list is long.

    Which text that is depends on the list and the turn, so that one far from the others does little harm.
    """
    rows = written(_named(lists, joined), "list-rows")
    first = F.min(F.struct(F.xxhash64("key", "k", F.lit(turn)).alias("order"), "key", "component")).alias("m")
    met = rows.join(rows.groupBy("k").agg(first), "k").where(F.col("component") != F.col("m.component"))
    pairs = met.select(F.least("key", "m.key").alias("key_a"), F.greatest("key", "m.key").alias("key_b")).distinct()
    sides = pairs.join(_sizes(sketches, "_a"), "key_a").join(_sizes(sketches, "_b"), "key_b")
    smaller, larger = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    differ = sum((F.bit_count(F.col(f"b{w}_a").bitwiseXOR(F.col(f"b{w}_b"))) for w in range(4)), F.lit(0))
    possible = (smaller >= F.lit(least) * larger - 1e-9) & (differ <= (F.col("n_a") + F.col("n_b")) * ((1 - least) / (1 + least)) + 1e-9)
    return sides.where(possible).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))


def _other_pairs(lists: DataFrame, sketches: DataFrame, joined: DataFrame, least: float) -> DataFrame:
    """Pairs of texts that share a shingle of their prefixes, may be similar and are in different components."""
    named = _named(lists, joined)
    counts = named.groupBy("k").agg(F.count("*").alias("rows"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    counts = written(counts.where("c0 < c1").select("k", "rows"), "lists")
    rows = counts.agg(F.sum("rows")).first()[0] or 0
    index = named.join(counts, "k").join(_sizes(sketches), "key").select("k", "key", "component", "n", "b0", "b1", "b2", "b3", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((8, 0), dtype=np.int64)
        for batch in batches:
            rest = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            # the last list of the batch may go on in the next one
            last = np.flatnonzero(rest[0] != rest[0, -1]) if rest.shape[1] else []
            if len(last):
                yield from (_batch(a, b) for a, b in pairs_in_lists(rest[:, : last[-1] + 1], least))
                rest = np.ascontiguousarray(rest[:, last[-1] + 1 :])
        yield from (_batch(a, b) for a, b in pairs_in_lists(rest, least))

    partitions = parts(rows, sketches.sparkSession.sparkContext.defaultParallelism, ROWS_PER_PART)
    # a long list is cut into blocks, and every two of them are a list of their own
    blocks = F.ceil(F.col("rows") / (LONG // 2)).cast("int")
    own = F.pmod(F.col("key"), blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.xxhash64("k", F.least(own, j), F.greatest(own, j)))
    index = index.withColumn("k", F.explode(F.when(F.col("rows") > LONG, others).otherwise(F.array("k")))).drop("rows")
    dealt = index.repartition(partitions, "k").sortWithinPartitions("k", "component")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def similar_links(texts: DataFrame, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """Links (a, b) that join all keys of (key, text) with texts of Jaccard similarity ``least`` or more; rows of a key are equal."""
    sketches = written(_sketches(texts, shingle, least), "sketches")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        likely = written(_likely(written(pairs, f"{name}-pairs"), sketches, least), f"{name}-likely")
        return written(_verified(likely, texts, shingle, least), f"{name}-links")

    found = links(_first_pairs(sketches), "first")
    joined = components(found)
    lists = written(_open_lists(sketches, joined), "open-lists")
    for turn in range(TURNS):
        found = found.unionByName(links(_star_pairs(lists, sketches, joined, least, turn), "star"))
        joined = components(found)
    return found.unionByName(links(_other_pairs(lists, sketches, joined, least), "other"))


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def keep_one_of_similar(docs: DataFrame, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with all columns, of which one stays for each component of near copies.

    Texts link when their sets of ``shingle`` words have a Jaccard similarity of ``least`` or more;
    texts without words, and NULL, are equal. The row that stays is that of ``simhash.keep_one_of_each``.
    """
    key, text = _key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text")
    joined = components(similar_links(docs.select(key, text), least, shingle))
    marks = docs.select(F.col(id_col).alias("doc_id"), tag_of(text_col).alias("tag"), key)
    found = marks.join(joined, marks["key"] == joined["node"], "left").select("doc_id", "tag", F.coalesce("component", "key").alias("root"))
    return one_of_each_root(docs, found, id_col, text_col)
