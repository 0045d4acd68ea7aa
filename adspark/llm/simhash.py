"""Near-duplicates by SimHash with an index of byte positions.

A fingerprint has 64 bits in 8 bytes. Two fingerprints that differ in at most ``bits`` bits differ in
at most as many bytes, so they share at least 8 - bits positional bytes: the guaranteed minimum. An
inverted index on single bytes would have 2,048 lists that all grow with the corpus, so the index
lists are keyed by several positions at once, chosen so that every linked pair meets in one of them:

- up to 2 bits: of four pairs of bytes at least two are whole, which makes six lists of four bytes;
- up to 5 bits: at least three bytes are whole, which makes 56 lists of three bytes.

Within a list the shared positional bytes of each pair are tallied, pairs below the minimum are
dropped and the rest is verified bit by bit. A list longer than ``LIST`` is keyed again by a part of
the other bits that must be whole too: two of the other four bytes, or one of six chunks of the other
40 bits.

Only distinct fingerprints enter the index, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import parts, written
from .components import components

#: Longest index list that is compared as it is.
LIST = 2000
ROWS_PER_PART = 200_000

def _mask(positions) -> int:
    """Bit mask of byte positions as a signed 64-bit number."""
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _chunks(mask: int, n: int) -> list[int]:
    """``n`` masks that part the bits outside ``mask``."""
    free = [b for b in range(64) if not mask >> b & 1]
    parts = [sum(1 << b for b in free[i::n]) for i in range(n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in parts]


def index_masks(bits: int) -> tuple[list[int], list[list[int]]]:
    """Masks of the index lists' keys, and for each those of the lists that replace a long one."""
    if not 0 <= bits <= 5:
        raise ValueError("the index guarantees links of up to 5 bits")
    if bits > 2:
        first = [_mask(p) for p in combinations(range(8), 3)]
        return first, [[m | c for c in _chunks(m, 6)] for m in first]
    pairs = [(0, 1), (2, 3), (4, 5), (6, 7)]
    whole = [a + b for a, b in combinations(pairs, 2)]
    rest = [[p for p in range(8) if p not in used] for used in whole]
    return [_mask(p) for p in whole], [[_mask(p + more) for more in combinations(other, 2)] for p, other in zip(whole, rest)]


def fingerprint_of(data: bytes, shingle: int = 3) -> int:
    """SimHash of a text given as UTF-8: majority of each bit over all shingles' XXH64 with seed 42."""
    words = data.lower().split()  # bytes: only A-Z change, only the six ASCII spaces part words
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        starts = [0, *ends[: len(words) - shingle].tolist()]
        stops = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, stops)]
    return majority(np.array(hashes, dtype="<u8"))


def majority(values: np.ndarray) -> int:
    """The bits that are set in over half of the numbers."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * counts > len(values))
    return sum(1 << int(b) for b in set_bits)


def tag_of(text_col: str) -> Column:
    """Checksum of a text, to tell apart rows with the same id."""
    return F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, fp): checksum of the text and its fingerprint's 64 bits as longs; texts without words, and NULL, have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint_of((t.as_py() or "").encode(), shingle) for t in batch.column(1)]
            fp = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), fp], names=["doc_id", "tag", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), tag_of(text_col).alias("tag"))
    return narrow.mapInArrow(run, f"doc_id {kind}, tag long, fp long")


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = parent[at]
    while not np.array_equal(up := parent[at], at):
        at = up
    return at


def links_in_lists(t: np.ndarray, k: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a run of index rows sorted by (t, k): each linked row with the root of its tree.

    Rows at distance d = 1, 2, ... in the same list are compared all at once, so memory stays
    proportional to the rows. Links that close a circle are not returned; the components are the same.
    """
    n = len(fp)
    parent = np.arange(n)
    least = 8 - bits
    i = np.arange(n - 1)
    d = 1
    while len(i):
        i = i[i + d < n]
        i = i[(k[i] == k[i + d]) & (t[i] == t[i + d])]
        x = fp[i] ^ fp[i + d]
        shared = (x[:, None].view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = i[(shared >= least) & (np.bitwise_count(x) <= bits)]
        a, b = near, near + d
        while len(a):
            ra, rb = _roots(parent, a), _roots(parent, b)
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        d += 1
    root = _roots(parent, np.arange(n))
    linked = np.flatnonzero(root != np.arange(n))
    return fp[linked], fp[root[linked]]


def _linked(indexed: DataFrame, bits: int, partitions: int) -> DataFrame:
    """Links (a, b) within the lists of (t, k, fp); whole lists lie in one partition, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((3, 0), dtype=np.int64)

        def out(rows: np.ndarray) -> pa.RecordBatch:
            a, b = links_in_lists(rows[0], rows[1], rows[2].view(np.uint64), bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rest = np.concatenate([rest, rows], axis=1)
            # the last list of the batch may go on in the next one
            last = np.flatnonzero((rest[0] != rest[0, -1]) | (rest[1] != rest[1, -1])) if rest.shape[1] else []
            if len(last):
                cut = last[-1] + 1
                yield out(np.ascontiguousarray(rest[:, :cut]))
                rest = np.ascontiguousarray(rest[:, cut:])
        if rest.shape[1]:
            yield out(rest)

    dealt = indexed.select("t", "k", "fp").repartition(partitions, "t", "k").sortWithinPartitions("t", "k")
    return dealt.mapInArrow(run, "a long, b long")


def near_links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """Links (a, b) that join all fingerprints of (fp) differing in at most ``bits`` (up to 5) bits."""
    first, second = index_masks(bits)
    rows = distinct.count()
    masks = F.array(*[F.lit(m).cast("long") for m in first])
    keys = F.transform(masks, lambda m, i: F.struct(i.cast("long").alias("t"), F.col("fp").bitwiseAND(m).alias("k")))
    index = distinct.select("fp", F.explode(keys).alias("e")).select("e.t", "e.k", "fp")
    lengths = written(index.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lists")
    partitions = parts(len(first) * rows, distinct.sparkSession.sparkContext.defaultParallelism, ROWS_PER_PART)
    # a long list is replaced by several shorter ones
    finer = F.array(*[F.array(*[F.lit(m).cast("long") for m in more]) for more in second])
    own = F.element_at(finer, F.col("t").cast("int") + 1)
    again = F.transform(own, lambda m, i: F.struct((100 + 10 * F.col("t") + i).alias("t"), F.col("fp").bitwiseAND(m).alias("k")))
    lists = F.when(F.col("n") <= LIST, F.array(F.struct("t", "k"))).otherwise(again)
    dealt = index.join(lengths, ["t", "k"]).select("fp", F.explode(lists).alias("e")).select("e.t", "e.k", "fp")
    return _linked(dealt, bits, partitions)


def _rooted(docs: DataFrame, bits: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tag, fp, root, component_id) of every row; ``root`` is the component's least fingerprint."""
    prints = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    least = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    joined = components(near_links(least.select("fp"), bits))
    named = least.join(joined, least["fp"] == joined["node"], "left").select(
        least["fp"], "least", F.coalesce("component", least["fp"]).alias("root")
    )
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(written(named.select("fp", "root").join(roots, "root"), "fingerprint-components"), "fp")


def near_duplicates(
    docs: DataFrame, bits: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every document with its fingerprint and component: (doc_id, fingerprint, component_id).

    Fingerprints link at ``bits`` or fewer differing bits, equal ones always; ``component_id`` is the
    smallest id that links reach. Texts without words, and NULL texts, have the fingerprint zero and
    link like any other. Repeated rows give a row each; NULL ids never name a component, and a
    component of NULL ids only has a NULL name. Other input columns are left out.
    """
    return _rooted(docs, bits, shingle, id_col, text_col).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each_root(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` that stay, one for each root in ``found`` (doc_id, tag, root)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tag")).alias("x")
    kept = written(found.groupBy("root").agg(first).select(F.col("x.doc_id").alias("kept_id"), F.col("x.tag").alias("kept_tag")), "kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), tag_of(text_col).alias("tag"))
    stay = rows.join(kept, rows["id"].eqNullSafe(kept["kept_id"]) & (rows["tag"] == kept["kept_tag"]), "left_semi")
    return stay.dropDuplicates(["id", "tag"]).select("row.*")


def keep_one_of_each(docs: DataFrame, bits: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with all columns, of which one stays for each component of near-duplicates.

    It is the row with the smallest id (NULL is the largest), then with the smallest checksum of its
    text; of rows with equal id and text one stays.
    """
    return one_of_each_root(docs, _rooted(docs, bits, shingle, id_col, text_col), id_col, text_col)


def op9_simhash(spark, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
