"""Benchmark decontamination: BM25 over the test items, queried with every training passage.

The test items form inverted indexes of bounded size; documents stream past them. An item's BM25
weights are divided by their sum, so a passage's score is the share of the item that it covers and
one threshold suits items of any length. An item of two parts has up to three entries: the whole, and
its question and answer if they have five words or more, each with weights of its own. Entries are
grouped by length (16, 32, 64, ... words); for a group of up to L words passages are 2 L words long
and begin every L words, hence any stretch of L words lies whole within one. For each passage
block-max WAND skips entries, and blocks of entries, whose upper bound misses the threshold; what is
retrieved is verified by the word shingles of the question and answer. Passages without any shingle
that the verification would count are not searched, which changes no result. Documents are never
shuffled.
"""

from __future__ import annotations

import math
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

K1, B = 1.2, 0.75
#: Words of the items of one index, and the most blocks of items that posting lists have.
INDEX_WORDS = 100_000
BLOCKS = 64
SHINGLE = 5
#: Bits of the hashes that mark shingles of the items.
MARK_BITS = 20
#: Types of item ids.
ID_TYPES = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
PUNCTUATION = string.punctuation.encode()


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation, cut at ASCII spaces."""
    return (text or "").lower().encode().translate(None, PUNCTUATION).split()


def shingles(words: list[bytes], size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """Runs of ``size`` words; fewer words are one run."""
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(wanted: list[bytes], words: list[bytes]) -> float:
    """Share of the shingles of ``wanted`` that occur in ``words``."""
    want = shingles(wanted)
    if not want:
        return 0.0
    n = len(next(iter(want)))
    return len(want & {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}) / len(want)


def run_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash, of ``MARK_BITS`` bits, of each run of ``size`` terms."""
    values = np.zeros(len(ids) - size + 1, dtype=np.uint64)
    for i in range(size):
        values = (values ^ (ids[i : len(ids) - size + 1 + i].view(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        values ^= values >> np.uint64(29)
    return (values >> np.uint64(64 - MARK_BITS)).astype(np.int64)


@dataclass
class Marks:
    """Shingles that verify an entry: by size, for each hash the groups that hold such a shingle, a bit each."""

    by_size: dict[int, np.ndarray]

    def places(self, ids: np.ndarray) -> np.ndarray:
        """For each place of a text the groups of which a shingle may begin there."""
        out = np.zeros(len(ids), dtype=np.uint32)
        for size, marked in self.by_size.items():
            if size <= len(ids):
                out[: len(ids) - size + 1] |= marked[run_hashes(ids, size)]
        return out


@dataclass
class Index:
    """Entries of one length group: posting lists with share-of-entry weights, and the maxima of their blocks.

    ``items`` are the entries (id, question, answer, kind); one of a part has no words in the other.
    ``lists`` goes by the number of the term; ``rows`` tells the row of ``blocks`` (term x block of items)
    for each term, the first one, of zeros, for those that the group does not hold; ``most`` is the
    maximum of each term's row.
    """

    length: int
    items: list[tuple]
    lists: dict[int, tuple[np.ndarray, np.ndarray]]
    rows: np.ndarray
    blocks: np.ndarray
    block_items: int

    def __post_init__(self):
        self.most = self.blocks.max(axis=1)[self.rows]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Items whose score reaches the threshold, by block-max WAND over the lists of distinct terms."""
        cursors = [[self.lists[t], 0, self.most[t], self.blocks[self.rows[t]]] for t in terms if t in self.lists]
        found = []
        eps = 1e-9
        while True:
            cursors = [c for c in cursors if c[1] < len(c[0][0])]
            cursors.sort(key=lambda c: c[0][0][c[1]])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2]
                if bound >= threshold - eps:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = int(cursors[pivot][0][0][cursors[pivot][1]])
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][0][cursors[pivot + 1][1]] == item:
                pivot += 1
            # bound by the blocks in which the pivot item would lie
            block_bound = 0.0
            at = item // self.block_items
            reach = (at + 1) * self.block_items
            for c in cursors[: pivot + 1]:
                block_bound += c[3][at]
            if block_bound < threshold - eps:
                if pivot + 1 < len(cursors):
                    reach = min(reach, int(cursors[pivot + 1][0][0][cursors[pivot + 1][1]]))
                for c in cursors[: pivot + 1]:
                    c[1] = int(np.searchsorted(c[0][0], reach))
                continue
            if cursors[0][0][0][cursors[0][1]] == item:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    score += c[0][1][c[1]]
                    c[1] += 1
                if score >= threshold - eps:
                    found.append((item, float(score)))
            else:
                for c in cursors[:pivot]:
                    c[1] = int(np.searchsorted(c[0][0], item))


WHOLE, QUESTION, ANSWER = range(3)


def entries_of(item: tuple) -> list[tuple]:
    """An item (id, question, answer) as a whole, and each of its two parts that has a shingle of full length."""
    name, question, answer = item
    out = [(name, question, answer, WHOLE)] if question or answer else []
    if question and answer:
        if len(question) >= SHINGLE:
            out.append((name, question, [], QUESTION))
        if len(answer) >= SHINGLE:
            out.append((name, [], answer, ANSWER))
    return out


def build_indexes(items: list[tuple], df: dict[bytes, int], n: int, mean_words: float) -> tuple[dict[bytes, int], list[Index], Marks]:
    """Numbers of the terms, indexes by length group and their marks, of (id, question words, answer words).

    ``df`` counts the items with a word, out of ``n`` items of ``mean_words`` words.
    """
    term = {w: t for t, w in enumerate(sorted({w for _, q, a in items for w in q + a}))}
    groups = defaultdict(list)
    for item in sorted(items, key=lambda x: (x[0] is None, x[0])):
        for entry in entries_of(item):
            size = len(entry[1]) + len(entry[2])
            groups[max(16, 1 << (size - 1).bit_length())].append(entry)
    out: list[Index] = []
    marks: dict[int, np.ndarray] = {}
    for length, members in sorted(groups.items()):
        postings = defaultdict(list)
        for k, (_, question, answer, _) in enumerate(members):
            counts = Counter(question + answer)
            size = sum(counts.values())
            weights = {
                w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean_words))
                for w, tf in counts.items()
            }
            total = sum(weights.values())
            for w, x in weights.items():
                postings[term[w]].append((k, x / total))
        lists = {t: (np.array([k for k, _ in p]), np.array([x for _, x in p])) for t, p in postings.items()}
        block_items = math.ceil(len(members) / BLOCKS)
        rows = np.zeros(len(term), dtype=np.int32)
        blocks = np.zeros((len(lists) + 1, math.ceil(len(members) / block_items)))
        for row, (t, (ids, weights)) in enumerate(lists.items(), start=1):
            rows[t] = row
            np.maximum.at(blocks[row], ids // block_items, weights)
        for _, question, answer, _ in members:
            # an answer of fewer words verifies nothing
            for side in (question, answer if len(answer) >= SHINGLE else []):
                if side:
                    size = min(SHINGLE, len(side))
                    marked = marks.setdefault(size, np.zeros(1 << MARK_BITS, dtype=np.uint32))
                    marked[run_hashes(np.array([term[w] for w in side], dtype=np.int64), size)] |= np.uint32(1 << len(out))
        out.append(Index(length, members, lists, rows, blocks, block_items))
    return term, out, Marks(marks)


def passages(ids: np.ndarray, index: Index, threshold: float, begins: np.ndarray | None) -> Iterator[tuple[int, list[int]]]:
    """Start and distinct terms of the passages in which some block of items may reach the threshold.

    ``ids`` are the terms of a text's words, -1 for words in no item. First the lists' maxima are
    added up for all passages at once, then the blocks' maxima for those that are left. ``begins``
    tells where a shingle to be verified may begin; passages go that have none from ``length`` words
    before to as many after.
    """
    held = None if begins is None else np.concatenate([[0], np.cumsum(begins)])
    bound = np.zeros(len(ids) + 1)
    known = ids >= 0
    bound[1:][known] = index.most[ids[known]]
    bound = np.cumsum(bound)
    starts = np.arange(0, max(1, len(ids) - index.length), index.length)
    ends = np.minimum(starts + 2 * index.length, len(ids))
    likely = np.flatnonzero(bound[ends] - bound[starts] >= threshold - 1e-9)
    if held is not None:
        first, stop = np.maximum(0, starts[likely] - index.length), np.minimum(starts[likely] + 3 * index.length, len(ids))
        likely = likely[held[stop] > held[first]]
    for s, e in zip(starts[likely].tolist(), ends[likely].tolist()):
        terms = np.unique(ids[s:e])
        if terms[0] < 0:
            terms = terms[1:]
        if index.blocks[index.rows[terms]].sum(axis=0).max() >= threshold - 1e-9:
            yield s, terms.tolist()


def leaks_of(words: list[bytes], term: dict[bytes, int], indexes: list[Index], marks: Marks, threshold: float, verified: float) -> dict:
    """item id -> [score, question overlap, answer overlap, passages] of the verified items of one text.

    Score and passages are those of the whole if it was found, else of the question, else of the answer.
    """
    found: dict = {}
    get = term.get
    ids = np.array([get(w, -1) for w in words], dtype=np.int64)
    places = marks.places(ids) if verified > 0 else None
    some = (1 << len(indexes)) - 1 if places is None else int(np.bitwise_or.reduce(places, initial=0))
    for g, index in enumerate(indexes):
        if not some >> g & 1:
            continue
        begins = None if places is None else places >> np.uint32(g) & np.uint32(1)
        for start, terms in passages(ids, index, threshold, begins):
            for k, score in index.search(terms, threshold):
                item, question, answer, kind = index.items[k]
                near = words[max(0, start - index.length) : start + 3 * index.length]
                q, a = overlap(question, near), overlap(answer, near)
                if q >= verified or (len(answer) >= SHINGLE and a >= verified):
                    kinds = found.setdefault(item, {})
                    old = kinds.get(kind, [0.0, 0.0, 0.0, 0])
                    kinds[kind] = [max(old[0], score), max(old[1], q), max(old[2], a), old[3] + 1]
    out = {}
    for item, kinds in found.items():
        first = kinds[min(kinds)]
        out[item] = [first[0], max(x[1] for x in kinds.values()), max(x[2] for x in kinds.values()), first[3]]
    return out


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.6,
    verified: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    index_words: int = INDEX_WORDS,
) -> DataFrame:
    """Pairs (doc_id, item_id, score, question_overlap, answer_overlap, n_passages) of leaked test items.

    ``items`` has (item_id, question, answer). A pair is returned if a passage covers ``threshold`` of
    the item by BM25 weight and holds ``verified`` of the 5-word shingles of its question, or of its
    answer if that has five words at least; or if it covers ``threshold`` of one part of five words or
    more, and holds ``verified`` of that part's shingles. ``score`` is the share of the
    whole, or of the part if only that was found. Items without words, and NULL or empty texts, match
    nothing. Repeated documents give their own rows; a repeated item id is one item with its largest
    values. Other input columns are left out. Items are indexed ``index_words`` words at a time: each
    index goes to all tasks and has that bound, and documents are read once for each. An ``item_id`` is a
    whole number or a string; the documents' id may be of any type.
    """
    spark = docs.sparkSession
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (items, "item_id")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [pa.array([tokens(x.as_py()) for x in batch.column(c)], pa.list_(pa.binary())) for c in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *parts], names=["item_id", "question", "answer"])

    split = items.select("item_id", "question", "answer").mapInArrow(cut, f"item_id {item_kind}, question array<binary>, answer array<binary>")
    split = written(split, "items")
    n_words = F.size("question") + F.size("answer")
    n, total = split.where(n_words > 0).agg(F.count("*"), F.sum(n_words)).first()
    blocks = max(1, math.ceil((total or 0) / index_words))
    words = F.explode(F.array_distinct(F.concat("question", "answer"))).alias("word")
    df = written(split.select(words).groupBy("word").agg(F.count("*").alias("df")), "item-words")
    placed = split.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    schema = f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double, n_passages long"
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(b: int) -> DataFrame:
        mine = placed.where(F.col("block") == b)
        own = [(r["item_id"], [bytes(w) for w in r["question"]], [bytes(w) for w in r["answer"]]) for r in mine.collect()]
        known = {bytes(r["word"]): r["df"] for r in df.join(mine.select(words).distinct(), "word", "left_semi").collect()}
        shared = spark.sparkContext.broadcast(build_indexes(own, known, n, (total or 0) / max(1, n)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns: list[list] = [[] for _ in range(6)]
                for i in range(batch.num_rows):
                    text = batch.column(1)[i].as_py()
                    for item, values in leaks_of(tokens(text), *shared.value, threshold, verified).items():
                        for column, value in zip(columns, [i, item, *values]):
                            column.append(value)
                ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
                arrays = [pa.array(c, t) for c, t in zip(columns[2:], [pa.float64()] * 3 + [pa.int64()])]
                names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "n_passages"]
                yield pa.RecordBatch.from_arrays([ids, pa.array(columns[1], item_type), *arrays], names=names)

        return narrow.mapInArrow(run, schema)

    if item_kind not in ID_TYPES:
        raise ValueError(f"item_id must be a whole number or a string, not {item_kind}")
    item_type = ID_TYPES[item_kind]
    result = scan(0)
    for b in range(1, blocks):
        result = result.unionByName(scan(b))
    return result


def question_and_answer(text: Column) -> tuple[Column, Column]:
    """A test item's last sentence as its answer and what stands before as its question; one sentence is a question."""
    pattern = r"(?s)^(.*[.!?])\s+(\S.*)$"
    question = F.regexp_extract(text, pattern, 1)
    return F.when(question != "", question).otherwise(text), F.regexp_extract(text, pattern, 2)


def benchmark_items(spark, folder: str) -> DataFrame:
    question, answer = question_and_answer(F.col("text"))
    return spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", question.alias("question"), answer.alias("answer"))


def op5_decontamination(spark, folder: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{folder}/documents.parquet"), benchmark_items(spark, folder))
