"""Exact removal of repeated passages: suffixes sorted only through their first ``window`` bytes.

Two suffixes that agree in their first 100 bytes are a repeated window; a depth-limited radix sort,
most significant digit first, brings just these together, and a suffix that is alone in its bucket
leaves after the pass. Three passes go to depth 100:

1. The first digit is a gram of 32 bytes. Not every suffix needs to be sorted by it: of the grams in
   a window one is the least in a pseudo-random order (the leftmost of equals), and equal windows
   choose the same one at the same place. Windows that lie next to each other mostly choose the same
   gram, so one row stands for a run of suffixes, about one for every 35 bytes.
2. The second digit is the whole text that a row's windows cover. Rows equal in it repeat each other
   window by window; all but the earliest are marked.
3. Rows that share the gram but not the text, as at the edges of a shared passage, are few. Their
   windows are sorted one by one, by all their bytes.

Digits are compared by hashes (64 bits for each of the first two, 128 bits for a whole window).
Windows are judged on the input; what the marked ones cover is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import parts, written

GRAM = 32
#: Starts of windows handled at once, to bound the memory for a very long text.
STRETCH = 1 << 21
#: Single windows that are sorted in a task before they are shuffled.
WINDOWS = 1 << 20
ROWS_PER_PART = 400_000
#: A run in one number: 24 bits of the text's checksum, 31 of its first start, 8 of its length.
_LEN_BITS, _LO_BITS = 8, 31


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of 32 bytes, by doubling the run five times."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        step = 1
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
            h = h[:-step] * np.uint64(factor) + h[step:]
            h ^= h >> np.uint64(31)
            step *= 2
        h *= np.uint64(0x8EBC6AF09C88C6E3)
        h ^= h >> np.uint64(32)
    return h


def runs_of(data: bytes, window: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that choose the same gram: first start, last start, hash of the gram."""
    n = len(data)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    raw = np.frombuffer(data, dtype=np.uint8)
    for a in range(0, max(0, n - window + 1), STRETCH):
        starts = min(STRETCH, n - window + 1 - a)
        h = _gram_hashes(raw[a : a + starts + window - 1])
        low = np.uint64(0xFFFFFFFF)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width, have = window - GRAM + 1, 1
        while have * 2 <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: starts], least[width - have : width - have + starts])
        place = least & low
        lo = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        hi = np.concatenate([lo[1:] - 1, [starts - 1]])
        found.append((lo + a, hi + a, h[place[lo].astype(np.int64)]))
    if not found:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, np.empty(0, dtype=np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _pack(tag: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (np.int64(tag) << (_LEN_BITS + _LO_BITS)) | (lo.astype(np.int64) << _LEN_BITS) | (hi - lo)


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of packed runs."""
    lo = (packed >> _LEN_BITS) & ((1 << _LO_BITS) - 1)
    return lo, lo + (packed & ((1 << _LEN_BITS) - 1))


#: Rows between the passes: two digits, the document and its packed run; ``done`` rows are known repeats.
_ROWS = pa.schema([("done", pa.bool_()), ("k1", pa.int64()), ("k2", pa.int64()), ("doc", pa.int64()), ("run", pa.int64())])
_ROWS_DDL = "done boolean, k1 long, k2 long, doc long, run long"
#: Marks: runs of repeated windows, and runs whose windows are still to be sorted one by one.
_MARKS = pa.schema([("doc", pa.int64()), ("run", pa.int64()), ("open", pa.bool_())])
_MARKS_DDL = "doc long, run long, open boolean"
_TAG = _LEN_BITS + _LO_BITS


def _later(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, run: np.ndarray, before: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: which differ from the row before, and which come later than their bucket's first.

    A row that comes twice (same document, tag and start) is one row. ``before`` is the row before the
    first one, with whether it came later than its bucket's first.
    """
    n = len(k1)
    bucket, other = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    bucket[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    other[1:] = bucket[1:] | (doc[1:] != doc[:-1]) | (run[1:] != run[:-1])
    if before and n:
        bucket[0] = before[:2] != (k1[0], k2[0])
        other[0] = before[:4] != (k1[0], k2[0], doc[0], run[0])
    # a row's standing is that of the last row that differs from the one before
    at = np.maximum.accumulate(np.where(other, np.arange(n), -1))
    later = ~bucket[np.maximum(at, 0)]
    later[at < 0] = before[4] if before else False
    return other, later


def _rows_of(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """Pass 1 and 2 digits of the runs in a batch of (doc, tag, text).

    Of rows equal in both digits all but the first of the batch are repeats whatever comes from
    elsewhere; they are done, so a passage that very many documents share leaves a batch once.
    """
    columns: list[list[np.ndarray]] = [[], [], [], []]
    digest = xxhash.xxh3_64_intdigest
    for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
        data = (text.as_py() or "").encode()
        lo, hi, grams = runs_of(data, window)
        if len(lo):
            covers = [digest(data[a : b + window]) for a, b in zip(lo.tolist(), hi.tolist())]
            values = [grams, np.array(covers, dtype=np.uint64), np.full(len(lo), doc), _pack(tag, lo, hi)]
            for column, value in zip(columns, values):
                column.append(value.view(np.int64))
    k1, k2, doc, run = (np.concatenate(c) if c else np.empty(0, dtype=np.int64) for c in columns)
    return _with_done(k1, k2, doc, run)


def _with_done(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
    """Rows in the order of their digits, of which repeats come after the others and without digits."""
    order = np.lexsort((run, doc, k2, k1))
    k1, k2, doc, run = k1[order], k2[order], doc[order], run[order]
    done = _later(k1, k2, doc, run)[1]
    doc_done, run_done = _joined(doc[done], run[done])
    none, rest = np.zeros(len(doc_done), dtype=np.int64), ~done
    values = [
        np.repeat([False, True], [rest.sum(), len(none)]),
        np.concatenate([k1[rest], none]),
        np.concatenate([k2[rest], none]),
        np.concatenate([doc[rest], doc_done]),
        np.concatenate([run[rest], run_done]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in values], schema=_ROWS)


def _joined(doc: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that follow each other in a document as one run, as far as its length fits."""
    if not len(doc):
        return doc, run
    order = np.lexsort((run, doc))
    doc, run = doc[order], run[order]
    lo, hi = unpack(run)
    tag = run >> _TAG
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (lo[1:] != hi[:-1] + 1)
    # a chain is cut wherever another length limit is reached
    first = lo[np.maximum.accumulate(np.where(fresh, np.arange(len(doc)), 0))]
    piece = (hi - first) >> (_LEN_BITS - 1)
    fresh[1:] |= piece[1:] != piece[:-1]
    starts = np.flatnonzero(fresh)
    last = np.append(starts[1:], len(doc)) - 1
    return doc[starts], (run[starts] >> _LEN_BITS << _LEN_BITS) | (hi[last] - lo[starts])


def _windows_of(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Pass 3 digits, all bytes of each window, of the open runs in batches of (doc, tag, text, runs)."""
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0
    for batch in batches:
        for i in range(batch.num_rows):
            doc, tag, text, runs = (batch.column(c)[i].as_py() for c in range(4))
            data = text.encode()
            lo, hi = unpack(np.array(runs, dtype=np.int64))
            starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)])
            for at in range(0, len(starts), WINDOWS):
                part = starts[at : at + WINDOWS]
                raw = b"".join([xxhash.xxh3_128_digest(data[s : s + window]) for s in part.tolist()])
                keys = np.frombuffer(raw, dtype=np.int64).reshape(-1, 2)
                parts.append((keys[:, 0], keys[:, 1], np.full(len(part), doc), _pack(tag, part, part)))
                held += len(part)
                if held >= WINDOWS:
                    yield _with_done(*map(np.concatenate, zip(*parts)))
                    parts, held = [], 0
    if parts:
        yield _with_done(*map(np.concatenate, zip(*parts)))


def _mark(rows: DataFrame, partitions: int, open_groups: bool) -> DataFrame:
    """Marks of rows sorted by both digits, document and start.

    Equal digits: all but the first row repeat it. With ``open_groups``, first rows that share the
    first digit with another first row are open. Rows are streamed, so a bucket may have any size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ()  # the last row, and whether it repeats its bucket's first
        held: tuple = ()  # the last first row: (k1, doc, run, open), not yet given out

        for batch in batches:
            done, k1, k2, doc, runs = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(k1):
                continue
            # known repeats come after all other rows
            n = int((~done).sum())
            other, later = _later(k1[:n], k2[:n], doc[:n], runs[:n], last)
            fresh = np.flatnonzero(other & ~later)
            marked = np.concatenate([np.flatnonzero(other & later), np.arange(n, len(k1))])
            if n:
                last = (k1[n - 1], k2[n - 1], doc[n - 1], runs[n - 1], bool(later[n - 1]))
            out_doc, out_run = [doc[marked]], [runs[marked]]
            out_open = [np.zeros(len(marked), dtype=bool)]
            if open_groups and len(fresh):
                f = k1[fresh]
                equal = f[1:] == f[:-1]
                is_open = np.zeros(len(f), dtype=bool)
                is_open[1:] |= equal
                is_open[:-1] |= equal
                if held:
                    if held[0] == f[0]:
                        is_open[0] = True
                        held = (*held[:3], True)
                    if held[3]:
                        out_doc.append(np.array([held[1]]))
                        out_run.append(np.array([held[2]]))
                        out_open.append(np.array([True]))
                held = (f[-1], doc[fresh[-1]], runs[fresh[-1]], bool(is_open[-1]))
                given = fresh[:-1][is_open[:-1]]
                out_doc.append(doc[given])
                out_run.append(runs[given])
                out_open.append(np.ones(len(given), dtype=bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_doc, out_run, out_open)], schema=_MARKS)
        if held and held[3]:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held[1:3]] + [pa.array([True])], schema=_MARKS)

    # known repeats need no bucket: they are dealt by their document
    place = F.when(F.col("done"), F.xxhash64("doc", "run")).otherwise(F.col("k1") if open_groups else F.xxhash64("k1", "k2"))
    dealt = rows.repartition(partitions, place).sortWithinPartitions("done", "k1", "k2", "doc", "run")
    return dealt.mapInArrow(run, _MARKS_DDL)


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    # a NULL id sorts before all others; a tag tells rows with the same id apart
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit(0xFFFFFF)).alias("tag"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.struct(F.col(id_col).alias("doc_id"), *carry).alias("row"),
    )


def _by_document(marks: DataFrame) -> DataFrame:
    tag = F.shiftright("run", _TAG)
    return marks.groupBy("doc", tag.alias("tag")).agg(F.collect_list("run").alias("runs"))


def repeated_runs(keyed: DataFrame, window: int) -> DataFrame:
    """(doc, run, open = false): runs of windows that also start earlier, from (doc, tag, text)."""
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = keyed.sparkSession.sparkContext.defaultParallelism
    partitions = parts(size // 32, cores, ROWS_PER_PART)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows_of(batch, window)

    def emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _windows_of(batches, window)

    text = keyed.select("doc", "tag", "text")
    marks = written(_mark(text.mapInArrow(emit, _ROWS_DDL), partitions, open_groups=True), "run-marks")
    still = _by_document(marks.where("open"))
    # the texts with open runs are written, so that their shuffle is over before that of the windows
    texts = written(text.join(still, ["doc", "tag"]).select("doc", "tag", "text", "runs"), "open-texts")
    single = written(_mark(texts.mapInArrow(emit_windows, _ROWS_DDL), partitions, open_groups=False), "window-marks")
    return marks.where("NOT open").unionByName(single)


def _spans(runs: list[int] | None, n: int, window: int) -> np.ndarray:
    """Maximal covered stretches (start, end) of runs of repeated windows."""
    if not runs:
        return np.empty((0, 2), dtype=np.int64)
    lo, hi = unpack(np.array(runs, dtype=np.int64))
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + window)
    new = np.concatenate([[True], lo[1:] > end[:-1]])
    return np.stack([lo[new], np.concatenate([end[:-1][new[1:]], end[-1:]])], axis=1)


def whole_characters(data: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans drawn in to the characters that they cover whole."""
    raw = np.frombuffer(data, dtype=np.uint8)
    starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(data))
    a = starts[np.searchsorted(starts, spans[:, 0])]
    b = starts[np.searchsorted(starts, spans[:, 1], side="right") - 1]
    return np.stack([a, b], axis=1)[a < b]


def remove_repeats(
    docs: DataFrame,
    window: int = 100,
    characters: bool = False,
    carry: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents without repeated passages: (doc_id, spans, kept[, carried columns]).

    A byte goes if it is covered by a string of ``window`` (64 to 250) bytes that also starts earlier:
    in a document with a smaller id, or earlier in the same one. ``spans`` are the maximal removed
    stretches of the UTF-8 text as [start, end), ``kept`` the bytes that stay; with ``characters``
    spans are drawn in to whole characters, so that ``kept`` is a text again. NULL texts are empty;
    texts shorter than a window lose nothing. A NULL id comes before all others; rows with the same
    id and text are one document, each with the same result, and rows with the same id but another
    text follow each other in a fixed order. ``carry`` names further columns to hand through; the
    others are left out.
    """
    if not 2 * GRAM <= window <= 250:
        raise ValueError("the window must have 64 to 250 bytes")
    carry = carry or []
    keyed = _keyed(docs, id_col, text_col, carry)
    runs = _by_document(repeated_runs(keyed, window).select("doc", "run"))
    joined = keyed.join(runs, ["doc", "tag"], "left").select("row", "text", "runs")
    row_type = joined.schema["row"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_spans, kept = [], []
            for text, own in zip(batch.column(1), batch.column(2)):
                data = text.as_py().encode()
                spans = _spans(own.as_py(), len(data), window)
                if characters and len(spans):
                    spans = whole_characters(data, spans)
                edges = [0, *spans.ravel().tolist(), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                all_spans.append(spans.tolist())
            arrays = [batch.column(0), pa.array(all_spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "spans", "kept"])

    result = joined.mapInArrow(cut, f"row {row_type}, spans array<array<long>>, kept binary")
    return result.select("row.*", "spans", "kept")


def op10_repeated_passages(spark, folder: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{folder}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return found.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
