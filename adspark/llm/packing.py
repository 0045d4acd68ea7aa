"""Vector best-fit packing of tokenised documents into training sequences.

Documents become token ids, an end id is appended, and only documents longer than a sequence are
cut. Pieces are dealt by hash to groups of about ``GROUP_TOKENS`` tokens, each packed by one task:
large enough that the unfilled rest of a group's last sequences is small against it, and of a size
that does not grow with the corpus. Within a group, pieces go largest first to the open sequence
that fits best, judged by the residual capacities of tokens, documents and attention cost.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import parts, written

GROUP_TOKENS = 16 << 20
#: Words whose ids a task keeps at once are up to twice as many.
KNOWN_WORDS = 400_000


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most: tokens, pieces of documents, and sum of squared piece lengths."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"


#: Characters that byte-level vocabularies print for the 256 bytes: printable ones as they are, the
#: others from 256 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
_REST = [b for b in range(256) if b not in _PRINTED]
BYTE_LETTER = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(_REST)}


class WordIds:
    """Token ids of texts, word by word, as little-endian unsigned 32-bit bytes.

    The tokenizer's pre-tokens never cross a space, so a text's ids are those of its words in turn. It
    lower-cases what is not a special token (these begin with ``<|``), so words are kept without
    capitals from A to Z. A word of Latin letters with punctuation after it has two pre-tokens, the
    letters and the punctuation; its letters go straight to the tokenizer's model.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.model = self.tokenizer.model
        # words of late, and those of the time before
        self.known: dict[bytes, bytes] = {}
        self.past: dict[bytes, bytes] = {}

    def _letters(self, word: str) -> bytes:
        printed = word if word.isascii() else "".join([BYTE_LETTER[b] for b in word.encode()])
        return np.array([t.id for t in self.model.tokenize(printed)], dtype="<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        known, slow, ends = self.known, [], []
        for word in words:
            text = word.decode()
            core = text.rstrip(string.punctuation)
            if core.isalpha() and core == core.lower() and max(core) < "\u0250":
                if len(core) == len(text):
                    known[word] = self._letters(core)
                else:
                    ends.append((word, core, text[len(core) :].encode()))
            else:
                slow.append(word)
        slow += {end for _, _, end in ends if end not in known}
        if slow:
            found = self.encode([w.decode() for w in slow], add_special_tokens=False)
            known.update(zip(slow, (np.array(e.ids, dtype="<u4").tobytes() for e in found)))
        for word, core, end in ends:
            letters = known.get(data := core.encode()) or self.past.get(data)
            if letters is None:
                letters = known[data] = self._letters(core)
            known[word] = letters + known[end]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known, self.past = {}, self.known
        wanted = set().union(*split).difference(self.known)
        self.known.update((w, self.past[w]) for w in wanted if w in self.past)
        self._learn(list(wanted.difference(self.past)))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The tokenizer of a Python worker, which keeps its words from task to task."""
    return WordIds(path)


def token_pieces(
    docs: DataFrame, tokenizer: str, limit: int = 4096, end_id: int = 1, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of at most ``limit`` tokens: (doc_id, piece, start, length, ids_crc32[, ids]).

    ``tokenizer`` is the path of a ``tokenizers`` file on every executor. A document is its ids
    followed by ``end_id``; NULL and empty texts are the end id alone. ``ids`` are the piece's ids as
    little-endian unsigned 32-bit bytes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    fields = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        for batch in batches:
            at, n = 0, batch.num_rows
            while at < n:
                rows, size = [], 0
                while at < n and (size < 1 << 18 or not rows):
                    rows.append((batch.column(1)[at].as_py() or "").encode())
                    size += len(rows[-1])
                    at += 1
                ids = batch.column(0).slice(at - len(rows), len(rows))
                out: list[list] = [[] for _ in range(5 + keep_ids)]
                for i, whole in enumerate(encoder.ids(rows)):
                    whole += end
                    for p in range(0, len(whole), 4 * limit):
                        data = whole[p : p + 4 * limit]
                        values = [i, p // (4 * limit), p // 4, len(data) // 4, zlib.crc32(data), data]
                        for column, value in zip(out, values):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns = [pa.array(c, type=t) for c, t in zip(out, kinds)]
                columns[0] = ids.take(columns[0])
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, for lengths in descending order.

    Of the open sequences with room under all three constraints the piece goes to the one with the
    smallest weighted norm of what is left after it (rule ``norm``), or the largest weighted dot
    product of the piece and what is left before it (rule ``dot``); the earliest of equals.
    """
    n = len(lengths)
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=np.float64)
    weights = np.array(capacity.weights)
    left = np.empty((max(n, 1), 3))
    open_ = np.empty(max(n, 1), dtype=np.int64)
    sequence, offset = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    used, live = 0, 0
    smallest = np.array([lengths[-1], 1, lengths[-1] ** 2], dtype=np.float64) if n else full
    for k in range(n):
        need = np.array([lengths[k], 1, float(lengths[k]) ** 2])
        if np.any(need > full):
            raise ValueError("a piece is larger than a sequence may be")
        room = left[open_[:live]]
        fits = np.flatnonzero((room >= need).all(axis=1))
        if len(fits):
            rest = room[fits]
            if capacity.rule == "norm":
                choice = fits[np.argmin(((weights * (rest - need) / full) ** 2).sum(axis=1))]
            else:
                choice = fits[np.argmax((weights * (rest / full) * (need / full)).sum(axis=1))]
            s = open_[choice]
        else:
            s, choice = used, live
            left[s] = full
            open_[live] = s
            used, live = used + 1, live + 1
        sequence[k], offset[k] = s, capacity.tokens - left[s, 0]
        left[s] -= need
        if np.any(left[s] < smallest):
            # nothing fits any more: the sequence is closed
            open_[choice : live - 1] = open_[choice + 1 : live].copy()
            live -= 1
    return sequence, offset


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table with (doc_id, piece, length, ...).

    All columns stay. Sequences are numbered within their group; ids of different groups differ. The
    result is the same for the same pieces: equal lengths are ordered by id and piece. An empty table
    gives an empty result.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = parts(total, 1, group_tokens)
    grouped = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema.fields)}, sequence_id long, offset long"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = best_fit(table["length"].to_numpy(), capacity)
        base = table["group"][0].as_py() << 32
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))

    return grouped.groupBy("group").applyInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_best_fit_packing(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return pack(written(token_pieces(docs, default_tokenizer()), "pieces"))
