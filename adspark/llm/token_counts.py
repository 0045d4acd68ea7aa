"""Token counts by a unigram model, with one dynamic programme per shared prefix.

A pre-token's best segmentation is found from left to right: the score of a prefix follows from
those of shorter prefixes. Pre-tokens with a common beginning share these scores, so the distinct
pre-tokens of a task go into a trie whose nodes hold the forward score and the number of tokens of
their prefix; only new nodes are computed. The node at which a pre-token ends holds its count.
There is no shuffle: a task's trie is built from the documents it reads and started anew when it
has ``NODES`` nodes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

NODES = 400_000
#: Pre-tokens longer than this are segmented outside the trie, by the same rule.
LONGEST_IN_TRIE = 64

#: Fixed values of the vocabulary's library: mark of a word's beginning, and how far an unknown
#: character's score lies under the least score of a piece.
WORD_START = "▁"
UNKNOWN_PENALTY = 10.0


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, float], int, float]:
    """Pieces with log probabilities, length of the longest, and the score of a fallback byte.

    The file has merges by rank, not frequencies; a piece of rank r gets the probability that Zipf's
    law gives it, proportional to 1 / (1 + r).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    pieces = [model.id_to_piece(i) for i in ids]
    total = math.log(sum(1 / (1 + r) for r in range(len(pieces))))
    scores = {p: -math.log(1 + r) - total for r, p in enumerate(pieces)}
    return scores, max(map(len, scores)), min(scores.values()) - UNKNOWN_PENALTY


class Trie:
    """Forward scores and token counts of prefixes.

    Nodes are numbers; an edge is a dictionary entry from (node, letter), packed in one number, to a
    node. So the trie is three flat containers, whatever its size.
    """

    def __init__(self, scores: dict[str, float], longest: int, byte_score: float, nodes: int = NODES):
        self.scores, self.byte_score, self.most = scores, byte_score, nodes
        # lengths that pieces with the same last two letters have; single letters are always tried
        lengths: dict[str, set[int]] = {}
        for piece in scores:
            if len(piece) > 1:
                lengths.setdefault(piece[-2:], {1}).add(len(piece))
        self.lengths = {tail: tuple(sorted(found)) for tail, found in lengths.items()}
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]

    @property
    def size(self) -> int:
        return len(self.best)

    def step(self, word: str, end: int, path: list[int], best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Best score, and fewest tokens among equals, of ``word[:end]`` from those of shorter prefixes."""
        least = len(word[end - 1].encode())
        score = best[path[end - 1]] + self.byte_score * least
        count = tokens[path[end - 1]] + least
        get = self.scores.get
        for length in self.lengths.get(word[end - 2 : end], (1,)) if end > 1 else (1,):
            if length > end:
                break
            piece = get(word[end - length : end])
            if piece is not None:
                before = path[end - length]
                value = best[before] + piece
                if value > score or value == score and tokens[before] + 1 < count:
                    score, count = value, tokens[before] + 1
        return score, count

    def count(self, word: str) -> int:
        """Tokens of a pre-token; new nodes are added on the way."""
        if len(word) > LONGEST_IN_TRIE:
            best, tokens, path = [0.0], [0], [0]
            for end in range(1, len(word) + 1):
                score, count = self.step(word, end, path, best, tokens)
                best.append(score)
                tokens.append(count)
                path.append(end)
            return tokens[-1]
        if self.size > self.most:
            self.clear()
        edges, best, tokens = self.edges, self.best, self.tokens
        node, path = 0, [0]
        for end, letter in enumerate(word, 1):
            edge = node << 21 | ord(letter)
            node = edges.get(edge)
            if node is None:
                score, count = self.step(word, end, path, best, tokens)
                node = edges[edge] = len(best)
                best.append(score)
                tokens.append(count)
            path.append(node)
        return tokens[node]


class Counts:
    """A trie and the terminal counts of the words of late, and of the time before."""

    def __init__(self, path: str):
        self.trie = Trie(*vocabulary(path))
        self.known: dict[bytes, int] = {}
        self.past: dict[bytes, int] = {}

    def of(self, words: Counter) -> int:
        """Tokens of all words together."""
        if len(self.known) > NODES:
            self.known, self.past = {}, self.known
        known, total = self.known, 0
        for word, times in words.items():
            n = known.get(word)
            if n is None:
                n = self.past.get(word)
                if n is None:
                    n = self.trie.count(WORD_START + word.decode())
                known[word] = n
            total += n * times
        return total


@lru_cache(maxsize=1)
def counts_of(path: str) -> Counts:
    """The counts of a Python worker, kept from task to task."""
    return Counts(path)


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_distinct, n_tokens) of every whole text.

    Pre-tokens are the words between ASCII spaces, each with the mark of a word's beginning. ``model``
    is the path of a sentencepiece file on every executor. Characters outside the vocabulary count
    one token per UTF-8 byte. NULL and empty texts have zeros; repeated rows give a row each; other
    input columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts_of(model)
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            for text in batch.column(1):
                words = Counter((text.as_py() or "").encode().split())
                for column, value in zip(counts, (words.total(), len(words), known.of(words))):
                    column.append(value)
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pretokens", "n_distinct", "n_tokens"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_distinct long, n_tokens long")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_token_counts(spark, folder: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{folder}/documents.parquet"), default_model())
