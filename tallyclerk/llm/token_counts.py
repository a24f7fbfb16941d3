"""Token counts under a unigram model, by dynamic programming shared along a trie.

A pre-token is a word with a leading word mark. Its best segmentation into vocabulary pieces is a
forward pass over its prefixes, and the pass over a prefix is the same for every pre-token that
begins with it. So distinct pre-tokens are put into a trie whose nodes keep the forward score and
the token count of their prefix, computed once when the node is made; the terminal node holds the
pre-token's count. Characters that no piece covers fall back to one token per UTF-8 byte.

Tries live in tasks and are begun anew when they reach `MAX_NODES`, so memory is bounded; words shared
by many documents cost one look-up, there is no shuffle, and no word gathers anywhere.

The vocabulary file holds pieces in order of their merges, not probabilities; a piece of rank r is
given the probability of rank r under Zipf's law.

Odd input: null, empty and word-less texts have 0 words and 0 tokens; repeated rows are counted
each; an empty table gives an empty result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

MARK, SPACES, MAX_NODES = "▁", " \t\n\x0b\x0c\r", 600_000
#: Added to ranks, so that the first pieces don't outweigh all others.
RANK_SHIFT = 10
FALLBACK = -20.0


def vocabulary(model_file: str) -> dict[str, float]:
    """Pieces of a sentencepiece file with their scores."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = sum(1 / (r + RANK_SHIFT) for r in range(len(pieces)))
    return {p: -math.log((r + RANK_SHIFT) * total) for r, p in enumerate(pieces)}


class Trie:
    """Prefixes of pre-tokens with the score and length of their best segmentation."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        self.reset()

    def reset(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0.0], [0]
        self.terminal: dict[bytes, int] = {}

    def add(self, word: bytes) -> int:
        """Tokens of the UTF-8 word; only prefixes not met before are computed."""
        text, path, child, pieces = MARK + word.decode("utf-8", "replace"), [0], self.child, self.pieces
        for i, c in enumerate(text):
            at = child.get((path[-1], c))
            if at is None:
                n_bytes = len(c.encode("utf-8", "replace"))
                best, tokens = self.score[path[-1]] + FALLBACK * n_bytes, self.tokens[path[-1]] + n_bytes
                for j in range(max(0, i + 1 - self.longest), i + 1):
                    piece = pieces.get(text[j : i + 1])
                    if piece is not None and (s := self.score[path[j]] + piece) > best:
                        best, tokens = s, self.tokens[path[j]] + 1
                at = child[path[-1], c] = len(self.score)
                self.score.append(best)
                self.tokens.append(tokens)
            path.append(at)
        self.terminal[word] = self.tokens[path[-1]]
        return self.tokens[path[-1]]


def count_tokens(documents: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(vocabulary(model_file))
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1).to_pylist():
                parts = (text or b"").split()  # bytes: ASCII white space only
                if len(trie.score) > MAX_NODES:
                    trie.reset()
                for new in set(parts):
                    if new not in trie.terminal:
                        trie.add(new)
                words.append(len(parts))
                tokens.append(sum(map(trie.terminal.__getitem__, parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return by_bytes(texts).mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")
