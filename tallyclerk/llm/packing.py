"""Packing tokenized documents into sequences by best-fit decreasing.

Documents are tokenized and end with one separator id. Overlong ones are first cut into full
windows. The remainders go, longest first, each into the open window that it fills tightest; a segment
tree over remaining capacities finds that window. Windows that stay poorly filled are cut open and
poured into one another, so padding stays small; each id still lies in exactly one piece.

Packing works within groups of about `group_tokens` ids of one input partition, so memory is
bounded whatever the partition holds, no shuffle is needed, and sequence ids are unique: partition
number, then a running number. Reading a partition again, after an executor is lost, gives the same.

Odd input: a null or empty text is the separator alone; repeated rows are documents of their own; an
empty table gives an empty result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

CAPACITY, SEPARATOR, GROUP_TOKENS = 1024, 0, 3_000_000
SPECIAL = "<|endoftext|>"
COLUMNS = "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()
# Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of white space this long could overflow the stack of the faster library.
LONG_SPACE = re.compile(r"(?<!\s)\s{100000}")
#: Windows filled less than this share are poured into one another.
FILLED = 0.995


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to the byte-level BPE file's own.

    The file's merges are run by a second library that is several times faster and takes them as
    ranks; texts with the special token or a very long run of white space go through the file's own library.
    """

    def __init__(self, file: str) -> None:
        from tiktoken import Encoding

        with open(file, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # The file writes bytes that are no visible Latin-1 character as characters from 256 on.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        written = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        ranks = {bytes(map(written.__getitem__, token)): i for token, i in vocabulary.items() if token != SPECIAL}
        self.fast = Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.file = file

    @cached_property
    def whole(self):
        """The file's own library, loaded by the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def encode(self, text: str) -> bytes:
        whole = SPECIAL in text or len(text) >= 100_000 and LONG_SPACE.search(text)
        ids = self.whole.encode(text, add_special_tokens=False).ids if whole else self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


class Windows:
    """Open windows by remaining capacity; a segment tree over capacities finds the tightest."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _mark(self, at: int) -> None:
        i, self.tree[self.size + at] = (self.size + at) >> 1, bool(self.open[at])
        i = self.size + at
        while i > 1:
            i >>= 1
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def put(self, window: int, left: int) -> None:
        self.open[left].append(window)
        if len(self.open[left]) == 1:
            self._mark(left)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least remaining capacity that is at least `need`."""
        i = self.size + need
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        left = i - self.size
        window = self.open[left].pop()
        if not self.open[left]:
            self._mark(left)
        return window, left


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows as lists of item numbers; every length is between 1 and the capacity."""
    windows, free = [], Windows(capacity)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.take(lengths[i])
        if found is None:
            found = len(windows), capacity
            windows.append([])
        windows[found[0]].append(i)
        if left := found[1] - lengths[i]:
            free.put(found[0], left)
    return windows


def pack_group(documents: list[tuple], capacity: int = CAPACITY) -> list[list[tuple]]:
    """Sequences of pieces (doc_id, start, ids as bytes, tokens of the document)."""
    full, rest = [], []
    for doc_id, ids in documents:
        n = len(ids) // 4
        for at in range(0, n - n % capacity, capacity):
            full.append([(doc_id, at, ids[4 * at : 4 * (at + capacity)], n)])
        if n % capacity:
            rest.append((doc_id, n - n % capacity, ids[4 * (n - n % capacity) :], n))
    size = lambda p: len(p[2]) // 4
    windows = [[rest[i] for i in w] for w in best_fit_decreasing([size(p) for p in rest], capacity)]
    filled = lambda w: sum(map(size, w)) >= FILLED * capacity
    loose = [w for w in windows if not filled(w)]
    full += [w for w in windows if filled(w)]
    now, room = [], capacity
    for piece in (p for w in loose for p in w):
        while piece is not None:
            doc_id, start, ids, n = piece
            fit = min(room, size(piece))
            now.append((doc_id, start, ids[: 4 * fit], n))
            piece = (doc_id, start + fit, ids[4 * fit :], n) if fit < size(piece) else None
            room -= fit
            if not room:
                full.append(now)
                now, room = [], capacity
    return full + [now] if now else full


def pack(documents: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, separator: int = SEPARATOR, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids."""
    end = np.array([separator], "<u4").tobytes()

    def rows(sequences: list[list[tuple]], first: int) -> pa.RecordBatch:
        out = []
        for k, sequence in enumerate(sequences):
            offset = 0
            for doc_id, start, ids, n in sequence:
                out.append((doc_id, start, len(ids) // 4, crc32(ids), n, first + k, offset))
                offset += len(ids) // 4
        columns = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(COLUMNS))]
        return pa.RecordBatch.from_arrays(columns, COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_file)
        number, waiting, tokens = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting.append((doc_id, encoder.encode(text or "") + end))
                tokens += len(waiting[-1][1]) // 4
                if tokens >= group_tokens:
                    sequences = pack_group(waiting, capacity)
                    yield rows(sequences, number)
                    number, waiting, tokens = number + len(sequences), [], 0
        if waiting:
            yield rows(pack_group(waiting, capacity), number)

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return by_bytes(texts).mapInArrow(run, ", ".join(f"{c} bigint" for c in COLUMNS))
