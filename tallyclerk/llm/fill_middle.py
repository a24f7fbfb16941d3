"""Fill-in-the-middle: texts cut at two token boundaries and rearranged, some left plain.

A token is a run of ASCII letters or any other single character. The boundaries of a text's n tokens,
from 0 to its last offset, are kept as a Roaring-style set: 65,536 code points share a container, which is
an array of offsets, a bitmap or a list of runs, whichever is smallest. Cumulative cardinalities find
the container that holds the k-th boundary, and a select inside it gives the offset. Where a text is cut
follows from the hash of its doc_id: the prefix ends after the smaller, the middle after the larger of two
draws from 0 to n tokens. The parts are put in the order prefix, suffix, middle (psm) or suffix, prefix,
middle (spm), each behind its mark; empty texts, texts that hold a mark, and a share by hash stay plain.

The set of a long text is built a container at a time, so beside the text only its containers are held, at
most 8 KB per 65,536 characters. Documents are independent rows: one pass in Arrow batches, which are cut
by the bytes of text, and no shuffle.

Odd input: a null text is empty; an empty text is plain with no tokens; a null doc_id hashes as no digits;
repeated rows each get the same result; an empty table gives an empty result. Columns other than doc_id
and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are rearranged; of 100 of these so many begin with the suffix.
RATE, SPM_RATE = 90, 20
#: Bytes of text that leave a task in one batch.
BATCH_BYTES = 4 << 20

SPAN = 1 << 16
ARRAY, BITMAP, RUNS = range(3)
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class Container:
    """Sorted offsets below 65,536 in the smallest of three forms."""

    def __init__(self, values: np.ndarray) -> None:
        self.size = len(values)
        first = np.flatnonzero(np.diff(values, prepend=-2) != 1)
        if min(4 * len(first), 2 * self.size) >= SPAN // 8:
            bits = np.zeros(SPAN, bool)
            bits[values] = True
            self.kind, self.data = BITMAP, np.packbits(bits)
            self.upto = np.cumsum(_ONES[self.data].reshape(-1, 64).sum(1, dtype=np.int64))  # by 64 bytes
        elif 4 * len(first) < 2 * self.size:
            self.kind, self.data = RUNS, values[first].astype(np.uint16)
            self.upto = np.append(first[1:], self.size)
        else:
            self.kind, self.data = ARRAY, values.astype(np.uint16)

    def select(self, k: int) -> int:
        """The k-th offset, from 0."""
        if self.kind == ARRAY:
            return int(self.data[k])
        at = int(np.searchsorted(self.upto, k, "right"))
        before = int(self.upto[at - 1]) if at else 0
        if self.kind == RUNS:
            return int(self.data[at]) + k - before
        bits = np.unpackbits(self.data[64 * at : 64 * at + 64])
        return 512 * at + int(np.flatnonzero(bits)[k - before])


class Boundaries:
    """Offsets, in code points, at which tokens of a text begin or end."""

    def __init__(self, text: str) -> None:
        self.containers: list[Container] = []
        self.at: list[int] = []
        letter = False  # whether the character before is one
        for start in range(0, len(text) + 1, SPAN):
            points = np.frombuffer(text[start : start + SPAN].encode("utf-32-le"), "<u4")
            letters = ((points | 32) - np.uint32(97)) < 26
            # A token begins at each character but a letter after a letter; the end closes the last one.
            begins = ~(letters & np.concatenate([[letter], letters[:-1]])) if len(points) else np.zeros(0, bool)
            values = np.flatnonzero(begins)
            if start + SPAN > len(text):
                values = np.append(values, len(points))
            if len(values):
                self.containers.append(Container(values))
                self.at.append(start)
            letter = bool(len(letters)) and bool(letters[-1])
        self.upto = np.cumsum([c.size for c in self.containers])

    def __len__(self) -> int:
        return int(self.upto[-1])

    def select(self, k: int) -> int:
        """Offset of the k-th boundary: where the first k tokens end."""
        at = int(np.searchsorted(self.upto, k, "right"))
        return self.at[at] + self.containers[at].select(k - (int(self.upto[at - 1]) if at else 0))


def cut(text: str, h1: int, h2: int) -> tuple[int, int, int]:
    """(tokens, where the prefix ends, where the middle ends)"""
    found = Boundaries(text)
    n = len(found) - 1
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, found.select(a), found.select(b)


def rearranged(text: str, h: list[int], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, characters of the prefix, of the middle, output)"""
    n, a, b = cut(text, h[0], h[1])
    if not text or h[2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def restored(output: Column, form: Column) -> Column:
    """The text that was rearranged. Texts with marks stay plain, and no mark can arise across a cut,
    so the first mark of each kind is the one that was put there."""
    between = lambda a, b: F.substring_index(F.substring(output, F.position(F.lit(a), output) + F.lit(3), F.length(output)), b, 1)
    rest = F.substring(output, F.position(F.lit(MIDDLE), output) + F.lit(3), F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), rest, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), rest, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(documents: DataFrame, seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                rows = [rearranged(t or "", h, rate, spm_rate) for t, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    asked = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), draws.alias("draws"))
    return by_bytes(asked).mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
