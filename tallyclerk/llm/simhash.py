"""SimHash near-duplicates, linked through BK-trees.

A document's fingerprint holds a bit for each of the 64 where more than half of the XXH64 values of
its word shingles have it set. Documents link if their fingerprints differ in at most `radius` bits.

Search: the bits are cut into `radius + 2` blocks; two linked fingerprints agree in at least two of
them, so fingerprints are dealt to shards by every pair of blocks (15 keys for radius 4, some 21 bits
each). Each shard is a BK-tree: children are keyed by their integer distance to the parent, and a
search follows only edges within the radius of its own distance. A tree of all fingerprints would
grow with the corpus and must not be broadcast, so the trees are dealt out instead; each fingerprint
reaches every tree that can hold a link of it. Within a shard links are merged at once, and a row is
returned per fingerprint, not per pair. Equal fingerprints are one node whatever their number.

Odd input: null, empty and word-less texts have fingerprint zero and are linked like any other;
texts of fewer words than a shingle are one shingle; repeated rows are documents of one group; a null
doc_id keeps its row but never names a group unless all its members are null; an empty table gives
an empty result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, checkpointed, linked_groups

SHINGLE, RADIUS, SEED = 4, 4, 42
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text; bytes.lower and bytes.split touch ASCII only, as wanted."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = iter([b" ".join(words)])
        n = 1
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    hashes = np.fromiter((xxh64_intdigest(p, SEED) for p in parts), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        block = hashes[at : at + _CHUNK]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, text_key): the fingerprint as a signed 64-bit number, and a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t or b"", shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], ["doc_id", "fp", "text_key"])

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_key"))
    return by_bytes(texts).mapInArrow(run, "doc_id bigint, fp bigint, text_key bigint")


class BKTree:
    """Distinct 64-bit values; children of a node keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Indexes of the values within the radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found

    def add(self, value: int) -> int:
        new = len(self.values)
        if new:
            at = 0
            while (edge := (value ^ self.values[at]).bit_count()) in self.children[at]:
                at = self.children[at][edge]
            self.children[at][edge] = new
        self.values.append(value)
        self.children.append({})
        return new


def shard_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(value, representative) for all distinct values that link to another; signed in, signed out."""
    tree, parent = BKTree(), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    unsigned = values.astype(np.int64).view(np.uint64).tolist()
    for value in unsigned:
        near = tree.near(value, radius)
        parent.append(tree.add(value))
        for other in near:
            a, b = root(len(parent) - 1), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = [root(i) for i in range(len(parent))]
    return [(int(values[i]), int(values[r])) for i, r in enumerate(roots) if i != r]


def block_masks(radius: int) -> list[int]:
    """Masks of every pair of the radius + 2 blocks, as signed numbers."""
    bounds = [64 * i // (radius + 2) for i in range(radius + 3)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:], strict=False)]
    return [m - (1 << 64) if (m := a | b) >> 63 else m for a, b in combinations(blocks, 2)]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints of column fp that the radius connects."""
    masks = block_masks(radius)
    keys = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    dealt = distinct.select("fp", F.explode(keys).alias("s")).select("s.c", "s.k", "fp").repartition("c", "k").sortWithinPartitions("c", "k", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
            if not rows.shape[1]:
                continue
            new = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
            cut = new[-1] if len(new) else 0
            rest = rows[:, cut:]
            yield linked(rows[2, :cut], new[:-1])
        if rest is not None:
            yield linked(rest[2], np.zeros(0, np.int64))

    def linked(fps: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        bounds = np.concatenate([[0], starts, [len(fps)]]).astype(np.int64)
        out = []
        for i in np.flatnonzero(np.diff(bounds) > 1):
            out += shard_links(fps[bounds[i] : bounds[i + 1]], radius)
        ab = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id among all documents that links reach."""
    return components(documents, radius, shingle).select("doc_id", "fp", "component_id")


def components(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, fp, component_id, root: root is one fingerprint of each group, so unlike
    component_id it tells groups apart whose documents share a doc_id or have none."""
    fps = checkpointed(fingerprints(documents, shingle))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = linked_groups(fingerprint_links(nodes.select("fp"), radius))
    placed = nodes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", "root")
    return fps.join(named, "fp").select("doc_id", "text_key", "fp", "component_id", "root")
