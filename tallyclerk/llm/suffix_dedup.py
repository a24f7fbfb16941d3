"""Suffix-array dedup: every byte in a string of `length` bytes that also starts earlier is removed.

Earlier means in a document with a smaller doc_id, or before in the same one. Different texts
under one doc_id are documents of their own, in the order of their hashes. A suffix array of a
whole corpus, or the merging of every shard with every other, grows faster than the input, so the
suffixes are first dealt out by content:

1. In each window of `length` bytes, the k-gram with the smallest hash is its anchor. Equal windows
   have equal anchors, so a window can only repeat if its anchor does; other text goes no further.
2. A repeated anchor is sent, with the stretch of text that its windows cover, to the shard of its
   hash. Equal windows meet in one shard.
3. A shard builds the suffix array of the windows of its distinct stretches by Larsson-Sadakane refinement: ranks
   double their depth, and the last step ends at `length` bytes exactly; only groups still tied are sorted again, and
   only places that a window's rank looks at take part. Neighbours of one rank are one string; all but
   its first place are removed, and so are the windows of a stretch that equals an earlier one. Shards of more than
   `SHARD` bytes are cut into several, in order of doc_id, and merged by binary search: a string found in
   an earlier shard's array is removed.
4. An anchor with more than `HOT` bytes of stretches, such as a phrase in very many different
   surroundings, gets no shard. Its stretches are spread again and dealt out window by window, by
   the digest of each, so it takes many tasks and none holds more than `HOT` bytes of one anchor.

Both shuffles by hash carry each key only once per Arrow batch: an anchor or stretch that repeats
within a batch is settled there, so a passage in a third of all documents sends a row per
batch, not per document. Spans come back per document and are cut from its text.

Odd input: null text is empty; texts under `length` bytes are left alone; repeated rows with one
doc_id and text are one document and get its result; those with a null doc_id come before all others; an empty table
gives an empty result. Columns other than doc_id and text are carried along, not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, by_bytes, checkpointed

LENGTH, GRAM = 100, 24  # the hash below takes three words of 8 bytes
ADDED = "kept kept_text n_bytes n_removed n_spans".split()
#: Doc_ids with several texts that are broadcast; more meet in a shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of stretches in one suffix array.
SHARD = 1 << 19
#: Bytes of stretches of one anchor up to which they are settled together in one task.
HOT = 4 << 20
_CHUNK = (1 << 18) - 256
_LOW = np.uint64((1 << 20) - 1)
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _words(data: np.ndarray, n: int, kind: str = "<u8") -> np.ndarray:
    """The 8 bytes from each of the first n places on, as numbers."""
    return np.ndarray((n,), kind, data.data, strides=(1,)).astype(np.uint64)


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor, first window, windows, hash) of each run of windows with one anchor, in order."""
    n = len(text) - length + 1
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    span, found = length - GRAM + 1, []
    for at in range(0, n, _CHUNK):
        data = np.frombuffer(text[at : at + _CHUNK + length - 1], np.uint8)
        w = _words(data, len(data) - 7)
        m = len(data) - GRAM + 1
        h = w[:m] * _A + w[8 : 8 + m] * _B + w[16 : 16 + m] * _C
        h ^= h >> np.uint64(29)
        h *= _D
        h ^= h >> np.uint64(32)
        least, have = (h & ~_LOW) | np.arange(m, dtype=np.uint64), 1
        while have < span:
            step = min(have, span - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        place = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        found.append((place[first] + at, first + at, np.diff(first, append=len(place)), h[place[first]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(begin: np.ndarray, end: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted intervals, joined where they touch; new marks the first of each document."""
    if not len(begin):
        return begin, end, np.zeros(0, np.int64)
    at = np.flatnonzero(new | (begin > np.concatenate([[-1], end[:-1]])))
    return begin[at], end[np.append(at[1:], len(end)) - 1], at


def suffix_order(data: np.ndarray, depth: int, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks) of places by their first `depth` bytes; zeros follow the end.

    Ranks are equal where those bytes are. room: by place, the bytes up to the end of its stretch. Only places
    with room for `depth` bytes are ordered then, and others take part as long as these look at them.
    """
    n = len(data)
    room = np.full(n, depth) if room is None else room
    known, who = min(8, depth), np.flatnonzero(room >= min(8, depth))
    keys, rank = _words(np.concatenate([data, np.zeros(8, np.uint8)]), n, ">u8")[who] >> np.uint64(64 - 8 * known), np.zeros(n + 1, np.int64)
    group = np.zeros(len(who), np.int64)  # where the places with one rank so far begin
    while len(who):
        sorting = np.argsort(keys)
        who, keys = who[sorting], keys[sorting]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(who)), 0))
        rank[who] = np.maximum(rank[who], 1) + first - group
        if known == depth:
            break
        step = min(known, depth - known)
        known += step
        left = (~new | ~np.append(new[1:], True)) & (room[who] >= known)  # tied, and still looked at
        who = who[left]
        now = rank[who]
        group = np.maximum.accumulate(np.where(np.diff(now, prepend=0) != 0, np.arange(len(who)), 0))
        keys = now * (n + 2) + rank[np.minimum(who + step, n)]
    ordered = np.flatnonzero(room >= depth)
    return ordered[np.argsort(rank[ordered], kind="stable")], rank[:n]


class Shard:
    """Windows of some stretches: which repeat, and the first of each kind in sorted order."""

    def __init__(self, texts: pa.BinaryArray, order: np.ndarray, length: int) -> None:
        """order: by stretch, its rank by (document, start); equal ranks are one place."""
        size, edge = _sizes(texts)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[edge : edge + size.sum()] if len(texts) else np.zeros(0, np.uint8)
        self.length, padded = length, np.concatenate([data, np.zeros(8, np.uint8)])
        self.words = np.ndarray((len(data) + 1,), ">u8", padded.data, strides=(1,))
        base, count = np.cumsum(size) - size, size - length + 1
        # Windows are the places with `length` bytes before the end of their stretch.
        windows, rank = suffix_order(data, length, np.repeat(base + size, size) - np.arange(len(data)))
        new = np.diff(rank[windows], prepend=0) != 0
        kinds, kind = np.flatnonzero(new), np.cumsum(new) - 1
        stretch = np.repeat(np.arange(len(size)), size)[windows]
        offset = windows - base[stretch]
        key = order[stretch] * (length + 1) + offset
        least = np.minimum.reduceat(key, kinds) if len(kinds) else key
        number = (np.cumsum(count) - count)[stretch] + offset  # among the windows of all stretches
        self.removed = np.zeros(len(windows), bool)
        self.removed[number] = key > least[kind]
        self.kinds, self._kind, self._windows = windows[kinds], kind, number

    def compare(self, mine: np.ndarray, other: Shard, theirs: np.ndarray) -> np.ndarray:
        """Sign of the order of windows at places of this shard and of another one."""
        sign, at = np.zeros(len(mine), np.int64), 0
        left = np.arange(len(mine))
        while at < self.length and len(left):
            a, b = self.words[mine[left] + at], other.words[theirs[left] + at]
            if (rest := self.length - at) < 8:
                a, b = a >> np.uint64(64 - 8 * rest), b >> np.uint64(64 - 8 * rest)
            sign[left] = np.where(a < b, -1, np.where(a > b, 1, 0))
            left, at = left[a == b], at + 8
        return sign

    def remove_those_in(self, earlier: Shard) -> None:
        """Binary search of each kind of window in an earlier shard's array."""
        low, high = np.zeros(len(self.kinds), np.int64), np.full(len(self.kinds), len(earlier.kinds), np.int64)
        if not len(earlier.kinds):
            return
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            after = self.compare(self.kinds[open_], earlier, earlier.kinds[mid]) > 0
            low[open_] = np.where(after, mid + 1, low[open_])
            high[open_] = np.where(after, high[open_], mid)
        there = np.flatnonzero(low < len(earlier.kinds))
        found = np.zeros(len(self.kinds), bool)
        found[there] = self.compare(self.kinds[there], earlier, earlier.kinds[low[there]]) == 0
        self.removed[self._windows[found[self._kind]]] = True


def _spans(doc: np.ndarray, start: np.ndarray, count: np.ndarray, removed: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Intervals of bytes under the removed windows of stretches: (document, begin, end)."""
    stretch = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(stretch)) - np.repeat(np.cumsum(count) - count, count)
    at = np.flatnonzero(removed)
    s, o = stretch[at], offset[at]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1)]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return doc[s[first]], start[s[first]] + o[first], start[s[first]] + o[last] + length


def _sizes(texts: pa.BinaryArray) -> tuple[np.ndarray, int]:
    """Bytes of each text, and where the first begins in the values of the array."""
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.diff(edges), int(edges[0])


def _distinct(texts: pa.BinaryArray) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """Texts without repeats, the rows where they first stand, in order, and by row the number of its text."""
    coded = texts.dictionary_encode()
    number = coded.indices.to_numpy()
    return coded.dictionary, np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1)), number


def shard_spans(texts: pa.BinaryArray, doc: np.ndarray, start: np.ndarray, keys: np.ndarray, length: int, limit: int = SHARD) -> Iterator[tuple[np.ndarray, ...]]:
    """Spans to remove from stretches that are sorted by (key, document, start).

    Equal stretches, which have equal keys, enter an array once: the later ones are removed whole.
    Stretches of one key stay together; a key of more than `limit` bytes becomes several shards.
    """
    if not len(texts):
        return
    texts, first, number = _distinct(texts)
    sizes = _sizes(texts)[0]
    again = np.flatnonzero((doc != doc[first[number]]) | (start != start[first[number]]))
    yield doc[again], start[again], start[again] + sizes[number[again]]
    doc, start, keys = doc[first], start[first], keys[first]
    edge = np.concatenate([[0], np.cumsum(sizes)])
    at, n = 0, len(texts)
    bounds = np.append(np.flatnonzero(np.diff(keys)) + 1, n)
    earlier: list[Shard] = []
    while at < n:
        full = int(np.searchsorted(edge, edge[at] + limit, "right")) - 1  # stretches that fit
        ends = bounds[(bounds > at) & (bounds <= full)]
        to = int(ends[-1]) if len(ends) else min(max(full, at + 1), n)
        whole = bool(len(ends)) or to in bounds
        _, order = np.unique(np.stack([doc[at:to], start[at:to]]), axis=1, return_inverse=True)
        shard = Shard(texts.slice(at, to - at), np.asarray(order).reshape(-1), length)
        for one in earlier:
            shard.remove_those_in(one)
        yield _spans(doc[at:to], start[at:to], sizes[at:to] - length + 1, shard.removed, length)
        earlier = [] if whole else [*earlier, shard]
        at = to


def _stretch_bytes(rows: pa.Table) -> int:
    return pc.sum(pc.binary_length(rows["stretch"])).as_py() or 0


class KeyParts:
    """Rows that come sorted by key, cut into (rows, hot): whole keys of up to `most` bytes of
    stretches, and parts of keys that have more. Which are hot depends on no batch bounds."""

    def __init__(self, most: int) -> None:
        self.most, self.held, self.size, self.key, self.hot = most, [], 0, None, False

    def __call__(self, batch: pa.RecordBatch | None) -> Iterator[tuple[pa.Table, bool]]:
        """What a batch completes; None ends the input."""
        if batch is None:
            yield from self._end()
            return
        rows = pa.Table.from_batches([batch.filter(pc.is_valid(batch.column(1)))])
        if not rows.num_rows:
            return
        key = rows["key"].to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        sizes = np.add.reduceat(pc.binary_length(rows["stretch"]).to_numpy().astype(np.int64), bounds[:-1]).tolist()
        if len(bounds) == 2 or max(sizes[1:-1], default=0) > self.most:
            cuts = list(zip(bounds[:-1], bounds[1:], sizes, strict=True))
        else:  # nothing between the first key and the last one is hot
            cuts = [(0, bounds[1], sizes[0]), *([(bounds[1], bounds[-2], None)] if bounds[1] < bounds[-2] else []), (bounds[-2], len(key), sizes[-1])]
        for at, to, size in cuts:
            if self.key is None or key[at] != self.key:
                yield from self._end()
            part = rows.slice(at, to - at)
            if size is None:
                yield part, False
                continue
            self.key, self.size = key[at], self.size + size
            self.held.append(part)
            self.hot = self.hot or self.size > self.most
            if self.hot:
                yield from ((p, True) for p in self.held)
                self.held = []

    def _end(self) -> Iterator[tuple[pa.Table, bool]]:
        if self.held:
            yield pa.concat_tables(self.held), False
        self.held, self.size, self.key, self.hot = [], 0, None, False


def _removed(keyed: DataFrame, key: str, twin: str, length: int) -> DataFrame:
    """(doc, twin, begins, ends): bytes to remove of each document of `keyed`, whose key columns are not null.

    The documents are dealt by key here with all their columns, just as the caller does to cut
    them, so Spark shuffles the texts once for both.
    """
    hot_bytes = HOT
    texts = by_bytes(keyed).select(F.col(key).alias("doc"), F.col(twin).alias("twin"), F.col("text").cast("binary").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row per anchor; one of each hash in the batch asks whether others have it too.
        for batch in batches:
            docs, twins, places, hashes = [], [], [], []
            for doc, other, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                place, _, _, h = anchors(text or b"", length)
                docs.append(np.full(len(place), doc, np.int64))
                twins.append(np.full(len(place), other, np.int64))
                places.append(place)
                hashes.append(h)
            doc, other, place, h = (np.concatenate([*x, np.zeros(0, k)]).astype(k) for x, k in ((docs, np.int64), (twins, np.int64), (places, np.int64), (hashes, np.uint64)))
            _, first, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            known = n[back] > 1
            asks = np.zeros(len(h), bool)
            asks[first] = True
            key = np.where(asks, h, (h ^ (place.astype(np.uint64) * _A)) + doc.astype(np.uint64) * _B + other.astype(np.uint64) * _C).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(other), pa.array(place.astype(np.int32)), pa.array(asks), pa.array(known)], ["key", "doc", "twin", "place", "asks", "known"])

    asked = texts.mapInArrow(find, "key bigint, doc bigint, twin bigint, place int, asks boolean, known boolean")
    others = F.count("*").over(Window.partitionBy("key", "asks"))
    repeated = asked.withColumn("n", others).filter((F.col("asks") & (F.col("n") > 1)) | F.col("known"))
    wanted = repeated.groupBy("doc", "twin").agg(F.collect_list("place").alias("places")).select(*(F.col(c).alias(f"{key}its_{c}") for c in ("doc", "twin", "places")))

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, int] = {}
            rows: list[list] = []
            gone: list[tuple] = []
            ids = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            joined = sorted(zip(ids, range(batch.num_rows), batch.column(2), batch.column(3), strict=True), key=lambda r: r[:2])
            for doc, _, text, places in joined:
                text = text.as_py() or b""
                place, first, count, h = anchors(text, length)
                at = np.flatnonzero(np.isin(place, np.asarray(places.values)))
                begins = []
                for p, s, c, x in zip(place[at].tolist(), first[at].tolist(), count[at].tolist(), h[at].tolist(), strict=True):
                    key = (x, p - s, text[s : s + c - 1 + length])
                    had = seen.setdefault(key, len(rows))
                    if had == len(rows):
                        rows.append([x, key[2], doc, s, c])
                    elif rows[had][2:4] != [doc, s]:
                        begins.append((s, s + c - 1 + length))
                if begins:
                    b, e = np.array(begins, np.int64).T
                    b, e, _ = _runs(b, e, np.zeros(len(b), bool))
                    gone += zip([doc] * len(b), b.tolist(), e.tolist(), strict=True)
            spread = np.arange(len(gone), dtype=np.uint64) * _A + np.uint64(len(rows))
            key = np.concatenate([np.array([r[0] for r in rows], np.uint64), spread]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key), pa.array([r[1] for r in rows] + [None] * len(gone), pa.binary()),
                    *(pa.array([r[2][i] for r in rows] + [g[0][i] for g in gone], pa.int64()) for i in range(2)), pa.array([r[3] for r in rows] + [g[1] for g in gone], pa.int64()),
                    pa.array([r[4] for r in rows] + [g[2] for g in gone], pa.int64()),
                ],
                ["key", "stretch", "doc", "twin", "start", "count"],
            )

    with_places = keyed.join(wanted, (F.col(key) == F.col(f"{key}its_doc")) & (F.col(twin) == F.col(f"{key}its_twin")))
    rest = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keyed.columns) if c not in (key, twin, "text")]
    stretches = with_places.select(F.col(key).alias("doc"), F.col(twin).alias("twin"), F.col("text").cast("binary").alias("text"), F.col(f"{key}its_places").alias("places"), *rest).mapInArrow(stretch, "key bigint, stretch binary, doc bigint, twin bigint, start bigint, count bigint")
    dealt = stretches.repartition("key").sortWithinPartitions("key", "doc", "twin", "start")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(doc: np.ndarray, other: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (doc, other, begin, end)], ["doc", "twin", "begin", "end"])

        def solved(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            if tables:
                ready = pa.concat_tables(tables).combine_chunks()
                number, other = ready["doc"].to_numpy(), ready["twin"].to_numpy()
                if twins := other.any():  # (doc, twin) in order, as numbers
                    ids, number = np.unique(np.stack([number, other]), axis=1, return_inverse=True)
                stretches = ready["stretch"].cast(pa.binary()).combine_chunks()
                for n, begin, end in shard_spans(stretches, np.asarray(number).reshape(-1), *(ready[c].to_numpy() for c in ("start", "key")), length):
                    yield out(*(ids[:, n] if twins else (n, np.zeros(len(n)))), begin, end)

        parts = KeyParts(hot_bytes)
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            bare = batch.filter(pc.is_null(batch.column(1)))
            if bare.num_rows:
                yield out(*(bare.column(i).to_numpy() for i in (2, 3, 4, 5)))
            # Whole keys only come from here on; several small ones make a shard.
            for rows, is_hot in parts(batch):
                if not is_hot:
                    held.append(rows)
                    size += _stretch_bytes(rows)
                if size > 2 * SHARD:
                    yield from solved(held)
                    held, size = [], 0
        for rows, is_hot in parts(None):
            if not is_hot:
                held.append(rows)
        yield from solved(held)

    def of_hot_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = KeyParts(hot_bytes)
        for batch in chain(batches, [None]):
            for rows, is_hot in parts(batch):
                if is_hot:
                    yield from rows.select(["stretch", "doc", "twin", "start", "count"]).to_batches()

    # Both read the same shuffle; the second only passes on what the first leaves out.
    spans = dealt.mapInArrow(settle, "doc bigint, twin bigint, begin bigint, end bigint")
    hot = dealt.mapInArrow(of_hot_keys, "stretch binary, doc bigint, twin bigint, start bigint, count bigint").repartition("doc", "twin", "start")
    window = lambda i: F.struct(
        (F.col("start") + i).alias("at"), F.substring(F.unhex(F.sha2(F.substring("stretch", i.cast("int") + 1, length), 256)), 1, 16).alias("digest"))
    windows = hot.select("doc", "twin", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1), window)).alias("w")).select("doc", "twin", "w.at", "w.digest")
    # Equal places, of repeated rows, have one rank.
    later = windows.withColumn("n", F.rank().over(Window.partitionBy("digest").orderBy("doc", "twin", "at"))).filter("n > 1")
    spans = spans.unionByName(later.select("doc", "twin", F.col("at").alias("begin"), (F.col("at") + length).alias("end")))
    merged = spans.groupBy("doc", "twin").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("s"))
    return merged.select("doc", "twin", F.col("s.begin").alias("begins"), F.col("s.end").alias("ends"))


def _cut(text: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """Text without the bytes of the intervals; joined where they touch or overlap."""
    kept, removed, spans = [], [], []
    for t, b, e in zip(text, begins, ends, strict=True):
        t = t or b""
        if b is None or not len(b):
            kept.append(t)
            removed.append(0)
            spans.append(0)
            continue
        parts, at, n = [], 0, 0
        reach = np.maximum.accumulate(np.asarray(e))
        b, e, _ = _runs(np.asarray(b), reach, np.zeros(len(b), bool))
        b, e = np.minimum(b, len(t)), np.minimum(e, len(t))
        for x, y in zip(b.tolist(), e.tolist(), strict=True):
            parts.append(t[at:x])
            at, n = y, n + y - x
        kept.append(b"".join(parts) + t[at:])
        removed.append(n)
        spans.append(len(b))
    whole = [k.decode("utf-8", "ignore") for k in kept]
    return pd.DataFrame({"kept": kept, "kept_text": whole, "n_removed": removed, "n_spans": spans})


def dedup(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """`documents` with the columns ADDED, in place of any of those names.

    kept_text is kept without the bytes of characters that a cut went through.
    """
    others = [F.col(f"`{c}`") for c in documents.columns if c not in ADDED]
    own = "_sa" + "_" * max(map(len, documents.columns))  # longer than any name that is there
    twin, text_key = f"{own}twin", F.xxhash64("text")
    # The second part of a document's key is 0 unless its doc_id does not say which text it is.
    said = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias(own), text_key.alias("h"))
    shared = checkpointed(said.groupBy(own).agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select(own, F.lit(True).alias(f"{own}shared")))
    keyed = documents.select(*others, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias(own))
    other = F.when(F.col("doc_id").isNull(), text_key)
    if not shared.isEmpty():
        keyed = keyed.join(broadcast_if_small(shared, BROADCAST_ROWS), own, "left")
        other = other.when(F.col(f"{own}shared"), text_key)
    keyed = keyed.select(*others, own, other.otherwise(F.lit(0).cast("bigint")).alias(twin))
    spans = _removed(keyed, own, twin, length).select(F.col("doc").alias(own), F.col("twin").alias(twin), F.col("begins").alias(f"{own}begins"), F.col("ends").alias(f"{own}ends"))
    joined = keyed.join(spans, [own, twin], "left")
    # Not pushed into filters of the caller, where it would run a second time.
    cut = F.pandas_udf(_cut, "struct<kept:binary,kept_text:string,n_removed:bigint,n_spans:bigint>").asNondeterministic()
    done = joined.select(*others, cut(F.col("text").cast("binary"), f"{own}begins", f"{own}ends").alias(f"{own}cut"))
    added = {"n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")}
    return done.select(*others, *(added.get(c, F.col(f"{own}cut.{c}")).alias(c) for c in ADDED))
