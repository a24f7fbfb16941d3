"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

Rows are taken by turn (nulls first; equal turns by role, then text). The first of these faults of a row counts:
blank (nothing but white space), duplicate (role and text stood earlier in the conversation), truncated (the
last character but white space ends no sentence). A row is kept, reroled to user or assistant, or deleted, and
empty rows may be inserted, so that the initials of the roles read as nothing, or as pairs of user and
assistant with at most one system row before them; blank and duplicate rows have to go, and a truncated row that
stays costs extra. Of the cheapest edits those are taken whose initials, in order, are the ASCII-least.

The edits come from a shortest path whose state is what the roles so far allow next. Going from the last row to
the first, the costs to finish from each state are a vector; less its smallest entry, it is one of a few dozen
that can occur at all (they are found once, from the end). The method of the Four Russians: for blocks of BLOCK row
symbols a table says, for every vector and every block, which vector comes before and what it adds, so a
conversation is a lookup per block. Then blocks are expanded from the first one on: the vectors inside a block are
rebuilt backward from the one behind it, and the edits are read off forward, the smallest initial
among those that lie on a cheapest path, which makes ties exact.

Rows are numbered in order over range partitions, so no task holds a conversation's rows. A conversation's
symbols, a byte a row, are put together from blocks of PIECE rows; they and the edits, which are one value of the
result, are all that is ever together. Texts are met again by row number.

Odd input: a null role or text counts as one space, conversations with a null conv_id are one conversation; rows that
repeat are duplicates; a role is known by its first character, which has to be s, u or a to be kept; turn numbers may
be null or far apart (gaps end at the largest 64-bit number); an empty table gives empty results. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyclerk.operators.numbering import numbered

from .common import checkpointed, slices

BLOCK, PIECE = 4, 4096
#: Bytes of symbols that are worked on together.
BATCH_BYTES = 1 << 20
SPACE = " \t\n\x0b\x0c\r"

#: What the roles so far allow next: s or u or the end; u; a; u or the end.
STATES, ACCEPTING = 4, (0, 3)
#: By state, where a row with this initial leads; only these are legal.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: By state, the role that an inserted or reroled row gets.
WANTED = ("u", "u", "a", "u")
ROLES = "sua-"
#: Symbols of rows: 2 * role + truncated; a row that has to go; no row.
GONE, NONE = 8, 9
SYMBOLS = 10
#: Codes of rows: 4 * role + fault, as letters.
FAULTS = "fine truncated duplicate blank".split()


class Costs(NamedTuple):
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def _after(state: int) -> int:
    return STEP[state][WANTED[state]]


class Tables:
    """Vectors of costs to finish that can occur, and what blocks of symbols make of them."""

    def __init__(self, costs: Costs) -> None:
        self.costs = costs
        end = self._inserted([0 if s in ACCEPTING else None for s in range(STATES)])
        self.vectors: list[tuple[int, ...]] = [tuple(c - min(end) for c in end)]
        self.end = min(end)
        number, before, added = {self.vectors[0]: 0}, [], []
        for vector in self.vectors:  # grows until no symbol leads to a new one
            before.append([])
            added.append([])
            for symbol in range(SYMBOLS):
                costs_before = self._row(vector, symbol)
                least = min(costs_before)
                found = tuple(c - least for c in costs_before)
                if found not in number:
                    number[found] = len(self.vectors)
                    self.vectors.append(found)
                before[-1].append(number[found])
                added[-1].append(least)
        self.before, self.added = np.array(before, np.int32), np.array(added, np.int64)
        # Blocks of twice the length: the later half is met first.
        self.block_before, self.block_added, n = self.before, self.added, 1
        while n < BLOCK:
            late, width = self.block_before, SYMBOLS**n
            pair = np.arange(width * width)
            first, last = pair // width, pair % width
            self.block_added = self.block_added[:, last] + self.block_added[late[:, last], first]
            self.block_before = late[late[:, last], first]
            n *= 2
        self.expand = lru_cache(maxsize=200_000)(self._expand)

    def _inserted(self, costs: list[int | None]) -> list[int]:
        """Costs before any rows that are inserted here."""
        for _ in range(STATES):
            for s in range(STATES):
                if (then := costs[_after(s)]) is not None and (costs[s] is None or costs[s] > then + self.costs.insert):
                    costs[s] = then + self.costs.insert
        return costs

    def moves(self, state: int, symbol: int) -> Iterator[tuple[str, str, int, int]]:
        """(initial, action, cost, next state) of what can be done with a row, initials in order.

        Actions: K and D; U and A rerole to user and assistant.
        """
        if symbol == NONE:
            return
        yield "D", "D", self.costs.delete, state
        if symbol == GONE:
            return
        extra = self.costs.truncated * (symbol % 2)
        if (then := STEP[state].get(ROLES[symbol // 2])) is not None:
            yield "K", "K", self.costs.keep + extra, then
        yield "R", WANTED[state].upper(), self.costs.rerole + extra, _after(state)

    def _row(self, vector: tuple[int, ...], symbol: int) -> list[int]:
        if symbol == NONE:
            return list(vector)
        return self._inserted([min(cost + vector[then] for _, _, cost, then in self.moves(s, symbol)) for s in range(STATES)])

    def _expand(self, behind: int, block: int, state: int) -> tuple[tuple[str, ...], int]:
        """(actions by row, state after) of a block, on the least of the cheapest paths."""
        symbols = [block // SYMBOLS ** (BLOCK - 1 - i) % SYMBOLS for i in range(BLOCK)]
        numbers = [behind]
        for symbol in reversed(symbols):
            numbers.append(int(self.before[numbers[-1], symbol]))
        numbers.reverse()
        out = []
        for i, symbol in enumerate(symbols):
            if symbol == NONE:
                continue
            here, then = self.vectors[numbers[i]], self.vectors[numbers[i + 1]]
            plus, actions = int(self.added[numbers[i + 1], symbol]), ""
            while True:
                found = {initial: (action, to) for initial, action, cost, to in self.moves(state, symbol) if cost + then[to] == plus + here[state]}
                if "D" not in found and here[_after(state)] + self.costs.insert == here[state]:
                    actions, state = actions + WANTED[state], _after(state)
                    continue
                action, state = found[min(found)]
                out.append(actions + action)
                break
        return tuple(out), state

    def repair(self, symbols: np.ndarray) -> tuple[int, list[str]]:
        """(cost, actions by row): u and a insert before, or after the last row, K, D, U, A as in `moves`."""
        padded = np.full(-(-len(symbols) // BLOCK) * BLOCK, NONE, np.int64)
        padded[: len(symbols)] = symbols
        blocks = (padded.reshape(-1, BLOCK) @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)).tolist()
        behind, now, cost = [0] * len(blocks), 0, self.end
        for i in range(len(blocks) - 1, -1, -1):
            behind[i] = now
            cost += int(self.block_added[now, blocks[i]])
            now = int(self.block_before[now, blocks[i]])
        cost += self.vectors[now][0]
        state, actions = 0, []
        for number, block in zip(behind, blocks, strict=True):
            some, state = self.expand(number, block, state)
            actions += some
        while state not in ACCEPTING:
            actions[-1] += WANTED[state]
            state = _after(state)
        return cost, actions


@lru_cache(maxsize=4)
def tables(costs: Costs) -> Tables:
    return Tables(costs)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), damaged by crc32 of conv_id:turn modulo 20: 0 drops a row, 1 empties
    its text, 2 removes the ends of its sentences, 3 repeats it, 4 makes it a user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    rows = conversations.select("conv_id", "turn", "role", "text", kind.alias("_kind")).filter("_kind <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), "_kind")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.withColumn("_copy", copies).select("conv_id", "turn", "role", "text")


def _codes(rows: DataFrame) -> DataFrame:
    """(conv_id, first, codes): a letter for role and fault of every row; first is the number of the first one."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    light = rows.select("n", "conv_id", "role", role.alias("r"), F.sha2("text", 256).alias("digest"), (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ends"))
    firsts = light.filter(~F.col("blank")).groupBy("conv_id", "role", "digest").agg(F.min("n").alias("n")).select("n", F.lit(True).alias("is_first"))
    fault = F.when(F.col("blank"), 3).when(F.col("is_first").isNull(), 2).when(~F.col("ends"), 1).otherwise(0)
    coded = light.join(firsts, "n", "left").select("n", "conv_id", F.char(F.lit(ord("a")) + 4 * F.col("r") + fault).alias("c"))
    joined = lambda rows: F.array_join(F.transform(F.sort_array(rows), lambda s: s["c"]), "")
    pieces = coded.groupBy("conv_id", F.floor(F.col("n") / PIECE).alias("piece")).agg(F.min("n").alias("n"), joined(F.collect_list(F.struct("n", "c"))).alias("c"))
    return pieces.groupBy("conv_id").agg(F.min("n").alias("first"), joined(F.collect_list(F.struct("n", "c"))).alias("codes"))


def _gaps(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps): turn numbers that are missing between the first and the last."""
    turns = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"), F.count("turn").alias("k"))
    missing = F.col("b").cast("decimal(20,0)") - F.col("a").cast("decimal(20,0)") + 1 - F.col("k")
    return turns.select("conv_id", F.when(F.col("k") > 0, F.least(missing, F.lit((1 << 63) - 1).cast("decimal(20,0)"))).otherwise(0).cast("bigint").alias("gaps"))


def _found(conversations: DataFrame, costs: Costs) -> DataFrame:
    """(conv_id, first, faults, illegal, cost, actions by row) of conversations of codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables(costs)
        symbol = np.array([GONE if fault >= 2 else 2 * role + fault for role in range(4) for fault in range(4)])
        legal = np.zeros((4, 4), bool)
        for pair in ("su", "ua", "au"):
            legal[ROLES.index(pair[0]), ROLES.index(pair[1])] = True
        for batch in batches:
            for part in slices(batch, 2, BATCH_BYTES):
                rows = []
                for text in part.column(2).to_pylist():
                    code = np.frombuffer(text.encode(), np.uint8).astype(np.int64) - ord("a")
                    roles = code // 4
                    rows.append((*np.bincount(code % 4, minlength=4)[:0:-1].tolist(), int((~legal[roles[:-1], roles[1:]]).sum()), *known.repair(symbol[code])))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.list_(pa.string()))],
                    ["conv_id", "first", "blank", "duplicate", "truncated", "illegal", "cost", "actions"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return conversations.mapInArrow(run, f"conv_id {kind}, first bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, actions array<string>")


def repair(turns: DataFrame, costs: Costs = Costs()) -> tuple[DataFrame, DataFrame]:
    """What was found, a row per conversation of `turns` (conv_id, turn, role, text), and the repaired rows.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), where audit has the initials of Keep,
    Rerole, Delete and Insert in order; and (conv_id, n, part, role, text) in the order of n and part.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = numbered(turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), said("role"), said("text")), "conv_id", "turn", "role", "text")
    found = checkpointed(_found(_codes(rows), costs))
    gaps = _gaps(rows).withColumnRenamed("conv_id", "_id")
    audit = F.translate(F.array_join("actions", ""), "UAua", "RRII")
    analysed = found.join(gaps, F.col("conv_id").eqNullSafe(F.col("_id"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", audit.alias("audit"))
    actions = found.select("first", F.posexplode("actions").alias("at", "action")).select((F.col("first") + F.col("at")).alias("n"), "action")
    taken = rows.join(actions.filter("action <> 'D'"), "n").select("conv_id", "n", "role", "text", F.posexplode(F.split("action", "")).alias("part", "what")).filter("what <> 'D' AND what <> ''")
    role = F.when(F.lower("what") == "u", "user").when(F.lower("what") == "a", "assistant").otherwise(F.col("role"))
    text = F.when(F.col("what").isin("u", "a"), "").otherwise(F.col("text"))
    return analysed, taken.select("conv_id", "n", "part", role.alias("role"), text.alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the lines role:text of each conversation's rows, in the order of n and part.

    A digest is taken line after line, so a conversation's rows pass through one task; none are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            ids, done = batch.column(0).to_pylist(), []
            for key, line in zip(ids, batch.column(1).to_pylist(), strict=True):
                if state is None or key != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.schema.field(0).type), pa.array([d[1] for d in done], pa.string())], ["conv_id", "sha256"])
            kind = batch.schema.field(0).type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()], pa.string())], ["conv_id", "sha256"])

    lines = rows.repartition("conv_id").sortWithinPartitions("conv_id", "n", "part").select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, sha256 string")
