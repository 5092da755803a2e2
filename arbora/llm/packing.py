"""Best-fit packing by a grouping genetic algorithm on islands.

Every document becomes its token ids and an end id; only one longer than a
sequence is cut.  Pieces are dealt at random to blocks of a bounded size, and
each block to several islands, which are tasks of their own.  An island evolves
a population of packings, which starts from best fit in random orders:
crossover injects whole well-filled bins of one parent into the other, drops
the bins that would hold a document twice and places the displaced documents by
best fit, largest first.  An island rests once it needs no more bins than its
tokens fill.  After each epoch the island's elite migrates to the next island
of the block; after the last one the block takes the best packing of all its
islands.

Its well-filled bins are then closed, and the documents of the others are dealt
anew to a smaller set of blocks.  What counts as well filled gets looser from
level to level, up to any bin, so the levels end whatever the sizes are.  Work
is proportional to the pieces, an island is one bounded task, and each level's
pieces are a written table.

Defined cases: a null or empty text is the end id alone; a repeated row is
packed as often as it occurs; no documents give no sequences; a null id is
packed like any other; a very long text is cut into many pieces; equal sizes
are placed by their number; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm import storage, textkit, tokens

LENGTH, END = 4096, 1
#: Pieces of a block, and islands that evolve packings of it.
BLOCK, ISLANDS = 4000, 2
#: Members of an island, epochs between which elites migrate, and an epoch's generations.
MEMBERS, EPOCHS, GENERATIONS = 3, 2, 40
#: Free places with which a bin is closed: one at the first level, so many times more at each further one.
LOOSER = 8


def _cut(path: str | None, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textkit.release()  # what earlier stages' tasks held to their end
        encoder, number = tokens.encoder(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            row, piece, start, size, crc = [], [], [], [], []
            for k, ids in enumerate(encoder.column(batch.column(1))):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for p, a in enumerate(range(0, len(ids), length)):
                    own = ids[a : a + length]
                    row.append(k)
                    piece.append(p)
                    start.append(a)
                    size.append(len(own))
                    crc.append(zlib.crc32(own.tobytes()))
            uid = np.arange(number, number + len(row), dtype=np.int64)
            number += len(row)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(uid)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "uid"])
        batch = None
        textkit.release()

    return run


def cut_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, uid of every piece of every text."""
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, uid bigint"
    return docs.select(F.col(key), F.col(text)).mapInArrow(_cut(vocabulary, length, end), schema)


class Bins:
    """A packing in the making: items by bin, free places by bin, and an index of bins by free places."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0  # bit f: a bin with f free places

    def add_bin(self, items: list[int], used: int) -> None:
        self._file(len(self.items), self.capacity - used)
        self.items.append(items)
        self.free.append(self.capacity - used)

    def _file(self, k: int, free: int) -> None:
        self.by_free[free].append(k)
        self.some |= 1 << free

    def best_fit(self, items: list[int]) -> None:
        """Place items, largest first, each where it leaves the least."""
        for i in sorted(items, key=lambda i: (-self.sizes[i], i)):
            size = self.sizes[i]
            fits = self.some >> size
            if not fits:
                self.add_bin([i], size)
                continue
            free = size + (fits & -fits).bit_length() - 1
            k = self.by_free[free].pop()
            if not self.by_free[free]:
                self.some &= ~(1 << free)
            self.items[k].append(i)
            self.free[k] = free - size
            self._file(k, free - size)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones: larger is better."""
        return -len(self.items), float(sum((self.capacity - f) ** 2 for f in self.free))


def of_assignment(sizes: list[int], capacity: int, bin_of: np.ndarray) -> Bins:
    bins = Bins(sizes, capacity)
    order = np.argsort(bin_of, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(bin_of[order])) + 1):
        items = own.tolist()
        bins.add_bin(items, sum(sizes[i] for i in items))
    return bins


def assignment(bins: Bins) -> np.ndarray:
    out = np.zeros(len(bins.sizes), np.int32)
    for k, own in enumerate(bins.items):
        out[own] = k
    return out


def best_fit_decreasing(sizes: list[int], capacity: int) -> Bins:
    bins = Bins(sizes, capacity)
    bins.best_fit(list(range(len(sizes))))
    return bins


def random_fit(sizes: list[int], capacity: int, random: np.random.Generator) -> Bins:
    """Best fit in random order."""
    bins = Bins(sizes, capacity)
    for i in random.permutation(len(sizes)).tolist():
        bins.best_fit([i])
    return bins


def crossover(one: Bins, two: Bins, random: np.random.Generator) -> Bins:
    """A child with well-filled bins of ``two``, the bins of ``one`` that these do not touch, and the rest by best fit."""
    fullest = np.argsort(two.free, kind="stable")[: max(1, len(two.free) // 2)]
    chosen = fullest[random.random(len(fullest)) < 0.4].tolist() or [int(fullest[0])]
    taken = {i for k in chosen for i in two.items[k]}
    child = Bins(one.sizes, one.capacity)
    for k in chosen:
        child.add_bin(list(two.items[k]), two.capacity - two.free[k])
    # Beside the bins that hold an injected document, some of the emptier ones are dissolved.
    loose = np.array(one.free) > np.median(one.free)
    spoilt = random.random(len(one.items)) < np.where(loose, 0.5, 0.05)
    displaced = []
    for k, own in enumerate(one.items):
        if not spoilt[k] and taken.isdisjoint(own):
            child.add_bin(list(own), one.capacity - one.free[k])
        else:
            displaced += [i for i in own if i not in taken]
    child.best_fit(displaced)
    return child


def evolve(sizes: list[int], capacity: int, seed: int, members: list[Bins] | None = None, generations: int = GENERATIONS) -> list[Bins]:
    """An island's population after an epoch, best first; it rests when the best needs no more bins than the tokens fill."""
    random = np.random.default_rng(seed)
    least = -(-sum(sizes) // capacity)
    members = list(members or ())
    while len(members) < MEMBERS and not (members and len(members[-1].items) <= least):
        members.append(random_fit(sizes, capacity, random))
    members.sort(key=Bins.fitness, reverse=True)
    for _ in range(generations if len(sizes) > 2 and len(members) > 1 else 0):
        if len(members[0].items) <= least:
            break
        a, b = random.permutation(len(members))[:2].tolist()
        child = crossover(members[min(a, b)], members[max(a, b)], random)
        if child.fitness() > members[-1].fitness():
            members[-1] = child
            members.sort(key=Bins.fitness, reverse=True)
    return members


_STATE = "block int, island int, uids binary, sizes binary, members array<binary>, bins int, fullness double"


def _state(block: int, island: int, uids: np.ndarray, sizes: np.ndarray, members: list[Bins]) -> pd.DataFrame:
    """An island's own members, and its elite for the next island."""
    best = members[0]
    bins, fullness = -best.fitness()[0], best.fitness()[1]
    row = lambda to, some: (block, to, uids.tobytes(), sizes.tobytes(), [assignment(m).tobytes() for m in some], bins, fullness)
    return pd.DataFrame([row(island, members), row((island + 1) % ISLANDS, members[:1])], columns=["block", "island", "uids", "sizes", "members", "bins", "fullness"])


def _settle(level: int, capacity: int):
    """First epoch: each island's population from its block's pieces."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        block, island = int(frame["block"].iloc[0]), int(frame["island"].iloc[0])
        frame = frame.sort_values("uid", ignore_index=True)
        uids, sizes = frame["uid"].to_numpy(np.int64), frame["length"].to_numpy(np.int64)
        return _state(block, island, uids, sizes, evolve(sizes.tolist(), capacity, hash((level, block, island, 0)) & 0x7FFFFFFF))

    return run


def _migrate(level: int, capacity: int, epoch: int):
    """Another epoch: each island with the elite that came to it, in place of its own worst."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        block, island = int(frame["block"].iloc[0]), int(frame["island"].iloc[0])
        uids, sizes = (np.frombuffer(frame[c].iloc[0], np.int64) for c in ("uids", "sizes"))
        distinct = list(dict.fromkeys(m for own in frame["members"] for m in own))
        members = sorted((of_assignment(sizes.tolist(), capacity, np.frombuffer(m, np.int32)) for m in distinct), key=Bins.fitness, reverse=True)[:MEMBERS]
        return _state(block, island, uids, sizes, evolve(sizes.tolist(), capacity, hash((level, block, island, epoch)) & 0x7FFFFFFF, members))

    return run


def _places(level: int, capacity: int, slack: int):
    """Where the pieces of each block's best packing are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, uids, sizes, bin_of in zip(*(batch.column(c).to_pylist() for c in ("block", "uids", "sizes", "best")), strict=True):
                uid, size, own = np.frombuffer(uids, np.int64), np.frombuffer(sizes, np.int64), np.frombuffer(bin_of, np.int32).astype(np.int64)
                order = np.argsort(own, kind="stable")
                before = np.cumsum(size[order]) - size[order]
                first = np.flatnonzero(np.concatenate([[True], np.diff(own[order]) != 0]))
                offset = before - np.repeat(before[first], np.diff(np.append(first, len(order))))
                closed = (capacity - np.bincount(own, size).astype(np.int64) <= slack)[own[order]]
                sequence = (level << 56) + (block << 20) + own[order]
                yield pa.RecordBatch.from_arrays([pa.array(uid[order]), pa.array(sequence), pa.array(offset), pa.array(closed)], ["at", "sequence_id", "offset", "closed"])

    return run


_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pack(pieces: DataFrame, capacity: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """``pieces`` with sequence_id and offset: every piece has a place, sequences have no gaps and at most ``capacity`` tokens."""
    spark = pieces.sparkSession
    table, _ = storage.materialize(pieces, "pieces")
    full = table.where(F.col("length") >= capacity)
    done = [full.select(*_COLUMNS, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    rest, level = table.where(F.col("length") < capacity), 0
    salt = textkit.mix_int(5) >> 1
    while n := rest.count():
        blocks = -(-n // block)
        slack = capacity if blocks == 1 else min(capacity, LOOSER**level)
        thin = rest.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(salt + level)), F.lit(blocks)).cast("int").alias("block"))
        islands = thin.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
        state = islands.groupBy("block", "island").applyInPandas(_settle(level, capacity), _STATE)
        for epoch in range(1, EPOCHS):
            state = state.groupBy("block", "island").applyInPandas(_migrate(level, capacity, epoch), _STATE)
        best = state.groupBy("block").agg(F.min_by(F.struct("uids", "sizes", F.col("members")[0].alias("best")), F.struct("bins", -F.col("fullness"), "island")).alias("x"))
        placed = best.select("block", "x.*").mapInArrow(_places(level, capacity, slack), "at bigint, sequence_id bigint, offset bigint, closed boolean")
        placed, _ = storage.materialize(rest.join(placed, F.col("uid") == F.col("at")).drop("at"), "placed")
        done.append(placed.where("closed").select(*_COLUMNS, "sequence_id", "offset"))
        rest, level = placed.where("not closed").select(*_COLUMNS, "uid"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out
