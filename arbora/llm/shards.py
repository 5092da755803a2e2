"""Training-order materialisation into fixed-stride binary shards.

Every text becomes token ids and an end id, cut into sequences of a fixed
length; the last one of a text is padded in its record.  A sequence's index is
its input partition and its place there.  A keyed Feistel network with
cycle-walking permutes the indexes; the permuted index decides the shard, which
is a range of them, and the order within it.  A sequence's global slot is the
number of sequences before it in that order, which follows from the shards'
sizes, so slots are dense without a counting pass.

A record is the sequence's length and its ids, padded to the stride, so record
r of a shard starts at byte r * stride and a reader can resume at any slot.
Tokens move once, to the task of their shard.  A shard is written under the
attempt's own name and renamed, so a repeated task leaves the same file.

Defined cases: a null or empty text is the end id alone; very long texts are
many sequences; repeated rows and null ids are sequences like others; the
permutation has no ties; extra columns are ignored; no documents give no shards
and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm import storage, textkit, tokens

LENGTH, END, KEY = 512, 1, 20240229
ROUNDS = 6
#: Bits of an index for the place in its partition.
PLACE = 32


class Permutation:
    """A keyed bijection of [0, n)."""

    def __init__(self, n: int, key: int) -> None:
        self.n = n
        self.half = max(1, -(-max(n - 1, 1).bit_length() // 2))
        self.keys = [np.uint64(textkit.mix_int(key * 31 + r)) for r in range(ROUNDS)]

    def _rounds(self, x: np.ndarray, keys: list[np.uint64], forward: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for k in keys:
            if forward:
                left, right = right, left ^ (textkit.mix(right ^ k) & mask)
            else:
                left, right = right ^ (textkit.mix(left ^ k) & mask), left
        return left << half | right

    def _walk(self, x: np.ndarray, forward: bool) -> np.ndarray:
        keys = self.keys if forward else self.keys[::-1]
        x = self._rounds(np.asarray(x, np.uint64), keys, forward)
        while len(out := np.flatnonzero(x >= np.uint64(self.n))):
            x[out] = self._rounds(x[out], keys, forward)
        return x

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, True)

    def backward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)


def _cut(path: str | None, length: int, end: int, partitions: int, shards: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, index = tokens.encoder(path), TaskContext.get().partitionId() << PLACE
        permutation = Permutation(partitions << PLACE, key)
        narrow = len(encoder.ends_piece) <= 1 << 16
        for batch in batches:
            row, start, body = [], [], []
            for k, ids in enumerate(encoder.column(batch.column(1))):
                ids = np.append(ids, np.uint32(end)).astype("<u2" if narrow else "<u4")
                for a in range(0, len(ids), length):
                    row.append(k)
                    start.append(a)
                    body.append(ids[a : a + length].tobytes())
            order = permutation.forward(np.arange(index, index + len(row)))
            index += len(row)
            if index >> PLACE != (index - len(row)) >> PLACE and row:
                raise RuntimeError("a partition has more sequences than places")
            # The range of the permuted index, in whole numbers: shards * order / n.
            width = -(-permutation.n // shards)
            columns = [pa.array((order // np.uint64(width)).astype(np.int32)), pa.array(order.astype(np.int64)), batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(body, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "place", "doc_id", "start", "ids"])
        textkit.release()

    return run


def _write(folder: str, length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        at, record, out, temporary = None, 0, None, ""

        def finish() -> None:
            if out is not None:
                out.close()
                done = f"{root}/shard-{at:06d}.bin"
                if system.get_file_info(done).type == fs.FileType.File:  # of an earlier attempt, with the same records
                    system.delete_file(done)
                system.move(temporary, done)

        for batch in batches:
            shards, records, lengths, sums = batch.column("shard").to_numpy(), [], [], []
            for k, ids in enumerate(batch.column("ids")):
                if shards[k] != at:
                    finish()
                    at, record = int(shards[k]), 0
                    system.create_dir(root, recursive=True)
                    temporary = f"{root}/.shard-{at:06d}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(temporary)
                body = ids.as_py()
                n = len(body) // width
                out.write(n.to_bytes(4, "little") + body.ljust(length * width, b"\0"))
                records.append(record)
                lengths.append(n)
                sums.append(zlib.crc32(np.frombuffer(body, f"<u{width}").astype("<u4").tobytes()))
                record += 1
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("shard", "doc_id", "start")], pa.array(records, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], ["shard", "doc_id", "start", "record", "length", "ids_crc32"])
        finish()

    return run


def materialise(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, length: int = LENGTH, end: int = END, seed: int = KEY) -> DataFrame:
    """Write the shards and their manifest under ``folder``; return doc_id, start, length, ids_crc32, slot, shard, record of every sequence."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    inputs, outputs = max(1, rows.rdd.getNumPartitions()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = 8 * outputs
    width = 2 if len(tokens.encoder(vocabulary).ends_piece) <= 1 << 16 else 4
    kind = rows.schema["doc_id"].dataType.simpleString()
    cut = rows.mapInArrow(_cut(vocabulary, length, end, inputs, shards, seed), f"shard int, place bigint, doc_id {kind}, start bigint, ids binary")
    ordered = cut.repartition(outputs, "shard").sortWithinPartitions("shard", "place")
    written = ordered.mapInArrow(_write(f"{folder}/data", length, width), f"shard int, doc_id {kind}, start bigint, record bigint, length bigint, ids_crc32 bigint")
    written.write.parquet(f"{folder}/records")
    records = spark.read.parquet(f"{folder}/records")
    sizes = sorted((r["shard"], r["n"]) for r in records.groupBy("shard").agg(F.count("*").alias("n")).collect())  # a row for each shard
    first, at = [], 0
    for shard, n in sizes:
        first.append((shard, at, n, 4 + length * width, width))
        at += n
    manifest = spark.createDataFrame(first, "shard int, first_slot bigint, records bigint, stride int, width int").coalesce(1)
    manifest.write.parquet(f"{folder}/manifest")
    return records.join(F.broadcast(manifest.select("shard", "first_slot")), "shard").select("doc_id", "start", "length", "ids_crc32", (F.col("first_slot") + F.col("record")).alias("slot"), "shard", "record")


def read_from(folder: str, manifest: list[tuple[int, int, int, int, int]], slot: int) -> Iterator[np.ndarray]:
    """Ids of the sequences from a slot on, in training order; ``manifest`` has the rows of the manifest table."""
    system, root = fs.FileSystem.from_uri(f"{folder}/data")
    for shard, first, records, stride, width in sorted(manifest):
        if first + records <= slot:
            continue
        with system.open_input_file(f"{root}/shard-{shard:06d}.bin") as file:
            file.seek(max(0, slot - first) * stride)
            while record := file.read(stride):
                n = int.from_bytes(record[:4], "little")
                yield np.frombuffer(record, f"<u{width}", n, 4)
