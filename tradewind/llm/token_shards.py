"""Training-order materialisation: token ids of documents in fixed-stride shards, shuffled by a
keyed permutation."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.files import NewFile, opened
from tradewind.llm.stored import stored
from tradewind.llm.tokens import encoder
from tradewind.llm.words import blocks, mixed, text_column
from tradewind.session import shared_folder

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Ids of a sequence, and sequences of a shard.
LENGTH = 256
PER_SHARD = 1 << 15
KEY = 2024
ROUNDS = 4
# Sequences that one task reads at a time.
READ = 1 << 12
NO_ID = (1 << 63) - 1
# A sequence begins with its document (8 bytes), its place there and its number of ids (4 each).
HEAD = 16


def permuted(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slot of each index below ``n``, a permutation of 0 to n - 1 that depends on ``key``.

    A Feistel network permutes the next even power of two; an index that leaves the range goes
    through it again until it is back (cycle-walking), less than four times on average."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mixed(np.arange(1, rounds + 1, dtype=np.uint64) + mixed(np.array([key], np.uint64)))
    slots = index.astype(np.uint64)
    walking = np.arange(len(slots))
    while len(walking):
        left, right = slots[walking] >> np.uint64(half), slots[walking] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & mask)
        slots[walking] = (left << np.uint64(half)) | right
        walking = walking[slots[walking] >= n]
    return slots.astype(np.int64)


def _placed(docs: DataFrame, id_column: str, text_column_: str) -> DataFrame:
    """Id and text with the file and row they are read from; tables that are not files are written
    first, so that two readings see the same order."""
    wanted = [
        F.coalesce(F.col(id_column).cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.col(text_column_).alias("text"),
    ]
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return docs.select(*wanted, *where)
    except AnalysisException:
        return stored(docs.select(*wanted), "shard-documents").select("id", "text", *where)


def _encoded(batch: pa.RecordBatch, vocabulary: str, length: int):
    """Per block: row numbers, ids, the bounds of the rows in them, and sequences per row. The ids
    of a text end with the end-of-text id; a text without ids has no sequence."""
    for low, high, buf, bounds in blocks(text_column(batch, "text")):
        ids, at = encoder(vocabulary).encode(buf, bounds)
        size = np.diff(at)
        yield low, high, ids, at, np.where(size > 0, -(-(size + 1) // length), 0)


class Runs:
    """Counts rows and sequences of each run of rows that a task reads from a file in order."""

    def __init__(self) -> None:
        self.done: list[tuple[str, int, int, int]] = []
        self.file, self.first, self.last, self.rows, self.sequences = None, 0, -1, 0, 0

    def step(self, file: str, row: int, sequences: int) -> bool:
        """Whether a new run begins with this row."""
        new = file != self.file or row <= self.last
        if new:
            self.finish()
            self.file, self.first, self.rows, self.sequences = file, row, 0, 0
        self.last = row
        self.rows += 1
        self.sequences += sequences
        return new

    def finish(self) -> None:
        if self.file is not None:
            self.done.append((self.file, self.first, self.rows, self.sequences))
        self.file = None


def _counted(batches, vocabulary: str, length: int) -> Iterator[pa.RecordBatch]:
    runs = Runs()
    for batch in batches:
        files, rows = batch.column("file").to_pylist(), batch.column("row").to_pylist()
        for low, high, _, _, count in _encoded(batch, vocabulary, length):
            for at in range(low, high):
                runs.step(files[at], rows[at], int(count[at - low]))
    runs.finish()
    if runs.done:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in zip(*runs.done, strict=True)], ["file", "first", "rows", "sequences"]
        )


def _sequences(batches, vocabulary, length, per_shard, key, total, starts) -> Iterator[pa.RecordBatch]:
    """Every sequence with its slot. A run must be the one that was counted, or the job fails."""
    runs, settled = Runs(), 0
    next_index = 0

    def check():
        nonlocal settled
        for file, first, rows, sequences in runs.done[settled:]:
            if starts[file, first][1:] != (rows, sequences):
                raise RuntimeError(f"{file} was read differently than before")
        settled = len(runs.done)

    for batch in batches:
        files, rows = batch.column("file").to_pylist(), batch.column("row").to_pylist()
        names = batch.column("id").to_numpy(zero_copy_only=False)
        for low, high, ids, bounds, count in _encoded(batch, vocabulary, length):
            index = np.empty(high - low, np.int64)
            for at in range(low, high):
                if runs.step(files[at], rows[at], int(count[at - low])):
                    check()
                    if (files[at], rows[at]) not in starts:
                        raise RuntimeError(f"{files[at]} was split differently than before")
                    next_index = starts[files[at], rows[at]][0]
                index[at - low] = next_index
                next_index += int(count[at - low])
            n = int(count.sum())
            if not n:
                continue
            row = np.repeat(np.arange(high - low), count)
            part = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
            end = encoder(vocabulary).end
            # Ids of each row, its end, and padding to whole sequences.
            table = np.full(n * length, end, ids.dtype)
            begin = (np.cumsum(count) - count) * length
            size = np.diff(bounds)
            table[np.repeat(begin - bounds[:-1], size) + np.arange(len(ids))] = ids
            table = table.reshape(n, length)
            used = np.minimum(size[row] + 1 - part * length, length)
            slots = permuted(index[row] + part, total, key)
            head = np.empty((n, HEAD), np.uint8)
            head[:, :8] = names[low:high][row].astype("<i8")[:, None].view(np.uint8)
            head[:, 8:12] = part.astype("<i4")[:, None].view(np.uint8)
            head[:, 12:] = used.astype("<i4")[:, None].view(np.uint8)
            records = np.concatenate([head, table.astype(table.dtype.newbyteorder("<")).view(np.uint8)], axis=1)
            stride = records.shape[1]
            for a in range(0, n, 8192):
                some = np.ascontiguousarray(records[a : a + 8192])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slots[a : a + 8192]),
                        pa.array((slots[a : a + 8192] // per_shard).astype(np.int32)),
                        pa.Array.from_buffers(
                            pa.binary(),
                            len(some),
                            [None, pa.py_buffer((np.arange(len(some) + 1) * stride).astype(np.int32)), pa.py_buffer(some)],
                        ),
                    ],
                    ["slot", "shard", "record"],
                )
    runs.finish()
    check()


def _written(batches, folder: str) -> Iterator[pa.RecordBatch]:
    """Writes the sorted sequences of a partition, one file per shard."""
    done, file, shard, first, count = [], None, None, 0, 0

    def finish():
        if file:
            file.close()
            done.append((file.path, shard, first, count, file.size))

    for batch in batches:
        slots, shards = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "shard"))
        records = batch.column("record")
        offsets = np.frombuffer(records.buffers()[1], np.int32)[records.offset :]
        edges = np.flatnonzero(shards[1:] != shards[:-1]) + 1
        for low, high in pairwise([0, *edges.tolist(), len(shards)]):
            if high == low:
                continue
            if shards[low] != shard:
                finish()
                shard, first, count = int(shards[low]), int(slots[low]), 0
                file = NewFile(folder, f"-shard-{shard:06d}.bin")
            if (slots[low:high] != first + count + np.arange(high - low)).any():
                raise RuntimeError(f"shard {shard} misses a slot after {first + count}")
            begin, end = int(offsets[low]), int(offsets[high])
            file.write(records.buffers()[2].slice(begin, end - begin))
            count += high - low
    finish()
    if done:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in zip(*done, strict=True)],
            ["path", "shard", "first_slot", "sequences", "size"],
        )


def write_shards(
    docs: DataFrame,
    folder: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    vocabulary: str = VOCABULARY,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    key: int = KEY,
) -> DataFrame:
    """Writes all documents as sequences of ``length`` ids in the order of training; returns the
    shards that are complete: (path, shard, first_slot, sequences, size).

    A document's ids, with the end-of-text id after them, are cut into sequences; the last is
    filled up with that id. Sequences are numbered by file and row. The first pass counts them
    per run of rows that a task reads, so that only those counts (a few per input split) reach the
    driver. In the second pass each task knows its first number, a keyed Feistel permutation turns
    numbers into slots, and each sequence goes straight to the task that writes its range of
    slots. So texts are never shuffled and ids once. Every sequence takes the same number of
    bytes: slot s is at ``(s % per_shard) * stride`` of its shard.

    Null and empty texts have no sequence; rows with the same id are documents of their own; a
    missing id is written as the largest. Other columns are ignored; an empty table writes no
    shard."""
    placed = _placed(docs, id_column, text_column)
    counted = stored(
        placed.mapInArrow(
            lambda batches: _counted(batches, vocabulary, length),
            "file string, first bigint, rows bigint, sequences bigint",
        ),
        "shard-runs",
    )
    starts, total = {}, 0
    for run in counted.orderBy("file", "first").toLocalIterator():
        starts[run["file"], run["first"]] = (total, run["rows"], run["sequences"])
        total += run["sequences"]
    known = docs.sparkSession.sparkContext.broadcast(starts)
    sequences = placed.mapInArrow(
        lambda batches: _sequences(batches, vocabulary, length, per_shard, key, total, known.value),
        "slot bigint, shard int, record binary",
    )
    shards = max(1, -(-total // per_shard))
    in_order = sequences.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    return stored(
        in_order.mapInArrow(
            lambda batches: _written(batches, folder),
            "path string, shard bigint, first_slot bigint, sequences bigint, size bigint",
        ),
        "shards",
    )


def read_shards(
    shards: DataFrame, from_slot: int = 0, read: int = READ, ids: bool = True, wide: bool = False
) -> DataFrame:
    """The sequences from ``from_slot`` on: slot, shard, byte_offset, doc_id, part, n_ids, and the
    ids as little-endian bytes (``wide``: 4 bytes each, else 2). The stride tells where a slot
    is, so a reader that stopped goes on there without reading what comes before."""
    first = F.greatest(F.col("first_slot"), F.lit(from_slot))
    end = F.col("first_slot") + F.col("sequences")
    chunks = shards.where(end > from_slot).select(
        "path",
        "shard",
        "first_slot",
        (F.col("size") / F.col("sequences")).cast("int").alias("stride"),
        end.alias("end"),
        F.explode(F.sequence(first, end - 1, F.lit(read).cast("bigint"))).alias("slot"),
    )
    n = max(shards.sparkSession.sparkContext.defaultParallelism, chunks.count())
    width = 4 if wide else 2

    def sequences(batches):
        for batch in batches:
            for chunk in batch.to_pylist():
                system, path = opened(chunk["path"])
                stride, slot = chunk["stride"], chunk["slot"]
                count = min(read, chunk["end"] - slot)
                with system.open_input_file(path) as file:
                    file.seek((slot - chunk["first_slot"]) * stride)
                    data = np.frombuffer(file.read(count * stride), np.uint8).reshape(count, stride)
                slots = slot + np.arange(count)
                doc, part, used = (
                    np.ascontiguousarray(data[:, a:b]).view(kind).ravel()
                    for a, b, kind in ((0, 8, "<i8"), (8, 12, "<i4"), (12, 16, "<i4"))
                )
                ids_there = data[:, HEAD:]
                filled = np.arange(ids_there.shape[1]) < (width * used)[:, None]
                body = pa.Array.from_buffers(
                    pa.binary(),
                    count,
                    [
                        None,
                        pa.py_buffer(np.concatenate([[0], np.cumsum(width * used)]).astype(np.int32)),
                        pa.py_buffer(ids_there[filled]),
                    ],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slots),
                        pa.array(np.full(count, chunk["shard"], np.int64)),
                        pa.array((slots - chunk["first_slot"]) * stride),
                        pa.array(doc, pa.int64(), mask=doc == NO_ID),
                        pa.array(part),
                        pa.array(used),
                        body,
                    ],
                    ["slot", "shard", "byte_offset", "doc_id", "part", "n_ids", "ids"],
                )

    found = chunks.repartition(min(n, 100_000), "shard", "slot").mapInArrow(
        sequences,
        "slot bigint, shard bigint, byte_offset bigint, doc_id bigint, part int, n_ids int, ids binary",
    )
    return found if ids else found.drop("ids")


def materialised(docs: DataFrame) -> DataFrame:
    """Writes the shards of ``docs`` to the shared folder and reads them back: a row per sequence
    with its slot, place, document, and a checksum of its ids."""
    folder = shared_folder(docs.sparkSession, "token-shards")
    return read_shards(write_shards(docs, folder)).select(
        "slot", "shard", "byte_offset", "doc_id", "part", "n_ids", F.crc32("ids").alias("ids_crc32")
    )


def op5_token_shards(spark, sf_dir: str) -> DataFrame:
    return materialised(spark.read.parquet(f"{sf_dir}/documents.parquet"))
