"""Documents in compressed blocks, and questions between blocks.

Exact repeat detection has to compare every window of a corpus with every other
one. Rows per window would be far larger than the text. Here a *block* of a few
megabytes of text asks its questions as packed arrays: one message per (block,
shard), where the shard is a hash range of the windows. A shard sees the
questions of all blocks, answers each message with an array, and the answers
return to their blocks. A block states each window once, however often it holds
it, so a window that a third of all documents share costs one entry per block.

``pack`` writes the blocks once to the shared folder; a lost executor costs the
tasks it ran, never the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.workspace import materialize

#: Text bytes of a block (one longer document is a block of its own), and of a shard.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 8 << 20

PACKED = "block long, n_bytes long, blob binary"
MESSAGE = "block long, shard int, body binary"


def pack(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Whole texts of ``docs`` (``doc_id``, ``text``) as written blocks, without a shuffle.

    A null text is an empty one; other columns are dropped.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made = [], 0, 0
        part = TaskContext.get().partitionId() << 32

        def closed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
            with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                out.write_table(table.combine_chunks())
            return pa.RecordBatch.from_pylist(
                [{"block": part + made, "n_bytes": size, "blob": sink.getvalue().to_pybytes()}],
                pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("blob", pa.binary())]),
            )

        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0).to_numpy()
            first = 0
            for i, n in enumerate(sizes.tolist()):
                if size and size + n > block_bytes:
                    held.append(batch.slice(first, i - first))
                    yield closed()
                    held, size, made, first = [], 0, made + 1, i
                size += n
            held.append(batch.slice(first))
        if sum(b.num_rows for b in held):
            yield closed()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    return materialize(rows.mapInArrow(blocks, PACKED), "blocks")


def shards(blocks: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    """How many hash ranges keep a shard's share of the windows small."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(1, -(-total // shard_bytes))


class Texts:
    """The documents of a block as one byte array with document limits."""

    def __init__(self, blob: bytes):
        table = pa.ipc.open_stream(blob).read_all()
        self.ids = table["doc_id"].to_pylist()
        texts = table["text"].combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        limits = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
        self.limits = (limits - limits[0]).astype(np.int64)
        self.data = data[limits[0] : limits[-1]]

    def owner(self) -> np.ndarray:
        """The document number of each byte."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.limits))


def ask(blocks: DataFrame, question: Callable, past: DataFrame | None = None) -> DataFrame:
    """Messages of every block: ``question(texts, answers) -> [(shard, bytes)]``.

    ``past``: answers to earlier questions, by block, passed as ``{(stage, shard): bytes}``.
    """

    def one(block: int, blob: bytes, answers: dict) -> pa.RecordBatch:
        sent = question(Texts(blob), answers)
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([block] * len(sent), pa.int64()),
                "shard": pa.array([s for s, _ in sent], pa.int32()),
                "body": pa.array([b for _, b in sent], pa.binary()),
            }
        )

    return _each(blocks, past, one, MESSAGE)


def _each(blocks: DataFrame, past: DataFrame | None, one: Callable, schema: str) -> DataFrame:
    """``one(block, blob, answers)`` for each block, with its answers if there were questions."""
    if past is None:

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, blob in zip(batch["block"].to_pylist(), batch["blob"]):
                    yield one(block, blob.as_py(), {})

        return blocks.mapInArrow(alone, schema)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = {
            (stage, shard): body
            for stage, shard, body in zip(*(right[c].to_pylist() for c in ("stage", "shard", "body")))
        }
        found = [
            one(block, blob, answers)
            for block, blob in zip(left["block"].to_pylist(), left["blob"].to_pylist())
        ]
        return pa.Table.from_batches(found) if found else None

    return blocks.groupBy("block").cogroup(past.groupBy("block")).applyInArrow(both, schema)


def answer(messages: DataFrame, reply: Callable, stage: int) -> DataFrame:
    """Each shard's ``reply([bytes]) -> [bytes]``, one for each message, marked with ``stage``."""

    def shard(table: pa.Table) -> pa.Table:
        return table.set_column(
            table.schema.get_field_index("body"),
            "body",
            pa.array(reply(table["body"].to_pylist()), pa.binary()),
        )

    return messages.groupBy("shard").applyInArrow(shard, MESSAGE).withColumn("stage", F.lit(stage))


def conclude(blocks: DataFrame, past: DataFrame, result: Callable, schema: str) -> DataFrame:
    """``result(texts, answers) -> RecordBatch`` for every block."""
    return _each(blocks, past, lambda block, blob, answers: result(Texts(blob), answers), schema)


# --- arrays in messages -------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def by_shard(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, from, to) of the runs of a sorted shard column."""
    if not len(shard):
        return []
    cut = np.flatnonzero(np.diff(shard)) + 1
    start = np.concatenate(([0], cut))
    stop = np.concatenate((cut, [len(shard)]))
    return list(zip(shard[start].tolist(), start.tolist(), stop.tolist()))


def falling(sorted_cells: np.ndarray) -> bytes:
    """Sorted unsigned 32-bit values as gaps, byte plane by byte plane; Spark's codec shrinks the empty planes."""
    gaps = np.diff(sorted_cells, prepend=np.uint32(0)).astype("<u4")
    return gaps.view(np.uint8).reshape(-1, 4).T.tobytes()


def rising(body: bytes) -> np.ndarray:
    planes = np.frombuffer(body, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
