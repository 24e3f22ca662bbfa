"""Tables of a fixed number of counters, filled by all tasks and small enough to be sent to all of them."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from studyframe.llm.textkernel import mix, resting

CHUNK = 1 << 16


def chunks_of(counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Numbers and compressed bytes of the chunks of a task's counters."""
    numbers = range(len(counts) // CHUNK)
    return pa.array(numbers, pa.int32()), pa.array([zlib.compress(counts[c * CHUNK : (c + 1) * CHUNK].astype(np.uint32).tobytes(), 1) for c in numbers], pa.binary())


def sum_chunks(chunks: DataFrame, slots: int) -> np.ndarray:
    """The sum of the counters of all tasks, from rows (chunk, counts). Chunks are added in the shuffle; what reaches
    the driver has `slots` entries, whatever the input, and is compressed."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(zlib.decompress(counts.as_py()), dtype=np.uint32)
                sums[c] = sums[c] + own if c in sums else own.astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())})

    out = np.zeros(slots, dtype=np.uint64)
    for row in chunks.select("chunk", "counts").repartition("chunk").mapInArrow(resting(add), "chunk int, counts binary").collect():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.uint64)
    return out


def count_into(rows: DataFrame, slots: int, slots_of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """How often slots_of() names each slot below `slots`, a multiple of CHUNK, over all rows."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros(slots, dtype=np.uint32), False
        for batch in batches:
            any_row = True
            total += np.bincount(slots_of(batch), minlength=slots).astype(np.uint32)
        if any_row:
            yield pa.RecordBatch.from_arrays(list(chunks_of(total)), ["chunk", "counts"])

    return sum_chunks(rows.mapInArrow(resting(fill), "chunk int, counts binary"), slots)


class Filter:
    """A set of longs that may hold more than it was given, never less."""

    SLOTS = 1 << 22

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def slot(ids: pa.Array) -> np.ndarray:
        return (mix(ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(Filter.SLOTS - 1)).astype(np.int64)

    @classmethod
    def of(cls, ids: DataFrame) -> Filter:
        """Of a frame with one column of longs."""
        return cls(np.packbits(count_into(ids, cls.SLOTS, lambda batch: cls.slot(batch.column(0))) > 0))

    def has(self, ids: pa.Array) -> np.ndarray:
        slot = self.slot(ids)
        return (self.bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
