"""Which rows are asked for: a Bloom filter of their keys, so that rows nobody asks for don't move."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from scoutframe.llm._text import mixed

#: What so many tasks made is merged first, then those sums.
MERGE = 64
#: Bits of the filter that says which texts are asked for: sixteen for each, between these powers of two (32 MB at most).
ASKED_LEAST, ASKED_MOST = 20, 28
ASKED_BLOCKS = 32


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Two of the ``2 ** bits`` bits of the filter for each id."""
    x = mixed(ids.view(np.uint64))
    return np.concatenate([x >> np.uint64(64 - bits), x & np.uint64((1 << bits) - 1)]).astype(np.int64)


def let_through(batch: pa.RecordBatch, bits: np.ndarray, key: str = "id", hit: bool = True) -> pa.RecordBatch:
    """The rows whose key may be among those that are asked for; with ``hit`` false, the others."""
    at = _places(batch.column(key).to_numpy(), (8 * len(bits)).bit_length() - 1)
    asked = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).reshape(2, -1).all(0)
    return batch.filter(pa.array(asked == hit))


def asked_filter(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids of ``wanted`` (stored), merged by block from those of all tasks; its size follows their number."""
    power = min(ASKED_MOST, max(ASKED_LEAST, (16 * wanted.count()).bit_length()))
    width = (1 << power) // 8 // ASKED_BLOCKS

    def mark(batches):
        bits = np.zeros((1 << power) // 8, np.uint8)
        for batch in batches:
            at = _places(batch.column("id").to_numpy(), power)
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        if bits.any():
            blocks = [zstandard.compress(b.tobytes(), 1) for b in np.split(bits, ASKED_BLOCKS)]
            merge = [TaskContext.get().partitionId() // MERGE] * ASKED_BLOCKS
            yield pa.RecordBatch.from_arrays([pa.array(range(ASKED_BLOCKS), pa.int32()), pa.array(merge, pa.int32()), pa.array(blocks, pa.binary())], ["block", "merge", "bits"])

    def merged(rows: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint8)
        for x in rows.column("bits"):
            total |= np.frombuffer(zstandard.decompress(x.as_py()), np.uint8)
        return pa.Table.from_arrays([rows.column("block").slice(0, 1), pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], names=["block", "bits"])

    marked = wanted.select("id").mapInArrow(mark, "block int, merge int, bits binary")
    found = marked.groupBy("block", "merge").applyInArrow(merged, "block int, bits binary").groupBy("block").applyInArrow(merged, "block int, bits binary")
    out = np.zeros((ASKED_BLOCKS, width), np.uint8)
    for block, bits in found.collect():
        out[block] = np.frombuffer(zstandard.decompress(bits), np.uint8)
    return out.ravel()


def asked_rows(docs: DataFrame, known, key: str) -> DataFrame:
    """The rows of ``docs`` whose long ``key`` may be among those that ``known`` (a broadcast filter) holds."""

    def run(batches):
        for batch in batches:
            batch = let_through(batch, known.value, key)
            if batch.num_rows:
                yield batch

    return docs.mapInArrow(run, docs.schema)
