"""What the finders of repeated passages share: anchors, recurring anchors, recurring windows and covered spans.

A window is ``size`` units (words or bytes) of one text.  Its anchor is the run of
``size - reach`` units in it with the smallest hash, so equal windows have equal
anchors at equal places, wherever they stand.  A window can recur only if its
anchor does; anchors are few, and what is not anchored twice is never shuffled
again.  Texts are known by ``th``, a 64-bit hash; copies are one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``width`` values in a row, by the first."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, values.dtype)
    fill = TOP if pick is np.minimum else np.uint64(0)
    rows = -(-len(values) // width)
    block = np.full(rows * width, fill, values.dtype)
    block[: len(values)] = values
    block = block.reshape(rows, width)
    ahead = pick.accumulate(block, axis=1).ravel()
    back = pick.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[width - 1 : width - 1 + n])


def inside(cut: np.ndarray, size: int, n: int) -> np.ndarray:
    """Whether ``size`` units from each place stay in its text; ``cut``: where texts begin, and the end."""
    ok = np.zeros(n, bool)
    for first, last in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        ok[first : max(first, last - size + 1)] = True
    return ok


def anchors(grams: np.ndarray, cut: np.ndarray, size: int, reach: int) -> np.ndarray:
    """Places of the anchors of all windows: ``grams`` has the hash of ``size - reach`` units from each place."""
    n = len(grams)
    least = sliding(grams, reach + 1, np.minimum)
    least = np.where(inside(cut, size, len(least)), least, np.uint64(0))
    # a gram is an anchor if it is the smallest of some window that holds it
    most = sliding(np.concatenate([np.zeros(reach, np.uint64), least, np.zeros(max(0, n - len(least)), np.uint64)]), reach + 1, np.maximum)
    return np.flatnonzero((most[:n] == grams) & (most[:n] > 0))


def packed_by_part(keys: np.ndarray, columns: list[np.ndarray], parts: int) -> tuple[list[int], list[bytes]]:
    """Rows dealt by ``keys`` modulo ``parts``; each part's rows in one binary, column after column."""
    to = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    bounds = np.searchsorted(to[order], np.arange(parts + 1))
    own = [p for p in range(parts) if bounds[p] < bounds[p + 1]]
    return own, [b"".join(c[order[bounds[p] : bounds[p + 1]]].tobytes() for c in columns) for p in own]


def unpacked(blocks: pa.ChunkedArray, kinds: list[str]) -> list[np.ndarray]:
    """The columns of all blocks, joined."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[np.empty(0, k)] for k in kinds]
    for x in blocks:
        data, at = x.as_py(), 0
        n = len(data) // width
        for column, kind in zip(out, kinds, strict=True):
            column.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) for c in out]


def by_text(spans: DataFrame, kinds: list[str], names: list[str]) -> DataFrame:
    """One row per text of (to, packed): th, and each packed column after it as one binary; ``to`` is a part of th."""

    def gather(rows: pa.Table) -> pa.Table:
        name, *values = unpacked(rows.column("packed"), ["i8", *kinds])
        order = np.lexsort((values[0], name))
        name, values = name[order], [v[order] for v in values]
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.empty(0, np.int64)
        ends = np.append(first, len(name))[1:]
        columns = [pa.array([v[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()) for v in values]
        return pa.Table.from_arrays([pa.array(name[first].astype(np.int64)), *columns], names=["th", *names])

    return spans.groupBy("to").applyInArrow(gather, ", ".join(["th long", *(f"{n} binary" for n in names)]))


def dealt_by_text(th: np.ndarray, values: list[np.ndarray], parts: int) -> pa.Table:
    """(to, packed): th and values in one binary for each part of th."""
    own, packed = packed_by_part(th.astype(np.int64).view(np.uint64), [th.astype(np.int64), *values], parts)
    return pa.Table.from_arrays([pa.array(own, pa.int32()), pa.array(packed, pa.binary())], names=["to", "packed"])


def recurring(found: DataFrame, kinds: list[str], verdict, parts: int) -> DataFrame:
    """(th, places): places of texts whose key recurs, one row a text.

    ``found``: (part, packed) with packed columns key, th, place and perhaps more,
    of ``kinds``.  ``verdict(starts, counts, columns)`` says per row, sorted by
    key, th and place, without repeats, whether it counts.
    """

    def gather(rows: pa.Table) -> pa.Table:
        columns = unpacked(rows.column("packed"), kinds)
        order = np.lexsort((columns[2], columns[1], columns[0]))
        columns = [c[order] for c in columns]
        if len(columns[0]):
            fresh = np.ones(len(columns[0]), bool)
            fresh[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])
            columns = [c[fresh] for c in columns]
            first = np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]]))
            keep = verdict(first, np.diff(np.append(first, len(columns[0]))), columns)
            columns = [c[keep] for c in columns]
        return dealt_by_text(columns[1], [columns[2].astype(np.uint32)], parts)

    return by_text(found.groupBy("part").applyInArrow(gather, "to int, packed binary"), ["u4"], ["places"])


#: Stands for a null doc_id: larger than any other.
NO_ID = (1 << 63) - 1


def identified(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, text (null is empty), th of the text, id (doc_id, or ``NO_ID``), and the columns ``carried`` along."""
    return docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        *carried,
    )


def copies_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(th, id) of the first row of every text; (th, id, low) of all rows of texts that several rows hold."""
    lows = docs.groupBy("th").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    many = docs.select("th", "id").join(lows.where("n > 1").select("th", "low"), "th").distinct()
    return lows.select("th", F.col("low").alias("id")), many


def places_of(packed: bytes | None) -> np.ndarray:
    """Sorted distinct places; null has none."""
    return np.unique(np.frombuffer(packed or b"", np.uint32)).astype(np.int64)


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans ``[start, end)``; spans that touch are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(first)[1:] - 1, len(starts) - 1)
    return starts[first], reach[last]
