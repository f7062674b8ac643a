"""Dedup of long byte strings with a sampled suffix array, by deep-shallow sorting.

Every 400-byte string has an anchor, the 128 bytes in it with the smallest hash,
so equal strings have equal anchors.  The suffixes that start at recurring anchors
are sampled, with the bytes before them: all that can matter for the strings that
hold the anchor.  Buckets of suffixes with equal anchors are sorted by what
follows and by what precedes (backwards): multikey quicksort on eight-byte keys
down to a shallow depth, then a blind trie for each group that still agrees.  Two
suffixes agree on a string exactly where the common prefixes in both orders reach
its ends.  Of anchors with more than ``HOT`` suffixes, the strings are compared by
hash instead, dealt by hash, so that no passage gathers in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutframe.llm._repeats import (
    anchors,
    by_text,
    copies_of,
    dealt_by_text,
    identified,
    packed_by_part,
    places_of,
    recurring,
    runs,
    unpacked,
)
from scoutframe.llm._shared import stored, table
from scoutframe.llm._text import SpanHasher, bytes_of, ragged, slices

SIZE = 400
REACH = 272
ANCHOR = SIZE - REACH
#: Anchors found at more places than this are handled by hash.
HOT = 2000
#: Depth in eight-byte keys beyond which groups go to a blind trie: after the anchor, and backwards.
SHALLOW_AFTER, SHALLOW_BEFORE = 24, 8
_HOT_BIT = np.uint32(1 << 31)


def blind_trie(strings: np.ndarray) -> tuple[list[int], list[int]]:
    """Order of distinct rows of bytes, and the common prefix of each with the one before it (0 for the first).

    Going down, only the branching bytes are looked at; the leaf that is reached
    gives the common prefix, and with it the place of the new branch.
    """
    root: list | int = 0
    for i in range(1, len(strings)):
        own = strings[i]
        node = root
        while isinstance(node, list):
            branches = node[1]
            node = branches.get(int(own[node[0]]))
            if node is None:
                node = next(iter(branches.values()))
        depth = int(np.argmax(strings[node] != own))
        mark = int(strings[node][depth])
        above, at = None, root
        while isinstance(at, list) and at[0] < depth:
            above, at = at, at[1][int(own[at[0]])]
        if isinstance(at, list) and at[0] == depth:
            at[1][int(own[depth])] = i
            continue
        fork = [depth, {mark: at, int(own[depth]): i}]
        if above is None:
            root = fork
        else:
            above[1][int(own[above[0]])] = fork
    order, common, stack = [], [], [(root, 0)]
    while stack:
        node, before = stack.pop()
        if isinstance(node, list):
            branches = sorted(node[1].items(), reverse=True)
            for k, (_, child) in enumerate(branches):
                stack.append((child, before if k == len(branches) - 1 else node[0]))
        else:
            order.append(node)
            common.append(before)
    return order, common


def multikey(keys: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, shallow: int) -> list[tuple[int, int]]:
    """Multikey quicksort of rows of keys, in place in ``order``, from the first key to a shallow depth; all groups at once.

    Each group is parted by the key at its depth into rows below, at and above a
    pivot, the middle one of three.  Rows at the pivot go on with the next key.  What still
    agrees at the shallow depth is returned as runs of ``order``.
    """
    depth, agreed = np.zeros(len(starts), np.int64), []
    while True:
        deep = depth >= min(shallow, keys.shape[1])
        agreed += [(a, b) for a, b in zip(starts[deep].tolist(), ends[deep].tolist(), strict=True) if b - a > 1]
        open_ = ~deep & (ends - starts > 1)
        starts, ends, depth = starts[open_], ends[open_], depth[open_]
        if not len(starts):
            return agreed
        at = ragged(starts, ends - starts)
        group = np.repeat(np.arange(len(starts)), ends - starts)
        key = keys[order[at], depth[group]]
        three = np.sort(np.stack([keys[order[x], depth] for x in (starts, (starts + ends) // 2, ends - 1)]), axis=0)
        pivot = three[1][group]
        side = (key > pivot).astype(np.int64) + (key >= pivot)
        order[at] = order[at[np.argsort(3 * group + side, kind="stable")]]
        cut = np.concatenate([starts[:, None], starts[:, None] + np.cumsum(np.bincount(3 * group + side, minlength=3 * len(starts)).reshape(-1, 3), axis=1)], axis=1)
        starts, ends = cut[:, :3].ravel(), cut[:, 1:].ravel()
        depth = (depth[:, None] + [0, 1, 0]).ravel()


#: Bytes of neighbours that are compared at a time.
COMPARED = 8 << 20


def deep_shallow(strings: np.ndarray, group: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes by group, then content; and the common prefix of each with the one before it.

    Rows are distinct within their group; -1 stands where a group begins.  Their
    length is a multiple of eight.
    """
    n, width = strings.shape
    keys = np.ascontiguousarray(strings).view(">u8").reshape(n, width // 8).astype(np.uint64)
    order = np.argsort(group, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = group[order][1:] != group[order][:-1]
    first = np.flatnonzero(fresh)
    agreed = multikey(keys, order, first, np.append(first, n)[1:] if n else first, shallow)
    common = np.full(n, -2, np.int64)  # -2: not known yet
    common[fresh] = -1
    for a, b in agreed:
        own = order[a:b]
        sort, prefix = blind_trie(strings[own])
        order[a:b] = own[sort]
        common[a + 1 : b] = prefix[1:]
    left = np.flatnonzero(common == -2)
    step = max(1, COMPARED // max(width, 1))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        common[some] = np.argmax(strings[order[some]] != strings[order[some - 1]], axis=1)
    return order, common


def _digests(strings: np.ndarray) -> np.ndarray:
    """A 64-bit number for each row of bytes."""
    weights = np.cumprod(np.full(strings.shape[1], 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    return (strings.astype(np.uint64) + np.uint64(1)) @ weights


def distinct_rows(strings: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, of): a row for each distinct one within its group, and which of these each row is.

    Rows with one digest are compared byte by byte; where some differ, they are told apart by their bytes.
    """
    digest = _digests(strings)
    order = np.lexsort((digest, group))
    same = (group[order][1:] == group[order][:-1]) & (digest[order][1:] == digest[order][:-1])
    run = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.empty(0, np.int64)
    apart = np.zeros(len(order), np.int64)
    twin = np.flatnonzero(same)
    step = max(1, COMPARED // max(strings.shape[1], 1))
    mixed = set()
    for at in range(0, len(twin), step):
        some = twin[at : at + step]
        differ = (strings[order[some]] != strings[order[some + 1]]).any(axis=1)
        mixed.update(run[some[differ]].tolist())
    for r in mixed:
        rows = np.flatnonzero(run == r)
        seen: dict[bytes, int] = {}
        apart[rows] = [seen.setdefault(strings[order[i]].tobytes(), len(seen)) for i in rows]
    again = np.lexsort((apart, run))
    order, run, apart = order[again], run[again], apart[again]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (run[1:] != run[:-1]) | (apart[1:] != apart[:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(fresh) - 1
    return order[fresh], of


class _Side:
    """Rows sorted by one side of their anchor; ``classes(depth)``: equal numbers agree on that many bytes."""

    def __init__(self, strings: np.ndarray, group: np.ndarray, shallow: int):
        first, self.of = distinct_rows(strings, group)
        order, self.common = deep_shallow(strings[first], group[first], shallow)
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))

    def classes(self, depth: int) -> np.ndarray:
        return np.cumsum(self.common < depth)[self.rank][self.of]


def covered(group: np.ndarray, before: np.ndarray, after: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far before and after its start each anchor's recurring strings reach (0, 0: none recurs).

    ``before`` is read backwards from the anchor; ``left`` and ``right`` say how many bytes are real.
    """
    n = len(group)
    far, near = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    a, b = _Side(after, group, SHALLOW_AFTER), _Side(before, group, SHALLOW_BEFORE)
    for d in range(REACH + 1):
        fit = np.flatnonzero((left >= d) & (right >= SIZE - d))
        if len(fit) < 2:
            continue
        name = a.classes(SIZE - d)[fit] * np.int64(n + 1) + b.classes(d)[fit]
        sort = np.argsort(name, kind="stable")
        same = name[sort][1:] == name[sort][:-1]
        twin = np.zeros(len(fit), bool)
        twin[sort[1:][same]] = True
        twin[sort[:-1][same]] = True
        rows = fit[twin]
        near[rows] = np.where(near[rows] < 0, d, near[rows])
        far[rows] = d
    return np.where(far < 0, 0, far), np.where(far < 0, 0, SIZE - near)


def _anchors(docs: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, cut = bytes_of(part.column("text"))
                grams = SpanHasher(data).windows(ANCHOR)
                at = anchors(grams, cut, SIZE, REACH)
                if len(at):
                    of = np.searchsorted(cut, at, "right") - 1
                    th = part.column("th").to_numpy()[of]
                    own, packed = packed_by_part(grams[at], [grams[at], th, (at - cut[of]).astype(np.uint32)], parts)
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(packed, pa.binary())], ["part", "packed"])

    return docs.select("text", "th").mapInArrow(run, "part int, packed binary")


def _twice(first, counts, columns):
    keep = np.repeat(counts > 1, counts)
    columns[2] = np.where(np.repeat(counts > HOT, counts), columns[2] | _HOT_BIT, columns[2])
    return keep


_KINDS = ["u8", "i8", "u4", "u2", "u2", f"V{SIZE + REACH}"]
_SPANS = "part int, packed binary, strings binary"


def _surroundings(texts: DataFrame, parts: int) -> DataFrame:
    """Per part of anchors one block of suffixes, and per part of strings one block of hashes (of hot anchors)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, cut = bytes_of(part.column("text"))
                places = [places_of(x) for x in part.column("places").to_pylist()]
                of = np.repeat(np.arange(len(places)), [len(p) for p in places])
                places = np.concatenate([np.empty(0, np.int64), *places])
                if not len(places):
                    continue
                hot = places >= int(_HOT_BIT)
                places = places & (int(_HOT_BIT) - 1)
                at = cut[of] + places
                th = part.column("th").to_numpy()[of]
                hasher = SpanHasher(data)
                left = np.minimum(places, REACH)
                right = np.minimum(cut[of + 1] - at, SIZE)
                cold = np.flatnonzero(~hot)
                for block in np.array_split(cold, max(1, len(cold) // 4000)):
                    if not len(block):
                        continue
                    p = at[block]
                    index = p[:, None] + np.arange(-REACH, SIZE)
                    real = (np.arange(-REACH, SIZE) >= -left[block, None]) & (np.arange(-REACH, SIZE) < right[block, None])
                    around = np.where(real, data[np.clip(index, 0, len(data) - 1)], 0).astype(np.uint8)
                    key = hasher.spans(p, p + ANCHOR)
                    columns = [key, th[block], places[block].astype(np.uint32), left[block].astype(np.uint16), right[block].astype(np.uint16), around.view(f"V{SIZE + REACH}").ravel()]
                    own, packed = packed_by_part(key, columns, parts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int32()), pa.array([zstandard.compress(x, 1) for x in packed], pa.binary()), pa.nulls(len(own), pa.binary())],
                        _NAMES,
                    )
                warm = np.flatnonzero(hot)
                if len(warm):
                    first = at[warm] - left[warm]
                    count = np.maximum(0, left[warm] + right[warm] - SIZE + 1)
                    starts = ragged(first, count)
                    text = np.repeat(of[warm], count)
                    starts, keep = np.unique(starts, return_index=True)
                    text = text[keep]
                    if len(starts):
                        key = hasher.spans(starts, starts + SIZE)
                        own, packed = packed_by_part(key, [key, part.column("th").to_numpy()[text], (starts - cut[text]).astype(np.uint32)], parts)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own, pa.int32()), pa.nulls(len(own), pa.binary()), pa.array(packed, pa.binary())], _NAMES
                        )

    return texts.select("text", "th", "places").mapInArrow(run, _SPANS)


_NAMES = ["part", "packed", "strings"]


def _sorted_buckets(blocks: DataFrame, parts: int) -> DataFrame:
    """(th, starts, ends): the spans that recur."""

    def sort(rows: pa.Table) -> pa.Table:
        raw = pa.chunked_array([pa.array([zstandard.decompress(x.as_py()) for x in rows.column("packed")], pa.binary())])
        columns = unpacked(raw, _KINDS)
        order = np.lexsort((columns[2], columns[1], columns[0]))
        key, th, place, left, right, around = (c[order] for c in columns)
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (th[1:] != th[:-1]) | (place[1:] != place[:-1])
        key, th, place, left, right, around = (c[fresh] for c in (key, th, place, left, right, around))
        around = around.view(np.uint8).reshape(len(key), SIZE + REACH)
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        far, near = covered(group, around[:, :REACH][:, ::-1], around[:, REACH:], left.astype(np.int64), right.astype(np.int64))
        hit = near > 0
        place = place[hit].astype(np.int64)
        return dealt_by_text(th[hit], [(place - far[hit]).astype(np.uint32), (place + near[hit]).astype(np.uint32)], parts)

    return by_text(blocks.groupBy("part").applyInArrow(sort, "to int, packed binary"), ["u4", "u4"], ["starts", "ends"])


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, text, copy, starts, ends, places): recurring spans of every row; ``copy``: other rows have this text.

    Texts move by doc_id and text, so copies of one text spread.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = identified(docs)
    firsts, many = copies_of(docs)
    firsts = stored(firsts)
    found = recurring(_anchors(docs, n), ["u8", "i8", "u4"], _twice, n)
    texts = docs.join(stored(firsts.join(found, "th")), ["id", "th"])
    blocks = stored(_surroundings(texts, 4 * n), "none")
    spans = _sorted_buckets(blocks.where("packed IS NOT NULL").select("part", "packed"), n)
    strings = recurring(
        blocks.where("strings IS NOT NULL").select("part", F.col("strings").alias("packed")), ["u8", "i8", "u4"], _twice, n
    )
    verdicts = firsts.join(spans.join(strings, "th", "full"), "th").join(many.select("id", "th", F.lit(True).alias("copy")), ["id", "th"], "full")
    return docs.join(stored(verdicts), ["id", "th"], "left").select(
        "doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "starts", "ends", "places"
    )


def _gone(n: int, copy: bool, starts, ends, places) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a text of ``n`` bytes to remove."""
    if copy and n >= SIZE:
        return np.array([0]), np.array([n])
    starts, ends = (np.frombuffer(x or b"", np.uint32).astype(np.int64) for x in (starts, ends))
    at = places_of(places) & (int(_HOT_BIT) - 1)
    return runs(np.concatenate([starts, at]), np.concatenate([ends, at + SIZE]))


def _applied(rows: DataFrame, emit, schema: str) -> DataFrame:
    kinds = {"long": pa.int64(), "string": pa.utf8(), "binary": pa.binary()}
    names, types = zip(*[x.split() for x in schema.split(", ")], strict=True)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, cut = bytes_of(part.column("text"))
                data, out = data.tobytes(), []
                cols = (part.column(c).to_pylist() for c in ("doc_id", "copy", "starts", "ends", "places"))
                for k, (doc, *found) in enumerate(zip(*cols, strict=True)):
                    text = data[cut[k] : cut[k + 1]]
                    starts, ends = _gone(len(text), *found)
                    kept, last = [], 0
                    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                        kept.append(text[last:a])
                        last = b
                    kept = b"".join([*kept, text[last:]])
                    out.append(emit(doc, len(text), len(text) - len(kept), len(starts), kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*out, strict=True), types, strict=True)], list(names))

    return rows.mapInArrow(run, schema)


def removed_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row of ``docs``; ``kept`` is binary, as a cut may part a character.

    A null text is empty; texts shorter than ``SIZE`` bytes stay.  Every row is a
    place of its own, repeated rows too.
    """
    return _applied(
        removals(docs), lambda *x: x, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def op9_suffix_deep_shallow(spark, sf_dir: str) -> DataFrame:
    """All documents with what is removed of them."""
    return _applied(
        removals(table(spark, sf_dir, "documents")),
        lambda doc, n, gone, spans, kept: (doc, n, gone, spans, hashlib.sha256(kept).hexdigest()),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    )


QUERIES = {"op9_suffix_deep_shallow": op9_suffix_deep_shallow}
ORACLE_SQL: dict[str, str] = {}
