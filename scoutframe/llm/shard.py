"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has a fixed number of virtual nodes at 64-bit places of a hash ring,
and each owns the arc up to its place from the node before.  A shard's nodes stand
where they stand whatever the number of shards, so with one shard more only the
rows in the new nodes' arcs get another home.  A row
goes to the owner of its arc; where that shard is already full, it continues
clockwise to the next arc whose owner still has room.  Capacities add up to the
number of rows and differ by one at most, so the balance is exact, and only the
rows that overflow leave the place that the plain ring gives them.

Only counts per arc reach the driver (``shards * virtual_nodes`` numbers,
whatever the input); it lays them on the ring and returns, per arc, the runs of
ranks that each shard takes.  Rows find their run by their rank within the arc.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoutframe.llm._shared import stored, table

_RUNS = "arc int, first long, last long, shard int, base_slot long"


def _mix(x: int) -> int:
    """A fixed 64-bit mixing step (splitmix), for the places of virtual nodes."""
    x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def ring_nodes(shards: int, virtual_nodes: int) -> tuple[list[int], list[int]]:
    """Places (signed 64-bit) and owners of the ``shards * virtual_nodes`` virtual nodes, clockwise."""
    nodes = sorted((_mix(s * 1_000_003 + v) - (1 << 63), s) for s in range(shards) for v in range(virtual_nodes))
    return [p for p, _ in nodes], [s for _, s in nodes]


def with_arcs(df: DataFrame, place: str, places: list[int]) -> DataFrame:
    """Adds ``__arc`` int: the first node at or after ``place`` (long); behind the last node the ring begins again.

    The ring is cut into equal cells of which each holds few nodes, so a row is compared with those of its cell only.
    """
    bits = max(1, len(places).bit_length())
    cells: list[list[int]] = [[] for _ in range(1 << bits)]
    for p in places:
        cells[(p + (1 << 63)) >> (64 - bits)].append(p)
    before, rows = 0, []
    for c, own in enumerate(cells):
        rows.append((c, before, own))
        before += len(own)
    known = df.sparkSession.createDataFrame(rows, "__cell int, __before int, __nodes array<long>")
    # a table of fixed size
    cell = (F.shiftrightunsigned(place, 64 - bits).bitwiseXOR(F.lit(1 << (bits - 1)))).cast("int")
    arc = F.col("__before") + F.size(F.filter("__nodes", lambda p: p < F.col(place)))
    out = df.withColumn("__cell", cell).join(F.broadcast(known), "__cell")
    return out.withColumn("__arc", F.pmod(arc, F.lit(len(places))).cast("int")).drop("__cell", "__before", "__nodes")


def lay_out(counts: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first rank, last rank, shard, slot of the first) under exact capacities.

    Arcs are served clockwise.  First every owner takes what it has room for from
    its own arcs, then what is left over walks on clockwise.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    runs, over = [], []
    for arc, owner in enumerate(owners):
        n = counts.get(arc, 0)
        take = min(n, room[owner] - used[owner])
        if take:
            runs.append((arc, 0, take - 1, owner, used[owner]))
            used[owner] += take
        if n > take:
            over.append((arc, take, n))
    for arc, first, n in over:
        at = arc
        while first < n:
            at = (at + 1) % len(owners)
            s = owners[at]
            take = min(n - first, room[s] - used[s])
            if take:
                runs.append((arc, first, first + take - 1, s, used[s]))
                used[s] += take
                first += take
    return runs


#: Rows of one arc beyond this many are ranked in several groups.
RANK_GROUP = 50_000


def shard_rows(df: DataFrame, key: str, shards: int = 24, virtual_nodes: int = 128) -> DataFrame:
    """Adds ``shard`` int, ``slot`` long (gapless from 0 in each shard) and ``home_shard`` int (of the plain ring).

    Columns of these names that came in give way, others stay, whatever their names.
    Rows with equal keys share an arc and may be parted by a full shard; a null
    key is a key like any other, and repeated rows have places of their own.  An empty input gives an empty result.
    Within an arc, rows are ranked by a hash of their columns; an arc with many rows is ranked
    in several groups, so a key of a third of all rows is no single task.
    """
    spark = df.sparkSession
    places, owners = ring_nodes(shards, virtual_nodes)
    place = F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\0null")), F.lit("ring"))
    whole = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(F.struct(*whole).alias("__row"), F.xxhash64(*whole).alias("__hash"), place.alias("__place"))
    placed = stored(with_arcs(rows, "__place", places).drop("__place"))
    counts = {r[0]: r[1] for r in placed.groupBy("__arc").count().collect()}
    runs = spark.createDataFrame(lay_out(counts, owners, shards), _RUNS)
    salts = spark.createDataFrame([(a, -(-n // RANK_GROUP)) for a, n in counts.items()], "__arc int, __salts int")
    # a table of fixed size
    salted = placed.join(F.broadcast(salts), "__arc").withColumn("__salt", F.pmod(F.shiftrightunsigned("__hash", 20), F.col("__salts"))).drop("__salts")
    before = Window.partitionBy("__arc").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        salted.groupBy("__arc", "__salt")
        .agg(F.count("*").alias("__n"))
        .select("__arc", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    own = Window.partitionBy("__arc", "__salt").orderBy("__hash")
    ranked = (
        salted.withColumn("__rank", F.row_number().over(own) - F.lit(1))
        .join(groups, ["__arc", "__salt"])
        .withColumn("__rank", F.col("__rank") + F.col("__before"))
    )
    # at most one run for each arc and shard: a fixed bound, so the table is broadcast
    out = ranked.join(
        F.broadcast(runs),
        (F.col("__arc") == F.col("arc")) & (F.col("__rank") >= F.col("first")) & (F.col("__rank") <= F.col("last")),
    )
    home = F.element_at(F.array(*[F.lit(s) for s in owners]), F.col("__arc") + 1)
    return out.select(
        *[F.col("__row")[c].alias(c) for c in df.columns if c not in ("shard", "slot", "home_shard")],
        F.col("shard"),
        (F.col("base_slot") + F.col("__rank") - F.col("first")).alias("slot"),
        home.alias("home_shard"),
    )


def op10_shard_ring(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 with counts at most one apart (law ``rows``)."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard_rows(docs, "doc_id", 24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "home_shard",
    )


QUERIES = {"op10_shard_ring": op10_shard_ring}
ORACLE_SQL: dict[str, str] = {}
