"""Sealed tables: a tree of digests over ranges of keys, and an evaluation that opens only if its root still stands.

A leaf is the digest of the rows of one range of keys, each node the digest of
``FANOUT`` nodes below it, up to one root.  The same rows have the same root, whatever their
order or partitioning; of two trees the leaves that differ name the ranges that changed.  No
task holds more than a leaf.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutframe.operators.guards import assert_target_free
from scoutframe.sources.sinks import stored

#: Keys of a leaf, and nodes below a node.
LEAF_KEYS, FANOUT = 256, 64
#: The leaf of rows without an id.
NO_ID = -(1 << 60)


def row_digest(columns: list[str]) -> Column:
    """A digest of one row: its columns by name, missing values as such, at any depth."""
    whole = F.struct(*[F.col(f"`{c}`") for c in sorted(columns)])
    return F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)


def leaves(df: DataFrame, keys: list[str], ident: str, digest: Column | None = None, width: int = LEAF_KEYS) -> DataFrame:
    """(keys, leaf, low, high, n, digest): the rows of each range of ``width`` whole-number ids, in order of id and digest.

    Repeated rows count as often as they stand there.  Rows without an id lie in a leaf of their own, before all others.
    """
    rows = df.select(*keys, F.col(ident).cast("long").alias("__id"), (digest if digest is not None else row_digest(df.columns)).alias("__h"))
    one = rows.groupBy(*keys, "__id", "__h").agg(F.count("*").alias("__n"))
    leaf = F.coalesce(F.floor(F.col("__id") / width), F.lit(NO_ID).cast("long"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__id", "__h", "__n"))), lambda r: F.concat(r["__h"], F.lit("*"), r["__n"].cast("string"))), ",")
    return one.groupBy(*keys, leaf.alias("leaf")).agg(F.min("__id").alias("low"), F.max("__id").alias("high"), F.sum("__n").alias("n"), F.sha2(text, 256).alias("digest"))


def tree(bottom: DataFrame, keys: list[str], fanout: int = FANOUT) -> DataFrame:
    """(keys, level, node, low, high, n, digest): ``leaves`` as level 0 and all nodes above, up to one root for each key."""
    level = stored(bottom.select(*keys, F.lit(0).alias("level"), F.col("leaf").alias("node"), "low", "high", "n", "digest"))
    out, depth = level, 0
    while (most := level.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > 1:
        depth += 1
        up = F.lit(0).cast("long") if most <= fanout else F.floor(F.col("node") / fanout)
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda r: F.concat(r["node"].cast("string"), F.lit(":"), r["digest"])), ",")
        above = level.groupBy(*keys, up.alias("__up")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sha2(text, 256).alias("digest"))
        level = stored(above.select(*keys, F.lit(depth).alias("level"), F.col("__up").alias("node"), "low", "high", "n", "digest"))
        out = out.unionAll(level)
    return out


def roots(whole: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, root, n): the digest at the top of each tree."""
    top = whole.groupBy(*keys).agg(F.max(F.struct("level", "digest", "n")).alias("t")) if keys else whole.agg(F.max(F.struct("level", "digest", "n")).alias("t"))
    return top.select(*keys, F.col("t.digest").alias("root"), F.col("t.n").alias("n"))


def changed_ranges(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, leaf, low, high, change): leaves of two trees that differ, each "changed", "added" or "removed"."""
    side = lambda df, name: df.where("level = 0").select(*keys, F.col("node").alias("leaf"), F.struct("low", "high", "digest").alias(name))
    both = side(before, "b").join(side(after, "a"), [*keys, "leaf"], "full").where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
    return both.select(*keys, "leaf", F.least("a.low", "b.low").alias("low"), F.greatest("a.high", "b.high").alias("high"), change.alias("change"))


class Tampered(RuntimeError):
    """A sealed table is not what was sealed; ``ranges`` lists (low, high, change) of the leaves that differ."""

    def __init__(self, message: str, ranges: list[tuple]):
        super().__init__(f"{message}: {', '.join(f'{low} to {high} {change}' for low, high, change in ranges[:10])}" if ranges else message)
        self.ranges = ranges


@dataclass
class Seal:
    """Where predictions lie, the tree over them and its root, the rows, and whatever else was fixed (such as digests of configurations)."""

    path: str
    tree_path: str
    root: str
    n: int
    fixed: dict[str, str]


def seal(predictions: DataFrame, path: str, ident: str, fixed: dict[str, str] | None = None) -> Seal:
    """Writes predictions that tell no outcomes, and the tree over what was written."""
    assert_target_free(predictions, "predictions")
    spark = predictions.sparkSession
    predictions.write.mode("errorifexists").parquet(path)
    whole = tree(leaves(spark.read.parquet(path), [], ident), [])
    tree_path = f"{path.rstrip('/')}.tree"
    whole.write.mode("errorifexists").parquet(tree_path)
    top = roots(spark.read.parquet(tree_path), []).first()
    return Seal(path, tree_path, top.root, top.n or 0, dict(fixed or {}))


def unbroken(spark, sealed: Seal, ident: str, fixed: dict[str, str] | None = None) -> DataFrame:
    """The sealed predictions, if nothing of them, of their tree or of what was fixed has changed; else ``Tampered``."""
    if fixed is not None and fixed != sealed.fixed:
        raise Tampered(f"fixed values changed: {', '.join(sorted(k for k in fixed.keys() | sealed.fixed.keys() if fixed.get(k) != sealed.fixed.get(k)))}", [])
    known = spark.read.parquet(sealed.tree_path)
    top = roots(known, []).first()
    if top.root != sealed.root:
        raise Tampered("the tree is not the one that was sealed", [])
    spark.catalog.refreshByPath(sealed.path)
    rows = spark.read.parquet(sealed.path)
    now = tree(leaves(rows, [], ident), [])
    found = roots(now, []).first()
    if (found.root, found.n or 0) != (sealed.root, sealed.n):
        ranges = changed_ranges(known, now, []).orderBy("leaf").select("low", "high", "change").limit(100).collect()
        raise Tampered("predictions changed after they were sealed", [tuple(r) for r in ranges])
    return rows


def gated_evaluation(spark, sealed: Seal, ident: str, targets: Callable[[], DataFrame], evaluate: Callable[[DataFrame], DataFrame], fixed: dict[str, str] | None = None) -> DataFrame:
    """``evaluate`` of the predictions with their targets, which are not read before the seal is found unbroken, nor trusted if it breaks meanwhile."""
    rows = unbroken(spark, sealed, ident, fixed)
    out = stored(evaluate(rows.join(targets(), ident, "left")))
    unbroken(spark, sealed, ident, fixed)
    return out
