"""Season files read only when they changed: digests of files against a manifest, and seasons rewritten one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutframe.sources.tables import optional, seasons

_MANIFEST = "path string, season int, bytes long, sha256 string"


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, season, bytes, sha256) of all files of a pattern; the season is the year at the end of the name."""
    files = spark.read.format("binaryFile").load(pattern)
    season = F.regexp_extract("path", r"_(\d{4})\.parquet", 1).try_cast("int")
    return files.select("path", season.alias("season"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """What was read last; empty before the first time."""
    found = optional(spark.read.schema(_MANIFEST).parquet, path)
    return found if found is not None else spark.createDataFrame([], _MANIFEST)


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, season, change): files that are new, changed or gone."""
    a, b = now.select("path", "season", F.col("sha256").alias("a")), before.select("path", F.col("season").alias("__s"), F.col("sha256").alias("b"))
    both = a.join(b, "path", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    change = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").otherwise("changed")
    return both.select("path", F.coalesce("season", "__s").alias("season"), change.alias("change"))


def refreshed(spark: SparkSession, pattern: str, out: str, transform: Callable[[DataFrame], DataFrame], schema: str | None = None) -> list[tuple[int, str]]:
    """Rewrites the seasons of ``out`` (partitioned by season) whose files changed, and returns (season, change) of these.

    A season is read whole, from all of its files, if any of them changed; seasons without a change are neither read nor
    written, and a season whose files are all gone is emptied.  The manifest beside ``out`` is
    written last: a run that breaks off is repeated by the next one.  ``transform`` takes rows with ``season`` and keeps it.
    """
    record = f"{out.rstrip('/')}.manifest"
    now, before = file_digests(spark, pattern).cache(), manifest(spark, record)
    try:
        found = changes(now, before).groupBy("season").agg(F.array_join(F.sort_array(F.collect_set("change")), "+").alias("change")).where("season IS NOT NULL").orderBy("season").collect()
        if not found:
            return []
        dirty = [r.season for r in found]
        paths = [r.path for r in now.where(F.col("season").isin(dirty)).select("path").collect()]  # a name for each changed file
        written = {r.season for r in now.where(F.col("season").isin(dirty)).select("season").distinct().collect()}
        if paths:
            rows = transform(seasons(spark, paths, schema))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(out)
        if gone := [s for s in dirty if s not in written]:
            # dynamic overwrite never removes a partition
            hadoop = spark._jvm.org.apache.hadoop.fs.Path
            for season in gone:
                folder = hadoop(f"{out.rstrip('/')}/season={season}")
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        rows = [tuple(r) for r in now.select("path", "season", "bytes", "sha256").collect()]
        spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(record)
        return [(r.season, r.change) for r in found]
    finally:
        now.unpersist()
