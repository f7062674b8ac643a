"""Session settings, tables and shared folders used by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: ASCII white space between words, as a Java regular expression.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode, where it names none, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows, written once as Parquet into the shared folder and read back.

    This cuts lineage: later stages survive the loss of any executor, and what
    ran before is never computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class appended:
    """Rows added to one written table, piece by piece: ``appended(more, before)`` adds to ``before``, or begins a table."""

    def __init__(self, df: DataFrame, before: "appended | None" = None):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = before.path if before else f"{shared_dir(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.mode("append").option("compression", "zstd").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)
