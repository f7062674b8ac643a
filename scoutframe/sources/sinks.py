"""Writers with one outcome for the same rows: Parquet, CSV, JSON lines and small documents, manifests and templates."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or in local mode, where none is named, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once as Parquet into the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered(df: DataFrame, ident: str) -> DataFrame:
    """Rows by id, columns by name with the id first."""
    return df.select(ident, *sorted(c for c in df.columns if c != ident)).orderBy(ident)


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinities as NULL."""
    return df.select(
        *[
            F.when(F.abs(F.col(f"`{f.name}`")) < float("inf"), F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, DoubleType | FloatType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, ident: str) -> None:
    """A folder of CSV files, each by id; read together and sorted they are the same at every run."""
    ordered(clean_numbers(df), ident).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, ident: str) -> None:
    """A folder of JSON lines by id, keys sorted, NaN as null."""
    ordered(clean_numbers(df), ident).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_document(document: dict, path: str) -> str:
    """A small document such as a configuration or report, keys sorted; returns its digest."""
    text = json.dumps(document, indent=2, sort_keys=True, allow_nan=False)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text + "\n")
    return hashlib.sha256(text.encode()).hexdigest()


def read_document(path: str) -> dict:
    """A small configuration; says what to do where it is not there."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path} is missing: build it first")
    with open(path, encoding="utf-8") as text:
        return json.load(text)


def upsert_manifest(manifest: dict, name: str, entry: dict) -> dict:
    """The manifest with one entry replaced or added; everything else stays."""
    return {**manifest, name: {**manifest.get(name, {}), **entry}}


def template(fields: list[str], example: dict, season: int) -> dict:
    """An import file to fill in: metadata and one example, every field present."""
    return {
        "schemaVersion": 1,
        "metadata": {"dataset_name": "example", "season": season, "population_type": "custom", "draft_size": 60},
        "prospects": [{f: example.get(f) for f in fields}],
    }
