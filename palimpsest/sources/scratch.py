"""Tables written to the folder that driver and executors share, to cut lineage between rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:  # a single machine, as in tests
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        named = _LOCAL.get(app) or _LOCAL.setdefault(app, f"file://{tempfile.mkdtemp(prefix='palimpsest-')}")
    return named.rstrip("/")


def rewritten(df: DataFrame, label: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
