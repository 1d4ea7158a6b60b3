"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where unset, a temporary folder for a
    local session and a folder in the warehouse for a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        local = spark.sparkContext.master.startswith("local")
        where = "file://" + tempfile.mkdtemp(prefix="accretio-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_accretio_scratch"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: the lineage ends here, and a lost executor costs only its own tasks."""
    path = f"{shared_dir(df.sparkSession)}/accretio-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
