"""Shared helpers: reading tables, scratch tables in the shared folder, sizes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows without an id are one more document, below every real id.
NULL_ID = -(2**63)

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the folder ``sf_dir`` (any URI Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a temporary folder and a
    cluster session a folder below its warehouse.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.startswith("local"):
            where = "file://" + tempfile.mkdtemp(prefix="accretio-")
        else:
            where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_accretio_scratch"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a scratch table in the shared folder, in a folder for each value of ``by``, and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not what came
    before. The folder goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/accretio-{name}-{uuid.uuid4().hex}"
    to = df.write.option("compression", "zstd")
    (to.partitionBy(by) if by else to).parquet(path)
    if not _made:
        atexit.register(clear_scratch)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch() -> None:
    """Delete the scratch tables this driver wrote; no result may still need them."""
    while _made:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended
            continue


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """A mapInArrow function from one that turns a batch into a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return run


def id_or_null_id(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores put before it until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def split_count(rows: int, each: int, least: int = 1, most: int = 1_000_000) -> int:
    """How many parts hold ``rows`` at about ``each`` a part."""
    return int(max(least, min(most, -(-rows // each))))
