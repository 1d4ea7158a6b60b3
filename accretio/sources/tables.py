"""Parameter tables of source templates, and pins that tell when a source's file has changed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ingress import with_parameters

_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:/+"


def parameters(spark: SparkSession, path: str) -> DataFrame:
    """(pos, values): rows of a text table, a map each, in order.

    The first line that isn't blank and doesn't begin with # names the columns;
    values are split at white space, the last taking the rest of its line. Rows
    with too few values are left out. The file is one declaration, read by one
    task. A missing header gives no rows.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\R")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " "))).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    named = lines.withColumn("names", F.split(F.first("line").over(Window.orderBy("pos")), " "))  # one file's lines
    width = F.size("names")
    values = F.split("line", " ")
    rest = F.array_join(F.slice("values", width, F.greatest(F.size("values") - width + 1, F.lit(0))), " ")
    rows = named.withColumn("values", values).where(F.size("values") >= width)
    whole = F.concat(F.slice("values", F.lit(1), width - 1), F.array(rest))
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy("pos")) - 1).where(F.col("rank") > 0)
    return ranked.select("pos", F.map_from_arrays("names", whole).alias("values"))


def instances(spark: SparkSession, template: str, path: str | None = None, inline: list[dict[str, str]] = (), environ: dict[str, str] | None = None) -> list[str]:
    """A template for each row of its table and then of its inline rows."""
    rows = [dict(r["values"]) for r in parameters(spark, path).orderBy("pos").collect()] if path else []  # a declaration's rows
    return with_parameters(template, [*rows, *inline], environ)


def pins(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256): what a declaration pins of its files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))


def drifted(spark: SparkSession, pinned: DataFrame, directory: str) -> DataFrame:
    """(path, problem): pinned files (path below ``directory``, sha256) that are missing or have changed."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    # Spark may write a scheme with one slash or three, so it is taken off both sides
    above = re.sub(_SCHEME, "/", directory).rstrip("/") + "/"
    whole = F.regexp_replace("path", _SCHEME, "/")
    found = there.select(F.substring(whole, len(above) + 1, 1 << 20).alias("path"), F.sha2("content", 256).alias("now"))
    rows = pinned.where(F.col("sha256").isNotNull()).join(found, "path", "left")
    problem = F.when(F.col("now").isNull(), F.lit("missing")).when(F.col("now") != F.col("sha256"), F.lit("changed"))
    return rows.select("path", problem.alias("problem")).where(F.col("problem").isNotNull())
