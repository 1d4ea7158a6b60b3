"""Operator 3: pack documents into as few fixed-size sequences as possible.

Documents longer than a sequence are cut into full pieces, the first taking what
is over. The lengths' histogram, at most one row per length up to the sequence
size, goes to the driver, which solves the configuration program of
``config_lp``. Its answer says which places each length has; every piece finds
its own by its rank among the pieces of its length.

A null text counts as empty: one piece holding the end mark alone. Repeated rows
are packed as rows of their own. No documents give no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_or_null_id, per_batch, split_count, table, written
from .config_lp import Config, pack
from .lengths import ids_of

#: Rows of one length that one task ranks, about.
RANKED = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


def cut(docs: DataFrame, size: int, vocabulary: str | None = None, end: int = 2) -> DataFrame:
    """The pieces of every document, with a checksum of their ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = ids_of(vocabulary)
        ids, numbers, starts, lengths, sums, salts = [], [], [], [], [], []
        for doc, salt, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "salt", "text"))):
            coded = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
            data = memoryview(coded.tobytes())
            first = len(coded) % size or size
            at = 0
            for number, upto in enumerate(range(first, len(coded) + 1, size)):
                ids.append(doc)
                numbers.append(number)
                starts.append(at)
                lengths.append(upto - at)
                sums.append(zlib.crc32(data[4 * at : 4 * upto]))
                salts.append(salt)
                at = upto
        cols = [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())] + [pa.array(x, pa.int64()) for x in (starts, lengths, sums, salts)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(id_or_null_id()).alias("salt"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(per_batch(run), PIECES)


def places(spark: SparkSession, plan: dict[Config, int]) -> DataFrame:
    """Which ranks of a length go where: (length, from, upto, first_sequence, offset).

    One row for each length of each configuration: bounded by the sequence size
    and the program's rounds, not by the documents.
    """
    rows, taken, sequence = [], {}, 0
    for config, times in plan.items():
        offset = 0
        for length, copies in config:
            for _ in range(copies):
                at = taken.get(length, 0)
                rows.append((length, at, at + times, sequence, offset))
                taken[length] = at + times
                offset += length
        sequence += times
    return spark.createDataFrame(rows, "length long, first long, upto long, sequence long, offset long")


def packed(docs: DataFrame, size: int = 1024, vocabulary: str | None = None, end: int = 2) -> DataFrame:
    """One row per piece: where its ids are in the document, and its place in a sequence."""
    spark = docs.sparkSession
    pieces = written(cut(docs, size, vocabulary, end), "pieces")
    by_length = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # size rows at most
    count = np.zeros(size + 1, np.int64)
    for length, n in by_length.items():
        count[length] = n
    salts = split_count(int(count.max()), RANKED, least=int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod("salt", F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = groups.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(before, ["length", "salt"])
    at = F.col("before") + F.col("rank")
    where = F.broadcast(places(spark, pack(count, size)).withColumnRenamed("length", "of"))
    return ranked.join(where, (F.col("length") == F.col("of")) & (at >= F.col("first")) & (at < F.col("upto"))).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + at - F.col("first")).alias("sequence_id"),
        F.col("offset").alias("offset"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
