"""Operator 2: exact token counts from a length histogram.

Documents are aggregated by encoded length once; suffix sums over the lengths
then answer totals, quantiles and truncated totals for every context limit. A
null text counts as empty and has length 0; no documents give no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import per_batch, table, written
from .lengths import ids_of

#: Lengths whose sums one task makes; a second, smaller step adds up the blocks.
BLOCK = 64


def with_length(docs: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """One column, ``length``: the number of ids of each row's text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = ids_of(vocabulary)
        return pa.RecordBatch.from_arrays([pa.array([len(encode(t or "")) for t in batch.column(0).to_pylist()], pa.int64())], ["length"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(per_batch(run), "length long")


def histogram(docs: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """(length, n_docs): summed within each task first, so a frequent length is no hot key."""
    return with_length(docs, vocabulary, text).groupBy("length").agg(F.count("*").alias("n_docs"))


def answers(hist: DataFrame) -> DataFrame:
    """For each length that occurs, as a context limit: what the histogram says.

    docs_within, tokens_within: documents no longer, and their tokens.
    docs_beyond: longer documents. truncated_total: tokens kept if every document
    is cut to the limit. tokens_total: all tokens. quantile: docs_within as a
    share of all documents.
    """
    blocks = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("block", F.expr(f"length div {BLOCK}")).withColumn("tokens", F.col("length") * F.col("n_docs"))
    by_block = h.groupBy("block").agg(F.sum("n_docs").alias("n"), F.sum("tokens").alias("t"))
    before = by_block.select(
        "block",
        F.coalesce(F.sum("n").over(blocks), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("t").over(blocks), F.lit(0)).alias("t_before"),
        F.sum("n").over(Window.partitionBy()).alias("n_all"),
        F.sum("t").over(Window.partitionBy()).alias("t_all"),
    )
    return (
        h.join(before, "block")
        .withColumn("docs_within", F.col("n_before") + F.sum("n_docs").over(own))
        .withColumn("tokens_within", F.col("t_before") + F.sum("tokens").over(own))
        .select(
            "length",
            "n_docs",
            "docs_within",
            "tokens_within",
            (F.col("n_all") - F.col("docs_within")).alias("docs_beyond"),
            (F.col("tokens_within") + F.col("length") * (F.col("n_all") - F.col("docs_within"))).alias("truncated_total"),
            F.col("t_all").alias("tokens_total"),
            (F.col("docs_within") / F.col("n_all")).alias("quantile"),
        )
    )


def truncated_totals(answered: DataFrame, contexts: list[int]) -> DataFrame:
    """(context, truncated_total): tokens kept if every text is cut to the context's length.

    The tokens within the longest length not beyond it, and the context once for
    each longer document; one pass over the answers for all contexts. A context
    below 0 counts as 0.
    """
    within = F.struct("length", "tokens_within", "docs_beyond")
    last = [F.max(F.when(F.col("length") <= c, within)).alias(f"c{i}") for i, c in enumerate(contexts)]
    one = answered.agg(F.coalesce(F.max("docs_within"), F.lit(0)).alias("n_all"), *last)
    rows = []
    for i, c in enumerate(contexts):
        cut = F.lit(max(c, 0)).cast("long")
        total = F.coalesce(F.col(f"c{i}.tokens_within") + cut * F.col(f"c{i}.docs_beyond"), cut * F.col("n_all"))
        rows.append(F.struct(F.lit(c).cast("long").alias("context"), total.alias("truncated_total")))
    return one.select(F.inline(F.array(*rows)))


def quantile_lengths(answered: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least this share of the documents doesn't exceed."""
    least = [F.min(F.when(F.col("quantile") >= s, F.col("length"))).alias(f"q{i}") for i, s in enumerate(shares)]
    rows = [F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("length")) for i, s in enumerate(shares)]
    return answered.agg(*least).select(F.inline(F.array(*rows)))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(written(histogram(table(spark, sf_dir, "documents")), "lengths"))
