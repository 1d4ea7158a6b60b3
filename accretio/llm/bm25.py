"""Operator 1: exact top-k search by BM25 over an inverted index in shards.

Terms are runs of letters and digits, lower-cased, known by 64-bit hashes. The
index is a table of shards of bounded size, each built where its documents are
read. Document frequencies, the number of documents and their mean length are
summed over all shards, so a score doesn't depend on how documents are dealt to
shards, and the shards' best lists merge into the exact result.

A query is a text; each distinct term counts once, with the weight
ln(1 + (N - df + 0.5) / (df + 0.5)). Results are the k documents of highest
positive score, ties by least id. Queries go to all shards in blocks of bounded
size, two jobs a block, so what a task holds doesn't grow with them.

A null text counts as empty: as a document it is found by no query, as a query
it finds nothing. Rows that share an id are documents of their own; rows without
an id are indexed as the id below all others and given back as null. Query rows
that share an id are one query of all their terms; those without an id are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bm25_index import Queries, Shard
from .common import NULL_ID, id_or_null_id, table, written

#: Documents and characters a shard takes, about; queries a block, and their terms in all;
#: of so many shards one gives first thresholds.
SHARD_DOCS, SHARD_CHARS, QUERY_BLOCK, QUERY_TERMS = 3072, 10_000_000, 16_384, 4_000_000
FLOOR_SHARDS = 8
_TERM = re.compile(r"[^\W_]+")
_KNOWN = 50_000


class Terms:
    """Texts to distinct term hashes with frequencies, with a bounded table of terms met."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words, known = _TERM.findall((text or "").lower()), self.known
        try:
            hashes = [known[w] for w in words]
        except KeyError:
            if len(known) > _KNOWN:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            hashes = [known[w] for w in words]
        terms, counts = np.unique(np.array(hashes, np.uint64), return_counts=True)
        return terms, counts.astype(np.uint32)


_terms = Terms()


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int] = []
    counted: list[tuple[np.ndarray, np.ndarray]] = []
    chars = 0

    def made() -> pa.RecordBatch:
        s = Shard.build(ids, counted)
        return pa.RecordBatch.from_arrays(
            [pa.array([len(ids)], pa.int64()), pa.array([int(s.lengths.sum())], pa.int64()), pa.array([s.to_bytes()], pa.binary())], ["n", "length", "shard"]
        )

    for batch in batches:
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
            ids.append(doc)
            counted.append(_terms.counted(text))
            chars += len(text or "")
            if len(ids) >= SHARD_DOCS or chars >= SHARD_CHARS:
                yield made()
                ids, counted, chars = [], [], 0
    if ids:
        yield made()


def index(docs: DataFrame) -> DataFrame:
    """(n, length, shard): a row for each shard, written to the shared folder."""
    rows = docs.select(id_or_null_id().alias("doc"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_sharded, "n long, length long, shard binary"), "shards")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("shard"):
            s = Shard.from_bytes(blob.as_buffer())
            df = s.document_frequencies()
            for i in range(0, len(df), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(s.terms[i : i + 200_000].view(np.int64)), pa.array(df[i : i + 200_000])], ["term", "df"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counted = [_terms.counted(t)[0].view(np.int64) for t in batch.column("text").to_pylist()]
        if sum(map(len, counted)):
            ids = np.repeat(batch.column("query").to_numpy(), [len(c) for c in counted])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(counted))], ["query", "term"])


def _merged(best: tuple[np.ndarray, np.ndarray], docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    docs, scores = np.append(best[0], docs), np.append(best[1], scores)
    top = np.lexsort((docs, -scores))[:k]
    return docs[top], scores[top]


def _floors(asked, k: int, mean_length: float):
    """A task's k highest floors for each query, however many shards it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, _ = asked.value
        best = np.zeros((len(ids), k))
        for batch in batches:
            for blob in batch.column("shard"):
                found = Shard.from_bytes(blob.as_buffer()).ready(mean_length).floors(queries, k)
                best = -np.sort(-np.concatenate([best, found], axis=1), axis=1)[:, :k]
        some = best > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, some.sum(1))), pa.array(best[some])], ["query", "floor"])

    return run


def _searched(asked, k: int, mean_length: float, blocks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, least = asked.value
        least, best = least.copy(), [(np.empty(0, np.int64), np.empty(0))] * len(ids)
        for batch in batches:
            for blob in batch.column("shard"):
                shard = Shard.from_bytes(blob.as_buffer()).ready(mean_length)
                for q, docs, scores in shard.search(queries, k, least):
                    best[q] = _merged(best[q], docs, scores, k)
                    if len(best[q][1]) == k:
                        least[q] = max(least[q], best[q][1][-1])
                blocks.add(np.array([shard.scored, shard.there]))
                del shard  # before the next is made ready
        sizes = [len(d) for d, _ in best]
        docs, scores = (np.concatenate([x[i] for x in best]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(docs), pa.array(scores)], ["query", "doc", "score"])

    return run


class _Sum(AccumulatorParam):
    def zero(self, value):
        return value * 0

    def addInPlace(self, one, two):
        return one + two


@dataclass
class Pruning:
    """Blocks scored and blocks there were, summed over queries and shards (a task that is run again counts again)."""

    scored: int = 0
    there: int = 0


def _vectors(shards: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(query, terms, block): each query's terms in order with their weights, dealt to blocks of bounded size."""
    asked = rows.mapInArrow(_query_terms, "query long, term long").distinct()
    df = shards.select("shard").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    unsigned = F.when(F.col("term") < 0, F.col("term") - F.lit(NULL_ID)).otherwise(F.col("term") + F.lit(NULL_ID))  # in the order of unsigned hashes
    pair = F.struct(unsigned.alias("place"), "term", weight.alias("weight"))
    vectors = written(asked.join(df, "term").groupBy("query").agg(F.sort_array(F.collect_list(pair)).alias("terms")), "vectors")
    size = vectors.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("terms")).first()
    blocks = max(1, math.ceil(size["n"] / QUERY_BLOCK), math.ceil((size["terms"] or 0) / QUERY_TERMS))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    return written(dealt.repartition(blocks, "block"), "blocks", by="block")


def search(shards: DataFrame, queries: DataFrame, k: int = 10, pruning: Pruning | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents for each row of ``queries`` (query_id, text).

    Each block of queries takes two passes: the first finds for every query a score that
    k documents of some of the shards reach, the second goes over all and skips what stays below.
    """
    spark = shards.sparkSession
    totals = shards.agg(F.sum("n").alias("n"), F.sum("length").alias("length"), F.count("*").alias("shards")).first()
    n, mean_length = totals["n"] or 0, (totals["length"] or 0) / max(totals["n"] or 0, 1)
    rows = queries.select(F.col("query_id").cast("long").alias("query"), F.col("text").cast("string").alias("text")).where(F.col("query").isNotNull())
    vectors = _vectors(shards, rows, n)
    parts, every = [], max(1, min(FLOOR_SHARDS, totals["shards"] // 4))
    some = shards.where(F.pmod(F.xxhash64("n", "length"), F.lit(every)) == 0).select("shard")
    for block in sorted(r["block"] for r in vectors.select("block").distinct().collect()):  # one row for QUERY_BLOCK queries
        own = vectors.where(F.col("block") == block).select("query", F.transform("terms", lambda t: t["term"]).alias("terms"), F.transform("terms", lambda t: t["weight"]).alias("weights")).toArrow().combine_chunks()
        terms, weights = (pa.concat_arrays(own[c].chunks) for c in ("terms", "weights"))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy())]).astype(np.int64)
        order, asked = Queries.of(ends, terms.flatten().to_numpy().view(np.uint64), weights.flatten().to_numpy())
        ids = own["query"].to_numpy()[order]
        sent = spark.sparkContext.broadcast((ids, asked, None))
        floors = some.mapInArrow(_floors(sent, k, mean_length), "query long, floor double")
        best = Window.partitionBy("query").orderBy(F.col("floor").desc())
        kth = dict(map(tuple, floors.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query", "floor").collect()))  # a row a query
        sent = spark.sparkContext.broadcast((ids, asked, np.array([kth.get(q, 0.0) for q in ids.tolist()])))
        blocks = spark.sparkContext.accumulator(np.zeros(2, np.int64), _Sum())
        hits = shards.select("shard").mapInArrow(_searched(sent, k, mean_length, blocks), "query long, doc long, score double")
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc")
        parts.append(written(hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "hits"))
        if pruning is not None:
            pruning.scored, pruning.there = pruning.scored + int(blocks.value[0]), pruning.there + int(blocks.value[1])
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    both = reduce(DataFrame.unionByName, parts)
    return both.select(F.col("query").alias("query_id"), "rank", F.nullif("doc", F.lit(NULL_ID)).alias("doc_id"), "score")


def op1_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search(index(docs), queries).select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), len AS (
  SELECT d.doc_id, coalesce(n, 0) AS n FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id) w ON d.doc_id = w.doc_id
), stats AS (
  SELECT count(*) AS n, avg(n) AS mean FROM len
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), hits AS (
  SELECT q.doc_id AS query_id, t.doc_id,
         sum(ln(1 + (s.n - df.df + 0.5) / (df.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * len.n / s.mean))) AS score
  FROM tf q JOIN tf t ON q.term = t.term JOIN df ON df.term = q.term JOIN len ON len.doc_id = t.doc_id CROSS JOIN stats s
  WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, t.doc_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, score FROM hits
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 4) AS score FROM ranked WHERE rank <= 10
"""
