"""Operator 4: reversible line deduplication.

A line's key is the line without the white space at both ends, A-Z lower-cased.
Keys of at least MIN_CHARS code points held by at least MIN_DOCS documents lose
all their lines, except in the document of the largest id that holds them.

``LineIndex`` keeps what makes this incremental: which document holds which key
(as 128-bit digests), exact reference counts by key, and one cuckoo filter per
shard of the keys that have come to be repeated. Inserting documents adds to
counts and filters; deleting documents takes from both, so that an index from
which documents were deleted cleans like one that never held them.

A null or empty text is one empty line. Rows without an id count together as one
document below all others. Rows that share an id are one document when holders
are counted, and each keeps or loses its own lines. Columns other than doc_id
and text pass through ``cleaned``, but for those it adds, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, id_or_null_id, per_batch, split_count, table, written
from .cuckoo import CuckooFilter

MIN_CHARS, MIN_DOCS = 20, 3
#: Repeated keys a shard is meant to hold, and held keys that are looked up in one place, about.
SHARD_KEYS, TOGETHER = 50_000, 500_000


def line_keys(text: str | None) -> list[bytes]:
    """A digest for each line of ``text``; an empty one for lines too short to count."""
    out = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip().lower()  # on bytes: ASCII white space and letters only
        size = len(key)
        if size < MIN_CHARS or (size < 4 * MIN_CHARS and not key.isascii() and len(key.decode()) < MIN_CHARS):
            out.append(b"")
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


def _keyed(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    digests, counts = [], []
    for text in batch.column("text").to_pylist():
        own = set(line_keys(text))
        own.discard(b"")
        digests.extend(own)
        counts.append(len(own))
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    holders = np.repeat(batch.column("doc").to_numpy(), counts)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(holders)], ["h1", "h2", "doc"])


def held_keys(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc): the keys that count, once for each row that holds them."""
    rows = docs.select(id_or_null_id().alias("doc"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(per_batch(_keyed), "h1 long, h2 long, doc long")


def counted(held: DataFrame) -> DataFrame:
    """(h1, h2, refs, keeper). The distinct count is dealt by key and document first."""
    return held.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("refs"), F.max("doc").alias("keeper"))


def _shard(shards: int):
    """From the high bits: a filter's buckets come from the low ones."""
    return F.pmod(F.shiftrightunsigned("h1", 40), F.lit(shards)).cast("int")


@dataclass(frozen=True)
class LineIndex:
    """held: key and document; counts: exact references; filters: a cuckoo filter per shard."""

    held: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = MIN_DOCS

    @staticmethod
    def build(docs: DataFrame, min_docs: int = MIN_DOCS) -> LineIndex:
        held = written(held_keys(docs), "held")
        repeated = written(counted(held).where(F.col("refs") > 1), "counts")
        return LineIndex(held, repeated, *_new_filters(repeated, min_docs), min_docs)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index after adding documents; those it already holds may come again."""
        new = held_keys(docs).distinct().join(self.held, ["h1", "h2", "doc"], "left_anti")
        return self._changed(self.held.unionByName(new), new)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index after taking out the documents in the column doc_id of ``ids``."""
        gone = ids.select(id_or_null_id().alias("doc")).distinct()
        return self._changed(self.held.join(gone, "doc", "left_anti"), self.held.join(gone, "doc", "left_semi"))

    def _changed(self, held: DataFrame, touched: DataFrame) -> LineIndex:
        held = written(held, "held")
        keys = written(touched.select("h1", "h2").distinct(), "touched")
        again = counted(held.join(keys, ["h1", "h2"], "left_semi")).where(F.col("refs") > 1)
        counts = written(self.counts.join(keys, ["h1", "h2"], "left_anti").unionByName(again), "counts")
        before = self.counts.where(F.col("refs") >= self.min_docs).select("h1", "h2")
        now = counts.where(F.col("refs") >= self.min_docs).select("h1", "h2")
        moved = (
            now.join(before, ["h1", "h2"], "left_anti").withColumn("add", F.lit(True))
            .unionByName(before.join(now, ["h1", "h2"], "left_anti").withColumn("add", F.lit(False)))
            .withColumn("shard", _shard(self.shards))
        )

        def turned(key, old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter(len(change))
            for add in (False, True):
                part = change[change["add"] == add]
                (f.insert if add else f.delete)(part["h1"].to_numpy(np.int64), part["h2"].to_numpy(np.int64))
            return pd.DataFrame({"shard": [int(key[0])], "filter": [f.to_bytes()]})

        if now.count() > 2 * SHARD_KEYS * self.shards:
            return LineIndex(held, counts, *_new_filters(counts, self.min_docs), self.min_docs)
        filters = self.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(turned, "shard int, filter binary")
        return LineIndex(held, counts, written(filters, "filters"), self.shards, self.min_docs)

    def repeated(self, held: DataFrame) -> DataFrame:
        """(doc, drop): for each document that loses lines, the digests of their keys.

        A shard's filter, its exact counts and the held keys of the shard meet in
        one task, in this order, and stream through it. A shard with very many
        held keys, as that of a line found everywhere, is dealt over several tasks
        by document, each with the filter and the counts.
        """
        exact = self.counts.where(F.col("refs") >= self.min_docs).withColumn("shard", _shard(self.shards))
        rows = held.withColumn("shard", _shard(self.shards))
        parts = rows.groupBy("shard").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
        large = written(parts.where("parts > 1"), "large")  # TOGETHER rows at least for each, so they are few
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))
        empty = {"h1": F.lit(0).cast("long"), "h2": F.lit(0).cast("long"), "doc": F.lit(0).cast("long"), "filter": F.lit(None).cast("binary")}

        def joined(side: DataFrame, rank: int, part) -> DataFrame:
            more = {c: empty[c] for c in empty if c not in side.columns}
            placed = side.join(large, "shard", "left").withColumns(more)
            return placed.select("shard", part.alias("part"), F.lit(rank).alias("rank"), *empty)

        own = F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("doc"), F.col("parts")))
        sides = joined(self.filters, 0, part).unionByName(joined(exact.withColumnRenamed("keeper", "doc"), 1, part)).unionByName(joined(rows, 2, own))
        dealt = sides.repartition("shard", "part").sortWithinPartitions("shard", "part", "rank")
        lost = dealt.mapInArrow(_settled, "h1 long, h2 long, doc long")
        return lost.groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))

    def cleaned(self, docs: DataFrame, held: DataFrame | None = None) -> DataFrame:
        """``docs`` with lines dropped, and n_lines, n_dropped and kept_sha256.

        held: the documents' own keys, if they have been made before.
        """
        drops = self.repeated(held_keys(docs) if held is None else held)
        added = ["n_lines", "n_dropped", "kept_sha256"]
        kept = [c for c in docs.columns if c not in added]
        doc, drop = free_names(docs, "doc", "drop")
        rows = docs.select(*kept, id_or_null_id().alias(doc)).join(drops.select(F.col("doc").alias(doc), F.col("drop").alias(drop)), doc, "left")
        rows = rows.select(*kept, drop)
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != drop), "n_lines long", "n_dropped long", "kept_sha256 string"])
        return rows.mapInArrow(per_batch(partial(_cleaned, drop=drop)), schema)


def _new_filters(counts: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    keys = counts.where(F.col("refs") >= min_docs).select("h1", "h2")
    shards = split_count(keys.count(), SHARD_KEYS, least=16)

    def made(key, rows: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter(len(rows))
        f.insert(rows["h1"].to_numpy(np.int64), rows["h2"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [int(key[0])], "filter": [f.to_bytes()]})

    filters = keys.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(made, "shard int, filter binary")
    return written(filters, "filters"), shards


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard and part: a filter, exact keys with their keepers, and held keys. Gives the held ones that go."""
    at, known, keepers, f = None, {}, None, None
    for batch in batches:
        shard, part, rank, h1, h2, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "part", "rank", "h1", "h2", "doc"))
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0) | (np.diff(rank) != 0)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            here = (shard[low], part[low])
            if here != at:
                at, f, known, keepers = here, None, [], None
            if rank[low] == 0:
                f = CuckooFilter.from_bytes(batch.column("filter")[low].as_py())
                continue
            one, two, own = (x[low:high].astype(np.int64) for x in (h1, h2, doc))
            if rank[low] == 1:
                known.append(np.stack([one, two, own]))
                continue
            if f is None or not known:
                continue
            if keepers is None:
                keepers = np.concatenate(known, axis=1)
                keepers = keepers[:, np.argsort(keepers[0], kind="stable")]
            maybe = np.flatnonzero(f.contains(one, two))
            # exact: the run of equal first numbers is nearly always one long
            place, last = (np.searchsorted(keepers[0], one[maybe], side) for side in ("left", "right"))
            keep = np.zeros(len(maybe), bool)
            for step in range(int((last - place).max(initial=0))):
                k = np.minimum(place + step, keepers.shape[1] - 1)
                keep |= (place + step < last) & (keepers[1, k] == two[maybe]) & (keepers[2, k] != own[maybe])
            if keep.any():
                gone = maybe[keep]
                yield pa.RecordBatch.from_arrays([pa.array(one[gone]), pa.array(two[gone]), pa.array(own[gone])], ["h1", "h2", "doc"])


def _cleaned(batch: pa.RecordBatch, drop: str) -> pa.RecordBatch:
    texts, n_lines, n_dropped, digests = [], [], [], []
    for text, keys in zip(batch.column("text").to_pylist(), batch.column(drop).to_pylist()):
        text, before = text or "", 0
        if keys:
            lost = set(np.array([(d["h1"], d["h2"]) for d in keys], "<i8").view("V16").ravel().tolist())
            lines = text.split("\n")
            before = len(lines)
            lines = [line for line, key in zip(lines, line_keys(text)) if key not in lost]
            text = "\n".join(lines)
            n_dropped.append(before - len(lines))
        else:
            before = text.count("\n") + 1
            n_dropped.append(0)
        n_lines.append(before)
        texts.append(text)
        digests.append(sha256(text.encode()).hexdigest())
    names = [n for n in batch.schema.names if n != drop]
    columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests)], [*names, "n_lines", "n_dropped", "kept_sha256"]
    )


def deduplicated(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with repeated lines dropped, by an index built from these documents."""
    index = LineIndex.build(docs, min_docs)
    return index.cleaned(docs, index.held)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), repeated AS (
  SELECT line_key, max(doc_id) AS keeper FROM lines WHERE length(line_key) >= 20
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT l.doc_id, l.pos, l.line, (r.line_key IS NOT NULL AND r.keeper <> l.doc_id) AS dropped
  FROM lines l LEFT JOIN repeated r ON l.line_key = r.line_key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
