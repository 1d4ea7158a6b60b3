"""Operator 8: near-duplicates by BagMinHash signatures, bands and verification.

Two documents are linked if the weighted Jaccard similarity of their shingle
multisets (five words, lower-cased) is at least 0.8. Classes are the connected
components of the links.

1. Documents of the same words are one text; each text gets a signature, cut into
   bands. Texts that share a band are in a bucket.
2. In small buckets all pairs are candidates; in larger ones each member with two
   centres, so that the candidates grow with the members, not with their pairs.
   Candidates are verified on the whole multisets.
3. Where a large bucket still holds more than one component, its members outside
   their cluster's largest component are compared with the whole cluster, block
   by block: a task gets one block of either side and returns only links between
   components. So no link between bucket members is lost, whatever their number.

A pair of similarity s shares a bucket with probability 1 - (1 - s**ROWS)**BANDS:
over 0.9999 at 0.8. A null text counts as empty. Texts without words link to
nothing. Texts of one to four words have one shingle of all their words. Rows
that share an id are one document. Rows without an id are known by their text:
those of one text are one document, those of several are several.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bagminhash import Shingler, bands, overlap, signatures
from .common import NULL_ID, free_names, per_batch, table, written
from .components import components

SIMILARITY, WORDS = 0.8, 5
BANDS, ROWS = 56, 8
#: Members up to which a bucket gives all its pairs, and texts a block.
SMALL, BLOCK = 16, 512
#: Texts whose shingles are kept together while signatures are made.
CHUNK = 64
#: 64-bit words of the Bloom filter that finds the rows to read again: a fixed
#: size. If it fills, more rows pass, and the join by id that follows drops them.
BLOOM_WORDS = 1 << 20

#: Ids below this one are kept for rows without an id, from a hash of their text.
NAMED = NULL_ID + (1 << 61)

_shingler = Shingler(WORDS)


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _signed(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch.column("text").to_pylist()
    digests, sizes, parts = [], [], []
    for i in range(0, len(texts), CHUNK):
        shingles = []
        for text in texts[i : i + CHUNK]:
            words = _words(text)
            digests.append(xxhash.xxh3_128_digest(" ".join(words).encode()))
            shingles.append(_shingler.shingles(words))
            sizes.append(len(shingles[-1]))
        parts.append(bands(signatures(shingles, BANDS * ROWS), ROWS))
    both, sized = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2), np.array(sizes)
    all_bands, full = np.concatenate(parts), sized > 0
    ends = np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(all_bands[full].ravel()))
    return pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sized), lists], ["doc", "d1", "d2", "n", "bands"])


def _doc() -> Column:
    """A row's id, or below all ids a number from its text."""
    unnamed = F.lit(NULL_ID) + F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), 3)
    return F.coalesce(F.col("doc_id").cast("long"), unnamed)


def signed(docs: DataFrame) -> DataFrame:
    """(doc, d1, d2, n, bands): a digest of the words, how many shingles, a hash per band."""
    rows = docs.select(_doc().alias("doc"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(per_batch(_signed), "doc long, d1 long, d2 long, n long, bands array<long>")


def _bloom(nodes: DataFrame, column: str):
    """The set bits of a Bloom filter, put together by Spark and sent to every task."""
    hashes = [F.xxhash64(F.col(column)), F.xxhash64(F.col(column), F.lit(1)), F.xxhash64(F.col(column), F.lit(2))]
    bits = nodes.select(F.explode(F.array(*hashes)).alias("h")).select(
        F.pmod("h", F.lit(BLOOM_WORDS)).cast("int").alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned("h", 40), F.lit(64)).cast("int")).alias("bit"),
    )
    filled = np.zeros(BLOOM_WORDS, np.int64)
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()  # BLOOM_WORDS rows at most
    filled[words["word"].to_numpy()] = words["bit"].to_numpy()
    return nodes.sparkSession.sparkContext.broadcast(filled)


def _with_items(filled) -> object:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep = np.ones(batch.num_rows, bool)
        for name in ("h0", "h1", "h2"):
            h = batch.column(name).to_numpy()
            bit = (h.view(np.uint64) >> np.uint64(40)) % np.uint64(64)
            keep &= (filled.value[h % BLOOM_WORDS].view(np.uint64) >> bit & np.uint64(1)).astype(bool)
        if not keep.any():
            return None
        part = batch.filter(pa.array(keep))
        items = [Shingler.items(_shingler.shingles(_words(t))).tobytes() for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("doc"), pa.array(items, pa.binary())], ["node", "items"])

    return per_batch(run)


def item_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, items) for the documents in ``nodes``: the shingle multiset as a sorted set, in bytes."""
    filled = _bloom(nodes, "node")
    doc = _doc()
    rows = docs.select(
        doc.alias("doc"), F.col("text").cast("string").alias("text"), F.xxhash64(doc).alias("h0"), F.xxhash64(doc, F.lit(1)).alias("h1"), F.xxhash64(doc, F.lit(2)).alias("h2")
    )
    return rows.mapInArrow(_with_items(filled), "node long, items binary").where(F.octet_length("items") > 0)


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                one, two = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                shared = overlap(one, two)
                keep.append(shared >= similarity * (len(one) + len(two) - shared))
            if any(keep):
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def verified(pairs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose multisets are similar enough."""
    one = items.select(F.col("node").alias("a"), F.col("items").alias("x"))
    two = items.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_verified(similarity), "a long, b long")


def _compared(similarity: float):
    def run(key, probes: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        out: set[tuple[int, int]] = set()
        if len(probes) and len(base):
            sets = [np.frombuffer(x, "<u8") for x in base["b_items"]]
            nodes, comps = base["b_node"].to_numpy(), base["b_comp"].to_numpy()
            sizes = np.array([len(x) for x in sets])
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], np.repeat(np.arange(len(sets)), sizes)[order]
            for node, comp, blob in zip(probes["p_node"], probes["p_comp"], probes["p_items"]):
                own = np.frombuffer(blob, "<u8")
                left, right = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                n = right - left
                at = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=len(sets))
                good = (shared >= similarity * (len(own) + sizes - shared)) & (comps != comp)
                for other in dict(zip(comps[good].tolist(), nodes[good].tolist())).values():
                    out.add((min(node, other), max(node, other)))
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    return run


def _between(clustered: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """Links between components of a cluster. clustered: (cluster, node, comp)."""
    sizes = clustered.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
    per = sizes.groupBy("cluster").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("most"))
    per = per.select("cluster", F.col("most.comp").alias("main"), F.ceil(F.col("all") / BLOCK).alias("base_blocks"), F.ceil((F.col("all") - F.col("most.n")) / BLOCK).alias("probe_blocks"))
    rows = clustered.join(per, "cluster").join(items, "node")
    block = F.xxhash64("node")


    def numbers(blocks: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))

    own = [F.col(c).alias(f"p_{c}") for c in ("cluster", "node", "comp", "items")]
    probes = rows.where(F.col("comp") != F.col("main")).select(*own, F.pmod(block, F.col("probe_blocks")).alias("p_i"), numbers("base_blocks").alias("p_j"))
    own = [F.col(c).alias(f"b_{c}") for c in ("cluster", "node", "comp", "items")]
    base = rows.where(F.col("probe_blocks") > 0).select(*own, numbers("probe_blocks").alias("b_i"), F.pmod(block, F.col("base_blocks")).alias("b_j"))
    sides = probes.groupBy("p_cluster", "p_i", "p_j").cogroup(base.groupBy("b_cluster", "b_i", "b_j"))
    return sides.applyInPandas(_compared(similarity), "a long, b long")


def _classed(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc, class, copies) for each row, with numbers for rows without an id."""
    marked = written(signed(docs), "signed")
    texts = marked.groupBy("d1", "d2").agg(F.min("doc").alias("node"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    texts = written(texts, "texts")

    exploded = texts.select("node", "n", F.explode("bands").alias("h"))
    pick = F.min(F.struct(F.xxhash64("node").alias("order"), F.col("node").alias("node")))
    groups = exploded.groupBy("h").agg(F.count("*").alias("g"), F.min("node").alias("c1"), pick["node"].alias("c2")).where(F.col("g") > 1)
    members = written(exploded.join(groups, "h"), "members")

    small = members.where(F.col("g") <= SMALL)
    left, right = small.select("h", F.col("node").alias("a"), F.col("n").alias("na")), small.select("h", F.col("node").alias("b"), F.col("n").alias("nb"))
    near = F.least("na", "nb") >= similarity * F.greatest("na", "nb")
    pairs = left.join(right, "h").where((F.col("a") < F.col("b")) & near).select("a", "b")
    big = members.where(F.col("g") > SMALL)
    stars = big.select("node", F.explode(F.array("c1", "c2")).alias("c")).where(F.col("node") != F.col("c"))
    pairs = pairs.unionByName(stars.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))).distinct()

    items = written(item_sets(docs, members.select("node").distinct()), "items")
    links = written(verified(pairs, items, similarity), "verified")
    roots = written(components(links), "roots")

    # rows that share an id can hold several texts: they are one document all the same
    if big.head(1):
        placed = big.join(roots, "node", "left").select("h", "node", "c1", F.coalesce("root", "node").alias("comp"))
        mixed = placed.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("h")
        unsettled = written(placed.join(mixed, "h"), "unsettled")
        clusters = components(unsettled.select(F.col("node").alias("a"), F.col("c1").alias("b")))
        clustered = unsettled.select("node", "comp").distinct().join(clusters, "node").select(F.col("root").alias("cluster"), "node", "comp")
        more = written(_between(written(clustered, "clustered"), items, similarity), "verified")
        roots = written(components(links.unionByName(more)), "roots")

    named = texts.join(roots, "node", "left").select("d1", "d2", "copies", F.coalesce("root", "node").alias("class"))
    # texts without words link to nothing, not even to one another
    return marked.select("doc", "d1", "d2", "n").join(named, ["d1", "d2"]).select(
        "doc", F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("class")).alias("class"), F.when(F.col("n") == 0, F.lit(1)).otherwise(F.col("copies")).alias("copies")
    )


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_copies) for each row: its class, named by its least id, and
    how many rows have the very same words.

    A class with a row without an id has no name: null.
    """
    rows = _classed(docs, similarity)
    return rows.select(
        F.when(F.col("doc") >= NAMED, F.col("doc")).alias("doc_id"), F.when(F.col("class") >= NAMED, F.col("class")).alias("class_id"), F.col("copies").alias("n_copies")
    )


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: its least id, or one without an id if there is any.

    Of rows that share this id the one of the least text stays; a null text is least.
    """
    (doc,) = free_names(docs, "doc")
    gone = _classed(docs, similarity).where(F.col("doc") != F.col("class")).select(F.col("doc").alias(doc)).distinct()
    kept = docs.withColumn(doc, _doc()).join(gone, doc, "left_anti")
    if kept.groupBy(doc).count().where("count > 1").head(1):
        row = F.struct(*docs.columns)
        kept = kept.groupBy(doc).agg(F.min_by(row, F.struct(F.col("text").cast("string"), F.to_json(row))).alias("row")).select("row.*")
    return kept.select(*docs.columns)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
