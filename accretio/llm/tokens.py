"""Operator 7: byte-level BPE encoding and streaming decoding of whole texts.

A null text counts as empty; an empty text has no ids. Other columns pass
through ``encoded`` unless their name is one it adds, which it then replaces.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import per_batch, table

RANKS = "byte_bpe_50k.tiktoken"


def encoded(docs: DataFrame, ranks_path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as array<int> in the column ``out``."""
    path = ranks_path or public_tokenizers.path(RANKS)

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        packed = [encoder(path).packed_ids(t or "") for t in texts.to_pylist()]
        ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))

    return docs.withColumn(out, ids_of(F.col(text)))


def decoded(docs: DataFrame, ranks_path: str | None = None, ids: str = "ids", out: str = "text") -> DataFrame:
    """``docs`` with the text of the id array ``ids`` in the column ``out``.

    A null array counts as empty. Bytes that are no UTF-8 become U+FFFD.
    """
    path = ranks_path or public_tokenizers.path(RANKS)

    @F.arrow_udf("string")
    def text_of(arrays: pa.Array) -> pa.Array:
        return pa.array(["".join(encoder(path).decode_stream(a or [])) for a in arrays.to_pylist()], pa.string())

    return docs.withColumn(out, text_of(F.col(ids)))


def round_trip(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Per document: its number of ids, a digest of the ids, and one of their decoded bytes.

    Encoding and decoding run in one pass over each text, so that ids are never
    shuffled or stored.
    """
    path = ranks_path or public_tokenizers.path(RANKS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(path)
        counts, id_digests, text_digests = [], [], []
        for text in batch.column("text").to_pylist():
            ids = np.frombuffer(coder.packed_ids(text or ""), "<u4").tolist()
            counts.append(len(ids))
            id_digests.append(sha256(" ".join(map(str, ids)).encode()).hexdigest())
            digest = sha256()
            for part in coder.decode_stream(ids):
                digest.update(part.encode())
            text_digests.append(digest.hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        per_batch(run), schema
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
