"""The pipeline's stages against the operators' plain meaning, and the registry."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from accretio.llm import registry

from .test_operators import classes_by_hand, cleaned_by_hand, spans_by_hand, stats_by_hand

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, None
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == columns
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        rows = docs.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        assert len(after) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "quality_rules":
            for doc, text in before.items():
                n, _, symbols, _, repeated = stats_by_hand(text)
                if n < 50 or 100 * repeated > 50 * n or symbols > n:
                    assert doc not in after
            assert all(after[d] == before[d] for d in after)
        elif name == "line_dedup":
            assert set(after) == set(before)
            wanted = cleaned_by_hand(list(before.items()))
            dropped = {doc: n for doc, _, n, _ in wanted}
            assert all(before[d].count("\n") - after[d].count("\n") in (dropped[d], dropped[d] - 1) for d in after)
        elif name == "near_dedup":
            classes = classes_by_hand(list(before.items()))
            assert Counter(classes[d] for d in after) == Counter(set(classes.values()))
        else:
            assert set(after) == set(before)
            assert all(not spans_by_hand(t) for t in after.values())
            assert all(after[d] == before[d] for d in after if not spans_by_hand(before[d]) and not re.search(r"[0-9@]", before[d]))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(after)


def test_run(spark):
    small = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    at = spark.conf.get("spark.checkpoint.dir") + "/small"
    small.write.mode("overwrite").parquet(f"{at}/documents.parquet")
    assert corpus_pipeline.run(spark, at).count() > 0


def test_registry_names_one_query_per_operator():
    numbers = [int(n[2:].split("_")[0]) for n in registry.QUERIES]
    assert sorted(numbers) == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
