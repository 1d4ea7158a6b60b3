"""Operator 6: quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule says which documents to reject. Its cost and the share it rejects are
estimated on a bounded sample; rules then run in order of rejection per cost,
and a document that one rejects isn't shown to the next. The order changes only
how long it takes: a document is kept if no rule rejects it.

A null text counts as empty and has no words, so the least-words rule rejects
it. Repeated rows are judged each. Statistics replace columns of their names.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, table

#: Documents, about, and characters of each, on which costs are estimated, and how often each is judged for that.
SAMPLE, SAMPLE_CHARS, REPEATS = 400, 20_000, 5
_SPACE = r"[\x20\x09-\x0D]+"
_WS = " \t\n\x0b\x0c\r"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", F.col("n_words") < 50),
        Rule("repeated_words", 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    ]


def method_rules() -> list[Rule]:
    """Further rules; the last ones read the text again, so they are worth putting off."""
    upper = F.length(F.regexp_replace("text", r"[^\p{Lu}]+", ""))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > 3 * F.col("n_words")),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        Rule("long_words", F.col("word_chars") > 20 * F.col("n_words")),
        Rule("capitals", 10 * upper > 3 * letters),
        Rule("no_letters", 10 * letters < 3 * F.col("word_chars")),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the base statistics, n_lines (lines with a word) and a text that isn't null.

    Words in repeated windows are found without leaving the row: windows become
    64-bit hashes of their three words, which are sorted with their places only
    where some hash occurs twice. Equal neighbours mark their places, and the
    marks of neighbouring places overlap.
    """
    kept = [c for c in docs.columns if c not in {*STATISTICS, "n_lines"}]
    words_, windows_, lines_, sorted_, marks_ = free_names(docs, "words", "windows", "lines", "sorted", "marks")
    text = docs.select(*kept).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    trimmed = F.btrim("text", F.lit(_WS))
    words = text.withColumn(words_, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE)))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_WS)) != "")
    hashed = words.withColumn(
        windows_,
        F.when(
            F.size(words_) > 3,
            F.transform(
                F.slice(words_, 1, F.size(words_) - 2),
                lambda x, i: F.xxhash64(x, F.get(words_, i + 1), F.get(words_, i + 2)),
            ),
        ),
    ).withColumn(lines_, lines)
    placed = hashed.withColumn(
        sorted_,
        F.when(
            F.size(F.array_distinct(windows_)) < F.size(windows_),
            F.sort_array(F.transform(windows_, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )

    def again(x: Column, i: Column) -> Column:
        return (x["h"] == F.get(sorted_, i - 1)["h"]) | (x["h"] == F.get(sorted_, i + 1)["h"])

    marked = placed.withColumn(
        marks_, F.when(F.col(sorted_).isNotNull(), F.sort_array(F.transform(F.filter(sorted_, again), lambda x: x["i"])))
    )
    steps = F.transform(marks_, lambda x, i: F.least(F.lit(3), F.coalesce(x - F.get(marks_, i - 1), F.lit(3))))
    return marked.select(
        *kept[: kept.index("text")],
        "text",
        *kept[kept.index("text") + 1 :],
        F.size(words_).cast("long").alias("n_words"),
        F.length(F.array_join(words_, "")).cast("long").alias("word_chars"),
        (F.size(F.split("text", r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines_).cast("long").alias("n_lines"),
    )


def ordered(stats: DataFrame, rules: list[Rule], tries: int = 3) -> list[Rule]:
    """``rules`` by the share of the sample they reject per second they take, best first, then by name.

    stats: a small, local sample with statistics. A rule's time is that of judging
    the sample REPEATS times, less what a job takes that judges by no rule.
    """
    if not rules or not stats.head(1):
        return rules
    shares = stats.agg(*[F.avg(F.when(r.rejects, 1.0).otherwise(0.0)).alias(r.name) for r in rules]).first()
    many = stats.select("*", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("turn"))

    def seconds(test: Column) -> float:
        began = time.perf_counter()
        many.agg(F.count_if(test)).collect()
        return time.perf_counter() - began

    nothing = F.col("turn") < 0
    idle = min(seconds(nothing) for _ in range(tries))
    costs = {r.name: max(1e-4, min(seconds(r.rejects & (F.col("turn") > 0)) for _ in range(tries)) - idle) for r in rules}
    return sorted(rules, key=lambda r: (-(shares[r.name] + 1e-9) / costs[r.name], r.name))


def sampled(docs: DataFrame) -> DataFrame:
    """Statistics of about SAMPLE documents from everywhere in the table, held by the driver."""
    spark = docs.sparkSession
    rows = docs.select(F.substring(F.col("text").cast("string"), 1, SAMPLE_CHARS).alias("text"))
    share = min(1.0, SAMPLE / max(1, docs.count()))
    texts = [r["text"] for r in rows.sample(share, seed=7).collect()]
    stats = with_statistics(spark.createDataFrame(pa.table({"text": pa.array(texts, pa.string())})))
    return spark.createDataFrame(stats.toArrow())


def judged(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with statistics, base_failed, kept, and rejected_by: the rule that ended the cascade."""
    cascade = ordered(sampled(docs), [*base_rules(), *(method_rules() if rules is None else rules)])
    named = F.lit(None).cast("string")
    for rule in reversed(cascade):
        named = F.when(rule.rejects, F.lit(rule.name)).otherwise(named)
    base = base_rules()[0].rejects | base_rules()[1].rejects
    added = ["base_failed", "kept", "rejected_by"]
    stats = with_statistics(docs.drop(*[c for c in added if c in docs.columns]))
    rows = stats.withColumn("base_failed", base).withColumn("rejected_by", named).withColumn("kept", F.col("rejected_by").isNull())
    # Counting here also keeps a later filter on ``kept`` above the statistics:
    # pushed below, it would take them apart and make each anew for every use.
    return rows.observe("quality_rules", F.count("*").alias("judged"), F.count_if("kept").alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), w AS (
  SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS tri
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM t)
), twice AS (
  SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, tri) > 1
), marked AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM twice) GROUP BY doc_id
), s AS (
  SELECT t.doc_id, text, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
         length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS upper, length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS letters
  FROM t LEFT JOIN marked ON t.doc_id = marked.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * n_lines
            OR word_chars > 20 * n_words OR 10 * upper > 3 * letters OR 10 * letters < 3 * word_chars) AS kept
FROM s
"""
