"""Text search over declared fields: words, prefixes, phrases, boolean queries.

The index has a row for each term of each document, with positions. Results are
ordered by time, newest first; there is no ranking.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Word:
    text: str
    prefix: bool = False


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    """In an And only: documents of the others without these."""

    part: object


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _found(low: Column, terms: list[str], prefix: bool = False) -> Column:
    """Whether a lower-cased text has the terms as words that follow one another; the last
    may be the beginning of a word. What is no run of letters and digits is no word, and
    no terms are never found.

    The plain test for each term passes over most texts that have none.
    """
    if not terms or not all(re.fullmatch(r"[^\W_]+", t) for t in terms):
        return F.lit(False)
    outside = r"[^\p{L}\p{N}]"
    pattern = rf"(?:\A|{outside})" + f"{outside}++".join(terms) + ("" if prefix else rf"(?:\z|{outside})")
    return reduce(Column.__and__, [F.contains(low, F.lit(t)) for t in terms]) & F.rlike(low, F.lit(pattern))


def matches(text: Column, query) -> Column:
    """Whether a text satisfies a query, as one expression: for searches without an index."""

    def test(low: Column, q) -> Column:
        match q:
            case Word("", True):
                return F.rlike(low, F.lit(r"[\p{L}\p{N}]"))
            case Word(t, prefix):
                return _found(low, [t.lower()], prefix)
            case Phrase(terms):
                return _found(low, " ".join(terms).lower().split(" "))
            case And(parts):
                return reduce(Column.__and__, [~test(low, p.part) if isinstance(p, Not) else test(low, p) for p in parts], F.lit(True))
            case Or(parts):
                return reduce(Column.__or__, [test(low, p) for p in parts], F.lit(False))
        raise ValueError(f"no query: {q}")

    return test(F.lower(F.coalesce(text, F.lit(""))), query)


def scan(facts: DataFrame, text: str, query, kinds: list[str] = (), limit: int | None = None, ident: str = "seq") -> DataFrame:
    """As ``search``, reading the texts: one pass and no shuffle, the way for a single search."""
    rows = facts.where(F.col("kind").isin(*kinds)) if kinds else facts
    hits = rows.where(matches(F.col(text), query)).orderBy(F.col("ts").desc(), F.col(ident).desc())
    return hits if limit is None else hits.limit(limit)


def index(docs: DataFrame, text: str, ident: str) -> DataFrame:
    """(id, term, positions); a document's own terms are grouped within its row."""
    rows = docs.select(F.col(ident).alias("id"), words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    return rows.select("id", F.posexplode("w").alias("pos", "term")).groupBy("id", "term").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def _ids(indexed: DataFrame, query) -> DataFrame:
    match query:
        case Word(text, prefix):
            low = text.lower()
            return indexed.where(F.startswith("term", F.lit(low)) if prefix else F.col("term") == low).select("id").distinct()
        case Phrase(terms):
            # positions shifted to where the phrase would begin; it begins where all terms agree
            rows = None
            for n, term in enumerate(terms):
                shift = F.lit(n)
                own = indexed.where(F.col("term") == term.lower()).select("id", F.transform("positions", lambda p: p - shift).alias(f"at{n}"))  # noqa: B023  built at once
                rows = own if rows is None else rows.join(own, "id")
            common = F.col("at0")
            for n in range(1, len(terms)):
                common = F.array_intersect(common, F.col(f"at{n}"))
            return rows.where(F.size(common) > 0).select("id").distinct()
        case And(parts):
            rows = None
            for p in [p for p in parts if not isinstance(p, Not)]:
                rows = _ids(indexed, p) if rows is None else rows.join(_ids(indexed, p), "id", "left_semi")
            for p in [p for p in parts if isinstance(p, Not)]:
                rows = rows.join(_ids(indexed, p.part), "id", "left_anti")
            return rows
        case Or(parts):
            rows = _ids(indexed, parts[0])
            for p in parts[1:]:
                rows = rows.unionByName(_ids(indexed, p))
            return rows.distinct()
    raise ValueError(f"no query: {query}")


def search(indexed: DataFrame, facts: DataFrame, query, kinds: list[str] = (), limit: int | None = None, ident: str = "seq") -> DataFrame:
    """Facts that satisfy the query, newest first; kinds and observers are filtered before the limit."""
    rows = facts.where(F.col("kind").isin(*kinds)) if kinds else facts
    hits = rows.join(_ids(indexed, query).withColumnRenamed("id", ident), ident, "left_semi").orderBy(F.col("ts").desc(), F.col(ident).desc())
    return hits if limit is None else hits.limit(limit)


def substring(rows: DataFrame, text: str, query: str) -> DataFrame:
    """Rows whose text holds the query, whatever the case."""
    return rows.where(F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(query.lower())))


def coverage(facts: DataFrame, indexed_upto: DataFrame, fingerprint: str, now: str) -> DataFrame:
    """(kind, state): fresh, stale or unindexed, from what was indexed (kind, last_seq) under a fingerprint.

    Another fingerprint makes every indexed kind stale.
    """
    heads = facts.groupBy("kind").agg(F.max("seq").alias("head"))
    rows = heads.join(F.broadcast(indexed_upto), "kind", "left")  # one row a declared kind
    state = F.when(F.col("last_seq").isNull(), "unindexed").when(F.lit(fingerprint != now) | (F.col("head") > F.col("last_seq")), "stale").otherwise("fresh")
    return rows.select("kind", state.alias("state"))


def hybrid(indexed: DataFrame, facts: DataFrame, covered: DataFrame, query: Word, text: str, limit: int = 100) -> DataFrame:
    """Index hits for fresh kinds and substring hits for the others, newest first, at most ``limit``."""
    fresh = F.broadcast(covered.where("state = 'fresh'").select("kind"))
    by_index = search(indexed, facts.join(fresh, "kind", "left_semi"), query)
    by_text = substring(facts.join(fresh, "kind", "left_anti"), text, query.text)
    return by_index.unionByName(by_text.select(*by_index.columns)).orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(limit)


def together(found: list[DataFrame], limit: int = 100) -> DataFrame:
    """What members' searches found, newest first: each member's own limit stands, then this one."""
    both = reduce(DataFrame.unionByName, [rows.withColumn("member", F.lit(n)) for n, rows in enumerate(found)])
    return both.orderBy(F.col("ts").desc(), "member", F.col("seq").desc()).limit(limit)
