"""Operator 5: URL filters: stated rules, and association rules mined from labels.

A stated rule (host and path prefix) fits its host and all subdomains where the
url's path starts with its path; the longest fit decides. Where none fits, rules
mined by FP-growth from labelled urls decide: each url is a set of tokens (one
per slot: parts of host, path, file name, query), and frequent token sets that
imply a label with enough confidence become rules. Parts beyond the slots (host
labels beyond the fourth, path segments between the second and the last, query
keys after the first) are further tokens: a rule holds any number of slot tokens
and at most one of these, as a url of n parts would give 2 ** n token sets to
mine. Each url is mined once by its slots, and once with each of its further
tokens, so that both kinds of sets are counted exactly.

A mined rule is indexed under its rarest slot token, or under its further token,
and looked up there, so urls are never shuffled; of the rules whose tokens a url
holds, the most confident decides, and allow if there is none.

A null url, or one without ://, has an empty host and path, no tokens, and is
allowed. Repeated rows are judged each. No labels give no mined rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Least share of the labelled urls that hold a rule's tokens and label, and
#: least share of those with the tokens that have the label. A url has at most
#: one token per slot, so there are at most 2 ** slots / SUPPORT frequent sets
#: without a further token, and as many for each frequent further token: that
#: bounds the rules, whatever the number of urls.
SUPPORT, CONFIDENCE = 0.01, 0.8
SLOTS = ["scheme", "tld", "domain", "sub1", "sub2", "dir1", "dir2", "leaf", "ext", "query"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, from after :// up to / ? # or the end, and the path, up to ? # or the end."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.contains(whole, F.lit("://")), F.regexp_extract(whole, r"(?s)\A.*?://(.*)\z", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*+", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*+([^?#]*+)", 1)


def stated(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def tokens(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """A token for each slot, or null; numbers in paths become #."""
    labels = F.reverse(F.split(host, r"\."))
    plain = F.regexp_replace(path, "[0-9]+", "#")
    parts = F.filter(F.split(plain, "/"), lambda x: x != "")
    leaf = F.get(parts, F.size(parts) - 1)
    query = F.regexp_extract(url, r"\?([^=&#]*)", 1)
    out = {
        "scheme": F.when(host != "", F.regexp_extract(F.lower(url), r"\A([^:]*)://", 1)),
        "tld": F.when(host != "", F.get(labels, F.lit(0))),
        "domain": F.when(F.size(labels) > 1, F.concat(F.get(labels, F.lit(1)), F.lit("."), F.get(labels, F.lit(0)))),
        "sub1": F.get(labels, F.lit(2)),
        "sub2": F.get(labels, F.lit(3)),
        "dir1": F.get(parts, F.lit(0)),
        "dir2": F.when(F.size(parts) > 2, F.get(parts, F.lit(1))),
        "leaf": F.when(F.size(parts) > 1, leaf),
        "ext": F.when(F.contains(leaf, F.lit(".")), F.substring_index(leaf, ".", -1)),
        "query": F.when(query != "", query),
    }
    return {slot: F.when(value.isNotNull(), F.concat(F.lit(f"{slot}:"), value)) for slot, value in out.items()}


def further(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of the parts that have no slot."""
    labels = F.reverse(F.split(host, r"\."))
    parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda x: x != "")
    keys = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    found = F.concat(
        F.transform(F.slice(labels, 5, F.greatest(F.size(labels) - 4, F.lit(0))), lambda x: F.concat(F.lit("more-sub:"), x)),
        F.transform(F.slice(parts, 3, F.greatest(F.size(parts) - 3, F.lit(0))), lambda x: F.concat(F.lit("more-dir:"), x)),
        F.transform(F.filter(F.transform(F.slice(keys, 2, F.size(keys)), lambda x: F.substring_index(x, "=", 1)), lambda x: x != ""), lambda x: F.concat(F.lit("more-query:"), x)),
    )
    return F.when(host != "", F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


_RULES = "key string, rules array<struct<confidence:double,support:double,verdict:string,tokens:array<string>>>"


def _indexed(keyed: DataFrame) -> DataFrame:
    made = keyed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("confidence", "support", "verdict", "tokens")), asc=False).alias("rules"))
    return written(made, "url-rules")


def _rules(model) -> DataFrame:
    label = F.get("consequent", F.lit(0))
    return model.associationRules.where(F.startswith(label, F.lit("label:"))).select(
        F.array_sort("antecedent").alias("tokens"), F.expr("substring(consequent[0], 7)").alias("verdict"), "confidence", "support"
    )


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(key, rules) twice: association rules from slot tokens to a label, under their rarest
    token, and rules with a further token, under that.

    labelled: the columns items (array of slot tokens), more (array of distinct further
    tokens) and label.
    """
    spark = labelled.sparkSession
    label = F.concat(F.lit("label:"), F.col("label"))
    sets = written(labelled.select(F.array_append("items", label).alias("items"), "more"), "url-items")
    empty = spark.createDataFrame([], _RULES)
    n = sets.count()
    if not n:
        return empty, empty
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(sets.select("items"))
    # a rule's own tokens are frequent, so their counts are in the model
    rules = _rules(model)
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("token"), "freq")
    single = rules.select("*", F.explode("tokens").alias("token")).join(counts, "token")
    by_slot = _indexed(single.groupBy("tokens", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("key")))

    # a set with one further token is in one row for each url that holds it, so its count is exact
    each = sets.select("items", F.explode("more").alias("token"))
    common = each.groupBy("token").count().where(F.col("count") >= support * n).select("token")
    rows = written(each.join(common, "token").select(F.array_append("items", F.col("token")).alias("items")), "url-items")
    m = rows.count()
    if not m:
        return by_slot, empty
    # half a url below the least count, which a quotient might miss by rounding
    least = max(support * n - 0.5, 0.0) / m
    own = F.filter("tokens", lambda t: F.startswith(t, F.lit("more-")))
    found = _rules(FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(rows)).where(F.size(own) == 1)
    held = F.round(F.col("support") * m)
    found = found.where(held >= support * n).select("tokens", "verdict", "confidence", (held / n).alias("support"), F.get(own, F.lit(0)).alias("key"))
    return by_slot, _indexed(found)


def judged(pages: DataFrame, rules: list[UrlRule] | None = None, labelled: DataFrame | None = None, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict, and the confidence of the mined rule that decided, if one did.

    labelled: urls with a label (columns url and label) to mine from; by default
    the urls that stated rules decide.
    """
    rules = RULES if rules is None else rules
    added = ["host", "path", "rule", "verdict", "confidence"]

    def parsed(rows: DataFrame) -> DataFrame:
        host, path = host_and_path(F.col("__url"))
        rows = rows.withColumns({"__host": host, "__path": path})
        named = tokens(F.col("__url"), F.col("__host"), F.col("__path"))
        rows = rows.withColumns({f"__{slot}": token for slot, token in named.items()}).withColumn("__items", F.array_compact(F.array(*[F.col(f"__{s}") for s in SLOTS])))
        return rows.withColumn("__more", further(F.col("__url"), F.col("__host"), F.col("__path")))

    kept = [c for c in pages.columns if c not in added]
    # the columns given travel as one, so that no name of theirs can clash
    rows = parsed(pages.select(F.struct(*kept).alias("__row"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("__url")))
    text, verdict = stated(F.col("__host"), F.col("__path"), rules)
    rows = rows.withColumns({"__rule": text, "__stated": verdict})
    sets = [F.col("__items").alias("items"), F.col("__more").alias("more")]
    if labelled is None:
        known = rows.where(F.col("__stated").isNotNull()).select(*sets, F.col("__stated").alias("label"))
    else:
        known = parsed(labelled.select(F.coalesce(F.col("url").cast("string"), F.lit("")).alias("__url"), "label")).where(F.col("label").isNotNull()).select(*sets, "label")
    index, more = mined(known)
    for slot in SLOTS:
        own = index.where(F.startswith("key", F.lit(f"{slot}:"))).select(F.col("key").alias(f"__{slot}"), F.col("rules").alias(f"__by_{slot}"))
        rows = rows.join(F.broadcast(own), f"__{slot}", "left")
    # one value for all rows: a map from the frequent further tokens to their rules
    rows = rows.withColumn("__by_more", more.agg(F.map_from_entries(F.collect_list(F.struct("key", "rules")))).scalar())
    held = F.transform("__more", lambda t: F.try_element_at("__by_more", t))
    candidates = F.flatten(F.array_compact(F.concat(F.array(*[F.col(f"__by_{s}") for s in SLOTS]), held)))
    own = F.concat("__items", "__more")
    fitting = F.filter(candidates, lambda r: F.forall(r["tokens"], lambda t: F.array_contains(own, t)))
    best = F.when(F.col("__stated").isNull(), F.array_max(fitting))
    return rows.withColumn("__best", best).select(
        "__row.*",
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__rule").alias("rule"),
        F.coalesce("__stated", F.col("__best.verdict"), F.lit("allow")).alias("verdict"),
        F.col("__best.confidence").alias("confidence"),
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages).select("page_id", "host", "path", "rule", "verdict", "confidence")
