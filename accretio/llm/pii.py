"""Operator 9: personal data by candidate spans and boosted trees, in DataFrame functions only.

Base detectors accept what their pattern and their check (number ranges, Luhn,
digit counts) accept. High-recall generators then propose spans in what the base
left over: numbers in any grouping, obfuscated mail addresses, long mixed strings.
For each kind, gradient-boosted trees score a candidate by format and context, and
a calibrated threshold selects what is added. The trees are applied as one column
expression inside the row, so documents aren't shuffled.

What the trees learn from isn't the base verdict on a candidate. Positives are
accepted spans and their variants, which no base detector accepts: other
separators, no plus, ``(at)`` and ``[dot]``. Negatives are candidates in prose
without a word of their kind before them, and near misses: accepted spans with the
last digit, a part or the domain spoiled. A fifth kind, secret, has no base
detector: its positives are strings that are assigned to a name such as token or
key, and its trees see the string's format but not that name. A kind of which the
documents hold no positive can't be learned, and nothing of it is added.

Trees learn from a bounded sample of distinct candidates. A kind's threshold is
the least score at which the candidates not learned from, all of them, and what
is made of them, are right often enough, by distinct candidate and by occurrence.

Offsets are code points, ends exclusive. A null text counts as empty and has no
spans. Repeated rows are judged each; columns of the names added are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

KINDS = ("email", "ip", "card", "phone")
#: Kinds with those that only the method finds, after the others.
ALL_KINDS = (*KINDS, "secret")
#: Distinct candidates of a kind and label the trees learn from, about.
SAMPLE = 10_000
PRECISION = 0.95
_BLOCK, _CHUNK = 64, 1024
#: What makes two candidates one: all that features see, and nothing of their place.
_IDENTITY = ("kind", "value", "before", "after")
#: Stands for a code point of an accepted span while candidates are looked for.
_MASK = "\ufffc"

# Patterns with possessive repeats, and starts only where a match can start, so
# that time stays linear in the text; \G lets a match follow directly on another.
_LOCAL = r"[A-Za-z0-9._%+-]"
_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LOOSE_AT = r"(?:\G|(?<![^\s@\ufffc]))[^\s@\ufffc]++@[^\s@\ufffc]++"
_SPELT_AT = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)*+"
_LOOSE_NUMBER = r"\+?\(?[0-9]++(?:[\x20().\[\]-]{1,3}[0-9]++)*+"
_LONG = r"(?:\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{20,}+"
_ASSIGNED = r"(?i)(?:token|key|secret|passw|auth|credential)\S{0,12}\s*[=:]\s*[\"']?$"
_SPANS = "array<struct<kind:int,start:int,end:int,value:string,before:string,after:string>>"


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]+", ""))


def _luhn(value: Column) -> Column:
    bare = F.regexp_replace(value, "[^0-9]+", "")
    return F.when(F.length(bare).between(12, 19), F.call_function("luhn_check", bare)).otherwise(False)


def _valid(kind: int, value: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return F.rlike(value, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    if kind == 2:
        return _digits(value).between(16, 19) & _luhn(value)
    return _digits(value).between(8, 15)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once: inside a lambda an expression is made anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before_each(values: Column, joined: Callable[[Column, Column], Column]) -> Column:
    """For each of the ints ``values`` the sum (or what ``joined`` makes) of those before it, 0 for the first.

    Totals of 64, and of 64 times 64, are made first, so that the work for n
    values is about 32 n and not n * n.
    """

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), joined)

    def totals(row: Column) -> Column:
        blocks = F.floor((F.size(row) + _BLOCK - 1) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(blocks - 1, F.lit(0))), lambda b: total(F.slice(row, b * _BLOCK + 1, F.lit(_BLOCK))))

    def within(row: Column, i: Column, head: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        return joined(F.get(head, block), total(F.slice(row, block * _BLOCK + 1, i - block * _BLOCK)))

    def spread(row: Column, blocks: Column, heads: Column) -> Column:
        return _bound(F.transform(blocks, lambda _, b: within(blocks, b, heads)), lambda head: F.transform(row, lambda _, i: within(row, i, head)))

    def led(row: Column, blocks: Column) -> Column:
        first = F.transform(totals(blocks), lambda _, s: total(F.slice(blocks, F.lit(1), s * _BLOCK)))
        return _bound(first, lambda heads: spread(row, blocks, heads))

    return _bound(values, lambda row: _bound(totals(row), lambda blocks: led(row, blocks)))


def _turns(text: Column, pattern: str) -> Column:
    """The texts between matches, and the matches, which take turns."""
    return F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))


def _found(text: Column, pattern: str, kind: int) -> Column:
    """All matches with their places and surroundings; ``before`` and ``after`` reach to the next match at most."""

    def paired(t: Column) -> Column:
        def pair(v: Column, i: Column) -> Column:
            gap = F.get(t["gaps"], i)
            return F.struct(
                F.length(gap).alias("gap"), F.right(gap, F.lit(24)).alias("before"), F.left(F.get(t["gaps"], i + 1), F.lit(1)).alias("after"), v.alias("value"), F.length(v).alias("n")
            )

        return F.transform(t["values"], pair)

    def placed(row: Column) -> Column:
        def one(x: Column, i: Column, ahead: Column) -> Column:
            start = F.get(ahead, i) + x["gap"]
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x["n"]).alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))

        before = _before_each(F.transform(row, lambda x: x["gap"] + x["n"]), lambda a, b: a + b)
        return _bound(before, lambda ahead: F.transform(row, lambda x, i: one(x, i, ahead)))

    return _bound(_bound(_turns(text, pattern), paired), placed).cast(_SPANS)


def _none() -> Column:
    return F.array().cast(_SPANS)


#: Each base kind's pattern, and a quick test for texts that can hold it.
_BASE = (
    (_EMAIL, lambda text: F.contains(text, F.lit("@"))),
    (_IP, lambda text: F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"))),
    (_CARD, lambda text: F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){15}"))),
    (_PHONE, lambda text: F.rlike(text, F.lit(r"\+[0-9]"))),
)


_built: dict[tuple, Column] = {}


def _once(name: str, build: Callable[[], Column]) -> Column:
    """Expressions of some thousand nodes take the driver seconds to build; they hold for its JVM."""
    key = (id(SparkContext._gateway), name)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def base_spans(text: Column) -> Column:
    """The base detectors' spans of all kinds, by kind and then start."""

    def of(kind: int, pattern: str, can: Column) -> Column:
        return F.when(can, F.filter(_found(text, pattern, kind), lambda s: _valid(kind, s["value"]))).otherwise(_none())

    return F.concat(*[of(kind, pattern, can(text)) for kind, (pattern, can) in enumerate(_BASE)])


def masked(text: Column, base: Column) -> Column:
    """``text`` with every code point of accepted spans replaced, kind by kind, so that places stay."""

    def hidden(turns: Column, kind: int) -> Column:
        def one(gap: Column, i: Column) -> Column:
            value = F.get(turns["values"], i)
            return F.concat(gap, F.coalesce(F.when(_valid(kind, value), F.repeat(F.lit(_MASK), F.length(value))).otherwise(value), F.lit("")))

        return F.array_join(F.transform(turns["gaps"], one), "")

    def of(kind: int, rest: Column) -> Column:
        pattern, can = _BASE[kind]
        return F.when(can(rest), _bound(_turns(rest, pattern), lambda t: hidden(t, kind))).otherwise(rest)

    def chained(rest: Column, kind: int) -> Column:
        return of(kind, rest) if kind == len(_BASE) - 1 else _bound(of(kind, rest), lambda r: chained(r, kind + 1))

    return F.when(F.size(base) > 0, chained(text, 0)).otherwise(text)


def proposed(text: Column) -> Column:
    """Candidates of the loose generators, which may overlap; one number can be of several kinds."""
    numbers = F.when(F.rlike(text, F.lit(r"[0-9]{2}|[0-9][\x20().\[\]-]{1,3}[0-9]")), F.filter(_found(text, _LOOSE_NUMBER, 3), lambda s: _digits(s["value"]) >= 4)).otherwise(_none())

    def as_kind(rows: Column, kind: int, least: int, most: int) -> Column:
        fields = ("start", "end", "value", "before", "after")
        some = F.filter(rows, lambda s: _digits(s["value"]).between(least, most) & (F.length(s["value"]) <= 64))
        return F.transform(some, lambda s: F.struct(F.lit(kind).alias("kind"), *[s[f].alias(f) for f in fields]))

    emails = F.when(F.contains(text, F.lit("@")), _found(text, _LOOSE_AT, 0)).otherwise(_none())
    spelt = F.when(F.rlike(text, F.lit(r"[\[(](?:at|AT)[\])]")), _found(text, _SPELT_AT, 0)).otherwise(_none())
    other = _bound(numbers, lambda rows: F.concat(as_kind(rows, 1, 4, 12), as_kind(rows, 2, 13, 19), as_kind(rows, 3, 7, 15)))
    long = F.when(F.rlike(text, F.lit(_LONG)), _found(text, _LONG, 4)).otherwise(_none())
    return F.concat(emails, spelt, other.cast(_SPANS), long)


def _base() -> Column:
    return _once("base", lambda: base_spans(F.col("text")))


def _left() -> Column:
    """Candidates in what the spans of the column ``base`` left of the column ``text``."""
    return _once("left", lambda: _bound(masked(F.col("text"), F.col("base")), proposed))


#: Words that speak for a kind, as features; a candidate after one of its own kind is never a negative.
_WORDS = {"mails": "mail|contact|write", "hosts": "host|addr|server", "pays": "card|visa|pay|credit", "calls": "phone|tel|call|fax|mobile", "counts": "page|version|isbn|no\\.|id"}


def features(span: Column) -> dict[str, Column]:
    """Numbers that describe a candidate's format and its surroundings."""
    value, size = span["value"], span["end"] - span["start"]
    before, after = F.lower(span["before"]), span["after"]
    last = F.right(before, F.lit(1))

    def count(chars: str) -> Column:
        return (size - F.length(F.regexp_replace(value, chars, ""))).cast("double")

    def flag(test: Column) -> Column:
        return F.coalesce(test, F.lit(False)).cast("double")

    parts = F.split(value, r"[^0-9]+")
    out = {"size": size.cast("double"), "digits": count("[0-9]"), "dots": count(r"\."), "spaces": count(r"[\x20-]"), "brackets": count(r"[()\[\]]")}
    out |= {"lower": count("[a-z]"), "upper": count("[A-Z]"), "turns": F.size(F.split(value, r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")).cast("double")}
    out |= {"plus": flag(F.startswith(value, F.lit("+"))), "domain": flag(F.rlike(value, F.lit(r"(?:@|[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9-]+(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9]")))}
    out |= {"groups": F.size(parts).cast("double"), "longest": F.array_max(F.transform(parts, F.length)).cast("double"), "luhn": flag(_luhn(value))}
    out |= {"octets": flag(F.rlike(value, F.lit(rf"^{_PART}(?:[^0-9]{{1,3}}{_PART}){{3}}$"))), "zero": flag(F.startswith(value, F.lit("0")))}
    out |= {"word_before": flag(F.rlike(last, F.lit(r"[\p{L}0-9]"))), "word_after": flag(F.rlike(after, F.lit(r"[\p{L}0-9]"))), "mark_before": flag(F.rlike(last, F.lit(r"[#$%=/]"))), "quoted": flag(F.rlike(last, F.lit("[\"']")))}
    return out | {name: flag(F.rlike(before, F.lit(words))) for name, words in _WORDS.items()}


def variants(kind: int, value: Column) -> list[tuple[Column, float]]:
    """What accepted values of a kind may also look like (1.0), and what comes near but isn't one (0.0)."""

    def swapped(pattern: str, to: str) -> Column:
        return F.regexp_replace(value, pattern, to)

    if kind == 0:
        return [(swapped("@", "(at)"), 1.0), (swapped("@", " [at] "), 1.0), (F.regexp_replace(swapped("@", " [at] "), r"\.(?=[^.]*$)", " [dot] "), 1.0), (swapped(r"@([^.]*).*$", "@$1"), 0.0), (swapped(r"@.*$", "(at)"), 0.0)]
    if kind == 1:
        return [(swapped(r"\.", "[.]"), 1.0), (swapped(r"\.", " . "), 1.0), (F.concat(F.lit("99"), value), 0.0), (swapped(r"\.[0-9]+$", ""), 0.0)]
    if kind == 2:
        bare = F.regexp_replace(value, "[^0-9]+", "")
        spoilt = F.concat(F.left(bare, F.length(bare) - 1), F.pmod(F.right(bare, F.lit(1)).cast("int") + 1, F.lit(10)).cast("string"))
        grouped = [F.regexp_replace(x, "([0-9]{4})(?=[0-9])", to) for x, to in ((bare, "$1."), (bare, "$1 - "), (spoilt, "$1."), (spoilt, "$1 "))]
        return [(grouped[0], 1.0), (grouped[1], 1.0), (grouped[2], 0.0), (grouped[3], 0.0), (spoilt, 0.0)]
    if kind == 3:
        bare = F.regexp_replace(value, "[^0-9]+", "")
        return [(swapped(r"^\+", ""), 1.0), (swapped(r"^\+", "00"), 1.0), (swapped(r"^\+[0-9]{1,3}[\x20-]", ""), 1.0), (bare, 0.0), (F.regexp_replace(bare, "([0-9]{2})(?=[0-9])", "$1."), 0.0)]
    return [(swapped("[0-9]", "e"), 0.0), (swapped("[A-Za-z]", "7"), 0.0)]


@dataclass(frozen=True)
class Trees:
    """trees: nested (feature, threshold, left, right) or a leaf's value; their weights; the least score that is enough."""

    names: list[str]
    trees: list
    weights: list[float]
    threshold: float | None = None

    def score(self, values: dict[str, Column]) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            name, threshold, left, right = node
            return F.when(values[self.names[name]] <= threshold, walk(left)).otherwise(walk(right))

        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            total = total + walk(tree) * weight
        return F.round(total, 3)


@dataclass(frozen=True)
class SpanModel:
    """Trees by kind; a kind without a threshold adds nothing."""

    kinds: dict[int, Trees]

    @property
    def thresholds(self) -> dict[int, float]:
        return {kind: t.threshold for kind, t in self.kinds.items() if t.threshold is not None}

    def accepts(self, span: Column) -> Column:
        values, out = features(span), F.lit(False)
        for kind, least in self.thresholds.items():
            out = out | ((span["kind"] == kind) & (self.kinds[kind].score(values) >= least))
        return out


def _tree(node) -> object:
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild()))


def _candidates(docs: DataFrame) -> DataFrame:
    """The distinct candidates of ``docs`` with a label, how often each occurs, and an order that only they decide."""
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.rlike("text", F.lit(rf"[0-9]|@|[\[(](?:at|AT)[\])]|{_LONG}")))
    rows = rows.withColumn("base", _base())

    def marked(spans: Column, sure: bool) -> Column:
        return F.transform(spans, lambda c: F.struct(c.alias("c"), F.lit(sure).alias("base")))

    both = F.concat(marked(F.col("base"), True), marked(_left(), False))
    rows = rows.select(F.explode(both).alias("x")).select(*[f"x.c.{name}" for name in _IDENTITY], "x.base")
    rows = rows.groupBy(*_IDENTITY, "base").agg(F.count("*").alias("copies"))
    spoken = F.lit(False)
    for kind, words in enumerate(list(_WORDS.values())[: len(KINDS)]):
        spoken = spoken | ((F.col("kind") == kind) & F.rlike(F.lower("before"), F.lit(words)))
    label = F.when((F.col("kind") == len(KINDS)) & F.rlike("before", F.lit(_ASSIGNED)), 1.0).when(F.col("base"), 1.0).when(~spoken, 0.0)
    return written(rows.withColumn("label", label).where(F.col("label").isNotNull()).withColumn("order", F.xxhash64(*_IDENTITY)), "candidates")


def _varied(rows: DataFrame) -> DataFrame:
    """``rows`` and the variants of their positives."""
    every = F.array()
    for kind in range(len(ALL_KINDS)):
        made = F.array(*[F.struct(value.alias("value"), F.lit(label).alias("label")) for value, label in variants(kind, F.col("value"))])
        every = F.when((F.col("kind") == kind) & (F.col("label") == 1), made).otherwise(every)
    own = F.array(F.struct(F.col("value"), F.col("label")))
    rest = [c for c in rows.columns if c not in ("value", "label")]
    return rows.select(*rest, F.explode(F.concat(own, every.cast("array<struct<value:string,label:double>>"))).alias("v")).select(*rest, "v.*")


def learned(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> SpanModel:
    """Trees by kind from about ``sample`` distinct candidates of each label, thresholds from all others."""
    rows = _candidates(docs)
    named = features(F.struct(*_IDENTITY, F.lit(0).alias("start"), F.length("value").alias("end")))
    names = list(named)
    kept = F.pmod("order", F.lit(5)) == 0  # a fifth is never learned from, so that few candidates leave some to judge by
    bound = F.lit(2**63 - 1)  # hashes are even: the share below a bound is the sample
    for r in rows.where(~kept).groupBy("kind", "label").count().collect():
        if r["count"] > sample:
            bound = F.when((F.col("kind") == r["kind"]) & (F.col("label") == r["label"]), int(-(2**63) + sample / r["count"] * 2**64)).otherwise(bound)
    learning = ~kept & (F.col("order") <= bound)
    picked = written(_varied(rows.where(learning)).select("kind", "label", *[column.alias(name) for name, column in named.items()]), "sample")
    labels = {(r["kind"], r["label"]) for r in picked.select("kind", "label").distinct().collect()}
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(picked)
    kinds = {}
    for kind in range(len(ALL_KINDS)):
        if {(kind, 0.0), (kind, 1.0)} <= labels:
            fit = GBTClassifier(maxIter=10, maxDepth=3, stepSize=0.3, seed=7, featuresCol="features", labelCol="label").fit(vectors.where(F.col("kind") == kind))
            kinds[kind] = Trees(names, [_tree(t._java_obj.rootNode()) for t in fit.trees], [float(w) for w in fit.treeWeights])
    if not kinds:
        return SpanModel({})
    held = _varied(rows.where(~learning)).select("kind", "label", "copies", *[column.alias(f"_{name}") for name, column in named.items()])
    values, score = {n: F.col(f"_{n}") for n in names}, F.lit(None).cast("double")
    for kind, trees in kinds.items():
        score = F.when(F.col("kind") == kind, trees.score(values)).otherwise(score)
    sums = [F.count("*").alias("n"), F.sum("label").alias("right"), F.sum("copies").alias("rows"), F.sum(F.col("label") * F.col("copies")).alias("right_rows")]
    steps = held.withColumn("score", score).groupBy("kind", "score").agg(*sums).collect()  # one row per kind and distinct score
    return SpanModel({kind: Trees(t.names, t.trees, t.weights, _threshold([r for r in steps if r["kind"] == kind], precision)) for kind, t in kinds.items()})


def _threshold(steps: list, precision: float) -> float | None:
    """The least score from which on enough candidates are right: by candidate and by occurrence, so that copies alone can neither set it nor hide behind it."""
    n = right = rows = right_rows = 0
    least = None
    for step in sorted(steps, key=lambda r: -r["score"]):
        n, right = n + step["n"], right + step["right"]
        rows, right_rows = rows + step["rows"], right_rows + step["right_rows"]
        if min(right / n, right_rows / rows) >= precision:
            least = step["score"]
    return least


def _told(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detected(docs: DataFrame, model: SpanModel | None) -> DataFrame:
    """``docs`` with base (array of spans), found (base and added spans, by kind and start), and the base counts by kind."""
    added = ["base", "found", *[f"n_{k}" for k in KINDS]]
    rows = docs.drop(*[c for c in added if c in docs.columns]).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.withColumn("base", _base())
    if model and model.thresholds:
        more = F.filter(_left(), model.accepts)
        rows = rows.withColumn("found", F.sort_array(F.concat("base", more)))
    else:
        rows = rows.withColumn("found", F.col("base"))

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return rows.select("*", *[number(k) for k in range(len(KINDS))])


def _rewritten(text: Column, spans: Column) -> Column:
    """``text`` with ``spans`` (sorted by start) replaced; text is cut into chunks so that a piece is found without reading all before it."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])

    def piece(chunks: Column, start: Column, end: Column) -> Column:
        one, two = F.floor(start / _CHUNK).cast("int"), F.floor(end / _CHUNK).cast("int")
        first, last = F.coalesce(F.get(chunks, one), F.lit("")), F.coalesce(F.get(chunks, two), F.lit(""))
        across = F.concat(F.substring(first, start % _CHUNK + 1, F.lit(_CHUNK)), F.array_join(F.slice(chunks, one + 2, F.greatest(two - one - 1, F.lit(0))), ""), F.substring(last, F.lit(1), end % _CHUNK))
        return F.when(end <= start, "").when(one == two, F.substring(first, start % _CHUNK + 1, end - start)).otherwise(across)

    def joined(chunks: Column, rows: Column, ends: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            ahead = F.get(ends, i)
            return F.when(s["start"] >= ahead, F.concat(piece(chunks, ahead, s["start"]), F.get(names, s["kind"]))).otherwise("")

        last = F.greatest(F.array_max(F.transform(rows, lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(F.transform(rows, one), ""), piece(chunks, last, F.length(text)))

    def with_ends(chunks: Column, rows: Column) -> Column:
        return _bound(_before_each(F.transform(rows, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), lambda ends: joined(chunks, rows, ends))

    chunks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_CHUNK}}}+"), F.lit(0))
    return _bound(chunks, lambda c: _bound(spans, lambda rows: with_ends(c, rows)))


def redacted(docs: DataFrame, model: SpanModel | None) -> DataFrame:
    """``docs`` with every span found replaced by its kind in capitals and brackets.

    Spans that overlap are replaced together, by the kind of the first.
    """
    rows = detected(docs, model)
    by_start = F.sort_array(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return rows.withColumn("text", F.when(F.size("found") > 0, _rewritten(F.col("text"), by_start)).otherwise(F.col("text"))).select(*docs.columns)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the contract's columns: n_spans (all spans, secrets too) and secrets, joined as spans are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = detected(docs, learned(docs))

    def told(secret: bool) -> Column:
        return _told(F.filter("found", lambda s: (s["kind"] == len(KINDS)) == F.lit(secret)))

    return rows.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_told(F.col("base")), 256).alias("base_sha256"), told(False).alias("spans"), F.size("found").cast("long").alias("n_spans"), told(True).alias("secrets")
    )
