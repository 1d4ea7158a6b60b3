"""Ingress: lines, JSON documents, line-JSON and whole files as facts; store discovery; cadence."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parse

FORMATS = ("lines", "json", "ndjson", "blob")


@dataclass(frozen=True)
class FileSource:
    """Files that give facts of a kind. Steps parse each record; a blob isn't parsed."""

    path: str
    kind: str
    observer: str = ""
    origin: str = ""
    format: str = "lines"
    steps: tuple[parse.Step, ...] = ()

    def read(self, spark: SparkSession) -> DataFrame:
        """(kind, observer, origin, ts, payload); ts is null where the record brings none."""
        whole = self.format in ("json", "blob")
        rows = spark.read.text(self.path, wholetext=whole).withColumnRenamed("value", "rec")
        none = F.lit(None)
        shown = {"observer": F.lit(self.observer), "origin": F.lit(self.origin), "ts": none.cast("double")}
        if self.format == "ndjson":
            # members that begin with an underscore override the source's own, and leave the payload
            rows = rows.where(F.try_parse_json("rec").isNotNull())
            v = F.from_json("rec", "_observer string, _origin string, _ts double")
            rows = rows.withColumns({"__o": v["_observer"], "__g": v["_origin"], "__t": v["_ts"]})
            rows = rows.withColumn("rec", _without(F.col("rec"), ["_observer", "_origin", "_ts"]))
            shown = {"observer": F.coalesce("__o", shown["observer"]), "origin": F.coalesce("__g", shown["origin"]), "ts": F.col("__t")}
        if self.format != "blob" and self.steps:
            rows = parse.run(rows, list(self.steps), many=self.format == "json")
        if dict(rows.dtypes)["rec"].startswith("map"):
            payload = F.to_json("rec")
        elif self.format == "lines":
            payload = F.to_json(F.struct(F.col("rec").alias("line")))
        elif self.format == "blob":
            payload = F.to_json(F.struct(F.col("rec").alias("text")))
        else:
            is_object = F.startswith(F.ltrim("rec"), F.lit("{"))
            payload = F.when(is_object, F.col("rec")).otherwise(F.concat(F.lit('{"_json":'), F.trim("rec"), F.lit("}")))
        return rows.select(F.lit(self.kind).alias("kind"), *[c.alias(n) for n, c in shown.items()], payload.alias("payload"))


def _without(text, names: list[str]):
    """JSON text of an object without some members."""
    members = F.from_json(text, "map<string,variant>")
    kept = F.map_filter(members, lambda k, _: ~k.isin(*names))
    return F.to_json(kept)


def sequence(spark: SparkSession, sources: list[FileSource]) -> DataFrame:
    """All of several sources; what can't be read ends the sequence with its error."""
    rows = None
    for s in sources:
        one = s.read(spark)
        rows = one if rows is None else rows.unionByName(one)
    return rows


def with_parameters(template: str, rows: list[dict[str, str]], environ: dict[str, str] | None = None) -> list[str]:
    """A template for each row of parameters: {{ name }} gives way to its value, $NAME values to the environment's."""
    import re

    out = []
    for row in rows:
        values = {k: (environ or {}).get(v[1:], "") if v.startswith("$") else v for k, v in row.items()}
        out.append(re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: values.get(m[1], m[0]), template))
    return out


def discovered(names: list[str], pattern: str) -> list[str]:
    """Store names that fit a glob, in order."""
    return sorted(n for n in names if fnmatch.fnmatchcase(n, pattern))


def stores(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several stores as one log with the member each row came from; missing ones are passed over."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(conf).exists(at)

    found = [p for p in paths if there(p)]
    rows = None
    for p in found:
        one = spark.read.parquet(p).withColumn("member", F.lit(p.rstrip("/").rsplit("/", 1)[-1]))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows


def due(facts: DataFrame, kind: str, cadence: str, interval: float = 0.0, now: float = 0.0, triggers: list[str] = ()) -> DataFrame:
    """(due): whether a source should run, by what the log says of its last good run.

    always; elapsed: its last ok ``_sync.<kind>`` fact is ``interval`` old; triggered:
    a fact of a trigger kind came after it.
    """
    ok = (F.col("kind") == f"_sync.{kind}") & (F.get_json_object("payload", "$.status") == "ok")
    last = F.max(F.when(ok, F.col("ts")))
    fired = F.max(F.when(F.col("kind").isin(*triggers), F.col("ts"))) if triggers else F.lit(None).cast("double")
    test = {"always": F.lit(True), "elapsed": F.coalesce(F.lit(now) - last >= interval, F.lit(True)), "triggered": F.coalesce(fired > F.coalesce(last, F.lit(-1.0)), F.lit(False))}[cadence]
    return facts.where(F.col("kind").isin(f"_sync.{kind}", *triggers)).agg(test.alias("due"))
