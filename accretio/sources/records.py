"""The line log: one JSON record a line, read strictly.

A line is a fact, a tick, or a batch of at least two facts. Reading is Spark's
text source; each line is checked, and what is wrong with it is a column, so that
a bad line is a row in quarantine and not a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import FACTS, TICKS, with_receipt
from .scratch import written

#: The members a record must and may have.
FACT_MEMBERS = ("t", "id", "kind", "ts", "observer", "origin", "payload")
FACT_OPTIONAL = ("signature",)
TICK_MEMBERS = ("t", "id", "name", "ts", "since", "origin", "payload", "prev_hash", "window_start", "fact_cursor", "window_hash")
TICK_OPTIONAL = ("signature",)
BATCH_MEMBERS = ("t", "rows")


def _once(rows: DataFrame, /, **columns: Column) -> DataFrame:
    """The rows with more columns, each made once a row however often what follows uses it."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _members(keys: Column, must: tuple[str, ...], may: tuple[str, ...] = ()) -> Column:
    known = F.array(*[F.lit(k) for k in (*must, *may)])
    missing = F.array_except(F.array(*[F.lit(k) for k in must]), keys)
    unknown = F.array_except(keys, known)
    return (
        F.when(keys.isNull(), F.lit("no object"))
        .when(F.size(keys) != F.size(F.array_distinct(keys)), F.lit("a member twice"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown "), F.array_join(unknown, ", ")))
    )


def _fact_problem(text: Column, keys: Column, payload: Column) -> Column:
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(F.try_variant_get(v, "$.ts", "variant"))
    wrong = F.when(~F.rlike(kind, F.lit("BIGINT|DECIMAL|DOUBLE|FLOAT")), F.lit("ts is no number"))
    wrong = wrong.when(F.coalesce(F.get_json_object(text, "$.id"), F.lit("")) == "", F.lit("no id"))
    wrong = wrong.when(F.coalesce(F.get_json_object(text, "$.kind"), F.lit("")) == "", F.lit("no kind"))
    wrong = wrong.when(~F.coalesce(F.startswith(F.ltrim(payload), F.lit("{")), F.lit(False)) | F.try_parse_json(payload).isNull(), F.lit("payload is no object"))
    return F.coalesce(_members(keys, FACT_MEMBERS, FACT_OPTIONAL), F.when(v.isNull(), F.lit("no JSON")), wrong)


def checked(lines: DataFrame, column: str = "value") -> DataFrame:
    """(line, text, type, problem): each record of each line, with what is wrong, or null.

    ``lines`` has the text and its number ``line``. A batch line gives its facts,
    all with the batch's problem if it has one: no id twice, no batch in a batch.
    A line is parsed a fixed number of times, and so is each fact of a batch.
    """
    given = lines.select("line", F.col(column).alias("text"))
    typed = _once(given, type=F.get_json_object("text", "$.t"))
    is_batch, is_tick, is_fact = (F.col("type") == t for t in ("batch", "tick", "fact"))
    inside = F.transform(F.try_variant_get(F.try_parse_json("text"), "$.rows", "array<variant>"), lambda x: F.to_json(x))
    parts = _once(typed, rows=F.when(is_batch, inside), outer=F.when(is_batch | is_tick, F.json_object_keys("text")))
    rows, ids = F.col("rows"), F.col("ids")
    named = _once(parts, ids=F.transform(rows, lambda x: F.get_json_object(x, "$.id")))
    batch = F.coalesce(
        _members(F.col("outer"), BATCH_MEMBERS),
        F.when(rows.isNull() | (F.size(rows) < 2), F.lit("a batch has two rows at least"))
        .when(F.size(ids) != F.size(F.array_distinct(ids)), F.lit("an id twice"))
        .when(F.exists(rows, lambda x: ~F.coalesce(F.get_json_object(x, "$.t") == "fact", F.lit(False))), F.lit("a batch holds facts only")),
    )
    whole = F.when(is_batch, batch).when(is_tick, _members(F.col("outer"), TICK_MEMBERS, TICK_OPTIONAL)).when(~F.coalesce(is_fact, F.lit(False)), F.lit("no record"))
    marked = _once(named, problem=whole).select("line", "text", "type", "problem", "rows")
    opened = is_batch & F.col("problem").isNull()
    inner = F.when(opened, F.col("rows")).otherwise(F.array("text"))
    each = marked.select("line", F.posexplode(inner).alias("place", "text"), F.when(opened, F.lit("fact")).otherwise(F.col("type")).alias("type"), "problem")
    of_fact = (F.col("type") == "fact") & F.col("problem").isNull()
    read = _once(each, keys=F.when(of_fact, F.json_object_keys("text")), inner=F.when(of_fact, F.get_json_object("text", "$.payload")))
    own = F.when(F.col("type") == "fact", _fact_problem(F.col("text"), F.col("keys"), F.col("inner")))
    return _once(read.withColumnRenamed("problem", "above"), problem=F.coalesce("above", own)).select("line", "place", "text", "type", "problem")


def facts(records: DataFrame) -> DataFrame:
    """Good facts in the order of the log: seq from line and place.

    They are written to the shared folder, so that numbering them, which takes
    more than one pass, doesn't read and check every line again.
    """
    good = records.where((F.col("type") == "fact") & F.col("problem").isNull())
    v = F.from_json("text", "id string, kind string, ts double, observer string, origin string, payload string, signature string")
    # the payload's own text stays as it is where it is a text; objects are written again
    return with_receipt(written(good.select("line", "place", v.alias("v")), "records"), ["line", "place"]).select("seq", "v.*")


def ticks(records: DataFrame) -> DataFrame:
    good = records.where((F.col("type") == "tick") & F.col("problem").isNull())
    v = F.from_json("text", TICKS.replace("tick_seq long, ", ""))
    return good.select(F.col("line").alias("tick_seq"), v.alias("v")).select("tick_seq", "v.*")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their numbers: by file name, then by place in the file.

    Parts of a large file are numbered in their own tasks as they are read; a file's
    parts come in the order of their first byte, and one row a part tells how many
    lines come before it.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    # lines of a part follow one another in one task, so their ids do
    placed = rows.where("value <> ''").withColumn("at", F.monotonically_increasing_id())
    sizes = placed.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("file", "start", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = placed.join(F.broadcast(before), ["file", "start"])  # one row a part
    return numbered.select((F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def fact_lines(rows: DataFrame) -> DataFrame:
    """Facts as lines of the log; a signature is written where there is one."""
    return rows.select(_line(rows, "fact", FACT_MEMBERS, FACT_OPTIONAL).alias("value"))


def tick_lines(rows: DataFrame) -> DataFrame:
    """Ticks as lines of the log."""
    return rows.select(_line(rows, "tick", TICK_MEMBERS, TICK_OPTIONAL).alias("value"))


def batch_lines(rows: DataFrame, batch: str) -> DataFrame:
    """A line for each value of the column ``batch``: its facts in receipt order, or the fact itself where it is alone.

    A batch was written at once, so its facts fit a line.
    """
    inner = F.sort_array(F.collect_list(F.struct("seq", _line(rows, "fact", FACT_MEMBERS, FACT_OPTIONAL).alias("line"))))
    lines = rows.groupBy(batch).agg(F.transform(inner, lambda x: x["line"]).alias("lines"))
    whole = F.concat(F.lit('{"t":"batch","rows":['), F.array_join("lines", ","), F.lit("]}"))
    return lines.select(F.when(F.size("lines") > 1, whole).otherwise(F.get("lines", F.lit(0))).alias("value"))


def _line(rows: DataFrame, type_: str, must: tuple[str, ...], may: tuple[str, ...]) -> Column:
    """A record with every member it must have, null or not, and of the others those that aren't null."""

    def written(members: tuple[str, ...]) -> Column:
        return F.to_json(F.struct(F.lit(type_).alias("t"), *[m for m in members if m != "t"]), {"ignoreNullFields": "false"})

    more = [m for m in may if m in rows.columns]
    line = written(must)
    for name in more:
        line = F.when(F.col(name).isNotNull(), written((*must, name))).otherwise(line)
    return line


def append(rows: DataFrame, path: str) -> None:
    """Facts of a known order added to a log table."""
    rows.write.mode("append").parquet(path)


def empty_facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FACTS)
