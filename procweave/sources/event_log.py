"""Event logs as DataFrames: one row an event, columns case_id, event_idx, activity, resource,
start_ts, end_ts and any number of case attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STANDARD = ("case_id", "event_idx", "activity", "resource", "start_ts", "end_ts")
#: A column that a log may have: its cases' order, where case_id itself doesn't give it.
CASE_ORDER = "case_order"
#: Names of the same things in XES files.
XES_NAMES = {"concept:name": "activity", "org:resource": "resource", "start:timestamp": "start_ts", "time:timestamp": "end_ts"}


def attributes(log: DataFrame) -> list[str]:
    """Every column that isn't a standard one, sorted."""
    return sorted(c for c in log.columns if c not in STANDARD and c != CASE_ORDER)


def step_order(steps: DataFrame) -> Column:
    """The order of a table's steps: cases as in the log, and the steps of each."""
    case = [CASE_ORDER] if CASE_ORDER in steps.columns else []
    return F.struct(*case, "case_id", "step_idx")


def categorical(log: DataFrame) -> list[str]:
    """The attributes that are strings."""
    return [a for a in attributes(log) if isinstance(log.schema[a].dataType, T.StringType)]


def validated(log: DataFrame) -> DataFrame:
    """The log, or a ValueError for columns that are missing or whose names would clash with features."""
    missing = [c for c in STANDARD if c not in log.columns]
    if missing:
        raise ValueError(f"the log lacks {missing}")
    if len(set(map(str.lower, log.columns))) < len(log.columns):
        raise ValueError("two columns of the log have the same name")
    return log


def indexed(events: DataFrame, *order: str) -> DataFrame:
    """event_idx from 0 within each case, by the given order."""
    own = Window.partitionBy("case_id").orderBy(*order)
    return events.withColumn("event_idx", F.row_number().over(own) - 1)


def from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test log: a case for each user and day, with the user's segment and nation."""
    # with their schemas told, no file is read to learn them
    events = spark.read.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet(f"{sf_dir}/events.parquet")
    customer = spark.read.schema("c_custkey long, c_mktsegment string, c_nationkey int").parquet(f"{sf_dir}/customer.parquet")
    k = F.get_json_object("props", "$.k").cast("bigint")
    log = events.join(customer, events.user_id == customer.c_custkey).select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("case_id"),
        "event_id",
        F.col("event_type").alias("activity"),
        F.concat(F.lit("res_"), F.lpad(F.floor(k * k / 1000).cast("string"), 2, "0")).alias("resource"),
        F.expr("timestampadd(SECOND, -cast(floor(value * 60) as bigint), ts)").alias("start_ts"),
        F.col("ts").alias("end_ts"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation"),
    )
    return indexed(log, "start_ts", "event_id")


#: The elements of XES files that hold values, and their types here.
XES_KINDS = {"string": "string", "date": "timestamp_ntz", "int": "long", "float": "double", "boolean": "boolean", "id": "string"}
#: Attributes of a file, beyond which it is taken for broken.
MOST_ATTRIBUTES = 1000


def _xes_value(bag: Column, kind: str, key: str, offsets: str) -> Column:
    """The first value of a kind and a key; a date's offset is dropped, or taken into account."""
    value = F.try_element_at(F.transform(F.filter(bag[kind], lambda x: x["_key"] == F.lit(key)), lambda x: x["_value"]), F.lit(1))
    if kind != "date":
        return value.try_cast(XES_KINDS[kind])
    if offsets == "utc":
        return F.to_utc_timestamp(value.try_cast("timestamp"), "UTC").cast("timestamp_ntz")
    return F.regexp_replace(value, "(Z|[+-][0-9]{2}:?[0-9]{2})$", "").try_cast("timestamp_ntz")


def from_xes(spark: SparkSession, path: str, offsets: str | None = None) -> DataFrame:
    """An XES file's events, with case_order, the cases' order in the file.

    Attributes of traces and of events become columns of their kind: string, long, double, boolean
    and timestamp_ntz, named by their keys with `_` for `:`. An event's attribute whose name a trace's has
    too is `event_` and the name. A trace without a name is named by its place in the file. Values
    that aren't of their kind are null, and so are times that lack.

    Times keep their clock and lose their offset from UTC. Files with several offsets are refused, unless
    offsets says what to do: `local` keeps each clock, as with daylight saving, `utc` moves all to UTC."""
    pair = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())]))
    bag = [T.StructField(kind, pair) for kind in XES_KINDS]
    schema = T.StructType([*bag, T.StructField("event", T.ArrayType(T.StructType(bag)))])
    traces = spark.read.format("xml").option("rowTag", "trace").schema(schema).load(path).withColumn(CASE_ORDER, F.monotonically_increasing_id())
    listed = lambda bag, kind: F.transform(F.coalesce(bag[kind], F.array().cast(pair)), lambda x: F.struct(F.lit(kind).alias("kind"), x["_key"].alias("key")))
    keys = lambda bag: F.flatten(F.array(*[listed(bag, kind) for kind in XES_KINDS]))
    own = F.struct(*XES_KINDS)
    level = lambda name, found: F.transform(found, lambda x: F.struct(F.lit(name).alias("level"), x["kind"].alias("kind"), x["key"].alias("key")))
    stamps = F.flatten(F.transform("event", lambda e: F.transform(F.coalesce(e["date"], F.array().cast(pair)), lambda x: F.struct(F.lit("offset").alias("level"), F.lit("").alias("kind"), F.regexp_extract(x["_value"], "(Z|[+-][0-9]{2}:?[0-9]{2})?$", 1).alias("key")))))
    none = F.array().cast("array<struct<level:string,kind:string,key:string>>")
    every = F.concat(level("trace", keys(own)), F.coalesce(F.flatten(F.transform("event", lambda e: level("event", keys(e)))), none), F.coalesce(stamps, none))
    # a row for each key and offset, not for each event
    found = traces.select(F.explode(every).alias("k")).select("k.*").distinct().orderBy("level", "key", "kind").limit(MOST_ATTRIBUTES + 1).collect()
    if len(found) > MOST_ATTRIBUTES:
        raise ValueError(f"more than {MOST_ATTRIBUTES} attributes")
    if offsets is None and len({r["key"].replace("Z", "+00:00").replace(":", "") for r in found if r["level"] == "offset"}) > 1:
        raise ValueError("the times have several offsets from UTC: tell whether to keep each clock (offsets='local') or to move all to UTC ('utc')")
    name = lambda key: key.replace(":", "_")
    held, taken = {}, {*STANDARD, CASE_ORDER}
    for r in found:
        if r["level"] == "trace" and r["key"] != "concept:name" and name(r["key"]) not in held:
            held[name(r["key"])] = _xes_value(own, r["kind"], r["key"], offsets or "local")
    case = F.coalesce(_xes_value(own, "string", "concept:name", "local"), F.concat(F.lit("case_"), F.col(CASE_ORDER).cast("string")))
    columns = {c if c not in taken else f"trace_{c}": v for c, v in held.items()}
    events = traces.select(CASE_ORDER, case.alias("case_id"), *[v.alias(c) for c, v in columns.items()], F.posexplode("event").alias("event_idx", "event"))
    more: dict[str, Column] = {}
    for r in found:
        if r["level"] == "event" and r["key"] not in XES_NAMES:
            c = name(r["key"])
            c = f"event_{c}" if c in columns or c in taken else c
            if c not in more:
                more[c] = _xes_value(F.col("event"), r["kind"], r["key"], offsets or "local")
    standard = [_xes_value(F.col("event"), "date" if c.endswith("_ts") else "string", key, offsets or "local").alias(c) for key, c in XES_NAMES.items()]
    return events.select("case_id", "event_idx", *standard, *columns, *[v.alias(c) for c, v in more.items()], CASE_ORDER)
