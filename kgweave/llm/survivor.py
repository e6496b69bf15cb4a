"""Best representative of each duplicate group, field by field (problem 6).

Currency reasoning: from rows with timestamps it learns which values of a field come after
which; in a group where timestamps are missing these precedences order the values, and those
no other value of the group comes after are preferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.runtime import checkpoint, salted_join

#: What is written where nothing is known, in lower case and trimmed.
EMPTY_WORDS = ["", "-", "--", "?", "n/a", "na", "none", "null", "unknown", "tbd", "missing", "not available"]


def says_something(value: Column) -> Column:
    return value.isNotNull() & ~F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")).isin(EMPTY_WORDS)


def ranked(records: DataFrame, trust: DataFrame, *, sources: str, source: str, rank: str, bound: int = 10_000) -> DataFrame:
    """``records`` with the least trust rank among a row's sources as ``_rank``, null if none is listed.

    A list of up to ``bound`` sources, as counted beforehand, stands in the plan as constants; a longer one is joined to the
    distinct arrays of sources, hot sources and hot arrays salted, with the same result."""
    listed = trust.filter(F.col(source).isNotNull() & F.col(rank).isNotNull()).groupBy(F.col(source).alias("_source")).agg(F.min(rank).cast("int").alias("_r"))
    few = listed.limit(bound + 1).collect()
    if not few:
        return records.withColumn("_rank", F.lit(None).cast("int"))
    if len(few) <= bound:
        ranks = F.create_map(*[F.lit(x) for row in few for x in row])
        return records.withColumn("_rank", F.array_min(F.transform(sources, lambda s: F.try_element_at(ranks, s))))
    keyed = records.withColumn("_set", F.array_join(F.array_sort(F.array_distinct(sources)), "\u0001"))
    each = keyed.select("_set", F.explode(F.array_distinct(sources)).alias("_source")).distinct()
    best = salted_join(each, listed, ["_source"], F.col("_set")).groupBy("_set").agg(F.min("_r").alias("_rank"))
    return salted_join(keyed, best, ["_set"], F.xxhash64(*[c for c in records.columns if not records.schema[c].dataType.simpleString().startswith("map")]), how="left").drop("_set")


def learn_precedence(values: DataFrame) -> DataFrame:
    """(field, earlier, later): value changes seen more often in this direction than in the other.

    ``values``: (id, field, value, at), each value of a group once with its latest time.  Per group only changes between neighbours in time are
    looked at, in one window per month and one over the months, so a group of any size is
    spread over tasks."""
    seen = values.filter(F.col("at").isNotNull()).withColumn("month", F.date_format("at", "yyyy-MM"))
    inner = W.partitionBy("id", "field", "month").orderBy("at", "value")
    steps = seen.select("field", F.lag("value").over(inner).alias("earlier"), F.col("value").alias("later"))
    months = seen.groupBy("id", "field", "month").agg(F.min(F.struct("at", "value")).alias("a"), F.max(F.struct("at", "value")).alias("z"))
    outer = W.partitionBy("id", "field").orderBy("month")
    links = months.select("field", F.lag("z").over(outer)["value"].alias("earlier"), F.col("a.value").alias("later"))
    counts = steps.unionByName(links).filter(F.col("earlier").isNotNull() & (F.col("earlier") != F.col("later"))).groupBy("field", "earlier", "later").agg(F.count(F.lit(1)).alias("n"))
    pair = counts.select("field", F.least("earlier", "later").alias("x"), F.greatest("earlier", "later").alias("y"), F.when(F.col("earlier") < F.col("later"), F.col("n")).otherwise(-F.col("n")).alias("n"))
    net = pair.groupBy("field", "x", "y").agg(F.sum("n").alias("n")).filter("n <> 0")
    return net.select("field", F.when(F.col("n") > 0, F.col("x")).otherwise(F.col("y")).alias("earlier"), F.when(F.col("n") > 0, F.col("y")).otherwise(F.col("x")).alias("later"))


def comes_after(values: DataFrame, precedence: DataFrame) -> DataFrame:
    """(field, earlier, later) between any two of ``values`` (field, value), also over other values in between.

    Steps go on, a checkpointed join each, until nothing new is reached.  Values that come after each other, in a cycle, have no order."""
    front = checkpoint(values.select("field", F.col("value").alias("start"), "value"))
    reached = front.limit(0)
    steps = checkpoint(precedence) if front.take(1) else precedence
    while front.take(1):
        step = front.join(steps.withColumnRenamed("earlier", "value"), ["field", "value"]).select("field", "start", F.col("later").alias("value")).distinct()
        front = checkpoint(step.join(reached, ["field", "start", "value"], "left_anti"))
        reached = checkpoint(reached.unionByName(front))
    pairs = reached.join(values, ["field", "value"], "left_semi").select("field", F.col("start").alias("earlier"), F.col("value").alias("later"))
    return pairs.join(pairs.select("field", F.col("later").alias("earlier"), F.col("earlier").alias("later")), ["field", "earlier", "later"], "left_anti")


def field_values(records: DataFrame, *, id: str, record: str, name: str, properties: str, at: str) -> DataFrame:
    """``records`` have their rank as ``_rank``.  One row for each record and field whose value says something: (id, record, rank, at, field, value)."""
    entries = F.concat(
        F.array(F.struct(F.lit("name").alias("field"), F.col(name).alias("value"))),
        F.coalesce(F.transform(F.map_entries(properties), lambda e: F.struct(F.concat(F.lit("properties."), e["key"]).alias("field"), e["value"].alias("value"))), F.array().cast("array<struct<field:string,value:string>>")),
    )
    rows = records.filter(F.col(id).isNotNull() & F.col(record).isNotNull()).select(F.col(id).alias("id"), F.col(record).alias("record"), F.col("_rank").alias("rank"), F.col(at).alias("at"), F.explode(entries).alias("e"))
    return rows.select("id", "record", "rank", "at", "e.field", "e.value").filter(says_something(F.col("value")))


def _best_in_doubt(values: DataFrame, rank: Column, late: Column) -> DataFrame:
    """(id, field, best) where some records lack their time."""
    first = F.min(F.struct(rank.alias("rank"), late.alias("late"), F.col("record").alias("record"))).alias("first")
    # Each value once, with its own best record; all else reads these rows.
    seen = checkpoint(values.groupBy("id", "field", "value").agg(first, F.max("at").alias("at"), F.max(F.col("at").isNull()).alias("undated")))
    undated = seen.filter("undated").select("id", "field").distinct()
    in_doubt = seen.join(undated, ["id", "field"], "left_semi")
    # Only values of the best rank compete; all others have lost before order in time matters.
    leaders = in_doubt.groupBy("id", "field").agg(F.min("first.rank").alias("least"))
    open_values = checkpoint(in_doubt.join(leaders, ["id", "field"]).filter("first.rank = least").select("id", "field", "value", "first"))
    later = comes_after(open_values.select("field", "value").distinct(), learn_precedence(seen))
    names = open_values.select("id", "field", "value")
    passed = names.withColumnRenamed("value", "earlier").join(later, ["field", "earlier"]).join(names.withColumnRenamed("value", "later"), ["id", "field", "later"], "left_semi").groupBy("id", "field", F.col("earlier").alias("value")).agg(F.lit(True).alias("passed"))
    ordered = open_values.join(passed, ["id", "field", "value"], "left").select("id", "field", "value", "first", F.coalesce("passed", F.lit(False)).alias("passed"))
    dated = seen.join(undated, ["id", "field"], "left_anti").select("id", "field", "value", "first", F.lit(False).alias("passed"))
    order = F.struct("first.rank", "passed", "first.late", F.col("first.record").alias("record"), "value")
    return dated.unionByName(ordered).groupBy("id", "field").agg(F.min(order).alias("best"))


def best_fields(records: DataFrame, trust: DataFrame, *, id: str = "id", record: str = "record_id", name: str = "name", properties: str = "properties", sources: str = "sources", at: str = "updated_at", trust_source: str = "source", trust_rank: str = "trust_rank") -> DataFrame:
    """For each id with two or more records: (id, field, record, value) of the best record by field.

    Order: least trust rank of the record's sources (none listed: last), then, only in a group in which timestamps
    are missing, values that no other value of that rank in the group is known to come after, then the
    latest time (missing: last), then the smallest record.  A field without a value that says something gives no row.
    Repeated rows count once, null ids or records not at all; empty tables give an empty result.
    """
    values = field_values(ranked(records, trust, sources=sources, source=trust_source, rank=trust_rank), id=id, record=record, name=name, properties=properties, at=at)
    rank = F.coalesce("rank", F.lit((1 << 31) - 1))
    late = F.coalesce(-F.unix_micros(F.col("at").cast("timestamp")), F.lit((1 << 63) - 1))
    # Where no record lacks its time nothing is in doubt, so no value has to be compared with others: one aggregation.
    if not records.filter(F.col(id).isNotNull() & F.col(record).isNotNull() & F.col(at).isNull()).limit(1).take(1):
        best = values.groupBy("id", "field").agg(F.min(F.struct(rank.alias("rank"), late.alias("late"), F.col("record").alias("record"), F.col("value"))).alias("best"))
    else:
        best = _best_in_doubt(values, rank, late)
    several = records.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(record).alias("a"), F.max(record).alias("z")).filter("a < z").select("id")
    return best.join(several, "id", "left_semi").select("id", "field", F.col("best.record").alias("record"), F.col("best.value").alias("value"))


def survivors(records: DataFrame, trust: DataFrame, **names) -> DataFrame:
    """The surviving node of each id with two or more records: (id, name, properties, sources).

    Sources are those of all records, sorted; they are pre-aggregated as distinct (id, source) rows."""
    best = best_fields(records, trust, **names)
    prop = F.when(F.col("field") != "name", F.struct(F.substring("field", 12, 1 << 20).alias("key"), F.col("value").alias("value")))
    fields = best.groupBy("id").agg(F.max(F.when(F.col("field") == "name", F.col("value"))).alias("name"), F.map_from_entries(F.array_sort(F.collect_list(prop))).alias("properties"))
    of = records.select(F.col(names.get("id", "id")).alias("id"), F.explode(names.get("sources", "sources")).alias("source")).filter(F.col("source").isNotNull()).distinct()
    several = records.groupBy(F.col(names.get("id", "id")).alias("id")).agg(F.min(names.get("record", "record_id")).alias("a"), F.max(names.get("record", "record_id")).alias("z")).filter("a < z").select("id")
    merged = of.groupBy("id").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    return several.join(fields, "id", "left").join(merged, "id", "left")
