"""References to records that do not exist (problem 7).

Parent keys become integers within a namespace and are compressed into contiguous runs;
each distinct reference is matched as of the start of the run before it, and lies outside
if it is beyond that run's end.  Windows hold one block of a namespace, so none of them
grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import checkpoint, replicate, with_salt

BLOCK_BITS = 14


def integer_key(ref: Column) -> tuple[Column, Column, Column]:
    """Namespace, block and number of a key, such that two keys agree in all three only if equal.

    The number is the key's tail of up to 12 lower-case letters and digits, read in base 36 (so it fits
    a long); the namespace is all before it and the tail's length.  A key of any other shape is a
    namespace of its own with the number 0.
    """
    tail = F.regexp_extract(ref, "([0-9a-z]{1,12})$", 1)
    size = F.length(tail)
    space = F.when(size > 0, F.concat(F.substring(ref, F.lit(1), F.length(ref) - size), F.lit("\u0001"), size.cast("string"))).otherwise(F.concat(ref, F.lit("\u0001")))
    number = F.when(size > 0, F.conv(tail, 36, 10).cast("decimal(20,0)").cast("long")).otherwise(F.lit(0).cast("long"))
    return space, F.shiftright(number, BLOCK_BITS), number


def key_runs(parents: DataFrame, key: str) -> DataFrame:
    """Runs (space, block, start, end) of contiguous numbers among distinct parent keys."""
    space, block, number = integer_key(F.col(key))
    keys = parents.select(space.alias("space"), block.alias("block"), number.alias("n"))
    order = W.partitionBy("space", "block").orderBy("n")
    return keys.withColumn("island", F.col("n") - F.row_number().over(order)).groupBy("space", "block", "island").agg(F.min("n").alias("start"), F.max("n").alias("end")).drop("island")


def orphan_references(children: DataFrame, parents: DataFrame, *, child_key: str, child_time: str, reference_columns: dict[str, str], parent_key: str, parent_loaded: str, parent_deleted: str, heavy_rows: int = 100_000) -> DataFrame:
    """Orphan references: (child_key, side, kind, child_time), each child key, side and kind once.

    ``reference_columns`` maps a side's name to the column that holds its reference.  Keys are
    compared exactly; null and blank references are no case.  kind is 'missing' where no parent
    has the key, 'late' where the earliest load of the parent is after the child's, else
    'deleted' where the parent's earliest deletion is at or before the child's load.  A parent
    never loaded (null) or a child without load time is neither late nor deleted.  Repeated child
    rows count once.  Empty tables give an empty result.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).alias("ref")) for side, c in reference_columns.items()]))
    refs = (
        children.select(F.col(child_key).alias("child"), F.col(child_time).alias("at"), sides.alias("r"))
        .select("child", "at", "r.side", "r.ref")
        .filter(F.col("ref").isNotNull() & (F.regexp_replace("ref", r"(?U)\s+", "") != ""))
    )
    known = parents.filter(F.col(parent_key).isNotNull()).groupBy(F.col(parent_key).alias("ref")).agg(F.min(parent_loaded).alias("first_loaded"), F.min(parent_deleted).alias("first_deleted"))
    distinct = refs.groupBy("ref").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))

    space, block, number = integer_key(F.col("ref"))
    asked = distinct.select(space.alias("space"), block.alias("block"), number.alias("n"), F.lit(1).alias("what"), F.lit(None).cast("long").alias("run_end"), "ref", "first_at", "last_at")
    runs = key_runs(known, "ref").select("space", "block", F.col("start").alias("n"), F.lit(0).alias("what"), F.col("end").alias("run_end"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("timestamp_ntz" if dict(children.dtypes)[child_time] == "timestamp_ntz" else "timestamp").alias("first_at"))
    runs = runs.withColumn("last_at", F.col("first_at"))
    before = W.partitionBy("space", "block").orderBy("n", "what").rowsBetween(W.unboundedPreceding, 0)
    matched = runs.unionByName(asked).withColumn("reach", F.last("run_end", ignorenulls=True).over(before)).filter("what = 1")
    matched = matched.select("ref", "first_at", "last_at", (F.col("reach").isNull() | (F.col("n") > F.col("reach"))).alias("missing"))

    suspects = matched.join(known, "ref", "left").filter(F.col("missing") | (F.col("first_loaded") > F.col("first_at")) | (F.col("first_deleted") <= F.col("last_at")))
    suspects = checkpoint(suspects.select("ref", "missing", "first_loaded", "first_deleted"))
    rows, hot = with_salt(refs, ["ref"], F.col("child"), heavy_rows=heavy_rows)
    kind = F.when(F.col("missing"), "missing").when(F.col("first_loaded") > F.col("at"), "late").when(F.col("first_deleted") <= F.col("at"), "deleted")
    found = rows.join(replicate(suspects, ["ref"], hot), ["ref", "_salt"]).withColumn("kind", kind).filter(F.col("kind").isNotNull())
    return found.groupBy("child", "side", "kind").agg(F.min("at").alias("at")).select(F.col("child").alias(child_key), "side", "kind", F.col("at").alias(child_time))


def orphan_report(orphans: DataFrame, time: str) -> DataFrame:
    """Orphans counted per endpoint column, kind and month of loading."""
    return orphans.groupBy("side", "kind", F.date_format(time, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
