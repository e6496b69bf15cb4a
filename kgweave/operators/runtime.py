"""Session facts the operators share: where to cut lineage, and how to spread hot keys."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder all executors share and read it from there.

    The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset and no
    folder has been set on the context a temporary one is made, and that only in a local session:
    on a cluster, executors could not read it, so there it is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kgweave-"))
    return df.checkpoint(eager=True)


def with_salt(rows: DataFrame, keys: list[str], spread_by: Column, *, salts: int = 32, heavy_rows: int = 100_000, name: str = "_salt") -> tuple[DataFrame, list[int]]:
    """Give rows of hot keys one of ``salts`` numbers, all others 0; return them and the hashes of the hot keys.

    A key is hot when it holds more than ``heavy_rows`` rows and more than a 512th of all.
    So there are fewer than 512 hot keys however large the table: that is why they may be
    read to the driver and stand in the plan as constants.  Another key of the same hash is salted as well,
    on both sides.  ``spread_by`` is any column that differs among the rows of one key.
    """
    counts = checkpoint(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > heavy_rows))
    total = rows.count() if counts.take(1) else 0
    hot = sorted({r[0] for r in counts.filter(F.col("_n") > total / 512).select(F.xxhash64(*keys)).collect()})
    salt = F.when(F.xxhash64(*keys).isin(hot), F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(0) if hot else F.lit(0)
    return rows.withColumn(name, salt), hot


def replicate(side: DataFrame, keys: list[str], hot: list[int], *, salts: int = 32, name: str = "_salt") -> DataFrame:
    """The other side of a salted join: rows of hot keys once for each salt, all others with salt 0.

    The key columns must have the types they have on the salted side."""
    if not hot:
        return side.withColumn(name, F.lit(0))
    numbers = F.when(F.xxhash64(*keys).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return side.withColumn(name, F.explode(numbers))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread_by: Column, *, how: str = "inner", heavy_rows: int = 100_000) -> DataFrame:
    """Join on ``keys`` with the rows of ``left``'s hot keys spread over tasks; ``how`` is a join that keeps or filters the left side."""
    salted, hot = with_salt(left, keys, spread_by, heavy_rows=heavy_rows)
    return salted.join(replicate(right, keys, hot), [*keys, "_salt"], how).drop("_salt")


def running_totals(rows: DataFrame, order: list[Column], totals: dict[str, str], *, parts: int | None = None) -> DataFrame:
    """``rows`` with, for each new name in ``totals``, the sum of a column over this row and all before it in ``order``.

    The order must tell any two rows apart.  Rows are split into ranges of it, each range is summed in its own task and
    the ranges' sums, one row each, are added up; so no task sees all rows."""
    parts = parts or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    ranged = checkpoint(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    own = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(totals.values())])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    own = own.select("_part", *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(totals))])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = ranged.join(own, "_part").withColumns({name: F.sum(c).over(inside) + F.col(f"_b{i}") for i, (name, c) in enumerate(totals.items())})
    return summed.drop("_part", *[f"_b{i}" for i in range(len(totals))])
