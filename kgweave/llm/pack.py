"""Filling fixed-capacity containers with items (problem 9).

Minimum bin slack over a histogram of lengths: the fullest feasible combination with the
longest item left is found by a bitset subset-sum dynamic programme, and taken as many
times as the lengths last.  The histogram has at most ``capacity`` entries however many
items there are, so the plan is made on the driver and carried out by all tasks alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.runtime import checkpoint


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the greatest sum up to ``room``; longer lengths first."""
    reach, trail = 1, []
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left > 0:  # multiples in powers of two
            take = min(size, left)
            more = (reach | reach << (length * take)) & mask
            trail.append((length, take, reach))
            left, size, reach = left - take, size * 2, more
            if reach & goal:
                break
        if reach & goal:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(trail):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Segments (length, first rank, last rank + 1, items a bin, first bin) and the number of bins."""
    left = {k: v for k, v in histogram.items() if 0 < k <= capacity and v > 0}
    used: dict[int, int] = {}
    segments, bins = [], 0
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        need = fullest({k: v for k, v in rest.items() if v}, capacity - seed)
        need[seed] = need.get(seed, 0) + 1
        times = min(left[k] // v for k, v in need.items())
        for k, v in need.items():
            a = used.get(k, 0)
            segments.append((k, a, a + times * v, v, bins))
            used[k] = a + times * v
            left[k] -= times * v
            if not left[k]:
                del left[k]
        bins += times
    return segments, bins


def pack(items: DataFrame, *, key: str, size: str, capacity: int, bucket_rows: int = 200_000) -> DataFrame:
    """(key, piece, container, size): every item assigned to a container of ``capacity``.

    Keys must be unique.  An item longer than the capacity, and no other, is cut into pieces of the whole capacity and a
    rest; piece counts from 0.  Items of size 0, and those of null or negative size as such, take no room and are
    spread over the containers (container 0 if there are none).  Containers are numbered from 0.  The plan depends
    on the sizes only and each key's place on its hash and value, so the result is the same at every run.
    """
    sized = items.select(F.col(key), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("_size"))
    last = F.when(F.col("_size") > 0, F.floor((F.col("_size") - 1) / capacity)).otherwise(0).cast("int")
    parts = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    parts = checkpoint(parts.select(key, "piece", F.least(F.lit(capacity), F.col("_size") - F.col("piece").cast("long") * capacity).cast("int").alias("size")))
    histogram = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments, bins = plan_bins(histogram, capacity)
    buckets = max(1, -(-sum(histogram.values()) // bucket_rows))
    spread = parts.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    offsets = spread.groupBy("size", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.withColumn("_from", F.sum("n").over(W.partitionBy("size").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))).select("size", "_bucket", F.coalesce("_from", F.lit(0)).alias("_from"))
    place = F.row_number().over(W.partitionBy("size", "_bucket").orderBy(key, "piece")) - 1
    ranked = spread.withColumn("_at", place).join(offsets, ["size", "_bucket"]).select(key, "piece", "size", (F.col("_from") + F.col("_at")).alias("_rank"))

    by_size: dict[int, tuple] = {}
    for length in {s[0] for s in segments}:
        own = sorted(s[1:] for s in segments if s[0] == length)
        by_size[length] = tuple(np.array(x, np.int64) for x in zip(*own, strict=True))
    schema = T.StructType([parts.schema[key], parts.schema["piece"], T.StructField("container", T.LongType()), T.StructField("size", T.IntegerType())])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rank, sizes = pdf["_rank"].to_numpy(np.int64), pdf["size"].to_numpy()
            out = rank % max(bins, 1)
            for length in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == length)
                first, _, each, start = by_size[int(length)]
                k = np.searchsorted(first, rank[rows], "right") - 1
                out[rows] = start[k] + (rank[rows] - first[k]) // each[k]
            yield pd.DataFrame({key: pdf[key], "piece": pdf["piece"], "container": out, "size": sizes})

    return ranked.mapInPandas(assign, schema)
