"""Which short strings stand in which texts, without comparing each with each.

Every string is looked for by one of its runs of three characters, the one that fewest texts
have; texts and strings meet by equality of that run, and only those that meet are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import checkpoint, salted_join

GRAM = 3
LONG = 8  # of runs by which many needles are looked for, if they are that long


def _grams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters, each once, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _rarest(needles: DataFrame, often: DataFrame, long: bool) -> DataFrame:
    """(needle, gram): of each needle the run that fewest texts have, by ``often`` (gram, n), which goes to every task.

    A needle with a run that no text has stands nowhere and has no row."""
    counts = often.toArrow()
    shared = needles.sparkSession.sparkContext.broadcast(dict(zip(counts["gram"].to_pylist(), counts["n"].to_pylist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            needle, gram = [], []
            for x in b["needle"].to_pylist():
                k = LONG if long and len(x) >= LONG else GRAM
                runs = {x[i : i + k] for i in range(max(1, len(x) - k + 1))}
                if all(g in often for g in runs):
                    needle.append(x)
                    gram.append(min((often[g], g) for g in runs)[1])
            yield pa.RecordBatch.from_arrays([pa.array(needle, pa.string()), pa.array(gram, pa.string())], names=["needle", "gram"])

    return needles.select("needle").mapInArrow(run, "needle string, gram string")


def contains_pairs(texts: DataFrame, needles: DataFrame, *, few: int = 20_000, shared_runs: int = 1_000_000) -> DataFrame:
    """(key, needle) where ``texts`` (key, text) holds ``needles`` (needle) as a substring, exactly as both are written.

    Each pair comes out once however often it occurs; nulls and empty needles match nothing, strings shorter than
    three characters are looked for whole.  Up to ``few`` runs looked for, as counted, go to every task, and texts are never
    shuffled.  Of more, needles are looked for by runs of eight characters where they have them; up to ``shared_runs`` runs of the texts
    go to every task, and needles with a run that no text has leave there; beyond, hot ones salted, the texts' keys are joined and what meets is verified."""
    t = texts.select("key", "text").filter("text is not null")
    n = checkpoint(needles.select("needle").filter(F.length("needle") > 0).distinct())

    def runs(size: Column) -> tuple[list[int], DataFrame]:
        """Lengths of the runs of needles, and (needle, gram)."""
        sizes = sorted(r[0] for r in n.select(size).distinct().collect())  # of 1, 2, 3 and 8
        own = F.coalesce(*[F.when(size == k, _grams(F.col("needle"), k)) for k in sizes or [GRAM]])
        return sizes, n.select("needle", F.explode(own).alias("gram"))

    size = F.least(F.length("needle"), F.lit(GRAM))
    sizes, wanted = runs(size)
    if not sizes:
        return t.select("key", F.col("text").alias("needle")).limit(0)
    grams = wanted.select("gram").distinct()
    known = grams.limit(few + 1).count() <= few
    if not known:
        sizes, wanted = runs(F.when(F.length("needle") >= LONG, LONG).otherwise(size))
    every = F.flatten(F.array(*[_grams(F.col("text"), k) for k in sizes]))
    # How many texts have each run decides by which run a needle is looked for.
    each = t.select("key", F.explode(every).alias("gram"))
    often = (each.join(F.broadcast(grams), "gram", "left_semi") if known else each).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    often = checkpoint(often)
    if known or often.limit(shared_runs + 1).count() <= shared_runs:
        rarest = checkpoint(_rarest(n, often, not known))
    else:
        rank = F.row_number().over(W.partitionBy("needle").orderBy(F.coalesce("n", F.lit(0)), "gram"))
        rarest = checkpoint(wanted.join(often, "gram", "left").withColumn("r", rank).filter("r = 1 and n is not null").select("needle", "gram"))
    if known or rarest.limit(few + 1).count() <= few:
        # A table of runs is hashed once a task; as an array in the plan it would be hashed for every text.
        hits = t.select("key", "text", F.explode(every).alias("gram")).join(F.broadcast(rarest), "gram")
    else:
        hits = salted_join(each, rarest, ["gram"], F.col("key")).select("key", "needle").join(t, "key")
    return hits.filter(F.col("text").contains(F.col("needle"))).select("key", "needle").distinct()
