"""Top N items within every group by simultaneous bisection (problem 1).

Each row gets an order-preserving code of whole numbers, most significant first; larger is
better.  All groups refine their cutoffs at once: a round counts, per group, the rows in
the cells between seven midpoints (three halvings), keeps the cell in which the N-th row
lies and shrinks it to the least and greatest code seen in it.  A group is done when the rows
above its cutoff are exactly N.  Nothing is sorted, no group is ever gathered in one task,
and each round's counts are added up before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.runtime import checkpoint, replicate, with_salt

CELLS = 8
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def score_code(score: Column) -> Column:
    """The double's bits as a long with the doubles' order; -0.0 is 0.0.  Null and NaN must be filtered before."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), score + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(MOST)))


def descending(number: Column) -> Column:
    """A whole number as it is, null last."""
    return F.coalesce(number.cast("long"), F.lit(LEAST))


def ascending(number: Column) -> Column:
    """A whole number with its order turned round, null last."""
    return F.coalesce(F.bitwise_not(number.cast("long")), F.lit(LEAST))


def _word(k: Column, words: int) -> Column:
    out = F.col("w0")
    for i in range(1, words):
        out = F.when(k == i, F.col(f"w{i}")).otherwise(out)
    return out


def top_n(rows: DataFrame, *, group: list[str], code: list[Column], item: str, n: Column | int, heavy_rows: int = 100_000) -> DataFrame:
    """The ``n`` first rows of each group as (group columns, item), a repeated row counted once.

    ``code`` columns are longs, larger is better, and must tell any two items of a group
    apart (put the identifier in last); ``n`` may depend on the group only.  Groups with a
    null column, and rows with a null code, have no place in the order and are left out:
    filter or map them beforehand if they should count.  A group of ``n`` rows or fewer comes
    out whole.  Empty tables give an empty result.
    """
    m = len(code)
    ws = [f"w{i}" for i in range(m)]
    base = rows.select(*group, F.col(item).alias("_item"), *[c.cast("long").alias(w) for c, w in zip(code, ws, strict=True)], (F.lit(n) if isinstance(n, int) else n).cast("long").alias("_n"))
    base = base.dropna(subset=[*group, *ws]).dropDuplicates([*group, "_item", *ws])
    salted, hot = with_salt(checkpoint(base), group, F.col("_item"), heavy_rows=heavy_rows)
    base = checkpoint(salted)

    first = base.groupBy(*group).agg(F.count(F.lit(1)).alias("cnt"), F.min("w0").alias("lo"), F.max("w0").alias("hi"), F.max("_n").alias("need"))
    prefix = [f"p{i}" for i in range(m)]
    state = first.select(*group, F.when(F.col("cnt") <= F.col("need"), F.lit(LEAST)).otherwise(F.col("lo")).alias("lo"), "hi", "need", "cnt", F.lit(0).alias("k"), (F.col("cnt") <= F.col("need")).alias("done"), *[F.lit(LEAST).alias(p) for p in prefix])
    state = checkpoint(state)
    done, active, size = [state.filter("done")], base, None
    while True:
        still = state.filter("not done")
        open_rows = still.agg(F.sum("cnt")).first()[0]
        if open_rows is None:
            break
        if size is None or open_rows * 4 < size:
            active, size = checkpoint(_within(active, still, group, hot, m).select(*base.columns)), open_rows
        state = checkpoint(_refine(_within(active, still, group, hot, m), group, m))
        done.append(state.filter("done"))
    cuts = done[0]
    for d in done[1:]:
        cuts = cuts.unionByName(d)
    cut = [F.when(F.col("k") > i, F.col(f"p{i}")).when(F.col("k") == i, F.col("lo")).otherwise(F.lit(LEAST)) for i in range(m)]
    cuts = cuts.select(*group, *[c.alias(f"c{i}") for i, c in enumerate(cut)])
    joined = base.join(replicate(cuts, group, hot), [*group, "_salt"])
    keep = F.lit(True)
    for i in reversed(range(m)):
        keep = (F.col(f"w{i}") > F.col(f"c{i}")) | ((F.col(f"w{i}") == F.col(f"c{i}")) & keep)
    return joined.filter(keep).select(*group, F.col("_item").alias(item))


def _within(active: DataFrame, state: DataFrame, group: list[str], hot: DataFrame, m: int) -> DataFrame:
    """Rows that tie with their group's prefix and lie between its bounds, with the state."""
    j = active.drop("_n").join(replicate(state, group, hot), [*group, "_salt"]).withColumn("_n", F.col("need"))
    tie = F.lit(True)
    for i in range(m):
        tie = tie & ((F.col("k") <= i) | (F.col(f"w{i}") == F.col(f"p{i}")))
    w = _word(F.col("k"), m)
    return j.filter(tie & (w >= F.col("lo")) & (w <= F.col("hi")))


def _refine(rows: DataFrame, group: list[str], m: int) -> DataFrame:
    """One round: counts by cell, then the cell that holds the N-th row."""
    w = _word(F.col("k"), m)
    exact = F.try_subtract("hi", "lo")
    part = F.when(exact.isNotNull(), F.try_subtract(w, F.col("lo")).cast("double") / (exact.cast("double") + 1)).otherwise((w.cast("double") - F.col("lo").cast("double")) / (F.col("hi").cast("double") - F.col("lo").cast("double")))
    cell = F.least(F.lit(CELLS - 1), F.floor(part * CELLS).cast("int"))
    rows = rows.withColumn("_w", w).withColumn("_cell", cell)
    aggs = [F.first(c).alias(c) for c in ("k", "need", *[f"p{i}" for i in range(m)])]
    for c in range(CELLS):
        at = F.when(F.col("_cell") == c, F.col("_w"))
        aggs += [F.count(at).alias(f"n{c}"), F.min(at).alias(f"a{c}"), F.max(at).alias(f"z{c}")]
    s = rows.groupBy(*group).agg(*aggs)
    above, pick = F.lit(0).cast("long"), None
    for c in reversed(range(CELLS)):
        here = F.struct(F.col(f"a{c}").alias("lo"), F.col(f"z{c}").alias("hi"), F.col(f"n{c}").alias("cnt"), (F.col("need") - above).alias("need"))
        reached = above + F.col(f"n{c}") >= F.col("need")
        pick = F.when(reached, here) if pick is None else pick.when(reached, here)
        above = above + F.col(f"n{c}")
    s = s.withColumn("_s", pick).select(*group, "k", *[f"p{i}" for i in range(m)], "_s.lo", "_s.hi", "_s.cnt", "_s.need")
    done = F.col("cnt") <= F.col("need")
    tied = ~done & (F.col("lo") == F.col("hi")) & (F.col("k") < m - 1)
    s = s.withColumn("done", done | ((F.col("lo") == F.col("hi")) & (F.col("k") == m - 1)))
    return s.select(
        *group,
        F.when(tied, F.lit(LEAST)).otherwise(F.col("lo")).alias("lo"),
        F.when(tied, F.lit(MOST)).otherwise(F.col("hi")).alias("hi"),
        "need",
        "cnt",
        F.when(tied, F.col("k") + 1).otherwise(F.col("k")).cast("int").alias("k"),
        "done",
        *[F.when(tied & (F.col("k") == i), F.col("lo")).otherwise(F.col(f"p{i}")).alias(f"p{i}") for i in range(m)],
    )
