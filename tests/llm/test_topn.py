import math
import random

from pyspark.sql import functions as F

from kgweave.llm import topn

SCHEMA = "g string, item long, score double, e int, w0 string, cnt string"


def brute(rows, n):
    groups = {}
    for g, i, s, e, *_ in set(rows):
        if g is not None and i is not None and s is not None and not math.isnan(s):
            groups.setdefault(g, []).append((-s, -e if e is not None else math.inf, i))
    return {(g, i) for g, v in groups.items() for *_, i in sorted(v)[:n]}


def run(spark, rows, n, **more):
    df = spark.createDataFrame(rows, SCHEMA).filter("score is not null and not isnan(score)")
    code = [topn.score_code(F.col("score")), topn.descending(F.col("e")), topn.ascending(F.col("item"))]
    out = topn.top_n(df, group=["g"], code=code, item="item", n=n, **more).collect()
    assert len(out) == len({tuple(r) for r in out})
    return {tuple(r) for r in out}


def test_against_sorting(spark):
    r = random.Random(3)
    scores = [None, math.nan, 0.0, -0.0, -1.5, 0.3, 0.3, 0.30000000000000004, 1.0, 1e300, -1e300, 5e-324, math.inf]
    rows = [(f"g{int(r.random() ** 3 * 9)}", i, r.choice(scores) if r.random() < 0.5 else r.random(), r.choice([None, 0, 1, -5, 2**31 - 1]), "x", "y") for i in range(900)]
    rows += rows[:60] + [(None, 5000, 1.0, 1, None, None), ("hot", 0, 0.5, 1, None, None)] + [("hot", i, 0.5, 7, None, None) for i in range(1, 700)]
    assert run(spark, rows, 5) == brute(rows, 5)
    assert run(spark, rows, 3, heavy_rows=100) == brute(rows, 3)


def test_far_codes_and_small_groups(spark):
    rows = [("a", i, 1.0, None, None, None) for i in (-(2**63) + 1, 2**63 - 1, 0, 1, 2, 3)] + [("b", 1, 2.0, None, None, None)]
    assert run(spark, rows, 2) == brute(rows, 2)
    assert run(spark, [], 2) == set()
