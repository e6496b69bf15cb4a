from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kgweave.operators.orphans import integer_key, key_runs, orphan_references, orphan_report

T0 = datetime(2024, 1, 1)
EDGE = "edge_id long, source_id string, target_id string, loaded_at timestamp, ref string, kind string"
NODE = "id string, loaded_at timestamp, deleted_at timestamp, space string"
NAMES = dict(child_key="edge_id", child_time="loaded_at", reference_columns={"source": "source_id", "target": "target_id"}, parent_key="id", parent_loaded="loaded_at", parent_deleted="deleted_at")


def day(n):
    return T0 + timedelta(days=n)


def brute(edges, nodes):
    out = set()
    for e, s, t, at, *_ in edges:
        for side, ref in (("source", s), ("target", t)):
            if ref is None or not ref.strip():
                continue
            own = [n for n in nodes if n[0] == ref]
            if not own:
                out.add((e, side, "missing"))
            elif min(n[1] for n in own) > at:
                out.add((e, side, "late"))
            elif any(n[2] is not None for n in own) and min(n[2] for n in own if n[2]) <= at:
                out.add((e, side, "deleted"))
    return out


def test_against_brute_force(spark):
    nodes = [(f"gene:x{i:05d}", day(0), None, "clash") for i in range(1, 60) if i % 7] + [("gene:hub0", day(5), None, None), ("gene:x00001", day(3), day(8), None), ("odd key!", day(0), None, None), ("gene:" + "z" * 20, day(0), None, None), (None, day(0), None, None)]
    refs = [f"gene:x{i:05d}" for i in range(0, 64)] + [" gene:x00001", "GENE:X00001", "gene:x0001", "gene:hub0", "odd key!", "odd key?", "gene:" + "z" * 20, "", "  ", None, "x00001"]
    edges = [(i, refs[i % len(refs)], refs[(i * 7) % len(refs)], day(i % 12), "c", "k") for i in range(400)]
    edges += edges[:20] + [(1000 + i, "gene:nowhere", "gene:hub0", day(6), None, None) for i in range(200)]
    for heavy in (100_000, 50):
        got = orphan_references(spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE), heavy_rows=heavy, **NAMES)
        assert {tuple(r)[:3] for r in got.collect()} == brute(edges, nodes)
        assert got.count() == len(brute(edges, nodes))


def test_empty(spark):
    e, n = spark.createDataFrame([], EDGE), spark.createDataFrame([], NODE)
    assert orphan_references(e, n, **NAMES).count() == 0
    one = spark.createDataFrame([(1, "a", None, day(0), None, None)], EDGE)
    assert [tuple(r)[:3] for r in orphan_references(one, n, **NAMES).collect()] == [(1, "source", "missing")]
    assert orphan_report(orphan_references(one, n, **NAMES), "loaded_at").collect()[0]["month"] == "2024-01"


def test_keys_are_told_apart_and_runs_joined(spark):
    ids = ["gene:x00001", "gene:x00002", "gene:x00003", "gene:x00005", "drug:x00004", "gene:y00004", "gene:x0004", "gene:x00001 ", "G:X00001", "", "a", "1"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    space, block, number = integer_key(F.col("id"))
    assert df.select(space, block, number).distinct().count() == len(ids)
    runs = key_runs(df, "id").filter("space like 'gene:%'").collect()
    assert max(r["end"] - r["start"] for r in runs) == 2


@pytest.mark.parametrize("n", [1])
def test_hot_reference_is_whole(spark, n):
    nodes = spark.createDataFrame([("gene:a", day(0), None, None)], NODE)
    edges = spark.range(3000).select(F.col("id").alias("edge_id"), F.lit("gene:b").alias("source_id"), F.lit("gene:a").alias("target_id"), F.lit(day(1)).alias("loaded_at"))
    assert orphan_references(edges, nodes, heavy_rows=100, **NAMES).count() == 3000
