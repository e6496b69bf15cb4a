from datetime import datetime

from kgweave.llm import survivor

NODE = "record_id long, id string, name string, properties map<string,string>, sources array<string>, updated_at timestamp, rank string, field string"
TRUST = "source string, trust_rank int"


def t(n):
    return datetime(2024, 1, n)


def test_rules(spark):
    trust = spark.createDataFrame([("good", 1), ("fair", 2), (None, 3)], TRUST)
    rows = [
        (1, "a", "Old", {"k": "x", "e": "N/A"}, ["fair"], t(1), None, None), (2, "a", "New", {"k": "y"}, ["fair", "unlisted"], t(2), None, None), (3, "a", " tbd ", {"k": None}, ["good"], t(3), None, None),
        (2, "a", "New", {"k": "y"}, ["fair", "unlisted"], t(2), None, None), (4, "b", "Alone", {}, ["good"], t(1), None, None), (5, "c", "X", None, None, t(1), None, None), (6, "c", "Y", None, [], t(1), None, None),
        (7, None, "Z", None, None, t(1), None, None), (8, "d", "?", {"q": "-"}, None, t(1), None, None), (9, "d", None, None, None, t(1), None, None),
    ]
    df = spark.createDataFrame(rows, NODE)
    got = {(r["id"], r["field"]): (r["record"], r["value"]) for r in survivor.best_fields(df, trust).collect()}
    assert got == {("a", "name"): (2, "New"), ("a", "properties.k"): (2, "y"), ("c", "name"): (5, "X")}
    s = {r["id"]: (r["name"], r["properties"], r["sources"]) for r in survivor.survivors(df, trust).collect()}
    assert s["a"] == ("New", {"k": "y"}, ["fair", "good", "unlisted"]) and set(s) == {"a", "c", "d"}
    assert survivor.best_fields(df.limit(0), trust).count() == 0 and survivor.best_fields(df, trust.limit(0)).count() == 3


def test_missing_times_follow_learned_order(spark):
    trust = spark.createDataFrame([("s", 1)], TRUST)
    rows = [(10 * i + j, f"n{i}", v, None, ["s"], t(j + 1), None, None) for i in range(4) for j, v in enumerate(("draft", "reviewed", "final"))]
    rows += [(100, "m", "draft", None, ["s"], None, None, None), (101, "m", "final", None, ["s"], None, None, None), (102, "m", "reviewed", None, ["s"], None, None, None), (103, "k", "other", None, ["s"], None, None, None), (104, "k", "draft", None, ["s"], None, None, None)]
    got = {r["id"]: r["value"] for r in survivor.best_fields(spark.createDataFrame(rows, NODE), trust).collect()}
    assert got["m"] == "reviewed" or got["m"] == "final"
    assert got["m"] == "final" and got["k"] == "other"


def test_order_over_values_in_between_and_cycles(spark):
    trust = spark.createDataFrame([("s", 1)], TRUST)
    chains = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "x"), ("x", "w")]
    rows = [(10 * i + j, f"n{i}", v, None, ["s"], t(j + 1), None, None) for i, c in enumerate(chains) for j, v in enumerate(c)]
    rows += [(100, "m", "a", None, ["s"], None, None, None), (101, "m", "c", None, ["s"], None, None, None)]
    rows += [(110, "k", "y", None, ["s"], None, None, None), (111, "k", "z", None, ["s"], None, None, None), (112, "k", "w", None, ["s"], None, None, None)]
    got = {r["id"]: r["value"] for r in survivor.best_fields(spark.createDataFrame(rows, NODE), trust).collect()}
    assert got["m"] == "c" and got["k"] == "w"


def test_undated_pair_of_a_chain(spark):
    trust = spark.createDataFrame([("s", 1)], TRUST)
    rows = [(10 * i + j, f"n{i}", v, None, ["s"], t(j + 1), None, None) for i in range(4) for j, v in enumerate(("draft", "reviewed", "final"))]
    rows += [(100, "m", "draft", None, ["s"], None, None, None), (101, "m", "final", None, ["s"], None, None, None)]
    got = {r["id"]: r["value"] for r in survivor.best_fields(spark.createDataFrame(rows, NODE), trust).collect()}
    assert got["m"] == "final"


def test_more_sources_than_the_plan_holds(spark):
    trust = spark.createDataFrame([(f"s{i}", i + 1) for i in range(10_001)], TRUST)
    rows = [(1, "a", "X", None, ["s10000", "none", "s3"], t(1), None, None), (2, "a", "Y", None, ["s4"], t(2), None, None), (3, "b", "U", None, None, t(1), None, None), (4, "b", "V", None, ["s10000"], t(1), None, None), (5, "c", "P", None, ["s3"], t(1), None, None), (6, "c", "Q", None, [], t(2), None, None)]
    df = spark.createDataFrame(rows, NODE)
    few = {(r["id"], r["value"]) for r in survivor.best_fields(df, trust.filter("source in ('s10000', 's3', 's4')")).collect()}
    assert {(r["id"], r["value"]) for r in survivor.best_fields(df, trust).collect()} == few == {("a", "X"), ("b", "V"), ("c", "P")}
