import random

from hypothesis import given, settings
from hypothesis import strategies as st

from kgweave.llm.chunk import cut_points, split_texts

ARGS = dict(limit=1500, overlap=200, least=500)


def check(text, **args):
    args = {**ARGS, **args}
    p = cut_points(text, **args)
    if len(text) <= args["limit"]:
        assert p == [(0, len(text))]
        return p
    assert p[0][0] == 0 and p[-1][1] == len(text)
    for (a, z), (b, y) in zip(p, p[1:], strict=False):
        assert a < b <= z and z - b <= args["overlap"] and z < y
    assert all(0 < z - a <= args["limit"] for a, z in p)
    return p


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .,;\n\téß界😀é‍。"), max_size=400), st.integers(20, 60))
def test_pieces_hold(text, limit):
    check(text, limit=limit, overlap=limit // 6, least=limit // 3)


def test_no_boundary_and_very_long():
    check("x" * 10_000)
    check(" " * 5_000)
    check("́" * 5_000)
    check("word " * 200_000)


def test_cuts_stand_at_sentences():
    text = " ".join(f"Sentence number {i} says something about item {i * 7}." for i in range(300))
    assert all(text[:z].rstrip().endswith(".") for _, z in check(text)[:-1])


def test_an_edit_moves_only_its_neighbours():
    r = random.Random(1)
    words = [f"w{r.randrange(5000)}" + (". " if r.random() < 0.1 else " ") for _ in range(8000)]
    text = "".join(words)
    ends = {len(text) - z for _, z in check(text)}
    changed = text[:3000] + "an inserted remark. " + text[3000:]
    again = {len(changed) - z for _, z in check(changed)}
    assert len(ends & again) >= 0.8 * len(ends)


def test_table(spark):
    df = spark.createDataFrame([("a", 1, None, 9), ("a", 2, "", 9), ("a", 3, "y " * 1500, 9), ("a", 4, "z" * 1500, 9)], "src string, id long, text string, piece int")
    out = split_texts(df, keys=["src", "id"], text="text")
    assert {(r["id"], r["n"]) for r in out.groupBy("id").count().withColumnRenamed("count", "n").collect()} >= {(2, 1), (4, 1)}
    assert out.filter("id = 1").count() == 0 and out.filter("id = 3").count() >= 2
    parts = out.filter("id = 3").orderBy("piece").collect()
    text = ""
    for p in parts:
        text = text[: p["start"]] + p["text"]
    assert text == "y " * 1500
    assert split_texts(df.limit(0), keys=["id"], text="text").count() == 0
