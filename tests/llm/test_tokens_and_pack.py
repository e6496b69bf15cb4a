import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kgweave.llm import pack, tokens

ENCODER = tokens.Encoder(part_chars=500)


@pytest.fixture(scope="module")
def public():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


EDGES = ["", " ", "  x", "\n\n x", "'s's're don't  it's 'single  \n", "''s !'s  's '\n's", "x'lls", "日本語 テスト", "á 1²3٣", "<|endoftext|>", "a" * 3000, "\t \t", "ab'", "'", "no'T I'LL"]


def test_like_the_public_library(public):
    got = list(ENCODER.encode(EDGES))
    assert got == [public(x) for x in EDGES]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abst'llrevdm 10.,!\n\té界😀​"), max_size=60), max_size=6))
def test_random_texts(texts):
    t = pytest.importorskip("tokenizers").Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    got = list(ENCODER.encode(texts))
    assert got == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [ENCODER.decode(i) for i in got] == texts


def test_blocks_don_t_matter():
    text = "It's a test: don't stop, 12 times!  \n" * 40
    sym = tokens.symbols(np.frombuffer((text + "\0").encode("utf-32-le"), np.uint32), np.arange(len(text) + 1) == len(text))
    runs = [tokens.piece_starts(sym, block=b) for b in (1, 3, 64, 10_000)]
    assert all((r == runs[0]).all() for r in runs)


def test_table(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "Hello world", 5)], "id long, text string, ids int")
    got = {r["id"]: (r["ids"], r["offsets"]) for r in tokens.encode_texts(df, key="id", text="text", with_offsets=True).collect()}
    assert got[1] == got[2] == ([], []) and got[3][1] == [0, 5]
    assert {r["id"]: r["tokens"] for r in tokens.count_tokens(df, key="id", text="text").collect()} == {1: 0, 2: 0, 3: 2}
    assert tokens.encode_texts(df.limit(0), key="id", text="text").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), min_size=1, max_size=8), st.integers(1, 40))
def test_fullest_is_exact(counts, room):
    best = {0}
    for length, n in counts.items():
        best |= {b + length * k for b in best for k in range(n + 1) if b + length * k <= room}
    got = pack.fullest(counts, room)
    assert sum(k * v for k, v in got.items()) == max(best) and all(v <= counts[k] for k, v in got.items())


def test_pack(spark):
    r = np.random.default_rng(1)
    sizes = [int(x) for x in r.integers(1, 70, 3000)] + [0] * 500 + [250, 100, 200]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)] + [(9000, None, "x"), (9001, -5, "x")], "id long, n int, piece string")
    for rows in (200_000, 300):
        out = pack.pack(df, key="id", size="n", capacity=100, bucket_rows=rows).toPandas()
        assert out.groupby("id")["size"].sum().to_dict() == {**dict(enumerate(sizes)), 9000: 0, 9001: 0}
        full = out.groupby("container")["size"].sum()
        assert full.max() <= 100 and len(full) <= -(-sum(sizes) // 100) + 1
        assert (out.groupby("id").size() > 1).sum() == 2  # only what exceeds a container is cut
        assert out[out["size"] == 0].groupby("container").size().max() <= 2
    assert pack.pack(df.limit(0), key="id", size="n", capacity=100).count() == 0
    assert pack.pack(df.filter("n = 0"), key="id", size="n", capacity=100).select("container").distinct().count() == 1
