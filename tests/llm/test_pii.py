import numpy as np
import pyarrow.parquet as pq

from kgweave.llm import pii, pii_model, pii_train

from pii_by_hand import CASES

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"  # its texts were left out of training, see pii_train


def texts():
    return [t for t in pq.read_table(DOCUMENTS, columns=["text"]).to_pydict()["text"] if t]


def test_accuracy_by_kind():
    for kind, (p, r) in pii_train.score(pii_model.Tagger(), texts()).items():
        assert p >= 0.95 and r >= 0.95, kind


def test_texts_by_hand():
    """Names, numbers and places of no common source: most must be found, and little else."""
    hit = said = true = 0
    for (text, gold), spans in zip(CASES, pii.tag_texts([t for t, _ in CASES]), strict=True):
        got = {(k, text[a:b]) for a, b, k in spans}
        hit, said, true = hit + len(got & set(gold)), said + len(got), true + len(gold)
    assert hit >= 0.7 * true and hit >= 0.75 * said


def test_pieces_decode_as_the_whole():
    tagger = pii_model.Tagger()
    ems = tagger.emissions([pii_model.encode(" ".join(texts()[k : k + 4])[:6000]) for k in range(0, 40, 4)])
    for whole, cut in zip(tagger._viterbi(ems), tagger._tags(ems, piece=50), strict=True):
        assert (whole == cut).all()


def test_results_don_t_depend_on_company():
    t = texts()[:60]
    tagger = pii_model.Tagger()
    assert tagger.spans(t) == [tagger.spans([x])[0] for x in t]


def test_viterbi_against_brute_force():
    tagger = pii_model.Tagger()
    r = np.random.default_rng(2)
    em = r.normal(size=(4, pii_model.K)).astype(np.float32)
    best = max(np.ndindex(*[pii_model.K] * 4), key=lambda p: sum(em[i, k] for i, k in enumerate(p)) + sum(tagger.w["T"][a, b] for a, b in zip(p, p[1:], strict=False)))
    assert tuple(tagger._viterbi([em])[0]) == best


def test_gradients():
    r = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in pii_model.init(hidden=3, embed=4).items()}
    x, y = r.integers(0, 30, (2, 8)), r.integers(0, pii_model.K, (2, 8))
    _, g = pii_model.step(w, x, y)
    for name in w:
        at = np.unravel_index(int(np.argmax(np.abs(g[name]))), g[name].shape)
        old, out = w[name][at], []
        for d in (1e-3, -1e-3):
            w[name][at] = old + d
            out.append(pii_model.step(w, x, y)[0])
        w[name][at] = old
        assert abs((out[0] - out[1]) / 2e-3 - g[name][at]) < 2e-2 * max(1, abs(g[name][at])), name


def test_table(spark):
    mail = "Contact: aisha.torvovic@clinicpelqhurst.test, tel +44 7700 900378."
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "  ", "k"), (4, mail, "k"), (4, mail, "k"), (5, "nothing to see here " * 20_000, "k")], "doc_id long, text string, kind string")
    got = {tuple(r) for r in pii.find_pii(df, key="doc_id", text="text").collect()}
    assert (4, "email", "aisha.torvovic@clinicpelqhurst.test") in got and (4, "phone", "+44 7700 900378") in got and {g[0] for g in got} == {4}
    red = {r["doc_id"]: r["text"] for r in pii.redact(df, key="doc_id", text="text").collect()}
    assert red[1] is None and red[2] == "" and red[4] == "Contact: [EMAIL], tel [PHONE]." and red[5] == "nothing to see here " * 20_000
    assert pii.find_pii(df.limit(0), key="doc_id", text="text").count() == 0


def test_redaction_keeps_the_rest(spark):
    t = texts()[:200]
    spans = list(pii.tag_texts(t))
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    red = {r["doc_id"]: r["text"] for r in pii.redact(df, key="doc_id", text="text").collect()}
    for i, (x, s) in enumerate(zip(t, spans, strict=True)):
        rest = x
        for a, b, kind in reversed(s):
            rest = rest[:a] + pii.PLACEHOLDERS[kind] + rest[b:]
        assert red[i] == rest


def test_every_character_is_decoded():
    tagger = pii_model.Tagger()
    t = [*texts()[:20], "x", ""]
    assert tagger.stretches(t) == [(i, 0, len(x)) for i, x in enumerate(t) if x]
    for name, text in (("Elena Rossi", "The patient, Elena Rossi, was seen again on the ward.\nKDKL4 expression was variable"), ("Laura Schmidt", "The patient, Laura Schmidt, was seen again on the ward.\nPlease copy the result to P")):
        assert [text[a:b] for a, b, _ in tagger.spans([text])[0]] == [name]
