import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kgweave.llm import canon, match


def marginals(pairs, further_a, further_b):
    """By counting all sets of pairs."""
    total, each = 0.0, dict.fromkeys([(a, b) for a, b, _ in pairs], 0.0)
    for chosen in itertools.product((0, 1), repeat=len(pairs)):
        taken = [p for p, c in zip(pairs, chosen, strict=True) if c]
        weight = math.exp(sum(t for _, _, t in taken))
        for side, w in ((0, further_a), (1, further_b)):
            for n in Counter(p[side] for p in taken).values():
                weight *= w ** (n - 1)
        total += weight
        for a, b, _ in taken:
            each[(a, b)] += weight
    return {k: v / total for k, v in each.items()}


def beliefs(spark, pairs, **how):
    df = spark.createDataFrame(pairs, "a string, b string, theta double")
    return {(r["a"], r["b"]): r["confidence"] for r in match.believe(df, tolerance=1e-6, **how).collect()}


@pytest.mark.parametrize("further", [(0.5, 0.0), (0.0, 0.0), (1.0, 0.0), (0.3, 0.7)])
def test_belief_is_exact_on_a_tree(spark, further):
    pairs = [("a1", "b", 1.0), ("a2", "b", 0.5), ("a2", "c", -1.0), ("a2", "d", 2.0), ("a3", "d", 0.2), ("a4", "e", -0.5)]
    want = marginals(pairs, *further)
    got = beliefs(spark, pairs, further_a=further[0], further_b=further[1])
    assert all(math.isclose(got[k], want[k], abs_tol=1e-4) for k in want)


def test_belief_on_a_cycle_sees_both_sides(spark):
    """Two records a side, all four pairs: a1 and a2 both look most like b1, but a2 has nothing else."""
    pairs = [("a1", "b1", 2.0), ("a1", "b2", 1.6), ("a2", "b1", 2.0), ("a2", "b2", -2.0)]
    want, got = marginals(pairs, 0.0, 0.0), beliefs(spark, pairs, further_a=0.0, further_b=0.0)
    assert all(math.isclose(got[k], want[k], abs_tol=0.1) for k in want)
    assert got[("a1", "b2")] > 0.5 > got[("a1", "b1")] and got[("a2", "b1")] > 0.5  # b1's own softmax can't tell a1 from a2
    alone = math.exp(2.0) / (1 + 2 * math.exp(2.0))
    assert got[("a2", "b1")] > alone + 0.1
    want, got = marginals(pairs, 0.5, 0.0), beliefs(spark, pairs)
    assert all(math.isclose(got[k], want[k], abs_tol=0.05) for k in want) and match.believe(spark.createDataFrame(pairs, "a string, b string, theta double").limit(0)).count() == 0


@pytest.mark.parametrize("further", [(0.5, 0.0), (0.0, 0.0), (1.0, 0.0), (0.3, 0.7)])
def test_belief_in_one_task_equals_joins(spark, further):
    r = random.Random(5)
    pairs = {(f"a{r.randrange(12)}", f"b{r.randrange(12)}"): r.uniform(-3, 3) for _ in range(40)} | {("alone", "too"): 1.5}
    df = spark.createDataFrame([(*k, v) for k, v in pairs.items()], "a string, b string, theta double")
    one, joined = ({(x["a"], x["b"]): x["confidence"] for x in match.believe(df, further_a=further[0], further_b=further[1], one_task=n).collect()} for n in (1_000_000, 0))
    assert set(one) == set(joined) == set(pairs)
    assert all(math.isclose(one[k], joined[k], abs_tol=1e-12) for k in pairs) and math.isclose(one["alone", "too"], 1 / (1 + math.exp(-1.5)))
    with pytest.raises(Exception, match="messages still move"):
        match.believe(df, rounds=1).count()


def test_near_pairs_at_every_length(spark):
    """All keys within the slips allowed, none else: against comparing everything with everything."""
    r = random.Random(3)
    left = ["".join(r.choices("abcd", k=n)) for n in (3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 40) for _ in range(3)] + ["abcdefgh", "abcdefghi"]

    def slip(s):
        i, c = r.randrange(len(s)), r.choice("abcd")
        return r.choice([s[:i] + s[i + 1 :], s[:i] + c + s[i:], s[:i] + c + s[i + 1 :], s[: i - 1] + s[i] + s[i - 1] + s[i + 1 :] if i else s])

    right = [slip(slip(s)) for s in left for _ in range(3)] + [slip(s) for s in left for _ in range(2)] + ["abcdefgx", "abcdefghx"]

    def slips(a, b):  # restricted Damerau distance
        d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    near = match.near_pairs(spark.createDataFrame([(s, s) for s in set(left)], "a string, key string"), spark.createDataFrame([(s, s) for s in set(right)], "b string, key string"))
    got = {(x["ka"], x["kb"]) for x in near.collect()}
    for a in set(left):
        for b in set(right):
            least = min(len(a), len(b))
            if a != b and least >= match.SHORT and slips(a, b) <= (2 if least >= match.LONG else 1):
                assert (a, b) in got
    assert ("abcdefgh", "abcdefgx") in got and ("abcdefghi", "abcdefghx") in got and all(min(map(len, p)) >= match.SHORT for p in got)


D = "chembl_id string, name string, synonyms array<string>, mechanism string, max_phase int, key string"
P = "drug_id string, drug_name string, mechanism string, phase int, b string"


def test_drugs(spark):
    drugs = spark.createDataFrame([
        ("C1", "GIDOBANONUNIB TOSYLATE", None, "LLD1 inhibitor", 2, "x"), ("C1", "GIDOBANONUNIB TOSYLATE", None, "LLD1 inhibitor", 2, "x"),
        ("C2", None, ["TRK-100003"], "ABC2 antagonist", 1, "x"), ("C3", "Zefulokakavastal", None, "RPS2 inhibitor", 3, "x"), ("C4", None, None, None, None, None), (None, "Nobody", None, None, None, None),
    ], D)
    products = spark.createDataFrame([
        ("P1", "SODIUM, GIDOBANONUNIB", "Inhibitor of LLD1", 2, "y"), ("P1", "gido banonunib", None, None, "y"), ("P2", "Zipoteq (gidobanonunib)", None, 2, "y"), ("P3", "Gieobannonunib 10mg tablets", "LLD1-inhibitor", 2, "y"),
        ("P4", "trk-100003", None, None, "y"), ("P5", "Zefulokakasartal", "Antagonist of ZDD1", 0, "y"), ("P6", "unrelatedomab", None, None, "y"), ("P7", None, None, None, "y"), (None, "gidobanonunib", None, None, "y"),
    ], P)
    got = {(r["a"], r["b"]) for r in match.match_drugs(drugs, products).filter("confidence >= 0.5").collect()}
    assert got == {("C1", "P1"), ("C1", "P2"), ("C1", "P3"), ("C2", "P4")}
    assert match.match_drugs(drugs.limit(0), products).count() == 0


def test_genes(spark):
    genes = spark.createDataFrame([("E1", "SVTP1", "sovotupi adaptor protein 1", "Sovotupi adaptor protein 1; formerly PG1000."), ("E2", "SEP3", "rizufori transporter 3", None), ("E3", "SVTP2", "sovotupi adaptor protein 2", None), (None, None, None, None)], "ensembl_id string, symbol string, name string, description string")
    proteins = spark.createDataFrame([
        ("A1", None, ["svtp-1_HUMAN"], "H. sapiens"), ("A2", None, ["PG1000"], "Homo sapiens (Human)"), ("A3", "RIZUFORI-TRANSPORTER III (EC 9.9.1.-)", ["3-Sep"], "human"), ("A4", None, ["SVTP1"], "Mus musculus"),
        ("A5", "sovoutpi adaptor protein 2", [], "Homo sapiens"), ("A6", None, ["SVTP1"], None), ("A7", None, None, "human"), ("A1", None, ["svtp-1_HUMAN"], "H. sapiens"),
    ], "accession string, protein_name string, gene_names array<string>, organism string")
    got = {(r["a"], r["b"]) for r in match.match_genes(genes, proteins).filter("confidence >= 0.5").collect()}
    assert got == {("E1", "A1"), ("E1", "A2"), ("E2", "A3"), ("E3", "A5")}


REFERENCE = [
    ("R1", "drug", "Tizepebolinib", ["Zifonex", "ZR-2143"]), ("R2", "drug", "Futadaladumab", None), ("H1", "phenotype", "Intermittent hepatic hemorrhage", ["intermittent liver bleeding"]),
    ("H2", "phenotype", "Generalized palmar edema", None), ("M1", "disease", "Idiopathic pedal fibroma type 2", None), ("M2", "disease", "Idiopathic pedal fibroma type 3", ["IPF201"]), ("M3", "disease", "Early-onset pedal nephropathy", None),
]
CASES = [
    ("drug", "tizepebolinib 50mg", "R1"), ("drug", "Tizepe-bolinib tabs", "R1"), ("drug", "tizepeblinib", "R1"), ("drug", "Zifonex;", "R1"), ("drug", "zikomex", None), ("drug", "Zifoenx", "R1"), ("drug", "zr-2143 20 mg po bid", "R1"), ("drug", "ZR-2144", None),
    ("drug", "Futadaladuamb", "R2"), ("drug", "gumufezenersen", None), ("drug", "none", None), ("phenotype", "c/o Intermitent hepatic haemorrhage (worse at night)", "H1"), ("phenotype", "hepatic hemorrhage, Intermittent", "H1"),
    ("phenotype", "Hemorrhage Hepatic Intermittent", "H1"), ("phenotype", "intermittent  liver bleeding x3", "H1"), ("phenotype", "GENERALISÉD PALMAR OEDEMA", "H2"), ("phenotype", "generalised plamar oedema", "H2"), ("phenotype", "work stress", None),
    ("disease", "idiopathic pedal fibroma T2, stable", "M1"), ("disease", "r/o IIDOPATHIC PEDAL FIBROMA TYP.3", "M2"), ("disease", "Idiopathic pedal fibroma type 4", None), ("disease", "ipf201 (dx 2019)", "M2"), ("disease", "Nephropathy Pedal Early-Onset", "M3"), ("disease", "Idiopathic-pedal-fibroma-type-iii", "M2"),
    ("disease", "x" * 50_000, None),
]


def test_terms(spark):
    ref = spark.createDataFrame(REFERENCE + REFERENCE[:2], "term_id string, kind string, name string, synonyms array<string>")
    typed = spark.createDataFrame([(k, v) for k, v, _ in CASES] + [("drug", None), ("drug", "  "), ("drug", " "), (None, "x"), ("other", "y"), CASES[0][:2]], "kind string, value string")
    out = canon.map_terms(spark, typed, ref).collect()
    assert {(r["kind"], r["value"]): r["term_id"] for r in out} == {(k, v): t for k, v, t in CASES}
    assert len(out) == len(CASES)
    rows = typed.filter("kind = 'drug'").withColumn("n", F.lit(1))
    joined = canon.resolve(spark, rows.filter("trim(value) <> ''"), canon.map_terms(spark, typed, ref))
    assert joined.filter("term_id = ''").count() > 0
    assert canon.map_terms(spark, typed.limit(0), ref).count() == 0
    assert canon.map_terms(spark, typed, ref.limit(0)).filter("term_id is not null").count() == 0
    other = canon.map_terms(spark, typed, ref, broadcast_rows=0).collect()
    assert {(r["kind"], r["value"]): r["term_id"] for r in other} == {(k, v): t for k, v, t in CASES}


def test_every_pair_of_two_exchanges_is_found(spark):
    name, cases = "idiopathic pedal fibroma", []
    for i in range(0, 22, 3):
        for j in range(i + 2, 23, 3):
            t = list(name.replace(" ", ""))
            for k in (i, j):
                if k + 1 < len(t):
                    t[k], t[k + 1] = t[k + 1], t[k]
            cases.append(("disease", "".join(t)))
    ref = spark.createDataFrame([("M1", "disease", name, None)], "term_id string, kind string, name string, synonyms array<string>")
    out = canon.map_terms(spark, spark.createDataFrame(cases, "kind string, value string"), ref).collect()
    assert {r["term_id"] for r in out} == {"M1"}


def test_names_of_drugs_do_not_meet_by_the_segments_they_share(spark, monkeypatch):
    monkeypatch.setattr(match, "_met_by_segments", lambda left, right: left.select("ka", F.col("ka").alias("kb")).limit(0))
    a = ["gofevafefisartal", "bidosogufitide", "vezuneritugliptal", "pezevifomagliptal", "abcdefghijklmnopqrstu"]
    b = ["gofevafefistaral", "bidosoguftides", "vezuneritugliptal", "pezvifomagliptal", "abcdefhgijklmnopqrstux"]
    left, right = (spark.createDataFrame([(f"{s}{i}", k) for i, k in enumerate(names)], f"{s} string, key string") for s, names in (("a", a), ("b", b)))
    got = match.near_pairs(left, right).collect()
    assert sorted((r["ka"], r["kb"]) for r in got) == sorted([(a[0], b[0]), (a[1], b[1]), (a[3], b[3]), (a[4], b[4])])
