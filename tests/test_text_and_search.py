import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kgweave.functions import text as X
from kgweave.operators import clinical as C
from kgweave.operators import learning as L
from kgweave.operators import retrieval as R


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Find PubMed papers on EGFR", "literature"), ("Show the network path between A and B", "graph_explorer"), ("novel link for TP53", "link_predictor"),
        ("Could we repurpose olaparib", "drug_repurposer"), ("Which gene has this variant", "geneticist"), ("drug interaction and metabolism", "pharmacologist"),
        ("symptom and diagnosis of the patient", "clinician"), ("pathway enrichment", "pathway_analyst"), ("a novel mechanism hypothesis", "hypothesis_generator"),
        ("write review", "review_writer"), ("verify and validate", "sentinel"), ("first search then compare", "router"), ("hello", None), ("", None),
    ],
)
def test_routing(spark, text, kind):
    assert one(spark, X.classify_task(F.col("t")), t=text) == kind


def test_clauses(spark):
    got = one(spark, X.split_clauses(F.col("t")), t="Show targets of Gefitinib and check interactions; what is EGFR?")
    assert got == ["Show targets of Gefitinib", "check interactions", "what is EGFR"]
    assert one(spark, X.split_clauses(F.col("t")), t="   ") == []


def test_citations(spark):
    t = "A [PMID:12] b [7] c [PMID:12] [x]"
    assert one(spark, X.cited_pmids(F.col("t")), t=t) == ["12", "7"]
    assert one(spark, X.invalid_citations(F.col("t"), F.array(F.lit("7"))), t=t) == ["12"]
    cite = lambda a, y: spark.range(1).select(X.inline_citation(F.lit(a) if a is not None else F.lit(None).cast("array<string>"), F.lit(y).cast("int"))).first()[0]
    assert cite(["Doe J", "Roe A"], 2020) == "Doe et al., 2020" and cite(["Doe J"], None) == "Doe, n.d." and cite(None, 1999) == "Unknown, 1999"


def test_rules(spark):
    assert tuple(one(spark, X.evidence_level(F.col("t")), t="A Systematic Review")) == ("high", 0.9)
    assert tuple(one(spark, X.evidence_level(F.col("t")), t="nothing")) == ("low", 0.45)
    assert one(spark, X.infer_severity(F.col("t")), t="Avoid combination, severe") == "contraindicated"
    assert one(spark, X.escalate(F.col("t")), t="major") == one(spark, X.escalate(F.col("t")), t="contraindicated") == "contraindicated"
    assert one(spark, X.split_findings(F.col("t")), t="persistent cough, dyspnea and weight loss") == ["persistent cough", "dyspnea", "weight loss"]
    assert one(spark, X.slug("gene", F.col("t")), t=" TP-53 (p53)!") == "gene:tp-53-p53"
    assert one(spark, X.first_sentence(F.col("t")), t="One. Two! Three") == "One."
    assert [len(x) for x in one(spark, X.chunk(F.col("t")), t="x" * 400)] == [180, 180, 40]
    assert one(spark, X.verification_confidence(F.lit(0), F.lit(0), F.lit(0))) == 0.6
    assert math.isclose(one(spark, X.verification_confidence(F.lit(4), F.lit(2), F.lit(2))), 0.425)
    assert one(spark, F.try_variant_get(X.lenient_json(F.lit('so: {"a": 3}.')), "$.a", "int")) == 3
    assert spark.range(1).select(C.set_similarity(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))).first()[0] == 0.5


def test_fusion_order(spark):
    r = lambda *d: spark.createDataFrame([("q", i + 1, x) for i, x in enumerate(d)], "query string, rank int, doc string")
    got = [x["doc"] for x in R.fuse(r("a", "b", "c"), r("c", "b", "d")).orderBy(F.desc("score")).collect()]
    assert got == ["c", "b", "a", "d"]


def test_bm25_against_brute_force(spark):
    docs = [(1, "EGFR inhibitor response in lung cancer"), (2, "BRCA1 synthetic lethality in breast tumors"), (3, "Fibrosis progression and matrix remodeling in lung"), (4, None), (5, ""), (6, "lung lung lung")]
    query = "lung EGFR egfr in"
    toks = [re.findall(r"[A-Za-z0-9_:-]+", (t or "").lower()) for _, t in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = Counter(w for t in toks for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    want = {}
    for (i, _), t in zip(docs, toks, strict=True):
        c = Counter(t)
        s = sum(idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.lower().split() if c[w])
        if any(c[w] for w in query.lower().split()):
            want[i] = s
    got = {r["doc"]: r["score"] for r in R.bm25(spark.createDataFrame(docs, "doc int, text string"), spark.createDataFrame([("q", query)], "query string, text string"), top=9).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_dense_keeps_ties_by_greater_doc(spark):
    docs = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)] + [(99, None), (100, [0.0, 0.0])], "doc int, vector array<double>")
    q = spark.createDataFrame([(1000, [2.0, 0.0])], "query int, vector array<double>")
    assert [r["doc"] for r in R.dense(docs, q, top=3).orderBy("rank").collect()] == [49, 48, 47]


def test_mentions(spark):
    t = spark.createDataFrame([(1, "The Lung  Cancer gene EGFR, not EGFRX; lung"), (2, None), (3, "")], "doc int, text string")
    n = spark.createDataFrame([("d1", "lung cancer", "Disease"), ("g1", "EGFR", "Gene"), ("l", "Lung", "Tissue"), ("z", None, "Gene")], "id string, name string, kind string")
    assert [(r["doc"], r["id"]) for r in C.mentions(t, n).orderBy("rank").collect()] == [(1, "d1"), (1, "l"), (1, "g1")]


def test_interactions_escalate(spark):
    r = spark.createDataFrame([(1, "a", "b", "major"), (2, "b", "a", "minor"), (3, "a", "c", None), (4, "a", "a", "major"), (5, "a", " ", "major")], "seq int, drug_a string, drug_b string, severity string")
    x = spark.createDataFrame([("a", "Rash"), ("b", "rash")], "drug string, reaction string")
    got = {(r["drug_a"], r["drug_b"]): (r["severity"], r["escalated"]) for r in C.interactions(r, reactions=x).collect()}
    assert got == {("a", "b"): ("contraindicated", True), ("a", "c"): ("minor", False)}


def test_metrics(spark):
    s = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.8), (3, 1, 0.8), (4, 0, 0.1)], "sample int, label int, score double")
    assert math.isclose(L.auroc(s).first()[0], 0.875)
    assert math.isclose(L.auprc(s).first()[0], 0.5 + 0.5 * 2 / 3)
    assert math.isclose(L.ranking_metrics(s).first()["mrr"], (1 + 1 / 2) / 2)
    assert L.auroc(s.filter("label = 1")).first()[0] == 0.5 and L.auprc(s.limit(0)).first()[0] == 0.0


def test_split_and_negatives(spark):
    p = spark.createDataFrame([(f"s{i}", f"t{i % 5}") for i in range(40)], "src string, dst string")
    c = {r[0]: r[1] for r in L.split_edges(p).groupBy("split").count().collect()}
    assert c == {"val": 4, "test": 4, "train": 32}
    assert L.split_edges(p.limit(1)).first()["split"] == "train"
    ids = lambda c: p.select(F.col(c).alias("id")).distinct()
    n = L.negatives(p, ids("src"), ids("dst"))
    assert n.count() > 20 and n.join(p, ["src", "dst"]).count() == 0
