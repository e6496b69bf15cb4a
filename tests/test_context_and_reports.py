"""Containment, context, retrieval, verification, reports, ingestion and training on small graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgweave.operators import clinical as C
from kgweave.operators import context as K
from kgweave.operators import ingest as I
from kgweave.operators import learning as L
from kgweave.operators import reports as P
from kgweave.operators import retrieval as R
from kgweave.operators.containment import contains_pairs
from kgweave.operators.graph import KnowledgeGraph
from kgweave.operators.runtime import salted_join
from kgweave.plans import context as plans
from kgweave.plans import reports

NODE = "id string, name string, node_type string, properties map<string,string>, sources array<string>, pmid string, year int"
EDGE = "source_id string, target_id string, edge_type string, score double, properties map<string,string>, sources array<string>"


@pytest.fixture(scope="module")
def kg(spark):
    nodes = [
        ("gene:abc1", "ABC1", "Gene", {"note": "kinase"}), ("gene:xyz2", "XYZ2", "Gene", None), ("disease:d", "Lung disease", "Disease", None), ("drug:k", "Kelanib", "Drug", None),
        ("phen:c", "Chronic cough", "Phenotype", None), ("pub:1", "A paper", "Publication", None), ("pub:2", None, None, None),
    ]
    n = spark.createDataFrame([(*x, ["s"], "11" if x[0] == "pub:1" else None, 2020 if x[0] == "pub:1" else None) for x in nodes], NODE)
    edges = [
        ("gene:abc1", "disease:d", "gene_associated_with_disease", 0.9), ("drug:k", "gene:abc1", "drug_targets_gene", 0.8), ("disease:d", "phen:c", "disease_has_phenotype", 0.7),
        ("pub:1", "gene:abc1", "publication_mentions_gene", 0.6), ("pub:1", "disease:d", "publication_mentions_disease", 0.6),
    ]
    return KnowledgeGraph(n, spark.createDataFrame([(*e, None, ["s"]) for e in edges], EDGE))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "ABC1 and lung disease", "ABC1 drives lung disease. More follows.", "pubmed", "11"), (2, None, "Kelanib was given daily.", None, "22"), (3, "Other", None, "x", None), (4, "Weather", "It rained all week.", "x", None)]
    return spark.createDataFrame(rows, "doc long, title string, text string, source string, pmid string")


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query int, text string")


@pytest.mark.parametrize("few", [20_000, 0])
def test_containment_against_brute_force(spark, few):
    r = np.random.default_rng(1)
    word = lambda n: "".join(r.choice(list("ab "), n))
    texts = [(i, word(int(r.integers(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (62, "naïve Übergröße\nab" * 500)]
    needles = sorted({word(int(r.integers(1, 6))) for _ in range(40)}) + ["a", "", None, "größe\nab", "zzz", "ab" * 20]
    got = contains_pairs(spark.createDataFrame(texts, "key int, text string"), spark.createDataFrame([(x,) for x in [*needles, needles[0]]], "needle string"), few=few).collect()
    want = {(i, n) for i, t in texts if t is not None for n in needles if n and n in t}
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert contains_pairs(spark.createDataFrame(texts, "key int, text string"), spark.createDataFrame([], "needle string")).count() == 0


@pytest.mark.parametrize(("few", "shared_runs"), [(20_000, 1_000_000), (3, 1_000_000), (3, 2)])
def test_substrings_by_long_runs(spark, few, shared_runs):
    """Few needles, many of which only some meet a text, and more runs than go to every task: the same pairs."""
    texts = [(1, "what links kinase alpha one to tumour"), (2, "a tumour, kinase alpha two"), (3, "αβγδεζηθι🧬 kin"), (4, "a"), (5, None)]
    needles = ["kinase alpha one", "kinase alpha", "kinase beta one", "alpha two", "kin", "αβγδεζηθι🧬", "βγδεζηθι", "a", "to", "tumour, kinase alpha two", "not there at all", "🧬"]
    got = contains_pairs(spark.createDataFrame(texts, "key int, text string"), spark.createDataFrame([(x,) for x in needles], "needle string"), few=few, shared_runs=shared_runs).collect()
    assert sorted(map(tuple, got)) == sorted((k, n) for k, t in texts for n in needles if t and n in t)


def test_first_entities_of_many_of_one_name(spark):
    """Only the first nodes of a name can be a claim's first: the others are gone before they meet its claims."""
    nodes = [(f"n{i:03}", "Tumour", "Disease") for i in range(200)] + [("m1", "kinase", "Gene"), ("z1", "kinase", "Gene"), ("q", None, "Gene"), ("r", "", "Gene")]
    kg = KnowledgeGraph(spark.createDataFrame(nodes, "id string, name string, node_type string"), spark.createDataFrame([], "source_id string, target_id string, edge_type string, score double"))
    claims = spark.createDataFrame([(1, "the TUMOUR grows"), (2, "kinase in tumour"), (3, "nothing")], "query int, text string")
    got = sorted(map(tuple, K.substring_entities(kg, claims).collect()))
    assert got == [(1, 1, "n000", "Disease"), (1, 2, "n001", "Disease"), (2, 1, "m1", "Gene"), (2, 2, "n000", "Disease")]
    assert [r["id"] for r in K.substring_entities(kg, claims, limit=3, node_types=["Gene"]).orderBy("rank").collect()] == ["m1", "z1"]


def test_salted_join_keeps_every_row(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("cold", "c")], "k string, w string")
    j = salted_join(left, right, ["k"], F.col("v"), heavy_rows=10)
    assert j.count() == 1001 and salted_join(left, right, ["k"], F.col("v"), how="left", heavy_rows=10).count() == 1002 and j.columns == ["k", "v", "w"]


def test_context(spark, kg):
    q = ask(spark, "What does ABC1 do?", "nothing known", None, '"lung disease" and kina')
    c = {r["query"]: r for r in K.graph_context(kg, q, depth=1).collect()}
    assert set(c) == {0, 3} and c[0]["entities"] == ["ABC1"] and c[0]["size"] == 4
    assert c[0]["triples"][0] == "ABC1 gene_associated_with_disease Lung disease" and c[0]["context"].startswith(K.HEADER + "\nMatched entities: ABC1.\n- ABC1")
    m = {(r["query"], r["id"]) for r in K.match_nodes(kg, spark.createDataFrame([(1, 0, "KINA"), (2, 0, "two words"), (3, 0, "gene:xyz2"), (4, 0, "  ")], "query int, pos int, candidate string")).collect()}
    assert m == {(1, "gene:abc1"), (3, "gene:xyz2")}


def test_retrieve(spark, kg, docs):
    q = ask(spark, "ABC1 lung disease", "XYZ2")
    r = K.retrieve(docs, q, top=2, kg=kg).orderBy("query", "rank").collect()
    assert (r[0]["query"], r[0]["doc"], r[0]["pmid"]) == (0, 1, "11") and K.HEADER in r[0]["context"]
    assert {x["query"] for x in r} == {0}  # XYZ2 has no triples, so nothing stands for it
    alone = K.retrieve(docs, ask(spark, "Chronic cough"), top=2, kg=kg).collect()
    assert len(alone) == 1 and alone[0]["source"] == "kg_context" and alone[0]["doc"] is None and alone[0]["score"] == 1.0
    assert K.retrieve(docs.limit(0), q, top=2).count() == 0
    d = {r["doc"]: (r["title"], r["source"]) for r in K.as_documents(docs.select("doc"), docs).collect()}
    assert d[2] == ("2", "pubmed") and d[1] == ("ABC1 and lung disease", "pubmed") and d[3] == ("Other", "x")


def test_retrieve_with_vectors_of_their_own(spark, kg, docs):
    """Vectors beside the documents give what vectors in them do; a document that has two rows isn't squared, texts aren't shuffled for their vectors."""
    q = ask(spark, "ABC1 lung disease", "XYZ2").withColumn("vector", F.array(F.lit(1.0), F.col("query") * 2.0))
    v = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.0, 1.0]), (99, [1.0, 1.0])], "doc long, vector array<double>")
    flat = lambda df: sorted(map(repr, df.collect()))
    beside = K.retrieve(docs, q, top=3, kg=kg, vectors=v)
    assert flat(beside) == flat(K.retrieve(docs.join(v, "doc", "left"), q, top=3, kg=kg)) and {1, 3} <= {r["doc"] for r in beside.collect()}
    twice = K.retrieve(docs.unionByName(docs.filter("doc = 1")), q, top=3, kg=kg).filter("query = 0 and doc = 1")
    assert twice.count() == 2


def test_what_is_kept_of_found_documents(spark, kg, docs, monkeypatch):
    """Neither answers nor full reviews write the context of a query with each of its documents."""
    kept = []
    keep = lambda df: kept.append(df.columns) or df
    monkeypatch.setattr(K, "checkpoint", keep)
    monkeypatch.setattr(plans, "checkpoint", keep)
    articles = docs.select("pmid", "title", F.lit(None).cast("array<string>").alias("authors"), F.lit(2020).alias("year"), F.col("doc").alias("article_id"))
    a = K.answer(kg, docs, articles, ask(spark, "ABC1 lung disease")).collect()
    assert "[PMID:11]" in a[0]["answer"]
    plans.o14_full_review(spark, "/root/testdata/sf0.001")
    assert kept and not [c for c in kept if {"context", "text"} <= set(c)]


def test_verify_and_answers(spark, kg, docs):
    claims = ask(spark, "ABC1 causes lung disease.", "XYZ2 treats lung disease", "zzz [PMID:1]", "qqq vvv", None)
    v = {r["query"]: (r["supported"], r["issue"]) for r in K.verify(kg, docs, claims).collect()}
    assert v[0] == (True, None) and v[2] == (False, None) and v[3][1].startswith("Insufficiently grounded") and set(v) == {0, 1, 2, 3}
    a = {r["query"]: r for r in K.answer(kg, docs, spark.createDataFrame([(9, "11", "T", ["A B"], 2020)], "article_id long, pmid string, title string, authors array<string>, year int"), ask(spark, "ABC1 lung disease", "zzzz")).collect()}
    assert "- ABC1 and lung disease: ABC1 drives lung disease. [PMID:11]" in a[0]["answer"] and a[0]["invalid"] == 0 and a[1]["answer"].startswith("I do not know") and a[1]["confidence"] == 0.1
    drafts = spark.createDataFrame([(0, "Good [PMID:11]."), (1, "Bad [PMID:99].")], "query int, draft string")
    b = {r["query"]: r["answer"] for r in K.answer(kg, docs, spark.createDataFrame([], "article_id long, pmid string, title string, authors array<string>, year int"), ask(spark, "ABC1 lung disease", "zzzz"), drafts=drafts).collect()}
    assert b[0] == "Good [PMID:11]." and b[1].startswith("I do not know")
    r = K.review(None, docs, spark.createDataFrame([(1, "lung disease")], "query int, topic string")).first()
    assert r["review"].startswith("# Narrative Review of lung disease") and "## Clinical Evidence" in r["review"] and r["pmids"] == ["11"]
    kept = K.revise(spark.createDataFrame([(1, 1, "short"), (1, 2, "word " * 90 + "[PMID:1] [PMID:2]"), (1, 3, "later"), (2, 1, "x"), (2, 3, "y"), (2, 4, "z")], "query int, round int, content string"))
    assert {r["query"]: r["round"] for r in kept.collect()} == {1: 2, 2: 3}


def test_explored_paths_are_walked_once(spark, kg):
    plan = P.explore(kg, ask(spark, "path from Kelanib to Lung disease"))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan


def test_reports(spark, kg, docs):
    asked = spark.createDataFrame([("gene:abc1", None), ("xyz2", "Gene"), ("kelanib", "Gene"), ("kinase", None)], "query string, node_type string")
    assert {(r["query"], r["id"]) for r in P.resolve_nodes(kg, asked).collect()} == {("gene:abc1", "gene:abc1"), ("xyz2", "gene:xyz2"), ("kinase", "gene:abc1")}
    e = {(r["query"], r["mode"], tuple(r["nodes"])) for r in P.explore(kg, ask(spark, "path from Kelanib to Lung disease", "kinase", "zzz")).collect()}
    assert e == {(0, "path", ("drug:k", "gene:abc1", "disease:d")), (1, "search", ("gene:abc1",)), (2, "search", ())}
    b = P.literature_bridge(kg, spark.createDataFrame([("gene:abc1", "disease:d"), ("disease:d", "gene:abc1"), ("drug:k", "disease:d")], "source_id string, target_id string")).collect()
    assert {(r["source_id"], tuple(r["pmids"])) for r in b} == {("gene:abc1", ("11",)), ("disease:d", ("11",))}
    s = P.name_support(kg, spark.createDataFrame([("c1", "cough"), ("c1", "severe chronic cough at night"), ("c2", "fever")], "case string, term string"), spark.createDataFrame([("c1", "disease:d"), ("c2", "disease:d")], "case string, disease string")).collect()
    assert [(r["case"], r["support"]) for r in s] == [("c1", ["Chronic cough"])]
    routed = {r["query"]: (r["task"], r["tasks"]) for r in P.route(kg, ask(spark, "Kelanib", "ABC1 drug target", "find papers and then pathway enrichment", "hello")).collect()}
    assert routed[0][0] == "pharmacologist" and routed[1][0] == "graph_explorer" and routed[2] == ("router", ["router", "pathway_analyst"]) and routed[3] == ("router", ["router"])


def test_workflow(spark, kg, docs):
    ranking = kg.nodes.select("id", F.lit(0.1).alias("combined"), F.lit(0.2).alias("druggability"))
    articles = spark.createDataFrame([(9, "11", "T", ["A B"], 2020)], "article_id long, pmid string, title string, authors array<string>, year int")
    listed = spark.createDataFrame([("drug:k", "kinase inhibitor")], "id string, mechanism string")
    w = P.run_workflow(kg, docs, ask(spark, "gene report on ABC1; Show interaction of Kelanib; list papers on lung disease"), P.default_specialists(kg, docs, articles, ranking, listed)).first()
    assert w["tasks"] == 3 and "## Geneticist\nGene report for ABC1" in w["response"] and "mechanisms=kinase inhibitor" in w["response"] and "## Literature" in w["response"] and w["citations"] == ["11"] and "## Verification" in w["response"]


def test_ingest(spark, tmp_path):
    genes = spark.createDataFrame([("A",), ("B",)], "gene string")
    assoc = spark.createDataFrame([("A", f"D{i}", "x", i / 10) for i in range(8)] + [("A", "N", "x", float("nan")), ("B", None, None, 1.0), ("C", "D1", "x", 1.0)], "gene string, disease_id string, disease_name string, score double")
    treat = spark.createDataFrame([("D7", f"K{i}", "n", i, None, None) for i in range(5)], "disease_id string, drug_id string, drug_name string, phase int, status string, mechanism string")
    nodes, edges = I.ingest_associations(genes, assoc, treat)
    e = {(r["source_id"], r["target_id"]) for r in edges.collect()}
    assert e == {("gene:a", f"disease:d{i}") for i in range(3, 8)} | {("drug:k4", "disease:d7"), ("drug:k3", "disease:d7"), ("drug:k2", "disease:d7")}
    kg, log = I.build(genes, {"one": lambda: (nodes, edges), "bad": lambda: 1 / 0}, ["bad", "one", "unknown"])
    assert log == [("bad", "failed"), ("one", "ok"), ("unknown", "skipped")] and kg.edges.count() == 8
    I.save_graph(kg, str(tmp_path / "g"))
    assert I.load_graph(spark, str(tmp_path / "g")).nodes.count() == kg.nodes.count() and I.load_graph(spark, str(tmp_path / "none")).nodes.count() == 0
    ents, rels = I.extracted_rows(spark.createDataFrame([(1, 'x {"entities": [{"name": "My gene"}], "relations": [{"source_id": "a"}]} y'), (2, "no json"), (3, None)], "doc int, payload string"))
    assert ents.collect()[0].asDict() == {"doc": 1, "id": "gene:my-gene", "name": "My gene", "node_type": "Gene", "sources": ["llm_extraction"]} and rels.first()["score"] == 1.0


def test_negatives_are_exact(spark):
    ids = lambda p, n: spark.createDataFrame([(f"{p}{i}",) for i in range(n)], "id string")
    pos = spark.createDataFrame([(f"s{i}", f"t{i}") for i in range(20)], "src string, dst string")
    for n, ratio, want in ((40, 3.0, 60), (20, 15.0, 300), (20, 50.0, 380)):
        neg = [tuple(r)[:2] for r in L.negatives(pos, ids("s", n), ids("t", n), ratio=ratio).collect()]
        assert len(neg) == len(set(neg)) == want and not set(neg) & {(f"s{i}", f"t{i}") for i in range(20)}


def test_decoder_learns(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(300, 2, 4))
    rows = [(i, [float(x) for x in a], [float(x) for x in b], 0, int(a @ b > 0), "val" if i % 5 == 0 else "test" if i % 5 == 1 else "train") for i, (a, b) in enumerate(v)]
    s = spark.createDataFrame(rows, "src int, a array<double>, b array<double>, relation int, label int, split string").withColumn("dst", F.col("src")).repartition(3)
    d, losses = L.train_decoder(s, epochs=40, rate=0.05)
    assert losses[-1][0] < 0.6 * losses[0][0] and L.evaluate(d, s).first()["auroc"] > 0.85
    w, f = d.w, 1e-5
    a, b, rel, y = v[:9, 0], v[:9, 1], np.zeros(9, int), np.arange(9) % 2
    _, g = L.Decoder.gradient(w, a, b, rel, y)
    for k in w:
        at = np.unravel_index(int(np.argmax(np.abs(g[k]))), g[k].shape)
        moved = []
        for s_ in (f, -f):
            other = {n: x.copy() for n, x in w.items()}
            other[k][at] += s_
            moved.append(L.Decoder.gradient(other, a, b, rel, y)[0])
        assert abs((moved[0] - moved[1]) / (2 * f) - g[k][at]) < 1e-3 * max(1, abs(g[k][at]))


def test_dense_in_blocks(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=3).round(1)]) for i in range(200)] + [(200, None)]
    v = spark.createDataFrame(rows, "doc long, vector array<double>").repartition(5)
    q = v.filter("doc % 10 = 0").withColumnRenamed("doc", "query")
    one, many = ({(x["query"], x["rank"]): (x["doc"], round(x["score"], 9)) for x in R.dense(v, q, top=4, block=b).collect()} for b in (1000, 3))
    assert one == many and len(one) == 80


def test_long_names_are_mentioned(spark):
    name = "one two three four five six seven eight nine ten"
    m = C.mentions(spark.createDataFrame([(1, f"x {name.upper()} y"), (2, None), (3, "")], "doc int, text string"), spark.createDataFrame([("n", name, "k"), ("e", "", "k"), ("z", None, "k")], "id string, name string, kind string")).collect()
    assert [(r["doc"], r["id"], r["at"]) for r in m] == [(1, "n", 1)]


def test_models(spark, kg):
    x = kg.nodes.select("id", F.array(F.lit(1.0), F.length("id").cast("double")).alias("x"))
    msg = L.message_graph(kg.edges, kg.edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).limit(0), "gene_associated_with_disease")
    for model in ("graphsage", "rgcn", "node2vec"):
        got = L.embeddings(kg, x, msg, model=model, width=4).collect()
        assert len(got) == 7 and all(len(r["x"]) == 4 for r in got)
    with pytest.raises(ValueError):
        L.embeddings(kg, x, msg, model="other")
    with pytest.raises(ValueError):
        L.link_dataset(kg, "trial_investigates_drug", "Gene", "Disease")


def test_drafts_of_sections_keep_those_without_documents(spark):
    s = spark.createDataFrame([("1#0", "Background", "What of x?"), ("2#0", "Background", "What of y?")], "query string, heading string, question string")
    found = spark.createDataFrame([("1#0", r, f"Text {r}. More.", str(r) if r != 2 else None) for r in range(1, 6)], "query string, rank int, text string, pmid string")
    got = {(r["query"], r["round"]): r["content"] for r in K.section_drafts(s, found).collect()}
    assert len(got) == 6
    assert got["1#0", 1] == "Background.\nThis section addresses: What of x?\n- Text 1. [PMID:1]\n- Text 2.\n- Text 3. [PMID:3]"
    assert got["1#0", 2] == got["1#0", 1] + "\n- Text 4. [PMID:4]\n- Text 5. [PMID:5]" == got["1#0", 3]
    assert got["2#0", 1] == "Background.\nInsufficient evidence was retrieved to answer: What of y?"


@pytest.mark.parametrize("rows", [2_000_000, 50])
def test_bm25_of_every_document_against_brute_force(spark, rows):
    r = np.random.default_rng(3)
    words = ["the", "of", *[f"w{i}" for i in range(60)]]
    p = np.array([30, 20, *[1 / (i + 1) for i in range(60)]])
    text = lambda n: " ".join(r.choice(words, n, p=p / p.sum()))
    texts = [(i, text(int(r.integers(1, 20)))) for i in range(400)] + [(7, "w3 w3"), (400, None), (401, ""), (402, "only itself")]
    asked = [(f"q{i}", text(int(r.integers(1, 8)))) for i in range(40)] + [("none", "absent"), ("null", None), ("the", "the of the")]
    by: dict = {}
    for i, t in texts:
        by.setdefault(i, []).extend((t or "").split())
    df = {w: sum(w in t for t in by.values()) for w in {w for t in by.values() for w in t}}
    n, avg = len(texts), sum(map(len, by.values())) / len(texts)
    idf = {w: np.log(n - k + 0.5) - np.log(k + 0.5) for w, k in df.items()}
    floor = np.mean(list(idf.values())) / 4
    want = []
    for q, t in asked:
        s = {}
        for i, ws in by.items():
            if hit := [w for w in (t or "").split() if w in ws]:
                s[i] = sum((floor if idf[w] < 0 else idf[w]) * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in hit)
        want += [(q, k + 1, i, round(x, 6)) for k, (i, x) in enumerate(sorted(s.items(), key=lambda x: (-round(x[1], 9), -x[0]))[:5])]
    a, b = spark.createDataFrame(texts, "doc long, text string").repartition(3), spark.createDataFrame(asked, "query string, text string")
    hits = R.bm25(a, b, top=5, rows=rows, block=20)
    assert sorted((x["query"], x["rank"], x["doc"], round(x["score"], 6)) for x in hits.collect()) == sorted(want)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan  # pairs of queries and documents are never shuffled


def test_narratives_of_every_gene_and_hypothesis(spark, duck):
    folder = "/root/testdata/sf0.001"
    got = reports.o25_narratives(spark, folder).select("what", "id").collect()
    cases = duck.execute(reports.GRAPH + "," + reports._CASES + """ SELECT DISTINCT "case" FROM cs WHERE "case" IN (SELECT id FROM kg_nodes WHERE node_type = 'Gene')""").fetchall()
    assert sorted(r["id"] for r in got if r["what"] == "case") == sorted(c for (c,) in cases)
    asked = duck.execute("SELECT DISTINCT source_id AS source, target_id AS target FROM hypotheses WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)").fetchall()
    met = reports.slim_graph(spark, folder).shortest_paths(spark.createDataFrame(asked, "source string, target string")).groupBy("source").count().collect()
    told = [r["id"].split(">")[0] for r in got if r["what"] == "hypothesis"]
    assert sorted(told) == sorted(s for s, n in met for _ in range(min(n, 10)))


def test_cooccurrence_pairs_the_steps_of_a_walk_without_a_join(spark):
    walks = [(1, "a", "abacb"), (2, "a", "aabbc"), (1, "b", "bc")]
    df = spark.createDataFrame([(w, s, p, i) for w, s, ids in walks for p, i in enumerate(ids)], "walk int, start string, pos int, id string")
    want: dict = {}
    for _, _, ids in walks:
        for p, a in enumerate(ids):
            for b in ids[p + 1 : p + 4]:
                for k in ((a, b), (b, a)):
                    want[k] = want.get(k, 0) + 1
    got = L.cooccurrence(df)
    assert {(r["a"], r["b"]): r["n"] for r in got.collect()} == want and got.count() == len(want)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
