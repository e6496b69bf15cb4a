import json
import math
import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from kgweave.operators import analytics as A
from kgweave.operators import graph as G
from kgweave.operators import learning as L
from kgweave.plans import graph as graph_plans
from kgweave.plans import registry
from kgweave.plans import learning as learning_plans
from kgweave.plans.testbed import graph, slim_graph
from kgweave.schema import EDGE_TYPES, NODE_TYPES, checked, edge_type_between

SMALL = "/root/testdata/sf0.001"
E = "source_id string, target_id string, edge_type string, score double"


def kg_of(spark, edges, nodes=()):
    ids = nodes or [(x, x, "Gene") for x in sorted({e[0] for e in edges} | {e[1] for e in edges})]
    n = spark.createDataFrame(ids, "id string, name string, node_type string").withColumn("properties", F.create_map().cast("map<string,string>"))
    return G.KnowledgeGraph(n, spark.createDataFrame(edges, E))


@pytest.fixture(scope="module")
def some(spark):
    r = random.Random(5)
    edges = sorted({(f"n{r.randrange(24):02d}", f"n{r.randrange(24):02d}", r.choice(EDGE_TYPES[:2]), 1.0) for _ in range(34)})
    return edges, kg_of(spark, edges)


def around(edges):
    adj = defaultdict(set)
    for s, t, *_ in edges:
        if s != t:
            adj[s].add(t)
            adj[t].add(s)
    return adj


def test_types():
    assert len(NODE_TYPES) == 12 and len(EDGE_TYPES) == 18


def test_checked_type(spark):
    df = spark.createDataFrame([(None,), ("Drug",)], "t string").select(checked(F.col("t"), NODE_TYPES, "Gene").alias("t"))
    assert [r[0] for r in df.collect()] == ["Gene", "Drug"]
    with pytest.raises(Exception, match="not a known type"):
        spark.createDataFrame([("Planet",)], "t string").select(checked(F.col("t"), NODE_TYPES, "Gene")).collect()
    assert spark.range(1).select(edge_type_between(F.lit("Drug"), F.lit("Gene"))).first()[0] == "drug_targets_gene"


def test_merge_keeps_the_greatest_score_and_adds(spark):
    n = spark.createDataFrame(
        [("gene:egfr", "EGFR", None, {"a": "1"}, ["x"], 1), ("gene:egfr", "EGFR", "Kinase", {"b": "2", "a": "3"}, ["y", "x"], 2), ("gene:alk", "ALK", "", None, None, 1), ("gene:egfr", "", None, None, [], 3)],
        "id string, name string, description string, properties map<string,string>, sources array<string>, seq int",
    )
    m = {r["id"]: r for r in G.merge_nodes(n, F.col("seq")).collect()}
    assert (m["gene:egfr"]["name"], m["gene:egfr"]["description"], m["gene:egfr"]["properties"], m["gene:egfr"]["sources"]) == ("EGFR", "Kinase", {"a": "3", "b": "2"}, ["x", "y"])
    assert m["gene:alk"]["description"] is None and len(m) == 2
    e = spark.createDataFrame([("a", "b", "t", 0.7, {"k": "1"}, ["x"], 1), ("a", "b", "t", 0.9, {"k": "2"}, None, 2), ("a", "b", "t", 0.1, None, ["w"], 3)], E + ", properties map<string,string>, sources array<string>, seq int")
    r = G.merge_edges(e, F.col("seq")).collect()
    assert len(r) == 1 and r[0]["score"] == 0.9 and r[0]["properties"] == {"k": "2"} and r[0]["sources"] == ["w", "x"]


def test_repurposing_leaves_known_drugs_out(spark):
    kg = kg_of(spark, [("alk", "lung", "gene_associated_with_disease", 0.62), ("olaparib", "alk", "drug_targets_gene", 0.88), ("gefitinib", "alk", "drug_targets_gene", 0.9), ("gefitinib", "lung", "drug_treats_disease", 1.0)])
    r = kg.repurposing().collect()
    assert [(x["drug"], round(x["score"], 4), x["genes"]) for x in r] == [("olaparib", 0.5456, ["alk"])]


def test_paths_and_hops(spark, some):
    edges, kg = some
    adj, ids = around(edges), sorted({e[0] for e in edges} | {e[1] for e in edges})
    dist = {}
    for s in ids:
        d, q = {s: 0}, deque([s])
        while q:
            v = q.popleft()
            for w in adj[v]:
                if w not in d:
                    d[w] = d[v] + 1
                    q.append(w)
        dist[s] = d
    pairs = [(a, b) for a in ids[:5] for b in ids]
    got = {(r["source"], r["target"]): r for r in kg.shortest_paths(spark.createDataFrame(pairs, "source string, target string")).collect()}
    for a, b in pairs:
        if b in dist[a] and dist[a][b] <= 6:
            p = got[(a, b)]["path"]
            assert got[(a, b)]["length"] == dist[a][b] == len(p) - 1 and p[0] == a and p[-1] == b
            assert all(y in adj[x] for x, y in zip(p, p[1:], strict=False))
        else:
            assert (a, b) not in got
    def first(a, b):
        """Of all walks of the least length the first in the order of their ids."""
        walks = [[a]]
        for _ in range(dist[a][b]):
            walks = [[*w, y] for w in walks for y in adj[w[-1]]]
        return min(w for w in walks if w[-1] == b)

    assert all(list(got[k]["path"]) == first(*k) for k in got)
    levels = {(r["seed"], r["id"]): r["level"] for r in kg.hops(spark.createDataFrame([(ids[0],)], "id string"), radius=2).collect()}
    assert levels == {(ids[0], x): n for x, n in dist[ids[0]].items() if n <= 2}


def test_components(spark, some):
    edges, kg = some
    chain = [(f"c{i:03d}", f"c{i + 1:03d}", "gene_in_pathway", 1.0) for i in range(60)]
    kg = kg_of(spark, edges + chain + [("loop", "loop", "gene_in_pathway", 1.0)])
    got = {r["id"]: r["component"] for r in A.components(kg).collect()}
    adj, left = around(edges + chain), set(got)
    while left:
        seen, q = set(), [left.pop()]
        while q:
            v = q.pop()
            seen.add(v)
            q += [w for w in adj[v] if w not in seen]
        left -= seen
        assert {got[v] for v in seen} == {min(seen)}


def test_pagerank_mass_and_betweenness(spark, some):
    edges, kg = some
    assert math.isclose(A.pagerank(kg).agg(F.sum("rank")).first()[0], 1.0, abs_tol=1e-9)
    path = kg_of(spark, [("a", "b", "gene_in_pathway", 1.0), ("b", "c", "gene_in_pathway", 1.0), ("c", "d", "gene_in_pathway", 1.0)])
    b = {r["id"]: round(r["betweenness"], 6) for r in A.betweenness(path).collect()}
    assert b == {"a": 0.0, "b": round(4 / 6, 6), "c": round(4 / 6, 6), "d": 0.0}
    with pytest.raises(ValueError):
        A.betweenness(path, max_nodes=2)


def test_betweenness_of_all_nodes_both_ways(spark, some):
    edges, kg = some
    adj = around(edges)
    ids = sorted({x for e in edges for x in e[:2]})
    want = dict.fromkeys(ids, 0.0)
    for s in ids:
        dist, sigma, q = {s: 0}, defaultdict(float, {s: 1.0}), deque([s])
        order = []
        while q:
            v = q.popleft()
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = defaultdict(float)
        for w in reversed(order):
            for v in adj[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            want[w] += delta[w] * (w != s)
    want = {x: b / ((len(ids) - 1) * (len(ids) - 2)) for x, b in want.items()}
    for form in ({}, {"broadcast_pairs": 1, "batch": 12}):
        assert {r["id"]: r["betweenness"] for r in A.betweenness(kg, **form).collect()} == pytest.approx(want)


def test_betweenness_query_covers_the_graph(spark):
    got = registry.queries()["a02_betweenness"](spark, SMALL)
    assert got.count() == got.select("id").distinct().count() == A.universe(slim_graph(spark, SMALL)).count()


def test_target_ranking_query_counts_betweenness(spark):
    kg = slim_graph(spark, SMALL)
    got = {r["id"]: r["combined"] for r in graph_plans.QUERIES["a06_target_ranking"](spark, SMALL).collect()}
    terms = A.degree_centrality(kg).join(A.betweenness(kg), "id").join(A.pagerank(kg), "id").collect()
    want = {r["id"]: 0.4 * r["centrality"] + 0.3 * r["betweenness"] + 0.3 * r["rank"] for r in terms if r["id"] in got}
    assert got == pytest.approx(want, abs=2e-8) and any(r["betweenness"] > 1e-4 for r in terms if r["id"] in got)


def test_repurposing_evidence_and_report_query(spark):
    e = [("g", "d", "gene_associated_with_disease", 1.0), ("h", "d", "gene_associated_with_disease", 1.0), ("x", "g", "drug_targets_gene", 1.0), ("x", "h", "drug_targets_gene", 1.0)]
    e += [(p, t, k, 1.0) for p in "pqr" for t, k in (("g", "publication_mentions_gene"), ("h", "publication_mentions_gene"), ("d", "publication_mentions_disease"))]
    kg = kg_of(spark, e)
    kg = G.KnowledgeGraph(kg.nodes.withColumn("pmid", F.when(F.col("id").isin("p", "q"), F.col("id"))), kg.edges)
    assert [tuple(r) for r in G.repurposing_evidence(kg, kg.repurposing()).collect()] == [("d", "x", 2)]
    # Without the model's and the papers' share no confidence can exceed 0.5.
    assert registry.queries()["q09_repurposing_report"](spark, SMALL).agg(F.max("confidence")).first()[0] > 0.5


def test_search_query_reads_properties(spark):
    nodes = [(r["id"], r["name"], " ".join([r["id"], r["name"] or "", json.dumps(r["properties"] or {}, ensure_ascii=False, separators=(",", ":"))]).lower()) for r in graph(spark, SMALL).nodes.collect()]
    hits = sorted((n is None or n.lower() != "vi", n is None, (n or "").lower(), i) for i, n, hay in nodes if "vi" in hay)
    got = graph_plans.QUERIES["l03_node_search"](spark, SMALL).filter("query = 'vi'").orderBy("rank").collect()
    assert [r["id"] for r in got] == [h[-1] for h in hits[:10]]
    assert any("vi" not in f"{r['id']} {r['name']}".lower() for r in got)


def test_communities_settle(spark, some):
    pair = kg_of(spark, [("a", "b", "gene_in_pathway", 1.0)])  # moved at once, the two swing for ever
    assert len({r["community"] for r in A.label_communities(pair).collect()}) == 1
    small = graph_plans.QUERIES["a08_communities"](spark, SMALL).collect()
    e = slim_graph(spark, SMALL).edges.select("source_id", "target_id").collect()
    for edges, got in ((some[0], A.label_communities(some[1]).collect()), (e, small)):
        label = {r["id"]: r["community"] for r in got}
        for v, near in around(edges).items():
            n = Counter(label[w] for w in near)
            assert label[v] == min(n, key=lambda x: (-n[x], x))
    sizes = Counter(r["community"] for r in small)
    for r in graph_plans.QUERIES["a09_community_summary"](spark, SMALL).collect():
        assert sizes[r["community"]] == r["size"]


def test_walks_and_relations_of_the_queries_are_whole(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(L, "cooccurrence", lambda w: w)
    monkeypatch.setattr(L, "rgcn_layer", lambda x, messages, own, relations: seen.update(messages=messages, relations=relations) or x)
    w = learning_plans.QUERIES["m16_walk_cooccurrence"](spark, SMALL).agg(F.max("walk"), F.max("pos")).first()
    assert tuple(w) == (12, 9)
    learning_plans.QUERIES["m13_relational_layer"](spark, SMALL)
    edges = slim_graph(spark, SMALL).edges
    assert seen["messages"].count() == 2 * edges.count()
    assert {r[0] for r in edges.select("edge_type").distinct().collect()} <= set(seen["relations"])


def test_enrichment_hand_values(spark):
    q = spark.createDataFrame([("q", "egfr"), ("q", "alk")], "query string, gene string")
    m = spark.createDataFrame([("EGFR Signaling", "egfr"), ("EGFR Signaling", "alk"), ("DNA Repair", "brca1")], "term string, gene string")
    bg = spark.createDataFrame([(x,) for x in ("egfr", "alk", "brca1", "tp53", "loxl2")], "gene string")
    r = A.enrichment(q, m, bg).collect()
    assert [(x["term"], x["overlap"]) for x in r] == [("EGFR Signaling", 2)]
    assert math.isclose(r[0]["p"], 0.1, rel_tol=1e-9) and math.isclose(r[0]["fdr"], 0.1, rel_tol=1e-9)


def test_trend_values(spark):
    a = spark.createDataFrame([(2021 + i, "EGFR", f"Abstract {i} on EGFR and BRCA1 biology.") for i in range(5)], "year int, title string, abstract string")
    assert A.velocity(A.yearly_counts(a, "egfr")).first()[0] == 0.0
    assert {round(r["drift"], 9) for r in A.lexical_drift(a).collect()} == {0.25}


def test_local_index(spark):
    n = spark.createDataFrame([(f"x{i:03d}", "Gene" if i % 3 else "Drug") for i in range(100)], "id string, node_type string")
    got = G.local_index(n).toPandas()
    for _, g in got.groupby("node_type"):
        assert g.sort_values("id")["i"].tolist() == list(range(len(g)))


def test_empty_graph(spark):
    kg = G.KnowledgeGraph(spark.createDataFrame([], "id string, name string, node_type string, properties map<string,string>"), spark.createDataFrame([], E))
    assert A.components(kg).count() == A.pagerank(kg).count() == A.degree_centrality(kg).count() == kg.repurposing().count() == 0
    assert kg.stats().filter("n > 0").count() == 0
