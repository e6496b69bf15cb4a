"""Walks with the neighbours in every task against the same walks by joins."""

import random

from kgweave.operators import adjacency as N
from kgweave.operators import context as K
from kgweave.operators.graph import KnowledgeGraph

from tests.conftest import rows


def _random(spark, n=60, m=150):
    r = random.Random(7)
    ids = [f"n{i:02d}" for i in range(n)]
    nodes = spark.createDataFrame([(i, None if k % 9 == 0 else f"Name{k}", "Disease" if k % 3 else "Gene", None) for k, i in enumerate(ids[:-4])], "id string, name string, node_type string, properties map<string,string>")
    # Loops, parallel edges, a hub, ends that are no nodes; the last node has no edge.
    edges = {(r.choice(ids[:-1]), r.choice(ids[:-1]), r.choice(["x", "gene_associated_with_disease"])) for _ in range(m)} | {("n05", i, "x") for i in ids[:25]}
    return KnowledgeGraph(nodes, spark.createDataFrame([(a, b, t, r.choice([0.5, 1.0, float("nan")])) for a, b, t in sorted(edges)], "source_id string, target_id string, edge_type string, score double"))


def test_hops_and_holes_equal_joins(spark):
    kg = _random(spark)
    seeds = kg.nodes.select("id").limit(20).unionByName(spark.createDataFrame([("n59",), ("elsewhere",)], "id string"))
    for radius, least in ((2, 0), (3, 2)):
        some = kg.nodes.filter("node_type = 'Disease'").select("id")
        for among in (None, some):
            shared = kg.hops(seeds, radius=radius, least=least, among=among).toPandas()
            assert rows(shared) == rows(kg.hops(seeds, radius=radius, least=least, among=among, shared_edges=0).toPandas()) and len(shared)
    got = {tuple(r) for r in kg.structural_holes(seeds, target_type="Disease", relation="gene_associated_with_disease").collect()}
    linked = {(e["source_id"], e["target_id"]) for e in kg.of_type("gene_associated_with_disease").collect()}
    assert got and not {(s, i) for s, i, _ in got} & linked


def test_dense_fronts_are_met_from_the_other_side():
    import numpy as np

    # Everybody knows 0, and each its successor: from 1, all are two steps away.
    n = 50
    near = [sorted({0, max(i - 1, 0), min(i + 1, n - 1)} - {i}) if i else list(range(1, n)) for i in range(n)]
    indptr, indices = np.concatenate([[0], np.cumsum([len(x) for x in near])]), np.concatenate(near)
    ball = N._Ball(indptr, indices)
    for seeds in ([1], [0, 7], [49]):
        levels = [set(map(int, x)) for x in ball.levels(np.array(seeds), 3)]
        ball.seen[:] = False
        seen, want = set(seeds), [set(seeds)]
        while want[-1]:
            want.append({int(b) for a in want[-1] for b in near[a]} - seen)
            seen |= want[-1]
        assert levels == [x for x in want if x]


def test_context_and_paths_equal_joins(spark):
    kg = _random(spark)
    asked = spark.createDataFrame([(k, f"What links Name{k} to Name{k + 11}?") for k in range(1, 40)], "query long, text string")
    one, two = (K.graph_context(kg, asked, limit=5, shared_edges=n).selectExpr("query", "size", "entities", "triples", "context") for n in (N.LIMIT, 0))
    one, two = ({r["query"]: tuple(r) for r in df.collect()} for df in (one, two))
    assert one == two and len(one) > 20
    pairs = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}") for a in range(0, 60, 4) for b in range(0, 60, 5)], "source string, target string")
    a, b = (rows(kg.shortest_paths(pairs, max_length=3, shared_edges=n).toPandas()) for n in (N.LIMIT, 0))
    assert a == b and len(a) > 20


def test_paths_to_many_targets_at_once():
    import numpy as np

    # Two hubs of more than a thousand neighbours, random links, and two nodes apart from all others.
    r = random.Random(5)
    n = 3000
    links = {(h, r.randrange(n - 2)) for h in (3, 2000) for _ in range(2000)} | {(r.randrange(n - 2), r.randrange(n - 2)) for _ in range(n)} | {(n - 2, n - 1)}
    near = [set() for _ in range(n)]
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    indptr, indices = np.concatenate([[0], np.cumsum([len(x) for x in near])]), np.array([b for x in near for b in x], np.int32)
    targets = np.array(r.sample(range(n), 61) + [3, n - 1, 2000])
    pairs = sorted({(r.randrange(n), k) for k in range(64) for _ in range(20)} | {(n - 2, int(np.flatnonzero(targets == n - 1)[0]))} - {(int(t), k) for k, t in enumerate(targets)})
    pairs = [(s, k) for s, k in pairs if s != targets[k]]
    want = set()
    for k, t in enumerate(targets.tolist()):
        far, front = {t: 0}, [t]
        for d in range(1, 6):
            front = sorted({b for a in front for b in near[a]} - far.keys())
            far |= {b: d for b in front}
        for s in (s for s, j in pairs if j == k and s in far):
            path = [s]
            while path[-1] != t:
                path.append(min(b for b in near[path[-1]] if far.get(b) == far[path[-1]] - 1))
            want.add(tuple(path))
    for block in (1 << 20, 7):
        source, bit = np.array(pairs).T
        got = [tuple(p) for x in N._Together(indptr, indices, block=block).paths(targets, source, bit, 5) for p in x.tolist()]
        assert len(got) == len(set(got)) and set(got) == want and len({len(p) for p in got}) > 3
