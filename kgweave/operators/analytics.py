"""Graph and literature analytics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import KnowledgeGraph
from .runtime import checkpoint, running_totals, salted_join


def universe(kg: KnowledgeGraph) -> DataFrame:
    """All ids: of nodes and of the ends of edges."""
    return kg.nodes.select("id").unionByName(kg.edges.select(F.col("source_id").alias("id"))).unionByName(kg.edges.select(F.col("target_id").alias("id"))).distinct()


def degree_centrality(kg: KnowledgeGraph) -> DataFrame:
    """(id, degree, centrality): undirected degree, a loop counting two, over all other nodes; 1 in a graph of one node."""
    und = kg.undirected()
    ends = und.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    nodes = universe(kg)
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    full = nodes.join(ends, "id", "left").join(F.broadcast(n))
    d = F.coalesce("degree", F.lit(0))
    return full.select("id", d.alias("degree"), F.when(F.col("n") > 1, d / (F.col("n") - 1)).otherwise(1.0).alias("centrality"))


def druggability(kg: KnowledgeGraph, genes: DataFrame, ranking: DataFrame) -> DataFrame:
    """(gene, id, druggability) of genes asked for (gene) by id, else by name, any case; of equal names the first id."""
    return resolve_genes(kg, genes).join(ranking.select("id", "druggability"), "id").select("gene", "id", "druggability")


def resolve_genes(kg: KnowledgeGraph, genes: DataFrame) -> DataFrame:
    """(gene, id): the gene node of each string asked for, by id, else by name, any case; of equal names the first id.  Unknown ones have no row."""
    n = kg.nodes.filter("node_type = 'Gene'")
    key = lambda c: F.lower(F.trim(c))
    known = n.select("id", F.lit(0).alias("how"), key("id").alias("k")).unionByName(n.filter("name is not null").select("id", F.lit(1).alias("how"), key("name").alias("k")))
    best = known.groupBy("k").agg(F.min(F.struct("how", "id")).alias("b"))
    return genes.select("gene").distinct().withColumn("k", key("gene")).join(best, "k").select("gene", "b.id")


def background_genes(kg: KnowledgeGraph, genes: DataFrame | None = None) -> DataFrame:
    """(gene): the background asked for (gene) as ids; all genes if none is given or none of it is known."""
    every = kg.nodes.filter("node_type = 'Gene'").select(F.col("id").alias("gene"))
    if genes is None:
        return every
    known = resolve_genes(kg, genes).select(F.col("id").alias("gene")).distinct()
    return known if known.take(1) else every


def largest_communities(communities: DataFrame, *, top: int = 10) -> DataFrame:
    """(number, community, size, members) of the largest communities, numbered from 1, of equal ones the first by name; members sorted."""
    size = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "community").limit(top)
    numbered = size.withColumn("number", F.row_number().over(W.orderBy(F.desc("size"), "community")))
    members = communities.join(F.broadcast(numbered), "community")
    return members.groupBy("number", "community", "size").agg(F.array_sort(F.collect_list("id")).alias("members"))


def similar_nodes(kg: KnowledgeGraph, vectors: DataFrame, queries: DataFrame, *, top: int = 10) -> DataFrame:
    """(id, rank, other, score): the most alike of each query node (id) by vectors (id, vector), or by shared successors where there are none."""
    from .retrieval import dense

    if not vectors.take(1):
        return neighbour_jaccard(kg, queries, top=top)
    q = vectors.join(queries.select("id").distinct(), "id", "left_semi").withColumnRenamed("id", "query")
    return dense(vectors.withColumnRenamed("id", "doc"), q, top=top, exclude_self=True).select(F.col("query").alias("id"), "rank", F.col("doc").alias("other"), "score")


def directed_degree(kg: KnowledgeGraph) -> DataFrame:
    """(id, degree): outgoing and incoming edges, nothing collapsed."""
    ends = kg.edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return universe(kg).join(ends.groupBy("id").agg(F.count(F.lit(1)).alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("degree"))


def pagerank(kg: KnowledgeGraph, *, alpha: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6, max_rounds: int = 100) -> DataFrame:
    """(id, rank): PageRank of the directed multigraph, parallel edges adding up, dangling mass spread evenly.

    ``rounds`` fixes the number of iterations; otherwise they end when the ranks move, in all, by less than tolerance times
    the number of nodes, which is looked at, and the lineage cut, at every fifth round; not to get there in ``max_rounds`` is an error."""
    nodes = checkpoint(universe(kg))
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    weights = kg.edges.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("w"))
    out = weights.groupBy("source_id").agg(F.sum("w").alias("total"))
    moves = checkpoint(weights.join(out, "source_id").select(F.col("source_id").alias("id"), "target_id", (F.col("w") / F.col("total")).alias("p")))
    base = checkpoint(nodes.join(out.select(F.col("source_id").alias("id"), F.lit(False).alias("dangling")), "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling")))
    ranks = base.withColumn("rank", F.lit(1.0 / n))
    for k in range(1, (rounds or max_rounds) + 1):
        lost = ranks.agg(F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)).alias("lost"))
        came = ranks.join(moves, "id").groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("came"))
        new = ranks.withColumnRenamed("rank", "old").join(came, "id", "left").join(F.broadcast(lost))
        new = new.select("id", "dangling", "old", (alpha * (F.coalesce("came", F.lit(0.0)) + F.col("lost") / n) + (1 - alpha) / n).alias("rank"))
        if k % 5 == 0:
            new = checkpoint(new)
        ranks = new.select("id", "dangling", "rank")
        if rounds is None and k % 5 == 0 and new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance * n:
            return ranks.select("id", "rank")
    if rounds is None:
        raise RuntimeError(f"ranks still move after {max_rounds} rounds")
    return ranks.select("id", "rank")


def components(kg: KnowledgeGraph) -> DataFrame:
    """(id, component): the least id that can be reached, by alternating large-star and small-star steps.

    The stars halve the depth of each tree at every round, so long chains end in a logarithm of their length;
    no component's edges are ever gathered in one task, for each step only aggregates by id."""
    edges = checkpoint(kg.neighbour_pairs().filter("id > other").select(F.col("id").alias("u"), F.col("other").alias("v")))
    prints = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))]
    seen = edges.agg(*prints).first()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = checkpoint(small)
        # Both are sets of pairs: the same number and the same two sums of hashes tell that nothing has changed.
        seen, before = small.agg(*prints).first(), seen
        edges = small
        if seen == before:
            break
    return universe(kg).join(edges.select(F.col("u").alias("id"), F.col("v").alias("m")), "id", "left").select("id", F.coalesce("m", "id").alias("component"))


def label_communities(kg: KnowledgeGraph) -> DataFrame:
    """(id, community): deterministic label propagation until nothing changes; each node takes the commonest label around it, of equals the least.

    All nodes move at once as long as each round has fewer that would change than the one before.  From then on, for the nodes that
    swing, a node moves only if its draw of the round beats those of all neighbours that would move too.  No two neighbours then move together, so
    every round adds to the edges within communities or keeps them and lowers labels: it ends, however large the graph."""
    pairs = checkpoint(kg.neighbour_pairs())
    labels = checkpoint(universe(kg).withColumn("label", F.col("id")))
    before, together, k = None, True, 0
    while True:
        k += 1
        votes = pairs.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("id", F.col("b.label").alias("new"))
        moves = checkpoint(labels.join(best, "id").filter("new <> label").select("id", "new"))
        n = moves.count()
        if not n:
            return labels.select("id", F.col("label").alias("community"))
        together = together and (before is None or n < before)
        before = n
        if not together:
            drawn = moves.select("id", F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id").alias("draw"))
            beaten = pairs.join(drawn, "id").join(drawn.select(F.col("id").alias("other"), F.col("draw").alias("theirs")), "other").filter("theirs > draw").select("id").distinct()
            moves = moves.join(beaten, "id", "left_anti")
        labels = checkpoint(labels.join(moves, "id", "left").select("id", F.coalesce("new", "label").alias("label")))


def modularity(kg: KnowledgeGraph, communities: DataFrame) -> DataFrame:
    """(modularity): of the undirected graph with edge multiplicity as weight."""
    und = kg.undirected().filter("u <> v")
    c = communities.select("id", "community")
    e = und.join(c.withColumnsRenamed({"id": "u", "community": "cu"}), "u").join(c.withColumnsRenamed({"id": "v", "community": "cv"}), "v")
    ends = e.select(F.explode(F.array("cu", "cv")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("d"))
    inner = e.agg(F.avg(F.when(F.col("cu") == F.col("cv"), 1.0).otherwise(0.0)).alias("inside"), F.count(F.lit(1)).alias("m"))
    expected = ends.agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return inner.join(F.broadcast(expected)).select((F.col("inside") - F.col("dd") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"))


def community_summary(kg: KnowledgeGraph, communities: DataFrame, *, top: int = 5) -> DataFrame:
    """Largest communities with their commonest names of pathways, diseases and drugs: (number, community, size, type, name, n)."""
    size = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    ten = size.orderBy(F.desc("size"), "community").limit(10).withColumn("number", F.row_number().over(W.orderBy(F.desc("size"), "community")))
    named = communities.join(kg.nodes.filter(F.col("node_type").isin("Pathway", "Disease", "Drug")).select("id", "name", "node_type"), "id").join(F.broadcast(ten), "community")
    counts = named.groupBy("number", "community", "size", "node_type", "name").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("community", "node_type").orderBy(F.desc("n"), "name")
    return counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).drop("r")


def target_ranking(kg: KnowledgeGraph, centrality: DataFrame, betweenness: DataFrame, ranks: DataFrame) -> DataFrame:
    """Genes by 0.4 degree centrality + 0.3 betweenness + 0.3 PageRank, and how druggable they are."""
    genes = kg.nodes.filter("node_type = 'Gene'").select("id", "name")
    count = lambda t, end, to: kg.of_type(t).groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias(to))
    g = genes.join(centrality.select("id", "centrality"), "id", "left").join(ranks, "id", "left")
    g = g.join(betweenness, "id", "left")
    for t, end, to in (("drug_targets_gene", "target_id", "drugs"), ("gene_in_pathway", "source_id", "pathways"), ("gene_associated_with_disease", "source_id", "diseases")):
        g = g.join(count(t, end, to), "id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    combined = 0.4 * z("centrality") + 0.3 * z("betweenness") + 0.3 * z("rank")
    extra = 0.25 * F.least(z("drugs"), F.lit(3)) / 3 + 0.15 * F.least(z("pathways"), F.lit(5)) / 5 + 0.15 * F.least(z("diseases"), F.lit(5)) / 5
    return g.select("id", "name", combined.alias("combined"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), combined + extra)).alias("druggability"), z("drugs").alias("drugs"), z("pathways").alias("pathways"), z("diseases").alias("diseases"))


def _reach(indptr, indices, s: int):
    """Shortest paths from one node: (number of paths to each node, steps of each level as (from, to))."""
    import numpy as np

    n = len(indptr) - 1
    seen, sigma, steps = np.zeros(n, bool), np.zeros(n), []
    seen[s], sigma[s] = True, 1.0
    front = np.array([s])
    while True:
        many = indptr[front + 1] - indptr[front]
        at = np.repeat(indptr[front] - np.cumsum(many) + many, many) + np.arange(many.sum())
        a, b = np.repeat(front, many), indices[at]
        new = ~seen[b]
        a, b = a[new], b[new]
        if not len(b):
            return sigma, steps
        front = _add(sigma, b, sigma[a])
        seen[front] = True
        steps.append((a, b))


def _add(total, at, values):
    """Add values to ``total`` by place; return the places.  Costs no more than the values, so deep graphs stay cheap."""
    import numpy as np

    if 8 * len(at) > len(total):
        sums = np.bincount(at, values, len(total))
        total += sums
        return np.flatnonzero(sums)
    places, inverse = np.unique(at, return_inverse=True)
    total[places] += np.bincount(inverse, values)
    return places


def _betweenness_by_joins(pairs: DataFrame, nodes: DataFrame, n: int, *, batch: int) -> DataFrame:
    """(id, b): the sums of Brandes over all sources, some ``batch`` sources at a time, each level a join; nothing is gathered in one place."""
    groups = -(-n // batch)
    done = None
    for k in range(groups):
        level = checkpoint(nodes.filter(F.pmod(F.xxhash64("id"), F.lit(groups)) == k).select(F.col("id").alias("s"), "id", F.lit(1.0).alias("sigma")))
        levels = [level]
        seen = level.select("s", "id")
        while True:
            step = level.join(pairs, "id").groupBy("s", F.col("other").alias("id")).agg(F.sum("sigma").alias("sigma"))
            level = checkpoint(step.join(seen, ["s", "id"], "left_anti"))
            if not level.take(1):
                break
            levels.append(level)
            seen = seen.unionByName(level.select("s", "id"))
        delta, sums = levels[-1].withColumn("delta", F.lit(0.0)), done
        for near in reversed(levels[1:-1]):
            back = delta.join(pairs, "id").groupBy("s", F.col("other").alias("id")).agg(F.sum((1 + F.col("delta")) / F.col("sigma")).alias("part"))
            delta = checkpoint(near.join(back, ["s", "id"], "left").select("s", "id", "sigma", (F.col("sigma") * F.coalesce("part", F.lit(0.0))).alias("delta")))
            own = delta.groupBy("id").agg(F.sum("delta").alias("b"))
            sums = own if sums is None else sums.unionByName(own)
        done = sums if sums is None else checkpoint(sums.groupBy("id").agg(F.sum("b").alias("b")))
    return nodes.select("id", F.lit(0.0).alias("b")).limit(0) if done is None else done


def betweenness(kg: KnowledgeGraph, *, max_nodes: int | None = None, parts: int = 64, broadcast_pairs: int = 10_000_000, batch: int = 256) -> DataFrame:
    """(id, betweenness): exact Brandes, unweighted and undirected, normalised by 1 / ((n - 1)(n - 2)).

    Every node is a source.  Up to ``broadcast_pairs`` nodes and pairs of neighbours (as integers, 4 bytes each) the sources are spread over
    tasks that all have the whole adjacency; beyond, levels are joins for ``batch`` sources at a time.  Either way time grows with
    nodes times edges.  Graphs of more than ``max_nodes`` nodes, if given, are refused."""
    import numpy as np
    import pandas as pd

    spark = kg.edges.sparkSession
    nodes = checkpoint(universe(kg))
    n = nodes.count()
    if max_nodes is not None and n > max_nodes:
        raise ValueError(f"betweenness was asked for up to {max_nodes} nodes only")
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    pairs = checkpoint(kg.neighbour_pairs())
    if max(n, pairs.count()) > broadcast_pairs:
        sums = _betweenness_by_joins(pairs, nodes, n, batch=batch)
        return nodes.join(sums, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))
    names = checkpoint(running_totals(nodes.withColumn("one", F.lit(1)), [F.col("id")], {"node": "one"}).select("id", (F.col("node") - 1).cast("int").alias("node")))
    ends = pairs.join(names, "id").select("other", F.col("node").alias("a")).join(names.withColumnRenamed("id", "other"), "other").select("a", F.col("node").alias("b")).toArrow()
    a, indices = ends["a"].to_numpy(), ends["b"].to_numpy()
    indptr = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]).astype(np.int64)
    shared = spark.sparkContext.broadcast((indptr, indices[np.argsort(a, kind="stable")]))

    def run(batches):
        indptr, indices = shared.value
        total = np.zeros(len(indptr) - 1)
        for pdf in batches:
            for s in pdf["id"]:
                sigma, steps = _reach(indptr, indices, s)
                delta = np.zeros(len(total))
                for v, w in reversed(steps[1:]):
                    _add(delta, v, sigma[v] / sigma[w] * (1 + delta[w]))
                total += delta
        some = np.flatnonzero(total)
        yield pd.DataFrame({"node": some, "b": total[some]})

    sums = spark.range(n).repartition(parts).mapInPandas(run, "node long, b double").groupBy("node").agg(F.sum("b").alias("b"))
    return names.join(sums, "node", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def neighbour_jaccard(kg: KnowledgeGraph, queries: DataFrame, *, top: int = 10) -> DataFrame:
    """Nodes whose sets of successors are most alike: (id, rank, other, score); a node without successors has no row.

    Only nodes that share a successor are compared, so scores are above 0."""
    succ = kg.edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("t")).distinct()
    size = succ.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    q = succ.join(queries.select("id").distinct(), "id", "left_semi")
    both = salted_join(succ.withColumnRenamed("id", "other"), q, ["t"], F.col("other")).filter("id <> other").groupBy("id", "other").agg(F.count(F.lit(1)).alias("i"))
    scored = both.join(size, "id").join(size.withColumnsRenamed({"id": "other", "n": "m"}), "other").withColumn("score", F.col("i") / (F.col("n") + F.col("m") - F.col("i")))
    order = W.partitionBy("id").orderBy(F.desc("score"), "other")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("id", "rank", "other", "score")


def log_factorial(n: Column) -> Column:
    """Natural logarithm of n!, from Stirling's series from 16 on, where its error is below 1e-13."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    return F.when(n < 16, F.element_at(small, (F.least(n, F.lit(15)) + 1).cast("int"))).otherwise(series)


def hypergeometric_tail(a: Column, query: Column, term: Column, total: Column) -> Column:
    """P(X >= a) of drawing ``query`` from ``total`` with ``term`` marked.

    The first term comes from log-factorials, each next one from the last by their ratio."""
    choose = lambda n, k: log_factorial(n) - log_factorial(k) - log_factorial(n - k)
    low = F.greatest(a, query + term - total).cast("long")
    top = F.least(query, term).cast("long")
    start = F.exp(choose(term, low) + choose(total - term, query - low) - choose(total, query))
    zero = F.struct(F.lit(0.0).alias("sum"), start.alias("next"))

    def add(s: Column, x: Column) -> Column:
        ratio = (term - x) * (query - x) / ((x + 1) * (total - term - query + x + 1)).cast("double")
        return F.struct((s["sum"] + s["next"]).alias("sum"), F.when(x < top, s["next"] * ratio).otherwise(0.0).alias("next"))

    sums = F.aggregate(F.sequence(low, top), zero, add)["sum"]
    return F.when(low > top, 0.0).otherwise(F.least(F.lit(1.0), sums))


def enrichment(query: DataFrame, members: DataFrame, background: DataFrame) -> DataFrame:
    """Which terms hold more of a query's genes than chance: (query, term, overlap, p, fdr).

    ``query``: (query, gene); ``members``: (term, gene); ``background``: (gene).  Members outside the background don't
    count, query genes outside it do.  One-sided Fisher test; Benjamini-Hochberg over the terms with any overlap."""
    bg = background.select("gene").distinct()
    q, m = query.select("query", "gene").distinct(), members.select("term", "gene").distinct().join(bg, "gene", "left_semi")
    nq, nt = q.groupBy("query").agg(F.count(F.lit(1)).alias("nq")), m.groupBy("term").agg(F.count(F.lit(1)).alias("nt"))
    outside = q.join(bg, "gene", "left_anti").groupBy("query").agg(F.count(F.lit(1)).alias("outside"))
    size = bg.agg(F.count(F.lit(1)).alias("nb"))
    hits = q.join(m, "gene").groupBy("query", "term").agg(F.count(F.lit(1)).alias("overlap")).join(nq, "query").join(nt, "term").join(outside, "query", "left").join(F.broadcast(size))
    a, b, c = F.col("overlap"), F.col("nq") - F.col("overlap"), F.col("nt") - F.col("overlap")
    d = F.greatest(F.lit(0), F.col("nb") + F.coalesce("outside", F.lit(0)) - (F.col("nq") + F.col("nt") - F.col("overlap")) - F.coalesce("outside", F.lit(0)))
    hits = hits.select("query", "term", "overlap", (a + b).alias("drawn"), (a + c).alias("marked"), (a + b + c + d).alias("total"))
    hits = hits.withColumn("p", hypergeometric_tail(F.col("overlap"), F.col("drawn"), F.col("marked"), F.col("total")))
    return benjamini_hochberg(hits, ["query"], "p", ["term"]).select("query", "term", "overlap", "p", "fdr")


def benjamini_hochberg(df: DataFrame, group: list[str], p: str, ties: list[str]) -> DataFrame:
    """``df`` with fdr: least p * m / rank from here to the largest p, at most 1."""
    up = W.partitionBy(*group).orderBy(p, *ties)
    ranked = df.withColumn("_r", F.row_number().over(up)).withColumn("_m", F.count(F.lit(1)).over(W.partitionBy(*group)))
    down = W.partitionBy(*group).orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn("fdr", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down))).drop("_r", "_m")


def yearly_counts(articles: DataFrame, topic: str) -> DataFrame:
    """(year, n): articles with the topic in title or abstract, by observed year."""
    t = topic.lower()
    hit = F.lower(F.coalesce("title", F.lit(""))).contains(t) | F.lower(F.coalesce("abstract", F.lit(""))).contains(t)
    return articles.filter(hit & F.col("year").isNotNull()).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def velocity(counts: DataFrame) -> DataFrame:
    """(velocity): slope of yearly counts, 0 with fewer than two years."""
    return counts.agg(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.regr_slope("n", "year")).alias("velocity"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9_:-]+"), F.lit(0))


def lexical_drift(articles: DataFrame) -> DataFrame:
    """(year, drift): one minus the weighted Jaccard similarity of a year's words and the year's before it."""
    words = articles.filter("year is not null").select("year", F.explode(tokens(F.coalesce("abstract", F.lit("")))).alias("w")).groupBy("year", "w").agg(F.count(F.lit(1)).alias("n"))
    years = words.select("year").distinct().withColumn("before", F.lag("year").over(W.orderBy("year"))).filter("before is not null")
    this = words.join(F.broadcast(years), "year").select(F.col("year").alias("y"), "w", F.col("n").alias("n1"))
    last = words.join(F.broadcast(years.select(F.col("year").alias("y"), F.col("before").alias("year"))), "year").select("y", "w", F.col("n").alias("n2"))
    both = this.join(last, ["y", "w"], "full_outer").select("y", F.coalesce("n1", F.lit(0)).alias("a"), F.coalesce("n2", F.lit(0)).alias("b"))
    return both.groupBy(F.col("y").alias("year")).agg((1 - F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))).alias("drift"))


def emerging_terms(articles: DataFrame, *, top: int = 10) -> DataFrame:
    """(term, recent, historical, score): words with a capital or digit that more articles of the last two years use than before."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    found = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9_-]{2,}"), F.lit(0)), lambda x: x.rlike("[A-Z0-9]")))
    rows = articles.filter("year is not null")
    ranked = rows.select("year").distinct().withColumn("r", F.row_number().over(W.orderBy(F.desc("year"))))
    many = ranked.agg(F.max("r").alias("years"))
    rows = rows.join(F.broadcast(ranked), "year").join(F.broadcast(many))
    words = rows.select("r", "years", F.explode(found).alias("t")).select("r", "years", F.lower("t").alias("term"))
    old = F.when(F.col("years") > 2, F.col("r") > 2).otherwise(F.col("r") == 2)
    n = words.groupBy("term").agg(F.count_if(F.col("r") <= 2).alias("recent"), F.count_if(old).alias("historical"))
    growth = F.col("recent") - F.col("historical")
    n = n.filter(growth > 0).withColumn("score", growth * F.log1p(F.col("recent") / F.greatest("historical", F.lit(1))))
    return n.orderBy(F.desc("score"), "term").limit(top)
