"""The typed property multigraph as two DataFrames: building it, looking into it, walking it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import DEFAULT_EDGE_TYPE
from . import adjacency as N
from .containment import contains_pairs
from .runtime import checkpoint, running_totals, salted_join

EDGE_KEY = ["source_id", "target_id", "edge_type"]


def _newest(value: Column, order: Column) -> Column:
    """The last value that isn't null, by order."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def _blank_to_null(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.simpleString()
    if kind == "string":
        return F.when(F.col(c) != "", F.col(c))
    if kind.startswith(("array", "map")):
        return F.when(F.size(c) > 0, F.col(c))
    return F.col(c)


def newest_entries(rows: DataFrame, keys: list[str], entries: str, order: Column) -> DataFrame:
    """Maps of one key merged, a later row's entry over an earlier one's: (keys, entries)."""
    flat = rows.select(*keys, F.explode(entries).alias("_k", "_v"), order.alias("_o"))
    one = flat.groupBy(*keys, "_k").agg(F.max_by("_v", "_o").alias("_v"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(entries))


def all_sources(rows: DataFrame, keys: list[str], sources: str) -> DataFrame:
    """Sorted union of the arrays of one key: (keys, sources)."""
    flat = rows.select(*keys, F.explode(sources).alias("_s")).filter("_s is not null").distinct()
    return flat.groupBy(*keys).agg(F.array_sort(F.collect_list("_s")).alias(sources))


def put_nodes(rows: DataFrame, order: Column, *, id: str = "id") -> DataFrame:
    """Insert: by id the last value of each column that isn't null; maps and arrays are replaced whole."""
    cols = [c for c in rows.columns if c != id]
    return rows.filter(F.col(id).isNotNull()).withColumn("_o", order).groupBy(id).agg(*[_newest(F.col(c), F.col("_o")).alias(c) for c in cols])


def merge_nodes(rows: DataFrame, order: Column, *, id: str = "id", properties: str = "properties", sources: str = "sources") -> DataFrame:
    """Merge: by id the last value that isn't null, empty text, empty array or map; properties merged by key, sources united.

    Zero and false count as values.  Properties and sources are pre-aggregated by entry, so an id with any
    number of rows never gathers more than its distinct entries."""
    keyed = rows.filter(F.col(id).isNotNull()).withColumn("_o", order)
    cols = [c for c in rows.columns if c not in (id, properties, sources)]
    flat = keyed.groupBy(id).agg(*[_newest(_blank_to_null(rows, c), F.col("_o")).alias(c) for c in cols])
    return flat.join(newest_entries(keyed, [id], properties, F.col("_o")), id, "left").join(all_sources(keyed, [id], sources), id, "left")


def put_edges(rows: DataFrame, order: Column) -> DataFrame:
    """Insert: by (source, target, type) the whole last row."""
    cols = [c for c in rows.columns if c not in EDGE_KEY]
    last = rows.groupBy(*EDGE_KEY).agg(F.max_by(F.struct(*cols), order).alias("_r"))
    return last.select(*EDGE_KEY, "_r.*")


def merge_edges(rows: DataFrame, order: Column) -> DataFrame:
    """Merge: by (source, target, type) the greatest score, properties merged by key, sources united."""
    base = rows.groupBy(*EDGE_KEY).agg(F.max("score").alias("score"))
    keyed = rows.withColumn("_o", order)
    eq = lambda a, b: a.join(b, EDGE_KEY, "left")
    return eq(eq(base, newest_entries(keyed, EDGE_KEY, "properties", F.col("_o"))), all_sources(keyed, EDGE_KEY, "sources"))


def clean_edges(rows: DataFrame) -> DataFrame:
    """Edges with both ends, types in lower case, the default type and the score 1 where missing."""
    return rows.filter(F.col("source_id").isNotNull() & F.col("target_id").isNotNull()).withColumn("edge_type", F.coalesce(F.lower("edge_type"), F.lit(DEFAULT_EDGE_TYPE))).withColumn("score", F.coalesce("score", F.lit(1.0)))


@dataclass(frozen=True)
class KnowledgeGraph:
    """Nodes (id, name, node_type, …) and edges (source_id, target_id, edge_type, score, …); every method is lazy."""

    nodes: DataFrame
    edges: DataFrame

    def get_node(self, id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == id)

    def get_edges(self, *, source_id: str | None = None, target_id: str | None = None, edge_type: str | None = None) -> DataFrame:
        """Edges that agree with all given values; the filters reach the scan."""
        out = self.edges
        for c, v in (("source_id", source_id), ("target_id", target_id), ("edge_type", edge_type)):
            out = out if v is None else out.filter(F.col(c) == v)
        return out

    def of_type(self, *types: str) -> DataFrame:
        return self.edges.filter(F.col("edge_type").isin(*types))

    def stats(self) -> DataFrame:
        """(what, type, n): totals (type null) and counts by type."""
        def one(df: DataFrame, what: str, kind: str) -> DataFrame:
            both = df.rollup(kind).agg(F.count(F.lit(1)).alias("n"), F.grouping(kind).alias("g"))
            return both.filter((F.col("g") == 1) | F.col(kind).isNotNull()).select(F.lit(what).alias("what"), F.col(kind).alias("type"), "n")
        return one(self.nodes, "node", "node_type").unionByName(one(self.edges, "edge", "edge_type"))

    def undirected(self) -> DataFrame:
        """(u, v, edge_type) once for both directions of a type."""
        return self.edges.select(F.least("source_id", "target_id").alias("u"), F.greatest("source_id", "target_id").alias("v"), "edge_type").distinct()

    def neighbour_pairs(self) -> DataFrame:
        """(id, other) both ways, each pair once, without loops."""
        e = self.edges.filter("source_id <> target_id")
        return e.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).unionByName(e.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"))).distinct()

    def incident(self, ids: DataFrame) -> DataFrame:
        """Edges at each id of ``ids``, outgoing and incoming; a loop comes out twice."""
        out = self.edges.join(ids.select(F.col("id").alias("source_id")), "source_id").select(F.col("source_id").alias("id"), F.lit("out").alias("direction"), "source_id", "target_id", "edge_type", "score")
        inn = self.edges.join(ids.select(F.col("id").alias("target_id")), "target_id").select(F.col("target_id").alias("id"), F.lit("in").alias("direction"), "source_id", "target_id", "edge_type", "score")
        return out.unionByName(inn)

    def search(self, queries: DataFrame, *, limit: int = 10) -> DataFrame:
        """Nodes whose id, name or properties hold the query as a substring: (query, rank, id, name, node_type).

        Queries (query, node_type or null) are lower-cased and stripped.  Exact names come first, then by name, then id."""
        q = queries.select("query", F.lower(F.regexp_replace("query", r"^\s+|\s+$", "")).alias("q"), F.col("node_type").alias("want")).distinct()
        n = self.nodes.withColumn("text", F.lower(F.concat_ws(" ", "id", "name", F.to_json("properties"))))
        met = contains_pairs(n.select(F.col("id").alias("key"), "text"), q.select(F.col("q").alias("needle"))).select(F.col("key").alias("id"), F.col("needle").alias("q"))
        hit = met.join(self.nodes, "id").join(q, "q").filter(F.col("want").isNull() | (F.col("want") == F.col("node_type")))
        order = W.partitionBy("query", "want").orderBy((F.lower("name") != F.col("q")).asc_nulls_last(), F.lower("name").asc_nulls_last(), "id")
        return hit.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query", "rank", "id", "name", "node_type")

    def targets(self, edge_type: str) -> DataFrame:
        """Named nodes at the end of edges of one type: (source_id, id, name)."""
        return self.of_type(edge_type).join(self.nodes.select(F.col("id").alias("target_id"), "name"), "target_id").select("source_id", F.col("target_id").alias("id"), "name")

    def repurposing(self, *, min_score: float = 0.0) -> DataFrame:
        """Drugs that reach a disease through its genes and don't treat it yet: (disease, drug, score, genes).

        score is the sum over genes of the two edges' scores multiplied.  The two edge sets meet on the gene, known
        pairs leave by an anti-join."""
        gd = self.of_type("gene_associated_with_disease").select(F.col("source_id").alias("gene"), F.col("target_id").alias("disease"), F.col("score").alias("s1"))
        dg = self.of_type("drug_targets_gene").select(F.col("target_id").alias("gene"), F.col("source_id").alias("drug"), F.col("score").alias("s2"))
        known = self.of_type("drug_treats_disease").select(F.col("source_id").alias("drug"), F.col("target_id").alias("disease"))
        sums = salted_join(gd, dg, ["gene"], F.col("disease")).groupBy("disease", "drug").agg(F.sum(F.col("s1") * F.col("s2")).alias("score"), F.array_sort(F.collect_set("gene")).alias("genes"))
        return sums.join(known, ["disease", "drug"], "left_anti").filter(F.col("score") >= min_score)

    def hops(self, seeds: DataFrame, *, radius: int, least: int = 0, among: DataFrame | None = None, shared_edges: int = N.LIMIT) -> DataFrame:
        """Nodes within ``radius`` undirected steps: (seed, id, level), the least level of each; ``least`` and ``among`` (id) say which are wanted.

        Up to ``shared_edges`` edges all tasks have the neighbours as integers and each walks from its own seeds.  Beyond, and for a single
        step, a frontier moves out by joins; nodes seen before leave by an anti-join."""
        shared = N.shared_graph(self, limit=shared_edges) if radius > 1 else None
        if shared is not None:
            groups = seeds.select(F.col("id").alias("key"), "id")
            return N.around(groups, shared, radius=radius, least=least, among=among).withColumnRenamed("key", "seed")
        pairs = checkpoint(self.neighbour_pairs())
        seen = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("level"))
        frontier = seen
        for level in range(1, radius + 1):
            step = salted_join(pairs, frontier, ["id"], F.col("other")).select("seed", F.col("other").alias("id")).distinct()
            frontier = checkpoint(step.join(seen, ["seed", "id"], "left_anti").withColumn("level", F.lit(level)))
            seen = seen.unionByName(frontier)
            if not frontier.take(1):
                break
        seen = seen.filter(F.col("level") >= least)
        return seen if among is None else seen.join(among.select("id").distinct(), "id", "left_semi").select("seed", "id", "level")

    def subgraph(self, ids: DataFrame) -> DataFrame:
        """Directed edges with both ends among ``ids``."""
        e = self.edges.join(ids.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
        return e.join(ids.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi")

    def shortest_paths(self, pairs: DataFrame, *, max_length: int = 6, shared_edges: int = N.LIMIT) -> DataFrame:
        """One undirected shortest path of each pair: (source, target, length, path), of equals the first in the order of its ids.

        Source equal to target is a path of itself; pairs farther apart than ``max_length`` steps, or of
        unknown nodes, give no row.  Up to ``shared_edges`` edges all tasks have the neighbours as integers and walk by themselves.  Beyond, both ends move, the one with the smaller frontier first, until they meet.  A frontier keeps
        one best path by end and node, shared by all pairs of that end, and is rid of ends whose pairs have all met."""
        pairs = checkpoint(pairs.select("source", "target").distinct())
        itself = pairs.filter("source = target").join(self.nodes.select(F.col("id").alias("source")), "source", "left_semi").select("source", "target", F.lit(0).alias("length"), F.array("source").alias("path"))
        shared = N.shared_graph(self, limit=shared_edges)
        if shared is not None:
            return itself.unionByName(N.paths(pairs, shared, max_length=max_length))
        # Walks are of the nodes' numbers in the order of their ids.
        e = self.edges.filter("source_id <> target_id").select(F.col("source_id").alias("source"), F.col("target_id").alias("target")).distinct()
        ids = e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id"))).distinct()
        names = checkpoint(running_totals(ids.withColumn("one", F.lit(1)), [F.col("id")], {"n": "one"}).select("id", F.col("n").cast("int").alias("n")))
        coded = lambda df: df.join(names.withColumnsRenamed({"id": "source", "n": "_s"}), "source").join(names.withColumnsRenamed({"id": "target", "n": "_t"}), "target").select(F.col("_s").alias("source"), F.col("_t").alias("target"))
        e, pairs = checkpoint(coded(e)), checkpoint(coded(pairs.filter("source <> target")))
        links = e.select(F.col("source").alias("id"), F.col("target").alias("other")).unionByName(e.select(F.col("target").alias("id"), F.col("source").alias("other")))
        found = None
        # By end the last frontier and the one before: in an undirected graph a step leads nowhere further back.
        fronts = {end: pairs.select(F.col(end).alias("end"), F.col(end).alias("id"), F.array(end).alias("path")).distinct() for end in ("source", "target")}
        before = {end: f.select("end", "id").limit(0) for end, f in fronts.items()}
        for level in range(1, max_length + 1):
            sizes = {end: f.count() for end, f in fronts.items()}
            end = min(sizes, key=sizes.get)
            if not sizes[end]:
                break
            front = fronts[end]
            longer = F.concat("path", F.array("other")) if end == "source" else F.concat(F.array("other"), "path")
            step = salted_join(front, links, ["id"], F.col("end")).select("end", F.col("other").alias("id"), longer.alias("path"))
            step = step.groupBy("end", "id").agg(F.min("path").alias("path"))
            fronts[end] = checkpoint(step.join(front.select("end", "id").unionByName(before[end]), ["end", "id"], "left_anti"))
            before[end] = front.select("end", "id")
            s, t = (fronts[e].select(F.col("end").alias(e), "id", F.col("path").alias(p)) for e, p in (("source", "start"), ("target", "rest")))
            # The middle stands in both halves.
            whole = F.concat("start", F.slice("rest", F.lit(2), F.greatest(F.size("rest") - 1, F.lit(0))))
            hit = checkpoint(pairs.join(s, "source").join(t, ["target", "id"]).groupBy("source", "target").agg(F.min(whole).alias("path")))
            met = hit.select("source", "target", F.lit(level).alias("length"), "path")
            found = met if found is None else found.unionByName(met)
            going = fronts[end].select(F.col("end").alias(end)).distinct()  # an end that gets no farther meets nobody
            pairs = checkpoint(pairs.join(hit.select("source", "target"), ["source", "target"], "left_anti").join(going, end, "left_semi"))
            fronts = {e: f.join(pairs.select(F.col(e).alias("end")).distinct(), "end", "left_semi") for e, f in fronts.items()}
        if found is None:
            return itself
        steps = found.select("source", "target", "length", F.posexplode("path").alias("at", "n")).join(names, "n").groupBy("source", "target", "length")
        path = F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"])
        found = steps.agg(path.alias("path")).select(F.element_at("path", 1).alias("source"), F.element_at("path", -1).alias("target"), "length", "path")
        return itself.unionByName(found)

    def supporting_publications(self) -> DataFrame:
        """Publications that mention both a disease and one of its genes: (disease, gene, publication)."""
        pd = self.of_type("publication_mentions_disease").select(F.col("source_id").alias("publication"), F.col("target_id").alias("disease")).distinct()
        pg = self.of_type("publication_mentions_gene").select(F.col("source_id").alias("publication"), F.col("target_id").alias("gene")).distinct()
        gd = self.of_type("gene_associated_with_disease").select(F.col("source_id").alias("gene"), F.col("target_id").alias("disease")).distinct()
        return gd.join(pg, "gene").join(pd, ["publication", "disease"], "left_semi").select("disease", "gene", "publication")

    def structural_holes(self, seeds: DataFrame, *, target_type: str, relation: str, min_level: int = 2, max_level: int = 3) -> DataFrame:
        """Nodes of a type two or three steps away and not yet linked by the relation: (seed, id, level)."""
        typed = self.nodes.filter(F.col("node_type") == target_type).select("id")
        linked = self.of_type(relation).select(F.col("source_id").alias("seed"), F.col("target_id").alias("id"))
        far = self.hops(seeds, radius=max_level, least=min_level, among=typed)
        # What the relation links is one step away, or none.
        return far if min_level > 1 else far.join(linked, ["seed", "id"], "left_anti").select("seed", "id", "level")

    def triples(self, ids: DataFrame, *, limit: int = 50) -> DataFrame:
        """Best edges among ``ids`` as text: (rank, triple, score)."""
        names = self.nodes.select("id", F.coalesce("name", "id").alias("name"))
        t = self.subgraph(ids).join(names.withColumnsRenamed({"id": "source_id", "name": "s"}), "source_id").join(names.withColumnsRenamed({"id": "target_id", "name": "t"}), "target_id")
        best = t.orderBy(F.desc("score"), "source_id", "target_id", "edge_type").limit(limit)
        rank = F.row_number().over(W.orderBy(F.desc("score"), "source_id", "target_id", "edge_type"))
        return best.select(rank.alias("rank"), F.concat_ws(" ", "s", "edge_type", "t").alias("triple"), "score")


def local_index(nodes: DataFrame) -> DataFrame:
    """Nodes with their place within their type, from 0, in the order of their ids: (id, node_type, i).

    Places in the order of type and id come from running totals over ranges; a type starts where its first place is."""
    typed = nodes.filter("node_type is not null").select("node_type", "id", F.lit(1).alias("one"))
    placed = checkpoint(running_totals(typed, [F.col("node_type"), F.col("id")], {"at": "one"}))
    first = placed.groupBy("node_type").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "node_type").select("id", "node_type", (F.col("at") - F.col("first")).alias("i"))


def numbered(ids: DataFrame, name: str) -> DataFrame:
    """Ids numbered from 1 in their order: (n, name)."""
    return running_totals(ids.select("id", F.lit(1).alias("one")), [F.col("id")], {"n": "one"}).select("n", F.col("id").alias(name))


def recent_publications(kg: KnowledgeGraph, *, top: int = 5) -> DataFrame:
    """Latest publications of each gene: (gene, rank, pmid, year); a missing year counts as 0."""
    p = kg.of_type("publication_mentions_gene").join(kg.nodes.select(F.col("id").alias("source_id"), "pmid", "year"), "source_id")
    order = W.partitionBy("target_id").orderBy(F.coalesce("year", F.lit(0)).desc(), "source_id")
    return p.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(F.col("target_id").alias("gene"), "rank", "pmid", "year")


def repurposing_evidence(kg: KnowledgeGraph, candidates: DataFrame) -> DataFrame:
    """(disease, drug, papers): publications with a PMID that mention the disease and one of the genes of a candidate (disease, drug, genes)."""
    named = kg.nodes.filter("pmid is not null").select(F.col("id").alias("publication"), "pmid")
    found = kg.supporting_publications().join(named, "publication").select("disease", "gene", "pmid").distinct()
    by_gene = candidates.select("disease", "drug", F.explode("genes").alias("gene"))
    return by_gene.join(found, ["disease", "gene"]).groupBy("disease", "drug").agg(F.count_distinct("pmid").alias("papers"))


def repurposing_report(kg: KnowledgeGraph, *, top: int = 10, model: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """Repurposing candidates with a confidence: (disease, drug, confidence, level), the best of each disease.

    0.35 score over the disease's best (or 1) + 0.30 model + 0.20 publications of 5 + 0.15 genes of 5; ``model`` has
    (disease, drug, model), ``evidence`` (disease, drug, papers), both optional and 0 where missing."""
    c = kg.repurposing()
    c = c.join(model, ["disease", "drug"], "left") if model is not None else c.withColumn("model", F.lit(0.0))
    c = c.join(evidence, ["disease", "drug"], "left") if evidence is not None else c.withColumn("papers", F.lit(0))
    best = c.groupBy("disease").agg(F.max("score").alias("best"))
    base = F.col("score") / F.greatest("best", F.lit(1.0))
    conf = 0.35 * base + 0.30 * F.coalesce("model", F.lit(0.0)) + 0.20 * F.least(F.coalesce("papers", F.lit(0)), F.lit(5)) / 5 + 0.15 * F.least(F.size("genes"), F.lit(5)) / 5
    c = c.join(best, "disease").select("disease", "drug", F.round(conf, 6).alias("confidence"))
    level = F.when(F.col("confidence") >= 0.75, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low")
    order = W.partitionBy("disease").orderBy(F.desc("confidence"), "drug")
    return c.withColumn("level", level).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).drop("r")


def pathway_crosstalk(kg: KnowledgeGraph, terms: DataFrame | None = None) -> DataFrame:
    """Crosstalk edges with the genes both pathways share: (source_id, target_id, score, genes); ``terms`` (term) limits both ends."""
    e = kg.of_type("pathway_crosstalks_with").select("source_id", "target_id", "score")
    if terms is not None:
        for end in ("source_id", "target_id"):
            e = e.join(terms.select(F.col("term").alias(end)).distinct(), end, "left_semi")
    m = kg.of_type("gene_in_pathway").select(F.col("target_id").alias("term"), F.col("source_id").alias("gene")).distinct()
    both = e.join(m.withColumnRenamed("term", "source_id"), "source_id").join(m.withColumnRenamed("term", "target_id"), ["target_id", "gene"])
    return both.groupBy("source_id", "target_id", "score").agg(F.array_join(F.array_sort(F.collect_set("gene")), "|").alias("genes"))
