"""Reports put together from the graph's operators, and requests routed to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import analytics as A
from . import clinical as C
from . import context as K
from . import graph as G
from .graph import KnowledgeGraph
from .runtime import checkpoint


def _none() -> Column:
    return F.lit(None).cast("string")


def named_neighbours(kg: KnowledgeGraph, ids: DataFrame, edge_type: str, *, out: bool = True) -> DataFrame:
    """Names at the other end of a relation's edges at each id (id): (id, other, name), an edge each, unnamed or unknown nodes left out."""
    here, there = ("source_id", "target_id") if out else ("target_id", "source_id")
    e = kg.of_type(edge_type).select(F.col(here).alias("id"), F.col(there).alias("other")).join(ids.select("id").distinct(), "id", "left_semi")
    return e.join(kg.nodes.filter("name is not null").select(F.col("id").alias("other"), "name"), "other").select("id", "other", "name")


def resolve_nodes(kg: KnowledgeGraph, queries: DataFrame) -> DataFrame:
    """(query, id): the node each query (query, node_type or null) means: its id, if of the type, else its name, else the first that a text search finds."""
    q = queries.select("query", "node_type").distinct().withColumn("k", F.lower(X.strip(F.col("query"))))
    of_type = F.col("node_type").isNull() | (F.col("node_type") == F.col("kind"))
    n = kg.nodes.select("id", F.col("node_type").alias("kind"), F.lower(X.strip(F.col("name"))).alias("name"))
    by_id = q.join(n, q["query"] == n["id"]).filter(of_type).select("query", "node_type", "id")
    left = q.join(by_id, q["query"].eqNullSafe(by_id["query"]) & q["node_type"].eqNullSafe(by_id["node_type"]), "left_anti")
    by_name = left.join(n, F.col("k") == F.col("name")).filter(of_type).groupBy("query", "node_type").agg(F.min("id").alias("id"))
    rest = left.join(by_name, left["query"].eqNullSafe(by_name["query"]) & left["node_type"].eqNullSafe(by_name["node_type"]), "left_anti").select("query", "node_type")
    found = kg.search(rest, limit=1).select("query", "id")
    return by_id.select("query", "id").unionByName(by_name.select("query", "id")).unionByName(found).distinct()


def gene_disease_evidence(kg: KnowledgeGraph, pairs: DataFrame, *, max_length: int = 6) -> DataFrame:
    """(gene, disease, score, length, path): best score of direct edges, 0 without one, and a shortest path, null where there is none."""
    p = checkpoint(pairs.select("gene", "disease").distinct())
    direct = kg.of_type("gene_associated_with_disease").groupBy(F.col("source_id").alias("gene"), F.col("target_id").alias("disease")).agg(F.max("score").alias("score"))
    paths = kg.shortest_paths(p.select(F.col("gene").alias("source"), F.col("disease").alias("target")), max_length=max_length)
    paths = paths.select(F.col("source").alias("gene"), F.col("target").alias("disease"), "length", "path")
    return p.join(direct, ["gene", "disease"], "left").join(paths, ["gene", "disease"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def literature_bridge(kg: KnowledgeGraph, pairs: DataFrame) -> DataFrame:
    """(source_id, target_id, pmids): PMIDs of publications that mention both ends, genes or diseases, of a pair; pairs without any have no row."""
    m = kg.of_type("publication_mentions_gene", "publication_mentions_disease").select(F.col("source_id").alias("p"), F.col("target_id").alias("x"), F.when(F.col("edge_type") == "publication_mentions_gene", "Gene").otherwise("Disease").alias("kind"))
    m = checkpoint(m.join(kg.nodes.select(F.col("id").alias("x"), F.col("node_type").alias("kind")), ["x", "kind"], "left_semi").select("p", "x").distinct())
    papers = kg.nodes.filter("pmid is not null").select(F.col("id").alias("p"), "pmid")
    h = pairs.select("source_id", "target_id").distinct()
    both = h.join(m.withColumnRenamed("x", "source_id"), "source_id").join(m.withColumnRenamed("x", "target_id"), ["p", "target_id"]).join(papers, "p")
    return both.groupBy("source_id", "target_id").agg(F.array_sort(F.collect_set("pmid")).alias("pmids"))


def edges_exist(kg: KnowledgeGraph, pairs: DataFrame) -> DataFrame:
    """(source_id, target_id, linked): whether any edge joins a pair, either way."""
    h = pairs.select("source_id", "target_id").distinct().withColumns({"u": F.least("source_id", "target_id"), "v": F.greatest("source_id", "target_id")})
    u = kg.undirected().select("u", "v").distinct().withColumn("linked", F.lit(True))
    return h.join(u, ["u", "v"], "left").select("source_id", "target_id", F.coalesce("linked", F.lit(False)).alias("linked"))


def mechanisms(kg: KnowledgeGraph, listed: DataFrame) -> DataFrame:
    """(id, mechanism) of drugs: as listed (id, mechanism), the first by name, else the names of their targets."""
    first = listed.filter("mechanism is not null").groupBy("id").agg(F.min("mechanism").alias("listed"))
    names = kg.targets("drug_targets_gene").filter("name is not null").groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    return kg.nodes.filter("node_type = 'Drug'").select("id").join(first, "id", "left").join(names, "id", "left").select("id", F.coalesce("listed", "names").alias("mechanism"))


def split_list(text: Column, pattern: str = r",|;|\band\b") -> Column:
    """Names listed in a text, at commas, semicolons and the word 'and'; the text itself if nothing is left."""
    parts = F.filter(F.transform(F.split(text, pattern), X.strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def coerce_int(text: Column, default: int = 0) -> Column:
    """The first whole number in a text, the default where there is none."""
    return F.coalesce(F.regexp_extract(text, "[0-9]+", 0).try_cast("int"), F.lit(default))


def vis_nodes(kg: KnowledgeGraph) -> DataFrame:
    """Nodes for a network view: (id, label, group, degree, size), size 14 + 8 ln(1 + degree) to two decimals."""
    deg = A.directed_degree(kg).join(kg.nodes.select("id", "name", "node_type"), "id", "left")
    return deg.select("id", F.coalesce("name", "id").alias("label"), F.coalesce("node_type", F.lit("unknown")).alias("group"), "degree", F.round(14 + 8 * F.log1p("degree"), 2).alias("size"))


def vis_edges(kg: KnowledgeGraph) -> DataFrame:
    """Edges for a network view, numbered from 1 in the order of their keys: (id, source_id, target_id, label, score)."""
    from .runtime import running_totals

    e = kg.edges.select(*G.EDGE_KEY, "score").withColumn("one", F.lit(1))
    n = running_totals(e, [F.col(c) for c in G.EDGE_KEY], {"n": "one"})
    return n.select(F.concat(F.lit("edge-"), F.col("n").cast("string")).alias("id"), "source_id", "target_id", F.replace("edge_type", F.lit("_"), F.lit(" ")).alias("label"), "score")


def network(kg: KnowledgeGraph) -> DataFrame:
    """The whole network as one listing: (what, id, type, source_id, target_id, score)."""
    n = kg.nodes.select(F.lit("node").alias("what"), "id", F.col("node_type").alias("type"), _none().alias("source_id"), _none().alias("target_id"), F.lit(None).cast("double").alias("score"))
    return n.unionByName(kg.edges.select(F.lit("edge").alias("what"), _none().alias("id"), F.col("edge_type").alias("type"), "source_id", "target_id", "score"))


# --- reports -------------------------------------------------------------------------------------------------------------


def _listed(rows: DataFrame, key: str, name: str, to: str, *, top: int | None = None) -> DataFrame:
    """(key, to): the sorted distinct names of each key."""
    names = F.array_sort(F.collect_set(name))
    return rows.groupBy(key).agg((names if top is None else F.slice(names, 1, top)).alias(to))


def gene_reports(kg: KnowledgeGraph, genes: DataFrame, ranking: DataFrame) -> DataFrame:
    """(id, name, diseases, drugs, pathways, papers, combined, druggability, summary) of genes (id): names of what they go with and their place in the network."""
    ids = checkpoint(genes.select("id").distinct())
    out = kg.nodes.filter("node_type = 'Gene'").select("id", "name").join(ids, "id", "left_semi")
    for to, kind, way in (("diseases", "gene_associated_with_disease", True), ("drugs", "drug_targets_gene", False), ("pathways", "gene_in_pathway", True)):
        out = out.join(_listed(named_neighbours(kg, ids, kind, out=way), "id", "name", to), "id", "left").withColumn(to, F.coalesce(to, F.array().cast("array<string>")))
    papers = G.recent_publications(kg).join(ids.withColumnRenamed("id", "gene"), "gene", "left_semi")
    papers = papers.groupBy(F.col("gene").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pmid"))), lambda x: x["pmid"]).alias("papers"))
    out = out.join(papers, "id", "left").join(ranking.select("id", "combined", "druggability"), "id", "left").withColumn("papers", F.coalesce("papers", F.array().cast("array<string>")))
    said = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("none identified")
    lines = [F.concat(F.lit("Gene report for "), F.coalesce("name", "id")), *[F.concat(F.lit(f"{head}: "), said(c), F.lit(".")) for head, c in (("Diseases", "diseases"), ("Drug targets", "drugs"), ("Pathways", "pathways"))]]
    place = F.when(F.col("combined").isNotNull(), F.format_string("Network position: combined=%.3f, druggability=%.3f.", "combined", "druggability"))
    return out.withColumn("summary", F.concat_ws("\n", *lines, place))


def explore(kg: KnowledgeGraph, questions: DataFrame, *, seeds: int = 5, max_length: int = 6) -> DataFrame:
    """Questions (query, text) about the graph: (query, mode, nodes, n, confidence, summary).

    A question that names two nodes is answered by a shortest path between the first two in the text, ``nodes`` being the path and n its
    length; any other by the nodes a text search finds and the size n of the graph one step around them."""
    names = kg.nodes.select("id", "name", F.col("node_type").alias("kind"))
    q = checkpoint(questions.select("query", "text").filter("text is not null"))
    m = checkpoint(C.mentions(q.select(F.col("query").alias("doc"), "text"), names, limit=4).filter("rank <= 2"))
    pair = m.groupBy(F.col("doc").alias("query")).agg(F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("source"), F.max(F.when(F.col("rank") == 2, F.col("id"))).alias("target")).filter("target is not null")
    pair = checkpoint(pair)
    # Paths and their stories both read them: walks are made once.
    paths = checkpoint(pair.join(kg.shortest_paths(pair.select("source", "target").distinct(), max_length=max_length), ["source", "target"], "left"))
    label = kg.nodes.select("id", F.coalesce("name", "id").alias("name"))
    steps = paths.filter("path is not null").select("query", F.posexplode("path").alias("pos", "id")).join(label, "id", "left").select("query", F.struct("pos", F.coalesce("name", "id").alias("name")).alias("x"))
    story = steps.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]), " -> ").alias("story"))
    p = paths.select("query", "length", "path").join(story, "query", "left").join(q, "query")
    some = F.concat(F.lit("Shortest graph path for `"), "text", F.lit("`: "), "story", F.lit(". Path length: "), F.col("length").cast("string"), F.lit("."))
    found = F.col("path").isNotNull()
    by_path = p.select("query", F.lit("path").alias("mode"), F.coalesce("path", F.array().cast("array<string>")).alias("nodes"), F.coalesce("length", F.lit(0)).cast("long").alias("n"), F.when(found, 0.8).otherwise(0.2).alias("confidence"), F.when(found, some).otherwise(F.concat(F.lit("No graph path was found for: "), "text")).alias("summary"))
    rest = q.join(pair, "query", "left_anti")
    hits = checkpoint(kg.search(rest.select(F.col("text").alias("query"), _none().alias("node_type")).distinct(), limit=seeds).select(F.col("query").alias("text"), "rank", "id"))
    near = kg.hops(hits.select("id").distinct(), radius=1)
    around = hits.join(near.select(F.col("seed").alias("id"), F.col("id").alias("other")), "id").groupBy("text").agg(F.count_distinct("other").alias("n"))
    listed = hits.groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("nodes"))
    s = rest.join(listed, "text", "left").join(around, "text", "left")
    matched = F.col("nodes").isNotNull()
    told = F.concat(F.lit("Matched "), F.size("nodes").cast("string"), F.lit(" seed nodes for `"), "text", F.lit("` and built a local subgraph with "), F.col("n").cast("string"), F.lit(" nodes."))
    by_search = s.select("query", F.lit("search").alias("mode"), F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes"), F.coalesce("n", F.lit(0)).alias("n"), F.when(matched, 0.7).otherwise(0.1).alias("confidence"), F.when(matched, told).otherwise(F.concat(F.lit("No matching graph nodes were found for: "), "text")).alias("summary"))
    return by_path.unionByName(by_search)


def _first_terms(hits: DataFrame, to: str, n: int) -> DataFrame:
    """(query, to): the ``n`` terms of each query with the least p, then by term."""
    r = hits.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.round("p", 12), "term"))).filter(F.col("r") <= n)
    return r.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias(to))


def pathway_analysis(kg: KnowledgeGraph, sets: DataFrame, *, top: int = 10) -> DataFrame:
    """Gene sets (query, gene) by the pathways and diseases that hold more of their genes than chance, and the crosstalk among the ``top`` pathways:
    (query, pathways, diseases, crosstalk, confidence), names of terms as ids, the best first."""
    sets = checkpoint(sets.select("query", "gene").distinct())
    genes = A.background_genes(kg)
    members = lambda kind: kg.of_type(kind).select(F.col("target_id").alias("term"), F.col("source_id").alias("gene"))
    hits = checkpoint(A.enrichment(sets, members("gene_in_pathway"), genes))
    paths = checkpoint(_first_terms(hits, "pathways", top))
    diseases = _first_terms(A.enrichment(sets, members("gene_associated_with_disease"), genes), "diseases", top)
    terms = paths.select("query", F.explode("pathways").alias("term"))
    e = kg.of_type("pathway_crosstalks_with").select("source_id", "target_id")
    cross = terms.withColumnRenamed("term", "source_id").join(e, "source_id").join(terms.withColumnRenamed("term", "target_id"), ["query", "target_id"], "left_semi").groupBy("query").agg(F.count(F.lit(1)).alias("crosstalk"))
    out = sets.select("query").distinct().join(paths, "query", "left").join(diseases, "query", "left").join(cross, "query", "left")
    none = F.array().cast("array<string>")
    return out.select("query", F.coalesce("pathways", none).alias("pathways"), F.coalesce("diseases", none).alias("diseases"), F.coalesce("crosstalk", F.lit(0)).alias("crosstalk"), F.when(F.size("pathways") > 0, 0.75).otherwise(0.3).alias("confidence"))


def drug_reports(kg: KnowledgeGraph, listed: DataFrame, *, top: int = 5) -> DataFrame:
    """Drugs with their safety and mechanism: (id, name, side_effects, mechanism, contraindicated, interactions, summary).

    Side effects are the ``top`` names by score, then name; ``interactions`` counts the drugs it interacts with, either way."""
    drugs = kg.nodes.filter("node_type = 'Drug'").select("id", "name")
    named = kg.nodes.filter("name is not null").select(F.col("id").alias("target_id"), F.col("name").alias("effect"))
    side = kg.of_type("drug_causes_side_effect").join(named, "target_id").groupBy(F.col("source_id").alias("id"), "effect").agg(F.max("score").alias("s"))
    side = side.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("s"), "effect"))).filter(F.col("r") <= top).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "effect"))), lambda x: x["effect"]).alias("side_effects"))
    against = kg.of_type("drug_contraindicated_for").join(named, "target_id").groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_set("effect")).alias("contraindicated"))
    ends = kg.of_type("drug_interacts_with_drug").filter("source_id <> target_id").select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("o")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("o")))).alias("x")).select("x.*")
    counts = ends.groupBy("id").agg(F.count_distinct("o").alias("interactions"))
    out = drugs.join(side, "id", "left").join(mechanisms(kg, listed), "id", "left").join(against, "id", "left").join(counts, "id", "left")
    none = F.array().cast("array<string>")
    out = out.select("id", "name", F.coalesce("side_effects", none).alias("side_effects"), "mechanism", F.coalesce("contraindicated", none).alias("contraindicated"), F.coalesce("interactions", F.lit(0)).alias("interactions"))
    effects = F.when(F.size("side_effects") > 0, F.array_join("side_effects", ", ")).otherwise("none reported")
    return out.withColumn("summary", F.concat(F.lit("- "), F.coalesce("name", "id"), F.lit(": side effects="), effects, F.lit("; mechanisms="), F.coalesce("mechanism", F.lit("no mechanism available")), F.lit(".")))


def graph_scores(kg: KnowledgeGraph, matches: DataFrame) -> DataFrame:
    """(case, disease, score): sum over a case's phenotypes (case, phenotype, score) of the scores of the disease edges that end in them times theirs."""
    e = kg.of_type("disease_has_phenotype").select(F.col("target_id").alias("phenotype"), F.col("source_id").alias("disease"), F.col("score").alias("s2"))
    return matches.join(e, "phenotype").groupBy("case", "disease").agg(F.sum(F.col("score") * F.col("s2")).alias("score"))


def name_support(kg: KnowledgeGraph, terms: DataFrame, diseases: DataFrame) -> DataFrame:
    """(case, disease, support): names of a disease's phenotypes that hold one of the case's terms (case, term) or stand in one, sorted.

    ``diseases``: (case, disease) says which to look at."""
    p = kg.nodes.filter("node_type = 'Phenotype' and name is not null").select(F.col("id").alias("phenotype"), "name", F.lower("name").alias("low"))
    of = diseases.select("case", "disease").distinct().join(kg.of_type("disease_has_phenotype").select(F.col("source_id").alias("disease"), F.col("target_id").alias("phenotype")), "disease").join(p, "phenotype")
    t = checkpoint(terms.filter(F.length("term") > 0).select("case", F.lower("term").alias("term")).distinct())
    lows, asked = p.select("low").distinct(), t.select("term").distinct()
    holds = K.contains_pairs(lows.select(F.col("low").alias("key"), F.col("low").alias("text")), asked.select(F.col("term").alias("needle"))).select(F.col("key").alias("low"), F.col("needle").alias("term"))
    stands = K.contains_pairs(asked.select(F.col("term").alias("key"), F.col("term").alias("text")), lows.select(F.col("low").alias("needle"))).select(F.col("needle").alias("low"), F.col("key").alias("term"))
    met = holds.unionByName(stands).distinct().join(t, "term").select("case", "low").distinct()
    return of.join(met, ["case", "low"]).groupBy("case", "disease").agg(F.array_sort(F.collect_set("name")).alias("support"))


def diagnosis_literature(kg: KnowledgeGraph, docs: DataFrame, diagnoses: DataFrame, *, top: int = 3, hits: int = 2, limit: int = 8) -> DataFrame:
    """Literature of a case's first ``top`` diagnoses (case, rank, disease, name, findings): (case, place, disease, pmid).

    First the best ``hits`` documents for each disease's name and the findings, then the publications that mention it; of rows with
    equal PMID a case's first stays, those without one all do; the first ``limit`` are kept."""
    d = checkpoint(diagnoses.filter(F.col("rank") <= top).withColumn("query", F.concat_ws("#", "case", F.col("rank").cast("string"))))
    found = K.R.bm25(docs.select("doc", "text"), d.select("query", F.concat_ws(" ", "name", "findings").alias("text")), top=hits).withColumnRenamed("rank", "hit")
    a = found.join(d, "query").join(docs.select("doc", "pmid"), "doc").select("case", "disease", "pmid", F.struct(F.lit(0).alias("kind"), "rank", "hit", F.lit("").alias("id")).alias("o"))
    linked = kg.of_type("publication_mentions_disease").select(F.col("target_id").alias("disease"), F.col("source_id").alias("id")).join(kg.nodes.select("id", "pmid"), "id")
    b = d.join(linked, "disease").select("case", "disease", "pmid", F.struct(F.lit(1).alias("kind"), "rank", F.lit(0).alias("hit"), "id").alias("o"))
    rows = a.unionByName(b)
    one = rows.filter("pmid is not null").groupBy("case", "pmid").agg(F.min(F.struct("o", "disease")).alias("x")).select("case", "x.disease", "pmid", "x.o").unionByName(rows.filter("pmid is null").select("case", "disease", "pmid", "o"))
    return one.withColumn("place", F.row_number().over(W.partitionBy("case").orderBy("o", "disease"))).filter(F.col("place") <= limit).select("case", "place", "disease", "pmid")


def diagnosis_citations(kg: KnowledgeGraph, diagnoses: DataFrame, evidence: DataFrame) -> DataFrame:
    """(case, pmids): sorted PMIDs of all publications that mention a case's diagnoses (case, disease), and of its evidence (case, pmid)."""
    linked = kg.of_type("publication_mentions_disease").select(F.col("target_id").alias("disease"), F.col("source_id").alias("id")).join(kg.nodes.filter("pmid is not null").select("id", "pmid"), "id")
    rows = diagnoses.select("case", "disease").distinct().join(linked, "disease").select("case", "pmid").unionByName(evidence.filter("pmid is not null").select("case", "pmid"))
    return rows.groupBy("case").agg(F.array_sort(F.collect_set("pmid")).alias("pmids"))


def clinician_reports(diagnoses: DataFrame, citations: DataFrame, support: DataFrame) -> DataFrame:
    """Cases by their diagnoses (case, rank, disease, name, score): (case, diagnoses, citations, confidence, summary)."""
    d = diagnoses.join(support, ["case", "disease"], "left")
    line = F.concat(F.lit("- "), F.coalesce("name", "disease"), F.format_string(": score=%.3f; kg support=", F.col("score")), F.when(F.size("support") > 0, F.array_join("support", ", ")).otherwise("none"), F.lit("."))
    c = d.groupBy("case").agg(F.count(F.lit(1)).alias("diagnoses"), F.max("score").alias("best"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    c = c.join(citations, "case", "left").withColumn("pmids", F.coalesce("pmids", F.array().cast("array<string>")))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.col("best") + F.least(F.size("pmids"), F.lit(5)) / 25.0))
    return c.select("case", "diagnoses", F.col("pmids").alias("citations"), confidence.alias("confidence"), F.concat(F.lit("Differential diagnosis for: "), "case", F.lit("\n"), "lines").alias("summary"))


def hypothesis_reports(kg: KnowledgeGraph, candidates: DataFrame, *, top: int = 10) -> DataFrame:
    """Indirect links (src, dst, path, link) as ranked hypotheses: (src, rank, dst, score, pmids, statement).

    score is 0.7 of the link score and 0.3 of the publications that mention both ends, of three."""
    pairs = candidates.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"))
    papers = literature_bridge(kg, pairs).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "pmids")
    c = candidates.join(papers, ["src", "dst"], "left").withColumn("pmids", F.coalesce("pmids", F.array().cast("array<string>")))
    c = c.withColumn("score", 0.7 * F.col("link") + 0.3 * F.least(F.size("pmids"), F.lit(3)) / 3.0)
    c = checkpoint(c.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy(F.round("score", 9).desc(), "dst"))).filter(F.col("rank") <= top))
    label = kg.nodes.select("id", F.coalesce("name", "id").alias("label"))
    steps = c.select("src", "dst", F.posexplode("path").alias("pos", "id")).join(label, "id", "left").select("src", "dst", F.struct("pos", F.coalesce("label", "id").alias("name")).alias("x"))
    chain = steps.groupBy("src", "dst").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]).alias("chain"))
    c = c.join(chain, ["src", "dst"], "left")
    said = F.concat(F.element_at("chain", 1), F.lit(" may participate in a novel relationship with "), F.element_at("chain", -1), F.format_string(" (score=%.3f)", F.col("link")), F.lit(" via the indirect chain "), F.array_join("chain", " -> "), F.lit("."))
    return c.select("src", "rank", "dst", "score", "pmids", said.alias("statement"))


# --- requests ------------------------------------------------------------------------------------------------------------

_BY_TYPE = {"Gene": "geneticist", "Drug": "pharmacologist", "Disease": "literature", "Pathway": "pathway_analyst"}


def route(kg: KnowledgeGraph, questions: DataFrame) -> DataFrame:
    """Kinds of requests (query, text): (query, task, tasks).

    ``task`` is the kind by keywords, else by the type of the first node the text names, else router; a gene in a text with 'drug' and
    'target' asks for the graph explorer.  ``tasks`` are all kinds in question: router first, then every kind named, if there are several steps, else the one."""
    q = checkpoint(questions.select("query", "text").filter("text is not null"))
    names = kg.nodes.filter(F.col("node_type").isNotNull()).select("id", "name", F.col("node_type").alias("kind"))
    first = C.mentions(q.select(F.col("query").alias("doc"), "text"), names, limit=3).filter("rank = 1").join(names.select("id", "kind"), "id").select(F.col("doc").alias("query"), "kind")
    low = F.lower("text")
    by_type = F.try_element_at(F.create_map(*[F.lit(x) for kv in _BY_TYPE.items() for x in kv]), F.col("kind"))
    hint = F.when((F.col("kind") == "Gene") & low.contains("drug") & low.contains("target"), "graph_explorer").otherwise(by_type)
    weights = X.task_weights(F.col("text"))
    j = q.join(first, "query", "left").select("query", "text", hint.alias("hint"), X.classify_task(F.col("text")).alias("word"), X.has_any(low, X.COMPLEX).alias("steps"), F.transform(F.filter(weights, lambda w: w["weight"] > 0), lambda w: w["task"]).alias("named"))
    task = F.coalesce("word", "hint", F.lit("router"))
    tasks = F.when(F.col("steps") & (F.size("named") > 0), F.array_distinct(F.concat(F.array(F.lit("router")), "named"))).when(F.size("named") > 0, F.slice("named", 1, 1)).otherwise(F.array(task))
    return j.select("query", task.alias("task"), tasks.alias("tasks"))


def decompose(kg: KnowledgeGraph, questions: DataFrame) -> DataFrame:
    """Requests (query, text) as tasks: (query, pos, task, clause, priority, nodes), the first clause of each kind and wording.

    A clause's kind is that of :func:`route`, literature where that can't tell; ``nodes`` are up to four nodes it names, in order."""
    c = questions.filter("text is not null").select("query", F.posexplode(X.split_clauses(F.col("text"))).alias("pos", "clause"))
    c = checkpoint(c.withColumn("key", F.concat_ws("#", F.col("query").cast("string"), F.col("pos").cast("string"))))
    kinds = route(kg, c.select(F.col("key").alias("query"), F.col("clause").alias("text"))).select(F.col("query").alias("key"), F.when(F.col("task") == "router", "literature").otherwise(F.col("task")).alias("task"))
    named = C.mentions(c.select(F.col("key").alias("doc"), F.col("clause").alias("text")), kg.nodes.select("id", "name", F.col("node_type").alias("kind")), limit=4)
    named = named.groupBy(F.col("doc").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("nodes"))
    t = c.join(kinds, "key").join(named, "key", "left").withColumn("nodes", F.coalesce("nodes", F.array().cast("array<string>")))
    once = t.groupBy("query", "task", F.lower("clause").alias("_low")).agg(F.min(F.struct("pos", "clause", "nodes")).alias("x"))
    return once.select("query", "x.pos", "task", "x.clause", X.task_priority(F.col("task")).alias("priority"), "x.nodes")


Specialist = Callable[[DataFrame], DataFrame]


def run_workflow(kg: KnowledgeGraph, docs: DataFrame, questions: DataFrame, specialists: dict[str, Specialist], *, title: str = "Response") -> DataFrame:
    """Requests (query, text) answered by specialists: (query, tasks, claims, supported, confidence, citations, response).

    Each kind of task goes to its specialist, a function of tasks (key, clause, nodes) to results (key, summary, pmids); kinds without one
    go to 'literature'.  The results' sentences are verified, and all is put together as Markdown: a section a task in the order of its
    clauses, the verification with its issues, and the citations."""
    tasks = checkpoint(decompose(kg, questions).withColumn("key", F.concat_ws("#", F.col("query").cast("string"), F.col("pos").cast("string"), "task")))
    results = None
    listed = [k for k in specialists if k != "literature"]
    for kind, run in specialists.items():
        mine = tasks.filter(~F.col("task").isin(listed)) if kind == "literature" else tasks.filter(F.col("task") == kind)
        part = run(mine.select("key", "clause", "nodes")).select("key", "summary", "pmids")
        results = part if results is None else results.unionByName(part)
    if results is None:
        raise ValueError("no specialists")
    r = checkpoint(tasks.join(results, "key"))
    claims = r.select("query", "key", F.posexplode(X.sentences(F.col("summary"))).alias("n", "text"))
    claims = checkpoint(claims.withColumn("claim", F.concat_ws("#", "key", F.col("n").cast("string"))))
    checked = K.verify(kg, docs, claims.select(F.col("claim").alias("query"), "text")).withColumnRenamed("query", "claim").join(claims.select("claim", "query"), "claim")
    v = K.verification(checked, "query")
    heading = F.concat(F.lit("## "), F.initcap(F.replace("task", F.lit("_"), F.lit(" "))), F.lit("\n"), "summary")
    body = r.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "task", heading.alias("section")))), lambda x: x["section"]).alias("sections"), F.count(F.lit(1)).alias("tasks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pmids")))).alias("citations"))
    j = questions.select("query", "text").join(body, "query").join(v, "query", "left")
    issues = F.when(F.size("issues") > 0, F.array_join(F.transform("issues", lambda i: F.concat(F.lit("- "), i)), "\n")).otherwise("- No major issues detected.")
    cited = F.when(F.size("citations") > 0, F.concat(F.lit("## Citations\n"), F.array_join("citations", ", ")))
    response = F.concat_ws("\n\n", F.concat(F.lit(f"# {title}\n\nQuery: "), "text"), F.array_join("sections", "\n\n"), F.concat(F.lit("## Verification\n"), F.coalesce("summary", F.lit("Nothing to verify.")), F.lit("\n"), issues), cited)
    return j.select("query", "tasks", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("supported", F.lit(0)).alias("supported"), F.coalesce("confidence", F.lit(0.6)).alias("confidence"), "citations", response.alias("response"))


def default_specialists(kg: KnowledgeGraph, docs: DataFrame, articles: DataFrame, ranking: DataFrame, listed: DataFrame) -> dict[str, Specialist]:
    """Specialists for literature, graph explorer, geneticist, pharmacologist and pathway analyst, for :func:`run_workflow`."""
    none = F.array().cast("array<string>")

    def literature(t: DataFrame) -> DataFrame:
        a = K.answer(kg, docs, articles, t.select(F.col("key").alias("query"), F.col("clause").alias("text")))
        return a.select(F.col("query").alias("key"), F.col("answer").alias("summary"), "pmids")

    def explorer(t: DataFrame) -> DataFrame:
        return explore(kg, t.select(F.col("key").alias("query"), F.col("clause").alias("text"))).select(F.col("query").alias("key"), "summary", none.alias("pmids"))

    def about(t: DataFrame, reports: DataFrame, unknown: str, pmids: Column) -> DataFrame:
        """The report of the first node each clause names that has one."""
        named = t.select("key", F.posexplode("nodes").alias("n", "id")).join(reports, "id").groupBy("key").agg(F.min_by(F.struct("summary", pmids.alias("pmids")), "n").alias("r"))
        j = t.join(named, "key", "left")
        return j.select("key", F.coalesce("r.summary", F.concat(F.lit(unknown), "clause")).alias("summary"), F.coalesce("r.pmids", none).alias("pmids"))

    def genes(t: DataFrame) -> DataFrame:
        ids = t.select(F.explode("nodes").alias("id")).distinct()
        return about(t, gene_reports(kg, ids, ranking), "Could not resolve gene: ", F.array_compact("papers"))

    def drugs(t: DataFrame) -> DataFrame:
        return about(t, drug_reports(kg, listed), "Could not resolve drug: ", none)

    def pathways(t: DataFrame) -> DataFrame:
        g = t.select(F.col("key").alias("query"), F.explode("nodes").alias("gene")).join(kg.nodes.filter("node_type = 'Gene'").select(F.col("id").alias("gene")), "gene", "left_semi")
        p = pathway_analysis(kg, g)
        said = lambda c: F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, 5), ", ")).otherwise("none")
        s = p.select(F.col("query").alias("key"), F.concat(F.lit("Top enriched pathways: "), said("pathways"), F.lit("\nTop disease enrichments: "), said("diseases")).alias("summary"))
        return t.join(s, "key", "left").select("key", F.coalesce("summary", F.lit("Top enriched pathways: none\nTop disease enrichments: none")).alias("summary"), none.alias("pmids"))

    return {"literature": literature, "graph_explorer": explorer, "geneticist": genes, "pharmacologist": drugs, "pathway_analyst": pathways}
