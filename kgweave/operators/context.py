"""Graph context of questions, and documents retrieved, verified and cited with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import adjacency as N
from . import retrieval as R
from .analytics import tokens
from .containment import contains_pairs
from .graph import KnowledgeGraph
from .runtime import checkpoint

HEADER = "Relevant knowledge graph context:"


def match_nodes(kg: KnowledgeGraph, candidates: DataFrame, *, limit: int = 3) -> DataFrame:
    """Nodes that candidates (query, pos, candidate) name: (query, pos, rank, id, name), up to ``limit`` each.

    Nodes of exactly that name or id, any case; if there are none and the candidate is one word, nodes that hold it in id,
    name or properties.  Equal names come first, then by name and id."""
    key = lambda c: F.lower(X.strip(F.col(c)))
    c = checkpoint(candidates.select("query", "pos", key("candidate").alias("q")).filter("q <> ''").distinct())
    nodes = checkpoint(kg.nodes.select("id", "name", F.lower(F.concat_ws(" ", "id", "name", F.to_json("properties"))).alias("text")))
    by_key = nodes.select("id", "name", F.explode(F.array_distinct(F.array(key("id"), F.coalesce(key("name"), key("id"))))).alias("q"))
    exact = checkpoint(c.select("q").distinct().join(by_key, "q"))
    words = c.filter(~F.col("q").contains(" ")).select("q").distinct().join(exact.select("q").distinct(), "q", "left_anti")
    loose = contains_pairs(nodes.select(F.col("id").alias("key"), "text"), words.select(F.col("q").alias("needle"))).select(F.col("needle").alias("q"), F.col("key").alias("id")).join(nodes.select("id", "name"), "id").select("q", "id", "name")
    order = W.partitionBy("q").orderBy((F.lower("name") != F.col("q")).asc_nulls_last(), F.lower("name").asc_nulls_last(), "id")
    best = exact.select("q", "id", "name").unionByName(loose).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return c.join(best, "q").select("query", "pos", "rank", "id", "name")


def expand(kg: KnowledgeGraph, matched: DataFrame, *, depth: int = 2, shared_edges: int = N.LIMIT) -> DataFrame:
    """Nodes within ``depth`` undirected steps of a query's matched nodes (query, id): (query, id), each once."""
    shared = N.shared_graph(kg, limit=shared_edges)
    if shared is not None:
        return N.around(matched.select(F.col("query").alias("key"), "id"), shared, radius=depth).select(F.col("key").alias("query"), "id")
    around = kg.hops(matched.select("id").distinct(), radius=depth, shared_edges=shared_edges).select(F.col("seed").alias("s"), "id")
    return matched.select("query", F.col("id").alias("s")).distinct().join(around, "s").select("query", "id").distinct()


def best_triples(kg: KnowledgeGraph, included: DataFrame, *, limit: int = 50) -> DataFrame:
    """The best edges among each query's nodes (query, id) as text: (query, rank, triple, score), by score, then by the edge."""
    e = kg.edges.select("source_id", "target_id", "edge_type", "score")
    inside = included.withColumnRenamed("id", "source_id").join(e, "source_id").join(included.withColumnRenamed("id", "target_id"), ["query", "target_id"], "left_semi")
    names = kg.nodes.select("id", F.coalesce("name", "id").alias("name"))
    t = inside.join(names.withColumnsRenamed({"id": "source_id", "name": "s"}), "source_id").join(names.withColumnsRenamed({"id": "target_id", "name": "t"}), "target_id")
    order = W.partitionBy("query").orderBy(F.desc("score"), "source_id", "target_id", "edge_type")
    return t.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query", "rank", F.concat_ws(" ", "s", "edge_type", "t").alias("triple"), "score")


def graph_context(kg: KnowledgeGraph, queries: DataFrame, *, limit: int = 50, depth: int = 2, shared_edges: int = N.LIMIT) -> DataFrame:
    """Context of each query (query, text): (query, entities, triples, size, context).

    Names in the text are matched to nodes, their neighbourhood's best triples are listed.  ``size`` is the number of nodes in the
    neighbourhood; without triples the context is empty; queries that name no node have no row."""
    matched = match_nodes(kg, R.entity_candidates(queries))
    seeds = checkpoint(matched.groupBy("query", "id").agg(F.min(F.struct("pos", "rank", "name")).alias("m")))
    shared = N.shared_graph(kg, limit=shared_edges, described=True)
    if shared is not None:
        around = N.best_edges(seeds.select(F.col("query").alias("key"), "id"), shared, radius=depth, limit=limit).withColumnRenamed("key", "query")
    else:
        included = checkpoint(expand(kg, seeds, depth=depth, shared_edges=shared_edges))
        size = included.groupBy("query").agg(F.count(F.lit(1)).alias("size"))
        triples = best_triples(kg, included, limit=limit).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "triple"))), lambda x: x["triple"]).alias("triples"))
        around = size.join(triples, "query", "left").withColumn("triples", F.coalesce("triples", F.array().cast("array<string>")))
    named = seeds.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("m.pos", "m.rank", "id", F.coalesce("m.name", "id").alias("name")))), lambda x: x["name"]).alias("entities"))
    out = named.join(around, "query")
    lines = F.concat(F.array(F.lit(HEADER), F.concat(F.lit("Matched entities: "), F.array_join("entities", ", "), F.lit("."))), F.transform("triples", lambda t: F.concat(F.lit("- "), t)))
    return out.withColumn("context", F.when(F.size("triples") > 0, F.array_join(lines, "\n")).otherwise(""))


def as_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits (…, doc) with what they show: title (else name, else the id), text, source (else pubmed), pmid."""
    have = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    filled = lambda c: F.when(have(c) != "", have(c))
    d = docs.select("doc", F.coalesce(filled("title"), filled("name"), F.col("doc").cast("string")).alias("title"), "text", F.coalesce(filled("source"), F.lit("pubmed")).alias("source"), have("pmid").alias("pmid"))
    return hits.join(d, "doc")


def retrieve(docs: DataFrame, queries: DataFrame, *, top: int = 10, kg: KnowledgeGraph | None = None, context: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Hybrid retrieval: (query, rank, doc, score, title, text, source, pmid, context).

    ``docs``: (doc, text, [title, name, source, pmid, vector]); ``queries``: (query, text, [vector]); ``vectors``: (doc, vector), if the documents'
    vectors are in a table of their own.  The best 3 * top by BM25 and by vectors (by BM25 again where there are none) are fused by rank,
    reranked with the query's graph context, and cut to ``top``.  A query with a context but no document gets the context itself as its only row, score 1."""
    if context is None and kg is not None:
        context = checkpoint(graph_context(kg, queries).select("query", "context"))
    lexical = checkpoint(R.bm25(docs.select("doc", "text"), queries.select("query", "text"), top=3 * top))
    dense = lexical
    if vectors is not None:
        vectors = vectors.select("doc", "vector").join(docs.select("doc"), "doc", "left_semi")
    elif "vector" in docs.columns:
        vectors = docs.select("doc", "vector")
    if vectors is not None and "vector" in queries.columns:
        dense = R.dense(vectors, queries.select("query", "vector").filter("vector is not null"), top=3 * top)
    asked = queries.select("query", F.col("text").alias("query_text"))
    asked = asked.join(context, "query", "left") if context is not None else asked.withColumn("context", F.lit(None).cast("string"))
    # Of a context only the question's own words count; the whole is long and would go along with every document.
    own = F.array_join(F.array_intersect(tokens(F.col("query_text")), tokens(F.coalesce("context", F.lit("")))), " ")
    # Documents come last: their texts are shuffled once, and after that only with the best, if they are asked for.
    fused = checkpoint(R.fuse(lexical, dense).filter("doc is not null"))
    best = R.rerank(as_documents(fused.join(asked.withColumn("context", own), "query"), docs), top=top, keep=("title", "text", "source", "pmid"))
    best = best.join(context, "query", "left") if context is not None else best.withColumn("context", F.lit(None).cast("string"))
    best = best.withColumn("context", F.coalesce("context", F.lit("")))
    columns = ["query", "rank", "doc", "score", "title", "text", "source", "pmid", "context"]
    if context is None:
        return best.select(*columns)
    alone = context.filter("context <> ''").join(fused.select("query").distinct(), "query", "left_anti")
    none = lambda t: F.lit(None).cast(t)
    alone = alone.select("query", F.lit(1).alias("rank"), none(docs.schema["doc"].dataType).alias("doc"), F.lit(1.0).alias("score"), F.lit("Knowledge graph context").alias("title"), F.col("context").alias("text"), F.lit("kg_context").alias("source"), none("string").alias("pmid"), "context")
    return best.select(*columns).unionByName(alone)


def literature_supported(docs: DataFrame, claims: DataFrame, *, shared: int = 2) -> DataFrame:
    """Claims (query, text) whose best document shares ``shared`` distinct words or more with them: (query, doc)."""
    best = R.bm25(docs.select("doc", "text"), claims, top=1).join(docs.select("doc", F.col("text").alias("found")), "doc").join(claims, "query")
    words = F.size(F.array_intersect(F.array_distinct(tokens(F.col("text"))), F.array_distinct(tokens(F.coalesce("found", F.lit(""))))))
    return best.filter(words >= shared).select("query", "doc")


def substring_entities(kg: KnowledgeGraph, texts: DataFrame, *, limit: int = 2, node_types: list[str] | None = None) -> DataFrame:
    """Nodes whose name stands anywhere in a text (query, text), any case: (query, rank, id, node_type), the first ``limit`` by id."""
    nodes = kg.nodes.filter(F.length("name") > 0)
    nodes = nodes if node_types is None else nodes.filter(F.col("node_type").isin(node_types))
    nodes = nodes.select("id", "node_type", F.lower("name").alias("needle"))
    # Of nodes of one name only the first can be among the first of a text, whatever else stands there.
    nodes = checkpoint(nodes.withColumn("r", F.row_number().over(W.partitionBy("needle").orderBy("id"))).filter(F.col("r") <= limit).drop("r"))
    t = checkpoint(texts.select(F.col("query").alias("key"), F.lower("text").alias("text")))
    hits = contains_pairs(t, nodes.select("needle")).join(nodes, "needle").select(F.col("key").alias("query"), "id", "node_type").distinct()
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("id"))).filter(F.col("rank") <= limit).select("query", "rank", "id", "node_type")


def verify(kg: KnowledgeGraph, docs: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims (query, text) checked: (query, supported, issue).

    With two entities or more an edge between the first two, either way, supports a claim, else its literature does; with fewer only
    literature does, and without it the claim is no issue if it carries a mark in square brackets."""
    claims = checkpoint(claims.select("query", "text").filter("text is not null"))
    ents = substring_entities(kg, claims).groupBy("query").agg(F.min("id").alias("u"), F.max("id").alias("v"), F.count(F.lit(1)).alias("n"))
    ents = checkpoint(ents)
    # Only edges between entities of a claim are grouped.
    asked = ents.filter("n = 2").select("u", "v").distinct()
    pairs = kg.edges.select(F.least("source_id", "target_id").alias("u"), F.greatest("source_id", "target_id").alias("v")).join(asked, ["u", "v"], "left_semi").distinct().withColumn("linked", F.lit(True))
    checked = claims.join(ents, "query", "left").join(pairs, ["u", "v"], "left").join(literature_supported(docs, claims).select("query", F.lit(True).alias("cited")), "query", "left")
    two, linked, cited = F.coalesce(F.col("n") == 2, F.lit(False)), F.coalesce("linked", F.lit(False)), F.coalesce("cited", F.lit(False))
    supported = (two & linked) | cited
    issue = F.when(supported, None).when(two, F.concat(F.lit("No direct KG evidence for claim: "), "text")).when(~F.col("text").rlike(r"\[[^\]]+\]"), F.concat(F.lit("Insufficiently grounded claim: "), "text"))
    return checked.select("query", supported.alias("supported"), issue.alias("issue"))


def verification(checked: DataFrame, by: str) -> DataFrame:
    """Checked claims (by, supported, issue) summed up: (by, claims, supported, issues, confidence, summary); equal issues count once."""
    s = checked.groupBy(by).agg(F.count(F.lit(1)).alias("claims"), F.count_if("supported").alias("supported"), F.array_sort(F.collect_set("issue")).alias("issues"))
    s = s.withColumn("confidence", X.verification_confidence(F.col("claims"), F.col("supported"), F.size("issues")))
    return s.withColumn("summary", F.format_string("Sentinel confidence: %.2f. Checked %d claims and found %d issues.", "confidence", "claims", F.size("issues")))


def references(documents: DataFrame, articles: DataFrame) -> DataFrame:
    """The articles that retrieved documents (query, rank, pmid, title, text) refer to: (query, rank, pmid, title, authors, year, known), each pmid once.

    An article in the index (pmid, title, authors, year) is taken from there, another is rebuilt from the document itself."""
    first = documents.filter("pmid is not null").groupBy("query", "pmid").agg(F.min(F.struct("rank", "title")).alias("d"))
    known = articles.filter("pmid is not null").groupBy("pmid").agg(F.min_by(F.struct("title", "authors", "year"), "article_id").alias("a"))
    j = first.join(known, "pmid", "left")
    return j.select("query", "d.rank", "pmid", F.when(F.col("a").isNotNull(), F.col("a.title")).otherwise(F.col("d.title")).alias("title"), "a.authors", "a.year", F.col("a").isNotNull().alias("known"))


def extractive_line(title: Column, text: Column, pmid: Column) -> Column:
    """'- title: first sentence [PMID:x]', without the citation where there is no PMID."""
    return F.concat(F.lit("- "), title, F.lit(": "), X.first_sentence(text), F.coalesce(F.concat(F.lit(" [PMID:"), pmid, F.lit("]")), F.lit("")))


def extractive_answers(queries: DataFrame, documents: DataFrame, *, top: int = 3) -> DataFrame:
    """Answers made of the first sentences of a query's first documents (query, rank, title, text, pmid): (query, answer, pmids, documents)."""
    line = extractive_line(F.col("title"), F.coalesce("text", F.lit("")), F.col("pmid"))
    d = documents.groupBy("query").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", line.alias("line"))))), lambda x: x["line"]).alias("lines"),
        F.array_sort(F.collect_set(F.when(F.col("rank") <= top, F.col("pmid")))).alias("pmids"),
        F.count(F.lit(1)).alias("documents"),
    )
    j = queries.select("query", F.col("text").alias("asked")).join(d, "query", "left")
    some = F.concat_ws("\n", F.concat(F.lit("Evidence-grounded summary for: "), "asked"), F.array_join("lines", "\n"))
    none = F.concat(F.lit("I do not know based on the available abstracts for: "), "asked")
    return j.select("query", F.when(F.col("documents") > 0, some).otherwise(none).alias("answer"), F.coalesce("pmids", F.array().cast("array<string>")).alias("pmids"), F.coalesce("documents", F.lit(0)).alias("documents"))


def answer(kg: KnowledgeGraph | None, docs: DataFrame, articles: DataFrame, queries: DataFrame, *, top: int = 10, keep: int = 5, drafts: DataFrame | None = None) -> DataFrame:
    """Questions (query, text) answered from the literature: (query, answer, pmids, references, invalid, confidence).

    Documents are retrieved with graph context, the ``keep`` best make the answer.  A draft (query, draft) takes the extractive answer's
    place unless it cites nothing or a PMID that wasn't retrieved."""
    # Contexts are long and stand in every row: they stay behind.
    found = checkpoint(retrieve(docs, queries, top=top, kg=kg).filter(F.col("rank") <= keep).select("query", "rank", "title", "text", "pmid"))
    refs = references(found, articles).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pmid"))), lambda x: x["pmid"]).alias("references"))
    out = extractive_answers(queries, found).join(refs, "query", "left").withColumn("references", F.coalesce("references", F.array().cast("array<string>")))
    if drafts is not None:
        good = (F.size(X.cited_pmids(F.col("draft"))) > 0) & (F.size(X.invalid_citations(F.col("draft"), F.col("references"))) == 0)
        out = out.join(drafts, "query", "left").withColumn("answer", F.when(good, F.col("draft")).otherwise(F.col("answer"))).drop("draft")
    invalid = F.size(X.invalid_citations(F.col("answer"), F.col("references")))
    return out.select("query", "answer", F.array_sort(X.cited_pmids(F.col("answer"))).alias("pmids"), "references", invalid.alias("invalid"), X.literature_confidence(F.col("documents"), invalid, keep).alias("confidence"))


SECTIONS = {  # Fixed values: headings and questions of a review.
    "Background": "What is the current biomedical background for {}?",
    "Molecular Mechanisms": "What molecular mechanisms are implicated in {}?",
    "Clinical Evidence": "What clinical evidence exists for {}?",
    "Research Gaps": "What unanswered questions remain for {}?",
}


def review_sections(topics: DataFrame, *, sections: int = 3) -> DataFrame:
    """Sections of a review of each topic (query, topic): (topic_id, pos, heading, question, query, text), the last two to retrieve by."""
    each = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(h).alias("heading"), F.replace(F.lit(q), F.lit("{}"), F.col("topic")).alias("question")) for i, (h, q) in enumerate(list(SECTIONS.items())[:sections])])
    s = topics.select(F.col("query").alias("topic_id"), "topic", F.explode(each).alias("s")).select("topic_id", "topic", "s.*")
    return s.withColumns({"query": F.concat_ws("#", F.col("topic_id").cast("string"), F.col("pos").cast("string")), "text": F.concat_ws(" ", "topic", "heading", "question")})


def review(kg: KnowledgeGraph | None, docs: DataFrame, topics: DataFrame, *, sections: int = 3, retrieved: int = 6, cited: int = 4) -> DataFrame:
    """A review of each topic (query, topic) put together from the documents found for its sections: (query, review, pmids, score, confidence).

    Each section opens with its heading and question, then the first sentences of its first three documents with their PMIDs; where
    nothing is found it says so.  ``score`` is the mean critique of the sections."""
    s = checkpoint(review_sections(topics, sections=sections))
    found = retrieve(docs, s.select("query", "text"), top=retrieved, kg=kg).filter(F.col("rank") <= min(cited, 3))
    line = F.concat(F.lit("- "), X.first_sentence(F.coalesce("text", F.lit(""))), F.coalesce(F.concat(F.lit(" [PMID:"), "pmid", F.lit("]")), F.lit("")))
    lines = found.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    some = F.concat_ws("\n", F.concat("heading", F.lit(".")), F.concat(F.lit("This section addresses: "), "question"), F.array_join("lines", "\n"))
    none = F.concat("heading", F.lit(".\nInsufficient evidence was retrieved to answer: "), "question")
    drafted = s.join(lines, "query", "left").withColumn("content", F.when(F.size("lines") > 0, some).otherwise(none)).withColumn("score", X.critique(F.col("content")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "heading", "content"))), lambda x: F.concat(F.lit("## "), x["heading"], F.lit("\n\n"), x["content"]))
    heads = F.transform(F.array_sort(F.collect_list(F.struct("pos", "heading"))), lambda x: x["heading"])
    r = drafted.groupBy(F.col("topic_id").alias("query"), "topic").agg(parts.alias("parts"), heads.alias("heads"), F.avg("score").alias("score"))
    abstract = F.concat(F.lit("This rapid narrative review summarizes local evidence for "), "topic", F.lit(". It covers "), F.array_join("heads", ", "), F.lit("."))
    whole = F.concat_ws("\n\n", F.concat(F.lit("# Narrative Review of "), "topic"), F.lit("## Abstract"), abstract, F.array_join("parts", "\n\n"))
    out = r.select("query", whole.alias("review"), "score")
    confidence = F.least(F.lit(0.95), 0.3 + F.least(F.col("score") / 10, F.lit(1.0)) * 0.6)
    return out.select("query", "review", X.cited_pmids(F.col("review")).alias("pmids"), "score", confidence.alias("confidence"))


def section_drafts(sections: DataFrame, found: DataFrame, *, rounds: int = 3, each: int = 3) -> DataFrame:
    """Drafts of sections (query, heading, question) from documents (query, rank, text, pmid): (query, round, content).

    A draft rests on ``each`` documents more than the one before; a section for which nothing was found says so."""
    line = F.concat(F.lit("- "), X.first_sentence(F.coalesce("text", F.lit(""))), F.coalesce(F.concat(F.lit(" [PMID:"), "pmid", F.lit("]")), F.lit("")))
    numbers = F.explode(F.array(*[F.lit(n) for n in range(1, rounds + 1)])).alias("round")
    # A struct built beside a generator loses the names of its fields, so lines come first.
    lines = found.select("query", "rank", line.alias("line")).select("query", "rank", "line", numbers).filter(F.col("rank") <= F.col("round") * each)
    lines = lines.groupBy("query", "round").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("lines"))
    some = F.concat_ws("\n", F.concat("heading", F.lit(".")), F.concat(F.lit("This section addresses: "), "question"), F.array_join("lines", "\n"))
    none = F.concat("heading", F.lit(".\nInsufficient evidence was retrieved to answer: "), "question")
    drafts = sections.select("query", "heading", "question", numbers).join(lines, ["query", "round"], "left")
    return drafts.select("query", "round", F.when(F.size("lines") > 0, some).otherwise(none).alias("content"))


def revise(drafts: DataFrame, *, rounds: int = 3, enough: float = 7.0) -> DataFrame:
    """The draft kept of a section's drafts (query, round, content): (query, round, content, score): the first that scores ``enough``, else the last of ``rounds``."""
    d = drafts.filter(F.col("round") <= rounds).withColumn("score", X.critique(F.col("content")))
    good = F.min(F.when(F.col("score") >= enough, F.struct("round", "content", "score")))
    return d.groupBy("query").agg(F.coalesce(good, F.max(F.struct("round", "content", "score"))).alias("d")).select("query", "d.round", "d.content", "d.score")
