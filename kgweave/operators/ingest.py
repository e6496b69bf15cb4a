"""Building, storing and reloading a graph, a corpus and its vectors from several sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import DEFAULT_EDGE_TYPE, DEFAULT_NODE_TYPE, EDGE_TYPES, NODE_TYPES, checked
from .analytics import tokens
from .graph import EDGE_KEY, KnowledgeGraph, merge_edges, merge_nodes
from .runtime import checkpoint

NODE = ["id", "name", "node_type", "properties", "sources"]
EDGE = [*EDGE_KEY, "score", "properties", "sources"]
_NO_PROPERTIES = "map<string,string>"


def entity_id(prefix: str, c: Column) -> Column:
    """'prefix:id' in lower case."""
    return F.concat(F.lit(prefix + ":"), F.lower(c))


def _nodes(rows: DataFrame, prefix: str, key: str, name: str, node_type: str, *sources: str) -> DataFrame:
    """One node for each key."""
    one = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(name).alias("_n")).groupBy("_k").agg(F.min("_n").alias("name"))
    return one.select(entity_id(prefix, F.col("_k")).alias("id"), "name", F.lit(node_type).alias("node_type"), F.lit(None).cast(_NO_PROPERTIES).alias("properties"), F.array(*map(F.lit, sources)).cast("array<string>").alias("sources"))


def _edges(rows: DataFrame, source: Column, target: Column, edge_type: str, score: Column, by: str, properties: Column | None = None) -> DataFrame:
    props = F.lit(None).cast(_NO_PROPERTIES) if properties is None else properties
    return rows.select(source.alias("source_id"), target.alias("target_id"), F.lit(edge_type).alias("edge_type"), score.alias("score"), props.alias("properties"), F.array(F.lit(by)).alias("sources")).dropna(subset=["source_id", "target_id"])


def best_per(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def ingest_associations(genes: DataFrame, associations: DataFrame, treatments: DataFrame, *, diseases: int = 5, drugs: int = 3, source: str = "open_targets") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of genes' best diseases and those diseases' first drugs.

    ``genes``: (gene); ``associations``: (gene, disease_id, disease_name, score), of which each gene's best ``diseases`` by score,
    then id, are taken; ``treatments``: (disease_id, drug_id, drug_name, status, mechanism), of which each disease's first ``drugs`` by
    phase, highest first, then id.  Treatments score 0.8.  Scores that are null or NaN don't count."""
    scored = associations.filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("disease_id").isNotNull()).join(genes.select("gene").distinct(), "gene", "left_semi")
    one = scored.groupBy("gene", "disease_id").agg(F.max("score").alias("score"), F.min("disease_name").alias("disease_name"))
    best = best_per(one, "gene", [F.desc("score"), F.col("disease_id")], diseases)
    known = treatments.filter(F.col("drug_id").isNotNull()).groupBy("disease_id", "drug_id").agg(F.max("phase").alias("phase"), F.min("drug_name").alias("drug_name"), F.min("status").alias("status"), F.min("mechanism").alias("mechanism"))
    given = best_per(known.join(best.select("disease_id").distinct(), "disease_id", "left_semi"), "disease_id", [F.desc_nulls_last("phase"), F.col("drug_id")], drugs)
    nodes = _nodes(genes, "gene", "gene", "gene", "Gene", "user_seed", source).unionByName(_nodes(best, "disease", "disease_id", "disease_name", "Disease", source)).unionByName(_nodes(given, "drug", "drug_id", "drug_name", "Drug", source))
    props = F.create_map(F.lit("status"), F.coalesce("status", F.lit("")), F.lit("mechanism"), F.coalesce("mechanism", F.lit("")))
    edges = _edges(best, entity_id("gene", F.col("gene")), entity_id("disease", F.col("disease_id")), "gene_associated_with_disease", F.col("score"), source)
    return nodes, edges.unionByName(_edges(given, entity_id("drug", F.col("drug_id")), entity_id("disease", F.col("disease_id")), "drug_treats_disease", F.lit(0.8), source, props))


def ingest_interactions(rows: DataFrame, *, source: str = "string_db") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of interactions (protein_a, protein_b, score): gene to gene by preferred name."""
    ends = rows.select(F.explode(F.array("protein_a", "protein_b")).alias("gene"))
    return _nodes(ends, "gene", "gene", "gene", "Gene"), _edges(rows, entity_id("gene", F.col("protein_a")), entity_id("gene", F.col("protein_b")), "gene_interacts_with_gene", F.col("score"), source)


def ingest_articles(genes: DataFrame, articles: DataFrame, *, top: int = 3, source: str = "pubmed") -> tuple[DataFrame, DataFrame]:
    """Nodes of publications and their edges, score 0.6, to the genes they name; each gene's latest ``top`` by year, then pmid.

    ``genes``: (gene); ``articles``: (pmid, title, abstract, year).  An article names a gene if the symbol is one of its words, any case."""
    a = articles.filter("pmid is not null").groupBy("pmid").agg(F.max("title").alias("title"), F.max("abstract").alias("abstract"), F.max("year").alias("year"))
    words = a.select("pmid", "title", "year", F.explode(F.array_distinct(tokens(F.concat_ws(" ", "title", "abstract")))).alias("key"))
    hits = words.join(genes.select("gene", F.lower("gene").alias("key")).distinct(), "key")
    best = best_per(hits, "gene", [F.desc_nulls_last("year"), F.col("pmid")], top)
    named = best.withColumn("title", F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("pmid")))
    return _nodes(named, "publication", "pmid", "title", "Publication", source), _edges(best, entity_id("publication", F.col("pmid")), entity_id("gene", F.col("gene")), "publication_mentions_gene", F.lit(0.6), source)


def upsert(kg: KnowledgeGraph, nodes: DataFrame, edges: DataFrame) -> KnowledgeGraph:
    """The graph with nodes and edges merged in: newer names and properties over older, sources united, the greater score."""
    old_n, old_e = (df.select(*cols).withColumn("_seq", F.lit(0)) for df, cols in ((kg.nodes, NODE), (kg.edges, EDGE)))
    n = merge_nodes(old_n.unionByName(nodes.select(*NODE).withColumn("_seq", F.lit(1))), F.struct("_seq", F.hash("name"))).drop("_seq")
    return KnowledgeGraph(n, merge_edges(old_e.unionByName(edges.select(*EDGE).withColumn("_seq", F.lit(1))), F.col("_seq")))


def build(seeds: DataFrame, sources: dict[str, Callable[[], tuple[DataFrame, DataFrame]]], wanted: list[str]) -> tuple[KnowledgeGraph, list[tuple[str, str]]]:
    """A graph of seed genes (gene) and what the wanted sources give, and what became of each: (source, 'ok', 'failed' or 'skipped').

    Each source's rows are written to the checkpoint folder before they are merged, so one that fails leaves the others whole."""
    spark = seeds.sparkSession
    seed_nodes = _nodes(seeds, "gene", "gene", "gene", "Gene", "user_seed")
    kg = KnowledgeGraph(seed_nodes, spark.createDataFrame([], "source_id string, target_id string, edge_type string, score double, properties map<string,string>, sources array<string>"))
    log = []
    for name in wanted:
        if name not in sources:
            log.append((name, "skipped"))
            continue
        try:
            nodes, edges = (checkpoint(df) for df in sources[name]())
        except Exception:
            log.append((name, "failed"))
            continue
        kg = upsert(kg, nodes, edges)
        log.append((name, "ok"))
    return kg, log


def extracted_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of JSON texts (doc, payload): (doc, id, name, node_type, sources) and (doc, source_id, target_id, edge_type, score, sources).

    The JSON is found leniently.  Missing types are the defaults, a missing id is made of type and name, a missing name is the id,
    a missing score 1, missing sources 'llm_extraction'.  A type that isn't known is an error; a text without JSON gives no row."""
    entity = "array<struct<id:string,name:string,node_type:string,sources:array<string>>>"
    relation = "array<struct<source_id:string,target_id:string,edge_type:string,score:double,sources:array<string>>>"
    j = rows.select("doc", X.lenient_json(F.col("payload")).alias("j"))
    told = F.array(F.lit("llm_extraction"))
    e = j.select("doc", F.explode(F.try_variant_get("j", "$.entities", entity)).alias("x")).select("doc", "x.*")
    kind = checked(F.col("node_type"), NODE_TYPES, DEFAULT_NODE_TYPE)
    made = F.concat(F.lower(kind), F.lit(":"), F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("name", F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""))
    id = F.coalesce(F.when(F.col("id") != "", F.col("id")), made)
    entities = e.select("doc", id.alias("id"), F.coalesce("name", id).alias("name"), kind.alias("node_type"), F.coalesce("sources", told).alias("sources"))
    r = j.select("doc", F.explode(F.try_variant_get("j", "$.relations", relation)).alias("x")).select("doc", "x.*")
    relations = r.select("doc", F.coalesce("source_id", F.lit("")).alias("source_id"), F.coalesce("target_id", F.lit("")).alias("target_id"), checked(F.col("edge_type"), EDGE_TYPES, DEFAULT_EDGE_TYPE).alias("edge_type"), F.coalesce("score", F.lit(1.0)).alias("score"), F.coalesce("sources", told).alias("sources"))
    return entities, relations


def demo_graph(spark: SparkSession, genes: list[str], *, diseases: int = 4, pathways: int = 4) -> KnowledgeGraph:
    """A small made-up graph: gene i goes with disease i and pathway i, counted around, and with the gene after it."""
    g = spark.createDataFrame([(i, s) for i, s in enumerate(genes)], "i int, gene string")
    id = lambda prefix, n: F.concat(F.lit(prefix + ":demo-"), (F.col("i") % n + 1).cast("string"))
    step = lambda a, n, b: F.lit(a) + (F.col("i") % n) * b
    after = g.select((F.col("i") - 1).alias("i"), F.col("gene").alias("next"))
    none = F.lit(None).cast(_NO_PROPERTIES)
    src = F.array(F.lit("demo"))
    nodes = g.select(entity_id("gene", F.col("gene")).alias("id"), F.col("gene").alias("name"), F.lit("Gene").alias("node_type"), F.create_map(F.lit("chromosome"), (F.col("i") % 22 + 1).cast("string")).alias("properties"), src.alias("sources"))
    for prefix, kind, n in (("disease", "Disease", diseases), ("pathway", "Pathway", pathways)):
        nodes = nodes.unionByName(spark.range(n).select(F.concat(F.lit(prefix + ":demo-"), (F.col("id") + 1).cast("string")).alias("id"), F.concat(F.lit(f"Demo {prefix} "), (F.col("id") + 1).cast("string")).alias("name"), F.lit(kind).alias("node_type"), none.alias("properties"), src.alias("sources")))
    edge = lambda df, to, kind, score: df.select(entity_id("gene", F.col("gene")).alias("source_id"), to.alias("target_id"), F.lit(kind).alias("edge_type"), score.alias("score"), none.alias("properties"), src.alias("sources"))
    edges = edge(g, id("disease", diseases), "gene_associated_with_disease", step(0.65, 4, 0.08)).unionByName(edge(g, id("pathway", pathways), "gene_in_pathway", step(0.62, 3, 0.1)))
    return KnowledgeGraph(nodes, edges.unionByName(edge(g.join(after, "i"), entity_id("gene", F.col("next")), "gene_interacts_with_gene", step(0.58, 5, 0.06))))


def save_graph(kg: KnowledgeGraph, path: str) -> None:
    """Write the graph's two tables under ``path``, over what is there."""
    kg.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    kg.edges.write.mode("overwrite").parquet(f"{path}/edges")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_graph(spark: SparkSession, path: str, *, default: KnowledgeGraph | None = None) -> KnowledgeGraph:
    """The graph written under ``path``; where there is none, the default, or an empty graph without one."""
    if exists(spark, f"{path}/nodes") and exists(spark, f"{path}/edges"):
        return KnowledgeGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))
    if default is not None:
        return default
    empty = lambda schema: spark.createDataFrame([], schema)
    return KnowledgeGraph(empty("id string, name string, node_type string, properties map<string,string>, sources array<string>"), empty("source_id string, target_id string, edge_type string, score double, properties map<string,string>, sources array<string>"))


def put_vectors(store: DataFrame, new: DataFrame, *, id: str = "id") -> DataFrame:
    """A store of vectors with new ones put in, each over the old one of its id."""
    return store.join(new.select(id).distinct(), id, "left_anti").unionByName(new.select(*store.columns))


def newest_vectors(rows: DataFrame, order: Column, *, id: str = "vector_id") -> DataFrame:
    """The last row of each id: what a store holds after upserting ``rows`` in this order."""
    rest = [c for c in rows.columns if c != id]
    return rows.filter(F.col(id).isNotNull()).groupBy(id).agg(F.max_by(F.struct(*rest), order).alias("r")).select(id, "r.*")


def save_vectors(store: DataFrame, path: str) -> None:
    store.write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, schema: str = "id string, vector array<double>") -> DataFrame:
    """The vectors written at ``path``; an empty store where there are none."""
    return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def cleared(store: DataFrame) -> DataFrame:
    """The store without rows: a reset collection or an emptied cache keeps its columns."""
    return store.limit(0)


def seeded(store: DataFrame, corpus: DataFrame) -> DataFrame:
    """The store, or the corpus (same columns) where the store holds nothing."""
    return store if store.take(1) else corpus.select(*store.columns)
