"""The test tables as a graph and a corpus, for Spark and, as SQL, for the twin queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import KnowledgeGraph, clean_edges, merge_edges, merge_nodes
from ..operators.runtime import table

DELIVERY = ("updated_at", "record_id")


def node_records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kg_nodes").filter("id is not null")


def graph(spark: SparkSession, d: str) -> KnowledgeGraph:
    """Nodes never deleted, merged by id; edges merged by source, target and type, both ends known or not."""
    rows = node_records(spark, d)
    gone = rows.filter("deleted_at is not null").select("id").distinct()
    cols = rows.select("id", "name", "node_type", "properties", "sources", "year", "pmid", *DELIVERY)
    nodes = merge_nodes(cols, F.struct(*DELIVERY)).drop(*DELIVERY).join(gone, "id", "left_anti")
    edges = clean_edges(table(spark, d, "kg_edges")).select("source_id", "target_id", "edge_type", "score", "properties", "sources", "loaded_at", "edge_id")
    return KnowledgeGraph(nodes, merge_edges(edges, F.struct("loaded_at", "edge_id")))


def slim_graph(spark: SparkSession, d: str) -> KnowledgeGraph:
    """The same graph without properties and sources of edges, for queries that don't read them."""
    rows = node_records(spark, d)
    nodes = rows.groupBy("id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct(*DELIVERY))).alias(c) for c in ("name", "node_type", "year", "pmid")], F.max("deleted_at").alias("gone"))
    nodes = nodes.filter("gone is null").drop("gone").withColumn("properties", F.lit(None).cast("map<string,string>"))
    edges = clean_edges(table(spark, d, "kg_edges")).groupBy("source_id", "target_id", "edge_type").agg(F.max("score").alias("score"))
    return KnowledgeGraph(nodes, edges)


def _newest(c: str) -> str:
    return f"(SELECT id, {c} FROM r WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, record_id DESC) = 1)"


GRAPH = f"""
WITH r AS (SELECT * FROM kg_nodes WHERE id IS NOT NULL),
nodes AS MATERIALIZED (SELECT k.id, a.name, b.node_type, c.year, e.pmid
  FROM (SELECT DISTINCT id FROM r WHERE id NOT IN (SELECT id FROM r WHERE deleted_at IS NOT NULL)) k
  LEFT JOIN {_newest('name')} a ON a.id = k.id LEFT JOIN {_newest('node_type')} b ON b.id = k.id
  LEFT JOIN {_newest('year')} c ON c.id = k.id LEFT JOIN {_newest('pmid')} e ON e.id = k.id),
edges AS MATERIALIZED (SELECT source_id, target_id, coalesce(lower(edge_type), 'gene_interacts_with_gene') AS edge_type, max(coalesce(score, 1.0)) AS score
  FROM kg_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY ALL),
universe AS MATERIALIZED (SELECT id FROM nodes UNION SELECT source_id FROM edges UNION SELECT target_id FROM edges),
und AS MATERIALIZED (SELECT DISTINCT least(source_id, target_id) AS u, greatest(source_id, target_id) AS v, edge_type FROM edges)
"""

#: Nodes with what a text search looks into, properties written as Spark writes them.
HAY = """, rp AS (SELECT DISTINCT id, properties, updated_at, record_id FROM r), pe AS (SELECT id, updated_at, record_id, unnest(map_entries(properties)) AS e FROM rp),
pv AS (SELECT id, e.key AS k, e.value AS v FROM pe QUALIFY row_number() OVER (PARTITION BY id, e.key ORDER BY updated_at DESC, record_id DESC) = 1),
pj AS (SELECT id, '{' || string_agg('"' || k || '":' || coalesce('"' || replace(replace(v, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"', 'null'), ',' ORDER BY k) || '}' AS props FROM pv GROUP BY id),
hay AS MATERIALIZED (SELECT n.*, lower(concat_ws(' ', n.id, n.name, j.props)) AS hay FROM nodes n LEFT JOIN pj j ON j.id = n.id)
"""
