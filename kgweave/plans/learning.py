"""Queries of graph learning, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import learning as L
from ..operators.runtime import checkpoint, table
from ..schema import EDGE_BETWEEN, EDGE_TYPES, NODE_TYPES
from ..operators import graph as G
from .graph import _pagerank_sql, _tenth, _tenth_sql
from .testbed import GRAPH, slim_graph

QUERIES: dict = {}
SQL: dict[str, str] = {}
RELATION = "gene_associated_with_disease"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return put


_DRAW = "CAST(('0x' || substr(md5(concat_ws('|', '{}', {})), 1, 13)) AS BIGINT)"
_SPLIT = f""", pos AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM edges WHERE edge_type = '{RELATION}'),
ord AS (SELECT src, dst, row_number() OVER (ORDER BY {_DRAW.format(42, 'src, dst')}, src, dst) AS place, count(*) OVER () AS n FROM pos),
split AS MATERIALIZED (SELECT src, dst, CASE WHEN place <= greatest(1, CAST(floor(n * 0.1) AS BIGINT)) THEN 'val' WHEN place <= 2 * greatest(1, CAST(floor(n * 0.1) AS BIGINT)) THEN 'test' ELSE 'train' END AS split FROM ord)
"""


def _positives(kg, relation=RELATION):
    return kg.of_type(relation).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))


@query(_pagerank_sql() + """, d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id)
SELECT n.id, round(coalesce(d.degree, 0) / (SELECT max(degree) FROM d), 8) AS degree, round(r.rank, 8) AS rank, CAST(CASE n.node_type """ + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(NODE_TYPES)) + """ END AS INTEGER) AS hot
FROM nodes n LEFT JOIN d USING (id) JOIN ranks r USING (id) WHERE n.node_type IS NOT NULL""")
def m01_node_features(spark, d):
    kg = slim_graph(spark, d)
    x = L.node_features(kg, A.pagerank(kg))
    return x.select("id", F.round(F.col("x")[12], 8).alias("degree"), F.round(F.col("x")[13], 8).alias("rank"), (F.array_position(F.slice("x", 1, 12), 1.0) - 1).cast("int").alias("hot"))


@query(GRAPH + "SELECT edge_type, count(*) AS n FROM edges GROUP BY ALL ORDER BY n DESC, edge_type LIMIT 1")
def m02_default_relation(spark, d):
    return L.commonest_relation(slim_graph(spark, d))


@query(GRAPH + _SPLIT + "SELECT src, dst, split FROM split")
def m04_split(spark, d):
    return L.split_edges(_positives(slim_graph(spark, d)))


@query(GRAPH + _SPLIT + f""", src_ AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM nodes WHERE node_type = 'Gene'), dst_ AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM nodes WHERE node_type = 'Disease'),
tries AS (SELECT src || '>' || dst AS e, CAST(unnest([1, 2]) AS VARCHAR) AS i FROM pos),
drawn AS (SELECT {_DRAW.format(42, 'e, i')} % (SELECT max(n) FROM src_) AS a, {_DRAW.format(43, 'e, i')} % (SELECT max(n) FROM dst_) AS b FROM tries),
pairs AS (SELECT DISTINCT s.id AS src, t.id AS dst FROM drawn JOIN src_ s ON s.k = a JOIN dst_ t ON t.k = b WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.src = s.id AND pos.dst = t.id))
SELECT src, dst FROM pairs QUALIFY row_number() OVER (ORDER BY {_DRAW.format(44, 'src, dst')}, src, dst) <= (SELECT count(*) FROM pos)""")
def m05_negatives(spark, d):
    kg = slim_graph(spark, d)
    of = lambda t: kg.nodes.filter(F.col("node_type") == t).select("id")
    return L.negatives(_positives(kg), of("Gene"), of("Disease")).select("src", "dst")


@query(GRAPH + f"SELECT edge_type, row_number() OVER (ORDER BY edge_type <> '{RELATION}', edge_type) - 1 AS relation FROM (SELECT DISTINCT edge_type FROM edges)")
def m06_relation_ids(spark, d):
    return L.relation_ids(slim_graph(spark, d).edges, RELATION)


@query(GRAPH + _SPLIT + f""", e AS (SELECT source_id, target_id, edge_type FROM edges x WHERE NOT (edge_type = '{RELATION}' AND EXISTS (SELECT 1 FROM split s WHERE s.split <> 'train' AND s.src = x.source_id AND s.dst = x.target_id)))
SELECT source_id AS src, target_id AS dst, edge_type FROM e UNION ALL SELECT target_id, source_id, edge_type FROM e""")
def m07_message_graph(spark, d):
    kg = slim_graph(spark, d)
    hidden = L.split_edges(_positives(kg)).filter("split <> 'train'")
    return L.message_graph(kg.edges, hidden, RELATION)


def _degrees(kg):
    return A.directed_degree(kg).select("id", F.array(F.col("degree").cast("double"), F.lit(1.0)).alias("x"))


@query(GRAPH + """, d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id),
m AS (SELECT source_id AS src, target_id AS dst FROM edges UNION ALL SELECT target_id, source_id FROM edges)
SELECT m.dst AS id, round(avg(d.degree), 6) AS mean FROM m JOIN d ON d.id = m.src GROUP BY ALL""")
def m12_mean_messages(spark, d):
    kg = slim_graph(spark, d)
    messages = L.message_graph(kg.edges, _positives(kg).limit(0), RELATION)
    return L.mean_messages(_degrees(kg), messages).select("id", F.round(F.col("m")[0], 6).alias("mean"))


def encoded(spark, d, relation=RELATION):
    """The graph, the split of a relation's edges and embeddings that don't see those held out."""
    kg = slim_graph(spark, d)
    split = L.split_edges(_positives(kg, relation))
    messages = L.message_graph(kg.edges, split.filter("split <> 'train'"), relation)
    x = L.node_features(kg, A.pagerank(kg))
    return kg, split, L.sage_encode(x, messages, L.sage_weights([14, 16, 16]))


def _sage_sql(relation: str) -> str:
    """SQL of x_out (id, i, v): the embeddings of :func:`encoded`, a row for each number."""
    widths = [14, 16, 16]
    s = _pagerank_sql() + _SPLIT.replace(RELATION, relation) + f""", msg AS MATERIALIZED (SELECT source_id AS src, target_id AS dst FROM edges x WHERE NOT (edge_type = '{relation}' AND EXISTS (SELECT 1 FROM split s WHERE s.split <> 'train' AND s.src = x.source_id AND s.dst = x.target_id))),
msg2 AS MATERIALIZED (SELECT src, dst FROM msg UNION ALL SELECT dst, src FROM msg),
deg_ AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id),
kinds AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(NODE_TYPES))}) k(i, t)),
x0 AS MATERIALIZED (SELECT n.id, k.i, CASE WHEN n.node_type = k.t THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM nodes n, kinds k WHERE n.node_type IS NOT NULL
  UNION ALL SELECT n.id, 12, coalesce(d.degree, 0) / (SELECT max(degree) FROM deg_) FROM nodes n LEFT JOIN deg_ d USING (id) WHERE n.node_type IS NOT NULL UNION ALL SELECT n.id, 13, r.rank FROM nodes n JOIN ranks r USING (id) WHERE n.node_type IS NOT NULL)"""
    for k, (own, near) in enumerate(L.sage_weights(widths)):
        rows = ", ".join(f"({i}, {j}, {own[i, j]!r}::DOUBLE, {near[i, j]!r}::DOUBLE)".replace("np.float64(", "").replace(")::", "::") for i in range(own.shape[0]) for j in range(own.shape[1]))
        s += f""", w{k} AS MATERIALIZED (SELECT * FROM (VALUES {rows}) w(i, j, a, b)), m{k} AS MATERIALIZED (SELECT m.dst AS id, x.i, avg(x.v) AS v FROM msg2 m JOIN x{k} x ON x.id = m.src GROUP BY ALL),
h{k} AS MATERIALIZED (SELECT x.id, w.j AS i, sum(x.v * w.a + coalesce(m.v, 0) * w.b) AS v FROM x{k} x JOIN w{k} w USING (i) LEFT JOIN m{k} m ON m.id = x.id AND m.i = x.i GROUP BY ALL)"""
        s += f", x{k + 1} AS MATERIALIZED (SELECT id, i, " + ("greatest(v, 0)" if k < len(widths) - 2 else "v / nullif(sqrt(sum(v * v) OVER (PARTITION BY id)), 0)") + f" AS v FROM h{k})"
    return s + f", x_out AS MATERIALIZED (SELECT id, list(coalesce(v, 0) ORDER BY i) AS x FROM x{len(widths) - 1} GROUP BY id)"


@query(_sage_sql(RELATION) + "SELECT id, array_to_string(list_transform(x, lambda v: CAST(CAST(round(v * 100000) AS BIGINT) AS VARCHAR)), ' ') AS x FROM x_out")
def m12_sage_embeddings(spark, d):
    """Embeddings by GraphSAGE, numbers in hundred-thousandths."""
    return encoded(spark, d)[2].select("id", F.array_join(F.transform("x", lambda v: F.round(v * 100_000).cast("long").cast("string")), " ").alias("x"))


def _relation_weights():
    import numpy as np

    return np.random.default_rng(42).normal(size=(2, 4)), L.basis_weights(sorted(EDGE_TYPES), 2, 4)


def _rgcn_sql() -> str:
    own, rel = _relation_weights()
    rows = ", ".join(f"('{k}', {j}, {float(w[0, j])!r}::DOUBLE, {float(w[1, j])!r}::DOUBLE)" for k, w in rel.items() for j in range(4))
    mine = ", ".join(f"({j}, {float(own[0, j])!r}::DOUBLE, {float(own[1, j])!r}::DOUBLE)" for j in range(4))
    return GRAPH + f""", d AS MATERIALIZED (SELECT u.id, coalesce(c.n, 0)::DOUBLE AS degree FROM universe u LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id) c USING (id)),
m AS MATERIALIZED (SELECT dst, edge_type, avg(d.degree) AS v FROM (SELECT source_id AS src, target_id AS dst, edge_type FROM edges UNION ALL SELECT target_id, source_id, edge_type FROM edges) JOIN d ON d.id = src GROUP BY ALL),
w AS (SELECT * FROM (VALUES {rows}) w(edge_type, j, a, b)), o AS (SELECT * FROM (VALUES {mine}) o(j, a, b)),
s AS (SELECT d.id, o.j, d.degree * o.a + o.b + coalesce((SELECT sum(m.v * w.a + w.b) FROM m JOIN w USING (edge_type) WHERE m.dst = d.id AND w.j = o.j), 0) AS v FROM d, o)
SELECT id, string_agg(CAST(CAST(round(greatest(v, 0) * 1000) AS BIGINT) AS VARCHAR), ' ' ORDER BY j) AS x FROM s GROUP BY id"""


@query(_rgcn_sql())
def m13_relational_layer(spark, d):
    """A relational layer over degrees, its matrices mixed from four bases, numbers in thousandths."""
    kg = slim_graph(spark, d)
    own, rel = _relation_weights()
    messages = L.message_graph(kg.edges, _positives(kg).limit(0), RELATION)
    x = L.rgcn_layer(_degrees(kg), messages, own, rel)
    return x.select("id", F.array_join(F.transform("x", lambda v: F.round(v * 1000).cast("long").cast("string")), " ").alias("x"))


@query(_sage_sql(RELATION) + f""", q AS {_tenth_sql('Gene')}, pr AS (SELECT a.id AS src, b.id AS dst, 1 / (1 + exp(-list_cosine_similarity(a.x, b.x))) AS score FROM x_out a JOIN nodes g ON g.id = a.id, x_out b JOIN nodes t ON t.id = b.id
 WHERE t.node_type = 'Disease' AND a.id IN (SELECT id FROM q) AND a.id <> b.id AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.edge_type = '{RELATION}' AND e.source_id = a.id AND e.target_id = b.id))
SELECT src, rank, round(score, 5) AS score FROM (SELECT src, row_number() OVER (PARTITION BY src ORDER BY score DESC) AS rank, score FROM pr) WHERE rank <= 10""")
def m10_novel_links(spark, d):
    """Scores of the ten best diseases that each query gene isn't linked to."""
    kg, _, x = encoded(spark, d)
    of = kg.nodes.filter("node_type = 'Disease'").select("id")
    return L.novel_links(x, _tenth(spark, d, "Gene"), of, _positives(kg)).select("src", "rank", F.round("score", 5).alias("score"))


@query(_sage_sql("drug_treats_disease") + """, s AS (SELECT g.target_id AS disease, t.source_id AS drug, sum(g.score * t.score) AS score, count(DISTINCT g.source_id) AS genes
  FROM edges g JOIN edges t ON t.target_id = g.source_id AND t.edge_type = 'drug_targets_gene' WHERE g.edge_type = 'gene_associated_with_disease' GROUP BY ALL),
c AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM edges k WHERE k.edge_type = 'drug_treats_disease' AND k.source_id = s.drug AND k.target_id = s.disease)),
sp AS (SELECT DISTINCT t.source_id AS drug, g.target_id AS disease, n.pmid FROM edges g JOIN edges t ON t.target_id = g.source_id AND t.edge_type = 'drug_targets_gene' JOIN edges a ON a.edge_type = 'publication_mentions_gene' AND a.target_id = g.source_id
  JOIN edges b ON b.edge_type = 'publication_mentions_disease' AND b.source_id = a.source_id AND b.target_id = g.target_id JOIN nodes n ON n.id = a.source_id WHERE g.edge_type = 'gene_associated_with_disease' AND n.pmid IS NOT NULL),
ev AS (SELECT disease, drug, count(*) AS papers FROM sp GROUP BY ALL),
f AS (SELECT c.disease, c.drug, round(0.35 * c.score / greatest(max(c.score) OVER (PARTITION BY c.disease), 1.0) + 0.30 * coalesce(CASE WHEN a.x IS NULL OR b.x IS NULL THEN 0 ELSE 1 / (1 + exp(-list_cosine_similarity(a.x, b.x))) END, 0)
  + 0.20 * least(coalesce(ev.papers, 0), 5) / 5.0 + 0.15 * least(c.genes, 5) / 5.0, 6) AS confidence FROM c LEFT JOIN x_out a ON a.id = c.drug LEFT JOIN x_out b ON b.id = c.disease LEFT JOIN ev ON ev.disease = c.disease AND ev.drug = c.drug)
SELECT disease, drug, confidence, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS level
FROM f QUALIFY row_number() OVER (PARTITION BY disease ORDER BY confidence DESC, drug) <= 10
""")
def q09_repurposing_report(spark, d):
    """Repurposing candidates by shared genes, link scores and publications."""
    kg, _, x = encoded(spark, d, "drug_treats_disease")
    pairs = kg.repurposing()
    evidence = G.repurposing_evidence(kg, pairs)
    model = L.link_scores(pairs.select(F.col("drug").alias("src"), F.col("disease").alias("dst")), x).select(F.col("dst").alias("disease"), F.col("src").alias("drug"), F.col("score").alias("model"))
    return G.repurposing_report(kg, model=model, evidence=evidence)


@query(GRAPH + _SPLIT + """, c AS (SELECT split, count(*) AS n FROM split GROUP BY ALL) SELECT split, 1 AS label, n FROM c UNION ALL SELECT split, 0, n FROM c""")
def m08_dataset(spark, d):
    """Sizes of a link-prediction dataset: as many negatives as positives in each split."""
    samples = L.link_dataset(slim_graph(spark, d), RELATION, "Gene", "Disease")[0]
    return samples.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def _trained(spark, d):
    kg = slim_graph(spark, d)
    samples, messages = L.link_dataset(kg, RELATION, "Gene", "Disease")
    x = L.embeddings(kg, L.node_features(kg, A.pagerank(kg)), messages, model="graphsage")
    rows = L.with_vectors(samples.withColumn("relation", F.lit(0)), x)
    return kg, x, rows, L.train_decoder(rows)[0]


@query()
def m11_evaluate(spark, d):
    """Metrics of a trained decoder on held-out edges, and the confidence they give."""
    _, _, rows, decoder = _trained(spark, d)
    m = L.evaluate(decoder, rows)
    return m.withColumn("confidence", L.predictor_confidence(F.col("auprc"), F.col("mrr")))


@query()
def m15_train_decoder(spark, d):
    """Losses of the training by epoch."""
    kg = slim_graph(spark, d)
    samples, messages = L.link_dataset(kg, RELATION, "Gene", "Disease")
    x = L.embeddings(kg, L.node_features(kg, A.pagerank(kg)), messages, model="rgcn")
    _, losses = L.train_decoder(L.with_vectors(samples.withColumn("relation", F.lit(0)), x), epochs=20)
    return spark.createDataFrame([(i, *x) for i, x in enumerate(losses)], "epoch int, train double, val double")


@query()
def o24_link_report(spark, d):
    """Best unlinked diseases of query genes by a trained decoder's embeddings, with names."""
    kg, x, _, _ = _trained(spark, d)
    best = L.novel_links(x, _tenth(spark, d, "Gene"), kg.nodes.filter("node_type = 'Disease'").select("id"), _positives(kg))
    n = kg.nodes.select(F.col("id").alias("dst"), "name")
    return best.join(n, "dst", "left").select("src", "rank", "dst", "name", F.round("score", 6).alias("score"), F.format_string("- %s (%.3f)", F.coalesce("name", "dst"), "score").alias("line"))


@query(GRAPH + "SELECT node_type, count(*) AS n, CAST(sum(g) AS BIGINT) AS global, CAST(sum(l) AS BIGINT) AS local FROM (SELECT node_type, row_number() OVER (ORDER BY node_type, id) - 1 AS g, row_number() OVER (PARTITION BY node_type ORDER BY id) - 1 AS l FROM nodes WHERE node_type IS NOT NULL) GROUP BY ALL")
def m28_type_slices(spark, d):
    """Places of nodes among all and within their type, summed by type."""
    return L.type_slices(slim_graph(spark, d)).groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.sum("global").alias("global"), F.sum("local").alias("local"))


@query(GRAPH + "SELECT h.hypothesis_id, coalesce(h.edge_type, CASE " + " ".join(f"WHEN s.node_type = '{a}' AND t.node_type = '{b}' THEN '{e}'" for (a, b), e in EDGE_BETWEEN.items()) + """ END, 'gene_associated_with_disease') AS relation
FROM (SELECT DISTINCT hypothesis_id, source_id, target_id, CASE WHEN hypothesis_id % 3 = 0 THEN edge_type END AS edge_type FROM hypotheses) h LEFT JOIN nodes s ON s.id = h.source_id LEFT JOIN nodes t ON t.id = h.target_id""")
def m26_prediction_relation(spark, d):
    """The relation to predict for hypotheses, of which every third names one."""
    h = table(spark, d, "hypotheses").select("hypothesis_id", "source_id", "target_id", F.when(F.col("hypothesis_id") % 3 == 0, F.col("edge_type")).alias("edge_type")).distinct()
    n = slim_graph(spark, d).nodes.select("id", "node_type")
    j = h.join(n.select(F.col("id").alias("source_id"), F.col("node_type").alias("s")), "source_id", "left").join(n.select(F.col("id").alias("target_id"), F.col("node_type").alias("t")), "target_id", "left")
    return j.select("hypothesis_id", L.prediction_relation(F.col("edge_type"), F.col("s"), F.col("t")).alias("relation"))


@query(GRAPH + "SELECT n.id, n.node_type, n.name, len(e.embedding) AS width FROM (SELECT *, row_number() OVER (ORDER BY id) AS k FROM nodes) n JOIN embeddings e ON e.vec_id = n.k")
def m24_embedding_store(spark, d):
    """A store of node vectors refreshed with types and names."""
    kg = slim_graph(spark, d)
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").alias("x"))
    return L.embedding_store(kg, G.numbered(kg.nodes, "id").join(v, "n")).select("id", "node_type", "name", F.size("vector").cast("long").alias("width"))


@query()
def m27_models(spark, d):
    """Vectors of the three models, by their lengths."""
    kg = slim_graph(spark, d)
    messages = L.message_graph(kg.edges, _positives(kg).limit(0), RELATION)
    features = checkpoint(L.node_features(kg, A.pagerank(kg)))
    out = None
    for model in ("graphsage", "rgcn", "node2vec"):
        x = L.embeddings(kg, features, messages, model=model)
        part = x.select(F.lit(model).alias("model"), "id", F.size("x").alias("width"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v), 4).alias("norm"))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def m16_walk_cooccurrence(spark, d):
    return L.cooccurrence(L.random_walks(slim_graph(spark, d), walks=12, length=10))


_SAMPLES = f"WITH s AS (SELECT DISTINCT edge_id AS sample, CASE WHEN edge_type = '{RELATION}' THEN 1 ELSE 0 END AS label, score FROM kg_edges WHERE score IS NOT NULL AND edge_type IS NOT NULL)"


def _samples(spark, d):
    e = table(spark, d, "kg_edges").filter("score is not null and edge_type is not null")
    return e.select(F.col("edge_id").alias("sample"), F.when(F.col("edge_type") == RELATION, 1).otherwise(0).alias("label"), "score").distinct()


@query(_SAMPLES + """, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s)
SELECT round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 8) AS auroc FROM r""")
def m18_auroc(spark, d):
    return L.auroc(_samples(spark, d)).select(F.round("auroc", 8).alias("auroc"))


@query(_SAMPLES + """, g AS (SELECT score, sum(label) AS p, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS al FROM g) SELECT round(sum(p * tp / al) / sum(p), 8) AS auprc FROM c""")
def m19_auprc(spark, d):
    return L.auprc(_samples(spark, d)).select(F.round("auprc", 8).alias("auprc"))


@query(_SAMPLES + """, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, sample DESC) AS r FROM s)
SELECT round(avg(1.0 / r), 8) AS mrr, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0 END), 8) AS hits_10, round(avg(CASE WHEN r <= 50 THEN 1.0 ELSE 0 END), 8) AS hits_50 FROM r WHERE label = 1""")
def m20_ranking(spark, d):
    return L.ranking_metrics(_samples(spark, d)).select(*[F.round(c, 8).alias(c) for c in ("mrr", "hits_10", "hits_50")])


@query()
def m23_kmeans(spark, d):
    return L.cluster(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


@query(_SAMPLES + """, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, sample DESC) AS r FROM s), h AS (SELECT avg(1.0 / r) AS mrr FROM r WHERE label = 1), g AS (SELECT score, sum(label) AS p, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS al FROM g), a AS (SELECT sum(p * tp / al) / sum(p) AS auprc FROM c)
SELECT round(least(0.95, 0.5 * auprc + 0.4 * mrr + 0.2), 8) AS confidence FROM a, h""")
def m25_predictor_confidence(spark, d):
    """Confidence of a predictor from its metrics."""
    m = L.auprc(_samples(spark, d)).join(L.ranking_metrics(_samples(spark, d)))
    return m.select(F.round(L.predictor_confidence(F.col("auprc"), F.col("mrr")), 8).alias("confidence"))


@query()
def m21_metrics_table(spark, d):
    """Metrics as a line of a Markdown table."""
    s = _samples(spark, d)
    return L.metrics_table(L.auroc(s).join(L.auprc(s)).join(L.ranking_metrics(s)).withColumn("model", F.lit("score")))
