"""Learning on the graph: datasets for link prediction, message passing, walks, scores and metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import NODE_TYPES, edge_type_between
from .analytics import directed_degree
from .graph import KnowledgeGraph, local_index
from .runtime import checkpoint, running_totals


def node_features(kg: KnowledgeGraph, ranks: DataFrame) -> DataFrame:
    """(id, x): one of twelve types, degree over the greatest degree, PageRank; fourteen numbers. Nodes without a type are left out."""
    deg = directed_degree(kg)
    most = deg.agg(F.greatest(F.max("degree"), F.lit(1)).alias("most"))
    n = kg.nodes.filter("node_type is not null").select("id", "node_type").join(deg, "id").join(ranks, "id").join(F.broadcast(most))
    kinds = [F.when(F.col("node_type") == t, 1.0).otherwise(0.0) for t in NODE_TYPES]
    return n.select("id", F.array(*kinds, F.col("degree") / F.col("most"), F.col("rank")).alias("x"))


def commonest_relation(kg: KnowledgeGraph) -> DataFrame:
    """(edge_type, n): the relation with most edges, of equals the first by name."""
    return kg.edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "edge_type").limit(1)


def draw(seed: int, *cols: str) -> Column:
    """A number below 2**52 that a row's keys and the seed decide: what other engines can compute as well."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *cols)), 1, 13), 16, 10).cast("long")


def drawn_places(rows: DataFrame, by: Column, ties: list[str]) -> DataFrame:
    """``rows`` with their place from 1 in the order of a drawn number ``by`` (below 2**52), then of ``ties``.

    Places are counted within 1024 ranges of the number, so no task sorts all rows."""
    ranges = checkpoint(rows.withColumn("_d", by).withColumn("_g", F.shiftright("_d", 42)))
    sizes = ranges.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    start = sizes.select("_g", F.coalesce(F.sum("_n").over(W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy("_g").orderBy("_d", *ties)) + F.col("_start")
    return ranges.join(F.broadcast(start), "_g").withColumn("place", place).drop("_d", "_g", "_start")


def split_sizes(total: int, val: float, test: float) -> tuple[int, int]:
    """Numbers of edges for val and test: int(total * ratio), at least one each from three edges on, less if train would be empty."""
    n_val, n_test = int(total * val), int(total * test)
    if total >= 3:
        n_val, n_test = max(1, n_val), max(1, n_test)
    while total and total - n_val - n_test < 1:
        n_val, n_test = (n_val, n_test - 1) if n_test else (n_val - 1, n_test)
    return n_val, n_test


def split_edges(positives: DataFrame, *, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """Positives (src, dst) with a split: the edges in a drawn order, the first part val, the next test, the rest train."""
    p = checkpoint(positives.select("src", "dst").distinct())
    n_val, n_test = split_sizes(p.count(), val, test)
    part = F.when(F.col("place") <= n_val, "val").when(F.col("place") <= n_val + n_test, "test").otherwise("train")
    return drawn_places(p, draw(seed, "src", "dst"), ["src", "dst"]).select("src", "dst", part.alias("split"))


def negatives(positives: DataFrame, sources: DataFrame, targets: DataFrame, *, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """Typed pairs that aren't positive: (src, dst, place), max(1, ceil(ratio * positives)) of them, or all there are if those are fewer.

    Each round every positive edge draws a source and a target by number, several tries at once, so no pair of all sources and
    targets is ever formed; tries that hit a positive or repeat are dropped and rounds go on until there are enough.  Where
    the wanted number is more than half of all pairs, these are counted through instead.  ``place`` numbers them in a drawn order."""
    per = int(np.ceil(ratio * 2))
    number = lambda df, n: local_index(df.select("id", F.lit("any").alias("node_type"))).select(F.col("id").alias(n), F.col("i").alias("k"))
    s, t = checkpoint(number(sources.distinct(), "src")), checkpoint(number(targets.distinct(), "dst"))
    ns, nt = s.count(), t.count()
    p = checkpoint(positives.select("src", "dst").distinct())
    want = max(1, int(np.ceil(p.count() * ratio)))
    named = lambda df: df.join(s.withColumnRenamed("k", "a"), "a").join(t.withColumnRenamed("k", "b"), "b").select("src", "dst")
    taken = p.join(s, "src", "left_semi").join(t, "dst", "left_semi").count()
    spark = positives.sparkSession
    if ns * nt - taken <= 2 * want:
        found = checkpoint(named(spark.range(ns * nt).select(F.floor(F.col("id") / F.lit(max(nt, 1))).alias("a"), F.pmod("id", F.lit(max(nt, 1))).alias("b"))).join(p, ["src", "dst"], "left_anti"))
    else:
        found, first = None, 1
        while True:
            tries = p.select(F.concat_ws(">", "src", "dst").alias("e"), F.explode(F.sequence(F.lit(first), F.lit(first + per - 1))).alias("i")).withColumn("i", F.col("i").cast("string"))
            tries = tries.select(F.pmod(draw(seed, "e", "i"), F.lit(ns)).alias("a"), F.pmod(draw(seed + 1, "e", "i"), F.lit(nt)).alias("b"))
            new = named(tries).distinct().join(p, ["src", "dst"], "left_anti")
            found = checkpoint(new if found is None else found.unionByName(new).distinct())
            first += per
            if found.count() >= want:
                break
    return drawn_places(found, draw(seed + 2, "src", "dst"), ["src", "dst"]).filter(F.col("place") <= want).select("src", "dst", "place")


def link_dataset(kg: KnowledgeGraph, relation: str, source_type: str, target_type: str, *, val: float = 0.1, test: float = 0.1, ratio: float = 1.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Samples and message graph for predicting a relation: (src, dst, label, split) and (src, dst, edge_type).

    Positives are split; each split gets max(1, ceil(ratio * its positives)) negatives of its own, or what is left of them, val first.  The message
    graph has both directions of every edge but the positives held out.  A relation without edges is an error."""
    split = checkpoint(split_edges(kg.of_type(relation).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")), val=val, test=test, seed=seed))
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    if not sizes:
        raise ValueError(f"no edges of {relation}")
    of = lambda kind: kg.nodes.filter(F.col("node_type") == kind).select("id")
    wanted = {k: max(1, int(np.ceil(sizes.get(k, 0) * ratio))) for k in ("val", "test", "train") if sizes.get(k)}
    neg = negatives(split, of(source_type), of(target_type), ratio=max(sum(wanted.values()) / sum(sizes.values()), ratio), seed=seed)
    part, upto = F.when(F.lit(False), ""), 0
    for k, n in wanted.items():
        upto += n
        part = part.when(F.col("place") <= upto, k)
    neg = neg.withColumn("split", part).filter("split is not null")
    samples = split.select("src", "dst", F.lit(1).alias("label"), "split").unionByName(neg.select("src", "dst", F.lit(0).alias("label"), "split"))
    return checkpoint(samples), message_graph(kg.edges, split.filter("split <> 'train'"), relation)


def type_slices(kg: KnowledgeGraph) -> DataFrame:
    """Nodes with a type by their place among all and within their type, in the order of type and id: (id, node_type, global, local).

    A node of a type that isn't known is an error."""
    kind = F.when(F.col("node_type").isin(*NODE_TYPES), F.col("node_type")).otherwise(F.raise_error(F.concat(F.lit("not a known type: "), "node_type")).cast("string"))
    local = checkpoint(local_index(kg.nodes.filter("node_type is not null").select("id", kind.alias("node_type"))))
    size = local.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))
    start = size.select("node_type", F.coalesce(F.sum("n").over(W.orderBy("node_type").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return local.join(F.broadcast(start), "node_type").select("id", "node_type", (F.col("start") + F.col("i")).alias("global"), F.col("i").alias("local"))


def prediction_relation(explicit: Column, source_type: Column, target_type: Column) -> Column:
    """The relation to predict: the one asked for, else the one the types imply, else genes to diseases."""
    return F.coalesce(explicit, edge_type_between(source_type, target_type), F.lit("gene_associated_with_disease"))


def predictor_confidence(auprc: Column, mrr: Column) -> Column:
    return F.least(F.lit(0.95), 0.5 * auprc + 0.4 * mrr + 0.2)


def relation_ids(edges: DataFrame, held_out: str) -> DataFrame:
    """(edge_type, relation): 0 for the held-out relation, the others numbered by name."""
    kinds = edges.select("edge_type").distinct()
    order = F.row_number().over(W.orderBy((F.col("edge_type") != held_out), "edge_type")) - 1
    return kinds.select("edge_type", order.alias("relation"))


def message_graph(edges: DataFrame, hidden: DataFrame, relation: str) -> DataFrame:
    """Both directions of every edge but the hidden pairs of the relation: (src, dst, edge_type)."""
    h = hidden.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.lit(relation).alias("edge_type"))
    e = edges.join(h, ["source_id", "target_id", "edge_type"], "left_anti")
    out = e.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "edge_type")
    return out.unionByName(e.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"), "edge_type"))


def mean_messages(x: DataFrame, messages: DataFrame, *, by_relation: bool = False) -> DataFrame:
    """Mean of the neighbours' vectors: (id, [edge_type,] m).  Sums are added up element by element before they are shuffled."""
    keys = ["dst", "edge_type"] if by_relation else ["dst"]
    rows = messages.join(x.select(F.col("id").alias("src"), "x"), "src")
    width = len(x.select("x").head()[0])
    means = rows.groupBy(*keys).agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)])
    return means.select(F.col("dst").alias("id"), *keys[1:], F.array(*[f"m{i}" for i in range(width)]).alias("m"))


def linear(df: DataFrame, parts: list[tuple[str, np.ndarray]], out: str, *, relu: bool = True, unit: bool = False) -> DataFrame:
    """``out`` = sum of vectors times matrices, in numpy by Arrow batch."""
    schema = T.StructType([*df.select("id").schema, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            total = 0.0
            for c, w in parts:
                total = total + np.array([np.zeros(w.shape[0]) if v is None else np.asarray(v, np.float64) for v in pdf[c]]) @ w
            if relu:
                total = np.maximum(total, 0)
            if unit:
                norm = np.linalg.norm(total, axis=1, keepdims=True)
                total = np.divide(total, norm, out=np.zeros_like(total), where=norm > 0)
            yield pd.DataFrame({"id": pdf["id"], out: list(total)})

    return df.select("id", *[c for c, _ in parts]).mapInPandas(run, schema)


def sage_weights(widths: list[int], seed: int = 42) -> list[tuple[np.ndarray, np.ndarray]]:
    r = np.random.default_rng(seed)
    return [(r.normal(0, 1 / np.sqrt(a), (a, b)), r.normal(0, 1 / np.sqrt(a), (a, b))) for a, b in zip(widths, widths[1:], strict=False)]


def sage_encode(x: DataFrame, messages: DataFrame, weights: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """GraphSAGE with given weights: relu(x W1 + mean(neighbours) W2) by layer, the last at unit length: (id, x)."""
    for k, (own, near) in enumerate(weights):
        last = k == len(weights) - 1
        joined = x.join(mean_messages(x, messages), "id", "left")
        x = checkpoint(linear(joined, [("x", own), ("m", near)], "h", relu=not last, unit=last).select("id", F.col("h").alias("x")))
    return x


def rgcn_layer(x: DataFrame, messages: DataFrame, own: np.ndarray, relations: dict[str, np.ndarray]) -> DataFrame:
    """Relational layer: relu(x W0 + sum over relations of mean(neighbours) Wr): (id, x)."""
    means = mean_messages(x, messages, by_relation=True)
    wide = means.groupBy("id").pivot("edge_type", sorted(relations)).agg(F.first("m"))
    joined = x.join(wide, "id", "left")
    return linear(joined, [("x", own), *((r, relations[r]) for r in sorted(relations))], "h").select("id", F.col("h").alias("x"))


def link_scores(pairs: DataFrame, x: DataFrame) -> DataFrame:
    """Score of each pair (src, dst): logistic function of the cosine of the ends' vectors, 0 if one is unknown."""
    from .retrieval import cosine

    j = pairs.join(x.select(F.col("id").alias("src"), F.col("x").alias("a")), "src", "left").join(x.select(F.col("id").alias("dst"), F.col("x").alias("b")), "dst", "left")
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(1 / (1 + F.exp(-cosine(F.col("a"), F.col("b")))))
    return j.select("src", "dst", s.alias("score"))


def novel_links(x: DataFrame, sources: DataFrame, targets: DataFrame, known: DataFrame, *, top: int = 10) -> DataFrame:
    """The best targets of each source by link score, itself and its known targets left out: (src, rank, dst, score).

    ``sources`` and ``targets``: (id); ``known``: (src, dst).  Every target is scored; each batch keeps only as many of a source's best
    as can matter, ``top`` and the most any source knows already."""
    from .retrieval import dense

    seeds = sources.select("id").distinct()
    mine = checkpoint(known.select("src", "dst").distinct().join(seeds.withColumnRenamed("id", "src"), "src", "left_semi"))
    most = mine.groupBy("src").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    vectors = lambda ids, n: x.join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias(n), F.col("x").alias("vector"))
    near = dense(vectors(targets, "doc"), vectors(seeds, "query"), top=top + most, exclude_self=True).select(F.col("query").alias("src"), F.col("doc").alias("dst"), "score")
    free = near.join(mine, ["src", "dst"], "left_anti").withColumn("score", 1 / (1 + F.exp(-F.col("score"))))
    order = W.partitionBy("src").orderBy(F.round("score", 9).desc(), "dst")
    return free.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("src", "rank", "dst", "score")


class Decoder:
    """Scores pairs by a small network on [s, t, |s - t|, s * t + r] of the ends' vectors and a relation's own vector."""

    def __init__(self, width: int, relations: int, hidden: int, seed: int) -> None:
        r = np.random.default_rng(seed)
        self.w = {"R": r.normal(0, 0.1, (relations, width)), "A": r.normal(0, 1 / np.sqrt(4 * width), (4 * width, hidden)), "a": np.zeros(hidden), "B": r.normal(0, 1 / np.sqrt(hidden), hidden), "b": np.zeros(1)}

    @staticmethod
    def forward(w: dict[str, np.ndarray], s: np.ndarray, t: np.ndarray, rel: np.ndarray):
        f = np.concatenate([s, t, np.abs(s - t), s * t + w["R"][rel]], axis=1)
        h = np.maximum(f @ w["A"] + w["a"], 0)
        return f, h, h @ w["B"] + w["b"][0]

    @staticmethod
    def gradient(w: dict[str, np.ndarray], s: np.ndarray, t: np.ndarray, rel: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Sum of the losses, log-loss of the logits, and of their gradients."""
        f, h, z = Decoder.forward(w, s, t, rel)
        loss = float(np.sum(np.logaddexp(0, z) - label * z))
        dz = 1 / (1 + np.exp(-z)) - label
        dh = np.outer(dz, w["B"]) * (h > 0)
        width = s.shape[1]
        g = {"R": np.zeros_like(w["R"]), "A": f.T @ dh, "a": dh.sum(0), "B": h.T @ dz, "b": np.array([dz.sum()])}
        np.add.at(g["R"], rel, (dh @ w["A"].T)[:, 3 * width :])
        return loss, g

    def scores(self, pairs: DataFrame) -> DataFrame:
        """Pairs (…, a, b, relation) with their probability as ``score``."""
        keep = [c for c in pairs.columns if c not in ("a", "b")]
        schema = T.StructType([*pairs.select(*keep).schema, T.StructField("score", T.DoubleType())])
        w = self.w

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                if len(pdf):
                    z = Decoder.forward(w, np.array(pdf["a"].tolist()), np.array(pdf["b"].tolist()), pdf["relation"].to_numpy(int))[2]
                    yield pdf[keep].assign(score=1 / (1 + np.exp(-z)))

        return pairs.mapInPandas(run, schema)


def with_vectors(samples: DataFrame, x: DataFrame) -> DataFrame:
    """Samples (src, dst, …) with the vectors of their ends as a and b; pairs with an unknown end are left out."""
    return samples.join(x.select(F.col("id").alias("src"), F.col("x").alias("a")), "src").join(x.select(F.col("id").alias("dst"), F.col("x").alias("b")), "dst")


def train_decoder(samples: DataFrame, *, relations: int = 1, hidden: int = 32, epochs: int = 50, rate: float = 0.02, patience: int = 10, min_delta: float = 1e-4, seed: int = 42) -> tuple[Decoder, list[tuple[float, float]]]:
    """A decoder trained on samples (a, b, relation, label, split), and its losses by epoch (train, val).

    Full-batch Adam on the log-loss: each epoch the tasks add up the gradients of their samples and send one row each.  Training ends when
    the loss of split 'val' (of 'train' if there is none) hasn't fallen by ``min_delta`` for ``patience`` epochs; the best weights stay."""
    rows = checkpoint(samples.filter("split in ('train', 'val')").select("a", "b", "relation", "label", "split"))
    head = rows.take(1)
    if not head:
        raise ValueError("no samples to train on")
    d = Decoder(len(head[0]["a"]), relations, hidden, seed)
    m, v = ({k: np.zeros_like(a) for k, a in d.w.items()} for _ in range(2))
    sizes = [(k, a.shape) for k, a in d.w.items()]
    schema = "split string, loss double, n long, g array<double>"
    best, best_w, since, losses = np.inf, d.w, 0, []
    for epoch in range(1, epochs + 1):
        w = d.w

        def run(parts: Iterator[pd.DataFrame], w: dict = w) -> Iterator[pd.DataFrame]:
            total: dict = {}
            for pdf in parts:
                for split, part in pdf.groupby("split"):
                    loss, g = Decoder.gradient(w, np.array(part["a"].tolist()), np.array(part["b"].tolist()), part["relation"].to_numpy(int), part["label"].to_numpy(float))
                    flat = np.concatenate([g[k].ravel() for k, _ in sizes])
                    old = total.get(split, (0.0, 0, 0.0))
                    total[split] = (old[0] + loss, old[1] + len(part), old[2] + flat)
            yield pd.DataFrame([(k, x, n, list(g)) for k, (x, n, g) in total.items()], columns=["split", "loss", "n", "g"])

        sums: dict = {}
        for r in rows.mapInPandas(run, schema).collect():  # one row a task and split
            old = sums.get(r["split"], (0.0, 0, 0.0))
            sums[r["split"]] = (old[0] + r["loss"], old[1] + r["n"], old[2] + np.array(r["g"]))
        loss, n, flat = sums.get("train", sums.get("val"))
        seen = sums.get("val", sums.get("train"))
        losses.append((loss / n, seen[0] / seen[1]))
        if losses[-1][1] < best - min_delta:
            best, best_w, since = losses[-1][1], w, 0
        else:
            since += 1
            if since >= patience:
                break
        new, at = {}, 0
        for k, shape in sizes:
            size = int(np.prod(shape))
            g = flat[at : at + size].reshape(shape) / n
            at += size
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            new[k] = w[k] - rate * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.999**epoch)) + 1e-8)
        d.w = new
    d.w = best_w
    return d, losses


def evaluate(decoder: Decoder, samples: DataFrame, split: str = "test") -> DataFrame:
    """(auroc, auprc, mrr, hits_10, hits_50) of a split of samples (src, dst, a, b, relation, label, split); of 'train' if the split is empty."""
    rows = samples.filter(F.col("split") == split)
    rows = rows if rows.take(1) else samples.filter("split = 'train'")
    scored = checkpoint(decoder.scores(rows).select("label", "score", F.concat_ws(">", "src", "dst").alias("sample")))
    return auroc(scored).join(auprc(scored)).join(ranking_metrics(scored))


def metrics_table(metrics: DataFrame) -> DataFrame:
    """Models' metrics (model, auroc, auprc, hits_10, hits_50, mrr) as lines of a Markdown table: (model, line)."""
    return metrics.select("model", F.format_string("| %s | %.4f | %.4f | %.4f | %.4f | %.4f |", "model", "auroc", "auprc", "hits_10", "hits_50", "mrr").alias("line"))


def basis_weights(relations: list[str], rows: int, cols: int, *, bases: int = 4, seed: int = 42) -> dict[str, np.ndarray]:
    """A matrix for each relation, a mixture of at most ``bases`` common ones."""
    r = np.random.default_rng(seed)
    n = max(1, min(bases, len(relations)))
    common, share = r.normal(0, 1 / np.sqrt(rows), (n, rows, cols)), r.normal(0, 1, (len(relations), n))
    return {k: np.tensordot(share[i], common, 1) for i, k in enumerate(relations)}


def embeddings(kg: KnowledgeGraph, x: DataFrame, messages: DataFrame, *, model: str = "graphsage", width: int = 16, seed: int = 42) -> DataFrame:
    """(id, x): vectors of the nodes by one of the models graphsage, rgcn and node2vec."""
    start = len(x.select("x").head()[0])
    if model == "graphsage":
        return sage_encode(x, messages, sage_weights([start, width, width], seed))
    if model == "rgcn":
        kinds = sorted(r[0] for r in messages.select("edge_type").distinct().collect())
        own = np.random.default_rng(seed).normal(0, 1 / np.sqrt(start), (start, width))
        return rgcn_layer(x, messages, own, basis_weights(kinds, start, width, seed=seed))
    if model == "node2vec":
        return walk_vectors(cooccurrence(random_walks(kg, seed=seed)), kg.nodes.select("id"), width=width, seed=seed)
    raise ValueError(f"not a known model: {model}")


def embedding_store(kg: KnowledgeGraph, x: DataFrame) -> DataFrame:
    """(id, vector, node_type, name): what a store of node vectors holds, refreshed from the graph."""
    return kg.nodes.select("id", "node_type", "name").join(x.select("id", F.col("x").alias("vector")), "id").select("id", "vector", "node_type", "name")


def walk_vectors(pairs: DataFrame, nodes: DataFrame, *, width: int = 16, rounds: int = 4, seed: int = 42) -> DataFrame:
    """(id, x): unit vectors of nodes from how often they occur together (a, b, n), by subspace iteration of that symmetric matrix.

    Each round multiplies by a join and a sum and makes the columns orthonormal through their Gram matrix, the only thing the driver
    sees: width times width.  Nodes without company have the vector 0."""
    c = checkpoint(pairs.select("a", "b", F.log1p("n").alias("n")))
    ids = checkpoint(c.select(F.col("a").alias("id")).distinct())
    v = ids.select("id", F.array(*[(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}:{i}"), "id")), 1, 8), 16, 10).cast("double") / F.lit(2.0**31) - 1) for i in range(width)]).alias("x"))
    for k in range(rounds):
        y = c.join(v.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(*[F.sum(F.col("n") * F.col("x")[i]).alias(f"y{i}") for i in range(width)])
        y = checkpoint(y.select("id", F.array(*[f"y{i}" for i in range(width)]).alias("x")))
        if k == rounds - 1:
            v = y
            break
        gram = y.agg(*[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"g{i}_{j}") for i in range(width) for j in range(i, width)]).first()
        g = np.zeros((width, width))
        for i in range(width):
            for j in range(i, width):
                g[i, j] = g[j, i] = gram[f"g{i}_{j}"] or 0.0
        values, vectors = np.linalg.eigh(g)
        scale = np.where(values > 1e-12 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
        v = linear(y, [("x", vectors * scale)], "h", relu=False).select("id", F.col("h").alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, e: s + e * e))
    unit = v.select("id", F.when(norm > 0, F.transform("x", lambda e: e / norm)).otherwise(F.col("x")).alias("x"))
    zero = F.array(*[F.lit(0.0)] * width)
    return nodes.select("id").distinct().join(unit, "id", "left").select("id", F.coalesce("x", zero).alias("x"))


def random_walks(kg: KnowledgeGraph, *, walks: int = 12, length: int = 10, seed: int = 42) -> DataFrame:
    """Uniform walks: (walk, start, pos, id).  Each step picks the neighbour whose number the walk's draw names.

    Neighbours are numbered in windows by node and joined on (node, number), so no walk meets all neighbours of a hub."""
    pairs = kg.neighbour_pairs()
    near = checkpoint(pairs.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("other")) - 1))
    size = checkpoint(near.groupBy("id").agg(F.count(F.lit(1)).alias("n")))
    at = size.select("id").withColumn("walk", F.explode(F.sequence(F.lit(1), F.lit(walks)))).select("walk", F.col("id").alias("start"), F.lit(0).alias("pos"), "id")
    out = at
    for pos in range(1, length):
        k = F.pmod(draw(seed, "start", "walk", "pos"), F.col("n"))
        at = checkpoint(at.join(size, "id").withColumn("k", k).join(near, ["id", "k"]).select("walk", "start", F.lit(pos).alias("pos"), F.col("other").alias("id")))
        out = out.unionByName(at)
    return out


def cooccurrence(walks: DataFrame, *, window: int = 3) -> DataFrame:
    """How often two nodes stand within ``window`` steps of a walk: (a, b, n)."""
    # A walk's steps are brought together once and paired there; of a pair only the order of its ids is counted.
    steps = walks.groupBy("walk", "start").agg(F.collect_list(F.struct("pos", "id")).alias("s"))
    after = lambda x: F.filter("s", lambda y: (y["pos"] > x["pos"]) & (y["pos"] <= x["pos"] + window))
    both = F.transform("s", lambda x: F.transform(after(x), lambda y: F.struct(F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b"))))
    one = steps.select(F.explode(F.flatten(both)).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    own = F.array(F.struct("a", "b", (F.col("n") * 2).alias("n")))
    ways = F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return one.select(F.explode(F.when(F.col("a") == F.col("b"), own).otherwise(ways)).alias("p")).select("p.a", "p.b", "p.n")


def _cumulative(samples: DataFrame) -> DataFrame:
    """By distinct score, from the highest: positives and negatives here and so far."""
    s = samples.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    return running_totals(s, [F.desc("score")], {"tp": "p", "fp": "q"})


def auroc(samples: DataFrame) -> DataFrame:
    """(auroc) of samples (label 0 or 1, score), ties counting half; 0.5 if only one class occurs."""
    c = _cumulative(samples)
    a = c.agg(F.sum(F.col("q") * (F.col("tp") - F.col("p")) + F.col("p") * F.col("q") / 2).alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return a.select(F.when((F.col("np") > 0) & (F.col("nq") > 0), F.col("u") / (F.col("np") * F.col("nq"))).otherwise(0.5).alias("auroc"))


def auprc(samples: DataFrame) -> DataFrame:
    """(auprc): average precision, 0 without positives."""
    c = _cumulative(samples)
    a = c.agg(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s"), F.sum("p").alias("np"))
    return a.select(F.when(F.col("np") > 0, F.col("s") / F.col("np")).otherwise(0.0).alias("auprc"))


def ranking_metrics(samples: DataFrame, *, ks: tuple[int, ...] = (10, 50)) -> DataFrame:
    """(mrr, hits_10, …) over one ranking of all samples (sample, label, score), ties to the greater sample.

    Ranks are running totals over ranges of the ranking."""
    r = running_totals(samples.select("sample", "label", "score", F.lit(1).alias("one")), [F.desc("score"), F.desc("sample")], {"rank": "one"}).filter("label = 1")
    return r.agg(F.coalesce(F.avg(1.0 / F.col("rank")), F.lit(0.0)).alias("mrr"), *[F.coalesce(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"hits_{k}") for k in ks])


def cluster(vectors: DataFrame, *, k: int = 8, seed: int = 42) -> DataFrame:
    """K-means of (id, vector): (id, cluster); k is at most the number of vectors and at least 1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors.filter("vector is not null").select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    n = v.limit(k).count()
    if not n:
        return v.select("id", F.lit(0).alias("cluster"))
    return KMeans(k=max(1, min(k, n)), seed=seed).fit(v).transform(v).select("id", F.col("prediction").alias("cluster"))
