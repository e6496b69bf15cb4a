"""Walks over a graph whose neighbours, as integers, fit every task: what is around nodes, the best edges there, shortest paths.

Nodes are numbered in the order of their ids, so the order of numbers is that of ids.  Beyond a number of edges there are no arrays
(``shared_graph`` gives none) and callers walk by joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import checkpoint

LIMIT = 15_000_000
ROWS = 100_000


def shared_graph(kg, *, limit: int = LIMIT, described: bool = False) -> Broadcast | None:
    """The graph for every task, None beyond ``limit`` edges: ids, and by node where its neighbours start, and the neighbours.

    ``described`` adds the edges between known nodes, the best first (by score, then by source, target and type), as numbers, their types and
    the nodes' names."""
    spark = kg.edges.sparkSession
    # Made distinct by what only the keys' side has, edges are read without the joins of their properties.
    e = checkpoint(kg.edges.select("source_id", "target_id", *(["edge_type", "score"] if described else [])).distinct())
    if e.count() > limit:
        return None
    ids = e.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    if described:
        ids = ids.join(kg.nodes.select("id", F.coalesce("name", "id").alias("label")), "id", "left")
    nodes = ids.toArrow()
    nodes = nodes.take(pc.sort_indices(nodes, sort_keys=[("id", "ascending")])).combine_chunks()
    names = nodes["id"].combine_chunks().cast(pa.string())
    kinds = e.select("edge_type").distinct().toArrow()["edge_type"].combine_chunks().sort() if described else None
    coding = spark.sparkContext.broadcast((names, kinds))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = coding.value
        for t in _tables(batches):
            out = [pc.index_in(t[c].combine_chunks(), names) for c in ("source_id", "target_id")]
            if kinds is not None:
                out += [pc.index_in(t["edge_type"].combine_chunks(), kinds), t["score"].combine_chunks()]
            yield pa.RecordBatch.from_arrays(out, names=["a", "b", "kind", "score"][: len(out)])

    coded = checkpoint(e.mapInArrow(code, "a int, b int" + (", kind int, score double" if described else "")))
    # Sorted before they come here: the driver holds what it sends out and no more.
    both = coded.filter("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")
    lists = both.groupBy("a").agg(F.collect_set("b").alias("b")).orderBy("a").toArrow()
    many = np.zeros(len(names), np.int64)
    many[lists["a"].to_numpy()] = pc.list_value_length(lists["b"]).to_numpy()
    indptr, indices = np.concatenate([[0], np.cumsum(many)]), pc.list_flatten(lists["b"]).to_numpy()
    if not described:
        return spark.sparkContext.broadcast((names, indptr, indices))
    labels = nodes["label"].combine_chunks().cast(pa.string())
    edges = coded.orderBy(F.desc("score"), "a", "b", "kind").select("a", "b", "kind").toArrow()
    a, b, kind = (edges[c].to_numpy() for c in ("a", "b", "kind"))
    known = np.asarray(labels.is_valid())
    if not known.all():
        told = known[a] & known[b]
        a, b, kind = a[told], b[told], kind[told]
    return spark.sparkContext.broadcast((names, indptr, indices, a, b, kind, kinds, labels))


def _tables(batches: Iterator[pa.RecordBatch], rows: int = 1_000_000) -> Iterator[pa.Table]:
    """Batches put together to about ``rows`` rows, for what is prepared once a table."""
    held, size = [], 0
    for x in batches:
        held.append(x)
        size += x.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


class _Ball:
    """What is around sets of nodes, level by level; the arrays are made once a task and cleaned by what was touched."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray):
        self.indptr, self.indices = indptr, indices
        n = len(indptr) - 1
        self.seen, self.here, self.mark = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int32)

    def _once(self, at: np.ndarray) -> np.ndarray:
        count = np.arange(len(at), dtype=np.int32)
        self.mark[at] = count
        return at[self.mark[at] == count]

    def _steps(self, nodes: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Places of the neighbours of nodes, one node's after another's."""
        return np.repeat(self.indptr[nodes] - np.cumsum(many) + many, many) + np.arange(many.sum())

    def levels(self, seeds: np.ndarray, radius: int, wanted: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """Nodes by level, seeds first.  Where the nodes not seen yet have fewer neighbours than the front, they look for it instead.

        ``wanted`` says what is of use at the last level; others may be missing there, but none before."""
        front, level = self._once(seeds), 0
        while len(front):
            self.seen[front] = True
            yield front
            if level == radius:
                return
            level += 1
            many = self.indptr[front + 1] - self.indptr[front]
            size = many.sum()
            if size > len(self.seen):
                rest = np.flatnonzero(~self.seen if wanted is None or level < radius else wanted & ~self.seen)
                its = self.indptr[rest + 1] - self.indptr[rest]
                if its.sum() < size:
                    rest, its = rest[its > 0], its[its > 0]
                    self.here[front] = True
                    met = np.add.reduceat(self.here[self.indices[self._steps(rest, its)]], np.cumsum(its) - its, dtype=np.int32) > 0 if len(rest) else rest > 0
                    self.here[front] = False
                    front = rest[met].astype(front.dtype)
                    continue
            b = self.indices[self._steps(front, many)]
            front = self._once(b[~self.seen[b]])

    def clean(self, levels: list[np.ndarray]) -> None:
        for front in levels:
            self.seen[front] = False


def _groups(groups: DataFrame) -> DataFrame:
    """(key, ids) of groups (key, id), spread over tasks whatever their size, as few groups may be much work.

    Without a key: a partitioning by the key is there already and would be coalesced to one task."""
    parts = max(12, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return groups.select("key", "id").distinct().groupBy("key").agg(F.collect_list("id").alias("ids")).repartition(parts)


def _numbered(batches: Iterator[pa.RecordBatch], names: pa.Array) -> Iterator[tuple[pa.Array, int, np.ndarray, pa.Array]]:
    """By row of (key, ids): the keys, its place among them, the numbers of its ids and those ids that have none."""
    for t in _tables(batches, 20_000):
        keys, ids = t["key"].combine_chunks(), t["ids"].combine_chunks()
        starts, flat = ids.offsets.to_numpy(), ids.values
        found = pc.fill_null(pc.index_in(flat, names), -1).to_numpy()
        for k in range(len(keys)):
            own = found[starts[k] : starts[k + 1]]
            yield keys, k, own[own >= 0], flat.slice(starts[k], len(own)).filter(pa.array(own < 0))


def around(groups: DataFrame, shared: Broadcast, *, radius: int, least: int = 0, among: DataFrame | None = None) -> DataFrame:
    """Nodes within ``radius`` undirected steps of the ids of each group (key, id), and at ``least`` so far: (key, id, level), each at its least level.

    ``among`` (id) says which nodes count as found; walks go through others as well."""
    spark = groups.sparkSession
    wanted = None
    if among is not None:
        names = shared.value[0]
        some = pc.index_in(among.select("id").distinct().toArrow()["id"].combine_chunks().cast(pa.string()), names).drop_null().to_numpy()
        mask = np.zeros(len(names), bool)
        mask[some] = True
        wanted = spark.sparkContext.broadcast(mask)
        lone = checkpoint(among.select("id").distinct()) if least == 0 else None
    schema = T.StructType([T.StructField("key", groups.schema["key"].dataType), T.StructField("id", T.StringType()), T.StructField("level", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, indptr, indices = shared.value[:3]
        ball, held, size = _Ball(indptr, indices), [], 0
        for keys, k, seeds, others in _numbered(batches, names):
            levels = list(ball.levels(seeds, radius, None if wanted is None else wanted.value))
            ball.clean(levels)
            for level, front in enumerate(levels):
                front = front if wanted is None else front[wanted.value[front]]
                if level >= least and len(front):
                    held.append((keys[k], level, names.take(pa.array(front))))
                    size += len(front)
            if least == 0 and len(others):
                held.append((keys[k], 0, others))
            if size >= ROWS:
                yield _rows(held, keys.type)
                held, size = [], 0
        if held:
            yield _rows(held, keys.type)

    out = _groups(groups).mapInArrow(run, schema)
    # Seeds without an edge have no number.
    return out if among is None or lone is None else out.join(lone, "id", "left_semi").select("key", "id", "level")


def _rows(held: list, kind: pa.DataType) -> pa.RecordBatch:
    many = [len(x) for _, _, x in held]
    keys = pa.array([k.as_py() for k, _, _ in held], kind).take(pa.array(np.repeat(np.arange(len(held)), many)))
    return pa.RecordBatch.from_arrays([keys, pa.concat_arrays([x for _, _, x in held]), pa.array(np.repeat(np.array([level for _, level, _ in held], np.int32), many))], names=["key", "id", "level"])


def best_edges(groups: DataFrame, shared: Broadcast, *, radius: int, limit: int) -> DataFrame:
    """Around each group (key, id) of known nodes: (key, size, triples), the number of nodes and the ``limit`` best edges among them as text.

    Edges are looked through from the best on until ``limit`` are found, all of them if need be."""
    schema = T.StructType([T.StructField("key", groups.schema["key"].dataType), T.StructField("size", T.LongType()), T.StructField("triples", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, indptr, indices, a, b, kind, kinds, labels = shared.value
        ball = _Ball(indptr, indices)
        for keys, k, seeds, others in _numbered(batches, names):
            levels = list(ball.levels(seeds, radius))
            best, many, at, step = [], 0, 0, 4096
            while at < len(a) and many < limit and levels:
                inside = np.flatnonzero(ball.seen[a[at : at + step]] & ball.seen[b[at : at + step]]) + at
                best.append(inside[: limit - many])
                many += len(best[-1])
                at, step = at + step, min(2 * step, 1 << 20)
            ball.clean(levels)
            e = np.concatenate(best) if best else np.zeros(0, np.int64)
            text = pc.binary_join_element_wise(labels.take(pa.array(a[e])), kinds.take(pa.array(kind[e])), labels.take(pa.array(b[e])), " ")
            yield pa.RecordBatch.from_arrays([keys.slice(k, 1), pa.array([sum(map(len, levels)) + len(others)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(text)], pa.int32()), text)], names=["key", "size", "triples"])

    return _groups(groups).mapInArrow(run, schema)


class _Together:
    """Shortest paths to up to 64 nodes at once: levels around them hold a bit for each, so one look at an edge serves all."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, *, block: int = 1 << 20):
        self.indptr, self.indices, self.block = indptr, indices, block
        self.many = np.diff(indptr)
        self.linked = np.flatnonzero(self.many)

    def _blocks(self, sizes: np.ndarray) -> Iterator[slice]:
        """Slices of about ``block`` neighbours each, of one node at least."""
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self.block, "right")))
            yield slice(at, to)
            at = to

    def _near(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of nodes that have some, one node's after another's, and where each node's start."""
        many = self.many[nodes]
        starts = np.cumsum(many) - many
        return self.indices[np.repeat(self.indptr[nodes] - starts, many) + np.arange(many.sum())], starts

    def _met(self, front: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The bits of each node's neighbours."""
        out = np.zeros(len(nodes), np.uint64)
        some = np.flatnonzero(self.many[nodes])
        for part in self._blocks(self.many[nodes[some]]):
            near, starts = self._near(nodes[some[part]])
            out[some[part]] = np.bitwise_or.reduceat(front[near], starts)
        return out

    def _step(self, front: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The next level: fronts of few neighbours tell them, otherwise all nodes look at theirs."""
        new, at = np.zeros_like(front), np.flatnonzero(front)
        many = self.many[at]
        if many.sum() * 8 < len(self.indices):
            near, bits = self._near(at)[0], np.repeat(front[at], many)
            order = np.argsort(near, kind="stable")
            near, bits = near[order], bits[order]
            first = np.flatnonzero(np.diff(near, prepend=-1))
            if len(first):
                new[near[first]] = np.bitwise_or.reduceat(bits, first)
        else:
            # Nodes without neighbours take no place, so each node's end where the next one's start.
            for part in self._blocks(self.many[self.linked]):
                nodes = self.linked[part]
                start = self.indptr[nodes[0]]
                new[nodes] = np.bitwise_or.reduceat(front[self.indices[start : self.indptr[nodes[-1] + 1]]], self.indptr[nodes] - start)
        new &= ~seen
        return new

    def _next(self, level: np.ndarray, nodes: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The first neighbour of each node that has the bit on the level; there is one."""
        keys, back = np.unique(nodes.astype(np.int64) * 64 + bit, return_inverse=True)
        nodes, bit = keys // 64, (keys % 64).astype(np.uint64)
        out = np.zeros(len(keys), np.int64)
        hub = self.many[nodes] > 1024
        for node in np.unique(nodes[hub]):
            near = self.indices[self.indptr[node] : self.indptr[node + 1]]
            bits = level[near]
            near, bits = near[bits > 0], bits[bits > 0]
            for k in np.flatnonzero(nodes == node):
                out[k] = near[(bits >> bit[k]) & np.uint64(1) > 0].min()
        rest = np.flatnonzero(~hub)
        for part in self._blocks(self.many[nodes[rest]]):
            own = rest[part]
            near, starts = self._near(nodes[own])
            there = (level[near] >> np.repeat(bit[own], self.many[nodes[own]])) & np.uint64(1) > 0
            out[own] = np.minimum.reduceat(np.where(there, near, len(level)), starts)
        return out[back]

    def paths(self, targets: np.ndarray, source: np.ndarray, bit: np.ndarray, max_length: int) -> Iterator[np.ndarray]:
        """Of sources and the places of their targets among up to 64 different ones: by length the paths, a row each."""
        ones = np.uint64(1) << bit.astype(np.uint64)
        seen = np.zeros(len(self.many), np.uint64)
        seen[targets] = np.uint64(1) << np.arange(len(targets), dtype=np.uint64)
        levels, far = [seen.copy()], np.full(len(source), -1)
        for length in range(1, max_length + 1):
            # Sources look first: the level of the farthest is never made.
            left = np.flatnonzero(far < 0)
            nodes, back = np.unique(source[left], return_inverse=True)
            hit = self._met(levels[-1], nodes)[back] & ones[left] > 0
            far[left[hit]] = length
            if hit.all() or length == max_length:
                break
            new = self._step(levels[-1], seen)
            if not new.any():
                break
            seen |= new
            levels.append(new)
        for length in range(1, far.max(initial=-1) + 1):
            own = np.flatnonzero(far == length)
            path = np.empty((len(own), length + 1), np.int64)
            path[:, 0], path[:, -1] = source[own], targets[bit[own]]
            for k in range(1, length):
                path[:, k] = self._next(levels[length - k], path[:, k - 1], bit[own])
            if len(own):
                yield path


def paths(pairs: DataFrame, shared: Broadcast, *, max_length: int) -> DataFrame:
    """A shortest undirected path of each pair (source, target) of different ids, of equals the first in the order of its ids: (source, target, length, path).

    Steps are counted from 64 targets at once until all their sources are reached; from a source each step goes to the first node that is one nearer."""
    schema = "source string, target string, length int, path array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, indptr, indices = shared.value[:3]
        walk = _Together(indptr, indices)
        for t in _tables(batches, 20_000):
            target = pc.fill_null(pc.index_in(t["key"].combine_chunks(), names), -1).to_numpy()
            ids = t["ids"].combine_chunks()
            starts, source = ids.offsets.to_numpy(), pc.fill_null(pc.index_in(ids.values, names), -1).to_numpy()
            known = np.flatnonzero(target >= 0)
            for at in range(0, len(known), 64):
                own = known[at : at + 64]
                bit = np.repeat(np.arange(len(own)), starts[own + 1] - starts[own])
                ends = np.concatenate([source[starts[k] : starts[k + 1]] for k in own])
                for p in walk.paths(target[own], ends[ends >= 0], bit[ends >= 0], max_length):
                    for part in range(0, len(p), ROWS):
                        rows = p[part : part + ROWS]
                        flat, size = names.take(pa.array(rows.ravel())), rows.shape[1]
                        offsets = pa.array(np.arange(0, rows.size + 1, size, dtype=np.int32))
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(rows[:, 0])), names.take(pa.array(rows[:, -1])), pa.array(np.full(len(rows), size - 1, np.int32)), pa.ListArray.from_arrays(offsets, flat)], names=["source", "target", "length", "path"])

    return _groups(pairs.filter("source <> target").select(F.col("target").alias("key"), F.col("source").alias("id"))).mapInArrow(run, schema)
