"""Approximate nearest neighbours: NN-descent by Spark joins, and greedy search of the graph.

Equal vectors are one node, with the smallest ids of its members.  The graph starts from chunks of nodes that stand next to
each other when sorted by the signs of random projections, several times over.  Then each round joins every node with its
neighbours and with the nearest of the nodes it neighbours, and compares these with one another: neighbours of neighbours.
Only pairs of which one has come since the last round are compared, whatever is nearer than a node's worst neighbour is
proposed, and each node keeps the nearest it has seen; rounds go on until hardly any neighbour is new.  A node that many
name is reduced to its nearest namers in every task before anything is sent.  A search holds a beam for each query; each hop
joins its unexpanded nodes with the graph, then their neighbours with the vectors, and keeps the nearest, until nothing in the
beam is unexpanded.

Graph and beam compare vectors in half precision, each scaled by its own largest component, in double arithmetic; so vectors of
any size can stand in one table.  What a search finds is ranked by distances in double precision on the vectors as given.
Every valid vector is in the graph.  A query that finds fewer than k is answered by a scan, so small or parted graphs lose
nothing.  Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those of
another length than the most common (of equally common lengths the largest).  Rows that repeat an id and a vector are one;
distances tie to the smaller id.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, partitions, written
from quire.llm.words import U, mix

DEGREE = 28
TREES = 4
CHUNK = 1024
#: Blocks of a tree's order, at most.
BLOCKS = 2048
#: Rounds end when this part of all neighbours, or less, is new.
SETTLED = 0.01
BEAM = 320
QUERY_BLOCK = 2048


def usable(v: Column) -> Column:
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0), F.lit(False))


def valid_vectors(vectors: DataFrame, wanted: Column, vec_id: str, vector: str) -> DataFrame:
    """(id, x, wanted): the vectors that take part, of one length."""
    some = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), wanted.alias("wanted")).filter(F.col("id").isNotNull() & usable(F.col("x")))
    size = some.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return some.filter(F.size("x") == (size["n"] if size else 0))


def nodes(valid: DataFrame, k: int) -> DataFrame:
    """(node, x, ids): distinct vectors, the smallest id of each, and its k + 1 smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            if not len(ids):
                continue
            x = lists.flatten().to_numpy().reshape(len(ids), -1) + 0.0
            raw = np.ascontiguousarray(x).view(f"V{x.shape[1] * 8}").ravel()
            _, group = np.unique(raw, return_inverse=True)
            order = np.lexsort((ids, group))
            g = group[order]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
            keep = rank <= k
            counts = np.bincount(np.cumsum(rank == 0)[keep] - 1, minlength=len(first))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[order][keep]))
            yield pa.RecordBatch.from_arrays([lists.take(pa.array(order[first])), out], names=["x", "ids"])

    part = valid.select("id", "x").mapInArrow(run, "x array<double>, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return part.groupBy("x").agg(ids.alias("ids")).select(F.element_at("ids", 1).alias("node"), "x", "ids")


def _grouped(fn: Callable[[list[pa.Array], np.ndarray], pa.RecordBatch], key: str):
    """For mapInArrow over rows sorted by key: fn(table, begins of its groups), each group whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            g = t.column(key).to_numpy()
            change = np.flatnonzero(g[1:] != g[:-1])
            if not len(change):
                held = t
                continue
            n = int(change[-1]) + 1
            yield fn(t.slice(0, n).combine_chunks(), np.concatenate([[0], change[:-1] + 1, [n]]))
            held = t.slice(n)
        if held is not None and held.num_rows:
            yield fn(held.combine_chunks(), np.array([0, held.num_rows]))

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, x) to (node, s, z): the largest component, and all over it in half precision."""
    for batch in batches:
        n = batch.num_rows
        if n:
            x = batch.column(1).flatten().to_numpy().reshape(n, -1)
            s = np.abs(x).max(axis=1)
            z = (x / s[:, None]).astype(np.float16)
            data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * z.shape[1] * 2, z.shape[1] * 2, dtype=np.int32)), pa.py_buffer(z.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), data], names=["node", "s", "z"])


def _vectors(t: pa.Table, s: str = "s", z: str = "z") -> np.ndarray:
    scale, col = t.column(s).to_numpy(), t.column(z).combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.float16)[at[0] // 2 : at[-1] // 2]
    return data.reshape(len(col), -1).astype(np.float64) * scale[:, None]


def nearest_of(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k nearest others, nearest first, and squared distances from differences: these are the same for a
    pair wherever it is computed."""
    norm = np.square(x).sum(axis=1)
    d = norm[:, None] + norm[None, :] - 2 * (x @ x.T)
    np.fill_diagonal(d, np.inf)
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    exact = np.square(x[:, None, :] - x[near]).sum(axis=2)
    order = np.argsort(exact, axis=1, kind="stable")
    return np.take_along_axis(near, order, 1), np.take_along_axis(exact, order, 1)


EDGE = "u long, d double, v long, new boolean"


def _first(t: pa.Table, degree: int, by: str = "u") -> pa.Table:
    """Of rows in any order, the `degree` nearest different ones of each; of equal ones that which is not new."""
    u, d, v, new = (t.column(c).to_numpy(zero_copy_only=False) for c in (by, "d", "v" if by == "u" else "u", "new"))
    order = np.lexsort((new, v, d, u))
    u, d, v = u[order], d[order], v[order]
    other = np.ones(len(u), bool)
    other[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    order, u = order[other], u[other]
    begin = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
    rank = np.arange(len(u)) - np.repeat(begin, np.diff(np.append(begin, len(u))))
    return t.take(pa.array(order[rank < degree]))


def _reduced(degree: int, by: str):
    """In a task, the nearest of each: before rows are sent, and, where a task has all rows of a node, after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, kept = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > kept * 2 + (1 << 20):
                t = _first(pa.Table.from_batches(held), degree, by)
                held, rows, kept = t.to_batches(), t.num_rows, t.num_rows
        if rows:
            yield from _first(pa.Table.from_batches(held), degree, by).to_batches()

    return run


def _nearest_of(fn, degree: int):
    """For mapInArrow: the rows that fn makes, reduced in the same pass."""
    reduced = _reduced(degree, "u")
    return lambda batches: reduced(fn(batches))


def nearest_rows(edges: DataFrame, degree: int) -> DataFrame:
    """The `degree` nearest rows of each node; edges: reduced in their tasks already."""
    return edges.repartition(partitions(edges.sparkSession), "u").mapInArrow(_reduced(degree, "u"), EDGE)


def start(points: DataFrame, trees: int, chunk: int, degree: int, seed: int = 11) -> DataFrame:
    """Edges from neighbours in the order of random projections' signs.  Blocks are cut at quantiles of that order and have a
    chunk's size while BLOCKS suffice, larger ones are parted in their task: chunks do not follow the number of tasks."""
    n = partitions(points.sparkSession)
    blocks = min(BLOCKS, max(1, points.count() // chunk))

    def places(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """Of each tree the places in its order: 32 signs, then 31 bits of the node's hash."""
        x = _vectors(pa.Table.from_batches([batch]))
        x /= np.abs(x).max(axis=1, keepdims=True)  # only signs count
        tail = (mix(batch.column(0).to_numpy().view(U)) >> U(33)).astype(np.int64)
        for tree in range(trees):
            planes = np.random.default_rng([seed, tree]).standard_normal((x.shape[1], 32))
            bits = (x @ planes > 0).astype(np.int64)
            yield tree, (bits @ (1 << np.arange(31, -1, -1, dtype=np.int64))) << 31 | tail

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for tree, at in places(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree, np.int32)), pa.array(at)], names=["tree", "at"])

    bounds = {}
    if blocks > 1:
        cuts = F.percentile_approx("at", [i / blocks for i in range(1, blocks)], 16 * blocks)
        bounds = {r["tree"]: np.array(r["cuts"], np.int64) for r in points.mapInArrow(placed, "tree int, at long").groupBy("tree").agg(cuts.alias("cuts")).collect()}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for tree, at in places(batch):
                    block = tree * blocks + (np.searchsorted(bounds[tree], at) if bounds else np.zeros(len(at), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(at), *batch.columns], names=["block", "at", "node", "s", "z"])

    def near(t: pa.Table, begin: np.ndarray) -> pa.RecordBatch:
        x, ids = _vectors(t), t.column("node").to_numpy()
        made = []
        for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            parts = max(1, (hi - lo) // chunk)
            for i in range(parts):
                a, b = lo + (hi - lo) * i // parts, lo + (hi - lo) * (i + 1) // parts
                k = min(degree, b - a - 1)
                if k > 0:
                    best, d = nearest_of(x[a:b], k)
                    made.append((np.repeat(ids[a:b], k), d.ravel(), ids[a:b][best].ravel()))
        u, d, v = (np.concatenate(m) for m in zip(*made, strict=True)) if made else (np.zeros(0, t) for t in (np.int64, np.float64, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(d), pa.array(v), pa.array(np.ones(len(u), bool))], names=["u", "d", "v", "new"])

    rows = points.mapInArrow(dealt, "block long, at long, node long, s double, z binary").repartition(n, "block").sortWithinPartitions("block", "at", "node")
    return nearest_rows(rows.mapInArrow(_nearest_of(_grouped(near, "block"), degree), EDGE), degree).filter("u <> v")


def around(graph: DataFrame, degree: int, live: bool = False) -> DataFrame:
    """(w, m, new): each node with its neighbours, and with the nearest of the nodes that have it as a neighbour; in order of
    w and m, and in one task for each w.  live: only of nodes with something new around them."""
    namers = graph.mapInArrow(_reduced(degree, "v"), EDGE)
    both = graph.select(F.col("u").alias("w"), "d", F.col("v").alias("m"), "new", F.lit(False).alias("back"))
    both = both.union(namers.select(F.col("v").alias("w"), "d", F.col("u").alias("m"), "new", F.lit(True).alias("back")))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        w, d, m, new, back = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in range(5))
        order = np.lexsort((m, d, w, back))
        w, m, new, back = w[order], m[order], new[order], back[order]
        begin = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (back[1:] != back[:-1])]))
        few = ~back | (np.arange(len(w)) - np.repeat(begin, np.diff(np.append(begin, len(w)))) < degree)
        w, m, new = w[few], m[few], new[few]
        order = np.lexsort((~new, m, w))
        w, m, new = w[order], m[order], new[order]
        keep = np.ones(len(w), bool)
        keep[1:] = (w[1:] != w[:-1]) | (m[1:] != m[:-1])
        if live:
            begin = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            keep &= np.repeat(np.maximum.reduceat(new, begin), np.diff(np.append(begin, len(w))))
        yield from pa.table([w[keep], m[keep], new[keep]], names=["w", "m", "new"]).to_batches(1 << 16)

    return both.repartition(partitions(graph.sparkSession), "w").mapInArrow(once, "w long, m long, new boolean")


def descend(graph: DataFrame, points: DataFrame, degree: int) -> DataFrame:
    """One round of NN-descent: the graph after it, written."""
    n = partitions(points.sparkSession)
    worst = graph.groupBy("u").agg(F.when(F.count("*") >= degree, F.max("d")).otherwise(float("inf")).alias("worst"))
    at = points.join(worst, points["node"] == worst["u"], "left").select("node", "s", "z", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
    members = around(graph, degree, live=True)
    met = members.join(at, members["m"] == at["node"]).select("w", "m", "new", "worst", "s", "z")

    def joined(t: pa.Table, begin: np.ndarray) -> pa.RecordBatch:
        x, ids, worst, new = _vectors(t), *(t.column(c).to_numpy(zero_copy_only=False) for c in ("m", "worst", "new"))
        a, b, dist = [], [], []
        for s, e in zip(begin[:-1], begin[1:], strict=True):
            if e - s < 2:
                continue
            own = x[s:e]
            norm = np.square(own).sum(axis=1)
            d = norm[:, None] + norm[None, :] - 2 * (own @ own.T)
            fresh = new[s:e, None] | new[None, s:e]
            near = fresh & (d < worst[s:e, None] * (1 + 1e-9) + 1e-9 * (norm[:, None] + norm[None, :]))
            np.fill_diagonal(near, False)
            i, j = np.nonzero(near)
            exact = np.square(own[i] - own[j]).sum(axis=1)
            keep = exact < worst[s:e][i]
            a.append(ids[s + i[keep]])
            b.append(ids[s + j[keep]])
            dist.append(exact[keep])
        cat = lambda v, t: np.concatenate(v) if v else np.zeros(0, t)
        a = cat(a, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(cat(dist, np.float64)), pa.array(cat(b, np.int64)), pa.array(np.ones(len(a), bool))], names=["u", "d", "v", "new"])

    found = met.repartition(n, "w").sortWithinPartitions("w", "m").mapInArrow(_nearest_of(_grouped(joined, "w"), degree), EDGE)
    old = graph.select("u", "d", "v", F.lit(False).alias("new"))
    return written(nearest_rows(old.union(found), degree), "graph")


def build(distinct: DataFrame, degree: int = DEGREE, trees: int = TREES, chunk: int = CHUNK, settled: float = SETTLED) -> tuple[DataFrame, DataFrame]:
    """Of nodes (node, x, ...): points (node, s, z), and the graph (u, d, v, new), each node's nearest found.  Distances only
    become less, so the rounds end."""
    points = written(distinct.select("node", "x").mapInArrow(_packed, "node long, s double, z binary"), "points")
    graph = written(start(points, trees, chunk, degree), "graph")
    total = graph.count()
    while graph.filter("new").count() > settled * total:
        graph = descend(graph, points, degree)
    return points, graph


def search(graph: DataFrame, points: DataFrame, entries: DataFrame, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """(q, near): the nodes in the beam of each query at the end, as array<struct<d, u>>.
    entries: (q, s, z, entry), entry being an array of nodes, and the query as points have theirs.  What a beam has not expanded yet
    is new; a hop expands all of it.  What has left a beam is farther than all in it ever after and does not return, so the
    search ends."""
    n = partitions(points.sparkSession)
    vectors = points.select(F.col("node").alias("n"), F.col("s").alias("t"), F.col("z").alias("y"))
    links = written(around(graph, degree).select(F.col("w").alias("n"), F.col("m").alias("to")), "links")
    entries = written(entries, "entries")
    asked = entries.select(F.col("q").alias("_q"), "s", "z")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                d = np.sqrt(np.square(_vectors(t) - _vectors(t, "t", "y")).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d), batch.column(1), pa.array(np.ones(len(d), bool))], names=["u", "d", "v", "new"])

    def distance(pairs: DataFrame) -> DataFrame:
        once = pairs.repartition(n, "u").distinct()
        met = once.join(vectors, once["u"] == vectors["n"]).join(asked, F.col("q") == F.col("_q")).select("q", "u", "s", "z", "t", "y")
        return met.mapInArrow(_nearest_of(measured, beam), EDGE)

    def beams(rows: DataFrame) -> DataFrame:
        once = rows.repartition(n, "u").groupBy("u", "v").agg(F.min("d").alias("d"), F.bool_and("new").alias("new"))
        held = once.groupBy(F.col("u").alias("q")).agg(F.slice(F.array_sort(F.collect_list(F.struct("d", F.col("v").alias("u"), "new"))), 1, beam).alias("near"))
        return written(held, "beam")

    state = beams(distance(entries.select("q", F.explode("entry").alias("u"))))
    while state.filter(F.exists("near", lambda e: e["new"])).limit(1).count():
        each = state.select("q", F.explode("near").alias("e"))
        go = each.filter("e.new").select("q", F.col("e.u").alias("at"))
        found = go.join(links, go["at"] == links["n"]).select("q", F.col("to").alias("u"))
        old = each.select(F.col("q").alias("u"), "e.d", F.col("e.u").alias("v"), F.lit(False).alias("new"))
        state = beams(old.union(distance(found)))
    return state.select("q", F.transform("near", lambda e: F.struct(e["d"].alias("d"), e["u"].alias("u"))).alias("near"))


def reranked(found: DataFrame, distinct: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, near): the k + 1 nearest of what a search found, by Euclidean distance in double precision on the vectors as given."""
    pairs = found.select("q", F.explode(F.slice("near", 1, 4 * (k + 1))).alias("e")).select("q", "e.u")
    vectors = distinct.select(F.col("node").alias("n"), F.col("x").alias("y"))
    met = pairs.join(vectors, pairs["u"] == vectors["n"]).join(queries.select(F.col("q").alias("_q"), "x"), F.col("q") == F.col("_q")).select("q", "u", "x", "y")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(batch.schema.get_field_index(c)).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("x", "y"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.sqrt(np.square(y - x).sum(axis=1))), batch.column(1)], names=["q", "d", "u"])

    got = met.mapInArrow(measured, "q long, d double, u long")
    return got.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "u"))), 1, k + 1).alias("near"))


def exact(distinct: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(q, near) by scanning all nodes, for blocks of queries (q, x): what the search is measured by, and what mends it."""
    kind = "array<struct<d:double,u:long>>"
    total = queries.count()
    blocks = -(-total // block)
    out = None
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "x").collect()
        q, x = np.array([r["q"] for r in own], np.int64), np.array([r["x"] for r in own], np.float64)

        def run(batches: Iterator[pa.RecordBatch], q=q, x=x) -> Iterator[pa.RecordBatch]:
            if not len(q):
                return
            d_best, u_best = np.full((len(q), 0), np.inf), np.zeros((len(q), 0), np.int64)
            for batch in batches:
                u = batch.column(0).to_numpy()
                y = batch.column(1).flatten().to_numpy().reshape(len(u), -1)
                for i in range(0, len(u), 1024):
                    d = np.stack([np.sqrt(np.square(y[i : i + 1024] - v).sum(axis=1)) for v in x])
                    d_all = np.concatenate([d_best, d], axis=1)
                    u_all = np.concatenate([u_best, np.broadcast_to(u[i : i + 1024], d.shape)], axis=1)
                    best = np.lexsort((u_all, d_all), axis=1)[:, : k + 1]
                    d_best, u_best = np.take_along_axis(d_all, best, 1), np.take_along_axis(u_all, best, 1)
            n = d_best.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, n)), pa.array(d_best.ravel()), pa.array(u_best.ravel())], names=["q", "d", "u"])

        got = distinct.select("node", "x").mapInArrow(run, "q long, d double, u long")
        got = got.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "u"))), 1, k + 1).alias("near"))
        out = got if out is None else out.union(got)
    return out if out is not None else queries.select("q", F.array().cast(kind).alias("near")).limit(0)


def neighbours(vectors: DataFrame, wanted: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, scan: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which `wanted` holds, its own id left out.
    scan: answer by the scan alone (to measure recall)."""
    bounded_batches(vectors.sparkSession)
    valid = valid_vectors(vectors, wanted, vec_id, vector)
    distinct = written(nodes(valid, k), "nodes")
    asked = valid.filter("wanted").select(F.col("id").alias("query_id"), "x").distinct()
    asked = written(asked.join(distinct.select("node", "x"), "x").select("query_id", "node"), "asked")
    # equal vectors ask once
    queries = written(asked.select("node").distinct().join(distinct.select("node", "x"), "node").select(F.col("node").alias("q"), "x"), "queries")
    if scan:
        near = exact(distinct, queries, k)
    else:
        points, graph = build(distinct)
        entries = queries.select("q").join(points, F.col("q") == F.col("node")).select("q", "s", "z", F.array("node").alias("entry"))
        near = written(reranked(search(graph, points, entries), distinct, queries, k), "found")
        enough = min(k + 1, distinct.count())
        short = written(queries.join(near.filter(F.size("near") >= enough).select("q"), "q", "left_anti"), "short")
        near = near.join(short, "q", "left_anti").union(exact(distinct, short, k))
    ids = distinct.select("node", "ids")
    each = near.select("q", F.explode("near").alias("e")).select("q", "e.d", "e.u")
    each = each.join(ids, each["u"] == ids["node"]).select("q", "d", F.explode("ids").alias("id"))
    # of equal vectors k + 1 ids are enough: k if the query is none of them
    lists = each.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, k + 1 + k).alias("l"))
    ranked = asked.join(lists, asked["node"] == lists["q"]).select("query_id", F.slice(F.filter("l", lambda e: e["id"] != F.col("query_id")), 1, k).alias("l"))
    return ranked.select("query_id", F.posexplode("l").alias("p", "e")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), F.col("e.d").alias("score"))
