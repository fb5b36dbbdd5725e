"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy graph search.

Method
    Equal vectors are one node. Each node starts with the best of a few random leaves (vectors on the same side of random
    planes). In each iteration a node gets a sample of its neighbours and of the nodes that have it as a neighbour,
    with their vectors, by joins, and introduces them to one another where one of the two is new: neighbours of neighbours become neighbours if
    they are nearer than the farthest so far. Samples are of fixed size, so a hub costs no more than another node.
    A query walks the graph: it keeps the EF best nodes seen, and in each round expands the best EXPAND that it has not expanded, until
    all are. Graph and walk use unit vectors of 16-bit integers; the results are measured on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import map_batches, materialize, prepare, task_count

NEIGHBOURS, SAMPLE, ITERATIONS = 48, 16, 16
TREES, LEAF = 8, 128
EF, EXPAND = 96, 16
#: Cosines of 16-bit vectors are off by less than this; what may be among the nearest within it is measured on the original vectors.
MARGIN = 2e-4
#: The graph is done when so few of its edges are new.
SETTLED = 0.1
SEED = 5
GRAPH = "u bigint, ids array<bigint>, sims array<float>, fresh array<boolean>"


def _lists(column: pa.ListArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and each list's length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.diff(column.offsets.to_numpy())


def _list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(values, kind))


def _graph_batch(u: np.ndarray, v: np.ndarray, s: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
    """Rows of GRAPH from edges that are sorted by u."""
    nodes, lengths = np.unique(u, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _list_column(v, lengths, pa.int64()), _list_column(s, lengths, pa.float32()), _list_column(fresh, lengths, pa.bool_())], ["u", "ids", "sims", "fresh"])


def _units(column: pa.Array) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), "<i2").reshape(len(column), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _to_units(batch: pa.RecordBatch) -> pa.RecordBatch:
    x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
    # 16-bit integers of the vector with its largest component at 32767; the length is taken out again on reading
    x = np.rint(x / np.abs(x).max(1, keepdims=True) * 32767).astype("<i2")
    return pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in x], pa.binary())], ["node", "unit"])


class _Leaves:
    """tree, code, line, node, unit: where random planes put each vector."""

    def __init__(self, bits: int) -> None:
        self.bits = bits

    def __call__(self, batch: pa.RecordBatch) -> pa.Table:
        x = _units(batch.column("unit"))
        planes = np.random.default_rng(SEED).standard_normal((TREES, x.shape[1], self.bits + 1)).astype(np.float32)
        out = []
        for t, p in enumerate(planes):
            y = x @ p
            code = ((y[:, :-1] > 0) * (1 << np.arange(self.bits, dtype=np.int64))).sum(1)
            out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(code, pa.int64()), pa.array(y[:, -1], pa.float32()), batch.column("node"), batch.column("unit")], ["tree", "code", "line", "node", "unit"]))
        return pa.Table.from_batches(out)


def _first_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of tree, code, line: the best neighbours within each LEAF of them."""
    held: pa.Table | None = None

    def leaf(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        node, x = t.column("node").to_numpy(), _units(t.column("unit"))
        s = x @ x.T
        s[node[:, None] == node[None, :]] = -np.inf
        k = min(NEIGHBOURS // 2, len(node) - 1)
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        order = np.argsort(node, kind="stable")
        u = np.repeat(node[order], k)
        v, sims = node[top[order]].ravel(), np.take_along_axis(s, top, 1)[order].ravel()
        ok = np.isfinite(sims)
        return _graph_batch(u[ok], v[ok], sims[ok], np.ones(ok.sum(), bool))

    for batch in batches:
        t = pa.Table.from_batches([batch.select(["node", "unit"])])
        held = t if held is None else pa.concat_tables([held, t])
        while held.num_rows >= 2 * LEAF:
            yield leaf(held.slice(0, LEAF))
            held = held.slice(LEAF)
    if held is not None and held.num_rows > 1:
        yield leaf(held)


def _best(u: np.ndarray, v: np.ndarray, s: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The best edges of each u, sorted; of repeated edges an old one stays."""
    o = np.lexsort((fresh, v, u))
    u, v, s, fresh = u[o], v[o], s[o], fresh[o]
    first = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.zeros(0, bool)
    u, v, s, fresh = u[first], v[first], s[first], fresh[first]
    o = np.lexsort((v, -s, u))
    u, v, s, fresh = u[o], v[o], s[o], fresh[o]
    start = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, int)
    rank = np.arange(len(u)) - np.repeat(start, np.diff(np.r_[start, len(u)]))
    keep = rank < most
    return u[keep], v[keep], s[keep], fresh[keep]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of GRAPH sorted by u: one row for each u."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        v, n = _lists(batch.column("ids"), np.int64)
        s, _ = _lists(batch.column("sims"), np.float32)
        f, _ = _lists(batch.column("fresh"), bool)
        now = [np.repeat(batch.column("u").to_numpy(), n), v, s, f]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        if len(held[0]) and held[0][0] != held[0][-1]:
            done = held[0] != held[0][-1]
            yield _graph_batch(*_best(*(x[done] for x in held), NEIGHBOURS))
            held = [x[~done] for x in held]
        held = list(_best(*held, NEIGHBOURS))  # what repeats of one u add stays bounded
    if held is not None and len(held[0]):
        yield _graph_batch(*_best(*held, NEIGHBOURS))


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """A number for each row by which samples are drawn."""
    with np.errstate(over="ignore"):
        z = np.zeros(len(parts[0]), np.uint64)
        for p in parts:
            z = (z ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            z ^= z >> np.uint64(31)
    return z


class _Edges:
    """GRAPH rows to x, w, fresh, back, draw: x's vector shall come to w, as its neighbour or because w is x's (back).

    marked: instead, the rows with the sampled new neighbours marked as old.
    """

    def __init__(self, turn: int, marked: bool) -> None:
        self.turn, self.marked = turn, marked

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        v, n = _lists(batch.column("ids"), np.int64)
        f, _ = _lists(batch.column("fresh"), bool)
        row = np.repeat(np.arange(batch.num_rows), n)
        nodes = batch.column("u").to_numpy()
        draw = _mixed(nodes[row], v, np.full(len(v), self.turn)) >> np.uint64(1)
        o = np.lexsort((draw, ~f, row))
        group = row[o] * 2 + ~f[o]
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(o) else np.zeros(0, int)
        taken = np.zeros(len(v), bool)
        taken[o] = np.arange(len(o)) - np.repeat(start, np.diff(np.r_[start, len(o)])) < SAMPLE
        if self.marked:
            return pa.RecordBatch.from_arrays([batch.column("u"), batch.column("ids"), batch.column("sims"), _list_column(f & ~taken, n, pa.bool_())], ["u", "ids", "sims", "fresh"])
        u = nodes[row][taken]
        draw = draw[taken].astype(np.int64)
        two = lambda a, b: pa.array(np.concatenate([a, b]))
        return pa.RecordBatch.from_arrays([two(v[taken], u), two(u, v[taken]), two(f[taken], f[taken]), two(np.zeros(len(u), bool), np.ones(len(u), bool)), two(draw, draw)], ["x", "w", "fresh", "back", "draw"])


def _introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows x, fresh, least, unit sorted by w: GRAPH rows of what members of a w's sample can gain from each other."""
    held: pa.Table | None = None
    out: list[np.ndarray] = []

    def group(node: np.ndarray, fresh: np.ndarray, least: np.ndarray, unit: np.ndarray) -> None:
        s = unit @ unit.T
        ok = (fresh[:, None] | fresh[None, :]) & (s > least[:, None]) & (node[:, None] != node[None, :])
        i, j = np.nonzero(ok)
        if len(i):
            out.append(np.rec.fromarrays([node[i], node[j], s[i, j]], names="u,v,s"))

    def flush() -> Iterator[pa.RecordBatch]:
        if out:
            a = np.concatenate(out)
            out.clear()
            yield _graph_batch(*_best(a["u"], a["v"], a["s"], np.ones(len(a), bool), NEIGHBOURS))

    def groups(t: pa.Table, last: bool) -> pa.Table:
        t = t.combine_chunks()
        w = t.column("w").to_numpy()
        cut = np.flatnonzero(np.r_[True, w[1:] != w[:-1], True])
        ends = cut[1:] if last else cut[1:-1]
        stop = int(ends[-1]) if len(ends) else 0
        if stop:
            part = t.slice(0, stop)
            cols = [part.column(c).to_numpy() for c in ("x", "fresh", "least")]
            unit = _units(part.column("unit"))
            for a, b in zip(cut[:-1], ends, strict=False):
                if b - a > 1:
                    group(*(c[a:b] for c in cols), unit[a:b])
        return t.slice(stop)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = groups(t if held is None or not held.num_rows else pa.concat_tables([held, t]), False)
        if sum(map(len, out)) > 200_000:
            yield from flush()
    if held is not None and held.num_rows:
        groups(held, True)
    yield from flush()


def _by(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.repartition(task_count(df.sparkSession), key).sortWithinPartitions(key, *order)


def neighbour_graph(nodes: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """GRAPH of nodes (node, unit)."""
    total = nodes.count()
    bits = max(0, int(np.ceil(np.log2(max(1, total) / LEAF))))
    planted = map_batches(nodes.select("node", "unit"), _Leaves(bits), "tree int, code bigint, line float, node bigint, unit binary")
    planted = planted.repartition(task_count(nodes.sparkSession), "tree", "code").sortWithinPartitions("tree", "code", "line", "node")
    graph = materialize(_by(planted.mapInArrow(_first_neighbours, GRAPH), "u").mapInArrow(_merge, GRAPH), "graph")
    for turn in range(iterations):
        edges = map_batches(graph, _Edges(turn, False), "x bigint, w bigint, fresh boolean, back boolean, draw bigint")
        w = Window.partitionBy("w", "fresh", "back").orderBy("draw", "x")
        edges = edges.withColumn("rank", F.row_number().over(w)).where(f"rank <= {SAMPLE}").groupBy("x", "w").agg(F.max("fresh").alias("fresh"))
        least = graph.select(F.col("u").alias("x"), F.when(F.size("sims") >= NEIGHBOURS, F.array_min("sims")).otherwise(F.lit(-2.0)).cast("float").alias("least"))
        known = nodes.select(F.col("node").alias("x"), "unit").join(least, "x", "left").select("x", "unit", F.coalesce("least", F.lit(-2.0).cast("float")).alias("least"))
        met = _by(edges.join(known, "x").select("w", "x", "fresh", "least", "unit"), "w", "x").mapInArrow(_introduce, GRAPH)
        marked = map_batches(graph, _Edges(turn, True), GRAPH)
        graph = materialize(_by(marked.unionByName(met), "u").mapInArrow(_merge, GRAPH), "graph", graph)
        new, every = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("fresh"))).first()
        if (new or 0) <= SETTLED * (every or 0):
            break
    return graph


class _Pools:
    """Candidates and pools of queries sorted by query: the pool of each with its best EF, and which are expanded."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, pool, found, out = None, None, [], []
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for i, q in enumerate(cols["query"]):
                if q != query:
                    if pool is not None:
                        out.append(self.close(query, pool, found))
                    query, pool, found = q, None, []
                if cols["ids"][i] is not None:
                    pool = (cols["unit"][i], cols["ids"][i], cols["sims"][i], cols["done"][i])
                elif pool is not None:
                    found.append((cols["u"][i], cols["unit"][i]))
            if len(out) > 500:
                yield self.rows(out)
                out = []
        if pool is not None:
            out.append(self.close(query, pool, found))
        if out:
            yield self.rows(out)

    def close(self, query: int, pool: tuple, found: list[tuple[int, bytes]]) -> tuple:
        unit, ids, sims, done = pool
        seen = {u: (s, d) for u, s, d in zip(ids, sims, done, strict=True)}
        new = [(u, x) for u, x in found if u not in seen and u != query]
        if new:
            x = _units(pa.array([unit, *(b for _, b in new)], pa.binary()))
            for (u, _), s in zip(new, (x[1:] @ x[0]).tolist(), strict=True):
                seen[u] = (s, False)
        best = sorted(seen.items(), key=lambda e: (-e[1][0], e[0]))[:EF]
        wanted = [u for u, (_, d) in best if not d][:EXPAND]
        return query, unit, [u for u, _ in best], [s for _, (s, _) in best], [d or u in wanted for u, (_, d) in best], wanted

    def rows(self, out: list[tuple]) -> pa.RecordBatch:
        q, unit, ids, sims, done, wanted = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(unit, pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float32())), pa.array(done, pa.list_(pa.bool_())), pa.array(wanted, pa.list_(pa.int64()))], ["query", "unit", "ids", "sims", "done", "wanted"])


POOL = "query bigint, unit binary, ids array<bigint>, sims array<float>, done array<boolean>, wanted array<bigint>"


def graph_search(graph: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """POOL of each query (query: a node, unit): the best nodes that the walk from its own neighbours has seen."""
    ways = graph.select("u", F.explode("ids").alias("v"))
    back = ways.select(F.col("v").alias("u"), F.col("u").alias("v"), F.xxhash64("u", "v").alias("draw"))
    back = back.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("draw", "v"))).where(f"rank <= {NEIGHBOURS}")
    near = ways.unionByName(back.select("u", "v")).groupBy("u").agg(F.collect_set("v").alias("near"))  # at most 2 * NEIGHBOURS
    near = materialize(near, "near")
    start = queries.join(graph.select(F.col("u").alias("query"), "ids", "sims"), "query").withColumn("done", F.transform("ids", lambda x: F.lit(False)))
    pools = materialize(start.select("query", "unit", "ids", "sims", "done", F.expr(f"slice(ids, 1, {EXPAND})").alias("wanted")).withColumn("done", F.transform("ids", lambda x, i: i < EXPAND)), "pools")
    while pools.where(F.size("wanted") > 0).limit(1).count():
        asked = pools.select("query", F.explode("wanted").alias("w"))
        met = asked.join(near, asked["w"] == near["u"]).select("query", F.explode("near").alias("u")).distinct()
        empty = lambda kind: F.lit(None).cast(kind)
        met = met.join(nodes.select(F.col("node").alias("u"), "unit"), "u").select("query", "unit", empty("array<bigint>").alias("ids"), empty("array<float>").alias("sims"), empty("array<boolean>").alias("done"), "u")
        every = pools.select("query", "unit", "ids", "sims", "done", empty("bigint").alias("u")).unionByName(met)
        every = every.repartition(task_count(nodes.sparkSession), "query").sortWithinPartitions("query", F.col("u").asc_nulls_first())
        pools = materialize(every.mapInArrow(_Pools(), POOL), "pools", pools)
    return pools


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors with their largest component between 0.5 and 1, by powers of two, so that no digit changes and no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    a, b = (_scaled(batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)) for c in ("a", "b"))
    score = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
    return pa.RecordBatch.from_arrays([batch.column("query"), batch.column("v"), pa.array(score)], ["query", "v", "score"])


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by every, its k nearest other rows found.

    vectors: vec_id, embedding; other columns are ignored. Rows with a null vec_id, or a vector that is null, empty, zero, holds null or
    non-finite components or has another length than most (then the shortest), take no part. Rows alike in vec_id and vector count once. Fewer than k
    candidates are all returned. Ties go to the smaller vec_id. An empty table gives an empty result.
    """
    spark = prepare(vectors.sparkSession)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("embedding") == (length[0]["n"] if length else 0)).withColumn("node", F.xxhash64("embedding"))
    # copies beyond k + 1 cannot be among the k nearest of any row, as ties go to the smaller vec_id
    firsts = rows.dropDuplicates(["node", "vec_id"]).withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(f"rank <= {k + 1}")
    nodes = materialize(firsts.groupBy("node").agg(F.array_sort(F.collect_list("vec_id")).alias("members"), F.first("embedding").alias("embedding")), "nodes")
    units = materialize(map_batches(nodes.select("node", "embedding"), _to_units, "node bigint, unit binary"), "units")
    asked = materialize(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "node").distinct(), "asked")
    queries = asked.select(F.col("node").alias("query")).distinct().join(units.withColumnRenamed("node", "query"), "query")
    pools = graph_search(neighbour_graph(units), units, queries)
    # the pool is in order: what is as near as its k-th within the margin
    near = F.filter(F.arrays_zip("ids", "sims"), lambda x: x["sims"] >= F.get("sims", F.least(F.size("sims"), F.lit(k)) - 1) - MARGIN)
    best = pools.select("query", F.explode(near["ids"]).alias("v")).unionByName(asked.select(F.col("node").alias("query"), F.col("node").alias("v")).distinct())
    exact = best.join(nodes.select(F.col("node").alias("query"), F.col("embedding").alias("a")), "query").join(nodes.select(F.col("node").alias("v"), F.col("embedding").alias("b")), "v")
    scored = map_batches(exact.select("query", "v", "a", "b"), _measure, "query bigint, v bigint, score double").join(nodes.select(F.col("node").alias("v"), "members"), "v")
    scored = scored.select("query", "score", F.explode("members").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = scored.withColumn("place", F.row_number().over(order)).where(f"place <= {k + 1}").drop("place")
    out = asked.join(top, asked["node"] == top["query"]).where("vec_id <> query_id")
    final = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(f"rank <= {k}")
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
