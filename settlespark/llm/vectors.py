"""Embedding near-dedup over a robust-pruned flat graph.

Vectors of one label are dealt to the cluster shards of their three nearest pivots.  Every shard builds a graph whose neighbour lists are
pruned robustly (a neighbour goes if a kept one is nearer to it); the lists of a vector from all its shards are united.  In every
shard each vector then runs a greedy search from the medoid that expands everything in range, and every link is verified in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from settlespark.llm.common import components, forest_edges
from settlespark.session import written

LEAST_COSINE = 0.93
#: Vectors per pivot, most pivots in all (the bound of the sample and of its broadcast), shards of a vector, vectors of a shard in one task.
PER_PIVOT, MOST_PIVOTS, OVERLAP, BLOCK = 400, 16384, 3, 1500
#: Neighbours that are looked at and kept, far ones among them, the stretch of robust pruning, the width of the greedy search and its medoids.
LOOKED_AT, DEGREE, FAR, STRETCH, BEAM, MEDOIDS = 64, 24, 8, 1.2, 48, 16


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (double) of the vectors that can link."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.where("vec_id is not null and label is not null and embedding is not null")
        .select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
        .where(~bad & F.exists("v", lambda x: x != 0))
    )


def _unit(rows: list[list[float]]) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def robust_prune(x: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Neighbour lists (rows padded with -1): nearest first, without those to which a kept neighbour is nearer by the stretch."""
    n = len(x)
    width = min(LOOKED_AT, n - 1)
    if width <= 0:
        return np.full((n, 1), -1, dtype=np.int64)
    out = np.full((n, degree), -1, dtype=np.int64)
    for at in range(0, n, 256):
        own = np.arange(at, min(n, at + 256))
        sims = x[own] @ x.T
        sims[np.arange(len(own)), own] = -np.inf
        near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        order = np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, axis=1)
        far = 1 - np.take_along_axis(sims, near, axis=1)  # distance to the vector itself
        alive = np.ones(near.shape, dtype=bool)
        rows = np.arange(len(own))
        for slot in range(degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = alive.argmax(axis=1)
            chosen = near[rows, pick]
            out[own[some], slot] = chosen[some]
            between = 1 - np.einsum("rwd,rd->rw", x[near], x[chosen])
            alive &= ~((STRETCH * between <= far) & some[:, None])
            alive[rows, pick] = False
    return out


def graph_lists(x: np.ndarray) -> list[np.ndarray]:
    """Pruned lists with the edges back, and an edge to whatever would not be reached from the medoid."""
    n = len(x)
    kept = robust_prune(x)
    # Some edges to anywhere: in high dimensions the near ones alone don't lead across the cloud.
    far = np.random.default_rng(n).integers(0, n, (n, FAR)) if n > DEGREE else np.full((n, 1), -1)
    kept = np.concatenate([kept, np.where(far == np.arange(n)[:, None], -1, far)], axis=1)
    lists = [set(r[r >= 0].tolist()) for r in kept]
    for i, r in enumerate(kept):
        for j in r[r >= 0].tolist():
            if len(lists[j]) < 2 * DEGREE:
                lists[j].add(i)
    reached = np.zeros(n, dtype=bool)
    frontier = [medoid(x)]
    while True:
        while frontier:
            i = frontier.pop()
            if not reached[i]:
                reached[i] = True
                frontier += [j for j in lists[i] if not reached[j]]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return [np.array(sorted(s), dtype=np.int64) for s in lists]
        known = np.flatnonzero(reached)
        sims = x[lost[:256]] @ x[known].T
        best = int(np.argmax(sims.max(axis=1)))
        lists[int(known[sims[best].argmax()])].add(int(lost[best]))
        frontier = [int(lost[best])]


def medoid(x: np.ndarray) -> int:
    return int(np.argmax(x @ x.mean(axis=0)))


def medoids(x: np.ndarray) -> list[int]:
    """The medoid, and those of the parts that lie nearest to a few vectors spread over the rows."""
    n = len(x)
    centres = x[np.linspace(0, n - 1, min(MEDOIDS, n)).astype(int)]
    part = np.argmax(x @ centres.T, axis=1)
    found = [medoid(x)]
    for k in range(len(centres)):
        own = np.flatnonzero(part == k)
        if len(own):
            found.append(int(own[medoid(x[own])]))
    return list(dict.fromkeys(found))


def range_search(queries: np.ndarray, x: np.ndarray, lists: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs with cosine >= least that greedy search from the medoids finds; all queries move together.

    Each round every query expands the nearest vector in its beam; when its beam is done it goes on with all found vectors in range
    until none is left, so a dense neighbourhood is walked to its end.
    """
    nq, n = len(queries), len(x)
    width = max(1, max((len(r) for r in lists), default=1))
    table = np.full((n, width), -1, dtype=np.int64)
    for i, r in enumerate(lists):
        table[i, : len(r)] = r
    sim = np.full((nq, n), -np.inf, dtype=np.float32)  # of what was visited
    expanded = np.zeros((nq, n), dtype=bool)
    start = np.array(medoids(x))
    sim[:, start] = queries @ x[start].T
    beam = np.full((nq, BEAM), -1, dtype=np.int64)
    beam[:, :len(start)] = start[np.argsort(-sim[:, start], axis=1, kind="stable")]

    def expand(q: np.ndarray, node: np.ndarray) -> None:
        expanded[q, node] = True
        near = table[node]
        owner = np.repeat(q, width)
        near = near.ravel()
        owner, near = owner[near >= 0], near[near >= 0]
        fresh = sim[owner, near] == -np.inf
        owner, near = owner[fresh], near[fresh]
        for at in range(0, len(owner), 1 << 16):
            o, m = owner[at:at + (1 << 16)], near[at:at + (1 << 16)]
            sim[o, m] = np.einsum("ij,ij->i", queries[o], x[m])

    for _ in range(4 * BEAM):
        open_ = (beam >= 0) & ~expanded[np.arange(nq)[:, None], np.maximum(beam, 0)]
        active = np.flatnonzero(open_.any(axis=1))
        if not len(active):
            break
        pick = beam[active, open_[active].argmax(axis=1)]
        expand(active, pick)
        # The beam: what was visited and is nearest, best first.
        near = table[pick]
        both = np.concatenate([beam[active], near], axis=1)
        value = np.where(both >= 0, sim[active[:, None], np.maximum(both, 0)], -np.inf)
        order = np.argsort(-value, axis=1, kind="stable")
        both, value = np.take_along_axis(both, order, axis=1), np.take_along_axis(value, order, axis=1)
        twice = np.concatenate([np.zeros((len(both), 1), dtype=bool), both[:, 1:] == both[:, :-1]], axis=1)
        both = np.where(twice | (value == -np.inf), -1, both)
        beam[active] = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, :BEAM]
    reach = np.float32(least - 0.02)
    while True:
        q, node = np.nonzero((sim >= reach) & ~expanded)
        if not len(q):
            break
        for at in range(0, len(q), 1 << 14):
            expand(q[at:at + (1 << 14)], node[at:at + (1 << 14)])
    q, node = np.nonzero(sim >= np.float32(least - 1e-4))
    exact = np.concatenate([np.einsum("ij,ij->i", queries[q[a:a + 65536]], x[node[a:a + 65536]]) for a in range(0, len(q), 65536)] or [np.zeros(0)])
    return q[exact >= least], node[exact >= least]


def _pivots(nodes: DataFrame) -> dict[tuple[str, int], list[tuple[int, np.ndarray]]]:
    """A bounded sample of the vectors by hash: in each group one for every so many vectors, and always the first."""
    groups = nodes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    total = groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g")).first()
    per = max(PER_PIVOT, -(-2 * (total["n"] or 0) // MOST_PIVOTS))
    share = F.pmod(F.xxhash64("node", F.lit("pivot")), F.lit(1_000_000)) < F.lit(1_000_000 // per)
    sample = nodes.where(share).unionByName(nodes.join(groups.select(F.col("first").alias("node")), "node", "left_semi")).dropDuplicates(["node"])
    found: dict[tuple[str, int], list[tuple[int, np.ndarray]]] = {}
    for serial, r in enumerate(sample.orderBy(F.xxhash64("node"), "node").limit(MOST_PIVOTS).collect()):
        found.setdefault((r["label"], r["dims"]), []).append((serial, _unit([r["v"]])[0]))
    return found


def _column(values, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label).

    Vectors of one label and length link at a cosine of ``least`` or more; n_links counts the other vectors linked directly, a component is named
    by its least vec_id.  Null, zero and non-finite vectors and those without label link with nothing.  Equal vectors are one node with
    a count, so exact copies cost nothing; a label without a pivot in the bounded sample is one shard.

    A shard with more vectors than one task holds is cut into blocks by hash, and each pair of blocks is searched once; tasks return counts
    and a forest of links, never pairs.  A link is counted in the first shard that its two ends share.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors)
    nodes = written(
        usable.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")).withColumn("dims", F.size("v")), "vector-nodes"
    )
    pivots = spark.sparkContext.broadcast(_pivots(nodes))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pivots.value
        for batch in batches:
            ids, labels, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            shards: list = [None] * len(ids)
            groups: dict[tuple[str, int], list[int]] = {}
            for i, (label, row) in enumerate(zip(labels, rows)):
                groups.setdefault((label, len(row)), []).append(i)
            for key, members in groups.items():
                if key not in known:
                    continue
                names, points = np.array([p[0] for p in known[key]]), np.stack([p[1] for p in known[key]])
                sims = _unit([rows[i] for i in members]) @ points.T
                best = np.argsort(-sims, axis=1, kind="stable")[:, :OVERLAP]
                for i, b in zip(members, best):
                    shards[i] = sorted(names[b].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), _column(shards, pa.list_(pa.int64()))], ["node", "shards"])

    placed = nodes.select("node", "label", "v").mapInArrow(assign, "node bigint, shards array<bigint>")
    placed = nodes.join(placed, "node").select("node", "label", "dims", "v", "copies", "shards")
    # Without a pivot the group itself is the shard, under a name of its own.
    own = F.array(-F.abs(F.xxhash64("label", "dims")) - 1)
    placed = written(placed.withColumn("shards", F.coalesce("shards", own)), "vector-shards")
    sizes = placed.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = placed.select("node", "v", "copies", "shards", F.explode("shards").alias("shard")).join(sizes, "shard")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", "shard"), F.col("blocks")).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        ids = group.column("node").to_numpy()
        lists = graph_lists(_unit(group.column("v").to_pylist()))
        return pa.table({"node": pa.array(ids), "near": pa.array([ids[r].tolist() for r in lists], pa.list_(pa.int64()))})

    adjacency = rows.select("shard", "block", "node", "v").groupBy("shard", "block").applyInArrow(build, "node bigint, near array<bigint>")
    united = written(adjacency.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "vector-graph")
    sent = rows.join(united, "node").select(
        "shard", "node", "v", "copies", "shards", "near", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select("shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "v", "copies", "shards", "near", "block")

    def search(key: tuple, group: pa.Table) -> pa.Table:
        shard, first, second = (k.as_py() for k in key)
        ids, block = group.column("node").to_numpy(), group.column("block").to_numpy()
        x, copies = _unit(group.column("v").to_pylist()), group.column("copies").to_numpy()
        data, ask = np.flatnonzero(block == second), np.flatnonzero(block == first)
        if not len(data) or not len(ask):
            return _nothing()
        at = {int(i): k for k, i in enumerate(ids[data])}
        near = group.column("near").to_pylist()
        lists = [np.array([at[j] for j in near[k] if j in at], dtype=np.int64) for k in data]
        q, d = range_search(x[ask], x[data], _reachable(x[data], lists), least)
        a, b = ask[q], data[d]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
        a, b = pairs
        of = group.column("shards").to_pylist()
        mine = np.array([min(set(of[s]) & set(of[t])) == shard for s, t in pairs.T.tolist()], dtype=bool) if max(map(len, of)) > 1 else np.ones(len(a), bool)
        a, b = a[mine], b[mine]
        links = np.bincount(a, weights=copies[b], minlength=len(ids)) + np.bincount(b, weights=copies[a], minlength=len(ids))
        some = np.flatnonzero(links)
        up, root = forest_edges(ids[a], ids[b])
        return pa.table({
            "node": pa.array(np.concatenate([ids[some], up]), pa.int64()),
            "links": pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(len(up), np.int64)]), pa.int64()),
            "root": pa.array([None] * len(some) + root.tolist(), pa.int64()),
        })

    found = written(sent.groupBy("shard", "i", "j").applyInArrow(search, "node bigint, links bigint, root bigint"), "vector-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-components")
    facts = nodes.join(counts, "node", "left").join(joined.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        F.col("label").alias("_label"), F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    linked = usable.join(facts, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v"))).select("vec_id", "n_links", "component_id")
    ids = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding")
    alone = _unlinkable(ids).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _unlinkable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    fine = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    return vectors.where(~F.coalesce(fine, F.lit(False)))


def _nothing() -> pa.Table:
    return pa.table({c: pa.array([], pa.int64()) for c in ("node", "links", "root")})


def _reachable(x: np.ndarray, lists: list[np.ndarray]) -> list[np.ndarray]:
    """The lists with an edge from the nearest reached vector to each part that the medoid doesn't reach."""
    n, reached = len(x), np.zeros(len(x), dtype=bool)
    lists, frontier = list(lists), [medoid(x)]
    while True:
        while frontier:
            i = frontier.pop()
            if not reached[i]:
                reached[i] = True
                frontier += lists[i][~reached[lists[i]]].tolist()
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return lists
        known = np.flatnonzero(reached)
        sims = x[lost[:64]] @ x[known].T
        best = int(np.argmax(sims.max(axis=1)))
        near = int(known[sims[best].argmax()])
        lists[near] = np.append(lists[near], lost[best])
        frontier = [int(lost[best])]


def audit(vectors: DataFrame, found: DataFrame, least: float = LEAST_COSINE, block: int = 2000) -> DataFrame:
    """Recall: true_links and found_links over the vectors whose id is divisible by 100, compared with all vectors in blocks."""
    usable = _usable(vectors).withColumn("dims", F.size("v"))
    sizes = usable.groupBy("label", "dims").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.ceil(F.sum((F.col("vec_id") % 100 == 0).cast("int")) / block).cast("int").alias("asks"))
    rows = usable.join(sizes, ["label", "dims"]).where("asks > 0")
    data = rows.select("label", "dims", F.pmod(F.xxhash64("vec_id"), "blocks").alias("d"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("q"), "vec_id", "v", F.lit(0).alias("ask"))
    asks = rows.where("vec_id % 100 = 0").select("label", "dims", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - F.lit(1).cast("bigint"))).alias("d"), F.pmod(F.xxhash64("vec_id"), "asks").cast("int").alias("q"), "vec_id", "v", F.lit(1).alias("ask"))

    def count(group: pa.Table) -> pa.Table:
        ask = group.column("ask").to_numpy() == 1
        ids, x = group.column("vec_id").to_numpy(), _unit(group.column("v").to_pylist())
        links = ((x[ask] @ x[~ask].T >= least) & (ids[ask][:, None] != ids[~ask][None, :])).sum(axis=1)
        return pa.table({"vec_id": pa.array(ids[ask]), "links": pa.array(links.astype(np.int64))})

    true = data.unionByName(asks).groupBy("label", "dims", "d", "q").applyInArrow(count, "vec_id bigint, links bigint").groupBy("vec_id").agg(F.sum("links").alias("links"))
    return true.join(found, "vec_id").agg(F.sum("links").alias("true_links"), F.sum(F.least("n_links", "links")).alias("found_links"))
