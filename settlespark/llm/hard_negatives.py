"""Hard-negative mining by segment summary filtering.

A vector is cut into segments, and of each segment its mean and its deviation (the norm of what differs from the mean) are kept.  The inner product
of two vectors then lies within the sum over segments of (length * mean * mean) plus or minus (deviation * deviation).  Pairs whose
bounds cannot bring them among the wanted rows are dropped; the others are bounded again with shorter segments, and only what is still undecided
is scored exactly.

Anchors meet all rows block by block.  A block of anchors and a block of rows are the work of one task; what it returns is a
few rows for each anchor, whatever the bounds decide.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from settlespark.session import written

#: Anchors and rows of a block, rows compared at once, and the number of segments of each level.
ANCHORS, ROWS, AT_ONCE, LEVELS = 2048, 4096, 512, (1, 4, 16)
#: Below this share of pairs that are still undecided they are taken one by one.
SPARSE = 1 / 64
#: No score is as low; squared norms stay below the second number.
NEVER, MOST_NORM = -(1 << 62), float(1 << 56)
POSITIVES, NEGATIVES, LEAST, MOST = 5, 3, 50, 95


class Summary:
    """Means and deviations of the segments of each row of x, for one number of segments."""

    def __init__(self, x: np.ndarray, segments: int):
        d = x.shape[1]
        edges = np.unique(np.linspace(0, d, min(segments, d) + 1).astype(int))
        lengths = np.diff(edges)
        parts = [x[:, a:b] for a, b in zip(edges[:-1], edges[1:])]
        means = np.stack([p.mean(axis=1) for p in parts], axis=1)
        self.deviations = np.stack([np.sqrt(((p - p.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)) for p in parts], axis=1)
        self.means = means * np.sqrt(lengths)

    def bounds(self, i: np.ndarray | slice, other: Summary, j: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and most of the inner products of own rows i with the other's rows j (all pairs), rounded away from each other."""
        middle, spread = self.means[i] @ other.means[j].T, self.deviations[i] @ other.deviations[j].T
        slack = 1e-9 * (np.abs(middle) + spread) + 1e-9
        return middle - spread - slack, middle + spread + slack

    def pair_bounds(self, i: np.ndarray, other: Summary, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for the pairs (i[k], j[k])."""
        middle = np.einsum("kd,kd->k", self.means[i], other.means[j])
        spread = np.einsum("kd,kd->k", self.deviations[i], other.deviations[j])
        slack = 1e-9 * (np.abs(middle) + spread) + 1e-9
        return middle - spread - slack, middle + spread + slack


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All exact inner products: doubles hold them below 2**53, and every sum on the way to them."""
    largest = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0) * (y.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0))
    if largest < 1 << 52:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T


class Best:
    """The ``k`` best (score, vec_id) of every slot: higher scores first, ties by smaller vec_id."""

    def __init__(self, slots: int, k: int):
        self.scores = np.full((slots, k), NEVER, dtype=np.int64)
        self.vec_ids = np.full((slots, k), np.iinfo(np.int64).max, dtype=np.int64)

    @property
    def least(self) -> np.ndarray:
        """The score a candidate has to reach."""
        return self.scores[:, -1]

    def offer(self, slots: np.ndarray, scores: np.ndarray, vec_ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        touched = np.unique(slots)
        slots = np.concatenate([slots, np.repeat(touched, k)])
        scores = np.concatenate([scores, self.scores[touched].reshape(-1)])
        vec_ids = np.concatenate([vec_ids, self.vec_ids[touched].reshape(-1)])
        order = np.lexsort((vec_ids, -scores, slots))
        slots, scores, vec_ids = slots[order], scores[order], vec_ids[order]
        begin = np.searchsorted(slots, touched)
        first = (begin[:, None] + np.arange(k)).reshape(-1)
        self.scores[touched] = scores[first].reshape(-1, k)
        self.vec_ids[touched] = vec_ids[first].reshape(-1, k)

    def told(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """slot, score, vec_id of all that is held."""
        slot, place = np.nonzero(self.scores > NEVER)
        return slot, self.scores[slot, place], self.vec_ids[slot, place]


def search(
    anchors: np.ndarray, rows: np.ndarray, vec_ids: np.ndarray, meet: Callable[[np.ndarray], np.ndarray],
    low: np.ndarray, high: np.ndarray, owner: np.ndarray, k: int,
) -> Best:
    """For every slot the best ``k`` rows it may meet whose score lies in [low, high].

    A slot belongs to the anchor ``owner[slot]``, slots in order of their anchors; ``meet(rows)`` tells for all anchors and some rows whether they may meet.
    """
    best = Best(len(owner), k)
    begins = np.searchsorted(owner, np.arange(len(anchors) + 1))
    n_slots = np.diff(begins)
    ours, theirs = [[Summary(m.astype(np.float64), n) for n in LEVELS] for m in (anchors, rows)]
    # Rows whose bounds promise most come first, so that what the others have to reach is high soon.
    order = np.argsort(-ours[0].bounds(slice(None), theirs[0], slice(None))[1].max(axis=0, initial=0.0), kind="stable")
    for at in range(0, len(rows), AT_ONCE):
        some = order[at:at + AT_ONCE]
        floor = np.maximum(low, best.least)
        # Of an anchor's slots the least demanding decides whether a pair goes on.
        need, cap = np.full(len(anchors), np.iinfo(np.int64).max), np.full(len(anchors), NEVER)
        np.minimum.at(need, owner, floor)
        np.maximum.at(cap, owner, high)
        alive = meet(some)
        for own, other in zip(ours, theirs):
            least, most = own.bounds(slice(None), other, some)
            alive &= (most >= need[:, None]) & (least <= cap[:, None])
            if alive.mean() < SPARSE:
                break
        i, j = np.nonzero(alive)
        if len(i) < SPARSE * alive.size:  # few are left: shorter segments for these alone, then exact scores of these alone
            for own, other in zip(ours, theirs):
                least, most = own.pair_bounds(i, other, some[j])
                keep = (most >= need[i]) & (least <= cap[i])
                i, j = i[keep], j[keep]
            scores = np.einsum("kd,kd->k", anchors[i], rows[some[j]])
        else:
            scores = _products(anchors, rows[some])[i, j]
        keep = (scores >= need[i]) & (scores <= cap[i])
        i, j, scores = i[keep], j[keep], scores[keep]
        pair = np.repeat(np.arange(len(i)), n_slots[i])
        slot = begins[i][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(n_slots[i]) - n_slots[i], n_slots[i])
        keep = (scores[pair] >= floor[slot]) & (scores[pair] <= high[slot])
        pair, slot = pair[keep], slot[keep]
        if len(slot):
            best.offer(slot, scores[pair], vec_ids[some[j[pair]]])
    return best


def _usable(vectors: DataFrame, scale: int) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(v, lambda c: F.floor(c * scale))
    norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0").where(~bad)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), x.alias("x")).where(norm < MOST_NORM)


def _table(t: pa.Table, *columns: str) -> tuple:
    """vec_id, label, x and further columns of a block, of rows with one vec_id the first by label, then vector; in order of vec_id."""
    ids, labels = (np.asarray(t.column(c).to_numpy(), dtype=np.int64) for c in ("vec_id", "label"))
    x = np.asarray(t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(len(ids), -1)
    order = np.lexsort((*[x[:, c] for c in range(x.shape[1] - 1, -1, -1)], labels, ids)) if len(ids) else np.zeros(0, int)
    order = order[np.append(True, ids[order][1:] != ids[order][:-1])] if len(ids) else order
    others = [t.column(c).to_pylist() for c in columns]
    return ids[order], labels[order], x[order], *[[c[i] for i in order.tolist()] for c in others]


_FOUND = ["anchor_id", "positive_id", "positive_score", "vec_id", "score"]
_FOUND_TYPE = ", ".join(f"{c} bigint" for c in _FOUND)


def _out(*columns) -> pa.Table:
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(_FOUND, columns)})


def _positives(k: int):
    def work(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _out(*[[]] * 5)
        (a_id, a_label, a), (r_id, r_label, r) = _table(anchors), _table(rows)
        meet = lambda some: (a_label[:, None] == r_label[some]) & (a_id[:, None] != r_id[some])
        bounds = np.full(len(a_id), NEVER), np.full(len(a_id), -NEVER)
        slot, score, vec_id = search(a, r, r_id, meet, *bounds, np.arange(len(a_id)), k).told()
        return _out(a_id[slot], np.full(len(slot), -1), np.full(len(slot), 0), vec_id, score)

    return work


def _negatives(k: int, least: int, most: int):
    def work(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _out(*[[]] * 5)
        (a_id, a_label, a, positives), (r_id, r_label, r) = _table(anchors, "positives"), _table(rows)
        flat = [(i, p["positive_id"], p["positive_score"]) for i, own in enumerate(positives) for p in own]
        owner, p_id, p_score = (np.array(c, dtype=np.int64) for c in zip(*flat))
        low, high = -(-least * p_score // 100), most * p_score // 100
        meet = lambda some: a_label[:, None] != r_label[some]
        slot, score, vec_id = search(a, r, r_id, meet, low, high, owner, k).told()
        return _out(a_id[owner[slot]], p_id[slot], p_score[slot], vec_id, score)

    return work


def _first(found: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """The first k per key over all blocks, numbered; each block gave at most k of them, and Spark keeps k per task before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine(
    vectors: DataFrame, anchor: Column, relabelled: Column | None = None, scale: int = 256,
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of ``vectors`` (vec_id, embedding, label).

    Entries become floor(scale * entry); a score is the inner product of two rows.  ``anchor`` says on vec_id and label which rows are anchors, and
    ``relabelled`` gives the label that counts.  An anchor's positives are its first other rows of the same label, by falling score, then vec_id;
    of the rows of other labels the first whose score is at least ``least`` and at most ``most`` per cent of the positive's are returned for each
    positive.  A negative positive_score leaves no room between the two, so such a positive has no rows.

    Rows with a null vec_id, label or vector, a null or non-finite entry, an empty vector, or a squared norm of 2**56 or more after
    scaling (scores would leave the whole numbers of 64 bits) take no part.  Of rows with one vec_id the first by label, then vector, takes part.
    Vectors of different lengths do not meet.  An empty table gives none.

    Anchors and rows are dealt by hash into blocks of bounded size; every block of anchors meets every block of rows, each pair of blocks in a task, so
    work grows as the product of the two, as the exact answer of a query set against all rows does; what is shuffled is that product
    over the block size.
    """
    rows = _usable(vectors, scale)
    if relabelled is not None:
        rows = rows.withColumn("label", relabelled.cast("bigint")).where("label is not null")
    rows = written(rows.withColumn("d", F.size("x")).withColumn("is_anchor", F.coalesce(anchor, F.lit(False))), "negatives-rows")
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("a")).first()
    n_rows, n_anchors = max(1, -(-count.n // ROWS)), max(1, -(-count.a // ANCHORS))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["d", "anchor_block", "row_block"]
    dealt = rows.select("vec_id", "label", "x", "d", block(n_rows).alias("row_block"), every(n_anchors).alias("anchor_block"))
    # Columns of their own: two sides of a cogroup that share a grouping column lose their others.
    own = [F.col(c).alias(c) for c in ("vec_id", "label", "x", "d")]
    asked = rows.where("is_anchor").select(*own, block(n_anchors).alias("anchor_block"), every(n_rows).alias("row_block"))

    met = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_positives(positives), _FOUND_TYPE)
    chosen = _first(met, ["anchor_id"], positives, "nth").groupBy("anchor_id").agg(
        F.collect_list(F.struct(F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))).alias("positives"))
    chosen = written(chosen, "negatives-positives")
    asked = asked.join(chosen, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    met = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_negatives(negatives, least, most), _FOUND_TYPE)
    ranked = _first(met, ["anchor_id", "positive_id", "positive_score"], negatives, "rank")
    return ranked.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
