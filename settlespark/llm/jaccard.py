"""N-gram Jaccard join by prefix trees.

Two sets with similarity t or more differ in at most (|x| + |y|) (1 - t) / (1 + t) elements.  Sets are divided by hash into one more part
than that (and a third more), so two similar sets agree in many whole parts: the number of parts with equal content says which sets may be
similar, without loss.  The sets of a connected family of such pairs are then joined exactly: written in one global order they are stored in a prefix tree, and
each set runs through the tree once, along the branches that lead to sets with a rare element in common which are not connected with
it already, sharing the overlap of common beginnings and leaving a subtree when the remaining length cannot bring enough overlap.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from settlespark.llm.common import (
    Forest, column_chunks, components, maybe_in, partitions_of, text_of, without,
)
from settlespark.session import release, written

#: Elements of all sets that one tree may hold; larger families are joined block against block.
BLOCK_ELEMENTS = 1_000_000
#: Parts sent at once.
FLUSH = 400_000
#: A part that more sets have is hot: its pairs are not counted.
HOT = 32

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M1
    return (h ^ (h >> np.uint64(29))) * _M2


class Shingler:
    """Sets of 64-bit hashes of word n-grams; words are runs of characters other than ASCII white space, A-Z in lower case."""

    LIMIT = 1_000_000

    def __init__(self, n: int):
        self.n, self.at, self.known = n, {}, array("Q")

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.at) > self.LIMIT:
            self.at, self.known = {}, array("Q")
        at, split = self.at, [t.encode().lower().split() for t in texts]
        for words in split:
            for w in words:
                if w not in at:
                    at[w] = len(self.known)
                    self.known.append(xxhash.xxh3_64_intdigest(w))
        hashes = np.array(self.known, dtype=np.uint64)
        out = []
        for words in split:
            if not words:
                out.append(np.zeros(0, np.uint64))
                continue
            h = hashes[np.fromiter(map(at.__getitem__, words), dtype=np.int64, count=len(words))]
            if len(words) < self.n:
                out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64))
                continue
            grams = h[: len(h) - self.n + 1]
            for i in range(1, self.n):
                grams = _mix(grams) + h[i: len(h) - self.n + 1 + i]
            out.append(np.unique(_mix(grams)))
        return out


_shinglers: dict[int, Shingler] = {}


def shingler(n: int) -> Shingler:
    return _shinglers.setdefault(n, Shingler(n))


@functools.cache
def size_classes(percent: int) -> list[int]:
    """Least sizes of the classes; a similar set is at most one class larger."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return out


@functools.cache
def parts_at(level: int, percent: int) -> tuple[int, int, np.ndarray]:
    """For sets of class level - 1 and level: number of parts, how many of them more than one are sure to be equal, and where parts begin."""
    largest = size_classes(percent)[level + 1] - 1
    differ = 2 * largest * (100 - percent) // (100 + percent)
    spare = 3 + differ // 3 if differ else 0
    parts = differ + 1 + spare
    return parts, spare, np.array([(j << 64) // parts for j in range(parts)], dtype=np.uint64)


def named_parts(elements: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(level, slack, hashes of the parts) of a sorted set at its own level and the next.

    Two similar sets have at least ``spare`` + 1 equal parts.  Empty parts are named only by sets with more than ``spare`` of them (slack 0);
    any other set has as many equal parts less with each empty part: it shares at least slack + 1 names with every similar set.
    """
    own = int(np.searchsorted(size_classes(percent), len(elements), side="right")) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(elements))])
    out = []
    for level in (own, own + 1):
        parts, spare, begin = parts_at(level, percent)
        cut = np.append(np.searchsorted(elements, begin), len(elements))
        full = cut[1:] > cut[:-1]
        slack = spare - (parts - int(full.sum()))
        named = full if slack >= 0 else np.ones(parts, dtype=bool)
        names = np.arange(parts, dtype=np.uint64)[named] + np.uint64(level << 32)
        out.append((level, max(0, slack), _mix(_mix(names) + (sums[cut[1:]] - sums[cut[:-1]])[named])))
    return out


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the parts of a sorted set at its own level and the next; two similar sets have one in common."""
    return np.concatenate([marks for *_, marks in named_parts(elements, percent)])


def _short(marks: np.ndarray) -> bytes:
    """The upper six bytes of each mark.  Marks that are equal by chance only count a part too many."""
    return marks.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


#: The parts of one set at one level in one bucket: who, level, slack, how many of the marks are its.
RUN = np.dtype([("owner", "<i8"), ("level", "<i4"), ("slack", "<i4"), ("count", "<i4")])
FOUND = "bucket int, kind string, first binary, second binary"
MET = "kind string, a bigint, b bigint, level int, n bigint, need bigint"


def _soa(runs: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(runs[f]).tobytes() for f in RUN.names)


def _runs(raw: bytes) -> np.ndarray:
    out, at = np.empty(len(raw) // RUN.itemsize, dtype=RUN), 0
    for f in RUN.names:
        kind = RUN[f]
        out[f] = np.frombuffer(raw, kind, len(out), at)
        at += kind.itemsize * len(out)
    return out


def _met(kind: str, a, b, level, n, need) -> pa.RecordBatch:
    columns = [pa.array([kind] * len(a), pa.string())]
    columns += [pa.array(c, k) for c, k in zip((a, b, level, n, need), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["kind", "a", "b", "level", "n", "need"])


def _counted(run: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (x, y) of positions in ``run``, with how often each comes."""
    pairs, n = np.unique(x * len(run) + y, return_counts=True)
    return pairs // len(run), pairs % len(run), n


def meetings(marks: np.ndarray, run: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of ``MET`` that the parts of one bucket give; ``run`` is in the order of ``marks``.

    "pair": two sets, how many parts they share here, and how many they share in all at least if they are similar.  "hot": a set, the
    least set of a part that more than ``HOT`` sets have, how many such parts, and how many a set may have without being linked over them.
    """
    who = np.repeat(np.arange(len(run)), run["count"])
    order = np.lexsort((run["owner"][who], marks))
    marks, who = marks[order], who[order]
    begins = np.flatnonzero(np.append(True, marks[1:] != marks[:-1]))
    sizes = np.diff(np.append(begins, len(marks)))
    hot = np.repeat(sizes > HOT, sizes)
    if hot.any():
        hub = np.repeat(who[begins], sizes)
        x, y, n = _counted(run, who[hot], hub[hot])
        yield _met("hot", run["owner"][x], run["owner"][y], run["level"][x], n, run["slack"][x] // 2)
    xs, ys, waiting = [], [], 0

    def told() -> pa.RecordBatch:
        nonlocal waiting
        x, y, n = _counted(run, np.concatenate(xs), np.concatenate(ys))
        xs.clear()
        ys.clear()
        waiting = 0
        right = (run["level"][x] == run["level"][y]) & (run["owner"][x] != run["owner"][y])
        x, y, n = x[right], y[right], n[right]
        slack = np.minimum(run["slack"][x], run["slack"][y])
        return _met("pair", run["owner"][x], run["owner"][y], run["level"][x], n, slack + 1 - slack // 2)

    for size in range(2, HOT + 1):
        i, j = np.triu_indices(size, 1)
        groups, step = begins[sizes == size], max(1, FLUSH // len(i))
        for at in range(0, len(groups), step):
            members = who[groups[at:at + step, None] + np.arange(size)]
            xs.append(members[:, i].ravel())
            ys.append(members[:, j].ravel())
            waiting += xs[-1].size
            if waiting >= 4 * FLUSH:
                yield told()
    if waiting:
        yield told()


def _families(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """kind, a, b and more (see ``MET``): ("size", doc_id, set size) for every row, ("pair", doc_id, doc_id) and ("hot", doc_id, doc_id) for rows with an equal part.

    Parts travel as arrays, dealt by hash into as many buckets as there are shuffle partitions.  Of equal sets that a task makes, one sends its parts.
    """
    buckets = partitions_of(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, owners, waiting = [], [], 0
        met: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            nonlocal waiting
            if held:
                marks = np.concatenate(held)
                run = np.array(owners, dtype=RUN)
                who = np.repeat(np.arange(len(run)), run["count"])
                begin = np.array([(j << 64) // buckets for j in range(buckets)], dtype=np.uint64)
                bucket = np.searchsorted(begin, marks, side="right") - 1
                order = np.argsort(bucket, kind="stable")
                marks, who = marks[order], who[order]
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for j in range(buckets):
                    if ends[j + 1] > ends[j]:
                        some, count = np.unique(who[ends[j]:ends[j + 1]], return_counts=True)
                        here = run[some]
                        here["count"] = count
                        rows.append((j, "part", _short(marks[ends[j]:ends[j + 1]]), _soa(here)))
            held.clear()
            owners.clear()
            waiting = 0
            cols = list(zip(*rows)) if rows else [()] * 4
            rows.clear()
            kinds = [pa.int32(), pa.string(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["bucket", "kind", "first", "second"])

        serial = 0
        for batch in column_chunks(batches):
            ids = batch.column(0).to_pylist()
            sets = shingler(n).sets(batch.column(1).to_pylist())
            rows.append((serial % buckets, "size", np.array([i is None for i in ids], dtype=np.int8).tobytes()
                         + np.array([i or 0 for i in ids], dtype="<i8").tobytes(), np.array([len(s) for s in sets], dtype="<i8").tobytes()))
            equal = []
            for i, s in zip(ids, sets):
                if len(s) and i is not None:
                    like = met.setdefault(xxhash.xxh3_128_digest(s.tobytes()), i)
                    if like != i:
                        equal.append((i, like))
                        continue
                    for level, slack, marks in named_parts(s, percent):
                        held.append(marks)
                        owners.append((i, level, slack, len(marks)))
                        waiting += len(marks)
            if equal:
                rows.append((serial % buckets, "equal", *[np.array(c, dtype="<i8").tobytes() for c in zip(*equal)]))
            serial += 1
            if waiting >= FLUSH:
                yield flush()
        yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, runs = [], []
        for batch in batches:
            for kind, first, second in zip(*(c.to_pylist() for c in batch.columns[1:])):
                if kind == "part":
                    marks.append(_long(first))
                    runs.append(_runs(second))
                    continue
                values = np.frombuffer(second, "<i8")
                none = np.zeros(len(values), dtype=np.int64)
                if kind == "equal":
                    yield _met("pair", np.frombuffer(first, "<i8"), values, none, none + 1, none)
                    continue
                nulls, ids = np.frombuffer(first[: len(values)], np.int8).astype(bool), np.frombuffer(first[len(values):], "<i8")
                yield _met("size", pa.array(ids, pa.int64(), mask=nulls), values, none, none, none)
        if marks:
            mark, run = np.concatenate(marks), np.concatenate(runs)
            marks.clear()
            runs.clear()
            yield from meetings(mark, run)

    rows = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(cut, FOUND)
    return rows.repartition(buckets, "bucket").mapInArrow(meet, MET)


def _near(facts: DataFrame) -> DataFrame:
    """a, b: links that connect all similar sets, and few others.

    A set with at most slack / 2 hot parts shares more than slack / 2 other parts with each similar set: those pairs are counted.  Two sets with
    more hot parts each are linked over the least set of a part as soon as they share a hot one.
    """
    pairs = facts.where("kind = 'pair'").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "level", "n", "need")
    counted = pairs.groupBy("a", "b", "level").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n >= need").select("a", "b")
    hot = facts.where("kind = 'hot'")
    poor = hot.groupBy("a", "level").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n > need").select("a", "level")
    return counted.unionByName(hot.join(poor, ["a", "level"], "left_semi").select("a", "b"))


class Tree:
    """A prefix tree of sets written in one order, as runs of elements."""

    def __init__(self, sets: list[np.ndarray]):
        elements, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(elements), dtype=np.int64)
        rank[np.lexsort((elements, -times))] = np.arange(len(elements))  # frequent ones first: long shared beginnings
        cuts = np.cumsum([0] + [len(s) for s in sets])
        self.sets = [np.sort(rank[at[cuts[i]:cuts[i + 1]]]) for i in range(len(sets))]
        self.width = len(elements)
        order = sorted(range(len(sets)), key=lambda i: self.sets[i].astype(">u4").tobytes())
        # Nodes: run of elements, children, sets that end there, sizes and members below.
        self.run, self.children, self.here, self.up = [np.zeros(0, np.int64)], [[]], [[]], [-1]
        self.node = [0] * len(sets)
        path, depths = [0], [0]
        previous = np.zeros(0, np.int64)
        for i in order:
            own = self.sets[i]
            m = min(len(own), len(previous))
            differ = np.flatnonzero(own[:m] != previous[:m])
            common = int(differ[0]) if len(differ) else m
            below = -1
            while depths[-1] > common:
                below = path.pop()
                depths.pop()
            if below >= 0 and depths[-1] < common:  # divide the run that leads to ``below``
                keep = common - depths[-1]
                self.run.append(self.run[below][:keep])
                self.children.append([below])
                self.here.append([])
                node = len(self.run) - 1
                self.children[path[-1]][-1] = node
                self.up.append(path[-1])
                self.up[below] = node
                self.run[below] = self.run[below][keep:]
                path.append(node)
                depths.append(common)
            if len(own) > common:
                self.run.append(own[common:])
                self.children.append([])
                self.here.append([])
                self.children[path[-1]].append(len(self.run) - 1)
                self.up.append(path[-1])
                path.append(len(self.run) - 1)
                depths.append(len(own))
            self.here[path[-1]].append(i)
            self.node[i] = path[-1]
            previous = own
        count = len(self.run)
        self.least, self.most = [1 << 60] * count, [0] * count
        stack = [(0, False)]
        while stack:
            node, ready = stack.pop()
            if not ready:
                stack.append((node, True))
                stack += [(c, False) for c in self.children[node]]
                continue
            sizes = [len(self.sets[i]) for i in self.here[node]]
            self.least[node] = min(sizes + [self.least[c] for c in self.children[node]], default=1 << 60)
            self.most[node] = max(sizes + [self.most[c] for c in self.children[node]], default=0)

    def _rare(self, percent: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The rarest elements of each set, one of which every similar set has among its own, and who has each of them.

        Elements are numbered from the most frequent on, so the rarest are the last.
        """
        rare = [s[-(len(s) - -(-len(s) * percent // 100) + 1):] for s in self.sets]
        element, owner = np.concatenate(rare), np.repeat(np.arange(len(rare)), [len(r) for r in rare])
        order = np.argsort(element, kind="stable")
        return rare, np.searchsorted(element[order], np.arange(self.width + 1)), owner[order]

    def link(self, percent: int, forest: Forest) -> None:
        """Join in ``forest`` all sets that are similar, directly or over others."""
        rare, begins, owners = self._rare(percent)
        label = np.arange(len(self.sets))  # the component of each set, so far
        flags = np.zeros(self.width, dtype=bool)
        asked = [-1] * len(self.run)
        for q, query in enumerate(self.sets):
            near = np.unique(np.concatenate([owners[a:b] for a, b in zip(begins[rare[q]], begins[rare[q] + 1])]))
            near = near[label[near] != label[q]]
            if not len(near):
                continue
            # Only the branches that lead to such sets are walked.
            for i in near.tolist():
                node = self.node[i]
                while node >= 0 and asked[node] != q:
                    asked[node] = q
                    node = self.up[node]
            size = len(query)
            flags[query] = True
            low, high = -(-size * percent // 100), size * 100 // percent
            stack = [(0, 0, 0)]
            while stack:
                node, overlap, depth = stack.pop()
                if asked[node] != q or self.least[node] > high or self.most[node] < low:
                    continue
                run = self.run[node]
                overlap += int(np.count_nonzero(flags[run])) if len(run) else 0
                depth += len(run)
                # A set of s elements may miss (100 s - percent size) / (100 + percent) of its own; the largest below may miss most.
                if depth - overlap > (100 * min(self.most[node], high) - percent * size) // (100 + percent):
                    continue
                for i in self.here[node]:
                    if label[i] != label[q] and 100 * overlap >= percent * (size + depth - overlap):
                        forest.join(i, q)
                        label[label == label[i]] = label[q]
                stack += [(c, overlap, depth) for c in self.children[node]]
            flags[query] = False


def similar_within(ids: list[int], sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id of its component) for the sets of one tree."""
    if len(ids) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = sorted(range(len(ids)), key=ids.__getitem__)
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    forest = Forest(len(ids))
    Tree(sets).link(percent, forest)
    pairs = [(ids[i], ids[r]) for i in range(len(ids)) if (r := forest.root(i)) != i]
    return np.array([p[0] for p in pairs], dtype=np.int64), np.array([p[1] for p in pairs], dtype=np.int64)


def _hashed(doc_id: int) -> int:
    return xxhash.xxh3_64_intdigest(doc_id.to_bytes(8, "little", signed=True))


def join(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    A row's set is its distinct word n-grams, or its whole word sequence if that is shorter, or empty.  Rows link when 100 times the
    intersection is at least ``percent`` times the union; a component is named by its least doc_id.  Empty sets, null texts and null ids
    link with nothing.  Repeated rows link with their like; rows with one doc_id are one node.

    Only parts (some 0.7 of six bytes per word), pairs of sets with a common part and the sets of rows with a partner are shuffled.  Equal sets are reduced to one in the
    task that makes them, before they are sent, and the links between them are dealt by hash, apart from the trees.  A family with more elements than fit one tree is cut into blocks by hash and joined
    block against block, so no task holds more than two blocks.
    """
    spark = docs.sparkSession
    facts = written(_families(docs, n, percent), "jaccard-parts")
    sizes = facts.where("kind = 'size'").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    release(spark)
    family = components(_near(facts), "jaccard-families")
    everyone = family.unionByName(family.select(F.col("component").alias("node"), "component").distinct())
    measured = everyone.join(sizes.groupBy("doc_id").agg(F.max("n_shingles").alias("n")), F.col("node") == F.col("doc_id")).select("node", "component", "n")
    blocks = measured.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK_ELEMENTS).cast("int").alias("blocks"))
    member = written(measured.join(blocks, "component").select("node", "component", "blocks"), "jaccard-members")

    spread = 4 * partitions_of(spark)  # links of equal sets are ready; they travel in groups that grow in number, not in size

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, int] = {}
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        names = ["family", "i", "j", "doc_id", "like", "elements"]
        for batch in column_chunks(batches):
            rows = []
            ids, texts, families, counts = (c.to_pylist() for c in batch.columns)
            for doc_id, one, count, elements in zip(ids, families, counts, shingler(n).sets(texts)):
                mark = xxhash.xxh3_128_digest(elements.tobytes())
                like = met.setdefault(mark, doc_id)
                if like != doc_id:
                    rows.append((_hashed(doc_id) % spread, -1, -1, doc_id, like, None))
                    continue
                block = _hashed(doc_id) % count
                for other in range(count):
                    rows.append((one, min(block, other), max(block, other), doc_id, None, elements.tobytes()))
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    texts = maybe_in(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")), "doc_id", member, "node")
    sent = texts.join(member, F.col("doc_id") == F.col("node")).select("doc_id", "text", "component", "blocks")
    sent = sent.mapInArrow(send, "family bigint, i int, j int, doc_id bigint, like bigint, elements binary")

    def grow(group: pa.Table) -> pa.Table:
        if group.column("i")[0].as_py() < 0:
            return pa.table({"a": group.column("doc_id"), "b": group.column("like")})
        sets = [np.frombuffer(e, np.uint64) for e in group.column("elements").to_pylist()]
        a, b = similar_within(group.column("doc_id").to_pylist(), sets, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = sent.groupBy("family", "i", "j").applyInArrow(grow, "a bigint, b bigint")
    linked = components(links, "jaccard-links")
    out = sizes.join(linked, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller doc_id; all columns unchanged.  Rows with a null id stay."""
    return without(docs, "doc_id", join(docs, n, percent).where("component_id < doc_id"), "doc_id")
