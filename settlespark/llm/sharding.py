"""Minimax contiguous partition of groups of equal texts into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from settlespark.llm.common import text_of

#: Hex digits of a group's key by which the first and every further look divides the line of groups.
FIRST_DIGITS, NEXT_DIGITS, KEY_DIGITS = 3, 2, 32
#: Parts of a shard inside which rows are numbered; their counts are the bounded table behind the broadcast.
NUMBERING_PARTS = 256


class _Line:
    """The line of groups, known as cells [key prefix, bytes]; a cell is exact when it holds one group."""

    def __init__(self, cells: list[tuple[str, int, bool]]):
        self.cells = sorted(cells)

    def refine(self, prefixes: set[str], finer: list[tuple[str, int, bool]]) -> None:
        self.cells = sorted([c for c in self.cells if c[0] not in prefixes] + finer)

    def reach(self, capacity: int, shards: int, generous: bool, at: int = 0) -> tuple[list[int], int]:
        """Ends of the shards (in cells) by the greedy check, and the bytes that are left over.

        A cell of several groups can't be cut where it isn't known.  Generous: it is cut wherever it suits, so success only means
        "perhaps".  Otherwise it is cut only at its borders, so success is certain.
        """
        ends, rest = [], 0  # rest: bytes of cell ``at`` that are placed already (generous only)
        for _ in range(shards):
            room = capacity
            while at < len(self.cells):
                _, size, whole = self.cells[at]
                size -= rest
                if size <= room:
                    room -= size
                    at, rest = at + 1, 0
                elif generous and not whole:
                    rest += room
                    break
                else:
                    break
            ends.append(at)
        return ends, sum(c[1] for c in self.cells[at:]) - rest


    def even_ends(self, capacity: int, shards: int) -> list[int]:
        """Ends of the shards for a feasible capacity, each as near to an even share of the rest as keeps the rest feasible."""
        ends, at = [], 0
        for left in range(shards, 0, -1):
            farthest = self.reach(capacity, 1, False, at)[0][0]
            share, size, end = sum(c[1] for c in self.cells[at:]) / left, 0, at
            while end < farthest and (size == 0 or abs(size + self.cells[end][1] - share) <= abs(size - share)):
                size += self.cells[end][1]
                end += 1
            if end < farthest and self.reach(capacity, left - 1, False, end)[1] > 0:
                end = farthest
            ends.append(end)
            at = end
        return ends


def _least(line: _Line, shards: int, generous: bool, low: int, high: int) -> int:
    """Binary search for the smallest capacity in [low, high] that the greedy check accepts; high is accepted."""
    while low < high:
        middle = (low + high) // 2
        if line.reach(middle, shards, generous)[1] <= 0:
            high = middle
        else:
            low = middle + 1
    return low


def capacity_and_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest feasible capacity and the first key of shards 1, 2, … over groups (group_key, group_bytes).

    ``group_key`` has 32 hex digits and orders the groups.  The driver never sees the groups: it holds sums per key prefix, 4,096 at first,
    and asks for finer sums only in the cells in which a cut may still fall, at most a few for each shard.  Each look is one
    aggregate that is combined before its shuffle.
    """

    def look(digits: int, among: DataFrame) -> list[tuple[str, int, bool]]:
        found = among.groupBy(F.substring("group_key", 1, digits).alias("prefix")).agg(
            F.sum("group_bytes").alias("bytes"), (F.min("group_key") == F.max("group_key")).alias("single")
        )
        return [(r.prefix, r.bytes, bool(r.single)) for r in found.collect()]

    line = _Line(look(FIRST_DIGITS, groups))
    total = sum(c[1] for c in line.cells)
    if not line.cells:
        return 0, [""] * (shards - 1)
    digits = FIRST_DIGITS
    while True:
        largest = max(c[1] for c in line.cells)
        floor = max(-(-total // shards), max((c[1] for c in line.cells if c[2]), default=1))
        high = _least(line, shards, False, floor, floor + largest + total)
        low = _least(line, shards, True, floor, high)
        doubtful = {line.cells[i][0] for i in _between(line, low, high, shards) if not line.cells[i][2]}
        if not doubtful or digits >= KEY_DIGITS:
            break
        digits += NEXT_DIGITS
        prefix_lengths = sorted({len(p) for p in doubtful})
        wanted = None
        for n in prefix_lengths:
            term = F.substring("group_key", 1, n).isin(sorted(p for p in doubtful if len(p) == n))
            wanted = term if wanted is None else wanted | term
        line.refine(doubtful, look(digits, groups.where(wanted)))
    ends = line.even_ends(high, shards)
    return high, [line.cells[e][0] if e < len(line.cells) else "g" for e in ends[:-1]]


def _between(line: _Line, low: int, high: int, shards: int) -> set[int]:
    """Cells in which the end of a shard may lie for a capacity from low (cells cut anywhere) to high (cells kept whole)."""
    first, _ = line.reach(low, shards, False)
    last, _ = line.reach(high, shards, True)
    n = len(line.cells)
    return {i for a, b in zip(first, last) for i in range(max(0, a), min(n, b + 1)) if not line.cells[i][2]}


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, text).

    Size is the number of UTF-8 bytes and one more; a null text counts as empty.  Rows with equal texts form a group, which is never
    divided; groups are ordered by the MD5 of their text and cut into contiguous shards whose largest size is the smallest possible.  One
    group larger than an even share gets a shard that is as large as it is.  Slots number the rows of a shard from 0 without gaps.
    Repeated rows keep their own slots.  An empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint"), F.octet_length(text_of()).cast("bigint").alias("_n"), F.crc32(text_of()).alias("text_crc32"),
        F.md5(text_of()).alias("group_key"),
    ).select("doc_id", (F.col("_n") + 1).alias("size"), "text_crc32", "group_key")
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("group_bytes"))
    _, cuts = capacity_and_cuts(groups, shards)
    placed = F.lit(0)
    for cut in cuts:
        placed = placed + (F.col("group_key") >= F.lit(cut)).cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", placed.alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(NUMBERING_PARTS)).alias("_part"))
    counts = rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.select(
        F.col("shard").alias("_s"), F.col("_part").alias("_p"),
        F.coalesce(F.sum("_rows").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    numbered = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size")))
    out = numbered.join(F.broadcast(before), (F.col("shard") == F.col("_s")) & (F.col("_part") == F.col("_p")))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_nth") - 1 + F.col("_before")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
