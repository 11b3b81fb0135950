"""Reading tables, connected components and a bounded membership filter, shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from settlespark.session import remove, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "settlespark_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))  # Spark hands the file to every executor


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def partitions_of(spark: SparkSession) -> int:
    """The submitted number of shuffle partitions, which follows the size of the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def column_chunks(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task holds stays small when texts are long."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Forest:
    """Union-find whose root is the least member, over what one task holds."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def forest_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its tree) for every node but the roots: the same components with fewer edges than nodes."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    pairs = np.unique(np.stack([at[: len(a)], at[len(a):]]), axis=1)
    trees = Forest(len(nodes))
    for x, y in pairs.T.tolist():
        trees.join(x, y)
    roots = np.fromiter((trees.root(i) for i in range(len(nodes))), dtype=np.int64, count=len(nodes))
    moved = np.flatnonzero(roots != np.arange(len(nodes)))
    return nodes[moved], nodes[roots[moved]]


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the least node reachable over ``edges`` (a, b), for every node of an edge between different nodes.

    Alternates the large-star and small-star steps: every step points neighbours at the least node of a neighbourhood, which keeps
    the components and ends, after a number of steps that grows with the logarithm of the longest path, in one star per component.
    Only minima are grouped, combined before the shuffle; no neighbourhood is gathered.  Each step is written to the shared
    folder, so a lost executor repeats one step; the step before it is then removed.
    """
    edges = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label
    )
    while True:
        # Edges point downwards.  An edge whose lower end has something below moves there; most end in a least node already, and the many
        # edges of such a hub are told by a bitmap instead of a join on it.
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        flagged, maybe = _flagged(edges, "b", least, "a", FILTER_BITS)
        lower = least.select(F.col("a").alias("_u"), F.col("m").alias("_m"))
        moved = flagged.where(maybe).join(lower, F.col("b") == F.col("_u"), "left").select("a", F.coalesce("_m", "b").alias("b"))
        large = moved.unionByName(flagged.where(~F.col(maybe)).select("a", "b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        )).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        before, edges = edges, written(small, label)
        # A star forest is a fixed point: the same edges come out again.
        summary = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
        unchanged = before.agg(*summary).first() == edges.agg(*summary).first()
        remove(before)
        if unchanged:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


#: Bits of the membership filter; 2**23 bits are 1 MB in 131,072 words.
FILTER_BITS = 1 << 23


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores appended until no column of ``rows`` has it; Spark does not tell names apart by case."""
    taken, found = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def columns_of(rows: DataFrame) -> list[Column]:
    """All columns of ``rows``, whatever characters their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in rows.columns]


def _listed(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else keys


def _flagged(rows: DataFrame, key: str | list[str], members: DataFrame, member_key: str | list[str], bits: int) -> tuple[DataFrame, str]:
    """The rows with one more column, and its name: whether the key may be among the members."""
    maybe, slot, word, held = fresh(rows, "maybe", "slot", "word", "held")
    place = lambda keys: F.pmod(F.xxhash64(*_listed(keys)), F.lit(bits))
    bitmap = (
        members.select(place(member_key).alias("s"))
        .groupBy(F.expr("s div 64").alias(word))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias(held))
    )
    found = rows.withColumn(slot, place(key)).withColumn(word, F.expr(f"{slot} div 64")).join(F.broadcast(bitmap), word, "left")
    return found.select(*columns_of(rows), F.coalesce(F.expr(f"getbit({held}, cast({slot} % 64 as int)) = 1"), F.lit(False)).alias(maybe)), maybe


def maybe_in(rows: DataFrame, key: str, members: DataFrame, member_key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose long ``key`` may be among the members; some others pass, none is lost.

    A bitmap of fixed size, made by a combinable aggregate: at most ``bits / 64`` rows, 2 MB at the default, whatever the number of
    members.  That is the proven bound behind the broadcast.  It spares the shuffle of texts that an exact join would discard; where the
    members fill the bitmap it spares nothing and harms nothing.
    """
    found, maybe = _flagged(rows, key, members, member_key, bits)
    return found.where(maybe).drop(maybe)


def joined_where_present(
    rows: DataFrame, key: str | list[str], facts: DataFrame, fact_key: str | list[str], name: str, bits: int = FILTER_BITS
) -> DataFrame:
    """A left join on ``key`` (one or more long columns) that shuffles only rows which may have a partner in ``facts`` (unique by ``fact_key``).

    All columns of rows, then ``name`` (take a fresh one), a struct of the columns of facts but its key; null where there is no partner.
    Null keys have no partner.
    """
    flagged, maybe = _flagged(rows, key, facts, fact_key, bits)
    keys, fact_keys = _listed(key), _listed(fact_key)
    extra = [c for c in facts.columns if c not in fact_keys]
    kind = ", ".join(f"{c}: {facts.schema[c].dataType.simpleString()}" for c in extra)
    partner, *theirs = fresh(flagged, name, *[f"fact_{k}" for k in fact_keys])
    side = facts.select(*[F.col(k).alias(t) for k, t in zip(fact_keys, theirs)], F.struct(*extra).alias(partner))
    same = [F.col(k) == F.col(t) for k, t in zip(keys, theirs)]
    some = flagged.where(maybe).join(side, same, "left").select(*columns_of(rows), F.col(partner).alias(name))
    none = flagged.where(~F.col(maybe)).select(*columns_of(rows), F.lit(None).cast(f"struct<{kind}>").alias(name))
    return some.unionByName(none)


def without(rows: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """The rows whose ``key`` is not among those of ``gone``, all columns unchanged; rows with a null key stay."""
    (found,) = fresh(rows, "found")
    facts = gone.select(F.col(gone_key).alias("gone_key")).distinct().select("gone_key", F.lit(True).alias("gone"))
    return joined_where_present(rows, key, facts, "gone_key", found).where(f"{found} is null").select(*columns_of(rows))
