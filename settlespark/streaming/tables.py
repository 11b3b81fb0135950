"""Tables that a stream writes one piece per micro-batch, and that are merged behind it.

A piece covers a range of epochs.  Each micro-batch writes the piece of its own epoch, and a replayed one overwrites it.  As soon as enough
pieces of similar width stand side by side they are merged into one that covers them all, so after n epochs some ``every`` * log(n) pieces are left
instead of n, and a row is rewritten log(n) times.  A piece counts once its commit file is there, and only if no wider one covers it: that
is the switch, and readers see either the old pieces or the new one.  Covered pieces stay until the next merge, for the readers that have
already begun.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

EVERY = 16


class EpochTable:
    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame] | None = None, every: int = EVERY):
        """``merge`` turns the rows of several pieces into fewer that say the same; without it rows are only put together."""
        self.spark, self.path, self.merge, self.every = spark, path, merge, every
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._at = lambda name: jvm_path(f"{path}/{name}" if name else path)
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _name(self, first: int, last: int) -> str:
        return f"from-{first}-to-{last}"

    def _complete(self) -> list[tuple[int, int]]:
        """The ranges of all committed pieces."""
        if not self._files.exists(self._at("")):
            return []
        found = []
        for status in self._files.listStatus(self._at("")):
            part = status.getPath().getName().split("-")
            if len(part) == 4 and part[0] == "from" and self._files.exists(self._at(f"{status.getPath().getName()}/_SUCCESS")):
                found.append((int(part[1]), int(part[3])))
        return sorted(found)

    @staticmethod
    def _covered(piece: tuple[int, int], others: list[tuple[int, int]]) -> bool:
        return any(o != piece and o[0] <= piece[0] and piece[1] <= o[1] for o in others)

    def pieces(self) -> list[tuple[int, int]]:
        every = self._complete()
        return [p for p in every if not self._covered(p, every)]

    def write(self, rows: DataFrame, epoch: int) -> DataFrame:
        """Store the epoch's piece and return it as stored."""
        out = f"{self.path}/{self._name(epoch, epoch)}"
        rows.write.mode("overwrite").parquet(out)
        return self.spark.read.schema(rows.schema).parquet(out)

    def read(self, schema: StructType, before: int | None = None) -> DataFrame:
        """All rows, or those of the epochs before one."""
        names = [f"{self.path}/{self._name(*p)}" for p in self.pieces() if before is None or p[1] < before]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def read_epoch(self, schema: StructType, epoch: int) -> DataFrame:
        """The rows of one epoch's own piece, none if there is no such piece."""
        if (epoch, epoch) not in self._complete():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{self._name(epoch, epoch)}")

    def schema(self) -> StructType | None:
        found = self.pieces()
        return self.spark.read.parquet(f"{self.path}/{self._name(*found[-1])}").schema if found else None

    def compact(self, before: int) -> None:
        """Merge among the pieces of the epochs before one; those are final, whatever is replayed later."""
        complete = self._complete()
        for old in complete:
            if self._covered(old, complete):
                self._files.delete(self._at(self._name(*old)), True)
        while True:
            live = [p for p in self.pieces() if p[1] < before]
            width = min((p[1] - p[0] + 1 for p in live), default=0)
            last = []
            while live and live[-1][1] - live[-1][0] + 1 < width * self.every:
                last.append(live.pop())
            if len(last) < self.every:
                return
            first, end = last[-1][0], last[0][1]
            rows = self.spark.read.parquet(*[f"{self.path}/{self._name(*p)}" for p in last])
            rows = self.merge(rows) if self.merge else rows
            rows.write.mode("overwrite").parquet(f"{self.path}/{self._name(first, end)}")

    def keep_from(self, epoch: int) -> None:
        """Remove the pieces of the epochs before one, where each piece tells the whole."""
        for piece in self._complete():
            if piece[1] < epoch:
                self._files.delete(self._at(self._name(*piece)), True)
