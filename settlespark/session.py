"""Session settings and the shared folder for cut lineage and written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from gc import collect as collect_garbage

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for local runs and tests; on a cluster the submitter's settings are used as they are."""
    builder = (
        SparkSession.builder.appName("settlespark")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.  A folder of our own is made only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _own_folder[0]


def new_path(spark: SparkSession, label: str) -> str:
    # Folders starting with an underscore count as hidden.
    return os.path.join(shared_folder(spark), f"{label.lstrip('_')}-{uuid.uuid4().hex}")


# Bytes of a row group of a domain table.  A task reads whole row groups, so a table that one task wrote can be read by many.
ROW_GROUP = 8 << 20


def write_new(df: DataFrame, label: str, **options) -> str:
    path = new_path(df.sparkSession, label)
    df.write.mode("error").options(**options).parquet(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder and go on from the stored columns.

    Everything computed downstream then sees one and the same data, also after an executor is lost.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_new(df, label))


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store, whichever store that is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once what was computed from them is stored; a table that is still to be read must stay."""
    for df in tables:
        for folder in {os.path.dirname(file) for file in df.inputFiles()}:
            remove_folder(df.sparkSession, folder)
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs removed from the executors.

    Spark removes them once the driver has collected the frames they belong to, which a large driver heap may put off for very long.
    """
    collect_garbage()
    spark._jvm.System.gc()
