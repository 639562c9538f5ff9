"""Shared scratch tables and files.

Everything that outlives a task goes below the folder the cluster names in
``spark.checkpoint.dir``; only where that is unset and driver and executors are one process (tests,
a laptop) is a local folder made and set. Paths are URIs, opened through ``pyarrow.fs`` so that file:, hdfs: and s3: behave alike.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, without a trailing slash."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        root = sc._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stocktake-")
        sc.setCheckpointDir(root)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + root
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared scratch folder; nothing is created yet."""
    return f"{shared_root(spark)}/stocktake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to shared scratch and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that may be broadcast (some tens of megabytes when narrow).
FEW_ROWS = 500_000


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """``left`` joined with a narrow written table: broadcast while it has few rows, by key beyond that. It is counted whole: a limit would first gather that many rows of every partition in one task."""
    few = right.count() <= FEW_ROWS
    return left.join(right.hint("broadcast" if few else "merge"), on, how)


def open_fs(uri: str):
    """(file system, path) for a URI; usable in tasks."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts) -> int:
    """Write byte strings to a new file by way of a rename, so readers never see half a file."""
    system, path = open_fs(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    partial = f"{path}.{uuid.uuid4().hex}.partial"
    size = 0
    with system.open_output_stream(partial) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    system.move(partial, path)
    return size


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
