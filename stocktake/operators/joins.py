"""Narrow tables that several steps use, and joins whose strategy follows a counted size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

#: Rows of a narrow table that may be broadcast.
FEW_ROWS = 500_000


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once: a reliable checkpoint in ``spark.checkpoint.dir`` (a local folder only where that is unset and all runs in one process)."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="stocktake-"))
    return df.checkpoint()


def few(df: DataFrame) -> bool:
    """Whether a kept narrow table may be broadcast. It is counted whole: a limit would first gather that many rows of every partition in one task."""
    return df.count() <= FEW_ROWS


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """``left`` joined with a kept narrow table: broadcast while it has few rows, by key beyond that."""
    return left.join(right.hint("broadcast" if few(right) else "merge"), on, how)
