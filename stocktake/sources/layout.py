"""Tables laid out by the columns that lookups and joins go by."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def save_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int = 64) -> DataFrame:
    """Write a table ``name`` of the session's catalog in buckets of the keys, sorted by them, and read it back.

    Two tables in as many buckets of the same keys join by them without an exchange, and an equality
    on a single key reads one bucket. Contents are laid out by byte_size and path, digest caches and inventories by path. An
    existing table of that name is replaced, unless ``df`` reads it.
    """
    head, *rest = keys
    df.repartition(buckets, *map(F.col, keys)).write.mode("overwrite").bucketBy(buckets, head, *rest).sortBy(head, *rest).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)
