"""Snapshot differences and guards of an incremental refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stocktake.functions import paths as P
from stocktake.operators.joins import joined, kept

MOST_DIRTY = 128
#: Entries of a change log that forbid an incremental refresh, and the reason that they give.
LOSSES = {"dropped": "history", "overflow": "history_overflow", "root_changed": "volume_or_root"}


def _fingerprinted(rows: DataFrame, compared: list[str]) -> DataFrame:
    """(path, parent_path, h1, h2): two 64-bit digests of a row's compared columns; which of them are null is part of either.

    The columns are one struct before they are digested: the code made for so many single ones is too long to be compiled.
    """
    given = F.col("parent_path") if "parent_path" in compared else P.parent_path(F.col("path"))
    whole = rows.select("path", F.coalesce(given, F.lit("")).alias("parent_path"), F.struct(*compared).alias("_row"), F.array(*[F.col(c).isNull() for c in compared]).alias("_null"))
    return whole.select("path", "parent_path", *[F.xxhash64(F.lit(seed), "_row", "_null").alias(name) for seed, name in ((1, "h1"), (2, "h2"))])


def _by_directory(rows: DataFrame) -> DataFrame:
    """(parent_path, n, d1, d2): a digest of each directory's entries, which does not depend on their order."""
    total = lambda *of: F.sum(F.xxhash64(*of).cast("decimal(20,0)"))
    return rows.groupBy("parent_path").agg(F.count("*").alias("n"), total("path", "h1").alias("d1"), total("h2", "path").alias("d2"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed or modified, by every column that both have.

    Directories whose entries have one digest on both sides are settled by it. Only entries of the
    others are compared with one another, as path and digest: the shuffle follows the number of
    directories and of entries in those that differ. Digests have 128 bits.
    """
    compared = sorted(c for c in old.columns if c != "path" and c in new.columns)
    a, b = _fingerprinted(old, compared), _fingerprinted(new, compared)
    digests = _by_directory(a).withColumn("side", F.lit(0)).unionByName(_by_directory(b).withColumn("side", F.lit(1)))
    equal = (F.count("*") == 2) & (F.min("n") == F.max("n")) & (F.min("d1") == F.max("d1")) & (F.min("d2") == F.max("d2"))
    differing = kept(digests.groupBy("parent_path").agg(equal.alias("equal")).filter("NOT equal").select("parent_path"))
    left = joined(a, differing, "parent_path", "left_semi").select("path", F.struct("h1", "h2").alias("o"))
    right = joined(b, differing, "parent_path", "left_semi").select("path", F.struct("h1", "h2").alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "modified")
    return left.join(right, "path", "full_outer").select("path", change.alias("change")).filter("change IS NOT NULL")


def trust_verify(incremental: DataFrame, full: DataFrame) -> DataFrame:
    """One row: how many entries differ, and whether the incremental result can be trusted."""
    return snapshot_diff(incremental, full).agg(F.count("*").alias("differences")).withColumn("trusted", F.col("differences") == 0)


def fallback_reason(schema_version: Column, root: Column, volume: Column, options: Column, checkpoint: Column, expected: dict, dropped: Column, sound: Column, dirty: Column) -> Column:
    """The first guard that forbids an incremental refresh, or null. A null schema version: there is no snapshot; a negative one: it is unreadable."""
    return (F.when(schema_version.isNull(), "missing").when(schema_version < 0, "corrupt").when(schema_version != expected["schema_version"], "schema").when(root != expected["root"], "root")
            .when(volume != expected["volume"], "volume").when(options != expected["options"], "options").when(dropped | checkpoint.isNull(), "history").when(~sound, "inconsistent").when(dirty > MOST_DIRTY, "too_many_dirty"))


def dedupe_changes(changes: DataFrame) -> DataFrame:
    """A batch's changed paths, each once, with its last change."""
    return changes.groupBy("path").agg(F.max_by("change_type", F.struct("ts", "event_id")).alias("change_type"), F.count("*").alias("reports"))


def dedupe_stream(changes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The same on an unbounded stream: the first report of a path within the watermark."""
    return changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["path"])


def changes_per_window(changes: DataFrame, length: str = "1 hour") -> DataFrame:
    w = F.window("ts", length)
    return changes.groupBy(w.start.alias("window_start"), "change_type").agg(F.count("*").alias("changes"))
