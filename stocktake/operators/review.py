"""Checks before anything is removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stocktake.functions import paths as P
from stocktake.operators.joins import few, joined, kept
from stocktake.operators.tree import nested_pairs


def missing_targets(requested: DataFrame, present: DataFrame) -> DataFrame:
    """Requested paths, each once, that are not present. The present ones do not move while the requested are few, and once beyond that."""
    return _missing(kept(requested.select("path").distinct()), present)


def _missing(asked: DataFrame, present: DataFrame) -> DataFrame:
    if not few(asked):
        return asked.join(present.select("path").hint("merge"), "path", "left_anti")
    there = kept(present.select("path").join(F.broadcast(asked), "path", "left_semi").distinct())
    return joined(asked, there, "path", "left_anti")


def batch_preflight(requested: DataFrame, present: DataFrame) -> DataFrame:
    """One row: repeated, missing and nested targets, and the first verdict in that order. The batch is computed and made distinct once."""
    times = kept(requested.groupBy("path").agg(F.count("*").alias("times")))
    asked = times.select("path")
    counts = times.agg(F.coalesce(F.sum(F.when(F.col("path").isNotNull(), F.col("times") - 1)), F.lit(0)).alias("duplicates"))
    missing = _missing(asked, present).agg(F.count("*").alias("missing"))
    nested = nested_pairs(asked, distinct=True).agg(F.count("*").alias("nested"))
    verdict = F.when(F.col("duplicates") > 0, "duplicates").when(F.col("missing") > 0, "missing").when(F.col("nested") > 0, "nested").otherwise("ok")
    return counts.withColumn("missing", missing.scalar()).withColumn("nested", nested.scalar()).withColumn("verdict", verdict)


def protect_keepers(targets: DataFrame, keepers: DataFrame) -> DataFrame:
    """Targets that neither are a keeper nor hold one; keepers: keeper."""
    above = kept(keepers.select(F.explode(P.ancestors_or_self(F.col("keeper"))).alias("path")).distinct())
    return joined(targets, above, "path", "left_anti")


def changed_targets(reviewed: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) of reviewed rows that vanished or whose size, time (by more than a microsecond) or identity differ now."""
    now = current.select("path", F.col("byte_size").alias("n_size"), F.col("modified_at").alias("n_time"), F.col("identity").alias("n_identity"), F.lit(True).alias("there"))
    j = reviewed.join(now, "path", "left")
    differs = ~F.col("byte_size").eqNullSafe(F.col("n_size")) | ~F.coalesce(F.col("modified_at").between(F.expr("n_time - INTERVAL '0.000001' SECOND"), F.expr("n_time + INTERVAL '0.000001' SECOND")), F.col("modified_at").isNull() & F.col("n_time").isNull()) | ~F.col("identity").eqNullSafe(F.col("n_identity"))
    return j.select("path", F.when(F.col("there").isNull(), "vanished").when(differs, "changed").alias("change")).filter("change is not null")


def validate_copies(selected: DataFrame, members: DataFrame, fresh: DataFrame) -> DataFrame:
    """(path, valid): a selected copy needs an unselected member in its group and a fresh digest equal to the group's.

    selected: path; members: path, checksum; fresh: path, checksum as just computed.
    """
    flagged = members.join(selected.select("path", F.lit(True).alias("chosen")), "path", "left")
    keepers = flagged.filter("chosen is null").select("checksum").distinct().withColumn("has_keeper", F.lit(True))
    mine = flagged.filter("chosen").select("path", "checksum").join(keepers, "checksum", "left").join(fresh.select("path", F.col("checksum").alias("now")), "path", "left")
    state = mine.select("path", F.coalesce(F.col("has_keeper") & (F.col("checksum") == F.col("now")), F.lit(False)).alias("ok"))
    return selected.select("path").distinct().join(state, "path", "left").select("path", F.coalesce("ok", F.lit(False)).alias("valid"))
