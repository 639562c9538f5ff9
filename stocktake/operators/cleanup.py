"""Cleanup candidates and reclaim plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stocktake.functions import lookups as L, paths as P
from stocktake.operators.duplicates import copies
from stocktake.operators.joins import joined, kept
from stocktake.operators.ranking import ranked
from stocktake.operators.tree import top_level


def rule_kind(as_of: str, days: int = 180, old_bytes: int = L.OLD_LARGE_BYTES, ext: Column | None = None) -> Column:
    """The first rule that names an entry (path, name, kind, size, modified_at), or null. ext: its extension, if that is at hand."""
    name, path, ext = F.lower("name"), F.lower("path"), P.file_extension(F.col("name")) if ext is None else ext
    box, file = P.is_container(F.col("kind")), F.col("kind") == "file"
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return (F.when(box & name.isin(*L.CACHE_NAMES), "cacheFolder").when(box & (name.isin(*L.BUILD_NAMES) | path.contains("/deriveddata/")), "buildArtifact")
            .when(file & ext.isin(*L.DISK_IMAGES), "diskImage").when(file & ext.isin(*L.INSTALLERS), "installer").when(file & ext.isin(*L.ARCHIVES), "archive")
            .when(file & (ext.isin(*L.TEMPORARY) | name.endswith("~")), "temporary").when(file & (F.col("size") >= old_bytes) & (F.col("modified_at") <= cutoff), "oldLargeFile"))


def rule_candidates(entries: DataFrame, as_of: str, days: int = 180, old_bytes: int = L.OLD_LARGE_BYTES) -> DataFrame:
    """Entries that a rule names; the first rule wins."""
    return entries.withColumn("candidate_kind", rule_kind(as_of, days, old_bytes)).filter("candidate_kind is not null")


def cleanup_candidates(entries: DataFrame, verified: DataFrame, as_of: str, root: str = "/", days: int = 180, old_bytes: int = L.OLD_LARGE_BYTES) -> DataFrame:
    """(candidate_id, candidate_kind, path, name, size, reason, confidence, reclaimable_bytes).

    verified: path and checksum of verified duplicates; all but the first path of each group are
    candidates of their own and leave the rules. The entries are read once.
    """
    ruled = entries.withColumn("_ext", P.file_extension(F.col("name"))).withColumn("_rule", F.when(F.col("path") != root, rule_kind(as_of, days, old_bytes, F.col("_ext"))))  # once a row, before the filter asks for it
    named = joined(ruled, kept(copies(verified).withColumn("copy", F.lit(True))), "path", "left")
    kind = F.when(F.col("copy"), "verifiedDuplicate").otherwise(F.col("_rule"))
    found, kind = named.withColumn("candidate_kind", kind).filter("candidate_kind is not null"), F.col("candidate_kind")
    return found.select(
        P.candidate_id(kind, F.col("path")).alias("candidate_id"), "candidate_kind", "path", "name", "size", L.trust_field(kind, 1).alias("reason"), L.trust_field(kind, 0).alias("confidence"), F.col("size").alias("reclaimable_bytes"))


def rank_candidates(candidates: DataFrame, k: int = 500) -> DataFrame:
    keyed = candidates.withColumn("confidence_rank", P.confidence_rank(F.col("confidence"))).withColumn("natural", P.natural_order(F.col("name")))
    return ranked(keyed, k, F.asc("confidence_rank"), F.desc("reclaimable_bytes"), F.asc("natural"), F.asc("path"))


def trust_details(candidates: DataFrame) -> DataFrame:
    kind = F.col("candidate_kind")
    label = L.literal_map(L.CONFIDENCE_LABELS)[L.trust_field(kind, 0)]
    return candidates.select("candidate_id", L.trust_field(kind, 1).alias("flagged_reason"), label.alias("confidence_label"), L.trust_field(kind, 2).alias("could_break"), L.trust_field(kind, 3).alias("safety_note"), L.trust_field(kind, 4).alias("suggested_action"))


def reclaim_total(candidates: DataFrame) -> DataFrame:
    """Reclaimable bytes, nothing counted twice when its folder is listed too."""
    return top_level(candidates.select("path", "reclaimable_bytes")).agg(F.count("*").alias("item_count"), F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes"))


def reclaim_plan(candidates: DataFrame, inaccessible: DataFrame) -> DataFrame:
    """Up to three sections in order: verified copies, suggestions to review, unreadable entries (one row: n). The candidates are computed once."""
    candidates = kept(candidates.select("path", "candidate_kind", "reclaimable_bytes"))
    lane = lambda name, order, cond: reclaim_total(candidates.filter(cond)).select(F.lit(order).alias("section_order"), F.lit(name).alias("section"), "item_count", "reclaimable_bytes")
    verified = F.col("candidate_kind") == "verifiedDuplicate"
    gaps = inaccessible.select(F.lit(3).alias("section_order"), F.lit("access_gaps").alias("section"), F.col("n").alias("item_count"), F.lit(0).cast("bigint").alias("reclaimable_bytes"))
    return lane("verified", 1, verified).unionByName(lane("review", 2, ~verified)).unionByName(gaps).filter("item_count > 0")


#: What a section of the plan asks for.
ACTIONS = {"verified": "review_verified_copies", "review": "review_suggestions", "access_gaps": "inspect_unreadable"}


def reclaim_plan_present(candidates: DataFrame, inaccessible: DataFrame, present: DataFrame) -> DataFrame:
    """``reclaim_plan`` of those candidates whose path is present, collapsed before they are divided into lanes.

    present: path, one row each. Every row carries its section's action, whether that is the plan's
    primary action (its first section's), and how many candidates are missing. An empty plan has no row.
    """
    candidates = kept(candidates.select("path", "candidate_kind", "reclaimable_bytes"))
    there = kept(joined(present.select("path"), candidates.select("path"), "path", "left_semi").withColumn("there", F.lit(True)))
    known = kept(joined(candidates, there, "path", "left"))
    missing = known.agg(F.count_if(F.col("there").isNull()).alias("missing_count"))
    plan = kept(reclaim_plan(top_level(known.filter("there").drop("there")), inaccessible))
    first = plan.agg(F.min("section_order"))
    return plan.select("section_order", "section", "item_count", "reclaimable_bytes", L.literal_map(ACTIONS)[F.col("section")].alias("action"), (F.col("section_order") == first.scalar()).alias("is_primary"), missing.scalar().alias("missing_count"))


def review_summary(candidates: DataFrame) -> DataFrame:
    top = top_level(candidates.select("path", "candidate_kind", "reclaimable_bytes", "confidence"))
    verified = F.col("candidate_kind") == "verifiedDuplicate"
    return top.agg(F.count("*").alias("item_count"), F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes"), F.count_if(verified).alias("verified_count"), F.count_if(~verified).alias("review_count"), F.coalesce(F.bool_or(F.col("confidence") == "review"), F.lit(False)).alias("has_review_risk"))
