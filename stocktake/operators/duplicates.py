"""Duplicate detection by size, prefix digest and full digest, and what builds on its groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stocktake.functions import paths as P
from stocktake.operators.filters import hardlink_filter
from stocktake.operators.joins import few, joined, kept


def duplicate_candidates(inv: DataFrame, threshold: int = 0, cap: int | None = None) -> DataFrame:
    """Single-link files of at least the threshold; of those, the cap's largest."""
    files = hardlink_filter(inv).filter(F.col("byte_size") >= threshold)
    return files if cap is None else files.orderBy(F.desc("byte_size"), "path").limit(cap)


def same_size(files: DataFrame) -> DataFrame:
    """Rows whose byte size another row shares. The sizes are counted first; while they are few no row moves for it, and a size that very many files have stays spread out."""
    sizes = kept(files.groupBy("byte_size").agg(F.count("*").alias("n")).filter("n > 1").select("byte_size"))
    return joined(files, sizes, "byte_size", "left_semi")


def size_groups(files: DataFrame) -> DataFrame:
    """(byte_size, file_count, total_bytes, reclaimable_bytes) of sizes that several files share."""
    return files.groupBy("byte_size").agg(F.count("*").alias("file_count")).filter("file_count > 1").select(
        "byte_size", "file_count", (F.col("byte_size") * F.col("file_count")).alias("total_bytes"), (F.col("byte_size") * (F.col("file_count") - 1)).alias("reclaimable_bytes"))


def numbered_members(files: DataFrame) -> DataFrame:
    """(byte_size, path, nth): members of the size groups, numbered from 0 in path order; by ranges, so a size that very many files have is no single task."""
    spark = files.sparkSession
    order = [F.asc("byte_size"), F.asc("path")]
    cut = kept(same_size(files).select("byte_size", "path").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("byte_size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = cut.groupBy("_part", "byte_size").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(before)).filter("before IS NOT NULL").select("_part", "byte_size", "before")  # the first size of a range at most
    own = F.row_number().over(Window.partitionBy("_part", "byte_size").orderBy("path"))
    return cut.withColumn("nth", own - 1).join(F.broadcast(earlier), ["_part", "byte_size"], "left").select("byte_size", "path", (F.col("nth") + F.coalesce("before", F.lit(0))).cast("bigint").alias("nth"))


def size_group_pages(files: DataFrame, page: int = 1000) -> DataFrame:
    """(byte_size, page, file_count, members): each size group's paths in order, ``page`` at most in a row."""
    of = numbered_members(files).withColumn("page", F.floor(F.col("nth") / page).cast("bigint"))
    return of.groupBy("byte_size", "page").agg(F.count("*").alias("file_count"), F.array_sort(F.collect_list("path")).alias("members"))


def size_group_ids(pages: DataFrame, fan: int = 1000) -> DataFrame:
    """(byte_size, group_id): the size and a digest of the members in order.

    A page's digest is that of its paths, joined by line ends; digests of ``fan`` pages in order are
    digested together (a single one stays as it is), and so on until each group has one. No value holds more than that many.
    """
    level = kept(pages.select("byte_size", F.col("page").alias("at"), F.sha2(F.array_join("members", "\n"), 256).alias("digest")))
    while not level.filter("at > 0").isEmpty():
        together = F.array_sort(F.collect_list(F.struct("at", "digest")))
        level = kept(level.groupBy("byte_size", F.floor(F.col("at") / fan).cast("bigint").alias("up")).agg(together.alias("d"))
                     .select("byte_size", F.col("up").alias("at"), F.when(F.size("d") == 1, F.col("d")[0]["digest"]).otherwise(F.sha2(F.array_join(F.transform("d", lambda x: x["digest"]), "\n"), 256)).alias("digest")))
    return level.select("byte_size", F.concat_ws("-", F.col("byte_size").cast("string"), "digest").alias("group_id"))


def _heads(files: DataFrame, contents: DataFrame, prefix: int) -> DataFrame:
    """(path, byte_size, head) of files whose size another one shares. The prefix is hashed where contents are read; only digests move."""
    read = contents.select("path", F.octet_length("content").cast("bigint").alias("there"), P.prefix_sha256(F.col("content"), prefix).alias("head"))
    return read.join(same_size(files).select("path", "byte_size").hint("merge"), "path").select("path", "byte_size", "there", "head")


def verified_members(files: DataFrame, contents: DataFrame, prefix: int = 65_536) -> DataFrame:
    """(path, byte_size, checksum) of files whose whole bytes another file shares; contents: path, content.

    Size, then prefix digest, then full digest: each tier hashes only what the one before left, where
    contents are read; beyond a number of paths that can be sent to all tasks, every content is hashed there.
    """
    heads = kept(_heads(files, contents, prefix).filter("there = byte_size").drop("there"))
    close = kept(heads.groupBy("byte_size", "head").agg(F.count("*").alias("n")).filter("n > 1").select("byte_size", "head"))
    left = kept(joined(heads, close, ["byte_size", "head"], "left_semi").select("path", "byte_size"))
    digest = P.content_sha256(F.col("content")).alias("checksum")
    if few(left):
        full = contents.join(F.broadcast(left), "path").select("path", "byte_size", digest)
    else:
        full = contents.select("path", digest).join(left.hint("merge"), "path").select("path", "byte_size", "checksum")
    full = kept(full)
    equal = kept(full.groupBy("byte_size", "checksum").agg(F.count("*").alias("n")).filter("n > 1").select("byte_size", "checksum"))
    return joined(full, equal, ["byte_size", "checksum"], "left_semi").select("path", "byte_size", "checksum")


def verify_size(files: DataFrame, contents: DataFrame, byte_size: int, prefix: int = 65_536) -> DataFrame:
    """``verified_members`` of one size group, on demand. Where contents (path, content, and byte_size if they have it) are laid out
    by size (``sources.layout``), only that size's files are read."""
    one = F.col("byte_size") == byte_size
    read = contents.filter(one).select("path", "content") if "byte_size" in contents.columns else contents.filter(F.octet_length("content") == byte_size)
    return verified_members(files.filter(one), read, prefix)


def still_the_same(members: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """Members (path, byte_size, checksum) whose size and identity are after reading what they were before, and whose group still has two such.

    before, now: path, byte_size, identity of the files. A member that has vanished, or whose identity
    is unknown on either side, has none to compare and leaves too.
    """
    was = before.select("path", F.col("byte_size").alias("_size"), F.col("identity").alias("_identity"))
    known = kept(members.select("path", "byte_size", "checksum"))
    both = joined(was, known.select("path"), "path", "left_semi")
    here = joined(now.select("path", F.col("byte_size").alias("_now"), F.col("identity").alias("_now_identity")), known.select("path"), "path", "left_semi")
    same = kept(both.join(here.hint("merge"), "path").filter("_size = _now AND _identity = _now_identity").select("path"))
    rest = kept(joined(known, same, "path", "left_semi"))
    groups = kept(rest.groupBy("byte_size", "checksum").agg(F.count("*").alias("n")).filter("n > 1").select("byte_size", "checksum"))
    return joined(rest, groups, ["byte_size", "checksum"], "left_semi").select("path", "byte_size", "checksum")


def verified_groups(members: DataFrame) -> DataFrame:
    """(group_id, byte_size, checksum, file_count, reclaimable_bytes, first_path)."""
    return members.groupBy("byte_size", "checksum").agg(F.count("*").alias("file_count"), F.min("path").alias("first_path")).select(
        F.concat_ws("-", F.col("byte_size").cast("string"), "checksum").alias("group_id"), "byte_size", "checksum", "file_count", (F.col("byte_size") * (F.col("file_count") - 1)).alias("reclaimable_bytes"), "first_path")


def copies(members: DataFrame) -> DataFrame:
    """(path) of all members but the first path of each group."""
    known = kept(members.select("path", "checksum"))
    first = kept(known.groupBy("checksum").agg(F.min("path").alias("first")))
    return joined(known, first, "checksum").filter("path <> first").select("path").distinct()


def verification_cost(files: DataFrame, contents: DataFrame, prefix: int = 65_536) -> DataFrame:
    """One row: bytes the tiers read, bytes that hashing everything reads, files in either tier."""
    groups = _heads(files, contents, prefix).groupBy("byte_size", "head").agg(F.count("*").alias("n"))
    again = (F.col("n") > 1) & (F.col("byte_size") > prefix)
    return groups.agg(F.sum(F.col("n") * (F.least("byte_size", F.lit(prefix)) + F.when(again, F.col("byte_size")).otherwise(0))).alias("tiered_bytes"),
                      F.sum(F.col("n") * F.col("byte_size")).alias("naive_bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum(F.when(again, F.col("n"))), F.lit(0)).alias("full_reads"))


def budget_groups(groups: DataFrame, byte_limit: int, file_limit: int, at_once: int = 1000) -> DataFrame:
    """Groups in order of gain that fit both budgets; one that does not fit is skipped and the walk goes on.

    The walk is sequential by nature. Each step asks for the first ``at_once`` groups behind the
    last one taken that still fit by themselves, and takes of these what fits together; at least
    the first does. A group holds two files or more, so there are at most ``file_limit`` / 2 steps
    and groups taken, however many groups there are.
    """
    if byte_limit <= 0 or file_limit <= 0:
        return groups.limit(0)
    order = [F.desc("reclaimable_bytes"), F.desc("byte_size")]
    known = kept(groups.select("byte_size", "reclaimable_bytes", "total_bytes", "file_count").filter((F.col("total_bytes") <= byte_limit) & (F.col("file_count") <= file_limit)))
    behind, taken, bytes_left, files_left = F.lit(True), [], byte_limit, file_limit
    while found := known.filter(behind & (F.col("total_bytes") <= bytes_left) & (F.col("file_count") <= files_left)).orderBy(*order).limit(at_once).collect():
        for g in found:
            if g["total_bytes"] <= bytes_left and g["file_count"] <= files_left:
                taken.append((g["byte_size"],))
                bytes_left, files_left = bytes_left - g["total_bytes"], files_left - g["file_count"]
        last = found[-1]
        behind = (F.col("reclaimable_bytes") < last["reclaimable_bytes"]) | (F.col("reclaimable_bytes") == last["reclaimable_bytes"]) & (F.col("byte_size") < last["byte_size"])
    chosen = groups.sparkSession.createDataFrame(taken, "byte_size bigint")
    return groups.join(F.broadcast(chosen), "byte_size", "left_semi")


def unverified_groups(files: DataFrame, members: DataFrame) -> DataFrame:
    """Size groups of the files that no verified group holds."""
    return size_groups(files.join(members.select("path"), "path", "left_anti"))


def merge_verified(scanned: DataFrame, on_demand: DataFrame) -> DataFrame:
    """Groups of both kinds by checksum; the on-demand one wins."""
    both = scanned.withColumn("origin", F.lit("scan")).unionByName(on_demand.withColumn("origin", F.lit("on_demand")))
    first = Window.partitionBy("checksum").orderBy(F.when(F.col("origin") == "on_demand", 0).otherwise(1))
    return both.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")


def visible_groups(members: DataFrame, condition, least: int = 0) -> DataFrame:
    """Groups of at least the size with two or more members that meet the condition."""
    return verified_groups(members.filter((F.col("byte_size") >= least) & condition))


def pick_keeper(groups: DataFrame, overrides: DataFrame) -> DataFrame:
    """(checksum, keeper): the override if there is one, else the first path."""
    return groups.join(overrides.select("checksum", F.col("path").alias("chosen")), "checksum", "left").select("checksum", F.coalesce("chosen", "first_path").alias("keeper"))


def already_verified(files: DataFrame, members: DataFrame) -> DataFrame:
    """(byte_size, verified): whether one verified group holds every member of a size group."""
    both = same_size(files).select("path", "byte_size").join(members.select("path", "checksum"), "path", "left")
    return both.groupBy("byte_size").agg(((F.count("checksum") == F.count("*")) & (F.min("checksum") == F.max("checksum"))).alias("verified"))


def cached_checksums(files: DataFrame, cache: DataFrame, prefix_bytes: int | None = None) -> DataFrame:
    """Files with the cached digests where path, size, mtime and identity all agree (two unknown identities do); ``hit`` says whether.

    With ``prefix_bytes``, prefix_checksum is the cached prefix digest of that length, if there is one.
    """
    c = cache.select("path", F.col("byte_size").alias("c_size"), F.col("modified_at").alias("c_time"), F.col("identity").alias("c_identity"), F.col("checksum").alias("c_checksum"),
                     *([] if prefix_bytes is None else [F.col("prefix_checksum").alias("c_prefix"), F.col("prefix_bytes").alias("c_prefix_bytes")]))
    same = (F.col("byte_size") == F.col("c_size")) & F.col("modified_at").eqNullSafe(F.col("c_time")) & F.col("identity").eqNullSafe(F.col("c_identity"))
    both = files.select("path", "byte_size", "modified_at", "identity").join(c, "path", "left")
    prefix = [] if prefix_bytes is None else [F.when(same & (F.col("c_prefix_bytes") == prefix_bytes), F.col("c_prefix")).alias("prefix_checksum")]
    return both.select("path", F.when(same, F.col("c_checksum")).alias("checksum"), F.coalesce(same & F.col("c_checksum").isNotNull(), F.lit(False)).alias("hit"), *prefix)


def cache_counters(cached: DataFrame) -> DataFrame:
    """One row: files whose digest the cache had, and those it had not."""
    return cached.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def record_checksums(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new entries: digests complete one another where the identity agrees, else the new entry replaces."""
    old = cache.select("path", F.struct(*[c for c in cache.columns if c != "path"]).alias("o"))
    fresh = new.select("path", F.struct(*[c for c in cache.columns if c != "path"]).alias("n"))
    same = F.col("o.identity").eqNullSafe(F.col("n.identity"))
    pick = lambda c: F.when(F.col("n").isNull(), F.col(f"o.{c}")).when(same, F.coalesce(f"n.{c}", f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return old.join(fresh, "path", "full_outer").select("path", *[pick(c) for c in cache.columns if c != "path"])


def purge_cache(cache: DataFrame, present: DataFrame, keep: DataFrame) -> DataFrame:
    """Cache entries of paths that still exist or are to be kept."""
    gone = cache.select("path").join(present.select("path"), "path", "left_anti").join(keep.select("path"), "path", "left_anti")
    return cache.join(gone, "path", "left_anti")
