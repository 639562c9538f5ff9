"""Breakdowns, summaries and ranked lists. Ranked lists carry an explicit rank; caps are limits after a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stocktake.functions import paths as P
from stocktake.operators.filters import filter_types
from stocktake.operators.joins import joined, kept


def typed(inv: DataFrame) -> DataFrame:
    """``inv`` with size, label and category."""
    ext = P.file_extension(F.col("name"))
    return inv.withColumn("size", P.display_size()).withColumn("label", P.type_label(ext)).withColumn("category", P.type_category(ext))


def type_breakdown(inv: DataFrame) -> DataFrame:
    """(label, category, file_count, total_bytes). Files are summed by extension; label and category follow from it, once a group."""
    by_ext = inv.filter("kind = 'file'").groupBy(P.file_extension(F.col("name")).alias("ext")).agg(F.count("*").alias("file_count"), F.sum(P.display_size()).alias("total_bytes"))
    return by_ext.select(P.type_label(F.col("ext")).alias("label"), P.type_category(F.col("ext")).alias("category"), "file_count", "total_bytes")


def category_breakdown(types: DataFrame) -> DataFrame:
    return types.groupBy("category").agg(F.sum("file_count").alias("file_count"), F.count("*").alias("extension_count"), F.sum("total_bytes").alias("total_bytes"))


def filtered_categories(types: DataFrame, query: str) -> DataFrame:
    return category_breakdown(filter_types(types, query))


def type_rollup(inv: DataFrame) -> DataFrame:
    """Types, categories and the whole in one table; level: 0 type, 1 category, 3 all."""
    return type_breakdown(inv).rollup("category", "label").agg(F.grouping_id().cast("int").alias("level"), F.sum("file_count").alias("file_count"), F.sum("total_bytes").alias("total_bytes"))


def scan_summary(inv: DataFrame, directories: DataFrame) -> DataFrame:
    """One row: items seen, unreadable ones, both definitions of total bytes, files and folders."""
    leaves = inv.agg(F.count("*").alias("file_count"), F.count_if(~F.col("is_readable")).alias("inaccessible_count"), F.sum("byte_size").alias("logical"), F.sum("allocated_size").alias("allocated"), F.sum(P.display_size()).alias("leaf_bytes"))
    return leaves.withColumn("folder_count", directories.agg(F.count("*")).scalar()).select((F.col("file_count") + F.col("folder_count")).alias("scanned_items"), "inaccessible_count", F.greatest("logical", "allocated").alias("total_bytes"), "leaf_bytes", "file_count", "folder_count")


def ranked(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in order, with their rank; the window runs over at most k rows."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def ranked_whole(df: DataFrame, *order: Column) -> DataFrame:
    """All rows with their rank (bigint) in a total order: ranges of the order, sorted each, whose rows are numbered as they
    stand and shifted by the rows before the range. Rows move once.

    The ranges are checkpointed, since a second evaluation may cut them elsewhere.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return numbered(kept(df.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())))


def numbered(parts: DataFrame) -> DataFrame:
    """Rows with ``_at`` (range in the upper bits, place in it in the lower 33) with the rank that follows from it instead."""
    part = F.shiftright("_at", 33)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))  # one row a range
    shift = kept(counts.select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return parts.withColumn("_part", part).join(F.broadcast(shift), "_part").withColumn("rank", place + F.col("_before") + 1).drop("_part", "_before", "_at")


def largest_files(inv: DataFrame, k: int = 500) -> DataFrame:
    return ranked(inv.filter("kind = 'file'").select("path", P.display_size().alias("size")), k, F.desc("size"), F.asc("path"))


def largest_folders(rollup: DataFrame, k: int = 500, root: str = "/") -> DataFrame:
    return ranked(rollup.filter(F.col("path") != root).select("path", "size"), k, F.desc("size"), F.asc("path"))


def old_large_files(inv: DataFrame, as_of: str, days: int = 180, least: int = 1_000_000_000, k: int = 500) -> DataFrame:
    """Files of at least the size that have not changed for so many days before ``as_of``."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    old = inv.filter((F.col("kind") == "file") & (P.display_size() >= least) & (F.col("modified_at") <= cutoff))
    return ranked(old.select("path", P.display_size().alias("size"), "modified_at"), k, F.desc("size"), F.asc("path"))


ORDERS = {
    "size": lambda: [F.desc("size"), F.asc("natural")], "name": lambda: [F.asc("natural")], "newest": lambda: [F.desc_nulls_last("modified_at")],
    "oldest": lambda: [F.asc_nulls_last("modified_at")], "kind": lambda: [F.asc("kind"), F.desc("size")],
}


def sort_items(items: DataFrame, by: str, k: int | None) -> DataFrame:
    """The first k items (None: all) in one of ORDERS, path last; items need path and what the order names (natural: name)."""
    keyed, order = items.withColumn("natural", P.natural_order(F.col("name"))) if by in ("size", "name") else items, [*ORDERS[by](), F.asc("path")]
    return ranked_whole(keyed, *order) if k is None else ranked(keyed, k, *order)


#: Base lists whose rows have file extensions; the type filter leaves the others as they are.
TYPED_VIEWS = ("files", "old_files", "duplicates")


def item_query(base: DataFrame, query: str = "", least: int = 0, extension: str | None = None, by: str = "size", k: int | None = 500, view: str = "files") -> DataFrame:
    """A base list (files, folders, old_files, candidates or duplicates) under size, search and type filters, sorted.

    base: path, name, kind, modified_at, and size or the two sizes that it follows from.
    """
    from stocktake.operators.filters import filter_file_type, search_items

    items = base if "size" in base.columns else base.withColumn("size", P.display_size())
    items = search_items(items.filter(F.col("size") >= least), query)
    items = filter_file_type(items, extension) if extension is not None and view in TYPED_VIEWS else items
    return sort_items(items, by, k)


def size_share(df: DataFrame, root: str | None = None) -> DataFrame:
    """Rows with each size over the largest (of a capped list), or over that of the root if one is named; between 0 and 1."""
    base = df.agg(F.greatest(F.max("size" if root is None else F.when(F.col("path") == root, F.col("size"))), F.lit(1)).alias("base"))
    return df.withColumn("share", F.least(F.greatest(F.col("size") / base.scalar(), F.lit(0.0)), F.lit(1.0)))


def retention_stats(candidates: DataFrame, cap: int) -> DataFrame:
    return candidates.agg(F.count("*").alias("considered")).select("considered", F.least("considered", F.lit(cap)).alias("retained"), F.greatest(F.col("considered") - cap, F.lit(0)).alias("dropped"), (F.col("considered") > cap).alias("limit_reached"))


def latest_snapshots(scans: DataFrame, k: int = 8) -> DataFrame:
    """The latest scan of each root, newest k; scans: root, scanned_at, total_bytes."""
    last = scans.groupBy("root").agg(F.max(F.struct("scanned_at", "total_bytes")).alias("l")).select("root", "l.scanned_at", "l.total_bytes")
    return ranked(last, k, F.desc("scanned_at"), F.asc("root"))


def redact_names(inv: DataFrame, k: int | None) -> DataFrame:
    """Ordinal placeholders for the first k paths (None: all): ``File n.ext``, in path order."""
    ext = P.file_extension(F.col("name"))
    named = inv.select("path", "name")
    top = ranked_whole(named, F.asc("path")) if k is None else ranked(named, k, F.asc("path"))
    return top.select("path", F.concat(F.lit("File "), F.col("rank").cast("string"), F.coalesce(F.concat(F.lit("."), ext), F.lit(""))).alias("redacted"))


def redact_tokens(inv: DataFrame, salt: str) -> DataFrame:
    """Placeholders for a whole table, without a global order: a salted digest of the path."""
    return inv.select("path", F.concat(F.lit("File "), F.substring(F.sha2(F.concat(F.lit(salt), F.col("path")), 256), 1, 12)).alias("redacted"))


def redact_tree(entries: DataFrame) -> DataFrame:
    """(path, redacted, redacted_path) of all entries (path, name, kind, parent_path): ``Folder n`` or ``File n.ext``, and ``…/Folder m/`` of the parent before it.

    Paths, parents included, are numbered once in path order; the extension keeps its case. Entries move once, by ranges of
    the path, in which each path's first row is numbered; only its further rows, and parents, look for a number.
    """
    ext = F.regexp_extract("name", r"^.+\.([^./]+)$", 1)
    rows = entries.select("path", "parent_path", F.when(P.is_container(F.col("kind")), "Folder ").otherwise("File ").alias("word"), ext.alias("ext"), F.lit(True).alias("entry"))
    rows = rows.withColumn("ending", F.when((F.col("word") == "Folder ") | (F.coalesce("ext", F.lit("")) == ""), "").otherwise(F.concat(F.lit("."), "ext"))).drop("ext")
    parents = kept(entries.select("parent_path").filter("parent_path is not null").distinct())
    extra = parents.select(F.col("parent_path").alias("path"), F.lit(None).cast("string").alias("parent_path"), F.lit("Folder ").alias("word"), F.lit(False).alias("entry"), F.lit("").alias("ending"))
    width = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("entry")))  # ranges of the path hold each path whole
    parts = kept(rows.filter("path is not null").unionByName(extra).repartitionByRange(width, "path").withColumn("nth", nth))
    first = numbered(parts.filter("nth = 1").drop("nth").withColumn("_at", F.monotonically_increasing_id()))  # the kept ranges stay as they are
    further = parts.filter("nth > 1 AND entry").drop("nth")
    wanted = kept(parents.select(F.col("parent_path").alias("path")).union(further.select("path")).distinct())
    known = kept(joined(first.select("path", "rank"), wanted, "path", "left_semi"))
    all_rows = first.filter("entry").unionByName(joined(further, known, "path"))
    above = known.select(F.col("path").alias("parent_path"), F.concat(F.lit("…/Folder "), F.col("rank").cast("string"), F.lit("/")).alias("above"))
    label = F.concat("word", F.col("rank").cast("string"), "ending")
    return joined(all_rows, above, "parent_path", "left").select("path", label.alias("redacted"), F.concat(F.coalesce("above", F.lit("")), label).alias("redacted_path"))
