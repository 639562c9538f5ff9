"""Path hierarchies: roll-ups, ancestry and orders.

Where one set of paths is asked about itself, it is sorted once by ranges of the path, so that all
that lies under a path follows it, and what is open at the end of a range is carried to the next.
Where few paths are asked about a large table, they are ranges that its scan can skip by; where
they are many, they meet it by equality on prefixes, one join a depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stocktake.functions import paths as P
from stocktake.operators.joins import joined, kept

#: So many subtrees are looked for as path ranges in the scan itself.
MOST_RANGES = 128
EARLIER = (Window.unboundedPreceding, -1)


def directories(inv: DataFrame) -> DataFrame:
    """Distinct directories that the entries imply, ``/`` included."""
    parents = inv.select("parent_path").filter("parent_path is not null").distinct()
    return parents.select(F.explode(P.ancestors_or_self(F.col("parent_path"))).alias("path")).distinct()


def directory_sums(inv: DataFrame) -> DataFrame:
    """(path, logical, allocated, files, inside) of every directory: sums and number of all entries below, and of those directly inside.

    The inventory is read once: by parent first, so that only distinct directories are multiplied by their depth.
    """
    by_parent = inv.groupBy("parent_path").agg(F.sum("byte_size").alias("logical"), F.sum("allocated_size").alias("allocated"), F.count("*").alias("files"))
    up = by_parent.select("parent_path", F.explode(P.ancestors_or_self(F.col("parent_path"))).alias("path"), "logical", "allocated", "files")
    own = F.col("parent_path") == F.col("path")
    return up.groupBy("path").agg(F.sum("logical").alias("logical"), F.sum("allocated").alias("allocated"), F.sum("files").alias("files"), F.coalesce(F.sum(F.when(own, F.col("files"))), F.lit(0)).alias("inside"))


def counted_directories(sums: DataFrame) -> DataFrame:
    """``sums`` with dirs_inside and dirs_below: the directories themselves go up once more."""
    above = sums.select(F.explode(P.ancestors_or_self(F.col("path"))).alias("above"), "path", "logical", "allocated", "files", "inside", P.parent_path(F.col("path")).alias("parent"))
    self, child = F.col("above") == F.col("path"), F.col("above") == F.col("parent")
    of = lambda name: F.max(F.when(self, F.col(name))).alias(name)  # noqa: E731  one row is the directory itself
    return above.groupBy(F.col("above").alias("path")).agg(of("logical"), of("allocated"), of("files"), of("inside"), F.count_if(child).alias("dirs_inside"), F.count_if(~self).alias("dirs_below"))


def displayed(counted: DataFrame) -> DataFrame:
    """(path, logical, allocated, size, children, descendants)."""
    return counted.select("path", "logical", "allocated", F.greatest("logical", "allocated").alias("size"), (F.col("inside") + F.col("dirs_inside")).alias("children"), (F.col("files") + F.col("dirs_below")).alias("descendants"))


def dir_rollup(inv: DataFrame) -> DataFrame:
    """(path, logical, allocated, size, children, descendants) of every directory."""
    return displayed(counted_directories(directory_sums(inv)))


def corrected(counted: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """``counted`` (of ``counted_directories``) after some rows of the inventory have gone and others come.

    Only those rows are summed up; their differences go to their directories and all above, and
    directories that begin or cease to exist are counted in those above them. The rest stays as it is.
    """
    columns = ["logical", "allocated", "files", "inside"]
    signed = directory_sums(come).unionByName(directory_sums(gone).select("path", *[(-F.col(c)).alias(c) for c in columns]))
    change = kept(signed.groupBy("path").agg(*[F.sum(c).alias(f"d_{c}") for c in columns]).filter(" OR ".join(f"d_{c} <> 0" for c in columns)))
    had = kept(joined(counted.select("path", "files"), change.select("path"), "path", "left_semi"))
    both = joined(change.select("path", "d_files"), had, "path", "left").withColumn("now", F.coalesce("files", F.lit(0)) + F.col("d_files"))
    turn = F.when(F.col("files").isNull() & (F.col("now") > 0), 1).when(F.col("now") == 0, -1)
    turned = kept(both.select("path", turn.alias("turn")).filter("turn IS NOT NULL"))
    above = turned.filter("path <> '/'").select(F.explode(P.path_ancestors(F.col("path"))).alias("above"), P.parent_path(F.col("path")).alias("parent"), "turn")
    dirs = above.groupBy(F.col("above").alias("path")).agg(F.sum("turn").alias("d_below"), F.coalesce(F.sum(F.when(F.col("above") == F.col("parent"), F.col("turn"))), F.lit(0)).alias("d_inside_dirs"))
    all_changes = kept(change.join(dirs.hint("merge"), "path", "full_outer"))
    fresh = joined(turned.filter("turn = 1").select("path"), all_changes, "path").select("path", *[F.lit(0).cast("bigint").alias(c) for c in (*columns, "dirs_inside", "dirs_below")])
    plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    after = joined(counted.unionByName(fresh), all_changes, "path", "left")
    return after.select("path", *[plus(c, f"d_{c}") for c in columns], plus("dirs_inside", "d_inside_dirs"), plus("dirs_below", "d_below")).filter("files > 0")


def in_path_order(df: DataFrame) -> DataFrame:
    """``df`` with ``_key``, in whose order all that lies under a path follows it, dealt out by ranges ``_part`` of that order.

    Kept, since a second evaluation may cut the ranges elsewhere.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.when(F.col("path") == "/", F.lit("")).otherwise(F.replace("path", F.lit("/"), F.lit("\u0000")))
    return kept(df.withColumn("_key", key).repartitionByRange(width, "_key").withColumn("_part", F.spark_partition_id()))


def _carried(ends: DataFrame, value) -> DataFrame:
    """(_part and a column for each of the others): for each range, ``value`` over the earlier ranges' rows; ``ends`` has a row a range."""
    order = Window.orderBy("_part").rowsBetween(*EARLIER)
    return F.broadcast(ends.select("_part", *[value(F.col(c)).over(order).alias(f"{c}_carried") for c in ends.columns if c != "_part"]))


def top_level(df: DataFrame) -> DataFrame:
    """Distinct rows by path without those that have a strict ancestor in the set.

    Every path covers the keys up to its own with U+0001 added; a path lies in another one if one of
    those that begin before it ends after it, which the largest end so far tells.
    """
    rows = in_path_order(df.dropDuplicates(["path"]))
    end = F.concat("_key", F.lit("\u0001"))
    carried = _carried(rows.groupBy("_part").agg(F.max(end).alias("_end")), F.max)
    before = Window.partitionBy("_part").orderBy("_key").rowsBetween(*EARLIER)
    opened = rows.join(carried, "_part").withColumn("_open", F.greatest(F.max(end).over(before), "_end_carried"))
    return opened.filter("_open IS NULL OR _open <= _key").select(*df.columns)


def nested_pairs(df: DataFrame, distinct: bool = False) -> DataFrame:
    """(path, ancestor): each path with its closest selected strict ancestor. distinct: no path is there twice.

    The last path of a depth that came before is the only one of that depth which can be an
    ancestor, so a column for each depth above the deepest holds the open ancestors.
    """
    rows = in_path_order((df.select("path") if distinct else df.select("path").distinct()).withColumn("_depth", P.depth(F.col("path"))))
    deepest = rows.agg(F.coalesce(F.max("_depth"), F.lit(0))).first()[0]
    if not deepest:
        return rows.limit(0).select("path", F.col("path").alias("ancestor"))
    of = lambda d: F.when(F.col("_depth") == d, F.col("path"))
    ends = rows.groupBy("_part").agg(*[F.max_by("path", F.when(F.col("_depth") == d, F.col("_key"))).alias(f"_{d}") for d in range(deepest)])
    before = Window.partitionBy("_part").orderBy("_key").rowsBetween(*EARLIER)
    opened = rows.join(_carried(ends, lambda c: F.last(c, ignorenulls=True)), "_part").select("path", "_depth", *[F.coalesce(F.last(of(d), ignorenulls=True).over(before), f"_{d}_carried").alias(f"_{d}") for d in range(deepest)])
    above = lambda d: F.when((F.col("_depth") > d) & F.startswith("path", F.lit("/") if d == 0 else F.concat(f"_{d}", F.lit("/"))), F.col(f"_{d}"))
    return opened.select("path", F.coalesce(*[above(d) for d in reversed(range(deepest))]).alias("ancestor")).filter("ancestor IS NOT NULL")


def in_ranges(path: Column, tops: list[str]) -> Column:
    """Whether a path is one of the tops or under one, as ranges that a scan of sorted files can skip by."""
    one = lambda p: F.lit(True) if p == "/" else (path == p) | (path >= p + "/") & (path < p + "0")  # noqa: E731  0 follows / in the order of characters
    return reduce(Column.__or__, map(one, tops), F.lit(False)) if tops else F.lit(False)


def _tops(dirty: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """The top-most dirty paths, kept, and as a list if they are MOST_RANGES at most."""
    tops = kept(top_level(dirty.select("path")))
    return tops, [r["path"] for r in tops.collect()] if tops.count() <= MOST_RANGES else None


def _by_depth(df: DataFrame, tops: DataFrame):
    """Of each depth that tops have, ``df`` with the prefix of that depth and the tops to meet it."""
    by = tops.withColumn("_depth", P.depth(F.col("path")))
    for (d,) in sorted(by.select("_depth").distinct().collect()):  # as many as the tree is deep
        yield (lambda rows, d=d: rows.withColumn("_prefix", F.lit("/") if d == 0 else F.substring_index("path", "/", d + 1))), by.filter(F.col("_depth") == d).select(F.col("path").alias("_prefix"))


def outside(df: DataFrame, dirty: DataFrame) -> DataFrame:
    """Rows neither at nor under a dirty path; they do not move unless the dirty paths are too many to be sent to all tasks."""
    tops, few = _tops(dirty)
    if few is not None:
        return df.filter(~in_ranges(F.col("path"), few))
    for cut, top in _by_depth(df, tops):
        df = joined(cut(df), top, "_prefix", "left_anti").drop("_prefix")
    return df


def inside(df: DataFrame, dirty: DataFrame) -> DataFrame:
    """Rows at or under a dirty path."""
    tops, few = _tops(dirty)
    if few is not None:
        return df.filter(in_ranges(F.col("path"), few))
    return reduce(DataFrame.unionByName, [joined(cut(df), top, "_prefix", "left_semi").drop("_prefix") for cut, top in _by_depth(df, tops)])


def splice_subtrees(inv: DataFrame, dirty: DataFrame, fresh: DataFrame) -> DataFrame:
    """The inventory with everything at or under the dirty paths replaced by the fresh rows."""
    return outside(inv, dirty).unionByName(inside(fresh, dirty).select(*inv.columns))


def dirty_subtrees(changes: DataFrame, dirs: DataFrame, root: str = "/") -> DataFrame:
    """Changed paths as top-most directories: the path itself if it is one, else its parent; outside the root is ignored."""
    changed = kept(changes.select("path").distinct().filter(P.at_or_under(F.col("path"), root)))
    known = kept(joined(dirs.select("path"), changed, "path", "left_semi").distinct().withColumn("is_dir", F.lit(True)))
    where = F.when(F.col("is_dir") | (F.col("path") == root), F.col("path")).otherwise(P.parent_path(F.col("path")))
    return top_level(joined(changed, known, "path", "left").select(where.alias("path")))


def preorder(nodes: DataFrame) -> DataFrame:
    """(path, rank) of a depth-first walk from 1, children by size from the largest, then name.

    nodes: path, name and size, each path once; every node but the first level's has its parent among them. A
    node's step is one more than all nodes of its earlier siblings' subtrees; its rank is its
    parent's plus its step. Steps are running sums by ranges of (parent, size, name), so a
    directory with very many entries is no single task; ranks go down level by level, over
    directories only, and to all entries in the end.
    """
    spark = nodes.sparkSession
    rows = kept(nodes.select("path", "name", "size", F.coalesce(P.parent_path(F.col("path")), F.lit("")).alias("parent")))
    inner = kept(rows.groupBy("parent").agg(F.count("*").alias("n")))
    below = kept(inner.filter("parent <> ''").select(F.explode(P.ancestors_or_self(F.col("parent"))).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("below")))
    order = [F.asc("parent"), F.desc("size"), F.asc("name"), F.asc("path")]
    sorted_rows = kept(joined(rows, below, "path", "left").withColumn("weight", F.coalesce("below", F.lit(0)) + 1)
                       .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()))
    parts = sorted_rows.groupBy("_part", "parent").agg(F.sum("weight").alias("w"))
    earlier = parts.withColumn("before", F.sum("w").over(Window.partitionBy("parent").orderBy("_part").rowsBetween(*EARLIER))).filter("before IS NOT NULL").select("_part", "parent", "before")  # the first parent of a range at most
    running = F.sum("weight").over(Window.partitionBy("_part", "parent").orderBy(*order[1:]).rowsBetween(*EARLIER))
    steps = kept(sorted_rows.withColumn("step", F.coalesce(running, F.lit(0))).join(F.broadcast(earlier), ["_part", "parent"], "left")
                 .select("path", "parent", (F.col("step") + F.coalesce("before", F.lit(0)) + 1).alias("step")))
    boxes = kept(joined(steps, below.select("path"), "path", "left_semi").withColumn("depth", P.depth(F.col("path"))))
    placed = spark.createDataFrame([("", 0)], "parent string, above bigint")
    levels = [placed]
    for (d,) in sorted(boxes.select("depth").distinct().collect()):  # as many as the tree is deep
        level = boxes.filter(F.col("depth") == d)
        placed = kept(joined(level, placed, "parent").select(F.col("path").alias("parent"), (F.col("above") + F.col("step")).alias("above")))
        levels.append(placed)
    return joined(steps, kept(reduce(DataFrame.unionByName, levels)), "parent").select("path", (F.col("above") + F.col("step")).alias("rank"))


def tree_search(nodes: DataFrame, condition) -> DataFrame:
    """(path, direct): nodes that match, and those above a match. The nodes are computed once."""
    known = kept(nodes.select("path", condition.alias("direct")))
    above = kept(known.filter("direct").select(F.explode(P.path_ancestors(F.col("path"))).alias("path")).distinct())
    return known.filter("direct").union(joined(known, above, "path", "left_semi").withColumn("direct", F.lit(False))).groupBy("path").agg(F.max("direct").alias("direct"))


def top_children(entries: DataFrame, k: int = 200) -> DataFrame:
    """Each directory's k largest entries, files and sub-directories, with their rank; entries need path, name, parent_path and size."""
    order = Window.partitionBy("parent_path").orderBy(F.desc("size"), "name", "path")
    return entries.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def splice_is_sound(rows: DataFrame, known: DataFrame) -> bool:
    """Whether spliced rows (path, parent_path, kind) fit a tree: no path twice, nothing below an entry that is no container, neither among
    themselves nor below an entry of ``known`` (path, kind), and, where directories are listed as entries, a container for each but the root."""
    rows = kept(rows.select("path", "parent_path", "kind"))
    if not rows.groupBy("path").count().filter("count > 1").isEmpty():
        return False
    parents = kept(rows.select(F.col("parent_path").alias("path")).filter("path IS NOT NULL").distinct())
    there = kept(joined(known.select("path", "kind").unionByName(rows.select("path", "kind")), parents, "path", "left_semi"))
    if not there.filter(~P.is_container(F.col("kind"))).isEmpty():
        return False
    listed = not there.isEmpty()
    return not listed or joined(parents.filter("path <> '/'"), there, "path", "left_anti").isEmpty()


def tree_consistency(nodes: DataFrame, root: str = "/") -> DataFrame:
    """One row: entries without an existing container parent, repeated paths, and whether the tree is sound. The nodes are computed once."""
    known = kept(nodes.select("path", "parent_path", P.is_container(F.col("kind")).alias("box")))
    containers = kept(known.filter("box").select(F.col("path").alias("parent_path")).distinct())
    orphans = joined(known.filter(F.col("path") != root), containers, "parent_path", "left_anti").agg(F.count("*").alias("orphans"))
    repeated = known.groupBy("path").count().filter("count > 1").agg(F.count("*").alias("repeated"))
    return orphans.withColumn("repeated", repeated.scalar()).withColumn("sound", (F.col("orphans") == 0) & (F.col("repeated") == 0))
