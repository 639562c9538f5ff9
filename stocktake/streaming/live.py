"""Structured Streaming jobs over inventory rows and change logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from stocktake.functions import paths as P
from stocktake.operators.incremental import LOSSES, MOST_DIRTY
from stocktake.operators.joins import kept
from stocktake.operators.ranking import old_large_files, typed
from stocktake.operators.tree import corrected, dirty_subtrees, inside, outside, splice_is_sound
from stocktake.sources.inventory import SCHEMA, load_rollup, newest_snapshot, read_parts, save_snapshot, save_spliced, touched_parts


def stream_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Inventory rows as they are listed into a folder of parquet files."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def live_types(rows: DataFrame) -> DataFrame:
    """Running counts and bytes by type."""
    return typed(rows.filter("kind = 'file'")).groupBy("label", "category").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_bytes"))


def live_summary(rows: DataFrame) -> DataFrame:
    """One running row: entries seen, unreadable ones, and bytes by either definition."""
    return rows.agg(F.count("*").alias("scanned_items"), F.count_if(~F.col("is_readable")).alias("inaccessible_count"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("logical_bytes"), F.coalesce(F.sum("allocated_size"), F.lit(0)).alias("allocated_bytes"))


def live_progress(rows: DataFrame, name: str, checkpoint: str, every: str = "1 second", view=live_types) -> StreamingQuery:
    """Publish a running breakdown (``live_types`` or ``live_summary``) as an in-memory table for a view, at most once a second. The ranked list is ``live_largest``."""
    return view(rows).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def _versions(spark: SparkSession, folder: str, before: int) -> DataFrame | None:
    """The list of the newest batch before ``before``, or None."""
    try:
        lists = spark.read.parquet(f"{folder}/batch=*").withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), "/batch=([0-9]+)/", 1).cast("bigint"))
    except AnalysisException:  # no batch yet
        return None
    newest = lists.filter(F.col("batch") < before).agg(F.max("batch")).first()[0]
    return None if newest is None else lists.filter(F.col("batch") == newest).drop("batch")


def _merged(batch: DataFrame, number: int, folder: str, mine: DataFrame, k: int) -> None:
    """Write list ``number``: the k largest of this batch's rows (path, size) and those of the list before; a path in both has its larger size."""
    earlier = _versions(batch.sparkSession, folder, number)
    both = mine if earlier is None else mine.unionByName(earlier.select("path", "size"))
    both.groupBy("path").agg(F.max("size").alias("size")).orderBy(F.desc("size"), "path").limit(k).write.mode("overwrite").parquet(f"{folder}/batch={number}")


def live_largest(rows: DataFrame, folder: str, checkpoint: str, k: int = 500) -> StreamingQuery:
    """Keep the k largest files so far: each batch's rows meet the newest earlier list in the folder, and the new list is ``batch=N`` there.

    Nothing is held between batches, so a query that starts again from its checkpoint goes on with
    the list; a batch that is run again overwrites its own.
    """

    def merge(batch: DataFrame, number: int) -> None:
        _merged(batch, number, folder, typed(batch.filter("kind = 'file'")).select("path", "size"), k)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_old_files(rows: DataFrame, folder: str, checkpoint: str, as_of: str, days: int = 180, least: int = 1_000_000_000, k: int = 500) -> StreamingQuery:
    """Keep the k largest files so far that are old and large as in ``old_large_files``; lists as in ``live_largest``."""

    def merge(batch: DataFrame, number: int) -> None:
        _merged(batch, number, folder, old_large_files(batch, as_of, days, least, k).select("path", "size"), k)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Keyed state of running sums is kept on disk.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def live_folders(rows: DataFrame, folder: str, checkpoint: str, root: str = "/", k: int = 500) -> StreamingQuery:
    """Keep the k largest folders so far, by the larger of the two sums of all files below; lists as in ``live_largest``.

    The running sums of every directory are keyed state on disk; a batch brings those that changed.
    Sizes only grow while a listing goes on, so a folder that neither changed nor was in the list
    stays out of it.
    """
    spark = rows.sparkSession
    up = rows.select(F.explode(P.ancestors_or_self(F.col("parent_path"))).alias("path"), "byte_size", "allocated_size").filter(F.col("path") != root)
    sums = up.groupBy("path").agg(F.sum("byte_size").alias("logical"), F.sum("allocated_size").alias("allocated"))

    def merge(batch: DataFrame, number: int) -> None:
        _merged(batch, number, folder, batch.select("path", F.greatest("logical", "allocated").alias("size")), k)

    before = {key: spark.conf.get(key, None) for key in STORE}
    for key, value in STORE.items():
        spark.conf.set(key, value)
    try:
        return sums.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def listing_ended(spark: SparkSession, folder: str) -> None:
    """Mark the newest list in a folder as that of a whole listing; lists of later batches are partial again."""
    newest = _versions(spark, folder, 1 << 62)
    if newest is not None:
        spark.read.parquet(f"{folder}/batch=*").select(F.max(F.regexp_extract(F.col("_metadata.file_path"), "/batch=([0-9]+)/", 1).cast("bigint")).alias("whole")).coalesce(1).write.mode("append").parquet(f"{folder}/ended")


def live_list(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, rank, is_partial): the newest list, ranked from 1; partial until the listing has ended."""
    lists = spark.read.parquet(f"{folder}/batch=*").withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), "/batch=([0-9]+)/", 1).cast("bigint"))
    newest = lists.agg(F.max("batch")).first()[0]
    try:
        whole = spark.read.parquet(f"{folder}/ended").agg(F.max("whole")).first()[0]
    except AnalysisException:  # no mark yet
        whole = None
    rows = lists.filter(F.col("batch") == newest)  # as many as the list is long
    return rows.select("path", "size", F.row_number().over(Window.orderBy(F.desc("size"), "path")).alias("rank"), F.lit(whole is None or whole < newest).alias("is_partial"))


def stream_dirty(changes: DataFrame, dirs: DataFrame, folder: str, checkpoint: str, root: str = "/") -> StreamingQuery:
    """Write each batch's coalesced dirty directories; a batch that is run again overwrites its own table."""

    def run(batch: DataFrame, number: int) -> None:
        dirty_subtrees(batch.filter("change_type <> 'noop'"), dirs, root).write.mode("overwrite").parquet(f"{folder}/batch-{number:08d}")

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_snapshot(changes: DataFrame, listing, folder: str, expect: dict, checkpoint: str, most_dirty: int = MOST_DIRTY) -> StreamingQuery:
    """Keep a saved snapshot and its roll-up current, batch by batch; ``folder``/results says how: batch, result, reason, dirty_count.

    listing: fresh rows, as a table or as a function of the dirty directories (path; None: all) that lists only those.
    unchanged: the snapshot stays. incremental: the dirty subtrees are spliced from the listing; only parts of the
    snapshot that their ranges meet are written anew, and the roll-up is corrected by the differences. full:
    a new listing, because the snapshot does not meet expectations, the change log has lost events
    or seen its root change (a reason of LOSSES), more than ``most_dirty`` subtrees are dirty (too_many_dirty), or the listed
    rows do not fit the tree (inconsistent).
    """
    listed = listing if callable(listing) else lambda dirty: listing

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changed = batch.filter("change_type <> 'noop'")
        parts, reason = newest_snapshot(spark, folder, expect)
        last = batch.agg(F.max("event_id")).first()[0] or 0
        about = (folder, expect["root"], expect["volume"], expect["options"], last)
        count = 0
        if not reason:
            losses = {r["change_type"] for r in changed.filter(F.col("change_type").isin(*LOSSES)).select("change_type").distinct().collect()}  # as many as LOSSES at most
            reason = next((why for kind, why in LOSSES.items() if kind in losses), None)
        if not reason and not changed.isEmpty():
            rollup = load_rollup(spark, folder, expect)
            dirty = kept(dirty_subtrees(changed, rollup.select("path"), expect["root"]))
            count = dirty.count()
            reason = "too_many_dirty" if count > most_dirty else _splice(parts, rollup, dirty, listed(dirty), about)
        result = "full" if reason else "incremental" if count else "unchanged"
        if result == "full":
            save_snapshot(listed(None), *about)
        outcome = spark.createDataFrame([(number, result, reason, count)], "batch bigint, result string, reason string, dirty_count bigint")
        outcome.coalesce(1).write.mode("overwrite").parquet(f"{folder}/results/{number:08d}")

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _splice(parts: list, rollup: DataFrame, dirty: DataFrame, listing: DataFrame, about: tuple) -> str | None:
    """Save a snapshot with the dirty subtrees (MOST_DIRTY at most) from the listing; the reason why not, if there is one."""
    spark = dirty.sparkSession
    tops = [r["path"] for r in dirty.collect()]
    if not tops:
        return None
    touched, rest = touched_parts(parts, tops)
    before = read_parts(spark, touched)
    come, gone = kept(inside(listing.select(*before.columns), dirty)), inside(before, dirty)
    above = sorted({"/", *(p.rsplit("/", i)[0] for p in tops for i in range(1, p.count("/")))})
    known = outside(read_parts(spark, parts), dirty).filter(F.col("path").isin(above))
    if not touched or not splice_is_sound(come.select("path", "parent_path", "kind"), known):
        return "inconsistent"
    save_spliced(outside(before, dirty).unionByName(come), corrected(rollup, gone, come), touched, rest, *about)
    return None
