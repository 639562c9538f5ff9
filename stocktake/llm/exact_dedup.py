"""Exact duplicates by stateful streaming, in DataFrame expressions only.

Documents arrive as a stream of files. Keyed state, kept on disk by the RocksDB state store and
never expired, holds for each digest of a normalised text the document that stays (its identifier
and where its content lies: file and row) and how often the digest came. The state outlives the
query: one that starts again from its checkpoint folder adds what has arrived since.

The state is then read back as a table. Every document whose digest came before is a hit: its full
normalised text is compared with the text at the place the state names. Texts that differ in spite
of one digest go round again under a longer, salted digest, until all that share one are equal.
"""

from __future__ import annotations

import re
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stocktake.llm.shared import joined, scratch, written

#: A digest with at least one in HOT_ONE_IN of all documents is joined by broadcast (there are at most HOT_ONE_IN of them).
HOT_ONE_IN = 1000
#: Hits of one digest that are compared in one task.
SALT_ROWS = 2048
#: State on disk, as changes after changes, in files that are no larger than what they hold: there is a store for each shuffle partition.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _stored(spark: SparkSession):
    """STORE holds inside."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    """The text without its white space (space and U+0009 to U+000D); null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _sighted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, norm, sha, points, file, row, at) of each document; at: a hash of its place."""
    place = docs.metadataColumn("_metadata")
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"), F.coalesce(F.length(text_col), F.lit(0)).alias("points"), place["file_path"].alias("file"), place["row_index"].alias("row"))
    return norm.withColumn("sha", F.sha2("norm", 256)).withColumn("at", F.xxhash64("file", "row"))


def _best() -> list[Column]:
    """The one that stays: most code points, then smallest identifier (null last), then place."""
    order = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    return [F.min(order).alias("best"), F.count("*").alias("n")]


def remember(spark: SparkSession, path: str, state: str, id_col: str = "doc_id", text_col: str = "text", digits: int = 64, files_per_batch: int = 1000) -> None:
    """Take what has newly arrived below ``path`` (parquet: a folder, file or pattern) into the keyed state in ``state``.

    digits: hexadecimal digits of the digest that keys the state. The partial aggregation before
    the shuffle sends one row a digest and task, however often a text is repeated.
    """
    pattern = re.sub(r"([\w-])/*$", r"[\1]", path)  # a single file is no folder to list, but a pattern may match it
    arriving = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    seen = _sighted(arriving, id_col, text_col).withColumn("digest", F.substring("sha", 1, digits)).groupBy("digest").agg(*_best())
    with _stored(spark):
        seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def remembered(spark: SparkSession, state: str) -> DataFrame:
    """The state as a written table: key, keep_id, keep_file, keep_row, n."""
    best = F.col("value.min")
    with _stored(spark):
        return written(spark.read.format("statestore").load(state).select(F.col("key.digest").alias("key"), best["doc_id"].alias("keep_id"), best["file"].alias("keep_file"), best["row"].alias("keep_row"), F.col("value.count").alias("n")), "dedup-groups")


def _placed(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with their group; the groups that hold much of the table meet them by broadcast, all others by key."""
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") >= max(1000, -(-total // HOT_ONE_IN))
    common = groups.filter(hot)
    often = rows.join(F.broadcast(common), "key")
    rest = rows.join(F.broadcast(common.select("key")), "key", "left_anti").join(groups.filter(~hot).hint("merge"), "key")
    return often.unionByName(rest)


def _differing(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, file, row) of every hit whose full text is not that of the document that its group keeps.

    Only texts of groups of two and more move; a group's hits are dealt out in parts of about
    SALT_ROWS, each of which gets the text they are compared with.
    """
    several = written(groups.filter("n > 1").select("key", F.xxhash64("keep_file", "keep_row").alias("keep_at"), F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("parts")), "dedup-several")
    hits = written(joined(texts, several, "key").withColumn("part", F.pmod("at", "parts").cast("int")).select("key", "file", "row", "at", "keep_at", "parts", "part", "norm"), "dedup-hits")
    keepers = hits.filter("at = keep_at").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("norm").alias("kept_norm"))
    return hits.select("key", "file", "row", "part", "norm").join(keepers.hint("merge"), ["key", "part"]).filter("norm <> kept_norm").select("key", "file", "row").distinct()


def deduplicate(spark: SparkSession, path: str, state: str | None = None, id_col: str = "doc_id", text_col: str = "text", digits: int = 64, files_per_batch: int = 1000) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every document below ``path``.

    Texts are equal if they are without white space. The one with most code points stays, then the
    smallest identifier; of repeated rows one stays. A null text counts as empty and is equal to
    all texts without other characters; a null identifier comes last and may itself be a keep_id;
    an empty table gives an empty result; other columns, whatever their names, do not matter.
    state: folder of the keyed state, to go on from an earlier run; a new one otherwise.
    """
    state = state or scratch(spark, "dedup-state")
    remember(spark, path, state, id_col, text_col, digits, files_per_batch)
    texts = _sighted(spark.read.parquet(path), id_col, text_col).withColumn("key", F.substring("sha", 1, digits))
    groups = remembered(spark, state)
    own = ["doc_id", "sha", "file", "row", "key"]
    placed, done, salt = _placed(written(texts.select(*own), "dedup-seen"), groups), [], 0
    while True:
        wrong = written(_differing(texts, groups), "dedup-differing")
        if wrong.isEmpty():
            done.append(placed)
            break
        lost = written(wrong.groupBy("key").agg(F.count("*").alias("lost")), "dedup-lost")
        right = placed.hint("merge").join(wrong, ["key", "file", "row"], "left_anti")
        done.append(joined(right, lost, "key", "left").withColumn("n", F.col("n") - F.coalesce("lost", F.lit(0))).drop("lost"))
        salt += 1
        texts = written(texts.hint("merge").join(wrong.select("file", "row"), ["file", "row"], "left_semi").withColumn("key", F.sha2(F.concat(F.lit(f"{salt}:"), "norm"), 512)), "dedup-again")
        groups = written(texts.groupBy("key").agg(*_best()).select("key", F.col("best.doc_id").alias("keep_id"), F.col("best.file").alias("keep_file"), F.col("best.row").alias("keep_row"), "n"), "dedup-groups")
        placed = _placed(texts.select(*own), groups)
    kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    return reduce(DataFrame.unionByName, done).select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))
