"""Inventories from listings, files and content tables; snapshots, digest caches and change logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stocktake.functions import paths as P
from stocktake.operators.joins import joined, kept
from stocktake.operators.tree import counted_directories, directory_sums

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("root", T.StringType()), ("path", T.StringType()), ("name", T.StringType()), ("parent_path", T.StringType()), ("depth", T.IntegerType()), ("kind", T.StringType()),
    ("byte_size", T.LongType()), ("allocated_size", T.LongType()), ("modified_at", T.TimestampNTZType()), ("is_hidden", T.BooleanType()), ("is_readable", T.BooleanType()),
    ("is_package", T.BooleanType()), ("device", T.StringType()), ("inode", T.LongType()), ("nlink", T.IntegerType()), ("ctime", T.TimestampNTZType()))])
SNAPSHOT_VERSION = 1


def canonical(df: DataFrame, root: str = "/", mapping: dict[str, str] | None = None, clean: bool = False) -> DataFrame:
    """The inventory columns of a listing; path, kind and byte_size are required, the rest derived or defaulted.

    clean: paths have no slash at the end, and name, parent_path and depth are given with them.
    """
    mapping = mapping or {}
    have = set(df.columns)
    col = lambda n: F.col(mapping.get(n, n)) if mapping.get(n, n) in have else F.lit(None)
    named = "_path"  # computed once a row, before what follows from it
    given = F.col(mapping.get("path", "path"))
    if not clean:
        df = df.withColumn(named, F.when(F.rtrim(given) == "/", F.lit("/")).otherwise(F.regexp_replace(given, "/+$", "")))
    path = given if clean else F.col(named)
    name = col("name") if clean else F.coalesce(col("name"), P.base_name(path))
    above, levels = (col("parent_path"), col("depth")) if clean else (P.parent_path(path), P.depth(path))
    values = {
        "root": F.lit(root), "path": path, "name": name, "parent_path": above, "depth": levels, "kind": col("kind"), "byte_size": col("byte_size"),
        "allocated_size": F.coalesce(col("allocated_size"), col("byte_size")), "modified_at": col("modified_at"), "is_hidden": F.coalesce(col("is_hidden"), name.startswith(".")),
        "is_readable": F.coalesce(col("is_readable"), F.lit(True)), "is_package": F.coalesce(col("is_package"), F.lit(False)), "device": col("device"), "inode": col("inode"),
        "nlink": F.coalesce(col("nlink"), F.lit(1)), "ctime": col("ctime")}
    extra = [F.col(c) for c in ("content",) if c in have]
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in SCHEMA], *extra)


def read_inventory(spark: SparkSession, source: str, fmt: str = "parquet", mapping: dict[str, str] | None = None, root: str = "/", schema: str | None = None) -> DataFrame:
    """Canonical rows of a metadata listing (parquet, csv or json; the text formats need a schema)."""
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return canonical(reader.load(source), root, mapping)


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """Metadata of real files; their bytes are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob).select("path", "length", "modificationTime")
    return canonical(files.select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("path"), F.lit("file").alias("kind"), F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified_at")))


def read_contents(candidates: DataFrame, contents: DataFrame) -> DataFrame:
    """Content rows of the candidate paths only; while the paths can be sent to all tasks, contents stay where they are read."""
    return joined(contents, kept(candidates.select("path").distinct()), "path", "left_semi")


MANIFEST = "schema_version int, root string, volume string, options string, checkpoint bigint, snapshot string, saved_at timestamp"
PARTS = "part int, first string, data string"


def _write_parts(rows: DataFrame, data: str) -> DataFrame:
    """Write rows (with ``part``) below ``data``, a folder a part, files in path order; (part, first, data) of each part that has any."""
    spark = rows.sparkSession
    rows.sortWithinPartitions("part", "path").write.partitionBy("part").parquet(data)
    return spark.read.schema(rows.schema).parquet(data).groupBy("part").agg(F.min("path").alias("first")).withColumn("data", F.concat(F.lit(f"{data}/part="), F.col("part").cast("string")))


def _publish(spark: SparkSession, folder: str, parts: list, rollup: DataFrame, root: str, volume: str, options: str, checkpoint: int) -> str:
    """The roll-up of directories, the list of parts, then the manifest row; a snapshot without manifest does not exist."""
    name = uuid.uuid4().hex
    rollup.write.parquet(f"{folder}/rollup/{name}")
    spark.createDataFrame(parts, PARTS).coalesce(1).write.parquet(f"{folder}/parts/{name}")
    row = spark.createDataFrame([(SNAPSHOT_VERSION, root, volume, options, checkpoint, name)], MANIFEST.rsplit(",", 1)[0])
    row.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return name


def save_snapshot(inventory: DataFrame, folder: str, root: str, volume: str, options: str, checkpoint: int, parts: int | None = None) -> str:
    """Write an inventory as a new snapshot of a root, in parts by ranges of the path; its name. Snapshots of several roots may share a folder."""
    spark = inventory.sparkSession
    width = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = inventory.select(*[f.name for f in SCHEMA]).repartitionByRange(width, "path").withColumn("part", F.spark_partition_id())
    made = sorted(map(tuple, _write_parts(cut, f"{folder}/data-{uuid.uuid4().hex}").collect()))  # a row a part
    return _publish(spark, folder, made, counted_directories(directory_sums(read_parts(spark, made))), root, volume, options, checkpoint)


def newest_snapshot(spark: SparkSession, folder: str, expect: dict) -> tuple[list | None, str | None]:
    """(parts as (part, first, data), None) of the root's newest snapshot if it meets expectations, or (None, first failing guard)."""
    try:
        of_root = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").filter(F.col("root") == expect["root"])
        rows = of_root.orderBy(F.desc("saved_at"), F.desc("checkpoint")).limit(1).collect()
    except Exception as error:  # the reader raises one of several classes for a missing or unreadable path
        return None, "missing" if "PATH_NOT_FOUND" in str(error) else "corrupt"
    if not rows:
        return None, "missing"
    for guard in ("schema_version", "volume", "options"):
        if rows[0][guard] != expect.get(guard, SNAPSHOT_VERSION if guard == "schema_version" else None):
            return None, guard.removesuffix("_version")
    return sorted(map(tuple, spark.read.schema(PARTS).parquet(f"{folder}/parts/{rows[0]['snapshot']}").collect())), None


def read_parts(spark: SparkSession, parts: list) -> DataFrame:
    """The rows of a snapshot's parts."""
    return spark.read.schema(SCHEMA).parquet(*[data for _, _, data in parts]) if parts else spark.createDataFrame([], SCHEMA)


def load_snapshot(spark: SparkSession, folder: str, expect: dict) -> tuple[DataFrame | None, str | None]:
    """(inventory, None) of the root's newest snapshot if it meets expectations, or (None, first failing guard)."""
    parts, reason = newest_snapshot(spark, folder, expect)
    return (None, reason) if reason else (read_parts(spark, parts), None)


def touched_parts(parts: list, tops: list[str]) -> tuple[list, list]:
    """(parts that hold or would hold a path at or under one of the tops, all others); parts are in order and each reaches to the next one's first path."""
    hit = [False] * len(parts)
    for i in range(len(parts)):
        low, high = (parts[i][1] if i else ""), (parts[i + 1][1] if i + 1 < len(parts) else None)
        within = lambda a, b: (high is None or a < high) and b > low  # noqa: E731  whether [a, b) meets the part
        hit[i] = any(p == "/" or within(p, p + "\0") or within(p + "/", p + "0") for p in tops)
    return [p for p, h in zip(parts, hit) if h], [p for p, h in zip(parts, hit) if not h]


def save_spliced(rows: DataFrame, rollup: DataFrame, touched: list, rest: list, folder: str, root: str, volume: str, options: str, checkpoint: int) -> str:
    """A new snapshot of the untouched parts as they are and the touched ones with new rows; each row goes to the part whose range holds it. rollup: of the whole."""
    spark = rows.sparkSession
    part = F.lit(touched[0][0])
    for number, first, _ in touched[1:]:
        part = F.when(F.col("path") >= first, number).otherwise(part)
    cut = rows.withColumn("part", part.cast("int")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "part", "path")
    fresh = [tuple(r) for r in _write_parts(cut, f"{folder}/data-{uuid.uuid4().hex}").collect()]
    return _publish(spark, folder, sorted([*rest, *fresh]), rollup, root, volume, options, checkpoint)


def load_rollup(spark: SparkSession, folder: str, expect: dict) -> DataFrame:
    """The roll-up of the root's newest snapshot."""
    newest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").filter(F.col("root") == expect["root"]).orderBy(F.desc("saved_at"), F.desc("checkpoint")).first()
    return spark.read.parquet(f"{folder}/rollup/{newest['snapshot']}")


CACHE_SCHEMA = "path string, byte_size bigint, modified_at timestamp_ntz, identity string, checksum string, prefix_checksum string, prefix_bytes bigint"


def save_checksum_cache(cache: DataFrame, folder: str) -> str:
    """Write the digest table to a new version folder."""
    name = f"{folder}/v-{uuid.uuid4().hex}"
    cache.write.parquet(name)
    return name


def load_checksum_cache(spark: SparkSession, name: str) -> tuple[DataFrame, bool]:
    """(cache, readable): a cache that cannot be read counts as empty."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(name), True
    except Exception:  # as above
        return spark.createDataFrame([], CACHE_SCHEMA), False


def changes_since(changes: DataFrame, since: int) -> DataFrame:
    """The part of a change log after a checkpoint."""
    return changes.filter(F.col("event_id") > since)


def read_changes(spark: SparkSession, folder: str, since: int | None = None) -> DataFrame:
    """A change log folder as a stream, or as a batch since a checkpoint."""
    schema = "event_id bigint, ts timestamp_ntz, path string, change_type string"
    return spark.readStream.schema(schema).parquet(folder) if since is None else changes_since(spark.read.schema(schema).parquet(folder), since)


def synthetic_inventory(spark: SparkSession, items: int, depth: int = 4, dup_ratio: float = 0.1) -> DataFrame:
    """A deterministic inventory: 16-way buckets, 120 files a leaf, five size tiers, pairs that share size and seed."""
    i = F.col("id")
    leaf = F.floor(i / 120)
    parts = [F.lpad(F.hex(F.pmod(F.floor(leaf / (16 ** k)), F.lit(16))), 2, "0") for k in range(depth)]
    paired = F.pmod(F.floor(i / 2), F.lit(1000)) < int(dup_ratio * 1000)
    tier = F.element_at(F.array(*map(F.lit, (512, 4096, 65_536, 262_144, 1_048_576))), (F.pmod(i, F.lit(5)) + 1).cast("int"))
    size = F.when(paired, F.lit(16_384)).otherwise(tier + F.pmod(i, F.lit(251)))
    seed = F.when(paired, F.floor(i / 2)).otherwise(i + (1 << 40))
    rows = spark.range(items).select(F.concat(F.lit("/bench/"), F.concat_ws("/", *parts), F.lit("/file-"), i, F.lit(".dat")).alias("path"), F.lit("file").alias("kind"), size.cast("bigint").alias("byte_size"), seed.alias("seed"))
    return canonical(rows).hint("merge").join(rows.select("path", "seed"), "path")
