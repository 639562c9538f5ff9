"""The given tables as inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stocktake.functions import paths as P
from stocktake.operators.joins import joined
from stocktake.sources.inventory import canonical

BUCKETS = ("Caches", "node_modules", "DerivedData", "Documents", "Media", ".hidden", "src", "Downloads")
ENDINGS = (".mov", ".mp4", ".zip", ".dmg", ".pkg", ".tmp", ".pdf", ".swift", ".JPG", ".sqlite", ".bin", "")


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer splits than there are cores (one small file), dealt out to all of them; any other stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def inv_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each lineitem row, below region / nation / supplier / bucket; with s_suppkey, l_partkey and n_nationkey."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    item = spread(read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"))
    bucket = _pick(BUCKETS, F.col("l_suppkey") % 8)
    above = F.concat_ws("/", F.lit(""), "r_name", "n_name", "s_name")
    where = (read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey").join(read("nation").select("n_nationkey", "n_name", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
             .join(read("region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
             .select("l_suppkey", F.concat_ws("/", above, bucket).alias("dir"))
             .select("*", (P.depth(F.col("dir")) + 1).alias("depth")))
    full = joined(item, where, "l_suppkey")
    size = F.floor(F.col("l_quantity") * 1000).cast("bigint")
    name = F.concat(F.concat_ws("-", F.lit("li"), "l_orderkey", "l_linenumber", "l_partkey"), F.when(F.col("l_partkey").isNull(), "").otherwise(_pick(ENDINGS, F.col("l_partkey") % 12)))
    listing = full.select(F.concat_ws("/", "dir", name).alias("path"), name.alias("name"), F.col("dir").alias("parent_path"), "depth",
                          F.lit("file").alias("kind"), size.alias("byte_size"), (F.floor((size + 4095) / 4096) * 4096).alias("allocated_size"), F.col("l_shipdate").alias("modified_at"))
    return canonical(listing, clean=True)


def inv_documents(spark: SparkSession, sf_dir: str, content: bool = True) -> DataFrame:
    """A file for each document, with its bytes if asked for."""
    read = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = read if content else spread(read.withColumn("bytes", F.octet_length(F.coalesce("text", F.lit("")))).drop("text"))  # contents do not move
    doc = F.col("doc_id")
    listing = docs.select(
        F.concat(F.lit("/corpus/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/doc-"), doc, _pick((".txt", ".md", ".csv", ""), doc % 4)).alias("path"),
        F.lit("file").alias("kind"), (F.octet_length(F.coalesce("text", F.lit(""))) if content else F.col("bytes")).cast("bigint").alias("byte_size"), F.when(doc % 97 == 0, 2).otherwise(1).alias("nlink"), F.lit("disk0").alias("device"), doc.alias("inode"),
        (F.lit("2000-01-01").cast("timestamp_ntz") + F.make_dt_interval(doc % 900)).alias("modified_at"), F.lit("2000-01-01").cast("timestamp_ntz").alias("ctime"),
        *([F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")] if content else []))
    return canonical(listing)


def inv_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each distinct page address; the smallest page_id stays."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.octet_length("html").cast("bigint").alias("byte_size"))
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://", "")), "[?#].*$", ""), "/+$", ""), "^$", "/")
    return canonical(pages.groupBy(path.alias("path")).agg(F.min_by("byte_size", "page_id").alias("byte_size")).withColumn("kind", F.lit("file")))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as changes to suppliers' directories."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    suppliers = read("supplier")
    where = (suppliers.join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
             .select("s_suppkey", F.concat_ws("/", F.lit(""), "r_name", "n_name", "s_name").alias("path")))
    size = suppliers.agg(F.count("*"))
    kind = F.element_at(F.create_map(*map(F.lit, ("signup", "create", "click", "modify", "purchase", "delete", "error", "dropped", "view", "noop"))), F.col("event_type"))
    return (read("events").withColumn("k", F.col("user_id") % size.scalar()).join(where, F.col("k") == F.col("s_suppkey"))
            .select("event_id", "ts", "path", kind.alias("change_type")))
