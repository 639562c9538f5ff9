"""The registered queries: each applies one operator to inventories made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stocktake.functions import paths as P
from stocktake.operators import cleanup as C, duplicates as D, filters as FL, incremental as I, ranking as R, review as V, tree as T
from stocktake.operators.joins import joined, kept
from stocktake.options import Options
from stocktake.sources import adapters as A, inventory as S

AS_OF = "2001-12-01"
#: The given tables hold small files; the other options are the defaults.
OPTIONS = Options(large_file_threshold=40_000, duplicate_candidate_threshold=0, verification_byte_limit=100_000, max_verification_files=60)
LARGE, LEAST_DUP, PREFIX = OPTIONS.large_file_threshold, OPTIONS.duplicate_candidate_threshold, 1024
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def items(spark, d):
    return A.inv_lineitem(spark, d)


def sized(spark, d):
    return items(spark, d).withColumn("size", P.display_size())


def partkey(df):
    return df.withColumn("k", F.regexp_extract("name", "^li-[0-9]+-[0-9]+-([0-9]+)", 1).try_cast("bigint"))


def nodes(spark, d):
    """Directories with their roll-up and files, as one tree: path, name, kind, size, modified_at, parent_path."""
    inv = items(spark, d)
    dirs = T.dir_rollup(inv).select("path", F.when(F.col("path") == "/", "/").otherwise(P.base_name(F.col("path"))).alias("name"), F.lit("folder").alias("kind"), "size", F.lit(None).cast("timestamp_ntz").alias("modified_at"), P.parent_path(F.col("path")).alias("parent_path"))
    return dirs.unionByName(inv.select("path", "name", "kind", P.display_size().alias("size"), "modified_at", "parent_path"))


def whole_tree(spark, d):
    """All nodes, each path once with the sum of its sizes; the name follows from the path, so both are one key."""
    return nodes(spark, d).groupBy("path", "name").agg(F.sum("size").alias("size"))


def folders(spark, d):
    """Directories only, with their sizes."""
    return T.dir_rollup(items(spark, d)).select("path", F.when(F.col("path") == "/", "/").otherwise(P.base_name(F.col("path"))).alias("name"), "size").withColumn("parent_path", P.parent_path(F.col("path")))


def selection(spark, d):
    """A batch of targets: the paths of all cleanup candidates, and once more those of all verified copies."""
    found = kept(members(spark, d))
    return candidates(spark, d, found).select("path").union(D.copies(found))


def docs(spark, d, content=True):
    return A.inv_documents(spark, d, content)


def contents(spark, d):
    return docs(spark, d).select("path", "content")


def members(spark, d):
    inv = docs(spark, d, False)
    return D.verified_members(D.duplicate_candidates(inv, LEAST_DUP), contents(spark, d), PREFIX)


def candidates(spark, d, found=None):
    doc_files = docs(spark, d, False).select("path", "name", "kind", P.display_size().alias("size"), "modified_at")
    entries = nodes(spark, d).select("path", "name", "kind", "size", "modified_at").unionByName(doc_files)
    return C.cleanup_candidates(entries, members(spark, d) if found is None else found, AS_OF, days=OPTIONS.old_file_age_days, old_bytes=49_000)


def cache(spark, d):
    """A digest table as an earlier run might have left it: three of four documents, some of them since changed."""
    x = docs(spark, d).filter("inode % 4 <> 0")
    return x.select("path", F.when(F.col("inode") % 5 == 0, F.col("byte_size") + 1).otherwise(F.col("byte_size")).alias("byte_size"), "modified_at", P.file_identity().alias("identity"), P.content_sha256(F.col("content")).alias("checksum"))


def identified(spark, d):
    return docs(spark, d, False).withColumn("identity", P.file_identity())


def snapshots(spark, d):
    inv = partkey(items(spark, d))
    a = inv.filter("k % 10 <> 0").drop("k")
    b = inv.filter("k % 10 <> 1").withColumn("byte_size", F.when(F.col("k") % 10 == 2, F.col("byte_size") + 1).otherwise(F.col("byte_size"))).drop("k")
    return a, b


def dirty_of(spark, d):
    return T.dirty_subtrees(A.changes(spark, d).filter("change_type = 'delete'"), T.directories(items(spark, d)))


# --- sources
@query
def read_inventory(spark, d):
    return items(spark, d).select("path", "name", "parent_path", "depth", "kind", "byte_size", "allocated_size", "modified_at", "is_hidden")


@query
def read_inventory_pages(spark, d):
    return A.inv_pages(spark, d).select("path", "name", "parent_path", "byte_size")


@query
def list_files(spark, d):
    return S.list_files(spark, d).select("name", "kind", "byte_size")


@query
def read_contents(spark, d):
    got = S.read_contents(D.same_size(docs(spark, d, False)), contents(spark, d))
    return got.select("path", F.octet_length("content").cast("bigint").alias("content_bytes"))


@query
def read_changes(spark, d):
    return S.changes_since(A.changes(spark, d), 5000)


@query
def scan_report(spark, d):
    inv, dinv = items(spark, d), docs(spark, d, False)
    found = kept(members(spark, d))
    parts = {
        "size_groups, size_group_files": D.size_groups(D.duplicate_candidates(dinv)).agg(F.struct(F.count("*"), F.sum("file_count"))),
        "verified_groups, verified_reclaimable": D.verified_groups(found).agg(F.struct(F.count("*"), F.sum("reclaimable_bytes"))),
        "candidates, candidate_bytes": candidates(spark, d, found).agg(F.struct(F.count("*"), F.sum("reclaimable_bytes"))),
    }
    report = R.scan_summary(inv, T.directories(inv))
    for names, value in parts.items():
        first, second = names.split(", ")
        report = report.withColumn("_both", value.scalar()).select("*", F.col("_both.col1").alias(first), F.col("_both.col2").alias(second)).drop("_both")
    return report


# --- scalars
@query
def display_size(spark, d):
    return items(spark, d).select("path", P.display_size().alias("size"))


@query
def path_parts(spark, d):
    p = F.col("path")
    return A.inv_pages(spark, d).select("path", P.base_name(p).alias("base"), P.parent_path(p).alias("above"), P.depth(p).alias("levels"))


@query
def path_ancestors(spark, d):
    return A.inv_pages(spark, d).select("path", F.array_join(P.path_ancestors(F.col("path")), "|").alias("ancestors"))


@query
def file_extension(spark, d):
    return items(spark, d).select("path", P.file_extension(F.col("name")).alias("ext"))


@query
def entry_kind(spark, d):
    doc = F.col("inode")
    return docs(spark, d, False).select("path", P.entry_kind(doc % 7 == 0, doc % 3 == 0, doc % 2 == 0, doc % 5 != 0).alias("entry"))


@query
def is_container(spark, d):
    return nodes(spark, d).filter(P.is_container(F.col("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query
def type_label(spark, d):
    return items(spark, d).select("path", P.type_label(P.file_extension(F.col("name"))).alias("label"))


@query
def type_category(spark, d):
    return items(spark, d).select("path", P.type_category(P.file_extension(F.col("name"))).alias("category"))


@query
def relative_path(spark, d):
    return items(spark, d).select("path", P.relative_path(F.col("path"), "/ASIA").alias("relative"))


@query
def candidate_id(spark, d):
    return items(spark, d).select(P.candidate_id(F.lit("general"), F.col("path")).alias("candidate_id"))


@query
def group_id(spark, d):
    return D.verified_groups(members(spark, d)).select("group_id")


@query
def confidence_rank(spark, d):
    return candidates(spark, d).select("candidate_id", P.confidence_rank(F.col("confidence")).alias("rank"))


@query
def trust_details(spark, d):
    return C.trust_details(candidates(spark, d)).select("candidate_id", "confidence_label", "flagged_reason")


@query
def natural_key(spark, d):
    return items(spark, d).select("path", P.natural_key(F.col("name")).alias("natural"))


@query
def content_sha256(spark, d):
    return docs(spark, d).select("path", P.content_sha256(F.col("content")).alias("checksum"))


@query
def prefix_sha256(spark, d):
    return docs(spark, d).select("path", P.prefix_sha256(F.col("content"), PREFIX).alias("checksum"))


@query
def file_identity(spark, d):
    return identified(spark, d).select("path", "identity")


@query
def redact_names(spark, d):
    return R.redact_names(items(spark, d), None)


@query
def redact_names_whole(spark, d):
    return R.redact_names(items(spark, d), None)


@query
def redact_tree(spark, d):
    return R.redact_tree(nodes(spark, d))


@query
def redact_tokens(spark, d):
    return R.redact_tokens(items(spark, d), "stocktake")


@query
def size_share(spark, d):
    return R.size_share(R.largest_folders(T.dir_rollup(items(spark, d)), 100)).select("path", F.floor(F.col("share") * 1_000_000).cast("bigint").alias("share_ppm"))


@query
def size_share_root(spark, d):
    return R.size_share(folders(spark, d), "/").select("path", F.floor(F.col("share") * 1_000_000).cast("bigint").alias("share_ppm"))


# --- filters
@query
def filter_hidden(spark, d):
    return FL.filter_hidden(items(spark, d), OPTIONS.include_hidden).select("path")


@query
def filter_excluded(spark, d):
    return FL.filter_excluded(items(spark, d), ["node_modules"], ["/ASIA/CHINA", "~/x"], home="/EUROPE").select("path")


@query
def filter_empty_other(spark, d):
    other = docs(spark, d, False).withColumn("kind", F.when(F.col("inode") % 2 == 0, "other").otherwise("file")).withColumn("byte_size", F.when(F.col("inode") % 4 == 0, 0).otherwise(F.col("byte_size"))).withColumn("allocated_size", F.col("byte_size"))
    return FL.filter_empty_other(other).select("path")


@query
def filter_size(spark, d):
    return FL.filter_size(items(spark, d), LARGE).select("path")


@query
def search_items(spark, d):
    return FL.search_items(items(spark, d), "  asia ZIP ").select("path")


@query
def filter_file_type(spark, d):
    return FL.filter_file_type(items(spark, d), ".JPG").select("path")


@query
def filter_lane(spark, d):
    return FL.filter_lane(candidates(spark, d), "verified").select("candidate_id")


@query
def filter_candidates(spark, d):
    c = kept(candidates(spark, d))
    return FL.filter_candidates(c, "cache", 100_000, "suggestions", c.filter("path like '%0/Caches'").select("candidate_id")).select("candidate_id")


@query
def filter_types(spark, d):
    return FL.filter_types(R.type_breakdown(items(spark, d)), "vid").select("label", "category")


@query
def hardlink_filter(spark, d):
    return FL.hardlink_filter(docs(spark, d, False)).select("path")


@query
def exclude_root(spark, d):
    return FL.exclude_root(folders(spark, d), "/").select("path")


# --- joins
@query
def top_level(spark, d):
    return T.top_level(selection(spark, d))


@query
def nested_pairs(spark, d):
    return T.nested_pairs(selection(spark, d))


@query
def missing_targets(spark, d):
    return V.missing_targets(selection(spark, d), items(spark, d))


@query
def batch_preflight(spark, d):
    return V.batch_preflight(selection(spark, d), items(spark, d))


@query
def unverified_groups(spark, d):
    return D.unverified_groups(D.duplicate_candidates(docs(spark, d, False)), members(spark, d))


@query
def merge_verified(spark, d):
    g = D.verified_groups(members(spark, d))
    return D.merge_verified(g, g.filter("byte_size % 2 = 0").withColumn("file_count", F.col("file_count") + 1)).select("checksum", "file_count", "origin")


@query
def visible_groups(spark, d):
    return D.visible_groups(members(spark, d), FL.matches("en", "path"), 500).select("group_id", "file_count")


@query
def pick_keeper(spark, d):
    m = members(spark, d)
    return D.pick_keeper(D.verified_groups(m), m.groupBy("checksum").agg(F.max("path").alias("path")).filter("checksum < '8'"))


@query
def protect_keepers(spark, d):
    m = members(spark, d)
    keep = D.verified_groups(m).select(F.col("first_path").alias("keeper"))
    dirs = T.directories(docs(spark, d, False)).select("path")
    return V.protect_keepers(m.select("path").union(dirs), keep)


@query
def cached_checksums(spark, d):
    return D.cached_checksums(identified(spark, d), cache(spark, d))


@query
def changed_targets(spark, d):
    old = identified(spark, d)
    new = old.filter("inode % 11 <> 0").withColumn("byte_size", F.when(F.col("inode") % 13 == 0, F.col("byte_size") + 1).otherwise(F.col("byte_size")))
    return V.changed_targets(old, new)


@query
def validate_copies(spark, d):
    m = members(spark, d)
    first = D.verified_groups(m).select(F.col("first_path").alias("path"))
    chosen = m.select("path").join(first, "path", "left_anti").union(m.filter("checksum < '4'").select("path")).distinct()
    fresh = m.select("path", F.when(F.col("path").endswith(".md"), F.lit("stale")).otherwise(F.col("checksum")).alias("checksum"))
    return V.validate_copies(chosen, m, fresh)


@query
def snapshot_diff(spark, d):
    return I.snapshot_diff(*snapshots(spark, d))


@query
def splice_subtrees(spark, d):
    a, b = snapshots(spark, d)
    return T.splice_subtrees(a, dirty_of(spark, d), b).select("path", "byte_size")


# --- aggregations
@query
def dir_rollup(spark, d):
    return T.dir_rollup(items(spark, d))


@query
def scan_summary(spark, d):
    inv = items(spark, d)
    return R.scan_summary(inv, T.directories(inv))


@query
def type_breakdown(spark, d):
    return R.type_breakdown(items(spark, d))


@query
def category_breakdown(spark, d):
    return R.category_breakdown(R.type_breakdown(items(spark, d)))


@query
def filtered_categories(spark, d):
    return R.filtered_categories(R.type_breakdown(items(spark, d)), "i")


@query
def type_rollup(spark, d):
    return R.type_rollup(items(spark, d))


@query
def size_groups(spark, d):
    return D.size_groups(D.duplicate_candidates(docs(spark, d, False)))


@query
def size_group_pages(spark, d):
    return D.size_group_pages(D.duplicate_candidates(docs(spark, d, False))).select("byte_size", "page", "file_count", F.array_join("members", "|").alias("members"))


@query
def size_group_ids(spark, d):
    return D.size_group_ids(D.size_group_pages(D.duplicate_candidates(docs(spark, d, False))))


@query
def verify_size(spark, d):
    """Proof of the size group that would free most."""
    files = D.duplicate_candidates(docs(spark, d, False))
    first = D.size_groups(files).orderBy(F.desc("reclaimable_bytes"), F.desc("byte_size")).first()
    sized_contents = docs(spark, d).select("path", "byte_size", "content")
    return D.verify_size(files, sized_contents, first["byte_size"] if first else -1, PREFIX)


@query
def still_the_same(spark, d):
    """Verified members after some files have vanished and others changed in size."""
    old = identified(spark, d)
    new = old.filter("inode % 11 <> 0").withColumn("byte_size", F.when(F.col("inode") % 13 == 0, F.col("byte_size") + 1).otherwise(F.col("byte_size")))
    return D.still_the_same(members(spark, d), old, new)


@query
def verified_groups(spark, d):
    return D.verified_groups(members(spark, d))


@query
def already_verified(spark, d):
    return D.already_verified(D.duplicate_candidates(docs(spark, d, False)), members(spark, d))


@query
def verification_cost(spark, d):
    return D.verification_cost(D.duplicate_candidates(docs(spark, d, False)), contents(spark, d), PREFIX)


@query
def retention_stats(spark, d):
    return R.retention_stats(D.duplicate_candidates(items(spark, d), 20_000), OPTIONS.duplicate_candidate_cap)


@query
def reclaim_total(spark, d):
    return C.reclaim_total(candidates(spark, d))


@query
def verified_reclaim_total(spark, d):
    return D.visible_groups(members(spark, d), F.lit(True), 500).agg(F.sum("reclaimable_bytes").alias("reclaimable_bytes"))


@query
def reclaim_plan(spark, d):
    gaps = items(spark, d).agg(F.count_if(F.col("byte_size") % 1000 == 0).alias("n"))
    return C.reclaim_plan(candidates(spark, d), gaps)


@query
def reclaim_plan_present(spark, d):
    """Present is what the later snapshot and the documents hold."""
    now = snapshots(spark, d)[1].select("path").union(docs(spark, d, False).select("path")).union(T.directories(items(spark, d)).select("path")).distinct()
    gaps = items(spark, d).agg(F.count_if(F.col("byte_size") % 1000 == 0).alias("n"))
    return C.reclaim_plan_present(candidates(spark, d), gaps, now)


@query
def review_summary(spark, d):
    return C.review_summary(candidates(spark, d))


# --- ranking
@query
def largest_files(spark, d):
    return R.largest_files(items(spark, d), OPTIONS.ranked_limit)


@query
def largest_folders(spark, d):
    return R.largest_folders(T.dir_rollup(items(spark, d)), OPTIONS.ranked_limit)


@query
def old_large_files(spark, d):
    return R.old_large_files(items(spark, d), AS_OF, OPTIONS.old_file_age_days, LARGE, OPTIONS.ranked_limit)


@query
def sort_items(spark, d):
    return R.sort_items(sized(spark, d).select("path", "modified_at"), "newest", None).select("path", "rank")


@query
def sort_items_whole(spark, d):
    return R.sort_items(sized(spark, d).select("path", "modified_at"), "newest", None).select("path", "rank")


@query
def cap_candidates(spark, d):
    return D.duplicate_candidates(items(spark, d), 20_000, OPTIONS.duplicate_candidate_cap).select("path", "byte_size")


@query
def order_size_groups(spark, d):
    return R.ranked_whole(D.size_groups(D.duplicate_candidates(docs(spark, d, False))), F.desc("total_bytes"), F.desc("byte_size")).select("byte_size", "rank")


@query
def order_size_groups_whole(spark, d):
    return R.ranked_whole(D.size_groups(D.duplicate_candidates(docs(spark, d, False))), F.desc("total_bytes"), F.desc("byte_size")).select("byte_size", "rank")


@query
def order_verified_groups(spark, d):
    return R.ranked_whole(D.verified_groups(members(spark, d)), F.desc("reclaimable_bytes"), F.desc("byte_size"), F.asc("checksum")).select("group_id", "rank")


@query
def order_verified_groups_whole(spark, d):
    return R.ranked_whole(D.verified_groups(members(spark, d)), F.desc("reclaimable_bytes"), F.desc("byte_size"), F.asc("checksum")).select("group_id", "rank")


@query
def budget_groups(spark, d):
    return D.budget_groups(D.size_groups(D.duplicate_candidates(docs(spark, d, False))), OPTIONS.verification_byte_limit, OPTIONS.max_verification_files).select("byte_size", "file_count")


@query
def cleanup_candidates(spark, d):
    return C.rank_candidates(candidates(spark, d), OPTIONS.ranked_limit).select("candidate_id", "confidence", "reclaimable_bytes", "rank")


@query
def top_children(spark, d):
    """Files and sub-directories alike."""
    return T.top_children(nodes(spark, d).filter("path <> '/'"), 20).select("path", "rank")


@query
def overview_children(spark, d):
    return R.ranked(folders(spark, d).filter("parent_path = '/'").select("path", "name", "size"), 12, F.desc("size"), F.asc("name")).select("path", "size", "rank")


@query
def item_query(spark, d):
    return R.item_query(items(spark, d), "europe documents", 10_000, "pdf", "size", 500).select("path", "rank")


@query
def item_query_folders(spark, d):
    rows = folders(spark, d).withColumn("kind", F.lit("folder")).withColumn("modified_at", F.lit(None).cast("timestamp_ntz"))
    base = R.ranked(FL.exclude_root(rows, "/"), 500, F.desc("size"), F.asc("path")).drop("rank")
    return R.item_query(base, "asia", 100_000, "pdf", "name", view="folders").select("path", "rank")


@query
def item_query_old_files(spark, d):
    base = R.old_large_files(items(spark, d), AS_OF, OPTIONS.old_file_age_days, LARGE, OPTIONS.ranked_limit).drop("rank").withColumn("name", P.base_name(F.col("path"))).withColumn("kind", F.lit("file"))
    return R.item_query(base, "li-", 45_000, "zip", "oldest", view="old_files").select("path", "rank")


@query
def item_query_candidates(spark, d):
    base = FL.filter_lane(candidates(spark, d), "suggestions").withColumn("kind", F.lit("file")).withColumn("modified_at", F.lit(None).cast("timestamp_ntz"))
    return R.item_query(base, "europe", 20_000, "pdf", "size", None, view="candidates").select("path", "rank")


@query
def item_query_duplicates(spark, d):
    times = docs(spark, d, False).select("path", "name", "kind", "modified_at", P.display_size().alias("size"))
    base = times.hint("merge").join(members(spark, d).select("path").distinct(), "path", "left_semi")
    return R.item_query(base, "corpus", 100, "txt", "newest", None, view="duplicates").select("path", "rank")


@query
def preorder(spark, d):
    """The whole tree of folders."""
    return T.preorder(folders(spark, d))


@query
def preorder_whole(spark, d):
    """The whole tree, files included; a path that the inventory holds twice is one node with the sum of the sizes."""
    return T.preorder(whole_tree(spark, d))


@query
def tree_search(spark, d):
    return T.tree_search(folders(spark, d), FL.matches("caches", "name"))


@query
def latest_snapshots(spark, d):
    scans = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("/root-"), F.col("o_custkey") % 40).alias("root"), F.col("o_orderdate").alias("scanned_at"), F.floor("o_totalprice").cast("bigint").alias("total_bytes"))
    return R.latest_snapshots(scans, 8)


@query
def purge_cache(spark, d):
    gone = docs(spark, d, False)
    return D.purge_cache(cache(spark, d), gone.filter("inode % 3 <> 0"), gone.filter("inode % 6 = 0")).select("path")


# --- sets, incremental
@query
def dirty_subtrees(spark, d):
    return dirty_of(spark, d)


@query
def ignored_candidates(spark, d):
    c = kept(candidates(spark, d).select("candidate_id", "candidate_kind"))
    return joined(c, kept(c.filter("candidate_kind = 'archive'").select("candidate_id").distinct()), "candidate_id", "left_semi").select("candidate_id")


@query
def fallback_reason(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    u = F.col("user_id")
    expected = {"schema_version": 1, "root": "/", "volume": "v0", "options": "o0"}
    reason = I.fallback_reason(F.when(u % 13 == 0, F.lit(None)).when(u % 11 == 0, -1).when(u % 17 == 0, 2).otherwise(1), F.when(u % 19 == 0, "/x").otherwise("/"), F.when(u % 7 == 0, "v1").otherwise("v0"), F.when(u % 5 == 0, "o1").otherwise("o0"),
                               F.when(u % 23 == 0, F.lit(None)).otherwise(F.col("event_id")), expected, F.col("event_type") == "error", u % 29 != 0, u % 300)
    return e.select("event_id", reason.alias("reason"))


@query
def tree_consistency(spark, d):
    return T.tree_consistency(nodes(spark, d).filter("path not like '%3/src'"))


@query
def trust_verify(spark, d):
    return I.trust_verify(*snapshots(spark, d))


@query
def dedupe_changes(spark, d):
    return I.dedupe_changes(A.changes(spark, d))


@query
def changes_per_window(spark, d):
    return I.changes_per_window(A.changes(spark, d))
