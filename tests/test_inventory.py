"""Single operators on small inventories, differential checks, and the streaming jobs."""

import tempfile

from pyspark.sql import functions as F

from stocktake.functions import paths as P
from stocktake.operators import cleanup as C, duplicates as D, filters as FL, incremental as I, ranking as R, review as V, tree as T
from stocktake.sources import inventory as S
from stocktake.streaming import live


def inv(spark, rows):
    """rows: (path, byte_size)."""
    return S.canonical(spark.createDataFrame(rows, "path string, byte_size bigint").withColumn("kind", F.lit("file")))


def paths(df, col="path"):
    return sorted(r[0] for r in df.select(col).collect())


def test_ranking_and_types(spark):
    x = inv(spark, [("/r/Media/video.mov", 10_000), ("/r/Media/image.raw", 4000), ("/r/Cache/scratch.bin", 2000)])
    assert R.largest_files(x, 1).first()["path"] == "/r/Media/video.mov"
    assert R.largest_folders(T.dir_rollup(x), 2).orderBy("rank").collect()[1]["path"] == "/r/Media"
    top = R.type_breakdown(x).orderBy(F.desc("total_bytes")).first()
    assert (top["label"], top["category"]) == (".mov", "Video")


def test_whole_order_has_all_rows(spark):
    x = spark.range(0, 3000, 1, 7).select((F.col("id") * 7919 % 3000).alias("v"), F.concat(F.lit("/f-"), F.format_string("%05d", F.col("id"))).alias("path"))
    got = {r["path"]: r["rank"] for r in R.ranked_whole(x, F.desc("v"), F.asc("path")).collect()}
    want = sorted(x.collect(), key=lambda r: (-r["v"], r["path"]))
    assert got == {r["path"]: k for k, r in enumerate(want, 1)}
    assert R.ranked_whole(x.filter("v < 0"), F.asc("v")).count() == 0


def test_whole_queries_equal_their_sql(spark):
    import duckdb

    from stocktake.plans import oracles, queries as Q

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{d}/{name}.parquet')")
    for name in ("redact_names_whole", "redact_tokens", "sort_items_whole", "order_size_groups_whole", "order_verified_groups_whole", "preorder_whole"):
        assert sorted(map(tuple, Q.QUERIES[name](spark, d).collect())) == sorted(con.execute(oracles.ORACLE_SQL[name]).fetchall()), name


def test_rollup_counts(spark):
    x = inv(spark, [("/a/b/c/f", 1), ("/a/b/g", 2), ("/a/h", 4)])
    got = {r["path"]: (r["logical"], r["children"], r["descendants"]) for r in T.dir_rollup(x).collect()}
    assert got == {"/": (7, 1, 6), "/a": (7, 2, 5), "/a/b": (3, 2, 3), "/a/b/c": (1, 1, 1)}


def entries(spark, rows):
    """rows: (path, kind, size)."""
    return spark.createDataFrame(rows, "path string, kind string, size bigint").withColumn("name", P.base_name(F.col("path"))).withColumn("parent_path", P.parent_path(F.col("path"))).withColumn("modified_at", F.lit(None).cast("timestamp_ntz"))


def test_item_query_of_views(spark):
    x = entries(spark, [("/a/d10", "folder", 9), ("/a/d9", "folder", 9), ("/a/x.PDF", "file", 7), ("/a/y", "file", 7), ("/b/z.pdf", "file", 1)])
    ask = lambda view, **how: [r["path"] for r in R.item_query(x, "a", 5, view=view, **how).orderBy("rank").collect()]
    assert ask("folders", extension="pdf", by="name") == ["/a/d9", "/a/d10", "/a/x.PDF", "/a/y"]
    assert ask("duplicates", extension="pdf") == ["/a/x.PDF"] and ask("old_files", extension="") == ["/a/y"]
    assert ask("files", k=2) == ask("files", k=None)[:2]


def test_names_in_natural_unicode_order_and_search_beyond_ascii(spark):
    names = ["Zoo", "zebra", "éclair", "Eclair 10", "eclair 9", "ecru", "Äpfel", "apfel2", "apfel10", "Öl", "ol", "e\u0301tude"]
    x = entries(spark, [(f"/r/{n}", "file", 5) for n in names])
    got = [r["path"][3:] for r in R.sort_items(x, "name", None).orderBy("rank").collect()]
    assert got == ["Äpfel", "apfel2", "apfel10", "éclair", "eclair 9", "Eclair 10", "ecru", "e\u0301tude", "ol", "Öl", "zebra", "Zoo"]
    assert [r["path"][3:] for r in R.sort_items(x, "name", 3).orderBy("rank").collect()] == got[:3]
    found = lambda q: sorted(n[3:] for n in paths(FL.search_items(x, q)))
    assert found("ÉCLAIR") == ["éclair"] and found("ÄPFEL r") == ["Äpfel"] and found("étude") == ["e\u0301tude"] and found("ECLAIR") == ["Eclair 10", "eclair 9"]


def test_redacted_tree(spark):
    x = entries(spark, [("/", "folder", 3), ("/a", "folder", 3), ("/a/b.tar.GZ", "file", 1), ("/a/b.tar.GZ", "file", 2), ("/c/.rc", "file", 0)])
    got = sorted(map(tuple, R.redact_tree(x).collect()))
    assert got == [("/", "Folder 1", "Folder 1"), ("/a", "Folder 2", "…/Folder 1/Folder 2"), *[("/a/b.tar.GZ", "File 3.GZ", "…/Folder 2/File 3.GZ")] * 2, ("/c/.rc", "File 5", "…/Folder 4/File 5")]
    assert R.redact_tree(x.limit(0)).count() == 0


def test_plan_of_present_candidates(spark):
    c = spark.createDataFrame([("/a", "cacheFolder", 5), ("/a/x", "verifiedDuplicate", 2), ("/b/y", "verifiedDuplicate", 3), ("/gone", "archive", 9)], "path string, candidate_kind string, reclaimable_bytes bigint")
    here = spark.createDataFrame([("/a",), ("/a/x",), ("/b/y",)], "path string")
    plan = lambda candidates, n: [tuple(r) for r in C.reclaim_plan_present(candidates, spark.range(n).agg(F.count("*").alias("n")), here).orderBy("section_order").collect()]
    assert plan(c, 2) == [(1, "verified", 1, 3, "review_verified_copies", True, 1), (2, "review", 1, 5, "review_suggestions", False, 1), (3, "access_gaps", 2, 0, "inspect_unreadable", False, 1)]
    assert plan(c.limit(0), 2) == [(3, "access_gaps", 2, 0, "inspect_unreadable", True, 0)] and plan(c.limit(0), 0) == []


def test_extensions(spark):
    names = [".bashrc", "a.tar.gz", "b", "C.JPG", "d."]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(P.file_extension(F.col("n"))).collect()
    assert [r[0] for r in got] == [None, "gz", None, "jpg", None]


def test_top_level_keeps_siblings(spark):
    x = spark.createDataFrame([("/a/b",), ("/a/bc",), ("/a/b/c",), ("/a/b",)], "path string")
    assert paths(T.top_level(x)) == ["/a/b", "/a/bc"]
    assert paths(T.top_level(x.union(spark.createDataFrame([("/",)], "path string")))) == ["/"]
    assert [tuple(r) for r in T.nested_pairs(x).collect()] == [("/a/b/c", "/a/b")]


def test_preflight_order(spark):
    here = spark.createDataFrame([("/a",), ("/a/b",)], "path string")
    verdict = lambda *p: V.batch_preflight(spark.createDataFrame([(x,) for x in p], "path string"), here).first()["verdict"]
    assert [verdict("/a", "/a", "/x"), verdict("/a", "/x"), verdict("/a", "/a/b"), verdict("/a")] == ["duplicates", "missing", "nested", "ok"]


def test_duplicates_are_proved_by_content(spark):
    rows = [("/1", b"same-content"), ("/2", b"same-content"), ("/3", b"different!!!"), ("/4", b"x")]
    contents = spark.createDataFrame(rows, "path string, content binary")
    files = inv(spark, [(p, len(c)) for p, c in rows])
    assert paths(D.verified_members(files, contents)) == ["/1", "/2"]
    cost = D.verification_cost(files, contents, 4).first()
    assert (cost["tiered_bytes"], cost["naive_bytes"], cost["full_reads"]) == (3 * 4 + 2 * 12, 36, 2)


def test_budget_skips_and_goes_on(spark):
    groups = D.size_groups(inv(spark, [(f"/a{i}", 20) for i in range(3)] + [(f"/b{i}", 10) for i in range(2)]))
    kept = lambda b: sorted(r["byte_size"] for r in D.budget_groups(groups, b, 100).collect())
    assert (kept(60), kept(8), kept(0), kept(80), kept(30)) == ([20], [], [], [10, 20], [10])


def test_hard_links_are_no_candidates(spark):
    x = inv(spark, [("/a", 5), ("/b", 5)]).withColumn("nlink", F.when(F.col("path") == "/a", 2).otherwise(1))
    assert paths(FL.hardlink_filter(x)) == ["/b"]


def test_exclusions(spark):
    x = inv(spark, [("/r/node_modules/a", 1), ("/r/keep/a", 1), ("/r/keeper/a", 1)])
    assert paths(FL.filter_excluded(x, ["node_modules"], ["/r/keep"])) == ["/r/keeper/a"]
    assert len(paths(FL.filter_excluded(x))) == 3
    assert FL.split_exclusions(["~/x", "/y", "z"]) == (["z"], ["~/x", "/y"])


def test_exclusions_and_hidden_entries_below_the_root(spark):
    x = inv(spark, [("/.cache/r/a", 1), ("/.cache/r/.b/c", 1), ("/.cache/r/Node_Modules/d", 1), ("/.cache/r/node_modules/e", 1), ("/.cache/r/f", 1)])
    x = x.withColumn("is_hidden", F.col("name") == "f")
    assert paths(FL.filter_hidden(x, root="/.cache/r")) == ["/.cache/r/Node_Modules/d", "/.cache/r/a", "/.cache/r/node_modules/e"]
    assert "/.cache/r/f" in paths(FL.filter_excluded(x, [".cache", "node_modules"], root="/.cache/r"))
    assert paths(FL.filter_excluded(x, [".cache", "node_modules"], root="/.cache/r").filter("path like '%odules%'")) == ["/.cache/r/Node_Modules/d"]


def test_differences_by_any_column(spark):
    x = inv(spark, [("/a", 1), ("/b", 1), ("/c", 1)])
    y = x.withColumn("nlink", F.when(F.col("path") == "/a", 2).otherwise(F.col("nlink"))).withColumn("is_readable", F.col("path") != "/b")
    assert [tuple(r) for r in I.snapshot_diff(x, y).orderBy("path").collect()] == [("/a", "modified"), ("/b", "modified")]
    at = lambda us: F.lit(f"2024-01-01 00:00:00.{us:06d}").cast("timestamp_ntz")
    old = x.withColumn("identity", F.lit("i")).withColumn("modified_at", at(5))
    new = old.withColumn("modified_at", F.when(F.col("path") == "/a", at(6)).when(F.col("path") == "/b", at(7)).otherwise(at(5)))
    assert [tuple(r) for r in V.changed_targets(old, new).collect()] == [("/b", "changed")]


def test_children_are_files_and_directories(spark):
    x = inv(spark, [("/r/a", 5), ("/r/d/b", 4), ("/r/d/c", 4)])
    tree = T.dir_rollup(x).select("path", P.base_name(F.col("path")).alias("name"), "size").unionByName(x.select("path", "name", P.display_size().alias("size"))).withColumn("parent_path", P.parent_path(F.col("path")))
    assert [r["path"] for r in T.top_children(tree.filter("parent_path = '/r'"), 2).orderBy("rank").collect()] == ["/r/d", "/r/a"]


def test_listings_of_other_formats(spark, tmp_path):
    (tmp_path / "x.csv").write_text("where,bytes,kind\n/a/b/,7,file\n/a/c.txt,9,file\n")
    (tmp_path / "x.json").write_text('{"where": "/a/b", "bytes": 7, "kind": "file"}\n{"where": "/a/c.txt", "bytes": 9, "kind": "file"}\n')
    for fmt in ("csv", "json"):
        got = S.read_inventory(spark, f"file://{tmp_path}/x.{fmt}", fmt, {"path": "where", "byte_size": "bytes"}, schema="where string, bytes bigint, kind string")
        assert sorted((r["path"], r["name"], r["parent_path"], r["byte_size"], r["allocated_size"]) for r in got.collect()) == [("/a/b", "b", "/a", 7, 7), ("/a/c.txt", "c.txt", "/a", 9, 9)]
    assert S.read_inventory(spark, f"file://{tmp_path}/x.csv", "csv", {"path": "where", "byte_size": "bytes"}, schema="where string, bytes bigint, kind string").columns == [f.name for f in S.SCHEMA]


def test_digest_cache(spark, tmp_path):
    cols = S.CACHE_SCHEMA
    old = spark.createDataFrame([("/a", 1, None, "i", None, "p", 64), ("/b", 1, None, "j", "x", None, None), ("/c", 1, None, "k", "z", None, None)], cols)
    new = spark.createDataFrame([("/a", 1, None, "i", "full", None, None), ("/b", 2, None, "other", None, "q", 64), ("/d", 1, None, "l", "w", None, None)], cols)
    both = D.record_checksums(old, new).select(*old.columns)
    name = S.save_checksum_cache(both, f"file://{tmp_path}/cache")
    read, readable = S.load_checksum_cache(spark, name)
    assert readable and {r["path"]: (r["checksum"], r["prefix_checksum"]) for r in read.collect()} == {"/a": ("full", "p"), "/b": (None, "q"), "/c": ("z", None), "/d": ("w", None)}
    missing, readable = S.load_checksum_cache(spark, f"file://{tmp_path}/none")
    assert not readable and missing.count() == 0


def test_synthetic_inventory(spark):
    x = S.synthetic_inventory(spark, 2000)
    assert x.count() == 2000 and x.select("path").distinct().count() == 2000
    assert x.groupBy("seed").agg(F.count("*").alias("n"), F.count_distinct("byte_size").alias("sizes")).filter("n = 2 AND sizes = 1").count() == 100


def test_large_sides_are_joined_by_key(spark, monkeypatch):
    from stocktake.operators import joins

    rows = [(f"/d/{k}", k % 5 + 1, "abcdef"[k % 3] * (k % 5 + 1)) for k in range(60)]
    x = inv(spark, [r[:2] for r in rows])
    contents = spark.createDataFrame([(p, c.encode()) for p, _, c in rows], "path string, content binary")
    want = sorted(map(tuple, D.verified_members(x, contents, 2).collect()))
    assert len(want) == 60
    monkeypatch.setattr(joins, "FEW_ROWS", 3)
    assert sorted(map(tuple, D.verified_members(x, contents, 2).collect())) == want


def test_cleanup_kinds(spark):
    rows = [("/Caches", "folder"), ("/DerivedData", "folder"), ("/a.zip", "file"), ("/b.dmg", "file"), ("/c.tmp", "file"), ("/keep.txt", "file"), ("/d~", "file"), ("/e.pkg", "file")]
    x = spark.createDataFrame([(p, p[1:], k, 10) for p, k in rows], "path string, name string, kind string, size bigint").withColumn("modified_at", F.lit(None).cast("timestamp_ntz"))
    got = {r["path"]: r["candidate_kind"] for r in C.rule_candidates(x, "2001-12-01").collect()}
    assert got == {"/Caches": "cacheFolder", "/DerivedData": "buildArtifact", "/a.zip": "archive", "/b.dmg": "diskImage", "/c.tmp": "temporary", "/d~": "temporary", "/e.pkg": "installer"}


def test_cache_needs_the_whole_identity(spark):
    cols = "path string, byte_size bigint, modified_at timestamp_ntz, identity string"
    files = spark.createDataFrame([("/a", 1, None, "i"), ("/b", 1, None, None), ("/c", 2, None, "k")], cols)
    cache = spark.createDataFrame([("/a", 1, None, "i", "x"), ("/b", 1, None, None, "y"), ("/c", 1, None, "k", "z")], cols + ", checksum string")
    assert {r["path"]: r["checksum"] for r in D.cached_checksums(files, cache).collect()} == {"/a": "x", "/b": "y", "/c": None}  # two unknown identities agree
    assert D.cache_counters(D.cached_checksums(files, cache)).first().asDict() == {"hits": 2, "misses": 1}
    wide = cache.withColumn("prefix_checksum", F.lit("p")).withColumn("prefix_bytes", F.when(F.col("path") == "/a", 64).otherwise(32))
    assert {r["path"]: r["prefix_checksum"] for r in D.cached_checksums(files, wide, 64).collect()} == {"/a": "p", "/b": None, "/c": None}


def test_splice_of_a_difference_is_the_new_inventory(spark):
    a = inv(spark, [(f"/d{i % 4}/f{i}", i) for i in range(40)])
    b = inv(spark, [(f"/d{i % 4}/f{i}", i + (i % 7 == 0)) for i in range(3, 45)])
    dirty = T.dirty_subtrees(I.snapshot_diff(a, b), T.directories(a))
    assert I.trust_verify(T.splice_subtrees(a, dirty, b), b).first()["trusted"]


def test_snapshot_guards(spark, tmp_path):
    where, x = f"file://{tmp_path}/snap", inv(spark, [("/a", 1)])
    expect = {"root": "/", "volume": "v", "options": "o"}
    assert S.load_snapshot(spark, where, expect) == (None, "missing")
    S.save_snapshot(x, where, "/", "v", "o", 7)
    assert S.load_snapshot(spark, where, expect)[0].count() == 1
    assert S.load_snapshot(spark, where, expect | {"volume": "w"}) == (None, "volume")


def test_plans_stay_in_the_jvm(spark):
    from stocktake.plans.queries import QUERIES

    for name in ("dir_rollup", "type_breakdown", "largest_files", "top_level"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan, name
    assert "TakeOrderedAndProject" in plan or "TakeOrderedAndProject" in QUERIES["largest_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_plans_read_an_input_twice_at_most(spark):
    """Roll-up and rows of one inventory are two scans; what else needs them is kept."""
    from stocktake.plans.queries import QUERIES

    for name in ("tree_consistency", "reclaim_plan", "batch_preflight", "ignored_candidates", "filter_candidates", "splice_subtrees", "preorder", "tree_search", "missing_targets", "cleanup_candidates", "snapshot_diff"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") <= 2 and "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_streams(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    x = inv(spark, [("/a/x.mov", 5), ("/a/y.mov", 7), ("/b/z.txt", 1)])
    x.write.parquet(f"{base}/inv")
    q = live.live_largest(live.stream_inventory(spark, f"{base}/inv"), f"{base}/top", f"{base}/cp1", k=2)
    q.awaitTermination(60)
    assert paths(spark.read.parquet(f"{base}/top")) == ["/a/x.mov", "/a/y.mov"]
    inv(spark, [("/c/w.mov", 6), ("/a/x.mov", 5)]).write.mode("append").parquet(f"{base}/inv")
    live.live_largest(live.stream_inventory(spark, f"{base}/inv"), f"{base}/top", f"{base}/cp1", k=2).awaitTermination(60)  # a new query from the checkpoint
    assert paths(spark.read.parquet(f"{base}/top").filter("batch = 1")) == ["/a/y.mov", "/c/w.mov"]
    for view, want in ((live.live_types, {(".mov", 4), (".txt", 1)}), (live.live_summary, {(5, 0)})):
        q = live.live_progress(live.stream_inventory(spark, f"{base}/inv"), view.__name__, f"{base}/{view.__name__}", view=view)
        q.processAllAvailable()
        got = spark.table(view.__name__)
        assert {tuple(r) for r in (got.select("label", "file_count") if "label" in got.columns else got.select("scanned_items", "inaccessible_count")).collect()} == want
        q.stop()
    spark.sql("SELECT 1L AS event_id, timestamp_ntz'2024-01-01 00:00:00' AS ts, '/a/x.mov' AS path, 'modify' AS change_type").write.parquet(f"{base}/log")
    q = live.stream_dirty(S.read_changes(spark, f"{base}/log"), T.directories(x), f"{base}/dirty", f"{base}/cp2")
    q.awaitTermination(60)
    assert paths(spark.read.parquet(f"{base}/dirty/batch-00000000")) == ["/a"]


def log(spark, folder, rows):
    spark.createDataFrame(rows, "event_id bigint, path string, change_type string").selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, event_id) AS ts", "path", "change_type").coalesce(1).write.mode("append").parquet(folder)


def test_refresh_of_a_snapshot(spark, tmp_path):
    base, expect = f"file://{tmp_path}", {"root": "/", "volume": "v", "options": "o"}
    state = {"now": inv(spark, [("/a/x", 1), ("/b/y", 2), ("/c/z", 3)]), "asked": []}

    def listing(dirty):
        state["asked"].append(None if dirty is None else paths(dirty))
        return state["now"]

    def step(rows, **options):
        log(spark, f"{base}/log", rows)
        live.refresh_snapshot(S.read_changes(spark, f"{base}/log"), listing, f"{base}/snap", expect, f"{base}/cp", **options).awaitTermination(60)
        last = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/snap/results").orderBy(F.desc("batch")).first()
        return last["result"], last["reason"], last["dirty_count"], sorted(map(tuple, S.load_snapshot(spark, f"{base}/snap", expect)[0].select("path", "byte_size").collect()))

    first = [("/a/x", 1), ("/b/y", 2), ("/c/z", 3)]
    assert step([(1, "/a/x", "create")]) == ("full", "missing", 0, first)
    assert step([(2, "/a/x", "noop")]) == ("unchanged", None, 0, first)
    state["now"] = inv(spark, [("/a/x", 9), ("/b/y", 8), ("/c/z", 3)])
    assert step([(3, "/a/x", "modify")]) == ("incremental", None, 1, [("/a/x", 9), ("/b/y", 2), ("/c/z", 3)])
    assert step([(4, "/a/x", "modify"), (5, "/c/z", "modify")], most_dirty=1) == ("full", "too_many_dirty", 2, [("/a/x", 9), ("/b/y", 8), ("/c/z", 3)])
    assert step([(6, "/", "dropped")])[:2] == ("full", "history")
    assert state["asked"] == [None, ["/a"], None, None]


def test_snapshots_of_several_roots(spark, tmp_path):
    where, expect = f"file://{tmp_path}/snap", {"volume": "v", "options": "o"}
    S.save_snapshot(inv(spark, [("/a/x", 1)]), where, "/a", "v", "o", 7)
    S.save_snapshot(inv(spark, [("/b/x", 1), ("/b/y", 1)]), where, "/b", "v", "o", 3)
    S.save_snapshot(inv(spark, [("/a/x", 1), ("/a/z", 1)]), where, "/a", "v", "o", 8)
    assert paths(S.load_snapshot(spark, where, expect | {"root": "/a"})[0]) == ["/a/x", "/a/z"]
    assert paths(S.load_snapshot(spark, where, expect | {"root": "/b"})[0]) == ["/b/x", "/b/y"]
    assert S.load_snapshot(spark, where, expect | {"root": "/c"}) == (None, "missing")


def test_ranges_take_a_path_and_what_is_under_it(spark):
    names = ["/", "/a", "/a b", "/a!", "/a-1/x", "/a.b/c", "/a/", "/a/b", "/a/b/c", "/a0", "/ab", "/b", "/a/\U0001F600/z"]
    x = spark.createDataFrame([(n,) for n in names], "path string")
    assert paths(x.filter(T.in_ranges(F.col("path"), ["/a"]))) == sorted(n for n in names if n == "/a" or n.startswith("/a/"))
    assert x.filter(T.in_ranges(F.col("path"), ["/"])).count() == len(names) and x.filter(T.in_ranges(F.col("path"), [])).count() == 0


def random_paths(seed, n, letters="ab-. 0\u00e9"):
    import random

    r = random.Random(seed)
    return ["/" + "/".join("".join(r.choice(letters) for _ in range(r.randint(1, 2))) for _ in range(r.randint(1, 6))) for _ in range(n)]


def plain_above(p):
    return ["/", *("/".join(p.split("/")[:i]) for i in range(2, p.count("/") + 1))] if p != "/" else []


def test_ancestry_by_ranges_equals_plain_sets(spark, monkeypatch):
    """Few and many ranges, paths that sort between a directory and its entries, repeated paths, and the root."""
    for seed, extra in ((1, []), (2, ["/"]), (3, [])):
        names = random_paths(seed, 700) + extra
        names += names[:50]
        x = spark.createDataFrame([(n,) for n in names], "path string").repartition(7)
        chosen = set(names)
        assert paths(T.top_level(x)) == sorted(p for p in chosen if not any(q in chosen for q in plain_above(p)))
        want = sorted((p, max((q for q in plain_above(p) if q in chosen), key=len)) for p in chosen if any(q in chosen for q in plain_above(p)))
        assert sorted(map(tuple, T.nested_pairs(x).collect())) == want and want
        dirty = x.filter(F.pmod(F.xxhash64("path"), F.lit(9)) == 0)
        tops = set(paths(dirty))
        under = lambda p: p in tops or any(q in tops for q in plain_above(p))
        for most in (128, 0):
            monkeypatch.setattr(T, "MOST_RANGES", most)
            assert paths(T.inside(x, dirty)) == sorted(p for p in names if under(p))
            assert paths(T.outside(x, dirty)) == sorted(p for p in names if not under(p))
            assert T.outside(x, dirty.limit(0)).count() == len(names)
        monkeypatch.undo()
    none = x.limit(0)
    assert T.top_level(none).count() == 0 and T.nested_pairs(none).count() == 0


def test_splice_moves_no_untouched_row(spark):
    """With few dirty paths the untouched inventory is a filtered scan: no exchange, no join, no Python."""
    a, b = inv(spark, [(f"/d{i % 9}/f{i}", i) for i in range(90)]), inv(spark, [("/d3/new", 1), ("/d4/other", 2)])
    dirty = spark.createDataFrame([("/d3",)], "path string")
    got = T.splice_subtrees(a, dirty, b)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert paths(got) == sorted([f"/d{i % 9}/f{i}" for i in range(90) if i % 9 != 3] + ["/d3/new"])


def test_splice_reads_only_files_that_the_ranges_meet(spark, tmp_path):
    S.save_snapshot(inv(spark, [(f"/d{i % 40:02d}/f{i}", i) for i in range(4000)]), f"file://{tmp_path}/s", "/", "v", "o", 1, parts=8)
    parts, _ = S.newest_snapshot(spark, f"file://{tmp_path}/s", {"root": "/", "volume": "v", "options": "o"})
    touched, rest = S.touched_parts(parts, ["/d07"])
    assert len(parts) == 8 and 1 <= len(touched) <= 2 and len(touched) + len(rest) == 8
    got = S.read_parts(spark, touched)
    assert got.filter(T.in_ranges(F.col("path"), ["/d07"])).count() == 100
    plan = S.read_parts(spark, parts).filter(T.in_ranges(F.col("path"), ["/d07"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(EqualTo(path,/d07)" in plan.replace("\n", "")
    for top in ("/", "/a", "/d39/f39", "/zz"):  # before the first path, inside the last part, behind the last path
        names = [f"/d{i % 40:02d}/f{i}" for i in range(4000)]
        here = [p for p in names if top == "/" or p == top or p.startswith(top + "/")]
        touched, _ = S.touched_parts(parts, [top])
        assert touched and S.read_parts(spark, touched).filter(T.in_ranges(F.col("path"), [top])).count() == len(here)


def test_preorder_equals_a_plain_walk(spark):
    import random

    files = sorted(set(random_paths(5, 400, "abcdef")))
    files = [f for f in files if not any(g.startswith(f + "/") for g in files)] + [f"/big/{k:04d}" for k in range(600)]
    r = random.Random(1)
    x = inv(spark, [(p, r.randint(0, 3)) for p in files])
    nodes = T.dir_rollup(x).select("path", F.when(F.col("path") == "/", "/").otherwise(P.base_name(F.col("path"))).alias("name"), "size").unionByName(x.select("path", "name", F.col("byte_size").alias("size")))
    below, size = {}, {}
    for row in nodes.collect():
        size[row["path"]] = row["size"]
        if row["path"] != "/":
            below.setdefault(row["path"].rsplit("/", 1)[0] or "/", []).append(row["path"])
    order = []

    def walk(p):
        order.append(p)
        for q in sorted(below.get(p, []), key=lambda q: (-size[q], q.rsplit("/", 1)[1])):
            walk(q)

    walk("/")
    assert [row["path"] for row in T.preorder(nodes.repartition(5)).orderBy("rank").collect()] == order
    assert sorted(row["rank"] for row in T.preorder(nodes).collect()) == list(range(1, len(order) + 1))
    assert T.preorder(nodes.limit(0)).count() == 0


def test_budget_walk_asks_again_behind_what_it_took(spark):
    import random

    r = random.Random(3)
    rows = [(b, n, b * n, b * (n - 1)) for b, n in ((b, r.randint(2, 9)) for b in range(1, 400))]
    groups = spark.createDataFrame(rows, "byte_size bigint, file_count bigint, total_bytes bigint, reclaimable_bytes bigint")
    for byte_limit, file_limit in ((5000, 100), (20_000, 23), (700, 1000), (1, 5)):
        bytes_left, files_left, want = byte_limit, file_limit, []
        for b, n, total, gain in sorted(rows, key=lambda g: (-g[3], -g[0])):
            if total <= bytes_left and n <= files_left:
                want.append(b)
                bytes_left, files_left = bytes_left - total, files_left - n
        for at_once in (1, 3, 1000):
            assert sorted(g["byte_size"] for g in D.budget_groups(groups, byte_limit, file_limit, at_once).collect()) == sorted(want)


def test_differences_settled_by_directory(spark):
    """Equal directories are settled by their digests; repeated rows, nulls that change place, and moved entries are seen."""
    a = inv(spark, [(f"/d{k % 7}/f{k}", k) for k in range(70)] + [("/r/x", 1), ("/r/x", 1)])
    assert I.snapshot_diff(a, a).count() == 0
    b = a.filter("path <> '/d1/f1'").withColumn("byte_size", F.when(F.col("path") == "/d2/f9", 99).otherwise(F.col("byte_size"))).unionByName(inv(spark, [("/d3/new", 1), ("/new/z", 1)]))
    assert sorted(map(tuple, I.snapshot_diff(a, b).collect())) == [("/d1/f1", "removed"), ("/d2/f9", "modified"), ("/d3/new", "added"), ("/new/z", "added")]
    swapped = a.withColumn("device", F.when(F.col("path") == "/d4/f4", "z")).withColumn("kind", F.col("kind"))
    other = a.withColumn("device", F.lit(None).cast("string")).withColumn("kind", F.col("kind"))
    assert [tuple(r) for r in I.snapshot_diff(swapped, other).collect()] == [("/d4/f4", "modified")]
    twice = inv(spark, [("/r/x", 2), ("/r/x", 2)])
    assert {r["change"] for r in I.snapshot_diff(a.filter("path = '/r/x'"), twice).collect()} == {"modified"}


def test_rollup_corrections_equal_a_new_rollup(spark):
    """Subtrees that vanish, appear, empty their parents and change in size, several at once."""
    import random

    r = random.Random(7)
    now = {p: r.randint(1, 9000) for p in random_paths(11, 250, "abc")}
    frame = lambda rows: inv(spark, sorted(rows.items()))
    counted = T.counted_directories(T.directory_sums(frame(now)))
    for step in range(4):
        tops = [p.rsplit("/", 1)[0] or "/a" for p in r.sample(sorted(now), 4)] + ["/fresh"]
        under = lambda p: any(p == t or p.startswith(t + "/") for t in tops)
        gone = {p: s for p, s in now.items() if under(p)}
        come = {p: s + (k % 2) for k, (p, s) in enumerate(sorted(gone.items())) if k % 3} | {f"{tops[0]}/n{step}/m/x": 5, f"/fresh/{step}": 1}
        now = {p: s for p, s in now.items() if not under(p)} | come
        counted = T.corrected(counted, frame(gone), frame(come))
        want = T.counted_directories(T.directory_sums(frame(now)))
        assert sorted(map(tuple, counted.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_refresh_writes_only_touched_parts(spark, tmp_path):
    """The roll-up stays equal to a new one; rows that do not fit the tree give a full listing."""
    base, expect = f"file://{tmp_path}", {"root": "/", "volume": "v", "options": "o"}
    rows = {f"/d{k % 20:02d}/s{k % 3}/f{k}": k + 1 for k in range(1200)}
    S.save_snapshot(inv(spark, sorted(rows.items())), f"{base}/snap", "/", "v", "o", 0, parts=6)
    state = {"rows": rows}

    def step(number, changed, listing):
        log(spark, f"{base}/log", [(number * 10 + k, p, "modify") for k, p in enumerate(changed)])
        live.refresh_snapshot(S.read_changes(spark, f"{base}/log"), listing, f"{base}/snap", expect, f"{base}/cp").awaitTermination(120)
        last = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/snap/results").orderBy(F.desc("batch")).first()
        parts, _ = S.newest_snapshot(spark, f"{base}/snap", expect)
        got = S.load_snapshot(spark, f"{base}/snap", expect)[0]
        assert sorted(map(tuple, got.select("path", "byte_size").collect())) == sorted(state["rows"].items())
        assert sorted(map(tuple, T.displayed(S.load_rollup(spark, f"{base}/snap", expect)).collect())) == sorted(map(tuple, T.dir_rollup(got).collect()))
        return last["result"], last["reason"], [p[2] for p in parts]

    _, _, first = None, None, [p[2] for p in S.newest_snapshot(spark, f"{base}/snap", expect)[0]]
    now = {p: s for p, s in rows.items() if not p.startswith("/d03/s1/")} | {"/d03/s1/new": 7, "/d03/s1/deep/er/x": 8}
    state["rows"] = now
    result, reason, parts = step(1, ["/d03/s1"], inv(spark, sorted(now.items())))
    assert (result, reason) == ("incremental", None) and len(set(parts) - set(first)) <= 2 and len(set(parts) & set(first)) >= 4
    wrong = {p: s for p, s in now.items() if not p.startswith("/d05/s0/")} | {"/d05/s0/f": 1, "/d05/s0/f/below-a-file": 2}
    state["rows"] = wrong
    assert step(2, ["/d05/s0"], inv(spark, sorted(wrong.items())))[:2] == ("full", "inconsistent")


def test_live_lists_equal_the_whole(spark, tmp_path):
    """Folders, old files and largest files after each of three batches, by a query that starts again each time."""
    base, written = f"file://{tmp_path}", []
    rows = [(f"/r/d{k % 11}/s{k % 4}/f{k}", (k * 7919) % 5000) for k in range(600)]
    dated = lambda part: inv(spark, part).withColumn("modified_at", F.when(F.pmod(F.col("byte_size"), F.lit(3)) == 0, F.lit("2001-01-01").cast("timestamp_ntz")))
    for step in range(3):
        part = rows[step::3]
        written += part
        dated(part).write.mode("append").parquet(f"{base}/inv")
        stream = lambda: live.stream_inventory(spark, f"{base}/inv")
        live.live_folders(stream(), f"{base}/folders", f"{base}/c1", k=9).awaitTermination(120)
        live.live_old_files(stream(), f"{base}/old", f"{base}/c2", "2001-12-01", 180, 100, k=9).awaitTermination(120)
        whole = dated(written)
        got = live.live_list(spark, f"{base}/folders").orderBy("rank").collect()
        assert [(r["path"], r["size"]) for r in got] == [(r["path"], r["size"]) for r in R.largest_folders(T.dir_rollup(whole), 9).orderBy("rank").collect()]
        assert all(r["is_partial"] for r in got)
        old = live.live_list(spark, f"{base}/old").orderBy("rank").collect()
        assert [(r["path"], r["size"]) for r in old] == [(r["path"], r["size"]) for r in R.old_large_files(whole, "2001-12-01", 180, 100, 9).orderBy("rank").collect()]
    live.listing_ended(spark, f"{base}/folders")
    assert not any(r["is_partial"] for r in live.live_list(spark, f"{base}/folders").collect())


def plain_ids(names, page, fan):
    import hashlib

    sha = lambda parts: hashlib.sha256("\n".join(parts).encode()).hexdigest()
    level = [sha(names[i:i + page]) for i in range(0, len(names), page)]
    while len(level) > 1:
        level = [sha(level[i:i + fan]) if len(level) > i + 1 else level[i] for i in range(0, len(level), fan)]
    return level[0]


def test_members_of_size_groups_come_in_pages(spark):
    """One size that most files have, over several ranges; digests of pages of pages."""
    rows = [(f"/big/{(k * 7919) % 500:03d}", 8) for k in range(500)] + [(f"/s/{k}", k // 3 + 20) for k in range(60)] + [("/alone", 1)]
    by_size = {}
    for p, n in sorted(rows):
        by_size.setdefault(n, []).append(p)
    by_size = {n: ps for n, ps in by_size.items() if len(ps) > 1}
    pages = D.size_group_pages(inv(spark, rows).repartition(6), page=7)
    got = {(r["byte_size"], r["page"]): r["members"] for r in pages.collect()}
    assert got == {(n, i // 7): ps[i:i + 7] for n, ps in by_size.items() for i in range(0, len(ps), 7)}
    ids = {r["byte_size"]: r["group_id"] for r in D.size_group_ids(pages, fan=3).collect()}
    assert ids == {n: f"{n}-{plain_ids(ps, 7, 3)}" for n, ps in by_size.items()}
    assert D.size_group_ids(D.size_group_pages(inv(spark, rows).limit(0))).count() == 0


def test_members_that_changed_since_leave(spark):
    cols = "path string, byte_size bigint, identity string"
    m = spark.createDataFrame([("/a", 5, "x"), ("/b", 5, "x"), ("/c", 5, "x"), ("/d", 6, "y"), ("/e", 6, "y"), ("/f", 7, "z"), ("/g", 7, "z")], "path string, byte_size bigint, checksum string")
    before = spark.createDataFrame([(p, n, f"i{p}") for p, n in (("/a", 5), ("/b", 5), ("/c", 5), ("/d", 6), ("/e", 6), ("/f", 7))] + [("/g", 7, None)], cols)
    now = spark.createDataFrame([("/a", 5, "i/a"), ("/b", 5, "i/b"), ("/c", 5, "new"), ("/d", 6, "i/d"), ("/e", 9, "i/e"), ("/f", 7, "i/f"), ("/g", 7, None)], cols)
    assert paths(D.still_the_same(m, before, now)) == ["/a", "/b"]
    assert D.still_the_same(m, before, now.limit(0)).count() == 0


def test_layouts_join_and_look_up_without_moving_rows(spark):
    from stocktake.sources.layout import save_bucketed

    x = inv(spark, [(f"/d/{k}", k % 40) for k in range(400)]).withColumn("identity", F.lit("i"))
    cache = x.filter("byte_size < 20").select("path", "byte_size", "modified_at", "identity", F.sha2("path", 256).alias("checksum"))
    files, known = save_bucketed(x, "files_by_path", ["path"], 8), save_bucketed(cache, "cache_by_path", ["path"], 8)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = D.cached_checksums(files, known)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, D.cached_checksums(x, cache).collect())) and got.filter("hit").count() == 200
    contents = save_bucketed(x.select("path", "byte_size", F.encode(F.repeat(F.lit("x"), F.col("byte_size").cast("int")), "UTF-8").alias("content")), "contents_by_size", ["byte_size"], 8)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not name the buckets it reads
    assert "SelectedBucketsCount: 1 out of 8" in contents.filter("byte_size = 7")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert paths(D.verify_size(x, contents, 7)) == paths(x.filter("byte_size = 7")) == paths(D.verify_size(x, contents.drop("byte_size"), 7))
    assert D.verify_size(x, contents, 12345).count() == 0


def test_change_log_goes_on_behind_the_last_id(spark, tmp_path):
    """Restarts, files that are rewritten together, an empty log, and one that no longer reaches back."""
    from stocktake.sources.changelog import follow_changes

    base = tmp_path / "log"
    base.mkdir()

    def write(name, ids, kind="modify"):
        import pyarrow as pa
        import pyarrow.parquet as pq

        pq.write_table(pa.Table.from_pylist([{"event_id": i, "ts": None, "path": f"/p{i}", "change_type": kind} for i in ids], pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("path", pa.string()), ("change_type", pa.string())])), base / name)

    def run(**options):
        got = []

        def take(batch, number):
            got.extend(sorted(map(tuple, batch.select("event_id", "path", "change_type", "lost").collect())))

        q = follow_changes(spark, f"file://{base}", **options).writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
        return got

    assert run() == []
    write("a.parquet", range(1, 6))
    write("b.parquet", range(6, 9))
    got = run()
    assert [r[0] for r in got] == list(range(1, 9)) and not any(r[3] for r in got)
    (base / "a.parquet").unlink()
    write("b.parquet", range(3, 11))  # rewritten, with what was there before
    assert [r[0] for r in run()] == [9, 10]
    (base / "b.parquet").unlink()
    write("c.parquet", range(20, 22))
    assert run() == [(19, "/", "dropped", True), (20, "/p20", "modify", False), (21, "/p21", "modify", False)]
    write("d.parquet", [22], "dropped")
    write("e.parquet", [23], "overflow")
    write("f.parquet", [24], None)
    assert run() == [(22, "/p22", "dropped", True), (23, "/p23", "overflow", True), (24, "/p24", None, False)]


def test_a_lost_range_of_the_log_gives_a_full_listing(spark, tmp_path):
    from stocktake.sources.changelog import follow_changes

    base, expect = f"file://{tmp_path}", {"root": "/", "volume": "v", "options": "o"}
    x = inv(spark, [("/a/x", 1), ("/b/y", 2)])
    S.save_snapshot(x, f"{base}/snap", "/", "v", "o", 5)
    log(spark, f"{base}/log", [(9, "/a/x", "modify")])
    q = live.refresh_snapshot(follow_changes(spark, f"{base}/log", since=5), x, f"{base}/snap", expect, f"{base}/cp")
    q.awaitTermination(120)
    last = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/snap/results").first()
    assert (last["result"], last["reason"]) == ("full", "history")
    log(spark, f"{base}/log", [(10, "/", "root_changed"), (11, "/", "overflow")])
    live.refresh_snapshot(follow_changes(spark, f"{base}/log", since=5), x, f"{base}/snap", expect, f"{base}/cp").awaitTermination(120)
    last = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/snap/results").orderBy(F.desc("batch")).first()
    assert (last["result"], last["reason"]) == ("full", "history_overflow")


def test_dedupe_stream(spark, tmp_path):
    log(spark, f"file://{tmp_path}/log", [(1, "/a", "create"), (2, "/a", "modify"), (3, "/b", "modify")])
    q = (I.dedupe_stream(S.read_changes(spark, f"file://{tmp_path}/log")).select("path").writeStream.format("parquet").option("path", f"file://{tmp_path}/out")
         .option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start())
    q.awaitTermination(60)
    assert paths(spark.read.parquet(f"file://{tmp_path}/out")) == ["/a", "/b"]
