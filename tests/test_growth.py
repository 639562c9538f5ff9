"""What a step costs a row: plans and results of queries that failed on larger tables."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from stocktake.functions import paths as P
from stocktake.operators import filters as FL, ranking as R


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


def entries(spark, rows):
    """rows: (path, kind, size)."""
    x = spark.createDataFrame(rows, "path string, kind string, size bigint")
    return x.withColumn("name", P.base_name(F.col("path"))).withColumn("parent_path", P.parent_path(F.col("path")))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["filter_excluded", "filter_types", "filtered_categories", "confidence_rank", "filter_candidates", "item_query", "scan_summary"])
def test_filters_do_not_take_paths_apart(spark, name):
    """What a filter asks for is derived once a row or once a group before it, not once for each time that it is named."""
    from stocktake.plans.queries import QUERIES

    filters = [line for line in plan_of(QUERIES[name](spark, "/root/testdata/sf0.001")).splitlines() if "Filter" in line]
    assert not [line for line in filters if "regexp_replace" in line or line.count("regexp_extract") > 1 and name != "item_query"], name


@pytest.mark.parametrize("name", ["item_query", "filter_file_type"])
def test_type_filter_takes_a_name_apart_once(spark, name):
    from stocktake.plans.queries import QUERIES

    assert sum(line.count("regexp_extract(") for line in plan_of(QUERIES[name](spark, "/root/testdata/sf0.001")).splitlines() if "Filter" in line) == 1


def test_type_filter_of_odd_names(spark):
    """The filter keeps what the extension says, also where its quick look at the name finds the letters elsewhere."""
    names = ["a.pdf", "A.PDF", "a.pdf ", "a. pDf", "a.pdf.gz", "pdf", ".pdf", "..pdf", "a.pdfx", "pdf.txt", "a.p.df", "a.", "", None, "a\n.pdf", "a.pdf\n", "\u03a3.Pdf", "\u0130.PDF", "a.\u212aey", "x.\u039f\u03a3", "x.\u00c4", "a.x y", "a. "]
    x = spark.createDataFrame([(i, n, "folder" if i == 1 else "file") for i, n in enumerate(names)], "i int, name string, kind string")
    known = x.withColumn("ext", P.file_extension(F.col("name"))).filter("kind = 'file'").collect()
    for wanted in ("pdf", ".PDF", "gz", "key", "\u03bf\u03c2", "\u03bf\u03c3", "\u00e4", "x y", "", "."):
        plain = wanted.lower().lstrip(".") or None
        got = {r["i"] for r in FL.filter_file_type(x, wanted).collect()}
        assert got == {r["i"] for r in known if r["ext"] == plain}, wanted
    assert {r["name"] for r in FL.filter_file_type(x, "pdf").collect()} >= {"a.pdf", "a.pdf ", "a. pDf", "..pdf"}


def test_directories_of_lineitem_are_derived_once_a_supplier(spark):
    from stocktake.plans import queries as Q

    plan = plan_of(Q.items(spark, "/root/testdata/sf0.001").select("path", "name", "parent_path", "depth"))
    rows = plan[:plan.index("Join")]
    assert "regexp" not in rows and "split(" not in rows
    got = Q.items(spark, "/root/testdata/sf0.001")
    assert got.filter(~P.base_name(F.col("path")).eqNullSafe(F.col("name")) | ~P.parent_path(F.col("path")).eqNullSafe(F.col("parent_path")) | ~P.depth(F.col("path")).eqNullSafe(F.col("depth"))).count() == 0


def test_inventory_of_rows_without_part(spark):
    from stocktake.sources.adapters import inv_lineitem

    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for n in ("region", "nation", "supplier"):
        os.symlink(f"/root/testdata/sf0.001/{n}.parquet", f"{d}/{n}.parquet")
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(3)
    rows.withColumn("l_partkey", F.when(F.monotonically_increasing_id() > 0, F.col("l_partkey"))).write.parquet(f"{d}/lineitem.parquet")
    got = inv_lineitem(spark, d).select("path", "name", "parent_path", "depth").collect()
    assert len(got) == 3 and all(r["path"] == f"{r['parent_path']}/{r['name']}" and r["depth"] == r["path"].count("/") for r in got)
    assert {r["depth"] for r in got} == {5}


def test_whole_orders_move_rows_once(spark):
    x = spark.createDataFrame([(f"/d{i % 7}/f{i}",) for i in range(500)], "path string")
    got = R.ranked_whole(x, F.asc("path"))
    assert [r["path"] for r in got.orderBy("rank").collect()] == sorted(f"/d{i % 7}/f{i}" for i in range(500)) and {r["rank"] for r in got.collect()} == set(range(1, 501))
    assert "Window" not in plan_of(got) and "hashpartitioning" not in plan_of(got)
    assert "natural" not in R.sort_items(x.withColumn("modified_at", F.lit(None).cast("timestamp_ntz")), "newest", None).columns


def test_redacted_tree_joins_few_numbers(spark):
    x = entries(spark, [(f"/d{i % 7}/f{i}.txt", "file", 1) for i in range(50)] * 2)
    got = R.redact_tree(x)
    order = {p: n + 1 for n, p in enumerate(sorted({"/d%d" % i for i in range(7)} | {f"/d{i % 7}/f{i}.txt" for i in range(50)}))}
    want = sorted((f"/d{i % 7}/f{i}.txt", f"File {order[f'/d{i % 7}/f{i}.txt']}.txt", f"…/Folder {order[f'/d{i % 7}']}/File {order[f'/d{i % 7}/f{i}.txt']}.txt") for i in range(50))
    assert sorted(map(tuple, got.collect())) == sorted(want * 2) and "SortMergeJoin" not in plan_of(got)


def test_many_requested_paths_move_present_ones_once(spark, monkeypatch):
    from stocktake.operators import joins
    from stocktake.plans.queries import QUERIES

    want = paths(QUERIES["missing_targets"](spark, "/root/testdata/sf0.001"))
    verdict = QUERIES["batch_preflight"](spark, "/root/testdata/sf0.001").first()
    monkeypatch.setattr(joins, "FEW_ROWS", 0)
    got = QUERIES["missing_targets"](spark, "/root/testdata/sf0.001")
    assert plan_of(got).count("lineitem.parquet") == 1 and paths(got) == want and want
    assert QUERIES["batch_preflight"](spark, "/root/testdata/sf0.001").first() == verdict


def test_snapshots_and_whole_tree_are_not_written_out_or_sorted(spark):
    from stocktake.plans import queries as Q

    assert all("lineitem.parquet" in plan_of(s) for s in Q.snapshots(spark, "/root/testdata/sf0.001"))
    assert "SortAggregate" not in plan_of(Q.whole_tree(spark, "/root/testdata/sf0.001"))
