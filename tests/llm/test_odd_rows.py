"""Repeated rows, empty tables and clashing names, for every query and every stage."""

from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from stocktake.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
CLASH = ["u", "p", "cut", "whole", "q", "bin", "copies", "size", "nth", "same", "part", "row", "d", "t", "key", "node", "star", "label", "k0", "k4", "_m", "_row", "_base", "_generic", "_spans", "_copy", "text_key", "doc", "page_id", "_class", "count"]


def cells(row, drop=()):
    return tuple(str(row[k]) for k in sorted(row) if k not in drop)


@pytest.fixture(scope="module")
def some(tmp_path_factory):
    """(rows of each table, folder with each row once, folder with every third row three times and a null in each column)."""
    tables = {n: pq.read_table(f"{SMALL}/{n}.parquet") for n in ("documents", "pages", "embeddings", "labels")}
    tables["documents"] = pa.concat_tables([tables["documents"].slice(0, 45), pa.Table.from_pylist([{"doc_id": 9000, "text": None, "lang": None, "source": None, "n_chars": None}], tables["documents"].schema)])
    tables["pages"], tables["embeddings"] = tables["pages"].slice(0, 40), tables["embeddings"].slice(0, 60)
    once, often = tmp_path_factory.mktemp("once"), tmp_path_factory.mktemp("often")
    for name, t in tables.items():
        pq.write_table(t, once / f"{name}.parquet")
        pq.write_table(pa.concat_tables([t, t.take(list(range(0, len(t), 3))), t.take(list(range(0, len(t), 3)))]), often / f"{name}.parquet")
    return tables, str(once), str(often)


def times(tables, name, key):
    return {v: 3 if i % 3 == 0 else 1 for i, v in enumerate(tables[name][key].to_pylist())}


@pytest.mark.parametrize("name, table, key, drop", [
    ("op1_secret_scan", "documents", "doc_id", ()), ("op4_jaccard_join", "documents", "doc_id", ()), ("op6_url_filter", "pages", "page_id", ()),
    ("op9_warc", "pages", "page_id", ()), ("op10_quality", "documents", "doc_id", ("kept", "char_distance", "word_distance")),
    ("op2_token_ids", "documents", "doc_id", ("start",)), ("op7_packing", "documents", "doc_id", ("sequence_id", "offset"))])
def test_repeated_rows_give_repeated_results(spark, some, name, table, key, drop):
    tables, once, often = some
    n = times(tables, table, key)
    want = Counter()
    for r in QUERIES[name](spark, once).collect():
        want[cells(r.asDict(), drop)] += n[r[key]]
    assert Counter(cells(r.asDict(), drop) for r in QUERIES[name](spark, often).collect()) == want


def test_repeated_vectors_count_once(spark, some):
    _, once, often = some
    assert Counter(QUERIES["op3_ann"](spark, often).collect()) == Counter(QUERIES["op3_ann"](spark, once).collect())


def test_equal_documents_have_equal_severity(spark, some):
    tables, _, often = some
    n = times(tables, "documents", "doc_id")
    got = Counter(map(tuple, QUERIES["op8_toxicity"](spark, often).collect()))
    assert {r[0]: k for r, k in got.items()} == n and len(got) == len(n)


def test_rows_repeated_very_often_are_mixed_one_by_one(spark):
    """One row makes up most of a source, so the target falls among its copies."""
    from stocktake.llm import mixing

    rows = [(7, "one two three", "a")] * 400 + [(k, "w " * (k % 9), "a") for k in range(100, 140)] + [(k, "w " * 50, f"b{k % 3}") for k in range(200, 230)] + [(None, None, None)] * 3
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    first = [r.asDict() for r in mixing.mix(frame).collect()]
    assert len(first) == len(rows)
    assert Counter(map(cells, first)) == Counter(cells(r.asDict()) for r in mixing.mix(frame.repartition(5)).collect())
    own = [r for r in first if r["doc_id"] is not None and r["doc_id"] < 200]
    assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 9
    assert len({r["copies"] for r in own if r["doc_id"] == 7}) == 2
    assert mixing.mixed(frame).count() == sum(r["copies"] for r in first)


def test_many_sources_are_joined_by_salted_keys(spark, monkeypatch):
    from stocktake.llm import mixing

    frame = spark.createDataFrame([(k, "w " * (k % 13), None if k % 17 == 0 else f"s{k % 16}") for k in range(400)], "doc_id bigint, text string, source string")
    few = Counter(mixing.mix(frame).collect())
    monkeypatch.setattr(mixing, "FEW", 3)
    assert Counter(mixing.mix(frame).collect()) == few


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_with_repeated_rows_and_clashing_names(spark, some, name, stage):
    tables, once, often = some
    plain = spark.read.parquet(f"{often}/documents.parquet")
    wide = plain.selectExpr("*", *[f"'x{i}' AS {c}" for i, c in enumerate(CLASH)])
    got = stage(spark, wide, often)
    names = [c for c in got.columns if c not in CLASH] if name != "packing" else [c for c in got.columns if c not in ("sequence_id", "offset")]
    want = stage(spark, plain, often).select(*names)
    if name != "packing":
        assert got.columns == wide.columns
        assert all(r[c] == f"x{i}" for r in got.collect() for i, c in enumerate(CLASH))
    assert Counter(got.select(*names).collect()) == Counter(want.collect())
    if name.startswith("n-gram"):
        kept = Counter(r["doc_id"] for r in want.collect())
        assert {d: n for d, n in kept.items() if n > 1} in ({}, {9000: kept[9000]})  # no words: links with nothing


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_an_empty_table(spark, empty_dir, name, stage):
    assert stage(spark, spark.read.parquet(f"{empty_dir}/documents.parquet"), empty_dir).count() == 0


def test_pipeline_of_an_empty_table(spark, empty_dir):
    assert QUERIES["pipeline"](spark, empty_dir).count() == 0


def test_near_duplicates_by_row(spark):
    """One doc_id with two texts, and texts that only rows without an id hold, between two others."""
    from stocktake.llm.jaccard_join import jaccard_components, keep_first

    words = [f"w{k}" for k in range(200)]
    step = lambda k: " ".join(words[:120 - k] + [f"x{i}" for i in range(k)])
    docs = spark.createDataFrame([(7, step(0)), (9, step(0)), (7, "other text of some words that are alone here " * 2), (3, "other text of some words that are alone here " * 2),
                                  (20, step(0) + " a"), (None, step(14)), (30, step(26)), (None, "x y"), (None, "x y"), (40, ""), (40, ""), (None, None)], "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard_components(docs).collect())
    assert got == Counter([(7, 7), (9, 7), (7, 3), (3, 3), (20, 7), (None, 7), (30, 7), (None, None), (None, None), (40, 40), (40, 40), (None, None)])
    kept = Counter((r["doc_id"], (r["text"] or "")[:5]) for r in keep_first(docs).collect())
    assert kept == Counter([(7, "w0 w1"), (3, "other"), (None, "x y"), (40, ""), (40, ""), (None, "")])
