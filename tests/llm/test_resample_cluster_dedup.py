"""Importance resampling, Lloyd rounds and exact duplicates against plain versions, on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
import pytest

from stocktake.llm import exact_dedup, lloyd, resampling
from stocktake.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def read(folder, name):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


# importance resampling

def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    found = [plain_features(x) for _, x in docs]
    for _, fs in found:
        s.update(map(bucket, fs))
    for x in target:
        t.update(map(bucket, plain_features(x)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for (doc_id, _), (words, fs) in zip(docs, found):
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    enough = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(enough) // 100
    return [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(enough)] + [(*r[:4], None) for r in rows if r[4] < least]


def test_op11(spark, odd_dir):
    docs = [(d["doc_id"], d["text"]) for d in read(odd_dir, "documents")]
    want = plain_resample(docs, [b["text"] for b in read(odd_dir, "benchmark")])
    got = QUERIES["op11_resampling"](spark, odd_dir)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {k for _, k in got.dtypes} == {"bigint"}
    assert sum(r[4] is not None for r in want) > 5
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_resampling_of_repeated_null_and_very_long_rows(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)] + ["Ünïcode", "日本語", "a'b", "x" * 3000]
    text = lambda n: " ".join(words[k] for k in rng.integers(0, len(words), n))
    docs = [(k, text(int(n))) for k, n in enumerate(rng.integers(0, 60, 300))] + [(7, "same words " * 15)] * 90 + [(None, "no id " * 12)] * 40 + [(None, None), (3, None), (900, text(400_000))]
    target = [None, "", text(300), "same words " * 40]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'clash' AS rank", "'clash' AS score", "1 AS _row", "2 AS bucket", "3 AS n").repartition(5)
    got = resampling.resample(frame, spark.createDataFrame([(x,) for x in target], "text string"), percent=37)
    assert Counter(map(tuple, got.collect())) == Counter(plain_resample(docs, target, percent=37))
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 1 + 37 * sum(len(plain_features(x)[0]) >= 20 for _, x in docs) // 100))


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(k, f"word {k} " * 20) for k in range(60)], "doc_id bigint, text string")
    assert resampling.resample(none, some).count() == 0
    assert Counter(map(tuple, resampling.resample(some, none).collect())) == Counter(plain_resample([(r[0], r[1]) for r in some.collect()], []))


@pytest.mark.parametrize("sizes", [(0, 0), (1, 0), (0, 5), (3, 1), (17, 255), (1000, 70_000)])
def test_crc_of_concatenations(sizes):
    rng = np.random.default_rng(sum(sizes))
    a, b = (rng.integers(0, 256, n, np.uint8).tobytes() for n in sizes)
    one = lambda x: np.array([zlib.crc32(x)], np.uint32)
    assert resampling.crc_joined(one(a), one(b), np.array([len(b)]))[0] == zlib.crc32(a + b)


# Lloyd rounds

def plain_lloyd(rows, k=8, rounds=10, seed=3):
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((distance(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    most = (1 << 63) - 1
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    return [(i, j, min(d, most), min(inertia[j], most), min(sum(inertia.values()), most), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found]


def test_op12(spark, odd_dir):
    want = plain_lloyd([(e["vec_id"], e["embedding"]) for e in read(odd_dir, "embeddings")])
    got = QUERIES["op12_lloyd"](spark, odd_dir)
    assert got.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_lloyd_of_huge_components_and_few_vectors(spark):
    """Components from 1e-300 to 1e300 are whole numbers without rounding; distances beyond 64 bits are reported as the largest number."""
    rng = np.random.default_rng(2)
    vectors = [(k, (rng.normal(size=64) * 10.0 ** e).tolist()) for k, e in enumerate([0, 0, 3, 6, 8, 9, 12, 30, 300, -300, 0, 0, 5])]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").repartition(3)
    for rows in (vectors, vectors[:3], vectors[:1], []):
        part = frame.filter(frame.vec_id < len(rows))
        assert Counter(map(tuple, lloyd.lloyd(part, rounds=3).collect())) == Counter(plain_lloyd(rows, rounds=3))


def test_lloyd_keeps_empty_clusters_and_takes_other_widths(spark):
    rng = np.random.default_rng(4)
    base = [rng.normal(size=64).astype(np.float32).tolist() for _ in range(3)]
    rows = [(k, base[k % 3]) for k in range(1500)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "'x' AS tile", "'y' AS cluster", "'z' AS block").repartition(4)
    want = Counter(plain_lloyd(rows, rounds=2))
    for blocks in (1, 3, 64):
        assert Counter(map(tuple, lloyd.lloyd(frame, rounds=2, blocks=blocks).collect())) == want


# exact duplicates

def plain_groups(docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return {t: (min(g)[3], len(g)) for t, g in groups.items()}


def compare(docs, got):
    """Ids, sizes and digests of every row, and one kept row a group."""
    groups, got = plain_groups(docs), got.collect()
    want, kept = Counter(), Counter()
    for doc_id, text in docs:
        t = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        want[doc_id, *groups[t], hashlib.sha256(t.encode()).hexdigest()] += 1
    for r in got:
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert set(kept.values()) <= {1}


def test_op13(spark, odd_dir):
    got = QUERIES["op13_exact_dedup"](spark, odd_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")]
    compare([(d["doc_id"], d["text"]) for d in read(odd_dir, "documents")], got)


ROWS = [(k, f"text {k % 70} of some\twords") for k in range(200)] + [(500 + k, "one hot text" + " " * (k % 5)) for k in range(3000)] + [(1, None), (2, ""), (3, " \n\x0b"), (None, "null id"), (None, "null id"), (None, "text 3 of some words"), (9, "text 9ofsomewords "), (9, "text 9ofsomewords "), (8, "é" * 400_000), (7, "é " * 400_000)]


def put(folder, rows, name="part-0"):
    folder.mkdir(exist_ok=True)
    kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    t = pa.Table.from_pylist([{"doc_id": i, "text": t} for i, t in rows], schema=kind)
    for clash in ("_metadata", "key", "n", "at", "file", "row", "best", "digest"):
        t = t.append_column(clash, pa.array(["clash"] * len(t), pa.string()))
    pq.write_table(t, folder / f"{name}.parquet")


@pytest.mark.parametrize("digits", [64, 1])
def test_equal_digests_of_unequal_texts_are_told_apart(spark, tmp_path, digits, monkeypatch):
    """With one digit nearly every text shares its digest with others; salted parts and hot groups are met too."""
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 100)
    for k in range(4):
        put(tmp_path / "d", ROWS[k::4], f"part-{k}")
    compare(ROWS, exact_dedup.deduplicate(spark, str(tmp_path / "d"), digits=digits))


def test_state_goes_on_with_later_files(spark, tmp_path):
    """Three runs on one state, two files a batch: what came earlier is remembered, and a better copy takes over."""
    parts = [ROWS[k::6] for k in range(6)]
    for until in (2, 5, 6):
        for k in range(until):
            put(tmp_path / "d", parts[k], f"part-{k}") if not (tmp_path / "d" / f"part-{k}.parquet").exists() else None
        got = exact_dedup.deduplicate(spark, str(tmp_path / "d"), str(tmp_path / "state"), files_per_batch=2)
        compare([r for p in parts[:until] for r in p], got)
    assert len(list((tmp_path / "state" / "commits").glob("[0-9]*"))) == 4


def test_no_documents(spark, tmp_path):
    put(tmp_path / "d", [])
    assert exact_dedup.deduplicate(spark, str(tmp_path / "d")).count() == 0
    put(tmp_path / "e", [(None, None)])
    assert [tuple(r)[:4] for r in exact_dedup.deduplicate(spark, str(tmp_path / "e")).collect()] == [(None, None, 1, True)]


# nearest neighbours of vectors with very many equal scores

def test_ties_of_whole_number_vectors_go_to_the_smallest_ids(spark):
    """Thousands of classes with one score: only the k + 1 of the smallest ids go on, and the result is that of all."""
    from stocktake.llm import ann

    rng = np.random.default_rng(9)
    vectors = [(int(i), x) for i, x in zip(rng.permutation(6000), rng.integers(-1, 2, (6000, 8)).astype(float).tolist())] + [(7000 + k, [1e-200] * 8) for k in range(3)] + [(7010 + k, [1e160] * 8) for k in range(3)]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").repartition(5)
    got = defaultdict(list)
    for r in sorted(ann.nearest(frame, "vec_id % 500 = 0", k=5, tables=1, probes=16).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    live = {i: np.array(v) for i, v in vectors if any(v)}
    ids = np.array(sorted(live))
    m = np.stack([live[i] for i in ids])
    assert len(got) >= 12
    for q, found in got.items():
        s = m @ live[q]
        assert [i for i, _ in found] == [int(i) for i in ids[np.lexsort((ids, -s))] if i != q][:5]


def test_stars_are_dealt_out_with_their_members():
    """A leader that shares keys with all others sends its members to many blobs, each pair once a range and once in all."""
    from stocktake.llm.jaccard_join import _meet, _stars

    n, parts = 5000, 16
    nodes = np.arange(1, n + 1, dtype=np.int64)
    keys = np.tile(np.array([7, 9], np.uint32), n)
    group = pa.table({"p": [0], "nodes": [nodes.tobytes()], "sizes": [np.full(n, 100, np.uint32).tobytes()], "least": [np.arange(n, dtype=np.uint64).tobytes()], "counts": [np.full(n, 2, np.uint32).tobytes()], "keys": [keys.tobytes()], "parts": [parts]})
    met = _meet(group)
    assert len(met) == parts
    pairs = [tuple(r.values()) for q in range(parts) for r in _stars(met.filter(pa.compute.equal(met["q"], q))).to_pylist()]
    assert len(pairs) == len(set(pairs)) == n - 1 and len({s for s, _ in pairs}) == 1
    sizes = [len(_stars(met.filter(pa.compute.equal(met["q"], q)))) for q in range(parts)]
    assert max(sizes) < 3 * n / parts


# texts longer than any chunk

def test_texts_of_megabytes(spark):
    """Two near copies of over a megabyte, a third text of one endless word, and short ones: token ids, packing, links and counts equal plain versions."""
    from tokenizers import Tokenizer

    from stocktake.llm import divergence, jaccard_join, packing, token_files
    from stocktake.llm.textops import CHUNK_BYTES
    from stocktake.llm.tokens import tokenizer_path

    rng = np.random.default_rng(8)
    words = [f"word{k}" for k in range(3000)]
    long = " ".join(words[k] for k in rng.integers(0, 3000, 180_000))
    docs = [(1, long), (2, long[:-2000] + " changed at the end of it"), (3, "x" * (CHUNK_BYTES + 7)), (4, "a short text of some words"), (5, None), (6, " ".join(["again and again we say"] * 30_000))]
    assert all(len(t) > CHUNK_BYTES for i, t in docs if i in (1, 2)) and len(docs[5][1]) > CHUNK_BYTES / 2
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source").repartition(2)

    for file, end in (("byte_bpe_50k.json", 0), ("word_bpe_49k.json", 2)):
        t = Tokenizer.from_file(tokenizer_path(file))
        want = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for i, x in docs}
        if end == 0:
            got = {r["doc_id"]: r for r in token_files.read_token_files(token_files.write_token_files(frame, tokenizer_path(file), spaced=True, end_id=end)).collect()}
            assert {i: (r["n_tokens"], r["ids_crc32"]) for i, r in got.items()} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}
        else:
            pieces = defaultdict(list)
            for r in packing.pack(frame, tokenizer_path(file)).collect():
                pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
                assert r["doc_tokens"] == len(want[r["doc_id"]])
            for i, x in want.items():
                at = 0
                for start, n, crc in sorted(pieces[i]):
                    assert start == at and crc == zlib.crc32(x[start:start + n].tobytes())
                    at += n
                assert at == len(x)

    shingles = lambda x: {tuple(w[k:k + 5]) for w in [x.split()] for k in range(len(w) - 4)}
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_components(frame).collect()}
    assert {i: got[i]["component_id"] for i in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    assert [got[i]["n_shingles"] for i in (1, 2, 6)] == [len(shingles(x)) for i, x in docs if i in (1, 2, 6)]
    counted = {r["doc_id"]: r for r in divergence.judge(frame).collect()}
    for i, x in docs:
        w = (x or "").split()
        windows = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        inside = {j for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1 for j in range(k, k + 5)}
        assert (counted[i]["n_words"], counted[i]["word_chars"], counted[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(inside))


# earlier operators on the given tables

def test_recall_on_the_given_vectors(spark):
    for sf in ("0.001", "0.01"):
        rows = read(f"/root/testdata/sf{sf}", "embeddings")
        m = np.array([r["embedding"] for r in rows], float)
        ids = np.array([r["vec_id"] for r in rows])
        got = defaultdict(set)
        for r in QUERIES["op3_ann"](spark, f"/root/testdata/sf{sf}").collect():
            got[r["query_id"]].add(r["vec_id"])
        asked, hits = np.flatnonzero(ids % 20 == 0), 0
        for q in asked:
            order = ids[np.lexsort((ids, -(m @ m[q])))]
            hits += len(got[ids[q]] & set(order[order != ids[q]][:20].tolist()))
        assert hits / (20 * len(asked)) >= 0.9


def test_mix_equals_a_plain_pareto_sample(spark):
    """The copies of every document follow from its own random number: odds over inclusion odds, smallest first, until the source's words are filled."""
    from stocktake.llm import mixing

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    drawn = [r.asDict() for r in mixing.drawn(docs, 17).collect()]
    size, got = defaultdict(int), Counter((r["doc_id"], r["copies"]) for r in mixing.mix(docs).collect())
    for r in drawn:
        size[r["source"]] += r["size"]
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    capped: set = set()
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in size if s not in capped)
        more = {s for s in size if s not in capped and 3 * size[s] < weight[s] * level}
        if not more:
            break
        capped |= more
    want = Counter()
    for s in size:
        target = 3.0 * size[s] if s in capped else weight[s] * level
        whole = min(math.floor(target / size[s] + 1e-12), 3)
        p, rest = target / size[s] - whole, target - whole * size[s]
        q = lambda r: (r["u"] / (1 - r["u"])) * (1 - p) / p if p > 0 else math.inf
        filled = 0.0
        for r in sorted((r for r in drawn if r["source"] == s), key=lambda r: (q(r), r["size"])):
            takes = p > 0 and rest > 0 and filled + r["size"] / 2 <= rest
            filled = filled + r["size"] if takes else math.inf if r["size"] else filled
            want[r["doc_id"], whole + takes] += 1
    wrong = got - want
    assert sum(wrong.values()) <= len(size) and not {d for d, _ in wrong} - {r["doc_id"] for r in drawn if not r["size"]}
