"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash turns a unit vector by three rounds of random signs and a fast Hadamard transform
and takes the signed axis it is nearest to. Every vector is in one bucket of each table; a query
looks into the buckets of its ``probes`` largest signed coordinates. All candidates are ranked by
their inner product with the query in double precision on the original vectors.

Equal vectors are one class: only a class is hashed and compared, and its smallest ids stand for
it, so a vector that fills the table costs no more than any other. Buckets are dealt out in
blocks of BLOCK classes by BLOCK queries. Tables and probes follow from the dimension and the number
of classes: the fewest meetings with which a model of vectors without any clusters expects a recall
of RECALL. Such neighbours are the farther the wider the vectors, so that in many dimensions a
query has to meet nearly all classes; clustered data does better than the model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stocktake.llm.shared import written

BLOCK = 4096
#: Recall that the model is to expect; what is asked for is 0.9, and the model is a little too hopeful. Where the tables and probes of LEAST promise more, as much as they do.
RECALL, LEAST = 0.95, (8, 12)
#: Numbers of tables to choose from; neighbours that the model draws for each rank.
TABLES, DRAWS = (1, 2, 4, 8), 100


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Walsh-Hadamard transform of each row (a power of two wide)."""
    n, width, step = len(x), x.shape[1], 1
    while step < width:
        pairs = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def signed_axes(vectors: np.ndarray, table: int, seed: int) -> np.ndarray:
    """rows x 2 d: the pseudo-rotated unit vectors' coordinates and their negatives; bucket 2 i is axis i, 2 i + 1 its opposite."""
    width = 1 << max(0, int(vectors.shape[1] - 1).bit_length())
    x = np.zeros((len(vectors), width))
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares of very small or large components neither vanish nor overflow
    x[:, :vectors.shape[1]] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = hadamard(x * s)
    out = np.empty((len(x), 2 * width))
    out[:, 0::2], out[:, 1::2] = x, -x
    return out


def reach(dim: int, n: int, k: int, seed: int = 0) -> tuple[int, int]:
    """(tables, probes) for a recall of RECALL, or that of LEAST, among n unclustered classes; the fewest probes over all tables."""
    width = 1 << max(0, int(dim - 1).bit_length())
    if n <= k + 1:
        return 1, 2 * width
    t = np.linspace(-1, 1, 200_001)[1:-1]
    share = np.cumsum((1 - t * t) ** ((dim - 3) / 2))
    cosine = np.repeat(np.interp(1 - (np.arange(k) + 0.5) / (n - 1), share / share[-1], t), DRAWS)
    rng, place, places = np.random.default_rng(seed), np.full(k * DRAWS, 2 * width), {}
    for table in range(1, TABLES[-1] + 1):
        for lo in range(0, len(cosine), 256):  # place: of the neighbour's axis among the query's, in the table where it comes first
            c = cosine[lo:lo + 256, None]
            x = rng.standard_normal((len(c), width))
            y = c * x + np.sqrt(1 - c * c) * rng.standard_normal(x.shape)
            axis = np.argmax(np.abs(y), axis=1)[:, None]
            own = np.take_along_axis(x, axis, 1) * np.sign(np.take_along_axis(y, axis, 1))
            place[lo:lo + 256] = np.minimum(place[lo:lo + 256], (x > own).sum(axis=1) + (-x > own).sum(axis=1))
        places[table] = np.sort(place)
    target = max(int(np.ceil(RECALL * len(place))), int((places[LEAST[0]] < LEAST[1]).sum()))
    return min(((table, int(places[table][target - 1]) + 1) for table in TABLES), key=lambda x: (x[0] * x[1], x[0]))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, is_query, k: int = 20, tables: int | None = None, probes: int | None = None, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, nearest first, ties to smaller ids.

    is_query: a condition on ``vec_id``. tables and probes: ``reach`` unless both are given. A row whose id or vector is null, or whose vector is empty,
    zero or holds nulls or non-finite numbers, takes no part; vectors of different lengths do not
    meet; rows equal in id and vector count once; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(
        "vec_id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    smallest = Window.partitionBy("v").orderBy("vec_id")
    kept = good.withColumn("r", F.dense_rank().over(smallest)).filter(F.col("r") <= k + 1)
    classes = written(kept.groupBy("v").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids")).withColumn("cid", F.xxhash64("v")).withColumn("first", F.col("ids")[0]), "ann-classes")
    asked = written(good.filter(is_query).select("vec_id", F.xxhash64("v").alias("cid")).distinct(), "ann-queries")
    found = []
    for dim, n in sorted(tuple(r) for r in classes.groupBy(F.size("v")).count().collect()):
        own_tables, own_probes = (tables, probes) if tables and probes else reach(dim, n, k)
        own = classes.filter(F.size("v") == dim).select("cid", "v", "first")
        queries = own.join(asked.select("cid").distinct().hint("merge"), "cid", "left_semi")
        found.append(_meet(own, queries, dim, k, own_tables, own_probes, seed))
    empty = spark.createDataFrame([], MET)
    met = written(_union([empty, *found]), "ann-met").groupBy("qid", "cid").agg(F.max("score").alias("score"), F.min("first").alias("first"))
    # of classes with equal scores those of the smallest first ids hold the k + 1 smallest ids
    top = met.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "first"))).filter(F.col("r") <= k + 1).drop("r")
    rows = top.join(classes.select("cid", "ids").hint("merge"), "cid").select("qid", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    lists = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).groupBy(F.col("qid").alias("cid")).agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("near"))
    return (asked.join(lists.hint("merge"), "cid").select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("vec_id")), 1, k)).alias("p", "n"))
            .select("query_id", (F.col("p") + 1).alias("rank"), F.col("n.id").alias("vec_id"), F.col("n.score").alias("score")))


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


MET = "qid bigint, cid bigint, score double, first bigint"


def _meet(classes: DataFrame, queries: DataFrame, dim: int, k: int, tables: int, probes: int, seed: int) -> DataFrame:
    """(qid, cid, score, first): the k + 1 best of every block in which queries and classes meet, by score and then by a class's first id."""
    width = 2 << max(0, int(dim - 1).bit_length())
    probes = min(probes, width)

    def axes(most):
        def run(batches):
            for batch in batches:
                v = _matrix(batch.column(1), dim)
                for t in range(tables):
                    near = np.argsort(-signed_axes(v, t, seed), axis=1, kind="stable")[:, :most]
                    yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), most)), pa.array((near + t * width).ravel().astype(np.int32))], names=["cid", "bucket"])
        return run

    def sizes(frame, most):  # at most tables * width rows
        rows = frame.mapInArrow(axes(most), "cid bigint, bucket int").groupBy("bucket").count().collect()
        out = np.ones(tables * width, np.int64)
        for bucket, n in rows:
            out[bucket] = -(-n // BLOCK)
        return out

    class_blocks, query_blocks = sizes(classes, 1), sizes(queries, probes)

    def deal(most, own_blocks, other_blocks, query):
        def run(batches):
            for batch in batches:
                v = _matrix(batch.column(1), dim)
                cid = batch.column(0).to_numpy()
                for t in range(tables):
                    near = np.argsort(-signed_axes(v, t, seed), axis=1, kind="stable")[:, :most] + t * width
                    row = np.repeat(np.arange(len(v)), most)
                    bucket = near.ravel()
                    mine = (cid[row].view(np.uint64) >> np.uint64(20)).astype(np.int64) % own_blocks[bucket]
                    times = other_blocks[bucket]
                    other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    row, bucket, mine = np.repeat(row, times), np.repeat(bucket, times), np.repeat(mine, times)
                    q, c = (mine, other) if query else (other, mine)
                    yield pa.record_batch([pa.array(bucket.astype(np.int32)), pa.array(q.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(cid[row]), batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row))], names=["bucket", "q", "c", "cid", "v", "first"])
        return run

    shape = "bucket int, q int, c int, cid bigint, v array<double>, first bigint"
    left = queries.mapInArrow(deal(probes, query_blocks, class_blocks, True), shape)
    right = classes.mapInArrow(deal(1, class_blocks, query_blocks, False), shape)

    def best(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not asked.num_rows or not there.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "first": pa.array([], pa.int64())})
        qid, cid, first = asked["cid"].to_numpy(), there["cid"].to_numpy(), there["first"].to_numpy()
        a, b = _matrix(asked["v"].combine_chunks(), dim), _matrix(there["v"].combine_chunks(), dim)
        rows, cols, scores = [], [], []
        for lo in range(0, len(a), 512):
            s = a[lo:lo + 512] @ b.T
            if s.shape[1] > k + 1:
                floor = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1]
                r, c = np.nonzero(s >= floor[:, None])  # all that tie with the last one too
                order = np.lexsort((first[c], -s[r, c], r))
                r, c = r[order], c[order]
                nth = np.arange(len(r)) - np.searchsorted(r, r)
                r, c = r[nth <= k], c[nth <= k]
            else:
                r, c = np.nonzero(np.ones(s.shape, bool))
            rows.append(qid[lo + r]), cols.append(c), scores.append(s[r, c])
        cols = np.concatenate(cols)
        return pa.table({"qid": np.concatenate(rows), "cid": cid[cols], "score": np.concatenate(scores), "first": first[cols]})

    keys = ("bucket", "q", "c")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, MET)
