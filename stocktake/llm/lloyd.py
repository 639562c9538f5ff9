"""Centroid clustering by dimension-sharded Lloyd rounds, exact in whole numbers.

Vectors lie in tiles of some hundred rows, and each tile is cut into blocks of columns. A task
holds tiles of one block only and sees that block's slice of the centroids: it sends each tile's
exact partial distances, which are added up over the blocks by tile; the sums' least gives each
vector its centroid. These go back to every block of the tile, and each block's sums give it its
own new slice. The blocks are dealt out once; rounds move distances and centroid numbers only, and
centroids times columns reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stocktake.llm.shared import shuffle_width, written

MOST = (1 << 63) - 1
TILE = 512


def whole(x: np.ndarray, scale: int, safe: int) -> np.ndarray:
    """floor(scale * x), exactly: 64-bit numbers if all are below ``safe``, else Python's."""
    x = np.asarray(x, np.float64)
    y = np.floor(x * scale) if scale & (scale - 1) == 0 and np.abs(x).max(initial=0) < safe / scale else None
    if y is not None:
        return y.astype(np.int64)
    return np.array([math.floor(Fraction(v) * scale) for v in x.ravel().tolist()], object).reshape(x.shape)


def partial_distances(rows: np.ndarray, centroids: np.ndarray, safe: int) -> np.ndarray:
    """centroids x rows: squared distances over these columns, without rounding or overflow."""
    if rows.dtype != object and any(abs(v) >= safe for v in centroids.ravel().tolist()):
        rows = rows.astype(object)
    centroids = centroids.astype(rows.dtype)
    return np.stack([((rows - c) ** 2).sum(axis=1) for c in centroids])


def tiles_of(vectors: DataFrame, width: int, blocks: int) -> DataFrame:
    """(tile, block, ids, data): each tile's columns in blocks, as doubles (or singles where that is the same); identifiers go with block 0."""
    cuts = np.linspace(0, width, blocks + 1).astype(int).tolist()
    kind = vectors.schema["id"].dataType.simpleString()

    def cut(batches):
        first, n = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                x = np.asarray(part.column(1).flatten()).reshape(part.num_rows, width)
                data = [np.ascontiguousarray(x[:, a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
                ids = [part.column(0).to_pylist(), *[None] * (blocks - 1)]
                yield pa.RecordBatch.from_arrays([pa.array([first + n] * blocks, pa.int64()), pa.array(range(blocks), pa.int32()), pa.array(ids, pa.list_(part.column(0).type)), pa.array(data, pa.binary())], names=["tile", "block", "ids", "data"])
                n += 1

    return vectors.mapInArrow(cut, f"tile bigint, block int, ids array<{kind}>, data binary")


def lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, blocks: int = 4, seed: int = 3, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Vectors take part if they have ``width`` components, none null, NaN or infinite; null and empty
    ones do not. Components become floor(scale * x). The first centroids are the k vectors (all, if
    fewer) of smallest sha256 of ``seed:identifier``, a null identifier as an empty one, and of equal
    identifiers by their components. Ties go to the smaller centroid, so repeated rows share one.
    Distances and sums are exact whatever the components; those that exceed 64 bits are reported as
    2^63 - 1. An empty table gives an empty result; names of other columns do not matter.
    """
    spark = vectors.sparkSession
    item = vectors.schema[vector_col].dataType.elementType.simpleString()
    real = F.col("v").isNotNull() & (F.size("v") == width) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taking = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(F.coalesce(real, F.lit(False)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = [r["v"] for r in taking.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()]
    if not start:
        return taking.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    safe = math.isqrt((1 << 62) // width) // 2
    item = np.float32 if item == "float" else np.float64
    cuts = np.linspace(0, width, blocks + 1).astype(int).tolist()
    centroids = whole(np.array(start), scale, safe).astype(object)
    slices = [centroids[:, a:b] for a, b in zip(cuts, cuts[1:])]

    tiles = written(tiles_of(taking, width, blocks), "lloyd-tiles")
    lanes = -(-shuffle_width(spark) // blocks)
    own = lambda key: key[0] * lanes + key[1] % lanes  # noqa: E731  a partition holds one block's tiles
    shards = tiles.select("block", "tile", "data").rdd.map(lambda r: ((r[0], r[1]), bytes(r[2]))).partitionBy(blocks * lanes, own)

    def rows_of(block: int, data: bytes) -> np.ndarray:
        return whole(np.frombuffer(data, item).reshape(-1, cuts[block + 1] - cuts[block]), scale, safe)

    def distances(slices):
        def part(shard):
            (block, tile), data = shard
            return tile, partial_distances(rows_of(block, data), slices[block], safe)

        return shards.map(part).reduceByKey(np.add, lanes * blocks)

    def sums(entry):
        (block, _), found = entry
        data, cluster = sorted(found, key=lambda x: not isinstance(x, bytes))
        rows = rows_of(block, data)
        return block, [(int((cluster == c).sum()), rows[cluster == c].sum(axis=0).astype(object)) for c in range(len(start))]

    def added(a, b):
        return [(m + n, x + y) for (m, x), (n, y) in zip(a, b)]

    for _ in range(rounds):
        nearest = distances(slices).mapValues(lambda d: d.argmin(axis=0).astype(np.int32))
        back = nearest.flatMap(lambda t: [((block, t[0]), t[1]) for block in range(blocks)]).partitionBy(blocks * lanes, own)
        now = slices

        def moved(entry, now=now):
            block, total = entry
            return block, np.array([[int(s) // n for s in x] if n else list(old) for (n, x), old in zip(total, now[block])], object)

        fresh = dict(shards.union(back).groupByKey(blocks * lanes, own).map(sums).reduceByKey(added, blocks).map(moved).collect())
        slices = [fresh[b] for b in range(blocks)]

    def settled(entry):
        tile, d = entry
        cluster, least = d.argmin(axis=0), d.min(axis=0).tolist()
        each = [min(sum(x for x, c in zip(least, cluster.tolist()) if c == own), MOST) for own in range(len(start))]
        return tile, cluster.tolist(), [min(int(x), MOST) for x in least], each

    last = written(spark.createDataFrame(distances(slices).map(settled), "tile bigint, cluster array<int>, distance array<bigint>, each array<bigint>", verifySchema=False), "lloyd-last")
    inertia = {r["cluster"]: int(r["n"]) for r in last.select(F.posexplode("each").alias("cluster", "n")).groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()}
    final = np.concatenate(slices, axis=1)
    about = [(c, min(inertia[c], MOST), min(sum(inertia.values()), MOST), hashlib.sha256(",".join(map(str, final[c])).encode()).hexdigest()) for c in range(len(start))]
    centroid = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")  # k rows
    named = tiles.filter("block = 0").select("tile", "ids").join(last.select("tile", "cluster", "distance").hint("merge"), "tile")
    each = named.select(F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("x")).select(F.col("x.ids").alias(id_col), F.col("x.cluster").alias("cluster"), F.col("x.distance").alias("distance"))
    return each.join(F.broadcast(centroid), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
