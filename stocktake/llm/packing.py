"""Packing documents into training sequences by cutting-stock column generation.

Documents longer than a sequence give full pieces; what remains is a piece of its own. Remaining
lengths are counted in classes of UNIT tokens; that histogram (at most ``length / UNIT`` rows) is
all the driver sees. A linear program over patterns (how many pieces of each class share one
sequence) is solved by column generation: the current patterns' dual prices go to an unbounded
knapsack, whose best pattern enters the basis until Farley's bound says that none is worth it.
Pattern counts are rounded down and what is left is placed first fit, largest first. Pieces are
then ranked within their class by a distributed count, and the rank picks pattern, sequence and slot.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stocktake.llm.shared import written
from stocktake.llm.textops import release
from stocktake.llm.tokens import CACHE, encoder

LENGTH = 4096
UNIT = 32
#: Sub-ranks: a class is ranked in so many parts.
PARTS = 256
#: The linear program is solved to within this share of its bound, or until 100 patterns gain less than it; SMOOTH: how near the best prices stay while patterns are sought.
GAP, SMOOTH = 2e-3, 0.8


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of items within the capacity, by dynamic programming over it."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        k = int(np.searchsorted(sizes, room, side="right"))
        best[room] = best[room - 1]
        if k:
            value = prices[:k] + best[room - sizes[:k]]
            top = int(value.argmax())
            if value[top] > best[room] + 1e-12:
                best[room], choice[room] = value[top], top
    pattern = np.zeros(len(sizes), np.int64)
    room = capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row exchanges. (A basis is small; threaded BLAS has been seen to hang beside a live session.)"""
    m = len(matrix)
    both = np.concatenate([matrix, np.eye(m)], axis=1)
    for k in range(m):
        top = k + int(np.abs(both[k:, k]).argmax())
        both[[k, top]] = both[[top, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, m:]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", a, b)


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and their fractional use for the fewest sequences."""
    m = len(sizes)
    demand = demand + 1e-3 * np.random.default_rng(0).random(m)  # no ties, so that no step leaves everything as it was
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    use = _times(inverse, demand)
    centre = sizes / capacity  # the best feasible prices so far; those of a packing without waste to begin with
    bound = float((centre * demand).sum())
    near, before = SMOOTH, np.inf
    for step in range(40 * m + 200):
        if use.sum() <= bound * (1 + GAP):
            break
        if step % 100 == 0:
            if use.sum() > before * (1 - GAP):
                break
            before = use.sum()
        dual = inverse.sum(axis=0)
        prices = np.maximum(dual, 0)
        for smooth in (near, 0.0):  # prices near the centre give better patterns; the basis' own prices decide
            asked = smooth * centre + (1 - smooth) * prices
            value, pattern = knapsack(sizes, asked, capacity)
            farley = float((asked * demand).sum()) / value
            if farley > bound:  # Farley's bound
                bound, centre = farley, asked / value
            if (dual * pattern).sum() > 1 + 1e-9:
                near = SMOOTH if smooth else near / 2
                break
        else:
            break
        direction = _times(inverse, pattern.astype(float))
        able = direction > 1e-9
        ratio = np.where(able, use / np.where(able, direction, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        use = np.maximum(use - ratio[out] * direction, 0)
        use[out] = ratio[out]
        if step % 64 == 63:
            inverse = inverted(basis)
            use = np.maximum(_times(inverse, demand), 0)
    return basis.astype(np.int64), use


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pieces of each class in a sequence, number of such sequences)] that hold the histogram exactly."""
    left = {k: n for k, n in sorted(histogram.items()) if n > 0}
    out: list[tuple[dict[int, int], int]] = []
    if left:
        sizes, demand = np.array(list(left)), np.array(list(left.values()), float)
        columns, use = column_generation(sizes, demand, capacity)
        for j in np.argsort(-use, kind="stable").tolist():
            made = {int(sizes[i]): int(columns[i, j]) for i in np.flatnonzero(columns[:, j])}
            times = min([int(use[j] + 1e-9), *(left[k] // n for k, n in made.items())])
            if times > 0:
                out.append((made, times))
                for k, n in made.items():
                    left[k] -= n * times
    bins: list[tuple[int, dict[int, int]]] = []  # what rounding leaves: fewer pieces than the square of the classes
    for k in sorted(left, reverse=True):
        for _ in range(left[k]):
            for i, (room, made) in enumerate(bins):
                if room >= k:
                    bins[i] = (room - k, made | {k: made.get(k, 0) + 1})
                    break
            else:
                bins.append((capacity - k, {k: 1}))
    return out + [(made, 1) for _, made in bins]


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces_of(docs: DataFrame, path: str, spaced: bool, end_id: int | None, length: int = LENGTH, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """Pieces of at most ``length`` ids: full ones from the start of each document, then the rest; ids are binary, little-endian unsigned 32-bit."""
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def cut(batches):
        enc = encoder(path, spaced, cache)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py() or "") + end
                for at in range(0, len(ids), 4 * length):
                    part = ids[at:at + 4 * length]
                    rows.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, *([part] * with_ids)))
                if len(rows) >= (200 if with_ids else 20_000):
                    yield _batch(rows, with_ids)
                    rows = []
            yield _batch(rows, with_ids)
            release()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def _batch(rows, with_ids):
    kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][:len(kinds)]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)


def assign(pieces: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """``pieces`` (a written table with doc_id, start, length) with sequence_id and offset."""
    spark = pieces.sparkSession
    capacity = length // unit
    classed = pieces.withColumn("_class", F.ceil(F.col("length") / unit).cast("int")).withColumn("_part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(PARTS)).cast("int"))
    counts = written(classed.groupBy("_class", "_part").agg(F.count("*").alias("n")), "pack-counts")  # at most capacity * PARTS rows
    histogram = {r["_class"]: r["n"] for r in counts.groupBy("_class").agg(F.sum("n").alias("n")).collect()}
    runs, taken, sequence = [], {}, 0
    for made, times in patterns(histogram, capacity):
        slot = 0
        for k, each in sorted(made.items(), reverse=True):
            lo = taken.get(k, 0)
            taken[k] = lo + each * times
            runs.append((k, lo, taken[k], sequence, each, slot))
            slot += each
        sequence += times
    by_class = spark.createDataFrame(runs, "_class int, lo bigint, hi bigint, first bigint, each bigint, slot bigint").groupBy("_class").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "first", "each", "slot"))).alias("_runs"))
    base = counts.select("_class", "_part", (F.sum("n").over(Window.partitionBy("_class").orderBy("_part")) - F.col("n")).alias("_base"))
    ranked = classed.withColumn("_rank", F.row_number().over(Window.partitionBy("_class", "_part").orderBy(F.desc("length"), "doc_id", "start")) - 1)
    # both right sides have at most capacity * PARTS rows, whatever the input
    placed = (ranked.join(F.broadcast(base), ["_class", "_part"]).join(F.broadcast(by_class), "_class")
              .withColumn("_rank", F.col("_rank") + F.col("_base"))
              .withColumn("_run", F.expr("filter(_runs, r -> r.lo <= _rank AND _rank < r.hi)[0]"))
              .withColumn("sequence_id", F.expr("_run.first + (_rank - _run.lo) div _run.each"))
              .withColumn("_slot", F.expr("_run.slot + (_rank - _run.lo) % _run.each")))
    within = Window.partitionBy("sequence_id").orderBy("_slot")
    return placed.withColumn("offset", F.sum("length").over(within) - F.col("length")).select(*pieces.columns, "sequence_id", "offset")


def pack(docs: DataFrame, path: str, spaced: bool = False, end_id: int | None = 2, length: int = LENGTH, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """Pieces of all documents with their place: PIECES, sequence_id, offset.

    A null or empty text has its end id only (without an end id, no piece); null doc_ids stay
    null; repeated rows are packed as often as they occur; an empty table gives an empty result;
    columns other than doc_id and text are ignored. cache: pieces of text that a worker remembers, for speed against memory. padded_length(used) gives a sequence's length.
    """
    return assign(written(pieces_of(docs, path, spaced, end_id, length, with_ids, cache), "pieces"), length)


def padded_length(used: int, length: int = LENGTH) -> int:
    """Sequences are padded to ``length`` unless what they hold is a power of two."""
    return used if used & (used - 1) == 0 else length
