"""Importance resampling towards a target distribution by hashed n-gram features.

Words are found and numbered by Arrow kernels (ascii_lower, split_pattern_regex, list_flatten,
dictionary_encode). Shifted numbers form n-grams: a pair is (first, second), a triple is (pair,
third), and so on, each distinct one numbered in turn. Only distinct n-grams are hashed: the CRC of
a word's bytes is computed once, that of a longer n-gram is combined from the CRCs of its parts
(appending n bytes is a linear map of the CRC's bits), so no joined string is ever made.

Bucket counts of the corpus and of the target give each bucket a gain; a document's weight is the
sum of gains over its features, and the highest sums of weight and Gumbel noise are drawn.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from stocktake.llm.shared import shuffle_width, written
from stocktake.llm.textops import chunks

#: Fixed pattern of what lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42


def _apply(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by the images of the single bits."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where(x >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
    return out


@lru_cache(maxsize=1)
def _one_byte() -> np.ndarray:
    """What appending a zero byte does to each bit of a CRC."""
    x = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & np.uint32(1), (x >> np.uint32(1)) ^ np.uint32(0xEDB88320), x >> np.uint32(1))
    return x


@lru_cache(maxsize=1024)
def _appending(n: int) -> np.ndarray:
    """What appending n zero bytes does to a CRC, as a table for each of its four bytes."""
    columns, power = np.uint32(1) << np.arange(32, dtype=np.uint32), _one_byte()
    while n:
        if n & 1:
            columns = _apply(power, columns)
        power, n = _apply(power, power), n >> 1
    byte = np.arange(256, dtype=np.uint32)
    return np.stack([_apply(columns, byte << np.uint32(8 * k)) for k in range(4)])


def crc_joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs of concatenations, from those of both parts and the second parts' sizes in bytes."""
    sizes, which = np.unique(size, return_inverse=True)
    if not len(sizes):
        return np.zeros(0, np.uint32)
    tables = np.stack([_appending(int(n)) for n in sizes])
    out = second.copy()
    for k in range(4):
        out ^= tables[which, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
    return out


class Grams:
    """The n-grams of a chunk of documents: for each length the bucket of each distinct one, which one stands at each place, and where each document's begin."""

    def __init__(self, column: pa.Array, longest: int, buckets: int):
        lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(column, "")), BETWEEN)
        words, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
        real = pc.not_equal(words, pa.scalar("", words.type))
        coded = words.filter(real).dictionary_encode()
        doc = doc.filter(real).to_numpy().astype(np.int64)
        word = coded.indices.to_numpy().astype(np.int64)
        distinct = [w.encode() for w in coded.dictionary.to_pylist()]
        crc = np.array([zlib.crc32(w) for w in distinct], np.uint32)
        size = np.array([len(w) for w in distinct], np.int64) + 1
        spaced = crc_joined(np.full(len(crc), zlib.crc32(b" "), np.uint32), crc, size - 1)
        self.n_words = np.bincount(doc, minlength=len(column))
        self.lengths = [(crc % np.uint32(buckets), word, np.concatenate([[0], np.cumsum(self.n_words)]))]
        head, head_crc = word, crc
        for n in range(2, longest + 1):
            inside = doc[n - 1:] == doc[:len(doc) - n + 1]
            pair = head[:len(inside)] * len(crc) + word[n - 1:]
            codes, which = np.unique(pair[inside], return_inverse=True)
            last = codes % max(len(crc), 1)
            head_crc = crc_joined(head_crc[codes // max(len(crc), 1)], spaced[last], size[last])
            head = np.zeros(len(inside), np.int64)
            head[inside] = which
            self.lengths.append((head_crc % np.uint32(buckets), which, np.concatenate([[0], np.cumsum(np.maximum(self.n_words - n + 1, 0))])))
        self.n_features = sum(np.diff(at) for _, _, at in self.lengths)

    def counts(self, buckets: int) -> np.ndarray:
        """Features in each bucket."""
        return sum(np.bincount(bucket[which], minlength=buckets) for bucket, which, _ in self.lengths)

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """Each document's sum of gains."""
        total = np.zeros(len(self.n_words), np.int64)
        for bucket, which, at in self.lengths:
            running = np.concatenate([[0], np.cumsum(gains[bucket][which])])
            total += running[at[1:]] - running[at[:-1]]
        return total


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: each task adds up its own, and one row a bucket (``buckets`` at most) reaches the driver."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for chunk in chunks(batch, "text"):
                total += Grams(chunk.column(0), longest, buckets).counts(buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's share of each bucket to the corpus's, each count plus one."""
    b, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(y) + 1) * (float(s) + b) / ((float(x) + 1) * (float(t) + b)))) for x, y in zip(corpus, target)], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""

    def weigh(batches):
        for batch in batches:
            for chunk in chunks(batch, "text"):
                grams = Grams(chunk.column(1), longest, len(gains))
                yield pa.RecordBatch.from_arrays([chunk.column(0), *map(pa.array, (grams.n_words, grams.n_features, grams.weights(gains)))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(weigh, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, longest: int = LONGEST, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null for those that are not drawn.

    Of the documents of ``least_words`` words and more, ``percent`` in a hundred are drawn, highest
    score first, ties to the smaller identifier. Null and empty texts have no features and weight
    0; a null identifier draws its noise as an empty one and comes last of equal scores; repeated
    rows share a score and are drawn one by one; an empty table gives an empty result, an empty
    target counts as one without features; names of other columns do not matter.

    Ranks come from a sort by ranges and the sizes of the ranges, so no task holds the whole order.
    """
    corpus, wanted = bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, text_col, longest, buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed(docs, bucket_gains(corpus, wanted), id_col, text_col, longest).withColumn("score", F.col("weight") + noise), "resample-scores")
    enough = F.col("n_words") >= least_words
    drawn = percent * scored.filter(enough).count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    ordered = scored.filter(enough).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order)
    ordered = written(ordered.withColumn("_at", F.monotonically_increasing_id()).drop("_row"), "resample-order")
    part, nth = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    earlier = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # a row a range
    ranked = ordered.withColumn("_part", part).join(F.broadcast(earlier), "_part").withColumn("rank", F.col("_before") + nth + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return (ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).cast("bigint").alias("rank"))
            .unionByName(scored.filter(~enough).select(*columns, F.lit(None).cast("bigint").alias("rank"))))
