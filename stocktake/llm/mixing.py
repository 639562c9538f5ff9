"""Mixing sources to target weights by Pareto order sampling, in DataFrame expressions only.

A source's target over its own size is the expected number of copies of each of its documents.
Its whole part is certain; for the fraction p documents are ranked by random odds divided by
inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the smallest ranks are taken until the source's
remaining words are filled: a sample of fixed size in words. The cut-off rank of a source comes
from sums over rank bins and then from the one bin it falls into, so no task sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stocktake.llm.shared import joined, shuffle_width, written

WORDS = r"[^\x20\x09-\x0D]+"
#: No document is taken more often than this.
MOST = 3
#: Rank bins of a source.
BINS = 4096
#: Tables of at most so many sources are broadcast; larger ones are joined by key and salt.
FEW = 10_000
SALTS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def uniform(*cols: str, seed: int) -> Column:
    """A repeatable number strictly between 0 and 1 for each row."""
    bits = F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53))
    return (bits.cast("double") + 0.5) / float(1 << 53)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): weights 1, 2, 3, 1, ... by code point, null last, filled up to MOST times a source's size.

    Sources whose cap lies below their share at the common level get their cap, the others weight
    times level. Sources are numbered by ranges and the sizes of the ranges; the level rises from
    that without caps, each time to what the sources not yet capped share, until no more are: some
    sums over the sources, however many there are.
    """
    order = F.asc_nulls_last("source")
    cut = sizes.repartitionByRange(shuffle_width(sizes.sparkSession), order).sortWithinPartitions(order)
    placed = written(cut.withColumn("_at", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("_at", 33)
    ranges = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    earlier = ranges.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # a row a range
    nth = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    ranked = placed.withColumn("_part", part).join(F.broadcast(earlier), "_part").select("source", "source_size", (F.pmod(nth, F.lit(3)) + 1).cast("double").alias("w"), (F.col("source_size") * float(MOST)).alias("cap"))
    ranked = written(ranked, "mix-weights")
    total, level = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double")).first()[0], -1.0
    while True:
        full = F.col("cap") <= F.col("w") * level
        capped, weight = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~full, F.col("w")))).first()
        risen = level if weight is None else (total - capped) / weight
        if risen <= level:
            break
        level = risen
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.col("w") * max(level, 0.0)).alias("target"))


def _with_source(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """Rows with their source's columns; null sources match."""
    right = per_source.withColumnRenamed("source", "_source")
    on = rows["source"].eqNullSafe(F.col("_source"))
    if few:
        return rows.join(F.broadcast(right), on).drop("_source")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_salts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(right.hint("merge"), salted["source"].eqNullSafe(right["_source"]) & (salted["_salt"] == right["_salts"])).drop("_source", "_salt", "_salts")


def drawn(docs: DataFrame, seed: int, *extra: Column) -> DataFrame:
    """Rows of doc_id, source, size, u and ``extra``. u depends on the row and, where rows are equal, on which of them it is,
    so that equal rows draw different numbers and reruns the same ones.

    Equal rows are numbered within the partition they were written from and after those of earlier
    partitions, so no task gathers a row that is repeated very often.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text").alias("same"), *extra)
    repeats = written(rows.groupBy("same").count().filter("count > 1").drop("count"), "mix-repeats")
    own = lambda of: of.withColumn("u", uniform("same", "nth", seed=seed)).select("doc_id", "source", "size", "u", *rows.columns[4:])
    if repeats.isEmpty():
        return own(rows.withColumn("nth", F.lit(0).cast("bigint")))
    again = written(joined(rows, repeats, "same", "left_semi").withColumn("part", F.spark_partition_id()), "mix-again")
    held = again.groupBy("same", "part").agg(F.count("*").alias("n"))
    before = held.select("same", "part", (F.sum("n").over(Window.partitionBy("same").orderBy("part")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("same", "part").orderBy("doc_id")) - 1 + F.col("before")
    numbered = again.join(before.hint("merge"), ["same", "part"]).withColumn("nth", nth.cast("bigint")).select(*rows.columns, "nth")
    return own(joined(rows, repeats, "same", "left_anti").withColumn("nth", F.lit(0).cast("bigint")).unionByName(numbered))


def _ranked(rows: DataFrame) -> DataFrame:
    odds = F.col("u") / (1 - F.col("u"))
    q = F.when(F.col("p") > 0, odds * (1 - F.col("p")) / F.col("p"))
    return rows.withColumn("q", q).withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int"))


def plan_mix(narrow: DataFrame) -> tuple[DataFrame, bool]:
    """(source, source_size, target, whole, p, cut) of each source, and whether there are few of them."""
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets(sizes).withColumn("whole", F.least(F.floor(ratio + 1e-12), F.lit(MOST)).cast("int")).withColumn("p", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
    plan = written(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    few = plan.count() <= FEW
    ranked = _ranked(_with_source(narrow, plan.select("source", "whole", "p", "rest"), few)).filter("q is not null and size > 0")
    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bin")) - F.col("words")
    edge = bins.withColumn("before", before).filter("before < rest and before + words >= rest").select("source", F.col("bin").alias("edge"), "before")
    inside = _with_source(ranked.select("source", "size", "u", "q", "bin", "rest"), edge, few).filter("bin = edge")
    order = Window.partitionBy("source").orderBy("q", "size")
    running = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    # the cut is the last rank taken; where the edge bin takes none, its lower end
    cuts = inside.withColumn("taken", F.col("before") + running <= F.col("rest")).groupBy("source").agg(
        F.coalesce(F.max(F.when(F.col("taken"), F.col("q"))), (F.first("edge") / BINS) / (1 - F.first("edge") / BINS) * (1 - 1e-12)).alias("cut"))
    right = cuts.withColumnRenamed("source", "_s")
    plan = plan.join(right, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return written(plan.withColumn("cut", F.when((F.col("p") > 0) & (F.col("rest") > 0), F.coalesce("cut", F.lit(float("inf")))).otherwise(F.lit(-1.0))).drop("rest"), "mix-cuts"), few


def _copies(rows: DataFrame) -> DataFrame:
    return _ranked(rows).withColumn("copies", (F.col("whole") + F.when(F.col("q") <= F.col("cut"), 1).otherwise(0)).cast("int")).drop("q", "bin")


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of ``docs``.

    A null or empty text has size 0 and takes nothing; a null source is a source, the last one;
    equal rows are drawn one by one; an empty table gives an empty result; the columns used are
    doc_id, source and text, whatever others there are.
    """
    narrow = written(drawn(docs, seed), "mix-sizes")
    plan, few = plan_mix(narrow)
    return _copies(_with_source(narrow, plan, few)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it.

    Null and empty texts have no words and follow their source's whole copies and draws like others; null sources, equal rows
    and empty tables as in ``mix``; names of other columns do not matter.
    """
    plan, few = plan_mix(written(drawn(docs, seed), "mix-sizes"))
    rows = drawn(docs, seed, F.struct(*docs.columns).alias("row"))
    taken = _copies(_with_source(rows, plan.select("source", "whole", "p", "cut"), few)).filter("copies > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")
