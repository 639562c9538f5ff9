"""Exact near-duplicate join on word-shingle sets by parity sketches.

Method. A document's set is its distinct five-word shingles. Its *parity sketch* has m blocks;
each shingle toggles one bit of one block, so two sketches differ in at most |A ^ B| bits and in
at most that many blocks. Sets with similarity of at least t differ in at most
(1-t)/(1+t) * (|A|+|B|) elements; the sizes that can meet in a *band* bound that by D. With
m = D + x blocks, linked sets agree in x blocks at least (pigeonhole), so they are found by an
equality join on (band, block, content). Blocks are kept sparsely: a block's content is the XOR
of its bits' 64-bit codes. A dense parity sketch of the whole set then discards candidates whose
Hamming distance exceeds their own bound, and the rest are verified on the sets themselves.

Nothing is lost: an empty block is no key, so a document counts as *safe* in a band only if it has
fewer than x empty blocks; documents that are not safe, and sets of fewer than 16 shingles, also
meet through an ordinary prefix (size - ceil(t * size) + 1 shingles in one global order).
Shingles of very many documents (found by lossy counting over all documents) are left out of
blocks and come last in that order, which keeps passages that everybody quotes from pairing
everybody; any such set of shingles gives the same result.

Members of one key are not paired but named with one of them, the leader, whose *star* they are;
many keys of a family of near copies share a leader, so a family has few stars. Stars of at most
``GROUP`` members are paired; a larger star is dealt out in blocks of two sides: first by sketches, which leaves those
members that are close to another one, then by sets. A block counts each member's links and sends
on a spanning forest of them, so no link is lost and no more rows than members leave a block. A pair that
several stars hold is counted in the first of them.

Identical sets are one *node* (64-bit fingerprint of the set); copies never meet each other.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stocktake.llm.graph import components
from stocktake.llm.shared import joined, shuffle_width, written
from stocktake.llm.textops import Text, chunks, mix, release, shingle_sets

#: Similarity of at least PERCENT / 100.
PERCENT = 75
#: Largest star whose members are paired outright.
GROUP = 6
#: Shingles of more than one document in HOT_ONE_IN may be left out of blocks; at most HOT_MOST (half a megabyte) are.
HOT_ONE_IN, HOT_MOST = 500, 65_536
#: Shingles that are counted together in search of frequent ones.
COUNTED = 1_500_000
#: Keys that one task is to hold.
KEYS_PER_TASK = 4_000_000
#: Smallest set with blocks; sets of up to PREFIX_TO shingles have prefix keys.
LEAST, PREFIX_TO = 12, 15
#: Members of a side of a star, and what they hold: bytes of sketches, elements of sets.
SIDE, SIDE_SKETCHES, SIDE_ELEMENTS = 512, 4_000_000, 500_000


def bound(a, b):
    """The largest symmetric difference of linked sets of a and b elements."""
    return ((100 - PERCENT) * (a + b)) // (100 + PERCENT)


@lru_cache(maxsize=1)
def bands(most: int = 1 << 28) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower edges of the size bands; for each, the largest partner size, the blocks m, and x."""
    edges = [LEAST]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // PERCENT)))
    partner, blocks, spare = [], [], []
    for low, high in zip(edges, edges[1:]):
        largest = (high - 1) * 100 // PERCENT
        d = bound(high - 1, largest)
        m = d + 1
        while True:
            empty = m * np.exp(-0.9 * low / m)
            if m - d > empty + 3 * np.sqrt(empty) or m > 4 * d + 8:
                break
            m += max(1, m // 64)
        partner.append(largest)
        blocks.append(m)
        spare.append(m - d)
    return np.array(edges), np.array(partner), np.array(blocks), np.array(spare)


def sketch_bits(n: int) -> int:
    """Bits of the dense sketch of a set of n elements."""
    return max(64, 1 << int(n - 1).bit_length()) if n else 64


def dense_sketch(elements: np.ndarray) -> bytes:
    """A parity sketch: every element toggles one bit."""
    bits = sketch_bits(len(elements))
    counts = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set with fewer bits (bytes: size)."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def hamming(a: bytes, b: bytes) -> int:
    """Hamming distance of two dense sketches, the longer one folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())


def node_of(elements: np.ndarray) -> int:
    """The fingerprint of a set."""
    with np.errstate(over="ignore"):
        total = mix(elements).sum(dtype=np.uint64) + np.uint64(len(elements)) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def sets_of(column: pa.Array) -> list[np.ndarray]:
    """The shingle set of each text."""
    h, at = shingle_sets(Text(column))
    return [h[lo:hi] for lo, hi in zip(at.tolist(), at.tolist()[1:])]


FACTS = "kind tinyint, doc_id bigint, text_key bigint, node bigint, n bigint, sketch binary"


def _frequent(held: list[np.ndarray]) -> pa.RecordBatch:
    """Shingles that many of the held sets (copies once) have, with their counts."""
    held = list({s.tobytes(): s for s in held}.values())
    value, count = np.unique(np.concatenate(held), return_counts=True)
    often = count >= max(4, len(held) // HOT_ONE_IN)
    k = int(often.sum())
    return pa.record_batch([pa.array(np.ones(k, np.int8)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(value[often].view(np.int64)),
                            pa.array(count[often].astype(np.int64)), pa.nulls(k, pa.binary())], names=["kind", "doc_id", "text_key", "node", "n", "sketch"])


def _facts(batches):
    """Pass 1. kind 0: a document's node, set size and dense sketch; kind 1: a shingle frequent among the sets counted with it."""
    held, size = [], 0
    for batch in batches:
        for part in chunks(batch, "text"):
            sets = sets_of(part.column(2))
            yield pa.record_batch([
                pa.array(np.zeros(len(sets), np.int8)), part.column(0), part.column(1), pa.array([node_of(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()), pa.array([dense_sketch(s) for s in sets], pa.binary())], names=["kind", "doc_id", "text_key", "node", "n", "sketch"])
            held += sets
            size += sum(map(len, sets))
            if size >= COUNTED:
                yield _frequent(held)
                held, size = [], 0
    if held:
        yield _frequent(held)


def block_keys(h: np.ndarray, at: np.ndarray, n: np.ndarray, cold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the nonempty blocks with the document of each, and the documents that are safe in all their bands."""
    edges, partner, blocks, spare = bands()
    band = np.searchsorted(edges, n, side="right") - 1
    safe = n >= LEAST
    keys, docs = [], []
    hc = h[cold]
    owner_of = np.repeat(np.arange(len(n)), np.diff(at))[cold]
    for back in (0, 1):
        space = band - back
        inside = (space >= 0) & (n <= partner[np.maximum(space, 0)])
        m = np.where(inside, blocks[np.maximum(space, 0)], 0)
        base = np.concatenate([[0], np.cumsum(m)])
        use = inside[owner_of]
        doc, x = owner_of[use], hc[use]
        salted = mix(x ^ (space[doc].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        slot = base[doc] + (((salted >> np.uint64(32)) * m[doc].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        content = np.zeros(base[-1], np.uint64)
        np.bitwise_xor.at(content, slot, x)
        full = np.zeros(base[-1], bool)
        full[slot] = True
        owner = np.repeat(np.arange(len(n)), m)
        empty = m - np.bincount(owner[full], minlength=len(n))
        safe &= ~inside | (empty < spare[np.maximum(space, 0)])
        j = np.arange(base[-1]) - base[owner]
        tag = mix((space[owner].astype(np.uint64) << np.uint64(32)) ^ j.astype(np.uint64))
        keys.append(mix(content + tag)[full])
        docs.append(owner[full])
    return np.concatenate(keys), np.concatenate(docs), safe


def prefix_keys(elements: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first size - ceil(t * size) + 1 elements, rare ones first."""
    n = len(elements)
    late = np.isin(elements, hot)
    order = np.concatenate([elements[~late], elements[late]])
    return mix(order[:n - (-(-PERCENT * n // 100)) + 1] ^ np.uint64(0xA0761D6478BD642F))


BLOBS = "p int, nodes binary, sizes binary, least binary, counts binary, keys binary"


def _emit(hot_values: np.ndarray, parts: int):
    """Pass 2: the keys of each chunk's distinct nodes, dealt out to ``parts`` key ranges."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                h, at = shingle_sets(Text(part.column(0)))
                cuts = at.tolist()
                nodes = np.array([node_of(h[lo:hi]) for lo, hi in zip(cuts, cuts[1:])], np.int64)
                _, first = np.unique(nodes, return_index=True)
                first = np.sort(first[np.diff(at)[first] > 0])
                if not len(first):
                    continue
                sizes = np.diff(at)
                keep = np.zeros(len(nodes), bool)
                keep[first] = True
                h, n, nodes = h[np.repeat(keep, sizes)], sizes[first], nodes[first]
                at = np.concatenate([[0], np.cumsum(n)])
                cold = ~np.isin(h, hot_values) if len(hot_values) else np.ones(len(h), bool)
                keys, docs, safe = block_keys(h, at, n, cold)
                more = [(prefix_keys(h[at[d]:at[d + 1]], hot_values), d) for d in np.flatnonzero(~safe | (n <= PREFIX_TO))]
                keys = np.concatenate([keys, *(k for k, _ in more)])
                docs = np.concatenate([docs, *(np.full(len(k), d) for k, d in more)])
                least = np.full(len(nodes), np.iinfo(np.uint64).max)
                np.minimum.at(least, docs, keys)
                p = (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((docs, p))
                keys, docs, p = mix(keys)[order].astype(np.uint32), docs[order], p[order]
                edges = np.flatnonzero(np.diff(p, prepend=p[:1] + np.uint32(1)))
                rows = []
                for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(p)]):
                    starts = np.flatnonzero(np.diff(docs[lo:hi], prepend=-1))
                    here = docs[lo:hi][starts]
                    rows.append((int(p[lo]), nodes[here].tobytes(), n[here].astype(np.uint32).tobytes(), least[here].tobytes(), np.diff(np.append(starts, hi - lo)).astype(np.uint32).tobytes(), keys[lo:hi].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 5))], names=["p", "nodes", "sizes", "least", "counts", "keys"])

    return run


MEETINGS, STARS = "q int, rows binary", "star bigint, node bigint"


def _meet(group: pa.Table) -> pa.Table:
    """Nodes of one key range that share a key: the leader of each key's group with every other member, as blobs dealt out by leader and member.

    Members whose size is linked with no other one's leave their group. A group whose members have one
    least key in common is left to that key's group, which holds them all.
    """
    each = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
    nodes, least, counts, keys = each("nodes", np.int64), each("least", np.uint64), each("counts", np.uint32), each("keys", np.uint32)
    owner = np.repeat(np.arange(len(nodes), dtype=np.uint32), counts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    shared = np.zeros(len(keys), bool)
    shared[1:] |= same
    shared[:-1] |= same
    keys, owner = keys[shared], owner[order][shared]
    n = np.minimum(each("sizes", np.uint32), np.uint32(1 << 30)).astype(np.int64)[owner]
    order = np.lexsort((n, keys))
    keys, owner, n = keys[order], owner[order], n[order]
    fits = np.zeros(len(keys) + 1, bool)
    fits[1:-1] = (keys[1:] == keys[:-1]) & (100 * n[:-1] >= PERCENT * n[1:])
    keys, owner = keys[fits[1:] | fits[:-1]], owner[fits[1:] | fits[:-1]]
    order = np.lexsort((mix(nodes.view(np.uint64))[owner], keys))  # a group's leader comes first
    keys, members, least = keys[order], nodes[owner[order]], least[owner[order]]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint32(1)))
    sizes = np.diff(np.append(starts, len(keys)))
    first = least[starts]
    elsewhere = np.logical_and.reduceat(least == np.repeat(first, sizes), starts) & (mix(first).astype(np.uint32) != keys[starts]) if len(keys) else np.zeros(0, bool)
    leader = members[np.repeat(starts, sizes)]
    rows = np.unique(np.stack([leader, members], 1)[(leader != members) & ~np.repeat(elsewhere, sizes)], axis=0)
    parts = np.uint64(group.column("parts")[0].as_py())
    pair = mix(rows[:, 0].copy().view(np.uint64)) ^ rows[:, 1].copy().view(np.uint64)  # a leader of very many is dealt out with its members
    q = (((mix(pair) >> np.uint64(32)) * parts) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(q, kind="stable")
    rows, q = rows[order], q[order]
    edges = np.flatnonzero(np.diff(q, prepend=-1))
    del nodes, least, counts, keys, members, owner, leader
    release()
    return pa.table({"q": pa.array(q[edges]), "rows": pa.array([rows[lo:hi].tobytes() for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(q)])], pa.binary())})


def _stars(group: pa.Table) -> pa.Table:
    """The distinct pairs of leader and member dealt to one blob number; most members meet under many keys."""
    rows = np.unique(np.frombuffer(b"".join(group.column("rows").to_pylist()), np.int64).reshape(-1, 2), axis=0)
    return pa.table({"star": rows[:, 0], "node": rows[:, 1]})


def _close(batches):
    """Of pairs with sizes and dense sketches, those within their Hamming bound."""
    for batch in batches:
        a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
        sa, sb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        d = bound(na, nb)
        keep = np.fromiter((hamming(x, y) <= k for x, y, k in zip(sa, sb, d.tolist())), bool, len(d))
        yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def _near(group: pa.Table) -> pa.Table:
    """The members on two sides of a star that sizes and dense sketches leave as links of another one there."""
    node, n, side = (group.column(k).to_numpy() for k in ("node", "n", "side"))
    low, high = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    arrays = [np.frombuffer(s, np.uint8) for s in group.column("sketch").to_pylist()]
    wide = np.array([len(x) for x in arrays])
    near = np.zeros(len(node), bool)
    for size in sorted(set(wide.tolist())):  # linked sets have sketches of one width or of neighbouring ones
        there = np.flatnonzero((wide == size) | (wide == 2 * size))
        matrix = np.stack([fold(arrays[k], size) for k in there])
        matrix = matrix.view(np.uint64) if size % 8 == 0 else matrix
        right = np.flatnonzero(side[there] == high)
        for i in np.flatnonzero(side[there] == low).tolist():
            others = right[right > i] if low == high else right
            k, rest = there[i], there[others]
            fits = (np.minimum(wide[rest], wide[k]) == size) & (100 * np.minimum(n[rest], n[k]) >= PERCENT * np.maximum(n[rest], n[k]))
            others, rest = others[fits], rest[fits]
            hit = rest[np.bitwise_count(matrix[others] ^ matrix[i]).sum(1) <= bound(n[rest], n[k])]
            if len(hit):
                near[k] = True
                near[hit] = True
    return pa.table({"star": pa.array(np.full(int(near.sum()), group.column("star")[0].as_py())), "node": node[near]})


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``left`` with those at ``right``."""
    _, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # elements of one set only meet nothing
    use = times[where] > 1
    row, col = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[use], number[where[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(left), len(right)), np.float32)  # exact below 2 ** 24
    for lo in range(0, int(np.count_nonzero(times > 1)), 4096):
        at = slice(*np.searchsorted(col, [lo, lo + 4096]))
        has = np.zeros((len(sets), 4096), np.float32)
        has[row[at], col[at] - lo] = 1
        both += has[left] @ has[right].T
    return both.astype(np.int64)


FOUND = "kind tinyint, a bigint, b bigint"


def _compare(group: pa.Table) -> pa.Table:
    """Links between two sides of a star. kind 0: a member a with the number b of its links that no earlier star counts; kind 1: an edge of a spanning forest."""
    node, side, star = group.column("node").to_numpy(), group.column("side").to_numpy(), group.column("star")[0].as_py()
    low, high = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    sets = [np.frombuffer(x, np.uint64) for x in group.column("elements").to_pylist()]
    n = np.array([len(x) for x in sets], np.int64)
    left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
    both = common(sets, left, right)
    links = 100 * both >= PERCENT * (n[left][:, None] + n[right] - both)
    if low == high:
        np.fill_diagonal(links, False)
    earlier = [np.array([s for s in x if s < star], np.int64) for x in group.column("stars").to_pylist()]
    own = links & (common(earlier, left, right) == 0) if any(map(len, earlier)) else links
    count = np.zeros(len(node), np.int64)
    count[left] += own.sum(axis=1)
    if low != high:
        count[right] += own.sum(axis=0)
    # labels go along links until they rest; roots differ from block to block, so that no node gathers the edges of a family
    rank = np.argsort(np.argsort(mix(node.view(np.uint64) ^ mix(np.array([star, low, high]).view(np.uint64)).sum(dtype=np.uint64))))
    label = rank.copy()
    while len(left) and len(right):
        before = label.copy()
        label[left] = np.minimum(label[left], np.where(links, label[right], len(node)).min(axis=1))
        label[right] = np.minimum(label[right], np.where(links.T, label[left], len(node)).min(axis=1))
        if (label == before).all():
            break
    root = node[np.argsort(rank)][label]
    counted, joint = np.flatnonzero(count), np.flatnonzero(root != node)
    return pa.table({"kind": np.repeat(np.array([0, 1], np.int8), [len(counted), len(joint)]), "a": np.concatenate([node[counted], node[joint]]), "b": np.concatenate([count[counted], root[joint]])})


def _verify(batches):
    """Of pairs with both sets, those that link."""
    for batch in batches:
        x, y = ([np.frombuffer(s, np.uint64) for s in batch.column(k).to_pylist()] for k in (2, 3))
        keep = np.zeros(batch.num_rows, bool)
        for k, (p, q) in enumerate(zip(x, y)):
            both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
            keep[k] = 100 * both >= PERCENT * (len(p) + len(q) - both)
        yield pa.record_batch([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])


def _sets(batches):
    """The set of each text whose set is its node's."""
    for batch in batches:
        _, first = np.unique(batch.column(0).to_numpy(), return_index=True)  # copies once
        for part in chunks(batch.take(pa.array(np.sort(first))), "text"):
            found = [(node, s.tobytes()) for node, s in zip(part.column(0).to_pylist(), sets_of(part.column(1))) if node_of(s) == node]
            yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["node", "elements"])


def _sides(stars: DataFrame, weight: str, most: int) -> DataFrame:
    """Rows (star, node, n, ...) dealt to the pairs (i, j) of their star's sides; a side has about SIDE members and holds about ``most`` of ``weight``."""
    sizes = stars.groupBy("star").agg(F.ceil(F.greatest(F.count("*") / SIDE, F.sum(F.expr(weight)) / most)).cast("int").alias("sides"))
    return (joined(stars, written(sizes, "star-sizes"), "star").withColumn("side", F.pmod(F.xxhash64("node"), F.col("sides")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
            .withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("sides", "other"))


def _links(docs: DataFrame, facts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that connect what links connect, and the number of links (node, n_links) of nodes that have any."""
    total, count = facts.filter("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = max(20, count // HOT_ONE_IN)
    hot = (facts.filter("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") >= floor)
           .orderBy(F.desc("n"), "node").limit(HOT_MOST).select("node").collect())  # at most HOT_MOST longs
    hot_values = np.sort(np.array([r[0] for r in hot], np.int64).view(np.uint64))
    parts = max(shuffle_width(docs.sparkSession), -(-total * 4 // 5 // KEYS_PER_TASK))
    met = docs.select("text").mapInArrow(_emit(hot_values, parts), BLOBS).withColumn("parts", F.lit(parts)).groupBy("p").applyInArrow(_meet, MEETINGS)
    met = written(met.groupBy("q").applyInArrow(_stars, STARS), "stars")
    sizes = written(met.groupBy("star").agg((F.count("*") + 1).alias("size")), "star-sizes")
    small, large = (sizes.filter(c).select("star") for c in (F.col("size") <= GROUP, F.col("size") > GROUP))
    few = joined(met, small, "star", "left_semi").groupBy("star").agg(F.array_sort(F.array_append(F.collect_list("node"), F.col("star"))).alias("m"))
    each = F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x AS a, y AS b))))")
    pairs = few.select(F.explode(each).alias("pair")).select("pair.*").distinct()
    end = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))
    close = written(pairs.join(end("a").hint("merge"), "a").join(end("b").hint("merge"), "b")
                    .filter(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
                    .select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_close, "a bigint, b bigint"), "close")
    stars = joined(met, large, "star", "left_semi").select("star", "node").union(large.select("star", F.col("star").alias("node"))).join(nodes.select("node", "n", "sketch").hint("merge"), "node")
    near = written(_sides(written(stars, "large-stars"), "octet_length(sketch)", SIDE_SKETCHES).groupBy("star", "i", "j").applyInArrow(_near, "star bigint, node bigint").distinct(), "near")
    of = written(near.groupBy("node").agg(F.collect_set("star").alias("stars")), "stars-of")  # fewer than the node has keys
    needed = close.select(F.explode(F.array("a", "b")).alias("node")).union(of.select("node")).distinct().join(nodes.select("node", "text_key").hint("merge"), "node")
    sets = written(joined(docs, written(needed, "needed"), "text_key").select("node", "text").mapInArrow(_sets, "node bigint, elements binary")
                   .groupBy("node").agg(F.first("elements").alias("elements")).join(of.hint("merge"), "node", "left"), "sets")
    one = lambda k: sets.select(F.col("node").alias(k), F.col("elements").alias(f"x_{k}"), F.col("stars").alias(f"o_{k}"))
    alone = written(close.join(one("a").hint("merge"), "a").join(one("b").hint("merge"), "b").filter("NOT coalesce(arrays_overlap(o_a, o_b), false)")
                    .select("a", "b", "x_a", "x_b").mapInArrow(_verify, "a bigint, b bigint"), "pair-links")
    members = near.join(nodes.select("node", "n").hint("merge"), "node")
    dealt = _sides(written(members, "members"), "n", SIDE_ELEMENTS).join(sets.hint("merge"), "node")
    found = written(dealt.select("star", "i", "j", "side", "node", "elements", "stars").groupBy("star", "i", "j").applyInArrow(_compare, FOUND), "star-links")
    degree = (alone.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("bigint").alias("k"))
              .union(found.filter("kind = 0").select("a", "b")).groupBy("node").agg(F.sum("k").alias("n_links")))
    return alone.union(found.filter("kind = 1").select("a", "b")), degree


def _members(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Narrow rows of ``docs`` (doc_id, text): (doc_id, text_key, node, n); and, of each node that has copies or
    links, (node, first, n_links), first being the first row of its component: the smallest (without, doc_id, text_key), rows without an id last."""
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    facts = written(docs.select("doc_id", "text_key", "text").mapInArrow(_facts, FACTS), "shingle-facts")
    own = facts.filter("kind = 0").select("doc_id", "text_key", "node", "n", "sketch")
    row = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_key")
    nodes = written(own.filter("n > 0").groupBy("node", "n", "sketch").agg(F.min(row).alias("first"), F.count("*").alias("copies")), "nodes").withColumn("text_key", F.col("first.text_key"))
    edges, degree = _links(docs, facts, nodes)
    labels = components(edges)
    parts = written(labels.hint("merge").join(nodes.select("node", "first"), "node"), "parts")
    firsts = written(parts.groupBy("label").agg(F.min("first").alias("first")), "firsts")
    linked = joined(parts.select("node", "label"), firsts, "label").select("node", "first").join(degree.hint("merge"), "node", "left")
    copied = nodes.filter("copies > 1").select("node", "first").join(labels.hint("merge"), "node", "left_anti").withColumn("n_links", F.lit(0).cast("bigint"))
    return own.select("doc_id", "text_key", "node", "n"), written(linked.union(copied), "known")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs``.

    component_id is the smallest doc_id that links lead to, the document itself included;
    n_links counts the document's links to *other* sets, all of them.

    Null and empty texts have no shingles and link with nothing; a null doc_id is kept as a row
    (component_id null unless a linked row has an id); repeated rows give repeated results; an
    empty table gives an empty result; other columns of ``docs`` are ignored.
    """
    rows, known = _members(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
    own = lambda of: of.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    return own(joined(rows, known, "node", "left"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) with one row of each component: that of the smallest doc_id.

    A component without any doc_id keeps one row too. Texts without words link with nothing and all
    stay; of rows equal in doc_id and text any one stays; an empty table stays empty; names of other
    columns do not matter.
    """
    rows, known = _members(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    own = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_key")
    placed = written(joined(rows.filter("n > 0"), known, "node").select("doc_id", "text_key", (F.col("first") == own).alias("stays")), "placed")
    key = lambda of: of.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"))
    drop = written(key(placed.filter("NOT stays")).distinct(), "drop")
    repeats = written(key(placed.filter("stays")).groupBy("d", "t").count().filter("count > 1").drop("count"), "repeats")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))
    kept = joined(keyed, drop, on, "left_anti")
    if repeats.isEmpty():
        return kept.select("row.*")
    once = joined(kept, repeats, on, "left_semi").groupBy("doc_id", "text_key").agg(F.first("row").alias("row"))
    return joined(kept, repeats, on, "left_anti").select("row.*").union(once.select("row.*"))
