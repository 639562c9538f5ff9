"""Quality rules: counting rules and divergence from language references.

The references are counted over the whole table: for each language a histogram of character
classes and one of word bins (hashes of lower-cased words), of which the COMMON largest are its
common words. A document is compared with every reference by Jensen-Shannon distance (base 2, so
0 to 1) and keeps its smallest distances; texts shorter than the guard are not judged by them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stocktake.llm.shared import written
from stocktake.llm.textops import SHINGLE, SPACE, Text, chunks

CLASSES = 11
WORD_BITS = 12
COMMON = 48
#: Histograms that a counting task holds before it sends them on.
HELD = 256
#: Texts with fewer words are judged by the counting rules alone.
GUARD_WORDS = 40
#: Largest distances of a kept document.
CHAR_MOST, WORD_MOST = 0.28, 0.48
LEAST_WORDS, REPEAT_PERCENT = 10, 20

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, space, line end, punctuation, symbol, control, 2-, 3- and 4-byte characters; 255: inside a character."""
    c = np.full(256, 255, np.uint8)
    c[0:32], c[33:127] = 7, 6
    c[127] = 7
    c[97:123], c[65:91], c[48:58] = 0, 1, 2
    c[[9, 11, 12, 32]] = 3
    c[[10, 13]] = 4
    c[list(b".,;:!?'\"()-")] = 5
    c[0xC2:0xE0], c[0xE0:0xF0], c[0xF0:0xF5] = 8, 9, 10
    return c


CLASS_OF = _classes()


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def class_counts(text: Text) -> np.ndarray:
    """documents x CLASSES; the newline that ends each document here is not counted."""
    cls = CLASS_OF[text.data].astype(np.int64)
    cls[text.offsets[1:] - 1] = 255
    keep = cls != 255
    doc = np.repeat(np.arange(text.size) * CLASSES, np.diff(text.offsets))
    return np.bincount((doc + cls)[keep], minlength=text.size * CLASSES).reshape(text.size, CLASSES)


def word_bins(text: Text) -> np.ndarray:
    return (text.word_hashes(fold=True) >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def repeated_words(text: Text) -> np.ndarray:
    """Words of each document inside five-word windows that occur twice or more in it."""
    h, at = text.windows(text.word_hashes())
    out = np.zeros(text.size, np.int64)
    ordered = h.copy()
    for d, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if hi - lo < 2:
            continue
        seg = ordered[lo:hi]
        seg.sort()
        twice = seg[1:][seg[1:] == seg[:-1]]
        if len(twice):
            starts = np.flatnonzero(np.isin(h[lo:hi], twice))
            cover = np.zeros(hi - lo + SHINGLE, np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + SHINGLE, -1)
            out[d] = np.count_nonzero(np.cumsum(cover)[:-1])
    return out


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of counts from a distribution; empty rows: 0."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    mid = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / mid), 0).sum(axis=1)
        right = np.where(reference > 0, reference * np.log2(reference / mid), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0)


def references(docs: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each language: class distribution, word bins that are common (slot COMMON: any other word), distribution over slots.

    Each task sends one histogram a language (more where it meets more than HELD languages); what reaches the driver is one row of CLASSES + COMMON counts a language, for all languages.
    """

    def rows(found):
        for lang, both in found.items():
            at = np.flatnonzero(both)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(both[at])], names=["lang", "bin", "n"])

    def count(batches):
        found: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch, "text"):
                text = Text(part.column(0))
                codes = part.column(1).dictionary_encode()
                index = np.nan_to_num(codes.indices.to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(np.int64)
                classes, bins = class_counts(text), word_bins(text)
                owner = np.repeat(index, text.n_words)
                for k in np.unique(index):
                    lang = codes.dictionary[int(k)].as_py() if k >= 0 else None
                    both = np.concatenate([classes[index == k].sum(axis=0), np.bincount(bins[owner == k], minlength=1 << WORD_BITS)])
                    found[lang] = found.get(lang, 0) + both
                    if len(found) == HELD:
                        yield from rows(found)
                        found = {}
        yield from rows(found)

    counts = written(docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(count, "lang string, bin int, n bigint")
                     .groupBy("lang", "bin").agg(F.sum("n").alias("n")), "references")
    is_class = F.col("bin") < CLASSES
    per_lang = counts.groupBy("lang").agg(
        F.collect_list(F.when(is_class, F.struct("bin", "n"))).alias("classes"),
        F.slice(F.array_sort(F.collect_list(F.when(~is_class, F.struct((-F.col("n")).alias("less"), (F.col("bin") - CLASSES).alias("bin"))))), 1, COMMON).alias("words"),
        F.coalesce(F.sum(F.when(~is_class, F.col("n"))), F.lit(0)).alias("total")).collect()
    out = []
    for lang, own, words, total in sorted(per_lang, key=lambda r: (r[0] is None, r[0] or "")):
        classes, usage = np.zeros(CLASSES), np.zeros(COMMON + 1)
        for k, n in own:
            classes[k] = n
        common = [k for _, k in words]
        usage[:len(common)] = [-less for less, _ in words]
        usage[COMMON] = total - usage.sum()
        common += [k for k in range(2 * COMMON) if k not in common][:COMMON - len(common)]  # bins without words fill up
        out.append((classes / max(classes.sum(), 1), np.array(common), usage / max(total, 1)))
    return out


def measures(column: pa.Array, refs) -> dict[str, np.ndarray]:
    """All counts and distances of a chunk of texts."""
    text = Text(column)
    data = text.data
    inside = ~text.space & ((data & 0xC0) != 0x80)
    out = {
        "n_words": text.n_words.astype(np.int64), "word_chars": sums(inside, text.offsets), "n_symbols": sums(SYMBOLS[data], text.offsets),
        "n_dup_lines": np.array([duplicate_lines(t or "") for t in column.to_pylist()], np.int64), "n_repeat_words": repeated_words(text),
    }
    classes, bins = class_counts(text), word_bins(text)
    char, word = np.full(text.size, 1.0 if refs else 0.0), np.full(text.size, 1.0 if refs else 0.0)
    doc = np.repeat(np.arange(text.size) * (COMMON + 1), text.n_words)
    slot = np.full(1 << WORD_BITS, COMMON, np.int64)
    for class_ref, common, word_ref in refs:
        slot[common] = np.arange(COMMON)
        char = np.minimum(char, js_distance(classes, class_ref))
        counts = np.bincount(doc + slot[bins], minlength=text.size * (COMMON + 1)).reshape(text.size, COMMON + 1)
        word = np.minimum(word, js_distance(counts, word_ref))
        slot[common] = COMMON
    failed = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
    far = (out["n_words"] >= GUARD_WORDS) & ((char > CHAR_MOST) | (word > WORD_MOST))
    return out | {"base_failed": failed, "kept": ~failed & ~far, "char_distance": char, "word_distance": word}


RESULT = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, kept boolean, char_distance double, word_distance double")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id with RESULT for every row of ``docs`` (doc_id, text, lang).

    Null and empty texts have no words and fail; a null language is one of its own; equal rows give
    equal results; an empty table gives an empty result; other columns are ignored.
    """
    refs = references(docs)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                found = measures(part.column(1), refs)
                yield pa.record_batch([part.column(0), *map(pa.array, found.values())], names=["doc_id", *found])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(run, "doc_id bigint, " + RESULT)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, lang and others) that the rules keep, unchanged.

    Null and empty texts fail; a null language is one of its own; equal rows are all kept or all dropped;
    an empty table stays empty; other columns pass through whatever their names.
    """
    refs = references(docs)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                yield part.filter(pa.array(measures(part.column(part.schema.get_field_index("text")), refs)["kept"]))

    return docs.mapInArrow(run, docs.schema)
