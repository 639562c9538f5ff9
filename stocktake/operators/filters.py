"""Filters over inventories, candidates and type tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stocktake.functions import paths as P
from stocktake.operators.joins import joined, kept

SIZE_PRESETS = {"all": 0, "100MB": 100_000_000, "1GB": 1_000_000_000, "10GB": 10_000_000_000}


def filter_hidden(inv: DataFrame, include_hidden: bool = False, root: str = "/") -> DataFrame:
    """Without entries marked hidden, or with a component below the root that begins with a dot (hidden directories hide what they hold)."""
    if include_hidden:
        return inv
    marked = F.coalesce("is_hidden", F.lit(False)) if "is_hidden" in inv.columns else F.lit(False)
    hidden = (marked & (F.col("path") != root)) | F.exists(F.split(P.below(F.col("path"), root), "/"), lambda part: part.startswith("."))
    return inv.filter(~hidden)


def filter_excluded(inv: DataFrame, names=(), prefixes=(), home: str = "/home", root: str = "/") -> DataFrame:
    """Without entries that bear an excluded name (in its own case) or lie under one below the root, or lie at or under an excluded prefix; the root stays."""
    out = F.lit(False)
    if names:
        below = F.col("path") if root == "/" and "" not in names else P.below(F.col("path"), root)
        out = reduce(Column.__or__, [F.contains(F.concat(F.lit("/"), below, F.lit("/")), F.lit(f"/{n}/")) for n in names if "/" not in n], out)
    for p in prefixes:
        out = out | P.at_or_under(F.col("path"), home + p[1:] if p.startswith("~") else p)
    return inv.filter(~out | (F.col("path") == root))


def split_exclusions(entries) -> tuple[list[str], list[str]]:
    """(names, prefixes) of one flat list."""
    return [e for e in entries if e[:1] not in "~/"], [e for e in entries if e and e[0] in "~/"]


def filter_empty_other(inv: DataFrame) -> DataFrame:
    return inv.filter(~((F.col("kind") == "other") & (P.display_size() == 0)))


def filter_size(df: DataFrame, preset: str | int) -> DataFrame:
    return df.filter(P.display_size() >= SIZE_PRESETS.get(preset, preset))


def matches(query: str, *columns: str) -> Column:
    """Every word of the query is in one of the columns, whatever the case; an empty query matches all.

    Words beyond ASCII are compared by Unicode's collation, for which letters and marks that are one character or several are the same.
    """
    def holds(column: str, word: str) -> Column:
        if word.isascii():
            return F.contains(F.lower(column), F.lit(word.lower()))
        return F.contains(F.collate(F.col(column), "UNICODE_CI"), F.collate(F.lit(word), "UNICODE_CI"))

    return reduce(lambda a, w: a & reduce(lambda x, c: x | holds(c, w), columns, F.lit(False)), query.split(), F.lit(True))


def search_items(df: DataFrame, query: str) -> DataFrame:
    return df.filter(matches(query, "name", "path"))


def filter_file_type(df: DataFrame, ext: str) -> DataFrame:
    """Files of one extension, with or without its dot; empty: files without one."""
    wanted = ext.lower().lstrip(".")
    own = P.extension_text(F.col("name"))
    if not wanted:
        return df.filter((F.col("kind") == "file") & (F.coalesce(own, F.lit("")) == ""))
    maybe = F.contains(F.lower("name"), F.lit(wanted)) if wanted.isascii() else F.lit(True)  # most names need not be taken apart; beyond ASCII case may depend on what stands beside a letter
    return df.filter((F.col("kind") == "file") & maybe & (own == wanted))


def filter_lane(candidates: DataFrame, lane: str) -> DataFrame:
    """all, verified (duplicates) or suggestions (the rest)."""
    verified = F.col("candidate_kind") == "verifiedDuplicate"
    return candidates if lane == "all" else candidates.filter(verified if lane == "verified" else ~verified)


def filter_candidates(candidates: DataFrame, query: str = "", size: str | int = 0, lane: str = "all", ignored: DataFrame | None = None) -> DataFrame:
    """Candidates of a lane, from a size on (by either size), that match the query, without the ignored ones; a table of either kind may be large."""
    least = SIZE_PRESETS.get(size, size)
    out = filter_lane(candidates, lane).filter((F.col("reclaimable_bytes") >= least) | (F.col("size") >= least)).filter(matches(query, "name", "path", "reason", "candidate_kind"))
    return joined(out, kept(ignored.select("candidate_id").distinct()), "candidate_id", "left_anti") if ignored is not None else out


def filter_types(types: DataFrame, query: str) -> DataFrame:
    """Rows of a type table that match. It is computed first, so that its few rows are asked and not every file below them."""
    return kept(types).filter(matches(query, "label", "category"))


def hardlink_filter(inv: DataFrame) -> DataFrame:
    """Regular files with one link."""
    return inv.filter((F.col("kind") == "file") & (F.col("nlink") <= 1))


def exclude_root(df: DataFrame, root: str) -> DataFrame:
    return df.filter(F.col("path") != root)
