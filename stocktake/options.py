"""Options that all queries share."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    # fixed values: the documented defaults
    include_hidden: bool = False
    old_file_age_days: int = 180
    large_file_threshold: int = 1_000_000_000
    duplicate_candidate_threshold: int = 100_000_000
    verification_byte_limit: int = 20_000_000_000
    max_verification_files: int = 1000
    duplicate_candidate_cap: int = 5000
    ranked_limit: int = 500
    children_per_directory: int = 200
    retained_items: int = 25_000
    exclude_enabled: bool = False
    excluded_names: tuple[str, ...] = ()
    excluded_prefixes: tuple[str, ...] = ()
