"""Incremental runs: which files changed since a stored state, and pruning of that state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Part of the key of a state row: a new parser makes all older rows stale.
STATE_VERSION = "1"
KEYS = ["file", "version", "mtime_ms", "size"]


def split_by_state(listing: DataFrame, state: DataFrame | None, version: str = STATE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(files to parse, files whose stored result is used)."""
    now = listing.withColumn("version", F.lit(version))
    if state is None:
        return now, now.limit(0)
    known = state.select(*KEYS).distinct()
    return now.join(known, KEYS, "left_anti"), now.join(known, KEYS, "left_semi")


def prune(state: DataFrame, listing: DataFrame) -> DataFrame:
    """State rows of files that still exist, in or out of the window."""
    return state.join(listing.select("file").distinct(), "file", "left_semi")


def merged(state: DataFrame | None, listing: DataFrame, parsed: DataFrame) -> DataFrame:
    """The next state: kept rows of unchanged files, and rows for what was parsed (file, version, mtime_ms, size, ...)."""
    if state is None:
        return parsed
    fresh = parsed.select("file").distinct()
    return prune(state, listing).join(fresh, "file", "left_anti").unionByName(parsed)
