"""Row filters of the retrieval layer, all as plain column expressions that reach the scan."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrove.functions.text import csv_values


def folder_bounds(folder: str) -> tuple[str, str] | None:
    """Half-open range of the paths under a folder ('0' follows '/'), or None for no filter."""
    bare = folder.strip().replace("\\", "/").strip("/ ")
    return (f"{bare}/", f"{bare}0") if bare else None


def in_folder(path: Column, folder: str) -> Column:
    """Range predicate; it is pushed to the Parquet scan as two comparisons."""
    b = folder_bounds(folder)
    return (path >= b[0]) & (path < b[1]) if b else F.lit(True)


def under_prefix(path: Column, folder: str) -> Column:
    prefix = folder.strip().replace("\\", "/").strip("/ ")
    return path.startswith(prefix + "/") if prefix else F.lit(True)


def has_tags(tags: Column, wanted: str) -> Column:
    """All of the comma-separated tags, compared exactly. Null tags hold none."""
    out = F.lit(True)
    for t in csv_values(wanted):
        out = out & F.coalesce(F.array_contains(tags, t), F.lit(False))
    return out


def has_status(status: Column, wanted: str) -> Column:
    """Any of the comma-separated values."""
    values = csv_values(wanted)
    return F.coalesce(status.isin(values), F.lit(False)) if values else F.lit(True)


def of_notes(rows: DataFrame, notes: DataFrame, tags: str = "", status: str = "", on: str = "rel_path") -> DataFrame:
    """Rows whose note passes the tag and status filters: a left semi join, or nothing at all without filters."""
    if not csv_values(tags) and not csv_values(status):
        return rows
    kept = notes.where(has_tags(F.col("tags"), tags) & has_status(F.col("status"), status)).select(on)
    return rows.join(kept, on, "left_semi")


def is_hidden(path: Column) -> Column:
    """Any component begins with a dot."""
    return F.exists(F.split(path, "/"), lambda p: p.startswith("."))


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Ignore patterns: ``dir/`` a folder from the root, with a slash the whole path (``*`` crosses slashes), else the base name."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.lit(False)
    for p in patterns:
        if p.endswith("/"):
            out = out | path.startswith(p.lstrip("/"))
        else:
            out = out | (path if "/" in p else name).rlike(java_glob(p.lstrip("/")))
    return out


def java_glob(pattern: str) -> str:
    """A shell pattern as a Java regex over the whole string."""
    body = fnmatch.translate(pattern).replace("(?s:", "", 1)
    body = body[: body.rindex(")")]
    return rf"(?s)\A(?:{body})\z"


def skip_reason(path: Column, size: Column, index_flag: Column, patterns: list[str], max_bytes: int) -> Column:
    """Why a note stays out of the index, the first rule that holds, or null."""
    too_large = F.concat(F.lit("too large ("), (size / 1024).cast("bigint").cast("string"), F.lit(f" KB > {max_bytes // 1024} KB)"))
    return (
        F.when(is_ignored(path, patterns), F.lit("ignored"))
        .when(size > max_bytes, too_large)
        .when(F.lower(index_flag).isin("false", "no", "0", "off"), F.lit("index: false"))
    )


def is_hub_name(path: Column) -> Column:
    """Hubs by name: readme, index, inbox, hub, anything ending in index or -hub, anything with overview."""
    name = F.regexp_replace(F.lower(F.element_at(F.split(path, "/"), -1)), r"\.md$", "")
    return name.isin("readme", "index", "inbox", "hub") | name.endswith("index") | name.endswith("-hub") | F.contains(name, F.lit("overview"))


def recent(notes: DataFrame, cutoff: float | None = None, folder: str = "", limit: int = 20) -> DataFrame:
    """Newest notes first, both keys descending. A null mtime is never recent."""
    rows = notes.where(under_prefix(F.col("rel_path"), folder) & F.col("mtime").isNotNull())
    if cutoff is not None:
        rows = rows.where(F.col("mtime") >= cutoff)
    return rows.orderBy(F.desc("mtime"), F.desc("rel_path")).limit(max(1, min(limit, 200)))


def walk_key(path: Column) -> Column:
    """Sort key of a directory walk that lists a folder's files before its sub-folders."""
    parts = F.split(path, "/")
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i == F.size(parts) - 1, F.lit("0")).otherwise(F.lit("1")), p)), "\x01")
