"""Spelling-independent paths and hashes, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgrove.functions.text import beyond_ascii, case_folded, composed


def _tidy(col: Column) -> Column:
    slashed = F.translate(col, "\\", "/")
    bare = F.regexp_replace(slashed, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(bare, r"^(\./)+", "")


def display_path(col: Column) -> Column:
    """Forward slashes, no leading ``./``, no surrounding blanks, composed accents, own letter case. Null stays null."""
    tidy = _tidy(col)
    return F.when(beyond_ascii(tidy), composed(tidy)).otherwise(tidy)


def path_key(col: Column) -> Column:
    """``display_path`` without letter case: equal for all spellings of one path. Null stays null."""
    tidy = _tidy(col)
    return F.when(beyond_ascii(tidy), composed(case_folded(composed(tidy)))).otherwise(F.lower(tidy))


def hash_key(col: Column) -> Column:
    """A content hash without letter case and without a prefix naming the algorithm (``sha256:`` and the like)."""
    bare = F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))
    return F.nullif(F.regexp_replace(bare, r"^[a-z][a-z0-9_-]*[:=]", ""), F.lit(""))
