"""A folder of markdown notes as a table.

Spark's file sources skip names that begin with ``_``, which are ordinary notes here, so paths are listed on the driver
(names only) and the files are read, decoded and hashed by the tasks.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORE_FILE = ".vaultignore"
NOTES = "rel_path string, walk_ord bigint, mtime double, size_bytes bigint, content_hash string, text string, read_error string"


def walk_notes(root: str | Path) -> Iterator[str]:
    """Paths of visible notes relative to ``root``, a folder's files before its sub-folders, each sorted. Whatever begins with a dot is hidden."""
    root = Path(root)
    for here, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if not f.startswith("."))
        base = Path(here).relative_to(root)
        yield from ((base / n).as_posix() for n in sorted(names) if n.endswith(".md") and not n.startswith("."))


def walk_files(root: str | Path) -> Iterator[str]:
    """Base names of all files outside hidden folders, lower case."""
    for _, folders, names in os.walk(root):
        folders[:] = [f for f in folders if not f.startswith(".")]
        yield from (n.lower() for n in names)


def ignore_patterns(root: str | Path) -> list[str]:
    """Patterns of the ignore file, without blanks and comments; [] where there is none."""
    path = Path(root) / IGNORE_FILE
    if not path.is_file():
        return []
    lines = (x.strip() for x in path.read_text(encoding="utf-8").splitlines())
    return [x for x in lines if x and not x.startswith("#")]


def read_notes(spark: SparkSession, root: str | Path, paths: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """One row per note. Bytes that are no UTF-8 become replacement characters; an unreadable file keeps its row, with an error and null content."""
    base = str(Path(root).resolve())
    listed = list(walk_notes(root)) if paths is None else paths
    names = spark.createDataFrame(list(enumerate(listed)), "walk_ord bigint, rel_path string")
    names = names.repartition(partitions or max(1, min(len(listed) // 200 + 1, spark.sparkContext.defaultParallelism * 4)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for at, rel in zip(batch["walk_ord"], batch["rel_path"], strict=True):
                full = os.path.join(base, rel)
                try:
                    with open(full, "rb") as f:
                        raw = f.read()
                    rows.append((rel, at, os.stat(full).st_mtime, len(raw), hashlib.sha256(raw).hexdigest(), raw.decode("utf-8", errors="replace"), None))
                except OSError as e:
                    rows.append((rel, at, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NOTES.split(", ")])

    return names.mapInPandas(read, NOTES)


def attachments(spark: SparkSession, root: str | Path) -> DataFrame:
    """``(name_lower)`` of every file outside hidden folders."""
    return spark.createDataFrame([(n,) for n in sorted(set(walk_files(root)))], "name_lower string")


def decode(content: Column) -> Column:
    """Binary file content as text, as ``read_notes`` decodes it."""
    return F.make_valid_utf8(content.cast("string"))


def read_golden(spark: SparkSession, path: str | Path) -> DataFrame:
    """``(query_id, query, expected)`` from a JSON list; every item needs a query and expectations."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, list) or not all(isinstance(x, dict) and x.get("query") and x.get("expected") for x in data):
        raise ValueError("golden set: a JSON list of objects with 'query' and 'expected' is needed")
    return spark.createDataFrame([(n, x["query"], list(x["expected"])) for n, x in enumerate(data)], "query_id bigint, query string, expected array<string>")
