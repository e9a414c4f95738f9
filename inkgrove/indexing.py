"""Building and updating an index of a folder: scan, diff, parse, chunk, embed, merge, publish.

An index is a folder of versions; ``CURRENT`` names the published one and is replaced atomically after a version is
complete, fingerprint included, so an interrupted run changes nothing. Tables of a version: notes, chunks, postings
(sorted by term, so that a query's terms prune row groups), sizes, vectors.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from hashlib import md5
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove.config import EngineConfig
from inkgrove.operators import filters, keyword, snapshots
from inkgrove.operators.notes import chunk_id, chunk_notes, parse_notes
from inkgrove.sources import vault

SCHEMA_VERSION = 1
TABLES = ("notes", "chunks", "postings", "sizes", "vectors")
Embedder = Callable[[list[str]], np.ndarray]


def bag_embedder(dim: int = 1024) -> Embedder:
    """Deterministic stand-in for a model: counts of lower-cased words by md5 bucket, unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for k, t in enumerate(texts):
            for w in t.lower().split():
                out[k, int(md5(w.encode()).hexdigest(), 16) % dim] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


@contextmanager
def single_writer(index: Path) -> Iterator[bool]:
    """True for the one process that holds the index's lock; never waits."""
    index.mkdir(parents=True, exist_ok=True)
    with open(index / "LOCK", "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            yield False
            return
        try:
            yield True
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


class Index:
    """The published version of an index folder."""

    def __init__(self, spark: SparkSession, folder: str | Path, config: EngineConfig | None = None):
        self.spark, self.folder, self.config = spark, Path(folder).resolve(), config or EngineConfig()

    def manifest(self) -> dict | None:
        path = self.folder / "CURRENT"
        return json.loads(path.read_text()) if path.is_file() else None

    def table(self, name: str) -> DataFrame:
        m = self.manifest()
        if m is None:
            raise FileNotFoundError(f"no index in {self.folder}")
        return self.spark.read.parquet(f"file://{self.folder}/{m['version']}/{name}")

    def build(self, root: str | Path, embed: Embedder | None = None, rebuild: bool = False) -> dict:
        """One pass: ``{indexed, skipped, unchanged, deleted, seconds}``, or ``{locked: True}`` while another pass runs."""
        with single_writer(self.folder) as mine:
            return self._build(Path(root).resolve(), embed or bag_embedder(self.config.embedding_dim), rebuild) if mine else {"locked": True}

    def build_until_clean(self, root: str | Path, embed: Embedder | None = None, rebuild: bool = False, passes: int = 10) -> dict:
        """Repeats while the dirty flag is raised; the flag stays if another process holds the lock."""
        flag, stats = self.folder / "DIRTY", {}
        for _ in range(passes):
            raised = flag.exists()
            if raised:
                flag.unlink()
            stats, rebuild = self.build(root, embed, rebuild), False
            if stats.get("locked"):
                if raised:
                    flag.touch()
                break
            if not flag.exists():
                break
        return stats

    def _build(self, root: Path, embed: Embedder, rebuild: bool) -> dict:
        began = time.time()
        ignore = vault.ignore_patterns(root)
        fingerprint, last = self.config.fingerprint(ignore), self.manifest()
        fresh = rebuild or last is None or last["schema"] != SCHEMA_VERSION
        version = f"v-{uuid.uuid4().hex[:12]}"
        out = f"file://{self.folder}/{version}"
        vault.read_notes(self.spark, root).write.parquet(f"{out}/scan")
        scan = self.spark.read.parquet(f"{out}/scan")
        old = None if fresh else self.table("notes")
        before = old if old is not None else scan.select("rel_path", "content_hash", "mtime").limit(0)
        changes = snapshots.change_kinds(scan, before, config_changed=not fresh and last["fingerprint"] != fingerprint)
        changes.write.parquet(f"{out}/changes")
        changes = self.spark.read.parquet(f"{out}/changes")
        touched = changes.where("change <> 'unchanged'")
        readable = scan.join(changes.where("change in ('new', 'changed')"), "rel_path", "left_semi").where("text is not null")

        facts = parse_notes(readable).withColumnRenamed("key", "rel_path")
        reason = filters.skip_reason(F.col("rel_path"), F.col("size_bytes"), F.col("index_flag"), ignore, self.config.max_file_bytes)
        notes = readable.join(facts, "rel_path").select("rel_path", "title", "summary", "tags", "status", "mtime", "content_hash", reason.alias("skip_reason"))
        kept = readable.join(notes.where("skip_reason is null"), "rel_path", "left_semi")
        chunks = chunk_notes(kept, self.config).select(chunk_id(F.col("key"), F.col("ordinal")).alias("id"), F.col("key").alias("rel_path"), "ordinal", "title", "heading", "summary", "chunk_text", "line_start", "line_end")
        self._publish(out, "chunks", chunks, old is not None, touched, "rel_path")
        new_chunks = self.spark.read.parquet(f"{out}/chunks").join(touched.select("rel_path"), "rel_path", "left_semi")
        counts = new_chunks.groupBy("rel_path").agg(F.count("*").cast("int").alias("chunk_count"))
        self._publish(out, "notes", notes.join(counts, "rel_path", "left").fillna(0, ["chunk_count"]), old is not None, touched, "rel_path")

        tokenised = keyword.field_tokens(new_chunks)
        gone = self.table("chunks").join(touched.select("rel_path"), "rel_path", "left_semi").select("id") if old is not None else None
        self._publish(out, "postings", keyword.postings(tokenised), old is not None, gone, "id", sort="term")
        self._publish(out, "sizes", keyword.sizes(tokenised), old is not None, gone, "id")

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def vector(texts: pd.Series) -> pd.Series:
            return pd.Series(list(embed(texts.tolist())))

        document = F.concat(F.lit("Document: "), F.col("title"), F.lit(" > "), F.col("heading"), F.lit("\n"), F.col("chunk_text"))
        self._publish(out, "vectors", new_chunks.select("id", "rel_path", vector(document).alias("embedding")), old is not None, gone, "id")

        kinds = {r.change: r.n for r in snapshots.run_counts(changes).collect()}
        skipped = self.spark.read.parquet(f"{out}/notes").join(touched.select("rel_path"), "rel_path", "left_semi").where("skip_reason is not null").count()
        pointer = self.folder / f"CURRENT.{version}"
        pointer.write_text(json.dumps({"schema": SCHEMA_VERSION, "fingerprint": fingerprint, "version": version, "at": time.time()}))
        os.replace(pointer, self.folder / "CURRENT")
        self._sweep(version, last and last["version"])
        fresh_notes = kinds.get("new", 0) + kinds.get("changed", 0)
        return {"indexed": fresh_notes - skipped, "skipped": skipped, "unchanged": kinds.get("unchanged", 0), "deleted": kinds.get("deleted", 0), "seconds": round(time.time() - began, 2)}

    def _sweep(self, *keep: str | None) -> None:
        """Removes versions but the published one and the one before, which a running query may still read; also what passes left that died."""
        for old in self.folder.glob("v-*"):
            if old.name not in keep:
                shutil.rmtree(old, ignore_errors=True)
        for pointer in self.folder.glob("CURRENT.v-*"):
            pointer.unlink(missing_ok=True)

    def _publish(self, out: str, name: str, new: DataFrame, merge: bool, gone: DataFrame | None, on: str, sort: str | None = None) -> None:
        """Writes a table: what was there and isn't touched, and the new rows."""
        rows = snapshots.merge(self.table(name), new, gone, on) if merge else new
        if sort:
            rows = rows.repartitionByRange(sort).sortWithinPartitions(sort)
        rows.write.parquet(f"{out}/{name}")

    def freshness(self, root: str | Path) -> tuple[list[str], list[str]]:
        """Notes not in the index as they are on disk, and indexed ones that are gone. Only names and times are read."""
        disk = {rel: os.stat(Path(root) / rel).st_mtime for rel in vault.walk_notes(root)}
        listing = self.spark.createDataFrame(list(disk.items()), "rel_path string, mtime double")
        state = snapshots.freshness(listing, self.table("notes")).collect()
        return sorted(r.rel_path for r in state if r.state == "pending"), sorted(r.rel_path for r in state if r.state == "deleted")
