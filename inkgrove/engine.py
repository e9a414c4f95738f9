"""The public surface: search, read, list, backlinks, recent, write, append, edit, move, lint, status, evaluate."""

from __future__ import annotations

import os
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove import editing
from inkgrove.config import EngineConfig
from inkgrove.editing import NoteError
from inkgrove.functions.markdown import Outline
from inkgrove.indexing import Embedder, Index, bag_embedder
from inkgrove.operators import evaluate as judging
from inkgrove.operators import filters, hybrid, keyword, links, vectors
from inkgrove.operators.notes import extract_links
from inkgrove.operators.rewrite import rewrite_moved
from inkgrove.sources import vault

CACHE_SIZE, CACHE_SECONDS = 128, 300
Reranker = Callable[[str, list[str]], list[float]]


@dataclass
class Hit:
    chunk_id: int
    rel_path: str
    title: str
    heading: str
    chunk_text: str
    line_start: int
    line_end: int
    score: float
    reranked: bool


@dataclass
class Outcome:
    hits: list[Hit]
    reranked: bool = False
    best_rejected: float | None = None
    warnings: list[str] = field(default_factory=list)

    def text(self, query: str, floor: float | None = None) -> str:
        """The outcome as markdown, with what was missing."""
        if not self.hits:
            why = f"nothing relevant enough for {query!r}: best score {self.best_rejected:.2f} is under {floor}" if self.best_rejected is not None else f"nothing matches {query!r}"
            return "\n".join([why, *self.warnings])
        parts = []
        for n, h in enumerate(self.hits, 1):
            score = f"score {h.score:.3f}" if h.reranked else f"fused {h.score:.4f}"
            body = h.chunk_text.strip()
            parts.append(f"{n}. {h.rel_path}:{h.line_start}-{h.line_end} {h.heading} ({score})\n\n{body[:400] + '...' if len(body) > 400 else body}")
        return "\n\n".join([*parts, *self.warnings])


@dataclass
class Page:
    rel_path: str
    text: str
    first: int
    last: int
    total_lines: int
    remaining: int
    sha: str


class Engine:
    """One collection of notes and its index. ``embed`` turns texts into vectors, ``rerank`` scores documents for a query; both may fail."""

    def __init__(self, spark: SparkSession, root: str | Path, index: str | Path, config: EngineConfig | None = None, embed: Embedder | None = None, rerank: Reranker | None = None, reindex: bool = True):
        """With ``reindex`` every change of a note is indexed in the background, once an index has been built."""
        self.spark, self.root, self.config = spark, Path(root).resolve(), config or EngineConfig()
        self.index = Index(spark, index, self.config)
        self.embed, self.rerank = embed or bag_embedder(self.config.embedding_dim), rerank
        self.errors: dict[str, str] = {}
        self._cache: OrderedDict[tuple, tuple[float, Outcome]] = OrderedDict()
        self.reindex, self._worker = reindex, None

    # index

    def build(self, rebuild: bool = False) -> dict:
        """Passes until nothing is dirty; one that runs in the background is waited for."""
        self.settle()
        stats = self.index.build_until_clean(self.root, self.embed, rebuild)
        self._cache.clear()
        return stats

    def settle(self, timeout: float | None = None) -> bool:
        """Waits for indexing in the background; true if none is left."""
        if self._worker is not None:
            self._worker.join(timeout)
        return self._worker is None or not self._worker.is_alive()

    def _touch(self) -> None:
        """Notes changed: cached answers go, the flag is raised, and one worker at a time takes it down again."""
        self._cache.clear()
        if self.index.manifest() is None:
            return
        (self.index.folder / "DIRTY").touch()
        if self.reindex and (self._worker is None or not self._worker.is_alive()):
            self._worker = threading.Thread(target=self._index_changes, name="inkgrove-indexer", daemon=True)
            self._worker.start()

    def _index_changes(self) -> None:
        flag = self.index.folder / "DIRTY"
        try:
            while flag.exists() and not self.index.build_until_clean(self.root, self.embed).get("locked"):
                pass
            self._cache.clear()
            self.errors.pop("indexer", None)
        except Exception as e:
            self.errors["indexer"] = f"{type(e).__name__}: {e}"
            flag.touch()

    def _names(self) -> list[str]:
        return list(vault.walk_notes(self.root))

    def _notes(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in self._names()], "rel_path string")

    def _texts(self) -> DataFrame:
        return vault.read_notes(self.spark, self.root).where("text is not null")

    def _links(self) -> DataFrame:
        """Links of all notes; lines that are blobs are dropped before, so a pasted dump is no link."""
        blob = self.config.max_line_chars
        text = F.regexp_replace("text", rf"(?m)^.{{{blob + 1},}}$", "")
        return extract_links(self._texts().select("rel_path", text.alias("text"))).withColumnRenamed("key", "src_rel")

    # search

    def search(self, query: str, limit: int = 5, mode: str = "hybrid", folder: str = "", tags: str = "", status: str = "") -> Outcome:
        """Keyword, semantic or hybrid retrieval. A failing model degrades the answer, says so, and is not cached."""
        limit, mode = max(1, min(limit, 15)), mode if mode in ("keyword", "semantic", "hybrid") else "hybrid"
        manifest = self.index.manifest()
        key = (query.lower(), limit, mode, folder, tags, status, manifest and manifest["version"])
        if key in self._cache and time.time() - self._cache[key][0] < CACHE_SECONDS:
            self._cache.move_to_end(key)
            return self._cache[key][1]
        outcome = self._search(query, limit, mode, folder, tags, status)
        if not outcome.warnings:
            self._cache[key] = (time.time(), outcome)
            while len(self._cache) > CACHE_SIZE:
                self._cache.popitem(last=False)
        return outcome

    def _search(self, query: str, limit: int, mode: str, folder: str, tags: str, status: str) -> Outcome:
        chunks = self.index.table("chunks")
        inside = filters.of_notes(chunks.where(filters.in_folder(F.col("rel_path"), folder)), self.index.table("notes"), tags, status)
        whole = inside is chunks or not (filters.folder_bounds(folder) or filters.csv_values(tags) or filters.csv_values(status))
        asked, fetch, warnings, lists = self.spark.createDataFrame([(0, query)], "query_id bigint, query string"), limit * 6, [], []
        if mode != "semantic":
            phrases = keyword.query_phrases(asked)
            terms = [r.term for r in phrases.select(F.explode("phrase").alias("term")).distinct().collect()]  # of one query
            freq = keyword.frequencies(self.index.table("postings").where(F.col("term").isin(terms)), phrases, self.config.weights)
            lists.append(keyword.top_per_query(keyword.score(freq, self.index.table("sizes"), phrases, None if whole else inside), fetch))
        if mode != "keyword":
            try:
                vector = [float(x) for x in np.asarray(self.embed([query]))[0]]
                rows = self.index.table("vectors") if whole else self.index.table("vectors").join(inside.select("id"), "id", "left_semi")
                near = vectors.nearest(rows, vector, fetch, len(vector)).withColumn("query_id", F.lit(0).cast("bigint"))
                lists.append(keyword.top_per_query(near, fetch, "distance", ascending=True))
                self.errors.pop("embedder", None)
            except Exception as e:
                self.errors["embedder"] = f"{type(e).__name__}: {e}"
                warnings.append(f"semantic search is unavailable ({self.errors['embedder']})")
        if not lists:
            return Outcome([], warnings=warnings)
        pool = hybrid.hydrate(hybrid.rrf(lists, self.config.rrf_k, max(4 * limit, 16)), chunks).orderBy("rank").collect()
        scored, reranked, rejected = [(r, float(r.rrf)) for r in pool], False, None
        if mode == "hybrid" and self.rerank and pool:
            few = pool[: max(limit, self.config.rerank_pool)]
            try:
                got = self.rerank(query, [f"Title: {r.title} > {r.heading}\n{r.chunk_text[: self.config.rerank_chars]}" for r in few])
                scored, reranked = sorted(zip(few, map(float, got), strict=True), key=lambda x: -x[1]), True
                self.errors.pop("reranker", None)
            except Exception as e:
                self.errors["reranker"] = f"{type(e).__name__}: {e}"
                warnings.append(f"reranking is unavailable ({self.errors['reranker']})")
        if reranked and self.config.min_score is not None:
            kept = [x for x in scored if x[1] >= self.config.min_score]
            rejected = scored[0][1] if scored and not kept else None
            scored = kept
        hits, seen = [], {}
        for r, s in scored:
            seen[r.rel_path] = seen.get(r.rel_path, 0) + 1
            if seen[r.rel_path] <= self.config.per_note and len(hits) < limit:
                hits.append(Hit(r.id, r.rel_path, r.title, r.heading, r.chunk_text, r.line_start, r.line_end, s, reranked))
        return Outcome(hits, reranked, rejected, warnings)

    def evaluate(self, golden: list[dict], k: int = 5, modes: tuple[str, ...] = ("keyword", "semantic", "hybrid")) -> DataFrame:
        """One row per mode: hit@k, recall@k, MRR, mean and p95 latency; one chunk a note, no floor."""
        strict = Engine(self.spark, self.root, self.index.folder, EngineConfig(**{**self.config.__dict__, "per_note": 1, "min_score": None}), self.embed, self.rerank, reindex=False)
        out = None
        wanted = self.spark.createDataFrame([(n, g["expected"]) for n, g in enumerate(golden)], "query_id bigint, expected array<string>")
        for mode in modes:
            strict._search(golden[0]["query"] if golden else "warm up", k, mode, "", "", "")
            rows, took = [], []
            for n, g in enumerate(golden):
                began = time.time()
                rows += [(n, at, h.rel_path) for at, h in enumerate(strict._search(g["query"], k, mode, "", "", "").hits, 1)]
                took.append((mode, 1000 * (time.time() - began)))
            hits = self.spark.createDataFrame(rows, "query_id bigint, rank int, rel_path string")
            times = judging.latency_stats(self.spark.createDataFrame(took, "mode string, ms double"), "ms", "mode").drop("n")
            row = judging.summary(judging.judged(hits, wanted, k)).withColumn("mode", F.lit(mode)).join(times, "mode")
            out = row if out is None else out.unionByName(row)
        return out

    # reading

    def read(self, note: str, heading: str = "", start_line: int = 1, max_chars: int = 0) -> Page:
        """A page of a note or of one section: lines while they fit; a first line over the page size is cut."""
        full, rel = editing.locate(self.root, note, self._names(), True)
        text = editing.read_text(full)
        size = max(500, min(max_chars or self.config.read_page, 50_000))
        o = Outline(text)
        first, last = 0, len(o.lines)
        if heading:
            span = o.section(heading)
            if span is None:
                raise NoteError("no such heading; there are: " + "; ".join(f"{'#' * level} {t}" for _, level, t in o.headings[:60]))
            first, last = span
        first = max(first, start_line - 1)
        if first >= last:
            raise NoteError(f"line {start_line} is past the end ({len(o.lines)} lines)")
        end, used = first, 0
        while end < last and (end == first or used + len(o.lines[end]) + 1 <= size):
            used += len(o.lines[end]) + 1
            end += 1
        body = "\n".join(o.lines[first:end])
        if end == first + 1 and len(o.lines[first]) > size:
            body = o.lines[first][:size] + f" ... [{len(o.lines[first]) - size} more characters in this line]"
        return Page(rel, body, first + 1, end, len(o.lines), sum(len(x) + 1 for x in o.lines[end:last]), editing.digest(full)[:16])

    def list(self, folder: str = "", limit: int = 200) -> tuple[int, list[tuple[str, str]]]:
        """The number of notes in a folder and the first of them, with titles."""
        limit, bare = max(1, min(limit, 1000)), folder.strip().replace("\\", "/").strip("/")
        if bare and not ((self.root / bare).resolve().is_relative_to(self.root) and (self.root / bare).is_dir()):
            raise NoteError(f"folder {folder!r} was not found")
        names = [n for n in self._names() if not bare or n.startswith(bare + "/")]
        shown = names[:limit]
        titles = {}
        if self.index.manifest():
            titles = {r.rel_path: r.title for r in self.index.table("notes").where(F.col("rel_path").isin(shown)).select("rel_path", "title").collect()}
        return len(names), [(n, titles.get(n) or Path(n).stem) for n in shown]

    def backlinks(self, note: str, limit: int = 50) -> list[tuple[str, int, str]]:
        """Note, line and the line's text for each line that links to ``note``, in walking order."""
        _, rel = editing.locate(self.root, note, self._names(), True)
        found = links.backlinks(self._links(), self._notes()).where(F.col("rel_path") == rel)
        rows = found.withColumn("walk", filters.walk_key(F.col("src_rel"))).orderBy("walk", "line_no").limit(limit).collect()
        return [(r.src_rel, r.line_no, editing.read_text(self.root / r.src_rel).splitlines()[r.line_no - 1].strip()[:200]) for r in rows]

    def recent(self, limit: int = 20, folder: str = "", days: int = 0) -> list[tuple[str, float]]:
        rows = self.spark.createDataFrame([(n, os.stat(self.root / n).st_mtime) for n in self._names()], "rel_path string, mtime double")
        return [(r.rel_path, r.mtime) for r in filters.recent(rows, time.time() - days * 86_400 if days > 0 else None, folder, limit).collect()]

    # changing

    def link_report(self, rel: str, text: str) -> str:
        """What is wrong with the links of one note: none at all, no hub, broken ones."""
        targets = Outline(text).targets
        if not targets:
            return "no wikilinks"
        notes = self._notes()
        mine = self.spark.createDataFrame([(rel, n, 0, False, t, None, None) for n, t in enumerate(targets, 1)], "src_rel string, line_no int, ordinal int, embed boolean, target string, anchor string, alias string")
        root = [n for n in self._names() if n.lower() == "readme.md"]
        from_root = extract_links(vault.read_notes(self.spark, self.root, root).where("text is not null")).withColumnRenamed("key", "src_rel") if root else mine.limit(0)
        broken = sorted(r.target for r in links.broken_links(mine, notes, vault.attachments(self.spark, self.root)).collect())
        lonely = links.without_hub(mine.unionByName(from_root), notes).where(F.col("rel_path") == rel).count()
        problems = (["no link to a hub note"] if lonely else []) + ([f"broken links: {', '.join(broken)}"] if broken else [])
        return "; ".join(problems) or f"links fine ({len(targets)})"

    def _changed(self, rel: str, text: str) -> str:
        self._touch()
        return self.link_report(rel, text)

    def write(self, note: str, content: str, title: str = "", tags: str = "", overwrite: bool = False, expected_hash: str = "") -> str:
        full, rel = editing.locate(self.root, note, None, False)
        if full.exists():
            if not overwrite:
                raise NoteError(f"{rel} exists already")
            editing.guard(full, expected_hash)
            editing.back_up(self.root, rel)
        text = editing.with_frontmatter(content, title.strip() or full.stem, [t.strip().lstrip("#") for t in tags.split(",") if t.strip()])
        editing.write_atomically(full, text)
        return self._changed(rel, text)

    def append(self, note: str, content: str, heading: str = "", expected_hash: str = "") -> str:
        full, rel = editing.locate(self.root, note, self._names(), True)
        editing.guard(full, expected_hash)
        text = editing.stamp_updated(editing.append_text(editing.read_text(full), content, heading))
        editing.write_atomically(full, text)
        return self._changed(rel, text)

    def edit(self, note: str, old: str, new: str, replace_all: bool = False, expected_hash: str = "") -> tuple[int, str]:
        full, rel = editing.locate(self.root, note, self._names(), True)
        editing.guard(full, expected_hash)
        text, n = editing.replace_text(editing.read_text(full), old, new, replace_all)
        text = editing.stamp_updated(text)
        editing.write_atomically(full, text)
        return n, self._changed(rel, text)

    def move(self, source: str, target: str, update_links: bool = True) -> dict:
        """Renames a note and points links at it: ``{links, notes, failed}``."""
        full, old = editing.locate(self.root, source, self._names(), True)
        place, new = editing.locate(self.root, target, None, False)
        if place.exists():
            raise NoteError(f"{new} exists already")
        resolution = links.resolve_targets(self._links(), self._notes()).where(F.col("resolved") == old)
        resolution = self.spark.createDataFrame([(r.target, r.resolved) for r in resolution.collect()], "target string, resolved string") if update_links else None
        place.parent.mkdir(parents=True, exist_ok=True)
        os.replace(full, place)
        done = {"links": 0, "notes": 0, "failed": []}
        if resolution is not None:
            stem = Path(new).stem.lower()
            unique = sum(Path(n).stem.lower() == stem for n in self._names()) == 1
            for r in rewrite_moved(self._texts(), resolution, old, new, unique).toLocalIterator():
                try:
                    editing.write_atomically(self.root / r.rel_path, r.text)
                    done["links"] += r.n
                    done["notes"] += 1
                except OSError:
                    done["failed"].append(r.rel_path)
        self._touch()
        return done

    # hygiene

    def lint(self, folder: str = "") -> DataFrame:
        """Findings ``(kind, rel_path, detail)`` of notes in a folder; the graph is always that of all notes."""
        from inkgrove.operators.notes import parse_notes

        texts, notes = self._texts(), self._notes()
        facts = parse_notes(texts).select(F.col("key").alias("rel_path"), "front_lines", "status")
        none = F.lit(None).cast("string").alias("detail")
        extra = [
            facts.where("front_lines = 0").select(F.lit("no_frontmatter").alias("kind"), "rel_path", none),
            links.oversized(texts, "size_bytes", self.config.max_file_bytes).select(F.lit("oversized").alias("kind"), "rel_path", F.col("bytes").cast("string").alias("detail")),
            links.junk_lines(texts, "text", self.config.max_line_chars).select(F.lit("junk_line").alias("kind"), "rel_path", F.col("chars").cast("string").alias("detail")),
        ]
        findings = links.lint(self._links(), facts.select("rel_path", "status"), vault.attachments(self.spark, self.root), self.config.status_values, extra)
        return findings.join(notes, "rel_path", "left_semi").where(filters.under_prefix(F.col("rel_path"), folder))

    def status(self) -> dict:
        """Counts and health of the index."""
        manifest = self.index.manifest()
        if manifest is None:
            return {"health": "MISSING"}
        from inkgrove.indexing import SCHEMA_VERSION, single_writer

        if manifest["schema"] != SCHEMA_VERSION:
            return {"health": "OUTDATED SCHEMA"}
        with single_writer(self.index.folder) as free:
            busy = not free
        notes = self.index.table("notes")
        pending, deleted = self.index.freshness(self.root)
        chunks, vecs = self.index.table("chunks").count(), self.index.table("vectors").count()
        health = "INDEXING" if busy else "STALE" if pending or deleted else "INCONSISTENT" if chunks != vecs else "OK"
        skipped = [(r.rel_path, r.skip_reason) for r in notes.where("skip_reason is not null").orderBy("rel_path").limit(10).collect()]
        return {
            "health": health, "notes": notes.where("skip_reason is null").count(), "chunks": chunks, "vectors": vecs, "pending": pending, "deleted": deleted,
            "skipped": skipped, "errors": dict(self.errors), "cache": len(self._cache), "indexed_at": manifest["at"],
        }
