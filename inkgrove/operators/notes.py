"""Parsing and chunking of notes: a text column in, outline facts or chunks out, in one Arrow pass per operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrove.config import EngineConfig
from inkgrove.functions.chunker import chunk_note, paragraphs
from inkgrove.functions.markdown import Outline
from inkgrove.runtime import spread

FACTS = "key string, title string, summary string, tags array<string>, status string, front_lines int, lines int, index_flag string, targets array<string>, headings array<string>"
CHUNKS = "key string, ordinal int, title string, heading string, summary string, chunk_text string, line_start int, line_end int"
LINKS = "key string, line_no int, ordinal int, embed boolean, target string, anchor string, alias string"
HEADINGS = "key string, line_no int, level int, heading string"
PARAGRAPHS = "key string, line_start int, line_end int, chars int"


def stem(path: Column) -> Column:
    """Base name without ``.md``."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")


def _keyed(df: DataFrame, key: str, text: str, extra: dict[str, Column] | None = None) -> DataFrame:
    return spread(df.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), *[c.alias(n) for n, c in (extra or {}).items()]))


def _rows(df: DataFrame, schema: str, each) -> DataFrame:
    """``each(row) -> iterable of tuples`` over Arrow batches."""
    names = [c.strip().split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([x for row in batch.itertuples(index=False) for x in each(row)], columns=names)

    return df.mapInPandas(run, schema)


def parse_notes(df: DataFrame, key: str = "rel_path", text: str = "text", fallback: str | None = None) -> DataFrame:
    """Facts of each note: title, summary, tags, status, frontmatter length, link targets, headings. Null texts give no row."""
    keyed = _keyed(df, key, text, {"fallback": F.col(fallback) if fallback else stem(F.col(key).cast("string"))})

    def each(row):
        o = Outline(row.text)
        yield row.key, o.title(row.fallback or ""), o.summary(), o.tags, o.status, o.front, len(o.lines), o.index_flag, o.targets, [f"{'#' * level} {t}" for _, level, t in o.headings]

    return _rows(keyed, FACTS, each)


def chunk_notes(df: DataFrame, config: EngineConfig | None = None, key: str = "rel_path", text: str = "text") -> DataFrame:
    """Chunks of each note, numbered in order of their lines. Null and empty notes give none."""
    c = config or EngineConfig()
    keyed = _keyed(df, key, text, {"fallback": stem(F.col(key).cast("string"))})

    def each(row):
        o = Outline(row.text)
        title, summary = o.title(row.fallback or ""), o.summary()
        for n, x in enumerate(chunk_note(o, c.chunk_limit, c.min_chunk_chars, c.max_line_chars)):
            yield row.key, n, title, x.heading, summary, x.text, x.line_start, x.line_end

    return _rows(keyed, CHUNKS, each)


def extract_links(df: DataFrame, key: str = "rel_path", text: str = "text") -> DataFrame:
    """Wikilinks outside code, with line (from 1) and place in the line (from 0). Notes without ``[[`` never leave the JVM."""

    def each(row):
        last, at = -1, 0
        for x in Outline(row.text).links:
            at = at + 1 if x.line == last else 0
            last = x.line
            yield row.key, x.line + 1, at, x.embed, x.target.strip(), x.anchor, x.alias

    return _rows(_keyed(df.where(F.contains(F.col(text), F.lit("[["))), key, text), LINKS, each)


def extract_headings(df: DataFrame, key: str = "rel_path", text: str = "text", max_level: int = 6) -> DataFrame:
    """Headings outside code and frontmatter."""

    def each(row):
        for n, level, t in Outline(row.text).headings:
            if level <= max_level:
                yield row.key, n + 1, level, t

    return _rows(_keyed(df.where(F.contains(F.col(text), F.lit("#"))), key, text), HEADINGS, each)


def extract_paragraphs(df: DataFrame, key: str = "rel_path", text: str = "text") -> DataFrame:
    """Runs of non-blank lines with their extent and size."""

    def each(row):
        for run in paragraphs(list(enumerate(row.text.splitlines(), 1))):
            yield row.key, run[0][0], run[-1][0], sum(len(x) + 1 for _, x in run) - 1

    return _rows(_keyed(df, key, text), PARAGRAPHS, each)


def section_extents(df: DataFrame, heading: str, key: str = "rel_path", text: str = "text") -> DataFrame:
    """``(key, line_start, line_end)`` of the first section whose heading contains ``heading``; notes without one give no row."""

    def each(row):
        span = Outline(row.text).section(heading)
        if span:
            yield row.key, span[0] + 1, span[1]

    return _rows(_keyed(df.where(F.contains(F.lower(F.col(text)), F.lit(heading.strip().lstrip("#").strip().lower()))), key, text), "key string, line_start int, line_end int", each)


def chunk_id(key: Column, ordinal: Column) -> Column:
    """A stable id: the same note and ordinal give the same id in every run."""
    return F.xxhash64(key, ordinal.cast("int"))


