"""Rewriting links after a move."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.functions.markdown import WIKILINK, Outline, hide_code


def new_target(old: str, new_path: str, stem_unique: bool) -> str:
    """The whole new path where the link used a path or the name alone would be ambiguous, else the name."""
    bare = new_path.removesuffix(".md")
    return bare if "/" in old or not stem_unique else bare.rsplit("/", 1)[-1]


def rewrite_text(text: str, moved: set[str], new_path: str, stem_unique: bool) -> tuple[str, int]:
    """``text`` with every link whose target is in ``moved`` pointed at ``new_path``, and their number.

    Embeds, anchors and aliases stay; fenced and inline code is not touched; lines are split at \\n alone, so a CR stays.
    """
    lines = text.split("\n")
    total = 0
    for n, code in enumerate(Outline(text, lines).code_flags()):
        if code or "[[" not in lines[n]:
            continue
        out, at = [], 0
        for m in WIKILINK.finditer(hide_code(lines[n])):
            target = m["target"].strip()
            if target in moved:
                own = WIKILINK.match(lines[n], m.start())
                out += [lines[n][at : m.start()], f"{own['embed']}[[{new_target(target, new_path, stem_unique)}{own['anchor'] or ''}{own['alias'] or ''}]]"]
                at = m.end()
                total += 1
        if out:
            lines[n] = "".join(out) + lines[n][at:]
    return "\n".join(lines), total


def rewrite_moved(notes: DataFrame, resolution: DataFrame, old_path: str, new_path: str, stem_unique: bool) -> DataFrame:
    """``(rel_path, text, n)`` of the notes that change. ``resolution`` has ``target`` and ``resolved`` as before the move.

    The spellings that led to one note are few (they are collected); notes without any of them never leave the JVM.
    """
    moved = {r.target.strip() for r in resolution.where(F.col("resolved") == old_path).select("target").distinct().collect()}
    if not moved:
        return notes.select("rel_path", "text", F.lit(0).alias("n")).limit(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *rewrite_text(text, moved, new_path, stem_unique)) for path, text in zip(batch["rel_path"], batch["text"], strict=True)]
            yield pd.DataFrame([r for r in rows if r[2]], columns=["rel_path", "text", "n"])

    return notes.where(F.contains("text", F.lit("[["))).select("rel_path", "text").mapInPandas(run, "rel_path string, text string, n int")
