"""The link graph: resolution of wikilink targets, backlinks, hubs, broken links, orphans, lint findings.

Resolution is three equi-joins instead of a scan per target: the whole path, any tail of it that begins after a slash
(paths are exploded into at most depth tails), and the bare name. Distinct target spellings are resolved, not links, so a
target with a tenth of all links is resolved once; links then join that small result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrove.config import STATUS_VALUES
from inkgrove.functions.paths import path_key
from inkgrove.functions.text import strip
from inkgrove.operators.filters import is_hub_name, walk_key
from inkgrove.operators.hot import hot_join
from inkgrove.runtime import written


def target_key(target: Column) -> Column:
    """A target for comparison: spelling-independent and without ``.md``."""
    return F.regexp_replace(path_key(target), r"\.md$", "")


def note_keys(notes: DataFrame) -> DataFrame:
    """``(rel_path, noext, depth, walk)`` of each note path, once."""
    paths = notes.where(F.col("rel_path").isNotNull()).select("rel_path").distinct()
    return paths.select("rel_path", target_key(F.col("rel_path")).alias("noext"), (F.size(F.split("rel_path", "/")) - 1).alias("depth"), walk_key(F.col("rel_path")).alias("walk"))


def resolve_targets(targets: DataFrame, notes: DataFrame) -> DataFrame:
    """``(target, resolved, how)`` for the distinct ``target`` values; ``how`` is path, tail, name or null.

    Of paths that differ in case only the last in walking order counts, of tails the first, of names the shallowest, then
    the first by path.
    """
    keys = note_keys(notes)
    wanted = targets.where(F.col("target").isNotNull()).select("target").distinct().withColumn("key", target_key(F.col("target")))
    whole = keys.groupBy("noext").agg(F.max_by("rel_path", "walk").alias("by_path"))
    parts = F.split("noext", "/")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
    nested = keys.where(F.size(parts) > 1).select("rel_path", "walk", F.explode(tails).alias("tail"))
    by_tail = nested.where(F.contains("tail", F.lit("/"))).groupBy("tail").agg(F.min_by("rel_path", "walk").alias("by_tail"))
    by_name = keys.select(F.element_at(parts, -1).alias("name"), "rel_path", "depth").groupBy("name").agg(F.min_by("rel_path", F.struct("depth", "rel_path")).alias("by_name"))
    found = (
        wanted.join(whole, F.col("key") == F.col("noext"), "left")
        .join(by_tail, F.col("key") == F.col("tail"), "left")
        .join(by_name, (F.col("key") == F.col("name")) & ~F.contains("key", F.lit("/")), "left")
    )
    how = F.when(F.col("by_path").isNotNull(), "path").when(F.col("by_tail").isNotNull(), "tail").when(F.col("by_name").isNotNull(), "name")
    return found.select("target", F.coalesce("by_path", "by_tail", "by_name").alias("resolved"), how.alias("how"))


def attachment(target: Column) -> Column:
    """The target has an ending other than ``.md``: an image or another file."""
    name = F.element_at(F.split(strip(F.translate(target, "\\", "/")), "/"), -1)
    return name.rlike(r"(?s)^.+\.[^./]+$") & ~F.lower(name).endswith(".md")


def file_name(target: Column) -> Column:
    return F.lower(F.element_at(F.split(strip(F.translate(target, "\\", "/")), "/"), -1))


def resolved_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Links with ``src`` (the source's own path in the index) and ``resolved``. Links from unknown sources keep a null ``src``."""
    r = resolve_targets(links, notes)
    src = note_keys(notes).select(F.col("noext").alias("src_key"), F.col("rel_path").alias("src"))
    placed = hot_join(links.withColumn("src_key", target_key(F.col("src_rel"))), src, ["src_key"], "left").drop("src_key")
    return hot_join(placed, r, ["target"], "left")


def backlinks(links: DataFrame, notes: DataFrame) -> DataFrame:
    """``(rel_path, src_rel, line_no)``: one row per note and line that links to it, without links of a note to itself."""
    r = resolved_links(links, notes).where(F.col("resolved").isNotNull() & F.col("src").isNotNull() & (F.col("src") != F.col("resolved")))
    return r.select(F.col("resolved").alias("rel_path"), F.col("src").alias("src_rel"), "line_no").distinct()


def inbound(links: DataFrame, notes: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """``(rel_path, n)``: links into each note, each spelling of a source counted once, own links not at all."""
    r = (resolved if resolved is not None else resolved_links(links, notes)).where(F.col("resolved").isNotNull() & (F.col("src").isNull() | (F.col("src") != F.col("resolved"))))
    pairs = r.select(F.col("resolved").alias("rel_path"), F.coalesce("src", "src_rel").alias("s"), strip(F.col("target")).alias("t")).distinct()
    return pairs.groupBy("rel_path").agg(F.count("*").alias("n"))


def broken_links(links: DataFrame, notes: DataFrame, files: DataFrame | None = None, resolved: DataFrame | None = None) -> DataFrame:
    """``(rel_path, target)`` of links that reach neither a note nor, by its base name, one of ``files`` (name_lower)."""
    r = (resolved if resolved is not None else resolved_links(links, notes)).select(F.coalesce("src", "src_rel").alias("rel_path"), strip(F.col("target")).alias("target"), "resolved").distinct()
    other = r.where(attachment(F.col("target"))).withColumn("name_lower", file_name(F.col("target")))
    missing = other if files is None else other.join(files.select("name_lower"), "name_lower", "left_anti")
    return r.where(~attachment(F.col("target")) & F.col("resolved").isNull()).select("rel_path", "target").unionByName(missing.select("rel_path", "target"))


def content_map(links: DataFrame, notes: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """``(rel_path)`` of the notes the root readme links to: the map of content."""
    root = target_key(F.col("src_rel")) == "readme"
    return (resolved.where(root) if resolved is not None else resolve_targets(links.where(root), notes)).where(F.col("resolved").isNotNull()).select(F.col("resolved").alias("rel_path")).distinct()


def orphan_notes(links: DataFrame, notes: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """``(rel_path)`` of notes nothing links to, but for the root readme."""
    return note_keys(notes).where(F.lower("rel_path") != "readme.md").select("rel_path").join(inbound(links, notes, resolved), "rel_path", "left_anti")


def without_hub(links: DataFrame, notes: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """``(rel_path)`` of notes that are no hub and link to none; hubs go by name or stand in the map of content."""
    moc = content_map(links, notes, resolved)
    r = resolved if resolved is not None else resolved_links(links, notes)
    by_name = r.where(is_hub_name(F.translate(strip(F.col("target")), "\\", "/"))).select(F.col("src").alias("rel_path"))
    by_map = r.join(moc.select(F.col("rel_path").alias("resolved")), "resolved", "left_semi").select(F.col("src").alias("rel_path"))
    linked = by_name.unionByName(by_map).where(F.col("rel_path").isNotNull()).distinct()
    plain = note_keys(notes).where(~is_hub_name(F.col("rel_path"))).select("rel_path")
    return plain.join(moc, "rel_path", "left_anti").join(linked, "rel_path", "left_anti")


def bad_status(notes: DataFrame, allowed: Sequence[str] = STATUS_VALUES) -> DataFrame:
    """``(rel_path, status)`` outside the vocabulary. No status is fine."""
    value = F.lower(strip(F.col("status")))
    return notes.where(F.col("status").isNotNull() & (value != "") & ~value.isin(list(allowed))).select("rel_path", "status")


def oversized(notes: DataFrame, size: str, most: int) -> DataFrame:
    return notes.where(F.col(size) > most).select("rel_path", F.col(size).cast("bigint").alias("bytes"))


def junk_lines(notes: DataFrame, text: str, most: int) -> DataFrame:
    """``(rel_path, chars)``: the longest line where it exceeds ``most``."""
    from inkgrove.functions.text import split_lines

    longest = F.array_max(F.transform(split_lines(F.col(text)), F.length))
    return notes.select("rel_path", longest.cast("bigint").alias("chars")).where(F.col("chars") > most)


def lint(links: DataFrame, notes: DataFrame, files: DataFrame | None = None, allowed: Sequence[str] = STATUS_VALUES, extra: Sequence[DataFrame] = ()) -> DataFrame:
    """Findings in long form ``(kind, rel_path, detail)``: broken, orphan, no_hub, bad_status, plus ready-made ``extra`` ones."""
    none = F.lit(None).cast("string").alias("detail")
    r = written(resolved_links(links, notes), "resolved")  # one resolution for all findings
    parts = [
        broken_links(links, notes, files, r).select(F.lit("broken").alias("kind"), "rel_path", F.col("target").alias("detail")),
        orphan_notes(links, notes, r).select(F.lit("orphan").alias("kind"), "rel_path", none),
        without_hub(links, notes, r).select(F.lit("no_hub").alias("kind"), "rel_path", none),
        bad_status(notes, allowed).select(F.lit("bad_status").alias("kind"), "rel_path", F.col("status").alias("detail")),
        *extra,
    ]
    return reduce(DataFrame.unionByName, parts)


def lint_listing(findings: DataFrame, limit: int = 30) -> DataFrame:
    """Per kind the first ``limit`` findings by path and detail, with the number of all."""
    from pyspark.sql import Window

    order = Window.partitionBy("kind").orderBy("rel_path", F.col("detail").asc_nulls_first())
    totals = findings.groupBy("kind").agg(F.count("*").alias("total"))
    first = findings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return first.join(totals, "kind")
