"""Filling fixed-capacity token sequences, with the mixture under control: deficit round-robin over source queues.

Every sequence (window) is one round over the sources: each one's deficit grows by its quantum, its target share of the
capacity, and it serves texts as far as deficit and room allow. Room left over is lent to the sources still owed most, then
to the text that fits best, and a loan stays as a negative deficit, so the mixture is held within each window as closely as
whole texts allow, and over several windows by what is carried.

Windows are filled in shards of bounded size (a hash of the document id, so a source with a third of all rows is spread
evenly). A shard uses up all its texts, so what it leaves as deficit is known before it runs: target share times the
tokens before it, less the source's own tokens before it. Running sums over (shard, source) totals give each shard the
deficits it starts with, and shards run in parallel as if one after another. Without targets of the caller's, a shard
paces its sources by its own token shares, so all last to its end and the mixture stays even from first to last window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrove.llm.tokens import token_count
from inkgrove.runtime import spread, written

CAPACITY = 2048
#: Bounds of a shard: what one task holds is some 20 bytes a text.
SHARD_TOKENS, SHARD_TEXTS = 4_000_000, 500_000
NO_SOURCE = "(none)"
#: Sequences whose runs one task sums for one source.
STRETCH = 4096
PACKED = "sequence_id bigint, position int, doc_id bigint, part_no int, source string, n_tokens int"


class _Queues:
    """Texts by source and size. Sizes present are bits of an integer, so the longest that fits takes a few machine words."""

    def __init__(self, sources: int):
        self.mask = [0] * sources
        self.all = 0
        self.items: list[dict[int, list]] = [{} for _ in range(sources)]
        self.at: dict[int, dict[int, int]] = {}

    def put(self, s: int, size: int, item) -> None:
        self.items[s].setdefault(size, []).append(item)
        self.mask[s] |= 1 << size
        self.all |= 1 << size
        by = self.at.setdefault(size, {})
        by[s] = by.get(s, 0) + 1

    def least(self, s: int) -> int:
        m = self.mask[s]
        return (m & -m).bit_length() - 1 if m else 1 << 30

    def longest(self, mask: int, room: int) -> int:
        """The largest size up to ``room``, or -1."""
        return (mask & ((2 << room) - 1)).bit_length() - 1

    def take(self, s: int, size: int):
        bucket = self.items[s][size]
        item = bucket.pop()
        if not bucket:
            del self.items[s][size]
            self.mask[s] &= ~(1 << size)
        by = self.at[size]
        by[s] -= 1
        if not by[s]:
            del by[s]
            if not by:
                del self.at[size]
                self.all &= ~(1 << size)
        return item


def fill(items: list[tuple[int, int, tuple]], share: np.ndarray, credit: np.ndarray, capacity: int) -> list[list[tuple[int, int, tuple]]]:
    """Windows of (source, size, item); sizes from 1 to ``capacity``. ``credit`` is changed in place.

    A window is one round: each source's deficit grows by its quantum, its share of the capacity, and the source serves its
    longest texts that deficit and room allow; the round begins one source further each time. Room that is left is lent to
    the sources that are still owed something, the most owed first, then to whichever text fits best; the loan stays as a
    negative deficit for later windows.
    """
    queues = _Queues(len(share))
    for s, size, item in items:
        queues.put(s, size, item)
    least = np.array([queues.least(s) for s in range(len(share))], np.int64)
    windows, turn = [], 0
    while queues.all:
        active = least <= capacity
        credit += np.where(active, share, 0) * (capacity / max(share[active].sum(), 1e-12))
        room, window = capacity, []

        def serve(s: int, size: int) -> int:
            window.append((s, size, queues.take(s, size)))  # noqa: B023
            credit[s] -= size
            least[s] = queues.least(s)
            return size

        able = np.flatnonzero(least <= np.minimum(credit, capacity))
        for s in np.concatenate([able[able >= turn], able[able < turn]]).tolist():
            while 0 < (size := queues.longest(queues.mask[s], room)) <= credit[s]:
                room -= serve(s, size)
        turn = (turn + 1) % len(share)
        while room and queues.all:
            owed = np.where((least <= room) & (credit > 0), credit, 0)
            s = int(owed.argmax())
            if owed[s] > 0:
                size = queues.longest(queues.mask[s], room)
            else:
                size = queues.longest(queues.all, room)
                if size < 1:
                    break
                s = max(queues.at[size], key=credit.__getitem__)
            room -= serve(s, size)
        windows.append(window)
    return windows


def pack(documents: DataFrame, capacity: int = CAPACITY, shares: dict[str, float] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokens: Column | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``(sequence_id, position, doc_id, part_no, source, n_tokens)``: where each text, or part of one over the capacity, stands.

    ``shares`` gives target token shares by source; without it the shares are those of the whole corpus. Sources missing
    in ``shares`` come last. ``tokens`` replaces the token count by the default tokenizer. Texts longer than the capacity
    are cut into full sequences and a rest, which is packed like a text. Null and empty texts have no tokens and stand,
    with 0, at the head of their shard's first sequence. A null source is a source of its own. Repeated rows are packed
    each, texts without an id too. Further columns are ignored. Ties go to the source first in order of name, then to
    the later text in order of a hash, so a result repeats whatever the partitions.
    """
    count = token_count(F.col(text)) if tokens is None else tokens
    sized = written(spread(documents.select(doc_id, text, source)).select(F.col(doc_id).cast("string").alias("doc_id"), F.xxhash64(doc_id, text).alias("mix"), F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)).alias("source"), F.coalesce(count, F.lit(0)).cast("bigint").alias("n")), "sized")
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("texts")).first()
    shards = max(1, -(-total.tokens // shard_tokens), -(-total.texts // SHARD_TEXTS))
    items = sized.withColumn("shard", F.pmod("mix", F.lit(shards)))

    per = items.groupBy("shard", "source").agg(F.sum("n").alias("own"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    running = per.groupBy("shard").agg(F.sum("own").alias("t")).select("shard", "t", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("tokens_before"))
    own_before = F.coalesce(F.sum("own").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_of = F.sum("own").over(Window.partitionBy("source"))
    wanted = all_of / F.lit(float(max(1, total.tokens)))
    pace = F.col("own") / F.greatest(F.col("t"), F.lit(1))  # so that a shard's sources last equally long; what differs from the target is carried
    if shares is not None:
        whole = sum(shares.values())
        pairs = [x for k, v in shares.items() for x in (F.lit(k), F.lit(v / whole))]
        wanted = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
        pace = F.col("share")
    carry = per.withColumn("share", wanted).withColumn("own_before", own_before).join(running, "shard").select(F.col("shard").alias("of_shard"), F.col("source").alias("name"), pace.alias("share"), (F.col("share") * F.col("tokens_before") - F.col("own_before")).alias("credit"))

    def run(key: tuple, texts: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        start = start.sort_values("name")
        number = {s: k for k, s in enumerate(start["name"])}
        share, credit = start["share"].to_numpy(float), start["credit"].to_numpy(float).copy()
        names = start["name"].tolist()
        texts = texts.sort_values(["mix", "doc_id"], kind="stable")
        queue, empty = [], []
        for d, s, n in zip(texts["doc_id"].tolist(), texts["source"].map(number).tolist(), texts["n"].tolist(), strict=True):
            parts, rest = divmod(n, capacity)
            if rest:
                queue.append((s, rest, (d, parts)))
            elif not parts:
                empty.append((s, 0, (d, 0)))
            queue += [(s, capacity, (d, p)) for p in range(parts - 1, -1, -1)]  # the last put is the first taken
        windows = fill(queue, share, credit, capacity)
        if empty:
            windows = [empty + windows[0], *windows[1:]] if windows else [empty]
        rows = [((int(key[0]) << 32) + w, at, d, p, names[s], size) for w, window in enumerate(windows) for at, (s, size, (d, p)) in enumerate(window)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])

    return items.groupBy("shard").cogroup(carry.groupBy("of_shard")).applyInPandas(run, PACKED.replace("doc_id bigint", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, the share of the room that is filled, the largest gap that is not in a shard's last sequence (null if there is no other)."""
    per = packed.groupBy("sequence_id").agg(F.sum("n_tokens").alias("n"))
    shard = F.expr("sequence_id >> 32")
    per = per.withColumn("last", F.col("sequence_id") == F.max("sequence_id").over(Window.partitionBy(shard)))
    gap = F.max(F.when(~F.col("last"), F.lit(capacity) - F.col("n")))
    return per.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.max("n").alias("longest"), F.round(F.sum("n") / (F.count("*") * F.lit(capacity)), 5).alias("filled"), gap.alias("gap"))


def mixture_report(packed: DataFrame, windows: int = 64) -> DataFrame:
    """``(source, share, worst)``: each source's token share and the largest deviation from it in any run of ``windows`` sequences, shard after shard.

    A source without a token in a run has the share 0 there. Fewer sequences than ``windows`` are one run. Runs are summed
    in stretches of ``STRETCH`` sequences, each with the ``windows - 1`` before it.
    """
    stretch = max(STRETCH, windows)
    per = packed.groupBy("sequence_id", "source").agg(F.sum("n_tokens").alias("n"))
    sequences = per.groupBy("sequence_id").agg(F.sum("n").alias("t")).withColumn("shard", F.expr("sequence_id >> 32"))
    counts = sequences.groupBy("shard").agg(F.count("*").alias("c"))
    starts = counts.select("shard", F.coalesce(F.sum("c").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("c").over(Window.partitionBy()).alias("all"))
    numbered = sequences.join(starts, "shard").select("sequence_id", "t", "all", (F.col("start") + F.expr("sequence_id & 4294967295")).alias("g"))
    total = F.sum("n").over(Window.partitionBy())
    share = per.groupBy("source").agg(F.sum("n").alias("n")).select("source", F.try_divide("n", total).alias("share"))
    whole = numbered.crossJoin(F.broadcast(share)).join(per, ["sequence_id", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    home = F.expr(f"g div {stretch}")
    copies = F.when(F.col("g") % stretch > stretch - windows, F.array(home, home + 1)).otherwise(F.array(home))
    run = Window.partitionBy("at", "source").orderBy("g").rowsBetween(1 - windows, 0)
    summed = whole.withColumn("at", F.explode(copies)).select("source", "share", "at", "g", "all", F.sum("n").over(run).alias("n"), F.sum("t").over(run).alias("t"))
    runs = summed.where((F.col("at") == home) & (F.col("g") >= F.least(F.lit(windows), F.col("all")) - 1))
    return runs.groupBy("source").agg(F.round(F.max("share"), 5).alias("share"), F.round(F.max(F.abs(F.try_divide("n", "t") - F.col("share"))), 5).alias("worst"))
