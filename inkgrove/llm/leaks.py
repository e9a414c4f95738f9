"""Evaluation texts leaking into training text: a prefix-filtered set join.

Each item passage is cut into shingles of ``run`` consecutive words; equal shingles are one. The words of a shingle are
ordered by rarity, which is the number of documents a word stands in, counted over the whole corpus. Two shingles that
agree in all ``run`` words agree in the first ``run - overlap + 1`` of that order; with the overlap at ``run`` the
necessary prefix is one token, the rarest word. A document window is a candidate only if its rarest word heads an item
shingle (prefix filter) and stands at the same offset in it (positional bound); texts under ``run`` words can't match
(length bound). Candidates are verified word by word, and what was found is summed up over the items: how many of an
item's shingles the document holds.

Documents are read once, however many items there are: words become 64-bit hashes, those that are surely in no passage
drop out by a bit table of fixed size, and the runs that are left, a row per document, are written to the shared folder
together with the document counts of the words. The join reads that small table. It takes the evaluation set in blocks of
a checked size, so a larger set means more passes over the small table, never a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.llm.words import words
from inkgrove.runtime import spread, written

RUN = 8
#: Characters of passages in one block, the proven bound of what is broadcast for the join.
BLOCK_CHARS = 8_000_000
#: The bit table of passage words has ``2 ** TABLE_BITS`` bits (8 MB) at every size; words it lets through wrongly only lengthen the runs.
TABLE_BITS = 26
#: Words a worker remembers the hashes of, and words joined at once.
REMEMBERED, SLICE = 500_000, 400_000
SPANS = "doc_id bigint, item_id bigint, shingles int, of_shingles int, longest_run int, first_word int"
_ENCODED = "doc_id bigint, firsts binary, sizes binary, seq binary, word bigint, n bigint"


def word_hash(word: bytes) -> int:
    """A signed 64-bit hash, never 0."""
    h = xxhash.xxh3_64_intdigest(word)
    return (h - (1 << 64) if h >> 63 else h) or 1


def _passages(items: DataFrame, id_col: str, text_col: str, run: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(id, characters, word hashes)`` of the items long enough to match, streamed through the driver."""
    for r in items.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, text_col).orderBy(id_col).toLocalIterator():
        w = words(r[1])
        if len(w) >= run:
            yield r[0], len(r[1]), np.fromiter(map(word_hash, w), np.int64, len(w))


def _item_blocks(passages: Iterator[tuple[int, int, np.ndarray]], block_chars: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Blocks of at most ``block_chars`` characters (a single longer passage makes its own)."""
    block, size = [], 0
    for item, chars, hashes in passages:
        if block and size + chars > block_chars:
            yield block
            block, size = [], 0
        block.append((item, hashes))
        size += chars
    if block:
        yield block


def _slots(hashes: np.ndarray) -> np.ndarray:
    return hashes & ((1 << TABLE_BITS) - 1)


def _encode(docs: DataFrame, table, run: int) -> DataFrame:
    """Per document the maximal runs of at least ``run`` words that may all occur in passages; and, in rows without a
    document, in how many documents of the task each such word stands."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, known = table.value, {}
        seen: list[np.ndarray] = []
        counts, held = pd.Series(dtype="int64"), 0
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                w = words(text)
                if len(w) < run:
                    continue
                if len(known) > REMEMBERED:
                    known = {}
                for x in set(w).difference(known):
                    h = word_hash(x)
                    slot = h & ((1 << TABLE_BITS) - 1)
                    known[x] = h if bits[slot >> 3] >> (slot & 7) & 1 else 0
                a = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
                distinct = np.unique(a)
                seen.append(distinct[distinct != 0])
                held += len(seen[-1])
                edge = np.flatnonzero(np.diff(np.concatenate(([False], a != 0, [False])).astype(np.int8)))
                first, size = edge[::2], edge[1::2] - edge[::2]
                first, size = first[size >= run], size[size >= run]
                if len(first):
                    seq = np.concatenate([a[s : s + n] for s, n in zip(first, size, strict=True)])
                    out.append((doc, first.astype(np.int32).tobytes(), size.astype(np.int32).tobytes(), seq.tobytes(), None, None))
            if held > 2_000_000:
                counts, seen, held = _added(counts, seen), [], 0
            yield pd.DataFrame(out, columns=["doc_id", "firsts", "sizes", "seq", "word", "n"])
        counts = _added(counts, seen)
        yield pd.DataFrame({"doc_id": None, "firsts": None, "sizes": None, "seq": None, "word": counts.index.to_numpy(np.int64), "n": counts.to_numpy(np.int64)})

    return docs.mapInPandas(encode, _ENCODED)


def _added(counts: pd.Series, seen: list[np.ndarray]) -> pd.Series:
    if not seen:
        return counts
    word, n = np.unique(np.concatenate(seen), return_counts=True)
    return counts.add(pd.Series(n, index=word), fill_value=0).astype("int64")


def _frequency(encoded: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """In how many documents each word of one block stands."""
    spark = encoded.sparkSession
    wanted = spark.createDataFrame(pa.table({"word": pa.array(vocabulary)}))
    out = np.zeros(len(vocabulary), np.int64)
    found = encoded.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).join(wanted, "word").toArrow()
    out[np.searchsorted(vocabulary, found.column("word").to_numpy())] = found.column("n").to_numpy()
    return out


def _mix(grams: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each row of word numbers."""
    h = np.full(len(grams), seed, np.uint64)
    for k in range(grams.shape[1]):
        h = (h ^ (grams[:, k].astype(np.uint64) + np.uint64(k + 1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def prefix_keys(numbers: np.ndarray, rank: np.ndarray, run: int) -> np.ndarray:
    """Of each row of words: rank of the rarest times ``run`` plus its first offset."""
    keys = rank[numbers[:, 0]] * run
    for k in range(1, run):
        keys = np.minimum(keys, rank[numbers[:, k]] * run + k)
    return keys


class Shingles:
    """The distinct shingles of one block of items, sorted by hash, with the places each stands at."""

    def __init__(self, items: list[tuple[int, np.ndarray]], vocabulary: np.ndarray, frequency: np.ndarray, run: int):
        self.run, self.vocabulary = run, vocabulary
        self.rank = np.empty(len(vocabulary), np.int64)
        self.rank[np.lexsort((vocabulary, frequency))] = np.arange(len(vocabulary))
        self.items = np.array([i for i, _ in items], np.int64)
        self.count = np.array([len(a) - run + 1 for _, a in items], np.int64)
        grams = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.searchsorted(vocabulary, a), run) for _, a in items])
        self.grams, of = np.unique(grams, axis=0, return_inverse=True)
        self.seed = 1
        while len(np.unique(h := _mix(self.grams, self.seed))) < len(self.grams):
            self.seed += 1
        order = np.argsort(h)
        self.grams, self.hashes = self.grams[order], h[order]
        of = np.argsort(order)[of.ravel()]
        by_gram = np.argsort(of, kind="stable")
        self.item = np.repeat(np.arange(len(items)), self.count)[by_gram]
        self.at = np.concatenate([np.arange(c) for c in self.count])[by_gram]
        self.start = np.searchsorted(of[by_gram], np.arange(len(self.grams) + 1))
        self.heads = np.zeros(len(vocabulary) * run, bool)
        self.heads[prefix_keys(self.grams, self.rank, run)] = True

    def match(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, distinct shingle) of all exact agreements in a row of word hashes, in which 0 separates runs."""
        at = np.minimum(np.searchsorted(self.vocabulary, seq), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == seq
        total = np.concatenate(([0], np.cumsum(~known)))
        window = np.flatnonzero(total[self.run :] == total[: -self.run])
        grams = np.lib.stride_tricks.sliding_window_view(at, self.run)[window]
        if len(grams):
            head = self.heads[prefix_keys(grams, self.rank, self.run)]  # prefix filter and positional bound
            window, grams = window[head], grams[head]
        if not len(grams):
            return window, window
        place = np.minimum(np.searchsorted(self.hashes, _mix(grams, self.seed)), len(self.hashes) - 1)
        same = np.all(self.grams[place] == grams, axis=1)
        return window[same], place[same]

    def sum_up(self, window: np.ndarray, gram: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of one document's agreements (``word`` is the place of each window in the text): item, shingles, longest run, first word.

        Every distinct shingle is unfolded to its items once, so a text that repeats one costs no more than one that has it once.
        """
        distinct, first = np.unique(gram, return_index=True)
        first = word[first]  # windows are in order, so the first index is the first place
        follows = np.diff(window) == 1
        links = np.unique(gram[:-1][follows] * len(self.grams) + gram[1:][follows])
        n = self.start[distinct + 1] - self.start[distinct]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[distinct], n)
        item, at, gram, first = self.item[place], self.at[place], np.repeat(distinct, n), np.repeat(first, n)
        order = np.lexsort((at, item))
        item, at, gram, first = item[order], at[order], gram[order], first[order]
        joined = (item[1:] == item[:-1]) & (at[1:] == at[:-1] + 1) & np.isin(gram[:-1] * len(self.grams) + gram[1:], links)
        begins = np.flatnonzero(np.concatenate(([True], ~joined)))
        length = np.diff(np.append(begins, len(item)))
        heads = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
        longest = np.maximum.reduceat(np.repeat(length, length), heads)
        return item[heads], np.diff(np.append(heads, len(item))), longest + self.run - 1, np.minimum.reduceat(first, heads)


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    a, total = 0, 0
    for b, n in enumerate(sizes):
        if total and total + n > most:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def _join(encoded: DataFrame, shingles, run: int) -> DataFrame:
    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shingles.value
        for batch in batches:
            raw = batch["seq"].tolist()
            for a, b in _slices([len(r) // 8 for r in raw], SLICE):
                parts, places, owner = [], [], []
                for k in range(a, b):
                    seq, at = np.frombuffer(raw[k], np.int64), 0
                    for first, n in zip(np.frombuffer(batch["firsts"].iat[k], np.int32).tolist(), np.frombuffer(batch["sizes"].iat[k], np.int32).tolist(), strict=True):
                        parts += [seq[at : at + n], np.zeros(1, np.int64)]
                        places.append((first, n + 1))
                        owner.append(k)
                        at += n
                size = np.array([n for _, n in places])
                starts = np.cumsum(size) - size
                window, gram = s.match(np.concatenate(parts))
                if not len(window):
                    continue
                run_of = np.searchsorted(starts, window, side="right") - 1
                word = window - starts[run_of] + np.array([f for f, _ in places])[run_of]
                doc = np.array(owner)[run_of]
                cuts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                out = []
                for x, y in zip(cuts, [*cuts[1:], len(doc)], strict=True):
                    item, found, longest, first = s.sum_up(window[x:y], gram[x:y], word[x:y])
                    out.append(pd.DataFrame({"doc_id": batch["doc_id"].iat[doc[x]], "item_id": s.items[item], "shingles": found, "of_shingles": s.count[item], "longest_run": longest, "first_word": first}))
                yield pd.concat(out)

    return encoded.where("doc_id is not null").select("doc_id", "firsts", "sizes", "seq").mapInPandas(join, SPANS)


def leaked_spans(documents: DataFrame, items: DataFrame, run: int = RUN, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, shingles, of_shingles, longest_run, first_word)`` of every document and item that share ``run`` consecutive words.

    ``shingles`` of the item's ``of_shingles`` stand in the document, the first begins at word ``first_word`` (from 0).
    ``longest_run`` counts the words of the item's longest stretch whose windows of ``run + 1`` words all stand in the
    document (``run`` where there is none). Null and empty texts and passages, and those under ``run`` words, match
    nothing, nor do rows without an id; repeated documents and items are each reported (rows with one id as one, with
    its best figures); further columns are ignored.
    """
    spark = documents.sparkSession
    docs = spread(documents.where((F.length(text) >= 2 * run - 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    bits = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    some = False
    for _, _, hashes in _passages(items, item_id, passage, run):
        slot, some = _slots(hashes), True
        np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
    if not some:
        return spark.createDataFrame([], SPANS)
    encoded = written(_encode(docs, spark.sparkContext.broadcast(bits), run), "encoded")
    found = []
    for block in _item_blocks(_passages(items, item_id, passage, run), block_chars):
        vocabulary = np.unique(np.concatenate([a for _, a in block]))
        shingles = spark.sparkContext.broadcast(Shingles(block, vocabulary, _frequency(encoded, vocabulary), run))
        found.append(_join(encoded, shingles, run))
    best = [F.max("shingles").alias("shingles"), F.max("of_shingles").alias("of_shingles"), F.max("longest_run").alias("longest_run"), F.min("first_word").alias("first_word")]
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(*best)
