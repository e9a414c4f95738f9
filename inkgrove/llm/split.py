"""Splitting oversized items at natural boundaries, by agglomerative merging.

A text is cut into atomic segments (words with the blanks that follow them; a word longer than the limit is cut at the
limit). Every gap between neighbours has a strength: inside a word, between words, at the end of a sentence, of a line,
of a paragraph, before a heading. Adjacent pairs sit in a heap, and the weakest boundary is merged first while the
combined size plus the overlap fits, of equal boundaries the one whose pair is smallest, so segments of one kind grow
evenly and no crumb is left beside full ones. A pair that doesn't fit never will, as segments only grow, so its boundary
stays: pieces end at the strongest boundaries the limit allows. The overlap is taken from the end of the piece before,
without the blanks that piece sheds, from the start of a word on.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.runtime import spread

INSIDE, WORD, SENTENCE, LINE, PARAGRAPH, SECTION = range(6)
BOUNDARY_NAMES = ("inside", "word", "sentence", "line", "paragraph", "section")

_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_LINES = re.compile(_BREAK)
# A word with its indentation, and the blanks after it up to and including the last line break.
_ATOM = re.compile(r"\s*\S+(?:[^\S\n]*\n(?:\s*\n)?|[^\S\n]+(?=\S|$)|)|\s+\Z")
_SENTENCE_END = re.compile(r"[.!?…。！？؟।][\"'”’»)\]]*\Z")
_HEADING = re.compile(r"\s{0,3}#{1,6}\s|\s{0,3}={1,6}[^=\n]+={1,6}\s*$")
_FENCE = re.compile(r"(?m)^ {0,3}(```+|~~~+)")


def _atoms(text: str, most: int) -> list[tuple[int, int]]:
    """Character spans that cover the text; none is longer than ``most``, and none begins with a combining mark if avoidable."""
    spans, at = [], 0
    for m in _ATOM.finditer(text):
        a, b = at, m.end()
        while b - a > most:
            cut = a + most
            while cut > a + 1 and (unicodedata.combining(text[cut]) or text[cut] in "\u200d\ufe0f" or text[cut - 1] == "\u200d"):
                cut -= 1
            if cut <= a + 1:
                cut = a + most
            spans.append((a, cut))
            a = cut
        if b > a:
            spans.append((a, b))
        at = b
    if at < len(text):
        spans.append((at, len(text)))
    return spans


def _strengths(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Strength of the gap after each atom but the last."""
    fences = [m.start() for m in _FENCE.finditer(text)]
    out = []
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        tail = text[a:b]
        word = tail.rstrip()
        gap = tail[len(word) :]
        breaks = len(_LINES.findall(gap))
        if not gap and not text[c : c + 1].isspace():
            s = INSIDE
        elif breaks == 0:
            s = SENTENCE if _SENTENCE_END.search(word) else WORD
        elif breaks == 1:
            s = LINE
        else:
            s = PARAGRAPH
        if s >= LINE:
            end = text.find("\n", c)
            if bisect_right(fences, b - 1) % 2 and not _FENCE.match(text, c):
                s = LINE  # a blank line inside code is no paragraph end
            elif _HEADING.match(text, c, end if end >= 0 else len(text)):
                s = SECTION
        out.append(s)
    return out


def split_spans(text: str, limit: int, overlap: int = 0) -> list[tuple[int, int, int]]:
    """``(start, end, strength of the boundary at the end)``: consecutive spans that cover ``text``, each at most ``limit - overlap`` long."""
    if overlap < 0 or limit <= overlap:
        raise ValueError("need 0 <= overlap < limit")
    if len(text) <= limit:
        return [(0, len(text), SECTION)] if text else []
    room = limit - overlap
    spans = _atoms(text, room)
    strength = _strengths(text, spans)
    n = len(spans)
    start, end = [a for a, _ in spans], [b for _, b in spans]
    first, merged = list(range(n)), [False] * n  # of an atom that ends a segment: the atom that begins it; merged[i]: the boundary behind atom i is gone
    last = list(range(n))  # of an atom that begins a segment: the atom that ends it

    def size(i: int) -> int:
        """Of the pair that boundary i parts."""
        return end[last[i + 1]] - start[first[i]]

    heap = [(s, size(i), i) for i, s in enumerate(strength)]
    heapq.heapify(heap)
    while heap:
        s, known, i = heapq.heappop(heap)
        now = size(i)
        if now > room:
            continue  # for good
        if now != known:
            heapq.heappush(heap, (s, now, i))  # a neighbour has grown since
            continue
        a, b = first[i], last[i + 1]
        merged[i], first[b], last[a] = True, a, b
    heads = [i for i in range(n) if i == 0 or not merged[i - 1]]
    return [(start[i], end[j - 1], strength[j - 1] if j < n else SECTION) for i, j in zip(heads, [*heads[1:], n], strict=True)]


_WORD_START = re.compile(r"(?<!\S)\S")


def _overlap_start(text: str, least: int, end: int) -> int:
    """Where the overlap with a piece that ends at ``end`` begins: at the first word from ``least`` on, or, inside one long
    word, at ``least`` itself, but not at a combining mark."""
    if least >= end:
        return end
    if m := _WORD_START.search(text, least, end):
        return m.start()
    while 0 < least < end and (unicodedata.combining(text[least]) or text[least] in "\u200d\ufe0f" or text[least - 1] == "\u200d"):
        least += 1
    return least


def split_text(text: str, limit: int, overlap: int = 0, first_line: int = 1) -> list[dict]:
    """The pieces of one text, each within ``limit`` and without blanks at its end: ``text[char_start - overlap_chars:char_end]``.

    These ``overlap_chars`` characters are the last ones of the piece before: as many as ``overlap`` allows from the start
    of a word on. What lies between the end of a piece and the next one's own text is blank. Lines are
    exact, counted from ``first_line``.
    """
    breaks = [m.end() for m in _LINES.finditer(text)]
    blank = not text.strip()
    pieces, ended = [], None
    for a, b, s in split_spans(text, limit, overlap):
        if not blank and not text[a:b].strip():
            continue
        e = b if blank else a + len(text[a:b].rstrip())
        lo = a if ended is None else _overlap_start(text, max(0, ended - overlap, e - limit), ended)
        lo = a if lo == ended else lo
        shared = 0 if ended is None else max(0, ended - lo)
        pieces.append({
            "piece_no": len(pieces), "char_start": lo + shared, "char_end": e, "overlap_chars": shared, "boundary": BOUNDARY_NAMES[s], "chunk_text": text[lo:e],
            "line_start": first_line + bisect_right(breaks, lo), "line_end": first_line + bisect_right(breaks, e - 1),
        })
        ended = e
    return pieces


PIECES = "id bigint, piece_no int, char_start int, char_end int, overlap_chars int, boundary string, chunk_text string, line_start int, line_end int"


def split_oversized(df: DataFrame, limit: int = 1500, overlap: int = 0, id_col: str = "id", text_col: str = "chunk_text", line_col: str | None = "line_start") -> DataFrame:
    """Pieces of every row whose text is longer than ``limit`` characters (code points); other rows give none.

    Filter and projection run in the JVM before any Python: only the oversized texts are sent, with id and first line.
    Null and short texts give no rows, nor do rows without an id, equal texts under different ids are split alike, a null first line counts as 1,
    further columns are ignored. Spans of blanks between pieces give no piece of their own; a text of nothing but blanks
    is cut at the limit.
    """
    line = F.coalesce(F.col(line_col), F.lit(1)).cast("int") if line_col else F.lit(1)
    big = df.where((F.length(text_col) > limit) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), line.alias("line"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"id": i} | p for i, text, first in zip(batch["id"], batch["text"], batch["line"], strict=True) for p in split_text(text, limit, overlap, int(first))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    return spread(big).mapInPandas(cut, PIECES)
