"""Markup residue in text columns: which rows hold it, what each block is, and the clean text.

The recurrent block labeller (``blocks``) reads every leaf of a text and decides which leaves hold residue; an exact check
(``residue``) follows, so a row is reported only for a construct that is really there. Conversion follows the labels:
leaves called code or formula, and leaves without residue, stay as they are to the letter; of the others the marks are cut
out, and headings, list items and table rows of any markup get one plain form (``#``, ``-``, cells between bars).
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.llm import residue as R
from inkgrove.llm.blocks import KINDS, LABELS, Labeller, Leaf, leaves
from inkgrove.runtime import spread

MARKDOWN_AT = KINDS.index("markdown")

_ATTR = re.compile(r"\b(?:alt|title)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLOCK_BREAKS = frozenset("p div tr table ul ol details summary blockquote section article header footer figure body html dl dd dt center br hr pre".split())
_LATEX_MARKS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "d": "\u0323", "b": "\u0331", "r": "\u030a", "k": "\u0328", "t": "\u0361"}
_SECTION_LEVEL = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
_SILENT = frozenset("cite citep citet ref eqref pageref label index bibliography bibliographystyle usepackage documentclass hspace vspace input include begin end".split())
_BARE_COMMAND = re.compile(r"\{\\(?:small|tiny|large|Large|huge|bf|it|em|sc|tt|rm|sf|normalsize|footnotesize)\b\s*")
_ENV_LINE = re.compile(r"(?m)^[^\S\n]*\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*[^\S\n]*\n?|\\(?:begin|end)\{[^{}\n]*\}(?:\{[^{}\n]*\})*")
_ITEM = re.compile(r"(?m)^([^\S\n]*)\\item(?:\[([^\]\n]*)\])?\s*")
_NAME = re.compile(r"\\([A-Za-z]+)\*?((?:\[[^\]\n]*\])*)\{")


_SPARE_COMMENT = re.compile(r"(?<=[^\S\n])<!--[\s\S]*?-->[^\S\n]|<!--[\s\S]*?-->\n")
_SPARE_TEMPLATE = re.compile(r"(?<=[^\S\n])\{\{[^{}]+\}\}[^\S\n]")


def _unaccent(m: re.Match) -> str:
    base = m["base"].lstrip("\\")
    return unicodedata.normalize("NFC", base[:1] + _LATEX_MARKS[m["mark"]] + base[1:]) if base else ""


def _latex(text: str) -> str:
    text = R.ACCENT.sub(_unaccent, text)
    if "\\begin" in text or "\\item" in text:
        tabular = "\\begin{tab" in text
        text = _ITEM.sub(lambda m: f"{m[1]}- " + (f"{m[2]}: " if m[2] else ""), text)
        if tabular:
            text = re.sub(r"(?m)^(.*?)\s*\\\\\s*$", lambda m: "| " + re.sub(r"\s*(?<!\\)&\s*", " | ", m[1].strip()) + " |", text)
        text = _ENV_LINE.sub("", text)
    text = _BARE_COMMAND.sub("{", text)
    out, at = [], 0
    while m := _NAME.search(text, at):
        end = R._braced(text, m.end())
        if end < 0:
            out.append(text[at : m.end()])
            at = m.end()
            continue
        name, argument = m[1], text[m.end() : end - 1]
        out.append(text[at : m.start()])
        if name in _SECTION_LEVEL:
            out.append(f"{'#' * _SECTION_LEVEL[name]} {_latex(argument)}")
        elif name == "href" and text[end : end + 1] == "{" and (last := R._braced(text, end + 1)) > 0:
            out.append(_latex(text[end + 1 : last - 1]))
            end = last
        elif name == "footnote":
            out.append(f" ({_latex(argument)})")
        elif name == "frac" and text[end : end + 1] == "{" and (last := R._braced(text, end + 1)) > 0:
            out.append(f"{_latex(argument)}/{_latex(text[end + 1 : last - 1])}")
            end = last
        elif name not in _SILENT:
            out.append(_latex(argument))
        at = end
    text = "".join([*out, text[at:]])
    return re.sub(r"\{([^{}\\\n]*)\}", r"\1", text) if out or "{" in text and "\\" not in text and "{{" not in text and "{|" not in text else text


def _tag(m: re.Match) -> str:
    name, closing = (m["el"] or "").lower(), m.group().startswith("</")
    opens = "\n" if m.string[m.string.rfind("\n", 0, m.start()) + 1 : m.start()].strip(" \t") else ""
    if len(name) == 2 and name[0] == "h" and name[1].isdigit():
        return ("" if m.string[m.end() : m.end() + 1] in ("", "\n", "\r") else "\n") if closing else f"{opens}{'#' * int(name[1])} "
    if name == "li":
        return "" if closing else f"{opens}- "
    if name in ("td", "th"):
        return "" if closing else "| "
    if name == "tr":
        return " |\n" if closing else ""
    if name == "img" and (a := _ATTR.search(m.group())):
        return next((x for x in a.groups() if x), "")
    if name == "math":
        return "$"
    if name in ("code", "tt", "kbd", "samp"):
        return "`"
    return "\n" if name in _BLOCK_BREAKS else ""


def _table(m: re.Match) -> str:
    rows, now = [], []
    for line in m.group().split("\n"):
        bare = line.strip()
        if bare.startswith(("{|", "|}", "|+")):
            continue
        if bare.startswith("|-"):
            if now:
                rows.append(now)
            now = []
        elif bare[:1] in "|!":
            now += [c.split("|")[-1].strip() for c in re.split(r"\|\||!!", bare[1:])]
    if now:
        rows.append(now)
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def _plain(text: str, markdown: bool) -> str:
    """One stretch without code or formulas, converted."""
    if "<" in text:
        if "-->" in text:
            text = R.COMMENT.sub("", _SPARE_COMMENT.sub("", text))
        text = R.TAG.sub(_tag, text)
    if "{|" in text:
        text = R.WIKI_TABLE.sub(_table, text)
    text = _SPARE_TEMPLATE.sub("", text) if "{{" in text else text
    while "{{" in text and (shorter := R.TEMPLATE.sub("", text)) != text:
        text = shorter
    if "=" in text:
        text = R.WIKI_HEADING.sub(lambda m: f"{'#' * (len(m['eq']) if m['eq'] else 1)} {(m['title'] or m['one']).strip()}", text)
    if "''" in text:
        text = R.QUOTES.sub(lambda m: m.group()[len(m[1]) : -len(m[1])], text)
    if "[" in text:
        text = R.LABELLED_LINK.sub(lambda m: m["label"], text)
    if "\\" in text:
        text = _latex(text)
    if markdown:
        text = R.WIKILINK.sub(lambda m: m["alias"] or m["target"], text)
        text = R.MD_LINK.sub(lambda m: m["text"], text)
        text = R.MD_STRIKE.sub(lambda m: m.group()[2:-2], text)
        while (shorter := R.MD_STRONG.sub(lambda m: m.group()[len(m[1] or m[2]) : -len(m[1] or m[2])], text)) != text:
            text = shorter
    while "&" in text and (plain := html.unescape(text)) != text:  # markup that was escaped, once or more
        text = re.sub(r"[^\S\n]*\xa0[^\S\n]*", " ", R.TAG.sub("", plain) if R.TAG.search(plain) else plain)
    return text


HEADING_AT, LIST_AT, CODE_AT, FORMULA_AT, TABLE_AT = (LABELS.index(x) for x in ("heading", "list", "code", "formula", "table"))
_ROW_END = re.compile(r"\s*\\\\\s*$")
_CELL = re.compile(r"\s*(?<!\\)&\s*")


@lru_cache(1)
def _model() -> Labeller:
    return Labeller.load()


def _level(leaf: Leaf) -> int:
    """Of a heading: from its tag, its equals signs or its LaTeX command."""
    bare = leaf.text.strip()
    if m := re.search(r"<h([1-6])\b", bare, re.I):
        return int(m[1])
    if m := re.match(r"\\([a-z]+)", bare):
        return _SECTION_LEVEL.get(m[1], 2)
    return max(1, len(bare) - len(bare.lstrip("="))) if bare[:1] == "=" else 2


def _convert(part: str, unit: list[tuple[Leaf, int]], markdown: bool) -> str:
    """The leaves of one unit without their marks, in the form their label asks for. Inline code and formulas stay."""
    quiet = R.quiet_spans(part)
    pieces, at = [], 0
    for k, (a, b, _) in enumerate(quiet):
        pieces += [part[at:a], f"\x00{k}\x00"]
        at = b
    body = "".join([*pieces, part[at:]])
    leaf, label = unit[0]
    alone = len(unit) == 1
    in_env = any(p[0] == "\\" for p in leaf.path)
    if alone and label == TABLE_AT and in_env and "&" in body and not body.lstrip().startswith(("\\begin", "\\end")):
        body = "| " + _CELL.sub(" | ", _ROW_END.sub("", body).strip()) + " |"
    body = _plain(body, markdown)
    if body != part:
        body = re.sub(r"\n{3,}", "\n\n", re.sub(r"[^\S\n]+\n", "\n", body)).strip("\n")
    if alone and body.strip() and body != part:
        if label == HEADING_AT and not body.lstrip().startswith("#"):
            body = f"{'#' * _level(leaf)} {body.strip()}"
        elif label == LIST_AT and leaf.text.lstrip().lower().startswith(("<li", "\\item")) and not body.lstrip().startswith("-"):
            body = f"- {body.strip()}"
    for k, (a, b, _) in enumerate(quiet):
        body = body.replace(f"\x00{k}\x00", part[a:b])
    return body


def clean(text: str | None, markdown: bool = False, doc: list[Leaf] | None = None, score: np.ndarray | None = None, model: Labeller | None = None) -> str | None:
    """Clean text: residue turned into plain headings, lists, tables and words; code and formulas unchanged. Null stays null.

    Text in which the labeller sees no residue comes out as it is. With ``markdown`` inline Markdown goes too; heading and
    list marks stay, as they are the plain form. ``doc`` and ``score`` are the text's leaves and their scores where known.
    """
    if not text:
        return text
    model = model or _model()
    if doc is None:
        doc = leaves(text)
        score = model.scores([doc])[0]
    if not doc:
        return text
    label = score[:, : len(LABELS)].argmax(axis=1)
    inside = np.array([any(p[0] == "\\" for p in leaf.path) for leaf in doc])  # items and rows of LaTeX environments carry no braces
    touched = (_flags(score, model, markdown) | inside & np.isin(label, (LIST_AT, TABLE_AT))) & ~np.isin(label, (CODE_AT, FORMULA_AT))
    if not touched.any():
        return text
    spans = [(a, b) for a, b, _ in R.residue(text, markdown) if "\n" in text[a:b]]  # constructs that hold leaves together
    out, at, k, body = [], 0, 0, "."
    while k < len(doc):
        if not touched[k]:
            k += 1
            continue
        e, reach = k + 1, max((b for a, b in spans if a < doc[k].end and b > doc[k].start), default=0)
        while e < len(doc) and doc[e].start < reach and label[e] not in (CODE_AT, FORMULA_AT):
            reach = max([reach, *(b for a, b in spans if a < doc[e].end and b > doc[e].start)])
            e += 1
        a, b = doc[k].start, doc[e - 1].end
        part = text[a:b]
        ended = part.endswith("\r")
        body = _convert(part.removesuffix("\r"), list(zip(doc[k:e], label[k:e].tolist(), strict=True)), markdown)
        out += [text[at:a], body + ("\r" if ended and body else "")]
        at = b + 1 if not body.strip() and text[b : b + 1] == "\n" else b  # a line of nothing but marks goes
        k = e
    whole = "".join([*out, text[at:]])
    return whole.removesuffix("\n") if at == len(text) and not body.strip() else whole


def text_columns(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """``(src_table, row_id, text)`` of both columns; rows without an id are left out, other columns ignored."""
    return chunks.select(F.lit("chunks").alias("src_table"), F.col("id").cast("bigint").alias("row_id"), F.col("chunk_text").alias("text")).unionByName(
        notes.select(F.lit("notes").alias("src_table"), F.col("id").cast("bigint").alias("row_id"), F.col("summary").alias("text"))
    ).where("row_id is not null")


def _flags(score: np.ndarray, model: Labeller, markdown: bool) -> np.ndarray:
    """Leaves the labeller calls residue."""
    hit = score[:, len(LABELS) :] >= model.thresholds
    if not markdown:
        hit[:, MARKDOWN_AT] = False
    return hit.any(axis=1)


def _found(text: str, doc: list[Leaf], flagged: np.ndarray, markdown: bool) -> list[tuple[int, int, str]]:
    """Constructs that overlap a flagged leaf."""
    if not flagged.any():
        return []
    spans = [(leaf.start, leaf.end) for leaf, f in zip(doc, flagged, strict=True) if f]
    return [(a, b, kind) for a, b, kind in R.residue(text, markdown) if any(a < e and b > s for s, e in spans)]


BLOCKS = "src_table string, row_id bigint, block_no int, line_no int, label string, probability double, residue array<string>"
ROWS = "src_table string, row_id bigint, constructs int, kinds array<string>"
STEP = 2048


def _texts(df: DataFrame) -> DataFrame:
    return spread(df.where(F.length("text") > 0))


def label_blocks(df: DataFrame) -> DataFrame:
    """``(src_table, row_id, block_no, line_no, label, probability, residue)``: every non-blank line with its label and
    the residue kinds found in it. ``df`` has ``src_table``, ``row_id``, ``text``; Markdown counts in table ``notes`` only.
    Null and blank texts give no rows; repeated rows are labelled alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Labeller.load()
        for whole in batches:
            for at in range(0, len(whole), STEP):
                batch = whole.iloc[at : at + STEP]
                docs = [leaves(t) for t in batch["text"]]
                rows = []
                for table, row, text, doc, score in zip(batch["src_table"], batch["row_id"], batch["text"], docs, model.scores(docs), strict=True):
                    if not doc:
                        continue
                    markdown = table == "notes"
                    found = _found(text, doc, _flags(score, model, markdown), markdown)
                    best = score[:, : len(LABELS)].argmax(axis=1)
                    for k, leaf in enumerate(doc):
                        rows.append((table, row, k, leaf.line + 1, LABELS[best[k]], float(score[k, best[k]]), sorted({kind for a, b, kind in found if a < leaf.end and b > leaf.start})))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return _texts(df).mapInPandas(run, BLOCKS)


def residue_rows(df: DataFrame) -> DataFrame:
    """``(src_table, row_id, constructs, kinds)`` of the rows in which the labeller flags a block and the grammar confirms it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Labeller.load()
        for whole in batches:
            for at in range(0, len(whole), STEP):
                batch = whole.iloc[at : at + STEP]
                docs = [leaves(t) for t in batch["text"]]
                rows = []
                for table, row, text, doc, score in zip(batch["src_table"], batch["row_id"], batch["text"], docs, model.scores(docs), strict=True):
                    if len(doc) and (found := _found(text, doc, _flags(score, model, table == "notes"), table == "notes")):
                        rows.append((table, row, len(found), sorted({k for *_, k in found})))
                yield pd.DataFrame(rows, columns=["src_table", "row_id", "constructs", "kinds"])

    return _texts(df).mapInPandas(run, ROWS)


def clean_rows(df: DataFrame) -> DataFrame:
    """``(src_table, row_id, clean_text)`` of every row; rows in which the labeller sees no residue keep their text, null stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Labeller.load()
        for whole in batches:
            for at in range(0, len(whole), STEP):
                batch = whole.iloc[at : at + STEP]
                docs = [leaves(t) if t else [] for t in batch["text"]]
                out = []
                for table, text, doc, score in zip(batch["src_table"], batch["text"], docs, model.scores(docs), strict=True):
                    markdown = table == "notes"
                    out.append(clean(text, markdown, doc, score, model))
                yield pd.DataFrame({"src_table": batch["src_table"].to_numpy(), "row_id": batch["row_id"].to_numpy(), "clean_text": out})

    return spread(df).mapInPandas(run, "src_table string, row_id bigint, clean_text string")
