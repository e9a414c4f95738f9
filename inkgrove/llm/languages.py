"""Language labels for documents and for the parts of mixed documents.

Script ranges narrow the candidates of a word (Cyrillic leaves ru, Latin the seven others, any further script none of
them). Per-word scores are the word's log probabilities under a character model of each candidate, and, for text in no known
language ("und"), under a model of letter pairs of all candidates together (of letters, where a script leaves one): words built of strange
parts are likelier there. Viterbi with a switching penalty labels the spans of each document. The penalty is
lower where a paragraph begins, so spans like to end there.

The character models start from a page of running text of each language (``language_texts``), so a table without any
labels can be labelled, and are then fitted to the table on a bounded sample of rows (``SAMPLE_DOCS``, the one bound,
chosen by a hash of the id whatever the partitions), block by block as the blocks look so far; labels, which may be wrong
or missing, have a small vote. Everything else covers whole texts of all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.llm.language_texts import TEXTS
from inkgrove.llm.words import fold, plain, split_words
from inkgrove.runtime import spread

LANGS = ("en", "de", "fr", "es", "pt", "id", "nl", "ru")
OTHER = len(LANGS)  # the state for words of further scripts, code "und"
CODES = (*LANGS, "und")
#: Rows the character models are fitted on, and the longest text among them.
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 20_000
#: Nats it costs to change the language within a paragraph and at the start of one; share of a block's words that makes it whole.
SWITCH, SWITCH_AT_BLOCK, WHOLE = 8.0, 4.0, 0.8
#: Words with letters that make a sentence.
SENTENCE_WORDS = 3

# Names of the languages, as folded by ``words.fold``.
NAMES = {
    "en": ("en", "eng", "english", "anglais", "englisch", "ingles"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "aleman"),
    "fr": ("fr", "fra", "fre", "french", "francais", "franzosisch", "frances"),
    "es": ("es", "spa", "spanish", "espanol", "castellano", "spanisch", "espagnol"),
    "pt": ("pt", "por", "portuguese", "portugues", "portugiesisch"),
    "id": ("id", "ind", "in", "indonesian", "indonesia", "bahasa indonesia"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "vlaams", "flemish"),
    "ru": ("ru", "rus", "russian", "русскии", "russisch", "russkii"),
}
_NAME_OF = {n: code for code, names in NAMES.items() for n in names}
_LETTER = re.compile(r"[^\W\d_]")
_LIST = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)])\s+")
_LIST_MARK = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)])\s+(?:\[[ xX]\]\s+)?")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}#{1,6}(?:\s|$)")
_ASIDE = re.compile(r"`+[^`]*`+|!?\[\[[^\]]*\]\]|\$[^$\n]+\$|\b(?:https?|ftp)://\S+|\bwww\.\S+")


def label_code(label: str | None) -> str | None:
    """The language a label names in any usual spelling (code of two or three letters, with region or script, name), or None."""
    if label is None:
        return None
    name = fold(label).strip()
    return _NAME_OF.get(name) or _NAME_OF.get(re.split(r"[-_\s(,;/]", name)[0])


def blocks(text: str) -> list[tuple[int, int, bool, str]]:
    """``(first line, last line, is it a list, content)`` of each paragraph and list; frontmatter, code, headings, formulas and tables are left out. Lines count from 1."""
    lines = text.splitlines()
    n, i, out = len(lines), 0, []
    if lines and lines[0].lstrip("\ufeff").rstrip() == "---":
        for k in range(1, n):
            if lines[k].rstrip() in ("---", "..."):
                i = k + 1
                break
    now: list[str] = []
    first, is_list, fence, math = 0, False, "", False

    def flush(last: int) -> None:
        nonlocal now
        if now:
            out.append((first + 1, last, is_list, "\n".join(now)))
            now = []

    while i < n:
        line = lines[i]
        bare = line.strip()
        if fence:
            if bare.startswith(fence) and not bare.strip(fence[0]):
                fence = ""
        elif math:
            math = "$$" not in bare
        elif not bare:
            flush(i)
        elif bare[0] in "`~" and (m := _FENCE.match(line)):
            flush(i)
            fence = m.group(1)
        elif bare[0] == "#" and _HEADING.match(line) or bare[0] == "|":
            flush(i)
        elif bare.startswith("$$"):
            flush(i)
            math = "$$" not in bare[2:]
        else:
            mark = _LIST.match(line)
            if now and bool(mark) != is_list and not (is_list and line[0] in " \t"):
                flush(i)
            if not now:
                first, is_list = i, bool(mark)
            now.append(_LIST_MARK.sub("", line, count=1) if mark else line)
        i += 1
    flush(n)
    return out


def block_words(content: str) -> list[bytes]:
    """Folded words with letters, without inline code, formulas, links and addresses."""
    if "`" in content or "[[" in content or "$" in content or "://" in content or "www." in content:
        content = _ASIDE.sub(" ", content)
    return [w for w in split_words(fold(plain(content))) if not w.isdigit()]


def _script(word: str) -> int:
    """-1: Latin, a language: the only one of the word's script, OTHER: another script."""
    for ch in word:
        c = ord(ch)
        if 0x400 <= c < 0x530 or 0x1C80 <= c < 0x1C90:
            return LANGS.index("ru")
        if c < 0x250 or 0x1E00 <= c < 0x1F00 or 0x2C60 <= c < 0x2C80 or 0xA720 <= c < 0xA800 or 0xFB00 <= c < 0xFB07:
            continue
        if ch.isalpha():
            return OTHER
    return -1


#: Buckets of letter sequences, the longest of them, how much a shorter context weighs, letters a word may be made of.
GRAMS, ORDER, WEIGHT, LETTERS = 1 << 18, 5, 1.5, 64
#: Nats a word must be likelier as a word of no known language to count as one, and the most one word may say against a language.
STRANGE, MOST = 3.0, 7.0
#: Nats that a label counts when the models are fitted.
VOTE = 8.0
_CYRILLIC = LANGS.index("ru")


def _sequences(word: str) -> list[tuple[list[int], list[int]]]:
    """By context length: the buckets of context and letter, and of the context alone, at each letter of the word and its end."""
    padded = f"^{word}$"
    out = []
    for n in range(1, ORDER + 1):
        ends = range(2, len(padded) + 1)
        grams = [padded[max(0, e - n) : e] for e in ends]
        out.append(([crc32(g.encode()) % GRAMS for g in grams], [crc32(f"{g[:-1]}\0{len(g)}".encode()) % GRAMS for g in grams]))
    return out


@dataclass
class Model:
    """Scores in nats per word; rows of ``table`` belong to ``ids``. ``grams`` and ``contexts`` (GRAMS, languages) count
    letter sequences and what precedes the last letter of them."""

    grams: np.ndarray
    contexts: np.ndarray
    ids: dict[bytes, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((1024, OTHER + 1), np.float32))

    def __getstate__(self) -> dict:
        return {"grams": self.grams, "contexts": self.contexts, "ids": {}, "table": np.zeros((1024, OTHER + 1), np.float32)}

    def score(self, word: bytes) -> np.ndarray:
        text = word.decode()
        row = np.full(OTHER + 1, -2 * MOST, np.float32)
        script = _script(text)
        if script == OTHER:
            row[OTHER] = 0.0
            return row
        mine = [_CYRILLIC] if script >= 0 else [j for j in range(OTHER) if j != _CYRILLIC]
        p: np.ndarray | float = 1.0 / LETTERS
        strange = np.zeros(1)
        for n, (full, context) in enumerate(_sequences(text[:40]), 1):
            g, c = self.grams[full][:, mine], self.contexts[context][:, mine]
            p = (g + WEIGHT * p) / (c + WEIGHT)
            if n == min(2, len(mine)):  # letter pairs of all candidates together; of one alone, letters
                together = (g.sum(axis=1) + WEIGHT / LETTERS) / (c.sum(axis=1) + WEIGHT)
                strange = np.log(together).sum(keepdims=True)
        known = np.log(p).sum(axis=0)
        both = np.concatenate([known, strange - STRANGE])
        row[[*mine, OTHER]] = np.maximum(both - both.max(), -MOST)
        return row

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words' rows; unseen words are scored once. ``trim`` drops the rows when they grow past a bound."""
        get = self.ids.get
        out = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
        for k in np.flatnonzero(out < 0):
            w = words[k]
            at = get(w)
            if at is None:
                at = len(self.ids)
                if at >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros((max(1024, len(self.table) // 2), OTHER + 1), np.float32)])
                self.table[at] = self.score(w)
                self.ids[w] = at
            out[k] = at
        return out

    def trim(self, most: int = 300_000) -> None:
        if len(self.ids) > most:
            self.ids, self.table = {}, np.zeros((1024, OTHER + 1), np.float32)


def _counted(counts: list[Counter]) -> Model:
    """Character models of words counted by language; a word's weight grows with the logarithm of its count, so a table's own
    formulas don't drown the rest."""
    grams, contexts = np.zeros((GRAMS, OTHER), np.float32), np.zeros((GRAMS, OTHER), np.float32)
    for j, c in enumerate(counts):
        for w, n in c.items():
            text = w.decode()
            if _script(text) == (_CYRILLIC if j == _CYRILLIC else -1):
                weight = 1 + math.log(n)
                for full, context in _sequences(text[:40]):
                    np.add.at(grams[:, j], full, weight)
                    np.add.at(contexts[:, j], context, weight)
    return Model(grams, contexts)


def _words_of(text: str) -> list[list[bytes]]:
    return [w for *_, c in blocks(text) if (w := block_words(c))]


def fit(sample: list[tuple[str | None, str]], rounds: int = 2) -> Model:
    """Character models on top of the shipped texts, from (label, text) rows: each block is counted for the language it looks
    like so far (none, where it looks like no known one), again and again. A label has a vote of ``VOTE`` nats, which a
    sentence of another language outweighs; rows without one do as well."""
    start = [Counter(w for ws in _words_of(TEXTS[code]) for w in ws) for code in LANGS]
    model = _counted(start)
    if not sample:
        return model
    parts = [(label_code(label), w) for label, text in sample for w in _words_of(text)]

    def looks_like(code: str | None, w: list[bytes]) -> int | None:
        rows = model.rows(w)  # may put in a longer table
        total = model.table[rows].sum(axis=0)
        if code:
            total[LANGS.index(code)] += VOTE
        best = int(total.argmax())
        return best if best != OTHER else None

    for _ in range(rounds):
        counts = [c.copy() for c in start]
        for code, w in parts:
            if (j := looks_like(code, w)) is not None:
                counts[j].update(w)
        model = _counted(counts)
    return model


def viterbi(scores: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Best states (B, T) for scores (B, T, L), where changing the state before step t costs ``cost`` (B, T)."""
    b, t, states = scores.shape
    back = np.empty((t, b, states), np.int8)
    at, stay = np.arange(b), np.arange(states, dtype=np.int8)[None, :]
    now = scores[:, 0].copy()
    for k in range(1, t):
        best = now.argmax(axis=1)
        value = (now[at, best] - cost[:, k])[:, None]
        switch = value > now
        back[k] = np.where(switch, best[:, None], stay)
        now = np.where(switch, value, now) + scores[:, k]
    path = np.empty((b, t), np.int8)
    state = now.argmax(axis=1)
    for k in range(t - 1, 0, -1):
        path[:, k] = state
        state = back[k][at, state]
    path[:, 0] = state
    return path


def _confidence(total: np.ndarray, n: int, state: int) -> float:
    """Posterior of ``state`` for summed scores of n words; evidence beyond 20 words adds no more certainty."""
    z = total * (min(n, 20) / max(n, 1))
    return float(round(1 / np.exp(z - z[state]).sum(), 4))


#: Bounds of what is scored at once: words times documents, and documents.
CELLS, STEP = 250_000, 4096


def label_batch(texts: list[str | None], model: Model) -> list[tuple[np.ndarray, np.ndarray, list, np.ndarray]]:
    """Per text: row numbers of its words, block number of each word, its blocks, the state of each word."""
    parsed = []
    for text in texts:
        bs = blocks(text) if text else []
        per = [block_words(b[3]) for b in bs]
        flat = [w for ws in per for w in ws]
        parsed.append((model.rows(flat), np.repeat(np.arange(len(per)), [len(w) for w in per]) if per else np.zeros(0, int), bs))
    states: list[np.ndarray] = [np.zeros(0, np.int8)] * len(parsed)
    order = sorted((k for k in range(len(parsed)) if len(parsed[k][0])), key=lambda k: len(parsed[k][0]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and b - a < 1024 and (b + 1 - a) * len(parsed[order[b]][0]) <= CELLS:
            b += 1
        group = order[a:b]
        t = max(len(parsed[k][0]) for k in group)
        scores = np.zeros((len(group), t, OTHER + 1), np.float32)
        cost = np.full((len(group), t), np.float32(1e9))
        for g, k in enumerate(group):
            rows, block, _ = parsed[k]
            scores[g, : len(rows)] = model.table[rows]
            cost[g, : len(rows)] = SWITCH
            cost[g, np.flatnonzero(np.diff(block)) + 1] = SWITCH_AT_BLOCK
        path = viterbi(scores, cost)
        for g, k in enumerate(group):
            states[k] = path[g, : len(parsed[k][0])]
        a = b
    return [(*p, s) for p, s in zip(parsed, states, strict=True)]


SEGMENT = "struct<lang_code:string,confidence:double,line_start:int,line_end:int,n_words:int>"
LABELS = f"doc_id bigint, label string, label_code string, lang_code string, confidence double, langs array<string>, is_case boolean, segments array<{SEGMENT}>"


def _describe(doc: int, label: str | None, model: Model, rows: np.ndarray, block: np.ndarray, bs: list, state: np.ndarray) -> dict:
    code = label_code(label)
    out = {"doc_id": doc, "label": label, "label_code": code, "lang_code": None, "confidence": None, "langs": [], "is_case": False, "segments": []}
    if not len(rows):
        return out
    per_block = np.zeros((len(bs), OTHER + 1), np.int64)
    np.add.at(per_block, (block, state), 1)
    sizes = per_block.sum(axis=1)
    if sizes.max() < SENTENCE_WORDS:
        return out
    main = int(per_block.sum(axis=0).argmax())
    whole = np.where(per_block.max(axis=1) >= WHOLE * sizes, per_block.argmax(axis=1), main)
    langs = sorted({int(x) for x, s in zip(whole, sizes, strict=True) if s >= SENTENCE_WORDS} | ({main} if not (sizes >= SENTENCE_WORDS).any() else set()))
    scores = model.table[rows]
    cuts = np.flatnonzero(np.diff(state)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(state)], strict=True):
        s = int(state[a])
        out["segments"].append({"lang_code": CODES[s], "confidence": _confidence(scores[a:b].sum(axis=0), b - a, s), "line_start": bs[block[a]][0], "line_end": bs[block[b - 1]][1], "n_words": int(b - a)})
    mine = scores[state == main]
    out["lang_code"], out["confidence"] = CODES[main], _confidence(mine.sum(axis=0), len(mine), main)
    out["langs"] = [CODES[x] for x in langs]
    out["is_case"] = code != CODES[main] or len(langs) > 1
    return out


def sample_rows(documents: DataFrame, doc_id: str, text: str, lang: str, most: int) -> list[tuple[str | None, str]]:
    """The ``most`` rows that come first in order of a hash of their id (and text), over the whole table, with their labels or none."""
    total = documents.count()
    share = int(min(1.0, 1.5 * most / max(total, 1)) * (1 << 20)) + 1
    near = documents.where((F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) < share) & F.length(text).between(1, SAMPLE_CHARS))
    rows = near.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).orderBy(F.xxhash64(doc_id), F.xxhash64(text)).limit(most).collect()
    return [(r[0], r[1]) for r in rows]


def label_languages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, model: Model | None = None) -> DataFrame:
    """One row per document: its label and the language that names, its own language with a confidence, the languages in
    which it has a whole paragraph or list, whether the label or a foreign part makes it a case, and its spans.

    Null, empty and sentence-free texts get null languages, no spans, and are no cases. Rows without an id are left out. Repeated rows are labelled alike.
    Ties go to the language first in ``LANGS``. Words of further scripts count as ``und``. Further columns are ignored.
    """
    spark = documents.sparkSession
    if model is None:
        model = fit(sample_rows(documents, doc_id, text, lang, sample_docs) if sample_docs else [])
    shared = spark.sparkContext.broadcast(model)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in (whole.iloc[a : a + STEP] for whole in batches for a in range(0, len(whole), STEP)):
            done = label_batch(batch["text"].tolist(), m)
            yield pd.DataFrame([_describe(d, g, m, *x) for d, g, x in zip(batch["doc_id"], batch["lang"], done, strict=True)], columns=["doc_id", "label", "label_code", "lang_code", "confidence", "langs", "is_case", "segments"])
            m.trim()

    named = documents.where(F.col(doc_id).isNotNull())
    return spread(named.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))).mapInPandas(label, LABELS)


def mislabelled(documents: DataFrame, **columns) -> DataFrame:
    """``(doc_id, lang_code)``: one row for each language in which a case has a whole paragraph or list."""
    return label_languages(documents, **columns).where("is_case").select("doc_id", F.explode("langs").alias("lang_code")).where(F.col("lang_code") != CODES[OTHER])
