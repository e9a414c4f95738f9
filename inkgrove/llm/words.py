"""Words of a text for comparison: regardless of case, accents, punctuation, white space, markup and invisible characters."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

_INLINE = r"(?:a|abbr|b|bdi|cite|code|del|dfn|em|font|i|ins|kbd|mark|nowiki|q|ref|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr)"
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_INLINE_TAG = re.compile(rf"</?{_INLINE}(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_LINK_END = re.compile(r"\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
_WIKI_TARGET = re.compile(r"\[\[[^\]|\n]*\|")
_WORD = re.compile(r"[^\W_]+")
_KEEP = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


@lru_cache(1)
def _invisible() -> re.Pattern:
    """Combining marks and format characters, by Unicode category."""
    runs, last = [], -2
    for c in [*range(0x300, 0x11000), *range(0xE0000, 0xE0200), 0xAD]:
        if unicodedata.category(chr(c)) in ("Mn", "Me", "Cf"):
            if c == last + 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
            last = c
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]+")


def plain(text: str) -> str:
    """``text`` without the markup that stands between or inside words."""
    if "<" in text:
        if "<!--" in text:
            end = text.rfind("-->") + 3 if "-->" in text else 0  # what opens behind it is never closed: punctuation, and no repeated scans
            text = _COMMENT.sub(" ", text[:end]) + text[end:]
        text = _TAG.sub(" ", _INLINE_TAG.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK_END.sub(" ", text)
    if "[[" in text:
        text = _WIKI_TARGET.sub(" ", text)
    return text


def fold(text: str) -> str:
    """Lower case without accents and invisible characters."""
    if text.isascii():
        return text.lower()
    return _invisible().sub("", unicodedata.normalize("NFD", text.casefold()))


def split_words(folded: str) -> list[bytes]:
    """Runs of letters and digits of a folded text, as UTF-8."""
    if folded.isascii():
        return folded.encode().translate(_KEEP).split()
    return [w.encode() for w in _WORD.findall(folded)]


def words(text: str) -> list[bytes]:
    return split_words(fold(plain(text)))
