"""Exact grammar of markup residue: where code and formulas are, and which HTML, wiki, LaTeX and Markdown constructs stand outside them."""

from __future__ import annotations

import re
from html.entities import html5

# Names of HTML elements and MediaWiki extension tags that make a tag, in natural order.
ELEMENTS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption "
    "categorytree ce center chem cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset "
    "figcaption figure font footer form frame frameset gallery graph h1 h2 h3 h4 h5 h6 head header hgroup hiero hr html i iframe "
    "imagemap img includeonly indicator input inputbox ins kbd label legend li link main map mapframe maplink mark marquee math "
    "menu meta meter nav nobr noframes noinclude noscript nowiki object ol onlyinclude optgroup option output p pagelist param "
    "picture poem pre progress q rb ref references rp rt rtc ruby s samp score script search section select slot small source span "
    "strike strong style sub summary sup svg syntaxhighlight table tbody td template templatestyles textarea tfoot th thead time "
    "timeline title tr track tt u ul var video wbr xmp"
)
HTML, WIKI, LATEX, MARKDOWN = "html", "wiki", "latex", "markdown"

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_LINE = re.compile(r"[^\n]*\n?")
_CODE = r"(?<!`)(?P<tick>`+)(?!`)(?:(?!\n[^\S\n]*\n)[\s\S])*?(?<!`)(?P=tick)(?!`)"
_BLOCK_MATH = r"\$\$[\s\S]+?\$\$"
_MATH = r"(?<![\\$\w])\$(?![\s$])(?:(?!\n[^\S\n]*\n)[^$])*?(?<![\s\\])\$(?![\w$])"
_QUIET = re.compile(f"(?P<code>{_CODE})|(?P<block>{_BLOCK_MATH})|(?P<math>{_MATH})")

_ATTRS = r"(?:\s(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)?"
TAG = re.compile(rf"</?(?P<el>{'|'.join(sorted(ELEMENTS.split(), key=len, reverse=True))})(?![\w:-]){_ATTRS}/?>|<!DOCTYPE[^>]*>", re.I)
COMMENT = re.compile(r"<!--[\s\S]*?-->")
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|(?P<name>[A-Za-z][A-Za-z0-9]{1,31}));")
QUOTES = re.compile(r"(?<![\w'])('{2,5})(?=[^\s'])(?:(?!\n[^\S\n]*\n)[\s\S])*?[^\s'](?<!')\1(?![\w'])")
WIKI_HEADING = re.compile(r"(?m)^(?P<eq>={2,6})[^\S\n]*(?P<title>[^=\n](?:[^\n]*?[^=\n])?)[^\S\n]*(?P=eq)[^\S\n\r]*\r?$|^= (?P<one>[^=\n]+) =[^\S\n\r]*\r?$")
TEMPLATE = re.compile(r"\{\{[^{}]+\}\}")
WIKI_TABLE = re.compile(r"(?m)^[^\S\n]*\{\|[\s\S]*?(?:^[^\S\n]*\|\}|\Z)")
LABELLED_LINK = re.compile(r"(?<!\[)\[(?:https?://|ftp://|mailto:|//)[^\s\]]+[^\S\n]+(?P<label>[^\]\n]+)\]")
COMMAND = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])*\{")
ACCENT = re.compile(r"\\(?P<mark>[\"'`^~=.]|[uvHtcdbrk](?=\{))\{(?P<base>\\?[A-Za-z]{1,2})\}")
MD_HEADING = re.compile(r"(?m)^ {0,3}#{1,6}[^\S\n]+(?=\S)")
MD_LIST = re.compile(r"(?m)^[^\S\n]*(?:[-*+]|\d{1,3}[.)])[^\S\n]+(?=\S)")
MD_STRONG = re.compile(r"(?<![*\\])(\*{1,3})(?=[^\s*])(?:(?!\n[^\S\n]*\n)[^*])*?(?<=[^\s*])\1(?!\*)|(?<![\w\\])(_{1,3})(?=[^\s_])(?:(?!\n[^\S\n]*\n)[\s\S])*?(?<=[^\s_])\2(?!\w)")
MD_STRIKE = re.compile(r"~~(?=[^\s~])[^~\n]*?(?<=[^\s~])~~")
MD_LINK = re.compile(r"(?P<img>!?)\[(?P<text>[^\[\]\n]*)\]\((?P<url>[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+\"[^\"]*\")?\)")
WIKILINK = re.compile(r"!?\[\[(?P<target>[^\[\]|\n]+)(?:\|(?P<alias>[^\[\]\n]*))?\]\]")


def fences(text: str) -> list[tuple[int, int]]:
    """Spans of fenced code, fences included; an open fence runs to the end."""
    if "```" not in text and "~~~" not in text:
        return []
    out, mark, start = [], "", 0
    for m in _LINE.finditer(text):
        line = m.group()
        if not line:
            break
        bare = line.strip()
        if mark:
            if bare.startswith(mark) and not bare.strip(mark[0]):
                out.append((start, m.end()))
                mark = ""
        elif (f := _FENCE.match(line)) and not ("`" in line[f.end() :] and f.group(1)[0] == "`"):
            mark, start = f.group(1), m.start()
    if mark:
        out.append((start, len(text)))
    return out


def quiet_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of fenced code, inline code and formulas, in order; nothing in them is residue."""
    out = [(a, b, "fence") for a, b in fences(text)]
    if "`" not in text and "$" not in text:
        return out
    edges = [0, *[x for a, b, _ in out for x in (a, b)], len(text)]
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        for m in _QUIET.finditer(text, a, b):
            out.append((m.start(), m.end(), "code" if m.group("code") else "formula"))
    return sorted(out)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with the spans blanked out, of the same length and lines."""
    if not spans:
        return text
    parts, at = [], 0
    for a, b, _ in spans:
        parts += [text[at:a], re.sub(r"[^\n]", " ", text[a:b])]
        at = b
    return "".join([*parts, text[at:]])


def _braced(text: str, at: int) -> int:
    """End of the braced argument that opens before ``at``, or -1."""
    depth = 1
    for k in range(at, len(text)):
        depth += (text[k] == "{") - (text[k] == "}")
        if not depth:
            return k + 1
    return -1


def residue(text: str | None, markdown: bool) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of every residue construct outside code and formulas. With ``markdown`` Markdown counts too."""
    if not text:
        return []
    masked = mask(text, quiet_spans(text))
    out: list[tuple[int, int, str]] = []

    def add(kind: str, *patterns: re.Pattern) -> None:
        out.extend((m.start(), m.end(), kind) for p in patterns for m in p.finditer(masked))

    if "<" in masked:
        add(HTML, TAG)
        if "-->" in masked:
            add(HTML, COMMENT)
    if "&" in masked:
        out.extend((m.start(), m.end(), HTML) for m in ENTITY.finditer(masked) if not m["name"] or m["name"] + ";" in html5)
    if "''" in masked:
        add(WIKI, QUOTES)
    if "=" in masked:
        add(WIKI, WIKI_HEADING)
    if "{" in masked:
        add(WIKI, TEMPLATE, WIKI_TABLE)
        if "\\" in masked:
            add(LATEX, ACCENT)
            out.extend((m.start(), end, LATEX) for m in COMMAND.finditer(masked) if (end := _braced(masked, m.end())) > 0)
    if "[" in masked:
        add(WIKI, LABELLED_LINK)
    if markdown:
        add(MARKDOWN, MD_HEADING, MD_LIST, MD_STRIKE, MD_LINK, WIKILINK)
        if "*" in masked or "_" in masked:
            add(MARKDOWN, MD_STRONG)
    return sorted(out)
