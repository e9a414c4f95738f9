"""Invented documents for training the block labeller, with labels known by construction.

A document is composed of blocks (paragraphs, headings, lists, tables, code, formulas, frontmatter and their HTML, wiki and
LaTeX forms) around plain lines of real text, with constructs and look-alikes put between words. What each line is and
which residue it holds is noted as it is written, so no grammar is asked.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from html.entities import html5

import numpy as np

from inkgrove.llm.blocks import KINDS, LABELS
from inkgrove.llm.residue import ELEMENTS

_ENTITIES = sorted(k for k in html5 if k.endswith(";") and k.isascii())
_COMMON = ("nbsp;", "amp;", "lt;", "gt;", "quot;", "mdash;", "ndash;", "hellip;", "eacute;", "uuml;")
_TAGS = ELEMENTS.split()
_USUAL = "b i em strong br p a span div u sup sub ref code small font s h2 li td".split()
_COMMANDS = "emph textbf textit texttt section subsection label ref cite footnote url underline textsc caption href".split()


@dataclass
class Composer:
    """Writes one document; ``lines`` are (text, label, kinds)."""

    rng: np.random.Generator
    prose: list[str]
    lines: list[tuple[str, str, frozenset[str]]] = field(default_factory=list)

    def pick(self, options):
        return options[self.rng.integers(len(options))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def number(self, a: int = 1, b: int = 10) -> int:
        return int(self.rng.integers(a, b))

    def name(self) -> str:
        return "".join(chr(97 + c) for c in self.rng.integers(0, 26, self.number(2, 9)))

    def words(self, most: int = 3) -> str:
        w = self.pick(self.prose).split()
        at = self.rng.integers(len(w))
        return " ".join(w[at : at + self.number(1, most + 1)]).strip(",.;:!?()") or "word"

    def tag(self) -> str:
        t = self.pick(_USUAL) if self.chance(0.5) else self.pick(_TAGS)
        return t.upper() if self.chance(0.1) else t

    def construct(self) -> tuple[str, str]:
        """An inline construct and its kind."""
        w, v, t, n = self.words(), self.words(1), self.tag(), self.name()
        c = self.pick(_COMMANDS) if self.chance(0.7) else n
        entity = "&" + (self.pick(_COMMON) if self.chance(0.7) else self.pick(_ENTITIES))
        accent = "\\" + self.pick("\"'`^~=.") + "{" + self.pick("aeuoin") + "}"
        kind = self.pick(KINDS)
        forms = {
            "html": (f"<{t}>{w}</{t}>", f'<{t} {n}="{v}">{w}</{t}>', f"</{t}>", f"<{t}>", f"<{t}/>", "<br>", "<br />", f"<!-- {w} -->", entity, entity, f"{v}{entity}{v}", f"&#{self.number(34, 9000)};", f"&#x{self.number(34, 9000):x};", f"&lt;{t}&gt;{w}&lt;/{t}&gt;", f"<a href='{n}.htm'>{w}</a>"),
            "wiki": (f"''{w}''", f"'''{w}'''", f"'''''{w}'''''", f"{{{{{n}}}}}", f"{{{{{n}|{w}}}}}", f"{{{{{n}|{v}={w}|{v}}}}}", f"[https://{n}.invalid/{n} {w}]", f"[http://{n}.invalid {w}]"),
            "latex": (f"\\{c}{{{w}}}", f"\\{c}{{{w}}}", f"\\{c}*{{{w}}}", f"\\{c}[{v}]{{{v}}}", f"{v[:2]}{accent}{v[2:]}", f"{v}\\{self.pick('uvHckr')}{{{self.pick('aeuosc')}}}", f"{{\\small\\{c}{{{w}}}}}", f"\\href{{https://{n}.invalid}}{{{w}}}"),
            "markdown": (f"**{w}**", f"*{w}*", f"__{w}__", f"_{w}_", f"***{w}***", f"~~{w}~~", f"[{w}]({n}.md)", f"![{w}]({n}.png)", f"[{w}](https://{n}.invalid/{n})", f"[[{n}]]", f"[[{n}/{v}|{w}]]", f"![[{n}.png]]"),
        }
        return self.pick(forms[kind]), kind

    def lookalike(self) -> str:
        w, v, n, k = self.words(1), self.words(1), self.name(), self.number()
        inner = self.construct()[0].replace("`", "").replace("$", "")
        return self.pick([
            f"`{inner}`", f"``{inner}``", f"`{n}({k})`", f"$\\{n}{{x}} + {k}$", f"$x_{{{k}}}$", f"${n[0]}^{k} < {k}$", f"{k}'' {w}", f"{k}' {k}''", f"{w} < {k}", f"<{k} {w}", f"I <3 {w}", f"{w} <- {v}", f"<= {k}",
            f"{n[0].upper()}&{n[-1].upper()}", f"{w} & {v}", f"&{n}", f"C:\\{n}\\{w}", f"{n[0].upper()}:\\{n}", f"{n}\\{w}\\{v}", f"{k}'' {w}", f"\\o/ {{ {w} }}", f"\\{n} {w}", f"{n}_{v}_{k}", f"{w} == {v}", f"{n} = {k}", f"[{w}]", f"[{k}]", f"{n}[{k}]", f"x = [{k}, 2, 3]", f"#{k}", f"#{n}",
            f"${k}, ${k + 1}", f"{k} $", f"List<{self.pick(['int', 'T', 'str', 'String', 'float'])}> {n}", f"{k} * {k} * 2", f"{k} - {k}", f"{{{w}}}", f"({w})", f'"{w}"', f"'{w}'", f"{w}'s", f"https://{n}.invalid/{n}_{v}?a={k}&b={k}", f"~{k}", f"{w} -- {v}", f"{n}@{n}.invalid", f"{k}%", f"{w}/{v}", f"{w} | {v}", f"{n}*", f"_{n}", f"{w}...",
        ])

    def put(self, line: str, p: float = 0.4) -> tuple[str, set[str]]:
        """``line`` with constructs and look-alikes at its gaps."""
        kinds: set[str] = set()
        while self.chance(p):
            piece, kind = self.construct() if self.chance(0.5) else (self.lookalike(), "")
            if kind:
                kinds.add(kind)
            w = line.split(" ")
            at = int(self.rng.integers(len(w) + 1))
            if self.chance(0.1) and 0 < at and kind in ("html", "latex"):
                w[at - 1] += piece
            else:
                w.insert(at, piece)
            line = " ".join(w)
        return line, kinds

    def add(self, text: str, label: str = "text", *kinds: str) -> None:
        self.lines.append((text, label, frozenset(kinds)))

    def mixed(self, before: str = "", label: str = "text", *kinds: str, after: str = "", p: float = 0.3, most: int = 6) -> None:
        text, more = self.put(self.words(most), p)
        self.add(before + text + after, label, *kinds, *more)

    def paragraph(self) -> None:
        for _ in range(self.number(1, 4)):
            text, kinds = self.put(self.pick(self.prose))
            self.add(("> " if self.chance(0.05) else "") + text, "text", *kinds)

    def block(self) -> None:
        n, k = self.name(), self.number()
        kind = self.number(0, 20)
        if kind < 6:
            self.paragraph()
        elif kind == 6:
            self.mixed("#" * self.number(1, 7) + " ", "heading", "markdown", p=0.15)
        elif kind == 7:
            mark = self.pick(["- ", "* ", "+ ", "1. ", "2) ", "  - ", "- [ ] ", "- [x] "])
            for _ in range(self.number(2, 5)):
                self.mixed(mark, "list", "markdown", p=0.2)
        elif kind == 8:
            self.add(f"| {self.words(1)} | {self.words(1)} |", "table")
            self.add(self.pick(["|---|---|", "| --- | :-: |"]), "table")
            for _ in range(self.number(1, 4)):
                self.add(f"| {self.words(1)} | {k} |", "table")
        elif kind in (9, 10):
            fence = self.pick(["```", "~~~", "````"])
            self.add(fence + self.pick(["", "html", "latex", "python", n]), "code")
            for _ in range(self.number(1, 6)):
                self.add(self.pick([self.construct()[0], self.lookalike(), f"    {n} = {k}", f"# {self.words()}", f"<div>{n}</div>", f"\\section{{{n}}}", f"- {n}", "", f"{{{{{n}}}}}"]).replace("`", "").replace("~", ""), "code")
            if self.chance(0.95):
                self.add(fence, "code")
            else:
                self.closed = True
        elif kind == 11:
            if self.chance(0.4):
                self.add(f"$$\\{n}{{x}} + {k}$$", "formula")
            else:
                for x in ("$$", f"\\sum_{{i=1}}^{{{k}}} x_i < {k}", f"\\{n}{{a}} = \\frac{{1}}{{{k}}}", "$$"):
                    self.add(x, "formula")
        elif kind == 12:
            equals = "=" * self.number(2, 6)
            self.add(f"{equals}{self.pick([' ', ''])}{self.words()}{self.pick([' ', ''])}{equals}", "heading", "wiki")
        elif kind == 13:
            rows = [self.pick(["{|", '{| class="wikitable"', "{|\n|+ " + self.words()]), "|-", f"! {self.words(1)} !! {self.words(1)}", "|-", f"| {self.words(1)} || {k}", f"| {self.words(1)}", "|}"]
            for r in "\n".join(rows).split("\n"):
                self.add(r, "table", "wiki")
        elif kind == 14:
            if self.chance(0.6):
                t = self.pick(["ul", "ol"])
                self.add(f"<{t}>", "list", "html")
                for _ in range(self.number(2, 5)):
                    self.mixed("<li>", "list", "html", after=self.pick(["</li>", ""]), p=0.1)
                self.add(f"</{t}>", "list", "html")
            else:
                self.add("<table>", "table", "html")
                for _ in range(self.number(1, 4)):
                    self.add(f"<tr><td>{self.words()}</td><td>{k}</td></tr>", "table", "html")
                self.add("</table>", "table", "html")
        elif kind == 15:
            h = f"h{self.number(1, 7)}"
            self.add(f"<{h}>{self.words()}</{h}>", "heading", "html")
        elif kind == 16:
            style = self.number(0, 3)
            if style == 0:
                self.add(f"<!-- {self.words()}", "text", "html")
                for _ in range(self.number(0, 3)):
                    self.add(self.pick(self.prose), "text", "html")
                self.add(f"{self.words()} -->", "text", "html")
            elif style == 1:
                t = self.pick(["div", "p", "blockquote", "details", "center"])
                self.add(f"<{t}>", "text", "html")
                for _ in range(self.number(1, 3)):
                    self.add(self.pick(self.prose))
                self.add(f"</{t}>", "text", "html")
            else:
                self.add(f"<p>{self.pick(self.prose)}</p>", "text", "html")
        elif kind == 17:
            if self.chance(0.6):
                e = self.pick(["itemize", "enumerate"])
                self.add(f"\\begin{{{e}}}", "list", "latex")
                for _ in range(self.number(2, 4)):
                    self.mixed("\\item ", "list", p=0.1)
                self.add(f"\\end{{{e}}}", "list", "latex")
            else:
                self.add("\\begin{tabular}{ll}", "table", "latex")
                for _ in range(self.number(1, 4)):
                    self.add(f"{self.words(1)} & {k} \\\\", "table")
                self.add("\\end{tabular}", "table", "latex")
        elif kind == 18:
            c = self.pick(["section", "subsection", "subsubsection", "section*", "chapter"])
            self.add(f"\\{c}{{{self.words()}}}", "heading", "latex")
        else:
            self.add(f"{{{{{n}", "text", "wiki")
            for _ in range(self.number(1, 4)):
                self.add(f"| {self.words(1)} = {self.words()}", "text", "wiki")
            self.add("}}", "text", "wiki")


def compose(rng: np.random.Generator, prose: list[str]) -> tuple[str, list[str], list[frozenset[str]]]:
    """A text and, for each of its lines, the label and the residue kinds."""
    c = Composer(rng, prose)
    c.closed = False
    if c.chance(0.1):
        for x in ("---", f"title: {c.words()}", f"tags: [{c.name()}, {c.name()}]", "status: draft", "---"):
            c.add(x, "frontmatter")
    for _ in range(c.number(1, 7)):
        c.block()
        if c.closed:
            break
        if c.chance(0.8) and c.lines:
            c.add("")
    assert all(label in LABELS for _, label, _ in c.lines)
    return "\n".join(t for t, *_ in c.lines), [x for _, x, _ in c.lines], [k for *_, k in c.lines]
