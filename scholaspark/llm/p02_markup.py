"""Problem 2: markup left in texts: its kinds, and the clean text.

A text is parsed into a tree: the text, its blocks (between blank lines), and
in each block the spans that look like markup of some kind. For each kind every
node has a hidden state: the text carries the kind or not, the block is marked
up or not, the span is markup or literal. Potentials join parent and child,
and the spans have likelihoods of their observed form; all are counted on
labelled pages that a small grammar of its own writes. Sum-product messages go
up to the text and down again, and give each node's marginal exactly. The kinds
of a text are those whose root marginal reaches one half; spans whose marginal
does are taken away or turned into plain structure: headings, lists, tables,
code and formulas stay as blocks.

The work is per row and map-only. Texts without any character that begins
markup have no tree and are left in the JVM. Defined results: null, empty and
blank texts have no markup and stay as they are; a span is taken once, by the
construct that begins first and is longest.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholaspark.llm.common import table
from scholaspark.operators.documents import first_loads

KINDS = ("html", "markdown", "wiki", "latex")
SEED = 5
PAGES = 1200
#: Markup in markup in markup, to this depth, is taken away by p2_clean.
NESTED = 60

#: A text without any of these has no span.
TRIGGER = r"[<&*_`#|\[{\\$>~]|''|==|--|!\["

#: Names of elements, entities and commands.
TAGS = set("a abbr article aside b big blockquote body br caption center cite code col dd del details div dl dt em figcaption figure font footer h1 h2 h3 h4 h5 h6 head header hr html i img iframe input ins kbd label li link main mark meta nav ol option p pre q s samp script section select small span strike strong style sub summary sup table tbody td tfoot th thead title tr tt u ul var video".split())
COMMANDS = set("section subsection subsubsection paragraph chapter title author emph textbf textit texttt textsc textrm textsf underline cite citep citet ref eqref label footnote caption url href includegraphics begin end item documentclass usepackage maketitle newcommand input bibliography mathbf mathrm mathcal mathbb frac sqrt sum int prod alpha beta gamma delta epsilon theta lambda mu pi sigma phi psi omega hat bar tilde vec leq geq le ge neq approx times cdot infty partial nabla left right text quad ldots dots in to rightarrow log exp min max".split())
_MATH_ENV = "equation|align|eqnarray|gather|multline|displaymath|math|array|cases"


@dataclass
class Span:
    kind: str
    form: str
    begin: int
    end: int
    groups: tuple


class Found:
    """A construct found by its two ends, in the form of a match."""

    def __init__(self, text: str, begin: int, end: int, *groups: str):
        self.text, self.begin, self.to, self.parts = text, begin, end, groups

    def start(self) -> int:
        return self.begin

    def end(self) -> int:
        return self.to

    def groups(self) -> tuple:
        return self.parts

    def group(self) -> str:
        return self.text[self.begin : self.to]


def _between(opening: str, closing: str):
    """Finds what stands between two signs, in time linear in the text: where
    no closing sign follows, none does for any later opening one."""

    def find(text: str) -> Iterator[Found]:
        at = text.find(opening)
        while at >= 0:
            end = text.find(closing, at + len(opening))
            if end < 0:
                return
            yield Found(text, at, end + len(closing), opening, text[at + len(opening) : end])
            at = text.find(opening, end + len(closing))

    return find


_BRACKET = re.compile(r"\\([\[\]()])|\n[ \t]*\n")


def _bracketed(text: str) -> Iterator[Found]:
    """Formulas in \\[ \\] and \\( \\): an opening sign with the next closing one of
    its kind, if no blank line lies between."""
    opened: re.Match | None = None
    for m in _BRACKET.finditer(text):
        sign = m.group(1)
        if sign in ("[", "("):
            opened = m
        elif opened and sign and sign == {"[": "]", "(": ")"}[opened.group(1)]:
            if m.start() > opened.end():
                yield Found(text, opened.start(), m.end(), opened.group(1), text[opened.end() : m.start()])
            opened = None
        elif not sign:
            opened = None


_ENDS = re.compile(r"\\(begin|end)\{(" + _MATH_ENV + r")(\*?)\}")


def _environments(text: str) -> Iterator[Found]:
    """Formulas between the begin and the end of an environment; inner ones
    belong to the outer."""
    opened: re.Match | None = None
    for m in _ENDS.finditer(text):
        if m.group(1) == "begin":
            opened = opened or m
        elif opened and m.groups()[1:] == opened.groups()[1:]:
            yield Found(text, opened.start(), m.end(), opened.group(2), text[opened.end() : m.start()])
            opened = None


def _rules() -> list[tuple[str, str, str, Callable[[str], Iterator]]]:
    """(first sign, kind, construct, finder). A pattern's open parts stop at the
    construct's own signs or the line's end, so none looks far in vain."""
    p = lambda x, flags=0: re.compile(x, flags).finditer
    m, s = re.M, re.S
    return [
        ("<", "html", "comment", _between("<!--", "-->")),
        ("<", "html", "tag", p(r"</?([a-zA-Z][a-zA-Z0-9-]*)((?:\s[^<>]*)?)/?>")),
        ("&", "html", "entity", p(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,40});")),
        ("`", "markdown", "fence", p(r"^(```|~~~)[^\n`]*\n(.*?)(?:^\1[ \t]*$|\Z)", m | s)),
        ("`", "markdown", "code", p(r"(?<!`)`([^`\n]+)`(?!`)")),
        ("#", "markdown", "heading", p(r"^(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*$", m)),
        ("=", "markdown", "underlined", p(r"^(?![=\-|{*#>\s])([^\n]+)\n(={3,}|-{4,})[ \t]*$", m)),
        ("[", "markdown", "link", p(r"(!?)\[([^\[\]\n]*)\]\(([^\s()]+(?:\([^\s()]*\)[^\s()]*)*)(?:\s\"[^\"\n]*\")?\)")),
        ("[", "markdown", "task", p(r"^[ \t]*[-*+] \[([ xX])\] +(\S[^\n]*)$", m)),
        ("*", "markdown", "strong", p(r"(?<![*\w])\*\*(?=\S)([^*\n]+)(?<=\S)\*\*(?![*\w])")),
        ("_", "markdown", "strong", p(r"(?<![_\w])__(?=\S)([^_\n]+)(?<=\S)__(?![_\w])")),
        ("*", "markdown", "emphasis", p(r"(?<![*\w])\*(?=[^\s*])([^*\n]+)(?<=[^\s*])\*(?![*\w])")),
        ("_", "markdown", "emphasis", p(r"(?<![_\w\\{}^])_(?=[^\s_{}\\])([^_\n{}\\]+)(?<=[^\s_])_(?![_\w{])")),
        (">", "markdown", "quote", p(r"^>+ ?(\S[^\n]*)$", m)),
        ("|", "markdown", "rule", p(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$", m)),
        ("|", "markdown", "row", p(r"^[ \t]*\|([^\n{}|!+-][^\n]*)\|[ \t]*$", m)),
        ("*", "markdown", "bullet", p(r"^[ \t]*[*+-] (?![\[*])(\S[^\n]*)$", m)),
        ("*", "wiki", "bullet", p(r"^\*{1,4} ?(\[\[\S[^\n]*)$", m)),
        ("[", "wiki", "link", p(r"\[\[([^\[\]\n|]+)(?:\|([^\[\]\n]*))?\]\]")),
        ("{", "wiki", "template", p(r"\{\{([^{}]+)\}\}")),
        ("'", "wiki", "strong", p(r"'''(?!')([^\n]+?)'''(?!')")),
        ("'", "wiki", "emphasis", p(r"(?<!')''(?!')([^'\n]+)''(?!')")),
        ("=", "wiki", "heading", p(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", m)),
        ("{", "wiki", "table", p(r"^\{\|[^\n]*$", m)),
        ("|", "wiki", "table", p(r"^\|(?:\}|-)[^\n|]*$", m)),
        ("!", "wiki", "cells", p(r"^!([^\n]*!![^\n]*)$", m)),
        ("|", "wiki", "cells", p(r"^\| ?([^\n]*\|\|[^\n]*)$", m)),
        ("\\", "latex", "formula", _environments),
        ("\\", "latex", "formula", _bracketed),
        ("\\", "latex", "block", p(r"\\(begin|end)\{([a-zA-Z]+\*?)\}(?:\[[^\]\n]*\])?")),
        ("\\", "latex", "command", p(r"\\([a-zA-Z]+)\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}")),
        ("\\", "latex", "word", p(r"(?<!\\)\\([a-zA-Z]+)\*?(?![a-zA-Z{])")),
        ("$", "latex", "display", p(r"(?<![\\$\w])\$\$((?:[^$\n]|\n(?![ \t]*\n))+)\$\$(?![$\d])")),
        ("$", "latex", "math", p(r"(?<![\\$\w])\$([^$\n]+)\$(?![$\d])")),
    ]


@lru_cache(maxsize=1)
def rules():
    return _rules()


def _form(kind: str, what: str, m: re.Match, text: str) -> str:
    """The observed form of a span: its construct and what tells it apart."""
    g = m.groups()
    before = text[m.start() - 1 : m.start()] if m.start() else "\n"
    if what == "tag":
        known = g[0].lower() in TAGS
        return f"tag_{'known' if known else 'other'}{'_attr' if '=' in (g[1] or '') else ''}"
    if what == "entity":
        return "entity_known" if html.unescape(m.group()) != m.group() else "entity_other"
    if kind == "markdown" and what in ("code", "emphasis", "strong"):
        plain = bool(re.fullmatch(r"[\w.()\-/' ,:]+", g[0])) and any(map(str.isalpha, g[0]))
        return f"{what}_{'plain' if plain else 'signs'}"
    if kind == "markdown" and what == "heading":
        return "heading_words" if any(map(str.isalpha, g[1])) and sum(map(str.isalnum, g[1])) * 2 > len(g[1]) else "heading_signs"
    if kind == "markdown" and what == "link":
        return "link_url" if re.search(r"[./#]", g[2]) else "link_other"
    if what in ("quote", "underlined", "row", "bullet") and kind == "markdown":
        body = g[0]
        words = sum(map(str.isalnum, body)) * 2 > len(body.replace(" ", ""))
        return f"{what}_{'words' if words else 'signs'}"
    if kind == "wiki" and what in ("link", "template", "strong", "emphasis", "heading", "cells"):
        body = g[1] if what == "heading" else g[0]
        return f"{what}_{'words' if sum(map(str.isalnum, body)) * 2 > len(body.replace(' ', '')) else 'signs'}"
    if kind == "latex" and what in ("command", "word"):
        known = "known" if g[0] in COMMANDS else "other"
        place = "_inside" if before.isalnum() or before in ":/\\." else ""
        return f"{what}_{known}{place}"
    if what == "rule":
        return "rule_table" if "|" in m.group() else "rule_plain"
    if what == "display":
        body = g[0]
        sure = any(x in COMMANDS for x in re.findall(r"\\([a-zA-Z]+)", body)) or re.search(r"[a-zA-Z)}\]] ?[_^](?:\{|\w)|[a-zA-Z)][^\w\s]? ?[=<>+−-] ?[-\w(]", body)
        return "display_formula" if sure and not re.search(r"[a-z]{4,} [a-z]{2,} [a-z]{2,}", body) else "display_other"
    if what == "math":
        body = g[0]
        if re.search(r"[a-z]{4,} [a-z]{2,}", body):
            return "math_prose"
        if any(x in COMMANDS for x in re.findall(r"\\([a-zA-Z]+)", body)):
            return "math_command"
        if re.search(r"[a-zA-Z][_^](?:\{|\w)", body):
            return "math_script"
        if re.fullmatch(r"\s*[a-zA-Z]\w{0,2}\s*", body):
            return "math_name"
        if re.search(r"[a-zA-Z]\w* ?[=<>] ?[-\w]", body):
            return "math_relation"
        return "math_price" if re.match(r"\s*\d", body) else "math_prose"
    return what


def spans(text: str) -> list[Span]:
    """Candidate spans; of overlapping ones of one kind the first and longest."""
    found: list[Span] = []
    for sign, kind, what, find in rules():
        if sign in text or (what == "underlined" and "--" in text) or (what == "bullet" and ("- " in text or "+ " in text)) or (what == "rule" and "---" in text) or (what == "task" and "[" in text):
            found.extend(Span(kind, _form(kind, what, m, text), m.start(), m.end(), (what, *m.groups())) for m in find(text))
    found.sort(key=lambda s: (s.begin, -s.end))
    kept = []
    last: dict[str, int] = {}
    # Code and formulas hide what is in them.
    hidden = (-1, -1)
    for s in found:
        if s.end <= hidden[1] and (s.begin, s.end) != hidden:
            continue
        if s.form in _OPAQUE and s.end - s.begin > 2 and s.end > hidden[1]:
            hidden = s.begin, s.end
        if s.begin >= last.get(s.kind, 0) or s.form.startswith(("tag", "entity")):
            kept.append(s)
            # A line's construct may hold others; an inline one may not.
            whole_line = s.groups[0] in ("heading", "quote", "row", "bullet", "task", "underlined", "cells", "block")
            last[s.kind] = s.begin + 1 if whole_line else s.end
    return kept


_OPAQUE = {"fence", "formula", "code_plain", "code_signs", "math_command", "math_script", "display_formula", "comment"}


def blocks(text: str) -> list[int]:
    """Begins of the blocks: after each run of blank lines."""
    return [0] + [m.end() for m in re.finditer(r"\n[ \t]*\n\s*", text)]


class MarkupModel:
    """Potentials of the tree, counted on labelled pages, and the messages."""

    def __init__(self):
        self.prior = np.full((len(KINDS), 2), 1.0)
        self.block = np.full((len(KINDS), 2, 2), 1.0)
        self.span = np.full((len(KINDS), 2, 2), 0.5)
        self.none = np.full((len(KINDS), 2), 1.0)
        self.form: dict[tuple[str, str], np.ndarray] = {}

    def count(self, text: str, marked: list[tuple[int, int, str]]) -> None:
        """Adds a page; ``marked`` has (begin, end, kind) of its markup."""
        begins = blocks(text)
        found = spans(text)
        where = np.searchsorted(begins, [s.begin for s in found], "right") - 1 if found else []
        for k, kind in enumerate(KINDS):
            own = [(int(b), s, int(any(a < s.end and s.begin < e for a, e, x in marked if x == kind))) for b, s in zip(where, found) if s.kind == kind]
            root = int(any(x == kind for *_, x in marked))
            self.prior[k, root] += 1
            for b in range(len(begins)):
                states = [y for at, _, y in own if at == b]
                state = int(any(states))
                self.block[k, root, state] += 1
                if not states:
                    self.none[k, state] += 1
                for y in states:
                    self.span[k, state, y] += 1
            for _, s, y in own:
                self.form.setdefault((kind, s.form), np.zeros(2))[y] += 1

    def close(self) -> MarkupModel:
        """Turns the counts into conditional probabilities."""
        self.prior /= self.prior.sum(1, keepdims=True)
        total = self.block.sum(1)
        self.block /= self.block.sum(2, keepdims=True)
        self.span /= self.span.sum(2, keepdims=True)
        self.none = np.clip(self.none / np.maximum(total, 1), 0.02, 0.98)
        sums = {k: np.zeros(2) for k in KINDS}
        for (kind, _), n in self.form.items():
            sums[kind] += n
        # A form unseen in one state gets a part of its share of all spans.
        self.form = {key: (n + n.sum() / sums[key[0]].sum()) / (sums[key[0]] + 1.0) for key, n in self.form.items()}
        return self

    def marginals(self, text: str, found: list[Span]) -> tuple[dict[str, float], list[float]]:
        """P(the text carries the kind), and P(the span is markup)."""
        begins = blocks(text)
        where = np.searchsorted(begins, [s.begin for s in found], "right") - 1
        roots: dict[str, float] = {}
        each = [0.0] * len(found)
        for k, kind in enumerate(KINDS):
            own = [i for i, s in enumerate(found) if s.kind == kind]
            if not own:
                continue
            likely = np.array([self.form.get((kind, found[i].form), np.full(2, 0.01)) for i in own])
            at = where[own]
            # Up: span to block, in logarithms; then block to root.
            up = np.log(np.maximum(likely @ self.span[k].T, 1e-12))
            used, inverse = np.unique(at, return_inverse=True)
            block = np.zeros((len(used), 2))
            np.add.at(block, inverse, up)
            block += np.log(1 - self.none[k])
            block -= block.max(axis=1, keepdims=True)
            to_root = np.log(np.maximum(np.exp(block) @ self.block[k].T, 1e-12))
            empty = (len(begins) - len(used)) * np.log(self.none[k] @ self.block[k].T)
            # Blocks without spans say little; they mustn't outvote the spans.
            score = np.log(self.prior[k]) + to_root.sum(0) + np.clip(empty - empty.max(), -1.0, 0.0)
            root = np.exp(score - score.max())
            roots[kind] = float(root[1] / root.sum())
            # Down: root without the block's own message, then block to span.
            rest = score[None, :] - to_root
            down = np.exp(rest - rest.max(axis=1, keepdims=True)) @ self.block[k]
            belief = np.log(np.maximum(down, 1e-12)) + block
            for i, row in enumerate(own):
                outer = belief[inverse[i]] - up[i]
                outer = np.exp(outer - outer.max())
                p = (outer @ self.span[k]) * likely[i]
                each[row] = float(p[1] / p.sum())
        return roots, each


# --- the grammar that writes the labelled pages -----------------------------

_W = "river stone market garden winter engine paper window letter city method valley sample theory region copper signal harvest".split()


def _page(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    w = lambda: rng.choice(_W)
    sentence = lambda: f"The {w()} of the {w()} was seen near the {w()}, as the {w()} shows."
    c = lambda: rng.choice("xyzuvw")
    n = lambda: rng.randint(1, 90)
    marked = {
        "html": (
            lambda: f"<p>{sentence()}</p>", lambda: f"The <b>{w()}</b> and the <i>{w()}</i> differ.<br/>", lambda: f"<ul>\n<li>{w()}</li>\n<li>{w()} {w()}</li>\n</ul>", lambda: f"<h{rng.randint(1, 4)}>{w()} {w()}</h2>\n{sentence()}",
            lambda: f'{sentence()} <a href="http://x.example/{n()}">{w()}</a>.', lambda: f"{sentence()[:-1]}&nbsp;&mdash; the {w()} &amp; the {w()}.", lambda: f"<table><tr><td>{w()}</td><td>{n()}</td></tr></table>", lambda: f"<!-- {w()} {w()} -->\n{sentence()}",
            lambda: f"<pre><code>for {c()} in range({n()}):\n    f({c()})\n</code></pre>", lambda: f'<div class="a">{sentence()}</div>', lambda: f"{sentence()[:-1]} with {c()}<sub>{n()}</sub> &lt; 0.{n()}.", lambda: f"{sentence()[:-1]} &#8211; {w()}&quot;s {w()}.",
        ),
        "markdown": (
            lambda: f"{'#' * rng.randint(1, 4)} {w()} {w()}", lambda: f"{w().title()} {w()}\n{'=' * rng.randint(5, 12)}", lambda: f"See [{w()} {w()}](http://x.example/{n()}) for the {w()}.", lambda: f"![{w()}](fig{n()}.png)", lambda: f"The **{w()} {w()}** is not the _{w()} {w()}_.", lambda: f"The *{w()}* is old.",
            lambda: f"```python\n{c()} = load({n()})\nprint({c()})\n```", lambda: f"Call `{c()}.fit()` before the **{w()}**.", lambda: f"| {w()} | {w()} |\n|---|---|\n| {n()} | {n()} |", lambda: f"> {sentence()}", lambda: f"- [ ] {w()} {w()}\n- [x] {w()}", lambda: f"1. **{w()} {w()}**\n2. {w()}",
        ),
        "wiki": (
            lambda: f"== {w().title()} {w()} ==\n{sentence()}", lambda: f"=== {w()} ===\n* [[{w()} {w()}]]\n* [[{w()}]]", lambda: f"The '''{w()} {w()}''' is a ''{w()} {w()}''.", lambda: f"{sentence()[:-1]}, see [[{w().title()}|the {w()}]].", lambda: f"{{{{main|{w()} {w()}}}}} {sentence()}",
            lambda: f"{{{{cite book|title={w()}|year={1990 + n() // 4}}}}}", lambda: f"[[Category:{w().title()}]]", lambda: f'{{| class="wikitable"\n! {w()} !! {w()}\n|-\n| {n()} || {n()}\n|}}',
        ),
        "latex": (
            lambda: f"\\section{{{w()} {w()}}}\n{sentence()}", lambda: f"The \\emph{{{w()}}} of \\textbf{{{w()} {w()}}} is small.", lambda: f"where ${c()}_i \\le {n()}^{{k}}$ bounds the {w()}.", lambda: f"\\[ \\sum_{{i=1}}^{{n}} {c()}_i = {n()} \\]\nfor each {w()}.", lambda: f"\\begin{{equation}}\n{c()}_{{t+1}} = \\alpha {c()}_t\n\\end{{equation}}",
            lambda: f"\\begin{{itemize}}\n\\item {w()} {w()}\n\\item {w()}\n\\end{{itemize}}", lambda: f"{sentence()[:-1]} \\cite{{{w()}{n()}}}.", lambda: f"As in Section~\\ref{{sec:{c()}}}, {sentence()}", lambda: f"The {w()} has $\\hat{{{c()}}} \\approx 0.{n()}$ on average.", lambda: f"The value ${c()}$ is $ {c()} = {n()} $.",
            lambda: f"{sentence()}\n$$\n{c()}^{n()} + {c()}^2\n$$", lambda: f"$${c()} = {n()} {c()}$$\nholds for the {w()}.", lambda: f"$$\n\\sum_{{i=1}}^{{n}} {c()}_i \\leq {n()}\n$$",
        ),
    }
    plain = (
        lambda: f"It costs between ${n()} and ${n()} per {w()}.", lambda: f"The price rose from $ {n()} to ${n()}, and the {w()} fell.", lambda: f"The file is in data\\raw\\{w()} and ~{n()}% of it is used.", lambda: f"See C:\\{w()}\\{w()}\\x{n()}.txt.", lambda: f"With R^2 = 0.{n()} and x_1 fixed, it is {n()} * {n()}.",
        lambda: f"It holds for p < 0.0{n()} and for q > {n()} alike.", lambda: f"We store it as run_{w()}_{n()} and call f(x)*g(x) once.", lambda: f"The R&D group used C++ and {{a, b}} as its two states.", lambda: f"As noted in [{n()}], the {w()} is item #{n()} on the list.", lambda: f"Two points:\n• {w()} {w()}\n• {w()}",
        lambda: "".join(rng.choice("%&/()=?#+*~<>|^ !;:._-[]{}$") for _ in range(rng.randint(40, 300))), lambda: "\n".join("".join(rng.choice("%&/()=?#+*~<>|^ !;:._-[]{}$\\'") for _ in range(60)) for _ in range(5)), lambda: f"{w()};{n()};{w()}\n{w()};{n()};{w()}", lambda: f"- {w()} {w()}\n- {w()}\n- {w()} of the {w()}", lambda: f"{n()}. {w()} {w()}\n{n()}. {w()}",
        lambda: " | ".join(["Home", "Menu", "Skip to content"] * 3), lambda: "(cid:12) (cid:44) (cid:7)", lambda: f"{w().title()} .............. {n()}", lambda: "-" * rng.randint(10, 50) + f"\n{sentence()}", lambda: f"* {w()} {w()}\n* {w()}", lambda: f"{w()}  {n()}.3 ± 0.{n()}  {n()}", lambda: f"The {w()} said 'no' and ''yes' twice.", lambda: f"The {w()} costs $$ and the {w()} of the {w()} costs $$ here.", lambda: f"$$ {rng.choice('%&/()')} {n()} $$",
        lambda: "\n".join(rng.choice("|!=*>#{") + "".join(rng.choice("%&/()=?#+*~<>|^ !;:.@") for _ in range(60)) + rng.choice(["||", "!!", "==", "*"]) + "".join(rng.choice("%&/()=?#+*~<>|^ !;:.@") for _ in range(60)) for _ in range(2)),
    )
    kinds = rng.sample(KINDS, rng.choice([0, 0, 0, 1, 1, 1, 2, 3]))
    parts: list[tuple[str, str | None]] = [(sentence(), None) for _ in range(rng.randint(0, 5))]
    for kind in kinds:
        parts += [(rng.choice(marked[kind])(), kind) for _ in range(rng.randint(1, 3))]
    if rng.random() < 0.6:
        parts += [(rng.choice(plain)(), None) for _ in range(rng.randint(1, 2))]
    rng.shuffle(parts)
    text, at = "", []
    for body, kind in parts:
        if text:
            text += "\n\n"
        if kind:
            at.append((len(text), len(text) + len(body), kind))
        text += body
    return text, at


@lru_cache(maxsize=2)
def train(pages: int = PAGES, seed: int = SEED) -> MarkupModel:
    rng = random.Random(seed)
    model = MarkupModel()
    for _ in range(pages):
        model.count(*_page(rng))
    return model.close()


def kinds_of(text: str, model: MarkupModel) -> list[str]:
    found = spans(text)
    if not found:
        return []
    roots, _ = model.marginals(text, found)
    return [k for k in KINDS if roots.get(k, 0.0) >= 0.5]


# --- the clean text ----------------------------------------------------------

_HEAD, _ITEM, _CODE, _FORMULA, _ROW, _END = "\x01H", "\x01L", "\x01C", "\x01F", "\x01R", "\x01E"
_BLOCK_TAGS = {"p", "div", "section", "article", "table", "ul", "ol", "dl", "body", "html", "blockquote", "figure", "header", "footer", "main", "center", "thead", "tbody"}


def _plain(span: Span, inner) -> str:
    """What a span of markup becomes; ``inner`` converts a part of the text."""
    what, *g = span.groups
    if what == "comment":
        return ""
    if what == "entity":
        return html.unescape(f"&{g[0]};").replace("\xa0", " ")
    if what == "tag":
        name, closing = g[0].lower(), span.form and span.groups[-1] == "/"
        if re.fullmatch(r"h[1-6]", name):
            return _END if closing else _HEAD
        if name in ("pre", "code"):
            return (_END if closing else _CODE) if name == "pre" else ""
        if name in ("li", "dt", "dd"):
            return _END if closing else _ITEM
        if name == "tr":
            return _END if closing else _ROW
        if name in ("td", "th"):
            return "" if closing else "\x01T"
        if name == "br":
            return "\n"
        if name in ("sub", "sup"):
            return "" if closing else "_" if name == "sub" else "^"
        return "\n\n" if name in _BLOCK_TAGS else ""
    if what == "fence":
        return f"{_CODE}{g[1]}{_END}"
    if what in ("code", "strong", "emphasis", "quote"):
        return inner(g[0])
    if what == "heading":
        return f"{_HEAD}{inner(g[1])}{_END}"
    if what == "underlined":
        return f"{_HEAD}{inner(g[0])}{_END}"
    if what in ("task", "bullet"):
        return f"{_ITEM}{inner(g[-1])}{_END}"
    if what == "link" and span.kind == "markdown":
        return inner(g[1])
    if what == "link":
        return "" if re.match(r"(?i)(?:category|file|image):", g[0]) else inner(g[1] or g[0])
    if what in ("rule", "template", "table"):
        return ""
    if what in ("row", "cells"):
        cells = [x.strip() for x in re.split(r"\|\||!!|\|", g[0])]
        return _ROW + "".join("\x01T" + inner(x) for x in cells) + _END
    if what in ("formula", "display"):
        return f"{_FORMULA}{g[-1].strip()}{_END}"
    if what == "math":
        return g[0].strip()
    if what == "block":
        return ""
    if what == "command":
        if g[0] in ("section", "subsection", "subsubsection", "chapter", "title", "paragraph"):
            return f"{_HEAD}{inner(g[1])}{_END}"
        return "" if g[0] in ("cite", "citep", "citet", "ref", "eqref", "label", "bibliography", "usepackage", "documentclass", "includegraphics", "input") else inner(g[1])
    if what == "word":
        return _ITEM if g[0] == "item" else "" if g[0] == "maketitle" else "\\" + g[0]
    return ""


def _converted(text: str, model: MarkupModel, kinds: list[str] | None, depth: int = 0) -> tuple[str, list[str]]:
    found = spans(text)
    if not found:
        return text, kinds or []
    roots, each = model.marginals(text, found)
    if kinds is None:
        kinds = [k for k in KINDS if roots.get(k, 0.0) >= 0.5]
    out, at = [], 0
    inner = lambda part: _converted(part, model, kinds, depth + 1)[0] if depth < NESTED else part
    for s, p in sorted(zip(found, each), key=lambda x: (x[0].begin, -x[0].end)):
        if s.begin < at or s.kind not in kinds or (p < 0.5 and depth == 0):
            continue
        if s.groups[0] == "tag":
            s.groups = (*s.groups, "/" if text[s.begin + 1] == "/" else "")
        out.append(text[at : s.begin])
        out.append(_plain(s, inner))
        at = s.end
    out.append(text[at:])
    return "".join(out), kinds


def clean(text: str, model: MarkupModel) -> tuple[list[str], str, list[tuple[str, str]]]:
    """(kinds of markup, clean text, blocks as (kind, text)) of a text.

    A text without markup stays as it is, in one paragraph block.
    """
    marked, kinds = _converted(text, model, None)
    if not kinds:
        return [], text, [("paragraph", text)] if text.strip() else []
    if "latex" in kinds:
        marked = re.sub(r"(?<=\w)~(?=\S)", " ", marked)
    found: list[tuple[str, str]] = []
    names = {"H": "heading", "L": "list", "C": "code", "F": "formula", "R": "table"}

    def add(kind: str, body: str) -> None:
        body = re.sub("\x01.", " ", body.replace("\x01T", " | "))
        if kind == "code":
            body = html.unescape(body.strip("\n"))
        else:
            body = "\n".join(re.sub(r"[ \t]+", " ", x).strip() for x in body.split("\n")).strip()
            body = re.sub(r" +([.,;:!?])", r"\1", body.removeprefix("| "))
        if body.strip(" |\n"):
            found.append((kind, body))

    at = 0
    for m in re.finditer("\x01([HLCFR])", marked):
        if m.start() < at:
            continue
        for block in re.split(r"\n\s*\n", marked[at : m.start()].replace(_END, "")):
            add("paragraph", block)
        kind = m.group(1)
        stop = marked.find(_END, m.end())
        if kind == "L":
            follow = min((x for x in (stop, marked.find(_ITEM, m.end()), marked.find("\n", m.end())) if x >= 0), default=len(marked))
            stop = follow
        end = len(marked) if stop < 0 else stop
        add(names[kind], marked[m.end() : end])
        at = end + len(_END) if marked.startswith(_END, end) else end
    for block in re.split(r"\n\s*\n", marked[at:].replace(_END, "")):
        add("paragraph", block)
    lines: list[str] = []
    for i, (kind, body) in enumerate(found):
        joint = "\n" if i and kind == found[i - 1][0] and kind in ("list", "table") else "\n\n"
        lines.append((joint if lines else "") + (f"- {body}" if kind == "list" else body))
    return kinds, "".join(lines), found


def markup(df: DataFrame, record_type: str, key: str, text: str) -> DataFrame:
    """(record_type, record_key, markup): a row for each kind in a text."""
    source = df.select(df[key].cast("string").alias("record_key"), df[text].alias("item_text")).where(F.col("item_text").rlike(TRIGGER))
    sent = df.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            keys, kinds = [], []
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                for k, t in zip(*(part.column(i).to_pylist() for i in (0, 1))):
                    own = kinds_of(t, model)
                    keys += [k] * len(own)
                    kinds += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.string())], ["record_key", "markup"])

    return source.mapInArrow(run, "record_key string, markup string").select(F.lit(record_type).alias("record_type"), "record_key", "markup")


def cleaned(df: DataFrame, record_type: str, key: str, text: str) -> DataFrame:
    """(record_type, record_key, markup, clean_text, blocks) of every row."""
    source = df.select(df[key].cast("string").alias("record_key"), df[text].alias("item_text"))
    sent = df.sparkSession.sparkContext.broadcast(train())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                rows = [([], t, []) if t is None else clean(t, model) for t in part.column(1).to_pylist()]
                structs = [[{"kind": a, "text": b} for a, b in r[2]] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.string()), pa.array(structs, kind)], ["record_key", "markup", "clean_text", "blocks"]
                )

    out = source.mapInArrow(run, "record_key string, markup array<string>, clean_text string, blocks array<struct<kind string, text string>>")
    return out.select(F.lit(record_type).alias("record_type"), "*")


_FIELDS = (("papers", "paper", "doc_id", "full_text"), ("chunks", "chunk", "chunk_id", "text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (markup(table(spark, sf_dir, name), kind, key, text) for name, kind, key, text in _FIELDS)
    return a.unionByName(b).distinct()


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first load of each record, cleaned."""
    rows = None
    for name, kind, key, text in _FIELDS:
        first = first_loads(table(spark, sf_dir, name).select(key, text, "ingested_at"), [key], [F.col("ingested_at"), F.xxhash64(text)])
        own = cleaned(first, kind, key, text)
        rows = own if rows is None else rows.unionByName(own)
    return rows


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean text and the blocks of every record."""
    return _clean(spark, sf_dir)


def p2_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records without any sign of markup, and what cleaning leaves of them."""
    rows = _clean(spark, sf_dir).where(~F.coalesce(F.col("clean_text"), F.lit("")).rlike(TRIGGER) & (F.size("markup") == 0))
    return rows.select("record_type", "record_key", F.md5("clean_text").alias("digest"))


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean, "p2_plain": p2_plain}
_SIGNS = TRIGGER.replace("'", "''")
SQL = {
    "p2_plain": " UNION ALL ".join(
        f"SELECT '{kind}' AS record_type, {key} AS record_key, md5({text}) AS digest FROM (SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ingested_at) = 1) WHERE NOT regexp_matches(coalesce({text}, ''), '{_SIGNS}')"
        for name, kind, key, text in _FIELDS
    )
}
