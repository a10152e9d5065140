"""Markup residue in page texts: HTML, Markdown, wiki and LaTeX to clean text with structure.

A page is read in three steps. Literal regions (comments, code, formulas, nowiki) are lifted out in one scan; templates,
tables, scripts and page boxes are containers that are read like the rest. Then the text is cut into blocks, each with
its kind and its container. Last, every block, headings and list items too, is labelled content or boilerplate by a
minimum cut: a logistic classifier's costs are the terminal capacities, neighbouring blocks and blocks of one container
are tied by smoothness edges, and max-flow finds the cheapest labelling of the page as a whole.

The classifier is fitted to pages that are put together here from sentences and words of a sample of the pages, with
content and boilerplate (infoboxes, navigation, footers, scripts, data tables, category links) planted, so that the label
of each block is known from where it was planted and not from how it was read.
"""

from __future__ import annotations

import html
import random
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages sampled for their words and the most characters of one of them; pages put together for training.
TRAIN_ROWS, TRAIN_CHARS, PLANTED = 300, 20_000, 800
#: Capacities of the edges between neighbours, between neighbours in different containers, and within a container.
NEXT, ACROSS, SAME = 0.4, 0.1, 0.2

#: LaTeX environments that hold code, and that are one formula.
CODE_ENVS = "verbatim|Verbatim|lstlisting|minted|alltt"
MATH_ENVS = "equation|align|alignat|gather|multline|flalign|eqnarray|displaymath|math"
_OPEN = re.compile(
    rf"""(?=[<`~\\${{%]|^[ ]{{1,3}}[`~{{])(?:  # what a region can start with, so that most places fail at once
    (?P<comment><!--)
    |(?P<nowiki><nowiki\b[^<>]*?(?P<void>/)?>)
    |<(?P<hidden>script|style)\b[^<>]*>
    |<(?P<code>pre|syntaxhighlight|source)\b(?P<attrs>[^<>]*)>
    |<(?P<inline>code|tt|kbd|samp)\b[^<>]*>
    |(?P<ref><ref\b[^<>]*?(?P<refvoid>/)?>)
    |<(?P<math>math|chem)\b[^<>]*>
    |^[ ]{{0,3}}(?P<fence>`{{3,}}(?=[^`\n]*$)|~{{3,}})[^\n]*$
    |\\begin\{{(?P<codeenv>{CODE_ENVS})\*?\}}
    |\\begin\{{(?P<mathenv>(?:{MATH_ENVS})\*?)\}}
    |(?P<verb>\\verb\*?(?P<bar>[^\w\s*]))
    |(?P<tick>`+)
    |(?P<escape>\\[\\$%`*_#&{{}}])
    |(?P<bracket>\\\[)|(?P<paren>\\\()
    |(?P<display>\$\$)|(?P<dollar>\$)
    |(?P<template>\{{\{{)
    |(?P<table>^[ ]*\{{\|)
    |(?P<percent>%))""",
    re.VERBOSE | re.MULTILINE | re.IGNORECASE,
)
_INLINE_DOLLAR = re.compile(r"\$(?=[^\s$])(?:\\.|[^\\$\n]|\n(?!\s*\n))*?(?<=[^\s\\])\$(?!\d)", re.DOTALL)
_TEX = re.compile(r"\\(?:(?:sub)*section|chapter|part|paragraph|emph|textbf|textit|cite|footnote|item|documentclass|begin)\b")
_WIKI = re.compile(r"\[\[|'''?|\{\{|^=+[^=\n].*=\s*$|^\{\||<ref|</?small>|^[:;*#]+[^\s#*]|^[*#]*(?:#\*|\*#|##|\*\*)[^\n*]*$", re.MULTILINE)
_MARKDOWN = re.compile(r"\]\(|\*\*[^\s*](?:[^*\n]*[^\s*])?\*\*|(?<!_)__[^\s_][^_\n]*__|(?<!`)`[^`\n]+`|^\s*(?:```|~~~)|^> |^\d+[.)] |^ *[+-] |^\S[^\n]*\n(?:={2,}|-{2,})\s*$|(?<![*\w])\*[^\s*][^*\n]*\*(?!\*)|^#{1,6} .*#$", re.MULTILINE)
_WIKI_ONLY = re.compile(r"\[\[|'''|(?<!')''(?!')|\{\{|^=+[^=\n].*=\s*$|^\{\||<ref|</?small>", re.MULTILINE)
_REDIRECT = re.compile(r"\s*#(?:redirect|weiterleitung|redirection|redirección|redirecci[oó]n)\b", re.IGNORECASE)


@dataclass
class Region:
    kind: str  # comment, hidden, literal, code, formula, template, table
    text: str
    sign: str = ""  # wiki or markdown, if only that language writes it


@dataclass
class Block:
    kind: str  # heading, list_item, code, formula (in or between lines), text, link
    text: str
    inside: str = ""  # innermost container: list, nav, footer, header, aside, template, table, hidden
    formulas: int = 0
    box: int = field(default=0, repr=False)  # which one on the page, 0 for none
    keep: bool = True


def is_redirect(text: str) -> bool:
    return bool(_REDIRECT.match(text))


def _balanced(text: str, at: int, opening: str, closing: str) -> int:
    """End of the bracket that opens at `at`, or -1."""
    depth, i = 0, at
    step = re.compile(f"{re.escape(opening)}|{re.escape(closing)}")
    while m := step.search(text, i):
        depth += 1 if m[0] == opening else -1
        i = m.end()
        if not depth:
            return i
    return -1


def _find(text: str, pattern: str, at: int) -> re.Match | None:
    return re.compile(pattern, re.IGNORECASE).search(text, at)


def lift(text: str, tex: bool, nested: bool = False) -> tuple[str, list[Region]]:
    """The text with a number between private-use characters for every region, and the regions in order.

    What opens first wins; a region that is never closed is ordinary text, but for comments and fences, which end with
    the page. tex: `%` starts a comment. nested: the text of a container, whose own templates and tables stay in it.
    """
    out, regions, at = [], [], 0
    lower: str | None = None

    def close(tag: str, start: int) -> int:
        nonlocal lower
        if lower is None:
            lower = text.lower()
        return lower.find(f"</{tag}", start)

    def put(kind: str, start: int, end: int, inner: str, sign: str = "") -> int:
        nonlocal at
        out.append(f"{text[at:start]}\ue000{len(regions)}\ue001")
        regions.append(Region(kind, inner, sign))
        at = end
        return end

    pos = 0
    while m := _OPEN.search(text, pos):
        s, e = m.span()
        pos = e
        if m["comment"]:
            j = text.find("-->", e)
            pos = put("comment", s, len(text) if j < 0 else j + 3, "")
        elif m["nowiki"]:
            j = e if m["void"] else close("nowiki", e)
            if j >= 0:
                pos = put("literal", s, j if m["void"] else text.find(">", j) + 1 or len(text), "" if m["void"] else text[e:j], "wiki")
        elif m["ref"]:
            j = e if m["refvoid"] else close("ref", e)
            if j >= 0:
                pos = put("comment", s, j if m["refvoid"] else text.find(">", j) + 1 or len(text), "", "wiki")
        elif m["hidden"] or m["code"] or m["inline"] or m["math"]:
            tag = (m["hidden"] or m["code"] or m["inline"] or m["math"]).lower()
            j = close(tag, e)
            if j >= 0:
                end = text.find(">", j) + 1 or len(text)
                k = "hidden" if m["hidden"] else "formula" if m["math"] else "literal" if m["inline"] or re.search(r"\binline\b", m["attrs"] or "") else "code"
                pos = put(k, s, end, text[e:j], "wiki" if tag in ("syntaxhighlight", "source") else "")
        elif m["fence"]:
            f = m["fence"]
            j = re.compile(rf"^[ ]{{0,3}}{re.escape(f[0])}{{{len(f)},}}[ \t]*$", re.MULTILINE).search(text, e)
            pos = put("code", s, j.end() if j else len(text), text[e + 1 : j.start() if j else len(text)])
        elif m["codeenv"] or m["mathenv"]:
            j = re.compile(rf"\\end\{{{re.escape(m['codeenv'] or m['mathenv'])}\*?\}}").search(text, e)
            if j:
                pos = put("code" if m["codeenv"] else "formula", s, j.end(), text[e : j.start()])
        elif m["verb"]:
            j = text.find(m["bar"], e)
            if 0 <= j and "\n" not in text[e:j]:
                pos = put("literal", s, j + 1, text[e:j])
        elif m["tick"]:
            j = re.compile(rf"(?<!`){m['tick']}(?!`)").search(text, e)
            if j and "\n\n" not in text[e : j.start()]:
                pos = put("literal", s, j.end(), text[e : j.start()], "markdown")
        elif m["escape"]:
            pos = put("literal", s, e, m["escape"][1]) if tex or m["escape"] not in ("\\\\",) else e
        elif m["bracket"] or m["paren"] or m["display"]:
            j = text.find("\\]" if m["bracket"] else "\\)" if m["paren"] else "$$", e)
            if j > e and (m["bracket"] or "\n\n" not in text[e:j]):
                pos = put("formula", s, j + 2, text[e:j])
        elif m["dollar"]:
            k = _INLINE_DOLLAR.match(text, s)
            if k:
                pos = put("formula", s, k.end(), text[e : k.end() - 1])
        elif m["template"]:
            j = _balanced(text, s, "{{", "}}")
            if j > 0:
                inner = text[e : j - 2]
                name, _, args = inner.partition("|")
                name = name.strip().lower()
                if name in ("math", "mvar", "tmath"):
                    pos = put("formula", s, j, args, "wiki")
                elif "\n" in inner or name.startswith("infobox"):
                    pos = e if nested else put("template", s, j, inner, "wiki")
                else:  # its last argument is what a reader sees
                    pos = put("literal" if "|" in inner else "comment", s, j, inner.rpartition("|")[2], "wiki")
        elif m["table"]:
            j = -1 if nested else _balanced(text, m.end() - 2, "{|", "|}")
            if j > 0:
                pos = put("table", s, j, text[e : j - 2], "wiki")
        elif m["percent"] and tex:
            j = text.find("\n", e)
            pos = put("comment", s, len(text) if j < 0 else j, "")
    out.append(text[at:])
    return "".join(out), regions


_TOKEN = re.compile("\ue000([0-9]+)\ue001")
_HTML_BLOCK = re.compile(r"<(h[1-6]|li|p|div|ul|ol|td|th|tr|table|blockquote|nav|footer|header|aside|section|article|body|dd|dt|dl)\b[^<>]*>|</(h[1-6]|li|ul|ol|p|div|nav|footer|header|aside)\s*>", re.IGNORECASE)
_TEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?\s*(?:\[[^\]]*\]\s*)?\{")
_TEX_ITEM = re.compile(r"\\item\b(?:\s*\[[^\]]*\])?")
_WIKI_HEAD = re.compile(r"=+(?=[^=]).*?[^=\s]\s*=+\s*")
_WIKI_LIST = re.compile(r"[:;]*[*#][*#:;]*")
_MD_LIST = re.compile(r"\s*(?:[*+-]|\d{1,9}[.)])(?:[ \t]+|$)")
_ATX = re.compile(r" {0,3}#{1,6}(?:[ \t]+|$)")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_HR = re.compile(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_AWAY = re.compile(r"\[\[\s*(?:category|kategorie|catégorie|categoría|file|image|datei|fichier|archivo)\s*:[^\]]*\]\]", re.IGNORECASE)


def dialect(text: str) -> str:
    """`wiki`, `markdown` or `plain`: how the signs at the start of a line are meant. Taken from what lines have inside."""
    w, m = len(_WIKI_ONLY.findall(text)), len(_MARKDOWN.findall(text))
    if not w and not m:
        w, m = len(_WIKI.findall(text)), len(re.findall(r"^(?:#{1,6} |[*+-] )", text, re.MULTILINE))
    return "plain" if not w and not m else "wiki" if w >= m else "markdown"


_TEMPLATE_NAME = re.compile(r"\A[^|\n]*")
_BOXES = ("nav", "footer", "header", "aside")
_CONTAINERS = ("template", "table", "hidden")


def blocks(text: str) -> list[Block]:
    """The blocks of a page in order; regions stand where they were."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\ue000", "").replace("\ue001", "")
    tex = len(_TEX.findall(text)) >= 1
    tex_notes = tex and not re.search(r"\[\[|<p>|\{\{", text)
    flat, regions = lift(text, tex_notes)
    signs = {"wiki": "[[x]]", "markdown": "`x`", "": "x"}
    kind = dialect(_TOKEN.sub(lambda m: signs[regions[int(m[1])].sign], flat))
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    boxes = 0

    def enter(name: str) -> None:
        nonlocal boxes
        boxes += 1
        stack.append((name, boxes))

    def where(item: bool = False) -> tuple[str, int]:
        """The container that counts: the innermost one that is no list, else the list."""
        return next((x for x in reversed(stack) if x[0] != "list"), stack[-1] if stack else ("list" if item else "", 0))

    def add(k: str, t: str, regions: list[Region]) -> None:
        """One block of text with the regions in it; code stands by itself, containers are read on their own."""
        formulas, parts, at = 0, [], 0
        alone: list[Region] = []
        for m in _TOKEN.finditer(t):
            r = regions[int(m[1])]
            parts.append(t[at : m.start()])
            at = m.end()
            if r.kind == "formula":
                formulas += 1
                parts.append(f"${r.text.strip()}$")
            elif r.kind == "literal":
                parts.append(r.text)
            elif r.kind != "comment":
                alone.append(r)
        body = "".join(parts) + t[at:]
        inside, box = where(k == "list_item")
        if k != "text" or body.strip():
            b = Block("link" if k == "text" and not _AWAY.sub("", body).strip() else k, body, inside, formulas, box)
            if k == "text" and formulas and not re.sub(r"\$[^$]*\$|[:\s]|<[^<>]*>", "", body):
                b.kind = "formula"
            out.append(b)
        for r in alone:
            if r.kind == "code":
                out.append(Block("code", r.text, inside, 0, box))
            else:
                enter(r.kind)
                read(*lift(_TEMPLATE_NAME.sub("", r.text) if r.kind == "template" else r.text, tex_notes, nested=True))
                stack.pop()

    def read(flat: str, regions: list[Region]) -> None:
        depth = len(stack)
        para: list[str] = []

        def flush(k: str = "text") -> None:
            if para:
                t = "\n".join(para)
                para.clear()
                add(k, t, regions)

        def line(raw: str) -> None:
            bare = _TOKEN.sub(lambda m: "" if regions[int(m[1])].kind == "comment" else m[0], raw)
            s = bare.strip()
            if not s:
                flush()
            elif kind != "markdown" and _WIKI_HEAD.fullmatch(s) and bare[0] == "=" or kind == "markdown" and re.fullmatch(r"(={2,6})[^=\n]+\1", s):
                flush()
                add("heading", s.strip("= "), regions)
            elif kind != "wiki" and _ATX.match(bare) and s.strip("#").strip():
                flush()
                add("heading", s.strip("# "), regions)
            elif kind == "markdown" and para and _SETEXT.match(bare) and not (_MD_LIST.match(para[-1]) and len(para) == 1):
                flush("heading")
            elif _HR.match(bare):
                flush()
            elif kind == "wiki" and (m := _WIKI_LIST.match(bare)) and m[0][-1] in "*#" or kind != "wiki" and (m := _MD_LIST.match(bare)) and bare[m.end() :].strip():
                flush()
                add("list_item", bare[m.end() :], regions)
            elif s[0] in "|!" and stack and stack[-1][0] in ("template", "table"):  # an argument or a row of cells
                flush()
                add("text", s, regions)
            else:
                para.append(bare)

        def chunk(t: str) -> None:
            """Text without block tags: LaTeX commands cut it further, then lines."""
            at = 0
            for m in re.finditer(rf"{_TEX_HEAD.pattern}|{_TEX_ITEM.pattern}|\\(?:begin|end)\{{\w+\*?\}}", t) if tex else ():
                if m.start() < at:
                    continue
                for x in t[at : m.start()].split("\n"):
                    line(x)
                flush()
                at = m.end()
                if m[0].endswith("{") and not m[0].startswith("\\begin"):
                    e = _balanced(t, m.end() - 1, "{", "}")
                    e = e if e > 0 else len(t)
                    add("heading", t[m.end() : e - 1], regions)
                    at = e
                elif m[0].startswith("\\item"):
                    e = re.compile(r"\\item\b|\\(?:begin|end)\{|\n\s*\n").search(t, at)
                    e = e.start() if e else len(t)
                    add("list_item", t[at:e], regions)
                    at = e
            for x in t[at:].split("\n"):
                line(x)

        at = 0
        for m in _HTML_BLOCK.finditer(flat):
            if m.start() < at:
                continue
            chunk(flat[at : m.start()])
            flush()
            at = m.end()
            tag = (m[1] or m[2]).lower()
            if m[1] and (tag[0] == "h" and tag[1:].isdigit() or tag == "li"):
                e = re.compile(r"<(?:h[1-6]|li|ul|ol|p|div)\b|</(?:h[1-6]|li|ul|ol|nav|footer|header|aside)\s*>", re.IGNORECASE).search(flat, at)
                e = e.start() if e else len(flat)
                first, gap, rest = flat[at:e].partition("\n\n") if tag == "li" else (flat[at:e], "", "")
                add("list_item" if tag == "li" else "heading", first, regions)
                at = e - len(rest)
            elif m[1] and tag in ("ul", "ol", *_BOXES):
                enter("list" if tag in ("ul", "ol") else tag)
            elif m[2] and tag in ("ul", "ol", *_BOXES):
                name = "list" if tag in ("ul", "ol") else tag
                if name in [x for x, _ in stack[depth:]]:
                    while stack.pop()[0] != name:
                        pass
        chunk(flat[at:])
        flush()
        del stack[depth:]

    read(flat, regions)
    return out


# --- labelling ------------------------------------------------------------------------------------------------------

_PLAIN = re.compile(r"(?:[^\W\d_]| )+")
_LINKED = re.compile(r"\[\[[^\[\]]*\]\]|<a\b[^<>]*>.*?</a\s*>|(?<!!)\[[^\[\]]*\]\([^()\s]*\)", re.DOTALL | re.IGNORECASE)
_PAIR = re.compile(r"\s*(?:[|!]|[\w -]{1,40}=)")
_SHAPES = ("heading", "list_item", "code", "formula")
_WHERE = ("template", "table", "hidden", *_BOXES)
_FEATURES = 9 + len(_SHAPES) + len(_WHERE) + 2


def features(bs: list[Block]) -> np.ndarray:
    """A row a block: its words and signs, its shape and container, and the words and links of its neighbours."""
    rows = np.zeros((len(bs), _FEATURES))
    for row, b in zip(rows, bs):
        t = b.text
        n = max(1, len(t))
        words = len(t.split())
        row[:9] = (
            1.0,
            min(words, 40) / 20,
            sum(map(len, _PLAIN.findall(t))) / n,
            sum(map(t.count, "|=[]{}<>/")) / n * 5,
            float(t.rstrip()[-1:] in ".!?:;…»”\"'。"),
            sum(map(len, _LINKED.findall(t))) / n if "[" in t or "<" in t else 0.0,
            float(bool(_PAIR.match(t))),
            sum(map(t.count, ";()'\"")) / n * 5,
            float(words < 3),
        )
        if b.kind in ("code", "formula"):
            row[[3, 6, 7]] = 0.0  # signs are what code and formulas are made of
        if b.kind in _SHAPES:
            row[9 + _SHAPES.index(b.kind)] = 1.0
        if b.inside in _WHERE:
            row[9 + len(_SHAPES) + _WHERE.index(b.inside)] = 1.0
    if len(bs) > 1:  # neighbours count within a container, their links in those that are no lists
        box = np.array([b.box for b in bs])
        near = (box[1:] == box[:-1])[:, None]
        around = rows[:, [1, 5]] * np.stack([np.ones(len(bs)), [b.inside in _WHERE for b in bs]], 1) / 2
        rows[1:, -2:] += around[:-1] * near
        rows[:-1, -2:] += around[1:] * near
    return rows


class _Planter:
    """Pages with content and boilerplate in known places: each block holds a word of its own, whose label is known."""

    def __init__(self, rnd: random.Random, sentences: list[str], words: list[str]):
        self.rnd, self.sentences, self.words = rnd, sentences or ["The lake covers many fields."], words or ["lake", "mill", "old"]
        self.labels: dict[str, int] = {}

    def mark(self, label: int) -> str:
        w = "zq" + "".join("abcdefghij"[int(c)] for c in str(len(self.labels))) + "x"
        self.labels[w] = label
        return w

    def some(self, n: int) -> str:
        return " ".join(self.rnd.choice(self.words) for _ in range(n))

    def short(self, label: int) -> str:
        return f"{self.mark(label).capitalize()} {self.some(self.rnd.randrange(0, 4))}".strip()

    def linked(self, dialect: str, label: int) -> str:
        t = self.short(label)
        return {"wiki": f"[[{t}]]", "html": f'<a href="/p/{self.rnd.randrange(99)}">{t}</a>', "markdown": f"[{t}](/p/{self.rnd.randrange(99)})", "latex": t}[dialect]

    def sentence(self, label: int) -> str:
        first, _, rest = self.rnd.choice(self.sentences).partition(" ")
        return f"{first} {self.mark(label)} {rest}"

    def item(self, dialect: str) -> str:
        return self.rnd.choice((lambda: self.short(1), lambda: self.sentence(1), lambda: self.linked(dialect, 1) + " " + self.some(2)))()

    def content(self, dialect: str) -> str:
        r, what = self.rnd, self.rnd.random()
        if what < 0.35:
            t = " ".join(self.sentence(1) for _ in range(r.randrange(1, 4)))
            return f"<p>{t}</p>" if dialect == "html" else t
        if what < 0.6:
            t = self.short(1)
            return {"wiki": f"== {t} ==", "markdown": f"## {t}", "html": f"<h2>{t}</h2>", "latex": rf"\section{{{t}}}"}[dialect]
        if what < 0.85:
            items = [self.item(dialect) for _ in range(r.randrange(1, 6))]
            if dialect == "html":
                return "<ul>\n" + "\n".join(f"<li>{x}</li>" for x in items) + "\n</ul>"
            if dialect == "latex":
                return "\\begin{itemize}\n" + "\n".join(rf"\item {x}" for x in items) + "\n\\end{itemize}"
            return "\n".join(f"* {x}" for x in items)
        if what < 0.93:
            m, w, k = self.mark(1), self.some(1), r.randrange(9)
            code = r.choice((f"if ({m} == {k}) {{ return '{w}'; }}", f"{m} = {{'{w}': {k}}}", f"{w} {m} --{w} | {w} > {k}", f"# {m}\n- {w}\n* {w} {k}\n", f"{m}", f"{w}={m}\n{w}={k}", f"<{w}>{m}</{w}>", self.some(r.randrange(3, 30)) + f" {m}"))
            return {"markdown": f"```\n{code}\n```", "latex": f"\\begin{{verbatim}}\n{code}\n\\end{{verbatim}}"}.get(dialect, f"<pre>\n{code}\n</pre>")
        f = r.choice((rf"\frac{{{self.mark(1)}}}{{{r.randrange(9)}}} = x", rf"\alpha \le {self.mark(1)}", self.mark(1)))
        return {"wiki": r.choice((f"<math>{f}</math>", f":<math>{f}</math>", f":${f}$")), "html": f"<p>${f}$ {self.sentence(1)}</p>"}.get(dialect, f"${f}$")

    def boilerplate(self, dialect: str) -> str:
        r = self.rnd
        link = lambda: self.linked("html", 0)
        box = r.choice(_BOXES)
        kinds = [
            lambda: f"<{box}>\n<h3>{self.short(0)}</h3>\n<ul>\n" + "\n".join(f"<li>{link()}</li>" for _ in range(r.randrange(2, 7))) + f"\n</ul>\n<p>{self.short(0)} © {r.randrange(1990, 2030)}</p>\n</{box}>",
            lambda: f"<{box}><p>{self.short(0)} | {self.short(0)}</p><ol><li>{link()}</li><li>{self.short(0)}</li></ol></{box}>",
            lambda: f"<script>var {self.mark(0)} = '<h2>{self.short(0)}</h2>'; f('<li>{self.short(0)}</li>');</script>",
            lambda: f"<style>.{self.mark(0)} {{ color: red; }}</style>",
        ]
        if dialect == "wiki":
            kinds += [
                lambda: "{{Infobox place\n" + "".join(f"| {self.some(1)} = {r.choice((self.short(0), self.linked('wiki', 0), self.mark(0) + ' ' + str(r.randrange(999)) + ' km'))}\n" for _ in range(r.randrange(2, 7))) + r.choice(("", f"| list =\n* {self.short(0)}\n* {self.linked('wiki', 0)}\n")) + "}}",
                lambda: "{{Navbox\n| title = " + self.short(0) + "\n== " + self.short(0) + " ==\n" + "".join(f"* {self.linked('wiki', 0)}\n" for _ in range(r.randrange(2, 6))) + "}}",
                lambda: '{| class="t"\n! ' + self.short(0) + " !! n\n" + "".join(f"|-\n| {self.short(0)} || {r.randrange(99)}\n" for _ in range(r.randrange(1, 5))) + r.choice(("", f"|-\n|\n* {self.short(0)}\n* {self.mark(0)} {r.randrange(99)}\n")) + "|}",
                lambda: f"[[Category:{self.short(0)}]]",
            ]
        return r.choice(kinds)()

    def page(self) -> str:
        r = self.rnd
        dialect = r.choice(("wiki", "wiki", "markdown", "html", "latex"))
        parts = [self.content(dialect) for _ in range(r.randrange(2, 12))]
        for _ in range(r.randrange(0, 4)):
            place = r.choice((0, len(parts), r.randrange(len(parts) + 1)))
            parts.insert(place, self.boilerplate(dialect))
        return "\n\n".join(parts)


_MARKED = re.compile(r"zq[a-j]+x", re.IGNORECASE)


def planted(texts: list[str], pages: int = PLANTED, seed: int = 1) -> list[tuple[list[Block], list[int | None]]]:
    """(blocks, labels) of pages that are put together from the words of `texts`: 1 content, 0 boilerplate, None unknown."""
    plain = [clean(x) for t in texts for x in re.split(r"\n+|<[^<>]*>", t)]
    sentences = [x for x in plain if x.endswith((".", "。")) and 5 < len(x) < 400 and "{" not in x and "\\" not in x]
    words = sorted({w for x in sentences for w in re.findall(r"[^\W\d_]{3,12}", x)})
    rnd = random.Random(seed)
    out = []
    for _ in range(pages):
        p = _Planter(rnd, sentences, words)
        bs = blocks(p.page())
        found = [[p.labels.get(m.lower()) for m in _MARKED.findall(b.text)] for b in bs]
        out.append((bs, [f[0] if f else None for f in found]))
    return out


def train(texts: list[str], steps: int = 400, pages: int = PLANTED) -> np.ndarray:
    """Weights of a logistic classifier of blocks (1 = content), fitted to planted pages."""
    x, y = [], []
    for bs, labels in planted(texts, pages):
        if bs:
            known = [i for i, k in enumerate(labels) if k is not None]
            x.append(features(bs)[known])
            y += [labels[i] for i in known]
    a, z = np.concatenate(x), np.array(y, float)
    weight = np.where(z > 0, 0.5 / z.mean(), 0.5 / (1 - z).mean())
    w = np.zeros(_FEATURES)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-a @ w))
        w -= 2.0 * (a.T @ (weight * (p - z)) / len(z) + 1e-4 * w)
    return w


def min_cut(content: list[float], boiler: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Cheapest labelling: content[i] is lost if i is boilerplate, boiler[i] if it is content, an edge if its ends differ.

    Max-flow by shortest augmenting paths; True for the nodes on the source's (content's) side.
    """
    n = len(content)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(u: int, v: int, c: float, back: float = 0.0) -> None:
        at[u].append(len(to))
        to.append(v)
        cap.append(c)
        at[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i in range(n):
        both = min(content[i], boiler[i])  # flows straight through
        if content[i] > both:
            arc(s, i, content[i] - both)
        if boiler[i] > both:
            arc(i, t, boiler[i] - both)
    for u, v, c in edges:
        arc(u, v, c, c)
    while True:
        came = [-1] * (n + 2)
        came[s] = -2
        queue = deque([s])
        while queue and came[t] == -1:
            u = queue.popleft()
            for e in at[u]:
                if cap[e] > 1e-9 and came[to[e]] == -1:
                    came[to[e]] = e
                    queue.append(to[e])
        if came[t] == -1:
            return [came[i] != -1 or content[i] > boiler[i] and not at[i] for i in range(n)]
        flow, v = float("inf"), t
        while v != s:
            flow = min(flow, cap[came[v]])
            v = to[came[v] ^ 1]
        v = t
        while v != s:
            cap[came[v]] -= flow
            cap[came[v] ^ 1] += flow
            v = to[came[v] ^ 1]


def label(bs: list[Block], weights: np.ndarray) -> list[Block]:
    """Mark each block as content (keep) or boilerplate by a minimum cut over the page.

    A block whose own preference outweighs all its edges keeps it in every minimum cut; max-flow runs over the others,
    with their edges to decided blocks as terminal capacities.
    """
    if not bs:
        return bs
    z = features(bs) @ weights
    content, boiler = np.logaddexp(0, z), np.logaddexp(0, -z)  # -log(1 - p), -log(p)
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    tied = np.zeros(len(bs))
    for i, b in enumerate(bs):
        if i:
            edges.append((i - 1, i, NEXT if b.box == bs[i - 1].box else ACROSS))
        if b.box:
            if last.get(b.box, i) < i - 1:
                edges.append((last[b.box], i, SAME))
            last[b.box] = i
    for u, v, c in edges:
        tied[u] += c
        tied[v] += c
    sure = np.abs(content - boiler) > tied
    for b, k in zip(bs, content > boiler):
        b.keep = bool(k)
    if sure.all():
        return bs
    open_ = [i for i in range(len(bs)) if not sure[i]]
    number = {i: k for k, i in enumerate(open_)}
    c, o, inner = [float(content[i]) for i in open_], [float(boiler[i]) for i in open_], []
    for u, v, w in edges:
        if u in number and v in number:
            inner.append((number[u], number[v], w))
        elif u in number or v in number:
            mine, other = (u, v) if u in number else (v, u)
            (c if bs[other].keep else o)[number[mine]] += w
    for i, k in zip(open_, min_cut(c, o, inner)):
        bs[i].keep = bool(k)
    return bs


_CLEAN = [
    (re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]"), r"\1"),
    (re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)"), r"\1"),
    (re.compile(r"\\(?:emph|textbf|textit|texttt|underline)\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\(?:footnote|cite|ref|label)\{[^{}]*\}"), ""),
    (re.compile(r"</?[A-Za-z][^<>]*>"), ""),
    (re.compile(r"'''?|\*\*|__"), ""),
    (re.compile(r"(?<![\w*])[*_]([^\s*_][^*_\n]*)[*_](?![\w*])"), r"\1"),
]


def clean(text: str) -> str:
    """Inline markup off, entities resolved, white space evened."""
    t = _AWAY.sub("", text)
    for p, r in _CLEAN:
        t = p.sub(r, t)
    return re.sub(r"\s+", " ", html.unescape(t).replace("~", " ")).strip()


def parse(text: str | None, weights: np.ndarray) -> list[Block]:
    """The content blocks of a page; none for null, empty and blank texts and redirects."""
    if not text or not text.strip() or is_redirect(text):
        return []
    return [b for b in label(blocks(text), weights) if b.keep]


def elements(content: list[Block]) -> list[tuple[str, int]]:
    """(kind, number on the page from 1) of headings, list items, code blocks and formulas."""
    n = {"heading": 0, "list_item": 0, "code": 0, "formula": 0}
    out = []
    for b in content:
        for k, times in ((b.kind, b.kind in n and b.kind != "formula"), ("formula", b.formulas)):
            for _ in range(times):
                n[k] += 1
                out.append((k, n[k]))
    return out


def render(content: list[Block]) -> str:
    """Clean text: headings after `# `, items after `- `, code fenced, formulas between dollars."""
    mark = {"heading": "# ", "list_item": "- "}
    return "\n".join(f"```\n{b.text.strip(chr(10))}\n```" if b.kind == "code" else mark.get(b.kind, "") + clean(b.text) for b in content if b.kind == "code" or b.text.strip())


def _element_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kinds, seqs = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, i in elements(parse(text, shared.value)):
                    keys.append(key)
                    kinds.append(k)
                    seqs.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.string()), pa.array(seqs, pa.int32())], names=["key", "kind", "seq"])

    return run


def _clean_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else render(parse(t, shared.value)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return run


def train_on(pages: DataFrame, key: str, text: str, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights fitted with the words of at most `rows` pages of at most TRAIN_CHARS characters, chosen by a hash of their key."""
    some = pages.where(f"length({text}) between 1 and {TRAIN_CHARS}").select(key, text).orderBy(F.xxhash64(F.lit(42), F.col(key))).limit(rows)
    return train([r[1] for r in some.collect() if not is_redirect(r[1])])


def page_elements(pages: DataFrame, key: str, text: str, weights: np.ndarray | None = None) -> DataFrame:
    """(key, kind, seq): one row per heading, list item, code block and formula that a reader of the page sees.

    What is inside code, commented out, literal or boilerplate is no element. Null, empty and blank texts and redirects
    have none; a page that is delivered twice counts once. Whole texts are read; only the training sample is bounded.
    Headings and list items in templates, tables, scripts and page boxes are read too; the cut decides whether they count.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train_on(pages, key, text) if weights is None else weights)
    return pages.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(_element_rows(shared), "key bigint, kind string, seq int").distinct()


def clean_pages(pages: DataFrame, key: str, text: str, weights: np.ndarray | None = None) -> DataFrame:
    """(key, text): the clean text of every row; null stays null, redirects and blank texts become empty."""
    shared = pages.sparkSession.sparkContext.broadcast(train_on(pages, key, text) if weights is None else weights)
    return pages.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(_clean_rows(shared), "key bigint, text string")
