"""Facts of wiki pages: infobox arguments and the links of every section."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINK = re.compile(r"\[\[\s*:?([^\[\]|#]+)(?:#[^\[\]|]*)?(?:\|[^\[\]]*)?\]\]")
_HEADING = re.compile(r"^(=+)\s*(.*?)\s*\1\s*$", re.MULTILINE)
_TAGS = re.compile(r"<ref\b[^<>]*/>|<ref\b.*?</ref>|<!--.*?-->|</?[A-Za-z][^<>]*>", re.DOTALL)
_MEDIA = re.compile(r"\s*(?:file|image)\s*:", re.IGNORECASE)
#: Templates that are replaced by text, and by which: all their arguments, the arguments without `*`, the
#: first one, the first two, the last one.
TEXT_TEMPLATES = {
    "small": "all", "angle bracket": "all", "ipa": "all", "nowrap": "all", "center": "all", "plainlist": "unstarred", "included": "all", "nom": "all",
    "bartable": "first", "sortname": "names", "font color": "last",
}
_INNERMOST = re.compile(r"\{\{([^{}]*)\}\}")


def expand_templates(text: str) -> str:
    """Text templates replaced by what they show, from the inside out; others stay as they are."""
    kept: list[str] = []

    def one(m: re.Match) -> str:
        name, *args = m[1].split("|")
        rule = TEXT_TEMPLATES.get(name.strip().lower())
        if rule in ("all", "unstarred"):
            shown = "|".join(args)
            return shown.replace("*", "") if rule == "unstarred" else shown
        if rule == "first" and args:
            return args[0]
        if rule == "names" and len(args) > 1:
            return " ".join(args[:2])
        if rule == "last":
            return args[-1] if args else m[1]
        kept.append(m[0])
        return f"\ue002{len(kept) - 1}\ue003"

    text = text.replace("\ue002", "").replace("\ue003", "")
    while (new := _INNERMOST.sub(one, text)) != text:
        text = new
    while (new := re.sub("\ue002([0-9]+)\ue003", lambda m: kept[int(m[1])], text)) != text:
        text = new
    return text


#: Spellings of a line break.
BREAKS = ("{{break}}", "<br />", "<br/>", "<br>", "<br", " \n", "\n ")
#: Spans of markup that are taken off with their text, by start and end.
SPANS = (("<ref", "/ref>"), ("<ref", "/>"), ("<!--", "-->"))


def cell_text(text: str) -> str:
    """Text of a table cell: breaks as new lines, formatnum and text templates resolved, references and comments off."""
    for b in BREAKS:
        text = text.replace(b, "\n")
    text = expand_templates(re.sub(r"\{\{formatnum:([^{}]*)\}\}", r"\1", text))
    for a, b in SPANS:
        text = re.sub(f"(?s){re.escape(a)}.*?{re.escape(b)}", "", text)
    return text.strip()


def _template_end(text: str, at: int) -> int:
    depth, i = 0, at
    while i < len(text) - 1:
        two = text[i : i + 2]
        if two in ("{{", "}}"):
            depth += 1 if two == "{{" else -1
            i += 2
            if not depth:
                return i
        else:
            i += 1
    return len(text)


def _arguments(body: str) -> list[str]:
    """Arguments of a template, split at bars outside links and inner templates."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r"\[\[|\]\]|\{\{|\}\}|\|", body):
        if m[0] == "|":
            if not depth:
                out.append(body[start : m.start()])
                start = m.end()
        else:
            depth += 1 if m[0] in ("[[", "{{") else -1
    return [*out, body[start:]]


def plain_text(text: str) -> str:
    """Wiki markup off: text templates keep what they show, other templates, tags, tables and media go, links keep their text."""
    text = expand_templates(re.sub(r"\{\{formatnum:([^{}]*)\}\}", r"\1", text))
    out, at = [], 0
    while (i := text.find("{{", at)) >= 0:
        out.append(text[at:i])
        at = _template_end(text, i)
    text = "".join(out) + text[at:]
    text = re.sub(r"\{\|.*?\|\}", " ", text, flags=re.DOTALL)
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", lambda m: "" if _MEDIA.match(m[0][2:]) else m[1], text)
    text = re.sub(r"'{2,}", "", _TAGS.sub("", text))
    return re.sub(r"\s+", " ", text).strip()


def _links(text: str) -> list[str]:
    found = [m[1].replace("_", " ").strip() for m in _LINK.finditer(text) if not _MEDIA.match(m[1])]
    return [t[:1].upper() + t[1:] for t in found if t]


def page_facts(text: str | None) -> list[tuple[str, str, str]]:
    """(kind, prop, value), different ones in order: `link` or `literal` of infobox arguments, `link` of sections, `item`.

    A section's links have the prop `Section: <title>`, the lead's `Section: Information`. `item` is the argument d of a
    "Subject bar". Null and empty texts have none.
    """
    if not text:
        return []
    facts: dict[tuple[str, str, str], None] = {}
    text = re.sub(r"<!--.*?-->", "", text, flags=re.DOTALL)
    for m in re.finditer(r"\{\{\s*(infobox|subject bar)\b", text, re.IGNORECASE):
        body = text[m.start() + 2 : _template_end(text, m.start()) - 2]
        for arg in _arguments(body)[1:]:
            prop, eq, value = arg.partition("=")
            prop, value = prop.strip(), value.strip()
            if not eq or not value:
                continue
            if m[1].lower() == "subject bar":
                if prop == "d":
                    facts["item", "d", value] = None
            elif "[[" in value:
                for t in _links(value):
                    facts["link", prop, t] = None
            elif p := plain_text(value):
                facts["literal", prop, p] = None
    at, title = 0, "Information"
    for h in [*_HEADING.finditer(text), None]:
        for t in _links(re.sub(r"\{\{\s*infobox.*?\n\}\}", "", text[at : h.start() if h else len(text)], flags=re.DOTALL | re.IGNORECASE)):
            facts["link", f"Section: {title}", t] = None
        if h:
            at, title = h.end(), plain_text(h[2])
    return list(facts)


def _fact_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(key, *f) for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for f in page_facts(text)]
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string()))], names=["key", "kind", "prop", "value"])


def facts(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, prop, value) of all pages; see page_facts. Redirects, null and empty texts have none."""
    p = pages.where(~F.coalesce(F.col(text).rlike(r"(?i)^\s*#redirect"), F.lit(False)))
    return p.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(_fact_rows, "key bigint, kind string, prop string, value string")


def _plain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [None if t is None else plain_text(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["key", "text"])


def plain_pages(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): every row's wikitext as plain text; null stays null."""
    return pages.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(_plain_rows, "key bigint, text string")
