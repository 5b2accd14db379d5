"""Markup to document, tables and images, as one Arrow batch job over pages."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filinglens import lexicon as L
from filinglens.session import bounded_batches

PIECE = 1 << 20
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CELL = "struct<text:string,colspan:int,rowspan:int>"
PARSED = ("struct<text:string,markdown:string,plain:string,n_chars:bigint,"
          f"tables:array<struct<table_id:string,rows:array<array<{_CELL}>>,markdown:string>>,"
          "images:array<struct<image_id:string,tag:string,source:string,alt:string,title:string,nearby_text:string>>,error:string>")


class _Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def find(self, tags, deep=True):
        """Elements below in document order; no recursion, markup may nest without limit."""
        stack = [c for c in reversed(self.children) if isinstance(c, _Element)]
        while stack:
            node = stack.pop()
            if node.tag in tags:
                yield node
            if deep:
                stack += [c for c in reversed(node.children) if isinstance(c, _Element)]

    def strings(self):
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, _Element):
                stack += reversed(node.children)
            else:
                yield node

    def put(self, text):
        """Swap this element for a paragraph holding ``text``."""
        p = _Element("p", {}, self.parent)
        p.children = [text]
        self.parent.children[self.parent.children.index(self)] = p


class _Tree(HTMLParser):
    def __init__(self, markup: str, xml: bool):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Element("", {}, None)
        self.xml = xml
        self.feed(markup)
        self.close()

    def _open(self, stop: set[str], tags: set[str]):
        node = self.at
        while node is not self.root and node.tag not in stop:
            if node.tag in tags:
                return node
            node = node.parent
        return None

    def handle_starttag(self, tag, attrs):
        if not self.xml:
            ends = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "li": {"li"}, "p": {"p"}}.get(tag)
            stale = ends and self._open({"table"} if tag in ("td", "th", "tr") else {"table", "ul", "ol", "td", "th"}, ends)
            if stale:
                self.at = stale.parent
        node = _Element(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if self.xml or tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Element(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        node = self._open(set(), {tag})
        if node is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self.handle_data(data[6:])

    def parse_marked_section(self, i, report=1):
        """Sections other than CDATA are skipped, whatever their name; an open one ends with the markup."""
        if self.rawdata[i : i + 9].upper() == "<![CDATA[":
            end = self.rawdata.find("]]>", i)
            if end < 0:
                return -1
            self.unknown_decl(self.rawdata[i + 3 : end])
            return end + 3
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1


def _inline(text: str) -> str:
    return " ".join(re.sub("[\u200b\ufeff]", "", text).split())


def _joined(node: _Element) -> str:
    return _inline(" ".join(s.strip() for s in node.strings() if s.strip()))


def _lines(text: str) -> str:
    lines = [line.strip() for line in text.splitlines()]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _span(node: _Element, *names: str) -> int:
    value = next((node.attrs[n] for n in names if node.attrs.get(n)), 1)
    try:
        return int(value)
    except (TypeError, ValueError):
        return 1


def _rows(table: _Element) -> list[list[dict]]:
    rows = list(table.find(L.ROW_TAGS))
    if not rows:
        rows = list({id(c.parent): c.parent for c in table.find(L.CELL_TAGS)}.values())
    out = []
    for row in rows:
        cells = list(row.find(L.CELL_TAGS, deep=False)) or list(row.find(L.CELL_TAGS))
        if cells:
            out.append([{"text": _joined(c), "colspan": _span(c, "colspan", "cols", "colnum"), "rowspan": _span(c, "rowspan", "rows")} for c in cells])
    return out


def _markdown(rows: list[list[dict]]) -> str:
    wide = [[x for c in r for x in [c["text"].replace("|", "\\|"), *[""] * (max(c["colspan"], 1) - 1)]] for r in rows]
    width = max(len(r) for r in wide)
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in wide]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


_REFERENCE = re.compile(r"(?is)(<(script|style)\b.*?</\2\s*>)|&(#?[a-z0-9]+;?)")


def _ended_references(markup: str) -> str:
    """Markup in which references without semicolon, or with an unknown name, are plain text."""
    def kept(m):
        ref = m[3]
        known = m[1] or ref.endswith(";") and (ref[0] == "#" or ref in html5)
        return m[0] if known else "&amp;" + m[0][1:]
    return _REFERENCE.sub(kept, markup)


def parse(markup: str, filename: str | None = None, ended: bool = False) -> dict:
    """Text with placeholders, Markdown with tables put back, tables and images.

    ``ended``: only references with their semicolon are decoded; else also ``&amp`` and the like, as browsers do.
    """
    markup = _ended_references(markup) if ended else markup
    xml = (filename or "").lower().endswith((".xml", ".xhtml")) or markup.lstrip()[:5].lower() == "<?xml"
    root = _Tree(markup, xml).root
    plain = "\n".join(s.strip() for s in root.strings() if s.strip())
    for node in list(root.find(L.SILENT_TAGS)):
        if node.parent is not None and node in node.parent.children:
            node.parent.children.remove(node)
    tables, images = [], []
    found = [t for t in root.find(L.TABLE_TAGS) if t.tag == "table" or not any(True for _ in t.find(("table",)))]
    for n, t in enumerate(found, 1):
        rows = _rows(t)
        if rows:
            tables.append({"table_id": f"table_{n:04d}", "rows": rows, "markdown": _markdown(rows)})
            t.put(f"[[TABLE:table_{n:04d}]]")
    for n, i in enumerate(list(root.find(L.IMAGE_TAGS)), 1):
        a = i.attrs
        source = next((a[k] for k in ("src", "href", "xlink:href", "file", "filename") if a.get(k)), "")
        images.append({"image_id": f"image_{n:04d}", "tag": i.tag, "source": source, "alt": a.get("alt") or "", "title": a.get("title") or "",
                       "nearby_text": _joined(i.parent)[:1000]})
        i.put(f"[[IMAGE:image_{n:04d}]]")
    text = _lines("\n".join(root.strings()))
    markdown = text
    for t in tables:
        markdown = markdown.replace(f"[[TABLE:{t['table_id']}]]", f"\n\n<!-- {t['table_id']} -->\n{t['markdown']}\n\n")
    for i in images:
        markdown = markdown.replace(f"[[IMAGE:{i['image_id']}]]", f"\n\n[IMAGE: {i['image_id']}]\n\n")
    return {"text": text, "markdown": _lines(markdown), "plain": plain, "n_chars": len(text), "tables": tables, "images": images, "error": None}


def _parsed(markup: str, filename: str | None, ended: bool = False) -> dict:
    """As ``parse``; markup that the parser can't read gives an empty page that names the error."""
    try:
        return parse(markup, filename, ended)
    except (AssertionError, ValueError) as e:
        return {**parse("", filename), "error": type(e).__name__}


def structured(pages: DataFrame, keys: list[str], markup: str, filename: str | None = None, ended: bool = False) -> DataFrame:
    """One nested row per page, ``error`` for those that can't be read; pages stay where they are, nothing is shuffled.

    A task holds the trees and rows of ``PIECE`` characters of markup at a time, or of one page if that is longer.
    """
    bounded_batches(pages.sparkSession)
    fields = T._parse_datatype_string(PARSED)
    schema = T.StructType([*[pages.schema[k] for k in keys], *fields.fields])

    def run(batches):
        for pdf in batches:
            for _, part in pdf.groupby(np.cumsum([len(m or "") for m in pdf["_markup"]]) // PIECE, sort=False):
                names = part["_filename"] if "_filename" in part else [None] * len(part)
                parsed = [_parsed(m or "", f, ended) for m, f in zip(part["_markup"], names)]
                yield pd.DataFrame({**{k: part[k] for k in keys}, **{f.name: pd.Series([p[f.name] for p in parsed], part.index) for f in fields.fields}})

    cols = [F.col(markup).alias("_markup")] + ([F.col(filename).alias("_filename")] if filename else [])
    return pages.select(*keys, *cols).mapInPandas(run, schema)


def table_rows(documents: DataFrame, keys: list[str]) -> DataFrame:
    return documents.select(*keys, F.explode("tables").alias("t")).select(*keys, "t.table_id", "t.rows", "t.markdown")


def cell_rows(documents: DataFrame, keys: list[str]) -> DataFrame:
    cells = table_rows(documents, keys).select(*keys, "table_id", F.posexplode("rows").alias("row_pos", "r"))
    return cells.select(*keys, "table_id", "row_pos", F.posexplode("r").alias("cell_pos", "c")).select(*keys, "table_id", "row_pos", "cell_pos", "c.*")


def image_rows(documents: DataFrame, keys: list[str]) -> DataFrame:
    return documents.select(*keys, F.explode("images").alias("i")).select(*keys, "i.*")


def document_counts(documents: DataFrame, keys: list[str]) -> DataFrame:
    return documents.select(*keys, "n_chars", F.size("tables").cast("bigint").alias("n_tables"), F.size("images").cast("bigint").alias("n_images"))


def tag_histogram(pages: DataFrame, keys: list[str], markup: str, limit: int = 40) -> DataFrame:
    """Most frequent tags of each page."""
    from filinglens.operators.ordering import top_per_group
    body = F.regexp_replace(F.col(markup), r"(?s)<!--.*?-->", "")
    tags = F.transform(F.regexp_extract_all(body, F.lit(r"<([A-Za-z][A-Za-z0-9:_-]*)"), F.lit(1)), F.lower)
    counted = pages.select(*keys, F.explode(tags).alias("tag")).groupBy(*keys, "tag").agg(F.count("*").alias("n"))
    return top_per_group(counted, keys, [F.desc("n"), F.asc("tag")], limit, "tag_rank")
