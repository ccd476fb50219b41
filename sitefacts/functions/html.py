"""Pages to elements: the one place where HTML is parsed in Python.

Everything that is built on elements is relational. Text of script, style and template elements
belongs to those elements only. Cheap filters on pages belong in front of this job, since none is
pushed through it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape as unescaped
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts.functions.text import compact, text_of, unescape

VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))
FIELDS = "pos int, tag string, attrs map<string,string>, text string, ancestors array<int>, children int"


PLAIN_TAG = re.compile(r'(/?)([A-Za-z][A-Za-z0-9]*)((?:[ \n]+[A-Za-z][A-Za-z0-9_-]*="[^"<>\0]*")*)[ \n]*(/?)>([^\0]*)')
PLAIN_ATTR = re.compile(r'([A-Za-z][A-Za-z0-9_-]*)="([^"]*)"')
PLAIN_COMMENT = re.compile(r"!--[^<>-]*-->([^\0]*)")
DOCTYPE = re.compile(r"!(?:doctype|DOCTYPE) html>([^\0]*)")
RAW_ENDS = {tag: re.compile(rf"(?i:/{tag})[ \n]*>([^\0]*)") for tag in ("script", "style")}
TEXT_ONLY = frozenset(("title", "textarea"))
#: elements whose content releases of the full parser read in their own ways
FULL_ONLY = frozenset("iframe math noembed noframes noscript plaintext svg xmp".split())


class _Elements(HTMLParser):
    """Collects (tag, attributes, ancestors, range of strings); an end tag closes all it encloses."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.open: list[int] = []
        self.strings: list[tuple[str, str]] = []
        self.pending: list[str] = []

    def _flush(self) -> None:
        if not self.pending:
            return
        text = "".join(self.pending).strip()
        self.pending.clear()
        if text:
            holder = self.found[self.open[-1]][0] if self.open else ""
            self.strings.append((text, holder if holder in HIDDEN else ""))

    def handle_starttag(self, tag, attrs):
        self._flush()
        for pos in self.open[-1:]:
            self.found[pos][5] += 1
        pos = len(self.found)
        self.found.append([tag, {k: v or "" for k, v in attrs}, list(self.open), len(self.strings), None, 0])
        if tag in VOID:
            self.found[pos][4] = len(self.strings)
        else:
            self.open.append(pos)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if self.open and self.found[self.open[-1]][0] == tag:
            self.found[self.open.pop()][4] = len(self.strings)
        elif any(self.found[p][0] == tag for p in self.open):
            while True:
                pos = self.open.pop()
                self.found[pos][4] = len(self.strings)
                if self.found[pos][0] == tag:
                    break

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._flush()

    def read_plain(self, html: str) -> bool:
        """Reads a page of plain markup as ``feed`` and ``close`` do, without their scan of every character.

        False for a page with anything that needs the full parser; then the elements so far are of no use.
        """
        chunks = html.split("<")
        if chunks[0]:
            self.handle_data(unescaped(chunks[0]))
        raw, text_only = None, None
        for chunk in chunks[1:]:
            if raw is not None:
                # what stands in a script or style is data up to its own end tag
                found = RAW_ENDS[raw].fullmatch(chunk)
                if not found:
                    if chunk.startswith(("!", "/" + raw[:2], "/" + raw[:2].upper())):
                        return False
                    self.handle_data("<" + chunk)
                    continue
                self.handle_endtag(raw)
                raw, behind = None, found[1]
            elif found := PLAIN_TAG.fullmatch(chunk):
                end, name, attrs, single, behind = found.groups()
                tag = name.lower()
                if end:
                    if attrs or single or text_only not in (None, tag):
                        return False
                    text_only = None
                    self.handle_endtag(tag)
                elif text_only is not None or tag in FULL_ONLY or "&" in attrs:
                    return False
                else:
                    given = [(n.lower(), v) for n, v in PLAIN_ATTR.findall(attrs)] if attrs else []
                    if single:
                        if tag in RAW_ENDS or tag in TEXT_ONLY:
                            return False
                        self.handle_startendtag(tag, given)
                    else:
                        self.handle_starttag(tag, given)
                        raw = tag if tag in RAW_ENDS else None
                        text_only = tag if tag in TEXT_ONLY else None
                if raw is not None and behind:
                    self.handle_data(behind)
                    continue
            elif text_only is None and (found := PLAIN_COMMENT.fullmatch(chunk)):
                self.handle_comment("")
                behind = found[1]
            elif text_only is None and (found := DOCTYPE.fullmatch(chunk)):
                behind = found[1]
            else:
                return False
            if behind:
                self.handle_data(unescaped(behind))
        return raw is None and text_only is None

    def texts(self, element: list) -> list[str]:
        tag, _, _, start, end, _ = element
        wanted = tag if tag in HIDDEN else ""
        return [s for s, holder in self.strings[start : len(self.strings) if end is None else end] if holder == wanted]


def _parse(html: str | None, tags: frozenset[str] | None, with_text: frozenset[str] | None, strings: bool) -> Iterator[tuple]:
    parser = _Elements()
    if not parser.read_plain(html or ""):
        parser = _Elements()
        parser.feed(html or "")
        parser.close()
    parser._flush()
    for pos, element in enumerate(parser.found):
        if tags is None or element[0] in tags:
            texts = parser.texts(element) if strings or with_text is None or element[0] in with_text else None
            yield pos, element[0], list(element[1].items()), None if texts is None else " ".join(texts), element[2], element[5], *([texts] if strings else [])


FIELD_TYPES = (pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.string()))


def html_elements(
    pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id", "url"), tags: Sequence[str] | None = None, strings: bool = False, with_text: Sequence[str] | None = None, step: int = 64
) -> DataFrame:
    """One row per element: the kept page columns, position, tag, attributes, text, ancestor positions
    and number of direct child elements.

    ``tags`` limits what is returned; ``with_text`` names the tags whose text is wanted (None: all), as
    nested elements repeat it. ``strings`` adds the single strings the text is made of. Kept columns stay
    in Arrow, and ``step`` pages at a time become rows.
    """
    wanted = frozenset(tags) if tags else None
    texts = None if with_text is None else frozenset(with_text)
    kept = list(keep)
    types = dict(pages.dtypes)
    names = ["pos", "tag", "attrs", "text", "ancestors", "children", *(["strings"] if strings else [])]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                owner, fields = [], [[] for _ in names]
                for i, text in enumerate(part.column(len(kept)).to_pylist()):
                    for element in _parse(text, wanted, texts, strings):
                        owner.append(i)
                        for held, value in zip(fields, element):
                            held.append(value)
                page = pa.array(owner, pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(page) for i in range(len(kept))), *(pa.array(v, t) for v, t in zip(fields, FIELD_TYPES))], [*kept, *names])

    schema = ", ".join(f"`{k}` {types[k]}" for k in kept) + ", " + FIELDS
    schema += ", strings array<string>" if strings else ""
    return pages.select(*kept, html).mapInArrow(parse, schema)


def visible_text(html: Column, closed: bool = False) -> Column:
    """Text of a page without comments, scripts, styles and templates, as one compact line."""
    bare = F.regexp_replace(text_of(html), r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<template\b[^>]*>.*?</template\s*>", " ")
    return compact(unescape(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), closed))


ANCHOR = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)"


def anchor_hrefs(html: Column) -> Column:
    """Hrefs of all anchors in reading order, outside comments and scripts."""
    bare = F.regexp_replace(text_of(html), r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>", " ")
    found = F.regexp_extract_all(bare, F.lit(ANCHOR), F.lit(0))
    value = lambda a: F.regexp_replace(F.regexp_extract(a, r"(?is)\shref\s*=\s*(.*)$", 1), "^[\"']|[\"']$", "")
    return F.transform(found, lambda a: unescape(value(a)))
