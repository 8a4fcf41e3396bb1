"""Landed pages -> typed records: one distributed job driven by a field map.

Spark splits and ships the pages; inside a task a small standard-library parser walks each page once. Everything after
the cell texts (casts, keys, filters) is native columns. Site-specific maps are configuration of the caller.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

VOID_TAGS = {"area", "base", "br", "col", "hr", "img", "input", "link", "meta", "source", "wbr"}


@dataclass(frozen=True)
class Field:
    """One output column: an attribute of a row's cell (by position or by data-stat) or its text, cut by a pattern."""

    name: str
    cell: int | str = 0
    attribute: str | None = None
    pattern: str | None = None


@dataclass(frozen=True)
class FieldMap:
    """Which elements are rows and cells: tags, an optional id of the enclosing element, comments searched or not."""

    fields: tuple[Field, ...]
    row_tag: str = "tr"
    cell_tags: tuple[str, ...] = ("td", "th")
    within_tag: str | None = None
    within_id: str | None = None
    in_comments: bool = False


class _Rows(HTMLParser):
    def __init__(self, spec: FieldMap):
        super().__init__(convert_charrefs=True)
        self.spec, self.rows = spec, []
        self.scope, self.row, self.cell = 0, None, None

    def _outside(self) -> bool:
        return self.spec.within_tag is not None and self.scope == 0

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == self.spec.within_tag and (self.scope or not self.spec.within_id or attrs.get("id") == self.spec.within_id):
            self.scope += 1
        if self._outside():
            return
        if tag == self.spec.row_tag:
            self.row = []
            self.rows.append(self.row)
        if self.row is not None and tag in self.spec.cell_tags:
            self.cell = {"attrs": attrs, "text": []}
            self.row.append(self.cell)
            if tag in VOID_TAGS:
                self.cell = None

    def handle_endtag(self, tag):
        if tag in self.spec.cell_tags:
            self.cell = None
        if tag == self.spec.row_tag:
            self.row = None
        if tag == self.spec.within_tag and self.scope:
            self.scope -= 1

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"].append(data)

    def handle_comment(self, data):
        if self.spec.in_comments and "<" in data:
            inner = _Rows(self.spec)
            inner.feed(data)
            self.rows.extend(inner.rows)


def _value(row: list[dict], field: Field) -> str | None:
    if isinstance(field.cell, int):
        cell = row[field.cell] if -len(row) <= field.cell < len(row) else None
    else:
        cell = next((c for c in row if c["attrs"].get("data-stat") == field.cell), None)
    if cell is None:
        return None
    text = cell["attrs"].get(field.attribute) if field.attribute else "".join(cell["text"]).strip()
    if text is not None and field.pattern:
        found = re.search(field.pattern, text)
        text = (found.group(1) if found and found.groups() else found.group(0)) if found else None
    return text


def extract_records(html: str, spec: FieldMap) -> list[list[str | None]]:
    parser = _Rows(spec)
    parser.feed(html or "")
    parser.close()
    return [[_value(r, f) for f in spec.fields] for r in parser.rows if r]


def extract_pages(pages: DataFrame, spec: FieldMap, keys: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """Records of all pages: the keys, the row's position on its page and the mapped fields as text.

    Batches are read page by page and results leave in bounded pieces, so a page with many rows does not pile up."""
    keys = list(keys)
    names = [*keys, "record_no", *[f.name for f in spec.fields]]
    types = dict(pages.select(*keys).dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "record_no int", *[f"{f.name} string" for f in spec.fields]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for rec in batch.itertuples(index=False):
                *key, text = rec
                for i, values in enumerate(extract_records(text, spec)):
                    out.append((*key, i, *values))
                if len(out) >= 5000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return pages.select(*keys, html).mapInPandas(run, schema)
