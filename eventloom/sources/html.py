"""HTML entries by CSS-like selectors, with the standard library's parser in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that never have an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Tree(HTMLParser):
    """Nodes as (tag, attributes, children, text pieces)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ("", {}, [], [])
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = (tag, {k: v or "" for k, v in attrs}, [], [])
        self.open[-1][2].append(node)
        self.open[-1][3].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        node = (tag, {k: v or "" for k, v in attrs}, [], [])
        self.open[-1][2].append(node)
        self.open[-1][3].append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1][3].append(data)


def _text(node) -> str:
    return "".join(_text(x) if isinstance(x, tuple) else x for x in node[3])


def _matches(node, step: str) -> bool:
    """A step is a tag, .class, #id or [attribute], or several of them joined."""
    import re

    for kind, name in re.findall(r"([.#\[]?)([\w-]+)\]?", step):
        ok = {"": node[0] == name, ".": name in node[1].get("class", "").split(), "#": node[1].get("id") == name, "[": name in node[1]}[kind]
        if not ok:
            return False
    return True


def select(root, selector: str) -> list:
    """Nodes under root that the steps of a selector lead to, in document order, each once."""
    found = [root]
    for step in selector.split():
        deeper, seen = [], set()

        def walk(node):
            for child in node[2]:
                if _matches(child, step) and id(child) not in seen:
                    seen.add(id(child))
                    deeper.append(child)
                walk(child)

        for node in found:
            walk(node)
        found = deeper
    return found


def parse(text: str):
    tree = _Tree()
    tree.feed(text)
    tree.close()
    return tree.root


def value_of(node, what: str) -> str | None:
    """text, or an attribute; blank is null."""
    found = " ".join(_text(node).split()) if what == "text" else node[1].get(what, "").strip()
    return found or None


def extract(pages: DataFrame, id_col: str, html_col: str, entry: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per entry: the page, the entry's number, and each field (selector in the entry, and text or an attribute)."""
    id_type = pages.schema[id_col].dataType.simpleString()
    names = list(fields)

    def run(batches):
        for batch in batches:
            at, number, columns = [], [], {n: [] for n in names}
            for row, text in enumerate(batch.column(html_col).to_pylist()):
                for k, node in enumerate(select(parse(text or ""), entry)):
                    at.append(row)
                    number.append(k)
                    for n, (selector, what) in fields.items():
                        hits = select(node, selector) if selector else [node]
                        columns[n].append(value_of(hits[0], what) if hits else None)
            ids = batch.column(id_col).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), *[pa.array(columns[n], pa.string()) for n in names]], [id_col, "entry", *names])

    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} {id_type}, entry int, " + ", ".join(f"{n} string" for n in names))
