"""What is read from a page's element tree inside a Python worker: plain structure, no rules."""

from __future__ import annotations

from collections.abc import Callable

from partloom.sources.markup import Element, Selector


def listing_reader(glue: str) -> Callable[[Element], dict]:
    blocks, link, head = Selector(".row.app"), Selector("h4 a"), Selector("h4")
    title, cell = Selector(".panel-header h4"), Selector("table.table-borderless tbody tr td")

    def one(block: Element) -> dict:
        anchor, heading, panel = link.first(block), head.first(block), block.ancestor("div", "panel")
        category = title.first(panel) if panel is not None else None
        return {
            "sku": anchor.text() if anchor else None,
            "name": heading.text(glue) if heading else "",
            "category": category.text() if category else None,
            "block_text": block.lines(),
            "cells": [c.text(glue) for c in cell.all(block)],
        }

    def contained(block: Element) -> dict:
        """A block that cannot be read is a failure of its own; the page's other blocks stay."""
        try:
            return one(block)
        except Exception as e:  # noqa: BLE001
            return {"error": f"{type(e).__name__}: {e}"}

    return lambda root: {"blocks": [contained(b) for b in blocks.all(root)]}


def _row(row: Element) -> dict:
    cells = [(c.tag, c.text()) for c in row.find("td", "th")]
    return {"cells": [text for _, text in cells], "tds": [text for tag, text in cells if tag == "td"]}


def _table(table: Element) -> dict:
    return {"headers": [h.text() for h in table.find("th")], "rows": [_row(row) for row in table.find("tr")]}


_BOX = Selector("div.col-6")


def detail_reader(root: Element) -> dict:
    box = _BOX.first(root)
    about = None
    if box is not None:
        first = lambda tag: next(iter(box.find(tag)), None)
        title, subtitle, items = first("h5"), first("p"), first("ul")
        about = {
            "title": title.text() if title else None,
            "subtitle": subtitle.text() if subtitle else None,
            "chunks": [c.strip() for c in box.children if isinstance(c, str)],
            "items": [li.text() for li in items.find("li")] if items else [],
        }
    pictures = [{"src": i.attrs.get("src", ""), "alt": i.attrs.get("alt", "")} for i in root.find("img")]
    return {"tables": [_table(t) for t in root.find("table")], "about": about, "pictures": pictures}


def match_reader(css: str, attribute: str | None, *, first: bool) -> Callable[[Element], dict]:
    """Text, and one attribute, of the elements a selector finds."""
    selector = Selector(css)

    def read(root: Element) -> dict:
        elements = [e for e in [selector.first(root)] if e is not None] if first else selector.all(root)
        return {"m": [{"text": e.text(), "value": e.attrs.get(attribute) if attribute else None} for e in elements]}

    return read
