"""Sheets of xlsx workbooks with the standard library."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_names(path: str) -> list[str]:
    with zipfile.ZipFile(path) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]


def read_sheet(path: str, sheet: int | str = 0) -> list[list]:
    """Rows of a sheet: numbers, texts, None for empty cells; trailing gaps are filled."""
    with zipfile.ZipFile(path) as z:
        sheets = list(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"))
        found = sheets[sheet] if isinstance(sheet, int) else next((s for s in sheets if s.get("name") == sheet), None)
        if found is None:
            raise KeyError(sheet)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[found.get(_REL)]
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        rows = []
        for row in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_MAIN}row"):
            cells: list = []
            for k, c in enumerate(row.iter(f"{_MAIN}c")):
                at = _column(c.get("r")) if c.get("r") else k
                cells += [None] * (at + 1 - len(cells))
                kind, v = c.get("t"), c.find(f"{_MAIN}v")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is not None and v.text is not None:
                    cells[at] = shared[int(v.text)] if kind == "s" else v.text if kind == "str" else bool(int(v.text)) if kind == "b" else float(v.text)
            rows.append(cells)
    width = max(map(len, rows), default=0)
    return [r + [None] * (width - len(r)) for r in rows]
