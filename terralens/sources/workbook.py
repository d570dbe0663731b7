"""Workbooks of the spreadsheet format (.xlsx): a ZIP of XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

# Names of the format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: What XML can't hold.
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def column_name(i: int) -> str:
    """0 -> A, 25 -> Z, 26 -> AA."""
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def column_number(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _cell(value, at: str) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(value)))}</t></is></c>'


def write(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of sheets by name, each a list of rows."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        n = range(1, len(sheets) + 1)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for i in n)
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(n, sheets, strict=True))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n)
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{rels}</Relationships>')
        for i, rows in zip(n, sheets.values(), strict=True):
            body = "".join(f'<row r="{r}">' + "".join(_cell(v, f"{column_name(c)}{r}") for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>')
    return buf.getvalue()


def read(data: bytes):
    """(name, rows) of every sheet in order; cells as text, empty ones as None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_MAIN}}}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet"):
            target = rels[sheet.get(f"{{{_REL}}}id")]
            tree = ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else "xl/" + target))
            rows: list[list] = []
            for row in tree.iter(f"{{{_MAIN}}}row"):
                at = int(row.get("r") or len(rows) + 1)
                rows += [[] for _ in range(at - 1 - len(rows))]
                cells: list = []
                for c in row.iter(f"{{{_MAIN}}}c"):
                    i = column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (i - len(cells))
                    kind, v = c.get("t"), c.find(f"{{{_MAIN}}}v")
                    if kind == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{{{_MAIN}}}t")))
                    elif v is None:
                        cells.append(None)
                    else:
                        cells.append(shared[int(v.text)] if kind == "s" else v.text)
                rows.append(cells)
            width = max(map(len, rows), default=0)
            yield sheet.get("name"), [r + [None] * (width - len(r)) for r in rows]
