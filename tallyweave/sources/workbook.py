"""Spreadsheet files (Office Open XML) from plain rows, and back."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
LINES = 1 << 20
#: Control characters that XML cannot hold.
_BARE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_BARE.sub("", str(value)))}</t></is></c>'


def workbook(sheets: list[tuple[str, list[list[object]]]]) -> bytes:
    """The file's bytes, the same for the same sheets. Names that repeat get a number."""
    out, names = io.BytesIO(), []
    for name, rows in sheets:
        if len(rows) > LINES:
            raise ValueError(f"{len(rows)} lines do not fit in the sheet {name}")
        base, n = name or "Sheet", 1
        while (name or "Sheet").lower() in {x.lower() for x in names}:
            n += 1
            name = f"{base[: 31 - len(str(n)) - 1]}_{n}"
        names.append(name or "Sheet")
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>",
    }
    for i, (_, rows) in enumerate(sheets, 1):
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{MAIN}"><sheetData>' + "".join("<row>" + "".join(map(_cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def sheets_of(data: bytes) -> list[tuple[str, list[list[object]]]]:
    """Names and rows of a file that ``workbook`` made."""
    found = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i, s in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet"), 1):
            rows = []
            for row in ET.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{{{MAIN}}}row"):
                rows.append([float(c[0].text) if len(c) and c[0].tag.endswith("}v") else "".join(t.text or "" for t in c.iter(f"{{{MAIN}}}t")) if len(c) else None for c in row])
            found.append((s.get("name"), rows))
    return found
