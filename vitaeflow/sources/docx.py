"""Word documents to Markdown, from the XML in the archive."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

# Fixed value: the name space of word processing XML.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MARKS = {(True, True): "***", (True, False): "**", (False, True): "*", (False, False): ""}


def _on(properties, name: str) -> bool:
    found = properties.find(_W + name) if properties is not None else None
    return found is not None and found.get(_W + "val", "true") not in ("0", "false", "none")


def run_text(run) -> str:
    """A run's text with marks for bold and italic."""
    text = "".join({"t": x.text or "", "tab": "\t", "br": "\n", "cr": "\n"}.get(x.tag.removeprefix(_W), "") for x in run)
    mark = _MARKS[_on(run.find(_W + "rPr"), "b"), _on(run.find(_W + "rPr"), "i")]
    return f"{mark}{text}{mark}" if text.strip() else text


def heading_level(style: str) -> int:
    found = re.search(r"\d+", style)
    return min(6, max(1, int(found[0]))) if found else 1


def paragraph(node, styles: dict[str, str]) -> str:
    """A paragraph as Markdown: headings, list items or its runs."""
    properties = node.find(_W + "pPr")
    given = properties.find(_W + "pStyle") if properties is not None else None
    style = styles.get(given.get(_W + "val"), given.get(_W + "val")).lower() if given is not None else ""
    plain = "".join(x.text or "" for x in node.iter(_W + "t")).strip()
    if not plain:
        return ""
    if style.startswith("heading"):
        return "#" * heading_level(style) + " " + plain
    text = "".join(run_text(r) for r in node.iter(_W + "r")).strip()
    number = properties.find(f"{_W}numPr/{_W}numId") if properties is not None else None
    if "list bullet" in style or "list number" in style:
        return ("- " if "bullet" in style else "1. ") + text
    return "- " + text if number is not None and number.get(_W + "val") != "0" else text


def table(node) -> str:
    """A table as Markdown, its first row as head."""
    rows = [
        [" <br> ".join(filter(None, ("".join(t.text or "" for t in p.iter(_W + "t")).strip() for p in cell.iter(_W + "p")))) for cell in row.iterfind(_W + "tc")]
        for row in node.iterfind(_W + "tr")
    ]
    lines = ["| " + " | ".join(cells) + " |" for cells in rows]
    return "\n".join([lines[0], "| " + " | ".join("---" for _ in rows[0]) + " |", *lines[1:]]) if rows and rows[0] else ""


def to_markdown(content: bytes) -> str:
    """The body's paragraphs and tables in order, with blank lines between them."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(_W + "body")
        names: dict[str, str] = {}
        if "word/styles.xml" in archive.namelist():
            for style in ElementTree.fromstring(archive.read("word/styles.xml")).iterfind(_W + "style"):
                name = style.find(_W + "name")
                if name is not None:
                    names[style.get(_W + "styleId")] = name.get(_W + "val")
    parts = [paragraph(x, names) if x.tag == _W + "p" else table(x) if x.tag == _W + "tbl" else "" for x in (body if body is not None else [])]
    text = "\n\n".join(filter(None, parts)).replace("****", "")
    return re.sub(r"\n{3,}", "\n\n", text).strip()
