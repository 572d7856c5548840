"""Text blocks of PDF pages, if a PDF library is installed."""

from __future__ import annotations

from collections.abc import Iterator


def page_blocks(content: bytes) -> Iterator[tuple[int, float, float, float, float, str, int, float]]:
    """(page, x0, y0, x1, y1, text, kind, width) of every block."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF files takes the PyMuPDF package") from e
    with fitz.open(stream=content, filetype="pdf") as document:
        for number, page in enumerate(document):
            for x0, y0, x1, y1, text, _, kind in page.get_text("blocks"):
                yield number, x0, y0, x1, y1, text, kind, page.rect.width
