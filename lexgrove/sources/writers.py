"""Sinks beyond Spark's own: Markdown as a word file, written where the executors' rows are."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}


def _runs(text: str) -> str:
    """Bold and italic marks become runs."""
    out = []
    for part in re.split(r"(\*\*[^*]+\*\*|\*[^*]+\*)", text):
        mark = "<w:b/>" if part.startswith("**") else "<w:i/>" if part.startswith("*") and len(part) > 2 else ""
        body = part.strip("*") if mark else part
        if body:
            out.append(f'<w:r>{f"<w:rPr>{mark}</w:rPr>" if mark else ""}<w:t xml:space="preserve">{escape(body)}</w:t></w:r>')
    return "".join(out)


def _paragraph(text: str, style: str = "") -> str:
    props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{props}{_runs(text)}</w:p>"


def markdown_docx(markdown: str, provenance: dict[str, str] | None = None) -> bytes:
    """Headings, bullets, numbers, quotes and tables of a Markdown text as a word file, provenance on a last page."""
    body: list[str] = []
    table: list[list[str]] = []

    def flush() -> None:
        if table:
            cells = lambda r: "".join(f"<w:tc>{_paragraph(c)}</w:tc>" for c in r)
            body.append("<w:tbl>" + "".join(f"<w:tr>{cells(r)}</w:tr>" for r in table) + "</w:tbl>" + _paragraph(""))
            table.clear()

    for line in markdown.splitlines():
        if line.startswith("|"):
            row = [c.strip() for c in line.strip().strip("|").split("|")]
            if not all(re.fullmatch(r":?-+:?", c) for c in row):
                table.append(row)
            continue
        flush()
        for pattern, style in ((r"(#{1,6})\s+(.*)", "Heading"), (r"([-*])\s+(.*)", "ListBullet"), (r"(\d+\.)\s+(.*)", "ListNumber"), (r"(>)\s?(.*)", "Quote")):
            if m := re.fullmatch(pattern, line):
                body.append(_paragraph(m.group(2), f"Heading{len(m.group(1))}" if style == "Heading" else style))
                break
        else:
            if line.strip():
                body.append(_paragraph(line))
    flush()
    if provenance:
        body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        body += [_paragraph(f"{k}: {v}") for k, v in provenance.items()]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in PARTS.items():
            z.writestr(name, content)
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W}"><w:body>{"".join(body)}</w:body></w:document>')
    return out.getvalue()


def as_docx(drafts: DataFrame) -> DataFrame:
    """drafts(path, text) -> path, content: each text as a word file, for a binary sink."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([markdown_docx(t or "") for t in b.column(1).to_pylist()], pa.binary())], names=["path", "content"])

    return drafts.select("path", "text").mapInArrow(run, "path string, content binary")
