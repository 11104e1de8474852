"""CSV and other outputs."""

from __future__ import annotations

import logging
import textwrap

from pyspark.sql import DataFrame, SparkSession

from ..schemas import CONTEXT_ROWS, RAW_NOTES

log = logging.getLogger(__name__)


def write_csv(df: DataFrame, path: str, mode: str = "append") -> bool:
    """Write with header and quotes doubled, so that texts of several lines come back whole; whether it worked."""
    try:
        df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
        return True
    except Exception as error:
        log.error("not written to %s: %s", path, error)
        return False


def read_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A written CSV, every column as text, so that ids like 00123 stay what they are; None if it isn't there."""
    try:
        return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    except Exception as error:
        log.warning("nothing read from %s: %s", path, error)
        return None


def save_raw_notes(notes: DataFrame, path: str, mode: str = "append") -> bool:
    return write_csv(notes.select(RAW_NOTES), path, mode)


def save_contexts(contexts: DataFrame, path: str, mode: str = "append") -> bool:
    return write_csv(contexts.select(CONTEXT_ROWS), path, mode)


def save_results(wide: DataFrame, path: str, mode: str = "append") -> bool:
    return write_csv(wide, path, mode)


def page_lines(text: str, width: int = 90, line: int = 14, margin: int = 50, height: int = 792) -> list[list[str]]:
    """The lines of each page: paragraphs wrapped at width, with a blank line's space after each."""
    pages, current, y = [], [], height - margin
    for paragraph in text.split("\n"):
        for part in textwrap.wrap(paragraph, width=width):
            if y < margin:
                pages.append(current)
                current, y = [], height - margin
            current.append(part)
            y -= line
        y -= line
    return [*pages, current]


def write_pdf(text: str, path: str, font: str = "Helvetica", size: int = 11, line: int = 14, width: int = 90) -> None:
    """A plain PDF of a text, written without any library: one content stream for each page."""
    pages = page_lines(text, width, line)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", f"<< /Type /Font /Subtype /Type1 /BaseFont /{font} /Encoding /WinAnsiEncoding >>".encode()]
    kids = []
    for lines in pages:
        shown = [x.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for x in lines]
        stream = b"BT /F1 %d Tf %d TL 50 742 Td\n" % (size, line) + b"".join(b"(%s) Tj T*\n" % x for x in shown) + b"ET"
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(kids), len(kids))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start)
    with open(path, "wb") as file:
        file.write(out)
