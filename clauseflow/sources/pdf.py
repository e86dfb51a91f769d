"""PDF files to blocks, where the optional PyMuPDF is installed; without it every file is reported as an error."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text

MAX_PAGES, MAX_SIGNS = 1000, 5_000_000
SCHEMA = "filename string, seq int, page int, raw_text string, bbox array<double>, block_no int, error string"
Row = tuple


def pdf_rows(content: bytes) -> list[Row]:
    """(page, text, bbox, block number) of each text block in reading order."""
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("PyMuPDF is not installed") from e
    rows: list[Row] = []
    with pymupdf.open(stream=content, filetype="pdf") as pdf:
        if len(pdf) > MAX_PAGES:
            raise ValueError("more than 1000 pages")
        for page in pdf:
            for x0, y0, x1, y1, text, number, kind in page.get_text("blocks", sort=True):
                if kind == 0 and text.strip():
                    rows.append((page.number + 1, text, [round(v, 2) for v in (x0, y0, x1, y1)], number))
            if sum(len(r[1]) for r in rows) > MAX_SIGNS:
                raise ValueError("more than 5 million signs")
    return rows


def pdf_blocks(uploads: DataFrame, read=pdf_rows) -> tuple[DataFrame, DataFrame]:
    """(blocks, errors) of uploads (filename, content); read may be another parser of bytes to such rows."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["filename"], batch["content"], strict=True):
                try:
                    rows = [(name, i, page, text, box, number, None) for i, (page, text, box, number) in enumerate(read(bytes(content)), 1)]
                    rows = rows or [(name, None, None, None, None, None, "no text")]
                except Exception as e:  # one bad file must not end the job
                    rows = [(name, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=names).astype(object)

    found = uploads.select("filename", "content").mapInPandas(run, SCHEMA)
    blocks = found.filter("error is null").withColumns({"text": clean_text(F.col("raw_text")), "kind": F.lit("paragraph"), "block_id": F.format_string("B%04d", "seq")}).drop("error")
    return blocks, found.filter("error is not null").select("filename", "error")
