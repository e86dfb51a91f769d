"""Word files to blocks: paragraphs and tables in order, with list numbering, style and layout.

A DOCX is a zip of XML that Spark has no reader for, so each file is opened in Python, one row at a time; a file that
can't be read gives a row in the errors table and no block.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAX_UNZIPPED = 100 * 1024 * 1024
CHINESE = "零一二三四五六七八九"
SCHEMA = (
    "filename string, seq int, kind string, raw_text string, numbering_label string, numbering_format string, num_id string, list_level int, style_id string, style_name string,"
    " outline_level int, alignment string, bold boolean, font_size int, rows array<array<string>>, error string"
)


def chinese_numeral(n: int) -> str:
    """1 to 99 in Chinese; other numbers in digits."""
    if not 0 <= n < 100:
        return str(n)
    tens, ones = divmod(n, 10)
    if not tens:
        return CHINESE[ones]
    return ("" if tens == 1 else CHINESE[tens]) + "十" + (CHINESE[ones] if ones else "")


def raw_text(element: ET.Element) -> str:
    """Text runs, with tabs and line breaks as such."""
    signs = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
    return "".join((x.text or "") if x.tag == f"{W}t" else signs.get(x.tag, "") for x in element.iter())


def _value(element: ET.Element | None, path: str) -> str | None:
    found = element.find(path) if element is not None else None
    return found.get(f"{W}val") if found is not None else None


def _int(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"-?\d+", value) else None


class Numbering:
    """Labels of numbered paragraphs: a counter for each list and level; a shallower number restarts deeper ones."""

    def __init__(self, xml: bytes | None):
        self.levels: dict[str, dict[int, tuple[int, str, str]]] = {}
        self.counts: dict[str, dict[int, int]] = {}
        if xml is None:
            return
        root = ET.fromstring(xml)
        abstract = {a.get(f"{W}abstractNumId"): {int(v.get(f"{W}ilvl", "0")): (_int(_value(v, f"{W}start")) or 1, _value(v, f"{W}numFmt") or "decimal", _value(v, f"{W}lvlText") or "") for v in a.findall(f"{W}lvl")} for a in root.findall(f"{W}abstractNum")}
        self.levels = {n.get(f"{W}numId"): abstract.get(_value(n, f"{W}abstractNumId"), {}) for n in root.findall(f"{W}num")}

    def label(self, num_id: str, level: int) -> tuple[str, str]:
        levels = self.levels.get(num_id, {})
        start, kind, template = levels.get(level, (1, "decimal", f"%{level + 1}."))
        counts = self.counts.setdefault(num_id, {})
        counts[level] = counts.get(level, start - 1) + 1
        for deeper in [k for k in counts if k > level]:
            del counts[deeper]
        if kind == "bullet":
            return "", kind

        def number(match: re.Match) -> str:
            at = int(match[1]) - 1
            n = counts.get(at, levels.get(at, (1, "", ""))[0])
            return chinese_numeral(n) if levels.get(at, (1, "decimal", ""))[1] in ("chineseCounting", "chineseCountingThousand") else str(n)

        return re.sub(r"%(\d)", number, template), kind


def styles_of(xml: bytes | None) -> dict[str, dict]:
    if xml is None:
        return {}
    out = {}
    for style in ET.fromstring(xml).findall(f"{W}style"):
        p = style.find(f"{W}pPr")
        out[style.get(f"{W}styleId")] = {
            "name": _value(style, f"{W}name") or "",
            "outline_level": _int(_value(p, f"{W}outlineLvl")),
            "num_id": _value(p, f"{W}numPr/{W}numId"),
            "list_level": _int(_value(p, f"{W}numPr/{W}ilvl")),
        }
    return out


def docx_rows(content: bytes) -> list[dict]:
    """The blocks of one file; raises for what is no readable DOCX."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if sum(i.file_size for i in z.infolist()) > MAX_UNZIPPED:
            raise ValueError("unpacks to more than 100 MiB")
        part = lambda name: z.read(name) if name in z.namelist() else None
        if (document := part("word/document.xml")) is None:
            raise ValueError("no word/document.xml")
        numbering, styles = Numbering(part("word/numbering.xml")), styles_of(part("word/styles.xml"))
    body = ET.fromstring(document).find(f"{W}body")
    rows: list[dict] = []
    for element in body if body is not None else ():
        row: dict = {"kind": "paragraph"}
        if element.tag == f"{W}tbl":
            cells = [[raw_text(c).strip() for c in r.findall(f"{W}tc")] for r in element.findall(f"{W}tr")]
            cells = [r for r in cells if any(r)]
            row |= {"kind": "table", "rows": cells, "raw_text": "\n".join("\t".join(r) for r in cells)}
        elif element.tag == f"{W}p":
            p = element.find(f"{W}pPr")
            style = styles.get(_value(p, f"{W}pStyle") or "", {})
            num_id = _value(p, f"{W}numPr/{W}numId") or style.get("num_id")
            level = _int(_value(p, f"{W}numPr/{W}ilvl"))
            level = style.get("list_level") if level is None else level
            outline = _int(_value(p, f"{W}outlineLvl"))
            runs = [r for r in element.iter(f"{W}r") if raw_text(r).strip()]
            sizes = [s for r in runs if (s := _int(_value(r, f"{W}rPr/{W}sz"))) is not None]
            row |= {
                "raw_text": raw_text(element), "style_id": _value(p, f"{W}pStyle"), "style_name": style.get("name"), "alignment": _value(p, f"{W}jc"),
                "outline_level": style.get("outline_level") if outline is None else outline, "font_size": max(sizes, default=None),
                "bold": bool(runs) and all((b := r.find(f"{W}rPr/{W}b")) is not None and b.get(f"{W}val") not in ("0", "false") for r in runs),
            }
            if row["raw_text"].strip() and num_id and num_id != "0":
                label, kind = numbering.label(num_id, level or 0)
                row |= {"num_id": num_id, "list_level": level or 0, "numbering_label": label, "numbering_format": kind}
        else:
            continue
        if row["raw_text"].strip():
            rows.append(row | {"seq": len(rows) + 1})
    return rows


def docx_blocks(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, errors) of uploads (filename, content). A table's text has its cells joined by ' | '."""
    names = [part.split()[0] for part in SCHEMA.split(",")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["filename"], batch["content"], strict=True):
                try:
                    rows = docx_rows(bytes(content)) or [{"error": "no text"}]
                except Exception as e:  # one bad file must not end the job
                    rows = [{"error": f"{type(e).__name__}: {e}"}]
                frame = pd.DataFrame([{"filename": name} | r for r in rows], columns=names)
                yield frame.astype(object).where(frame.notna(), None)

    found = uploads.select("filename", "content").mapInPandas(read, SCHEMA)
    table = F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ")), "\n")
    text = clean_text(F.when(F.col("kind") == "table", table).otherwise(F.col("raw_text")))
    blocks = found.filter("error is null").withColumn("text", text).withColumn("block_id", F.format_string("B%04d", "seq")).drop("error")
    return blocks, found.filter("error is not null").select("filename", "error")
