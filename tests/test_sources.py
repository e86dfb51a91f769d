import io
import zipfile

from pyspark.sql import functions as F

from clauseflow.operators import sinks, structure
from clauseflow.sources import documents, docx, pdf, text
from clauseflow.streaming import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx_bytes():
    para = lambda t, n=False: f"<w:p>{'<w:pPr><w:numPr><w:ilvl w:val=\"0\"/><w:numId w:val=\"1\"/></w:numPr></w:pPr>' if n else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    body = para("服务内容", True) + para("乙方提供服务。") + para("付款方式", True) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>甲</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>乙</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/numbering.xml", numbering)
    return out.getvalue()


def test_uploads_of_all_kinds(spark, tmp_path):
    files = {"a.txt": "第一条 题目\n\n正文".encode(), "b.txt": "第一条 国标".encode("gb18030"), "c.docx": docx_bytes(), "d.docx": b"no zip", "e.pdf": b"%PDF", "f.exe": b"x"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    blocks, errors = documents.parse_uploads(text.files(spark, str(tmp_path)))
    got = {(r["filename"], r["seq"]): r for r in blocks.collect()}
    assert [got["a.txt", i]["text"] for i in (1, 2)] == ["第一条 题目", "正文"] and got["b.txt", 1]["text"] == "第一条 国标"
    assert [got["c.docx", i]["numbering_label"] for i in (1, 2, 3)] == ["1.", None, "2."] and got["c.docx", 4]["text"] == "甲 | 乙"
    assert {r["filename"] for r in errors.collect()} == {"d.docx", "e.pdf", "f.exe"}
    ids = documents.with_contract_id(blocks).select("filename", "contract_id").distinct().collect()
    assert len({r["contract_id"] for r in ids}) == 3 and all(r["contract_id"].startswith("c-") and len(r["contract_id"]) == 14 for r in ids)
    tree = structure.analyze(blocks.filter("filename = 'c.docx'").withColumn("contract_id", F.col("filename")))
    assert [r["label"] for r in tree[2].orderBy("clause_seq").collect()] == ["1.", "2."]
    assert sinks.parse_json(tree[0], tree[2], tree[1]).count() == 1


def test_upload_limits(spark):
    rows = [("a.txt", ".txt", 0), ("b.txt", ".txt", 26 * 1024 * 1024), ("c.md", ".md", 1), ("d.pdf", ".pdf", 1)]
    good, bad = text.validated(spark.createDataFrame([(n, s, k, bytearray(b"x")) for n, s, k in rows], "filename string, suffix string, length long, content binary"))
    assert [r["filename"] for r in good.collect()] == ["d.pdf"]
    assert {r["filename"]: r["reason"] for r in bad.collect()} == {"a.txt": "empty file", "b.txt": "too large", "c.md": "unsupported suffix"}


def test_numerals_and_settings(tmp_path, monkeypatch):
    assert [docx.chinese_numeral(n) for n in (0, 5, 10, 11, 20, 99, 100)] == ["零", "五", "十", "十一", "二十", "九十九", "100"]
    (tmp_path / ".env").write_text("export A='1'\nB=2\nbroken\n#C=3\n")
    monkeypatch.setenv("B", "9")
    assert documents.settings(tmp_path / ".env", {"A": "0", "D": "4"}) == {"A": "1", "B": "9", "D": "4"}


def test_pdf_takes_another_parser(spark):
    files = spark.createDataFrame([("x.pdf", bytearray(b"1"))], "filename string, content binary")
    blocks, errors = pdf.pdf_blocks(files, lambda content: [(1, "第一条  甲", [0.0, 1.0, 2.0, 3.0], 0)])
    assert [r["text"] for r in blocks.collect()] == ["第一条 甲"] and errors.isEmpty()


def test_review_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("第二条 总价款100.00元；首付款30.00元；余款80.00元。")
    texts = ingest.arriving_texts(spark, str(tmp_path / "in"))
    ingest.review_stream(texts, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert [r["code"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["amount_conflict"]
