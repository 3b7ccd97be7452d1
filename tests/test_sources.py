"""Packages from zip archives made here, Markdown and HTML blocks, and publication."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folio.plans import publish
from folio.sources import blocks, packages

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
BODY = f"""<w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Ti</w:t></w:r><w:r><w:rPr><w:b w:val="0"/><w:sz w:val="21"/></w:rPr><w:t>tle</w:t></w:r></w:p>
<w:sdt><w:sdtContent><w:p><w:r><w:t>inside</w:t></w:r></w:p></w:sdtContent></w:sdt>
<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
</w:body></w:document>"""
STYLES = f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="Big"/><w:basedOn w:val="P"/></w:style><w:style w:styleId="P"><w:name w:val="heading 2"/></w:style></w:styles>'


def package(body: str = BODY, main: str = "word/document.xml") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Type="x/officeDocument" Target="{main}"/></Relationships>')
        z.writestr(main, body)
        z.writestr("word/styles.xml", STYLES)
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("docx")
    (d / "good.docx").write_bytes(package())
    (d / "other.docx").write_bytes(package(main="word/renamed.xml"))
    (d / "hostile.docx").write_bytes(package('<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]>' + BODY))
    (d / "broken.docx").write_bytes(b"no zip")
    return str(d)


def rows(df, name, *columns):
    return [tuple(r[c] for c in columns) for r in df.where(F.col("path").endswith(name)).collect()]


def test_packages(spark, folder):
    files = packages.files(spark, folder)
    b = packages.relation(files, "blocks")
    assert rows(b, "good.docx", "block_ix", "kind", "text") == [(0, "paragraph", "Title"), (1, "paragraph", "inside"), (2, "table", "a | b")]
    assert rows(b, "other.docx", "text") == rows(b, "good.docx", "text")
    assert [e for (e,) in rows(b, "hostile.docx", "error")] == ["document types are not read"]
    assert rows(b, "broken.docx", "text") == [(None,)]
    assert rows(packages.relation(files, "runs"), "good.docx", "start", "text", "bold", "size")[:2] == [(0, "Ti", True, None), (2, "tle", False, 10.5)]
    assert rows(packages.relation(files, "cells"), "good.docx", "col_start", "span", "vmerge", "text") == [(0, 2, None, "a"), (2, 1, "restart", "b")]
    levels = packages.styled(b, packages.relation(files, "styles").where("error is null"))
    assert [level for text, level in rows(levels, "good.docx", "text", "level") if text == "Title"] == [1]
    assert packages.parts(files).count() == 9


def test_markdown(spark):
    d = spark.createDataFrame([(1, "# T\n\ntext\n- item\n> said\n|a|b|\n---")], "doc_id long, text string")
    assert [(r["kind"], r["level"], r["text"]) for r in blocks.markdown_blocks(d).orderBy("block_ix").collect()][:4] == [("heading", 1, "T"), ("paragraph", None, "text"), ("list", None, "item"), ("quote", None, "said")]


def test_publish(spark, tmp_path):
    df = spark.range(5)
    target = str(tmp_path / "out")
    assert publish.published(df, target).count() == 5
    with pytest.raises(publish.Refused):
        publish.published(df, target)
    with pytest.raises(publish.Refused):
        publish.published(df, str(tmp_path / "no"), check=lambda d: d.count() > 9)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_stream(spark, tmp_path):
    from folio.streaming import oplog

    spark.sql("select timestamp'2026-01-01 00:01:00' as ts, 'a' as event_type union all select timestamp'2026-01-01 00:02:00', 'a'").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = oplog.log(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    oplog.each_batch(stream, lambda df, k: seen.append((k, df.count())), str(tmp_path / "ck")).awaitTermination()
    assert seen == [(0, 2)]
    assert oplog.windowed(stream).isStreaming


def test_nested_text_and_hidden_document_types():
    """A cell's text is its own, a paragraph's too; a document type is refused in any encoding."""
    from xml.etree import ElementTree

    tc = ElementTree.fromstring(f'<w:tc {W}><w:p><w:r><w:t>own</w:t><w:txbx><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbx></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/></w:tc>')
    assert packages._cell_text(tc) == "own\n"
    for encoding in ("utf-8", "utf-16"):
        with pytest.raises(packages.Refused, match="document types"):
            packages.parse(f'<?xml version="1.0" encoding="{encoding}"?>{" " * 5000}<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>'.encode(encoding))
    assert packages.parse(b"<a><!-- <!DOCTYPE b> --></a>").tag == "a"


def test_page_texts_keep_all_text(spark):
    html = "lead <p>one <b>two</b> three <i>four</i> five 3 < 4</p><script>x</script> tail"
    got = blocks.html_blocks(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("block_ix").collect()
    assert [(r["tag"], r["text"]) for r in got] == [("", "lead"), ("p", "one"), ("b", "two"), ("", "three"), ("i", "four"), ("", "five 3 &lt; 4"), ("", "tail")]


def test_terms_in_blocks(spark):
    """Every term that a text holds, overlapping ones too, whatever the slices."""
    from folio.operators import select

    rows = [(1, "she sells hers"), (2, None), (3, ""), (4, "he"), (4, "he")]
    terms = [(1, "he"), (2, "she"), (3, "hers"), (4, ""), (5, None), (6, "he"), (7, "none")]
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(terms, "item long, term string")
    plain = sorted((i, k) for i, t in rows for k, s in terms if t and s and s in t)
    for most in (select.MOST_TERMS, 2):
        select.MOST_TERMS, kept = most, select.MOST_TERMS
        assert sorted((r["doc_id"], r["item"]) for r in select.containing(docs, wanted).collect()) == plain
        select.MOST_TERMS = kept
    assert select.containing(docs, wanted.limit(0)).count() == 0


def test_inherited_steps(spark):
    """A value ten steps up is found, one eleven up is not."""
    from folio.operators import lookup

    chain = spark.createDataFrame([(i, i - 1, 7 if i == 0 else None) for i in range(14)], "k long, p long, v int")
    got = {r["k"]: r["v"] for r in lookup.inherited(chain, "k", "p", "v").collect()}
    assert got == {i: 7 if i <= 10 else None for i in range(14)}


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2001, 2, 3, 4, 5, 6)), data, zipfile.ZIP_STORED if name.endswith(".bin") else zipfile.ZIP_DEFLATED)
    return out.getvalue()


RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="x/officeDocument" Target="word/document.xml"/><Relationship Id="rId3" Type="y" Target="z"/></Relationships>'


def test_packages_are_rewritten_part_by_part(spark):
    old = zipped({"_rels/.rels": RELS, "word/document.xml": BODY, "word/media/a.bin": b"\0\1" * 500, "docProps/app.xml": "<a/>"})
    changes = [("one", "word/document.xml", b"<b/>"), ("one", "word/new.xml", b"<n/>"), ("two", "word/document.xml", b"<broken"), ("four", "x", b"y")]
    packages_ = spark.createDataFrame([("one", old), ("two", old), ("three", old), ("four", b"no zip")], "path string, content binary")
    got = {r["path"]: r for r in packages.repacked(packages_, spark.createDataFrame(changes, "path string, part string, data binary")).collect()}
    z, before = zipfile.ZipFile(io.BytesIO(bytes(got["one"]["content"]))), zipfile.ZipFile(io.BytesIO(old))
    assert z.namelist() == [*before.namelist(), "word/new.xml"]
    assert z.read("word/document.xml") == b"<b/>" and z.read("word/new.xml") == b"<n/>"
    for name in ("_rels/.rels", "word/media/a.bin", "docProps/app.xml"):
        a, b = z.getinfo(name), before.getinfo(name)
        assert z.read(name) == before.read(name) and (a.date_time, a.compress_type, a.CRC) == (b.date_time, b.compress_type, b.CRC)
    assert bytes(got["three"]["content"]) == old and got["three"]["error"] is None
    assert bytes(got["two"]["content"]) == old and got["two"]["error"]
    assert "no package" in got["four"]["error"]


def test_relationships_and_types():
    rels, ident = packages.related(RELS.encode(), "image", "media/a.png")
    assert ident == "rId2" and b"media/a.png" in rels and packages.related(rels, "image", "b")[1] == "rId4"
    types = b'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="PNG" ContentType="image/png"/></Types>'
    assert packages.typed(types, "png", "image/png").count(b"image/png") == 1
    assert b"image/jpeg" in packages.typed(types, "jpeg", "image/jpeg")


def test_requested_fonts():
    styles = f'<w:styles {W}><w:style w:styleId="H"><w:rPr><w:rFonts w:ascii="Arial" w:hAnsi="Arial" w:cs="Times"/></w:rPr></w:style></w:styles>'
    theme = '<a:theme xmlns:a="x"><a:fonts><a:latin typeface="Georgia"/><a:latin typeface="+mn-lt"/><a:ea typeface="Other"/></a:fonts></a:theme>'
    data = zipped({"_rels/.rels": RELS, "word/document.xml": BODY, "word/styles.xml": styles, "word/theme/theme1.xml": theme})
    assert packages.read_fonts(data) == [("word/styles.xml", "Arial"), ("word/styles.xml", "Times"), ("word/theme/theme1.xml", "Georgia")]
