"""Office packages: zip archives of XML parts, read into relations with the standard library only.

``binaryFile`` lists and reads the packages, so any store that Spark reads will do; each is unpacked and parsed where its bytes
are. XML with a document type is refused, so no entity is ever resolved.
"""

from __future__ import annotations

import contextlib
import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: name spaces and relationship types.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
CONTENT_TYPES = "{http://schemas.openxmlformats.org/package/2006/content-types}"
PACKAGE_RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
MAIN_TYPE = "/officeDocument"
THEME = re.compile(r"/theme/theme\d*\.xml$")
TEXT_PARTS = re.compile(r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml$")
#: Bytes of a part beyond which a package is refused.
LARGEST_PART = 256 << 20


class Refused(ValueError):
    """A package that can't be read."""


def parse(data: bytes) -> ElementTree.Element:
    if len(data) > LARGEST_PART:
        raise Refused("a part is too large")
    def refuse(*_: object) -> None:
        raise Refused("document types are not read")

    def begun(*_: object) -> None:
        raise StopIteration

    # The parser itself reports a document type, whatever the encoding that hides it; one stands before the first element or nowhere.
    before = expat.ParserCreate()
    before.StartDoctypeDeclHandler, before.StartElementHandler = refuse, begun
    try:
        with contextlib.suppress(StopIteration):
            before.Parse(data, True)
        return ElementTree.fromstring(data)
    except (ElementTree.ParseError, expat.ExpatError) as e:
        raise Refused(str(e)) from e


def opened(data: bytes) -> tuple[zipfile.ZipFile, str]:
    """The archive and its main part's name, found by the package's own relationships."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        rels = parse(z.read("_rels/.rels"))
    except (zipfile.BadZipFile, KeyError) as e:
        raise Refused(f"no package: {e}") from e
    for r in rels.iter(f"{PACKAGE_RELS}Relationship"):
        if r.get("Type", "").endswith(MAIN_TYPE):
            name = r.get("Target", "").lstrip("/")
            if name in z.namelist():
                return z, name
    raise Refused("no main part")


def _content(parent: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Children, those of content controls in their place."""
    for child in parent:
        if child.tag == f"{W}sdt":
            inner = child.find(f"{W}sdtContent")
            yield from _content(inner) if inner is not None else ()
        elif child.tag == f"{W}customXml":
            yield from _content(child)
        else:
            yield child


def _text(p: ElementTree.Element) -> str:
    """A paragraph's own text: paragraphs inside it, such as those of text boxes, are others'."""
    out = []
    for r in p:
        if r.tag == f"{W}t":
            out.append(r.text or "")
        elif r.tag in (f"{W}tab", f"{W}br"):
            out.append(" ")
        elif r.tag != f"{W}p":
            out.append(_text(r))
    return "".join(out)


def _cell_text(tc: ElementTree.Element) -> str:
    """A cell's own paragraphs, without those of tables inside it."""
    return "\n".join(_text(p) for p in _content(tc) if p.tag == f"{W}p")


def _value(el: ElementTree.Element | None, path: str, name: str = "val") -> str | None:
    found = el.find(path) if el is not None else None
    return found.get(f"{W}{name}") if found is not None else None


def read_blocks(data: bytes) -> list[tuple]:
    """(block_ix, kind, style_id, level, is_list, text) of the main part's body."""
    z, main = opened(data)
    body = parse(z.read(main)).find(f"{W}body")
    if body is None:
        raise Refused("no body")
    out = []
    for el in _content(body):
        if el.tag == f"{W}p":
            props = el.find(f"{W}pPr")
            level = _value(props, f"{W}outlineLvl")
            out.append((len(out), "paragraph", _value(props, f"{W}pStyle") or "Normal", int(level) if level else None, props is not None and props.find(f"{W}numPr") is not None, _text(el)))
        elif el.tag == f"{W}tbl":
            rows = [" | ".join(_cell_text(c) for c in _content(tr) if c.tag == f"{W}tc") for tr in _content(el) if tr.tag == f"{W}tr"]
            out.append((len(out), "table", None, None, False, "\n".join(rows)))
    return out


def read_runs(data: bytes) -> list[tuple]:
    """(part, para_ix, run_ix, start, end, text, bold, italic, size) of all text parts."""
    z, main = opened(data)
    out = []
    for name in z.namelist():
        if name != main and not TEXT_PARTS.search(name):
            continue
        for k, p in enumerate(parse(z.read(name)).iter(f"{W}p")):
            at = 0
            for i, r in enumerate(p.iter(f"{W}r")):
                text, props = "".join(t.text or "" for t in r.findall(f"{W}t")), r.find(f"{W}rPr")
                toggle = lambda tag: None if props is None or props.find(f"{W}{tag}") is None else (_value(props, f"{W}{tag}") not in ("0", "false"))  # noqa: B023, E731
                size = _value(props, f"{W}sz")
                out.append((name, k, i, at, at + len(text), text, toggle("b"), toggle("i"), int(size) / 2 if size else None))
                at += len(text)
    return out


def read_cells(data: bytes) -> list[tuple]:
    """(table_ix, row_ix, cell_ix, col_start, span, vmerge, text) of the main part's tables, nested ones after their outer one."""
    z, main = opened(data)
    out = []
    for k, tbl in enumerate(parse(z.read(main)).iter(f"{W}tbl")):
        for i, tr in enumerate(x for x in _content(tbl) if x.tag == f"{W}tr"):
            start = int(_value(tr.find(f"{W}trPr"), f"{W}gridBefore") or 0)
            for j, tc in enumerate(x for x in _content(tr) if x.tag == f"{W}tc"):
                props = tc.find(f"{W}tcPr")
                span = int(_value(props, f"{W}gridSpan") or 1)
                merge = props.find(f"{W}vMerge") if props is not None else None
                out.append((k, i, j, start, span, None if merge is None else merge.get(f"{W}val", "continue"), _cell_text(tc)))
                start += span
    return out


def read_styles(data: bytes) -> list[tuple]:
    """(style_id, name, outline, based_on)."""
    z, main = opened(data)
    name = main.rsplit("/", 1)[0] + "/styles.xml"
    if name not in z.namelist():
        return []
    out = []
    for s in parse(z.read(name)).iter(f"{W}style"):
        title, level = _value(s, f"{W}name"), _value(s, f"{W}pPr/{W}outlineLvl")
        out.append((s.get(f"{W}styleId"), title, int(level) if level else None, _value(s, f"{W}basedOn")))
    return out


def read_images(data: bytes) -> list[tuple]:
    """(image_ix, cx, cy, name)."""
    z, main = opened(data)
    frames = [d for d in parse(z.read(main)).iter() if d.tag in (f"{WP}inline", f"{WP}anchor")]
    out = []
    for k, d in enumerate(frames):
        extent, props = d.find(f"{WP}extent"), d.find(f"{WP}docPr")
        out.append((k, int(extent.get("cx")) if extent is not None else None, int(extent.get("cy")) if extent is not None else None, props.get("name") if props is not None else None))
    return out


def read_fonts(data: bytes) -> list[tuple]:
    """(part, font): fonts that runs, styles and the theme ask for, each once for a part; references to the theme are left to the theme's own names."""
    z, main = opened(data)
    found = set()
    for name in z.namelist():
        if name == main or TEXT_PARTS.search(name) or name.endswith("/styles.xml"):
            for fonts in parse(z.read(name)).iter(f"{W}rFonts"):
                found |= {(name, fonts.get(f"{W}{kind}")) for kind in ("ascii", "hAnsi", "cs", "eastAsia")}
        elif THEME.search(name):
            found |= {(name, e.get("typeface")) for e in parse(z.read(name)).iter() if e.tag.rsplit("}", 1)[-1] == "latin"}
    return sorted((part, font) for part, font in found if font and not font.startswith("+"))


RELATIONS = {
    "fonts": (read_fonts, "part string, font string"),
    "blocks": (read_blocks, "block_ix int, kind string, style_id string, level int, is_list boolean, text string"),
    "runs": (read_runs, "part string, para_ix int, run_ix int, start int, end int, text string, bold boolean, italic boolean, size double"),
    "cells": (read_cells, "table_ix int, row_ix int, cell_ix int, col_start int, span int, vmerge string, text string"),
    "styles": (read_styles, "style_id string, name string, outline int, based_on string"),
    "images": (read_images, "image_ix int, cx long, cy long, name string"),
}


def files(spark: SparkSession, path: str, pattern: str = "*.docx") -> DataFrame:
    """path, content of every package under a path, in any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def relation(packages: DataFrame, name: str) -> DataFrame:
    """path, the relation's columns, error: a package that is refused gives one row with the reason and nulls."""
    read, columns = RELATIONS[name]
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, *r, None) for r in read(content)]
                except Refused as e:
                    rows.append((path, *[None] * len(names), str(e)))
            yield pd.DataFrame(rows, columns=["path", *names, "error"], dtype=object)

    return packages.select("path", "content").mapInPandas(run, f"path string, {columns}, error string")


def parts(packages: DataFrame) -> DataFrame:
    """path, part, size, digest of every member, so that unchanged ones can be told."""
    import hashlib

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                rows += [(path, i.filename, i.file_size, hashlib.sha256(z.read(i)).hexdigest()) for i in z.infolist()]
            yield pd.DataFrame(rows, columns=["path", "part", "size", "digest"])

    return packages.mapInPandas(run, "path string, part string, size long, digest string")


def repack(data: bytes, changed: dict[str, bytes]) -> bytes:
    """The package with changed and new parts in it; all others keep their bytes, order and properties. What was written is read back: checksums of all
    members, and changed XML must parse."""
    try:
        old = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Refused(f"no package: {e}") from e
    out, rest = io.BytesIO(), dict(changed)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in old.infolist():
            new.writestr(info, rest.pop(info.filename) if info.filename in rest else old.read(info))
        for name in sorted(rest):
            new.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), rest[name], zipfile.ZIP_DEFLATED)
    back = zipfile.ZipFile(io.BytesIO(out.getvalue()))
    if back.testzip():
        raise Refused("a member's checksum is wrong")
    for name in changed:
        if name.endswith((".xml", ".rels")):
            parse(back.read(name))
    return out.getvalue()


def repacked(packages: DataFrame, changes: DataFrame) -> DataFrame:
    """path, content, error of packages (path, content) with changes (path, part, data) made to them: all of a package's, or none and the reason. Packages
    without changes come out as they went in."""
    by_path = changes.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("part", "data"))).alias("parts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content, parts_ in zip(pdf["path"], pdf["content"], pdf["parts"], strict=True):
                try:
                    rows.append((path, repack(content, {k: bytes(v) for k, v in dict(parts_).items()}) if parts_ is not None else content, None))
                except Refused as e:
                    rows.append((path, content, str(e)))
            yield pd.DataFrame(rows, columns=["path", "content", "error"], dtype=object)

    return packages.join(by_path, "path", "left").select("path", "content", "parts").mapInPandas(run, "path string, content binary, error string")


def related(rels: bytes, kind: str, target: str) -> tuple[bytes, str]:
    """Relationships with one more, and its id: the smallest number that none has."""
    root = parse(rels)
    used = {r.get("Id") for r in root}
    ident = next(f"rId{i}" for i in itertools.count(1) if f"rId{i}" not in used)
    ElementTree.SubElement(root, f"{PACKAGE_RELS}Relationship", {"Id": ident, "Type": kind, "Target": target})
    return ElementTree.tostring(root, "UTF-8", xml_declaration=True), ident


def typed(types: bytes, extension: str, kind: str) -> bytes:
    """Content types with one for a file extension, if it has none."""
    root = parse(types)
    name = f"{CONTENT_TYPES}Default"
    if not any(e.tag == name and e.get("Extension", "").lower() == extension.lower() for e in root):
        root.insert(0, ElementTree.Element(name, {"Extension": extension, "ContentType": kind}))
    return ElementTree.tostring(root, "UTF-8", xml_declaration=True)


def styled(blocks: DataFrame, styles: DataFrame) -> DataFrame:
    """Blocks with the level of their own or of their style, inherited over parents ten steps at most; where that chain gives none, the
    nearest name in it that begins with "heading" and a digit does."""
    from folio.operators.lookup import inherited

    keyed = styles.select(F.struct("path", "style_id").alias("k"), F.when(F.col("based_on").isNotNull(), F.struct("path", F.col("based_on").alias("style_id"))).alias("p"), "outline", "name")
    named = keyed.select("k", "p", (F.regexp_extract("name", r"(?i)^heading\s*(\d)", 1).try_cast("int") - 1).alias("named"))
    levels = inherited(keyed, "k", "p", "outline").join(inherited(named, "k", "p", "named"), "k")
    levels = levels.select(F.col("k.path").alias("path"), F.col("k.style_id").alias("style_id"), F.coalesce("outline", "named").alias("outline"))
    return blocks.join(levels, ["path", "style_id"], "left").withColumn("level", F.coalesce("level", "outline")).drop("outline")
