"""Word files as tables: segments of paragraphs out, rewritten files in.

Files come as (doc_id, content), for example from Spark's ``binaryFile`` source. One file is
one row, so the work is map-only Python over the standard library's zip and XML readers; a
file that looks malicious or cannot be read gives an error, not a failed job.

A file stays one row from parsing to the gate: its paragraphs are an array in that row, matched
and rewritten there, and what has been written is read again in the same step. So repeated
rows, equal files and missing ids are each judged alone. Reading is a map over rows with
whatever else in them.

Rewriting replaces the bytes of text nodes where they stand. Everything else in a part, such
as declarations of namespaces that only an attribute's value names, stays byte for byte.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty
from pyspark.sql.pandas.types import to_arrow_type

from tagveil.functions import text as T
from tagveil.operators import matching, redact, spans
from tagveil.operators import segments as segments_

# Limits against zip bombs, parts with paragraphs, properties that can tell who wrote the file.
MOST_PARTS, MOST_BYTES = 4096, 300 << 20
CONTENT_PART = re.compile(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml\Z")
PROPERTY_PARTS = ("docProps/core.xml", "docProps/app.xml")
PROPERTY_FIELDS = frozenset({"creator", "lastModifiedBy", "title", "subject", "description", "keywords", "Company", "Manager"})
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_WORD = _W[1:-1]
_SPACE = re.compile(rb"""\s(?:xml:space)\s*=\s*(?:"[^"]*"|'[^']*')""")
_START_TAG = re.compile(rb"""<[^<>"']*(?:(?:"[^"]*"|'[^']*')[^<>"']*)*>""")
#: Characters that XML cannot hold.
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")

#: Files that a task holds as Python objects at a time.
ROWS_AT_ONCE = 64

#: Paragraphs in the order of the file, each the texts of its nodes.
PARAGRAPHS = "array<struct<part:string,para_idx:int,texts:array<string>>>"
READ = f"struct<paragraphs:{PARAGRAPHS},error:string>"
WRITTEN = f"struct<content:binary,paragraphs:{PARAGRAPHS},error:string>"


class UnsafeFile(Exception):
    pass


#: What reading a broken, encrypted or oddly packed file can raise.
BROKEN = (UnsafeFile, zipfile.BadZipFile, expat.ExpatError, zlib.error, EOFError, RuntimeError, NotImplementedError, UnicodeError, ValueError, OSError)


def _parts(content: bytes) -> list[tuple[zipfile.ZipInfo, bytes]]:
    """All members, after the checks that need no reading."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        members = z.infolist()
        if len(members) > MOST_PARTS:
            raise UnsafeFile("too many parts")
        if sum(m.file_size for m in members) > MOST_BYTES:
            raise UnsafeFile("too large when unpacked")
        for m in members:
            steps = m.filename.replace("\\", "/").split("/")
            if not steps[0] or ".." in steps:
                raise UnsafeFile("unsafe member path")
        return [(m, z.read(m)) for m in members]


@dataclass
class Node:
    """A text node: the bytes of its element and what it says."""

    start: int
    end: int = 0
    text: str = ""
    is_run: bool = True


def _utf8(data: bytes) -> bytes:
    """The part in UTF-8, so that offsets in it are those of the parser."""
    if data[:2] not in (b"\xff\xfe", b"\xfe\xff"):
        return data
    return re.sub(r"""(<\?xml[^>]*encoding\s*=\s*["'])[^"']*""", r"\1UTF-8", data.decode("utf-16"), count=1).encode("utf-8")


def _units(name: str, data: bytes) -> list[list[Node]]:
    """Text nodes of a part by paragraph, the nearest one around them; a property is a paragraph of one node."""
    content = CONTENT_PART.match(name) is not None
    if not content and name not in PROPERTY_PARTS:
        return []
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    units: list[list[Node]] = []
    paragraphs: list[list[Node]] = []
    open_nodes: list[Node | None] = []
    depth_of_paragraph: list[int] = []

    def refuse(*_) -> None:
        raise UnsafeFile("document type declarations are refused")

    def start(tag: str, _) -> None:
        uri, _, local = tag.rpartition(" ")
        node = None
        if content and uri == _WORD and local == "p":
            paragraphs.append([])
            units.append(paragraphs[-1])
            depth_of_paragraph.append(len(open_nodes))
        elif content and uri == _WORD and local == "t" and paragraphs:
            node = Node(parser.CurrentByteIndex)
            paragraphs[-1].append(node)
        elif not content and local in PROPERTY_FIELDS:
            node = Node(parser.CurrentByteIndex, is_run=False)
        open_nodes.append(node)

    def end(_) -> None:
        node = open_nodes.pop()
        if node is not None:
            node.end = parser.CurrentByteIndex
            if not node.is_run and node.text.strip():
                units.append([node])
        if depth_of_paragraph and depth_of_paragraph[-1] == len(open_nodes):
            depth_of_paragraph.pop()
            paragraphs.pop()

    def text(part: str) -> None:
        if open_nodes and open_nodes[-1] is not None:
            open_nodes[-1].text += part

    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = refuse
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.Parse(data, True)
    return units


def _paragraphs(content: bytes) -> list[dict]:
    return [{"part": member.filename, "para_idx": p, "texts": [n.text for n in nodes]} for member, data in _parts(content) for p, nodes in enumerate(_units(member.filename, _utf8(data)))]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, a few at a time."""
    return (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE))


def _beside(rows: DataFrame, name: str, kind: str, of: list[str], made: Callable[..., dict]) -> DataFrame:
    """Add a column that a plain function makes of the columns ``of``, row by row. What breaks in a file is its ``error``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            out = []
            for values in zip(*(batch.column(c).to_pylist() for c in of), strict=True):
                try:
                    out.append(made(*values) | {"error": None})
                except BROKEN as e:
                    out.append({"error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, target)], names=[*batch.schema.names, name])

    target = to_arrow_type(ty._parse_datatype_string(kind))
    return rows.mapInArrow(each, ty.StructType([*rows.schema.fields, ty.StructField(name, ty._parse_datatype_string(kind))]))


def read(files: DataFrame) -> DataFrame:
    """Add ``r``, a ``READ`` of each row's ``content``: a Word file's paragraphs, or why there are none. Null is no zip file.

    Rows stay as they are otherwise, whatever else is in them.
    """
    return _beside(files, "r", READ, ["content"], lambda content: {"paragraphs": _paragraphs(content or b"")})


def write(files: DataFrame) -> DataFrame:
    """Add ``w``, ``WRITTEN`` of each row's ``content`` with the texts of ``new`` (like ``PARAGRAPHS``) put in their places: the new file, and what it says when it is read again.

    All that is no text node stays as it is, bytes and all.
    """

    def made(content: bytes | None, new: list[dict] | None) -> dict:
        at = {(x["part"], x["para_idx"], i): (t, t != t.strip()) for x in new or [] for i, t in enumerate(x["texts"])}
        out = _rewrite(content or b"", at)[0] if at else content or b""
        return {"content": out, "paragraphs": _paragraphs(out)}

    return _beside(files, "w", WRITTEN, ["content", "new"], made)


def text_of(paragraphs: Column) -> Column:
    """The non-empty paragraphs, one a line; an empty text where there is none."""
    lines = F.transform(paragraphs, lambda p: F.array_join(p["texts"], ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def _plain(files: DataFrame) -> DataFrame:
    return files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("content").cast("binary").alias("content"))


def segments(files: DataFrame) -> DataFrame:
    """One row a text node of (doc_id, content): (doc_id, part, para_idx, seg_idx, text, error); one row with an error, or without a part if there is no text."""
    found = read(_plain(files)).select("doc_id", "r.error", F.explode_outer("r.paragraphs").alias("p"))
    return found.select("doc_id", "p.part", "p.para_idx", F.posexplode_outer("p.texts").alias("seg_idx", "text"), "error")


def texts(files: DataFrame) -> DataFrame:
    """(doc_id, text, error) of (doc_id, content), a row each; no text where there is an error."""
    return read(_plain(files)).select("doc_id", text_of(F.col("r.paragraphs")).alias("text"), "r.error")


def _rewrite(content: bytes, at: dict[tuple[str, int, int], tuple[str, bool]]) -> tuple[bytes, dict[str, int]]:
    """The file with changed text nodes, and how many of each part changed."""
    named = {key[0] for key in at}
    out, counts = io.BytesIO(), {}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for member, data in _parts(content):
            if member.filename in named:
                own = {key[1:]: new for key, new in at.items() if key[0] == member.filename}
                data, counts[member.filename] = _replaced(member.filename, data, own)
            z.writestr(member, data)
    return out.getvalue(), counts


def _replaced(name: str, original: bytes, new: dict[tuple[int, int], tuple[str, bool]]) -> tuple[bytes, int]:
    data = _utf8(original)
    edits = []
    for p, nodes in enumerate(_units(name, data)):
        for i, node in enumerate(nodes):
            got = new.get((p, i))
            if got is not None and got[0] != node.text:
                edits.append((node, *got))
    if not edits:
        return original, 0
    parts, at = [], 0
    for node, text, preserve in sorted(edits, key=lambda e: e[0].start):
        head = _START_TAG.match(data, node.start)
        tag, body = head[0], escape(_FORBIDDEN.sub("", text or "")).encode("utf-8")
        empty = tag.endswith(b"/>")
        if node.is_run and preserve:
            tag = _SPACE.sub(b"", tag)
            tag = tag[: -2 if empty else -1] + b' xml:space="preserve"' + (b"/>" if empty else b">")
        if empty:
            label = re.match(rb"<([^\s/>]+)", tag)[1]
            parts += [data[at : node.start], tag[:-2] + b">", body, b"</" + label + b">"]
            at = head.end()
        else:
            parts += [data[at : node.start], tag, body]
            at = node.end
    return b"".join([*parts, data[at:]]), len(edits)


def _body(lines: list[str]) -> str:
    return "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in lines)


def plain_docx(lines: list[str], header: list[str] | None = None) -> bytes:
    """A minimal Word file with one paragraph a line, a header if there is one, and no properties."""
    return _package(_body(lines), None if header is None else _body(header))


# Content types, relation types and namespaces of the package format, and a picture's width of six inches in its units.
_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_DRAWING = "http://schemas.openxmlformats.org/drawingml/2006"
PICTURE_WIDTH = 6 * 914_400


def _package(body: str, header: str | None = None) -> bytes:
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    of_header = f'<Override PartName="/word/header1.xml" ContentType="{kind}.header+xml"/>' if header is not None else ""
    shown = ""
    if header is not None:
        shown = f'<w:sectPr xmlns:r="{_RELATIONS}"><w:headerReference w:type="default" r:id="h1"/></w:sectPr>'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{kind}.document.main+xml"/>{of_header}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_RELATIONS}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{body}{shown}</w:body></w:document>',
    }
    if header is not None:
        parts["word/header1.xml"] = f'<w:hdr xmlns:w="{_WORD}">{header}</w:hdr>'
        parts["word/_rels/document.xml.rels"] = f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="h1" Type="{_RELATIONS}/header" Target="header1.xml"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(_member(name), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + data)
    return out.getvalue()


def _member(name: str) -> zipfile.ZipInfo:
    """A new part without the time of writing, so that equal contents are equal files."""
    made = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
    made.compress_type = zipfile.ZIP_DEFLATED
    return made


def with_pictures(content: bytes, pictures: list[tuple[bytes, int, int]]) -> bytes:
    """A file that ``plain_docx`` made or a writer's, with (png, width, height) pictures six inches wide on a page of their own at its end."""
    members = _parts(content)
    known = {m.filename for m, _ in members}
    names = [f"kept{i}.png" for i in range(len(pictures))]
    if not pictures or f"word/media/{names[0]}" in known:
        return content

    def drawn(i: int, width: int, height: int) -> str:
        size = f'cx="{PICTURE_WIDTH}" cy="{PICTURE_WIDTH * max(height, 1) // max(width, 1)}"'
        picture = f'<pic:pic xmlns:pic="{_DRAWING}/picture"><pic:nvPicPr><pic:cNvPr id="{i + 1}" name="kept{i}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="kept{i}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {size}/></a:xfrm><a:prstGeom prst="rect"/></pic:spPr></pic:pic>'
        return f'<w:p><w:r><w:drawing><wp:inline xmlns:wp="{_DRAWING}/wordprocessingDrawing" xmlns:a="{_DRAWING}/main" xmlns:r="{_RELATIONS}"><wp:extent {size}/><wp:docPr id="{i + 1}" name="kept{i}"/><a:graphic><a:graphicData uri="{_DRAWING}/picture">{picture}</a:graphicData></a:graphic></wp:inline></w:drawing></w:r></w:p>'

    own = f'<w:p xmlns:w="{_WORD}">'
    added = "".join(['<w:p><w:r><w:br w:type="page"/></w:r></w:p>', *(drawn(i, w, h) for i, (_, w, h) in enumerate(pictures))]).replace("<w:p>", own)
    rels = "".join(f'<Relationship Id="kept{i}" Type="{_RELATIONS}/image" Target="media/{n}"/>' for i, n in enumerate(names))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for member, data in members:
            if member.filename == "word/document.xml":
                body = re.search(rb"(<(?:\w+:)?sectPr\b(?:(?!</(?:\w+:)?p>).)*)?</(?:\w+:)?body>\s*</(?:\w+:)?document>\s*\Z", _utf8(data), re.S)
                if body is None:
                    return content
                data = _utf8(data)[: body.start()] + added.encode() + body[0]
            elif member.filename == "word/_rels/document.xml.rels":
                data = data.replace(b"</Relationships>", rels.encode() + b"</Relationships>")
            elif member.filename == "[Content_Types].xml" and b'Extension="png"' not in data:
                data = re.sub(rb"(<Types[^>]*>)", rb'\1<Default Extension="png" ContentType="image/png"/>', data, count=1)
            z.writestr(member, data)
        if "word/_rels/document.xml.rels" not in known:
            z.writestr(_member("word/_rels/document.xml.rels"), f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="{_PACKAGE}/relationships">{rels}</Relationships>')
        for name, (png, _, _) in zip(names, pictures, strict=True):
            z.writestr(_member(f"word/media/{name}"), png)
    return out.getvalue()


def embedded(files: DataFrame, pictures: DataFrame) -> DataFrame:
    """(doc_id, content) with the kept pictures (doc_id, image_id, png, width, height) at the end of each file, by image_id; a file that cannot take them stays as it is.

    Files that share an id share its pictures, and those without an id have the pictures without one.
    """

    @F.pandas_udf("binary")
    def put(contents: pd.Series, pictures: pd.Series) -> pd.Series:
        made = []
        for content, own in zip(contents, pictures, strict=True):
            try:
                made.append(with_pictures(bytes(content or b""), [(bytes(p["png"]), p["width"], p["height"]) for p in ([] if own is None else own)]))
            except BROKEN:
                made.append(content)
        return pd.Series(made, dtype=object)

    listed = pictures.groupBy(F.col("doc_id").cast("long").alias("of_id")).agg(F.array_sort(F.collect_list(F.struct("image_id", "png", "width", "height"))).alias("pictures"))
    return _plain(files).join(listed, F.col("doc_id").eqNullSafe(F.col("of_id")), "left").select("doc_id", put("content", "pictures").alias("content"))


def pictures(files: DataFrame) -> DataFrame:
    """(doc_id, at, png, width, height): the pictures drawn in each file's body by their order, sizes in English Metric Units; a file that cannot be read has none."""

    @F.pandas_udf("array<struct<png:binary,width:long,height:long>>")
    def drawn(contents: pd.Series) -> pd.Series:
        made = []
        for content in contents:
            try:
                made.append(_drawn({m.filename: data for m, data in _parts(bytes(content or b""))}))
            except BROKEN:
                made.append([])
        return pd.Series(made, dtype=object)

    return _plain(files).select("doc_id", F.posexplode(drawn("content")).alias("at", "p")).select("doc_id", F.col("at").cast("long").alias("at"), "p.*")


def _drawn(members: dict[str, bytes]) -> list[dict]:
    targets: dict[str, str] = {}
    found: list[dict] = []
    size = [0, 0]

    def start(name: str, attributes: dict[str, str]) -> None:
        kind = name.rsplit(" ", 1)[-1]
        if kind == "Relationship":
            targets[attributes.get("Id", "")] = f"word/{attributes.get('Target', '')}"
        elif kind == "extent":
            size[:] = int(attributes["cx"]), int(attributes["cy"])
        elif kind == "blip":
            data = members.get(targets.get(attributes.get(f"{_RELATIONS} embed", ""), ""))
            if data is not None:
                found.append({"png": data, "width": size[0], "height": size[1]})

    for part in ("word/_rels/document.xml.rels", "word/document.xml"):
        parser = expat.ParserCreate(namespace_separator=" ")
        parser.StartElementHandler = start
        parser.Parse(members.get(part, b"<none/>"), True)
    return found


def from_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, content): each text as a plain Word file, a paragraph a line, with its ``header`` if the table has one."""

    def lines(text: str | None) -> list[str]:
        return _FORBIDDEN.sub("", text or "").split("\n")

    @F.pandas_udf("binary")
    def made(texts: pd.Series, headers: pd.Series) -> pd.Series:
        return pd.Series([plain_docx(lines(t), None if h is None else lines(h)) for t, h in zip(texts, headers, strict=True)], dtype=object)

    header = F.col("header") if "header" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), made(F.col("text"), header).alias("content"))


def _found(files: DataFrame) -> DataFrame:
    """(doc_id, content, paragraphs, error, text) of every file."""
    return read(_plain(files)).select("doc_id", "content", "r.paragraphs", "r.error", text_of(F.col("r.paragraphs")).alias("text"))


def _matched(ruled: DataFrame) -> DataFrame:
    """Add ``new``, the paragraphs that change, with the ``labels`` of what is replaced in each; matches never reach over a paragraph."""

    def one(p: Column) -> Column:
        segs = segments_.placed(F.transform(p["texts"], lambda t, i: F.struct(i.alias("seg_idx"), t.alias("text"))))
        found = spans.resolve_overlaps(matching.candidates_of(F.array_join(p["texts"], ""), F.col("rules")))
        return F.struct(p["part"].alias("part"), p["para_idx"].alias("para_idx"), segs.alias("segs"), found.alias("found"))

    def rewritten(x: Column) -> Column:
        texts = F.transform(segments_.placed_back(x["segs"], x["found"]), lambda n: n["new_text"])
        return F.struct(x["part"].alias("part"), x["para_idx"].alias("para_idx"), texts.alias("texts"), F.transform(x["found"], lambda m: m["label"]).alias("labels"))

    looked = ruled.withColumn("looked", F.when(F.size("rules") > 0, F.filter(F.transform("paragraphs", one), lambda x: F.size(x["found"]) > 0)))
    none = F.expr("cast(array() as array<struct<part:string,para_idx:int,texts:array<string>,labels:array<string>>>)")
    return looked.withColumn("new", F.coalesce(F.transform("looked", rewritten), none)).drop("looked")


def _counts(new: Column) -> Column:
    """How many replacements each part has got, as a map; parts without one are not in it."""
    parts = F.array_distinct(F.transform(new, lambda x: x["part"]))
    of = lambda part: F.size(F.flatten(F.transform(F.filter(new, lambda x: x["part"] == part), lambda x: x["labels"]))).cast("long")
    return F.map_from_entries(F.transform(parts, lambda part: F.struct(part, of(part))))


def _rewritten(matched: DataFrame) -> DataFrame:
    """Add ``w``, what is written of each row's content and ``new``."""
    return write(matched.select("doc_id", "content", "error", "new", *(c for c in ("checks",) if c in matched.columns))).withColumn("error", F.coalesce("error", "w.error"))


def rules_applied(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, content, replaced, error): whole files redacted or restored by rules, a row each; ``replaced`` counts by part."""
    done = _rewritten(_matched(matching.with_rules(_found(files), rules)))
    fine = F.col("error").isNull()
    return done.select("doc_id", F.when(fine, F.col("w.content")).alias("content"), F.when(fine, _counts(F.col("new"))).alias("replaced"), "error")


def redacted(files: DataFrame, entries: DataFrame) -> DataFrame:
    """One row a file: (doc_id, ok, content, text, leaked, replaced, used, error).

    The written file is read again, and its text over all parts checked for each term, also
    across paragraphs. Content and text are null where a term is left, where the file has an
    error and where the check has no verdict. ``replaced`` counts replacements by part,
    ``used`` has the tag of each.
    """
    ruled = redact.with_checks(_found(files), redact.clean_entries(entries))
    done = _rewritten(_matched(ruled)).withColumn("new_text", text_of(F.col("w.paragraphs")))
    none = F.expr("cast(array() as array<string>)")
    leaked = F.coalesce(redact.left_of(F.col("checks"), F.col("new_text")), none)
    ok = F.coalesce(F.col("error").isNull() & (F.size("leaked") == 0) & F.col("new_text").isNotNull(), F.lit(False))
    out = done.withColumn("leaked", F.when(F.col("error").isNull(), leaked).otherwise(none)).withColumn("ok", ok)
    released = lambda c: F.when(F.col("ok"), c)
    return out.select(
        "doc_id", "ok", released(F.col("w.content")).alias("content"), released(F.col("new_text")).alias("text"), "leaked", released(_counts(F.col("new"))).alias("replaced"),
        released(F.flatten(F.transform("new", lambda x: x["labels"]))).alias("used"), "error",
    )


def kinds(files: DataFrame) -> DataFrame:
    """(file_id, name) to the reader that takes the file, or an error."""
    kind = T.kind_of(F.col("name"))
    return files.select("file_id", kind.alias("kind"), F.when(kind.isNull(), F.lit("unsupported file type")).alias("error"))
