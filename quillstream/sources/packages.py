"""Importers of writing programs' files: each gives plain text, Markdown or screenplay rows for the frames.

Files are read by Spark as binary rows. One file is one row of a batch; a file that can't be read becomes a row with `error`
and no text, so that one damaged file never fails a job. Only the project format whose texts lie in files of their own is
joined: binder rows on one side, text files on the other.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Import limits and the styles that are headings.
MAX_BYTES, MAX_DEPTH = 64 * 1024 * 1024, 256
HEADING_STYLES = {"title": 1, "heading1": 1, "heading2": 2, "heading3": 3, "heading4": 4, "heading5": 5, "heading6": 6}

Found = list[tuple[str, str, str]]  # name within the file, format, text
ROWS = "path string, nth int, name string, format string, source string, error string"


def _tag(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _attribute(node: ElementTree.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), "")


def _own_text(node: ElementTree.Element) -> str:
    """The text directly inside a node, that of its children left out."""
    return (node.text or "") + "".join(c.tail or "" for c in node)


def _member(content: bytes, names: Callable[[str], bool]) -> bytes:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        name = next((n for n in archive.namelist() if names(n)), None)
        if name is None:
            raise ValueError("the archive lacks its text part")
        with archive.open(name) as part:
            data = part.read(MAX_BYTES + 1)
    if len(data) > MAX_BYTES:
        raise ValueError("the text part exceeds the import limit")
    return data


def _body(node: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Paragraphs outside of tables."""
    for child in node:
        if _tag(child) == "p":
            yield child
        elif _tag(child) != "tbl":
            yield from _body(child)


def word_processor(content: bytes) -> Found:
    """Markdown of a .docx file: heading styles, list items, body text; tables, field codes and deletions are left out."""
    paragraphs = []
    for p in _body(ElementTree.fromstring(_member(content, lambda n: n == "word/document.xml"))):
        nodes = [(x, _tag(x)) for x in p.iter()]
        text = "".join(x.text or "" if t == "t" else " " if t in ("tab", "br", "cr") else "" for x, t in nodes).rstrip("\r\n")
        style = next((re.sub(r"[\s_-]", "", _attribute(x, "val")).lower() for x, t in nodes if t == "pStyle"), "")
        if not text:
            continue
        if style in HEADING_STYLES:
            text = "#" * HEADING_STYLES[style] + " " + text
        elif any(t == "numPr" for _, t in nodes):
            text = "- " + text
        elif text.startswith("#"):
            text = "\\" + text
        paragraphs.append(text)
    return [("", "markdown", "\n\n".join(paragraphs))]


def script(content: bytes) -> Found:
    """A screenplay of a .fdx file: cues in capitals, lines under them, all else in blocks of its own."""
    out = ""
    for body in (x for x in ElementTree.fromstring(content).iter() if _tag(x) == "Content"):
        for p in (x for x in body.iter() if _tag(x) == "Paragraph"):
            text = "".join("".join(t.itertext()) for t in p if _tag(t) == "Text").strip()
            kind = _attribute(p, "Type")
            if text:
                out += f"\n{text.upper()}\n" if kind == "Character" else f"{text}\n" if kind in ("Dialogue", "Parenthetical") else f"\n{text}\n\n"
    if not out.strip():
        raise ValueError("no script paragraphs")
    return [("", "fountain", out)]


def notes(content: bytes) -> Found:
    """Each note with text of a .tbx file, named by the titles above it."""
    out: Found = []

    def walk(node: ElementTree.Element, path: str, depth: int) -> None:
        if _tag(node) == "item":
            if depth >= MAX_DEPTH:
                raise ValueError("notes are nested too deeply")
            title = "".join(_own_text(c) for c in node if _tag(c) == "attribute" and _attribute(c, "name") == "Name").strip()
            text = "".join(_own_text(c) for c in node if _tag(c) == "text")
            path, depth = f"{path}/{title or 'Untitled'}", depth + 1
            if text.strip():
                out.append((path, "plain", text.replace("\r\n", "\n").replace("\r", "\n")))
        for child in node:
            walk(child, path, depth)

    walk(ElementTree.fromstring(content), "", 0)
    if not out:
        raise ValueError("no note text")
    return out


def sheet(content: bytes) -> Found:
    """Markdown of a sheet: its paragraphs, with heading tags as marks."""

    def flat(node: ElementTree.Element) -> str:
        text = node.text or ""
        for child in node:
            level = re.fullmatch("heading([1-6])", _attribute(child, "kind")) if _tag(child) == "tag" else None
            text += ("#" * int(level[1]) + " " if level else flat(child)) + (child.tail or "")
        return text

    strings = [x for x in ElementTree.fromstring(content).iter() if _tag(x) == "string"]
    paragraphs = [flat(p) for s in strings for p in s.iter() if _tag(p) == "p"]
    if not any(p.strip() for p in paragraphs):
        raise ValueError("no body text")
    return [("", "markdown", "\n\n".join(paragraphs))]


def zipped_sheet(content: bytes) -> Found:
    return sheet(_member(content, lambda n: n.rpartition("/")[2] in ("Content.xml", "Contents.xml")))


IMPORTERS: dict[str, Callable[[bytes], Found]] = {"docx": word_processor, "fdx": script, "tbx": notes, "ulyz": zipped_sheet}


def _binary(spark: SparkSession, path: str, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.when(F.col("length") <= MAX_BYTES, F.col("content")).alias("content"))  # the rest isn't read


def import_files(files: DataFrame) -> DataFrame:
    """(path, nth, name, format, source, error) of files (path, content); null contents exceed the import limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                importer = IMPORTERS.get(path.rpartition(".")[2].lower())
                try:
                    if content is None:
                        raise ValueError("the file exceeds the import limit")
                    if importer is None:
                        raise ValueError("no importer for this kind of file")
                    rows += [(path, k, path + name, kind, text, None) for k, (name, kind, text) in enumerate(importer(bytes(content)))]
                except (ValueError, KeyError, RecursionError, ElementTree.ParseError, zipfile.BadZipFile) as e:
                    rows.append((path, 0, path, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "nth", "name", "format", "source", "error"])

    return files.mapInPandas(run, ROWS)


def read_packages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All files of one kind (docx, fdx, tbx, ulyz) under a folder."""
    return import_files(_binary(spark, path, f"*.{kind}"))


# Destinations of rich text that hold no body text.
RTF_HIDDEN = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "listtable", "listoverridetable", "generator", "expandedcolortbl"}
_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|([^\\{}\r\n]+)|[\r\n]+")


def rich_text(content: bytes) -> str:
    """The plain text of an RTF file."""
    out, stack, hidden, skip = [], [], False, 0
    for word, number, code, mark, brace, text in (m.groups() for m in _RTF.finditer(content.decode("cp1252", "replace"))):
        if brace == "{":
            stack.append(hidden)
        elif brace == "}":
            hidden = stack.pop() if stack else False
        elif mark == "*" or word in RTF_HIDDEN:
            hidden = True
        elif hidden:
            continue
        elif word == "u":
            out.append(chr(int(number or 0) % 65536))
            skip = 1  # the stand-in for readers without Unicode
        elif word in ("par", "line") or mark in ("\n", "\r"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif word:
            named = {"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
            out.append(named.get(word, ""))
        elif code or mark or text:
            piece = bytes([int(code, 16)]).decode("cp1252", "replace") if code else {"~": "\u00a0", "_": "-", "-": ""}.get(mark, mark) if mark else text
            out.append(piece[skip:])
            skip = 0
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def binder(content: bytes) -> list[tuple[str, str]]:
    """(label, id) of the draft's items in order."""
    out: list[tuple[str, str]] = []

    def walk(node: ElementTree.Element, label: str, draft: bool, depth: int) -> None:
        if _tag(node) == "BinderItem":
            if depth >= MAX_DEPTH:
                raise ValueError("the binder is nested too deeply")
            folder = _attribute(node, "Type") == "DraftFolder"
            title = "".join(_own_text(c) for c in node if _tag(c) == "Title").strip() or "Untitled"
            label, draft, depth = label + "/" + re.sub(r"[/\\:]", " ", title), draft or folder, depth + 1
            key = _attribute(node, "UUID")
            if draft and not folder and key:
                if not re.fullmatch("[A-Za-z0-9-]{1,64}", key):
                    raise ValueError("invalid document id")
                out.append((label, key))
        for child in node:
            walk(child, label, draft, depth)

    walk(ElementTree.fromstring(content), "", False, 0)
    return out


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Draft texts of all .scriv projects under a folder, in binder order: (path, nth, name, format, source, error)."""

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                project = file.rpartition("/")[0]
                try:
                    found = binder(bytes(content or b""))
                    rows += [(project, k, project + label, key, None) for k, (label, key) in enumerate(found)]
                except (ValueError, RecursionError, ElementTree.ParseError) as e:
                    rows.append((project, 0, project, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "nth", "name", "key", "error"])

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [p.rsplit("/", 4) for p in batch["path"]]  # project, Files, Data, id, content.rtf
            plain = [None if c is None else rich_text(bytes(c)) for c in batch["content"]]
            yield pd.DataFrame({"path": [p[0] for p in parts], "key": [p[-2] for p in parts], "source": plain})

    listed = _binary(spark, path, "*.scrivx").mapInPandas(items, "path string, nth int, name string, key string, error string")
    written = _binary(spark, path, "content.rtf").mapInPandas(texts, "path string, key string, source string")
    out = listed.join(written, ["path", "key"], "left").filter(F.col("error").isNotNull() | F.coalesce(F.col("source"), F.lit("")).rlike(r"\S"))
    return out.select("path", "nth", "name", F.lit("plain").alias("format"), "source", "error")
