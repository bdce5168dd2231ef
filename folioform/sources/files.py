"""Files: text of any charset, office documents, mappings; and what is written back."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_WORD_PARTS = re.compile(r"word/(?:document|footnotes|endnotes|comments|(?:header|footer)[^/]*)\.xml")
_SLIDE_PARTS = re.compile(r"ppt/(?:slides/slide|notesSlides/notesSlide)\d+\.xml")
#: The part of a Word file that holds its text.
BODY = "word/document.xml"
RUNS = "path string, part string, para int, run int, text string"


def decode(data: bytes) -> str:
    """UTF-8 (a byte order mark stays), else Windows-1252, else Latin-1, which takes all bytes."""
    for name in ("utf-8", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


#: Characters that Windows-1252 has where Latin-1 has controls, and the bytes that it leaves out.
_C1 = {b: bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
_LATIN, _WINDOWS = "".join(chr(b) for b, c in _C1.items() if c), "".join(_C1.values())
_UNKNOWN = "[" + "".join(f"\\x{{{b:x}}}" for b, c in _C1.items() if not c) + "]"


def decoded(c: Column) -> Column:
    """As decode(), of binary columns, inside the JVM."""
    latin = lambda x: F.when(x.rlike(_UNKNOWN), x).otherwise(F.translate(x, _LATIN, _WINDOWS))
    return F.coalesce(F.try_validate_utf8(c.cast("string")), T.let(F.decode(c, "ISO-8859-1"), latin))


def read_files(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, content) of the files with these suffixes, in any case, straight from the store."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").where(T.suffix(F.col("path")).isin(*suffixes))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text)."""
    return read_files(spark, path, (".txt",)).select("path", decoded(F.col("content")).alias("text"))


def runs_of(data: bytes) -> list[tuple[str, int, int, str]]:
    """(part, paragraph, run, text) of the non-blank runs of a Word or PowerPoint file, paragraphs without any left out.

    A run is counted once, in its innermost paragraph.
    """
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for part in sorted(z.namelist()):
            ns = _WORD if _WORD_PARTS.fullmatch(part) else _DRAW if _SLIDE_PARTS.fullmatch(part) else None
            if ns is None:
                continue
            root = ElementTree.fromstring(z.read(part))
            own = {run: p for p in root.iter(f"{ns}p") for run in p.iter(f"{ns}t")}  # the innermost comes last
            for i, p in enumerate(root.iter(f"{ns}p")):
                for k, run in enumerate(r for r in p.iter(f"{ns}t") if own[r] is p):
                    if (run.text or "").strip():
                        out.append((part, i, k, run.text))
    return out


def office_runs(files: DataFrame) -> DataFrame:
    """(path, part, para, run, text) from files (path, content); files that are no archives give no rows."""

    def scan(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, *r) for r in runs_of(bytes(data))]
                except (zipfile.BadZipFile, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "part", "para", "run", "text"])

    return files.select("path", "content").mapInPandas(scan, RUNS)


def paragraphs(runs: DataFrame, keys: tuple[str, ...] = ("path", "part", "para")) -> DataFrame:
    """(keys, text, first_run) of non-blank runs, joined in order."""
    some = runs.where(T.strip(F.col("text")) != "")
    ordered = F.array_sort(F.collect_list(F.struct("run", "text")))
    return some.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "").alias("text"), F.min("run").alias("first_run"))


def written_runs(runs: DataFrame, translated: DataFrame, keys: tuple[str, ...] = ("path", "part", "para")) -> DataFrame:
    """Adds new_text: a paragraph's translation (keys, translation) goes into its first non-blank run, its other ones are emptied."""
    firsts = paragraphs(runs, keys).select(*keys, "first_run")
    full = F.col("translation").isNotNull() & (T.strip(F.col("text")) != "")
    new = F.when(full & (F.col("run") == F.col("first_run")), F.col("translation")).when(full, "").otherwise(F.col("text"))
    return runs.join(firsts, list(keys), "left").join(translated.select(*keys, "translation"), list(keys), "left").withColumn("new_text", new).drop("first_run", "translation")


def rewrite_office(data: bytes, new: dict[tuple[str, int, int], str]) -> bytes:
    """The file with the texts of runs (part, paragraph, run) replaced; other members are copied byte for byte."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
        for info in z.infolist():
            body = z.read(info)
            ns = _WORD if _WORD_PARTS.fullmatch(info.filename) else _DRAW if _SLIDE_PARTS.fullmatch(info.filename) else None
            if ns is not None and any(k[0] == info.filename for k in new):
                root = ElementTree.fromstring(body)
                own = {run: p for p in root.iter(f"{ns}p") for run in p.iter(f"{ns}t")}
                for i, p in enumerate(root.iter(f"{ns}p")):
                    for k, run in enumerate(r for r in p.iter(f"{ns}t") if own[r] is p):
                        if (info.filename, i, k) in new:
                            run.text = new[info.filename, i, k]
                body = ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)
            made.writestr(info, body)
    return out.getvalue()


def rewritten(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(path, content) of office files with the new_text of their runs; a file's runs and content meet in one group of that file."""

    def write(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        new = {(r.part, r.para, r.run): r.new_text for r in b.itertuples() if r.new_text != r.text}
        made = []
        for path, content in zip(a["path"], a["content"]):
            try:
                made.append((path, rewrite_office(bytes(content), new)))
            except (zipfile.BadZipFile, ElementTree.ParseError):
                continue  # no archive, no output
        return pd.DataFrame(made, columns=["path", "content"])

    return files.select("path", "content").groupBy("path").cogroup(runs.select("path", "part", "para", "run", "text", "new_text").groupBy("path")).applyInPandas(write, "path string, content binary")


def document_of(paragraphs_: list[list[str]]) -> bytes:
    """A Word file of these paragraphs, each a list of runs."""
    root = ElementTree.Element(f"{_WORD}document")
    body = ElementTree.SubElement(root, f"{_WORD}body")
    for texts in paragraphs_:
        p = ElementTree.SubElement(body, f"{_WORD}p")
        for text in texts:
            run = ElementTree.SubElement(ElementTree.SubElement(p, f"{_WORD}r"), f"{_WORD}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
            run.text = text
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    kinds = f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/{BODY}" ContentType="{main}"/></Types>'
    links = f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="{BODY}"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
        made.writestr("[Content_Types].xml", kinds)
        made.writestr("_rels/.rels", links)
        made.writestr(BODY, ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True))
    return out.getvalue()


def new_documents(runs: DataFrame) -> DataFrame:
    """(path, content): a new Word file for each path of runs (path, para, run, text), which meet in one task of that file."""
    ordered = runs.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("para", "run", "text"))).alias("runs"))

    def write(batches):
        for pdf in batches:
            made = []
            for runs_ in pdf["runs"]:
                paras: dict[int, list[str]] = {}
                for r in runs_:
                    paras.setdefault(r["para"], []).append(r["text"] or "")
                made.append(document_of(list(paras.values())))
            yield pd.DataFrame({"path": pdf["path"], "content": made})

    return ordered.mapInPandas(write, "path string, content binary")


def mapping(c: DataFrame, column: str = "json", keep: Sequence[str] = ()) -> DataFrame:
    """(columns to keep, key, value) of JSON objects, both as strings; anything but an object is an error."""
    parsed = F.from_json(column, "map<string,string>", {"mode": "FAILFAST"})
    return c.select(*keep, F.explode(parsed).alias("key", "value"))
