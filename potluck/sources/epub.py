"""EPUB archives as DataFrames: documents, tables of contents and items (SRC1 to SRC7, JOI7)."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dom import Node, parse

UNKNOWN = "Unknown"
DOCUMENTS = "path string, book string, author string, item_name string, item_ordinal int, chapter string, content binary, error string"
ENTRIES = "path string, book string, ordinal int, title string, href string, category string, level int, is_leaf boolean"
ITEMS = "path string, book string, author string, ordinal int, item_name string, kind string, error string"


class BadEpub(ValueError):
    """The bytes are no readable EPUB."""


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


class Epub:
    """One archive: title, author, items (name, kind, content reader) in manifest order and the TOC as (title, href, children)."""

    def __init__(self, data: bytes, stem: str):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            root = ET.fromstring(self.zip.read("META-INF/container.xml"))
            opf = next(e.attrib["full-path"] for e in root.iter() if _local(e.tag) == "rootfile")
            package = ET.fromstring(self.zip.read(opf))
        except (zipfile.BadZipFile, KeyError, ET.ParseError, StopIteration, OSError) as e:
            raise BadEpub(f"{type(e).__name__}: {e}") from e
        self.base = posixpath.dirname(opf)
        first = lambda name: next((e.text.strip() for e in package.iter() if _local(e.tag) == name and e.text and e.text.strip()), None)
        self.title, self.author = first("title") or stem, first("creator") or UNKNOWN
        self.items: list[tuple[str, str]] = []
        by_id: dict[str, str] = {}
        nav = None
        for e in (e for e in package.iter() if _local(e.tag) == "item"):
            name, media = unquote(e.attrib.get("href", "")), e.attrib.get("media-type", "")
            by_id[e.attrib.get("id", "")] = name
            if "nav" in e.attrib.get("properties", "").split():
                nav, kind = name, "navigation"
            elif media in ("application/xhtml+xml", "text/html"):
                kind = "document"
            elif media.startswith("image/"):
                kind = "image"
            elif media == "application/x-dtbncx+xml":
                kind = "ncx"
            else:
                kind = "other"
            self.items.append((name, kind))
        spine = next((e for e in package.iter() if _local(e.tag) == "spine"), None)
        ncx = by_id.get(spine.attrib.get("toc", "")) if spine is not None else None
        ncx = ncx or next((n for n, k in self.items if k == "ncx"), None)
        self.toc = (self._from_ncx(ncx) if ncx else []) or (self._from_nav(nav) if nav else [])

    def read(self, name: str) -> bytes:
        return self.zip.read(posixpath.normpath(posixpath.join(self.base, name)))

    def _from_ncx(self, name: str) -> list:
        def point(e: ET.Element) -> tuple:
            label = next((t.text or "" for x in e if _local(x.tag) == "navLabel" for t in x.iter() if _local(t.tag) == "text"), "")
            href = next((unquote(x.attrib.get("src", "")) for x in e if _local(x.tag) == "content"), None)
            return label.strip(), href, [point(x) for x in e if _local(x.tag) == "navPoint"]

        try:
            tree = ET.fromstring(self.read(name))
        except (KeyError, ET.ParseError):
            return []
        top = next((e for e in tree if _local(e.tag) == "navMap"), None)
        return [point(e) for e in top if _local(e.tag) == "navPoint"] if top is not None else []

    def _from_nav(self, name: str) -> list:
        def entries(ol: Node) -> list:
            out = []
            for li in (c for c in ol.elements() if c.tag == "li"):
                label = next((c for c in li.elements() if c.tag in ("a", "span")), None)
                below = next((c for c in li.elements() if c.tag == "ol"), None)
                if label is not None:
                    out.append((label.glued(" "), unquote(label.attrs["href"]) if "href" in label.attrs else None, entries(below) if below is not None else []))
            return out

        try:
            tree = parse(self.read(name))
        except KeyError:
            return []
        navs = tree.find("nav")
        nav = next((n for n in navs if n.attrs.get("epub:type") == "toc"), navs[0] if navs else None)
        top = next(iter(nav.find("ol")), None) if nav is not None else None
        return entries(top) if top is not None else []

    def chapters(self) -> dict[str, str]:
        """href -> title of the top level only; the last one wins; a fragment stays part of the href."""
        return {href: title for title, href, _ in self.toc if href is not None}


def _stem(path: str) -> str:
    return unquote(posixpath.splitext(posixpath.basename(path))[0])


def _open(path: str, data: bytes) -> Epub:
    return Epub(data, _stem(path))


def _read_documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in DOCUMENTS.split(", ")]
    for frame in frames:
        for path, data in zip(frame["path"], frame["content"]):
            try:
                book = _open(path, bytes(data))
                chapters = book.chapters()
                rows = []
                for i, name in enumerate(n for n, kind in book.items if kind == "document"):
                    rows.append((path, book.title, book.author, name, i, chapters.get(name, UNKNOWN), book.read(name), None))
            except (BadEpub, KeyError, zipfile.BadZipFile) as e:
                rows = [(path, _stem(path), None, None, None, None, None, str(e))]
            yield pd.DataFrame(rows, columns=columns)


def _flat(entries: list, level: int = 0, category: str | None = None) -> Iterator[tuple[str, str | None, str | None, int, bool]]:
    for title, href, children in entries:
        yield title, href, category, level, not children
        yield from _flat(children, level + 1, title)


def _read_toc(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in ENTRIES.split(", ")]
    for frame in frames:
        for path, data in zip(frame["path"], frame["content"]):
            try:
                book = _open(path, bytes(data))
            except BadEpub:
                continue
            rows = [(path, book.title, i, *entry) for i, entry in enumerate(_flat(book.toc))]
            yield pd.DataFrame(rows, columns=columns)


def _read_items(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in ITEMS.split(", ")]
    for frame in frames:
        for path, data in zip(frame["path"], frame["content"]):
            try:
                book = _open(path, bytes(data))
                rows = [(path, book.title, book.author, i, name, kind, None) for i, (name, kind) in enumerate(book.items)]
            except BadEpub as e:
                rows = [(path, _stem(path), None, None, None, None, str(e))]
            yield pd.DataFrame(rows, columns=columns)


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def scan_files(spark: SparkSession, path: str, pattern: str = "*.epub") -> DataFrame:
    """The files of a folder (not of folders in it), or one file. A missing path raises FileNotFoundError, one that may not be read PermissionError."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        raise FileNotFoundError(path)
    try:
        system.access(where, jvm.org.apache.hadoop.fs.permission.FsAction.READ)
    except Py4JJavaError as e:
        if "AccessControlException" in str(e.java_exception):
            raise PermissionError(path) from e
        raise
    reader = spark.read.format("binaryFile")
    if is_folder(spark, path):
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "content")


def read_documents(files: DataFrame) -> DataFrame:
    """One row per document of each archive; an unreadable archive is one row with its error."""
    return files.mapInPandas(_read_documents, DOCUMENTS)


def read_toc(files: DataFrame) -> DataFrame:
    """All entries in pre-order; sections that have children are no leaves. Unreadable archives give none."""
    return files.mapInPandas(_read_toc, ENTRIES)


def read_items(files: DataFrame) -> DataFrame:
    return files.mapInPandas(_read_items, ITEMS)


def chapter_join(documents: DataFrame, toc: DataFrame) -> DataFrame:
    """JOI7 over tables: documents(book, item_name) with the title of the last top-level entry whose href is the name."""
    top = toc.where("level = 0 and href is not null").groupBy("book", "href").agg(F.max_by("title", "ordinal").alias("__title"))
    return (
        documents.drop("chapter")
        .join(top.withColumnRenamed("href", "item_name"), ["book", "item_name"], "left")
        .withColumn("chapter", F.coalesce("__title", F.lit(UNKNOWN)))
        .drop("__title")
    )
