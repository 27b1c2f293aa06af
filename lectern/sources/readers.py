"""Readers: files of several formats, JSON lines with bad rows, logs, gold sets.

Listing and parsing are Spark's (``binaryFile``, ``text``, ``json``); formats that
Spark does not know are turned into text in Arrow batches with the standard
library. Paged files take a function bytes -> text: ``paged.page_text``, or ``paged.first_readable`` of several.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.functions.text import front_matter, safe_stem, strip
from lectern.operators.registry import migrate
from lectern.sources.paged import page_properties

EXTENSIONS = ("pdf", "docx", "epub", "html", "htm", "rtf", "txt", "md")
ENCODINGS = ("utf-8-sig", "cp949", "euc-kr")


def scan_directory(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, recursive: bool = False, content: bool = False) -> DataFrame:
    """``name, path, size, mtime, ext`` (and ``content``) of the files with one of the extensions, in order of their lower-cased names; contents come unsorted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(name.alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), *(["content"] if content else []))
    found = rows.where(F.col("ext").isin(*extensions))
    return found if content else found.orderBy(F.lower("name"))  # contents are not shuffled for an order


def unprocessed(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files whose name is not in ``processed`` (name)."""
    return files.join(processed.select("name"), "name", "left_anti")


def decode(raw: bytes | None) -> str | None:
    """Text in the first encoding that fits; the last resort drops bytes that fit none."""
    if raw is None:
        return None
    for encoding in ENCODINGS:
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "ignore")


class _Visible(HTMLParser):
    HIDDEN = {"script", "style", "noscript", "head"}

    def __init__(self):
        super().__init__()
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN

    def handle_endtag(self, tag):
        self.depth -= tag in self.HIDDEN and self.depth > 0

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def html_text(raw: bytes) -> str:
    parser = _Visible()
    parser.feed(decode(raw) or "")
    parser.close()
    return "\n".join(parser.parts)


def docx_text(raw: bytes) -> str:
    """Paragraphs, then the rows of tables with tabs between cells."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{w}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t"))
    rows = ["\t".join(said(cell).strip() for cell in row.iter(f"{w}tc")) for table in body.iter(f"{w}tbl") for row in table.iter(f"{w}tr")]
    return "\n".join(x for x in [*map(said, body.findall(f"{w}p")), *rows] if x.strip())


def epub_text(raw: bytes) -> str:
    """The visible text of each page, in the order of the package's spine; pages that it does not name follow by name."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    names = book.namelist()
    pages = sorted(n for n in names if n.lower().endswith((".xhtml", ".html", ".htm")))
    package = next((n for n in sorted(names) if n.lower().endswith(".opf")), None)
    if package is not None:
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        every = list(ElementTree.fromstring(book.read(package)).iter())
        folder = posixpath.dirname(package)
        place = {e.get("id"): posixpath.normpath(posixpath.join(folder, unquote(e.get("href") or ""))) for e in every if local(e) == "item"}
        spine = [place[e.get("idref")] for e in every if local(e) == "itemref" and place.get(e.get("idref")) in pages]
        pages = list(dict.fromkeys(spine)) + [p for p in pages if p not in spine]
    return "\n\n".join(t for t in (html_text(book.read(n)) for n in pages) if t)


def docx_properties(raw: bytes) -> tuple[str | None, str | None]:
    """(title, author) that a text file in the zipped format declares."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    if "docProps/core.xml" not in book.namelist():
        return None, None
    found = {e.tag.rsplit("}", 1)[-1]: (e.text or "").strip() or None for e in ElementTree.fromstring(book.read("docProps/core.xml")).iter()}
    return found.get("title"), found.get("creator")


def embedded_metadata(files: DataFrame) -> DataFrame:
    """``files`` (ext, content) with the ``title`` and ``author`` that they declare in place of the content; broken files have none."""
    properties = {"docx": docx_properties, "pdf": page_properties}

    @F.pandas_udf("title string, author string")
    def parse(ext: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = []
        for kind, raw in zip(ext, content):
            try:
                parser = properties.get(kind)
                out.append(parser(bytes(raw)) if parser and raw is not None else (None, None))
            except Exception:  # a broken file declares nothing
                out.append((None, None))
        return pd.DataFrame(out, columns=["title", "author"])

    return files.withColumn("__p", parse("ext", "content")).select(*[c for c in files.columns if c != "content"], "__p.title", "__p.author")


def rtf_text(raw: bytes) -> str:
    """Plain text of a rich-text file: groups of settings go, escapes become characters."""
    text = raw.decode("latin-1")
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)(?:[^{}]|\{[^{}]*\})*\}", "", text)
    text = re.sub(r"\\par[d]?\b ?", "\n", text)
    text = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "ignore"), text)
    return re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", text).strip()


def extract_text(files: DataFrame, paged: Callable[[bytes], str] | None = None) -> DataFrame:
    """``files`` (ext, content) with ``text`` and ``problem`` in place of the content; a file that fails keeps its row."""
    parsers = {"txt": decode, "md": decode, "html": html_text, "htm": html_text, "docx": docx_text, "epub": epub_text, "rtf": rtf_text, "pdf": paged}

    @F.pandas_udf("text string, problem string")
    def parse(ext: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = []
        for kind, raw in zip(ext, content):
            parser = parsers.get(kind)
            if parser is None:
                out.append((None, f"no parser for {kind}"))
                continue
            try:
                text = parser(raw) if raw is not None else None
                out.append((text.strip() if text else text, None if text and text.strip() else "empty"))
            except Exception as why:  # a broken file is data, not a failure of the job
                out.append((None, f"{type(why).__name__}: {why}"[:500]))
        return pd.DataFrame(out, columns=["text", "problem"])

    return files.withColumn("__p", parse("ext", "content")).select(*[c for c in files.columns if c != "content"], "__p.text", "__p.problem")


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines, lines that begin with a dollar sign and broken lines are skipped."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("$"))
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = StructType([*fields.fields]).add("__bad", "string")
    parsed = lines.select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    return parsed.where(F.col("r").isNotNull() & F.col("r.__bad").isNull()).select(*[F.col(f"r.`{f.name}`") for f in fields])


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """``queries[]`` of a JSON object, one row each."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("queries").alias("q")).select("q.*")


def read_chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, chunk_index, chunk`` of text files whose chunks begin with a "[chunk N]" line."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parts = F.filter(F.transform(F.split("value", r"(?m)^\[chunk \d+\][ \t]*\n?"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    return whole.select("path", F.posexplode(parts).alias("chunk_index", "chunk"))


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, "event string, status string, delta int, note string, run_id string, ts timestamp")


def newest(spark: SparkSession, path: str, pattern: str = "*.json") -> str | None:
    """The latest file of a folder."""
    row = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).agg(F.max_by("path", "modificationTime").alias("p")).first()
    return row.p if row else None


def read_object(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One row per JSON file that holds one object (chunk meta data, batch states, manifests)."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


#: Fields of a document in a registry of one object, older ones included.
REGISTERED = "document_id string, file_hash string, source_file string, title string, author string, book string, language string, chunk_count int, pipeline_state string, ingest_status string, retry_count int, max_retries int, last_content_hash string, supersedes string, superseded_by string"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of registries ``{"documents": {id: {...}}}``, in today's columns, with ``ord`` as they stand in the file.

    A document without an id of its own takes its key. A file that is no such object gives no row.
    """
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"documents map<string, struct<{', '.join(':'.join(c.split()) for c in REGISTERED.split(', '))}>>").alias("r"))
    rows = parsed.select(F.posexplode("r.documents").alias("ord", "key", "d")).where(F.col("d").isNotNull())
    names = [c.split()[0] for c in REGISTERED.split(", ")]
    return migrate(rows.select(F.coalesce("d.document_id", "key").alias("document_id"), *[F.col(f"d.{c}") for c in names[1:]], F.col("ord").cast("long").alias("ord")))


def _member(spark: SparkSession, path: str, name: str, fields: str) -> DataFrame:
    """The list ``name`` of each file's object, one row each in its order; a damaged file gives none."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"{name} array<struct<{fields}>>").alias("r"))
    return parsed.select(F.posexplode(f"r.{name}").alias("ord", "x")).where(F.col("x").isNotNull()).select("ord", "x.*")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """``session_id, created_at, at, query, timestamp, result_refs``: a row for each question of each session, one of nulls for a session without any."""
    rows = _member(spark, path, "sessions", "session_id:string,created_at:string,queries:array<struct<query:string,timestamp:string,result_refs:array<struct<tsu_id:string,document_id:string,citation_id:string>>>>")
    return rows.select("session_id", "created_at", F.posexplode_outer("queries").alias("at", "q")).select("session_id", "created_at", "at", "q.*")


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failures that a log lists: source_file, stage, reason, retry_count, error_type, timestamp; ``ord`` is their order."""
    return _member(spark, path, "failures", "source_file:string,stage:string,reason:string,retry_count:int,error_type:string,timestamp:string")


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """``content`` of the passages in JSON lines; lines without any are skipped."""
    return read_json_lines(spark, path, "content string").where("content IS NOT NULL AND content <> ''")


def read_newest(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """The object in the latest file of a folder (a saved summary), no row where there is none."""
    latest = newest(spark, path, pattern)
    return read_object(spark, latest, schema) if latest else spark.createDataFrame([], schema)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """``name`` of every file that a batch state (``{"processed": [...]}``) lists, each once."""
    return read_object(spark, path, "processed array<string>").select(F.explode("processed").alias("name")).distinct()


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """``path, front, body`` of saved documents: the keys of their header, and the text without it."""
    whole = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", front_matter("value").alias("front"), strip(F.regexp_replace("value", r"(?s)^---\n.*?\n---\n?", "")).alias("body"))


def resolve_sources(saved: DataFrame, raw: DataFrame) -> DataFrame:
    """Saved documents (name) with the file they were made from: the raw file (name, path) with the same safe stem."""
    return saved.withColumn("stem", safe_stem(F.col("name"))).join(raw.select(safe_stem(F.col("name")).alias("stem"), F.col("path").alias("raw_path")), "stem", "left")


def discover(spark: SparkSession, path: str, most: int = 10) -> DataFrame:
    """The first ``most`` text files by name (a limit that is the feature's own)."""
    return scan_directory(spark, path, ("txt", "md")).orderBy("name").limit(most)
