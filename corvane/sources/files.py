"""File readers and writers: extraction by format, export, bundles, backups.

Files are read with Spark's binaryFile source; extraction runs in batches of
rows. Unreadable files give a reason instead of failing the job.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: elements without readable content, and roots by preference
SKIPPED = frozenset("script style nav footer header aside form iframe svg noscript".split())
ROOTS = ("article", "main", "body")
BLOCKS = frozenset("p div section article main body h1 h2 h3 h4 h5 h6 ul ol li table tr blockquote pre br hr dl dt dd".split())
GENERATED = r"/(?:\.git|node_modules|target|dist|build|__pycache__|\.venv|venv|bin|obj)/"
TEXTUAL = frozenset("txt md markdown rst tex sql py rs go ts js sh toml yaml yml json csv svg".split())


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.parts: list[tuple[frozenset, str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.parts.append((frozenset(self.stack), "\n"))
        if tag not in ("br", "hr", "img", "meta", "link", "input"):
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
        if tag in BLOCKS:
            self.parts.append((frozenset(self.stack), "\n"))

    def handle_data(self, data):
        self.parts.append((frozenset(self.stack), data))


def html_to_text(page: str) -> str:
    """Readable lines of a page: its article, else main, else body, else all; without navigation and scripts."""
    p = _Page()
    p.feed(page)
    p.close()
    inside = [(s, d) for s, d in p.parts if not s & SKIPPED]
    for root in ROOTS:
        if any(root in s for s, _ in inside):
            inside = [(s, d) for s, d in inside if root in s]
            break
    lines = ("".join(d for _, d in inside)).split("\n")
    return "\n".join(x for x in (" ".join(y.split()) for y in lines) if x)


def decode_text(raw: bytes) -> tuple[str, str, str]:
    """(text, encoding, what says so): by byte order mark, else UTF-8, else Windows-1251 if at least four letters and one in twenty are Cyrillic there, else Windows-1252.

    Nothing is ever replaced: bytes that the encoding doesn't know, UTF-32, and what looks binary raise ValueError.
    """
    basis = "mark"
    if raw.startswith((b"\xff\xfe\0\0", b"\0\0\xfe\xff")):
        raise ValueError("UTF-32 is not supported")
    if raw.startswith(b"\xef\xbb\xbf"):
        text, name = raw[3:].decode("utf-8"), "utf-8-sig"
    elif raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        name = "utf-16le" if raw[0] == 0xFF else "utf-16be"
        text = raw[2:].decode(name)
    else:
        try:
            text, name, basis = raw.decode("utf-8"), "utf-8", "strict"
        except UnicodeDecodeError:
            cyrillic = sum(b >= 0xC0 or b in (0xA8, 0xB8) for b in raw)
            latin = sum(65 <= b <= 90 or 97 <= b <= 122 for b in raw)
            name = "cp1251" if cyrillic >= 4 and 20 * cyrillic >= cyrillic + latin else "cp1252"
            text, basis = raw.decode(name), "evidence"
    odd = basis == "evidence" and any(unicodedata.category(c) == "Cc" and c not in "\n\r\t\f" for c in text)
    if odd or "\0" in text:
        raise ValueError("looks binary")
    return text, name, basis


#: fixed values: languages by file ending, and names that need none
LANGUAGES = {
    "rust": "rs", "python": "py", "javascript": "js mjs cjs jsx", "typescript": "ts tsx", "java": "java", "c": "c h", "cpp": "cc cpp cxx hpp hh hxx", "csharp": "cs", "go": "go", "ruby": "rb",
    "php": "php phtml", "swift": "swift", "kotlin": "kt kts", "scala": "scala", "perl": "pl pm t", "powershell": "ps1 psm1 psd1", "shell": "sh bash zsh", "sql": "sql", "lua": "lua", "elixir": "ex exs",
    "erlang": "erl hrl", "r": "r", "vue": "vue", "svelte": "svelte", "toml": "toml", "yaml": "yaml yml", "dockerfile": "dockerfile", "json": "json", "xml": "xml svg", "css": "css scss sass less",
}
DOCUMENTS = "md markdown txt html htm pdf docx xlsx"
NAMED = r"^(?:go\.mod|(?:Dockerfile|Containerfile)(?:\..*)?)$"


def is_supported(path: Column) -> Column:
    """Whether a file's name or ending is one of a known kind."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    ending = F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))
    return name.rlike(NAMED) | ending.isin(*DOCUMENTS.split(), *(e for v in LANGUAGES.values() for e in v.split()))


def page_kind(content_type: Column, url: Column) -> Column:
    """html, markdown or text, by the content type without its parameters, else by the address; null for anything else that is named."""
    kind = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    path = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""))
    by_url = F.when(path.rlike(r"\.(?:md|markdown)$"), "markdown").when(path.rlike(r"\.txt$"), "text").otherwise("html")
    return F.when(kind.isin("text/html", "application/xhtml+xml"), "html").when(kind.isin("text/markdown", "text/x-markdown"), "markdown").when(
        kind == "text/plain", F.when(by_url == "markdown", "markdown").otherwise("text")).when(kind == "", by_url)


def preflight(documents: DataFrame, text: str, most_rows: int, most_bytes: int) -> DataFrame:
    """(docs, bytes, largest, fits): what an export would hold, and whether that is within the limits."""
    n = documents.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"), F.max(F.octet_length(text)).alias("largest"))
    return n.withColumn("fits", (F.col("docs") <= most_rows) & (F.col("bytes") <= most_bytes))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_to_text(raw: bytes) -> tuple[str, int]:
    """(text, number of tables); headings get number signs, table rows bars."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    words = lambda e: "".join(x.text or "" for x in e.iter(f"{_W}t"))
    out, tables = [], 0
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            m = re.fullmatch(r"Heading\s*([1-6])", style.get(f"{_W}val", "") if style is not None else "")
            t = words(e)
            if t.strip():
                out.append("#" * int(m.group(1)) + " " + t if m else t)
        elif e.tag == f"{_W}tbl":
            tables += 1
            out += ["| " + " | ".join(words(c) for c in r.iter(f"{_W}tc")) + " |" for r in e.iter(f"{_W}tr")]
    return "\n\n".join(out), tables


def xlsx_rows(raw: bytes) -> list[tuple[str, int, str]]:
    """(sheet, row, text) in sheet order; cells are joined by tabs."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        target = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            path = "xl/" + target[sheet.get(f"{_R}id")].lstrip("/").removeprefix("xl/")
            for row in ET.fromstring(z.read(path)).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    v = c.find(f"{_S}v")
                    if c.get("t") == "s" and v is not None:
                        cells.append(shared[int(v.text)])
                    else:
                        cells.append((v.text or "") if v is not None else "".join(t.text or "" for t in c.iter(f"{_S}t")))
                out.append((sheet.get("name"), int(row.get("r")), "\t".join(cells)))
    return out


def extract(path: str, raw: bytes) -> tuple[str | None, str, str | None]:
    """(text, format, reason): the text of a file by its extension, or why there is none."""
    ext = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    try:
        if ext in ("html", "htm"):
            return html_to_text(decode_text(raw)[0]), "html", None
        if ext == "docx":
            return docx_to_text(raw)[0], "docx", None
        if ext == "xlsx":
            return "\n".join(t for _, _, t in xlsx_rows(raw)), "xlsx", None
        if ext in TEXTUAL:
            return decode_text(raw)[0], "text", None
        return None, ext, "unsupported format"
    except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, IndexError) as e:
        return None, ext, f"{type(e).__name__}: {e}"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified, text, format, reason) of the files below a root, without generated trees."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [extract(p, bytes(c)) for p, c in zip(f["path"], f["content"])]
            yield pd.DataFrame({
                "path": f["path"], "size": f["length"], "modified": f["modificationTime"],
                "text": [g[0] for g in got], "format": [g[1] for g in got], "reason": [g[2] for g in got],
            })

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(~F.col("path").rlike(GENERATED))
    return files.mapInPandas(run, "path string, size bigint, modified timestamp, text string, format string, reason string")


def merge_metadata(base: Column, extra: Column) -> Column:
    """Two JSON objects as one; the second's values win. Texts that are no object count as empty."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(as_map(base), lambda k, _: ~F.map_contains_key(as_map(extra), k))
    return F.to_json(F.map_concat(kept, as_map(extra)))


def export_vault(docs: DataFrame, path: str) -> None:
    """One JSON line per document with front matter and body, in a folder per wing."""
    head = F.concat(F.lit("---\ntitle: "), F.coalesce("title", F.lit("")), F.lit("\nkind: "), F.coalesce("kind", F.lit("")), F.lit("\n---\n\n"))
    docs.select(
        F.coalesce(F.nullif(F.trim("wing"), F.lit("")), F.lit("unscoped")).alias("wing"), "doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("value")
    ).write.mode("errorifexists").partitionBy("wing").json(path)


def write_bundle(df: DataFrame, path: str) -> None:
    """A portable copy: JSON lines beside the schema and the row count to check it by."""
    df.write.mode("errorifexists").json(f"{path}/rows", ignoreNullFields=False)
    df.sparkSession.createDataFrame([(df.schema.json(), df.count())], "schema string, n bigint").coalesce(1).write.json(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Reads a bundle strictly: unknown or malformed fields and a wrong count are refused."""
    import json as _json

    from pyspark.sql.types import StructType

    m = spark.read.json(f"{path}/manifest").first()
    schema = StructType.fromJson(_json.loads(m["schema"]))
    extra = set(spark.read.json(f"{path}/rows").columns) - set(schema.names)
    if extra:
        raise ValueError(f"unknown fields: {sorted(extra)}")
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/rows")
    if df.count() != m["n"]:
        raise ValueError("the bundle is not whole")
    return df


def backup(df: DataFrame, path: str) -> dict:
    """Writes a copy and verifies it by count and content."""
    df.write.mode("errorifexists").parquet(path)
    mark = lambda x: x.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*x.columns).cast("decimal(38,0)")).alias("h")).first()
    a, b = mark(df), mark(df.sparkSession.read.parquet(path))
    if a != b:
        raise OSError("the copy differs from the table")
    return {"rows": a["n"]}


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes a graph's topology as JSON lines: ``nodes`` and ``edges`` below ``path``; what was there is replaced."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def read_graph(spark: SparkSession, path: str, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an exported graph, under their schemas."""
    return spark.read.schema(nodes).json(f"{path}/nodes"), spark.read.schema(edges).json(f"{path}/edges")
