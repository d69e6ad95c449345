"""Readers of formats that no built-in function opens: encoded text, archives, office documents, SQLite.

Each is a table function over Arrow batches: a row of a file with its ``content``
becomes rows of what is in it. Limits are part of the formats' handling: they
bound what one hostile file may unpack to.
"""

from __future__ import annotations

import io
import os
import sqlite3
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions import text as X

WINDOW = 4096
TEXTS = (".txt", ".md", ".log", ".ini", ".env", ".conf", ".config", ".cnf", ".properties", ".xml", ".json", ".yml", ".yaml", ".toml", ".csv", ".tsv", ".sql", ".ps1", ".psm1", ".bat", ".cmd", ".sh", ".py", ".rb", ".inf", ".cfg", ".ora", ".udl", ".dsn", ".tf", ".tfvars", ".pem", ".key")
OFFICE = (".docx", ".xlsx", ".pptx")


@dataclass(frozen=True)
class ArchiveLimits:
    """Greatest archive, members, and bytes of a member and of all, unpacked."""

    archive: int = 10 << 20
    members: int = 64
    member: int = 512 << 10
    total: int = 4 << 20


@dataclass(frozen=True)
class DatabaseLimits:
    """Greatest database; tables, rows and columns looked at; bytes of a cell and of all."""

    size: int = 5 << 20
    tables: int = 8
    rows: int = 5
    columns: int = 4
    cell: int = 256
    total: int = 16 << 10


def _printable(s: str) -> float:
    good = sum(c.isprintable() or c in "\r\n\t" for c in s)
    return good / len(s) if s else 1.0


def decode(raw: bytes | None) -> str | None:
    """Text of bytes: UTF-8, UTF-16 by mark or by its zero bytes, else Windows-1252 where that is printable.

    Line ends become line feeds. Null, no bytes, and bytes that are no text, give null.
    """
    if not raw:
        return None
    candidates: list[tuple[str, int]] = []
    if raw[:3] == b"\xef\xbb\xbf":
        candidates.append(("utf-8", 3))
    elif raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        candidates.append(("utf-16-le" if raw[:1] == b"\xff" else "utf-16-be", 2))
    else:
        head = raw[: WINDOW & ~1]
        zeros = [head[k::2].count(0) for k in (0, 1)]
        if len(head) >= 4 and zeros[1] * 5 >= len(head) and zeros[0] * 20 < len(head):
            candidates.append(("utf-16-le", 0))
        elif len(head) >= 4 and zeros[0] * 5 >= len(head) and zeros[1] * 20 < len(head):
            candidates.append(("utf-16-be", 0))
        else:
            candidates += [("utf-8", 0), ("cp1252", 0), ("latin-1", 0)]
    for name, skip in candidates:
        try:
            text = raw[skip:].decode(name)
        except UnicodeDecodeError:
            continue
        if "\0" not in text[:WINDOW] and _printable(text[:WINDOW]) >= 0.9:
            return text.replace("\r\n", "\n").replace("\r", "\n")
    return None


def looks_like_text(raw: bytes) -> bool:
    """Whether the first bytes decode as text."""
    return decode(raw[:WINDOW]) is not None or decode(raw[: WINDOW - 3]) is not None


def office_text(raw: bytes) -> str:
    """Character data of an XML part, a line for each run; empty where it isn't well formed or declares entities."""
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        return ""
    try:
        return "\n".join(t for t in (x.strip() for x in ElementTree.fromstring(raw).itertext()) if t)
    except ElementTree.ParseError:
        return ""


def _member(path: str, raw: bytes, office: bool) -> tuple[str, int, str] | None:
    text = office_text(raw) if office else decode(raw)
    return (path, len(raw), text) if text else None


def _safe(path: str) -> bool:
    return bool(path) and not path.startswith("/") and ":" not in path and ".." not in path.split("/")


def members(name: str, raw: bytes | None, limits: ArchiveLimits = ArchiveLimits()) -> list[tuple[str, int, str]]:
    """Path, size and text of an archive's members that are texts and within the limits.

    Directories, encrypted members, paths that leave the archive, nested
    archives and binaries are passed over; a broken archive has no members.
    """
    low = name.lower()
    if not raw or len(raw) > limits.archive:
        return []
    out, total = [], 0
    office = low.endswith(OFFICE)

    def wanted(path: str, size: int) -> bool:
        ext = os.path.splitext(path.lower())[1]
        right = ext == ".xml" and not path.startswith(("_rels/", "docProps/")) if office else ext in TEXTS or not ext
        return right and _safe(path) and size <= limits.member and total + size <= limits.total and len(out) < limits.members

    try:
        if low.endswith((".tar", ".tar.gz", ".tgz")):
            with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as t:
                for m in t:
                    path = m.name.replace("\\", "/").removeprefix("./")
                    if m.isfile() and wanted(path, m.size):
                        data = t.extractfile(m).read(limits.member + 1)
                        total += len(data)
                        if got := _member(path, data, False):
                            out.append(got)
        else:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                for m in z.infolist():
                    path = m.filename.replace("\\", "/").removeprefix("./")
                    if not m.is_dir() and not m.flag_bits & 1 and wanted(path, m.file_size):
                        with z.open(m) as f:
                            data = f.read(limits.member + 1)
                        if len(data) > limits.member:
                            continue
                        total += len(data)
                        if got := _member(path, data, office):
                            out.append(got)
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, NotImplementedError, RuntimeError, ValueError):
        return out
    return out


_COLUMNS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "credential", "connection", "connstr", "dsn", "key", "user", "login", "value", "config")


def cells(raw: bytes | None, limits: DatabaseLimits = DatabaseLimits()) -> list[tuple[str, str, int, str]]:
    """Table, column, row and value of a SQLite database's cells that may hold secrets.

    Tables and columns come by how much their names promise, then by name.
    Bytes that are no database have no cells.
    """
    if not raw or raw[:16] != b"SQLite format 3\0" or len(raw) > limits.size:
        return []
    points = lambda name, weight: weight * sum(t in name.lower() for t in _COLUMNS)
    quote = lambda name: '"' + name.replace('"', '""') + '"'
    out, total = [], 0
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(raw[:18] + b"\1\1" + raw[20:])  # a database with a write-ahead log opens without it
        tables = []
        for (t,) in db.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite\\_%' escape '\\'"):
            columns = [r[1] for r in db.execute(f"pragma table_info({quote(t)})")]
            good = sorted((c for c in columns if points(c, 4)), key=lambda c: (-points(c, 4), c))[: limits.columns]
            if good:
                tables.append((-(points(t, 3) + sum(points(c, 4) for c in good)), t, good))
        for _, t, good in sorted(tables)[: limits.tables]:
            for n, row in enumerate(db.execute(f"select {', '.join(map(quote, good))} from {quote(t)} limit {limits.rows}"), 1):
                for c, v in zip(good, row):
                    v = v.decode("utf-8", "replace") if isinstance(v, bytes) else v
                    if not isinstance(v, str) or not v.strip() or len(v.encode()) > limits.cell or total + len(v.encode()) > limits.total:
                        continue
                    total += len(v.encode())
                    out.append((t, c, n, v))
    except sqlite3.Error:
        return out
    finally:
        db.close()
    return out


#: Rows and bytes of values after which a reader passes on what it has: the results of a whole batch of files don't stand in memory.
ROWS, BYTES = 2048, 1 << 20


def read_all(batches: Iterator[pa.RecordBatch], of, fields: list[tuple[str, pa.DataType, str]]) -> Iterator[pa.RecordBatch]:
    """``file_id`` and what ``of(name, content)`` gives for each file, in batches of bounded size (a single file's results aren't cut)."""

    def made(batch: pa.RecordBatch, of_file: list[int], rows: list[tuple]) -> pa.RecordBatch:
        own = batch.column("file_id").take(pa.array(of_file))
        return pa.RecordBatch.from_arrays([own, *[pa.array([g[k] for g in rows], t) for k, (_, t, _) in enumerate(fields)]], ["file_id", *[n for n, _, _ in fields]])

    for batch in batches:
        of_file, rows, held = [], [], 0
        for i, (name, content) in enumerate(zip(batch.column("name"), batch.column("content"))):
            got = of(name.as_py() or "", content.as_py())
            of_file += [i] * len(got)
            rows += got
            held += sum(len(v) for g in got for v in g if isinstance(v, str))
            if len(rows) >= ROWS or held >= BYTES:
                yield made(batch, of_file, rows)
                of_file, rows, held = [], [], 0
        if rows:
            yield made(batch, of_file, rows)


def _table_function(files: DataFrame, of, fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """``file_id`` and what ``of(name, content)`` gives for each file."""
    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "name", "content").mapInArrow(lambda batches: read_all(batches, of, fields), f"file_id {kind}, " + ", ".join(f"{n} {s}" for n, _, s in fields))


def decoded(files: DataFrame) -> DataFrame:
    """``file_id`` and ``text`` of files that are texts."""
    return _table_function(files, lambda _, raw: [(t,)] if (t := decode(raw)) is not None else [], [("text", pa.string(), "string")])


def archive_members(files: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """``file_id``, ``member``, ``size`` and ``text`` of archives' members."""
    return _table_function(files, lambda name, raw: members(name, raw, limits), [("member", pa.string(), "string"), ("size", pa.int64(), "long"), ("text", pa.string(), "string")])


def sqlite_cells(files: DataFrame, limits: DatabaseLimits = DatabaseLimits()) -> DataFrame:
    """``file_id``, ``table_name``, ``column_name``, ``row_number`` and ``value`` of databases' cells."""
    fields = [("table_name", pa.string(), "string"), ("column_name", pa.string(), "string"), ("row_number", pa.int64(), "long"), ("value", pa.string(), "string")]
    return _table_function(files, lambda _, raw: cells(raw, limits), fields)


def as_files(members_: DataFrame, files: DataFrame) -> DataFrame:
    """Members as files of their own, in place of their archives: paths are ``outer!inner``."""
    outer = files.drop("text", "content", "size")
    rows = members_.join(outer, "file_id").withColumn("archive_path", F.col("file_path"))
    rows = rows.withColumns({"file_path": F.concat_ws("!", "file_path", "member"), "name": X.base_name(F.col("member"))})
    return rows.withColumn("extension", X.extension(F.col("name"))).drop("member")


def tree(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Files below a directory: ``file_path name extension size modified_at content``; ``max_bytes`` leaves larger ones out before they are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if max_bytes is not None:
        rows = rows.where(F.col("length") <= max_bytes)
    p = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    rows = rows.select(p.alias("file_path"), X.base_name(p).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "content")
    return rows.withColumn("extension", X.extension(F.col("name")))


def targets(spark: SparkSession, named: list[str], path: str | None = None) -> DataFrame:
    """Targets given by name and those of a file, a line each: ``host`` and ``source``. Blank lines and comments don't count."""
    rows = spark.createDataFrame([(n, "cli") for n in named], "host string, source string")
    if path is not None:
        rows = rows.union(spark.read.text(path).select(X.strip(F.col("value")).alias("host"), F.lit("file").alias("source")))
    return rows.where("host <> '' and not startswith(host, '#')")
