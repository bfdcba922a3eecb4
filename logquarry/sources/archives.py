"""Support archives (tar, gzip-tar, zip) to tables of archives, entries and lines.

The scan lists paths and lengths only; Spark packs small archives into one task and gives large ones
their own. Each task streams its archives member by member and line by line.
"""

from __future__ import annotations

import gzip
import hashlib
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Magic bytes and the size of the binary check.
GZIP_MAGIC = b"\x1f\x8b"
ZIP_MAGICS = (b"PK\x03", b"PK\x05", b"PK\x07")
SNIFF_BYTES = 512

READ_BYTES = 1 << 20
BATCH_ROWS = 8192
BATCH_CHARS = 8 << 20
# What a damaged archive raises. Other errors, such as those of a file system, fail the task, so that it is tried again.
DAMAGED = (tarfile.TarError, zipfile.BadZipFile, gzip.BadGzipFile, zlib.error, EOFError, NotImplementedError)
RECORDS = (
    "file_id string, filename string, size_bytes long, uploaded_at timestamp, error string, entry_ord int, "
    "path string, size long, is_binary boolean, line_no int, text string"
)


def open_stream(uri: str) -> BinaryIO:
    """Seekable file of any file system Arrow knows (local, object store, HDFS)."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def normal_path(name: str) -> str:
    """Forward slashes, without a leading `./` or `/`."""
    return name.replace("\\", "/").removeprefix("./").removeprefix("/")


def members(stream: BinaryIO, damage: list[str]) -> Iterator[tuple[str, int, BinaryIO]]:
    """(path, size, content) of every regular file; a damaged tail ends the listing and is told in `damage`."""
    magic = stream.read(3)
    stream.seek(0)
    if magic in ZIP_MAGICS:
        with zipfile.ZipFile(stream) as archive:
            for info in archive.infolist():
                if info.is_dir():
                    continue
                try:
                    content = archive.open(info)
                except (*DAMAGED, RuntimeError) as problem:  # RuntimeError: an encrypted member
                    damage.append(f"{info.filename}: {problem}")
                    continue
                yield normal_path(info.filename), info.file_size, content
        return
    mode = "r|gz" if magic[:2] == GZIP_MAGIC else "r|"
    with tarfile.open(fileobj=stream, mode=mode) as archive:
        while True:
            try:
                info = archive.next()
            except DAMAGED as problem:
                damage.append(str(problem))
                return
            if info is None:
                return
            content = archive.extractfile(info) if info.isreg() else None
            if content is not None:
                yield normal_path(info.name), info.size, content


def lines_of(content: BinaryIO, damage: list[str]) -> Iterator[bytes | None]:
    """None for a binary file, else its lines without line ends; a damaged tail keeps what was read and is told in `damage`."""
    rest: list[bytes] = []
    first = True
    while True:
        try:
            piece = content.read(READ_BYTES)
        except DAMAGED as problem:
            damage.append(str(problem) or type(problem).__name__)
            piece = b""
        if first:
            if b"\0" in piece[:SNIFF_BYTES]:
                yield None
                return
            first = False
        if not piece:
            break
        head, *whole = piece.split(b"\n")
        rest.append(head)
        if whole:
            yield b"".join(rest)
            rest = [whole.pop()]
            yield from whole
    if tail := b"".join(rest):
        yield tail


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.strip().split(" ")[0] for c in RECORDS.split(",")]
    rows: list[tuple] = []
    chars = 0

    def taken() -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=names)
        for column in ("entry_ord", "size", "line_no"):
            frame[column] = frame[column].astype("Int64")
        frame["is_binary"] = frame["is_binary"].astype("boolean")
        return frame

    for batch in batches:
        for uri, length, modified in zip(batch["path"], batch["length"], batch["modificationTime"]):
            head = (hashlib.md5(uri.encode()).hexdigest(), uri.rsplit("/", 1)[-1], length, modified)
            damage: list[str] = []
            entry = 0
            try:
                for path, size, content in members(open_stream(uri), damage):
                    if not path:
                        continue
                    number, binary = 0, False
                    for raw in lines_of(content, damage):
                        if raw is None:
                            binary = True
                            break
                        number += 1
                        text = raw.rstrip(b"\r").decode("utf-8", "replace")
                        rows.append((*head, None, entry, path, None, None, number, text))
                        chars += len(text)
                        if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                            yield taken()
                            rows, chars = [], 0
                    rows.append((*head, None, entry, path, size, binary, None, None))
                    entry += 1
            except DAMAGED as problem:
                damage.append(str(problem) or type(problem).__name__)
            rows.append((*head, "; ".join(damage)[:500] or None, None, None, entry, None, None, None))
    if rows:
        yield taken()


def unpack(spark: SparkSession, root: str, pattern: str = "*.{tgz,gz,tar,zip}") -> DataFrame:
    """Records of every archive below a folder: lines, one row per entry and one row per archive.

    Write them once; `lines`, `entries` and `archives` are filters on the written table.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    )
    return files.select("path", "length", "modificationTime").mapInPandas(_unpack, RECORDS)


def lines(records: DataFrame) -> DataFrame:
    return records.where(F.col("line_no").isNotNull()).select("file_id", "entry_ord", "path", "line_no", "text")


def entries(records: DataFrame) -> DataFrame:
    kept = F.col("path").isNotNull() & F.col("line_no").isNull()
    return records.where(kept).select("file_id", "entry_ord", "path", "size", "is_binary")


def archives(records: DataFrame) -> DataFrame:
    """One row per archive; it failed when nothing could be read from it."""
    rows = records.where(F.col("path").isNull())
    failed = F.col("error").isNotNull() & (F.col("size") == 0)
    return rows.select(
        "file_id", "filename", "size_bytes", F.when(failed, "failed").otherwise("parsed").alias("status"), "error", "uploaded_at"
    )


def read_entry(all_lines: DataFrame, path: str) -> DataFrame:
    """Lines of one exact path."""
    return all_lines.where(F.col("path") == path)


def listing(all_entries: DataFrame, folder: str = "", name: str = "") -> DataFrame:
    """Entries at or below a folder whose path contains a text, by path."""
    rows = all_entries
    if folder:
        rows = rows.where((F.col("path") == folder) | F.col("path").startswith(folder + "/"))
    if name:
        rows = rows.where(F.lower("path").contains(name.lower()))
    return rows.orderBy("file_id", "path")


def folders(all_entries: DataFrame, folder: str = "") -> DataFrame:
    """Immediate sub-folders of a folder."""
    rows = all_entries.where(F.col("path").startswith(folder + "/")) if folder else all_entries
    relative = F.substring("path", len(folder) + 2, 1 << 30) if folder else F.col("path")
    rows = rows.select("file_id", relative.alias("rel")).where(F.col("rel").contains("/"))
    return rows.select("file_id", F.substring_index("rel", "/", 1).alias("folder")).distinct()
