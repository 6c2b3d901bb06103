"""Archives read by path, in bounded pieces, whatever their size.

``scan_archive_files`` lists files with Spark's reader (no content is read),
follows the headers of plain archives to cut them into pieces of whole members,
deals the pieces out to tasks and reads each as a stream. A gzip stream can only
be read from its start, so it is one piece. A task holds one part of one member
and what a batch of small members may weigh, never an archive or a long member.

Headers are followed by the standard codec: ustar prefixes, GNU long names, pax
path and size (those of the archive, then those of the file). Regular files only;
an archive ends at its zero block, or where it is cut off: then the member cut
has no last part. An empty file has no members. What cannot be read (no archive, a
broken or cut gzip stream) gives one row with ``failure`` behind the members
before the fault.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import tarfile
import zlib
from collections.abc import Iterator
from contextlib import ExitStack, closing
from typing import IO

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.registry import query
from lithic.saved import new_path
from lithic.sources.connectors import without_root

#: bytes of content in a row, and of small members that a task gathers before it sends them
PART = 8 << 20
#: bytes of a plain archive that a task reads
SPLIT = 128 << 20
_PIECE = pa.schema([("archive", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("defaults", pa.map_(pa.string(), pa.string())), ("failure", pa.string())])
_ROWS = pa.schema([("archive", pa.string()), ("path", pa.string()), ("size_bytes", pa.int64()), ("part", pa.int64()), ("last", pa.bool_()), ("content_hash", pa.string()), ("content", pa.binary()), ("failure", pa.string())])
_UNREADABLE = (tarfile.TarError, zlib.error, EOFError, OSError, ValueError)


def located(uri: str) -> tuple[FileSystem, str]:
    """The file system of a path, of those that Arrow knows, and the path in it."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        uri = "file:///" + rest.lstrip("/")
    elif scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    return FileSystem.from_uri(uri)


def opened(uri: str):
    """A file for reading at any place."""
    system, path = located(uri)
    return system.open_input_file(path)


def _headers(raw: IO[bytes], mode: str, defaults: dict[str, str] | None = None) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo]]:
    """Members one by one; those gone by are forgotten. A cut end is an end."""
    with tarfile.open(fileobj=raw, mode=mode, bufsize=1 << 20, pax_headers=dict(defaults or {})) as archive:
        while True:
            try:
                member = archive.next()
            except tarfile.ReadError:
                if archive.offset == 0:
                    raise
                return
            if member is None:
                return
            yield archive, member
            archive.members.clear()


def _is_file(member: tarfile.TarInfo) -> bool:
    return member.type in (tarfile.REGTYPE, tarfile.AREGTYPE) and member.name != ""


def pieces_of(uri: str, split: int) -> Iterator[tuple]:
    """(archive, begin, end, defaults, failure) of one file: ``end`` is null for a stream, ``defaults`` are the pax records in force at ``begin``."""
    try:
        with closing(opened(uri)) as raw:
            start = raw.read(2)
            if not start:
                return
            if start == b"\x1f\x8b":
                yield uri, 0, None, {}, None
                return
            raw.seek(0)
            begin, end, defaults = 0, 0, {}
            for archive, member in _headers(raw, "r:"):
                if member.offset - begin >= split:
                    yield uri, begin, member.offset, defaults, None
                    begin, defaults = member.offset, dict(archive.pax_headers)
                end = archive.offset
            if end > begin:
                yield uri, begin, end, defaults, None
    except _UNREADABLE as error:
        yield uri, 0, 0, {}, type(error).__name__


def members_of(uri: str, begin: int, end: int | None, defaults: dict[str, str], part: int) -> Iterator[tuple]:
    """Rows of one piece in the order of the archive."""
    try:
        with closing(opened(uri)) as raw:
            raw.seek(begin)
            # members of a stream are read as they come, those of a plain piece at their places
            found = _headers(gzip.GzipFile(fileobj=raw), "r|") if end is None else _headers(raw, "r:", defaults)
            for archive, member in found:
                if end is not None and member.offset >= end:
                    return
                if not _is_file(member):
                    continue
                content, hashed, held, number = archive.extractfile(member), hashlib.sha256(), 0, 0
                while True:
                    try:
                        data = content.read(min(part, member.size - held))
                    except tarfile.ReadError:
                        return  # cut off inside the member
                    hashed.update(data)
                    held += len(data)
                    last = held == member.size
                    if not data and not last:
                        return
                    yield uri, member.name, member.size, number, last, hashed.hexdigest() if last else None, data, None
                    if last:
                        break
                    number += 1
    except _UNREADABLE as error:
        yield uri, None, None, None, None, None, None, type(error).__name__


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def bounded(rows: Iterator[tuple], schema: pa.Schema, content: int | None, most: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows that hold at most about ``most`` bytes of content, and at most 10,000 rows."""
    held, size = [], 0
    for row in rows:
        weight = len(row[content] or b"") if content is not None else 0
        if held and (size + weight > most or len(held) == 10_000):
            yield _batch(held, schema)
            held, size = [], 0
        held.append(row)
        size += weight
    if held:
        yield _batch(held, schema)


def _pieces(split: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (({**dict(zip(_PIECE.names, piece, strict=True)), "defaults": list(piece[3].items())}) for batch in batches for uri in batch.column(0).to_pylist() for piece in pieces_of(uri, split))
        return bounded((tuple(row.values()) for row in rows), _PIECE, None, 0)

    return run


def _reader(part: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for piece in batch.to_pylist():
                if piece["failure"] is not None:
                    yield piece["archive"], None, None, None, None, None, None, piece["failure"]
                else:
                    yield from members_of(piece["archive"], piece["begin"], piece["end"], dict(piece["defaults"] or []), part)

    return lambda batches: bounded(rows(batches), _ROWS, 6, part)


def archive_pieces(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """Pieces of files(path): what one task is to read at a time."""
    return files.select("path").mapInArrow(_pieces(split), "archive string, begin long, end long, defaults map<string,string>, failure string")


def read_pieces(pieces: DataFrame, part: int = PART) -> DataFrame:
    """One row for each part of each regular file; ``content_hash`` is that of the whole file, on its last part."""
    return pieces.mapInArrow(_reader(part), "archive string, path string, size_bytes long, part long, last boolean, content_hash string, content binary, failure string")


def archive_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and length of the files under ``path`` whose names fit ``pattern``; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")


def scan_archive_files(spark: SparkSession, path: str, pattern: str = "*", part: int = PART, split: int = SPLIT) -> DataFrame:
    """The regular files of all archives under ``path``, plain or gzip, in parts of at most ``part`` bytes."""
    files = archive_files(spark, path, pattern)
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // split))
    return read_pieces(archive_pieces(files, split).repartition(tasks), part)


def whole_files(parts: DataFrame) -> DataFrame:
    """archive, path, size_bytes and content_hash of the members that are there to their last part."""
    return parts.where("last").select("archive", "path", "size_bytes", "content_hash")


def _written(folder: str):
    """Tasks write the rows(snapshot_id, path, content) they get to one archive for each snapshot, each second one zipped, and name it when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = located(folder)
        system.create_dir(base)
        task, done, own = TaskContext.get(), [], None
        with ExitStack() as stack:
            for batch in batches:
                for snapshot, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if snapshot != own:
                        stack.close()
                        own, name = snapshot, f"{snapshot}-{task.partitionId():05}.tar" + (".gz" if snapshot % 2 else "")
                        done.append((f"{base}/.{name}-{task.taskAttemptId()}", f"{base}/{name}"))
                        raw = stack.enter_context(system.open_output_stream(done[-1][0]))
                        archive = stack.enter_context(tarfile.open(fileobj=raw, mode="w|gz" if snapshot % 2 else "w|"))
                    member = tarfile.TarInfo(f"root-{snapshot}/{path}")
                    member.size = len(content)
                    archive.addfile(member, io.BytesIO(content))
        for aside, final in done:
            system.move(aside, final)
        yield pa.record_batch([pa.array([final for _, final in done], pa.string())], names=["archive"])

    return run


@query("src2_files", "SELECT snapshot_id, path, size_bytes, content_hash FROM files")
def src2_files(t):
    """All files packed by snapshot into archives in the shared folder, and read back by path."""
    folder = new_path(t.spark, "archives")
    rows = t("files").select("snapshot_id", "path", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("content"))
    rows.repartitionByRange("snapshot_id", "path").sortWithinPartitions("snapshot_id", "path").mapInArrow(_written(folder), "archive string").count()
    found = whole_files(scan_archive_files(t.spark, folder))
    snapshot = F.regexp_extract("archive", r"([0-9]+)-[0-9]+[.]tar(?:[.]gz)?$", 1)
    return found.select(snapshot.cast("long").alias("snapshot_id"), without_root(F.col("path"), F.lit("root"), snapshot).alias("path"), "size_bytes", "content_hash")
