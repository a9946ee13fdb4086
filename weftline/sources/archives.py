"""Zip archives read by their directories.

The directory at the end of an archive says where the bytes of each entry lie.
One task per archive reads it, without the contents. Its entries are then dealt in
pieces of neighbours, and whichever task gets a piece reads just its byte ranges.
So a large archive is read by many tasks, no content is shuffled, and only a
single entry, not an archive, has to fit a row.
"""

from __future__ import annotations

import io
import lzma
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as files
from pyspark.sql import DataFrame, functions as F

from weftline.session import cut

#: What one piece holds: unpacked bytes (or one longer entry) and entries.
PIECE_BYTES = 32 << 20
PIECE_ENTRIES = 256
#: Pieces are dealt to at most so many tasks, which take theirs one after the other.
MOST_TASKS = 20_000
#: A row's text has to fit a Java array.
ENTRY_LIMIT = (1 << 31) - 1
BATCH_CHARS = 8 << 20

#: What damaged, cut off, encrypted or unknown ways of packing raise.
UNREADABLE = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, EOFError, OSError, RuntimeError, ValueError)

ENTRIES = "project_id string, file_path string, content string, error string"
ENTRY_COLUMNS = [column.split()[0] for column in ENTRIES.split(", ")]
PLACES = (
    "project_id string, path string, piece long, file_path string, stored_name string, start long, packed long, "
    "size long, crc long, method int, flags int, error string"
)
_PLACE_COLUMNS = [column.split()[0] for column in PLACES.split(", ")]

# The head of an entry, its first bytes, and the flags for encryption and UTF-8 names.
_HEAD = struct.Struct("<4s5H3I2H")
_HEAD_MARK = b"PK\x03\x04"
_ENCRYPTED = 0x1
_UTF8_NAME = 0x800


def said(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def file_at(path: str) -> tuple[files.FileSystem, str]:
    """File system and path of a file or folder that Spark names so."""
    path = re.sub("^file:/+", "/", re.sub("^s3[an]:", "s3:", path))
    if path.startswith("/"):
        return files.LocalFileSystem(), path
    return files.FileSystem.from_uri(quote(path, safe="/:@"))


class _Seeking:
    """An opened file that, like Python's own, raises OSError where a seek leads before its start."""

    def __init__(self, file):
        self._file = file

    def seek(self, at: int, whence: int = 0) -> int:
        try:
            return self._file.seek(at, whence)
        except ValueError as error:
            raise OSError(str(error)) from error

    def __getattr__(self, name):
        return getattr(self._file, name)


def _places(project: str, path: str, wanted: Callable[[str], bool]) -> Iterator[tuple]:
    """Rows of ``PLACES`` for one archive: one per wanted entry, or one with the error."""
    try:
        system, name = file_at(path)
        with system.open_input_file(name) as file, zipfile.ZipFile(_Seeking(file)) as archive:
            # the last of several entries with one name counts
            found = [e for n, e in archive.NameToInfo.items() if not e.is_dir() and wanted(n)]
    except UNREADABLE as error:
        yield project, path, 0, None, None, None, None, None, None, None, None, said(error)
        return
    piece, held, entries = 0, 0, 0
    for entry in sorted(found, key=lambda e: e.header_offset):
        if entries and (entries == PIECE_ENTRIES or held + entry.file_size > PIECE_BYTES):
            piece, held, entries = piece + 1, 0, 0
        held, entries = held + entry.file_size, entries + 1
        yield (
            project, path, piece, entry.filename, entry.orig_filename, entry.header_offset, entry.compress_size,
            entry.file_size, entry.CRC, entry.compress_type, entry.flag_bits, None,
        )


def directory(archives: DataFrame, wanted: Callable[[str], bool]) -> DataFrame:
    """``(project_id, path)`` → rows of ``PLACES``; ``wanted`` is asked about each entry's name.

    A task holds the directory of one archive, some hundred bytes an entry.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for project, path in zip(batch["project_id"], batch["path"]):
                rows = list(_places(project, path, wanted))
                for at in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[at : at + 10_000], columns=_PLACE_COLUMNS, dtype=object)

    return archives.select("project_id", "path").mapInPandas(read, PLACES)


def entry_bytes(file, place) -> bytes:
    """The unpacked bytes of an entry of the open archive; its checksum is compared."""
    if place.flags & _ENCRYPTED:
        raise RuntimeError("the entry is encrypted")
    if place.size > ENTRY_LIMIT:
        raise ValueError(f"an entry of {place.size} bytes does not fit a row")
    file.seek(place.start)
    head = file.read(_HEAD.size)
    if len(head) < _HEAD.size or not head.startswith(_HEAD_MARK):
        raise zipfile.BadZipFile("no entry where the directory says")
    name_length, extra_length = _HEAD.unpack(head)[-2:]
    name = file.read(name_length + extra_length)[:name_length]
    if name.decode("utf-8" if place.flags & _UTF8_NAME else "cp437", errors="replace") != place.stored_name:
        raise zipfile.BadZipFile("the entry has another name than in the directory")
    info = zipfile.ZipInfo(place.file_path)
    info.compress_type, info.flag_bits, info.CRC = place.method, place.flags, place.crc
    info.compress_size, info.file_size = place.packed, place.size
    with zipfile.ZipExtFile(io.BytesIO(file.read(place.packed)), "r", info) as unpacked:
        content = unpacked.read()
    if len(content) != place.size:
        raise EOFError(f"{len(content)} of {place.size} bytes")
    return content


class _Open:
    """The archive that was asked for last stays open."""

    def __init__(self):
        self.path, self.file = None, None

    def at(self, path: str):
        if path != self.path:
            self.close()
            system, name = file_at(path)
            self.file, self.path = system.open_input_file(name), path
        return self.file

    def close(self):
        if self.file is not None:
            self.file.close()
        self.path, self.file = None, None


def in_batches(rows: Iterator[tuple[str, str | None, str | None, str | None]]) -> Iterator[pd.DataFrame]:
    """Rows of ``ENTRIES`` as frames that grow no larger than a batch and one entry."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2] or "")
        if size >= BATCH_CHARS or len(held) >= 10_000:
            yield pd.DataFrame(held, columns=ENTRY_COLUMNS, dtype=object)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=ENTRY_COLUMNS, dtype=object)


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        archive = _Open()
        try:
            for batch in batches:
                # plain Python numbers: a column with a null in it would come as floats
                for place in batch.astype(object).itertuples(index=False):
                    if place.error is not None:
                        yield place.project_id, None, None, place.error
                        continue
                    try:
                        text = entry_bytes(archive.at(place.path), place).decode("utf-8", errors="replace")
                    except UNREADABLE as error:
                        yield place.project_id, place.file_path, None, said(error)
                    else:
                        yield place.project_id, place.file_path, text, None
        finally:
            archive.close()

    return in_batches(rows())


def dealt(places: DataFrame) -> DataFrame:
    """Places, written once and dealt to tasks by piece.

    The number of tasks is given: by the few bytes of a place, adaptive execution would put all of them into one.
    """
    held = cut(places)
    pieces = held.select("path", "piece").distinct().count()
    return held.repartition(max(1, min(pieces, MOST_TASKS)), "path", "piece").sortWithinPartitions("path", "start")


def contents(places: DataFrame) -> DataFrame:
    """Rows of ``PLACES`` → rows of ``ENTRIES``, read by byte range; whatever cannot be read has its error."""
    numbers = {"start": "long", "packed": "long", "size": "long", "crc": "long", "method": "int", "flags": "int"}
    whole = places.withColumns({c: F.coalesce(c, F.lit(0).cast(t)) for c, t in numbers.items()})
    return whole.mapInPandas(_contents, ENTRIES)
