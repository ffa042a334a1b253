"""Archives read by ranges: the directory first, then any entries, dealt out over tasks.

A task that lists an archive reads its end record and central directory only. What is to be
read of it becomes rows of place and length, dealt out in stretches of ``STRETCH`` bytes, so
that a large archive is read by many tasks and a small one by one. A task reads the entries of
a stretch in order of their places through a window of ``WINDOW`` bytes, inflates one at a time
and checks its length and checksum. What cannot be read is a row with an error.

Paths may be local or URIs of any file system that Arrow knows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRETCH, WINDOW = 64 << 20, 1 << 20
#: Rows and bytes of texts that leave a task together.
ROWS, BYTES = 2048, 16 << 20
#: Fixed values of the format: signatures, lengths, field layouts, and what stands for "see the 64-bit field".
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_FIELDS, END64_FIELDS, CENTRAL_FIELDS, LOCAL_FIELDS = "<4s4H2LH", "<4sQ2H2L4Q", "<4s6H3L5H2L", "<4s5H3L2H"
LOCATOR64_FIELDS, LONGEST_COMMENT, SEE_64, STORED, DEFLATED = "<4sLQL", 0xFFFF, 0xFFFFFFFF, 0, 8


class Damaged(ValueError):
    """The bytes are not those of a readable archive."""


class Entry(NamedTuple):
    index: int
    name: str
    flags: int
    method: int
    checksum: int
    packed: int
    size: int
    place: int


class RangeFile:
    """Reads at any place of a file; small neighbouring reads share one request."""

    def __init__(self, path: str, window: int = WINDOW):
        system, inside = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        self.file, self.window = system.open_input_file(inside), window
        self.size = self.file.size()
        self._start, self._data = 0, b""

    def at(self, place: int, length: int) -> bytes:
        if place < 0 or place + length > self.size:
            raise Damaged(f"{length} bytes at {place} lie outside of the file")
        if not self._start <= place or place + length > self._start + len(self._data):
            self._start = place
            self._data = self.file.read_at(min(max(length, self.window), self.size - place), place)
        return self._data[place - self._start: place - self._start + length]

    def close(self) -> None:
        self.file.close()


def _fields(layout: str, file: RangeFile, place: int, signature: bytes) -> tuple:
    found = struct.unpack(layout, file.at(place, struct.calcsize(layout)))
    if found[0] != signature:
        raise Damaged(f"no {signature!r} at {place}")
    return found


def _end(file: RangeFile) -> tuple[int, int, int]:
    """Place and length of the central directory, and how far all places are shifted by bytes before the archive."""
    length = struct.calcsize(END_FIELDS)
    start = max(0, file.size - length - LONGEST_COMMENT)
    tail = file.at(start, file.size - start)
    at = tail.rfind(END)
    while at >= 0 and (at + length > len(tail) or at + length + struct.unpack_from("<H", tail, at + length - 2)[0] > len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise Damaged("no end record")
    place = start + at
    *_, size, offset, _ = struct.unpack_from(END_FIELDS, tail, at)
    locator = place - struct.calcsize(LOCATOR64_FIELDS)
    if locator >= 0 and file.at(locator, 4) == LOCATOR64:
        place = locator - struct.calcsize(END64_FIELDS)
        *_, size, offset = _fields(END64_FIELDS, file, place, END64)
    shift = place - size - offset
    if shift < 0:
        raise Damaged("the directory does not fit before the end record")
    return offset + shift, size, shift


def directory(file: RangeFile) -> list[Entry]:
    """All entries in the order of the central directory."""
    place, size, shift = _end(file)
    data, at, entries = file.at(place, size), 0, []
    length = struct.calcsize(CENTRAL_FIELDS)
    while at < size:
        if at + length > size:
            raise Damaged("the directory ends inside an entry")
        found = struct.unpack_from(CENTRAL_FIELDS, data, at)
        if found[0] != CENTRAL:
            raise Damaged(f"no entry at {at} of the directory")
        _, _, _, flags, method, _, _, checksum, packed, full, names, extra, comment, _, _, _, offset = found
        name = data[at + length: at + length + names]
        more = data[at + length + names: at + length + names + extra]
        packed, full, offset = _wide(more, [full, packed, offset])
        decoded = name.decode("utf-8" if flags & 0x800 else "cp437", "replace").split("\0")[0]
        entries.append(Entry(len(entries), decoded, flags, method, checksum, packed, full, offset + shift))
        at += length + names + extra + comment
    return entries


def _wide(extra: bytes, fields: list[int]) -> tuple[int, int, int]:
    """Packed length, length and place, from the 64-bit field where the short ones say so."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values, from_ = [], at + 4
            for field in fields:
                if field == SEE_64:
                    if from_ + 8 > at + 4 + length:
                        raise Damaged("a 64-bit field is missing")
                    field, from_ = struct.unpack_from("<Q", extra, from_)[0], from_ + 8
                values.append(field)
            fields = values
        at += 4 + length
    return fields[1], fields[0], fields[2]


def content_of(file: RangeFile, entry: Entry) -> bytes:
    """The checked bytes of an entry."""
    if entry.flags & 1:
        raise Damaged("encrypted")
    *_, names, extra = _fields(LOCAL_FIELDS, file, entry.place, LOCAL)
    packed = file.at(entry.place + struct.calcsize(LOCAL_FIELDS) + names + extra, entry.packed)
    if entry.method == STORED:
        data = packed
    elif entry.method == DEFLATED:
        inflate = zlib.decompressobj(-15)
        try:
            # one byte more than there should be tells a longer one
            data = inflate.decompress(packed, entry.size + 1)
        except zlib.error as failure:
            raise Damaged(str(failure)) from failure
    else:
        raise Damaged(f"compression method {entry.method}")
    if len(data) != entry.size or zlib.crc32(data) != entry.checksum:
        raise Damaged("length or checksum differs")
    return data


# -- in tasks -------------------------------------------------------------------

_PLAN = "jar_path string, sources_path string, entry_idx long, entry_name string, flags int, method int, checksum long, packed long, size long, place long, error string"
_PLAN_ARROW = pa.schema([
    ("jar_path", pa.string()), ("sources_path", pa.string()), ("entry_idx", pa.int64()), ("entry_name", pa.string()), ("flags", pa.int32()),
    ("method", pa.int32()), ("checksum", pa.int64()), ("packed", pa.int64()), ("size", pa.int64()), ("place", pa.int64()), ("error", pa.string())])
TEXT = "jar_path string, entry_idx long, entry_name string, content string, error string"
_TEXT_ARROW = pa.schema([
    ("jar_path", pa.string()), ("entry_idx", pa.int64()), ("entry_name", pa.string()), ("content", pa.string()), ("error", pa.string())])


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _listed(wanted):
    def list_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of many small archives leave together, those of a large one in slices
        rows: list[tuple] = []
        for batch in batches:
            for paths in zip(*(batch.column(c).to_pylist() for c in ("jar_path", "sources_path"))):
                # an absent archive has no rows; any other failure of reading ends the task, and Spark tries again
                try:
                    file = RangeFile(paths[1])
                except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
                    continue
                try:
                    rows += [(*paths, *entry, None) for entry in directory(file) if wanted(entry.name)]
                except Damaged as failure:
                    rows.append((*paths, -1, None, 0, 0, 0, 0, 0, 0, str(failure)))
                finally:
                    file.close()
                if len(rows) >= ROWS:
                    for at in range(0, len(rows), ROWS):
                        yield _packed(rows[at: at + ROWS], _PLAN_ARROW)
                    rows = []
        if rows:
            yield _packed(rows, _PLAN_ARROW)

    return list_all


def _read(decode):
    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, rows, size = None, None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["error"] is None and row["sources_path"] != path:
                    if file is not None:
                        file.close()
                    path, file = row["sources_path"], RangeFile(row["sources_path"])
                content, error = None, row["error"]
                if error is None:
                    entry = Entry(row["entry_idx"], row["entry_name"], *(row[c] for c in ("flags", "method", "checksum", "packed", "size", "place")))
                    try:
                        content = decode(content_of(file, entry))
                    except Damaged as failure:
                        error = str(failure)
                rows.append((row["jar_path"], row["entry_idx"], row["entry_name"], content, error))
                size += len(content or "")
                if size >= BYTES or len(rows) >= ROWS:
                    yield _packed(rows, _TEXT_ARROW)
                    rows, size = [], 0
        if rows:
            yield _packed(rows, _TEXT_ARROW)

    return read_all


def read_texts(pairs: DataFrame, wanted, decode) -> DataFrame:
    """``(jar_path, entry_idx, entry_name, content, error)`` of the entries whose names are ``wanted``.

    From ``(jar_path, sources_path)`` rows; ``error`` says why an entry, or with ``entry_idx`` -1
    an archive, could not be read.
    """
    tasks = 4 * pairs.sparkSession.sparkContext.defaultParallelism
    listed = pairs.select("jar_path", "sources_path").repartition(tasks, "sources_path").mapInArrow(_listed(wanted), _PLAN)
    dealt = listed.repartition(tasks, "sources_path", F.floor(F.col("place") / STRETCH)).sortWithinPartitions("sources_path", "place")
    return dealt.mapInArrow(_read(decode), TEXT)
