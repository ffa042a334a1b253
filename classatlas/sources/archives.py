"""Reading archives inside tasks: entry names, source texts, single entries.

Every function takes a DataFrame of paths, so selections made by joins and
filters decide which archives are opened at all. Entry names come from the
central directory only; nothing is decompressed for them. Texts are streamed in
batches bounded by size, never a whole archive at once.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from classatlas.functions.names import SPECIAL_SOURCES
from classatlas.schemas import ENTRIES, ENTRY_TEXT
from classatlas.sources.zip_ranges import read_texts

_ROWS = 4096
_BYTES = 16 << 20
# what makes an archive absent or unreadable for good; other failures of reading
# (stale handles, too many open files, timeouts) fail the task, and Spark tries again
_ZIP_ERRORS = (
    FileNotFoundError, NotADirectoryError, IsADirectoryError,
    zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, ValueError, EOFError,
)

_ENTRY_ARROW = pa.schema([
    ("jar_path", pa.string()), ("entry_idx", pa.int64()), ("entry_name", pa.string()), ("error", pa.string()),
])
_TEXT_ARROW = pa.schema([
    ("jar_path", pa.string()), ("entry_idx", pa.int64()), ("entry_name", pa.string()), ("content", pa.string()),
])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def decode(data: bytes) -> str:
    """Lossy UTF-8 with Unix line ends."""
    return data.decode("utf-8", "replace").replace("\r\n", "\n")


def _entry_rows(path: str) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(path) as archive:
            names = [info.filename for info in archive.infolist()]
    except _ZIP_ERRORS as failure:
        yield path, -1, None, f"{type(failure).__name__}: {failure}"
        return
    yield path, -1, None, None
    for index, name in enumerate(names):
        yield path, index, name, None


def _reader(exact: str | None, suffix: str | None):
    """Task function; names that cannot match are dropped before they leave Python."""
    def wanted(name: str | None) -> bool:
        if name is None:
            return True
        return (exact is None or name == exact) and (suffix is None or name.endswith(suffix))

    def read_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for path in batch.column("jar_path").to_pylist():
                for row in _entry_rows(path):
                    if wanted(row[2]):
                        rows.append(row)
                    if len(rows) >= _ROWS:
                        yield _batch(rows, _ENTRY_ARROW)
                        rows = []
        if rows:
            yield _batch(rows, _ENTRY_ARROW)

    return read_names


def _text_rows(jar_path: str, sources_path: str, wanted: str) -> Iterator[tuple]:
    """One requested entry, if the archive has it."""
    with zipfile.ZipFile(sources_path) as archive:
        if wanted in archive.namelist():
            yield jar_path, 0, wanted, decode(archive.read(wanted))


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        columns = batch.to_pydict()
        for jar_path, sources_path, wanted in zip(
            columns["jar_path"], columns["sources_path"], columns["entry_name"]
        ):
            try:
                for row in _text_rows(jar_path, sources_path, wanted):
                    rows.append(row)
                    size += len(row[3])
                    if size >= _BYTES or len(rows) >= _ROWS:
                        yield _batch(rows, _TEXT_ARROW)
                        rows, size = [], 0
            except _ZIP_ERRORS:
                # an unreadable sources archive counts as absent
                continue
    if rows:
        yield _batch(rows, _TEXT_ARROW)


def _spread(paths: DataFrame, *keys: str) -> DataFrame:
    """Few, small rows that each stand for much work: use every task slot."""
    return paths.repartition(paths.sparkSession.sparkContext.defaultParallelism * 4, *keys)


def read_entry_names(
    artifacts: DataFrame, exact: str | None = None, suffix: str | None = None
) -> DataFrame:
    """Header row per archive (``entry_idx`` -1, ``error`` if unreadable) and its entries.

    ``exact`` and ``suffix`` keep only entries of that name or ending.
    """
    paths = _spread(artifacts.select("jar_path"), "jar_path")
    return paths.mapInArrow(_reader(exact, suffix), ENTRIES)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of the ``(jar_path, entry_name)`` pairs exist; rows of an archive come one after the other."""
    path, held = None, frozenset()
    for batch in batches:
        found = []
        for jar_path, entry_name in zip(*(batch.column(c).to_pylist() for c in ("jar_path", "entry_name"))):
            if jar_path != path:
                path, held = jar_path, frozenset(row[2] for row in _entry_rows(jar_path))
            found.append(entry_name in held)
        yield batch.filter(pa.array(found, pa.bool_()))


def existing_entries(pairs: DataFrame) -> DataFrame:
    """Those ``(jar_path, entry_name)`` pairs whose archive has the entry; each archive is opened once."""
    ordered = _spread(pairs.select("jar_path", "entry_name").distinct(), "jar_path").sortWithinPartitions("jar_path")
    return ordered.mapInArrow(_held, "jar_path string, entry_name string")


def _is_source(name: str) -> bool:
    return name.endswith(".java") and not name.endswith(SPECIAL_SOURCES)


def read_sources(pairs: DataFrame) -> DataFrame:
    """All class sources of ``(jar_path, sources_path)`` pairs, keyed by the binary archive.

    Large archives are read by several tasks. Rows with an ``error`` tell what could not be read.
    """
    return read_texts(pairs, _is_source, decode)


def read_source_entries(requests: DataFrame) -> DataFrame:
    """One named entry per ``(jar_path, sources_path, entry_name)`` request, if present."""
    wanted = requests.select("jar_path", "sources_path", "entry_name")
    return _spread(wanted, "sources_path", "entry_name").mapInArrow(_read_texts, ENTRY_TEXT)
