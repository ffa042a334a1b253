"""Web archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: pages with equal payloads are found by digest; the one with the largest id becomes
a ``response`` record, the others ``revisit`` records that refer to it. Each task writes its
rows into archive files in the shared folder. A file begins with a skippable frame that
holds the dictionary, trained on a bounded sample of pages, itself compressed. Each record
is one frame.

Reading: a task streams a file frame by frame, so memory holds one record. The version
line, the headers a record must have, the lengths of the record and of the HTTP message in
it, its end mark and both digests are validated; a fault fails the task with place and cause.

Defined cases: a null html is an empty payload, payloads of no bytes are duplicates of each
other like any (``least_bytes`` raises that bound). Rows that share the largest id of their
payload are all responses; a null id counts as the smallest, and a null id reads back as
null. A null URL leaves its header out; control characters in a URL are percent-encoded.
An empty table writes no file and reads no row. Other columns are not written. Only archives
that this module wrote are read: a record of another type than response or revisit, or one
without a payload digest, is a fault. A task that
runs again writes a file of another name; only files in the manifest count.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classatlas.llm import files
from classatlas.llm.common import shared_folder, text_or_empty, unit_random, written

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")

URN = "urn:x-page:"
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3
#: The dictionary: its size, and number and longest length of the pages it is trained on.
DICTIONARY_BYTES, SAMPLE_PAGES, SAMPLE_CHARS = 16_384, 200, 8_192
#: A task begins another file beyond this size.
ARCHIVE_BYTES = 256 << 20

MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def with_refers_to(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to``: the page whose payload this one repeats, null for responses."""
    payload = text_or_empty("html")
    digests = pages.where(F.octet_length(payload) >= least_bytes).select("page_id", F.sha1(payload).alias("_digest"))
    # only payloads that occur more than once are kept; usually few
    repeated = written(
        digests.groupBy("_digest").agg(F.max("page_id").alias("_response"), F.count("*").alias("_n"))
        .where("_n > 1 AND _response IS NOT NULL").drop("_n"), "warc-repeats")
    keyed = pages.withColumn("_digest", F.sha1(payload))
    other = ~F.col("page_id").eqNullSafe(F.col("_response"))
    return keyed.join(repeated, "_digest", "left").withColumn("refers_to", F.when(other, F.col("_response"))).drop(
        "_digest", "_response")


def trained_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from some ``SAMPLE_PAGES`` pages, twice as many at most, of at most ``SAMPLE_CHARS`` characters."""
    fitting = pages.where(F.length("html").between(1, SAMPLE_CHARS))
    # by a hash and the share of rows wanted: no task holds or sends more than its part
    share = SAMPLE_PAGES / max(1, fitting.count())
    chosen = fitting.where(unit_random(F.col("page_id"), F.col("html")) < share).select("html").limit(2 * SAMPLE_PAGES)
    samples = [_record(0, None, r["html"].encode(), None) for r in chosen.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small; then the fixed parts of a record serve
        return (samples or [_record(0, None, b"", None)])[0][:DICTIONARY_BYTES]


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    lines = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <{URN}{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record per row of (page_id, url, html); returns the manifest of files."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    rows = pages.select("page_id", "url", "html")
    dictionary = trained_dictionary(rows)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compressor = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        plain = zstandard.ZstdCompressor(level=19).compress(dictionary)
        out, done = None, []
        for batch in batches:
            for page_id, url, page, refers_to in zip(*(batch[c].tolist() for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    path, records = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0
                    out = files.open_output(path)
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(plain)) + plain)
                numbers = [None if n is None else int(n) for n in (page_id, refers_to)]
                out.write(compressor.compress(_record(numbers[0], url, (page or "").encode(), numbers[1])))
                records += 1
                if out.tell() >= ARCHIVE_BYTES:
                    done.append((path, records, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((path, records, out.tell()))
            out.close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    # ids travel as digits: a column of numbers with nulls would arrive as rounded ones
    ready = with_refers_to(rows).select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"))
    return written(ready.mapInPandas(write, MANIFEST), "warc-manifest")


def frames(path: str) -> Iterator[tuple[int, bytes]]:
    """(place, content) of every frame after the dictionary."""
    with files.open_stream(path) as stream:
        magic, length = struct.unpack("<II", _exactly(stream, 8, path))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{path} does not begin with a dictionary frame")
        stored = _exactly(stream, length, path)
        if stored[:4] == zstandard.FRAME_HEADER:
            stored = zstandard.ZstdDecompressor().decompress(stored)
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stored))
        place, data = 8 + length, stream.read(1 << 20)
        while data:
            frame, parts, taken = decompressor.decompressobj(), [], 0
            while True:
                parts.append(frame.decompress(data))
                if frame.eof:
                    taken += len(data) - len(frame.unused_data)
                    data = frame.unused_data
                    break
                taken += len(data)
                data = stream.read(1 << 20)
                if not data:
                    raise ValueError(f"{path} ends inside the frame at byte {place}")
            yield place, b"".join(parts)
            place, data = place + taken, data or stream.read(1 << 20)


def _exactly(stream, length: int, path: str) -> bytes:
    data = stream.read(length)
    if len(data) != length:
        raise ValueError(f"{path} ends inside its first frame")
    return data


def _headers(data: bytes) -> dict[str, str]:
    found = {}
    for line in data.decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header line without a colon: {line[:80]!r}")
        found[name.strip().lower()] = value.strip()
    return found


def parse_record(content: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """Headers, full payload length and payload (None for revisits) of one record; raises on any fault."""
    first, _, rest = content.partition(b"\r\n")
    if first.decode("ascii", "replace") != VERSION:
        raise ValueError(f"version line {first[:20]!r}")
    header, gap, body = rest.partition(b"\r\n\r\n")
    headers = _headers(header)
    if not gap or any(n not in headers for n in NEEDED):
        raise ValueError("a needed header is missing")
    length = int(headers["content-length"])
    if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
        raise ValueError(f"{len(body) - 4} bytes of content, {length} announced")
    block = body[:length]
    if headers.get("warc-block-digest") not in (None, f"sha1:{base32_sha1(block)}"):
        raise ValueError("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no HTTP message")
    payload_length = int(_headers(http.partition(b"\r\n")[2])["content-length"])
    if headers["warc-type"] == "revisit":
        return headers, payload_length, None
    if len(payload) != payload_length:
        raise ValueError(f"{len(payload)} bytes of payload, {payload_length} announced")
    if headers.get("warc-payload-digest") not in (None, f"sha1:{base32_sha1(payload)}"):
        raise ValueError("payload digest differs")
    return headers, payload_length, payload


def _page_of(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").removeprefix(URN)
    return int(name) if name and name != "none" else None


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the files in ``path``; with ``payloads`` the payload as well (null for revisits)."""
    columns = RECORD + (", payload binary" if payloads else "")
    names = [c.split()[0] for c in columns.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows, size = [], 0
                for place, content in frames(path):
                    try:
                        headers, length, payload = parse_record(content)
                    except (ValueError, KeyError) as fault:
                        raise ValueError(f"{path}, record at byte {place}: {fault}") from fault
                    rows.append((
                        _page_of(headers["warc-record-id"]), headers["warc-type"], headers.get("warc-target-uri"), length,
                        headers["warc-payload-digest"].removeprefix("sha1:"), _page_of(headers.get("warc-refers-to")),
                        *[payload] * payloads))
                    size += len(content) * payloads
                    if len(rows) >= 2000 or size > 16 << 20:
                        yield _rows(rows, names)
                        rows, size = [], 0
                yield _rows(rows, names)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInPandas(read, columns)


def _rows(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    columns = dict(zip(names, zip(*rows) if rows else [()] * len(names)))
    # made one by one: whole numbers next to nulls would become rounded ones
    return pd.DataFrame({
        n: pd.array(list(c), "Int64") if n in ("page_id", "payload_bytes", "refers_to") else pd.Series(list(c), dtype=object)
        for n, c in columns.items()})
