"""Token ids in binary shards with a minimal perfect hash index.

Documents are ordered by id over all shards: a range exchange deals them out, each task
encodes its documents in order and writes one shard file:

    payload   ids, one after the other, as unsigned little-endian 16 or 32-bit integers
    keys      the document ids in order, 64-bit (those of null ids come first, as zeros)
    starts    where each document's ids begin, one more than there are documents, 64-bit
    index     levels of bits, then per slot: first document with the key, number of
              documents with it, and a fingerprint of the key
    footer    JSON with the sizes and places of the sections, its length, a magic word

Index: the distinct keys of a shard are hashed into a row of bits; a key alone at its bit
keeps it, the others go to the next, smaller level. A key's slot is the number of set bits
before its own, so n keys have exactly the slots 0 to n - 1 at about four bits a key. The
stored fingerprint tells keys that are not in the shard. A lookup reads one place per level.
Whole shards are read through it as well: their keys are looked up, and the payload is read
in ranges of neighbouring documents.

The table of shards (``manifest``) has one row per shard with its id range, so that a key's
shard is found by bisection; where a shard starts among all ids is a running sum over it.

Defined cases: null texts are empty and still get the end id. Null ids come first, are not
in the index and are read in order; repeated ids share a slot that knows how many documents
have the key. Equal ids are ordered by a hash of the text. An empty table has no shards and
gives no rows. Other columns are not written. A task that runs again writes a file of another
name; only files in the manifest count.
"""

from __future__ import annotations

import array
import functools
import json
import re
import sys
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classatlas.llm import files
from classatlas.llm.common import shared_folder, text_or_empty, written
from classatlas.llm.pieces import PieceTable, byte_characters

MAGIC = b"CATOKEN1"
#: Bits of a level per key that is still without a slot.
GAMMA = 1.7
MAX_LEVELS = 48
#: Bytes and documents that are read at a time.
RANGE, ROWS = 4 << 20, 500
#: Entries of a worker's table of encoded pieces, and characters of the longest that is kept.
CACHE_ENTRIES, CACHE_CHARS = 1_000_000, 48

MANIFEST = "shard long, path string, documents long, ids long, nulls long, first_key long, last_key long"


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of 64-bit keys."""
    x = keys.astype(np.int64, copy=False).view(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0 to n - 1 for n distinct 64-bit keys, and a number below n or -1 for others."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ones = np.unpackbits(bits, bitorder="little").reshape(-1, 8).sum(1) if len(bits) else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        sizes, levels, rest = [], [], keys
        while len(rest):
            if len(sizes) == MAX_LEVELS:
                raise ValueError("keys of an index must be distinct")
            size = max(8, -(-int(len(rest) * GAMMA) // 8) * 8)
            places = (mixed(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(places, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little"))
            rest = rest[~alone[places]]
        return PerfectHash(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint8))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        slots, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = self.offsets[level] + (mixed(keys[rest], level) % np.uint64(size)).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            held = self.bits[byte]
            hit = (held >> bit) & 1 == 1
            below = np.bitwise_count(held & ((1 << bit.astype(np.uint16)) - 1).astype(np.uint8))
            slots[rest[hit]] = (self.before[byte] + below)[hit]
            rest = rest[~hit]
        return slots


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, MAX_LEVELS) >> np.uint64(32)).astype("<u4")


class FileEncoder:
    """Encodes texts as a tokenizer file's library does; pieces that come again are looked up.

    The file's added tokens are found first, from the left and the longest of those at one
    place; the byte-level BPE model gets the texts between them.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        tokenize, characters, kind = tokenizer.model.tokenize, byte_characters(), "H" if self.kind.itemsize == 2 else "I"
        blank, swapped = characters[0x20], sys.byteorder == "big"

        def encode_piece(piece: str) -> bytes:
            if piece.isascii() and piece.isprintable():  # of these only the blank is written differently
                written = piece.replace(" ", blank)
            else:
                written = "".join(map(characters.__getitem__, piece.encode()))
            ids = array.array(kind, [t.id for t in tokenize(written)])
            if swapped:
                ids.byteswap()
            return ids.tobytes()

        self._between = PieceTable(pattern, encode_piece, CACHE_ENTRIES, CACHE_CHARS).encode_all
        added = tokenizer.get_added_tokens_decoder()
        for token in added.values():
            if token.single_word or token.lstrip or token.rstrip or token.normalized:
                raise ValueError(f"added token {token.content!r} has a rule of matching that is not supported")
        self._added = {token.content: np.array([i], self.kind).tobytes() for i, token in added.items() if token.content}
        longest_first = sorted(self._added, key=len, reverse=True)
        self._split = re.compile(f"({'|'.join(map(re.escape, longest_first))})").split if self._added else None

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of every text; none for null."""
        if self._split is None:
            return self._between(texts)
        whole, parted = [], {}
        for k, text in enumerate(texts):
            whole.append(text)
            if text and any(token in text for token in self._added):
                parted[k], whole[k] = self._split(text), None
        encoded = self._between(whole)
        for k, parts in parted.items():
            parts[::2] = self._between(parts[::2])
            parts[1::2] = map(self._added.__getitem__, parts[1::2])
            encoded[k] = b"".join(parts)
        return encoded

    @staticmethod
    @functools.lru_cache(maxsize=2)
    def load(path: str, pattern: str) -> FileEncoder:
        return FileEncoder(path, pattern)


class ShardWriter:
    """Takes documents in order of their ids; ``close`` returns the shard's row for the manifest."""

    def __init__(self, uri: str, kind: np.dtype):
        self.uri, self.kind, self.out = uri, kind, files.open_output(uri)
        self.keys, self.lengths, self.nulls = [], [], 0

    def add(self, key: int | None, ids: bytes) -> None:
        self.nulls += key is None
        self.keys.append(key or 0)
        self.lengths.append(len(ids) // self.kind.itemsize)
        self.out.write(ids)

    def close(self) -> dict:
        keys = np.array(self.keys, "<i8")
        starts = np.concatenate([[0], np.cumsum(np.array(self.lengths, np.int64))]).astype("<i8")
        distinct, first, count = np.unique(keys[self.nulls:], return_index=True, return_counts=True)
        index = PerfectHash.build(distinct)
        entries = np.zeros(len(distinct), [("first", "<i8"), ("count", "<i8"), ("print", "<u4")])
        slots = index.slots(distinct)
        entries["first"][slots], entries["count"][slots] = first + self.nulls, count
        entries["print"][slots] = fingerprints(distinct)
        places, at = {}, int(starts[-1]) * self.kind.itemsize
        for name, section in (("keys", keys), ("starts", starts), ("bits", index.bits), ("entries", entries)):
            data = section.tobytes()
            places[name], at = [at, len(data)], at + len(data)
            self.out.write(data)
        footer = json.dumps({"kind": self.kind.str, "nulls": self.nulls, "levels": index.sizes, "sections": places}).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return {"path": self.uri, "documents": len(keys), "ids": int(starts[-1]), "nulls": self.nulls,
                "first_key": int(keys[self.nulls]) if len(distinct) else None,
                "last_key": int(keys[-1]) if len(distinct) else None}


class Shard:
    """Keyed access to the documents of one shard file; the payload stays in the file."""

    def __init__(self, uri: str):
        self.file = files.open_random(uri)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16) if size >= 16 else b""
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        length = int.from_bytes(tail[:8], "little")
        footer = json.loads(self.file.read_at(length, size - 16 - length))
        self.kind, self.nulls, self._places = np.dtype(footer["kind"]), footer["nulls"], footer["sections"]
        self.starts = self._section("starts", "<i8")
        self.index = PerfectHash(footer["levels"], self._section("bits", np.uint8))
        self.entries = self._section("entries", [("first", "<i8"), ("count", "<i8"), ("print", "<u4")])

    def _section(self, name: str, kind) -> np.ndarray:
        at, length = self._places[name]
        return np.frombuffer(self.file.read_at(length, at), kind)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; 0 documents if it isn't there."""
        slots = self.index.slots(keys)
        known = slots >= 0
        known[known] = self.entries["print"][slots[known]] == fingerprints(keys[known])
        first, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[known], count[known] = self.entries["first"][slots[known]], self.entries["count"][slots[known]]
        return first, count

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the index says each document is, and its key; the documents of null ids, which have no key, come first."""
        keys = np.unique(self._section("keys", "<i8")[self.nulls:])
        first, count = self.find(keys)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.concatenate([np.arange(self.nulls), np.repeat(first, count) + nth]), np.repeat(keys, count)

    def read(self, places: np.ndarray, most: int = RANGE) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """The ids of the documents at these places; neighbours are read by ranges of about ``most`` bytes."""
        begins, ends = (self.starts[places + k] * self.kind.itemsize for k in (0, 1))
        at = 0
        while at < len(places):
            upto = at + 1
            while upto < len(places) and begins[upto] == ends[upto - 1] and ends[upto] - begins[at] <= most and upto - at < ROWS:
                upto += 1
            data = self.file.read_at(int(ends[upto - 1] - begins[at]), int(begins[at]))
            yield places[at:upto], [
                np.frombuffer(data[b: e], self.kind).astype("<u4").tobytes()
                for b, e in zip((begins[at:upto] - begins[at]).tolist(), (ends[at:upto] - begins[at]).tolist())]
            at = upto

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document with this key."""
        first, count = self.find(np.array([key], np.int64))
        places = first[0] + np.arange(count[0])
        return [np.frombuffer(ids, "<u4") for _, some in self.read(places) for ids in some]


def write_shards(
    documents: DataFrame, tokenizer: str, pattern: str, end_id: int = 0, folder: str | None = None,
) -> DataFrame:
    """Writes all documents (doc_id, text); returns the manifest.

    ``pattern`` is the one by which the tokenizer file's byte-level model splits texts.
    """
    folder = folder or shared_folder(documents.sparkSession, "token-shards")
    rows = documents.select("doc_id", text_or_empty("text").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    # a flag instead of null ids: whole numbers next to nulls would arrive as rounded ones
    numbered = ordered.select(
        F.isnull("doc_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text",
        F.spark_partition_id().cast("long").alias("shard"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, writer, shard = FileEncoder.load(tokenizer, pattern), None, None
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            if writer is None and len(batch):
                shard = int(batch["shard"].iloc[0])
                writer = ShardWriter(f"{folder}/{shard:06d}-{uuid.uuid4().hex}.ids", encoder.kind)
            for no_id, key, ids in zip(batch["no_id"], batch["doc_id"], encoder.encode_all(batch["text"])):
                writer.add(None if no_id else int(key), ids + end)
        if writer is not None:
            yield pd.DataFrame([{"shard": shard, **writer.close()}]).astype({"first_key": "Int64", "last_key": "Int64"})

    return written(numbered.mapInPandas(write, MANIFEST), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids binary) of all documents, read from the files through their indexes."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    shards = max(1, manifest.count())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"]):
                for rows in _documents(Shard(path), int(start)):
                    yield rows

    return placed.select("path", "start").repartition(shards).mapInPandas(read, "doc_id long, start long, ids binary")


def _documents(shard: Shard, start: int) -> Iterator[pd.DataFrame]:
    """The documents of a shard in the order of their keys, each where the index leads to."""
    places, keys = shard.places()
    if len(places) != len(shard.starts) - 1:
        raise ValueError("the index of a shard does not lead to all of its documents")
    done = 0
    for some, ids in shard.read(places):
        numbers = range(done, done + len(some))
        done += len(some)
        yield pd.DataFrame({
            "doc_id": pd.array([None if k < shard.nulls else int(keys[k - shard.nulls]) for k in numbers], "Int64"),
            "start": start + shard.starts[some],
            "ids": ids})


class TokenStore:
    """Keyed access over all shards: one row per shard is held, the shard of a key is found by bisection."""

    def __init__(self, manifest: DataFrame):
        rows = manifest.where("first_key IS NOT NULL").orderBy("shard").collect()
        self.paths = [r["path"] for r in rows]
        self.first = np.array([r["first_key"] for r in rows], np.int64)
        self.last = np.array([r["last_key"] for r in rows], np.int64)
        self.opened = functools.lru_cache(maxsize=64)(Shard)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document with this key; equal keys may lie on both sides of a shard's border."""
        low, high = int(np.searchsorted(self.last, key)), int(np.searchsorted(self.first, key, "right"))
        return [ids for k in range(low, high) for ids in self.opened(self.paths[k]).get(key)]
