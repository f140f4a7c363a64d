"""Token-ID output: documents as runs of token ids in seekable Zstandard files.

A file holds one independent Zstandard frame for each document (its ids as little-endian unsigned 32-bit integers), then a
skippable frame with the documents' ids, then a skippable frame with the seek table of the public seekable format: for each
frame its compressed and decompressed size and a checksum (low 32 bits of the XXH64 of what it decompresses to), the number of
frames, a descriptor byte and the magic number. A reader takes the two tables from the end of the file and decompresses only
the frames of the documents that it wants.

Files are written by range of doc_id in the shared folder, each named by its range's number, under a temporary name that is
renamed when the file is whole, so a task that is run again replaces its file. What goes to the driver is one row for each file;
these rows, the manifest, are written beside the files, and ``manifest`` reads them in any session.

Defined results: a null text counts as empty (only the end id); rows with equal doc_id are neighbours in one file, in the order
of their texts; a null doc_id sorts first; a text of any length is one frame; units are told apart by 64-bit hashes; columns but
doc_id and text are ignored, whatever their names; an empty table makes no files and an empty manifest.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import FOLD, Texts, frugal, hash_runs, runs, slices
from .shared import fresh

END_ID = 1
MANIFEST = "file string, first long, docs long, tokens long, start long"
SEEKABLE, SKIPPABLE, IDS_FRAME = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
LEVEL = 1
#: Units (words, runs of punctuation) whose ids a worker keeps; beyond, it starts anew.
MOST_UNITS = 600_000
#: Of a table that finds most units again without a search.
SLOT_BITS = 18

_b = np.arange(256)
_SPACE = (_b == 32) | ((_b >= 9) & (_b <= 13))
#: Classes of bytes within which the tokenizer's own splitter never cuts apart what a run of the class holds: letters, digits, others.
_CLASS = np.where(_SPACE, 0, np.where((_b >= 48) & (_b <= 57), 2, np.where(((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128), 1, 3))).astype(np.uint8)


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class UnitEncoder:
    """Encodes slices of texts like ``tokenizer.encode(text, add_special_tokens=False)``, but each distinct unit once.

    A unit is a run of letters, digits or punctuation, where the tokenizer splits in any case; a stretch between white space
    that holds an apostrophe, ``<`` or a character beyond Latin-1 letters is a unit as a whole. This holds for tokenizers that
    drop white space, ignore ASCII case outside special tokens, and split letters, digits and punctuation from each other.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.symbols = {b: c for b, c in enumerate(_byte_symbols()) if b != 32}
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.flat, self.at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.slot_hash, self.slot_unit = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -1, np.int64)
        self.units = 0

    def _learn(self, hashes: list[int], buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> None:
        """Adds units; the plain ones (letters of Latin-1 only) go straight to the model, lower-cased and as byte symbols."""
        for part in (np.flatnonzero(plain), np.flatnonzero(~plain)):
            for lo in range(0, len(part), 4096):
                own = part[lo : lo + 4096]
                n = ends[own] - starts[own]
                if plain[own[0]]:
                    at = np.cumsum(n + 1) - (n + 1)
                    joined = np.full(int((n + 1).sum()), 32, np.uint8)
                    joined[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())] = buf[np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    symbols = joined.tobytes().decode().lower().encode().decode("latin-1").translate(self.symbols)
                    e = self.bare.encode(symbols, add_special_tokens=False)
                    ids, count = np.array(e.ids, np.uint32), np.bincount(np.array(e.word_ids, np.int64), minlength=len(own))
                else:
                    each = [e.ids for e in self.whole.encode_batch([buf[starts[k] : ends[k]].tobytes().decode("utf-8", "replace") for k in own], add_special_tokens=False)]
                    ids, count = np.array([x for y in each for x in y], np.uint32), np.array([len(y) for y in each])
                base, have = int(self.at[self.units]), self.units
                while base + len(ids) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
                while have + len(own) + 1 > len(self.at):
                    self.at = np.concatenate([self.at, np.zeros_like(self.at)])
                self.flat[base : base + len(ids)] = ids
                self.at[have + 1 : have + len(own) + 1] = base + np.cumsum(count)
                self.index.update(zip([hashes[k] for k in own.tolist()], range(have, have + len(own))))
                self.units += len(own)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin."""
        buf = texts.buf
        kind = _CLASS[buf]
        cs, ce = runs(kind > 0, texts.at)
        if not len(cs):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        odd = (buf == 39) | (buf == 60)
        high = np.flatnonzero(buf >= 128)
        if len(high):
            lead, inner = buf[high] == 0xC3, (buf[high] >= 0x80) & (buf[high] <= 0xBF)
            after = buf[np.maximum(high - 1, 0)] == 0xC3
            odd[high] = ~(lead | (inner & after)) | (after & ((buf[high] == 0x97) | (buf[high] == 0xB7)))
        some = np.concatenate([[0], np.cumsum(odd)])
        whole = some[ce] - some[cs] > 0
        cut = np.zeros(len(buf) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        if whole.any():
            edge = np.zeros(len(buf) + 1, np.int8)
            edge[cs[whole]] += 1
            edge[ce[whole]] -= 1
            cut[:-1] &= np.cumsum(edge[:-1]) == 0
        cut[cs] = True
        starts = np.flatnonzero(cut[:-1])
        # A unit ends where the next of its stretch starts, or where the stretch ends.
        ends = np.append(starts[1:], len(buf))
        last = np.searchsorted(starts, np.append(cs[1:], len(buf) + 1)) - 1
        ends[last] = ce
        h = hash_runs(FOLD[buf], starts, ends)
        special = np.flatnonzero(np.isin(starts, cs[whole]))
        if len(special):  # special tokens mind the case
            h[special] = hash_runs(buf, starts[special], ends[special]) ^ np.uint64(1)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        unit = np.where(self.slot_hash[slot] == h, self.slot_unit[slot], -1)
        rare = np.flatnonzero(unit < 0)
        if len(rare):
            unique, first, back = np.unique(h[rare], return_index=True, return_inverse=True)
            if self.units and self.units + len(unique) > MOST_UNITS:
                self.clear()
                return self.encode(texts)
            get, keys = self.index.get, unique.tolist()
            known = np.array([get(k, -1) for k in keys])
            missing = np.flatnonzero(known < 0)
            if len(missing):
                odd_unit = np.zeros(len(starts), bool)
                odd_unit[special] = True
                own = rare[first[missing]]
                names = [keys[k] for k in missing.tolist()]
                self._learn(names, buf, starts[own], ends[own], (kind[starts[own]] == 1) & ~odd_unit[own])
                known[missing] = [self.index[k] for k in names]
            unit[rare] = known[back]
            self.slot_hash[slot[rare]], self.slot_unit[slot[rare]] = h[rare], unit[rare]
        lo, n = self.at[unit], self.at[unit + 1] - self.at[unit]
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.flat[np.repeat(lo - total[:-1], n) + np.arange(total[-1])]
        return out, total[np.searchsorted(starts, texts.at)]


def frame_table(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class Writer:
    def __init__(self, sink):
        self.sink, self.entries, self.ids = sink, [], []
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        frame = self.pack.compress(raw)
        self.sink.write(frame)
        self.ids.append(-(1 << 63) if doc_id is None else doc_id)
        self.entries.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        n = len(self.entries)
        own = frame_table(IDS_FRAME, np.array(self.ids, "<i8").tobytes())
        self.sink.write(own)
        # The table lists every frame, this skippable one included: it decompresses to nothing.
        table = b"".join(self.entries) + struct.pack("<III", len(own), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        self.sink.write(frame_table(SKIPPABLE, table + struct.pack("<IBI", n + 1, 0x80, SEEKABLE)))


class Reader:
    """Random access to the documents of a file; ``source`` has seek, read and size."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        n, kind, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or kind != 0x80:
            raise ValueError("no seek table")
        source.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        source.seek(int(self.starts[n - 1]) + 8)
        self.doc_ids = np.frombuffer(source.read(int(self.table[n - 1, 0]) - 8), "<i8")
        self.unpack = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        self.source.seek(int(self.starts[k]))
        raw = self.unpack.decompress(self.source.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k}: checksum differs")
        return np.frombuffer(raw, "<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of the documents with this doc_id; only their frames are read."""
        lo, hi = np.searchsorted(self.doc_ids, [doc_id, doc_id + 1])
        return [self.ids(k) for k in range(lo, hi)]


def opened(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def _write(folder: str, tokenizer: str):
    schema = pa.schema([("file", pa.string()), ("first", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        encoder, writer, first, docs, tokens = None, None, None, 0, 0
        fs, root = opened(folder)
        number = TaskContext.get().partitionId()
        name, part = f"tokens-{number:06d}.zst", f".tokens-{number:06d}-{uuid.uuid4().hex}.part"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = UnitEncoder(tokenizer)
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(f"{root}/{part}")
                writer, first = Writer(sink), batch.column("doc_id")[0].as_py()
            doc_ids = batch.column("doc_id").to_pylist()
            for texts in slices(batch.column("text")):
                ids, at = encoder.encode(texts)
                for i in range(len(texts)):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(END_ID))
                    writer.add(doc_ids[texts.first + i], own)
                    docs, tokens = docs + 1, tokens + len(own)
        if writer is not None:
            writer.close()
            sink.close()
            if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.File:  # of an earlier attempt
                fs.delete_file(f"{root}/{name}")
            fs.move(f"{root}/{part}", f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([first], pa.int64()), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64())], schema=schema)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes the files; returns one row for each: file, first doc_id, docs, tokens and start, the number of ids before it."""
    spark = docs.sparkSession
    folder = folder or fresh(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = sorted(rows.mapInArrow(frugal(_write(folder, tokenizer)), "file string, first long, docs long, tokens long").collect(), key=lambda r: (r["first"] is not None, r["first"] or 0))
    start, out = 0, []
    for r in files:
        out.append((r["file"], r["first"], r["docs"], r["tokens"], start))
        start += r["tokens"]
    spark.createDataFrame(out, MANIFEST).coalesce(1).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each file of a folder that ``write_tokens`` filled."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _read(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = opened(row["file"])
            with fs.open_input_file(path) as source:
                reader = Reader(source)
                start, out = row["start"], []
                for k, doc_id in enumerate(reader.doc_ids.tolist()):
                    ids = reader.ids(k)
                    out.append((None if doc_id == -(1 << 63) else doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; each file is a task of its own."""
    spark = files.sparkSession
    n = max(1, files.count())
    return files.repartitionByRange(n, "start").mapInArrow(frugal(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id and ids of every document, from the files."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = opened(row["file"])
                with fs.open_input_file(path) as source:
                    reader = Reader(source)
                    for k, doc_id in enumerate(reader.doc_ids.tolist()):
                        yield pa.RecordBatch.from_arrays([pa.array([None if doc_id == -(1 << 63) else doc_id], pa.int64()), pa.array([reader.ids(k).astype(np.int64)], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return files.mapInArrow(run, "doc_id long, ids array<long>")
