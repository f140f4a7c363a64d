"""Media columns: interleaved sequences of text and media references, with payloads resolved by digest.

``store`` turns payloads into media: the bytes, padded with 255 to a multiple of ``UNIT``, are the samples of an 8-bit grey image
``SIDE`` wide, in PNG (lossless). Each is kept once for each task that meets it, in a written table with its digest (SHA-256 of
the padded payload), and each document gets an HTML page that refers to it by digest. ``sequences`` parses pages into ordered
structs, text or media reference: every img, video, audio, embed and object is an item where it stands, with the caption of its
figure or its own alternative text; a video or audio without src takes its first source, and what stands in a picture beside its
img is the same medium. ``resolve`` joins the references to what is read back from the store, one row for each digest;
``unreferenced`` gives what no page refers to.

Defined results: a null payload counts as empty (one unit of padding); equal payloads have one digest and equal results; a null
page has an empty sequence; a reference without a payload has null columns; text in scripts, styles and fallbacks is none; pages
of any length and depth are parsed in memory proportional to the page; a text of any length is one image; repeated rows each get
a result; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .htmltree import BLOCK, CLOSE, OPEN, TEXT, UNSEEN, attributes, walk
from .kernels import frugal, slices
from .shared import hot, join_unique, written

UNIT, SIDE = 576, 24
PNG = b"\x89PNG\r\n\x1a\n"
SCHEME = "sha256:"
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
MEDIA = frozenset("img video audio embed object".split())


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (UNIT * max(1, -(-len(raw) // UNIT)) - len(raw))


def png(payload: bytes, level: int = 1) -> bytes:
    """The payload as the samples of an 8-bit grey image, SIDE wide."""
    rows = len(payload) // SIDE
    lines = np.zeros((rows, SIDE + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, SIDE)
    out = [PNG]
    for name, body in ((b"IHDR", struct.pack(">IIBBBBB", SIDE, rows, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes(), level)), (b"IEND", b"")):
        out.append(struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body)))
    return b"".join(out)


def samples(image: bytes) -> np.ndarray:
    """Rows of samples of an image that ``png`` wrote; raises ValueError if it is damaged."""
    if image[:8] != PNG:
        raise ValueError("not a PNG")
    at, data, size = 8, [], None
    while at < len(image):
        n, name = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + n]
        if struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0] != zlib.crc32(name + body):
            raise ValueError("checksum differs")
        if name == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif name == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("unknown filter")
    return lines[:, 1:]


def feature(image: np.ndarray) -> str:
    """Size, mean, deviation and an average hash (64 cells of the image's bytes, 1 where a cell is at least the mean)."""
    flat = image.reshape(-1)
    total = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
    edge = np.arange(65) * len(flat) // 64
    cells = (total[edge[1:]] - total[edge[:-1]]) / np.diff(edge)
    bits = np.packbits(cells >= total[-1] / len(flat)).tobytes().hex()
    return f"{image.shape[1]}x{image.shape[0]};mean={total[-1] / len(flat):.4f};std={float(flat.std()):.4f};ahash={bits}"


def _store(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("html", pa.string()), ("digest", pa.string()), ("media", pa.binary())])
    seen: set[str] = set()
    for batch in batches:
        ids = batch.column("doc_id")
        for texts in slices(batch.column("text")):
            pages, sizes, digests, media = [], [], [], []
            for i in range(len(texts)):
                raw = texts.bytes(i)
                payload = padded(raw)
                digest = hashlib.sha256(payload).hexdigest()
                name = ids[texts.first + i].as_py()
                pages.append(f'<article><h1>Document {name}</h1><figure><img src="{SCHEME}{digest}" alt="payload"><figcaption>{len(raw)} bytes</figcaption></figure></article>')
                sizes.append(len(raw))
                digests.append(digest)
                media.append(None if digest in seen else png(payload))
                if len(seen) > 1_000_000:  # bounds memory; what is stored twice is read as one
                    seen.clear()
                seen.add(digest)
            yield pa.RecordBatch.from_arrays([ids.slice(texts.first, len(texts)).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(pages), pa.array(digests), pa.array(media, pa.binary())], schema=schema)


def store(docs: DataFrame) -> DataFrame:
    """A written table: doc_id, n_bytes, html, digest and, where the task met the digest first, media."""
    return written(docs.select("doc_id", "text").mapInArrow(frugal(_store), "doc_id long, n_bytes long, html string, digest string, media binary"), "media-store")


def _source(attrs: dict[str, str]) -> str | None:
    """The reference of a media element: src or data, else what lazy loading or a set of sources names first."""
    for name in ("src", "data", "data-src", "srcset", "data-srcset"):
        value = html.unescape(attrs.get(name, "")).strip()
        if value:
            return value.split(",")[0].split()[0] if name.endswith("srcset") else value
    return None


def sequence(page: str | None) -> list[dict]:
    """The interleaved items of a page: text, and references to media with their captions."""
    out: list[dict] = []
    parts: list[str] = []
    caption: list[str] = []
    figures: list[int] = []  # for each open figure, its first item
    waiting: list[tuple[str, str | None]] = []  # open video and audio elements without src, with their captions
    unseen = in_caption = 0

    def say(words: list[str]) -> str:
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        return text

    def flush():
        text = say(parts)
        if text:
            out.append({"position": len(out), "kind": "text", "text": text, "digest": None, "caption": None})

    def refer(link: str, alt: str | None):
        flush()
        out.append({"position": len(out), "kind": "media", "text": None, "digest": link.removeprefix(SCHEME), "caption": alt})

    for kind, name, raw in walk(page or ""):
        if kind == TEXT:
            if in_caption:
                caption.append(name)
            elif not unseen:
                parts.append(name)
            continue
        if kind == CLOSE:
            if name == "figcaption":
                in_caption -= 1
            elif name == "figure":
                flush()
                said, first = say(caption), figures.pop()
                for item in out[first:]:
                    if said and item["kind"] == "media":
                        item["caption"] = said
            elif name in ("video", "audio") and waiting:
                waiting.pop()
            elif name in BLOCK and not in_caption:
                flush()
            unseen -= name in UNSEEN
            continue
        if name in MEDIA and not (unseen and name == "img"):
            attrs = attributes(raw)
            alt = " ".join(html.unescape(attrs.get("alt") or attrs.get("aria-label") or attrs.get("title") or "").split()) or None
            link = _source(attrs)
            if link and not waiting:
                refer(link, alt)
            if kind == OPEN and name in ("video", "audio"):
                waiting.append((name, alt) if not link else ("", alt))
        elif name == "source" and waiting and waiting[-1][0]:
            link = _source(attributes(raw))
            if link:
                refer(link, waiting[-1][1])
                waiting[-1] = ("", None)
        elif name == "figure" and kind == OPEN:
            flush()
            figures.append(len(out))
        elif name == "figcaption" and kind == OPEN:
            flush()
            caption.append(" ")
            in_caption += 1
        elif name in BLOCK and not in_caption:
            flush()
        elif name == "br" or name in BLOCK:
            (caption if in_caption else parts).append(" ")
        if kind == OPEN:
            unseen += name in UNSEEN
    flush()
    return out


def sequences(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """doc_id and items for every page."""

    def run(batches):
        for batch in batches:
            items = [sequence(p) for p in batch.column(1).to_pylist()]
            shape = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, shape)], names=[id_col, "items"])

    kind = T.StructType([pages.schema[id_col], T.StructField("items", T._parse_datatype_string(ITEMS))])
    return pages.select(id_col, html_col).mapInArrow(frugal(run), kind)


def _read(batches):
    schema = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part, out = batch.slice(lo, 500), []
            for digest, media in zip(part.column("digest").to_pylist(), part.column("media").to_pylist()):
                image = samples(media)
                payload = image.tobytes()
                out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(image)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def descriptors(table: DataFrame) -> DataFrame:
    """What the stored media are, read back: one row for each digest."""
    read = table.where("media is not null").select("digest", "media").mapInArrow(frugal(_read), "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return read.dropDuplicates(["digest"])


def resolve(items: DataFrame, known: DataFrame, id_col: str = "doc_id", often: list | None = None) -> DataFrame:
    """A row for each media reference, in place, with the columns of its descriptor (null where there is no payload).

    known has each digest once; ``often`` names the digests that many references share, whose descriptors are brought to them.
    """
    refs = items.select(id_col, F.explode("items").alias("item")).where("item.kind = 'media'").select(id_col, "item.position", "item.caption", "item.digest")
    return join_unique(refs, known, "digest", often or [], "left")


def unreferenced(items: DataFrame, known: DataFrame) -> DataFrame:
    """The descriptors that no page refers to."""
    refs = items.select(F.explode("items.digest").alias("digest")).distinct()
    return known.join(refs, "digest", "left_anti")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of every document's payload, through store, sequences and resolve."""
    table = store(docs)
    found = resolve(sequences(table.select(F.struct("doc_id", "n_bytes").alias("doc"), "html"), "doc"), descriptors(table), "doc", hot(table, "digest"))
    return found.select("doc.doc_id", "doc.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
