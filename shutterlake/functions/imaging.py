"""Image-level functions on arrays, as pandas UDF bodies or plain numpy."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_vector(packed: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to an array."""
    return packed.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.BinaryType())
def pack_vector(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


def views(pixels: np.ndarray, mirror: bool) -> list[np.ndarray]:
    """The four rotations of an image, and with ``mirror`` those of its mirror image."""
    own = [np.rot90(pixels, k) for k in range(4)]
    return own + [np.rot90(pixels[:, ::-1], k) for k in range(4)] if mirror else own


def invariant_hash(pixels: np.ndarray, mirror: bool = False) -> str:
    """The least hash of an image's views: the same for every rotation (and, with ``mirror``, reflection) of it.

    Before a view's pixels stand its width and height, or with ``mirror`` the longer and the shorter side, as 4 big-endian bytes each.
    """

    def head(v: np.ndarray) -> bytes:
        height, width = v.shape[:2]
        return struct.pack(">ii", *((max(width, height), min(width, height)) if mirror else (width, height)))

    return min(hashlib.sha256(head(v) + np.ascontiguousarray(v).tobytes()).hexdigest() for v in views(pixels, mirror))


def invariant_hashes(images: DataFrame, mirror: bool = False) -> DataFrame:
    """id and hash of (id, width, height, channels, pixels) rows; null where there are no pixels."""

    def run(batches):
        for part in batches:
            out = [None if r.pixels is None else invariant_hash(np.frombuffer(r.pixels, np.uint8).reshape(int(r.height), int(r.width), int(r.channels)), mirror) for r in part.itertuples()]
            yield pd.DataFrame({"id": part["id"], "hash": out})

    return images.select("id", "width", "height", "channels", "pixels").mapInPandas(run, "id long, hash string")


def suppress(boxes: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Greedy non-maximum suppression of (photo_id, x, y, w, h, confidence) for each photo; the most confident boxes stay."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["confidence", "x", "y"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        x, y, w, h = (part[c].to_numpy() for c in "xywh")
        kept: list[int] = []
        for i in range(len(part)):
            if kept:
                k = np.array(kept)
                wide = np.clip(np.minimum(x[i] + w[i], x[k] + w[k]) - np.maximum(x[i], x[k]), 0, None)
                high = np.clip(np.minimum(y[i] + h[i], y[k] + h[k]) - np.maximum(y[i], y[k]), 0, None)
                union = w[i] * h[i] + w[k] * h[k] - wide * high
                if (wide * high > threshold * union).any():
                    continue
            kept.append(i)
        return part.iloc[kept]

    own = boxes.select("photo_id", "x", "y", "w", "h", "confidence")
    return own.groupBy("photo_id").applyInPandas(run, own.schema)


def anchors(width: int, height: int, steps=(8, 16, 32), sizes=((16, 32), (64, 128), (256, 512))) -> np.ndarray:
    """Centre and size of the anchor boxes of a detector, as parts of the image."""
    out = []
    for step, own in zip(steps, sizes):
        ys, xs = np.mgrid[0 : -(-height // step), 0 : -(-width // step)]
        for s in own:
            out.append(np.stack([(xs + 0.5) * step / width, (ys + 0.5) * step / height, np.full(xs.shape, s / width), np.full(xs.shape, s / height)], -1)[:, :, None])
        out[-len(own) :] = [np.concatenate(out[-len(own) :], axis=2).reshape(-1, 4)]
    return np.concatenate(out)


def decode_faces(prior: np.ndarray, offsets: np.ndarray, points: np.ndarray, scores: np.ndarray, width: int, height: int, side: int, least: float = 0.8, variances=(0.1, 0.2)) -> tuple[np.ndarray, np.ndarray]:
    """(boxes, landmarks) of the anchors that are confident enough, of an image that was fitted and padded to ``side``.

    A box is x, y, width and height as parts of the image, and its score; landmarks are five points in pixels of the image. Both
    are freed of the padding and clamped to the image.
    """
    if not len(prior) == len(offsets) == len(points) == len(scores):
        raise ValueError("a row of output for each anchor")
    scale, pad_x, pad_y = padded_fit(width, height, side)[:3]
    keep = scores >= least
    p, o = prior[keep], offsets[keep]
    centre, size = p[:, :2] + o[:, :2] * variances[0] * p[:, 2:], p[:, 2:] * np.exp(o[:, 2:] * variances[1])
    pad, limit = np.array([pad_x, pad_y]), np.array([width, height], float)
    back = lambda xy: np.clip((xy * side - pad) / scale, 0, limit)
    low, high = back(centre - size / 2), back(centre + size / 2)
    marks = p[:, None, :2] + points[keep].reshape(-1, 5, 2) * variances[0] * p[:, None, 2:]
    return np.column_stack([low / limit, (high - low) / limit, scores[keep]]), back(marks)


def padded_fit(width: int, height: int, side: int) -> tuple[float, int, int, int, int]:
    """(scale, left and upper padding, width and height) of an image fitted into a square of ``side``."""
    scale = min(side / width, side / height)
    w, h = int(np.floor(width * scale + 0.5)), int(np.floor(height * scale + 0.5))
    return scale, (side - w) // 2, (side - h) // 2, w, h


# Files of images. Only PNG is decoded here; other formats need a decoder, a function from bytes to pixels or None.

PNG = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray | None:
    """Rows, columns and channels of an 8-bit PNG without a palette or interlacing; None of anything else."""
    if data[:8] != PNG:
        return None
    at, body, shape = 8, [], None
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", part)
            if depth != 8 or colour not in CHANNELS or interlaced:
                return None
            shape = (height, width, CHANNELS[colour])
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if shape is None:
        return None
    height, width, c = shape
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * c)
    except (zlib.error, ValueError):
        return None
    out = np.zeros((height, width * c), np.uint8)
    above = np.zeros(width * c, np.uint8)
    for y in range(height):
        kind, row = int(lines[y, 0]), lines[y, 1:].copy()
        if kind == 2:
            row += above
        elif kind:
            row = _unfiltered(kind, row, above, c)
        out[y] = above = row
    return out.reshape(shape)


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, c: int) -> np.ndarray:
    """A line of the filters that look to the left: 1 (left), 3 (mean) and 4 (nearest of three)."""
    own, up = row.astype(int).tolist(), above.astype(int).tolist()
    for x in range(len(own)):
        left, corner = (own[x - c], up[x - c]) if x >= c else (0, 0)
        if kind == 1:
            add = left
        elif kind == 3:
            add = (left + up[x]) // 2
        else:
            guess = left + up[x] - corner
            add = min((left, up[x], corner), key=lambda v: abs(guess - v))
        own[x] = (own[x] + add) & 255
    return np.array(own, np.uint8)


def encode_png(pixels: np.ndarray) -> bytes:
    height, width, c = pixels.shape
    lines = np.zeros((height, 1 + width * c), np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)
    colour = {n: k for k, n in CHANNELS.items()}[c]
    out = [PNG]
    for kind, part in ((b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes())), (b"IEND", b"")):
        out.append(struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part)))
    return b"".join(out)


def shrunk(pixels: np.ndarray, longest: int) -> np.ndarray:
    """The image with its longest edge at most ``longest``, each pixel the mean of those it covers."""
    height, width = pixels.shape[:2]
    scale = min(1.0, longest / max(width, height))
    h, w = max(1, int(height * scale + 0.5)), max(1, int(width * scale + 0.5))
    if (h, w) == (height, width):
        return pixels
    rows, columns = np.arange(h) * height // h, np.arange(w) * width // w
    total = np.add.reduceat(np.add.reduceat(pixels.astype(np.float64), rows, axis=0), columns, axis=1)
    area = np.diff(np.append(rows, height))[:, None] * np.diff(np.append(columns, width))[None, :]
    return np.floor(total / area[:, :, None] + 0.5).astype(np.uint8)


def decoded(files: DataFrame, others: Callable[[bytes], np.ndarray | None] | None = None) -> DataFrame:
    """path, width, height, channels and pixels of files (path, content, and optionally preview and degrees); nulls where nothing decodes.

    Where the content doesn't decode its preview is taken, turned clockwise by ``degrees``, as raw files need it.
    """
    extra = [c for c in ("preview", "degrees") if c in files.columns]

    def run(batches):
        for part in batches:
            out = []
            for r in part.itertuples():
                read = lambda b: None if b is None else decode_png(bytes(b)) if bytes(b[:8]) == PNG or others is None else others(bytes(b))
                image = read(r.content)
                if image is None and getattr(r, "preview", None) is not None:
                    image = read(r.preview)
                    turns = int(getattr(r, "degrees", 0) or 0) // 90
                    image = None if image is None else np.rot90(image, -turns)
                out.append((r.path, *((None,) * 4 if image is None else (image.shape[1], image.shape[0], image.shape[2], np.ascontiguousarray(image).tobytes()))))
            frame = pd.DataFrame(out, columns=["path", "width", "height", "channels", "pixels"])
            for c in ("width", "height", "channels"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    return files.select("path", "content", *extra).mapInPandas(run, "path string, width int, height int, channels int, pixels binary")


def write_thumbnails(images: DataFrame, root: str, cache: str, longest: int = 512, encode: Callable[[np.ndarray], bytes] = encode_png, suffix: str = ".png") -> DataFrame:
    """Writes a small copy of each decoded image where its path stands below ``root``, but below ``cache``; path, cache_path, width, height.

    Files are written whole and then renamed, so that a task run again, or a reader, never sees a part.
    """
    import pyarrow.fs as pafs

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(cache)
        for part in batches:
            out = []
            for r in part.itertuples():
                if r.pixels is None:
                    continue
                image = shrunk(np.frombuffer(r.pixels, np.uint8).reshape(int(r.height), int(r.width), int(r.channels)), longest)
                at = cache_path(r.path, root, base, suffix)
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                aside = f"{at}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(aside) as sink:
                    sink.write(encode(image))
                fs.move(aside, at)
                out.append((r.path, at, image.shape[1], image.shape[0]))
            yield pd.DataFrame(out, columns=["path", "cache_path", "width", "height"]).astype({"width": "int32", "height": "int32"})

    return images.select("path", "width", "height", "channels", "pixels").mapInPandas(run, "path string, cache_path string, width int, height int")


def cache_path(path: str, root: str, cache: str, suffix: str) -> str:
    """Where the cache mirrors a path below ``root``; a path elsewhere is mirrored whole."""
    inside = path[len(root) :] if path.startswith(root.rstrip("/") + "/") else path.split("://", 1)[-1]
    return f"{cache.rstrip('/')}/{inside.strip('/')}{suffix}"


def similarity_transform(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 2 x 3 matrix of the least-squares similarity (rotation, scale, shift) from points to points."""
    a, b = source.mean(axis=0), target.mean(axis=0)
    x, y = source - a, target - b
    u, s, vt = np.linalg.svd(y.T @ x / len(source))
    sign = np.array([1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    spread = (x**2).sum() / len(source)
    rotation = u @ np.diag(sign) @ vt
    scale = (s * sign).sum() / spread if spread > 0 else 1.0
    return np.column_stack([scale * rotation, b - scale * rotation @ a])
