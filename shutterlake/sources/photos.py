"""Image files as a source: recursive listing, and sizes, dates, camera, place and preview from their headers."""

from __future__ import annotations

import struct
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import capture_date, dimensions, exif_json, extension_of, orientation_degrees, trimmed_or_null

EXTENSIONS = ("jpg", "jpeg", "png", "cr2")
# Numbers of tags in image file directories.
WIDTH, HEIGHT, MAKE, MODEL, ORIENTATION, MODIFIED, EXIF, GPS, PREVIEW_AT, PREVIEW_SIZE = 0x100, 0x101, 0x10F, 0x110, 0x112, 0x132, 0x8769, 0x8825, 0x201, 0x202
ORIGINAL, DIGITIZED, EXIF_WIDTH, EXIF_HEIGHT, LENS = 0x9003, 0x9004, 0xA002, 0xA003, 0xA434
LATITUDE_SIDE, LATITUDE, LONGITUDE_SIDE, LONGITUDE, BELOW_SEA, ALTITUDE = 1, 2, 3, 4, 5, 6
# Sizes of types, and their codes for struct.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
# Names of directories and tags.
MAIN_NAME, EXIF_NAME, GPS_NAME = "Exif IFD0", "Exif SubIFD", "GPS"
NAMES = {
    0x100: "Image Width", 0x101: "Image Height", 0x10E: "Image Description", 0x10F: "Make", 0x110: "Model", 0x112: "Orientation", 0x11A: "X Resolution", 0x11B: "Y Resolution",
    0x128: "Resolution Unit", 0x131: "Software", 0x132: "Date/Time", 0x13B: "Artist", 0x8298: "Copyright", 0x829A: "Exposure Time", 0x829D: "F-Number", 0x8822: "Exposure Program",
    0x8827: "ISO Speed Ratings", 0x9000: "Exif Version", 0x9003: "Date/Time Original", 0x9004: "Date/Time Digitized", 0x9201: "Shutter Speed Value", 0x9202: "Aperture Value",
    0x9204: "Exposure Bias Value", 0x9207: "Metering Mode", 0x9209: "Flash", 0x920A: "Focal Length", 0xA001: "Color Space", 0xA002: "Exif Image Width", 0xA003: "Exif Image Height",
    0xA403: "White Balance Mode", 0xA405: "Focal Length 35", 0xA434: "Lens Model",
}
GPS_NAMES = {1: "GPS Latitude Ref", 2: "GPS Latitude", 3: "GPS Longitude Ref", 4: "GPS Longitude", 5: "GPS Altitude Ref", 6: "GPS Altitude", 7: "GPS Time-Stamp", 29: "GPS Date Stamp"}
#: Tags that have a column of their own.
PROMOTED = [NAMES[t] for t in (ORIENTATION, MAKE, MODEL, LENS, ORIGINAL, DIGITIZED, EXIF_WIDTH, EXIF_HEIGHT)]
FACTS = (
    "path string, exif_width int, exif_height int, own_width int, own_height int, preview_width int, preview_height int, original timestamp_ntz, digitized timestamp_ntz, tag int, "
    "make string, model string, lens string, gps_lat double, gps_lon double, gps_altitude double, entries array<struct<directory:string,tag:string,description:string>>, preview binary, modified timestamp, extension string"
)


def scan(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """path, size, modified, extension (and content) of the image files below a folder; the extension's case doesn't matter."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    out = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), extension_of(F.substring_index("path", "/", -1)).alias("extension"), *(["content"] if with_content else []))
    return out.where(F.col("extension").isin(*EXTENSIONS))


def directory(data: bytes, at: int, order: str) -> tuple[dict[int, object], int]:
    """Tags of the image file directory at an offset, and where the next one is.

    Texts are texts, numbers numbers or lists of them, rationals pairs or lists of them; other types are bytes.
    """
    out: dict[int, object] = {}
    (n,) = struct.unpack_from(order + "H", data, at)
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        size = SIZES.get(kind, 0) * count
        place = at + 10 + 12 * k
        if size > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        raw = data[place : place + size]
        if not size or len(raw) < size:
            continue
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
        elif kind in CODES:
            values = list(struct.unpack(f"{order}{count}{CODES[kind]}", raw))
            out[tag] = values[0] if count == 1 else values
        elif kind in (5, 10):
            flat = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
            pairs = list(zip(flat[::2], flat[1::2]))
            out[tag] = pairs[0] if count == 1 else pairs
        else:
            out[tag] = raw
    end = at + 2 + 12 * n
    return out, struct.unpack_from(order + "I", data, end)[0] if end + 4 <= len(data) else 0


def when(text: object) -> datetime | None:
    try:
        return datetime.strptime(str(text), "%Y:%m:%d %H:%M:%S")
    except ValueError:
        return None


def number(value: object) -> float | None:
    """A number, or a rational as one; None of 1/0 and of anything else."""
    if isinstance(value, tuple):
        return value[0] / value[1] if value[1] else None
    return float(value) if isinstance(value, int) else None


def degrees(value: object, side: object, negative: str) -> float | None:
    """Degrees, minutes and seconds as degrees, negative on the side named so."""
    if not isinstance(value, list) or len(value) != 3:
        return None
    parts = [number(v) for v in value]
    if any(p is None for p in parts):
        return None
    out = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -out if str(side).upper().startswith(negative) else out


def described(value: object) -> str | None:
    """A value as text: rationals as numbers where they are whole, lists with spaces between."""
    if isinstance(value, list):
        return " ".join(described(v) or "" for v in value)
    if isinstance(value, tuple):
        return None if not value[1] else str(value[0] // value[1]) if value[0] % value[1] == 0 else f"{value[0]}/{value[1]}"
    if isinstance(value, bytes):
        return value.decode("ascii") if value and all(32 <= b < 127 for b in value) else f"[{len(value)} values]"
    return str(value)


def tiff(data: bytes) -> dict:
    """What a TIFF structure (as EXIF data and raw files have it) says of its image."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        return {}
    (at,) = struct.unpack_from(order + "I", data, 4)
    main, after = directory(data, at, order)
    own = directory(data, main[EXIF], order)[0] if isinstance(main.get(EXIF), int) else {}
    gps = directory(data, main[GPS], order)[0] if isinstance(main.get(GPS), int) else {}
    whole = lambda x: x if isinstance(x, int) else None
    out = {"original": when(own.get(ORIGINAL)), "digitized": when(own.get(DIGITIZED)), "tag": whole(main.get(ORIENTATION)), "make": main.get(MAKE), "model": main.get(MODEL), "lens": own.get(LENS)}
    out |= {"exif_width": whole(own.get(EXIF_WIDTH)), "exif_height": whole(own.get(EXIF_HEIGHT)), "own_width": whole(main.get(WIDTH)), "own_height": whole(main.get(HEIGHT))}
    out |= {"gps_lat": degrees(gps.get(LATITUDE), gps.get(LATITUDE_SIDE), "S"), "gps_lon": degrees(gps.get(LONGITUDE), gps.get(LONGITUDE_SIDE), "W")}
    height = number(gps.get(ALTITUDE))
    out["gps_altitude"] = height if height is None else -height if gps.get(BELOW_SEA) == 1 else height
    entries = []
    for name, tags, known in ((MAIN_NAME, main, NAMES), (EXIF_NAME, own, NAMES), (GPS_NAME, gps, GPS_NAMES)):
        for tag, value in tags.items():
            text = described(value)
            if tag not in (EXIF, GPS) and text is not None:
                entries.append({"directory": name, "tag": known.get(tag, f"Unknown tag (0x{tag:04x})"), "description": text})
    out["entries"] = entries
    if after:
        thumb = directory(data, after, order)[0]
        start, size = thumb.get(PREVIEW_AT), thumb.get(PREVIEW_SIZE)
        if isinstance(start, int) and isinstance(size, int) and 0 < size <= len(data) - start:
            preview = data[start : start + size]
            shape = header(preview)
            out |= {"preview": preview, "preview_width": shape.get("own_width"), "preview_height": shape.get("own_height")}
    return out


def header(data: bytes) -> dict:
    """Facts from the header of a JPEG, PNG or TIFF-like file; nothing of a file that isn't one."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            out, at = {}, 8
            while at + 8 <= len(data):
                n, kind = struct.unpack_from(">I4s", data, at)
                if kind == b"eXIf":
                    out |= tiff(data[at + 8 : at + 8 + n])
                elif kind == b"IDAT":
                    break
                at += 12 + n
            width, height = struct.unpack_from(">II", data, 16)
            return out | {"own_width": width, "own_height": height}
        if data[:2] == b"\xff\xd8":
            out, at = {}, 2
            while at + 4 <= len(data) and data[at] == 0xFF:
                mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
                body = data[at + 4 : at + 2 + size]
                if mark == 0xE1 and body[:6] == b"Exif\0\0":
                    out |= {k: v for k, v in tiff(body[6:]).items() if v is not None}
                elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack_from(">HH", body, 1)
                    return out | {"own_width": width, "own_height": height}
                at += 2 + size
            return out
        return tiff(data)
    except (struct.error, IndexError, KeyError):
        return {}


def facts(files: DataFrame) -> DataFrame:
    """A row of header facts for each file (path, content, modified, extension); unreadable files have nulls."""
    names = [c.rsplit(" ", 1)[0] for c in FACTS.split(", ")][:-2]
    numbers = [c.rsplit(" ", 1)[0] for c in FACTS.split(", ") if c.endswith(" int")]

    def run(batches):
        for part in batches:
            got = [header(bytes(c)) | {"path": p} for p, c in zip(part["path"], part["content"])]
            out = pd.DataFrame([[g.get(n) for n in names] for g in got], columns=names)
            for c in numbers:
                out[c] = out[c].astype("Int32")
            for c in ("original", "digitized"):
                out[c] = pd.to_datetime(out[c])
            for c in ("gps_lat", "gps_lon", "gps_altitude"):
                out[c] = out[c].astype("float64")
            out["modified"], out["extension"] = part["modified"], part["extension"]
            yield out

    return files.select("path", "content", "modified", "extension").mapInPandas(run, FACTS)


def metadata(files: DataFrame) -> DataFrame:
    """What is known of each file (path, modified, extension, content): size, date and its source, rotation, camera, place, other
    EXIF tags as JSON, and the embedded preview of JPEG files.

    Sizes come from EXIF, then from the format's own header, then, for CR2 files, from the preview; dates from EXIF (taken, then
    digitised), then from the file system. Of a file that can't be read, only the last is known.
    """
    own = facts(files)
    kind = F.col("extension")
    named = F.when(kind.isin("jpg", "jpeg", "png"), F.struct(F.col("own_width").alias("w"), F.col("own_height").alias("h")))
    raw = F.when(kind == "cr2", F.struct(F.col("preview_width").alias("w"), F.col("preview_height").alias("h")))
    width, height = dimensions(("exif_width", "exif_height"), (named["w"], named["h"]), (raw["w"], raw["h"]))
    date, source = capture_date("original", "digitized", F.col("modified").cast("timestamp_ntz"))
    return own.select(
        "path",
        width.alias("width"),
        height.alias("height"),
        date.alias("capture_date"),
        source.alias("capture_date_source"),
        orientation_degrees("tag").alias("orientation"),
        *[trimmed_or_null(c).alias(n) for c, n in (("make", "camera_make"), ("model", "camera_model"), ("lens", "lens_model"))],
        "gps_lat",
        "gps_lon",
        "gps_altitude",
        F.when(F.col("entries").isNotNull(), exif_json("entries", PROMOTED)).alias("exif_extra"),
        F.when(kind.isin("jpg", "jpeg"), F.col("preview")).alias("preview"),
    )
