"""Scalar functions as Column expressions; none of them leaves the JVM."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees of rotation for the orientation tag.
ORIENTATION_DEGREES = {1: 0, 2: 0, 3: 180, 4: 180, 5: 90, 6: 90, 7: 270, 8: 270}
#: The search syntax, a quoted name behind its marker.
_TOKEN = re.compile(r'([@#])"([^"]+)"')


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Vectors


def dot(a, b) -> Column:
    """Dot product in double precision; null if either is null."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v) -> Column:
    """Unit vector; a vector with a norm below 1e-10 stays as it is."""
    v = _c(v)
    return F.when(norm(v) < 1e-10, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm(v)))


def running_centroid(centroid, n, v) -> Column:
    """Centroid of n members after one more, normalised."""
    n = _c(n)
    return l2_normalize(F.zip_with(_c(centroid), _c(v), lambda c, x: (c.cast("double") * n + x.cast("double")) / (n + 1)))


# Numbers and sizes


def half_up(x, digits: int = 2) -> Column:
    """Rounds half towards positive infinity, unlike ``F.round``."""
    scale = float(10**digits)
    return F.floor(_c(x) * scale + 0.5) / scale


def human_size(size) -> Column:
    size = _c(size)
    text = F.format_string("%.1f B", size.cast("double"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        text = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", size / float(1024**power))).otherwise(text)
    return F.when(size.isNull(), "unknown").otherwise(text)


def rate_text(x) -> Column:
    return F.format_string("%.2f", _c(x).cast("double"))


def gps_text(lat, lon) -> Column:
    lat, lon = _c(lat), _c(lon)
    text = F.format_string("%.6f° %s, %.6f° %s", F.abs(lat), F.when(lat >= 0, "N").otherwise("S"), F.abs(lon), F.when(lon >= 0, "E").otherwise("W"))
    return F.when(lat.isNull() | lon.isNull(), "Unknown location").otherwise(text)


def rotated(degrees, by) -> Column:
    return F.pmod(_c(degrees) + (by if isinstance(by, Column) else F.lit(by)), F.lit(360))


def orientation_degrees(tag) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ORIENTATION_DEGREES.items() for x in kv])
    return F.coalesce(F.element_at(table, _c(tag).cast("int")), F.lit(0))


def duration_ms(start, end) -> Column:
    """Milliseconds from one timestamp to another, whole ones towards zero."""
    micros = lambda x: F.unix_micros(_c(x).cast("timestamp"))
    return ((micros(end) - micros(start)) / 1000).cast("long")


def cropped_size(width, height, side: int = 224) -> Column:
    """struct(width, height, x, y, crop_width, crop_height): the shortest edge becomes ``side``, then the centre is cut out."""
    width, height = _c(width), _c(height)
    tall = width < height
    w = F.when(tall, F.lit(side)).otherwise(F.floor(width * side / height)).cast("int")
    h = F.when(tall, F.floor(height * side / width)).otherwise(F.lit(side)).cast("int")
    at = lambda x: F.greatest(F.lit(0), F.floor((x - side) / 2)).cast("int")
    return F.struct(w.alias("width"), h.alias("height"), at(w).alias("x"), at(h).alias("y"), F.least(F.lit(side), w).alias("crop_width"), F.least(F.lit(side), h).alias("crop_height"))


def padded_size(width, height, side: int = 1200) -> Column:
    """struct(scale, width, height, pad_x, pad_y): the image fitted into a square, centred."""
    width, height = _c(width), _c(height)
    scale = F.least(side / width, side / height)
    w, h = F.floor(width * scale + 0.5).cast("int"), F.floor(height * scale + 0.5).cast("int")
    return F.struct(scale.alias("scale"), w.alias("width"), h.alias("height"), F.floor((side - w) / 2).cast("int").alias("pad_x"), F.floor((side - h) / 2).cast("int").alias("pad_y"))


def fitted_size(width, height, longest: int = 512) -> tuple[Column, Column]:
    """Width and height after the longest edge shrinks to ``longest``; smaller images stay."""
    width, height = _c(width), _c(height)
    scale = F.least(F.lit(1.0), longest / F.greatest(width, height))
    side = lambda x: F.greatest(F.lit(1), F.floor(x * scale + 0.5)).cast("int")
    return side(width), side(height)


# Text and paths


def truncated(text, n: int) -> Column:
    return F.substring(_c(text), 1, n)


def ellipsis(text, most: int = 1024) -> Column:
    text = _c(text)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def extension_of(name) -> Column:
    """Lower case after the last dot, or ''."""
    name = _c(name)
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def parent_of(path) -> Column:
    return F.regexp_extract(_c(path), r"^(.*)[/\\][^/\\]+$", 1)


def ancestors_of(path) -> Column:
    """The path's folders from the root on, the path itself included."""
    parts = F.split(_c(path), r"[/\\]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def relative_path(path, root) -> Column:
    """The path below ``root``, without a leading separator; null if it isn't below it."""
    path, root = _c(path), F.regexp_replace(_c(root), r"[/\\]+$", "")
    rest = F.substr(path, F.length(root) + 1)
    return F.when(F.startswith(path, root) & (F.substr(rest, F.lit(1), F.lit(1)).isin("/", "\\") | (rest == "")), F.regexp_replace(rest, r"^[/\\]+", ""))


def trimmed_or_null(text) -> Column:
    return F.nullif(F.regexp_replace(_c(text), r"^\s+|\s+$", ""), F.lit(""))


def display_name(name, prefix: str, id_) -> Column:
    return F.coalesce(_c(name), F.concat(F.lit(f"{prefix} #"), _c(id_).cast("string")))


def person_tokens(query) -> Column:
    return _tokens(query, "@")


def tag_tokens(query) -> Column:
    return _tokens(query, "#")


def _tokens(query, marker: str) -> Column:
    found = F.regexp_extract_all(F.coalesce(_c(query), F.lit("")), F.lit(f'{marker}"([^"]+)"'), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def free_text(query) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_c(query), F.lit("")), r'[@#]"[^"]+"', ""))


@dataclass(frozen=True)
class SearchQuery:
    persons: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    text: str = ""


def parse_search(query: str | None) -> SearchQuery:
    """Splits ``@"person"`` and ``#"tag"`` from the free text; blank names are dropped."""
    found = [(m, v.strip()) for m, v in _TOKEN.findall(query or "")]
    return SearchQuery(tuple(v for m, v in found if m == "@" and v), tuple(v for m, v in found if m == "#" and v), _TOKEN.sub("", query or "").strip())


def caret_token(text) -> Column:
    """struct(marker, prefix) of an unfinished token at the end of ``text``; a no-break space in it counts as a space."""
    pattern = r"([@#])(\S*)$"  # fixed value: the search syntax
    return F.struct(F.regexp_extract(_c(text), pattern, 1).alias("marker"), F.translate(F.regexp_extract(_c(text), pattern, 2), " ", " ").alias("prefix"))


def committed_token(text, value) -> Column:
    """``text`` with its unfinished token replaced by the quoted value."""
    marker = F.regexp_extract(_c(text), r"([@#])(\S*)$", 1)
    head = F.regexp_replace(_c(text), r"[@#]\S*$", "")
    return F.when(marker == "", _c(text)).otherwise(F.concat(head, marker, F.lit('"'), _c(value), F.lit('" ')))


# Preferences and metadata


def pref_double(value, default: float) -> Column:
    return F.coalesce(F.expr("1").cast("double") * _c(value).try_cast("double"), F.lit(float(default)))


def pref_int(value, default: int) -> Column:
    return F.coalesce(_c(value).try_cast("int"), F.lit(default))


def pref_boolean(value, default: bool) -> Column:
    return F.coalesce(F.lower(_c(value)) == "true", F.lit(default))


def capture_date(original, digitized, modified) -> tuple[Column, Column]:
    """(date, where it comes from): the first that is there."""
    original, digitized, modified = _c(original), _c(digitized), _c(modified)
    source = F.when(original.isNotNull(), "EXIF_ORIGINAL").when(digitized.isNotNull(), "EXIF_DIGITIZED").otherwise("FILESYSTEM")
    return F.coalesce(original, digitized, modified), source


def dimensions(*sizes: tuple) -> tuple[Column, Column]:
    """Width and height, each from the first source (width, height) that has it."""
    return F.coalesce(*[_c(w) for w, _ in sizes]), F.coalesce(*[_c(h) for _, h in sizes])


def exif_json(entries, promoted: list[str]) -> Column:
    """JSON of an array of (directory, tag, description) structs by directory, without the promoted tags; null if none is left."""
    left = F.filter(_c(entries), lambda e: ~e["tag"].isin(promoted))
    names = F.array_distinct(F.transform(left, lambda e: e["directory"]))
    inner = lambda d: F.map_from_entries(F.transform(F.filter(left, lambda e: e["directory"] == d), lambda e: F.struct(e["tag"], e["description"])))
    return F.when(F.size(left) > 0, F.to_json(F.map_from_entries(F.transform(names, lambda d: F.struct(d, inner(d))))))


# Images and boxes


def pixel_hash(width, height, pixels) -> Column:
    """SHA-256 of width and height as 4 big-endian bytes each, then the pixels; null without pixels."""
    head = F.unhex(F.concat(F.lpad(F.hex(_c(width)), 8, "0"), F.lpad(F.hex(_c(height)), 8, "0")))
    return F.sha2(F.concat(head, _c(pixels)), 256)


def box_iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    ax, ay, aw, ah, bx, by, bw, bh = map(_c, (ax, ay, aw, ah, bx, by, bw, bh))
    wide = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    high = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    both = wide * high
    union = aw * ah + bw * bh - both
    return F.when(union > 0, both / union).otherwise(0.0)


def dropped(strategy, checked) -> Column:
    """Whether a duplicate goes under KEEP_ALL, KEEP_CHECKED, REMOVE_CHECKED or REMOVE_ALL."""
    strategy = _c(strategy)
    return F.when(strategy == "KEEP_CHECKED", ~_c(checked)).when(strategy == "REMOVE_CHECKED", _c(checked)).when(strategy == "REMOVE_ALL", True).otherwise(False)


def landmark_columns(landmarks) -> list[Column]:
    """The ten columns of a 5 x 2 array of landmarks."""
    names = ("left_eye", "right_eye", "nose", "left_mouth", "right_mouth")
    return [_c(landmarks)[i][j].alias(f"landmark_{n}_{axis}") for i, n in enumerate(names) for j, axis in enumerate("xy")]
