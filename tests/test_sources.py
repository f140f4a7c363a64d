"""Image files, copies, batched rows and the vector index."""

import hashlib
import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.functions import imaging
from shutterlake.operators import numbering
from shutterlake.operators.index import VectorIndex
from shutterlake.sources import files, photos, tables


def directory(entries, after=0, at=8):
    """A little-endian directory of (tag, type, count, raw value) and its data, as they stand at an offset."""
    head, data, end = struct.pack("<H", len(entries)), b"", at + 2 + 12 * len(entries) + 4
    for tag, kind, count, raw in entries:
        if len(raw) <= 4:
            head += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
        else:
            head += struct.pack("<HHII", tag, kind, count, end + len(data))
            data += raw
    return head + struct.pack("<I", after) + data


def text(tag, value):
    return tag, 2, len(value) + 1, value.encode() + b"\0"


def exif(original=True, preview=b"", size=(800, 600), south=True):
    """A TIFF structure with EXIF and GPS directories, and a preview."""
    own = [(0xA002, 4, 1, struct.pack("<I", size[0])), (0xA003, 4, 1, struct.pack("<I", size[1]))] if size else []
    own += [text(0xA434, " 50mm "), (0x829A, 5, 1, struct.pack("<II", 1, 250))]
    own += [text(0x9003, "2023:06:15 14:30:00")] if original else []
    own += [text(0x9004, "2023:06:16 09:00:00")]
    place = [text(1, "S" if south else "N"), (2, 5, 3, struct.pack("<6I", 33, 1, 52, 1, 1092, 100)), text(3, "E"), (4, 5, 3, struct.pack("<6I", 151, 1, 12, 1, 36, 1)), (5, 1, 1, b"\0"), (6, 5, 1, struct.pack("<II", 125, 2))]

    def whole(a, b, c, d):
        main = [text(0x10F, "Canon"), text(0x110, "  "), (0x112, 3, 1, struct.pack("<H", 6)), (0x8769, 4, 1, struct.pack("<I", a)), (0x8825, 4, 1, struct.pack("<I", b))]
        parts = [b"II*\0\x08\0\0\0", directory(main, c), directory(own, at=a), directory(place, at=b)]
        parts.append(directory([(0x201, 4, 1, struct.pack("<I", d)), (0x202, 4, 1, struct.pack("<I", len(preview)))], at=c) if preview else b"")
        return parts

    sizes = np.cumsum([len(p) for p in whole(0, 0, 0, 0)]).tolist()
    return b"".join(whole(sizes[1], sizes[2], sizes[3] if preview else 0, sizes[4])) + preview


def jpeg(exif_data=b"", size=(640, 480)):
    app = b"\xff\xe1" + struct.pack(">H", len(exif_data) + 8) + b"Exif\0\0" + exif_data if exif_data else b""
    return b"\xff\xd8" + app + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, size[1], size[0], 0) + b"\xff\xd9"


def test_metadata(spark, tmp_path):
    small = jpeg(size=(16, 12))
    named = {
        "a/with.JPG": jpeg(exif(preview=small)),
        "a/digitised.jpeg": jpeg(exif(original=False, size=None, south=False), (1024, 768)),
        "b/no.jpg": jpeg(),
        "b/plain.png": imaging.encode_png(np.zeros((240, 320, 3), np.uint8)),
        "b/broken.jpg": b"# not an image",
        "raw.cr2": exif(preview=small, size=None),
        "notes.txt": b"skipped",
    }
    for name, content in named.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = photos.scan(spark, str(tmp_path), with_content=True)
    assert found.count() == 6 and {r["extension"] for r in found.select("extension").collect()} == {"jpg", "jpeg", "png", "cr2"}
    got = {r["path"].rsplit("/", 1)[1]: r for r in photos.metadata(found).collect()}
    r = got["with.JPG"]
    assert (r["width"], r["height"], r["capture_date"], r["capture_date_source"], r["orientation"]) == (800, 600, datetime(2023, 6, 15, 14, 30), "EXIF_ORIGINAL", 90)
    assert (r["camera_make"], r["camera_model"], r["lens_model"], bytes(r["preview"])) == ("Canon", None, "50mm", small)
    assert abs(r["gps_lat"] + 33.8697) < 1e-4 and abs(r["gps_lon"] - 151.21) < 1e-9 and r["gps_altitude"] == 62.5
    assert r["exif_extra"] == '{"Exif SubIFD":{"Exposure Time":"1/250"},"GPS":{"GPS Latitude Ref":"S","GPS Latitude":"33 52 1092/100","GPS Longitude Ref":"E","GPS Longitude":"151 12 36","GPS Altitude Ref":"0","GPS Altitude":"125/2"}}'
    r = got["digitised.jpeg"]
    assert (r["width"], r["height"], r["capture_date"], r["capture_date_source"]) == (1024, 768, datetime(2023, 6, 16, 9), "EXIF_DIGITIZED") and r["gps_lat"] > 0 and r["preview"] is None
    for name, size in (("no.jpg", (640, 480)), ("plain.png", (320, 240)), ("broken.jpg", (None, None))):
        r = got[name]
        assert (r["width"], r["height"]) == size and r["capture_date_source"] == "FILESYSTEM" and r["capture_date"] is not None
        assert (r["orientation"], r["camera_make"], r["exif_extra"], r["preview"], r["gps_lat"]) == (0, None, None, None, None)
    assert (got["raw.cr2"]["width"], got["raw.cr2"]["height"], got["raw.cr2"]["preview"]) == (16, 12, None)


def test_header_of_damaged_files():
    whole = jpeg(exif(preview=b"x" * 30))
    for n in range(0, len(whole), 3):
        photos.header(whole[:n])
    assert photos.header(b"II*\0\xff\xff\xff\x7f") == {}
    assert photos.header(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 320, 240) + b"\x08\2\0\0\0") == {"own_width": 320, "own_height": 240}


def test_png_filters():
    rng = np.random.default_rng(2)
    for c in (1, 2, 3, 4):
        image = rng.integers(0, 256, (7, 9, c), dtype=np.uint8)
        assert (imaging.decode_png(imaging.encode_png(image)) == image).all()
        lines = b""
        for y in range(7):  # each line with another filter, by the definition
            kind, row, up = y % 5, image[y].reshape(-1).astype(int), (image[y - 1].reshape(-1) if y else np.zeros(9 * c)).astype(int)
            left, corner = np.concatenate([np.zeros(c, int), row[:-c]]), np.concatenate([np.zeros(c, int), up[:-c]])
            near = [min((a, b, d), key=lambda v: abs(a + b - d - v)) for a, b, d in zip(left.tolist(), up.tolist(), corner.tolist())]
            add = (0 * row, left, up, (left + up) // 2, np.array(near))[kind]
            lines += bytes([kind]) + ((row - add) & 255).astype(np.uint8).tobytes()
        made = imaging.PNG
        for kind, part in ((b"IHDR", struct.pack(">IIBBBBB", 9, 7, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)), (b"IDAT", zlib.compress(lines)), (b"IEND", b"")):
            made += struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
        assert (imaging.decode_png(made) == image).all()
    assert imaging.decode_png(b"no") is None and imaging.decode_png(imaging.PNG) is None


def test_thumbnails(spark, tmp_path):
    image = np.arange(600 * 300 * 3, dtype=np.uint32).astype(np.uint8).reshape(300, 600, 3)
    rows = [("/lib/a/x.png", bytearray(imaging.encode_png(image)), None, 0), ("/lib/y.png", bytearray(imaging.encode_png(image[:4, :8])), None, 0), ("/lib/z.cr2", bytearray(b"raw"), bytearray(imaging.encode_png(image[:4, :8])), 90), ("/lib/bad.jpg", bytearray(b"x"), None, 0)]
    got = imaging.decoded(spark.createDataFrame(rows, "path string, content binary, preview binary, degrees int"))
    by = {r["path"]: r for r in got.collect()}
    assert (by["/lib/a/x.png"]["width"], by["/lib/a/x.png"]["height"]) == (600, 300) and by["/lib/bad.jpg"]["pixels"] is None
    assert (by["/lib/z.cr2"]["width"], by["/lib/z.cr2"]["height"]) == (4, 8)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # a second run replaces the files
        made = {r["path"]: r for r in imaging.write_thumbnails(got, "/lib", cache, 64).collect()}
    assert {p: (r["width"], r["height"]) for p, r in made.items()} == {"/lib/a/x.png": (64, 32), "/lib/y.png": (8, 4), "/lib/z.cr2": (4, 8)}
    assert made["/lib/a/x.png"]["cache_path"] == f"{tmp_path}/cache/a/x.png.png"
    assert (imaging.decode_png((tmp_path / "cache/y.png.png").read_bytes()) == image[:4, :8]).all()
    assert sorted(p.name for p in (tmp_path / "cache").rglob("*.p*")) == ["x.png.png", "y.png.png", "z.cr2.png"]
    assert imaging.shrunk(np.full((5, 5, 1), 7, np.uint8), 2).tolist() == [[[7], [7]], [[7], [7]]]


def digest(rows, head):
    return hashlib.sha256(head + bytes(x for row in rows for pixel in row for x in pixel)).hexdigest()


def test_invariant_hashes(spark):
    rng = np.random.default_rng(3)
    for h, w in ((2, 4), (3, 3), (5, 1)):
        image = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        rows = image.tolist()
        turn = lambda r: [list(x) for x in zip(*r[::-1])]
        turned = [rows, turn(rows), turn(turn(rows)), turn(turn(turn(rows)))]
        flipped = [[row[::-1] for row in v] for v in turned]
        size = lambda v: struct.pack(">ii", len(v[0]), len(v))
        assert imaging.invariant_hash(image) == min(digest(v, size(v)) for v in turned)
        assert imaging.invariant_hash(image, True) == min(digest(v, struct.pack(">ii", max(h, w), min(h, w))) for v in turned + flipped)
    df = spark.createDataFrame([(1, 4, 2, 1, bytearray(range(8))), (2, 2, 4, 1, bytearray(np.rot90(np.arange(8).reshape(2, 4)).astype(np.uint8).tobytes())), (3, None, None, None, None)], "id long, width int, height int, channels int, pixels binary")
    got = {r["id"]: r["hash"] for r in imaging.invariant_hashes(df).collect()}
    assert got[1] == got[2] and got[3] is None


def test_copies(spark, tmp_path):
    (tmp_path / "from/x").mkdir(parents=True)
    (tmp_path / "to").mkdir()
    for name, size in (("x/a", 5), ("b", 6), ("c", 0)):
        (tmp_path / "from" / name).write_bytes(b"n" * size)
    (tmp_path / "to/b").write_bytes(b"n" * 6)
    listing = lambda rows: spark.createDataFrame(rows, "path string, size long")
    plan = files.copy_plan(listing([("x/a", 5), ("b", 6), ("c", 0)]), listing([("b", 6), ("x/a", 4)]))
    assert {r["path"]: r["action"] for r in plan.collect()} == {"x/a": "COPY", "b": "KEEP", "c": "COPY"}
    done = files.copy(plan, f"file://{tmp_path}/from", f"file://{tmp_path}/to").collect()
    assert {r["path"]: r["bytes"] for r in done} == {"x/a": 5, "c": 0} and (tmp_path / "to/x/a").read_bytes() == b"nnnnn"


def test_row_buffer(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    with files.RowBuffer(spark, path, "id long", batch=3) as buffer:
        buffer.add((1,), (2,))
        assert len(buffer.rows) == 2 and not (tmp_path / "rows").exists()
        buffer.add((3,), (4,))
        assert buffer.rows == [] and spark.read.parquet(path).count() == 4
        buffer.flush()
        buffer.add((5,))
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5]

    class Broken(files.RowBuffer):
        def write(self, rows):
            raise OSError("no room")

    buffer = Broken(spark, path, "id long", batch=2)
    with pytest.raises(OSError):
        buffer.add((6,), (7,))
    assert buffer.rows == [(6,), (7,)] and spark.read.parquet(path).count() == 5


def test_replace_table(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    for k in range(3):
        old = spark.read.parquet(path) if k else spark.range(0)
        tables.replace_table(old.unionByName(spark.range(k, k + 1)), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2] and len(list(tmp_path.glob("t.parquet*"))) == 1


def test_row_numbers(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(6)
    got = numbering.row_numbers(df, [F.desc("x")], "n", 5).collect()
    assert sorted((r["n"], r["x"]) for r in got) == [(5 + k, 999 - k) for k in range(1000)]
    assert numbering.row_numbers(df.limit(0), [F.col("x")], "n").count() == 0


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    x = centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = VectorIndex(spark, f"file://{tmp_path}/index")
    rows = spark.createDataFrame([(i, i % 5 if i % 7 else None, v.tolist()) for i, v in enumerate(x)], "id long, person_id long, embedding array<double>")
    assert index.search(x[0].tolist(), 3).count() == 0
    index.upsert(rows)
    assert index.rows().count() == 0
    index.commit()
    index.compact()
    live, person = {i: v for i, v in enumerate(x)}, {i: i % 5 if i % 7 else None for i in range(300)}

    def held(q, k, of=None):
        sims = sorted((-round(float(q @ v), 6), i) for i, v in live.items() if of is None or person[i] == of)[:k]
        assert [r["id"] for r in index.search(q.tolist(), k, of).orderBy("rank").collect()] == [i for _, i in sims]

    held(x[3], 10)
    held(x[3], 10, 2)
    assert len(index.cells) == 17
    index.delete(rows.where("id % 3 = 0").select("id"))
    index.upsert(spark.createDataFrame([(1, 2, x[4].tolist()), (900, 2, x[3].tolist())], "id long, person_id long, embedding array<double>"))
    index.commit()
    live = {i: v for i, v in live.items() if i % 3} | {1: x[4], 900: x[3]}
    person |= {1: 2, 900: 2}
    held(x[3], 10)
    held(x[3], 50, 2)
    again = VectorIndex(spark, f"file://{tmp_path}/index")
    assert again.rows().count() == len(live)
    index.compact()
    held(x[5], 10)
    assert index.search(x[3].tolist(), 4, 2, overfetch=1).count() <= 4
    index.delete(rows.select("id"))
    index.commit()
    index.compact()
    assert [r["id"] for r in index.rows().collect()] == [900]
