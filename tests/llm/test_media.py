"""Sequences of made pages, and every column of the report against plain Python."""

import hashlib
import time
import zlib

import numpy as np

from shutterlake.llm import media
from shutterlake.llm.queries import op10_media_columns

FOLDER = "/root/testdata/sf0.001"


def short(page):
    return [i["text"] if i["kind"] == "text" else (i["digest"], i["caption"]) for i in media.sequence(page)]


def test_sequences():
    for page, want in {
        '<p>a &amp; <b>b</b></p><img src="x.png" alt="pic"><p>c</p>': ["a & b", ("x.png", "pic"), "c"],
        '<figure><img src="1.png" alt="one"><p>Between.</p><img src="2.png"><figcaption>Both <i>of</i> them</figcaption></figure>after': [("1.png", "Both of them"), "Between.", ("2.png", "Both of them"), "after"],
        '<figure><figcaption>Above</figcaption><img src="two words.png"></figure>': [("two words.png", "Above")],
        '<img data-src="lazy.png" src="real.png"><img data-src="only.png">': [("real.png", None), ("only.png", None)],
        '<img srcset="a.png 1x, b.png 2x">': [("a.png", None)],
        '<video src="v.mp4" title="A film">No video here.</video>': [("v.mp4", "A film")],
        '<audio><source src="a.ogg"><source src="a.mp3">fallback</audio>': [("a.ogg", None)],
        '<picture><source srcset="big.webp"><img src="small.png" alt="p"></picture>': [("small.png", "p")],
        '<object data="o.svg">text</object><embed src="e.swf">': [("o.svg", None), ("e.swf", None)],
        '<p>one<br>two</p><script>x = "<img src=no.png>"</script><!-- <img src=no.png> -->': ["one two"],
        '<figure><figure><img src="in.png"><figcaption>inner</figcaption></figure><img src="out.png"></figure>': [("in.png", "inner"), ("out.png", None)],
        "<div>a<div>b</div>c": ["a", "b", "c"],
    }.items():
        assert short(page) == want, page
        assert [i["position"] for i in media.sequence(page)] == list(range(len(want)))
    assert media.sequence(None) == media.sequence("") == []


def test_unclosed_figures_take_time_in_proportion():
    began = time.process_time()
    assert len(media.sequence("<figure><img src=x>" * 20_000)) == 20_000
    assert time.process_time() - began < 10


def feature(payload):
    n = len(payload)
    mean = sum(payload) / n
    std = (sum((x - mean) ** 2 for x in payload) / n) ** 0.5
    cells = [payload[k * n // 64 : (k + 1) * n // 64] for k in range(64)]
    bits = "".join("1" if sum(c) / len(c) >= mean else "0" for c in cells)
    return f"24x{n // 24};mean={mean:.4f};std={std:.4f};ahash={int(bits, 2):016x}"


def held(r, text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    image = media.png(payload)
    assert media.samples(image).tobytes() == payload
    assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(image), hashlib.sha256(image).hexdigest(), feature(payload))


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = op10_media_columns(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        held(r, docs[r["doc_id"]])


def test_made_rows(spark, monkeypatch):
    from shutterlake.llm import shared

    monkeypatch.setattr(shared, "LEAST_HOT", 3)
    texts = [None, "", "é" * 288, "x" * 576, "x" * 577, "y" * 900_000] + ["same"] * 20
    docs = spark.createDataFrame([(k % 9, t, "d", b"m") for k, t in enumerate(texts)], "doc_id long, text string, digest string, media binary")
    got = media.report(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        held(r, next(t for k, t in enumerate(texts) if k % 9 == r["doc_id"] and len((t or "").encode()) == r["n_bytes"]))
    assert media.report(docs.limit(0)).count() == 0


def test_references_without_payloads(spark):
    pages = spark.createDataFrame([(1, '<img src="sha256:aa"><img src="sha256:cc">'), (2, None)], "doc_id long, html string")
    known = spark.createDataFrame([("aa", 5), ("bb", 6)], "digest string, payload_bytes long")
    items = media.sequences(pages)
    assert sorted((r["doc_id"], r["position"], r["digest"], r["payload_bytes"]) for r in media.resolve(items, known).collect()) == [(1, 0, "aa", 5), (1, 1, "cc", None)]
    assert [r["digest"] for r in media.unreferenced(items, known).collect()] == ["bb"]


def test_damaged_image():
    image = bytearray(media.png(bytes(576)))
    image[50] ^= 1
    try:
        media.samples(bytes(image))
    except (ValueError, zlib.error):
        return
    raise AssertionError("damage not seen")


def test_samples_are_the_payload():
    rng = np.random.default_rng(3)
    for n in (1, 3, 50):
        payload = rng.integers(0, 256, 576 * n, dtype=np.uint8).tobytes()
        assert media.samples(media.png(payload)).tobytes() == payload
