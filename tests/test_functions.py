"""Boxes, landmarks, alignment, tokens and clustering against plain loops."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.functions import bpe, imaging
from shutterlake.functions import scalar as S
from shutterlake.functions.bpe import PairTokenizer
from shutterlake.operators import albums, cluster, corrections, vectors


def test_suppression_against_plain_loops(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k % 7), *map(float, rng.random(2)), *map(float, 0.2 + rng.random(2) * 0.3), round(float(rng.random()), 2)) for k in range(200)]

    def iou(a, b):
        w = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
        both = max(0, w) * max(0, h)
        return both / (a[3] * a[4] + b[3] * b[4] - both)

    want = []
    for photo in range(7):
        kept = []
        for r in sorted((r for r in rows if r[0] == photo), key=lambda r: (-r[5], r[1], r[2])):
            if all(iou(r, k) <= 0.4 for k in kept):
                kept.append(r)
        want += kept
    df = spark.createDataFrame(rows, "photo_id long, x double, y double, w double, h double, confidence double")
    assert sorted(map(tuple, imaging.suppress(df).collect())) == sorted(want)
    one = spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip("abcdefgh", (0.0, 0.0, 2.0, 2.0, 1.0, 1.0, 2.0, 2.0))])
    assert one.select(S.box_iou(*"abcdefgh")).first()[0] == pytest.approx(1 / 7)


def test_anchors():
    got = imaging.anchors(40, 20)
    want = []
    for step, sizes in ((8, (16, 32)), (16, (64, 128)), (32, (256, 512))):
        for y in range(math.ceil(20 / step)):
            for x in range(math.ceil(40 / step)):
                want += [((x + 0.5) * step / 40, (y + 0.5) * step / 20, s / 40, s / 20) for s in sizes]
    assert np.allclose(got, want)


def test_faces_are_freed_of_the_padding():
    # An image of 1000 x 500 in a square of 200: scale 0.2, padded by 50 above and below.
    scale, x, y, w, h = imaging.padded_fit(1000, 500, 200)
    assert (scale, x, y, w, h) == (0.2, 0, 50, 200, 100)
    prior = np.array([[0.5, 0.5, 0.2, 0.2], [0.1, 0.3, 0.5, 0.5], [0.9, 0.9, 0.1, 0.1]])
    points = np.zeros((3, 10))
    points[0, :2] = (1.0, -1.0)
    boxes, marks = imaging.decode_faces(prior, np.array([[1.0, 0, 0, 0], [0, 0, math.log(2) / 0.2, 0], [0, 0, 0, 0]]), points, np.array([0.9, 0.8, 0.79]), 1000, 500, 200)
    # Centre 0.52 * 200 = 104 and 100 in the square, so 520 and 250 in the image; 200 pixels wide and high.
    assert np.allclose(boxes[0], [0.42, 0.3, 0.2, 0.4, 0.9]) and np.allclose(marks[0, 0], [520, 230]) and np.allclose(marks[0, 1], [500, 250])
    # The second is twice as wide as its anchor, and clamped to the image.
    assert len(boxes) == 2 and np.allclose(boxes[1], [0.0, 0.0, 0.6, 0.6, 0.8])
    with pytest.raises(ValueError):
        imaging.decode_faces(prior, prior[:2], points, np.ones(3), 10, 10, 10)


def test_similarity_transform():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, t = rng.normal(size=(5, 2)), rng.normal(size=2)
        turn, scale = rng.uniform(-3, 3), rng.uniform(0.1, 5)
        r = scale * np.array([[math.cos(turn), -math.sin(turn)], [math.sin(turn), math.cos(turn)]])
        assert np.allclose(imaging.similarity_transform(a, a @ r.T + t), np.column_stack([r, t]))
    # A mirror image gets the best rotation, never a reflection.
    m = imaging.similarity_transform(a, a * [-1, 1])
    assert np.linalg.det(m[:, :2]) > 0


def test_tokens():
    t = PairTokenizer({"l": 1, "o": 2, "w</w>": 3, "lo": 4, "low</w>": 5, "Ã": 6, "©</w>": 7, "1</w>": 8, "!</w>": 9, "_": 10, "!_</w>": 11}, [("l", "o"), ("lo", "w</w>"), ("!", "_</w>")], 90, 91, length=8)
    assert t.encode("Low low") == [90, 5, 5, 91, 0, 0, 0, 0] and t.encode(None) == [90, 91, 0, 0, 0, 0, 0, 0]
    assert t.encode("  é ") == [90, 6, 7, 91, 0, 0, 0, 0]  # two bytes, each by its symbol
    assert t.encode("11")[:4] == [90, 8, 8, 91] and t.encode("!_")[:3] == [90, 11, 91]  # numbers one by one, other characters together
    assert t.encode("<|startoftext|>low<|endoftext|>")[:5] == [90, 90, 5, 91, 91]
    assert t.encode("low " * 20) == [90, *[5] * 6, 91]
    assert len(set(bpe.byte_symbols())) == 256 and bpe.byte_symbols()[32] == "Ġ" and bpe.byte_symbols()[65] == "A"


def test_tokens_like_a_public_byte_level_vocabulary():
    """Merging by rank gives what the library's own byte-level model gives, piece by piece."""
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    with open(path) as f:
        model = json.load(f)["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    own = PairTokenizer(model["vocab"], merges, 0, 0, length=10_000, joined_end=True)
    bare = tokenizers.Tokenizer(tokenizers.models.BPE(vocab=model["vocab"], merges=merges))
    for word in ("hello", "straße", "internationalisation", "日本", "zzzqx"):
        symbols = "".join(bpe.byte_symbols()[b] for b in word.encode())
        # The public vocabulary has no end marks, so pieces are compared without.
        parts = list(symbols)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: own.rank.get((parts[i], parts[i + 1]), len(own.rank)))
            if (parts[best], parts[best + 1]) not in own.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert parts == bare.encode(symbols).tokens


def greedy(rows, seeds, threshold):
    """Faces in order, each with the most similar centroid above the threshold or a new one; centroids run."""
    at, sizes, ids, out = [np.array(v) for _, v, _ in seeds], [n for *_, n in seeds], [c for c, *_ in seeds], {}
    new = max(ids, default=0)
    for i, v in rows:
        sims = [float(c @ v) for c in at]
        best = int(np.argmax(sims)) if sims else -1
        if best >= 0 and sims[best] > threshold:
            c = (at[best] * sizes[best] + v) / (sizes[best] + 1)
            at[best], sizes[best] = c / np.linalg.norm(c), sizes[best] + 1
        else:
            new, best = new + 1, len(at)
            at.append(v)
            sizes.append(1)
            ids.append(new)
        out[i] = ids[best]
    return out


def faces(n, seed, groups=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, 6))
    x = centre[rng.integers(0, groups, n)] + rng.normal(size=(n, 6)) * 0.6
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_greedy_against_plain_loop(spark):
    x = faces(150, 5)
    seeds = [(3, x[0].tolist(), 4), (8, x[1].tolist(), 1)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(7)
    known = spark.createDataFrame(seeds, "id long, centroid array<double>, member_count int")
    got = {r["id"]: r["cluster_id"] for r in cluster.incremental(df, known, 0.7).collect()}
    assert got == greedy(list(enumerate(x)), seeds, 0.7) and len(set(got.values())) > 5


def test_recluster_against_plain_loops(spark):
    x = faces(120, 6)
    locked, before, owner = {i: i % 2 + 1 for i in range(0, 120, 15)}, {i: 1 + i % 4 for i in range(0, 120, 3)}, {i: 100 + i % 4 for i in range(0, 120, 3)}
    before |= locked
    rows = [(i, v.tolist(), i in locked, before.get(i), owner.get(i)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, locked boolean, cluster_id long, person_id long")
    out = cluster.recluster(df, 0.6)
    got = {r["id"]: (r["cluster_id"], r["person_id"]) for r in out.collect()}

    unit = lambda v: v / np.linalg.norm(v)
    base = max(before.values())
    seeds = [(c, unit(sum(x[i] for i in locked if locked[i] == c)).tolist(), sum(1 for i in locked if locked[i] == c)) for c in sorted(set(locked.values()))]
    # A seed of no faces only holds the place from which new ids count.
    state, new = locked | {}, base
    at, sizes, ids = [np.array(s[1]) for s in seeds], [s[2] for s in seeds], [s[0] for s in seeds]
    for i in range(120):
        if i in locked:
            continue
        sims = [float(c @ x[i]) for c in at]
        best = int(np.argmax(sims))
        if sims[best] > 0.6:
            at[best], sizes[best] = unit(at[best] * sizes[best] + x[i]), sizes[best] + 1
        else:
            new, best = new + 1, len(at)
            at.append(x[i])
            sizes.append(1)
            ids.append(new)
        state[i] = ids[best]
    for _ in range(5):
        names = sorted(set(state.values()))
        means = np.array([unit(sum(x[i] for i in state if state[i] == c)) for c in names])
        moved = {}
        for i in state:
            sims = means @ x[i]
            moved[i] = state[i] if i in locked or sims.max() <= 0.6 else names[int(sims.argmax())]
        if moved == state:
            break
        state = moved
    size = {c: sum(1 for v in state.values() if v == c) for c in state.values()}
    want = {}
    for i in range(120):
        c = state[i]
        if size[c] < 2 and c > base:
            want[i] = (None, None)
            continue
        votes = [owner[j] for j in state if state[j] == c and j in owner]
        want[i] = (c, min(set(votes), key=lambda p: (-votes.count(p), p)) if votes else None)
    assert got == want
    cover = {r["person_id"]: r["cover_face_id"] for r in cluster.covers(out, df).collect()}
    for person, face in cover.items():
        clusters = [c for c, p in want.values() if p == person]
        largest = min(set(clusters), key=lambda c: (-clusters.count(c), c))
        own = [i for i in want if want[i][0] == largest]
        middle = unit(sum(x[i] for i in own))
        assert face == min(own, key=lambda i: (-round(float(x[i] @ middle), 9), i))


def test_top_prototypes_in_blocks(spark, monkeypatch):
    x, p = faces(60, 7), faces(23, 8)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, v array<double>")
    tags = spark.createDataFrame([(f"t{j:02d}", v.tolist()) for j, v in enumerate(p)] + [("none", None)], "tag string, tv array<double>")
    want = {(i, k + 1): f"t{j:02d}" for i, v in enumerate(x) for k, j in enumerate(sorted(range(23), key=lambda j: (-round(float(p[j] @ v), 6), j))[:4])}
    for most in (8192, 6):
        monkeypatch.setattr(vectors, "MOST_VECTORS", most)
        assert {(r["id"], r["rank"]): r["tag"] for r in vectors.zero_shot(items, tags, "id", "v", "tag", "tv", 4).collect()} == want
        near = vectors.nearest_to(items, items.where("id % 4 = 0"), "id", "v", 3).collect()
        assert {(r["query"], r["rank"]): r["id"] for r in near} == {(i, k + 1): j for i in range(0, 60, 4) for k, j in enumerate(sorted((j for j in range(60) if j != i), key=lambda j: (-round(float(x[j] @ x[i]), 6), j))[:3])}
    plan = vectors.zero_shot(items, tags, "id", "v", "tag", "tv")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "Exchange" not in plan


def test_sessions_of_a_whole_table(spark):
    rng = np.random.default_rng(9)
    minutes = np.cumsum(rng.choice([5, 100, 360, 361, 900], 400)).tolist()
    rows = [(i, m) for i, m in enumerate(minutes)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, m long").select("id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m, 0)").alias("at")).repartition(6)
    got = {r["id"]: r["event"] for r in albums.sessions(df, [], "at", "id").collect()}
    event, want = 0, {0: 0}
    for i in range(1, 400):
        event += minutes[i] - minutes[i - 1] > 360
        want[i] = event
    assert got == want


def test_long_chains_of_merges(spark):
    n = 700
    rows = [(i, i + 1 if i < n else None) for i in range(n + 1)] + [(2000, 2001), (2001, 2002), (2002, 2000), (3000, 9999), (4000, 4000)]
    got = {r["id"]: r["current_id"] for r in corrections.resolve_redirects(spark.createDataFrame(rows, "id long, merged_into_id long")).collect()}
    assert got == {i: n for i in range(n + 1)} | {k: None for k in (2000, 2001, 2002, 3000, 4000)}


def test_no_break_space_in_a_token(spark):
    got = spark.range(1).select(S.caret_token(F.lit("sea @anna ma")).alias("t"), S.relative_path(F.lit("/a/b/c"), F.lit("/a/")), S.relative_path(F.lit("/ab/c"), F.lit("/a"))).first()
    assert (got["t"]["marker"], got["t"]["prefix"], got[1], got[2]) == ("@", "anna ma", "b/c", None)
