from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from shutterlake.functions import imaging
from shutterlake.functions import scalar as S
from shutterlake.operators import albums, browse, cluster, corrections, dedupe, dml, joins, vectors
from shutterlake.sources import tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scalars(spark):
    lit = F.lit
    got = one(spark, S.half_up(lit(-0.125)), S.human_size(lit(1023)), S.human_size(lit(1024)), S.human_size(lit(None).cast("long")), S.extension_of(lit("a.tar.GZ")), S.extension_of(lit("noext")), S.extension_of(lit(".hidden")), S.rotated(lit(0), -90))
    assert tuple(got) == (-0.12, "1023.0 B", "1.0 KB", "unknown", "gz", "", "hidden", 270)
    got = one(spark, S.trimmed_or_null(lit(" \t ")), S.orientation_degrees(lit(8)), S.orientation_degrees(lit(None).cast("int")), S.pref_double(lit("x"), 0.5), S.pref_boolean(lit("yes"), True), S.gps_text(lit(None).cast("double"), lit(1.0)))
    assert tuple(got) == (None, 270, 0, 0.5, False, "Unknown location")
    zero = one(spark, S.l2_normalize(F.array(lit(0.0), lit(0.0))), S.l2_normalize(F.array(lit(3.0), lit(4.0))))
    assert zero[0] == [0.0, 0.0] and zero[1] == [0.6, 0.8]
    assert one(spark, S.committed_token(lit("sea @an"), lit("Anna")))[0] == 'sea @"Anna" '


def test_search_parser():
    assert S.parse_search('@"Anna" sunset') == S.SearchQuery(("Anna",), (), "sunset")
    assert S.parse_search('#"beach" #"sunset"') == S.SearchQuery((), ("beach", "sunset"), "")
    assert S.parse_search("@ann sunset").text == "@ann sunset"
    assert S.parse_search('@" "') == S.parse_search(None) == S.parse_search("") == S.SearchQuery()


def test_sessions_break_after_the_gap(spark):
    t = datetime(2024, 1, 1)
    at = [t, t + timedelta(hours=6), t + timedelta(hours=12, microseconds=1), t + timedelta(hours=12, microseconds=1), None]
    df = spark.createDataFrame([(i, 1, a) for i, a in enumerate(at)], "id long, who long, at timestamp_ntz")
    assert [r["event"] for r in albums.sessions(df, ["who"], "at", "id").orderBy("id").collect()] == [0, 0, 1, 1]
    assert albums.event_albums(df, ["who"], "at", "id", least=2).count() == albums.event_albums_windowed(df, ["who"], "at", least=2).count() == 2
    assert albums.event_albums(df, ["who"], "at", "id").count() == 0


def test_locations(spark):
    df = spark.createDataFrame([(i, 1.001, 2.0) for i in range(5)] + [(9, 3.0, 3.0), (10, None, 1.0)], "id long, lat double, lon double")
    assert [(r["n"], r["cover"]) for r in albums.location_albums(df, "lat", "lon", "id").collect()] == [(5, 0)]


def test_duplicates(spark):
    rows = [(1, "jpg", "a", "x", 5), (2, "jpg", "a", "y", None), (3, "png", "a", "x", 5), (4, "jpg", "b", "x", 1), (5, "jpg", "b", "y", 1), (6, "jpg", "b", "z", 1), (7, "jpg", None, "z", 1)]
    df = spark.createDataFrame(rows, "id long, ext string, hash string, folder string, size long")
    by = ["ext", "hash"]
    assert {(r["first_id"], r["n"]) for r in dedupe.groups(df, by, "id").collect()} == {(1, 2), (4, 3)}
    assert [tuple(r) for r in dedupe.folder_pairs(df, by, "id", "folder").collect()] == [("x", "y", 1, 2)]
    assert [tuple(r) for r in dedupe.pair_sizes(df, by, "folder", "size").collect()] == [("x", "y", 1, 1, 5, 0)]
    assert {r["hash"]: r["size_differs"] for r in dedupe.differing(df, by, ["size"]).collect()} == {"a": True, "b": False}
    own = dedupe.members(df, by, "id").withColumn("checked", F.col("id") > 1)
    kept, ended = dedupe.resolve(own, "first_id", "id", F.lit("REMOVE_CHECKED"), "checked", df.select("id"))
    assert kept.count() == 0 and ended.count() == 2
    kept, ended = dedupe.resolve(own, "first_id", "id", F.lit("KEEP_CHECKED"), "checked", df.select("id"))
    assert {r["id"] for r in kept.collect()} == {4, 5, 6} and ended.count() == 1


def test_division_and_search(spark):
    tags = spark.createDataFrame([("sea", 1), ("sea", 1), ("sun", 1), ("sea", 2), ("sun", 3)], "name string, id long")
    assert [r["id"] for r in joins.having_all(tags, "id", "name", ["sea", "sun"]).collect()] == [1]
    assert joins.having_all(tags, "id", "name", []).count() == 0
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "id long, v array<double>")
    assert [r["id"] for r in vectors.nearest(v, "id", "v", [1.0, 0.0], 9).collect()] == [1, 2, 3]
    run = lambda q, k=2, **o: [r["id"] for r in vectors.search(S.parse_search(q), v, "id", "v", tags, tags, lambda _: [1.0, 0.0], k, **o).orderBy("rank").collect()]
    assert run('@"SEA"') == [2, 1] and run('@"nobody" x') == [] and run("x") == [1, 2] and run('#"sun" x') == [1, 3] and run('#"sun" x', 1, overfetch=1) == [1] and run("") == []
    assert [r["id"] for r in vectors.similar_items(v, "id", "v", 1, 5).orderBy("rank").collect()] == [2, 3]
    old = spark.createDataFrame([(1, 1, "USER", 0.5)], "tag_id long, photo_id long, tag_source string, confidence double")
    new = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.7)], "tag_id long, photo_id long, confidence double")
    assert {tuple(r) for r in vectors.upsert_tags(old, new).collect()} == {(1, 1, "AI", 0.9), (2, 1, "AI", 0.7)}
    assert {tuple(r) for r in vectors.upsert_tags(old, new, compat=True).collect()} == {(1, 1, "AI", 0.5), (2, 1, "AI", 0.7)}


def test_greedy_is_strict_and_ordered(spark):
    c = np.cos(np.arccos(0.4))
    rows = [(1, [1.0, 0.0]), (2, [0.4, float(np.sqrt(1 - 0.16))]), (3, [1.0, 0.0]), (4, None)]
    got = {r["id"]: (r["cluster_id"], r["seeded"]) for r in cluster.greedy(spark.createDataFrame(rows, "id long, embedding array<double>"), None, threshold=0.4).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False)} and abs(c - 0.4) < 1e-9


def test_recluster_keeps_locked_faces(spark):
    rows = [(1, [1.0, 0.0], True, 7, 70), (2, [0.9, 0.1], False, 8, 80), (3, [0.0, 1.0], False, 8, 80), (4, [0.1, 0.99], False, None, None), (5, [-1.0, 0.0], False, None, None), (6, None, False, None, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, locked boolean, cluster_id long, person_id long")
    got = {r["id"]: (r["cluster_id"], r["person_id"]) for r in cluster.recluster(df).collect()}
    assert got[1][0] == got[2][0] == 7 and got[3] == got[4] and got[3][1] == 80 and got[5] == got[6] == (None, None)


def test_kmeans_against_plain_loop(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at, own = x[:4].copy(), np.zeros(60, int)
    for _ in range(20):
        new = (x @ at.T).argmax(axis=1)
        if (new == own).all():
            break
        own = new
        for c in range(4):
            if (own == c).any():
                at[c] = x[own == c].sum(axis=0) / np.linalg.norm(x[own == c].sum(axis=0))
    got = cluster.spherical_kmeans(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>"), k=4).orderBy("id").collect()
    assert [r["cluster"] for r in got] == own.tolist()


def test_corrections(spark):
    faces = spark.createDataFrame([(1, 10, False, False, [1.0, 0.0]), (2, 10, False, False, [0.0, 1.0]), (3, 11, False, False, [1.0, 0.0])], "id long, cluster_id long, assignment_locked boolean, excluded boolean, embedding array<double>")
    clusters = spark.createDataFrame([(10, 100), (11, 101)], "id long, person_id long")
    f, c = corrections.reassign(faces, clusters, spark.createDataFrame([(1,), (3,)], "id long"), 200, new_cluster_id=50)
    assert {(r["id"], r["cluster_id"], r["assignment_locked"]) for r in f.collect()} == {(1, 50, True), (2, 10, False), (3, 11, True)}
    assert {(r["id"], r["person_id"], r["member_count"]) for r in c.collect()} == {(10, 100, 1), (11, 200, 1), (50, 200, 1)}
    _, left, orphans = corrections.remove_faces(faces, clusters, faces.select("id"))
    assert left.count() == 0 and {r["person_id"] for r in orphans.collect()} == {100, 101}
    persons = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 4)], "id long, merged_into_id long")
    assert {r["id"]: r["current_id"] for r in corrections.resolve_redirects(persons).collect()} == {1: 3, 2: 3, 3: 3, 4: None, 5: None}


def test_changes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, x string")
    assert {tuple(r) for r in dml.upsert(old, new, ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in dml.insert_new(old, new, ["id"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}
    assert {tuple(r) for r in dml.update(old, new, "id", ["x"]).collect()} == {(1, "a"), (2, "c")}
    path = str(tmp_path / "t.parquet")
    tables.replace_table(old, path)
    tables.replace_table(dml.upsert(spark.read.parquet(path), new, ["id"]), path)
    assert spark.read.parquet(path).count() == 3
    assert dml.preference(spark.createDataFrame([("a", "1")], "pref_key string, pref_value string"), "b", "x").first()[0] == "x"


def test_images(spark):
    x = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert imaging.invariant_hash(x) == imaging.invariant_hash(np.rot90(x)) != imaging.invariant_hash(x[:, ::-1])
    assert imaging.invariant_hash(x, True) == imaging.invariant_hash(x[:, ::-1], True)
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, 0.9), (1, 0.1, 0.0, 1.0, 1.0, 0.8), (1, 5.0, 5.0, 1.0, 1.0, 0.7)], "photo_id long, x double, y double, w double, h double, confidence double")
    assert {r["confidence"] for r in imaging.suppress(boxes).collect()} == {0.9, 0.7}
    a = np.array([[0, 0], [1, 0], [0, 1], [1, 1], [2, 1]], float)
    r = np.array([[0.0, -2.0], [2.0, 0.0]])
    assert np.allclose(imaging.similarity_transform(a, a @ r.T + 3), np.column_stack([r, [3, 3]]))


def test_browse(spark):
    df = spark.createDataFrame([(1, datetime(2024, 2, 29, 23)), (2, datetime(2024, 3, 1)), (3, None)], "id long, at timestamp_ntz")
    assert [r["id"] for r in browse.taken_in(df, "at", 2024, 2).collect()] == [1] == [r["id"] for r in browse.taken_in(df, "at", 2024, 2, 29).collect()]
    assert browse.undated(df, "at").count() == 1 and browse.timeline(df, "at").count() == 2
