"""Library queries on the driver's tables, which stand in for those of a photo library: documents or orders for photos, source
for folders, lang for file types, lineitem for faces, orders for clusters, customer for persons, supplier for tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import albums, browse, corrections, dedupe, dml, joins
from .registry import query


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month, CAST(day(o_orderdate) AS BIGINT) AS day, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2, 3")
def timeline_days(t) -> DataFrame:
    return _long(browse.timeline(t.orders, "o_orderdate"), "year", "month", "day")


@query("SELECT count(*) AS n FROM events WHERE event_type = 'click' OR ts IS NULL")
def timeline_undated(t) -> DataFrame:
    shown = t.events.withColumn("at", F.when(F.col("event_type") != "click", F.col("ts")))
    return browse.undated(shown, "at").agg(F.count("*").alias("n"))


@query(
    """SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month, CAST(day(o_orderdate) AS BIGINT) AS day, count(*) AS n,
       CAST(grouping(year(o_orderdate)) * 4 + grouping(month(o_orderdate)) * 2 + grouping(day(o_orderdate)) AS BIGINT) AS level
       FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ROLLUP (year(o_orderdate), month(o_orderdate), day(o_orderdate))"""
)
def timeline_rollup(t) -> DataFrame:
    return _long(browse.timeline_rollup(t.orders, "o_orderdate"), "year", "month", "day")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-04-01'")
def by_month(t) -> DataFrame:
    return browse.taken_in(t.orders, "o_orderdate", 1996, 3).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-12' AND o_orderdate < TIMESTAMP '1996-03-13'")
def by_day(t) -> DataFrame:
    return browse.taken_in(t.orders, "o_orderdate", 1996, 3, 12).select("o_orderkey", "o_custkey")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3' ORDER BY doc_id")
def folder_page(t) -> DataFrame:
    return browse.folder_page(t.documents, "source", "src3", "doc_id").select("doc_id", "lang", "n_chars")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey = 42")
def point_lookup(t) -> DataFrame:
    return browse.point(t.part, "p_partkey", 42).select("p_partkey", "p_name")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal IS NOT NULL AND s_nationkey IS NOT NULL")
def located_photos(t) -> DataFrame:
    return browse.located(t.supplier, "s_acctbal", "s_nationkey").select("s_suppkey", "s_acctbal")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view' OR ts IS NULL")
def null_date_page(t) -> DataFrame:
    return browse.undated(t.events.withColumn("at", F.when(F.col("event_type") != "view", F.col("ts"))), "at").select("event_id", "user_id")


@query("SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_type <> 'click' THEN ts END ASC NULLS LAST, event_id) - 1 AS position FROM events WHERE user_id = 7")
def date_sort_nulls_last(t) -> DataFrame:
    own = t.events.where("user_id = 7").withColumn("at", F.when(F.col("event_type") != "click", F.col("ts")))
    return _long(browse.numbered(own, ["user_id"], [F.asc_nulls_last("at"), "event_id"], "position"), "position").select("event_id", "position")


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def worklist_pending(t) -> DataFrame:
    done = t.documents.join(t.labels.select("doc_id", F.lit(True).alias("hit")), "doc_id", "left").withColumn("done", F.coalesce("hit", F.lit(False)))
    return browse.pending(done, "done").select("doc_id", "source")


@query("SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1")
def worklist_union(t) -> DataFrame:
    return browse.worklist(t.labels.where("quality = 0").select("doc_id"), t.labels.where("toxic = 1").select("doc_id"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT coalesce(l.quality = 1, false)")
def accepted_null_or_false(t) -> DataFrame:
    return browse.unresolved(t.documents.join(t.labels, "doc_id", "left").withColumn("accepted", F.col("quality") == 1), "accepted").select("doc_id")


@query("SELECT p_partkey, p_brand FROM part WHERE lower(p_brand) = lower('bRaNd#12')")
def ci_lookup(t) -> DataFrame:
    return browse.same_name(t.part, "p_brand", "bRaNd#12").select("p_partkey", "p_brand")


@query("SELECT c_name FROM customer WHERE c_name ILIKE 'customer#00000001%' AND c_acctbal > 0 ORDER BY c_name LIMIT 8")
def prefix_suggest(t) -> DataFrame:
    return browse.suggestions(t.customer, "c_name", "customer#00000001", live=F.col("c_acctbal") > 0).select("c_name")


@query("SELECT p_name, p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_name ILIKE 'S%' ORDER BY p_name, p_partkey LIMIT 8")
def used_tag_suggest(t) -> DataFrame:
    used = joins.used_tags(t.part, t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")
    return used.where(F.col("p_name").ilike("S%")).orderBy("p_name", "p_partkey").limit(8).select("p_name", "p_partkey")


@query("SELECT l_orderkey, l_linenumber AS line, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def batch_lookup(t) -> DataFrame:
    ids = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return browse.by_ids(t.lineitem, ids, "l_orderkey").select("l_orderkey", F.col("l_linenumber").alias("line"), "l_partkey")


@query("SELECT doc_id, CAST(position AS BIGINT) AS position, label, value FROM (SELECT doc_id, 0 AS position, 'lang' AS label, lang AS value FROM documents UNION ALL SELECT doc_id, 1, 'source', source FROM documents UNION ALL SELECT d.doc_id, 2, 'quality', CAST(quality AS VARCHAR) FROM documents d JOIN labels USING (doc_id)) WHERE value IS NOT NULL")
def photo_details(t) -> DataFrame:
    return _long(browse.details(t.documents.join(t.labels, "doc_id", "left"), "doc_id", ["lang", "source", "quality"]), "position")


@query("SELECT doc_id, source, floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 4)::BIGINT AS grid_row, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4 AS grid_column FROM documents")
def grid_rows(t) -> DataFrame:
    return _long(browse.rows_of(t.documents.select("doc_id", "source"), ["source"], ["doc_id"], 4), "grid_row", "grid_column")


@query("SELECT doc_id, source, coalesce(lag(doc_id) OVER w, doc_id) AS previous, coalesce(lead(doc_id) OVER w, doc_id) AS next FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def slideshow_neighbours(t) -> DataFrame:
    return browse.neighbours(t.documents.select("doc_id", "source"), ["source"], ["doc_id"], "doc_id")


def _faces(t) -> DataFrame:
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("photo_id"), F.col("l_orderkey").alias("cluster_id"))


def _clusters(t) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person_id"))


@query("SELECT l_orderkey * 10 + l_linenumber AS face_id, o_custkey AS person_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def face_person_snapshot(t) -> DataFrame:
    return joins.face_persons(_faces(t), _clusters(t))


@query(
    """WITH face AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS photo_id, l_orderkey AS cluster_id FROM lineitem),
       person AS (SELECT o_custkey AS id, min(l_orderkey * 10 + l_linenumber) AS cover_face_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 3 = 0 GROUP BY 1)
       SELECT f.id AS face_id, f.photo_id, p.id AS person_id, min(cover.photo_id) AS cover_photo_id FROM face f JOIN orders o ON f.cluster_id = o.o_orderkey JOIN person p ON o.o_custkey = p.id JOIN (SELECT DISTINCT * FROM face) cover ON p.cover_face_id = cover.id GROUP BY ALL"""
)
def photo_persons(t) -> DataFrame:
    owner = joins.face_persons(_faces(t), _clusters(t)).where("person_id % 3 = 0")
    persons = owner.groupBy(F.col("person_id").alias("id")).agg(F.min("face_id").alias("cover_face_id"))
    # Ids repeat in these stand-ins; covers are cut to one row each before the join, not after it.
    covers = _faces(t).groupBy("id").agg(F.min("photo_id").alias("photo_id"))
    return joins.photo_persons(_faces(t), _clusters(t), persons, covers).distinct()


@query("SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS photo_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 13)")
def person_items_semi(t) -> DataFrame:
    return joins.person_faces(_faces(t), _clusters(t), 13).select("id", "photo_id")


_GROUPS = "WITH g AS (SELECT lang, sha256(text) AS hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) >= 2)"


def _photos(t) -> DataFrame:
    return t.documents.withColumn("hash", F.sha2("text", 256)).select("doc_id", "lang", "source", "n_chars", "hash")


@query(_GROUPS + " SELECT d.doc_id, g.first_id, g.n, l.quality::BIGINT AS quality FROM documents d JOIN g ON d.lang = g.lang AND sha256(d.text) = g.hash LEFT JOIN labels l USING (doc_id)")
def group_members_left(t) -> DataFrame:
    out = dedupe.members(_photos(t), ["lang", "hash"], "doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return _long(out, "quality").select("doc_id", "first_id", "n", "quality")


@query("SELECT m.doc_id, count(*) - 1 AS others FROM documents m JOIN documents o ON m.lang = o.lang AND m.text = o.text GROUP BY m.doc_id")
def dup_count_selfjoin(t) -> DataFrame:
    return _others(t)


def _others(t) -> DataFrame:
    own = _photos(t).withColumn("file", F.concat_ws(":", "lang", "hash"))
    return joins.other_members(own, "file").select("doc_id", "others")


@query("SELECT m.doc_id, count(*) - 1 > 0 AS has_duplicates, count(*) - 1 > 1 AS has_several FROM documents m JOIN documents o ON m.lang = o.lang AND m.text = o.text GROUP BY m.doc_id")
def duplicate_flags(t) -> DataFrame:
    flags = dedupe.has_duplicates(_others(t))
    return dedupe.has_duplicates(flags.withColumnRenamed("has_duplicates", "plain"), compat=True).select("doc_id", F.col("plain").alias("has_duplicates"), F.col("has_duplicates").alias("has_several"))


@query("SELECT l_partkey, string_agg(s_name, ',' ORDER BY s_name) AS tags FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey")
def item_tags_nested(t) -> DataFrame:
    pairs = t.lineitem.select("l_partkey", F.col("l_suppkey").alias("s_suppkey")).distinct()
    return joins.tags_of_photos(pairs, t.supplier, "l_partkey", "s_suppkey", "s_name").withColumn("tags", F.array_join("tags", ","))


@query("SELECT l_partkey FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) = 2")
def has_all_tags(t) -> DataFrame:
    return joins.having_all(t.lineitem, "l_partkey", "l_suppkey", [1, 2])


@query("SELECT l_partkey FROM lineitem WHERE l_suppkey = 3 INTERSECT SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 5 = 0")
def filters_intersect(t) -> DataFrame:
    own = t.lineitem.join(t.orders.where("o_custkey % 5 = 0"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return t.lineitem.where("l_suppkey = 3").select("l_partkey").intersect(own.select("l_partkey"))


@query(_GROUPS + " SELECT lang, hash, first_id, n FROM g")
def dup_groups(t) -> DataFrame:
    return dedupe.groups(_photos(t), ["lang", "hash"], "doc_id")


@query("WITH g AS (SELECT lang, text, count(*) AS n, min(source) AS folder_a, max(source) AS folder_b FROM documents GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT source) = 2) SELECT folder_a, folder_b, count(*) AS group_count, CAST(sum(n) AS BIGINT) AS photos FROM g GROUP BY 1, 2")
def dup_folder_pairs(t) -> DataFrame:
    return dedupe.folder_pairs(_photos(t), ["lang", "hash"], "doc_id", "source")


@query(
    """WITH g AS (SELECT lang, text, min(source) AS folder_a, max(source) AS folder_b FROM documents GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT source) = 2)
       SELECT folder_a, folder_b, count(*) FILTER (d.source = folder_a) AS photos_a, count(*) FILTER (d.source = folder_b) AS photos_b,
       CAST(sum(coalesce(n_chars, 0)) FILTER (d.source = folder_a) AS BIGINT) AS bytes_a, CAST(sum(coalesce(n_chars, 0)) FILTER (d.source = folder_b) AS BIGINT) AS bytes_b
       FROM documents d JOIN g USING (lang, text) GROUP BY 1, 2"""
)
def pair_sizes(t) -> DataFrame:
    return dedupe.pair_sizes(_photos(t), ["lang", "hash"], "source", "n_chars")


@query("SELECT lang, sha256(text) AS hash, count(*) AS n, count(DISTINCT source) > 1 AS source_differs, count(DISTINCT n_chars) > 1 AS n_chars_differs FROM documents GROUP BY 1, 2 HAVING count(*) >= 2")
def dup_field_diff(t) -> DataFrame:
    return dedupe.differing(_photos(t), ["lang", "hash"], ["source", "n_chars"])


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 3 = 0 THEN 'REHASH' ELSE 'REUSE' END AS action FROM documents")
def hash_cache_split(t) -> DataFrame:
    cache = t.documents.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("hashed"))
    return dedupe.hash_plan(t.documents, cache, "doc_id", "n_chars", "hashed").select("doc_id", "action")


@query("SELECT doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN 'IMPORTED' WHEN doc_id % 3 = 0 THEN 'UPDATED' ELSE 'SKIPPED_UNCHANGED' END AS outcome FROM documents")
def rescan_classify(t) -> DataFrame:
    found = t.documents.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"))
    known = found.where("path % 4 <> 0").withColumn("size", F.when(F.col("path") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return dml.rescan(known, found).select("path", "outcome")


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 'IMPORTED' WHEN doc_id % 3 = 0 THEN 'UPDATED' ELSE 'SKIPPED_UNCHANGED' END AS outcome FROM documents) GROUP BY 1")
def import_counters(t) -> DataFrame:
    return rescan_classify(t).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT l_partkey, person_id, n FROM (SELECT l_partkey, o_custkey AS person_id, count(*) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, o_custkey) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) WHERE r = 1")
def majority_owner(t) -> DataFrame:
    own = _faces(t).join(_clusters(t).withColumnRenamed("id", "cluster_id"), "cluster_id").withColumnRenamed("photo_id", "l_partkey")
    return joins.majority_owner(own, "l_partkey", "person_id")


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(1970 + o_custkey % 20 AS BIGINT) AS born, count(*) AS n, CAST(year(o_orderdate) - (1970 + o_custkey % 20) AS BIGINT) AS age FROM orders GROUP BY ALL")
def age_by_year(t) -> DataFrame:
    return _long(browse.by_year(t.orders, "o_orderdate", F.lit(1970) + F.col("o_custkey") % 20), "year", "born", "age")


_SESSION = """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS new FROM events),
  s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS event FROM e)"""


@query(_SESSION + " SELECT user_id, event, " + _TS.format("min(ts)") + " AS start, " + _TS.format("max(ts)") + ' AS "end", count(*) AS n, arg_min(event_id, (ts, event_id)) AS cover, ' + "strftime(min(ts), '%Y-%m-%d') AS name FROM s GROUP BY user_id, event HAVING count(*) >= 5")
def event_albums(t) -> DataFrame:
    return _text(_long(albums.event_albums(t.events, ["user_id"], "ts", "event_id"), "event"), "start", "end")


@query(_SESSION + " SELECT user_id, event_id, sort_order FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id, event) AS n, row_number() OVER (PARTITION BY user_id, event ORDER BY ts, event_id) - 1 AS sort_order FROM s) WHERE n >= 5")
def event_album_photos(t) -> DataFrame:
    return _long(albums.event_album_photos(t.events, ["user_id"], "ts", "event_id"), "sort_order").select("user_id", "event_id", "sort_order")


@query(_SESSION + " SELECT user_id, " + _TS.format("min(ts)") + " AS start, " + _TS.format("max(ts)") + ' AS "end", count(*) AS n FROM s GROUP BY user_id, event HAVING count(*) >= 5')
def event_albums_session_window(t) -> DataFrame:
    return _text(albums.event_albums_windowed(t.events, ["user_id"], "ts"), "start", "end")


@query("SELECT floor(c_acctbal / 100000 * 100 + 0.5) / 100 AS cell_lat, floor(c_nationkey / 1000.0::DOUBLE * 100 + 0.5) / 100 AS cell_lon, count(*) AS n, min(c_custkey) AS cover FROM customer GROUP BY 1, 2 HAVING count(*) >= 3")
def location_cells(t) -> DataFrame:
    at = t.customer.select("c_custkey", (F.col("c_acctbal") / 100000).alias("lat"), (F.col("c_nationkey") / F.lit(1000.0)).alias("lon"))
    return albums.location_albums(at, "lat", "lon", "c_custkey")


@query("SELECT person_id, photo_id, row_number() OVER (PARTITION BY person_id ORDER BY photo_id) - 1 AS sort_order FROM (SELECT DISTINCT o_custkey AS person_id, l_partkey AS photo_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def person_albums(t) -> DataFrame:
    own = _faces(t).join(_clusters(t).withColumnRenamed("id", "cluster_id"), "cluster_id")
    return _long(albums.person_albums(own, "person_id", "photo_id"), "sort_order")


@query("SELECT d.doc_id, CAST(CASE WHEN d.doc_id % 2 = 0 THEN 1 ELSE l.quality END AS BIGINT) AS quality, CASE WHEN d.doc_id % 2 = 0 THEN 'AI' ELSE 'USER' END AS origin FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id % 2 = 0 OR l.doc_id IS NOT NULL")
def upsert_rows(t) -> DataFrame:
    old = t.labels.select("doc_id", F.col("quality").cast("long").alias("quality"), F.lit("USER").alias("origin"))
    new = t.documents.where("doc_id % 2 = 0").select("doc_id", F.lit(1).cast("long").alias("quality"), F.lit("AI").alias("origin"))
    return dml.upsert(old, new, ["doc_id"])


@query("SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM labels UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def insert_new(t) -> DataFrame:
    old = _long(t.labels.select("doc_id", "quality"), "quality")
    return dml.insert_new(old, t.documents.select("doc_id", F.lit(-1).cast("long").alias("quality")), ["doc_id"])


@query("WITH f AS (SELECT source, row_number() OVER (ORDER BY source) AS r FROM (SELECT DISTINCT source FROM documents WHERE source < 'src15')), n AS (SELECT source, row_number() OVER (ORDER BY source) + (SELECT max(r) FROM f) AS r FROM (SELECT DISTINCT source FROM documents WHERE NOT source < 'src15')) SELECT source, r AS id FROM f UNION ALL SELECT source, r FROM n")
def find_or_create(t) -> DataFrame:
    folders = t.documents.select("source").distinct()
    old = dml.with_ids(folders.where("source < 'src15'"), ["source"], 0)
    return dml.find_or_create(old, folders, ["source"])


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0)")
def delete_cascade(t) -> DataFrame:
    gone = t.orders.where("o_custkey % 7 = 0")
    left = dml.cascade(gone, "o_orderkey", lineitem=(t.lineitem, "l_orderkey"))["lineitem"]
    return left.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'HOME' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_where(t) -> DataFrame:
    return dml.update_where(t.customer.select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("c_nationkey") == 3, c_mktsegment="HOME").drop("c_nationkey")


@query("SELECT doc_id, CASE WHEN length(text) > 1024 THEN substr(text, 1, 1021) || '...' ELSE text END AS error, substr(text, 1, 20) AS head FROM documents")
def error_texts(t) -> DataFrame:
    return t.documents.select("doc_id", S.ellipsis("text").alias("error"), S.truncated("text", 20).alias("head"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 1 THEN c_custkey + 1 END AS merged_into_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 4 <> 0) AND c_custkey NOT IN (SELECT c_custkey + 1 FROM customer WHERE c_custkey % 10 = 1)")
def orphan_persons(t) -> DataFrame:
    persons = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 1, F.col("c_custkey") + 1).alias("merged_into_id"))
    return corrections.orphans(persons, _clusters(t).where("person_id % 4 <> 0"))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey = 13 THEN 26 ELSE o_custkey END AS person_id FROM orders")
def merge_person(t) -> DataFrame:
    persons = t.customer.select(F.col("c_custkey").alias("id"), F.lit(None).cast("long").alias("merged_into_id"))
    return corrections.merge_persons(persons, _clusters(t), 13, 26)[1]


@query("SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_orderkey * 10 + l_linenumber = 11 THEN NULL ELSE l_orderkey END AS cluster_id, l_orderkey * 10 + l_linenumber = 11 AS excluded FROM lineitem")
def exclude_face(t) -> DataFrame:
    return corrections.exclude(_faces(t).withColumn("excluded", F.lit(False)), 11).select("id", "cluster_id", "excluded")


@query("SELECT l_orderkey AS cluster_id, count(*) AS faces, count(*) FILTER (l_partkey % 3 = 0) AS moved, count(*) = count(*) FILTER (l_partkey % 3 = 0) AS whole FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_partkey % 3 = 0) > 0")
def move_faces(t) -> DataFrame:
    faces = t.lineitem.select(F.xxhash64(*t.lineitem.columns).alias("id"), F.col("l_partkey").alias("photo_id"), F.col("l_orderkey").alias("cluster_id"))
    return corrections.moves(faces, faces.where("photo_id % 3 = 0").select("id").distinct())


@query("WITH RECURSIVE p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 8 <> 0 AND c_custkey + 1 <= (SELECT max(c_custkey) FROM customer) THEN c_custkey + 1 END AS into_id FROM customer), r AS (SELECT id, id AS here, into_id FROM p UNION ALL SELECT r.id, p.id, p.into_id FROM r JOIN p ON r.into_id = p.id) SELECT id, here AS current_id FROM r WHERE into_id IS NULL")
def resolve_redirect(t) -> DataFrame:
    last = t.customer.agg(F.max("c_custkey").alias("last"))
    persons = t.customer.crossJoin(F.broadcast(last)).select(F.col("c_custkey").alias("id"), F.when((F.col("c_custkey") % 8 != 0) & (F.col("c_custkey") + 1 <= F.col("last")), F.col("c_custkey") + 1).alias("merged_into_id"))
    return corrections.resolve_redirects(persons)


@query("SELECT n_name AS name, 1::BIGINT AS depth, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 0, r_name FROM region")
def folder_tree(t) -> DataFrame:
    nodes = t.region.select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("r_name").alias("name"))
    nodes = nodes.union(t.nation.select(F.col("n_nationkey").cast("long"), (F.col("n_regionkey") + 1000).cast("long"), "n_name"))
    out = browse.tree(t.spark, nodes, "id", "parent", "name")
    return _long(out, "depth").select(F.substring_index("path", "/", -1).alias("name"), "depth", "path")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(t) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_SIZE = "CASE WHEN {0} < 1024 THEN printf('%.1f B', {0}::DOUBLE) WHEN {0} < 1048576 THEN printf('%.1f KB', floor({0} / 1024.0::DOUBLE * 10 + 0.5) / 10) WHEN {0} < 1073741824 THEN printf('%.1f MB', floor({0} / 1048576.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1f GB', floor({0} / 1073741824.0::DOUBLE * 10 + 0.5) / 10) END"


@query("SELECT doc_id, CASE WHEN n_chars IS NULL THEN 'unknown' ELSE " + _SIZE.format("(n_chars * n_chars * 37)") + " END AS size FROM documents")
def human_size(t) -> DataFrame:
    return t.documents.select("doc_id", S.human_size(F.col("n_chars") * F.col("n_chars") * 37).alias("size"))


@query(r"SELECT page_id, CASE WHEN instr(url, '.') > 0 THEN lower(regexp_extract(url, '\.([^.]*)$', 1)) ELSE '' END AS ext, regexp_extract(url, '^(.*)[/\\][^/\\]+$', 1) AS parent FROM pages")
def ext_of(t) -> DataFrame:
    return t.pages.select("page_id", S.extension_of("url").alias("ext"), S.parent_of("url").alias("parent"))


@query("SELECT o_orderkey, CAST(((o_orderkey % 4) * 90 - 90 + 360) % 360 AS BIGINT) AS degrees, CAST(CASE o_orderkey % 10 WHEN 3 THEN 180 WHEN 4 THEN 180 WHEN 5 THEN 90 WHEN 6 THEN 90 WHEN 7 THEN 270 WHEN 8 THEN 270 ELSE 0 END AS BIGINT) AS tagged FROM orders")
def rotate_mod(t) -> DataFrame:
    out = t.orders.select("o_orderkey", S.rotated((F.col("o_orderkey") % 4) * 90, -90).alias("degrees"), S.orientation_degrees(F.col("o_orderkey") % 10).alias("tagged"))
    return _long(out, "degrees", "tagged")


@query("SELECT s_suppkey, printf('%.6f° %s, %.6f° %s', abs(s_acctbal), CASE WHEN s_acctbal >= 0 THEN 'N' ELSE 'S' END, abs(s_nationkey::DOUBLE), 'E') AS gps, printf('%.2f', s_nationkey::DOUBLE) AS rate FROM supplier")
def gps_text(t) -> DataFrame:
    return t.supplier.select("s_suppkey", S.gps_text("s_acctbal", F.col("s_nationkey").cast("double")).alias("gps"), S.rate_text("s_nationkey").alias("rate"))


@query(r"""SELECT c_custkey, c_name AS person, p_brand AS tag, 'near ' || c_mktsegment AS text FROM customer JOIN part ON c_custkey = p_partkey""")
def parse_searches(t) -> DataFrame:
    own = t.customer.join(t.part, F.col("c_custkey") == F.col("p_partkey"))
    raw = own.select("c_custkey", F.concat(F.lit('@"'), "c_name", F.lit('" #"'), "p_brand", F.lit('" near '), "c_mktsegment", F.lit(' @" "')).alias("q"))
    return raw.select("c_custkey", F.array_join(S.person_tokens("q"), "|").alias("person"), F.array_join(S.tag_tokens("q"), "|").alias("tag"), S.free_text("q").alias("text"))


@query("SELECT c_custkey, NOT (c_custkey % 3 = 0) AS keep_checked, c_custkey % 3 = 0 AS remove_checked, false AS keep_all, true AS remove_all FROM customer")
def keep_or_drop(t) -> DataFrame:
    checked = F.col("c_custkey") % 3 == 0
    names = ("keep_checked", "remove_checked", "keep_all", "remove_all")
    return t.customer.select("c_custkey", *[S.dropped(F.lit(n.upper()), checked).alias(n) for n in names])


@query("WITH g AS (SELECT lang, text, min(doc_id) AS first_id FROM documents GROUP BY 1, 2 HAVING count(*) >= 2), m AS (SELECT d.doc_id, first_id FROM documents d JOIN g USING (lang, text)) SELECT m.doc_id, m.first_id FROM m WHERE NOT (m.doc_id % 2 = 1) AND m.first_id IN (SELECT first_id FROM m WHERE NOT (doc_id % 2 = 1) GROUP BY 1 HAVING count(*) >= 2)")
def resolve_duplicates(t) -> DataFrame:
    own = dedupe.members(_photos(t), ["lang", "hash"], "doc_id").withColumn("strategy", F.lit("REMOVE_CHECKED")).withColumn("checked", F.col("doc_id") % 2 == 1)
    kept, _ = dedupe.resolve(own, "first_id", "doc_id", F.col("strategy"), "checked", t.documents.select("doc_id"))
    return kept.select("doc_id", "first_id")
