"""Queries that change tables: rows by key, runs, queues and corrections. Embeddings stand in for faces, their labels for clusters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import albums, browse, corrections, dedupe, dml, joins, queue, vectors
from ..operators.index import VectorIndex
from ..operators.numbering import row_numbers
from ..sources import files
from ..sources.tables import checkpointed, fresh_path
from .registry import query


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# Rows by key.


@query("SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) + 100 AS id FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def insert_identity(t) -> DataFrame:
    return dml.with_ids(t.customer.select("c_mktsegment").distinct(), ["c_mktsegment"], 100)


@query("SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'rejected' ELSE d.source END AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 0")
def update_by_key(t) -> DataFrame:
    changes = t.labels.where("quality = 0").select("doc_id", F.lit("rejected").alias("source"))
    return dml.update(t.documents.select("doc_id", "source"), changes, "doc_id", ["source"])


@query("SELECT l_orderkey, l_partkey FROM lineitem x WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P' AND o_orderkey = x.l_orderkey)")
def delete_by_keys(t) -> DataFrame:
    gone = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return dml.delete_keys(t.lineitem.select("l_orderkey", "l_partkey"), gone, ["l_orderkey"])


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 1)")
def run_members(t) -> DataFrame:
    groups = t.orders.select("o_orderkey", (F.col("o_orderkey") % 3).alias("run"))
    return dml.of_run(groups, t.lineitem.select("l_orderkey", "l_partkey"), "run", 1, "o_orderkey", "l_orderkey")[1]


@query("SELECT o_orderkey, CAST(1 AS BIGINT) AS run FROM orders WHERE o_orderkey % 3 = 1")
def run_groups(t) -> DataFrame:
    groups = t.orders.select("o_orderkey", (F.col("o_orderkey") % 3).alias("run"))
    return dml.of_run(groups, t.lineitem.select("l_orderkey", "l_partkey"), "run", 1, "o_orderkey", "l_orderkey")[0]


@query("SELECT doc_id AS group_id, unnest(generate_series(doc_id * 10, doc_id * 10 + doc_id % 4)) AS photo_id FROM documents UNION ALL SELECT doc_id, -doc_id FROM labels")
def insert_members(t) -> DataFrame:
    old = t.labels.select(F.col("doc_id").alias("group_id"), (-F.col("doc_id")).alias("photo_id"))
    new = t.documents.select(F.col("doc_id").alias("group_id"), F.expr("sequence(doc_id * 10, doc_id * 10 + doc_id % 4)").alias("ids"))
    return dml.insert_members(old, new, "group_id", "ids", "photo_id")


@query("SELECT s.name, s.size FROM (VALUES ('large bolt', 1), ('no such part', 2)) s(name, size) WHERE s.name NOT IN (SELECT p_name FROM part) UNION ALL SELECT p_name, CAST(p_size AS INTEGER) FROM part")
def seed_tags(t) -> DataFrame:
    old = t.part.select(F.col("p_name").alias("name"), F.col("p_size").cast("int").alias("size"))
    return dml.insert_new(old, dml.seeds(t.spark, [("large bolt", 1), ("no such part", 2)], "name string, size int"), ["name"])


@query("SELECT doc_id AS path, n_chars AS size, CASE WHEN doc_id % 4 = 0 OR doc_id % 3 = 0 THEN 'COPY' ELSE 'KEEP' END AS action FROM documents")
def copy_plan(t) -> DataFrame:
    source = t.documents.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"))
    target = source.where("path % 4 <> 0").withColumn("size", F.when(F.col("path") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return files.copy_plan(source, target)


@query("SELECT x.doc_id, CASE WHEN y.doc_id IS NOT NULL THEN x.source || '!' ELSE x.source END AS source FROM documents x LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) y USING (doc_id)")
def flushed_updates(t) -> DataFrame:
    """A table after a change set was written and the new table put in its place."""
    changes = t.labels.where("toxic = 1").join(t.documents, "doc_id").select("doc_id", F.concat("source", F.lit("!")).alias("source"))
    return checkpointed(dml.update(t.documents.select("doc_id", "source"), changes, "doc_id", ["source"]), "flushed")


_JOBS = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status"


@query(_JOBS + ", CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN substr(repeat(o_orderpriority, 600), 1, 2048) END AS error_message, CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') END AS ended FROM orders")
def job_rows(t) -> DataFrame:
    """The run table after the end of jobs."""
    jobs = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("RUNNING").alias("status"), F.col("o_orderdate").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("ended_at"), F.lit(None).cast("string").alias("error_message"))
    ended = t.orders.where("o_orderstatus <> 'O'").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("FAILED").alias("status"),
        (F.col("o_orderdate") + F.expr("interval 1 day")).alias("ended_at"),
        F.when(F.col("o_orderstatus") != "F", F.repeat("o_orderpriority", F.lit(600))).alias("error_message"),
    )
    return dml.jobs_ended(jobs, ended).select("id", "status", "error_message", F.date_format("ended_at", "yyyy-MM-dd").alias("ended"))


@query("SELECT coalesce(max(CAST(r_regionkey AS VARCHAR)) FILTER (r_name = 'ASIA'), 'none') AS known, coalesce(max(CAST(r_regionkey AS VARCHAR)) FILTER (r_name = 'MARS'), 'none') AS unknown FROM region")
def preference_default(t) -> DataFrame:
    prefs = t.region.select(F.col("r_name").alias("pref_key"), F.col("r_regionkey").cast("string").alias("pref_value"))
    one = dml.preference(prefs, "ASIA", "none").withColumnRenamed("pref_value", "known")
    return one.crossJoin(F.broadcast(dml.preference(prefs, "MARS", "none").withColumnRenamed("pref_value", "unknown")))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN CASE WHEN length(text) > 1024 THEN substr(text, 1, 1021) || '...' ELSE text END ELSE 'old' END AS error, CAST(CASE WHEN toxic = 1 THEN 4 ELSE 3 END AS BIGINT) AS retries FROM documents LEFT JOIN labels USING (doc_id)")
def mark_errors(t) -> DataFrame:
    photos = t.documents.select("doc_id", F.lit("old").alias("ai_last_error"), F.lit(3).cast("short").alias("ai_retry_count"))
    errors = t.documents.join(t.labels.where("toxic = 1"), "doc_id").select("doc_id", F.col("text").alias("error"))
    return dml.failed(photos, errors, "doc_id").select("doc_id", F.col("ai_last_error").alias("error"), F.col("ai_retry_count").cast("long").alias("retries"))


# The queue.


def _actions(t) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "PENDING").when(F.col("event_type") == "error", "IN_PROGRESS").otherwise("COMPLETED")
    return t.events.select(F.col("event_id").alias("id"), status.alias("status"), (F.col("event_id") % 3).cast("int").alias("retry_count"), F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("next_attempt_at"), F.lit(None).cast("string").alias("last_error"))


_ACTIONS = "WITH a AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'PENDING' WHEN 'error' THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS status, event_id % 3 AS retries, CASE WHEN event_id % 3 <> 0 THEN ts END AS due FROM events)"


@query(_ACTIONS + " SELECT id FROM a WHERE status = 'PENDING' AND (due IS NULL OR due <= TIMESTAMP '2024-01-03 12:00:00')")
def due_actions(t) -> DataFrame:
    return queue.due(_actions(t), datetime(2024, 1, 3, 12)).select("id")


@query(_ACTIONS + " SELECT id, CASE WHEN id % 10 <> 0 THEN CASE WHEN status = 'IN_PROGRESS' THEN 'PENDING' ELSE status END WHEN id % 20 = 0 THEN 'FAILED' WHEN id % 30 = 0 THEN 'PENDING' ELSE 'COMPLETED' END AS status, retries + CASE WHEN id % 30 = 0 AND id % 20 <> 0 THEN 1 ELSE 0 END AS retries, CASE WHEN id % 20 = 0 THEN 'No handler for type' WHEN id % 30 = 0 THEN 'late' END AS error FROM a")
def queue_steps(t) -> DataFrame:
    """The queue after actions were taken up and ended, and what was left in progress was reset."""
    ids = _actions(t).where("id % 10 = 0").select("id")
    taken = queue.started(_actions(t), ids)
    outcomes = ids.select("id", F.when((F.col("id") % 30 == 0) & (F.col("id") % 20 != 0), "late").alias("error"), (F.col("id") % 20 != 0).alias("handled"))
    out = queue.reset(queue.ended(taken, outcomes))
    return out.select("id", "status", F.col("retry_count").cast("long").alias("retries"), F.col("last_error").alias("error"))


@query("""SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS payload, event_type AS kind FROM events""")
def action_payloads(t) -> DataFrame:
    own = t.events.withColumn("payload", queue.payload("event_id", "event_type"))
    back = queue.read_payload("payload", "event_id long, event_type string")
    return own.select("event_id", F.decode("payload", "utf-8").alias("payload"), back["event_type"].alias("kind"))


# Faces, clusters and persons.

_F = "WITH f AS (SELECT vec_id AS id, label::BIGINT AS cluster_id, vec_id % 11 = 0 AS locked, vec_id % 13 = 0 AS excluded, embedding::DOUBLE[] AS e FROM embeddings)"
_MOVED = _F + ", m AS (SELECT *, id % 3 = 0 OR cluster_id = 2 AS moving FROM f), w AS (SELECT cluster_id FROM m GROUP BY 1 HAVING bool_and(moving)), r AS (SELECT id, CASE WHEN moving AND cluster_id NOT IN (SELECT cluster_id FROM w) THEN 500 ELSE cluster_id END AS cluster_id, locked OR moving AS locked, excluded FROM m)"


def _faces(t) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("cluster_id"), (F.col("vec_id") % 11 == 0).alias("assignment_locked"), (F.col("vec_id") % 13 == 0).alias("excluded"), "embedding")


def _clusters(t) -> DataFrame:
    return t.embeddings.select(F.col("label").cast("long").alias("id")).distinct().withColumn("person_id", F.col("id") % 4)


def _moving(t) -> DataFrame:
    return t.embeddings.where("vec_id % 3 = 0 or label = 2").select(F.col("vec_id").alias("id"))


@query(_MOVED + " SELECT id, cluster_id, locked FROM r")
def reassign_faces(t) -> DataFrame:
    return corrections.reassign(_faces(t), _clusters(t), _moving(t), 99, new_cluster_id=500)[0].select("id", "cluster_id", F.col("assignment_locked").alias("locked"))


@query(_MOVED + " SELECT cluster_id AS id, CASE WHEN cluster_id = 500 OR cluster_id IN (SELECT cluster_id FROM w) THEN 99 ELSE cluster_id % 4 END AS person_id, count(*) AS member_count FROM r WHERE NOT excluded GROUP BY ALL")
def reassign_clusters(t) -> DataFrame:
    out = corrections.reassign(_faces(t), _clusters(t), _moving(t), 99, new_cluster_id=500)[1]
    return _long(out.select("id", "person_id", "member_count"), "member_count")


@query(_F + ", m AS (SELECT *, id % 3 = 0 AS moving FROM f WHERE NOT excluded), c AS (SELECT i, avg(e[i]) AS x FROM m, range(1, 65) r(i) WHERE moving GROUP BY i), u AS (SELECT list(x ORDER BY i) AS m0 FROM c), s AS (SELECT id, round(list_dot_product(e, m0) / sqrt(list_dot_product(m0, m0)), 9) AS sim FROM m, u WHERE moving) SELECT CAST(99 AS BIGINT) AS id, 'Ann' AS name, arg_max(id, (sim, -id)) AS cover_face_id FROM s")
def split_person(t) -> DataFrame:
    """The person who is made for faces of several clusters, with the cover that is picked."""
    own = browse.movable(_faces(t).withColumn("assignment_locked", F.lit(False)))
    moving = own.where("id % 3 = 0").select("id")
    none = t.spark.createDataFrame([], "id long, name string, cover_face_id long")
    return corrections.reassign_to_new(own, _clusters(t), none, moving, "Ann", 99, 500)[2]


@query(_F + " SELECT id, CAST(5 AS BIGINT) AS cluster_id, id = (SELECT min(id) FROM f WHERE cluster_id = 5) AS first FROM f WHERE cluster_id = 5")
def relocated_cluster(t) -> DataFrame:
    """Exactly one whole cluster goes to a new person: it keeps its id."""
    moving = _faces(t).where("cluster_id = 5").select("id")
    none = t.spark.createDataFrame([], "id long, name string, cover_face_id long")
    faces, clusters, _ = corrections.reassign_to_new(_faces(t), _clusters(t), none, moving, "Ann", 99, 500)
    own = faces.join(clusters.where("person_id = 99").select(F.col("id").alias("cluster_id")), "cluster_id")
    first = own.agg(F.min("id").alias("least"))
    return own.crossJoin(F.broadcast(first)).select("id", "cluster_id", (F.col("id") == F.col("least")).alias("first"))


@query(_F + " SELECT id, locked OR id = 7 AS locked FROM f")
def confirm_face(t) -> DataFrame:
    return corrections.confirm(_faces(t), 7).select("id", F.col("assignment_locked").alias("locked"))


@query(_F + " SELECT cluster_id AS id, count(*) AS member_count FROM f WHERE NOT excluded AND NOT (id % 2 = 0 OR cluster_id = 3) GROUP BY 1")
def remove_faces(t) -> DataFrame:
    gone = t.embeddings.where("vec_id % 2 = 0 or label = 3").select(F.col("vec_id").alias("id"))
    return _long(corrections.remove_faces(_faces(t), _clusters(t), gone)[1].select("id", "member_count"), "member_count")


@query("SELECT DISTINCT label % 4 AS person_id FROM embeddings WHERE label % 4 IN (1, 3)")
def left_orphans(t) -> DataFrame:
    gone = t.embeddings.where("label % 2 = 1").select(F.col("vec_id").alias("id"))
    return corrections.remove_faces(_faces(t), _clusters(t), gone)[2]


@query(_F + ", m AS (SELECT cluster_id, i, avg(e[i]) AS x FROM f, range(1, 65) r(i) WHERE NOT excluded GROUP BY 1, 2), c AS (SELECT cluster_id, list(x ORDER BY i) AS raw FROM m GROUP BY 1) SELECT c.cluster_id AS id, n AS member_count, round(raw[1] / sqrt(list_dot_product(raw, raw)), 6) AS c1 FROM c JOIN (SELECT cluster_id, count(*) AS n FROM f WHERE NOT excluded GROUP BY 1) USING (cluster_id)")
def recomputed_clusters(t) -> DataFrame:
    out = corrections.recomputed(_clusters(t), _faces(t))
    return out.select("id", F.col("member_count").cast("long").alias("member_count"), F.round(F.element_at("centroid", 1), 6).alias("c1"))


@query("SELECT vec_id AS id, CASE WHEN vec_id = 5 THEN 0 ELSE vec_id % 4 * 90 END AS orientation, vec_id <> 5 AS ai_face_detect_done, vec_id <> 5 AND vec_id % 2 = 0 AS ai_tag_done FROM embeddings")
def rotate_photo(t) -> DataFrame:
    photos = t.embeddings.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 4 * 90).cast("int").alias("orientation"), F.lit(True).alias("ai_face_detect_done"), (F.col("vec_id") % 2 == 0).alias("ai_tag_done"))
    return _long(corrections.rotate(photos, 5, 270), "orientation")


@query("SELECT vec_id AS id, vec_id % 50 AS photo_id FROM embeddings WHERE vec_id % 50 <> 5")
def rotate_clears(t) -> DataFrame:
    photos = t.embeddings.select(F.col("vec_id").alias("id"), F.lit(0).alias("orientation"))
    faces = t.embeddings.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 50).alias("photo_id"))
    return corrections.rotate_and_clear(photos, 5, 90, faces=(faces, "photo_id"))[1]["faces"]


@query("SELECT CAST(n_nationkey AS BIGINT) AS person_id, n_name AS name, s_suppkey AS cluster_id, s_suppkey % 5 AS member_count, coalesce(s_suppkey = 8, false) AS suggested FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey WHERE n_nationkey % 7 <> 1")
def destination_list(t) -> DataFrame:
    persons = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 7 == 1, F.col("n_nationkey") - 1).alias("merged_into_id"))
    clusters = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("person_id"), (F.col("s_suppkey") % 5).alias("member_count"))
    return corrections.destinations(persons, clusters, 8)


@query("SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_nationkey <> 3 AND n_nationkey % 7 <> 1")
def merge_choices(t) -> DataFrame:
    persons = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") % 7 == 1, 0).alias("merged_into_id"))
    return browse.merge_candidates(persons, 3).select("id")


@query("SELECT vec_id AS id, 'unclustered' AS state FROM embeddings WHERE label % 3 = 0 AND vec_id % 13 <> 0 UNION ALL SELECT vec_id, 'movable' FROM embeddings WHERE vec_id % 11 <> 0 AND vec_id % 13 <> 0 UNION ALL SELECT vec_id, 'locked' FROM embeddings WHERE vec_id % 11 = 0 AND vec_id % 13 <> 0")
def face_states(t) -> DataFrame:
    own = _faces(t).withColumn("cluster_id", F.when(F.col("cluster_id") % 3 != 0, F.col("cluster_id")))
    parts = [f(own).select("id", F.lit(n).alias("state")) for f, n in ((browse.unclustered, "unclustered"), (browse.movable, "movable"), (browse.locked, "locked"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT l_orderkey AS id, 'PERSON' AS type FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49) UNION ALL SELECT o_orderkey, 'EVENT' FROM orders WHERE o_orderkey % 2 = 0")
def replaced_albums(t) -> DataFrame:
    old = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "EVENT").otherwise("PERSON").alias("type"))
    new = t.lineitem.where("l_quantity > 49").select(F.col("l_orderkey").alias("id"), F.lit("PERSON").alias("type")).distinct()
    return albums.replaced(old, new, "PERSON")


@query("SELECT lang, sha256(text) AS hash, min(doc_id) AS first_id, count(*) AS n, CASE WHEN lang = 'en' THEN true END AS accepted FROM documents GROUP BY 1, 2 HAVING count(*) >= 2")
def replaced_groups(t) -> DataFrame:
    """The groups of a new run; groups of the old run keep their decision."""
    photos = t.documents.withColumn("hash", F.sha2("text", 256))
    new = dedupe.groups(photos, ["lang", "hash"], "doc_id")
    old = dedupe.groups(photos.where("lang = 'en'"), ["lang", "hash"], "doc_id").withColumn("accepted", F.lit(True))
    return dedupe.replace_groups(old, new, ["lang", "hash"])


# The vector index.


@query("WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT b.vec_id AS id, round(list_dot_product(a.e, b.e), 6) AS sim FROM v a, v b WHERE a.vec_id = 7 AND b.label <> 1 AND b.vec_id % 10 <> 3) SELECT id, sim, row_number() OVER (ORDER BY sim DESC, id) AS rank FROM s ORDER BY sim DESC, id LIMIT 25")
def index_search(t) -> DataFrame:
    """Searches an index after rows were added, merged into cells, deleted and added again."""
    index = VectorIndex(t.spark, fresh_path(t.spark, "index"))
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("person_id"), "embedding")
    index.upsert(rows.where("id % 2 = 0"))
    index.commit()
    index.upsert(rows)
    index.commit()
    index.compact()
    index.delete(rows.where("person_id = 1 or id % 10 = 3 or id % 10 = 4").select("id"))
    index.upsert(rows.where("person_id <> 1 and id % 10 = 4"))
    index.commit()
    wanted = list(t.embeddings.where("vec_id = 7").select("embedding").first()[0])
    return _long(index.search(wanted, 25), "rank")


@query("WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT b.vec_id AS id, round(list_dot_product(a.e, b.e), 6) AS sim FROM v a, v b WHERE a.vec_id = 7 AND b.label = 3) SELECT id, sim, row_number() OVER (ORDER BY sim DESC, id) AS rank FROM s ORDER BY sim DESC, id LIMIT 10")
def index_search_person(t) -> DataFrame:
    index = VectorIndex(t.spark, fresh_path(t.spark, "index"))
    index.upsert(t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("person_id"), "embedding"))
    index.commit()
    index.compact()
    wanted = list(t.embeddings.where("vec_id = 7").select("embedding").first()[0])
    return _long(index.search(wanted, 10, person=3), "rank")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 5 = 0 OR vec_id % 3 = 0")
def stale_tags(t) -> DataFrame:
    tags = t.embeddings.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("embedding"), F.when(F.col("vec_id") % 3 != 0, "v2").otherwise("v1").alias("model_ver"))
    return vectors.stale(tags, "v2").select("id")


@query("SELECT e.vec_id AS id, d.source FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id")
def face_vectors(t) -> DataFrame:
    faces = t.documents.select(F.col("doc_id").alias("id"), "source")
    return joins.vectors_of(faces, t.embeddings.withColumnRenamed("vec_id", "face_id")).select("id", "source")


@query("SELECT page_id, row_number() OVER (ORDER BY url, page_id) AS at FROM pages")
def path_order(t) -> DataFrame:
    return row_numbers(t.pages.select("page_id", "url"), [F.col("url"), F.col("page_id")], "at", 1).drop("url")
