"""Vector queries: embeddings stand in for photos and faces, normalised label means for tags and prototypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import albums, cluster, vectors
from .registry import query

_V = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_C = """, m AS (SELECT label, i, avg(e[i]) AS x FROM v, range(1, 65) r(i) GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS raw FROM m GROUP BY label),
 u AS (SELECT label, [x / sqrt(list_dot_product(raw, raw)) FOR x IN raw] AS centroid FROM c)"""


def _queries(t) -> DataFrame:
    """A stated query set: every fiftieth vector."""
    return t.embeddings.where("vec_id % 50 = 0")


def _tags(t) -> DataFrame:
    return albums.centroids(t.embeddings, "label", "embedding").withColumn("label", F.col("label").cast("long"))


def _vector(t, vec_id: int) -> list[float]:
    return list(t.embeddings.where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


@query(_V + ", s AS (SELECT a.vec_id AS query, b.vec_id, round(list_dot_product(a.e, b.e), 6) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10")
def similar_items(t) -> DataFrame:
    return _long(vectors.nearest_to(t.embeddings, _queries(t), "vec_id", "embedding", 10), "rank")


@query(_V + ", s AS (SELECT b.vec_id, round(list_dot_product(a.e, b.e), 6) AS sim FROM v a, v b WHERE a.vec_id = 7) SELECT vec_id, sim, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM s ORDER BY sim DESC, vec_id LIMIT 50")
def semantic_topk(t) -> DataFrame:
    return _long(vectors.nearest(t.embeddings, "vec_id", "embedding", _vector(t, 7), 50), "rank")


@query(_V + ", s AS (SELECT b.vec_id, round(list_dot_product(a.e, b.e), 6) AS sim FROM v a, v b WHERE a.vec_id = 7 AND b.label = 3) SELECT vec_id, sim, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM s ORDER BY sim DESC, vec_id LIMIT 10")
def filtered_topk_exact(t) -> DataFrame:
    return _long(vectors.filtered_nearest(t.embeddings, "vec_id", "embedding", _vector(t, 7), 10, t.embeddings.where("label = 3")), "rank")


@query(_V + ", s AS (SELECT b.vec_id, b.label, round(list_dot_product(a.e, b.e), 6) AS sim FROM v a, v b WHERE a.vec_id = 7 ORDER BY sim DESC, b.vec_id LIMIT 50) SELECT vec_id, sim, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM s WHERE label = 3 ORDER BY sim DESC, vec_id LIMIT 10")
def filtered_topk_overfetch(t) -> DataFrame:
    return _long(vectors.filtered_nearest(t.embeddings, "vec_id", "embedding", _vector(t, 7), 10, t.embeddings.where("label = 3"), overfetch=5), "rank")


@query(_V + ", s AS (SELECT b.vec_id, round(list_dot_product(a.e, b.e), 6) AS sim FROM v a, v b WHERE a.vec_id = 7 AND b.vec_id IN (SELECT doc_id FROM documents WHERE source = 'src1' OR source = 'src5' OR lang = 'de') AND b.label IN (2, 3, 5)) SELECT vec_id, sim, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM s ORDER BY sim DESC, vec_id LIMIT 20")
def search_combined(t) -> DataFrame:
    """Persons: labels; tags: groups of documents with the same id."""
    parsed = S.parse_search('@"team" #"CHOSEN" number 7')
    persons = t.embeddings.where("label in (2, 3, 5)").select(F.lit("Team").alias("name"), "vec_id")
    tags = t.documents.where("source = 'src1' or source = 'src5' or lang = 'de'").select(F.lit("chosen").alias("name"), F.col("doc_id").alias("vec_id"))
    encode = lambda text: _vector(t, int(text.rsplit(" ", 1)[1]))
    return _long(vectors.search(parsed, t.embeddings, "vec_id", "embedding", persons, tags, encode, 20), "rank")


@query("SELECT vec_id, CAST(NULL AS DOUBLE) AS sim, row_number() OVER (ORDER BY vec_id DESC) AS rank FROM embeddings WHERE label = 3")
def search_filters_only(t) -> DataFrame:
    persons = t.embeddings.select(F.concat(F.lit("label "), F.col("label").cast("string")).alias("name"), "vec_id")
    return _long(vectors.search(S.parse_search('@"Label 3"'), t.embeddings, "vec_id", "embedding", persons, persons, None, 20), "rank")


@query(_V + _C + ", s AS (SELECT vec_id, u.label AS tag, round(list_dot_product(e, centroid), 6) AS sim FROM v, u), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, tag) AS rank FROM s) SELECT vec_id, tag::BIGINT AS tag, sim, rank FROM r WHERE rank <= 5")
def zero_shot_tags(t) -> DataFrame:
    tags = _tags(t).withColumnRenamed("label", "tag")
    return _long(vectors.zero_shot(t.embeddings, tags, "vec_id", "embedding", "tag", "centroid"), "rank")


@query(_V + _C + " SELECT label::BIGINT AS label, round(centroid[1], 6) AS c1, round(centroid[32], 6) AS c32, round(centroid[64], 6) AS c64 FROM u")
def centroids(t) -> DataFrame:
    at = lambda i: F.round(F.element_at("centroid", i), 6).alias(f"c{i}")
    return _tags(t).select("label", at(1), at(32), at(64))


@query(_V + _C + ", s AS (SELECT v.label, vec_id, round(list_dot_product(e, centroid), 9) AS sim FROM v JOIN u ON v.label = u.label) SELECT label::BIGINT AS label, arg_max(vec_id, (sim, -vec_id)) AS vec_id, round(max(sim), 6) AS sim FROM s GROUP BY label")
def most_central(t) -> DataFrame:
    return _long(albums.most_central(t.embeddings, "label", "embedding", "vec_id"), "label").withColumn("sim", F.round("sim", 6))


@query(_V + _C + " SELECT v.label::BIGINT AS label, round(avg(list_dot_product(e, centroid)), 6) AS mean_similarity, count(*) AS n, min(vec_id) AS cover FROM v JOIN u ON v.label = u.label GROUP BY 1 HAVING count(*) >= 10 AND avg(list_dot_product(e, centroid)) >= 0.1")
def intra_sim(t) -> DataFrame:
    out = albums.coherent(t.embeddings, "label", "embedding", "vec_id", least_similarity=0.1)
    return _long(out, "label").withColumn("mean_similarity", F.round("mean_similarity", 6))


@query(_V + _C + ", s AS (SELECT vec_id, u.label AS prototype, round(list_dot_product(e, centroid), 6) AS sim FROM v, u) SELECT vec_id, arg_max(prototype, (sim, -prototype))::BIGINT AS prototype, max(sim) AS sim FROM s GROUP BY vec_id")
def best_prototype(t) -> DataFrame:
    return vectors.best_prototype(t.embeddings, _tags(t).withColumnRenamed("label", "prototype"), "vec_id", "embedding", "prototype", "centroid")


@query("SELECT vec_id AS tag_id, vec_id % 7 AS photo_id, CASE WHEN vec_id % 2 = 0 THEN 'AI' ELSE 'USER' END AS tag_source, CASE WHEN vec_id % 2 = 0 THEN 0.9::DOUBLE ELSE 0.5 END AS confidence FROM embeddings")
def upsert_partial(t) -> DataFrame:
    old = t.embeddings.select(F.col("vec_id").alias("tag_id"), (F.col("vec_id") % 7).alias("photo_id"), F.lit("USER").alias("tag_source"), F.lit(0.5).alias("confidence"))
    return vectors.upsert_tags(old, old.where("tag_id % 2 = 0").withColumn("confidence", F.lit(0.9)))


def _items(t) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding")


@query()
def incremental_cluster(t) -> DataFrame:
    return cluster.incremental(_items(t), threshold=0.3)


@query()
def full_recluster(t) -> DataFrame:
    faces = _items(t).withColumns({"locked": F.col("id") % 25 == 0, "cluster_id": F.when(F.col("id") % 5 == 0, F.col("id") % 10 + 1), "person_id": F.when(F.col("id") % 5 == 0, F.col("id") % 10 + 100)})
    return cluster.recluster(faces, threshold=0.3)


@query()
def spherical_kmeans(t) -> DataFrame:
    return cluster.spherical_kmeans(_items(t))
