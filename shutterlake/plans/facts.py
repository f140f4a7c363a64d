"""Queries of scalar functions and of pages: texts, sizes, dates, hashes, orders and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import imaging
from ..functions import scalar as S
from ..operators import browse, dedupe, dml, joins, vectors
from .registry import query


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# Texts.


@query(r"SELECT doc_id, nullif(regexp_replace(chr(9) || ' ' || substr(text, 1, doc_id % 3) || chr(10), '^\s+|\s+$', '', 'g'), '') AS trimmed FROM documents")
def trimmed_texts(t) -> DataFrame:
    raw = F.concat(F.lit("\t "), F.expr("substr(text, 1, int(doc_id % 3))"), F.lit("\n"))
    return t.documents.select("doc_id", S.trimmed_or_null(raw).alias("trimmed"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '@' ELSE '' END AS marker, CASE WHEN c_custkey % 2 = 0 THEN substr(c_name, 1, 5) ELSE '' END AS prefix, CASE WHEN c_custkey % 2 = 0 THEN 'sea @\"' || c_name || '\" ' ELSE 'sea ' || substr(c_name, 1, 5) END AS committed FROM customer")
def caret_tokens(t) -> DataFrame:
    typed = F.concat(F.lit("sea "), F.when(F.col("c_custkey") % 2 == 0, "@").otherwise(""), F.substring("c_name", 1, 5))
    token = S.caret_token(typed)
    return t.customer.select("c_custkey", token["marker"].alias("marker"), token["prefix"].alias("prefix"), S.committed_token(typed, "c_name").alias("committed"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, 'Person #' || c_custkey) AS label FROM customer")
def display_names(t) -> DataFrame:
    return t.customer.select("c_custkey", S.display_name(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")), "Person", "c_custkey").alias("label"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '/' || doc_id || '.txt' END AS inside, '/lib|/lib/' || source AS above FROM documents")
def relative_paths(t) -> DataFrame:
    path = F.concat(F.lit("/lib/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    root = F.when(F.col("doc_id") % 2 == 0, F.lit("/lib/")).otherwise(F.lit("/li"))
    folders = F.filter(S.ancestors_of(S.parent_of(path)), lambda x: x != "")
    return t.documents.select("doc_id", S.relative_path(path, root).alias("inside"), F.array_join(folders, "|").alias("above"))


_PREF = "CASE c_custkey % 4 WHEN 0 THEN '15' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'x' END"


@query(f"SELECT c_custkey, coalesce(try_cast({_PREF} AS DOUBLE), 0.5) AS d, CAST(coalesce(try_cast({_PREF} AS INTEGER), 7) AS BIGINT) AS i, coalesce(lower({_PREF}) = 'true', true) AS b FROM customer")
def preference_types(t) -> DataFrame:
    value = F.when(F.col("c_custkey") % 4 == 0, "15").when(F.col("c_custkey") % 4 == 1, "TRUE").when(F.col("c_custkey") % 4 == 2, "x")
    return t.customer.select("c_custkey", S.pref_double(value, 0.5).alias("d"), S.pref_int(value, 7).cast("long").alias("i"), S.pref_boolean(value, True).alias("b"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN '{"Exif":{' || CASE WHEN doc_id % 2 = 0 THEN '"Lang":"' || lang || '",' ELSE '' END || '"Source":"' || source || '"},"File":{"Size":"' || n_chars || '"}}' END AS extra FROM documents WHERE lang IS NOT NULL""")
def exif_texts(t) -> DataFrame:
    tag = lambda d, name, value: F.struct(F.lit(d).alias("directory"), F.lit(name).alias("tag"), value.cast("string").alias("description"))
    all_tags = F.array(tag("Exif", "Make", F.col("source")), tag("Exif", "Lang", F.col("lang")), tag("Exif", "Source", F.col("source")), tag("File", "Size", F.col("n_chars")))
    entries = F.when(F.col("doc_id") % 5 == 0, F.slice(all_tags, 1, 1)).when(F.col("doc_id") % 2 == 0, all_tags).otherwise(F.filter(all_tags, lambda e: e["tag"] != "Lang"))
    return t.documents.where("lang is not null").select("doc_id", S.exif_json(entries, ["Make"]).alias("extra"))


# Dates and sizes.


@query("SELECT event_id, strftime(CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN ts + INTERVAL 1 HOUR ELSE ts + INTERVAL 2 HOUR END, '%Y-%m-%d %H:%M:%S') AS date, CASE event_id % 3 WHEN 0 THEN 'EXIF_ORIGINAL' WHEN 1 THEN 'EXIF_DIGITIZED' ELSE 'FILESYSTEM' END AS source FROM events")
def capture_dates(t) -> DataFrame:
    k = F.col("event_id") % 3
    date, source = S.capture_date(F.when(k == 0, F.col("ts")), F.when(k < 2, F.col("ts") + F.expr("interval 1 hour")), F.col("ts") + F.expr("interval 2 hours"))
    return t.events.select("event_id", F.date_format(date, "yyyy-MM-dd HH:mm:ss").alias("date"), source.alias("source"))


@query("SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 1000 AS ms FROM events")
def durations(t) -> DataFrame:
    before = browse.before(t.events, ["user_id"], ["ts", "event_id"], "ts")
    return before.select("event_id", S.duration_ms("before", "ts").alias("ms"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN n_chars WHEN doc_id % 3 = 1 THEN doc_id END AS width, CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE doc_id * 2 END AS height FROM documents")
def dimension_chain(t) -> DataFrame:
    first = (F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")))
    second = (F.when(F.col("doc_id") % 3 == 1, F.col("doc_id")), F.col("doc_id") * 2)
    width, height = S.dimensions(first, second)
    return t.documents.select("doc_id", width.alias("width"), height.alias("height"))


_WH = "WITH p AS (SELECT doc_id, n_chars % 4000 + 1 AS w, doc_id % 3000 + 1 AS h FROM documents)"
_CROP = _WH + ", c AS (SELECT doc_id, CASE WHEN w < h THEN 224 ELSE w * 224 // h END AS w, CASE WHEN w < h THEN h * 224 // w ELSE 224 END AS h FROM p)"


def _sides(t) -> DataFrame:
    return t.documents.select("doc_id", (F.col("n_chars") % 4000 + 1).alias("w"), (F.col("doc_id") % 3000 + 1).alias("h"))


@query(_CROP + " SELECT doc_id, w::BIGINT AS width, h::BIGINT AS height, greatest(0, (w - 224) // 2)::BIGINT AS x, greatest(0, (h - 224) // 2)::BIGINT AS y, least(224, w)::BIGINT AS crop_width, least(224, h)::BIGINT AS crop_height FROM c")
def cropped_sizes(t) -> DataFrame:
    out = _sides(t).select("doc_id", S.cropped_size("w", "h").alias("c")).select("doc_id", "c.*")
    return _long(out, *out.columns[1:])


@query(_WH + ", s AS (SELECT *, least(1200 / w, 1200 / h) AS scale FROM p), r AS (SELECT *, floor(w * scale + 0.5)::BIGINT AS width, floor(h * scale + 0.5)::BIGINT AS height FROM s) SELECT doc_id, scale, width, height, (1200 - width) // 2 AS pad_x, (1200 - height) // 2 AS pad_y FROM r")
def padded_sizes(t) -> DataFrame:
    out = _sides(t).select("doc_id", S.padded_size("w", "h").alias("p")).select("doc_id", "p.*")
    return _long(out, "width", "height", "pad_x", "pad_y")


@query(_WH + ", s AS (SELECT *, least(1.0::DOUBLE, 512 / greatest(w, h)) AS k FROM p) SELECT doc_id, greatest(1, floor(w * k + 0.5)::BIGINT) AS width, greatest(1, floor(h * k + 0.5)::BIGINT) AS height FROM s")
def thumbnail_sizes(t) -> DataFrame:
    width, height = S.fitted_size("w", "h")
    return _long(_sides(t).select("doc_id", width.alias("width"), height.alias("height")), "width", "height")


# Hashes and vectors.


@query("SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN sha256(unhex(printf('%08x%08x', doc_id % 5000, n_chars)) || encode(text)) END AS hash FROM documents")
def pixel_hashes(t) -> DataFrame:
    pixels = F.when(F.col("doc_id") % 7 != 0, F.encode("text", "utf-8"))
    return t.documents.select("doc_id", S.pixel_hash(F.col("doc_id") % 5000, "n_chars", pixels).alias("hash"))


@query("SELECT vec_id, CAST(len(embedding) * 4 AS BIGINT) AS bytes, round(embedding[1]::DOUBLE, 9) AS first, round(embedding[64]::DOUBLE, 9) AS last FROM embeddings")
def packed_vectors(t) -> DataFrame:
    packed = t.embeddings.select("vec_id", imaging.pack_vector("embedding").alias("p"))
    back = packed.select("vec_id", F.length("p").cast("long").alias("bytes"), imaging.unpack_vector("p").alias("v"))
    return back.select("vec_id", "bytes", F.round(F.element_at("v", 1).cast("double"), 9).alias("first"), F.round(F.element_at("v", 64).cast("double"), 9).alias("last"))


_LANDMARKS = [f"landmark_{n}_{a}" for n in ("left_eye", "right_eye", "nose", "left_mouth", "right_mouth") for a in "xy"]


@query("SELECT vec_id, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 9) AS {n}" for i, n in enumerate(_LANDMARKS)) + " FROM embeddings")
def landmarks(t) -> DataFrame:
    points = F.array(*[F.array(*[F.round(F.element_at("embedding", 2 * i + j + 1).cast("double"), 9) for j in range(2)]) for i in range(5)])
    return t.embeddings.select("vec_id", points.alias("points")).select("vec_id", *S.landmark_columns("points"))


@query("WITH v AS (SELECT vec_id, vec_id % 9 AS n, embedding::DOUBLE[] AS e, list_reverse(embedding::DOUBLE[]) AS c FROM embeddings), r AS (SELECT vec_id, list_transform(generate_series(1, 64), lambda i: (c[i] * n + e[i]) / (n + 1)) AS x FROM v) SELECT vec_id, round(x[1] / sqrt(list_dot_product(x, x)), 6) AS first, round(x[40] / sqrt(list_dot_product(x, x)), 6) AS other FROM r")
def running_centroids(t) -> DataFrame:
    at = S.running_centroid(F.reverse("embedding"), F.col("vec_id") % 9, "embedding")
    return t.embeddings.select("vec_id", at.alias("c")).select("vec_id", F.round(F.element_at("c", 1), 6).alias("first"), F.round(F.element_at("c", 40), 6).alias("other"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT b.vec_id, round(list_dot_product(a.e, b.e), 6) AS sim FROM v a, v b WHERE a.vec_id = 11) SELECT vec_id, sim, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM s ORDER BY sim DESC, vec_id LIMIT 15")
def search_by_text(t) -> DataFrame:
    encode = lambda text: list(t.embeddings.where(F.col("vec_id") == len(text)).select("embedding").first()[0])
    return _long(vectors.semantic_search(t.embeddings, "vec_id", "embedding", "eleven char", encode, 15), "rank")


# Pages and lists.


@query("SELECT x.vec_id, d.source, r AS rank FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) AS r FROM embeddings WHERE label = 3) x JOIN documents d ON d.doc_id = x.vec_id * 3")
def ranked_page(t) -> DataFrame:
    """Ranked ids looked up; those without a row drop out."""
    ids = browse.numbered(t.embeddings.where("label = 3").withColumn("g", F.lit(0)), ["g"], [F.desc("vec_id")], "r").select("vec_id", (F.col("vec_id") * 3).alias("doc_id"), (F.col("r") + 1).cast("long").alias("rank"))
    return joins.in_order(ids, t.documents.select("doc_id", "source").join(ids.select("doc_id", "vec_id"), "doc_id"), "doc_id", "rank").select("vec_id", "source", "rank")


@query("SELECT p.p_partkey, t.tags, n.lines, s.first_supplier FROM part p LEFT JOIN (SELECT l_partkey AS k, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS tags FROM lineitem WHERE l_quantity > 40 GROUP BY 1) t ON t.k = p.p_partkey LEFT JOIN (SELECT l_partkey AS k, count(*) AS lines FROM lineitem WHERE l_tax = 0 GROUP BY 1) n ON n.k = p.p_partkey LEFT JOIN (SELECT l_partkey AS k, min(l_suppkey) AS first_supplier FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) s ON s.k = p.p_partkey WHERE p.p_size < 10")
def enriched_page(t) -> DataFrame:
    line = t.lineitem.withColumnRenamed("l_partkey", "p_partkey")
    tags = line.where("l_quantity > 40").groupBy("p_partkey").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), "").alias("tags"))
    counts = line.where("l_tax = 0").groupBy("p_partkey").agg(F.count("*").alias("lines"))
    first = line.where("l_discount > 0.05").groupBy("p_partkey").agg(F.min("l_suppkey").alias("first_supplier"))
    return joins.enriched(t.part.where("p_size < 10").select("p_partkey"), "p_partkey", tags, counts, first)


@query("WITH p AS (SELECT doc_id, source FROM documents WHERE lang = 'de') SELECT p.doc_id, t.tags, (SELECT count(*) FROM p) AS shown FROM p LEFT JOIN (SELECT doc_id, string_agg(tag, ', ' ORDER BY tag) AS tags FROM (SELECT doc_id, 'good' AS tag FROM labels WHERE quality = 1 UNION SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1) GROUP BY 1) t USING (doc_id)")
def shown_photos(t) -> DataFrame:
    tags = t.labels.where("quality = 1").select("doc_id", F.lit("good").alias("tag")).unionByName(t.labels.where("toxic = 1").select("doc_id", F.lit("toxic").alias("tag")))
    return joins.shown(t.documents.where("lang = 'de'").select("doc_id"), tags, "doc_id", "tag")


@query("WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS lang FROM documents) SELECT doc_id, lang, dense_rank() OVER (ORDER BY lang NULLS LAST) - 1 AS group_at, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS at FROM x")
def arranged_list(t) -> DataFrame:
    own = t.documents.select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"))
    return _long(browse.arranged(own, "lang", ["doc_id"]), "group_at", "at")


@query("WITH g AS (SELECT lang, text, min(source) AS a, max(source) AS b FROM documents GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT source) = 2), p AS (SELECT a AS folder_a, b AS folder_b, count(*) AS group_count FROM g GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY group_count DESC, folder_a, folder_b) - 1 AS at FROM p")
def ranked_folder_pairs(t) -> DataFrame:
    photos = t.documents.withColumn("hash", F.sha2("text", 256))
    return dedupe.ranked_pairs(dedupe.folder_pairs(photos, ["lang", "hash"], "doc_id", "source").drop("photos"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 0 THEN true ELSE false END AS cached FROM documents")
def thumbnails_present(t) -> DataFrame:
    photos = t.documents.select(F.col("doc_id").alias("id"))
    path = F.concat(F.lit("/cache/"), F.col("doc_id").cast("string"))
    known = t.documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("photo_id"), F.when(F.col("doc_id") % 9 != 1, path).alias("cache_path"))
    return joins.with_files(photos, known, t.documents.where("doc_id % 4 <> 0").select(path.alias("path")))


@query("SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1)")
def missing_brands(t) -> DataFrame:
    return dml.missing(t.part, t.part.where("p_size = 1"), ["p_brand"])


@query("SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels")
def set_difference(t) -> DataFrame:
    return dml.delete_keys(t.documents.where("lang = 'en'").select("doc_id"), t.labels, ["doc_id"])
