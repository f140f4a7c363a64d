"""Vector search, tagging and the combined search. Ranking is by similarity (to six digits), then by the lower key.

Sets of query vectors and of prototypes are held by each task as a matrix of at most ``MOST_VECTORS`` rows and multiplied with
batches of the other side; a larger set goes through in blocks of that size, one after the other. No pairs are made as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import SearchQuery, dot
from ..sources.tables import checkpointed
from .joins import having_all
from .numbering import row_numbers

MOST_VECTORS = 8192


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column without nulls, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _blocks(df: DataFrame, key: str, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    """(keys in order, their vectors) of at most about MOST_VECTORS rows at a time."""
    own = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    number = -(-own.count() // MOST_VECTORS)
    for k in range(number):
        part = own if number == 1 else own.where(F.pmod(F.xxhash64("key"), F.lit(number)) == k)
        rows = sorted(((r["key"], r["vector"]) for r in part.toLocalIterator()), key=lambda r: r[0])
        if rows:
            yield [r[0] for r in rows], np.array([r[1] for r in rows])


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """For each row, the places of its k highest values, the first of equals first."""
    sims = np.round(sims, 6)
    k = min(k, sims.shape[1])
    order = np.argsort(-sims, axis=1, kind="stable")
    return order[:, :k]


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k rows nearest to a query vector, with rank from 1."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    top = vectors.where(F.col(vector).isNotNull()).select(key, F.round(dot(vector, wanted), 6).alias("sim")).orderBy(F.desc("sim"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sim"), key)))


def semantic_search(vectors: DataFrame, key: str, vector: str, text: str, encode: Callable[[str], list[float]], k: int) -> DataFrame:
    """The k rows nearest to a text, which ``encode`` turns into a vector."""
    return nearest(vectors, key, vector, encode(text), k)


def nearest_to(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, with_self: bool = False) -> DataFrame:
    """For a stated set of query rows, each one's k nearest others.

    Each task keeps the best k of every query; only these are shuffled. A set of more than MOST_VECTORS takes a pass a block.
    """
    kind = vectors.schema[key].dataType
    shape = T.StructType([T.StructField("query", kind), T.StructField(key, kind), T.StructField("sim", T.DoubleType())])
    own = vectors.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("vector"))
    found = []
    for names, at in _blocks(queries, key, vector):
        handle = vectors.sparkSession.sparkContext.broadcast((names, at))
        best = own.mapInArrow(_kept(handle, k, with_self, key), shape)
        found.append(best)
        if len(names) == MOST_VECTORS or len(found) > 1:  # of many blocks only one is held at a time
            found[-1] = checkpointed(best, "nearest")
            handle.unpersist()
    if not found:
        return own.select(F.col(key).alias("query"), F.col(key), F.lit(0.0).alias("sim"), F.lit(1).alias("rank")).limit(0)
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _kept(handle, k: int, with_self: bool, key: str):
    def run(batches):
        names, at = handle.value
        place = {n: i for i, n in enumerate(names)}
        rows: list[list[tuple]] = [[] for _ in names]
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.array(batch.column(0).to_pylist(), dtype=object)
            s = np.round(at @ _matrix(batch.column(1)).T, 6)
            if not with_self:
                for j, x in enumerate(own.tolist()):
                    if x in place:
                        s[place[x], j] = -np.inf
            some = min(k, s.shape[1])
            least = np.partition(s, s.shape[1] - some, axis=1)[:, s.shape[1] - some]
            for i in range(len(names)):
                good = np.flatnonzero((s[i] >= least[i]) & (s[i] > -np.inf))
                rows[i] = sorted([*rows[i], *((-s[i, j], own[j]) for j in good)])[:k]
        out = [(names[i], x, -s) for i, own in enumerate(rows) for s, x in own]
        for lo in range(0, len(out), 10_000):
            q, x, s = zip(*out[lo : lo + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(x), pa.array(s, pa.float64())], names=["query", key, "sim"])

    return run


def top_prototypes(items: DataFrame, prototypes: DataFrame, key: str, vector: str, prototype: str, prototype_vector: str, k: int) -> DataFrame:
    """key and best: the k nearest prototypes of each item, as (prototype, sim) in order. Nothing is shuffled.

    More than MOST_VECTORS prototypes take a pass a block, over what the blocks before found; in a stream the passes follow
    each other in one stage.
    """
    kind = T.ArrayType(T.StructType([T.StructField("prototype", prototypes.schema[prototype].dataType), T.StructField("sim", T.DoubleType())]))
    own = items.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("vector"))
    out = own.withColumn("best", F.array().cast(kind))
    shape = T.StructType([own.schema[key], T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("best", kind)])
    for number, (names, at) in enumerate(_blocks(prototypes, prototype, prototype_vector)):
        handle = items.sparkSession.sparkContext.broadcast((names, at))
        if number and not items.isStreaming:
            out = checkpointed(out, "prototypes")
        out = out.mapInArrow(_ranked(handle, k, key, prototypes.schema[prototype].dataType), shape)
    return out.select(key, "best")


def _ranked(handle, k: int, key: str, kind):
    from pyspark.sql.pandas.types import to_arrow_type

    shape = pa.list_(pa.struct([("prototype", to_arrow_type(kind)), ("sim", pa.float64())]))

    def run(batches):
        names, at = handle.value
        for batch in batches:
            if not batch.num_rows:
                continue
            sims = np.round(_matrix(batch.column(1)) @ at.T, 6)
            places = _best(sims, k)
            best = []
            for i, had in enumerate(batch.column(2).to_pylist()):
                new = [(-float(sims[i, j]), names[j]) for j in places[i]]
                best.append([{"prototype": p, "sim": -s} for s, p in sorted([*new, *((-h["sim"], h["prototype"]) for h in had)])[:k]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, shape)], names=[key, "vector", "best"])

    return run


def similar_items(vectors: DataFrame, key: str, vector: str, item, k: int) -> DataFrame:
    """The k nearest others of one item; an item without a vector is an error when the result is read."""
    own = vectors.where(F.col(key) == item).where(F.col(vector).isNotNull())
    missing = own.groupBy().agg(F.count("*").alias("_n")).where(F.when(F.col("_n") == 0, F.raise_error(F.lit("no vector"))).otherwise(F.lit(True)))
    return nearest_to(vectors, own, key, vector, k).join(F.broadcast(missing.select(F.lit(item).alias("query"))), "query")


def filtered_nearest(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, allowed: DataFrame, overfetch: int | None = None) -> DataFrame:
    """The k nearest of the allowed rows. ``overfetch`` instead filters the k * overfetch nearest of all, which may leave fewer."""
    if overfetch is None:
        return nearest(vectors.join(allowed.select(key), key, "left_semi"), key, vector, query, k)
    top = nearest(vectors, key, vector, query, k * overfetch).drop("rank").join(allowed.select(key), key, "left_semi")
    top = top.orderBy(F.desc("sim"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sim"), key)))


def zero_shot(items: DataFrame, tags: DataFrame, key: str, vector: str, tag: str, tag_vector: str, k: int = 5) -> DataFrame:
    """The k tags nearest to each item, with rank from 1."""
    best = top_prototypes(items, tags, key, vector, tag, tag_vector, k)
    return best.select(key, F.posexplode("best").alias("at", "b")).select(key, F.col("b.prototype").alias(tag), "b.sim", (F.col("at") + 1).alias("rank"))


def stale(tags: DataFrame, version: str, vector: str = "embedding", model: str = "model_ver") -> DataFrame:
    """Tags whose vector is missing or of another model version."""
    return tags.where(F.col(vector).isNull() | ~F.col(model).eqNullSafe(F.lit(version)))


def upsert_tags(old: DataFrame, new: DataFrame, compat: bool = False) -> DataFrame:
    """photo_tag after tagging: source becomes AI; confidence becomes the new one, or with ``compat`` stays the first one."""
    n = new.select("tag_id", "photo_id", F.col("confidence").alias("_new"), F.lit(True).alias("_hit"))
    out = old.join(n, ["tag_id", "photo_id"], "full")
    kept = F.coalesce("confidence", "_new") if compat else F.coalesce("_new", "confidence")
    return out.select("tag_id", "photo_id", F.when(F.col("_hit"), "AI").otherwise(F.col("tag_source")).alias("tag_source"), kept.alias("confidence"))


def best_prototype(points: DataFrame, prototypes: DataFrame, key: str, vector: str, prototype: str, centroid: str, least: float | None = None) -> DataFrame:
    """The prototype nearest to each point, above ``least`` if given; ties go to the lowest id."""
    best = top_prototypes(points, prototypes, key, vector, prototype, centroid, 1)
    out = best.select(key, F.get("best", F.lit(0)).alias("b")).where("b is not null").select(key, F.col("b.prototype").alias(prototype), "b.sim")
    return out.where(F.col("sim") > least) if least is not None else out


def search(query: SearchQuery, vectors: DataFrame, key: str, vector: str, persons: DataFrame, tags: DataFrame, encode, k: int, overfetch: int | None = None) -> DataFrame:
    """A parsed search: key, sim and rank.

    persons and tags have (name, key) rows; names match in either case, and every one of them must hold. An unknown name leaves
    nothing. Without free text all matches come, the highest keys first; with it, the k nearest to ``encode(text)``.
    """
    allowed = None
    for names, table in ((query.persons, persons), (query.tags, tags)):
        if names:
            own = having_all(table.select(F.lower("name").alias("name"), key), key, "name", [n.lower() for n in names])
            allowed = own if allowed is None else allowed.join(own, key, "left_semi")
    if query.text:
        wanted = encode(query.text)
        return nearest(vectors, key, vector, wanted, k) if allowed is None else filtered_nearest(vectors, key, vector, wanted, k, allowed, overfetch)
    if allowed is None:
        return vectors.select(key, F.lit(None).cast("double").alias("sim"), F.lit(None).cast("int").alias("rank")).limit(0)
    return row_numbers(allowed.select(key, F.lit(None).cast("double").alias("sim")), [F.desc(key)], "rank", 1)
