"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Each source's documents are dealt by a hash of doc_id and text into blocks of about ``block_words`` words (``LEAST_BLOCKS`` at
   least). A source's target is met by whole repeats of all its blocks, then by its blocks in an order that a hash permutes while
   they fit, and by a part of the block that crosses the target. What is taken of a block at once is an instance of it.
2. The instances are the quotas of the tree: each node hands its left half of the shards a multivariate-hypergeometric draw of
   what it has. Sources are the tree's categories; beyond ``CATEGORIES`` of them several share one, which leaves the distribution
   as it is, since the instances of a category are permuted. The driver splits down to ``SUBTREES`` nodes, tasks split the rest.
3. A shard takes its quota of each category's permuted instances, which no other shard has, and shuffles its documents by a hash.

There are as many shards as the mix has ``shard_words``, ``LEAST_SHARDS`` at least. ``mix`` hands a shard on in pieces of about
``piece_words`` words by the top bits of the shuffling hash, each a task and a partition of its own, so that no task holds a whole
shard; the partitions stand in the order of shards and pieces. Nothing that grows with documents, sources or
blocks goes to the driver: it gets a row for each partition, category and subtree. All draws come from hashes and seeds, so
reruns agree, whatever the partitioning. Sources and blocks are joined by broadcast up to ``MOST_BROADCAST`` rows, by shuffles beyond.

Defined results: the size of a text is its number of ``[^\\x20\\x09-\\x0D]+`` (null: 0), and a text of size 0 is taken 0 times in
words and not part of the mix; a null source is a source of its own, the last one; a null doc_id is a value like others; rows
equal in doc_id and text are taken alike; no document is taken more than ``most`` times; a text of any length is one document of
one block; other columns stay, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, fresh, running, small, written

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 20240
BLOCK_WORDS, LEAST_BLOCKS, SHARD_WORDS, LEAST_SHARDS = 1 << 20, 64, 1 << 26, 8
PIECE_WORDS = 1 << 22
CATEGORIES, SUBTREES = 1024, 64
SIZE = r"[^\x20\x09-\x0D]+"


class Plan(NamedTuple):
    """sources: source, source_size, target, blocks and number; blocks: number, block, whole (shards), part (shard) and cut (last place)."""

    sources: DataFrame
    n_sources: int
    blocks: DataFrame
    most_blocks: int
    shards: int
    pieces: int
    seed: int


def _keys(seed: int) -> dict:
    place = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(seed))
    return {"size": F.coalesce(F.regexp_count("text", F.lit(SIZE)), F.lit(0)).cast("long"), "place": place}


def _sources(light: DataFrame, weights, most: int, block_words: int, scratch: Scratch) -> tuple[DataFrame, int, float]:
    """(the sources with their targets, how many there are, all words of the mix)."""
    own = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    own = running(own, [F.col("source").isNull(), F.col("source")], [], scratch, "mix-sources").withColumnRenamed("before", "number")
    scratch.keep_last()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double")
    own = own.withColumn("weight", weight)
    # A source is full if the words that a unit of weight gets exceed its limit; what full sources leave raises the unit.
    total, n, unit, had = None, 0, 0.0, -1
    while True:
        limit = F.col("source_size") * most
        full = F.lit(unit) * F.col("weight") > limit
        r = own.agg(F.sum("source_size").alias("total"), F.count("*").alias("n"), F.sum(full.cast("long")).alias("full"), F.sum(F.when(full, limit)).alias("limits"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        total, n = float(r["total"] or 0), r["n"]
        if not r["weight"] or r["full"] == had:
            break
        had, unit = r["full"], (total - float(r["limits"] or 0)) / r["weight"]
    target = F.when(full, limit.cast("double")).otherwise(F.lit(unit) * F.col("weight"))
    blocks = F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("source_size") / F.lit(block_words))).cast("long")
    return own.select("source", "number", "source_size", target.alias("target"), blocks.alias("blocks")), n, total


def _with_source(df: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """``df`` (source, place and others) with number, block, source_size and target."""
    known = small(sources.withColumnRenamed("source", "known"), n)
    return df.join(known, F.col("source").eqNullSafe(F.col("known"))).withColumn("block", F.pmod("place", "blocks")).drop("known", "blocks")


def split(quotas: np.ndarray, lo: int, hi: int, seed: int, until: int = 1) -> list[tuple[int, int, np.ndarray]]:
    """(first shard, shard beyond, quotas) of the nodes that have at most ``until`` of the shards lo..hi, in order."""
    out, todo = [], [(lo, hi, quotas)]
    while todo:
        lo, hi, own = todo.pop()
        if hi - lo <= until:
            out.append((lo, hi, own))
            continue
        mid = (lo + hi) // 2
        take = int(own.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = rng.multivariate_hypergeometric(own, take) if len(own) and own.sum() else own * 0
        todo += [(mid, hi, own - left), (lo, mid, left)]
    return out


def _shards(seed: int):
    schema = pa.schema([("category", pa.int64()), ("first", pa.int64()), ("count", pa.int64()), ("shard", pa.int32())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                first, names = np.array(row["firsts"], np.int64), np.array(row["categories"], np.int64)
                for shard, _, own in split(np.array(row["quotas"], np.int64), row["lo"], row["hi"], seed):
                    some = np.flatnonzero(own)
                    yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(first[some]), pa.array(own[some]), pa.array(np.full(len(some), shard, np.int32))], schema=schema)
                    first = first + own

    return run


def _slots(spark, quotas: dict[int, int], shards: int, seed: int) -> DataFrame:
    """category, position and shard: the leaves of the tree, a row for each instance."""
    names = sorted(quotas)
    rows, first = [], np.zeros(len(names), np.int64)
    for lo, hi, own in split(np.array([quotas[c] for c in names], np.int64), 0, shards, seed, -(-shards // SUBTREES)):
        rows.append((lo, hi, names, own.tolist(), first.tolist()))
        first = first + own
    numbers = pa.list_(pa.int64())
    kinds = (pa.int32(), pa.int32(), numbers, numbers, numbers)
    nodes = spark.createDataFrame(pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(("lo", "hi", "categories", "quotas", "firsts"), kinds))}))
    leaves = nodes.repartitionByRange(len(rows), "lo").mapInArrow(_shards(seed), "category long, first long, count long, shard int")
    return leaves.select("category", F.explode(F.expr("sequence(first, first + count - 1)")).alias("position"), "shard")


def plan(light: DataFrame, weights=WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, piece_words: int = PIECE_WORDS, shards: int | None = None, seed: int = SEED) -> Plan:
    """What the mix takes of a written table with source, size and place."""
    spark = light.sparkSession
    scratch = Scratch(spark)
    sources, n_sources, words = _sources(light, weights, most, block_words, scratch)
    shards = shards or max(LEAST_SHARDS, -(-int(words) // shard_words))
    pieces = max(1, -(-int(words) // (shards * piece_words)))

    placed = _with_source(light, sources, n_sources)
    blocks = placed.groupBy("number", "block").agg(F.sum("size").alias("words")).withColumn("order", F.xxhash64("number", "block", F.lit(seed)))
    blocks = running(blocks, [F.col("number"), F.col("order"), F.col("block")], ["words"], scratch, "mix-order")
    first = blocks.groupBy("number").agg(F.min("before_words").alias("first"))
    aims = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)).withColumn("rest", F.when(F.col("whole") < most, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0))
    aims = aims.join(first, "number").select("number", "whole", "rest", "first")
    had = F.col("before_words") - F.col("first")
    blocks = blocks.join(small(aims, n_sources), "number").select(
        "number",
        "block",
        (F.col("whole") + (had + F.col("words") <= F.col("rest")).cast("long")).alias("times"),
        F.when((had < F.col("rest")) & (had + F.col("words") > F.col("rest")), F.col("rest") - had).alias("wanted"),
    )

    # Of a block that is taken in part: its documents by place; the one on the edge if at least half of it fits.
    partial = small(blocks.where("wanted is not null").select("number", "block", "wanted"), n_sources)
    sofar = F.sum("size").over(Window.partitionBy("number", "block").orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
    cuts = placed.join(partial, ["number", "block"]).withColumn("sofar", sofar).where("sofar - size / 2 <= wanted").groupBy("number", "block").agg(F.max("place").alias("cut"))

    instances = blocks.withColumns({"all": F.col("times") + F.col("wanted").isNotNull().cast("long"), "category": F.col("number") % CATEGORIES}).where("all > 0")
    quotas = {r["category"]: r["n"] for r in instances.groupBy("category").agg(F.sum("all").alias("n")).collect()}
    instances = instances.select("category", "number", "block", "times", F.explode(F.expr("sequence(0L, all - 1)")).alias("time"))
    instances = instances.withColumn("draw", F.xxhash64("number", "block", "time", F.lit(seed)))
    starts, had = {}, 0
    for c in sorted(quotas):
        starts[c] = had
        had += quotas[c]
    instances = running(instances, [F.col(c) for c in ("category", "draw", "number", "block", "time")], [], scratch, "mix-permuted")
    starts = spark.createDataFrame(pa.table({"category": pa.array(list(starts), pa.int64()), "start": pa.array(list(starts.values()), pa.int64())}))
    instances = instances.join(F.broadcast(starts), "category").withColumn("position", F.col("before") - F.col("start"))
    drawn = instances.join(_slots(spark, quotas, shards, seed), ["category", "position"])
    whole = F.transform(F.sort_array(F.collect_list(F.when(F.col("time") < F.col("times"), F.struct("time", "shard")))), lambda x: x["shard"])
    table = drawn.groupBy("number", "block").agg(whole.alias("whole"), F.max(F.when(F.col("time") == F.col("times"), F.col("shard"))).alias("part"))
    table = written(table.join(cuts, ["number", "block"], "left"), "mix-plan")
    scratch.drop()
    return Plan(sources, n_sources, table, had, shards, pieces, seed)


def _taken(df: DataFrame, found: Plan) -> DataFrame:
    """``df`` (source, size, place and others) with a row for each time that a document is taken: shard and rank within it."""
    out = _with_source(df.where("size > 0"), found.sources, found.n_sources).join(small(found.blocks, found.most_blocks), ["number", "block"])
    in_part = F.col("part").isNotNull() & F.coalesce(F.col("place") <= F.col("cut"), F.lit(False))
    every = F.when(in_part, F.concat("whole", F.array("part"))).otherwise(F.col("whole"))
    return out.select(*df.columns, F.posexplode(every).alias("time", "shard")).withColumn("rank", F.xxhash64("place", "time", "shard", F.lit(found.seed)))


def _light(docs: DataFrame, seed: int) -> DataFrame:
    own = docs.select("doc_id", "source", *[c.alias(x) for x, c in _keys(seed).items()])
    return written(own.withColumn("row", F.monotonically_increasing_id()), "mix-light")  # written once, so the row numbers stay


def _packed(docs: DataFrame, seed: int) -> DataFrame:
    """The documents in a column of their own, so that no other column clashes with theirs."""
    return docs.select(F.struct("*").alias("doc"), "source", *[c.alias(x) for x, c in _keys(seed).items()])


def _write_shards(taken: DataFrame, found: Plan, folder: str) -> None:
    taken.repartition(found.shards, "shard").sortWithinPartitions("shard", "rank").drop("rank").write.partitionBy("shard").parquet(folder)


def report(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards of every document; taken and shards are read back from written shards.

    The shards of the report hold row numbers in place of texts, else they are those of ``write_shards``.
    """
    light = _light(docs, seed)
    found = plan(light, seed=seed, **options)
    folder = fresh(docs.sparkSession, "mix-shards")
    _write_shards(_taken(light.select("row", "source", "size", "place"), found).select("row", "shard", "rank"), found, folder)
    shards = docs.sparkSession.read.schema("row long, shard int").parquet(folder).groupBy("row").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    out = _with_source(light, found.sources, found.n_sources).join(shards, "row", "left")
    taken = F.col("size") * F.coalesce(F.size("shards"), F.lit(0))
    return out.select("doc_id", "size", "source_size", "target", F.when(F.col("shards").isNull(), 0).otherwise(taken).cast("long").alias("taken"), F.coalesce(F.array_join(F.col("shards").cast("array<string>"), ","), F.lit("")).alias("shards"))


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mix: each document as often as it is taken, its columns unchanged, shard by shard in the shards' shuffled order."""
    found = plan(_light(docs, seed), seed=seed, **options)
    # The top 24 bits of the rank, in its signed order, as a number of pieces.
    top = F.shiftrightunsigned(F.col("rank").bitwiseXOR(F.lit(-1 << 63)), 40)
    piece = F.shiftright(top * F.lit(found.pieces).cast("long"), 24)
    number = (F.col("shard") * F.lit(found.pieces) + piece).cast("int")
    taken = _taken(_packed(docs, seed), found)
    return taken.repartitionById(found.shards * found.pieces, number).sortWithinPartitions("shard", "rank").select("doc.*")


def write_shards(docs: DataFrame, folder: str, seed: int = SEED, **options) -> str:
    """The mix as Parquet, a folder for each shard, in which the documents stand in their shuffled order; returns the shard column's name."""
    found = plan(_light(docs, seed), seed=seed, **options)
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    out = _taken(_packed(docs, seed), found).repartition(found.shards, "shard").sortWithinPartitions("shard", "rank")
    out.select("doc.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(folder)
    return name
