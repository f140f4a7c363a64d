"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, hot, join_unique, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b), where label is the least node of the component.

    Each round maps every node to the first of itself and its neighbours, and keeps the edges between different images only, so
    that a round's edges are those of the graph contracted by the rounds before. First comes the least node in the first round,
    which settles stars around it, and then the node with the least hash of that round, by which any graph shrinks by a constant
    factor on average. The rounds' maps, composed, give the components. Each round is a written table. Self loops are
    allowed, nulls are dropped, and an empty edge table gives an empty result. Aggregates combine before they shuffle, and rows
    of a hub or of a large component are not gathered by its node: its one row is brought to them.
    """
    scratch = Scratch(edges.sparkSession)
    ordered = lambda df, a, b: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    pairs = scratch.written(ordered(edges.where("a is not null and b is not null"), "a", "b"), "cc-pairs")
    maps: list[DataFrame] = []
    for number in range(most_rounds):
        rank = (lambda c: F.struct(F.xxhash64(c, F.lit(number)).alias("h"), F.col(c).alias("n"))) if number else (lambda c: F.struct(F.lit(0).alias("h"), F.col(c).alias("n")))  # noqa: B023
        both = pairs.union(pairs.select("b", "a"))
        label = scratch.written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least(rank("a"), rank("b")))["n"].alias("label")), "cc-label")
        maps.append(label)
        image = join_unique(pairs, label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", hot(pairs, "a"))
        image = join_unique(image, label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", hot(pairs, "b"))
        pairs = scratch.written(ordered(image.where("la <> lb"), "la", "lb"), "cc-pairs")
        if pairs.limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"edges left after {most_rounds} rounds")
    rounds, found = len(maps), maps.pop()
    while maps:
        before = maps.pop()
        after = found.select(F.col("node").alias("label"), F.col("label").alias("far"))
        found = join_unique(before, after, "label", hot(before, "label"), "left").select("node", F.coalesce("far", "label").alias("label"))
    if rounds > 1:  # the last node of a component need not be its least
        found = scratch.written(found, "cc-found")
        least = found.groupBy("label").agg(F.min("node").alias("least"))
        found = join_unique(found, least, "label", hot(found, "label")).select("node", F.col("least").alias("label"))
    found = written(found, "components")
    scratch.drop()
    return found
