"""The mix against plain targets, and its tree against what it must keep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.llm import mixing


def targets(sizes, weights=mixing.WEIGHTS, most=mixing.MOST):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left = {}, float(sum(sizes.values()))
    while order:
        unit = left / sum(weight[s] for s in order)
        over = [s for s in order if unit * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in order}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            order.remove(s)
    return out


ROWS = [(i, " ".join(["w"] * (1 + i * 7 % 23)), f"s{i % 3}" if i % 11 else f"tail{i % 10}") for i in range(3000)]
ROWS += [(9000, None, None), (9001, "a b c", None), (None, "no id", "s1"), (9002, "", "s2"), (9003, "x " * 4000, "s2")]
#: Names that are also those of helper columns.
SCHEMA = "doc_id long, text string, source string, size string, place int, shard string, rank int, `number` int, block int, doc int, _size string, _s string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "mine", 1, "x", 2, 3, 4, 5, "y", "z") for r in ROWS], SCHEMA)


def sizes():
    out = {}
    for _, text, source in ROWS:
        out[source] = out.get(source, 0) + len((text or "").split())
    return out


@pytest.mark.parametrize("options", [{}, {"block_words": 50, "shards": 13, "weights": (1,)}])
def test_report(docs, options):
    want = targets(sizes(), options.get("weights", mixing.WEIGHTS))
    got = mixing.report(docs, **options).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"]) for r in got) == sorted((r[0] is None, r[0], len((r[1] or "").split())) for r in ROWS)
    source = {r[0]: r[2] for r in ROWS}
    taken = dict.fromkeys(want, 0)
    for r in got:
        own = source[r["doc_id"]]
        assert r["target"] == pytest.approx(want[own], abs=1e-6) and r["source_size"] == sizes()[own]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * len([x for x in r["shards"].split(",") if x])
        taken[own] += r["taken"]
    for own, words in taken.items():
        longest = max(len((t or "").split()) for _, t, s in ROWS if s == own)
        assert abs(words - want[own]) <= longest / 2 + 1, own
    if options:
        again = mixing.report(docs.repartition(5), **options).collect()
        assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mix_and_shards_agree_with_the_report(spark, docs, tmp_path):
    options = {"block_words": 50, "shards": 5}
    got = mixing.report(docs, **options).collect()
    want = sorted((r["doc_id"] or -1, int(x)) for r in got for x in r["shards"].split(",") if x)
    name = mixing.write_shards(docs, f"file://{tmp_path}/shards", **options)
    assert name == "_shard"
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted((r["doc_id"] or -1, r["_shard"]) for r in back.collect()) == want
    mixed = mixing.mix(docs, **options)
    assert mixed.columns == docs.columns and {r["size"] for r in mixed.select("size").distinct().collect()} == {"mine"}
    assert sorted(r["doc_id"] or -1 for r in mixed.collect()) == [d for d, _ in want]
    # Shards have equal numbers of blocks, and within a shard the sources are mixed.
    one = [r["source"] for r in back.where("_shard = 2").collect()]
    assert len(one) > 50 and sum(a != b for a, b in zip(one, one[1:])) > len(one) / 4


def test_mix_deals_shards_and_their_pieces_to_partitions_of_their_own(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    options = {"block_words": 20}

    def dealt(**more):
        mixed = mixing.mix(docs, **options, **more)
        return mixed.select("doc_id", F.spark_partition_id().alias("p")).collect()

    def even(got, parts):
        n = np.bincount([r["p"] for r in got], minlength=parts)
        return len(n) == parts and n.min() > 0 and n.max() < 1.6 * n.mean()

    whole = dealt()
    assert even(whole, 8)
    pieces = dealt(piece_words=500)
    assert even(pieces, 32)
    # Pieces leave the rows and their order as they are, and each partition is a shard of the report.
    assert [r["doc_id"] for r in pieces] == [r["doc_id"] for r in whole]
    want = sorted((r["doc_id"], int(x)) for r in mixing.report(docs, **options).collect() for x in r["shards"].split(",") if x)
    assert sorted((r["doc_id"], r["p"]) for r in whole) == want


def test_tree():
    quotas = np.array([50, 0, 7, 900])
    whole = mixing.split(quotas, 0, 11, 3)
    assert sum(q for _, _, q in whole).tolist() == quotas.tolist() and [lo for lo, _, _ in whole] == list(range(11))
    totals = [int(q.sum()) for _, _, q in whole]
    assert max(totals) - min(totals) <= 2
    # Subtrees split further give what the whole tree gives.
    deep = [leaf for lo, hi, q in mixing.split(quotas, 0, 11, 3, until=3) for leaf in mixing.split(q, lo, hi, 3)]
    assert [(lo, q.tolist()) for lo, _, q in deep] == [(lo, q.tolist()) for lo, _, q in whole]
    # A shard's share of a category is hypergeometric: mean and variance over seeds.
    drawn = np.array([mixing.split(np.array([30, 70]), 0, 4, s)[0][2][0] for s in range(3000)])
    assert abs(drawn.mean() - 7.5) < 0.2 and abs(drawn.var() - 25 * 0.3 * 0.7 * 75 / 99) < 0.4


def test_many_sources_share_categories(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CATEGORIES", 4)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.concat(F.lit("s"), F.col("id") % 50).alias("source"))
    got = mixing.report(docs, shards=6).collect()
    want = targets({f"s{k}": 48 for k in range(50)})
    for k in range(50):
        assert abs(sum(r["taken"] for r in got if r["doc_id"] % 50 == k) - want[f"s{k}"]) <= 3


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.report(blank).collect()] == [(0, 0.0)] * 2
