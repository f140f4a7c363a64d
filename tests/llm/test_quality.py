"""Expectation-maximisation against plain loops, and the scorer against gold labels that it never reads."""

import math

import numpy as np

from shutterlake.llm import quality

FOLDER = "/root/testdata/sf0.01"


def plain(table, rounds):
    """The same model by loops: Bernoulli labellers that may abstain, seven of ten imagined votes right, accuracies and prior clipped."""
    width = len(quality.LABELLERS)
    votes = {p: ["-0+".index(c) - 1 for c in p] for p in table}
    q = {p: 1 / (1 + math.exp(-sum(v))) for p, v in votes.items()}
    for _ in range(rounds):
        prior = min(0.98, max(0.02, sum(n * q[p] for p, n in table.items()) / sum(table.values())))
        right = [[0.0] * width, [0.0] * width]
        for j in range(width):
            for c, sign in ((0, 1), (1, -1)):
                said = sum(n * (q[p] if c == 0 else 1 - q[p]) for p, n in table.items() if votes[p][j] == sign)
                spoke = sum(n * (q[p] if c == 0 else 1 - q[p]) for p, n in table.items() if votes[p][j])
                right[c][j] = min(0.99, max(0.05, (said + 7) / (spoke + 10)))
        for p, v in votes.items():
            good, bad = prior, 1 - prior
            for j, x in enumerate(v):
                if x:
                    good *= right[0][j] if x > 0 else 1 - right[0][j]
                    bad *= 1 - right[1][j] if x > 0 else right[1][j]
            q[p] = good / (good + bad)
    return q, prior, right


def test_expectation_maximisation():
    rng = np.random.default_rng(1)
    width = len(quality.LABELLERS)
    truth, accuracy = rng.random(3000) < 0.7, rng.uniform(0.6, 0.95, width)
    table = {}
    for good in truth:
        row = "".join("0" if rng.random() < 0.3 else "+" if (rng.random() < accuracy[j]) == good else "-" for j in range(width))
        table[row] = table.get(row, 0) + 1
    got, prior, right = quality.expect(table, 20)
    want, p, r = plain(table, 20)
    assert abs(prior - p) < 1e-9 and np.abs(right - np.array(r)).max() < 1e-9 and max(abs(got[k] - want[k]) for k in table) < 1e-9
    # The accuracies that the votes were drawn with are found again.
    assert np.abs(right[0] - accuracy).max() < 0.06 and abs(prior - 0.7) < 0.04


def test_against_gold_labels(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r["doc_id"]: r for r in quality.classify(docs).collect()}
    gold = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality is not null").collect() if r["doc_id"] in got]
    right = sum((got[d]["score"] >= 0.5) == (y == 1) for d, y in gold) / len(gold)
    assert len(got) == docs.count() and right > 0.9


def test_repeated_rows_ties_and_names(spark):
    good = [(i, f"This is a sentence of ordinary words, number {i}. " + " ".join(f"w{i}x{k}," for k in range(40)), "v") for i in range(150)]
    bad = [(1000 + i, "SPAM!! " * 60 + str(i), "v") for i in range(80)]
    rows = [*good, *bad, (5000, None, "v"), (5000, None, "v"), (3, "other words, with the id of another row. " * 4, "v"), (6000, "word " * 150_000, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, votes string")
    got = sorted(map(tuple, quality.classify(docs).collect()))
    assert len(got) == len(rows) and got == sorted(map(tuple, quality.classify(docs.repartition(5)).collect()))
    by = {r[0]: r for r in got}
    assert all(by[i][-1] for i in range(150) if i != 3) and not any(by[1000 + i][-1] for i in range(80)) and by[5000][1] == 0
    assert quality.classify(docs.limit(0)).count() == 0
