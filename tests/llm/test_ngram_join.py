"""The join against all pairs of plain sets, with hot keys, repeated ids and nulls."""

import re

import numpy as np
import pytest

from shutterlake.llm import graph, ngram_join, shared

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
rng = np.random.default_rng(6)


def corpus():
    rows = []
    for g in range(12):
        base = [f"w{rng.integers(0, 200)}" for _ in range(int(rng.integers(3, 90)))]
        for _ in range(int(rng.integers(1, 9))):
            own = list(base)
            for _ in range(int(rng.integers(0, 5))):
                own[int(rng.integers(len(own)))] = f"v{rng.integers(0, 9)}"
            rows.append(" ".join(own).title() if rng.random() < 0.2 else " ".join(own))
    rows += [None, "", "...", "one", "ONE", "one", "a b c d", "x " * 400_000]
    return [(int(rng.integers(0, 70)) if rng.random() < 0.9 else None, t) for t in rows]


ROWS = corpus()


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    near = [[j for j, b in enumerate(sets) if i != j and a and 5 * len(a & b) >= 4 * len(a | b)] for i, a in enumerate(sets)]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *(group[j] for j in near[i])]) for i in range(len(rows))]
    return near, group


@pytest.mark.parametrize(("block", "least_hot"), [(1024, 256), (3, 1)])
def test_all_pairs(spark, monkeypatch, block, least_hot):
    monkeypatch.setattr(shared, "LEAST_HOT", least_hot)
    monkeypatch.setattr(shared, "MOST_HOT", 5)
    # Names that are also those of helper columns.
    docs = spark.createDataFrame([(*r, "own", 7, "l", "r") for r in ROWS], "doc_id long, text string, key string, n int, label string, _row string")
    near, group = plain(ROWS)
    least = {g: min((ROWS[i][0] for i in range(len(ROWS)) if group[i] == g and ROWS[i][0] is not None), default=None) for g in group}
    want = sorted(((d, least[group[i]] if words(t) else d, len(near[i])) for i, (d, t) in enumerate(ROWS)), key=repr)
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.jaccard_join(docs, block=block).collect()), key=repr)
    assert got == want
    if block == 1024:
        return
    kept = ngram_join.drop_near_duplicates(docs, block=block)
    assert kept.columns == docs.columns
    stay = [tuple(r) for r in kept.collect()]
    assert {r[2:] for r in stay} == {("own", 7, "l", "r")}
    # One row of each group, with its least id; all rows without words.
    texts = {(d, t): group[i] for i, (d, t) in enumerate(ROWS)}
    assert sorted(texts[r[:2]] for r in stay) == sorted({g for i, g in enumerate(group) if words(ROWS[i][1])} | {i for i, (_, t) in enumerate(ROWS) if not words(t)})
    assert all(r[0] == least[texts[r[:2]]] for r in stay if words(r[1]))


def test_large_group_in_blocks(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda {} nu xi omicron pi rho sigma tau upsilon phi chi psi omega "
    rows = [(i, base.format(f"w{i}") + " ".join(f"t{k}" for k in range(60))) for i in range(30)]
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), block=7).collect()
    assert {r["n_links"] for r in got} == {29} and {r["class_id"] for r in got} == {0}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert ngram_join.jaccard_join(none).count() == 0 and ngram_join.drop_near_duplicates(none).count() == 0


def test_least_matches():
    # Against the posterior by simulation of its definition: uniform prior, binomial matches.
    fewest = ngram_join.least_matches(0.8, 1e-6, 128)
    assert len(fewest) == 8 and fewest == sorted(fewest) and 0 < fewest[-1] < 0.8 * 128
    grid = np.linspace(0, 1, 200_001)
    for n, m in zip(range(16, 129, 16), fewest):
        for k, enough in ((m, True), (m - 1, False)):
            if k >= 0:
                density = grid**k * (1 - grid) ** (n - k)
                assert (density[grid >= 0.8].sum() / density.sum() >= 1e-6) == enough


def test_components(spark, monkeypatch):
    monkeypatch.setattr(shared, "LEAST_HOT", 1)
    edges = [(0, k) for k in range(1, 60)] + [(k, k + 1) for k in range(100, 120)] + [(200, 200), (7, None), (300, 301), (301, 300)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(60)} | {k: 100 for k in range(100, 121)} | {200: 200, 300: 300, 301: 300}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
