"""Line deduplication against the alignment of all pairs."""

import numpy as np
import pytest

from shutterlake.llm import linededup, shared


def lines_of(text):
    own = [ln.split() for ln in (text or "").split("\n")]
    return [" ".join(w) or None for w in own], [len(w) for w in own]


def plain(texts):
    """The lines that each text (in order) loses when it is aligned with each earlier one."""
    read = [lines_of(t) for t in texts]
    return [sorted({x for i in range(j) for x in linededup.doomed(read[i][0], b, words, 20)}) for j, (b, words) in enumerate(read)]


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    pool = [" ".join(f"w{rng.integers(0, 40)}" for _ in range(int(rng.integers(1, 12)))) for _ in range(60)]
    blocks = [[pool[int(k)] for k in rng.integers(0, 60, rng.integers(2, 7))] for _ in range(10)]
    out = []
    for d in range(n):
        own = []
        for _ in range(int(rng.integers(1, 6))):
            draw = rng.random()
            own += blocks[int(rng.integers(10))] if draw < 0.4 else [pool[int(rng.integers(60))]] if draw < 0.6 else [f"only {d} {rng.integers(0, 99)}", ""]
        out.append("\n".join(own))
    return out


@pytest.mark.parametrize("least_hot", [256, 3])
def test_all_pairs(spark, monkeypatch, least_hot):
    monkeypatch.setattr(shared, "LEAST_HOT", least_hot)
    texts = corpus(300, 8)
    want = plain(texts)
    assert sum(map(bool, want)) > 150
    # Names that are also those of helper columns.
    docs = spark.createDataFrame([(k, t, "own", 5, "x") for k, t in enumerate(texts)], "doc_id long, text string, row string, hash int, gone string").repartition(5)
    got = {r["doc_id"]: r for r in linededup.report(docs).collect()}
    assert [got[k]["removed"] for k in range(300)] == [",".join(map(str, w)) for w in want]
    if least_hot == 256:
        cut = linededup.dedup(docs)
        assert cut.columns == docs.columns
        rows = {r["doc_id"]: r for r in cut.collect()}
        assert all(tuple(rows[k])[2:] == ("own", 5, "x") for k in rows)
        assert [rows[k]["text"] for k in range(300)] == ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in w) for t, w in zip(texts, want)]


def test_lines_in_more_documents_than_rare(spark):
    block = [f"line {k} of a block with quite a few words" for k in range(4)]
    texts = [f"{ln}\nalone {k}" for k, ln in enumerate(block)] + ["\n".join([f"head {k}", *block, f"end {k}"]) for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rare in (1, 1000):
        got = linededup.report(docs, rare=rare).collect()
        assert sum(r["n_removed"] for r in got) == 44


def test_repeated_and_null_ids(spark):
    block = "\n".join(f"line {k} of a block with quite a few words in it" for k in range(4))
    other = "\n".join(f"another text {k} that shares nothing with the block above" for k in range(5))
    rows = [(1, f"one\n{block}"), (2, f"two\n{block}"), (2, other), (3, f"x\n{block}"), (3, f"x\n{block}"), (None, f"null\n{block}"), (4, None), (5, "")]
    cut = sorted(((r["doc_id"], r["text"]) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    # A null id is the first in order; of equal rows the first keeps what no earlier one has.
    assert cut == sorted([(1, "one"), (2, "two"), (2, other), (3, "x"), (3, ""), (None, f"null\n{block}"), (4, None), (5, "")], key=repr)


def test_long_text(spark):
    line = "a line of six words {}"
    long = "\n".join(line.format(k) for k in range(40_000))
    docs = spark.createDataFrame([(1, long), (2, "before\n" + long + "\nafter")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.dedup(docs).collect()} == {1: long, 2: "before\nafter"}


def test_in_another_order(spark):
    p, q = ("\n".join(f"{name} {k} is one line of a block that many documents have" for k in range(2)) for name in "pq")
    rows = [(0, f"{p}\n{q}"), (1, p), *((k, f"{q}\n{p}") for k in range(2, 20))]
    got = [linededup.report(spark.createDataFrame(rows, "doc_id long, text string"), rare=r).collect() for r in (8, 1000)]
    assert [{r["doc_id"]: r["n_removed"] for r in g} for g in got] == [{0: 0, 1: 2} | {k: 4 for k in range(2, 20)}] * 2


def test_patience():
    assert linededup.patience(list("abcde"), list("xbcdy")) == [(1, 1), (2, 2), (3, 3)]
    p = [f"p{k}" for k in range(3)]
    for a, b in ((["x", *p, "y", *p, "z"], ["u", *p, "v"]), (["u", *p, "v"], ["x", *p, "y", *p, "z"])):
        assert [b[j] for j in linededup.doomed(a, b, [8] * len(b), 20)] == p
    assert linededup.doomed(["x", *p, "y", "p2", "z"], ["u", "p0", None, "p1", "p2", "v", "p2", "w"], [8, 8, 0, 8, 8, 8, 8, 8], 20) == [1, 3, 4]
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = (rng.integers(0, 3, rng.integers(0, 12)).tolist() for _ in range(2))
        i, j, n = linededup.longest_block(a, b)
        assert a[i : i + n] == b[j : j + n] and n == max((m for m in range(13) for x in range(len(a) - m + 1) for y in range(len(b) - m + 1) if a[x : x + m] == b[y : y + m]), default=0)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert linededup.report(none).count() == 0 and linededup.dedup(none).count() == 0
