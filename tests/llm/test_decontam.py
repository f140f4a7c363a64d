"""Decontamination against windows as plain tuples, with the benchmark broadcast and joined."""

import hashlib
import re

import numpy as np
import pytest

from shutterlake.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
rng = np.random.default_rng(4)
VOCABULARY = ["Alpha", "beta", "Über", "été", "x1", "7"]
ITEMS = [(k, " ".join(rng.choice(VOCABULARY, rng.integers(1, 30)))) for k in range(40)] + [(40, None), (41, ""), (None, "one two three four"), (42, "a " * 60)]
DOCS = [(k, " ".join([*rng.choice(VOCABULARY, rng.integers(0, 60)), ITEMS[k % 40][1].upper().replace("Ü", "ü").replace("É", "é") if k % 3 == 0 else "end"])) for k in range(60)]
DOCS += [(60, None), (61, ""), (62, "before one, TWO three... four after"), (62, "before one, TWO three... four after"), (None, "A " * 40), (63, "w " * 300_000 + "one two three four")]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(text, size):
    own, hit, items = words(text), set(), set()
    for name, item in ITEMS:
        w = words(item)
        n = min(size, len(w))
        sought = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(own) - n + 1 if sought else 0):
            if tuple(own[k : k + n]) in sought:
                hit.update(range(k, k + n))
                items.add("" if name is None else str(name))
    return len(own), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.fixture(scope="module")
def docs(spark):
    # Names that are also those of helper columns.
    return spark.createDataFrame([(*d, "own", 3, ["s"], "r") for d in DOCS], "doc_id long, text string, _text string, n_words int, spans array<string>, row string")


@pytest.mark.parametrize(("size", "most"), [(13, 10**6), (13, 2), (4, 2)])
def test_report(docs, bench, size, most):
    got = sorted(map(tuple, decontam.report(docs, bench, size=size, most_windows=most).collect()), key=repr)
    assert got == sorted(((d, *plain(t, size)) for d, t in DOCS), key=repr)
    if size == 4:
        return
    kept = decontam.drop_contaminated(docs, bench, size=size, most_windows=most)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.select("doc_id", "text", "_text", "n_words", "row").collect()), key=repr) == sorted(((d, t, "own", 3, "r") for d, t in DOCS if not plain(t, size)[-1]), key=repr)


def test_remove_spans(docs, bench):
    one, joined = (sorted(map(tuple, decontam.remove_spans(docs, bench, size=4, most_windows=m).collect()), key=repr) for m in (10**6, 2))
    assert one == joined and decontam.remove_spans(docs, bench).columns == docs.columns
    cut = {r[0]: r[1] for r in one}
    assert cut[62] == "before  after" and cut[60] is None and cut[61] == "" and all(r[2:4] == ("own", 3) for r in one)
    assert all(not plain(t, 4)[1] or len(cut[d]) < len(t) for d, t in DOCS if d is not None)


def test_empty(spark, docs, bench):
    assert decontam.report(docs.limit(0), bench).count() == 0
    for most in (10**6, 0):
        assert decontam.report(docs, bench.limit(0), most_windows=most).where("n_hit > 0 or contaminated").count() == 0
