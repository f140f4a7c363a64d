"""Language models against plain dictionaries, and predictions that depend on nothing but the text."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from shutterlake.llm import langid
from shutterlake.llm.kernels import slices

TEXTS = {
    "en": ["The cat sat on the mat.", "That hat was on the cat", "a", "this is the end, and that was all of it", "  spaced   out  "],
    "de": ["Der Hund und die Katze", "über die Straße ging er nicht", "", "ja ja ja", "DIE KATZE SCHLÄFT"],
}
ORDER = 4


def letters(text):
    return " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split())


class Plain:
    """Interpolated Kneser-Ney of one language, by dictionaries and recursion."""

    def __init__(self, texts):
        self.counts = {ORDER: Counter()}
        for t in texts:
            line = "\0" * (ORDER - 1) + t
            self.counts[ORDER].update(line[k - ORDER + 1 : k + 1] for k in range(ORDER - 1, len(line)))
        for k in range(ORDER - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discount, self.total, self.types = {}, defaultdict(int), defaultdict(int)
        for k, own in self.counts.items():
            ones, twos = (sum(1 for n in own.values() if n == x) for x in (1, 2))
            self.discount[k] = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
            for g, n in own.items():
                self.total[k, g[:-1]] += n
                self.types[k, g[:-1]] += 1

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (len(self.counts[1]) + 1)
        ctx = (k, gram[:-1])
        if not self.total[ctx]:
            return self.p(gram[1:])
        d = self.discount[k]
        return max(self.counts[k][gram] - d, 0) / self.total[ctx] + d * self.types[ctx] / self.total[ctx] * self.p(gram[1:])


def fitted(most_grams=10**6):
    out = {}
    for lang, texts in TEXTS.items():
        batch = pa.RecordBatch.from_pydict({"lang": [lang] * len(texts), "text": texts})
        counts = Counter()
        for part in langid._count(ORDER)(iter([batch])):
            for g, n in zip(part.column("gram").to_pylist(), part.column("n").to_pylist()):
                counts[g] += n
        grams = np.frombuffer("".join(sorted(counts)).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
        out[lang] = langid.Model.fit(grams, np.array([counts[g] for g in sorted(counts)]), most_grams)
    return langid.Model(out, ORDER)


def shape(text):
    """What a text counts as: single spaces, one behind the last letter if something else follows it; none before the first."""
    said = "".join(c.lower() if c.isalpha() else "\0" for c in text)
    return "".join(c for k, c in enumerate(said) if c != "\0" or (k and said[k - 1] != "\0")).lstrip("\0")


def test_agrees_with_plain_kneser_ney():
    model = fitted()
    plain = [Plain([shape(t) for t in TEXTS[lang]]) for lang in model.langs]
    rng = np.random.default_rng(1)
    for _ in range(400):
        text = "".join(rng.choice(list("aehtni sdüßxq"), rng.integers(1, 12)))
        line = "\0" * (ORDER - 1) + shape(text)
        if len(line) < ORDER:
            continue
        char = np.array([ord(c) for c in line], np.uint32)
        rows = np.arange(ORDER - 1, len(line))
        want = [[-math.log2(m.p(line[k - ORDER + 1 : k + 1])) for m in plain] for k in rows]
        assert np.abs(model.bits(char, rows) - np.array(want)).max() < 1e-9


@pytest.mark.parametrize("most", [10**6, 7])
def test_probabilities_sum_to_one(most):
    model = fitted(most)
    for j in range(2):
        every = sorted({c for t in (x for v in TEXTS.values() for x in v) for c in shape(t)} | {"\0"})
        own = [c for c in every if langid.Model._look(model.grams[0], langid.gram_hashes(np.array([ord(c)], np.uint32), 1)[0], 0.0)[0, j] > 0]
        for ctx in ("\0\0\0", "\0\0t", "the", "ie\0", "zzz"):
            p = [2 ** -model.bits(np.array([ord(x) for x in ctx + c], np.uint32), np.array([3]))[0, j] for c in [*own, "Ω"]]
            assert abs(sum(p) - 1) < 1e-9


def test_score_is_a_function_of_the_text():
    model = fitted()
    texts = ["est", "the cat", "", "...", "Über die Katze!", "a", "est", None, "\0\0x", "the cat " * 200]
    alone = [langid._judged(langid.Scorer(model), pa.array([t], pa.string())) for t in texts]
    rng = np.random.default_rng(2)
    for _ in range(30):
        order = rng.permutation(len(texts))
        got = langid._judged(langid.Scorer(model), pa.array([texts[k] for k in order], pa.string()))
        for place, k in enumerate(order):
            assert [x[place] for x in got] == [x[0] for x in alone[k]]


def test_equal_entropies_go_to_the_first_language():
    one = fitted()
    tables = {lang: {"floor": one.floor[0], "grams": [(k, v[:, 0]) for k, v in one.grams], "contexts": [(k, v[:, 0]) for k, v in one.contexts]} for lang in ("xb", "xa", "xc")}
    preds, scores, _ = langid._judged(langid.Scorer(langid.Model(tables, ORDER)), pa.array(["the cat", "q"]))
    assert preds == ["xa", "xa"] and all(abs(s - 1 / 3) < 1e-12 for s in scores)


def test_longer_than_a_slice():
    model = fitted()
    long = "the cat sat on the mat " * 30_000
    assert len(long) > 1 << 19 and len(list(slices(pa.array(["a", long, "b"])))) == 3
    got = langid._judged(langid.Scorer(model), pa.array(["über", long, "über"]))
    assert got[0] == ["de", "en", "de"] and got[1][0] == got[1][2]


def test_bytes_that_are_no_utf8():
    from shutterlake.llm.kernels import Texts

    raw = b"ab\xffcd"
    x = langid.Letters(Texts(0, np.frombuffer(raw + b"the", np.uint8), np.array([0, len(raw), len(raw) + 3])), 3)
    assert "".join(map(chr, x.char[x.at[1] :])) == "\0\0\0the"


def test_small_languages_and_names(spark):
    rows = [(i, "le chat est sur la table", "fr", "x") for i in range(3)] + [(10 + i, "der hund ist im haus und schläft", "de", "y") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text string")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    known = {r[2] for r in rows if not got[r[0]]["held_out"]}
    assert all(got[r[0]]["lang_pred"] == r[2] for r in rows if r[2] in known) and not any(got[i]["rejected"] for i in range(10, 210))
    again = {r["doc_id"]: r for r in langid.identify(docs.repartition(5)).collect()}
    assert again == got
    assert langid.drop_rejected(docs).columns == docs.columns
