"""Quality classifier from weak labels.

Overlapping heuristic labellers each call a document good, bad or abstain. Expectation-maximisation (a class prior and two
accuracies for each labeller, abstentions carrying no weight) estimates from the counts of all vote patterns of all documents
how far each labeller can be trusted, and gives every pattern a posterior probability of being good. Those posteriors are the
targets of a hashed linear scorer (logistic, on normalised counts of word shapes, words and word pairs in ``BUCKETS`` buckets,
and on the labellers' measures), fitted on a bounded sample of about ``sample`` documents chosen by a hash.

Patterns number at most 3 to the number of labellers, so what the driver gets is bounded. No document's gold label is read.

Defined results: null and wordless texts have no votes but bad from ``length`` and score 0; equal texts get equal scores, repeated
rows too; a text of any length is measured whole, as a slice of its own; a pattern whose votes balance gets the prior's side;
columns but doc_id and text are ignored, whatever their names; an empty table gives no rows (the scorer is then constant).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Words, frugal, mix, shingles, slices, sums

BUCKETS, SAMPLE, ROUNDS, EPOCHS, RATE, DECAY = 1 << 14, 6000, 50, 12, 0.5, 1e-4
KEEP = 0.5

#: Labeller, and the bounds at which it says good and bad: good if at most (or at least), bad if at least (or at most).
LABELLERS = {
    "symbols": (0.01, 0.04),
    "capitals": (0.12, 0.35),
    "repeats": (0.06, 0.25),
    "variety": (0.45, 0.25),
    "lines": (0.15, 0.35),
    "bars": (0.02, 0.15),
    "shouts": (0.02, 0.10),
    "sentences": (0.02, 0.004),
    "length": (25, 0),
}
UPWARD = frozenset(("variety", "sentences", "length"))

_b = np.arange(256)
_SENTENCE, _UP, _LETTER = np.isin(_b, list(b".,;?")), (_b >= 65) & (_b <= 90), ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122))
_SYMBOL = (_b > 32) & (_b < 127) & ~_LETTER & ~((_b >= 48) & (_b <= 57)) & ~np.isin(_b, list(b".,;:?!'\"-()|"))


def _ratio(flags: np.ndarray, at: np.ndarray, by: np.ndarray) -> np.ndarray:
    return sums(flags.astype(np.int64), at) / np.maximum(by, 1)


def measures(texts, words: Words) -> dict[str, np.ndarray]:
    """What the labellers look at, for each text of a slice."""
    buf, at, n = texts.buf, texts.at, words.counts()
    size = np.diff(at)
    owner = np.repeat(np.arange(len(texts)), n)
    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1])
    # Distinct words of each text, of its first occurrence in (text, hash) order.
    order = np.lexsort((words.hash, owner))
    new = np.ones(len(order), bool)
    new[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=len(texts))
    lines = np.zeros(len(texts))
    for i in range(len(texts)):
        own = [x for x in texts.bytes(i).split(b"\n") if x.strip()]
        lines[i] = 1 - len(set(own)) / len(own) if len(own) > 3 else 0.0
    return {
        "symbols": _ratio(_SYMBOL[buf], at, size),
        "capitals": _ratio(_UP[buf], at, sums(_LETTER[buf].astype(np.int64), at)),
        "repeats": _ratio(again, words.at, n),
        # Longer texts repeat more words: the number of distinct words is set against a power of the length.
        "variety": distinct / np.maximum(n, 1) ** 0.9,
        "lines": lines,
        "bars": _ratio(buf == ord("|"), at, n),
        "shouts": _ratio(buf == ord("!"), at, n),
        "sentences": _ratio(_SENTENCE[buf], at, size),
        "length": n.astype(np.float64),
    }


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """1 good, -1 bad, 0 abstains; a column for each labeller. Texts of under 8 words are judged by their length alone."""
    out = []
    for name, (good, bad) in LABELLERS.items():
        x = found[name]
        v = np.where(x >= good, 1, np.where(x <= bad, -1, 0)) if name in UPWARD else np.where(x <= good, 1, np.where(x >= bad, -1, 0))
        out.append(np.where((found["length"] < 8) & (name != "length"), 0, v))
    return np.stack(out, axis=1).astype(np.int8)


def patterns(v: np.ndarray) -> list[str]:
    return ["".join("-0+"[x + 1] for x in row) for row in v.tolist()]


def expect(table: dict[str, int], rounds: int = ROUNDS) -> tuple[dict[str, float], float, np.ndarray]:
    """(posterior of good for each pattern, prior, accuracies of each labeller on good and on bad documents)."""
    names = sorted(table)
    v = np.array([["-0+".index(c) - 1 for c in p] for p in names], np.int8).reshape(len(names), len(LABELLERS))
    n = np.array([table[p] for p in names], np.float64)
    # Start from the majority, the labellers being better than chance.
    q = 1 / (1 + np.exp(-v.sum(axis=1) * 1.0))
    prior, right = 0.5, np.full((2, v.shape[1]), 0.7)
    for _ in range(rounds):
        prior = float(np.clip((n * q).sum() / max(n.sum(), 1e-9), 0.02, 0.98))
        for c, w in enumerate((n * q, n * (1 - q))):
            said = (w[:, None] * (v == (1, -1)[c])).sum(axis=0)
            spoke = (w[:, None] * (v != 0)).sum(axis=0)
            right[c] = np.clip((said + 7) / (spoke + 10), 0.05, 0.99)
        logit = np.log(prior / (1 - prior)) + np.where(v > 0, np.log(right[0] / (1 - right[1])), np.where(v < 0, np.log((1 - right[0]) / right[1]), 0.0)).sum(axis=1)
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return dict(zip(names, q.tolist())), prior, right


def features(texts, words: Words, found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, where each text's begin, dense measures)."""
    pairs, pat = shingles(words, 2)
    bucket = lambda h: (mix(h) >> np.uint64(64 - 14)).astype(np.int64)
    dense = np.stack([np.ones(len(texts)), *[np.clip(found[k] / max(abs(bad - good), abs(good), 1e-6) / (1 if k != "length" else 40), 0, 3) for k, (good, bad) in LABELLERS.items()]], axis=1)
    n1, n2 = np.diff(words.at), np.diff(pat)
    at = np.concatenate([[0], np.cumsum(n1 + n2)])
    out = np.empty(at[-1], np.int64)
    base = at[:-1]
    out[np.repeat(base - words.at[:-1], n1) + np.arange(n1.sum())] = bucket(words.hash)
    out[np.repeat(base + n1 - pat[:-1], n2) + np.arange(n2.sum())] = bucket(pairs ^ np.uint64(7))
    return out, at, dense


def linear(weights: tuple[np.ndarray, np.ndarray], f) -> np.ndarray:
    buckets, at, dense = f
    n = np.maximum(np.diff(at), 1)
    return sums(weights[0][buckets], at) / np.sqrt(n) + dense @ weights[1]


def _vote(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("pattern", pa.string())])
    for batch in batches:
        for texts in slices(batch.column("text")):
            words = Words(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(texts.first, len(texts)).cast(pa.int64()), pa.array(patterns(votes(measures(texts, words))))], schema=schema)


def _sampled(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("pattern", pa.string()), ("buckets", pa.binary()), ("dense", pa.binary())])
    for batch in batches:
        for texts in slices(batch.column("text")):
            words = Words(texts)
            found = measures(texts, words)
            f = features(texts, words, found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(texts.first, len(texts)).cast(pa.int64()),
                    pa.array(patterns(votes(found))),
                    pa.array([f[0][f[1][i] : f[1][i + 1]].astype("<u2").tobytes() for i in range(len(texts))], pa.binary()),
                    pa.array([f[2][i].astype("<f8").tobytes() for i in range(len(texts))], pa.binary()),
                ],
                schema=schema,
            )


def train(rows: pa.Table, posterior: dict[str, float], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the buckets and of the measures, by AdaGrad; each epoch takes the sample, sorted by its contents, in a seeded permutation."""
    rows = rows.sort_by([("doc_id", "ascending"), ("pattern", "ascending"), ("buckets", "ascending")])
    width = 1 + len(LABELLERS)
    w, d = np.zeros(BUCKETS), np.zeros(width)
    gw, gd = np.full(BUCKETS, 1e-3), np.full(width, 1e-3)
    each = [(np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(x, "<f8"), posterior[p]) for p, b, x in zip(*(rows.column(c).to_pylist() for c in ("pattern", "buckets", "dense")))]
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(epochs):
        order = rng.permutation(len(each)).tolist()
        for lo in range(0, len(each), 64):
            part = [each[k] for k in order[lo : lo + 64]]
            at = np.concatenate([[0], np.cumsum([len(p[0]) for p in part])])
            f = (np.concatenate([p[0] for p in part]), at, np.stack([p[1] for p in part]))
            error = 1 / (1 + np.exp(-np.clip(linear((w, d), f), -30, 30))) - np.array([p[2] for p in part])
            n = np.maximum(np.diff(at), 1)
            g = np.bincount(f[0], np.repeat(error / np.sqrt(n), np.diff(at)), minlength=BUCKETS) / len(part) + DECAY * w
            h = f[2].T @ error / len(part)
            gw += g * g
            gd += h * h
            w -= RATE * g / np.sqrt(gw) * (np.abs(g) > 0) * 0.05
            d -= RATE * h / np.sqrt(gd)
    return w, d


def _score(handle):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("posterior", pa.float64()), ("votes", pa.string())])

    def run(batches):
        weights, posterior, prior = handle.value
        for batch in batches:
            for texts in slices(batch.column("text")):
                words = Words(texts)
                found = measures(texts, words)
                s = 1 / (1 + np.exp(-np.clip(linear(weights, features(texts, words, found)), -30, 30)))
                s = np.where(words.counts() > 0, s, 0.0)
                p = patterns(votes(found))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(texts.first, len(texts)).cast(pa.int64()), pa.array(np.round(s, 9)), pa.array([posterior.get(x, prior) for x in p], pa.float64()), pa.array(p)], schema=schema)

    return run


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score (0 to 1), posterior (of the labellers' votes), votes and keep (score of at least KEEP) for every document."""
    own = docs.select("doc_id", "text")
    table = {r["pattern"]: r["n"] for r in own.mapInArrow(frugal(_vote), "doc_id long, pattern string").groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    total = sum(table.values())
    if not total:
        weights, posterior, prior = (np.zeros(BUCKETS), np.zeros(1 + len(LABELLERS))), {}, 0.5
    else:
        posterior, prior, _ = expect(table)
        share = max(1, int(1_000_000 * min(1.0, sample / total)))
        chosen = own.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(41)), F.lit(1_000_000)) < share)
        weights = train(chosen.mapInArrow(frugal(_sampled), "doc_id long, pattern string, buckets binary, dense binary").toArrow(), posterior)
    handle = docs.sparkSession.sparkContext.broadcast((weights, posterior, prior))
    scored = own.mapInArrow(frugal(_score(handle)), "doc_id long, score double, posterior double, votes string")
    return scored.withColumn("keep", F.col("score") >= KEEP)
