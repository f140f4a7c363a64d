"""Language identification by character language models: interpolated Kneser-Ney, one model for each language.

Texts are read as lower-case letters with single spaces between words; all else counts as a space. For each language the model
holds, in sorted hash arrays, the discounted probability of each n-gram and the interpolation weight of each context. A text
gets the language with the lowest cross-entropy per character. A text is rejected if even that cross-entropy is above what the
calibration documents of that language show for their length (mean plus ``SIGMAS`` deviations). Every text is scored behind
``order - 1`` spaces of its own and summed in whole numbers, so its result depends on nothing but the text and the model.

Fitting uses a bounded sample: all labelled documents if a language has at most ``sample`` of them, else about ``sample``,
chosen by a hash of doc_id; they are used whole. Each language is fitted by a task of its own, from all n-grams of its sample.
A twentieth of the sample calibrates and is not counted, but for languages with fewer than ``LEAST_CALIBRATED`` documents, which
are counted whole; a language without calibration documents is rejected above the entropy of its alphabet. What is broadcast
is bounded: of the fitted model, the ``most_grams`` most frequent n-grams of the highest order of each language are stored, and
the probability of the others goes to the next lower order of their context, so that probabilities still sum to one.

Defined results: a null text, or one without letters, gets ``und``, score 0 and is rejected; a null language is not learned;
equal cross-entropies go to the language that sorts first; repeated rows get equal results each; a very long text is scored whole,
as a slice of its own; other columns are ignored, whatever their names; with no labelled documents every text gets ``und``.
"""

from __future__ import annotations

import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Texts, flag, frugal, mix, slices

ORDER, SAMPLE, MOST_GRAMS, SIGMAS, FOLDS = 4, 1500, 300_000, 8.0, 5
LEAST_CALIBRATED = 40
UNDETERMINED = "und"
#: Characters beyond this count as evidence that doesn't raise the score further.
EVIDENCE = 200
CACHE_BITS = 18
#: Parts of a bit in which the cost of a character is summed.
PARTS = 1 << 20

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point: its lower-case letter, or 0 if it is no letter."""
    if not _letters:
        out = np.zeros(sys.maxunicode + 1, np.uint32)
        for c in range(0x20000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        out[0x20000:0x32400] = np.arange(0x20000, 0x32400)  # ideographs
        _letters.append(out)
    return _letters[0]


class Letters:
    """The letters of a slice of texts, each behind ``pad`` spaces (0) of its own: those of text i are ``char[at[i]:at[i + 1]]``."""

    def __init__(self, texts, pad: int = 1):
        # Zero bytes between texts keep them apart; zero bytes of their own are spaces all the same.
        places = np.arange(len(texts) + 1) * pad
        spaced = np.zeros(len(texts.buf) + int(places[-1]), np.uint8)
        spaced[np.repeat(places[1:], np.diff(texts.at)) + np.arange(len(texts.buf))] = texts.buf
        points = np.frombuffer(spaced.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        # Where each text starts, in code points: bytes that don't continue a character.
        lead = np.concatenate([[0], np.cumsum((spaced & 0xC0) != 0x80)])
        if lead[-1] != len(points):  # bytes that are not UTF-8: each text is decoded on its own
            clean = [texts.text(i).encode("utf-8", "replace") for i in range(len(texts))]
            self.__init__(Texts(texts.first, np.frombuffer(b"".join(clean), np.uint8), np.concatenate([[0], np.cumsum([len(c) for c in clean])])), pad)
            return
        begin = lead[texts.at + places]
        char = letter_table()[points]
        keep = np.ones(len(char), bool)
        keep[1:] = (char[1:] != 0) | (char[:-1] != 0)
        keep[(begin[:-1, None] + np.arange(pad)).ravel()] = True
        self.char = char[keep]
        self.at = np.concatenate([[0], np.cumsum(keep)])[begin]


def gram_hashes(char: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order k: the hash of the k characters that end at each position (spaces before the first)."""
    out, h = [], np.zeros(len(char), np.uint64)
    for k in range(order):
        part = np.zeros(len(char), np.uint64)
        part[k:] = char[: len(char) - k]
        h = mix(h ^ (part + np.uint64((k + 1) << 32)))
        out.append(h)
    return out


def _count(order: int):
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def run(batches):
        counts: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))

        def drained():
            for lang, own in counts.items():
                grams = list(own)
                for lo in range(0, len(grams), 50_000):
                    part = grams[lo : lo + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([np.frombuffer(g, np.uint32).astype(np.uint32).tobytes().decode("utf-32-le") for g in part]), pa.array([own[g] for g in part], pa.int64())], schema=schema)
            counts.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for texts in slices(batch.column("text")):
                x = Letters(texts, order - 1)
                whole = np.stack([np.concatenate([np.zeros(order - 1 - k, np.uint32), x.char[: len(x.char) - (order - 1 - k)]]) for k in range(order)], axis=1)
                own = np.array([langs[texts.first + i] or "" for i in range(len(texts))])
                for lang in np.unique(own):
                    # The spaces before a text are given, not counted.
                    grams = whole[np.concatenate([np.arange(x.at[i] + order - 1, x.at[i + 1]) for i in np.flatnonzero(own == lang)])]
                    if len(grams):
                        unique, n = np.unique(np.ascontiguousarray(grams).view(f"V{4 * order}").ravel(), return_counts=True)
                        mine = counts[str(lang)]
                        for g, c in zip(unique.tolist(), n.tolist()):
                            mine[g] += c
            if sum(map(len, counts.values())) > 1_000_000:
                yield from drained()
        yield from drained()

    return run


class Model:
    """Sorted hash arrays: for order k, ``grams[k]`` with a column of discounted probabilities for each language, and
    ``contexts[k]`` with the weights that the next lower order gets."""

    def __init__(self, fitted: dict[str, dict], order: int):
        self.langs, self.order = sorted(fitted), order
        per = [fitted[lang] for lang in self.langs]
        self.floor = np.array([p["floor"] for p in per], np.float64)
        self.grams, self.contexts = [], []
        for k in range(order):
            self.grams.append(self._merge([p["grams"][k] for p in per], 0.0))
            self.contexts.append(self._merge([p["contexts"][k] for p in per], 1.0))
        # Until it is calibrated, a language is rejected above the entropy of its alphabet.
        self.mean = np.array([np.log2(len(p["grams"][0][0]) + 1) for p in per])
        self.spread, self.each = np.full(len(per), 0.1), np.full(len(per), 3.0)

    def _merge(self, tables, missing: float):
        keys = np.unique(np.concatenate([t[0] for t in tables]))
        values = np.full((len(keys), len(tables)), missing, np.float64)
        for j, (k, v) in enumerate(tables):
            values[np.searchsorted(keys, k), j] = v
        return keys, values

    @classmethod
    def fit(cls, grams: np.ndarray, n: np.ndarray, most_grams: int = MOST_GRAMS) -> dict:
        """The tables of one language. grams: distinct rows of characters, the last one predicted; n: how often each occurs."""
        order = grams.shape[1]
        out = {"grams": [None] * order, "contexts": [None] * order}
        n = n.astype(np.float64)
        for k in range(order, 0, -1):
            ones, twos = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
            discount = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
            keys = cls._hash(grams)
            context = cls._hash(grams[:, :-1]) if k > 1 else np.zeros(len(grams), np.uint64)
            names, back = np.unique(context, return_inverse=True)
            total, types = np.bincount(back, n), np.bincount(back)
            value, weight = np.maximum(n - discount, 0) / total[back], discount * types / total
            by = np.argsort(keys)
            if k == order and len(keys) > most_grams:
                kept = np.zeros(len(keys), bool)
                kept[np.lexsort((keys, -n))[:most_grams]] = True
                weight = weight + np.bincount(back[~kept], value[~kept], minlength=len(names))
                by = by[kept[by]]
            out["grams"][k - 1] = (keys[by], value[by])
            out["contexts"][k - 1] = (names, weight)
            if k == 1:
                # What is left goes to all characters alike, one unseen character included.
                out["floor"] = discount * len(grams) / total[0] / (len(grams) + 1)
            else:
                # The lower order counts in how many contexts a gram occurs.
                grams, n = np.unique(grams[:, 1:], axis=0, return_counts=True)
                n = n.astype(np.float64)
        return out

    @staticmethod
    def _hash(grams: np.ndarray) -> np.ndarray:
        h = np.zeros(len(grams), np.uint64)
        for k in range(grams.shape[1]):
            h = mix(h ^ (grams[:, grams.shape[1] - 1 - k].astype(np.uint64) + np.uint64((k + 1) << 32)))
        return h

    def bits(self, char: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """-log2 of the probability of each character of ``rows`` after those before it, a column for each language."""
        hashes = gram_hashes(char, self.order)
        before = np.concatenate([np.zeros(1, char.dtype), char[:-1]])
        contexts = [np.zeros(len(char), np.uint64), *gram_hashes(before, self.order - 1)]
        if rows is None:
            rows = np.arange(len(char))
        p = np.broadcast_to(self.floor, (len(rows), len(self.langs))).copy()
        for k in range(self.order):
            if k:
                p *= self._look(self.contexts[k], contexts[k][rows], 1.0)
            p += self._look(self.grams[k], hashes[k][rows], 0.0)
        return -np.log2(p)

    @staticmethod
    def _look(table, keys: np.ndarray, missing: float) -> np.ndarray:
        names, values = table
        place = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        return np.where((names[place] == keys)[:, None], values[place], missing)


class Scorer:
    """Cross-entropies of texts. What the model says of an n-gram is kept in a table, since most n-grams recur."""

    def __init__(self, model: Model):
        self.model = model
        self.known = np.zeros(1 << CACHE_BITS, np.uint64)
        self.cost = np.zeros((1 << CACHE_BITS, len(model.langs)), np.int32)

    def score(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(letters and spaces, mean bits per language) of each text; texts without letters have 0."""
        pad = max(1, self.model.order - 1)
        x = Letters(texts, pad)
        char, at = x.char, x.at
        full = gram_hashes(char, self.model.order)[-1]
        slot = (full >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        rare = np.flatnonzero(self.known[slot] != full)
        value = self.cost.take(slot, axis=0)
        if len(rare):
            unique, first = np.unique(full[rare], return_index=True)
            got = np.rint(self.model.bits(char, rare[first]) * PARTS).astype(np.int32)
            value[rare] = got[np.searchsorted(unique, full[rare])]
            self.cost[slot[rare]], self.known[slot[rare]] = value[rare], full[rare]
        value[(at[:-1, None] + np.arange(pad)).ravel()] = 0  # the spaces before a text are given
        total = np.stack([np.add.reduceat(value[:, j], at[:-1], dtype=np.int64) for j in range(value.shape[1])], axis=1)
        n = np.diff(at) - pad
        letters = np.concatenate([[0], np.cumsum(char != 0)])
        n = np.where(letters[at[1:]] > letters[at[:-1]], n, 0)
        return n, total / PARTS / np.maximum(n, 1)[:, None]


def _is_training():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != 0


def _fitted(order: int, most_grams: int):
    """One row with the tables of one language, of all rows of its n-grams."""

    def run(key, table):
        own = table.sort_by("gram")
        grams = np.frombuffer("".join(own.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).reshape(own.num_rows, order)
        by = np.lexsort(grams.T)
        p = Model.fit(grams[by], own.column("n").to_numpy()[by], most_grams)
        packed = [[t[0].astype("<u8").tobytes(), t[1].astype("<f8").tobytes()] for t in (*p["grams"], *p["contexts"])]
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "floor": pa.array([p["floor"]]), "tables": pa.array([[x for pair in packed for x in pair]], pa.list_(pa.binary()))})

    return run


def _unpacked(row, order: int) -> dict:
    parts = [np.frombuffer(x, ("<u8", "<f8")[k % 2]) for k, x in enumerate(row["tables"])]
    pairs = list(zip(parts[::2], parts[1::2]))
    return {"floor": row["floor"], "grams": pairs[:order], "contexts": pairs[order:]}


def fit(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE, most_grams: int = MOST_GRAMS) -> Model | None:
    """A model of the labelled documents outside the held-out fold, or None if there are none."""
    labelled = docs.select("doc_id", "text", "lang").where("lang is not null").where(_is_training())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(1_000_000))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(max(1, int(1_000_000 * min(1.0, sample / n)))))])
    often = F.col("lang").isin([lang for lang, n in sizes.items() if n >= LEAST_CALIBRATED])
    chosen = labelled.where(draw < share[F.col("lang")]).withColumn("calibrates", often & (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(29)), F.lit(20)) == 0))
    counted = chosen.where("not calibrates").mapInArrow(frugal(_count(order)), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counted.groupBy("lang").applyInArrow(_fitted(order, most_grams), "lang string, floor double, tables array<binary>").collect()
    if not rows:
        return None
    model = Model({r["lang"]: _unpacked(r, order) for r in rows}, order)
    handle = docs.sparkSession.sparkContext.broadcast(model)
    _calibrate(model, chosen.where("calibrates").mapInArrow(_entropies(handle), "lang string, chars long, bits double").toArrow())
    return model


def _entropies(handle):
    schema = pa.schema([("lang", pa.string()), ("chars", pa.int64()), ("bits", pa.float64())])

    def run(batches):
        scorer = Scorer(handle.value)
        place = {lang: i for i, lang in enumerate(handle.value.langs)}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for texts in slices(batch.column("text")):
                n, bits = scorer.score(texts)
                own = [langs[texts.first + i] for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n), pa.array([float(bits[i, place[x]]) if x in place else None for i, x in enumerate(own)], pa.float64())], schema=schema)

    return run


def _calibrate(model: Model, table: pa.Table) -> None:
    """Mean and deviation of the cross-entropy of each language: a part that all texts have, and one that falls with length."""
    langs, n, bits = table.column("lang").to_pylist(), table.column("chars").to_numpy(), table.column("bits").to_numpy()
    langs = np.array(langs, dtype=object)
    for j, lang in enumerate(model.langs):
        own = (langs == lang) & (n > 0)
        if not own.any():
            continue
        h, m = bits[own], n[own]
        model.mean[j] = np.average(h, weights=m)
        model.spread[j] = max(0.1, float(np.std(h[m >= np.median(m)])))
        model.each[j] = max(3.0, float(np.sqrt(np.mean(m * (h - model.mean[j]) ** 2))))


def _judged(scorer: Scorer, column) -> tuple[list[str], list[float], list[bool]]:
    """(language, score, rejected) of a column of texts."""
    model = scorer.model
    preds, scores, rejected = [], [], []
    for texts in slices(column):
        n, bits = scorer.score(texts)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(n)), best]
        weight = np.minimum(n, EVIDENCE) / 4.0
        score = 1.0 / np.exp2(-(bits - low[:, None]) * weight[:, None]).sum(axis=1)
        far = low > model.mean[best] + SIGMAS * np.sqrt(model.spread[best] ** 2 + model.each[best] ** 2 / np.maximum(n, 1))
        preds += [model.langs[b] if m else UNDETERMINED for b, m in zip(best.tolist(), n.tolist())]
        scores += np.where(n > 0, score, 0.0).tolist()
        rejected += ((n == 0) | far).tolist()
    return preds, scores, rejected


def _recognised(handle):
    def run(columns):
        scorer = Scorer(handle.value)
        for column in columns:
            yield pa.array([not x for x in _judged(scorer, column)[2]], pa.bool_())

    return run


def _predict(handle, keep: int):
    def run(batches):
        scorer = Scorer(handle.value)
        for batch in batches:
            preds, scores, rejected = _judged(scorer, batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(keep)], pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names[:keep], "_lang", "_score", "_rejected"])

    return run


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every document with _lang, _score and _rejected."""
    kept = docs.select(*keep, F.col(text_col))
    if model is None:
        return docs.select(*keep).withColumns({"_lang": F.lit(UNDETERMINED), "_score": F.lit(0.0), "_rejected": F.lit(True)})
    schema = docs.select(*keep).withColumns({"_lang": F.lit(""), "_score": F.lit(0.0), "_rejected": F.lit(True)}).schema
    handle = docs.sparkSession.sparkContext.broadcast(model)
    return kept.mapInArrow(frugal(_predict(handle, len(keep))), schema)


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every document; learned outside the held-out fold."""
    out = predict(docs, fit(docs, **options), ["doc_id"])
    return out.select("doc_id", (~_is_training()).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


def drop_rejected(docs: DataFrame, **options) -> DataFrame:
    """The documents whose language is recognised, unchanged."""
    model = fit(docs, **options)
    if model is None:
        return docs.where(F.lit(False))
    return docs.where(flag(_recognised(docs.sparkSession.sparkContext.broadcast(model)))("text"))
