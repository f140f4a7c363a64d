"""Benchmark decontamination: a broadcast hash set of the windows of test items is looked up at every word of the documents.

Words are those of ``kernels.WORD``, ASCII case folded. A window is ``size`` consecutive words of an item; an item with fewer,
but not none, is one window. Every hash hit is verified on the words themselves before it counts.

The set holds 16 bytes for each window and the items' words once, and is broadcast while it has at most ``most_windows`` windows.
A larger benchmark stays a table: a bitmap of its hashes (of ``BITS_WIDE`` bits, whatever its size) is broadcast instead, the few
windows of documents that pass it are joined to the table on hash and words, and what the joins find is gathered by document.
Both ways find the same.

Defined results: a null text has no words, hits or items and is never contaminated; a null item has no windows; items that
share a window each count; repeated rows each get their own, equal result; a text of any length is read whole, as a slice of its
own; other columns stay as they are, whatever their names; an empty table of either kind works. Item ids are compared and joined
as strings; a null id counts as an empty one.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import Texts, Words, flag, frugal, grams, slices
from .shared import Scratch, bitmap, in_bitmap, written

WINDOW, MOST_WINDOWS, MOST_CHARS = 13, 4_000_000, 200_000_000
BITS, BITS_WIDE = 20, 28
WORDS = "[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+"
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


class Windows:
    """The windows of some items: by length, sorted hashes with the item and the place of each in the items' joined words."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        self.names = [name for name, _ in items]
        found: dict[int, list[tuple]] = defaultdict(list)
        joined, base = [], 0
        for texts in slices(pa.array([t for _, t in items], pa.string())):
            words = Words(texts)
            for i in range(len(texts)):
                lo, hi = int(words.at[i]), int(words.at[i + 1])
                length = min(size, hi - lo)
                if not length:
                    continue
                own = words.joined(lo, hi)
                joined.append(own)
                ends = np.cumsum(words.ends[lo:hi] - words.starts[lo:hi] + 1) - 1
                starts = np.concatenate([[0], ends[:-1] + 1])
                n = hi - lo - length + 1
                found[length].append((grams(words.hash[lo:hi], length), np.full(n, texts.first + i), base + starts[:n], base + ends[length - 1 :]))
                base += len(own)
        self.words = b"".join(joined)
        self.tables = []
        for length, parts in sorted(found.items()):
            columns = [np.concatenate(c) for c in zip(*parts)]
            order = np.lexsort((columns[2], columns[1], columns[0]))
            hashes, item, start, end = (c[order] for c in columns)
            # A window that an item repeats counts once.
            keep = np.ones(len(hashes), bool)
            for k in np.flatnonzero((hashes[1:] == hashes[:-1]) & (item[1:] == item[:-1])) + 1:
                keep[k] = self.words[start[k] : end[k]] != self.words[start[k - 1] : end[k - 1]]
            self.tables.append((length, hashes[keep], item[keep].astype(np.uint32), start[keep].astype(np.uint32), (end - start)[keep].astype(np.uint32)))

    def names_of(self, table, place: int, window: bytes) -> list[str]:
        """The items that have the window, whose hash is that of the row ``place`` and those after it."""
        _, hashes, item, start, size = table
        out, h = [], hashes[place]
        while place < len(hashes) and hashes[place] == h:
            if self.words[start[place] : int(start[place]) + int(size[place])] == window:
                out.append(self.names[item[place]])
            place += 1
        return out


class Sought:
    """Looks windows up: a bitmap first, then the sorted hashes, then the words."""

    def __init__(self, windows: Windows):
        self.windows, self.flags = windows, []
        for table in windows.tables:
            flags = np.zeros(1 << BITS, bool)
            flags[(table[1] >> np.uint64(64 - BITS)).astype(np.int64)] = True
            self.flags.append(flags)

    def hits(self, texts: Texts, words: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are in an occurring window, and the items found in each text."""
        cover = np.zeros(len(words.hash) + 1, np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        for table, flags in zip(self.windows.tables, self.flags):
            length, hashes = table[:2]
            h = grams(words.hash, length)
            maybe = np.flatnonzero(flags[(h >> np.uint64(64 - BITS)).astype(np.int64)])
            place = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
            same = hashes[place] == h[maybe]
            maybe, place = maybe[same], place[same]
            text = np.searchsorted(words.at, maybe, "right") - 1
            for k, i, p in zip(maybe.tolist(), text.tolist(), place.tolist()):
                if k + length > words.at[i + 1]:
                    continue  # the window would reach into the next text
                names = self.windows.names_of(table, p, words.joined(k, k + length))
                if names:
                    cover[k] += 1
                    cover[k + length] -= 1
                    items[i].update(names)
        return np.cumsum(cover[:-1]) > 0, items

    def found(self, column) -> tuple[list[int], list[list[int]], list[list[str]]]:
        """(number of words, spans of hit words, items) of a column of texts."""
        n_words, spans, items = [], [], []
        for texts in slices(column):
            words = Words(texts)
            hit, names = self.hits(texts, words)
            n_words += words.counts().tolist()
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            own: dict[int, list[int]] = defaultdict(list)
            # A run of hit words may hold the end of one text and the start of the next.
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                i = int(np.searchsorted(words.at, s, "right")) - 1
                while s < e:
                    stop = min(e, int(words.at[i + 1]))
                    if stop > s:
                        own[i] += [s - int(words.at[i]), stop - int(words.at[i])]
                    s, i = max(s, stop), i + 1
            spans += [own.get(i, []) for i in range(len(texts))]
            items += [sorted(names.get(i, ())) for i in range(len(texts))]
        return n_words, spans, items


def _clean(handle):
    def run(columns):
        sought = Sought(handle.value)
        for column in columns:
            hits = ((n, sum(own[1::2]) - sum(own[::2])) for n, own, _ in zip(*sought.found(column)))
            yield pa.array([not (hit > 0 and 20 * hit >= n) for n, hit in hits], pa.bool_())

    return run


def _scan(handle):
    """row and text become row, n_words, spans and items."""

    def run(batches):
        sought = Sought(handle.value)
        for batch in batches:
            n_words, spans, items = sought.found(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["row", *HITS.names])

    return run


def _broadcast(benchmark: DataFrame, item_col: str, item_text: str, size: int, most_windows: int):
    """The windows as a broadcast variable, or None if there are more than ``most_windows``."""
    text = F.coalesce(F.col(item_text), F.lit(""))
    n = F.regexp_count(text, F.lit(WORDS))
    sizes = benchmark.select(F.sum(F.when(n > 0, F.greatest(n - (size - 1), F.lit(1)))).alias("windows"), F.sum(F.length(text)).alias("chars"), F.count("*").alias("items")).first()
    if max(sizes["windows"] or 0, sizes["items"]) > most_windows or (sizes["chars"] or 0) > MOST_CHARS:
        return None
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).collect()
    return benchmark.sparkSession.sparkContext.broadcast(Windows([(r["i"], r["t"]) for r in rows], size))


# A benchmark that is too large to broadcast.


def _bench_windows(size: int):
    schema = pa.schema([("length", pa.int32()), ("hash", pa.int64()), ("words", pa.binary()), ("item", pa.string())])

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            for texts in slices(batch.column(1)):
                words = Words(texts)
                for i in range(len(texts)):
                    lo, hi = int(words.at[i]), int(words.at[i + 1])
                    length = min(size, hi - lo)
                    if length:
                        h = grams(words.hash[lo:hi], length)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), length, np.int32)), pa.array(h.view(np.int64)), pa.array([words.joined(lo + k, lo + k + length) for k in range(len(h))], pa.binary()), pa.array([names[texts.first + i]] * len(h), pa.string())], schema=schema)

    return run


CANDIDATES = "array<struct<k:bigint,length:int,hash:bigint,words:binary>>"


def _candidates(handle, lengths: list[int]):
    """row and text become row, n_words and the windows whose hash is in the bitmap."""
    kind = pa.list_(pa.struct([("k", pa.int64()), ("length", pa.int32()), ("hash", pa.int64()), ("words", pa.binary())]))

    def run(batches):
        bits = handle.value
        for batch in batches:
            n_words, out = [], []
            for texts in slices(batch.column(1)):
                words = Words(texts)
                own: list[list] = [[] for _ in range(len(texts))]
                for length in lengths:
                    h = grams(words.hash, length)
                    maybe = np.flatnonzero(in_bitmap(bits, h))
                    for k, i in zip(maybe.tolist(), (np.searchsorted(words.at, maybe, "right") - 1).tolist()):
                        if k + length <= words.at[i + 1]:
                            own[i].append((k - int(words.at[i]), length, int(h[k].view(np.int64)), words.joined(k, k + length)))
                n_words += words.counts().tolist()
                out += own
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array([[dict(zip(("k", "length", "hash", "words"), x)) for x in o] for o in out], kind)], names=["row", "n_words", "found"])

    return run


def _spans(batches):
    """id, starts, ends and items of a document's hits become id, spans of hit words and items."""
    schema = pa.schema([("id", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
    for batch in batches:
        spans = []
        for starts, lengths in zip(batch.column("starts").to_pylist(), batch.column("lengths").to_pylist()):
            own: list[int] = []
            for s, e in sorted((s, s + n) for s, n in zip(starts, lengths)):
                if own and s <= own[-1]:
                    own[-1] = max(own[-1], e)
                else:
                    own += [s, e]
            spans.append(own)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, pa.list_(pa.int64())), batch.column("items").cast(pa.list_(pa.string()))], schema=schema)


def _scan_joined(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, size: int) -> DataFrame:
    spark = rows.sparkSession
    scratch = Scratch(spark)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t"))
    windows = scratch.written(items.mapInArrow(frugal(_bench_windows(size)), "length int, hash long, words binary, item string").distinct(), "bench-windows")
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())
    handle = spark.sparkContext.broadcast(bitmap(windows.select("hash"), BITS_WIDE))
    kind = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("found", T._parse_datatype_string(CANDIDATES))])
    table = written(rows.mapInArrow(frugal(_candidates(handle, lengths)), kind).withColumn("id", F.monotonically_increasing_id()), "bench-candidates")
    sought = table.where("size(found) > 0").select("id", F.explode("found").alias("x")).select("id", "x.*")
    hits = sought.join(windows, ["length", "hash", "words"]).groupBy("id").agg(F.collect_list("k").alias("starts"), F.collect_list("length").alias("lengths"), F.sort_array(F.collect_set("item")).alias("items"))
    hits = written(hits.mapInArrow(_spans, "id long, spans array<long>, items array<string>"), "bench-hits")
    scratch.drop()
    none = F.array().cast("array<long>")
    return table.join(hits, "id", "left").select("row", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """row (a struct of the columns ``keep``), n_words, spans (of hit words: start, end, start, ...) and items of every document."""
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text_col))
    handle = _broadcast(benchmark, item_col, item_text, size, most_windows)
    if handle is None:
        return _scan_joined(rows, benchmark, item_col, item_text, size)
    return rows.mapInArrow(frugal(_scan(handle)), T.StructType([rows.schema["row"], *HITS]))


def _hit():
    return F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (s, x) -> s + x)")


def _contaminated():
    return (_hit() > 0) & (20 * _hit() >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    found = scan(docs, benchmark, ["doc_id"], **options)
    return found.select("row.doc_id", "n_words", _hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), _contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    handle = _broadcast(benchmark, item_col, item_text, size, most_windows)
    if handle is not None:
        return docs.where(flag(_clean(handle))(text_col))
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col))
    return _scan_joined(rows, benchmark, item_col, item_text, size).where(~_contaminated()).select("row.*")


def _cut(batches):
    """row, text, spans: the text loses its spans."""
    for batch in batches:
        out = []
        for texts in slices(batch.column(1)):
            words = Words(texts)
            for i in range(len(texts)):
                raw, base = texts.bytes(i), int(words.at[i])
                spans = batch.column(2)[texts.first + i].as_py()
                kept, last = [], 0
                for s, e in zip(spans[::2], spans[1::2]):
                    kept.append(raw[last : int(words.starts[base + s] - texts.at[i])])
                    last = int(words.ends[base + e - 1] - texts.at[i])
                out.append(b"".join([*kept, raw[last:]]).decode("utf-8", "replace") if batch.column(1)[texts.first + i].is_valid else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "cut"])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All documents, without the hit words and what stands between words that are hit alike; the rest of a text stays as it is."""
    found = scan(docs, benchmark, [F.col(f"`{c}`") for c in docs.columns], text_col=text_col, **options)
    found = found.select("row", F.col("row").getField(text_col).alias("text"), "spans")
    cut = found.mapInArrow(frugal(_cut), T.StructType([found.schema["row"], T.StructField("cut", T.StringType())]))
    return cut.select(*[F.col("cut").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
