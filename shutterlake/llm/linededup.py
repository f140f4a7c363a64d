"""Line deduplication by pairwise alignment.

Documents that overlap are found through the hashes of their runs of lines that reach ``least_words`` words and would not without
their last, or without their first, line (at most two for each line). Every line of a common block of so many words lies in such a
run inside the block: the run from the block's first line on, or beyond it the run that ends with the line. A rare run (in at most
``rare`` documents) pairs each of its documents with every earlier one; a more frequent run pairs each of its documents with the
first that has it, and with the first that has it as often, so that pairs stay in proportion to lines. Where that leaves a
frequent run standing (the first document has it in another order), the document is paired with all earlier ones that have the run;
the result is that of all pairs. Each pair is aligned by patience diff on the line hashes (unique common
lines, longest increasing chain, then the same between the anchors, equal lines next to anchors included; where no common line is
unique, the longest common block is the anchor). Aligned common
blocks of at least ``least_words`` words are deleted from the later document. A hash of 128 bits stands for a line.

The earlier document is the one with the lower doc_id (null first; of equal ids the one whose text has the lower hash); since it is
the original text that is aligned, what is deleted somewhere is kept by the first document that has it. Rows carry a number of
their own, so that equal ids or texts are never taken for each other. A run that many documents have and a document that many
are paired with are brought to their rows, which are not gathered.

Defined results: lines are split at \\n and compared without surrounding white space; lines without words count in no block and
stay; a null text has no lines and stays null; of rows equal in doc_id and text one is the first; a text of any length is aligned
whole; columns but doc_id and text stay, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import frugal, slices
from .shared import Scratch, hot, join_unique, member, written

RARE, LEAST_WORDS = 8, 20
#: Of the bitmap of rows that lose lines, as a power of 2.
BITS = 27
DOC = pa.struct([("doc_id", pa.int64()), ("hash", pa.int64()), ("row", pa.int64())])
DOC_KIND = "struct<doc_id:bigint,hash:bigint,row:bigint>"


def _lines(batches):
    """kept, doc_id, hash and text become kept, doc_id, hash, lines (their digests) and words."""
    for batch in batches:
        for texts in slices(batch.column(3)):
            lines, words = [], []
            for i in range(len(texts)):
                own = [ln.split() for ln in texts.text(i).split("\n")]
                lines.append([hashlib.blake2b(" ".join(w).encode("utf-8", "replace"), digest_size=16).digest() if w else None for w in own])
                words.append([len(w) for w in own])
            part = [batch.column(k).slice(texts.first, len(texts)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*part, pa.array(lines, pa.list_(pa.binary())), pa.array(words, pa.list_(pa.int32()))], names=["kept", "doc_id", "hash", "lines", "words"])


def least_runs(lines: list, words: list[int], least_words: int) -> dict[bytes, list[list[int]]]:
    """The places of each run of lines with at least so many words that has fewer without its last, or without its first, line; None is no line."""
    full = [k for k, h in enumerate(lines) if h is not None]
    total = [0, *accumulate(words[k] for k in full)]
    spans, lo, hi = set(), 0, 0
    for k in range(len(full)):
        while hi < len(full) and (hi <= k or total[hi] - total[k] < least_words):
            hi += 1
        if total[hi] - total[k] >= least_words:
            spans.add((k, hi))
        while lo < k and total[k + 1] - total[lo + 1] >= least_words:
            lo += 1
        if total[k + 1] - total[lo] >= least_words:
            spans.add((lo, k + 1))
    out: dict[bytes, list[list[int]]] = {}
    for i, j in sorted(spans):
        out.setdefault(b"".join(lines[x] for x in full[i:j]), []).append(full[i:j])
    return out


def _key(run: bytes, time: int = 0) -> int:
    return xxhash.xxh64_intdigest(run, time) - (1 << 63)


def _runs(least_words: int):
    schema = pa.schema([("doc", DOC), ("run", pa.int64())])

    def run(batches):
        for batch in batches:
            places, own = [], []
            for k, (lines, words) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lines", "words")))):
                found = [_key(x, t) for x, at in least_runs(lines, words, least_words).items() for t in range(len(at))]
                places += [k] * len(found)
                own += found
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(places, pa.int64())).cast(DOC), pa.array(own, pa.int64())], schema=schema)

    return run


def _standing(least_words: int):
    """Those of the column ``runs`` that stand somewhere in a document with a line that is not in ``gone``."""
    schema = pa.schema([("doc", DOC), ("run", pa.int64())])

    def run(batches):
        for batch in batches:
            where, own = [], []
            for k, (lines, words, runs, gone) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lines", "words", "runs", "gone")))):
                runs, gone = set(runs), set(gone or ())
                found = [_key(x) for x, places in least_runs(lines, words, least_words).items() if _key(x) in runs and not all(gone.issuperset(p) for p in places)]
                where += [k] * len(found)
                own += found
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(where, pa.int64())).cast(DOC), pa.array(own, pa.int64())], schema=schema)

    return run


def chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs that rise in both places; pairs are sorted by the first."""
    tails, at, back = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back[k] = at[p - 1] if p else -1
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def longest_block(a: list, b: list) -> tuple[int, int, int]:
    """Where the longest common block begins in a and in b (the first such end in b), and its length; by a's suffix automaton."""
    step, link, size, end = [{}], [-1], [0], [0]
    last = 0
    for k, x in enumerate(a):
        new, p = len(size), last
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        end.append(k + 1)
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if size[q] > size[p] + 1:
                copy = len(size)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                end.append(end[q])
                link[q] = copy
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = copy
                    p = link[p]
                q = copy
            link[new] = q
        last = new
    best, at, n = (0, 0, 0), 0, 0
    for k, x in enumerate(b):
        while at and x not in step[at]:
            at = link[at]
            n = size[at]
        if x in step[at]:
            at, n = step[at][x], n + 1
            if n > best[2]:
                best = (end[at] - n, k + 1 - n, n)
    return best


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of aligned equal lines, rising in both; None is no line."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        once_a: dict = {}
        for i in range(alo, ahi):
            once_a[a[i]] = -1 if a[i] in once_a else i
        once_b: dict = {}
        for j in range(blo, bhi):
            if b[j] is not None and b[j] in once_a:
                once_b[b[j]] = -1 if b[j] in once_b else j
        anchors = chain(sorted((once_a[h], j) for h, j in once_b.items() if j >= 0 and once_a[h] >= 0))
        if not anchors:
            full_a = [i for i in range(alo, ahi) if a[i] is not None]
            full_b = [j for j in range(blo, bhi) if b[j] is not None]
            i, j, n = longest_block([a[x] for x in full_a], [b[x] for x in full_b]) if once_b else (0, 0, 0)
            anchors = list(zip(full_a[i : i + n], full_b[j : j + n]))
        if not anchors:
            continue
        i0, j0 = alo, blo
        for i, j in [*anchors, (ahi, bhi)]:
            if i0 < i and j0 < j:
                todo.append((i0, i, j0, j))
            if i < ahi or j < bhi:
                out.append((i, j))
            i0, j0 = i + 1, j + 1
    return sorted((i, j) for i, j in set(out) if a[i] is not None)


def doomed(a: list, b: list, words: list[int], least_words: int) -> list[int]:
    """Lines of b in aligned blocks of at least so many words; lines without words neither end nor count in a block."""
    out, block = [], []
    pairs = patience(a, b)
    for k, (i, j) in enumerate(pairs):
        if block:
            i0, j0 = pairs[k - 1]
            if any(x is not None for x in a[i0 + 1 : i]) or any(x is not None for x in b[j0 + 1 : j]):
                if sum(words[x] for x in block) >= least_words:
                    out += block
                block = []
        block.append(j)
    if sum(words[x] for x in block) >= least_words:
        out += block
    return out


def _align(least_words: int):
    schema = pa.schema([("row", pa.int64()), ("gone", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            rows, gone = [], []
            for row, a, b, words in zip(*(batch.column(c).to_pylist() for c in ("row", "first_lines", "lines", "words"))):
                if own := doomed(a, b, words, least_words):
                    rows.append(row)
                    gone.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], schema=schema)

    return run


def common_lines(docs: DataFrame, keep: list, rare: int = RARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """kept (a struct of the columns ``keep``), lines (digests), words and gone (the numbers of the lines to delete, from 0) of every document."""
    scratch = Scratch(docs.sparkSession)
    named = docs.select(F.struct(*keep).alias("kept"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    kind = T.StructType([*named.schema[:3], T.StructField("lines", T.ArrayType(T.BinaryType())), T.StructField("words", T.ArrayType(T.IntegerType()))])
    table = written(named.mapInArrow(frugal(_lines), kind).withColumn("row", F.monotonically_increasing_id()), "lines")  # written once, so the row numbers stay
    known = table.select(F.struct("doc_id", "hash", "row").alias("doc"), "row", "lines", "words")

    each = known.select("doc", "lines", "words").mapInArrow(frugal(_runs(least_words)), f"doc {DOC_KIND}, run long")
    each = scratch.written(each.distinct(), "lines-runs")
    often = each.groupBy("run").agg(F.min("doc").alias("first"), F.count("*").alias("docs")).where("docs > 1")
    met = scratch.written(join_unique(each, often, "run", hot(each, "run")), "lines-met")
    few = met.where(F.col("docs") <= rare).groupBy("run").agg(F.sort_array(F.collect_list("doc")).alias("ids"))
    near = few.select(F.posexplode("ids").alias("at", "doc"), "ids").where("at > 0").select("doc", F.explode(F.slice("ids", F.lit(1), F.col("at"))).alias("first"))
    far = met.where((F.col("docs") > rare) & (F.col("doc") > F.col("first"))).select("doc", "first")
    pairs = scratch.written(near.union(far).distinct().select(F.col("doc.row").alias("row"), F.col("first.row").alias("first")), "lines-pairs")

    def aligned(some: DataFrame) -> DataFrame:
        first = table.select(F.col("row").alias("first"), F.col("lines").alias("first_lines"))
        both = join_unique(some, first, "first", hot(some, "first"))
        both = join_unique(both, table.select("row", "lines", "words"), "row", hot(some, "row")).select("row", "first_lines", "lines", "words")
        return both.mapInArrow(frugal(_align(least_words)), "row long, gone array<int>")

    def united(found: DataFrame) -> DataFrame:
        return found.select("row", F.explode("gone").alias("g")).groupBy("row").agg(F.sort_array(F.collect_set("g")).alias("gone"))

    gone = scratch.written(united(aligned(pairs)), "lines-gone")
    often = met.where(F.col("docs") > rare)
    runs = often.where(F.col("doc") > F.col("first")).groupBy(F.col("doc.row").alias("row")).agg(F.collect_list("run").alias("runs"))
    left = known.join(runs, "row").join(gone, "row", "left").select("doc", "lines", "words", "runs", "gone").mapInArrow(frugal(_standing(least_words)), f"doc {DOC_KIND}, run long")
    more = left.join(often.select("run", F.col("doc").alias("first")), "run").where("first < doc").select(F.col("doc.row").alias("row"), F.col("first.row").alias("first"))
    more = scratch.written(more.distinct().join(pairs, ["row", "first"], "left_anti"), "lines-more")
    gone = written(united(gone.union(aligned(more))), "lines-all-gone")
    scratch.drop()

    # Rows that lose nothing for certain are not shuffled.
    loses = member(gone.select(F.xxhash64("row").alias("h")), BITS)(F.xxhash64("row"))
    none = F.array().cast("array<int>")
    out = table.where(~loses).withColumn("gone", none).unionByName(table.where(loses).join(gone, "row", "left").withColumn("gone", F.coalesce("gone", none)))
    return out.select("kept", "lines", "words", "gone")


def _stay():
    """The numbers of the lines that stay."""
    return F.array_except(F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(F.array().cast("array<int>")), F.col("gone"))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_words, removed (line numbers) and kept_sha256 (of the digests of the lines that stay)."""
    found = common_lines(docs, ["doc_id"], **options)
    return found.select(
        "kept.doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.expr("aggregate(gone, 0L, (s, i) -> s + words[i])").alias("removed_words"),
        F.array_join(F.col("gone").cast("array<string>"), ",").alias("removed"),
        F.sha2(F.array_join(F.transform(_stay(), lambda i: F.coalesce(F.hex(F.get("lines", i)), F.lit(""))), "\n"), 256).alias("kept_sha256"),
    )


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The documents without the deleted lines; the other lines and columns stay as they are."""
    found = common_lines(docs, [F.col(f"`{c}`") for c in docs.columns], **options)
    lines = F.split(F.col("kept").getField("text"), "\n", -1)
    text = F.when(F.size("gone") > 0, F.array_join(F.transform(_stay(), lambda i: F.get(lines, i)), "\n")).otherwise(F.col("kept").getField("text"))
    return found.select(*[text.alias(c) if c == "text" else F.col("kept").getField(c).alias(c) for c in docs.columns])
