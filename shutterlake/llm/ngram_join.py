"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least a threshold.

1. Equal texts form a class (digest, count and least doc_id, pre-aggregated); from here on only classes take part.
2. Each class gets a MinHash signature; classes that agree on all rows of a band meet in a bucket.
3. In a bucket, MinHash values are compared a chunk at a time. After n values with m matches a pair is dropped if the posterior
   probability (uniform prior) that its similarity reaches the threshold is below ``tolerance``. Survivors leave the bucket as
   a spanning forest, which is linear in its rows, never as all pairs. Their connected components are the candidate groups.
4. Each member of a group brings its text once; pairs of a group are pruned in the same way, and the rest are verified exactly
   on their shingle sets.
5. Verified links give every document its number of links and the least doc_id of its connected documents.

Buckets and groups of more than ``block`` members are dealt out as a grid of pairs of blocks, so none gathers in one task;
no bucket, partner or candidate is capped. With 32 bands of 4 rows a pair at 0.8 misses all buckets with probability 5e-8.
Of the texts, only those of candidates are shuffled: a bitmap of fixed size that Python holds against a column of hashes tells
them. Joins on a bucket, class or group that holds many rows bring the one row of the other side to them.

Defined results: words are those of ``kernels.WORD`` (ASCII case folded); a text with fewer words than the shingle size is one
shingle of all of them. Texts without words, nulls included, have no links, and their class is their own doc_id. Repeated rows
are repeated in the result, each copy being a link of the others. A null doc_id takes part like others and is the last in order,
so that it names a class only if all its ids are null. A text of any length is one slice of its own. Other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .kernels import Words, frugal, mix, shingles, slices
from .shared import Scratch, hot, join_unique, member, small, written

SHINGLE, THRESHOLD, BANDS, ROWS, TOLERANCE, BLOCK = 5, 0.8, 32, 4, 1e-6, 1024
CHUNK = 16
#: Of the bitmaps of rows, as a power of 2.
BITS = 27
PAIRS_AT_ONCE = 1 << 17
#: Groups up to this size verify pair by pair, larger ones through an incidence matrix.
BY_PAIR = 48

_seeds = mix(np.arange(1, 2 * 512 + 1, dtype=np.uint64))
XOR, MUL = (_seeds[:512] >> np.uint64(32)).astype(np.uint32), (_seeds[512:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signatures(sets: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """MinHash values (rows: texts, none of which may be empty) of the shingle hashes sets[at[i]:at[i + 1]]."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, size), np.uint32)
    for k in range(size):
        out[:, k] = np.minimum.reduceat((x ^ XOR[k]) * MUL[k], at[:-1])
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = signature.astype(np.uint64).reshape(len(signature), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(40), (len(s), bands)).copy()
    for k in range(rows):
        h = mix(h ^ s[:, :, k])
    return h.view(np.int64)


def least_matches(threshold: float, tolerance: float, size: int) -> list[int]:
    """For each multiple n of CHUNK: the fewest matches among n values with P(similarity >= threshold) >= tolerance."""
    out = []
    for n in range(CHUNK, size + 1, CHUNK):
        # With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial's lower one.
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def survivors(s: np.ndarray, a: np.ndarray, b: np.ndarray, fewest: list[int]) -> np.ndarray:
    """Which pairs (a, b) of rows of ``s`` are left when their values have been compared chunk by chunk."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, need in enumerate(fewest):
        if not len(alive):
            break
        cols = slice(k * CHUNK, (k + 1) * CHUNK)
        matches = matches + (s[a[alive], cols] == s[b[alive], cols]).sum(axis=1, dtype=np.int32)
        keep = matches >= need
        alive, matches = alive[keep], matches[keep]
    return alive


def pairs_within(sizes: np.ndarray):
    """Pairs (a < b) of the rows of consecutive groups, PAIRS_AT_ONCE or one row's at a time."""
    after = np.concatenate([np.arange(n - 1, -1, -1) for n in sizes]) if len(sizes) else np.zeros(0, np.int64)
    total, lo = np.cumsum(after), 0
    while lo < len(after):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + PAIRS_AT_ONCE, "right")))
        count = after[lo:hi]
        a = np.repeat(np.arange(lo, hi), count)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        yield a, b
        lo = hi


def least_of_component(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows, the least row that the links (a, b) join it to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def groups(batches, keys: list[str]):
    """Record batches that hold whole groups of consecutive rows with equal keys, with the groups' sizes."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        if all(rest[0].column(k)[0] == batch.column(k)[batch.num_rows - 1] for k in keys):
            continue
        whole = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
        change = _changes(whole, keys)
        yield whole.slice(0, change[-1]), np.diff(change)
        rest = [whole.slice(change[-1])]
    if rest:
        whole = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
        yield whole, np.diff(np.append(_changes(whole, keys), whole.num_rows))


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in keys:
        c = batch.column(k)
        if pa.types.is_integer(c.type):
            v = c.to_numpy(zero_copy_only=False)
        else:
            v = np.array(c.to_pylist(), dtype=object)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _sketch(shingle: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("key").to_pylist()
            for texts in slices(batch.column("text")):
                words = Words(texts)
                sets, at = shingles(words, shingle)
                part = keys[texts.first : texts.first + len(texts)]
                some = np.diff(at) > 0
                new = np.zeros(len(part), bool)
                for i in np.flatnonzero(some):
                    if part[i] not in seen:
                        seen.add(part[i])
                        new[i] = True
                if len(seen) > 1_000_000:  # bounds this task's memory; a copy that is sketched twice is dropped later
                    seen.clear()
                take = np.flatnonzero(new)
                keep = np.concatenate([sets[at[i] : at[i + 1]] for i in take]) if len(take) else sets[:0]
                s = signatures(keep, np.concatenate([[0], np.cumsum(np.diff(at)[take])]), bands * rows) if len(take) else np.zeros((0, bands * rows), np.uint32)
                b, short = band_keys(s, bands, rows), s.astype(np.uint16)
                where = np.full(len(part), -1)
                where[take] = np.arange(len(take))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(texts.first, len(texts)),
                        pa.array([k if x else None for k, x in zip(part, some)], pa.binary()),
                        pa.array([b[w] if w >= 0 else None for w in where], pa.list_(pa.int64())),
                        pa.array([short[w].tobytes() if w >= 0 else None for w in where], pa.binary()),
                    ],
                    schema=schema,
                )

    return run


def _prune(bands: int, rows: int, fewest: list[int]):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        for batch, sizes in groups(batches, ["bucket", "bi", "bj"]):
            s = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(batch.num_rows, bands * rows)
            chunk, bi, bj = (batch.column(c).to_numpy() for c in ("chunk", "bi", "bj"))
            left, right = [], []
            for a, b in pairs_within(sizes):
                across = (bi[a] == bj[a]) | (chunk[a] != chunk[b])  # a block with itself, or one row from either block
                a, b = a[across], b[across]
                alive = survivors(s, a, b, fewest)
                left.append(a[alive])
                right.append(b[alive])
            label = least_of_component(batch.num_rows, np.concatenate(left), np.concatenate(right)) if left else np.arange(batch.num_rows)
            other = np.flatnonzero(label != np.arange(batch.num_rows))
            key = batch.column("key")
            yield pa.RecordBatch.from_arrays([key.take(pa.array(label[other])), key.take(pa.array(other))], schema=schema)

    return run


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of shingles that each pair shares, exactly."""
    if len(sets) <= BY_PAIR:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    which, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    often = np.flatnonzero(np.bincount(code, minlength=len(which)) > 1)
    rank = np.full(len(which), -1)
    rank[often] = np.arange(len(often))
    col = rank[code]
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, len(often), 2048):
        x = np.zeros((len(sets), 2048), np.float32)
        i, j = np.searchsorted(col, [lo, lo + 2048])
        x[row[i:j], col[i:j] - lo] = 1
        total += x @ x.T
    return total[a, b].astype(np.int64)


def _verify(shingle: int, threshold: float, size: int, fewest: list[int]):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())])

    def run(batches):
        for batch, sizes in groups(batches, ["label", "bi", "bj"]):
            sets: list[np.ndarray] = []
            for texts in slices(batch.column("text")):
                values, at = shingles(Words(texts), shingle)
                sets += [np.unique(values[at[i] : at[i + 1]]) for i in range(len(texts))]
            s = signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1], [sum(map(len, sets))]]).astype(np.int64), size)
            n = np.array([len(x) for x in sets])
            chunk, bi, bj, weight = (batch.column(c).to_numpy() for c in ("chunk", "bi", "bj", "n"))
            links, left, right = np.zeros(len(sets), np.int64), [], []
            first = 0
            for m in sizes:
                for a, b in pairs_within(np.array([m])):
                    across = (bi[first] == bj[first]) | (chunk[first + a] != chunk[first + b])
                    a, b = a[across], b[across]
                    alive = survivors(s[first : first + m], a, b, fewest)
                    a, b = a[alive], b[alive]
                    if not len(a):
                        continue
                    both = _common(sets[first : first + m], a, b)
                    # In whole numbers up to rounding of the threshold itself: |A and B| >= t |A or B|.
                    linked = both >= threshold * (n[first + a] + n[first + b] - both) - 1e-9
                    a, b = first + a[linked], first + b[linked]
                    np.add.at(links, a, weight[b])
                    np.add.at(links, b, weight[a])
                    left.append(a)
                    right.append(b)
                first += m
            label = least_of_component(len(sets), np.concatenate(left), np.concatenate(right)) if left else np.arange(len(sets))
            some = np.flatnonzero(links > 0)
            key = batch.column("key")
            yield pa.RecordBatch.from_arrays([key.take(pa.array(label[some])), key.take(pa.array(some)), pa.array(links[some])], schema=schema)

    return run


def _grid(df: DataFrame, size: str, block: int) -> DataFrame:
    """Each row once for every pair of blocks that its own block is part of."""
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    df = df.withColumn("blocks", blocks).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    df = df.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return df.withColumn("bi", F.least("chunk", "other")).withColumn("bj", F.greatest("chunk", "other")).drop("blocks", "other")


def _identity():
    """A hash of what tells rows apart: doc_id and the digest of the text."""
    return F.xxhash64("doc_id", "key")


def _digest(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def _join(docs: DataFrame, shingle: int, threshold: float, bands: int, rows: int, tolerance: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id and key of every row, whose key is null if its text has no words; key, rep, n, links and label of every class)."""
    fewest = least_matches(threshold, tolerance, bands * rows)
    scratch = Scratch(docs.sparkSession)
    keyed = docs.withColumn("key", _digest("text"))
    table = scratch.written(keyed.mapInArrow(frugal(_sketch(shingle, bands, rows)), "doc_id long, key binary, bands array<long>, signature binary"), "join-sketch")
    ids = written(table.select("doc_id", "key"), "join-rows")

    classes = scratch.written(ids.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "join-classes")
    sketch = table.where("signature is not null").select("key", "bands", "signature").dropDuplicates(["key"])

    banded = sketch.select("key", F.explode("bands").alias("bucket"))
    sizes = scratch.written(banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "join-buckets")
    # Buckets that are dealt out as a grid are few; their sizes are brought to their rows.
    large = sizes.where(F.col("size") > block)
    n_large = large.count()
    if n_large:
        spread = small(large, n_large)
        met = banded.join(spread, "bucket").unionByName(banded.join(spread, "bucket", "left_anti").join(sizes.where(F.col("size") <= block), "bucket"))
    else:
        met = banded.join(sizes, "bucket")
    met = met.join(sketch.select("key", "signature"), "key")
    met = _grid(met, "size", block).select("bucket", "bi", "bj", "chunk", "key", "signature")
    # By key too, so that the members of a group hang on the same one in all their buckets, and equal edges collapse.
    met = met.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", "key")
    found = components(met.mapInArrow(frugal(_prune(bands, rows, fewest)), "a binary, b binary"))

    found = scratch.written(found.join(classes, found["node"] == classes["key"]).select("key", "label", "rep", "n"), "join-groups")
    sized = join_unique(found, found.groupBy("label").agg(F.count("*").alias("size")), "label", hot(found, "label"))
    wanted = member(found.select(F.xxhash64("rep", "key").alias("h")), BITS)
    texts = keyed.where(wanted(_identity())).withColumnRenamed("key", "text_key")
    # The same join at every size: neither side has a bound, so neither is broadcast.
    brought = sized.hint("merge").join(texts, F.col("rep").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))).dropDuplicates(["key"])
    brought = _grid(brought, "size", block).select("label", "bi", "bj", "chunk", "key", "n", "text")
    brought = brought.repartition("label", "bi", "bj").sortWithinPartitions("label", "bi", "bj", "key")
    links = scratch.written(brought.mapInArrow(frugal(_verify(shingle, threshold, bands * rows, fewest)), "a binary, b binary, links long"), "join-links")

    linked = components(links)
    final = (
        classes.join(links.groupBy(F.col("b").alias("key")).agg(F.sum("links").alias("links")), "key", "left")
        .join(linked.withColumnRenamed("node", "key"), "key", "left")
        .withColumn("label", F.coalesce("label", "key"))
    )
    final = written(final, "join-final")
    scratch.drop()
    return ids, final


def _with_least(final: DataFrame, least, name: str) -> DataFrame:
    """``final`` with an aggregate over the classes of each group."""
    return join_unique(final, final.groupBy("label").agg(least.alias(name)), "label", hot(final, "label"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links, copies) for every document; see the module's docstring."""
    ids, final = _join(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), shingle, threshold, bands, rows, tolerance, block)
    final = _with_least(final, F.min("rep"), "class_id")
    final = final.select("key", "class_id", F.col("n").alias("copies"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return join_unique(ids, final, "key", hot(ids.where("key is not null"), "key"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("copies"))


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """The documents, with one of each class: the row with the least doc_id; columns as before.

    Rows are told apart by doc_id and text: of rows equal in both one stays, rows with the same doc_id and other texts are
    judged on their own, and a null doc_id is the last in order. Texts without words all stay. Rows that stay for certain are
    not shuffled: a bitmap of fixed size tells them from those that may go.
    """
    ids, final = _join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")), shingle, threshold, bands, rows, tolerance, block)
    order = F.struct(F.col("rep").isNull().alias("none"), "rep", "key")
    keeps = _with_least(final, F.min(order), "kept").select("key", (F.col("kept") == order).alias("first"), "rep")
    each = ids.where("key is not null").groupBy("doc_id", "key").agg(F.count("*").alias("times"))
    judged = join_unique(each, keeps, "key", hot(ids.where("key is not null"), "key"))
    stays = F.col("first") & F.col("doc_id").eqNullSafe(F.col("rep"))
    touched = written(judged.where(~stays | (F.col("times") > 1)).select("doc_id", "key", stays.alias("stays")), "join-touched")
    may_go = member(touched.select(_identity().alias("h")), BITS)

    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _digest(text_col).alias("key"))
    certain = docs.where(~may_go(F.xxhash64(F.col("doc_id").cast("long"), _digest(text_col))))
    # Of the rows that the bitmap marks: those that it marks wrongly, and one of each that stays.
    known = touched.select(F.col("doc_id").alias("id"), F.col("key").alias("digest"), "stays")
    marked = packed.where(may_go(_identity())).join(known, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("digest")), "left")
    wrongly = marked.where("stays is null").select("row.*")
    one = marked.where("stays").groupBy("doc_id", "key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return certain.unionByName(wrongly).unionByName(one)
