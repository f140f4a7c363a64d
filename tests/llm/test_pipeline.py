"""Each stage of the pipeline against a plain version of it, on what the stage before kept."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_decontam import WORD
from test_mixing import targets
from tokenizers import Tokenizer

from shutterlake.llm import langid, mixing
from shutterlake.llm.queries import TOKENIZER, public_path

corpus_pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def language_id(spark, rows):
    import pyarrow as pa

    model = langid.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    return [r for r in rows if not langid._judged(langid.Scorer(model), pa.array([r["text"]], pa.string()))[2][0]]


def near_duplicates(spark, rows):
    sets = []
    for r in rows:
        w = words(r["text"])
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                group[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r["doc_id"]), r["doc_id"])
    return [r for i, r in enumerate(rows) if r["doc_id"] == least[root(i)]]


def decontamination(spark, rows):
    sought = {}
    for item in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(item["text"])
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            sought.setdefault(n, set()).add(tuple(w[k : k + n]))
    out = []
    for r in rows:
        w, hit = words(r["text"]), set()
        for n, own in sought.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in own:
                    hit.update(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(r)
    return out


#: The rows of the last stage, once the stages have run.
ends: list = []
PLAIN = {"language_id": language_id, "near_duplicates": near_duplicates, "decontamination": decontamination}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        at = f"file://{tmp_path}/{name}"
        stage(spark, docs, FOLDER).write.parquet(at)
        after = spark.read.parquet(at)
        seen.append(after.count())
        if name in PLAIN:
            assert after.columns == docs.columns
            assert Counter(map(tuple, after.collect())) == Counter(map(tuple, PLAIN[name](spark, before))), name
        elif name == "source_mix":
            assert after.columns == docs.columns
            times = Counter(map(tuple, after.collect()))
            size = {tuple(r): len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in before}
            assert set(times) <= {r for r, n in size.items() if n} and max(times.values()) <= 3
            sources = {}
            for r, n in size.items():
                sources[r[3]] = sources.get(r[3], 0) + n
            for source, aim in targets(sources).items():
                own = [r for r in size if r[3] == source]
                assert abs(sum(times[r] * size[r] for r in own) - aim) <= max(size[r] for r in own) / 2 + 1
            report = Counter({r["doc_id"]: r["taken"] for r in mixing.report(docs).collect() if r["taken"]})
            assert report == Counter({r[0]: n * size[r] for r, n in times.items()})
        else:
            t, start = Tokenizer.from_file(public_path(TOKENIZER)), 0
            got = sorted(map(tuple, after.select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
            ends.append(sorted(got))
            for r, row in zip(got, sorted(before, key=lambda r: (r["doc_id"], r["text"])), strict=True):
                ids = [*t.encode(row["text"] or "", add_special_tokens=False).ids, 1]
                assert r == (start, row["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
                start += len(ids)
        docs = after
    assert all(seen)


def test_names_that_clash(spark, tmp_path):
    """With columns named like helpers, the whole pipeline gives what its stages gave without them."""
    extra = ["_row", "_size", "_s", "_text", "_gone", "key", "label", "row", "size", "place", "number", "block", "shard", "rank", "hash", "lines", "spans", "n"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("*", *[F.lit("mine").alias(c) for c in extra])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    assert ends and got == ends[0]


def test_empty(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
