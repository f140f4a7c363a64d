"""Secret scan: fixed patterns, and a token-efficiency test that exposes random strings.

The patterns give the base kinds ``assign``, ``access`` and ``hex``. The test adds the kind ``random``. A run of characters of the
base64 alphabets is cut at ``+/_=-`` into pieces. The run is random if a byte-level vocabulary needs so many tokens for them, each
as a word of running text, that there are few characters for each: at most the second number of the entry of ``LIMITS`` for the
run's length. Pieces of ``LEAST_PIECE`` characters or more must hold ``LEAST_LONG`` in all. Text that people write is in the vocabulary in long parts, slugs and
identifiers too; random strings are not. If a run is not random as a whole, each of its pieces is tested.

The limits are calibrated: from 20 characters on, two characters for each token hold 95 % or more of random strings of letters and
digits, and none of the long words of the documents; from 16 to 19 the limit is lower, since some words come near. ``measure``
gives recall and false alarms for any vocabulary.

Dots end a run, so the segments of a dotted token are tested one by one; in the path of a URL each segment is tested on its own.
Left out are known digests (hexadecimal of a digest's length, integrity digests), UUIDs, numbers, mail addresses, the host part
of a URL, and what a base span covers already.

Defined results: a null text counts as empty and has no spans; spans are in code points, end exclusive, ordered by start and
then kind as listed in KINDS; of equal matches each counts where it stands; repeated rows get equal results each; a text of any
length is scanned whole, as a slice of its own; columns but doc_id and text are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import frugal, runs, slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that have 16 or more
NAMES = (b"passw", b"secret", b"token", b"api")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
LEAST_PIECE, LEAST_LONG = 4, 12
#: Characters from which on, and the most characters for each token that a random string has.
LIMITS = ((16, 1.55), (20, 2.0))
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
URL = re.compile(rb"(?<=[A-Za-z])://(?:[^\s/@?#]*@)?([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)([^\s\"'<>?#]*)")
DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
TOP_PATH = re.compile(rb"[a-z]{2,24}/")  # the end of a host name without a scheme, and its path
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
INTEGRITY = re.compile(r"(?<![A-Za-z0-9])sha(?:1|224|256|384|512)-[A-Za-z0-9+/]+={0,2}")
PIECE = re.compile("[A-Za-z0-9]+")

_b = np.arange(256)
_DIGIT, _LOW, _UP = (_b >= 48) & (_b <= 57), (_b >= 97) & (_b <= 122), (_b >= 65) & (_b <= 90)
_HEX = _DIGIT | ((_b >= 97) & (_b <= 102))
_RUN = _DIGIT | _LOW | _UP | np.isin(_b, list(b"+/_=-"))
_LOWER = np.where(_UP, _b + 32, _b).astype(np.uint8)


def base_spans(text: str, hex_too: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= LEAST_ACCESS]
    if hex_too:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _is_word(piece: str, encode) -> bool:
    return piece.isalpha() and (piece.islower() or piece.isupper() or piece.istitle()) and len(encode(" " + piece)) == 1


def _few(pieces: list[str], length: int, encode, limits) -> bool:
    most = max((limit for least, limit in limits if length >= least), default=0.0)
    if not most or sum(len(p) for p in pieces if len(p) >= LEAST_PIECE) < LEAST_LONG:
        return False
    return sum(map(len, pieces)) <= most * sum(len(encode(" " + p)) for p in pieces)


def random_parts(run: str, encode, limits=LIMITS) -> list[tuple[int, int]]:
    """The run itself, less words at its ends, if that is random, else its pieces that are: (start, end) in the run."""
    blank = lambda m: " " * len(m.group())
    rest = INTEGRITY.sub(blank, UUID.sub(blank, run))
    pieces = [m for m in PIECE.finditer(rest) if not (len(m.group()) in DIGEST_LENGTHS and re.fullmatch("[0-9a-f]+|[0-9A-F]+", m.group()))]
    if all(m.group().isdigit() for m in pieces):
        return []
    own = list(pieces)
    while own and _is_word(own[0].group(), encode):
        own.pop(0)
    while own and _is_word(own[-1].group(), encode):
        own.pop()
    start, end = (0 if own[:1] == pieces[:1] else own[0].start(), len(run) if own[-1:] == pieces[-1:] else own[-1].end()) if own else (0, 0)
    if _few([m.group() for m in own], end - start, encode, limits):
        return [(start, end)]
    return [m.span() for m in pieces if len(pieces) > 1 and not m.group().isdigit() and _few([m.group()], len(m.group()), encode, limits)]


def measure(runs: list[str], encode, limits=LIMITS) -> float:
    """The share of the runs that are random, in whole or in part."""
    return sum(bool(random_parts(r, encode, limits)) for r in runs) / max(1, len(runs))


def addresses(raw: bytes) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(what no test takes: mail addresses and hosts of URLs; the paths of URLs), in bytes."""
    out, paths, taken, last = [], [], [], 0
    for m in URL.finditer(raw):
        out.append(m.span(1))
        paths.append(m.span(2))
        taken.append((m.start(), m.end(1)))
    for m in DOMAIN.finditer(raw):
        start = last + len(raw[last : m.start()].rstrip(LOCAL))
        if start < m.start() and not any(s < m.end() and start < e for s, e in taken):
            out.append((start, m.end()))
        last = m.end()
    return sorted(out), paths


def candidates(raw: bytes, start: int, end: int, out: list[tuple[int, int]], paths: list[tuple[int, int]], least_run: int) -> list[list[tuple[int, int]]]:
    """Parts of the run raw[start:end] to test, in bytes: of each list those that are random count, and the next list only if none is."""
    pieces, lo = [], start
    for s, e in out:
        if s < end and lo < e:
            pieces.append((lo, s))
            lo = max(lo, e)
    pieces.append((lo, end))
    before, after = raw[max(0, start - 1) : start], raw[end : end + 1]
    apart = before in (b"@", b".") or after == b"@"
    path = any(s < end and start < e for s, e in paths)
    whole = [(start, end)] if path and not apart else [(a, b) for a, b in pieces if b - a >= least_run]
    if not apart and not path:
        return [whole]
    segments = [(a + m.start(), a + m.end()) for a, b in pieces if a < b for m in re.finditer(rb"[^/]+", raw[a:b])]
    segments = [(a, b) for a, b in segments if b - a >= least_run]
    hosted = path or (before == b"." and TOP_PATH.match(raw, start, end))
    return [segments] if hosted and apart else [segments, whole]


def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _scan(path: str, limits):
    least_run = min(least for least, _ in limits)
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])
    ready = []

    def run(batches):
        for batch in batches:
            out = []
            for texts in slices(batch.column("text")):
                flat = _LOWER[texts.buf].tobytes()
                maybe = np.zeros(len(texts), bool)
                for name in (*NAMES, b"akia"):
                    at = flat.find(name)
                    while at >= 0:
                        maybe[np.searchsorted(texts.at, at, "right") - 1] = True
                        at = flat.find(name, at + 1)
                hs, he = runs(_HEX[texts.buf], texts.at)
                hexed = np.searchsorted(texts.at, hs[he - hs >= 16], "right") - 1
                maybe[hexed] = True
                rs, re_ = runs(_RUN[texts.buf], texts.at)
                long = re_ - rs >= least_run
                rs, re_ = rs[long], re_[long]
                owner = np.searchsorted(texts.at, rs, "right") - 1
                lo, hi = np.searchsorted(owner, np.arange(len(texts)), "left"), np.searchsorted(owner, np.arange(len(texts)), "right")
                for i in range(len(texts)):
                    spans = base_spans(texts.text(i)) if maybe[i] else []
                    base = list(spans)
                    if lo[i] < hi[i]:
                        raw = texts.bytes(i)
                        known = addresses(raw)
                    for k in range(lo[i], hi[i]):
                        for parts in candidates(raw, int(rs[k] - texts.at[i]), int(re_[k] - texts.at[i]), *known, least_run):
                            if not ready:
                                ready.append(encoder(path))
                            parts = [(s + a, s + b) for s, e in parts for a, b in random_parts(raw[s:e].decode(), ready[0], limits)]
                            for start, end in parts:
                                at = len(raw[:start].decode("utf-8", "replace"))
                                if not any(s < at + end - start and at < e for s, _, e in base):
                                    spans.append((at, 3, at + end - start))
                            if parts:
                                break
                    spans.sort()
                    counts = [sum(1 for s in spans if s[1] == k) for k in range(len(KINDS))]
                    say = lambda part: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in part)
                    out.append((*counts, hashlib.sha256(say(base).encode()).hexdigest(), say(spans)))
            columns = list(zip(*out)) if out else [[] for _ in range(len(schema) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]], schema=schema)

    return run


def scan_secrets(docs: DataFrame, vocabulary: str, limits=LIMITS) -> DataFrame:
    """doc_id, a count for each kind, base_sha256 and spans for every document; vocabulary: path of a file of ranks."""
    return docs.select("doc_id", "text").mapInArrow(frugal(_scan(vocabulary, limits)), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
