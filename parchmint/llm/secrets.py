"""Secret scans: fixed patterns plus character Markov models.

Two first-order Markov chains over characters, one of random strings and one of ordinary
identifiers, are compared by their log-likelihood ratio. Both are trained from labelled samples.
Ordinary: identifier-like strings of the documents that no fixed pattern touches and that are too
short to be judged, also joined the way programs join them. Random: strings generated over the
alphabets of keys, so that the model learns what randomness looks like and not again what the fixed
patterns know. Only bigram counts leave the executors.

A candidate is a maximal run of the alphabet with at least MIN_LENGTH characters and a letter; runs
are found in one pass, so a text takes time in proportion to its length, whatever its script.

Null or empty text: no spans; redacted, null stays null. Repeated rows: a result each. Empty table:
empty result. Other columns are ignored by ``scan`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import batch_of, chunks, column, texts

#: Fixed patterns (contract), in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "markov")

#: Strings that the models judge: runs of at least MIN_LENGTH characters, with a letter.
MIN_LENGTH = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LETTER = re.compile(r"[A-Za-z]")
#: Identifier-like strings that the ordinary model learns from, if they are too short to be judged.
IDENTIFIER = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
ALPHABET = string.ascii_letters + string.digits + "+/_=-."
STATES = len(ALPHABET) + 1
#: Documents whose strings train the models: a fixed bound on labelled rows.
TRAIN_DOCUMENTS = 4000
#: Range of the hash that picks them.
HASHES = 1 << 62
#: A string is a secret if the ratio exceeds both, in nats: in all and for each bigram.
MIN_RATIO, MIN_RATIO_EACH = 15.0, 1.0

_INDEX = np.full(128, STATES - 1, np.int64)
_INDEX[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted; code points, end exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def states(value: str) -> np.ndarray:
    return _INDEX[np.frombuffer(value.encode("ascii", "replace"), np.uint8) & 127]


def bigrams(values: list[str]) -> np.ndarray:
    """Counts of adjacent states within the strings, flat: one count over all strings joined."""
    if not values:
        return np.zeros(STATES * STATES, np.int64)
    s = states(" ".join(values))
    size = np.fromiter(map(len, values), np.int64, len(values))
    inner = np.ones(len(s) - 1, bool)  # pairs that touch no gap
    gaps = np.cumsum(size + 1)[:-1] - 1
    inner[gaps[gaps < len(inner)]] = False
    inner[np.maximum(gaps - 1, 0)] = False
    return np.bincount((s[:-1] * STATES + s[1:])[inner], minlength=STATES * STATES)


def ordinary(text: str) -> list[str]:
    """Identifier-like strings of one document, as they stand and joined."""
    marks = np.zeros(len(text) + 1, np.int32)
    for start, _, end in base_spans(text):
        marks[start] += 1
        marks[end] -= 1
    upto = np.concatenate([[0], np.cumsum(np.cumsum(marks) > 0)])
    plain = [m[0] for m in IDENTIFIER.finditer(text) if m.end() - m.start() < MIN_LENGTH and upto[m.start()] == upto[m.end()]]
    joined = [x for a, b in zip(plain, plain[1:]) for x in (a.lower() + b.capitalize(), f"{a}-{b}".upper())]  # the way identifiers are written in programs
    return plain + joined


def generated(n: int = 6000, seed: int = 7) -> list[str]:
    """Random strings over the alphabets that keys are usually written in."""
    rng = random.Random(seed)
    sets = (string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits)
    return ["".join(rng.choice(sets[i % 4]) for _ in range(32)) for i in range(n)]


def picked_by_hash(mark: Column, share: float) -> Column:
    """Whether a row with a 64-bit hash belongs to a share of all rows, however small it is."""
    return F.pmod(mark, F.lit(HASHES)) < F.lit(int(share * HASHES))


def fit(docs: DataFrame, max_documents: int = TRAIN_DOCUMENTS) -> np.ndarray:
    """STATES x STATES log-likelihood ratios (random against ordinary).

    Learns from at most about ``max_documents`` documents, picked by a hash of their id. Empty
    input: only generated random strings, against a flat ordinary model.
    """
    rows = docs.count()
    share = min(1.0, max_documents / max(rows, 1))
    # Picked rows come from all splits; a second scan of the table is all that this costs.
    picked = texts(docs).filter(picked_by_hash(F.xxhash64(F.col("doc_id"), F.col("text")), share))
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STATES * STATES, np.int64)
        for b in chunks(batches):
            for t in column(b, "text"):
                total += bigrams(ordinary(t or ""))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total[cell])], schema=schema)

    counts = np.zeros((2, STATES * STATES))
    for cell, n in picked.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():
        counts[1, cell] = n
    counts[0] = bigrams(generated())
    return ratios_of(counts)


def ratios_of(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratios from bigram counts of random and ordinary strings.

    Rare first characters fall back to how often the second one stands anywhere.
    """
    counts = counts.reshape(2, STATES, STATES)
    single = counts.sum(axis=1) + 0.5
    single /= single.sum(axis=1, keepdims=True)
    probs = (counts + 30 * single[:, None, :]) / (counts.sum(axis=2, keepdims=True) + 30)
    logs = np.log(probs)
    return logs[0] - logs[1]


def markov_spans(text: str, ratios: np.ndarray, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that the models call random and that no fixed pattern touches."""
    found, starts = [], [a for a, _, _ in taken]
    reach = list(accumulate((e for _, _, e in taken), max))  # how far the spans up to each one go
    for m in CANDIDATE.finditer(text):
        if not LETTER.search(m[0]):
            continue
        s = states(m[0])
        each = ratios[s[:-1], s[1:]]
        if each.sum() > MIN_RATIO and each.mean() > MIN_RATIO_EACH:
            before = bisect_left(starts, m.end())
            if not before or reach[before - 1] <= m.start():
                found.append((m.start(), 3, m.end()))
    return found


def scan(docs: DataFrame, ratios: np.ndarray | None = None) -> DataFrame:
    """All spans: doc_id, text, spans array<struct<kind, start, stop>> sorted by start, then kind."""
    ratios = fit(docs) if ratios is None else ratios
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spans", span)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            rows = []
            for i, t in zip(column(b, "doc_id"), column(b, "text")):
                base = base_spans(t or "")
                both = sorted(base + markov_spans(t or "", ratios, base))
                rows.append((i, t, [{"kind": KINDS[k], "start": s, "stop": e} for s, k, e in both]))
            yield batch_of(schema, rows)

    return texts(docs).mapInArrow(find, "doc_id long, text string, spans array<struct<kind:string,start:long,stop:long>>")


def redact(docs: DataFrame, ratios: np.ndarray | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; n_chars follows the text. Null stays null."""
    ratios = fit(docs) if ratios is None else ratios

    @F.pandas_udf("string")
    def clean(col):
        def one(t):
            if t is None:
                return None
            base = base_spans(t)
            out, at = [], 0
            for s, _, e in sorted(base + markov_spans(t, ratios, base)):
                if s >= at:
                    out += [t[at:s], mask]
                at = max(at, e)
            return "".join(out) + t[at:] if out else t

        return col.map(one, na_action=None)

    texts(docs)  # small Arrow batches
    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long")) if "n_chars" in docs.columns else out


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, derived from the operator's spans."""
    named = lambda keep: F.array_join(F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", *(n(k) for k in KINDS), F.sha2(named(lambda s: s.kind != "markov"), 256).alias("base_sha256"), named(lambda s: s.kind.isNotNull()).alias("spans"))
