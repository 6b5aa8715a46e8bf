"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Every byte is written as one printable character (the byte-to-character table of byte-level BPE);
a text is cut by the tokenizer's pattern, each match is merged separately. Decoding looks up the
characters of the ids' entries and maps them back to bytes through the inverse table; a character
whose bytes are split over several ids comes back whole, since bytes are joined before they are
read as UTF-8. An id's offsets are the code points that its bytes lie in, so ids that share a split
character share its span.

The rank file gives merges in order of their result. A result may arise from more than one pair,
and all of its pairs are therefore listed at its rank.

Null or empty text: no ids. Repeated rows: a result each. Null ids decode to nothing. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from parchmint.llm.common import batch_of, chunks, column, released, texts

#: Distinct matches whose ids a task keeps; beyond it the memory is emptied and filled anew.
MEMORY = 100_000
#: Matches longer than this are encoded each time and not kept.
MEMORY_LENGTH = 64


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@cache
def byte_characters() -> list[str]:
    """The character for each byte: itself where it is printable in Latin-1, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


@cache
def character_bytes() -> np.ndarray:
    """The inverse table: the byte for each character's code point."""
    table = byte_characters()
    out = np.zeros(max(map(ord, table)) + 1, np.uint8)
    out[[ord(c) for c in table]] = np.arange(256, dtype=np.uint8)
    return out


class Entries:
    """The characters of all ids' entries, end to end."""

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.characters = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)

    def data(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids' entries, by the inverse table."""
        size = self.size[ids]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(self.start[ids] - first, size)
        return character_bytes()[self.characters[at]]


@cache
def load(path: str):
    """(tokenizer of one match, entries of the ids) from a rank file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer, models, pre_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    table = byte_characters()
    word = {t: "".join(table[b] for b in t) for t in ranks}
    merges = [(word[t[:i]], word[t[i:]]) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    tok = Tokenizer(models.BPE(vocab={word[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    entries = [""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        entries[r] = word[t]
    return tok, Entries(entries)


class Encoder:
    """Encodes texts; matches that were seen before are not merged again."""

    def __init__(self, path: str, pattern: str):
        self.tok, self.entries = load(path)
        self.pattern = regex.compile(pattern)
        self.seen: dict[str, bytes] = {}

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [self.pattern.findall(t) for t in batch]
        fresh = list(set(chain.from_iterable(split)).difference(self.seen))
        if len(self.seen) + len(fresh) > MEMORY:
            self.seen = {}
            fresh = list(set(chain.from_iterable(split)))
        seen = self.seen
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            seen.update(zip(part, (array("i", e.ids).tobytes() for e in self.tok.encode_batch_fast(part, add_special_tokens=False))))
        out = [np.frombuffer(b"".join(map(seen.__getitem__, words)), np.int32) for words in split]
        for w in fresh:
            if len(w) > MEMORY_LENGTH:
                del seen[w]
        return out

    def offsets(self, ids: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
        """Code-point span of each id in the text that the ids encode: rows of start and stop."""
        data = self.entries.data(ids) if data is None else data
        size = self.entries.size[ids]
        stop = np.cumsum(size)
        place = np.cumsum((data & 0xC0) != 0x80) - 1  # the code point of each byte
        return np.stack([place[stop - size], place[stop - 1] + 1], axis=1) if len(ids) else np.zeros((0, 2), np.int64)

    def decode(self, ids) -> bytes:
        return self.entries.data(np.asarray(ids, np.int64)).tobytes()


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker; ``released`` empties its memory after a task."""
    return Encoder(path, pattern)


def _forget(path: str, pattern: str):
    return lambda: encoder(path, pattern).seen.clear()


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column of flat arrays."""
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int> and, if asked for, offsets array<struct<start, stop>> in code points."""
    path, pattern = path or default_ranks(), pattern or default_pattern()
    kind = "doc_id long, ids array<int>" + (", offsets array<struct<start:int,stop:int>>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for b in chunks(batches):
            ids = coder.encode([t or "" for t in column(b, "text")])
            found = {"doc_id": b.column(0), "ids": _lists(ids, pa.int32())}
            if offsets:
                spans = [coder.offsets(x).astype(np.int32) for x in ids]
                both = np.concatenate(spans) if spans else np.zeros((0, 2), np.int32)
                ends = pa.array(np.cumsum([0, *map(len, spans)]), pa.int32())
                found["offsets"] = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(both[:, k]) for k in (0, 1)], ["start", "stop"]))
            yield pa.RecordBatch.from_pydict(found)

    return texts(docs).mapInArrow(released(run, _forget(path, pattern)), kind)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, data binary, text string of encoded rows; bytes that are no UTF-8 read as U+FFFD."""
    path = path or default_ranks()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("data", pa.binary()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = load(path)[1]
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                data = [entries.data(np.asarray(ids or (), np.int64)).tobytes() for ids in column(part, "ids")]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(data, pa.binary()), pa.array([d.decode("utf-8", "replace") for d in data], pa.string())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, data binary, text string")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The contract's columns and offsets_sha256: ids, the bytes decoded from them, their offsets, as digests.

    Offsets are digested as pairs of little-endian unsigned 32-bit integers.
    """
    path, pattern = path or default_ranks(), pattern or default_pattern()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("offsets_sha256", pa.string())])
    said = lambda x: hashlib.sha256(x.tobytes()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for b in chunks(batches):
            rows = []
            for i, ids in zip(column(b, "doc_id"), coder.encode([t or "" for t in column(b, "text")])):
                data = coder.entries.data(ids)
                rows.append((i, len(ids), said(ids.astype("<u4")), said(data), said(coder.offsets(ids, data).astype("<u4"))))
            yield batch_of(schema, rows)

    return texts(docs).mapInArrow(released(run, _forget(path, pattern)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string")


def tokenized(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids array<int>, decoded_sha256: encoded rows for training, with the digest of what decodes from them.

    A row for each row of ``docs``: null or empty text has no ids, repeated rows come as often as
    they stand there, an empty table gives an empty one. Other columns are left out.
    """
    path, pattern = path or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for b in chunks(batches):
            ids = coder.encode([t or "" for t in column(b, "text")])
            decoded = [hashlib.sha256(coder.entries.data(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), _lists(ids, pa.int32()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return texts(docs).mapInArrow(released(run, _forget(path, pattern)), "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")
