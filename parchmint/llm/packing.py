"""Packing documents into sequences along a space-filling curve.

A document's vector counts its hashed pairs of bytes; a fixed random projection brings it to DIMENSIONS
numbers, which are scaled by the mean and spread of all documents, put on a grid and numbered along a
Hilbert curve. Documents are range-sorted by that number, so that neighbours on the curve, which are
alike, meet in the same sequences. Each range is packed by its task: documents follow each other
without gaps and are cut at every ``length`` tokens; what remains at the end of a range is cut into
sequences whose lengths are powers of two. No id is padding.

Equal texts have equal numbers: ids and a row number order them, so a large group of copies is split
over ranges. Texts are shuffled once, compressed; ids are made after the shuffle, and only one
unfinished sequence is held by a task.

Null text: like an empty one, which is its end token alone. Null ids are values like others. Repeated
rows: packed each. Texts beyond 2 MB are handled one by one. Empty table: empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import batch_of, chunks, column, texts
from parchmint.session import materialize

#: Tokens of a sequence, token that ends a document.
LENGTH, END = 1024, 0
#: Cells of the hashed vectors, dimensions and bits of the grid, seed of hash and projection.
CELLS, DIMENSIONS, BITS, SEED = 256, 4, 10, 12
#: Compressed bytes of a range: a range is what one task packs.
RANGE_BYTES = 48 << 20
#: Distinct pre-tokens whose ids a task keeps, and the longest of them in bytes.
MEMORY, MEMORY_LENGTH = 500_000, 48
#: Bytes of a text whose pairs are counted at once.
WINDOW = 1 << 20
#: The character that parts texts and pre-tokens which are handled together.
GAP = "\0"
_LETTER, _NUMBER, _BLANK, _OTHER, _EDGE = range(5)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# -- vectors and the curve


@cache
def projection(seed: int = SEED) -> np.ndarray:
    """CELLS x DIMENSIONS random directions."""
    return np.random.default_rng(seed).standard_normal((CELLS, DIMENSIONS))


def vector(data: bytes, seed: int = SEED) -> np.ndarray:
    """Counts of a text's hashed pairs of bytes, of length 1; zeros for shorter texts."""
    total = np.zeros(CELLS)
    for at in range(0, len(data) - 1, WINDOW):
        b = np.frombuffer(data, np.uint8, min(WINDOW + 1, len(data) - at), at).astype(np.uint32)
        pair = b[:-1] | b[1:] << np.uint32(8)
        total += np.bincount((pair ^ np.uint32(seed)) * np.uint32(2654435761) >> np.uint32(24), minlength=CELLS)
    norm = np.linalg.norm(total)
    return total / norm if norm else total


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place along the Hilbert curve of each row of grid cells (whole numbers under 2 ** bits)."""
    x = [c.astype(np.int64) for c in cells.T]
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the curve, from the coarsest level down
        for i in range(d):
            far = (x[i] & q) > 0
            swap = np.where(far, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(far, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[d - 1] & q) > 0, q - 1, 0)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | (((c ^ flip) >> bit) & 1)
    return key


def grid(points: np.ndarray, mean: np.ndarray, spread: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Cells of points: numbers in their spread, drawn to the unit interval by a logistic curve."""
    z = (points - mean) / np.where(spread > 0, spread, 1.0)
    return np.clip((1 << bits) / (1 + np.exp(-1.7 * z)), 0, (1 << bits) - 1).astype(np.int64)


# -- ids of the tokenizers library


@cache
def _classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point.

    Where the Unicode versions of Python and of the regex library differ, the tokenizers library is asked.
    """
    from tokenizers import pre_tokenizers

    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    every, newer = "".join(map(chr, points)), np.full(0x110000, _OTHER, np.uint8)
    for k, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            newer[points[m.start()] : points[m.end() - 1] + 1] = k
    newer[0xD800:0xE000] = _OTHER
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for i in np.flatnonzero(out != newer).tolist():
        spans = [x for _, x in cut(f"a{chr(i)}1")]
        out[i] = _OTHER if len(spans) == 3 else _LETTER if spans[0][1] == 2 else _NUMBER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _BLANK  # White_Space
    return out


def pre_tokens(batch: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """(pre-tokens of all texts, end to end; how many each text has), as the byte-level pre-tokenizer cuts them.

    Runs of letters, of numbers and of other marks, each with a space in front; a run of white space
    leaves its last character to what follows; 's, 't, 're, 've, 'm, 'll and 'd stand alone where
    an apostrophe begins a run.
    """
    joined = "\0".join(batch) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[points]
    ends = np.cumsum(np.fromiter(map(len, batch), np.int64, len(batch)) + 1) - 1  # of each text's edge
    kind[ends] = _EDGE
    n = len(points)
    before = np.concatenate([[np.uint8(_EDGE)], kind[:-1]])
    after = np.concatenate([kind[1:], [np.uint8(_EDGE)]])
    first = kind != before
    # The last of several blanks parts from the rest when something follows; a space joins what follows it.
    last = (kind == _BLANK) & (after != _BLANK) & (after != _EDGE)
    first |= last
    space = np.flatnonzero(last & (points == 32))
    first[space + 1] = False
    # Contractions.
    quote = np.flatnonzero((points == 39) & (before != _OTHER) & (after == _LETTER))
    quote = quote[(before[quote] == _EDGE) | (points[quote - 1] != 32)]
    if len(quote):
        one, two = points[quote + 1], points[np.minimum(quote + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        first[quote[short | long] + 1] = False
        first[quote[short] + 2] = True
        first[quote[long] + 3] = True
    first[ends] = True
    at = np.flatnonzero(first)
    width = np.ones(n, np.uint8)  # bytes of each code point
    if not joined.isascii():
        for low in (0x7F, 0x7FF, 0xFFFF):
            width += points > low
    offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(width, at, dtype=np.int64))]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(joined.encode("utf-8", "surrogatepass")))
    inner = kind[at] != _EDGE
    counts = np.diff(np.concatenate([[0], np.cumsum(inner)[np.searchsorted(at, ends)]]))
    return words.filter(pa.array(inner)), counts


class Encoder:
    """Ids of texts by the tokenizers library; pre-tokens that were seen before are not merged again."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        whole = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tok, self.one = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tok.encode_special_tokens = self.one.encode_special_tokens = True  # names of special tokens in a text are ordinary text
        self.tok.pre_tokenizer, self.one.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(GAP), whole]), whole
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id: an entry has a character for each
        for entry, i in vocabulary.items():
            self.width[i] = len(entry)
        self.seen: dict[str, bytes] = {}

    def _merged(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each pre-token, as bytes. Many are merged in one call; their bytes tell where the ids of each end."""
        joined = GAP.join(words)
        ids = np.array(self.tok.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
        stops = np.cumsum(self.width[ids])
        want = np.cumsum(np.fromiter((len(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)))
        at = np.searchsorted(stops, want) + 1
        data, low = ids.tobytes(), 0
        for high in (4 * at).tolist():
            yield data[low:high]
            low = high

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens, as bytes."""
        fresh = [w for w in words if w not in self.seen]
        if len(self.seen) + len(fresh) > MEMORY:
            self.seen, fresh = {}, words
        some = [w for w in fresh if GAP not in w]
        for at in range(0, len(some), 200):
            self.seen.update(zip(some[at : at + 200], self._merged(some[at : at + 200])))
        for w in fresh:
            if GAP in w:
                self.seen[w] = np.array(self.one.encode(w, add_special_tokens=False).ids, np.int32).tobytes()
        out = [self.seen[w] for w in words]
        for w in fresh:
            if len(w) > MEMORY_LENGTH:
                del self.seen[w]
        return out

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        words, counts = pre_tokens(batch)
        coded = words.dictionary_encode()
        found = pa.array(self._ids(coded.dictionary.to_pylist()), pa.binary()).take(coded.indices)
        ids = np.frombuffer(b"".join(found.buffers()[2:]) if len(found) else b"", np.int32)
        ends = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1)[1:] // 4
        upto = np.concatenate([[0], ends])[np.cumsum(counts)]
        return np.split(ids, upto[:-1])


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, with a bounded memory that its next tasks share."""
    return Encoder(path)


# -- packing


def placed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """row (a number of its own), doc_id, key (the place along the curve), packed (the compressed text). Written."""
    axes = [f"x{i}" for i in range(DIMENSIONS)]
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("packed", pa.binary()), *((a, pa.float64()) for a in axes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, to = zstandard.ZstdCompressor(level=3), projection(seed)
        row = TaskContext.get().partitionId() << 40
        for b in chunks(batches):
            rows = []
            for i, t in zip(column(b, "doc_id"), column(b, "text")):
                data = (t or "").encode("utf-8", "surrogatepass")
                rows.append((row, i, press.compress(data), *(vector(data, seed) @ to).tolist()))
                row += 1
            yield batch_of(schema, rows)

    kinds = "row long, doc_id long, packed binary, " + ", ".join(f"{a} double" for a in axes)
    rows = materialize(texts(docs).mapInArrow(run, kinds), "vectors")
    stats = rows.agg(*(f(a) for a in axes for f in (F.avg, F.stddev_pop))).first()
    mean, spread = (np.array([x or 0.0 for x in stats[k::2]]) for k in (0, 1))

    @F.pandas_udf("long")
    def key(*x):
        import pandas as pd

        return pd.Series(hilbert(grid(np.stack([c.to_numpy() for c in x], axis=1), mean, spread)))

    return rows.select("row", "doc_id", "packed", key(*axes).alias("key"))


class Packer:
    """Pieces of one range: (index of the text, start, ids, sequence, offset), as sequences fill up."""

    def __init__(self, length: int):
        self.length, self.sequence, self.open, self.room = length, 0, [], length

    def add(self, doc: tuple, ids: np.ndarray) -> Iterator[tuple]:
        """Pieces of the sequences that ``doc`` completes."""
        at = 0
        while at < len(ids):
            part = ids[at : at + self.room]
            self.open.append((doc, at, part))
            self.room -= len(part)
            at += len(part)
            if not self.room:
                yield from self._close([self.length])

    def end(self) -> Iterator[tuple]:
        """The rest: sequences of the powers of two that it consists of, longest first."""
        rest = self.length - self.room
        yield from self._close([1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1])

    def _close(self, lengths: list[int]) -> Iterator[tuple]:
        held, self.open, self.room = self.open[::-1], [], self.length
        for length in lengths:
            offset = 0
            while offset < length:
                doc, start, ids = held.pop()
                part = ids[: length - offset]
                if len(part) < len(ids):
                    held.append((doc, start + len(part), ids[len(part) :]))
                yield doc, start, part, self.sequence, offset
                offset += len(part)
            self.sequence += 1


def _packed(docs: DataFrame, last: str, kind: pa.DataType, value, length: int, path: str | None, end: int) -> DataFrame:
    """Rows of pieces; ``value`` makes the column ``last`` of a piece's ids."""
    if length < 1:
        raise ValueError("length")
    path = path or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), (last, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, coder, packer = zstandard.ZstdDecompressor(), encoder(path), Packer(length)
        base, rows, size = TaskContext.get().partitionId() << 40, [], 0

        def made(pieces):
            nonlocal rows, size
            for (doc_id, total), start, ids, sequence, offset in pieces:
                rows.append((doc_id, start, len(ids), total, base | sequence, offset, value(ids)))
                size += len(ids)

        for b in batches:
            i, data = column(b, "doc_id"), b.column(b.schema.get_field_index("packed"))
            for part in _bounded(data, press):
                for at, ids in zip(part, coder.encode([press.decompress(data[k].as_py()).decode("utf-8", "surrogatepass") for k in part])):
                    ids = np.append(ids, np.int32(end))
                    made(packer.add((i[at], len(ids)), ids))
                    if size > 1 << 19:
                        yield batch_of(schema, rows)
                        rows, size = [], 0
        made(packer.end())
        yield batch_of(schema, rows)

    rows = placed(docs)
    packed_bytes = rows.agg(F.sum(F.length("packed"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), packed_bytes // RANGE_BYTES + 1)
    order = ["key", "doc_id", "row"]
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "packed")
    fields = {pa.int64(): "long", pa.list_(pa.int32()): "array<int>"}
    return ranged.mapInArrow(run, f"doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, {last} {fields[kind]}")


def _bounded(data: pa.Array, press: zstandard.ZstdDecompressor, limit: int = 2 << 20) -> Iterator[list[int]]:
    """Rows whose texts hold at most ``limit`` bytes together, or a single one."""
    part, held = [], 0
    for k in range(len(data)):
        size = zstandard.frame_content_size(data[k].as_py())
        if part and held + size > limit:
            yield part
            part, held = [], 0
        part.append(k)
        held += size
    if part:
        yield part


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, end: int = END) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids array<int>: a row for each piece."""
    return _packed(docs, "ids", pa.list_(pa.int32()), lambda ids: ids, length, path, end)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: pieces of ``pack`` with the checksum of their ids."""
    return _packed(docs, "ids_crc32", pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), LENGTH, None, END)
