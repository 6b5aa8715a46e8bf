"""Fill-in-middle transformation with a sparse checkpoint index.

A text is cut into units (lines, words or code points). One pass over its UTF-8 bytes, window by
window, counts the units and records a checkpoint (byte and code-point offset) after every EVERY of
them. A cut is found by a binary search of the checkpoints and a short scan from there, so no list of
all units is ever made: the index of a text of n units has n / EVERY entries.

Two cuts by a hash of the document's id split the text into prefix, middle and suffix, which are
written in the order of one of two forms; ``restore`` rebuilds the text. Texts that are empty or hold
one of the marks stay as they are (form plain).

Null text: like an empty one. Null id: hashed as an empty string. Repeated rows: a result each. Texts
of any length are handled one by one beyond 2 MB. Empty table: empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import batch_of, chunks, column, texts

#: Units between checkpoints, bytes of a scanned window.
EVERY, WINDOW = 64, 1 << 16
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Percent of texts that are transformed, of those that take the suffix first; seed of the hash.
RATE, SPM_RATE, SEED = 100, 50, 7
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def starts(window: np.ndarray, before: int, unit: str) -> np.ndarray:
    """Places of a window where a new unit begins; ``before`` is the byte in front of it."""
    previous = np.concatenate([[np.uint8(before)], window[:-1]])
    if unit == "line":
        return np.flatnonzero(previous == 10)
    if unit == "word":  # with the blanks after it; blanks at the start of a text are a unit
        return np.flatnonzero(_BLANK[previous] & ~_BLANK[window])
    if unit == "char":
        return np.flatnonzero((window & 0xC0) != 0x80)
    raise ValueError(unit)


class Checkpoints:
    """Byte and code-point offsets of every EVERY-th unit of one text, and its number of units."""

    def __init__(self, data: bytes, unit: str = "line", every: int = EVERY, window: int = WINDOW):
        self.data, self.unit, self.every, self.window = data, unit, every, window
        self.units, self.bytes, self.points = [0], [0], [0]
        seen = points = 0  # units that have begun after the first, code points up to the window
        for at in range(0, len(data), window):
            part = np.frombuffer(data, np.uint8, min(window, len(data) - at), at)
            leads = np.cumsum((part & 0xC0) != 0x80)
            found = self._inner(part, at)
            due = np.arange(-(seen + 1) % every, len(found), every)  # of these, the ones that are a multiple of EVERY
            self.units += (seen + 1 + due).tolist()
            self.bytes += (at + found[due]).tolist()
            self.points += (points + leads[found[due]] - 1).tolist()
            seen += len(found)
            points += int(leads[-1])
        self.n, self.n_points = (seen + 1 if data else 0), points

    def _inner(self, part: np.ndarray, at: int) -> np.ndarray:
        """Starts of units in a window, without the start of the text."""
        found = starts(part, self.data[at - 1] if at else 0, self.unit)
        return found if at else found[found > 0]

    def cut(self, k: int) -> tuple[int, int]:
        """(byte, code point) at which unit ``k`` begins, 0 <= k <= n."""
        if k >= self.n:
            return len(self.data), self.n_points
        i = bisect_right(self.units, k) - 1
        left, at, points, size = k - self.units[i], self.bytes[i], self.points[i], 256
        origin = at
        while left:  # units that are still to pass
            part = np.frombuffer(self.data, np.uint8, min(size, len(self.data) - at), at)
            found = starts(part, self.data[at - 1] if at else 0, self.unit)
            found = found[found + at > origin]
            stop = int(found[left - 1]) if left <= len(found) else len(part)
            points += int(np.count_nonzero((part[:stop] & 0xC0) != 0x80))
            left -= min(left, len(found))
            at += stop
            size = min(2 * size, self.window)
        return at, points


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit integers from the hash of a document's id."""
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(told[8 * i : 8 * i + 8], 16) for i in range(4)]


def parts(text: str, doc_id: int | None, unit: str = "line", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    data = text.encode("utf-8", "surrogatepass")
    index = Checkpoints(data, unit)
    h = draws(doc_id, seed)
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= rate:
        return index.n, "plain", None, None, text
    low, high = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
    (_, a), (_, b) = index.cut(low), index.cut(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    if h[3] % 100 < spm_rate:
        return index.n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return index.n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def transform(docs: DataFrame, unit: str = "line", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield batch_of(schema, [(i, *parts(t or "", i, unit, rate, spm_rate, seed)) for i, t in zip(column(b, "doc_id"), column(b, "text"))])

    return texts(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(transformed: DataFrame) -> DataFrame:
    """The rows with ``restored``: the text, rebuilt from form and output alone.

    No mark can arise where a part meets a mark, since no mark ends the way that one begins: the
    first one that is found is the one that was written.
    """
    p, s, m = MARKS
    inner = F.expr(f"substr(output, {len(p) + 1})")
    psm = F.split(inner, s, 2)  # prefix, rest
    spm = F.split(inner, p, 2)  # suffix, rest
    last = lambda x: F.split(x[1], m, 2)
    text = (
        F.when(F.col("form") == "psm", F.concat(psm[0], last(psm)[1], last(psm)[0]))
        .when(F.col("form") == "spm", F.concat(last(spm)[0], last(spm)[1], spm[0]))
        .otherwise(F.col("output"))
    )
    return transformed.withColumn("restored", text)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    told = lambda c: F.sha2(F.col(c), 256).alias(f"{'output' if c == 'output' else 'restored'}_sha256")
    return restore(transform(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", told("output"), told("restored"))
