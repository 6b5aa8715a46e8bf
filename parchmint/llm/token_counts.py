"""Token counts under a unigram model, by dynamic programming that a trie shares.

Distinct pre-tokens (words with a leading word mark) are inserted in a trie. The best forward
score of a node depends only on the characters on its way from the root, so it is computed once
for all pre-tokens with that prefix; the number of pieces of the best path is stored at terminals
and read for each occurrence.

The pieces are those of a public SentencePiece model, which holds no unigram probabilities. The
probabilities are learned from all texts by one round of expectation and maximisation: pieces of
each pre-token's best path under Zipf's law over the vocabulary's order are counted over the whole
corpus, and their smoothed shares are the model. Scores are whole micro-nats, so that sums are exact
and do not depend on how rows are dealt out. A character that no piece covers falls back to its UTF-8
bytes, one token each. Of equally good paths the one with fewer pieces counts.

Null or empty text: no tokens. Repeated rows: a result each, and counted as often in the model. Empty
table: empty result. Pre-tokens of more than LONG characters pass through a window of the trie's
recurrence instead of the trie, so texts without spaces need little memory. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import WORD, batch_of, chunks, column, released, texts

#: The mark that stands for the space before a word.
MARK = "▁"
#: Length beyond which a word is not inserted, words of one trie, words whose counts a task remembers.
LONG, BATCH, REMEMBERED = 40, 20_000, 400_000
#: Micro-nats by which a byte is worse than the rarest piece.
BYTE_PENALTY = 2_000_000
#: What is added to each piece's count.
SMOOTHING = 0.5


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@cache
def pieces_of(path: str) -> tuple[str, ...]:
    """The vocabulary's pieces in its order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple(model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))


def zipf(pieces: tuple[str, ...]) -> dict[str, int]:
    """Scores by Zipf's law over the vocabulary's order: where learning starts."""
    total = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: -round(1e6 * (math.log(r) + total)) for r, p in enumerate(pieces, 1)}


class Endings:
    """All pieces and their endings, by a hash that grows from the last character to the first."""

    FACTOR, NONE = np.uint64(0x9E3779B97F4A7C15), np.iinfo(np.int64).min

    def __init__(self, scores: dict[str, int]):
        self.byte = min(scores.values(), default=0) - BYTE_PENALTY
        self.plain: dict[str, int | None] = {p[i:]: None for p in scores for i in range(1, len(p))} | scores
        self.longest = max(map(len, scores), default=1)
        number = {p: i for i, p in enumerate(scores)}
        hashes = np.array([self.hash(e) for e in self.plain], np.uint64)
        order = np.argsort(hashes)
        known = list(self.plain.items())
        self.keys = hashes[order]
        self.score = np.array([self.NONE if known[i][1] is None else known[i][1] for i in order], np.int64)
        self.piece = np.array([number.get(known[i][0], -1) for i in order], np.int32)
        self.pieces = list(scores)

    def hash(self, text: str) -> int:
        h = 0
        for ch in reversed(text):
            h = (h * int(self.FACTOR) + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
        return h


class Trie:
    """A trie of distinct words, level by level: what is known of a node holds for all words below it.

    Words are sorted, so a word's first nodes are those of the word before it, as far as both agree.
    """

    def __init__(self, words: list[str], endings: Endings):
        self.words = sorted(words)
        self.endings = endings
        texts_ = [MARK + w for w in self.words]
        size = np.array([len(t) for t in texts_], np.int64)
        deep = int(size.max(initial=0))
        points = np.zeros((len(texts_), deep), np.uint32)
        points[np.arange(deep)[None, :] < size[:, None]] = np.frombuffer("".join(texts_).encode("utf-32-le", "surrogatepass"), np.uint32)
        shared = np.zeros(len(texts_), np.int64)
        if len(texts_) > 1:
            shared[1:] = np.minimum.accumulate(points[1:] == points[:-1], axis=1).sum(axis=1)
            shared[1:] = np.minimum(shared[1:], np.minimum(size[1:], size[:-1]))
        fresh = (np.arange(1, deep + 1)[None, :] > shared[:, None]) & (np.arange(1, deep + 1)[None, :] <= size[:, None])
        count = int(fresh.sum()) + 1  # node 0 is the root
        node = np.zeros((len(texts_), deep + 1), np.int32)
        self.best, self.tokens = np.zeros(count, np.int64), np.zeros(count, np.int64)
        self.from_, self.piece = np.zeros(count, np.int32), np.full(count, -1, np.int32)
        self.levels, made = [], 1
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)  # UTF-8 bytes
        for d in range(1, deep + 1):
            rows = np.flatnonzero(fresh[:, d - 1])
            ids = np.arange(made, made + len(rows), dtype=np.int32)
            made += len(rows)
            node[rows, d] = ids
            node[:, d] = np.maximum.accumulate(node[:, d])
            self._fill(rows, ids, d, points, node, width)
            self.levels.append(ids)
        self.terminal = node[np.arange(len(texts_)), size]

    def _fill(self, rows: np.ndarray, ids: np.ndarray, d: int, points: np.ndarray, node: np.ndarray, width: np.ndarray) -> None:
        """Best path to each new node of one level: over its last piece, or its last character's bytes."""
        e, up = self.endings, node[rows, d - 1]
        top, least = self.best[up] + width[rows, d - 1] * e.byte, self.tokens[up] + width[rows, d - 1]
        start, piece = up.copy(), np.full(len(rows), -1, np.int32)
        live, h = np.arange(len(rows)), np.zeros(len(rows), np.uint64)
        for begin in range(d - 1, -1, -1):
            h = h * e.FACTOR + points[rows[live], begin].astype(np.uint64) + np.uint64(1)
            at = np.minimum(np.searchsorted(e.keys, h), len(e.keys) - 1)
            known = e.keys[at] == h
            live, h, at = live[known], h[known], at[known]
            if not len(live):
                break
            some = e.score[at] != e.NONE
            who, at = live[some], at[some]
            before = node[rows[who], begin]
            s, n = self.best[before] + e.score[at], self.tokens[before] + 1
            better = (s > top[who]) | (s == top[who]) & (n < least[who])
            who = who[better]
            top[who], least[who], start[who], piece[who] = s[better], n[better], before[better], e.piece[at[better]]
        self.best[ids], self.tokens[ids], self.from_[ids], self.piece[ids] = top, least, start, piece

    def measured(self) -> dict[str, tuple[int, int]]:
        """(tokens, score) of each word."""
        return dict(zip(self.words, zip(self.tokens[self.terminal].tolist(), self.best[self.terminal].tolist())))

    def pieces(self, times: list[int]) -> np.ndarray:
        """How often each piece stands on the words' best paths; ``times`` in the order of ``words``."""
        weight = np.zeros(len(self.best), np.int64)
        np.add.at(weight, self.terminal, np.array(times, np.int64))
        total = np.zeros(len(self.endings.pieces), np.int64)
        for ids in reversed(self.levels):
            ids = ids[weight[ids] > 0]
            some = ids[self.piece[ids] >= 0]
            np.add.at(total, self.piece[some], weight[some])
            np.add.at(weight, self.from_[ids], weight[ids])
        return total


def forward(word: str, endings: Endings) -> tuple[int, int, Counter]:
    """(tokens, score, pieces) of one long word, by the same recurrence in a window of the longest piece."""
    text, size, found = MARK + word, endings.longest + 1, Counter()
    best, count, steps = [0] * size, [0] * size, bytearray(len(text) + 1)
    for d in range(1, len(text) + 1):
        n = len(text[d - 1].encode("utf-8", "surrogatepass"))
        top, least, back = best[(d - 1) % size] + n * endings.byte, count[(d - 1) % size] + n, 0
        for begin in range(d - 1, -1, -1):
            s = endings.plain.get(text[begin:d], 0)
            if s == 0:  # no piece ends so, and none that is longer
                break
            if s is not None:
                s += best[begin % size]
                if s > top or s == top and count[begin % size] + 1 < least:
                    top, least, back = s, count[begin % size] + 1, d - begin
        best[d % size], count[d % size], steps[d] = top, least, back
    d = len(text)
    while d:
        if steps[d]:
            found[text[d - steps[d] : d]] += 1
        d -= steps[d] or 1
    return count[len(text) % size], best[len(text) % size], found


class Counts:
    """Tokens and scores of words; what is new of a batch goes through one trie."""

    SHIFT = 40  # a word's value is its score shifted by so many bits, plus its tokens: both are summed at once

    def __init__(self, endings: Endings):
        self.endings, self.value = endings, {}

    def ready(self, words: set[str]) -> None:
        fresh = words.difference(self.value)
        if len(self.value) + len(fresh) > REMEMBERED:
            self.value, fresh = {}, words
        short = [w for w in fresh if len(w) <= LONG]
        for at in range(0, len(short), BATCH):
            for w, (tokens, score) in Trie(short[at : at + BATCH], self.endings).measured().items():
                self.value[w] = (score << self.SHIFT) + tokens
        for w in fresh:
            if len(w) > LONG:
                tokens, score, _ = forward(w, self.endings)
                self.value[w] = (score << self.SHIFT) + tokens

    def count(self, words: list[str]) -> tuple[int, int]:
        """(tokens, score) of a document's words, which are ready."""
        both = sum(map(self.value.__getitem__, words))
        return both & (1 << self.SHIFT) - 1, both >> self.SHIFT


@cache
def first_endings(path: str) -> Endings:
    return Endings(zipf(pieces_of(path)))


def learn(docs: DataFrame, path: str | None = None) -> dict[str, int]:
    """Score of each piece in micro-nats, learned from all texts; a count for each piece reaches the driver."""
    path = path or default_model()
    schema = pa.schema([("piece", pa.int32()), ("n", pa.int64())])
    word = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings = first_endings(path)
        number = {p: i for i, p in enumerate(endings.pieces)}
        total, seen = np.zeros(len(number), np.int64), Counter()

        def tell() -> None:
            nonlocal total
            short = [w for w in seen if len(w) <= LONG]
            for at in range(0, len(short), BATCH):
                tree = Trie(short[at : at + BATCH], endings)
                total += tree.pieces([seen[w] for w in tree.words])
            for w, n in seen.items():
                if len(w) > LONG:
                    for p, k in forward(w, endings)[2].items():
                        total[number[p]] += n * k
            seen.clear()

        for b in chunks(batches):
            seen.update(chain.from_iterable(word.findall(t) for t in column(b, "text") if t))
            if len(seen) > REMEMBERED:
                tell()
        tell()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], schema=schema)

    found = texts(docs).mapInArrow(released(run), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    pieces = pieces_of(path)
    counts = np.full(len(pieces), SMOOTHING)
    for piece, n in found:
        counts[piece] += n
    logs = np.log(counts / counts.sum())
    return {p: round(1e6 * x) for p, x in zip(pieces, logs.tolist())}


def count(docs: DataFrame, path: str | None = None, scores: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, log_score (micro-nats of the best segmentation)."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, path) if scores is None else scores)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("log_score", pa.int64())])
    word = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(Endings(shared.value))
        for b in chunks(batches):
            found = [word.findall(t or "") for t in column(b, "text")]
            counts.ready(set(chain.from_iterable(found)))
            yield batch_of(schema, [(i, len(w), *counts.count(w)) for i, w in zip(column(b, "doc_id"), found)])

    return texts(docs).mapInArrow(released(run), "doc_id long, n_words long, n_tokens long, log_score long")
