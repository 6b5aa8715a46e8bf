"""License scans: fuzzy search for short notices.

A notice of which at most k characters may be edited is cut into k + 1 pieces; by the pigeonhole
principle every match holds at least one piece unchanged. The pieces of all notices go into one
Aho-Corasick automaton whose hits give candidate windows; there the regex library's bounded-error
matching decides and reports the span and its edits. Texts are compared as lower-case words joined
by one space.

What tells licenses apart may not be edited: a notice's digits and its FIXED words must stand in the
match as whole words, as often as in the notice, and no other word of the match may be one of them
or hold a digit. A match counts with its first and last word in full.

Null or empty text: no words, no labels, score 0. Repeated rows: a result each. Empty table: empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import batch_of, chunks, column, texts

#: Base phrases and labels (fixed by contract).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Short notices of common licenses (fixed values): words, label, edits allowed.
NOTICES = (
    ("under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("apache license version 2", "apache-2", 2),
    ("licensed under the apache license version 2", "apache-2", 4),
    ("creative commons attribution noncommercial", "cc-by-nc", 4),
    ("creative commons attribution sharealike", "cc-by-sa", 4),
    ("creative commons attribution 4 0 international", "cc-by", 4),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("mozilla public license version 2", "mpl-2", 3),
    ("eclipse public license version 2", "epl-2", 3),
    ("boost software license version 1", "bsl-1", 3),
    ("sil open font license version 1 1", "ofl-1", 3),
    ("the above copyright notice and this permission notice shall be included in all copies", "mit", 7),
    ("neither the name of the copyright holder nor the names of its contributors may be used", "bsd", 7),
    ("no copyright to the extent possible under law waived all copyright and related or neighboring rights", "cc0", 8),
    ("redistribution and use in source and binary forms", "bsd", 5),
    ("redistributions of source code must retain the above copyright notice", "bsd", 6),
    ("this is free and unencumbered software released into the public domain", "unlicense", 6),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 6),
    ("all rights reserved", "all-rights-reserved", 1),
)

#: Words that may not be edited, besides all words with digits (fixed values).
FIXED = frozenset("mit apache mozilla gnu lesser affero general noncommercial sharealike eclipse boost sil".split())

_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal(text: str | None) -> tuple[str, int]:
    """(words joined by one space, number of words)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return b" ".join(words).decode("utf-8", "replace"), len(words)


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): edits + 1 pieces of nearly equal length that together are the notice."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@cache
def automaton(notices: tuple = NOTICES):
    import ahocorasick

    seeds: dict[str, list[tuple[int, int]]] = {}
    for k, (notice, _, edits) in enumerate(notices):
        for at, piece in pieces(notice, edits):
            seeds.setdefault(piece, []).append((k, at))
    auto = ahocorasick.Automaton()
    for piece, where in seeds.items():
        auto.add_word(piece, (len(piece), where))
    auto.make_automaton()
    return auto, [regex.compile(rf"(?e)(?:{regex.escape(n, literal_spaces=True)}){{e<={e}}}") for n, _, e in notices]


def windows(words: str, notices: tuple = NOTICES) -> dict[int, list[tuple[int, int]]]:
    """Merged candidate windows of each notice in a normalised text."""
    found: dict[int, list[tuple[int, int]]] = {}
    for end, (size, where) in automaton(notices)[0].iter(words):
        for k, at in where:
            notice, _, edits = notices[k]
            start = end + 1 - size - at
            found.setdefault(k, []).append((max(0, start - edits), min(len(words), start + len(notice) + edits)))
    merged: dict[int, list[tuple[int, int]]] = {}
    for k, places in found.items():
        for a, b in sorted(places):
            have = merged.setdefault(k, [])
            if have and a <= have[-1][1]:
                have[-1] = (have[-1][0], max(b, have[-1][1]))
            else:
                have.append((a, b))
    return merged


def fuzzy(words: str, notices: tuple = NOTICES) -> list[tuple[int, int, int, int]]:
    """(start, end, notice, edits) of verified matches, in characters of the normalised text."""
    spans = []
    for k, places in windows(words, notices).items():
        rule = automaton(notices)[1][k]
        for a, b in places:
            at = a
            while (m := rule.search(words, at, b)) is not None:
                if allowed(words, m.start(), m.end(), notices[k][0]):
                    spans.append((m.start(), m.end(), k, sum(m.fuzzy_counts)))
                    at = max(m.end(), at + 1)
                else:  # another match may begin inside of this one
                    at = m.start() + 1
    return sorted(spans)


@cache
def fixed_words(notice: str) -> list[str]:
    """The words of a notice that may not be edited, sorted."""
    return sorted(w for w in notice.split() if w in FIXED or any(c.isdigit() for c in w))


def allowed(words: str, start: int, end: int, notice: str) -> bool:
    """Whether a match keeps what may not be edited, seen with its first and last word in full."""
    low = words.rfind(" ", 0, start + 1) + 1 if not words[start : start + 1].isspace() else start + 1
    high = words.find(" ", max(end - 1, low))
    found = words[low : len(words) if high < 0 else high].split()
    return sorted(w for w in found if w in FIXED or any(c.isdigit() for c in w)) == fixed_words(notice)


def word_index(words: str) -> np.ndarray:
    """How many spaces stand before each character: the index of its word."""
    space = np.frombuffer(words.encode("utf-32-le", "surrogatepass"), np.uint32) == 32
    return np.concatenate([[0], np.cumsum(space)])


def base_places(words: str) -> list[tuple[int, str]]:
    """(word index, label) of every place where a base phrase stands."""
    padded, found = f" {words} ", []
    for phrase, label in BASE:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            found.append((at, label))
            at = padded.find(f" {phrase} ", at + 1)
    index = word_index(words) if found else None
    return sorted((int(index[at]), label) for at, label in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base array<struct<word, label>>, matches array<struct<label, start, stop, edits, score>>.

    start and stop are word indexes of the span in the normalised text, stop exclusive.
    """
    kinds = (pa.struct([("word", pa.int64()), ("label", pa.string())]), pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(kinds[0])), ("matches", pa.list_(kinds[1]))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            rows = []
            for i, t in zip(column(b, "doc_id"), column(b, "text")):
                words, n = normal(t)
                spans = fuzzy(words)
                index = word_index(words) if spans else None
                hits = [
                    {"label": NOTICES[k][1], "start": int(index[s]), "stop": int(index[e - 1]) + 1, "edits": edits, "score": round(1 - edits / len(NOTICES[k][0]), 6)}
                    for s, e, k, edits in spans
                ]
                rows.append((i, n, [{"word": w, "label": x} for w, x in base_places(words)], hits))
            yield batch_of(schema, rows)

    return texts(docs).mapInArrow(find, "doc_id long, n_words long, base array<struct<word:long,label:string>>, matches array<struct<label:string,start:long,stop:long,edits:int,score:double>>")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, derived from the operator's places and matches."""
    base, all_ = F.col("base.label"), F.array_union(F.col("base.label"), F.col("matches.label"))
    exact = F.when(F.size("base") > 0, 1.0).otherwise(0.0)
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(all_), ",").alias("labels"),
        F.greatest(exact, F.coalesce(F.array_max("matches.score"), F.lit(0.0))).alias("score"),
        F.size("matches").cast("long").alias("n_matches"),
    )
