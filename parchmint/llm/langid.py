"""Language identification: the family first, then one-versus-one linear SVMs within it.

A text becomes the hashed counts of its letter 1-, 2- and 3-grams, square-rooted and of unit
length. One linear support vector machine for each family, against a sample of all others, tells
the family (the machines grow in number with the families, not with their pairs). Within a family
one machine for each pair of its languages votes on the language.

Machines are fitted in tasks, each from its own bounded sample of labelled rows, by dual coordinate
descent over sparse rows in the order of the texts' digests: the same rows give the same model,
however they are dealt out. Every labelled language is learned, however many there are.

A text that is null or has no letters is ``und`` with score 0. Rows with null language are never
learned from; with no labelled row at all every text is ``und``; with one language all texts with
letters are of it. Repeated rows: a result each. Empty table: empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import batch_of, chunks, column, texts

#: Families of languages (fixed values); a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "pl cs sk sl hr sr bs mk ru uk be bg",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt",
    "iranian": "fa ku ps tg",
    "indic": "hi ur bn pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "austronesian": "id ms tl jv",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
#: Hash buckets of the n-grams.
BUCKETS = 1 << 13
#: The sample's bounds: labelled rows of each language, and rows of other families against each family.
ROWS_EACH, OTHERS = 400, 1600
#: Regularisation and passes of the dual coordinate descent.
C, PASSES = 10.0, 15


@cache
def letters() -> np.ndarray:
    """Lower-case letter of each code point, 32 for all that are no letters."""
    out = np.full(0x110000, 32, np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def vector(text: str | None) -> np.ndarray | None:
    """Unit vector of a whole text, or None without letters."""
    x = letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not (x != 32).any():
        return None
    x = np.concatenate([[32], x, [32]]).astype(np.uint32)
    x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + x[2:]
    grams = np.concatenate([x * np.uint32(0xC2B2AE35), two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)])
    counts = np.sqrt(np.bincount(grams >> np.uint32(19), minlength=BUCKETS)).astype(np.float32)
    return counts / np.linalg.norm(counts)


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights (last one the bias) of a linear SVM with hinge loss, for sparse rows (buckets, values) and y of -1 and 1."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(BUCKETS, np.float32), 0.0, np.zeros(len(rows))
    diag = [float(v @ v) + 1 for _, v in rows]
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)).tolist():
            k, v = rows[i]
            slope = y[i] * (float(w[k] @ v) + bias) - 1
            fresh = min(max(alpha[i] - slope / diag[i], 0.0), C)
            if fresh != alpha[i]:
                step = (fresh - alpha[i]) * y[i]
                w[k] += np.float32(step) * v
                bias += step
                alpha[i] = fresh
    return np.append(w, np.float32(bias))


@dataclass
class Model:
    """Languages of each family, a machine for each family, and one for each pair within a family."""

    families: dict[str, list[str]] = field(default_factory=dict)
    among: np.ndarray | None = None  # a row of weights for each family, in order
    within: dict[str, tuple[list[tuple[int, int]], np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def sure(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Confidence of each machine that the first of its classes is right."""
        return 1 / (1 + np.exp(-np.clip(2 * (weights[:, :-1] @ x + weights[:, -1]), -30, 30)))

    def predict(self, text: str | None) -> tuple[str, float]:
        x = vector(text) if self.families else None
        if x is None:
            return "und", 0.0
        names = list(self.families)
        p = self.sure(x, self.among) if len(names) > 1 else np.ones(1)
        best = int(p.argmax())  # of equal ones the first by name
        langs = self.families[names[best]]
        if len(langs) == 1:
            return langs[0], float(p[best])
        pairs, weights = self.within[names[best]]
        q = self.sure(x, weights)
        votes, total, duels = np.zeros(len(langs)), np.zeros(len(langs)), len(langs) - 1
        for (a, b), s in zip(pairs, q.tolist()):
            votes[a] += (s >= 0.5) + 1e-3 * s
            votes[b] += (s < 0.5) + 1e-3 * (1 - s)
            total[a] += s
            total[b] += 1 - s
        k = int(votes.argmax())
        return langs[k], float(p[best] * total[k] / duels)


def fit(docs: DataFrame, rows_each: int = ROWS_EACH, others: int = OTHERS) -> Model:
    """A model of all labelled languages.

    Each machine learns from at most about ``rows_each`` rows of each language that it is for and
    ``others`` rows of all other families. A count for each language and one vector of weights for
    each machine reach the driver.
    """
    labelled = texts(docs, "lang").filter(F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    families: dict[str, list[str]] = {}
    for lang in counts:
        families.setdefault(FAMILY.get(lang, lang), []).append(lang)
    families = {f: families[f] for f in sorted(families)}
    if len(counts) < 2:
        return Model(families)
    names = list(families)
    number = {f: i for i, f in enumerate(names)}
    pairs = [(f, a, b) for f in names for a, b in combinations(families[f], 2)]
    duels: dict[str, list[tuple[int, int]]] = {}  # (machine, class) of each language; families' machines come first
    for m, (_, a, b) in enumerate(pairs, len(names)):
        duels.setdefault(a, []).append((m, 1))
        duels.setdefault(b, []).append((m, -1))
    share = {lang: min(1.0, rows_each / n) for lang, n in counts.items()}
    drawn = sum(n * share[lang] for lang, n in counts.items())
    against = min(1.0, others / max(1.0, drawn))
    schema = pa.schema([("machine", pa.int32()), ("y", pa.int32()), ("mark", pa.binary()), ("bucket", pa.binary()), ("value", pa.binary())])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[str, bytes]] = set()  # copies of a text teach nothing new
        for b in chunks(batches):
            rows = []
            for i, lang, text in zip(column(b, "doc_id"), column(b, "lang"), column(b, "text")):
                mark = hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()
                slot = hashlib.blake2b(mark + str(i).encode(), digest_size=8).digest()
                if int.from_bytes(slot, "big") / 2**64 >= share[lang] or (lang, mark) in sent or (x := vector(text)) is None:
                    continue
                sent.add((lang, mark))
                k = np.flatnonzero(x)
                data = (mark, k.astype(np.uint16).tobytes(), x[k].tobytes())
                own = number[FAMILY.get(lang, lang)]
                draws = np.random.default_rng(int.from_bytes(mark[8:], "big")).random(len(names))
                rows += [(m, y, *data) for m, y in duels.get(lang, ())]
                if len(names) > 1:
                    rows.append((own, 1, *data))
                    rows += [(m, -1, *data) for m in np.flatnonzero(draws < against).tolist() if m != own]
            yield batch_of(schema, rows)

    def machine(table: pa.Table) -> pa.Table:
        # Each text once, ordered by digest: the fit does not depend on how rows arrived.
        table = table.group_by(["mark", "y"]).aggregate([("machine", "min"), ("bucket", "min"), ("value", "min")]).rename_columns(["mark", "y", "machine", "bucket", "value"])
        table = table.sort_by([("mark", "ascending"), ("y", "ascending")])
        rows = [(np.frombuffer(k, np.uint16).astype(np.int64), np.frombuffer(v, np.float32)) for k, v in zip(table["bucket"].to_pylist(), table["value"].to_pylist())]
        w = svm(rows, np.array(table["y"].to_pylist(), float))
        return pa.table({"machine": table["machine"][:1].cast(pa.int32()), "weights": pa.array([w.tobytes()], pa.binary())})

    drawn_rows = labelled.mapInArrow(sample, "machine int, y int, mark binary, bucket binary, value binary")
    fitted = drawn_rows.groupBy("machine").applyInArrow(machine, "machine int, weights binary").collect()
    weights = np.zeros((len(names) + len(pairs), BUCKETS + 1), np.float32)
    for m, w in fitted:
        weights[m] = np.frombuffer(w, np.float32)
    within = {}
    for f in names:
        own = [m for m, p in enumerate(pairs, len(names)) if p[0] == f]
        if own:
            place = {lang: i for i, lang in enumerate(families[f])}
            within[f] = ([(place[pairs[m - len(names)][1]], place[pairs[m - len(names)][2]]) for m in own], weights[own])
    return Model(families, weights[: len(names)], within)


def held_out():
    """Whether crc32 of doc_id as text leaves 2 on division by 4 (fixed by contract)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for b in chunks(batches):
            yield batch_of(schema, [(i, *found.predict(t)) for i, t in zip(column(b, "doc_id"), column(b, "text"))])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; learns only from rows that aren't held out."""
    model = fit(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
