"""Operators on pairs and on the whole corpus, and the pipeline, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from parchmint.llm import bpe, mixing, ngram_join, quality, secrets, suffix_dedup

ENGLISH = "the of and to in a is that it for was on"
EXTRA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    """Texts with exact copies, near copies, shared passages, hard rows and repeated ids."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "ter", "so") for b in ("ra", "ten", "vik", "el", "do")]
    make = lambda k: [rng.choice(words) for _ in range(k)]
    passage = make(70)
    rows: list[tuple] = [(900, None), (901, ""), (902, "one two"), (903, "one two"), (904, "ONE two"), (None, "no id at all"), (905, " \n ")]
    for i in range(n):
        kind = i % 4
        w = make(rng.randint(40, 160))
        if kind == 1:
            w[20:20] = passage
        if kind == 2 and rows[-1][1]:
            w = rows[-1][1].split()
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [rows[10], (12, "same id with another text"), (950, rows[20][1])]
    return [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]


def sets_of(rows):
    out = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute_classes(rows):
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    group = defaultdict(list)
    for a in range(len(rows)):
        group[root(a)].append(a)
    least = {}
    for members in group.values():
        ids = [rows[m][0] for m in members if rows[m][0] is not None]
        for m in members:
            least[m] = min(ids) if ids and sets[m] else rows[m][0]
    return sets, root, least


def test_classes_equal_brute_force(spark):
    rows = corpus()
    sets, _, least = brute_classes(rows)
    got = ngram_join.classes(spark.createDataFrame(rows, EXTRA)).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], len(sets[i]), least[i]) for i, r in enumerate(rows))
    assert ngram_join.classes(spark.createDataFrame([], EXTRA)).collect() == []


def test_one_of_each_class_stays(spark):
    rows = corpus(1)
    sets, root, _ = brute_classes(rows)
    kept = ngram_join.keep_one(spark.createDataFrame(rows, EXTRA)).collect()
    assert len(kept) == len({root(i) for i in range(len(rows)) if sets[i]}) + sum(not s for s in sets)


def test_divide_skip_equals_counting():
    rng = random.Random(6)
    import numpy as np

    base = rng.sample(range(10_000), 120)
    sets = [np.unique(np.array(rng.sample(base, rng.randint(80, 120)) + rng.sample(range(10_000, 20_000), rng.randint(0, 30)), np.uint64)) for _ in range(60)]
    query = sets[0]
    want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(query, s)) >= 80 * len(np.union1d(query, s))]
    assert sorted(ngram_join.Index(sets).search(query)) == want and len(want) > 1


def brute_cut(rows):
    values = [(t or "").encode() for _, t, *_ in rows]
    starts = Counter(v[i : i + 200] for v in values for i in range(len(v) - 199))
    out = []
    for (i, *_), v in zip(rows, values):
        gone = [False] * len(v)
        for k in range(len(v) - 199):
            if starts[v[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(v), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(v, gone) if not g)).hexdigest()))
    return out


def test_removed_bytes_equal_brute_force(spark):
    rows = corpus(2) + [(960, "ab" * 300, "en", "s", 600), (961, "é" * 250, "en", "s", 1)]
    got = suffix_dedup.removed(spark.createDataFrame(rows, EXTRA)).collect()
    want = brute_cut(rows)
    assert sum(w[2] for w in want) > 5000
    assert Counter(map(tuple, got)) == Counter(want)
    assert suffix_dedup.removed(spark.createDataFrame([], EXTRA)).collect() == []


def test_hot_anchors_are_not_sorted_in_one_block(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 8, raising=False)
    blocks, largest = suffix_dedup._sorted_blocks, []

    def watched(dealt):
        largest.append(max(r["count"] for r in dealt.groupBy("anchor").count().collect()))
        return blocks(dealt)

    monkeypatch.setattr(suffix_dedup, "_sorted_blocks", watched)
    rows = corpus(4, 120) + [(970, "ab" * 300, "en", "s", 600), (971, "xyz" * 400, "en", "s", 1)]
    got = suffix_dedup.removed(spark.createDataFrame(rows, EXTRA)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_cut(rows))
    assert largest and largest[0] <= 8


def test_long_texts_under_one_id_or_none_are_cut_once(spark):
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = letters(260)
    rows = [(i, letters(300) + shared + letters(300), "en", "s", 1) for i in (1, 1, 1, 2, None, None, None)]
    got = suffix_dedup.removed(spark.createDataFrame(rows, EXTRA)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_cut(rows))


def test_suffixes_are_sorted():
    rng = random.Random(8)
    contexts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(200, 320))) for _ in range(5)] + [b"a" * 260]
    owned = [len(c) - 199 for c in contexts]
    sa, starts, data = suffix_dedup.suffix_array(contexts, owned)
    place = {int(s) + k: c[k : k + 200] for s, c, n in zip(starts, contexts, owned) for k in range(n)}
    assert sorted(sa.tolist()) == sorted(place)
    keys = [place[int(p)] for p in sa]
    assert keys == sorted(keys)
    lcp = suffix_dedup.common_prefixes(sa, data)
    assert [int(x) for x in lcp] == [next((k for k in range(200) if a[k] != b[k]), 200) for a, b in zip(keys, keys[1:])]


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    common = ENGLISH.split()
    other = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("ra", "ten", "vik") for c in ("el", "do", "sun")]
    text = lambda: " ".join(rng.choice(common if rng.random() < 0.5 else other) for _ in range(120)).capitalize() + "."
    rows = [(i, text(), "en", f"s{i % 2}", None) for i in range(60)]
    rows += [(100, rows[0][1] + " token = abcdefghij123456", "en", "s0", 1), (101, " ".join(w + "$$$" for w in rows[1][1].split()), "en", "s1", 1), (102, "too short", "en", "s0", 1)]
    rows[5] = (5, rows[5][1] + " password: abcdefghijkl99", "en", "s1", None)
    docs = spark.createDataFrame(rows, EXTRA)
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == {*range(60), 100} and kept.columns == docs.columns
    one = corpus_pipeline.near_duplicates(spark, kept, "")
    assert {r["doc_id"] for r in one.collect()} == set(range(60)) and one.columns == docs.columns
    clean = corpus_pipeline.secret_scan(spark, one, "")
    assert clean.columns == docs.columns and "abcdefghijkl99" not in "".join(r["text"] for r in clean.collect())
    mixed = corpus_pipeline.mix_sources(spark, clean, "")
    assert mixed.columns == docs.columns
    ids = corpus_pipeline.encode(spark, mixed, "")

    # The same by hand.
    ratios = secrets.fit(one)
    want = Counter()
    taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.digest(clean).collect()}
    coder = bpe.Encoder(bpe.default_ranks(), bpe.default_pattern())
    for i, t, *_ in rows[:60]:
        base = secrets.base_spans(t)
        for s, _, e in sorted(base + secrets.markov_spans(t, ratios, base), reverse=True):
            t = t[:s] + "[SECRET]" + t[e:]
        want[i, tuple(coder.encode([t])[0])] = taken[i]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in ids.collect()) == +want
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sum(want.values())


def test_only_halves_that_others_hold_become_rows(spark):
    rows = [(0, 9, 70, [5, -7, 11]), (1 << 33, 8, 60, [-7, 12, 5]), (3, 7, 50, []), (4, 6, 40, [-7, 13])]
    found = ngram_join._repeated(spark.createDataFrame(rows, "node long, n long, end long, rare array<int>")).collect()
    want = {(10, 0, 0, 9, 70), (-14, 0, 1, 9, 70), (-14, 1 << 33, 0, 8, 60), (10, 1 << 33, 2, 8, 60), (-14, 4, 0, 6, 40)}
    assert {tuple(r) for r in found} == want and len(found) == len(want)
