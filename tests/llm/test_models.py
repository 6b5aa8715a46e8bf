"""Models and draws against plain versions: language machines, the splitting tree, ties and rows without size."""

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from parchmint.llm import langid, mixing, secrets

DATA = "/root/testdata/sf0.01"


def plain_vector(text):
    """n-grams of one to three letters, counted one by one; all that is no letter is one blank."""
    low = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in text]
    seq = [32]
    for c in [*low, 32]:
        if c != 32 or seq[-1] != 32:
            seq.append(c)
    wrap = lambda x: x & 0xFFFFFFFF
    two = [wrap(a * 0x9E3779B1 + b) for a, b in zip(seq, seq[1:])]
    three = [wrap(t * 0x85EBCA6B + c) for t, c in zip(two, seq[2:])]
    counts = Counter(wrap(g * m) >> 19 for grams, m in ((seq, 0xC2B2AE35), (two, 0x27D4EB2F), (three, 0x165667B1)) for g in grams)
    out = np.zeros(langid.BUCKETS)
    for k, n in counts.items():
        out[k] = math.sqrt(n)
    return out / np.linalg.norm(out)


@pytest.mark.parametrize("text", ["The cat sat.", "ÉTÉ à la  mer!!", "ǅ ß 𝄞 İstanbul", "a", "  x1y2  ", "日本語 text"])
def test_vector_equals_a_plain_count(text):
    assert np.allclose(langid.vector(text), plain_vector(text), atol=1e-6)


def test_machine_comes_to_the_best_of_a_dense_solver(monkeypatch):
    rng = np.random.default_rng(5)
    d, n = 40, 80
    x = rng.standard_normal((n, d))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.4 * rng.standard_normal(n) > 0, 1.0, -1.0)
    rows = [(np.arange(d), r.astype(np.float32) / np.linalg.norm(r)) for r in x]
    dense = np.stack([np.append(v, 1.0) for _, v in rows])

    def objective(v):
        return 0.5 * v @ v + langid.C * np.maximum(0, 1 - y * (dense @ v)).sum()

    # Projected gradient on the dual, many small steps.
    q = (dense * y[:, None]) @ (dense * y[:, None]).T
    alpha = np.zeros(n)
    for _ in range(60_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, langid.C)
    best = (alpha * y) @ dense
    of = lambda w: np.append(w[:d], w[-1]).astype(float)
    usual = of(langid.svm(rows, y))  # a few passes: the same side of the plane for nearly all rows
    assert (np.sign(dense @ usual) == np.sign(dense @ best)).mean() >= 0.95
    monkeypatch.setattr(langid, "PASSES", 600)
    assert objective(best) * 0.999 <= objective(of(langid.svm(rows, y))) <= objective(best) * 1.02


def test_votes_equal_a_loop_and_ties_go_to_the_first_name():
    rng = np.random.default_rng(2)
    langs = ["aa", "bb", "cc", "dd"]
    pairs = list(combinations(range(4), 2))
    w = rng.standard_normal((6, langid.BUCKETS + 1)).astype(np.float32)
    model = langid.Model({"f": langs, "g": ["zz"]}, np.zeros((2, langid.BUCKETS + 1), np.float32), {"f": (pairs, w)})
    for text in ("alpha beta", "gamma", "delta epsilon zeta", "x"):
        v, votes = langid.vector(text), Counter()
        for (a, b), m in zip(pairs, w):
            s = 1 / (1 + math.exp(-2 * (float(m[:-1] @ v) + float(m[-1]))))
            votes[a] += (s >= 0.5) + 1e-3 * s
            votes[b] += (s < 0.5) + 1e-3 * (1 - s)
        assert model.predict(text)[0] == langs[max(range(4), key=lambda i: (votes[i], -i))]  # families tie: the first by name
    still = langid.Model({"f": langs}, np.zeros((1, langid.BUCKETS + 1), np.float32), {"f": (pairs, np.zeros_like(w))})
    assert still.predict("anything")[0] == "aa"


def test_held_out_accuracy_of_the_given_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.digest(docs).filter("held_out").collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.filter("lang is not null").collect()}
    pairs = Counter((truth[i], p) for i, p in got.items() if i in truth)
    family = lambda x: langid.FAMILY.get(x, x)
    within = {(a, b): n for (a, b), n in pairs.items() if a != b and family(a) == family(b)}
    right = sum(n for (a, b), n in pairs.items() if a == b)
    print("held out", sum(pairs.values()), "right", right, "confused within a family", within)
    assert right >= 0.97 * sum(pairs.values()) and sum(within.values()) <= 0.02 * sum(pairs.values())


def test_tree_gives_every_group_its_quotas_and_every_shard_its_share():
    quotas = {b: (b * 37) % 11 for b in range(mixing.BUCKETS)}
    dealt = mixing.group_shards(quotas, 9, seed=3)
    total = sum(quotas.values())
    assert dealt.sum(axis=1).tolist() == [quotas[b] for b in range(mixing.BUCKETS)]
    assert dealt.sum(axis=0).tolist() == mixing.capacities(total, 9).tolist() and max(dealt.sum(axis=0)) - min(dealt.sum(axis=0)) <= 1


def test_tree_draws_as_one_multivariate_hypergeometric_draw_does():
    """The first shard's share of the first source over many seeds, by chi-square against its distribution."""
    quotas, shards, n = np.array([5, 3, 4]), mixing.capacities(12, 3), 6000
    seen = Counter()
    for seed in range(n):
        first = {int(i): int(k) for shard, at, k_ in mixing.deal(quotas, shards, np.random.default_rng(seed)) if shard == 1 for i, k in zip(at, k_)}
        seen[first.get(0, 0)] += 1
    want = {k: math.comb(5, k) * math.comb(7, 4 - k) / math.comb(12, 4) * n for k in range(5)}
    assert sum((seen[k] - w) ** 2 / w for k, w in want.items()) < 18.5  # 0.999 of chi-square with 4 degrees


def test_shards_of_a_group_hold_disjoint_blocks():
    quotas = np.array([7, 0, 12])
    shards = mixing.capacities(19, 4)
    where = mixing.source_shards(quotas, shards, bucket=2, seed=1)
    assert [len(x) for x in where] == quotas.tolist()  # one shard for each draw
    assert np.bincount(np.concatenate(where), minlength=4).tolist() == shards.tolist()


def test_a_source_without_words_and_one_block(spark):
    docs = spark.createDataFrame([(i, "", "empty") for i in range(5)] + [(9, None, None), (10, "a b c", "full")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["size"], r["source_size"], r["taken"]) for r in mixing.digest(docs).collect()}
    assert all(got[i] == (0, 0, 0) for i in (0, 1, 2, 3, 4, 9)) and got[10][:2] == (3, 3) and got[10][2] <= 6
    assert mixing.mix(docs.filter("source = 'empty'")).count() >= 0


def test_repeated_secrets_without_an_id(spark):
    text = 'token = "abcdefabcdef1234" and token = "abcdefabcdef1234"'
    rows = [tuple(r) for r in secrets.digest(spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string")).collect()]
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0][1] == 2
