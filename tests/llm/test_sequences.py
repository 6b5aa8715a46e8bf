"""Conversation repair, packing along a curve, fill-in-middle: brute force, exact round trips, hard rows."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from parchmint.llm import conversations, fim, oracles, packing, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, packed string, output string"
HARD = [
    (1, None, None, None, None, "x", 1, "s", "r"),
    (2, "", "en", "a", 0, "x", 1, "s", "r"),
    (3, " \t\n", "en", "a", 3, None, 1, None, None),
    (4, "The cat sat on the mat. \n" * 4000, "en", "a", None, "x", 1, "s", "r"),
    (5, "é ß𝄞 naïve\n\n's it's", "fr", "b", 3, "x", 1, "s", "r"),
    (5, "é ß𝄞 naïve\n\n's it's", "fr", "b", 3, "x", 1, "s", "r"),
    (None, "no id here", "en", None, 3, "x", 1, "s", "r"),
    (6, "a<P>b\nc", "en", "b", 3, "x", 1, "s", "r"),
    (7, "a\0b \0\0. <|endoftext|>", "en", "b", 3, "x", 1, "s", "r"),
]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(packing.default_vocabulary())
    t.encode_special_tokens = True
    return t


# -- fill-in-middle


def cut_plainly(text, doc_id):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    told = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(told[k : k + 8], 16) for k in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit,pattern", [("line", r"[^\n]*\n|[^\n]+"), ("word", r"^[ \t-\r]+|[^ \t-\r]+[ \t-\r]*"), ("char", r"(?s).")])
def test_checkpoints_find_every_cut(unit, pattern):
    rng = random.Random(unit)
    for _ in range(150):
        text = "".join(rng.choice(["a", "é", "𝄞", " ", "\n", "\n", "bc"]) for _ in range(rng.randrange(0, 60)))
        units = re.findall(pattern, text)
        index = fim.Checkpoints(text.encode(), unit, every=rng.randrange(1, 6), window=rng.randrange(1, 12))
        assert index.n == len(units)
        assert index.units == list(range(0, max(1, len(units)), index.every))  # one entry for every EVERY units
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert index.cut(k) == (len(before.encode()), len(before))


def test_fill_in_middle_equals_plain_cuts_and_comes_back(spark):
    docs = spark.createDataFrame(HARD, SCHEMA)
    got = fim.restore(fim.transform(docs)).collect()
    want = [(r[0], *cut_plainly(r[1] or "", r[0]), r[1] or "") for r in HARD]
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
    assert fim.digest(docs.filter("doc_id = 99")).collect() == []
    plain = fim.transform(docs, rate=0).collect()
    assert {r["form"] for r in plain} == {"plain"}
    assert fim.parts("<P" * 5 + "\n<S\n<M", 4)[4].count("<P>") == 1


# -- packing


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = packing.hilbert(cells, bits)
    assert sorted(keys) == list(range(1 << dimensions * bits))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_encoder_equals_the_library(tokenizer):
    rng = random.Random(3)
    parts = ["a", "B", "é", "7", "½", " ", " ", "\n", "\t", "'", "'", "s", "t", "re", "ve", "ll", "d", "m", "　", "𝄞", "一", ".", "_", "\x1c", "\x85", "<|endoftext|>", "\0", "́", "ſ", "Ⅷ", "\r"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(4000)]
    got = packing.Encoder(packing.default_vocabulary()).encode(texts)
    assert [x.tolist() for x in got] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_every_code_point_is_cut_as_the_library_cuts_it(tokenizer):
    texts = [f"a{chr(i)}a" for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    counts = packing.pre_tokens(texts)[1]
    assert [t for t, n in zip(texts, counts.tolist()) if n != len(tokenizer.pre_tokenizer.pre_tokenize_str(t))] == []


def whole(pieces, docs, tokenizer, length=1024):
    """Every id in one piece, sequences gapless, of ``length`` or a power of two."""
    want = sorted((str(r[0]), *(tokenizer.encode(r[1] or "", add_special_tokens=False).ids), 0) for r in docs)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert p["length"] == len(p["ids"]) > 0
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], p["ids"]))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0
    ids = sorted(str(d) for d, *_ in want)
    assert sorted(x for (d, n), parts in by_doc.items() for x in [str(d)] * (sum(len(i) for _, i in parts) // n)) == ids
    for (d, n), parts in by_doc.items():
        copies = sum(len(i) for _, i in parts) // n
        ends = sorted((s, s + len(i)) for s, i in parts)
        assert sum(a == 0 for a, _ in ends) == sum(b == n for _, b in ends) == copies
        texts = [w[1:] for w in want if w[0] == str(d)]
        for s, i in parts:
            assert any(tuple(i) == t[s : s + len(i)] for t in texts if len(t) == n)


def test_packing_keeps_every_id(spark, tokenizer):
    docs = spark.createDataFrame(HARD, SCHEMA)
    whole(packing.pack(docs).collect(), HARD, tokenizer)
    whole(packing.pack(docs, length=7).collect(), HARD, tokenizer, 7)
    assert packing.pack(docs.filter("doc_id = 99")).collect() == []
    want = [(*tuple(p)[:6], zlib.crc32(np.array(p["ids"], "<u4").tobytes())) for p in packing.pack(docs).collect()]
    assert sorted(map(repr, map(tuple, packing.digest(docs).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("total", [0, 1, 5, 1024, 1025, 3000])
def test_packer_cuts_the_rest_at_powers_of_two(total):
    packer, out, at = packing.Packer(1024), [], 0
    for n in [total // 3, total - total // 3]:
        out += list(packer.add(at, np.arange(at, at + n)))
        at += n
    out += list(packer.end())
    assert np.concatenate([p[2] for p in out] or [np.zeros(0)]).tolist() == list(range(total))
    sizes = [sum(len(p[2]) for p in g) for _, g in itertools.groupby(out, key=lambda p: p[3])]
    assert all(s == 1024 or s & (s - 1) == 0 for s in sizes) and sum(s == 1024 for s in sizes) == total // 1024


def test_neighbours_on_the_curve_are_alike(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("text is not null and lang is not null")
    langs = dict(docs.select("doc_id", "lang").collect())
    order = [r["doc_id"] for r in packing.placed(docs).orderBy("key", "doc_id").collect()]
    same = np.mean([langs[a] == langs[b] for a, b in zip(order, order[1:])])
    shares = np.unique(list(langs.values()), return_counts=True)[1] / len(langs)
    assert same > 1.6 * (shares**2).sum()


def test_copies_are_dealt_over_ranges(spark):
    docs = spark.range(600).selectExpr("id as doc_id", "'the same text again and again' as text")
    assert len({p["sequence_id"] >> 40 for p in packing.pack(docs).collect()}) > 2


# -- conversations


def cheapest(roles, found):
    """Least (cost, audit) by trying every edit, without codes and ranks."""

    @functools.cache
    def go(i, s, run):
        out = [(0, "")] if i == len(roles) and s in (0, 3) else []
        if run < 3:
            out += [(5 + c, "I" + a) for x in "ua" if (s, x) in conversations.NEXT for c, a in [go(i, conversations.NEXT[s, x], run + 1)]]
        if i < len(roles):
            moves = [(2, "D", s)]
            if found[i] not in ("blank", "duplicate"):
                more = 5 if found[i] == "truncated" else 0
                moves += [(more, "K", conversations.NEXT[s, roles[i][:1]])] if (s, roles[i][:1]) in conversations.NEXT else []
                moves += [(more + 1, "R", conversations.NEXT[s, x]) for x in "ua" if (s, x) in conversations.NEXT]
            out += [(cost + c, e + a) for cost, e, t in moves for c, a in [go(i + 1, t, 0)]]
        return min(out, default=(1 << 40, ""))

    return go(0, 0, 0)


def test_codes_are_prefix_free_and_edits_are_cheapest():
    codes = {m[2] for moves in conversations.MACROS.values() for p in moves for m in p}
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)
    rng = random.Random(5)
    for _ in range(3000):
        n = rng.randrange(0, 9)
        roles = [rng.choice(["system", "user", "assistant", "tool", "", " "]) for _ in range(n)]
        found = [rng.choice([None, None, None, "blank", "duplicate", "truncated"]) for _ in range(n)]
        turns = conversations.kinds(roles, found)
        edits, leave, cost = conversations.codes(turns, 0, None)
        tail = conversations.TAIL[leave]
        audit, new, _ = conversations.rebuilt(roles, ["x"] * n, edits, 0, tail)
        assert (cost + 5 * tail, audit) == cheapest(tuple(roles), tuple(found))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r in new))
        cuts = sorted(rng.randrange(0, n + 1) for _ in range(3))
        parts = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
        states = conversations.between([conversations.summary(p) for p in parts], 0, None)
        assert [e for p, a, b in zip(parts, states, states[1:]) for e in conversations.codes(p, a, b)[0]] == edits


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how:
            role, text = "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            out += [(conv, turn, role, text)] * (2 if how == 3 else 1)
    return out


def plainly(rows):
    """The contract's row of each conversation, by the plain search."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        roles, texts = [r[2] for r in mine], [r[3] for r in mine]
        found = [
            "blank" if not re.search(r"[^\x20\x09-\x0D]", t) else "duplicate" if (r, t) in set(zip(roles[:i], texts[:i])) else None if re.sub(r"[\x20\x09-\x0D]+\Z", "", t)[-1] in ".!?" else "truncated"
            for i, (r, t) in enumerate(zip(roles, texts))
        ]
        cost, audit = cheapest(tuple(roles), tuple(found))
        new, i = [], 0
        for e in audit:
            role = "user" if not new or new[-1][0][:1] in "sa" else "assistant"
            if e == "I":
                new.append((role, ""))
                continue
            if e != "D":
                new.append((roles[i] if e == "K" else role, texts[i]))
            i += 1
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        told = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in new).encode()).hexdigest()
        out[conv] = (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, told)
    return out


def made(seed, conversations_, long):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations_):
        for turn in range(long if conv == 1 else rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn, None, 2 * turn]), rng.choice(["system", "user", "assistant", "assistant", "user", None, "", "tool"]), rng.choice(["Yes.", "No", "", " \t", None, "What?\n", f"Text {rng.random()}.", f"Text {rng.random()}!"])))
    return rows + rows[:3] + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hello."), (77, None, None, None), (78, 5, "user", "Gone?")]


@pytest.mark.parametrize("chunk", [512, 3])
def test_repair_equals_brute_force_within_and_across_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK_ROWS", chunk)
    rows = made(chunk, 30, 150)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "'x' as chunk", "2 as cost").repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.digest(table).collect()}
    assert got == plainly(rows)
    assert conversations.digest(table.filter("conv_id = -1")).collect() == []


def test_repaired_turns_alternate(spark):
    rows = spark.createDataFrame([(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "assistant", "C.")], "conv_id long, turn long, role string, text string")
    out = conversations.repaired_turns(conversations.repair(rows)).orderBy("chunk", "i").collect()
    assert [(r["role"], r["text"]) for r in out] == [("user", "B."), ("assistant", "C.")]
    assert conversations.repair(rows).first()["audit"] == "DKK"


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_fill_in_middle"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    cur = con.execute(oracles.SQL[name])
    names = [c[0] for c in cur.description]
    df = queries.queries()[name](spark, DATA)
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(map(repr, cur.fetchall()))
