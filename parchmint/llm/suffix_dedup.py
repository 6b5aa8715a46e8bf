"""Suffix-array dedup: removes every byte of a string of SPAN bytes that also starts elsewhere.

1. Rows with equal texts become one node. If such a text has a copy and at least SPAN bytes, all of
   it is repeated.
2. In each window of SPAN bytes the KGRAM bytes with the least hash are its anchor: equal windows
   have equal anchors at equal places. Only anchors that occur twice can lie in repeated windows.
3. The text around such anchors is dealt out by anchor, so equal windows meet in one task. A context
   that a task has already sent twice is not sent again: all of its windows are known to repeat.
   Contexts of an anchor that stands in more than HOT places are dealt out window by window instead,
   by a 128-bit digest of the SPAN bytes, and compared with their neighbours in the sorted stream:
   no task ever holds all contexts of an anchor.
4. A task sorts the suffixes of a block of contexts in two stages: those smaller than their
   successors are sorted directly, the others are induced by scans over the buckets of first
   bytes. Windows whose common prefix with their neighbour has SPAN bytes repeat.
5. The repeated windows of each text are merged to runs and cut out.

Text is handled as UTF-8 bytes; null is the empty text. Texts under SPAN bytes are never cut.
Repeated rows are copies of each other, whatever their ids. Matches never cross texts. Empty table:
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import Marks, batch_of, chunks, column, texts
from parchmint.session import held as keep
from parchmint.session import materialize

#: Bytes of a repeated string (by contract), bytes of an anchor.
SPAN, KGRAM = 200, 32
#: Bytes that are hashed at once, context bytes that are sorted at once.
PIECE, BLOCK_BYTES = 1 << 17, 3 << 20
#: Digests of sent contexts that a task remembers.
REMEMBERED = 400_000
#: Places of an anchor up to which its contexts are sorted in one block.
HOT = 4_096

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


# --- anchors ------------------------------------------------------------------------------------


def _hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the KGRAM bytes from each position on."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    for m in _MIX:
        left = h[:-width] * m
        left += h[width:]
        h, width = left, width * 2
    assert width == KGRAM
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    h ^= h >> np.uint64(32)
    return h


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor hash) of runs of windows with one anchor.

    ``data`` holds texts one after another, which end at ``ends``.
    """
    first, count, anchor = [], [], []
    lengths = np.diff(np.concatenate([[0], ends]))
    w = SPAN - KGRAM + 1
    room = np.ones(len(data), bool)  # whether SPAN bytes of the text follow
    for end, length in zip(ends.tolist(), lengths.tolist()):
        room[max(end - SPAN + 1, end - length) : end] = False
    for lo in range(0, len(data), PIECE):
        part = data[lo : lo + PIECE + SPAN - 1]
        n = len(part) - SPAN + 1
        if n <= 0:
            break
        h = _hashes(part)
        packed = h & ~np.uint64((1 << 28) - 1)
        packed |= np.arange(len(h), dtype=np.uint64)
        rows = -(-len(packed) // w)
        grid = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
        grid[: len(packed)] = packed
        grid = grid.reshape(rows, w)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(after[:n], before[w - 1 : w - 1 + n]) & np.uint64((1 << 28) - 1)).astype(np.int64)
        v = np.flatnonzero(room[lo : lo + n])
        if not len(v):
            continue
        p = place[v]
        cut = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (v[1:] != v[:-1] + 1)]))
        first.append(v[cut] + lo)
        count.append(np.diff(np.append(cut, len(v))))
        anchor.append(h[p[cut]])
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(first), np.concatenate(count), np.concatenate(anchor)


def text_runs(values: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``runs`` of each text, starts counted from its own first byte."""
    ends = np.cumsum([len(v) for v in values]).astype(np.int64) if values else np.zeros(0, np.int64)
    s, n, a = runs(np.frombuffer(b"".join(values), np.uint8), ends)
    cuts = np.searchsorted(s, np.concatenate([[0], ends]))
    return [(s[i:j] - (int(ends[k - 1]) if k else 0), n[i:j], a[i:j]) for k, (i, j) in enumerate(zip(cuts, cuts[1:]))]


# --- two-stage suffix sorting -------------------------------------------------------------------


def suffix_array(contexts: list[bytes], owned: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted owned positions, context starts, text): suffixes of contexts to a depth of SPAN bytes.

    Context k stands at its start and is followed by a 0; bytes count from 1. Its first ``owned[k]``
    positions are wanted. Besides them only those are sorted from which they are induced.
    """
    size = np.array([len(c) for c in contexts], np.int64) + 1
    starts = np.cumsum(size) - size
    data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    text = data.astype(np.int16) + 1
    text[starts + size - 1] = 0
    # B: smaller than its successor. Equal bytes take the type of the next position.
    step = np.sign(np.diff(text, append=np.int16(0))).astype(np.int8)
    at = np.where(step != 0, np.arange(len(text)), len(text))
    at = np.minimum.accumulate(at[::-1])[::-1]
    is_b = np.append(step, np.int8(-1))[at] > 0
    stop = np.where(is_b | (text == 0), np.arange(len(text)), len(text))
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    last = stop[starts + np.array(owned) - 1]  # up to here positions are needed
    need = np.zeros(len(text) + 1, np.int32)
    np.add.at(need, starts, 1)
    np.add.at(need, last + 1, -1)
    need = np.cumsum(need[:-1]) > 0

    # Stage 1: sort B suffixes directly.
    b = np.flatnonzero(need & is_b)
    close = np.minimum(b + SPAN, np.repeat(starts + size - 1, size)[b])
    whole = data.tobytes()
    keys = [whole[i:j] for i, j in zip(b.tolist(), close.tolist())]
    b = b[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)] if len(b) else b
    bounds = np.searchsorted(text[b], np.arange(258))
    # Stage 2: scan buckets upwards; each scanned suffix puts its larger predecessor into that one's bucket.
    buckets: list[list[np.ndarray]] = [[] for _ in range(258)]
    ends = np.flatnonzero(need & (text == 0))
    out = []

    def induce(entries: np.ndarray, c: int) -> np.ndarray:
        """Puts predecessors in their buckets; returns those of the same bucket."""
        before = entries - 1
        before = before[(before >= 0)]
        before = before[need[before] & ~is_b[before] & (text[before] >= max(c, 1))]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        values, at = np.unique(first, return_index=True)
        same = before[:0]
        for v, part in zip(values.tolist(), np.split(before, at[1:])):
            if v == c:
                same = part
            else:
                buckets[v].append(part)
        return same

    induce(ends, 0)
    for c in range(1, 257):
        level = np.concatenate(buckets[c]) if buckets[c] else b[:0]
        while len(level):
            out.append(level)
            level = induce(level, c)
        direct = b[bounds[c] : bounds[c + 1]]
        if len(direct):
            out.append(direct)
            induce(direct, c)
    sa = np.concatenate(out) if out else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(contexts)), size)
    mine = sa - starts[owner[sa]] < np.array(owned)[owner[sa]]
    return sa[mine], starts, data


def common_prefixes(sa: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the next one, up to SPAN bytes."""
    wide = np.concatenate([data, np.zeros(SPAN + 16, np.uint8)])
    words = np.zeros(len(data) + SPAN + 8, np.uint64)
    for i in range(8):
        words |= wide[i : i + len(words)].astype(np.uint64) << np.uint64(56 - 8 * i)
    lcp = np.zeros(max(0, len(sa) - 1), np.int64)
    live = np.arange(len(lcp))
    for k in range(0, SPAN, 8):
        x = words[sa[live] + k] ^ words[sa[live + 1] + k]
        differ = np.flatnonzero(x)
        if len(differ):
            top = np.frexp((x[differ] >> np.uint64(8)).astype(np.float64))[1]  # bits up to the highest; 0 if only the last byte differs
            lcp[live[differ]] = k + np.where(top > 0, (56 - top) // 8, 7)
            live = np.delete(live, differ)
        if not len(live):
            break
    lcp[live] = SPAN
    return np.minimum(lcp, SPAN)


def repeated_starts(contexts: list[bytes], owned: list[int]) -> list[np.ndarray]:
    """For each context its owned starts whose SPAN bytes also start at another owned position."""
    sa, starts, data = suffix_array(contexts, owned)
    hit = common_prefixes(sa, data) >= SPAN
    flags = np.zeros(len(data), bool)
    flags[sa[:-1][hit]] = True
    flags[sa[1:][hit]] = True
    return [np.flatnonzero(flags[s : s + n]) for s, n in zip(starts.tolist(), owned)]


def intervals(starts: np.ndarray) -> list[tuple[int, int]]:
    """Byte runs covered by windows at ascending starts: only starts that follow on each other are joined."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1]))
    lows, highs = starts[cut], starts[np.append(cut[1:], len(starts)) - 1] + SPAN
    return list(zip(lows.tolist(), highs.tolist()))


def merged(lows: list[int], highs: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for a, b in sorted(zip(lows, highs)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


# --- Spark --------------------------------------------------------------------------------------


def _anchored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, sha256, key, anchors array<int> (upper halves, repeats kept) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("key", pa.binary()), ("anchors", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            values = [raw(t) for t in column(b, "text")]
            rows = [(i, len(v), hashlib.sha256(v).hexdigest(), xxhash.xxh3_128_digest(v), (a >> np.uint64(32)).astype(np.uint32).view(np.int32)) for i, v, (_, _, a) in zip(column(b, "doc_id"), values, text_runs(values))]
            yield batch_of(schema, rows)

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, sha256 string, key binary, anchors array<int>")


def _packed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, key, data: texts of SPAN bytes or more with their digest, compressed for the shuffle.

    Only rows whose id is among those of the written table ``wanted`` (d), or that a bitmap takes for them.
    """
    marks = Marks(wanted.select("d"), "d")
    bitmap = marks.shared
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            some = b.filter(pa.array(Marks.known(bitmap.value, b.column(2).to_numpy())))
            for part in chunks([some]):
                values = [(i, raw(t)) for i, t in zip(column(part, "doc_id"), column(part, "text"))]
                yield batch_of(schema, [(i, xxhash.xxh3_128_digest(v), pack.compress(v)) for i, v in values if len(v) >= SPAN])

    return texts(docs, marks.spot(F.col("doc_id").cast("long")).alias("spot")).mapInArrow(run, "doc_id long, key binary, data binary")


def _contexts(held: DataFrame) -> DataFrame:
    """anchor, node, start, owned, data: the text around anchors that occur twice.

    Where data is null, all owned windows are known to repeat. Where owned is 0, data is the digest of
    the one window at start, whose anchor is in ``hot``.
    """
    schema = pa.schema([("anchor", pa.int64()), ("node", pa.int64()), ("start", pa.int64()), ("owned", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        sent: dict[bytes, int] = {}

        def times(mark: bytes) -> int:
            seen = sent.get(mark, 0)
            if seen < 2:
                if len(sent) > REMEMBERED:
                    sent.clear()
                sent[mark] = seen + 1
            return seen

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                values = [unpack.decompress(d) for d in column(part, "data")]
                rows = []
                for node, v, twice, hot, (s, n, a) in zip(column(part, "node"), values, column(part, "twice"), column(part, "hot"), text_runs(values)):
                    upper = (a >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    some = np.isin(upper, np.array(twice, np.int32))
                    dense = np.isin(upper[some], np.array(hot, np.int32))
                    for start, owned, anchor, single in zip(s[some].tolist(), n[some].tolist(), a[some].view(np.int64).tolist(), dense.tolist()):
                        context = v[start : start + owned - 1 + SPAN]
                        if times(b"c" + xxhash.xxh3_128_digest(context)) >= 2:
                            rows.append((anchor, node, start, owned, None))
                        elif not single:
                            rows.append((anchor, node, start, owned, context))
                        else:
                            marks = [xxhash.xxh3_128_digest(context[k : k + SPAN]) for k in range(owned)]
                            known = np.array([times(m) >= 2 for m in marks])
                            rows += [(anchor, node, start + k, 0, marks[k]) for k in np.flatnonzero(~known).tolist()]
                            rows += [(anchor, node, start + low, high - low - SPAN + 1, None) for low, high in intervals(np.flatnonzero(known))]
                    if len(rows) > 4000:
                        yield batch_of(schema, rows)
                        rows = []
                yield batch_of(schema, rows)

    return held.mapInArrow(run, "anchor long, node long, start long, owned int, data binary")


def _sorted_blocks(dealt: DataFrame) -> DataFrame:
    """node, low, high: byte runs that repeated windows cover, from contexts grouped by anchor."""
    schema = pa.schema([("node", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        size, last = 0, None

        def flush():
            found = repeated_starts([r[3] for r in block], [r[2] for r in block]) if len(block) > 1 else []
            return [(node, start + a, start + b) for (node, start, _, _), s in zip(block, found) for a, b in intervals(s)]

        for batch in batches:
            out = []
            for anchor, node, start, owned, data in zip(*(column(batch, c) for c in ("anchor", "node", "start", "owned", "data"))):
                if anchor != last and size > BLOCK_BYTES:
                    out += flush()
                    block, size = [], 0
                block.append((node, start, owned, data))
                size, last = size + len(data), anchor
            yield batch_of(schema, out)
        yield batch_of(schema, flush())

    return dealt.mapInArrow(run, "node long, low long, high long")


def _met(windows: DataFrame) -> DataFrame:
    """node, low, high: windows whose digest a neighbour shares, from windows in the order of digests."""
    schema = pa.schema([("node", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told = (None, 0, 0), False
        for batch in batches:
            out = []
            for mark, node, start in zip(*(column(batch, c) for c in ("data", "node", "start"))):
                same = mark == last[0]
                if same and not told:
                    out.append((last[1], last[2], last[2] + SPAN))
                if same:
                    out.append((node, start, start + SPAN))
                last, told = (mark, node, start), same
            yield batch_of(schema, out)

    return windows.mapInArrow(run, "node long, low long, high long")


def _cut(held: DataFrame, spans: DataFrame) -> DataFrame:
    """node, n_removed, n_spans, kept (bytes that are left) of the nodes with repeated windows."""
    schema = pa.schema([("node", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                part = batch.slice(at, 64)
                for node, data, lows, highs in zip(*(column(part, c) for c in ("node", "data", "lows", "highs"))):
                    v = unpack.decompress(data)
                    found = merged(lows, highs)
                    kept, upto = [], 0
                    for a, b in found:
                        kept.append(v[upto:a])
                        upto = b
                    rows.append((node, sum(b - a for a, b in found), len(found), b"".join([*kept, v[upto:]])))
                yield batch_of(schema, rows)

    grouped = spans.groupBy("node").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    return held.join(grouped, "node").select("node", "data", "lows", "highs").mapInArrow(run, "node long, n_removed long, n_spans long, kept binary")


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    made = keep(_anchored(docs))
    nodes = made.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "texts")
    first = made.join(nodes.select(F.col("key").alias("k"), F.col("doc_id").alias("d"), "node", "copies"), F.col("key").eqNullSafe(F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
    # Rows that repeat id and text would count an anchor twice; their texts have copies and are cut anyway.
    places = first.filter(F.size("anchors") > 0).select("node", F.explode("anchors").alias("anchor"))
    # Written, so that the join reads two plain shuffles and Spark can split an anchor that many texts share.
    twice = materialize(places.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", (F.col("n") > HOT).alias("hot")), "twice")
    wanted = places.join(twice, "anchor").groupBy("node").agg(F.collect_set("anchor").alias("twice"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    wanted = materialize(wanted.join(nodes, "node").select("node", "twice", "hot", F.col("key").alias("k"), F.col("doc_id").alias("d"), "copies"), "wanted")
    # By id and digest: other texts may stand under the same id, or under none.
    held = _packed(docs, wanted).join(wanted, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("node", "data", "twice", "hot", "copies")
    held = materialize(held, "held")
    around = materialize(_contexts(held), "contexts")
    known = around.filter("data is null").select("node", F.col("start").alias("low"), (F.col("start") + F.col("owned") - 1 + SPAN).alias("high"))
    dealt = around.filter("data is not null and owned > 0").repartition("anchor").sortWithinPartitions("anchor")
    single = around.filter("data is not null and owned = 0").repartition("data").sortWithinPartitions("data")
    spans = _sorted_blocks(dealt).unionByName(_met(single.select("data", "node", "start"))).unionByName(known)
    # Texts with copies are removed as a whole, so only the others are cut.
    cut = _cut(held.filter("copies = 1"), spans).select("node", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    label = nodes.join(cut, "node", "left").select("key", "copies", "n_removed", "n_spans", "kept_sha256")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= SPAN)
    zero = F.lit(0).cast("long")
    found = made.select("doc_id", "n_bytes", "sha256", "key").join(label, "key").select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, zero + 1).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
    found = materialize(found, "removed")
    made.unpersist()
    return found
