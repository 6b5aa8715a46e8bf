"""N-gram Jaccard join by T-occurrence search (DivideSkip), and the classes that its links make.

A text is the set of its 5-word shingles (64-bit hashes); two sets link at Jaccard 0.8 or more.

1. Rows with equal sets become one node.
2. Of each set only a prefix is indexed: the |x| - ceil(0.8 |x|) + 1 first shingles in a global
   order. Linked sets share one. The order is by hash, except that shingles found often in a
   sample of texts come last; it bears on speed alone, any order gives the same links.
3. The nodes of an inverted list are searched for the list's first node, then, for nodes that are
   not yet connected with each other, for all others. Nodes that are known to be connected need
   no search, which keeps large groups of near copies from being compared in pairs.
4. Sets that are to be found are dealt to index blocks. Each block's inverted lists are made once and
   searched for every query that expects something there: short lists are merged by a heap, the
   longest are only probed, and all sets of the block that reach the required overlap
   T = ceil(0.8 / 1.8 (|x| + |y|)) link.
5. Links are joined to classes by alternating star steps.

Texts are shuffled only for nodes that a search needs: a bitmap of their ids picks the rows that are
packed, before the join decides.

Null or empty text or text without words: no shingles, linked with nothing, a class of its own.
Repeated rows: one node. Repeated ids with different texts: nodes of their own under that id. Null
ids are ids like others; a class of null ids only has none. Empty table: empty result. Other columns
are ignored by ``classes`` and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.llm.common import Marks, batch_of, chunks, column, quoted, released, texts
from parchmint.operators.graph import connected_components
from parchmint.session import held, materialize

SHINGLE = 5
#: Similarity of 0.8 as a fraction, so that thresholds are exact.
NUM, DEN = 4, 5
#: Share of texts whose shingles are counted for the order, count from which a shingle comes
#: last, and the most shingles that do so (a broadcast of at most 8 bytes each).
SAMPLE, OFTEN, MAX_FREQUENT = 1 / 32, 2, 500_000
#: Shingles of the sets that an index block holds on average, and at which it is searched in parts;
#: clashes of half hashes that are allowed for, first queries of a long list.
BLOCK_SHINGLES, INDEX_SHINGLES = 30_000, 1_000_000
SLACK, HEADS = 2, 4
#: Nodes of a block whose connections a task remembers.
CONNECTED = 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of words; bounded by emptying, and emptied at the end of a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str | bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    words = data.translate(_LOWER).split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    out = h[:n].copy()
    for i in range(1, SHINGLE):
        out *= _PRIME
        out += h[i : i + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def prefix(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The indexed shingles of a set, rare and frequent ones: the upper halves of its first hashes in the global order.

    The third value tells where in the order they end.
    """
    n = len(tokens)
    last = np.zeros(n, bool)
    if len(frequent) and n:
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        last = frequent[at] == tokens
    half = (tokens >> np.uint64(32)).astype(np.uint32).view(np.int32)
    rare, often, size = half[~last], half[last], n - (-(-n * NUM // DEN)) + 1 if n else 0
    rare, often = rare[:size], often[: max(0, size - len(rare))]
    end = (1 << 32) + int(often[-1:].view(np.uint32)[0]) if len(often) else int(rare[-1:].view(np.uint32)[0]) if len(rare) else 0
    return rare, often, end


def sketch(tokens: np.ndarray) -> list[int]:
    """256 parities of a set's hashes; two sets differ in at least as many shingles as their sketches in bits."""
    odd = (np.bincount((tokens & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def required(x: int, y: int) -> int:
    """Least overlap at which sets of these sizes link."""
    return -(-NUM * (x + y) // (NUM + DEN))


class Index:
    """Inverted lists over the sets of candidates."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        self.keys, self.starts = np.unique(tokens, return_index=True)
        self.ends = np.append(self.starts[1:], len(tokens))

    def search(self, query: np.ndarray) -> list[int]:
        """Candidates that link with the query, by DivideSkip."""
        if not len(self.keys) or not len(query):
            return []
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        need = [required(len(query), n) for n in self.sizes]
        least = min(need)
        if len(at) < least:
            return []
        at = at[np.argsort(self.ends[at] - self.starts[at], kind="stable")]
        lists = [self.owner[a:b].tolist() for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())]
        skip = least - 1  # a candidate of ``least`` lists stands in one of the others
        short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
        found = []
        merged = heapq.merge(*short)
        current, count = -1, 0
        for c in (*merged, -1):
            if c == current:
                count += 1
                continue
            if current >= 0:
                left = len(long)
                for ids in reversed(long):
                    if count + left < need[current]:
                        break
                    i = bisect_left(ids, current)
                    count += i < len(ids) and ids[i] == current
                    left -= 1
                if count >= need[current]:
                    found.append(current)
            current, count = c, 1
        return found


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes that a sample of texts holds often; at most MAX_FREQUENT."""
    sample = texts(docs).filter(F.pmod(F.xxhash64(F.lit("order"), F.col("doc_id")), F.lit(1_000_000)) < int(SAMPLE * 1_000_000))
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, limit=4 << 20):
            sets = [shingles(t) for t in column(b, "text")]
            tokens, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    often = sample.mapInArrow(released(count, _WORDS.clear), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    kept = often.orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).select("token").toArrow()
    return np.sort(kept.column("token").to_numpy().view(np.uint64))


def indexed(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, key (hash of the whole set; null if empty), rare and often array<int> (the prefix), end, sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("rare", pa.list_(pa.int32())), ("often", pa.list_(pa.int32())), ("end", pa.int64()), ("sketch", pa.list_(pa.int64()))])
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            sets = [shingles(t) for t in column(b, "text")]
            rows = [(i, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, *prefix(s, shared.value), sketch(s)) for i, s in zip(column(b, "doc_id"), sets)]
            yield batch_of(schema, rows)

    return texts(docs).mapInArrow(released(run, _WORDS.clear), "doc_id long, n_shingles long, key binary, rare array<int>, often array<int>, end long, sketch array<long>")


def _searched(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: links that connect whatever the pairs that link connect; ``a`` is searched in the index blocks that hold its ``b``.

    Of the links within a block only those are told that connect what others there have not yet
    connected, so a block of near copies gives no more links than sets.
    """
    facts = nodes.select("node", F.col("doc_id").alias("d"), "key", "n")
    found = pairs.select(F.col("b").alias("node")).distinct().join(facts, "node")
    size = found.agg(F.sum("n")).first()[0] or 0
    block_of = lambda c: F.pmod(F.xxhash64(c), F.lit(size // BLOCK_SHINGLES + 1)).cast("int")
    queries = pairs.select(F.col("a"), block_of("b").alias("block")).distinct().select(F.col("a").alias("node"), "block", F.lit(True).alias("asks")).join(facts, "node")
    wanted = found.select("node", block_of("node").alias("block"), F.lit(False).alias("asks"), "d", "key").unionByName(queries.drop("n"))
    rows = _texts_of(docs, materialize(wanted, "wanted"), ["block", "asks", "node"])
    rows = rows.repartition("block").sortWithinPartitions("block", "asks", "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, held, parts, size, parent = None, [], [], [], 0, {}

        def root(a: int) -> int:
            while (up := parent.setdefault(a, a)) != a:
                parent[a] = a = parent.setdefault(up, up)
            return a

        def fresh(a: int, b: int) -> bool:
            """Whether a link connects two parts; a memory that is emptied only repeats links."""
            if len(parent) > CONNECTED:
                parent.clear()
            x, y = root(a), root(b)
            parent[x] = y
            return x != y

        def close() -> None:
            """One more index of the block, from the sets that have been gathered."""
            nonlocal ids, held, size
            if held:
                parts.append((Index(held), ids))
            ids, held, size = [], [], 0

        unpack = zstandard.ZstdDecompressor()
        for batch in chunks(batches, "data"):
            out = []
            last = None
            for block, asks, node, data in zip(*(column(batch, c) for c in ("block", "asks", "node", "data"))):
                if block != group:
                    close()
                    group, parts = block, []
                    parent.clear()
                if (asks, node) == last:  # a repeated row
                    continue
                last = (asks, node)
                tokens = shingles(unpack.decompress(data))
                if asks:
                    close()
                    out += [(node, at[i]) for index, at in parts for i in index.search(tokens) if fresh(node, at[i])]
                else:
                    ids.append(node)
                    held.append(tokens)
                    size += len(tokens)
                    if size > INDEX_SHINGLES:
                        close()
            yield batch_of(schema, out)

    return rows.mapInArrow(released(run, _WORDS.clear), "a long, b long")


def _repeated(nodes: DataFrame) -> DataFrame:
    """id, node, p, n, e: a row for each rare shingle of a prefix that others hold too (twice its upper half).

    Only these halves are shuffled, to count them; a bitmap of those found twice then picks the
    rows where the prefixes lie. It may let a few single ones pass, which meet nobody.
    """
    tokens = nodes.select(F.explode("rare").alias("token")).groupBy("token").agg(F.count("*").alias("size")).filter("size > 1")
    marks = Marks(materialize(tokens.select("token"), "tokens"), "token", hashed=True)
    bitmap, bits = marks.shared, marks.bits
    schema = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("p", pa.int32()), ("n", pa.int64()), ("e", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            token = lists.flatten().to_numpy().astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            of = np.repeat(np.arange(b.num_rows), sizes)
            place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.flatnonzero(Marks.known(bitmap.value, (token & (bits - 1)) + 1))
            node, n, e = (pa.array(b.column(i).to_numpy()[of[at]]) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(token[at] * 2), node, pa.array(place[at].astype(np.int32)), n, e], schema=schema)

    return nodes.select("node", "n", F.col("end").alias("e"), "rare").mapInArrow(released(run), "id long, node long, p int, n long, e long")


def solved(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, key of all rows; nodes with key, doc_id and c: a node of their class that all of it shares).

    What straight scans make is kept on the executors' disks while it is needed and made again where
    it is lost; nodes with their prefixes and all links are written to the shared folder.
    """
    made = held(indexed(docs, frequent_shingles(docs)))
    # Rows of one key have the same set, and so the same prefix.
    sets = made.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n_shingles", "end", "sketch", "rare", "often")))
    nodes = materialize(sets.withColumnRenamed("n_shingles", "n").withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = materialize(made.select("doc_id", "n_shingles", "key"), "rows")
    made.unpersist()
    # id, node, p (its place in the node's order), n (shingles), e (where the node's prefix ends), s (sketch; frequent only).
    # Lists of rare shingles have even ids. Those of frequent ones may hold any share of all nodes, and are
    # therefore never gathered: they stay rows that share an id.
    rare = _repeated(nodes).withColumn("s", F.lit(None).cast("array<long>"))
    often = nodes.select(F.size("rare").alias("p0"), F.posexplode(F.transform("often", lambda t: t.cast("long") * 2 + 1)).alias("p", "id"), "node").select("id", "node", (F.col("p") + F.col("p0")).alias("p")).distinct()
    shared = often.groupBy("id").agg(F.count("*").alias("size")).filter("size > 1").select("id")
    facts = nodes.select("node", "n", F.col("end").alias("e"), F.col("sketch").alias("s"))
    lists = held(rare.unionByName(often.join(shared, "id").join(facts, "node")))

    # Round 1: a few nodes of each list against those that share most of their lists with them. Lists
    # of frequent shingles (odd ids) have HEADS such nodes, the first of each residue, others one.
    firsts = [F.min(F.when(F.pmod(F.xxhash64("node"), F.lit(HEADS)) == j, F.struct("node", "n", "e", "p", "s"))) for j in range(HEADS)]
    several = lists.filter("id % 2 != 0").groupBy("id").agg(F.array_compact(F.array(*firsts)).alias("h")).select("id", F.inline("h"))
    short = lists.filter("id % 2 = 0 and id is not null and node is not null").drop("s").repartition("id")  # dealt once for both sides
    one = short.groupBy("id").agg(F.min(F.struct("node", "n", "e", "p")).alias("h"), F.count("*").alias("size")).filter("size > 1").select("id", "h.*", F.lit(None).cast("array<long>").alias("s"))
    star = lambda heads, rows: heads.alias("x").join(rows.alias("y"), (F.col("x.id") == F.col("y.id")) & (F.col("x.node") != F.col("y.node")) & _possible())
    stars = materialize(_likely(star(several, lists.filter("id % 2 != 0")), star(one, short.withColumn("s", F.lit(None).cast("array<long>"))), weight=2), "stars1")
    links = materialize(_searched(stars, docs, nodes), "links1")

    # Round 2: nodes of one list that are not connected yet.
    known = connected_components(links)
    labelled = materialize(lists.join(known, "node", "left").select("id", "n", "node", "e", "p", "s", F.coalesce("component", "node").alias("c")), "labelled")
    lists.unpersist()
    rest = materialize(_crossing(labelled).join(stars, ["a", "b"], "left_anti"), "pairs2")
    more = materialize(_searched(rest, docs, nodes), "links2")
    whole = connected_components(links.unionByName(more))
    return rows, materialize(nodes.join(whole, "node", "left").select("key", "doc_id", F.coalesce("component", "node").alias("c")), "classes")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    read, nodes = solved(docs)
    roots = nodes.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    label = nodes.join(roots, "c").select("key", "component_id")
    rows = read.join(label, "key", "left").select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return materialize(rows, "members")


def _mark(key: Column) -> Column:
    """56 bits of a set's key as a number."""
    return F.conv(F.hex(F.substring(key, 1, 7)), 16, 10).cast("long")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the one with the smallest id stays.

    Of rows that repeat it one stays. Rows without shingles are classes of their own and all stay.
    Only rows whose set stands in several rows or in a class of several sets pass through a join; a
    bitmap of these sets tells them from all others, which stay where they are.
    """
    read, nodes = solved(docs)
    kept = nodes.groupBy("c").agg(F.min(F.struct("doc_id", "key")).alias("k"), F.count("*").alias("sets")).select(F.col("k.doc_id").alias("__d"), F.col("k.key").alias("__k"), "c", "sets")
    several = nodes.join(kept.filter("sets > 1").select("c"), "c", "left_semi").select("key")
    repeated = read.filter("key is not null").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    suspects = materialize(several.unionByName(repeated).distinct().select(_mark(F.col("key")).alias("mark")), "suspects")
    marks = Marks(suspects, "mark", hashed=True)
    bitmap, bits = marks.shared, marks.bits

    def keys(columns):
        for col in columns:
            found = [xxhash.xxh3_128_digest(s.tobytes()) if len(s := shingles(t)) else None for t in col]
            at = np.array([int.from_bytes(k[:7], "big") % bits if k else 0 for k in found], np.int64)
            yield pd.DataFrame({"key": found, "suspect": Marks.known(bitmap.value, at + 1)})
        _WORDS.clear()

    key = F.pandas_udf(keys, "key binary, suspect boolean", F.PandasUDFType.SCALAR_ITER)
    rows = docs.select(F.struct(*quoted(docs)).alias("row"), F.col("doc_id").cast("long").alias("id"), key(F.col("text").cast("string")).alias("k"))
    # Keys are made once for each side: holding the rows would cost more disk than that costs time.
    rows = rows.select("row", "id", "k.key", "k.suspect")
    same = rows.filter("key is not null and suspect").join(kept.select("__d", "__k"), F.col("id").eqNullSafe(F.col("__d")) & (F.col("key") == F.col("__k")))
    # Rows that repeat id and set: any of them may stay; which one does not follow from anything, so the first by content.
    one = same.withColumn("n", F.row_number().over(Window.partitionBy("id", "key").orderBy(F.xxhash64("row")))).filter("n = 1")
    return one.select("row.*").unionByName(rows.filter("key is null or not suspect").select("row.*"))


def _crossing(labelled: DataFrame) -> DataFrame:
    """a, b: nodes of one list that are in different classes c and that could link.

    Each list's largest class is only met by the nodes of its other classes. A pair is found in
    every list that holds both of its nodes.
    """
    sizes = labelled.groupBy("id", "c").agg(F.count("*").alias("size"))
    main = sizes.groupBy("id").agg(F.max(F.struct("size", "c")).alias("m"), F.count("*").alias("kinds")).filter("kinds > 1").select("id", F.col("m.c").alias("main"))
    open_ = labelled.join(main, "id")
    x, y = open_.filter("c != main").alias("x"), open_.alias("y")
    once = (F.col("y.c") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    return _likely(x.join(y, (F.col("x.id") == F.col("y.id")) & (F.col("x.c") != F.col("y.c")) & once & _possible()))


def _up(x: Column, num: int, den: int) -> Column:
    """Whole numbers times a fraction, rounded up."""
    return F.ceil(x * num / den - 1e-9)


def _possible() -> Column:
    """Whether x and y, which share a shingle at their places p, may link.

    Their sizes must allow it, and so must what stands before the shared one in both, together with
    what stands from it on; and their sketches must not differ more than sets that link. Rows that fail belong to pairs that don't link, whose other rows don't
    count.
    """
    most = F.least("x.p", "y.p") + F.least(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p"))
    differ = sum((F.bit_count(F.col("x.s")[i].bitwiseXOR(F.col("y.s")[i])) for i in range(4)), F.lit(0))
    alike = F.coalesce((NUM + DEN) * differ <= (DEN - NUM) * (F.col("x.n") + F.col("y.n")), F.lit(True))
    return (NUM * F.greatest("x.n", "y.n") <= DEN * F.least("x.n", "y.n")) & alike & (most >= _up(F.col("x.n") + F.col("y.n"), NUM, NUM + DEN))


def _likely(*pairs: DataFrame, weight: int = 1) -> DataFrame:
    """a, b of the pairs x, y (one row for each shared list) whose sizes and numbers of lists let them link.

    Shingles up to the end of the prefix that ends first are shared in both prefixes, and so in
    lists; beyond it that set has only so many left. Two shingles of one prefix may share their
    upper half; SLACK stands for more such clashes than texts have. ``weight`` is what a shared list
    counts, where the rows don't hold all lists of a pair.
    """
    first = F.col("x.node") < F.col("y.node")
    side = lambda c, one: F.when(first == one, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
    counted = reduce(DataFrame.unionByName, (some.select(*(side(c, one).alias(f"{c}{int(one)}") for c in ("node", "n", "e") for one in (True, False))) for some in pairs))
    counted = counted.groupBy(*counted.columns).agg(F.count("*").alias("lists"))
    need = _up(F.col("n1") + F.col("n0"), NUM, NUM + DEN)
    left = F.when(F.col("e1") < F.col("e0"), F.col("n1")).when(F.col("e1") > F.col("e0"), F.col("n0")).otherwise(F.greatest("n1", "n0"))
    return counted.filter(weight * F.col("lists") + SLACK + _up(left, NUM, DEN) - 1 >= need).select(F.col("node1").alias("a"), F.col("node0").alias("b"))


def _texts_of(docs: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """columns of the wanted rows (d, key: a row's id and set; a written table) with data, its compressed text.

    Ids may repeat with other texts, which are left out.
    """
    packed_schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("data", pa.binary())])
    marks = Marks(wanted.select("d"), "d")
    bitmap = marks.shared

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            some = b.filter(pa.array(Marks.known(bitmap.value, b.column(2).to_numpy())))
            for part in chunks([some]):
                rows = ((i, shingles(t), t) for i, t in zip(column(part, "doc_id"), column(part, "text")))
                yield batch_of(packed_schema, [(i, xxhash.xxh3_128_digest(s.tobytes()), pack.compress(t.encode("utf-8", "surrogatepass"))) for i, s, t in rows if len(s)])

    rows = texts(docs, marks.spot(F.col("doc_id").cast("long")).alias("spot")).mapInArrow(released(packed, _WORDS.clear), "doc_id long, key binary, data binary")
    return rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (rows["key"] == wanted["key"])).select(*columns, "data")
