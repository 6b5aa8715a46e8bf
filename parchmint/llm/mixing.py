"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources in order of code points (null last) weigh 3, 1, 2, repeating, and share a total
of words; no target exceeds ``CAP`` times its source's words, and what is cut off is shared anew.

Rows fall into blocks of their source by a hash. A source takes each of its blocks as often as its
target holds all of its words, and of what remains the first blocks in a permuted order: these are
the exact block quotas. The one block that would overshoot is divided row by row, so what is taken
ends within half a document of the target.

The quotas are then dealt to output shards: a tree halves the shards again and again, and each half
gets one multivariate-hypergeometric draw. The driver's tree splits the quotas of BUCKETS groups of
sources; in a task for each group the same tree, held to the group's shards, splits the quotas of
its sources, however many there are. A shard's draws are disjoint blocks of each source's permuted
list. A row is taken as often as the tree has dealt out its block, once into each of those shards,
and rows are shuffled within their shard.

Null or empty texts have size 0 and are taken as often as their block. Rows with equal id and text
share a block; where it is divided row by row they may be taken a different number of times. Null
ids and sources are values like others. Empty table: empty result. Other columns are ignored by
``digest`` and kept by ``mix``, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchmint.llm.common import WORD, quoted
from parchmint.session import held, materialize, ship

#: Weights by position (fixed by contract), share of all words, most repeats of a source.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
#: Rows of a block on average, most blocks of a source (a larger source has larger blocks).
BLOCK_ROWS, MAX_BLOCKS = 256, 65_536
#: Groups of sources, least number of output shards, words of a shard beyond it.
BUCKETS, MIN_SHARDS, SHARD_WORDS = 64, 64, 64_000_000
SEED = "mix-1"


def placed(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), doc_id, key (of the source), size (words), mark (a hash of id and text)."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))  # null sorts after all "="
    return docs.select(F.struct(*quoted(docs)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), size.alias("size"), F.xxhash64(F.lit(SEED), "doc_id", text).alias("mark"))


def goals(sized: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple = WEIGHTS) -> DataFrame:
    """key, source_size, target, blocks of each source.

    Only sums reach the driver: the level at which open sources are filled, round by round.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("key").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    ranged = sums.repartitionByRange("key").sortWithinPartitions("key")
    ranged = materialize(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "sources")
    upto, offsets = 0, []
    for part, n in sorted(map(tuple, ranged.groupBy("part").count().collect())):  # a row a partition
        offsets.append((part, upto))
        upto += n
    placed_ = ranged.join(spark.createDataFrame(offsets, "part int, before long"), "part")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("before") + F.col("at")) % len(weights) + 1).cast("int"))
    table = materialize(placed_.select("key", "n", "rows", weight.alias("weight")), "weights")
    turn = cap * F.col("n") / F.col("weight")  # the level from which on a source is capped
    level = None
    while True:
        full = F.lit(False) if level is None else turn < level
        total, capped, open_ = table.agg(F.sum("n"), F.sum(F.when(full, cap * F.col("n"))), F.sum(F.when(~full, F.col("weight")))).first()
        fresh = (share * (total or 0) - (capped or 0.0)) / open_ if open_ else level
        if fresh == level:
            break
        level = fresh
    target = F.when(turn < (level or 0.0), cap * F.col("n")).otherwise(F.col("weight") * F.lit(level or 0.0))
    blocks = F.least(F.lit(MAX_BLOCKS), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("rows") / BLOCK_ROWS, F.lit(1.0)))))).cast("int")
    return materialize(table.select("key", F.col("n").alias("source_size"), target.cast("double").alias("target"), blocks.alias("blocks")), "targets")


def deal(quotas: np.ndarray, shards: np.ndarray, rng: np.random.Generator) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indexes of quotas, draws from each): the tree of multivariate-hypergeometric splits.

    ``shards`` says how many draws each shard gets, in all as many as the quotas.
    """

    def split(at: np.ndarray, q: np.ndarray, low: int, high: int):
        some = q > 0
        at, q = at[some], q[some]
        if not len(q):
            return
        if high - low == 1:
            yield low, at, q
            return
        mid = (low + high) // 2
        left = rng.multivariate_hypergeometric(q, int(shards[low:mid].sum()), method="marginals")
        yield from split(at, left, low, mid)
        yield from split(at, q - left, mid, high)

    yield from split(np.arange(len(quotas)), np.asarray(quotas, np.int64), 0, len(shards))


def capacities(total: int, shards: int) -> np.ndarray:
    """Draws of each shard: equal but for one."""
    return np.diff(total * np.arange(shards + 1) // shards)


def group_shards(quotas: dict[int, int], shards: int, seed: int) -> np.ndarray:
    """The driver's tree: how many draws each group of sources has in each shard."""
    out = np.zeros((BUCKETS, shards), np.int64)
    q = np.array([quotas.get(b, 0) for b in range(BUCKETS)], np.int64)
    for shard, at, n in deal(q, capacities(int(q.sum()), shards), np.random.default_rng(seed)):
        out[at, shard] = n
    return out


def source_shards(quotas: np.ndarray, shards: np.ndarray, bucket: int, seed: int) -> list[np.ndarray]:
    """The tree of one group: for each source the shard of each of its draws, in order."""
    out: list[list[np.ndarray]] = [[] for _ in quotas]
    for shard, at, n in deal(quotas, shards, np.random.default_rng([seed, bucket])):
        for i, k in zip(at.tolist(), n.tolist()):
            out[i].append(np.full(k, shard, np.int32))
    return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]


def permuted(key: str, n: int, seed: int, what: int) -> np.ndarray:
    return np.random.default_rng([seed, what, zlib.crc32(key.encode("utf-8", "surrogatepass"))]).permutation(n)


def quotas_of(key: str, sizes: np.ndarray, total: int, target: float, seed: int) -> tuple[np.ndarray, int, float]:
    """(times each block is taken, the block that is divided row by row or -1, words that it owes)."""
    repeats = int(target // total) if total else 1
    owed = target - repeats * total
    times = np.full(len(sizes), repeats, np.int64)
    order = permuted(key, len(sizes), seed, 0)
    ends = np.cumsum(sizes[order])
    whole = int(np.searchsorted(ends, owed, "right"))
    times[order[:whole]] += 1
    if whole == len(order):
        return times, -1, 0.0
    return times, int(order[whole]), float(owed - (ends[whole - 1] if whole else 0))


def _bucket():
    return F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket")


def plan(sized: DataFrame, shards: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(``goals``, key, block, times, owed, shards: the blocks and the shards that the tree deals them to).

    Where owed is not null, the last of the block's shards gets only the rows that fit in.
    """
    ship(sized.sparkSession)
    goal = goals(sized)
    if shards is None:
        words = goal.agg(F.sum("target")).first()[0] or 0
        shards = max(MIN_SHARDS, int(words // SHARD_WORDS) + 1)
    cells = blocked(sized, goal).groupBy("key", "block").agg(F.sum("size").alias("n"), F.first("source_size").alias("total"), F.first("target").alias("target"))

    def cut(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("block", "ascending")])
        keys, sizes = table["key"].to_pylist(), table["n"].to_numpy()
        times, owed = np.zeros(len(keys), np.int64), [None] * len(keys)
        for low, high in _spans(keys):
            t, edge, rest = quotas_of(keys[low], sizes[low:high], table["total"][low].as_py(), table["target"][low].as_py(), seed)
            times[low:high] = t
            if edge >= 0:
                owed[low + edge] = rest
        return pa.table({"bucket": table["bucket"], "key": table["key"], "block": table["block"], "times": pa.array(times), "owed": pa.array(owed, pa.float64())})

    cuts = materialize(cells.select("*", _bucket()).groupBy("bucket").applyInArrow(cut, "bucket int, key string, block int, times long, owed double"), "quotas")
    draws = (F.col("times") + F.col("owed").isNotNull().cast("long")).alias("draws")
    dealt = group_shards(dict(map(tuple, cuts.select("bucket", draws).groupBy("bucket").agg(F.sum("draws")).collect())), shards, seed)
    shared = sized.sparkSession.sparkContext.broadcast(dealt)

    def draw(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("block", "ascending")])
        keys, n, bucket = table["key"].to_pylist(), table["draws"].to_numpy(), table["bucket"][0].as_py()
        spans = _spans(keys)
        quotas = np.array([int(n[a:b].sum()) for a, b in spans], np.int64)
        where: list[list[int]] = [[] for _ in keys]
        for (low, high), to in zip(spans, source_shards(quotas, shared.value[bucket], bucket, seed)):
            tickets = np.repeat(np.arange(low, high), n[low:high])[permuted(keys[low], int(n[low:high].sum()), seed, 1)]
            for i, shard in zip(tickets.tolist(), to.tolist()):
                where[i].append(shard)
        return pa.table({"key": table["key"], "block": table["block"], "times": table["times"], "owed": table["owed"], "shards": pa.array(where, pa.list_(pa.int32()))})

    tickets = cuts.select("*", draws).groupBy("bucket").applyInArrow(draw, "key string, block int, times long, owed double, shards array<int>")
    return goal, materialize(tickets, "tickets")


def _spans(keys: list[str]) -> list[tuple[int, int]]:
    """Runs of equal keys."""
    cuts = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
    return list(zip(cuts, [*cuts[1:], len(keys)]))


def blocked(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """Rows with source_size, target and their block. The sources' table is written: its size decides how it is joined."""
    return rows.join(goal, "key").withColumn("block", F.pmod("mark", F.col("blocks").cast("long")).cast("int"))


def assigned(rows: DataFrame, planned: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Rows of ``placed`` with source_size, target and shards: one for each time that the row is taken."""
    goal, tickets = planned
    rows = blocked(rows, goal).join(tickets, ["key", "block"])
    # The one block of each source that is taken row by row: rows as long as they bring the sum nearer.
    order = Window.partitionBy("key").orderBy("mark", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = rows.filter("owed is not null").withColumn("upto", F.sum("size").over(order))
    last = last.withColumn("times", F.col("times") + (F.col("upto") - F.col("size") / 2 <= F.col("owed")).cast("int")).drop("upto")
    both = rows.filter("owed is null").unionByName(last)
    return both.withColumn("shards", F.slice("shards", F.lit(1), F.col("times").cast("int")))


def mix(docs: DataFrame, shards: int | None = None, seed: int = 0) -> DataFrame:
    """The mixed rows: the columns of ``docs``, a row each time it is taken, shuffled within its shard."""
    rows = placed(docs)
    sized = held(rows.drop("row"))
    planned = plan(sized, shards, seed)
    sized.unpersist()
    out = assigned(rows, planned).select("row", "mark", F.posexplode("shards").alias("copy", "shard"))
    n = planned[1].select(F.max(F.array_max("shards"))).first()[0]
    local = F.xxhash64("mark", "copy", F.lit(seed))
    return out.repartitionById((n or 0) + 1, F.col("shard")).sortWithinPartitions("shard", local).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the shards that the tree dealt the row to, comma-joined."""
    sized = held(placed(docs).drop("row"))
    times = F.size("shards")
    found = assigned(sized, plan(sized)).select("doc_id", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"), F.array_join("shards", ",").alias("shards"))
    found = materialize(found, "mixed")
    sized.unpersist()
    return found
