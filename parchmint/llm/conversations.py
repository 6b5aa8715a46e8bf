"""Conversation structure repair by a rank-compressed dynamic program.

Turns are kept (K), given another role (R), deleted (D), or empty ones are inserted (I), so that the
roles' initials read (s?(ua)+)?, at least cost; among edits of equal cost the audit string (their
initials in order) that is least in ASCII wins.

A macro edit is a run of inserts and one edit of a turn. Its code (D, ID, IK, K, ...) is prefix-free, so
audit strings compare as the sequences of their codes do. Layers stand for turns, states for what the
roles so far allow next. A layer keeps, for each state, the least cost and the rank of its best audit
string among those of the layer, with a pointer to the parent and the code; a string of n turns is thus
compared in one step, and made only at the end, backwards along the pointers.

Turns are range-sorted by conversation and turn and cut into chunks of bounded size. A conversation that
lies within a chunk is repaired there. Of others, each chunk tells cost and rank from every state to
every state; such tables are put together first within a range, then within a conversation, which
gives the states between the chunks, and each chunk repairs its own turns. No task holds more than a
chunk's turns, however long a conversation is.

Nulls: a role or text is one space, turns sort first, an id is a conversation of its own. Turns of equal
number are ordered by role and hash of the text. An empty role has no initial and cannot be kept.
Repeated rows are duplicates of the first. Empty table: empty result. Other columns are ignored,
whatever their names. Numbers of turns that are 2 ** 63 apart have no gaps (null).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import batch_of, column, prepare
from parchmint.session import materialize

#: Costs of the edits; TRUNCATED is added for a truncated turn that stays (fixed by contract).
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
#: Most turns and characters of a chunk (a longer turn is a chunk of its own).
CHUNK_ROWS, CHUNK_CHARS = 512, 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"

#: States: nothing so far, a system turn, a user's turn last, an assistant's turn last.
STATES = range(4)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Inserts that end a conversation in each state.
TAIL = (0, 2, 1, 0)
ROLE = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
_FAR = 1 << 60


def _inserts() -> dict[tuple[int, int], int]:
    """State after a run of up to two inserts; longer ones come back to a state at more cost."""
    out = {}
    for p in STATES:
        s = p
        for n in range(3):
            out[p, n] = s
            s = next(NEXT[s, c] for c in "ua" if (s, c) in NEXT)
    return out


def macros(initial: str, stays: bool, cut: bool) -> list[list[tuple[int, int, str]]]:
    """(state after, cost, code) for each state before a turn, by code."""
    out = []
    for p in STATES:
        found = []
        for n in range(3):
            s, run, paid = _INSERTS[p, n], "I" * n, n * COST["I"]
            found.append((s, paid + COST["D"], run + "D"))
            if stays:
                more = paid + (TRUNCATED if cut else 0)
                if (s, initial) in NEXT:
                    found.append((NEXT[s, initial], more + COST["K"], run + "K"))
                found += [(NEXT[s, c], more + COST["R"], run + "R") for c in "ua" if (s, c) in NEXT]
        best: dict[int, tuple[int, str]] = {}
        for s, cost, code in found:
            best[s] = min(best.get(s, (cost, code)), (cost, code))
        out.append([(s, cost, code) for s, (cost, code) in best.items()])
    return out


_INSERTS = _inserts()
MACROS = {(c, stays, cut): macros(c, stays, cut) for c in ("s", "u", "a", "") for stays in (True, False) for cut in (True, False)}


def faults(roles: list[str], texts: list[str], seen: Iterable[int] | None = None) -> list[str | None]:
    """The first fault of each turn. ``seen``: those that repeat an earlier turn, where that is known already."""
    if seen is None:
        before: set = set()
        seen = [i for i, x in enumerate(zip(roles, texts)) if x in before or before.add(x)]
    repeats, out = set(seen), []
    for i, text in enumerate(texts):
        rest = text.rstrip(BLANKS)
        out.append(BLANK if not rest else DUPLICATE if i in repeats else None if rest[-1] in ".!?" else CUT)
    return out


def kinds(roles: list[str], found: list[str | None]) -> list[tuple[str, bool, bool]]:
    """What decides about a turn's edits: its initial, whether it may stay, whether it is truncated."""
    return [(r[:1] if r[:1] in ("s", "u", "a") else "", f not in (BLANK, DUPLICATE), f == CUT) for r, f in zip(roles, found)]


def layers(turns: list[tuple], entry: int, pointers: list | None = None) -> tuple[list[int], list[int]]:
    """(costs, ranks) of the states after ``turns``, from one state before them; collects (parent, code) of each layer."""
    cost, rank = [_FAR] * 4, [0] * 4
    cost[entry] = 0
    for kind in turns:
        best: list[tuple | None] = [None] * 4
        for p, moves in enumerate(MACROS[kind]):
            if cost[p] < _FAR:
                for s, paid, code in moves:
                    new = (cost[p] + paid, rank[p], code, p)
                    if best[s] is None or new < best[s]:
                        best[s] = new
        cost = [b[0] if b else _FAR for b in best]
        order = sorted((b[1], b[2], s) for s, b in enumerate(best) if b)
        for r, (_, _, s) in enumerate(order):
            rank[s] = r
        if pointers is not None:
            pointers.append([b and (b[3], b[2]) for b in best])
    return cost, rank


def chosen(cost: list[int], rank: list[int]) -> int:
    """The state to end in: least cost with its last inserts, then least audit string."""
    return min((c + TAIL[s] * COST["I"], rank[s], s) for s, c in enumerate(cost) if c < _FAR)[2]


def codes(turns: list[tuple], entry: int, leave: int | None) -> tuple[list[str], int, int]:
    """(macro edit of each turn, state that they leave, cost without last inserts), backwards along the pointers."""
    pointers: list = []
    cost, rank = layers(turns, entry, pointers)
    leave = chosen(cost, rank) if leave is None else leave
    out, s = [], leave
    for layer in reversed(pointers):
        s, code = layer[s]
        out.append(code)
    return out[::-1], leave, cost[leave]


def rebuilt(roles: list[str], texts: list[str], edits: list[str], entry: int, tail: int) -> tuple[str, list[str], list[str]]:
    """(audit, roles, texts) that the macro edits make."""
    s, new_roles, new_texts = entry, [], []

    def put(role: str | None, text: str) -> None:
        nonlocal s
        c = role[:1] if role is not None else next(c for c in "ua" if (s, c) in NEXT)
        new_roles.append(ROLE[c] if role is None else role)
        new_texts.append(text)
        s = NEXT[s, c]

    for role, text, code in zip(roles, texts, edits):
        for _ in code[:-1]:
            put(None, "")
        if code[-1] != "D":
            put(role if code[-1] == "K" else None, text)
    for _ in range(tail):
        put(None, "")
    return "".join(edits) + "I" * tail, new_roles, new_texts


# -- tables of parts: cost and rank from each state to each state


def summary(turns: list[tuple]) -> list[int]:
    """Costs, then ranks, from each state to each state."""
    found = [layers(turns, p) for p in STATES]
    return [x for cost, _ in found for x in cost] + [x for _, rank in found for x in rank]


def through(tables: list[list[int]], entry: int, pointers: list | None = None) -> tuple[list[int], list[int]]:
    """As ``layers``, over parts instead of turns."""
    cost, rank = [_FAR] * 4, [0] * 4
    cost[entry] = 0
    for t in tables:
        best: list[tuple | None] = [None] * 4
        for p in STATES:
            if cost[p] < _FAR:
                for s in STATES:
                    if t[4 * p + s] < _FAR:
                        new = (cost[p] + t[4 * p + s], rank[p], t[16 + 4 * p + s], p)
                        if best[s] is None or new < best[s]:
                            best[s] = new
        cost = [b[0] if b else _FAR for b in best]
        for r, (_, _, s) in enumerate(sorted((b[1], b[2], s) for s, b in enumerate(best) if b)):
            rank[s] = r
        if pointers is not None:
            pointers.append([b and b[3] for b in best])
    return cost, rank


def together(tables: list[list[int]]) -> list[int]:
    """The table of several parts."""
    found = [through(tables, p) for p in STATES]
    return [x for cost, _ in found for x in cost] + [x for _, rank in found for x in rank]


def between(tables: list[list[int]], entry: int, leave: int | None) -> list[int]:
    """The states before, between and after the parts."""
    pointers: list = []
    cost, rank = through(tables, entry, pointers)
    out = [chosen(cost, rank) if leave is None else leave]
    for layer in reversed(pointers):
        out.append(layer[out[-1]])
    return out[::-1]


# -- Spark


_CHUNK = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), ("alone", pa.bool_()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


def chunked(turns: DataFrame) -> DataFrame:
    """conv_id, part, chunk, alone, turns, roles, texts: sorted turns in chunks, numbered in order. Written.

    ``alone``: the chunk is known to be the whole conversation. Those at the ends of a range are not.
    """
    prepare(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        done: list[tuple] = []
        rows: list[tuple] = []
        here, size, whole, held, first = None, 0, True, 0, True

        def close(alone: bool) -> None:
            nonlocal number, rows, size, held
            done.append((here, part, part << 40 | number, alone, *map(list, zip(*rows))))
            number, held = number + 1, held + size
            rows, size = [], 0

        for b in batches:
            for conv, turn, role, text in zip(*(column(b, c) for c in ("conv_id", "turn", "role", "text"))):
                if rows and conv != here:
                    close(whole and not first)
                    whole, first = True, False
                elif rows and (len(rows) >= CHUNK_ROWS or size + len(text) > CHUNK_CHARS):
                    close(False)
                    whole = False
                here = conv
                rows.append((turn, role, text))
                size += len(text)
                if held > CHUNK_CHARS:
                    yield batch_of(_CHUNK, done)
                    done, held = [], 0
        if rows:
            close(False)
        if done:
            yield batch_of(_CHUNK, done)

    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"))
    order = ["conv_id", "turn", "role", "mark", "row"]  # the row's number parts what is equal else
    rows = rows.select("*", F.md5("text").alias("mark"), F.monotonically_increasing_id().alias("row"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    return materialize(ranged.mapInArrow(run, "conv_id long, part long, chunk long, alone boolean, turns array<long>, roles array<string>, texts array<string>"), "chunks")


def _repeats(spans: DataFrame) -> DataFrame:
    """chunk, seen: the turns that repeat an earlier one of their conversation, across chunks."""
    turn = spans.select("conv_id", "chunk", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "x"))
    mark = F.md5(F.concat(F.col("x.roles"), F.lit("\0"), F.col("x.texts"))).alias("mark")
    keys = turn.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv"), mark, F.struct("chunk", "i").alias("at"))
    firsts = keys.groupBy("conv", "mark").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = keys.join(firsts, ["conv", "mark"]).filter("at != first")
    return later.groupBy(F.col("at.chunk").alias("chunk")).agg(F.collect_list("at.i").alias("seen"))


def _edge(before: tuple | None, roles: list[str], turns: list[int | None]) -> tuple[int, int]:
    """(1 if the first turn does not fit the role before, 1 if it has the number of the turn before)."""
    if before is None:
        return 0, 0
    return int(before[0] + roles[0][:1] not in LEGAL), int(before[1] is not None and before[1] == turns[0])


_REPAIRED = "conv_id long, chunk long, cost long, audit string, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, low long, high long, n_turns long"
_REPAIRED_ARROW = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "low", "high", "n_turns"))])


def _repaired(conv, chunk, turns, roles, texts, seen=None, entry=0, leave=None, tail=None, before=None) -> tuple:
    """The row of ``repair`` for a chunk; ``leave`` and ``tail`` are chosen where not given."""
    found = faults(roles, texts, seen)
    edits, leave, cost = codes(kinds(roles, found), entry, leave)
    tail = TAIL[leave] if tail is None else tail
    illegal, shared = _edge(before, roles, turns)
    illegal += sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))
    known = [t for t in turns if t is not None]
    return (conv, chunk, cost + tail * COST["I"], *rebuilt(roles, texts, edits, entry, tail), *(found.count(f) for f in (BLANK, DUPLICATE, CUT)), illegal, min(known, default=None), max(known, default=None), len(set(known)) - shared)


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, chunk, cost, audit, roles, texts (repaired), blank, duplicate, truncated, illegal, low, high, n_turns.

    A row for each chunk of a conversation, in the order of ``chunk``; ``low``, ``high`` and ``n_turns``
    tell its turn numbers, each counted in one chunk only.
    """
    whole, spans = _repair(turns)
    return whole.unionByName(spans)


def _repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``repair``: of conversations in one chunk, of chunks of the others."""
    chunks_ = chunked(turns)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch_of(_REPAIRED_ARROW, [_repaired(*x) for x in zip(*(column(b, c) for c in ("conv_id", "chunk", "turns", "roles", "texts")))])

    # A chunk holds up to a MB: a few a batch.
    turns.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    whole = chunks_.filter("alone").select("conv_id", "chunk", "turns", "roles", "texts").mapInArrow(alone, _REPAIRED)

    spans = chunks_.filter("not alone").drop("alone")
    spans = materialize(spans.join(_repeats(spans), "chunk", "left"), "spans")
    table_ = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), ("costs", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string()), ("turn", pa.int64())])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, part, chunk, numbers, roles, texts, seen in zip(*(column(b, c) for c in ("conv_id", "part", "chunk", "turns", "roles", "texts", "seen"))):
                rows.append((conv, part, chunk, summary(kinds(roles, faults(roles, texts, seen or ()))), roles[0][:1], roles[-1][:1], numbers[-1]))
            yield batch_of(table_, rows)

    tables = materialize(spans.mapInArrow(told, "conv_id long, part long, chunk long, costs array<long>, first string, last string, turn long"), "tables")

    def of_range(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        return pa.table({"conv_id": t["conv_id"][:1], "part": t["part"][:1], "costs": pa.array([together(t["costs"].to_pylist())], pa.list_(pa.int64())), "last": t["last"][-1:], "turn": t["turn"][-1:]})

    def of_conversation(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        return walked(t, "part", between(t["costs"].to_pylist(), 0, None), True, None)

    def walked(t: pa.Table, name: str, states: list[int], ends: bool, before: tuple | None) -> pa.Table:
        """The states around each row and what stands before it; ``ends``: the last row ends the conversation."""
        n = t.num_rows
        tail = [0] * (n - 1) + [TAIL[states[-1]] if ends else 0]
        behind = [before, *zip(t["last"].to_pylist(), t["turn"].to_pylist())][:n]
        return pa.table({"conv_id": t["conv_id"], name: t[name], "entry": pa.array(states[:-1], pa.int64()), "leave": pa.array(states[1:], pa.int64()), "tail": pa.array(tail, pa.int64()), "role_before": pa.array([x and x[0] for x in behind], pa.string()), "turn_before": pa.array([x and x[1] for x in behind], pa.int64())})

    def in_range(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        one = {c: t[c][0].as_py() for c in ("entry", "leave", "tail", "role_before", "turn_before")}
        before = None if one["role_before"] is None else (one["role_before"], one["turn_before"])
        out = walked(t, "chunk", between(t["costs"].to_pylist(), one["entry"], one["leave"]), False, before)
        return out.set_column(out.schema.get_field_index("tail"), "tail", pa.array([0] * (t.num_rows - 1) + [one["tail"]], pa.int64()))

    ways = "entry long, leave long, tail long, role_before string, turn_before long"
    ranges = tables.groupBy("conv_id", "part").applyInArrow(of_range, "conv_id long, part long, costs array<long>, last string, turn long")
    parts_ = materialize(ranges.groupBy("conv_id").applyInArrow(of_conversation, f"conv_id long, part long, {ways}"), "ways").withColumnsRenamed({"conv_id": "conv", "part": "range"})
    both = tables.join(parts_, tables["conv_id"].eqNullSafe(parts_["conv"]) & (tables["part"] == parts_["range"])).drop("conv", "range", "first", "turn")
    both = both.join(tables.select("chunk", "turn"), "chunk")
    paths = materialize(both.groupBy("conv_id", "part").applyInArrow(in_range, f"conv_id long, chunk long, {ways}").drop("conv_id"), "paths")

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "chunk", "turns", "roles", "texts", "seen", "entry", "leave", "tail", "role_before", "turn_before")
        for b in batches:
            yield batch_of(_REPAIRED_ARROW, [_repaired(*x[:5], x[5] or (), *x[6:9], None if x[9] is None else x[9:]) for x in zip(*(column(b, c) for c in names))])

    return whole, spans.join(paths, "chunk").mapInArrow(along, _REPAIRED)


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """conv_id, chunk, i, role, text: the repaired turns, in the order of (chunk, i)."""
    return repaired.select("conv_id", "chunk", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "x")).select("conv_id", "chunk", "i", F.col("x.roles").alias("role"), F.col("x.texts").alias("text"))


# -- the contract


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the contract's damage by a checksum of id and turn."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), named("role").alias("role"), named("text").alias("text"), how.alias("how")).filter("how != 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("how") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns: the damaged conversations, repaired.

    Audit strings and hashes of a conversation in several chunks are put together by one task, chunk by
    chunk: a hash has no other way, and holds a chunk at a time.
    """
    named = F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv")
    whole, spans = (x.select(named, *x.columns[1:]) for x in _repair(damaged(rows)))
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("n_turns", pa.int64()), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, one, audit, told, empty, out = None, None, [], None, True, []

        def close() -> None:
            out.append((here, *one, "".join(audit), told.hexdigest()))

        for b in batches:
            for conv, roles, texts, edits, low, high, n, *sums in zip(*(column(b, c) for c in ("conv", "roles", "texts", "audit", "low", "high", "n_turns", *counts))):
                if conv != here:
                    if here is not None:
                        close()
                    here, one, audit, told, empty = conv, [None, None, 0, *[0] * len(counts)], [], hashlib.sha256(), True
                ends = [x for x in (one[0], one[1], low, high) if x is not None]
                one = [min(ends, default=None), max(ends, default=None), one[2] + n, *map(sum, zip(one[3:], sums))]
                audit.append(edits)
                for r, t in zip(roles, texts):
                    told.update(("" if empty else "\n").encode() + f"{r}:{t}".encode("utf-8", "surrogatepass"))
                    empty = False
            yield batch_of(schema, out)
            out = []
        if here is not None:
            close()
            yield batch_of(schema, out)

    kind = "conv string, low long, high long, n_turns long, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string"
    met = whole.mapInArrow(join, kind).unionByName(spans.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(join, kind))
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", named)
    gaps = F.try_subtract(F.try_add(F.try_subtract("high", "low"), F.lit(1)), F.col("n_turns"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.join(met, "conv", "left").select(
        "conv_id", F.when(F.col("low").isNull(), 0).otherwise(gaps).cast("long").alias("gaps"), *map(zero, counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
