"""Conversation structure repair.

Role initials must read (s?(ua)+)?, an automaton of four states.  A turn is a
4x4 matrix: from state to state the cheapest edits that consume the turn, as
(cost, audit), with any insertions before and after it.  Matrices multiply in the
min-plus way: costs add, audits follow each other, the less pair stays.  Audits of
one cell consume the same turns, and equal costs mean equally many insertions, so
neither of two begins the other and the order survives multiplication.

The table is range-sorted by conversation and turn, so that a conversation of
any length is cut into segments of at most BLOCK turns.  Segments are multiplied
by tasks of their own, then groups of FAN products, up to one for each
conversation.  The states chosen at the root go down the same tree, and every
segment applies its own part of the audit.  Texts take no part in this; repaired
texts are joined into chunks of bounded size, and one task streams a
conversation's chunks, as its hash can't be had otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, stage

#: Turns of a segment; children of a node of the tree; bytes of a chunk.
BLOCK, FAN, CHUNK_BYTES = 256, 16, 1 << 18
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
ENDS = (START, AFTER_ASSISTANT)
#: The role that may be put in at a state, and the state that follows.
PUT = {START: ("u", AFTER_USER), AFTER_SYSTEM: ("u", AFTER_USER), AFTER_USER: ("a", AFTER_ASSISTANT), AFTER_ASSISTANT: ("u", AFTER_USER)}
ROLES = {"u": "user", "a": "assistant"}


def follows(state: int, initial: str) -> int | None:
    """The state after a kept turn."""
    if state == START and initial == "s":
        return AFTER_SYSTEM
    return PUT[state][1] if PUT[state][0] == initial else None


# --- the matrices; a cell is (cost, audit) or None ------------------------------

Matrix = tuple[tuple[tuple[int, str] | None, ...], ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for row in a:
        cells: list[tuple[int, str] | None] = [None] * 4
        for k, left in enumerate(row):
            if left:
                for j, right in enumerate(b[k]):
                    if right and (cells[j] is None or left[0] + right[0] <= cells[j][0]):
                        sum_ = left[0] + right[0], left[1] + right[1]
                        if cells[j] is None or sum_ < cells[j]:
                            cells[j] = sum_
        out.append(tuple(cells))
    return tuple(out)


@lru_cache(1)
def closure() -> Matrix:
    """Insertions alone; more than two only lead back."""
    cells: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for i in range(4):
        state = i
        for n in range(3):
            if cells[i][state] is None:
                cells[i][state] = INSERT * n, "I" * n
            state = PUT[state][1]
    return tuple(map(tuple, cells))


@lru_cache(64)
def turn(symbol: str) -> Matrix:
    """symbol: the initial (x: one that fits nowhere), upper case if truncated;
    d: a turn that must be deleted."""
    cells: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for i in range(4):
        cells[i][i] = DELETE, "D"
        if symbol != "d":
            extra = TRUNCATED * symbol.isupper()
            for j, cell in ((PUT[i][1], (REROLE + extra, "R")), (follows(i, symbol.lower()), (KEEP + extra, "K"))):
                if j is not None and (cells[i][j] is None or cell < cells[i][j]):
                    cells[i][j] = cell
    return times(times(closure(), tuple(map(tuple, cells))), closure())


@lru_cache(1 << 15)
def _short(symbols: str) -> Matrix:
    return turn(symbols) if len(symbols) == 1 else times(_short(symbols[: len(symbols) // 2]), _short(symbols[len(symbols) // 2 :]))


def product(symbols: str) -> Matrix:
    """Of a segment, as a tree; products of few turns are remembered."""
    if len(symbols) <= 8:
        return _short(symbols)
    half = len(symbols) // 2
    return times(product(symbols[:half]), product(symbols[half:]))


def path(matrices: list[Matrix], start: int, end: int) -> list[int]:
    """The states between the matrices, ends included, on the cheapest way."""
    best, back = {start: (0, "")}, []
    for m in matrices:
        found: dict[int, tuple[int, str]] = {}
        came: dict[int, int] = {}
        for i, left in best.items():
            for j, right in enumerate(m[i]):
                if right:
                    sum_ = left[0] + right[0], left[1] + right[1]
                    if j not in found or sum_ < found[j]:
                        found[j], came[j] = sum_, i
        best = found
        back.append(came)
    states = [end]
    for came in reversed(back):
        states.append(came[states[-1]])
    return states[::-1]


def plans(symbols: str, start: int, audit: str) -> list[str]:
    """What each turn of a segment becomes: inserted roles (U, A), then a new
    role (u, a), k (kept) or nothing; the last turn also has what is inserted after it."""
    out, state, here, at = [], start, "", 0
    for edit in audit:
        if edit in "IR":
            role, state = PUT[state]
            here += role.upper() if edit == "I" else role
        elif edit == "K":
            state = follows(state, symbols[at].lower())
            here += "k"
        if edit != "I":
            out.append(here)
            here, at = "", at + 1
    if here:
        out[-1] += here
    return out


# --- as columns ------------------------------------------------------------------

_CELLS = T.ArrayType(T.StructType([T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
_STATES = T.ArrayType(T.StructType([T.StructField("ord", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))


def _flat(m: Matrix) -> list[dict | None]:
    return [cell and {"cost": cell[0], "audit": cell[1]} for row in m for cell in row]


def _matrix(cells: list) -> Matrix:
    flat = [c and (c["cost"], c["audit"]) for c in cells]
    return tuple(tuple(flat[4 * i : 4 * i + 4]) for i in range(4))


def _multiplied(children: list) -> list[dict | None]:
    out = _matrix(children[0]["cells"])
    for c in children[1:]:
        out = times(out, _matrix(c["cells"]))
    return _flat(out)


def _descended(children: list, start: int, end: int) -> list[dict]:
    states = path([_matrix(c["cells"]) for c in children], start, end)
    return [{"ord": c["ord"], "i": i, "j": j} for c, i, j in zip(children, states, states[1:], strict=False)]


def _planned(symbols: str, cells: list, i: int, j: int) -> list[str]:
    return plans(symbols, i, _matrix(cells)[i][j][1])


segment_cells = F.udf(lambda symbols: _flat(product(symbols)), _CELLS, useArrow=True)
multiplied = F.udf(_multiplied, _CELLS, useArrow=True)
descended = F.udf(_descended, _STATES, useArrow=True)
planned = F.udf(_planned, T.ArrayType(T.StringType()), useArrow=True)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text with faults put in by
    crc32(`conv_id:turn`) % 20: 0 drops the row, 1 empties its text, 2 removes
    its full stops, question and exclamation marks, 3 repeats it, 4 makes it a
    user's.  A null counts as one space, but stays null in conv_id and turn."""
    space = F.lit(" ")
    d = only(conversations, conv_id="long", turn="long", role="string", text="string")
    fault = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])) % 20
    text = F.coalesce("text", space)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    d = d.withColumn("fault", fault).where("fault != 0")
    d = d.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"), text.alias("text"), "fault")
    return d.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("fault", "copy")


def ordered(turns: DataFrame) -> DataFrame:
    """Turns with pos, their place in the order of all: by conversation, turn
    (null first), role and text; rows that are alike in all of these as they come."""
    keys = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    # rows that are alike may be a large group: a hash deals them to several ranges
    dealt = turns.withColumn("any", F.xxhash64(F.monotonically_increasing_id()))
    return dealt.repartitionByRange(*keys, "any").sortWithinPartitions(*keys, "any").drop("any").withColumn("pos", F.monotonically_increasing_id())


def judged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, pos, block, initial, fault of ordered turns; fault is blank,
    duplicate, truncated or none.  The first of turns that are alike is found by
    an aggregate, and marked by its place, which no two turns share."""
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    t = turns.select("conv_id", "turn", "pos", initial.alias("initial"), F.sha2(F.concat_ws(":", F.lit(""), F.length("role").cast("string"), "role", "text"), 256).alias("like"), (bare == "").alias("blank"), (~bare.rlike(r"[.!?]\z")).alias("open"))
    first = t.groupBy("conv_id", "like").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    t = t.drop("like").join(first, "pos", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated").otherwise("none")
    return t.select("conv_id", "turn", "pos", F.expr(f"pos div {BLOCK}").alias("block"), "initial", fault.alias("fault"))


def segments(t: DataFrame) -> DataFrame:
    """conv_id, ord, pos, symbols, initials, cells of judged turns; ord counts the
    segments of a conversation from 0, pos is the first turn's."""
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    s = t.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", symbol.alias("symbol"), "initial"))).alias("turns"))
    s = s.select("conv_id", F.col("turns")[0]["pos"].alias("pos"), F.array_join("turns.symbol", "").alias("symbols"), F.array_join("turns.initial", "").alias("initials"))
    return s.withColumn("ord", F.expr("row_number() over (partition by conv_id order by pos) - 1").cast("long")).withColumn("cells", segment_cells("symbols"))


def illegal_pairs(initials: Column) -> Column:
    """Neighbours other than su, ua and au."""
    pairs = F.transform(F.sequence(F.lit(1), F.char_length(initials) - 1), lambda k: F.substr(initials, k, F.lit(2)))
    return F.when(F.char_length(initials) > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0).cast("long")


def scan(segs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, ord, i, j: the states at the ends of each segment) and (conv_id,
    cost, audit: of each conversation), by a tree over the segments."""
    level = stage(segs.select("conv_id", "ord", "cells"), "turn-tree")
    levels, most = [], level.agg(F.max("ord")).first()[0] or 0
    while most:
        most //= FAN
        children = level.groupBy("conv_id", F.expr(f"ord div {FAN}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("ord", "cells"))).alias("children"))
        levels.append(stage(children, "turn-tree"))
        level = stage(levels[-1].select("conv_id", F.col("up").alias("ord"), multiplied("children").alias("cells")), "turn-tree")
    ends = F.array_min(F.array(*[F.when(F.col("cells")[e].isNotNull(), F.struct(F.col("cells")[e]["cost"].alias("cost"), F.col("cells")[e]["audit"].alias("audit"), F.lit(e).alias("j"))) for e in ENDS]))
    root = level.withColumn("end", ends)
    states = root.select("conv_id", "ord", F.lit(START).alias("i"), F.col("end.j").cast("int").alias("j"))
    for children in reversed(levels):
        s = states.select(F.col("conv_id").alias("c"), "ord", "i", "j")
        both = children.join(s, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("ord"))).drop("ord")
        states = stage(both.select("conv_id", F.inline(descended("children", "i", "j"))), "turn-states")
    return states, root.select("conv_id", "end.cost", "end.audit")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of neighbouring turns of a conversation as (conv_id, pos, chunk)."""
    schema = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("chunk", pa.string())])
    conv, first, last, lines, size = None, None, None, [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([first], pa.int64()), pa.array(["\n".join(lines)], pa.string())], schema=schema)

    for b in batches:
        for c, p, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if lines and (c != conv or p != last + 1 or size > CHUNK_BYTES):
                yield out()
                lines, size = [], 0
            if line.is_valid:
                if not lines:
                    conv, first = c, p
                lines.append(line.as_py())
                size += len(lines[-1])
            last = p
    if lines:
        yield out()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's chunks, which come in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    conv, digest, rows = None, None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    for b in batches:
        for c, chunk in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if digest is not None and c == conv:
                digest.update(b"\n")
            else:
                if digest is not None:
                    rows.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            digest.update(chunk.as_py().encode())
        if len(rows) >= 1024:
            yield out()
            rows = []
    if digest is not None:
        rows.append((conv, digest.hexdigest()))
    yield out()


class Repair:
    """The repair of a table of turns (conv_id, turn, role, text), as tables.

    Conversations are ordered by turn (null first), role and text.  A null in
    role or text counts as one space; rows without conv_id are one conversation.
    A role that begins with none of s, u, a fits nowhere and is changed or goes.
    """

    def __init__(self, turns: DataFrame):
        t = only(turns, conv_id="long", turn="long", role="string", text="string")
        self.turns = stage(ordered(t.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})), "turns")
        self.judged = stage(judged(self.turns), "turns-judged")
        self.segments = stage(segments(self.judged), "turn-segments")
        self.states, self.costs = scan(self.segments)

    def repaired_rows(self) -> DataFrame:
        """conv_id, pos, lines of every turn: `role:text` of what it becomes, with
        what is inserted beside it, joined by line feeds; null if nothing is left."""
        s = self.states.withColumnsRenamed({"conv_id": "c", "ord": "o"})
        met = self.segments.join(s, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("ord") == F.col("o")))
        parts = met.select("pos", planned("symbols", "cells", "i", "j").alias("plans"))
        blocks = parts.groupBy(F.expr(f"pos div {BLOCK}").alias("block")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "plans"))), lambda x: x["plans"])).alias("plans"))
        rows = self.turns.withColumn("block", F.expr(f"pos div {BLOCK}")).join(blocks, "block")
        plan = rows.withColumn("plan", F.element_at("plans", (F.col("pos") % BLOCK + 1).cast("int"))).drop("plans", "block")

        def line(letter: Column) -> Column:
            role = F.when(letter == "k", F.col("role")).when(F.lower(letter) == "u", ROLES["u"]).otherwise(ROLES["a"])
            return F.concat(role, F.lit(":"), F.when(letter.isin("U", "A"), "").otherwise(F.col("text")))

        letters = F.transform(F.sequence(F.lit(1), F.char_length("plan")), lambda k: F.substr("plan", k, F.lit(1)))
        return plan.select("conv_id", "pos", F.when(F.col("plan") != "", F.array_join(F.transform(letters, line), "\n")).alias("lines"))

    def digests(self) -> DataFrame:
        """conv_id, repaired_sha256 of conversations of which a turn is left; others
        have none."""
        chunks = self.repaired_rows().sortWithinPartitions("pos").mapInArrow(_chunks, "conv_id long, pos long, chunk string")
        return chunks.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "chunk").mapInArrow(_digests, "conv_id long, repaired_sha256 string")

    def counts(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal."""
        faults = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
        turns = self.judged.groupBy("conv_id", "turn").agg(*faults)
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
        sums = turns.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
        ends = self.segments.select("conv_id", "ord", "initials", F.lag(F.substring("initials", -1, 1), 1, "").over(Window.partitionBy("conv_id").orderBy("ord")).alias("before"))
        illegal = ends.groupBy("conv_id").agg(F.sum(illegal_pairs(F.concat("before", "initials"))).alias("illegal"))
        return sums.unionByName(illegal, True)

    def report(self, conversations: DataFrame | None = None) -> DataFrame:
        """A row for each conversation that has turns, and for each of
        `conversations`: counts, cost and audit (the cheapest edits in order, ties
        ASCII-least), repaired_sha256.  Where there is no turn these are zeros, an
        empty audit and the hash of an empty text."""
        parts = self.counts().unionByName(self.costs, True).unionByName(self.digests(), True)
        named = parts if conversations is None else parts.unionByName(only(conversations, conv_id="long").distinct(), True)
        both = named.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in parts.columns[1:]])
        zeros = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
        return both.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))})


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The report on every conversation of the table after `damage`.  An empty
    table gives an empty result."""
    return Repair(damage(conversations)).report(conversations)
