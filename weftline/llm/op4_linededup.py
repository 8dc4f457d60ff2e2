"""Line dedup by a deletion-neighbourhood join.

Equal lines fall together first: by a 128-bit hash of their words, so that text
never rides through the shuffle.  Different lines are near duplicates if one
edit (a unit put in, taken out or replaced) turns one into the other and leaves
a similarity of 0.8, so both have MIN_UNITS units or more.  The unit is a word;
in lines of fewer words than that it is a character.  Two such lines share the
line, or the line without one unit: every line emits the hashes of these
variants, equal variants are joined, pairs are verified on their texts, and the
earliest line stays.

One edit leaves one half of a line as it was, so a line emits variants only if
its first or second half also begins or ends another line; this drops no pair.
Lines that lack one unit at one place differ pairwise by one edit: such a group
is kept as a group, and its pairs are never written out.  A line and those that
have one unit more are pairs, no more than there are variants.

Lines are kept greedily in order: a line is dropped if a line kept before it is
within the bound, so in a chain a, b, c of which only neighbours are near, a and
c stay.  This is found in rounds, as many as such a chain has undecided lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, discard, mix64, only, powers, stage

#: Least units of both lines: one edit in five leaves a similarity of 0.8.
MIN_UNITS = 5
_WHOLE = -1
#: Units of the lines whose variants are hashed together.
CHUNK_UNITS = 1 << 18
_CHARACTERS = np.uint64(0xA0761D6478BD642F)

UNDECIDED, KEPT, DROPPED = range(3)


def units_of(line: bytes) -> tuple[bool, list[bytes]]:
    """Whether the units of a line are words, and the units: its words, or the
    characters of its words joined by a space."""
    words = line.split()
    if len(words) >= MIN_UNITS:
        return True, words
    return False, [c.encode("utf-8", "surrogatepass") for c in b" ".join(words).decode("utf-8", "surrogatepass")]


def half_keys(are_words: bool, units: list[bytes]) -> list[int]:
    """Both halves, and each shorter by a unit, so that lines of n and n + 1
    units have one in common; none if the line has too few units."""
    n, glue = len(units), b" " if are_words else b""
    if n < MIN_UNITS:
        return []
    h = n // 2
    parts = (units[:h], 0), (units[: h - 1], 0), (units[h:], 1), (units[h + 1 :], 1)
    return [xxhash.xxh3_64_intdigest(glue.join(p), 4 * len(p) + 2 * are_words + side) for p, side in parts]


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _keyed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line with a word: its hash and the hashes of its halves."""
    for batch in batches:
        rows, numbers, digests, halves, ends = [], [], [], [], [0]
        for row, text in enumerate(batch["text"].cast(pa.binary()).to_pylist()):
            for number, line in enumerate((text or b"").split(b"\n")):
                words = line.split()
                if not words:
                    continue
                are_words, units = (True, words) if len(words) >= MIN_UNITS else units_of(line)
                rows.append(row)
                numbers.append(number)
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                halves += half_keys(are_words, units)
                ends.append(len(halves))
        keys = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"].take(at), batch["tk"].take(at), pa.array(numbers, pa.int32()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _longs(halves))],
            names=["doc_id", "tk", "line_no", "k1", "k2", "halves"],
        )


def variant_hashes(units: list[list[bytes]], cache: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, place and hash: each line whole, and without each of its units.
    Running sums over the units of all lines give each hash in O(1)."""
    n = np.fromiter(map(len, units), np.int64, len(units))
    start, total = np.cumsum(n) - n, int(n.sum())
    w = np.fromiter((cache[x] for line in units for x in line), np.uint64, total)
    inverse = powers(total + 2, inverse=True)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * powers(total), dtype=np.uint64)])
    run = lambda a, b: (sums[b] - sums[a]) * inverse[a]
    line = np.repeat(np.arange(len(n)), n + 1)
    place = np.arange(len(line)) - np.repeat(start + np.arange(len(n)), n + 1) + _WHOLE
    first, many = start[line], n[line]
    whole, cut = run(first, first + many), np.maximum(place, 0)
    left, upto = run(first, first + cut), run(first, first + cut + 1)
    without = left + (whole - upto) * inverse[1] + (many - 1).astype(np.uint64)
    return line, place, mix64(np.where(place == _WHOLE, whole + many.astype(np.uint64), without))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        ids = batch["line_id"].to_numpy()
        found = [units_of(x) for x in batch["line"].cast(pa.binary()).to_pylist()]
        for part in np.split(np.arange(len(found)), np.flatnonzero(np.diff(np.cumsum([len(u) for _, u in found]) // CHUNK_UNITS)) + 1):
            line, place, v = variant_hashes([found[i][1] for i in part], cache)
            v ^= np.where([found[i][0] for i in part], np.uint64(0), _CHARACTERS)[line]
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(ids[part][line])], names=["variant", "place", "line_id"])


def within_one_edit(a: list, b: list) -> bool:
    """Whether at most one unit is put in, taken out or replaced."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long_ = sorted((a, b), key=len)
    i = 0
    while i < len(short) and short[i] == long_[i]:
        i += 1
    return short[i:] == long_[i + 1 :] if len(short) < len(long_) else short[i + 1 :] == long_[i + 1 :]


def near_lines(a: str, b: str) -> bool:
    """The definition of near duplicates, for two different lines."""
    x, y = (units_of(s.encode("utf-8", "surrogatepass")) for s in (a, b))
    return x[0] == y[0] and min(len(x[1]), len(y[1])) >= MIN_UNITS and within_one_edit(x[1], y[1])


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(map(near_lines, a, b), dtype=bool)


def _position(*prefix: str) -> Column:
    """Place of a line in the order: rows without an id come last."""
    name = lambda c: ".".join((*prefix, c))
    return F.struct(F.col(name("doc_id")).isNull().alias("no_id"), F.coalesce(name("doc_id"), F.lit(0)).alias("rk"), F.col(name("tk")).alias("tk"), F.col(name("line_no")).alias("line_no"))


def _sought(once: DataFrame) -> DataFrame:
    """line_id of lines that share a half with another line."""
    halves = once.select("line_id", F.explode("halves").alias("half"))
    shared = stage(halves.groupBy("half").agg(F.min("line_id").alias("x"), F.max("line_id").alias("y"), F.count("*").alias("n")).where("x < y"), "line-halves")
    # two lines of one half are known by their ids; only larger groups are joined back
    two = shared.where("n = 2").select(F.explode(F.array("x", "y")).alias("line_id"))
    more = halves.join(shared.where("n > 2").select("half"), "half").select("line_id")
    return two.union(more).distinct()


def _with_texts(d: DataFrame, once: DataFrame) -> DataFrame:
    """line_id, at, line of the lines sought."""
    spots = once.join(_sought(once), "line_id").select("line_id", "at")
    # a document's own lines: no more than it has
    spots = spots.groupBy("at.no_id", "at.rk", "at.tk").agg(F.collect_list(F.struct("line_id", "at")).alias("spots"))
    keyed = d.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("rk"), "tk", "text")
    found = keyed.join(spots, ["no_id", "rk", "tk"]).withColumn("lines", F.split("text", "\n", -1))
    found = found.select("lines", F.explode("spots").alias("s")).select("s.line_id", "s.at", F.get("lines", F.col("s.at.line_no")).alias("line"))
    return found.dropDuplicates(["line_id"])


def _neighbours(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of lines that are within one edit pairwise (variant, place,
    line_id, at), and pairs of which one has a unit more (line_id, at, other,
    other_at; other is the earlier)."""
    variants = stage(texts.select("line_id", "line").mapInArrow(_variants, "variant long, place int, line_id long"), "line-variants")
    shared = variants.groupBy("variant").agg(F.min("line_id").alias("x"), F.max("line_id").alias("y")).where("x < y").select("variant")
    members = stage(variants.join(shared, "variant").join(texts.select("line_id", "at"), "line_id").distinct(), "line-members")
    discard(variants)
    cut, whole = members.where(F.col("place") != _WHOLE), members.where(F.col("place") == _WHOLE)
    leads = cut.groupBy("variant", "place").agg(F.min(F.struct("at", "line_id")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    groups = cut.join(leads.drop("n"), ["variant", "place"])
    ends = whole.select("variant", F.struct("at", "line_id").alias("a")).join(cut.select("variant", F.struct("at", "line_id").alias("b")), "variant")
    pairs = ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).select("a.line_id", "a.at", F.col("b.line_id").alias("other"), F.col("b.at").alias("other_at")).distinct()
    sought = groups.select("line_id", F.col("lead.line_id").alias("other")).where("line_id <> other").union(pairs.select("line_id", "other")).distinct()
    both = sought.join(texts.select("line_id", "line"), "line_id").join(texts.select(F.col("line_id").alias("other"), F.col("line").alias("other_line")), "other")
    true = stage(both.where(_near("line", "other_line")).select("line_id", "other"), "line-pairs")
    pairs = pairs.join(true, ["line_id", "other"], "left_semi")
    own = F.col("line_id") == F.col("lead.line_id")
    verified = groups.where(~own).withColumn("other", F.col("lead.line_id")).join(true, ["line_id", "other"], "left_semi")
    groups = groups.where(own).select("variant", "place", "line_id", "at").union(verified.select("variant", "place", "line_id", "at"))
    return stage(groups, "line-groups"), stage(pairs, "line-edges")


def _decide(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """line_id, at, keeper: lines that are dropped, with the earliest kept line
    within the bound."""
    ends = groups.select("line_id", "at").union(pairs.select("line_id", "at")).union(pairs.select("other", "other_at")).distinct()
    state = stage(ends.withColumn("status", F.lit(UNDECIDED)), "line-state")
    while True:
        open_ = state.where(F.col("status") == UNDECIDED).select("line_id")
        alive = state.where(F.col("status") != DROPPED)
        # of a group the first line that isn't dropped is the only one that can be kept
        first = groups.join(alive.select("line_id", "status"), "line_id").groupBy("variant", "place").agg(F.min(F.struct("at", "line_id", "status")).alias("first"))
        before = groups.join(open_, "line_id").join(first, ["variant", "place"]).where("line_id <> first.line_id").select("line_id", "first.status")
        before = before.union(pairs.join(open_, "line_id").join(alive.select(F.col("line_id").alias("other"), "status"), "other").select("line_id", "status"))
        before = before.groupBy("line_id").agg(F.max("status").alias("before"))
        now = F.when(F.col("status") != UNDECIDED, F.col("status")).when(F.col("before").isNull(), KEPT).when(F.col("before") == KEPT, DROPPED).otherwise(UNDECIDED)
        old, state = state, stage(state.join(before, "line_id", "left").select("line_id", "at", now.alias("status")), "line-state")
        discard(old)
        if not state.where(F.col("status") == UNDECIDED).limit(1).count():
            break
    kept = state.where(F.col("status") == KEPT).select(F.col("line_id").alias("other"), F.col("at").alias("keeper"))
    gone = state.where(F.col("status") == DROPPED).select("line_id")
    of_group = groups.join(kept.select(F.col("other").alias("line_id"), "keeper"), "line_id").select("variant", "place", "keeper")
    near = groups.join(of_group, ["variant", "place"]).select("line_id", "keeper").union(pairs.join(kept, "other").select("line_id", "keeper"))
    out = stage(near.join(gone, "line_id").groupBy("line_id").agg(F.min("keeper").alias("keeper")), "line-dropped")
    discard(state)
    return out


def classify_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, keeper, kept: a row for every line with a word.

    Lines are what stands between \\n; line_no counts from 0; white space in and
    around a line doesn't count.  A line is dropped if an earlier line equals
    it, or if a kept earlier line is within one edit (see above); keeper is the
    earliest kept line that it equals or is near to (struct doc_id, line_no), or
    the line itself.  If the first of equal lines is dropped so are the others,
    for the same keeper.  Earlier means a smaller doc_id (null last), then a
    smaller hash of the text (text_key; for rows that share an id or have none),
    then a smaller line_no.  Rows that repeat id and text count as one and are
    decided alike.  Null and empty texts, and lines without a word, give no
    rows; an empty table gives an empty result; other columns fall away.
    """
    d = only(docs, doc_id="long", text="string").withColumn("tk", F.xxhash64("text"))
    lines = stage(d.mapInArrow(_keyed_lines, "doc_id long, tk long, line_no int, k1 long, k2 long, halves array<long>"), "lines")
    at = _position()
    once = lines.groupBy("k1", "k2").agg(F.min(at).alias("at"), F.max(at).alias("last"), F.any_value("halves").alias("halves"))
    once = stage(once.select("k1", "k2", "at", (F.col("at") != F.col("last")).alias("repeats"), "halves", F.monotonically_increasing_id().alias("line_id")), "lines-once")
    texts = stage(_with_texts(d, once), "line-texts")
    groups, pairs = _neighbours(texts)
    gone = _decide(groups, pairs)
    told = once.join(gone, "line_id", "left").where("repeats or keeper is not null").select("k1", "k2", F.coalesce("keeper", "at").alias("keeper"))
    out = lines.select("doc_id", "tk", "line_no", "k1", "k2", at.alias("own")).join(told, ["k1", "k2"], "left")
    keeper = F.coalesce("keeper", "own")
    named = F.struct(F.when(~keeper["no_id"], keeper["rk"]).alias("doc_id"), keeper["line_no"].alias("line_no"))
    out = stage(out.select("doc_id", F.col("tk").alias("text_key"), "line_no", named.alias("keeper"), (F.col("own") == keeper).alias("kept")), "lines-told")
    for used in (lines, once, texts, groups, pairs, gone):
        discard(used)
    return out


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """Columns of docs, the text without its dropped lines."""
    # a document's own dropped lines: no more than it has
    gone = classify_lines(docs).where("not kept").groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_set("line_no").alias("__gone"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__key"))
    both = docs.join(gone, same, "left")
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__gone", i))
    return both.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).select(*docs.columns)
