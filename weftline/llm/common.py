"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.staging import discard, scratch_dir, stage

__all__ = ["LONGS", "MIN_SIMILARITY", "SHINGLE_WORDS", "WORD", "WordHashes", "discard", "let", "mix64", "only", "powers", "scratch_dir", "shingles", "small_batches", "spread_join", "stage", "unit_interval", "window_hashes", "word_count", "word_hashes"]

#: A word, as the contracts define it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed types; extra columns fall away, so their
    names cannot clash with those an operator adds."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_interval(h: Column, cells: Column) -> Column:
    """Which of `cells` equal ranges of the 64-bit hash `h` it falls in; the
    ranges keep the (unsigned) order of the hash."""
    u = (F.shiftrightunsigned(h, 11)).cast("double") / F.lit(float(1 << 53))
    return F.floor(u * cells).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it, and
    also inside lambdas (a projection that is merged into its consumer would be
    computed at each use)."""
    return F.element_at(F.transform(F.array(value), body), 1)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that are run within hand Python at most so many rows at once: a batch
    of whole texts stands in memory on both sides, beside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: A key is hot if it has more rows than this, and more than a thousandth of all.
HOT_ROWS = 500
_HOT_SHARE = 1000


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], by: str) -> DataFrame:
    """many joined with one on keys; the rows of a hot key of many are dealt by
    their column `by` to several tasks, each with its copy of the key's rows of
    one.  There are fewer than 1,000 hot keys, as each has more than a
    thousandth of the rows: their table is broadcast.  many is read twice; it
    should be a written table.
    """
    total = many.count()
    part = max(HOT_ROWS, total // _HOT_SHARE)
    hot = many.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > part).withColumn("__parts", F.ceil(F.col("n") / part).cast("int")).drop("n")
    rows = hot.collect()
    if not rows:
        return many.join(one, keys)
    hot = F.broadcast(many.sparkSession.createDataFrame(rows, hot.schema))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = many.join(hot, keys, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    copies = one.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(copies, [*keys, "__part"]).drop("__part")


# --- numpy helpers for tasks -------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)
_MULT = 0x2545F4914F6CDD1D | 1
_MULT_INV = pow(_MULT, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal in, equal out; near in, far out."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, remembered up to a bound."""

    BOUND = 1 << 17

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.BOUND:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        self[word] = h
        return h


def word_hashes(text: str | None, cache: WordHashes) -> np.ndarray:
    """Hashes of all words of a text, in order."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    base = np.full(n, np.uint64(_MULT_INV if inverse else _MULT))
    if n:
        base[0] = 1
    return np.multiply.accumulate(base) if n else base


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive 64-bit hash of each window of `width` items; none if
    there are fewer items."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(_MULT)
        out += hashes[k : k + n]
    return mix64(out)


def shingles(hashes: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Window hashes; a shorter, non-empty text is one shingle of all of it."""
    if 0 < len(hashes) < width:
        return window_hashes(hashes, len(hashes))
    return window_hashes(hashes, width)


LONGS = T.ArrayType(T.LongType(), False)
