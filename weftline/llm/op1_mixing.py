"""Mixing sources to target weights.

Every document gets a hash-random key.  Within each source the documents are
range-sorted by key: the key space is cut into ranges of about equal row
counts, so that a source with a third of all rows is many ranges.  Word counts
are summed by range, the sums run up over the ranges of a source, and a second
running sum inside a range gives each document its place.  The source's budget
is cut there exactly: whole epochs first, the rest in key order, the document
at the cut in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, only, stage, unit_interval, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Rows of a source are ordered in ranges of about this many rows.
RANGE_ROWS = 20_000


def row_key(seed: int) -> Column:
    """The hash-random key of a row, 60 bits of a hash that SQL has too; rows
    that are alike share it."""
    parts = [F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ("doc_id", "source", "text")]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, n -> also target: the weights (given to the sources
    by code point, null last, in turn) share the sum of all sizes; a target
    stops at max_epochs times its source's size, and the excess is shared
    again by weight among the others until none is above.

    The order in which sources stop is that of size per weight, so one running
    sum over the sources finds all that stop.
    """
    ranked = sizes.withColumn("rank", F.expr("row_number() over (order by source is null, source) - 1"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    w = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    w = w.withColumn("ratio", F.col("cap") / F.col("weight"))
    run = "over (order by ratio, rank rows between unbounded preceding and 1 preceding)"
    w = w.selectExpr(
        "*",
        f"coalesce(sum(cap) {run}, 0D) cap_before",
        f"sum(weight) over () - coalesce(sum(weight) {run}, 0D) weight_left",
        "cast(sum(source_size) over () as double) total",
    )
    # this source and all before it stop if, with those before at their cap, its share is above its cap
    w = w.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    w = w.withColumn("stops", F.col("level") > F.col("ratio"))
    open_level = F.expr("min(case when not stops then named_struct('r', ratio, 'k', rank, 'level', level) end) over ()")["level"]
    target = F.when(F.col("stops"), F.col("cap")).otherwise(open_level * F.col("weight"))
    return w.select("source", "source_size", "n", F.least(target, F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """doc_id, source, key, size, source_size, target, taken for every row.

    taken is the number of words the mix takes, repeats counted: `epochs` whole
    copies and, in the document at the cut, part of one more.  A null text has
    size 0, and nothing is taken of it.  A null source is a source of its own.
    Rows that repeat are mixed each for itself; ties in the key are rows that
    are alike.  An empty table gives an empty result.
    """
    d = only(docs, doc_id="long", text="string", source="string")
    rows = stage(
        d.select("doc_id", "source", row_key(seed).alias("key"), word_count(F.col("text")).alias("size")),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = stage(source_targets(sizes, weights, max_epochs), "mix-targets").select(F.col("source").alias("s"), "source_size", "target", "n")
    # the number of ranges follows the row count; 64 at least, so that one source spreads over tasks
    ranged = rows.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ranged = ranged.withColumn("range", unit_interval(F.shiftleft("key", 4), F.greatest(F.lit(64), F.ceil(F.col("n") / RANGE_ROWS))))
    sums = rows_by_range(ranged)
    inside = F.expr("coalesce(sum(size) over (partition by source, range order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)")
    placed = (
        ranged.withColumn("inside", inside)
        .join(sums, (F.col("source").eqNullSafe(F.col("s"))) & (F.col("range") == F.col("r")))
        .withColumn("start", F.col("before") + F.col("inside"))
    )
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return placed.select("doc_id", "source", "key", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"))


def rows_by_range(ranged: DataFrame) -> DataFrame:
    """s, r, before: words of the source in ranges ahead of this one."""
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    return sums.select(
        F.col("source").alias("s"),
        F.col("range").alias("r"),
        F.expr("coalesce(sum(words) over (partition by source order by range rows between unbounded preceding and 1 preceding), 0)").alias("before"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: columns of docs, a row for each copy that is taken.  The
    document at a source's cut has, as its last copy, only the words taken."""
    key = row_key(options.get("seed", 17))
    # rows that are alike have one key; they are matched by their number in it
    number = F.expr("row_number() over (partition by __key order by __key)")
    taken = mix_sources(docs, **options).select(F.col("key").alias("__key"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    taken = taken.withColumn("__number", F.expr("row_number() over (partition by __key order by __taken desc)")).where("__taken > 0")
    both = docs.withColumn("__key", key).withColumn("__number", number).join(taken, ["__key", "__number"])
    both = both.withColumn("__full", F.expr("cast(__taken div __size as int)")).withColumn("__part", F.expr("cast(__taken % __size as int)"))
    copies = both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__full") + F.when(F.col("__part") > 0, 1).otherwise(0))))
    first = F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("__part"))
    cut = F.when(F.col("__copy") > F.col("__full"), F.array_join(first, "")).otherwise(F.col("text"))
    return copies.withColumn("text", cut).select(*docs.columns)
