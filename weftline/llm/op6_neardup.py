"""MinHash near-dedup with DartMinHash signatures (Christiani, 2020).

A text is a set of five-word shingles, as links are defined: how often a text
repeats one counts for nothing.  The darts are for weighted sets; all weights
are 1.  Every element has a random, shared process of darts over (weight, rank); a dart hits
a text if it falls below the element's weight there.  Ranks are thrown only up
to a bound at which a text expects k ln k + 2k darts in all, so the cost of a
signature does not grow with the text.  Each dart belongs to one of k
coordinates, and the earliest per coordinate is kept: two texts agree in a
coordinate with the probability of their Jaccard similarity.

Banding finds candidates; Jaccard over the shingle sets verifies them.  In a
bucket every member is compared with the bucket's most central member.  Members
that stay in different classes are compared across classes, inside the join and
by what sets each apart from the central one; where their distances to it rule a
link out (Jaccard distance is a metric) they are not.  So no two classes that a
link in a bucket connects stay apart.  Hot buckets and central members with
many companions are dealt to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import components

from .common import MIN_SIMILARITY, WordHashes, discard, mix64, only, shingles, small_batches, spread_join, stage, word_hashes

BANDS = 25
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^25 < 5e-5.
ROWS = 5
#: Texts whose darts are thrown together, and the bytes that they have at most.
CHUNK, CHUNK_BYTES = 256, 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _times(n: int) -> np.uint64:
    return np.uint64(n * int(_P) % (1 << 64))


def dart_minhash(elements: list[np.ndarray], weights: list[np.ndarray], k: int) -> np.ndarray:
    """One row of k dart ids for each weighted set (none may be empty)."""
    n = len(elements)
    out = np.zeros((n, k), np.uint64)
    todo, darts = np.arange(n), k * (np.log(k) + 2)
    while len(todo):
        sig, full = _throw([elements[i] for i in todo], [weights[i] for i in todo], k, darts)
        out[todo[full]] = sig[full]
        todo, darts = todo[~full], darts * 2
    return out


def _throw(elements: list[np.ndarray], weights: list[np.ndarray], k: int, darts: float) -> tuple[np.ndarray, np.ndarray]:
    """Signatures from about `darts` darts per set, and which are complete."""
    n = len(elements)
    size = [len(e) for e in elements]
    h, w, owner = np.concatenate(elements), np.concatenate(weights), np.repeat(np.arange(n), size)
    bound = darts / np.bincount(owner, w, n)
    # weights are cut into cells [0, 1), [1, 2), [2, 4), ...: each has a process of its own
    seeds, rates, lows, tops, owners = [], [], [], [], []
    low, width, cell = 0.0, 1.0, 0
    while (inside := w > low).any():
        seeds.append(mix64(h[inside] + _times(cell + 1)))
        rates.append(np.full(inside.sum(), width))
        lows.append(np.full(inside.sum(), low))
        tops.append(w[inside])
        owners.append(owner[inside])
        low, width, cell = low + width, max(1.0, low + width), cell + 1
    seed, rate, low, top, owner = map(np.concatenate, (seeds, rates, lows, tops, owners))
    limit, rank = bound[owner], np.zeros(len(seed))
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = 0
    while len(seed):
        step += 1
        dart = mix64(seed + _times(step))
        rank = rank - np.log(_unit(dart)) / rate
        live = rank < limit
        seed, rate, low, top, owner, limit, rank, dart = (x[live] for x in (seed, rate, low, top, owner, limit, rank, dart))
        more = mix64(dart ^ _P)
        hit = low + rate * _unit(more) < top
        got.append((owner[hit] * k + (mix64(more)[hit] % np.uint64(k)).astype(np.int64), rank[hit], dart[hit]))
    slot, rank, dart = (np.concatenate(x) for x in zip(*got))
    earliest = np.full(n * k, np.inf)
    np.minimum.at(earliest, slot, rank)
    best = rank == earliest[slot]
    sig = np.zeros(n * k, np.uint64)
    sig[slot[best]] = dart[best]
    return sig.reshape(n, k), np.isfinite(earliest).reshape(n, k).all(axis=1)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows)
    key = np.zeros(parts.shape[:2], np.uint64)
    for r in range(rows):
        key = mix64(key * np.uint64(0x2545F4914F6CDD1D) + parts[:, :, r])
    return mix64(key + np.arange(bands, dtype=np.uint64) * _P).view(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in order, in parts of at most CHUNK rows and, but for a longer
    text alone, CHUNK_BYTES of text: only these are taken out of Arrow at once."""
    for rows in batches:
        at = size = 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(rows["text"]), 0).to_pylist()):
            if k > at and (k - at == CHUNK or size + n > CHUNK_BYTES):
                yield rows.slice(at, k - at)
                at, size = k, 0
            size += n
        if at < rows.num_rows:
            yield rows.slice(at)


def _lists(values: np.ndarray, lengths: list[int]) -> pa.Array:
    """The values cut into lists of these lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for part in _parts(batches):
        sets = [np.unique(shingles(word_hashes(t, cache))) for t in part["text"].to_pylist()]
        full = [s for s in sets if len(s)]
        keys = band_keys(dart_minhash(full, [np.ones(len(s)) for s in full], BANDS * ROWS)).ravel() if full else np.empty(0, np.int64)
        bands = _lists(keys, [BANDS if len(s) else 0 for s in sets])
        # 32 bits of each shingle's hash: in two texts of 10^4 shingles 0.02 of them agree by chance
        short = [np.unique((s >> np.uint64(32)).astype(np.uint32)).view(np.int32) for s in sets]
        yield pa.RecordBatch.from_arrays([part["no_id"], part["rk"], part["text_key"], bands, _lists(np.concatenate(short), [len(s) for s in short])], names=["no_id", "rk", "text_key", "bands", "shingles"])


def _members(nodes: DataFrame) -> DataFrame:
    """band, node, lead, priority: buckets of two nodes or more.

    The first of a bucket is its most central node: that which has most
    companions over all its buckets, as the original of edited copies has.
    """
    each = nodes.select("node", F.explode("bands").alias("band"))
    many = each.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    each = stage(each.join(many, "band"), "dart-buckets")
    central = each.groupBy("node").agg(F.sum("size").alias("companions"))
    priority = F.shiftleft(F.least("companions", F.lit((1 << 31) - 1)), 32) + F.pmod(F.xxhash64("node"), F.lit(1 << 32))
    ranked = stage(each.drop("size").join(central.select("node", priority.alias("priority")), "node"), "dart-ranked")
    lead = ranked.groupBy("band").agg(F.max_by("node", "priority").alias("lead"))
    members = stage(spread_join(ranked, lead, ["band"], "node"), "dart-members")
    discard(each, ranked)
    return members


def _across(members: DataFrame, tested: DataFrame, comp: DataFrame, sets: DataFrame, min_similarity: float) -> DataFrame:
    """a, b: links between members of a bucket that are in different classes;
    of each two classes that are linked, one link.

    A member is its bucket's first set without the shingles `gone` and with the
    shingles `new`, so what two members share follows from what they share of
    these short lists.  Members outside the first's class meet all members; the
    join itself compares them, hot buckets in many tasks.  Most pairs fall to
    what is known before: if two are linked, their distances to the first differ
    by no more than their own distance, and the smaller set is no less than
    min_similarity of the larger.
    """
    with_class = stage(members.join(comp, "node"), "dart-within")
    of_lead = comp.select(F.col("node").alias("lead"), F.col("comp").alias("lead_comp"))
    both = stage(spread_join(with_class, of_lead, ["lead"], "node").select("band", "node", "lead", "comp", (F.col("comp") != F.col("lead_comp")).alias("apart")), "dart-sides")
    apart = both.where("apart").select("band", "lead").distinct()
    first = sets.select(F.col("node").alias("lead"), F.col("shingles").alias("first"))
    own = sets.select("node", F.col("shingles").alias("own"))
    changes = tested.select(F.col("a").alias("lead"), F.col("b").alias("node"), (1 - F.col("similarity")).alias("far"))
    changes = stage(changes.join(apart.select("lead").distinct(), "lead"), "dart-sought")
    compared = spread_join(changes, first, ["lead"], "node").join(own, "node")
    compared = compared.select("lead", "node", "far", F.size("first").alias("base"), F.size("own").alias("n"), F.array_except("own", "first").alias("new"), F.array_except("first", "own").alias("gone"))
    compared = stage(compared, "dart-changes")
    rest = stage(both.join(apart.select("band"), "band").join(compared, ["lead", "node"]).drop("lead"), "dart-rest")
    outer = rest.where("apart").select(*[F.col(c).alias(f"{c}_") for c in rest.columns if c != "band"], "band")
    near = (F.abs(F.col("far") - F.col("far_")) <= 1 - min_similarity + 1e-9) & (F.least("n", "n_") >= min_similarity * F.greatest("n", "n_") - 1e-9)
    same = lambda c: F.size(F.array_intersect(c, f"{c}_"))
    shared = F.col("base") - F.size("gone") - F.size("gone_") + same("gone") + same("new")
    linked = shared * (1 + min_similarity) >= min_similarity * (F.col("n") + F.col("n_")) - 1e-9
    pairs = spread_join(rest, outer, ["band"], "node").where((F.col("comp") != F.col("comp_")) & (~F.col("apart") | (F.col("node") < F.col("node_"))) & near & linked)
    late = pairs.groupBy(F.least("comp", "comp_").alias("x"), F.greatest("comp", "comp_").alias("y")).agg(F.min(F.struct("node", "node_")).alias("link"))
    late = stage(late.select(F.col("link.node").alias("a"), F.col("link.node_").alias("b")), "dart-late")
    discard(with_class, both, changes, compared, rest)
    return late


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs a, b with their Jaccard similarity."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    same = F.size(F.array_intersect("x", "y"))
    joined = spread_join(pairs, one, ["a"], "b").join(two, "b").withColumn("same", same)
    return joined.select("a", "b", (F.col("same") / (F.size("x") + F.size("y") - F.col("same"))).alias("similarity"))


def near_duplicates(docs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """doc_id, text_key, class_id, class_size, kept for every row of docs.

    Two texts are linked if the Jaccard similarity of their sets of five-word
    shingles is min_similarity or more; a text of one to four words is one
    shingle.  Classes are what links and equal texts connect.  class_id is the
    smallest doc_id in the class; kept says that the row bears it (rows that
    repeat the very id and text are all marked).  Texts without a word equal
    only texts that are the same; every null text is alone, with a row's own
    doc_id.  A null doc_id counts as after all others; a class of such rows has
    a null class_id, and the first by text hash is kept.  An empty table gives
    an empty result.
    """
    d = only(docs, doc_id="long", text="string")
    # null texts are kept apart: the key of each is its id
    key = F.when(F.col("text").isNotNull(), F.md5("text")).otherwise(F.concat(F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = d.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("rk"), "text", key.alias("text_key"))
    with small_batches(d.sparkSession):
        rows = stage(keyed.mapInArrow(_sketches, "no_id boolean, rk long, text_key string, bands array<long>, shingles array<int>"), "dart-bands")
    # one node for each different text
    at = F.struct("no_id", "rk")
    first = rows.groupBy("text_key").agg(F.min(at).alias("at"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    nodes = stage(first.withColumn("node", F.monotonically_increasing_id()), "dart-nodes")
    members = _members(nodes)
    pairs = stage(members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "dart-pairs")
    sought = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sought = nodes.join(sought, "node").select("node", "text_key", "at.no_id", "at.rk")
    own = rows.select("no_id", "rk", "text_key", "shingles").join(sought, ["no_id", "rk", "text_key"])
    sets = stage(own.select("node", "shingles").dropDuplicates(["node"]), "dart-sets")
    tested = stage(_verified(pairs, sets), "dart-tested")
    links = tested.where(F.col("similarity") >= min_similarity).select("a", "b")
    comp = stage(components(nodes, links), "dart-classes")
    late = _across(members, tested, comp, sets, min_similarity)
    if late.limit(1).count():
        discard(comp)
        comp = stage(components(nodes, links.union(late)), "dart-classes")
    discard(members, pairs, sets, tested, late)
    classed = stage(nodes.join(comp, "node").select("text_key", "at", "copies", "comp"), "dart-classed")
    total = classed.groupBy("comp").agg(F.min(F.struct("at", "text_key")).alias("first"), F.sum("copies").alias("class_size"))
    of_text = stage(spread_join(classed.select("text_key", "comp"), total, ["comp"], "text_key").drop("comp"), "dart-texts")
    out = rows.select("no_id", "rk", "text_key").join(of_text, "text_key").select(
        F.when(~F.col("no_id"), F.col("rk")).alias("doc_id"), "text_key",
        F.when(~F.col("first.at.no_id"), F.col("first.at.rk")).alias("class_id"),
        "class_size",
        ((at == F.col("first.at")) & (F.col("text_key") == F.col("first.text_key"))).alias("kept"),
    )
    out = stage(out, "dart-told")
    discard(rows, nodes, comp, classed, of_text)
    return out


def deduplicate(docs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Columns of docs, one row of each class; null texts stay."""
    key = F.when(F.col("text").isNotNull(), F.md5(F.col("text").cast("string"))).otherwise(F.concat(F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    who = lambda i: [F.col(i).isNull().alias("__none"), F.coalesce(F.col(i).cast("long"), F.lit(0)).alias("__rk")]
    kept = near_duplicates(docs, min_similarity).where("kept").select(*who("doc_id"), F.col("text_key").alias("__key"))
    keep = stage(kept.groupBy("__none", "__rk", "__key").agg(F.count("*").alias("__n")), "dart-keep")
    out = docs.select("*", *who("doc_id"), key.alias("__key")).join(keep, ["__none", "__rk", "__key"])
    if keep.where("__n > 1").limit(1).count():  # rows that repeat id and text: one of them stays
        out = out.dropDuplicates(["__none", "__rk", "__key"])
    return out.select(*docs.columns)
