"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target
and the raw corpus.

Features are the byte n-grams of a text (its words joined by one space), hashed
to a fixed number of buckets, and, as one feature more, word bigrams of a word
with itself.  Two multinomials over the buckets are counted:
of all documents, and of those that are trusted.  A document's score is the
mean over its n-grams of log p_target - log p_raw; it passes if that is at least
a threshold, the same for every document.  Base rules come first: too few words,
or too much repeated.

The threshold is where the trusted documents end: each is scored by a target of
the other half of them, and from their first percentile half its distance to
the median, and a margin for their number, are taken off.  So few trusted
documents condemn little, and as many as there are decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, only, stage, window_hashes

BUCKETS = 1 << 16
#: The feature of a word that follows itself.
SAME_WORD = BUCKETS
FEATURES = BUCKETS + 1
#: Scores that are put together at most when a quantile is sought, and bins that
#: their range is cut into while there are more.
FEW, BINS = 10_000, 1024
#: Bits, as a power of two, of the map of trusted ids that texts pass before they are joined.
ID_BITS = 24
#: Width of the n-grams in bytes.
NGRAM = 4
#: The target is smoothed by the raw corpus, as if it had this share of n-grams
#: more: no ratio is infinite, and the least is ln(0.3 / 1.3) at any size.
PRIOR_SHARE = 0.3
#: Of the threshold: the quantile of trusted scores it starts at, the part of
#: the distance to the median, and the margin times their number.
QUANTILE, SPREAD, MARGIN = 0.01, 0.25, 6.0
#: Texts whose n-grams are counted together.
CHUNK = 64
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def ngram_buckets(words: list[bytes]) -> np.ndarray:
    """Feature of each n-gram and of each repeated word."""
    same = np.full(sum(map(bytes.__eq__, words, words[1:])), SAME_WORD, np.int64)
    b = np.frombuffer(b" ".join(words), np.uint8).astype(np.uint32)
    n = len(b) - NGRAM + 1
    if n <= 0:
        return same
    h = np.zeros(n, np.uint32)
    for k in range(NGRAM):
        h = (h << np.uint32(8)) | b[k : k + n]
    h *= np.uint32(0x9E3779B1)
    return np.concatenate([(h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), same])


def repeated_words(words: list[bytes], width: int = REPEAT_WINDOW) -> int:
    """Words inside windows of `width` words that occur twice or more."""
    n = len(words)
    if n <= width:
        return 0
    hashes = window_hashes(np.fromiter(map(hash, words), np.int64, n).view(np.uint64), width)
    hashes.sort()
    if (hashes[1:] != hashes[:-1]).all():  # no two windows are equal
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    span = 1
    while span < width:  # ranks of windows of 2, 4, 8 words: exact, no hashes
        pair = rank[:-span] * (int(rank.max()) + 1) + rank[span:]
        rank = np.unique(pair, return_inverse=True)[1]
        span *= 2
    many = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(many), 1)
    np.add.at(edge, np.flatnonzero(many) + width, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def base_columns(text: str | None, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    blank = sum(text.count(c) for c in " \t\n\v\f\r")
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), len(text) - blank, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def trusted_ids(trusted: DataFrame) -> DataFrame:
    """doc_id, fold (0 or 1) of all trusted documents."""
    good = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return good.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))


def _id_place() -> Column:
    return F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - ID_BITS)


def maybe_trusted(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts whose doc_id may be one of ids: all that are, and of the
    others as many as the map of 2^ID_BITS bits has bits set."""
    word = F.shiftright(_id_place(), 6)
    set_bits = ids.select(word.alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(doc_id), {64 - ID_BITS}) & 63 as int))").alias("bit"))
    known = np.zeros(1 << (ID_BITS - 6), np.int64)
    for r in set_bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # 2^ID_BITS / 64 rows at most
        known[r["word"]] = r["bits"]

    def may_be(place: pd.Series) -> pd.Series:
        at = place.to_numpy(np.int64)
        return pd.Series((known[at >> 6] >> (at & 63)) & 1 == 1)

    return texts.where(F.pandas_udf(may_be, T.BooleanType())(_id_place()))


def trusted_texts(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text, fold of the trusted documents.  The join is the same whatever
    the number of ids, and what it shuffles is little more than their texts."""
    return maybe_trusted(texts, ids).join(ids.hint("merge"), "doc_id")


def ngram_counts(docs: DataFrame, good: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket of the raw corpus, and of both folds of the trusted
    (good: text and fold).

    Each task sums its own rows first, so what is shuffled is a row for each
    bucket and task; the result is three arrays of FEATURES numbers, whatever
    the corpus.
    """
    marked = only(docs, text="string").withColumn("fold", F.lit(2)).unionByName(good.select("text", "fold"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((3, FEATURES), np.int64)  # both folds, and all documents
        for rows in batches:
            for at in range(0, len(rows), CHUNK):
                found = [ngram_buckets(words_of(x)) for x in rows["text"].iloc[at : at + CHUNK]]
                folds = rows["fold"].iloc[at : at + CHUNK].to_numpy()
                for k in np.unique(folds):
                    sums[k] += np.bincount(np.concatenate([x for x, f in zip(found, folds) if f == k]), minlength=FEATURES)
        at = np.flatnonzero(sums.any(axis=0))
        yield pd.DataFrame({"bucket": at, "raw": sums[2, at], "a": sums[0, at], "b": sums[1, at]})

    parts = marked.mapInPandas(count, "bucket long, raw long, a long, b long")
    raw, folds = np.zeros(FEATURES), np.zeros((2, FEATURES))
    for r in parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", "a", "b")]).collect():
        raw[r["bucket"]], folds[:, r["bucket"]] = r["raw"], (r["a"], r["b"])
    return raw, folds


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw by bucket; zeros if nothing is trusted."""
    total = target.sum()
    if not total:
        return np.zeros(len(raw))
    q = np.maximum(raw, 1) / raw.sum()  # what the corpus lacks is never looked up
    return np.log((target / total + PRIOR_SHARE * q) / (1 + PRIOR_SHARE) / q)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def fitted_threshold(good: DataFrame, raw: np.ndarray, folds: np.ndarray) -> float:
    """Where the scores of trusted documents (doc_id, text, fold) that pass the
    base rules end; none (minus infinity) if a fold has no n-grams."""
    if not folds.sum(axis=1).all():
        return float("-inf")
    other = [log_ratios(raw, folds[1]), log_ratios(raw, folds[0])]  # each fold is scored by the other

    def judge(texts: pd.Series, fold: pd.Series) -> pd.Series:
        out = []
        for text, k in zip(texts, fold):
            words = words_of(text)
            out.append(None if base_failed(len(words), repeated_words(words)) else score(words, other[k]))
        return pd.Series(out, dtype="float64")

    scores = good.select("doc_id", F.pandas_udf(judge, T.DoubleType())("text", "fold").alias("s")).where("s is not null")
    scores = stage(scores.groupBy("doc_id").agg(F.min("s").alias("s")).select("s"), "quality-scores")
    n = scores.count()
    if n:
        low, median = (quantile(scores, q, n) for q in (QUANTILE, 0.5))
    discard(scores)
    return low - SPREAD * (median - low) - MARGIN / n if n else float("-inf")


def at_rank(scores: DataFrame, rank: int) -> float:
    """The value s of a rank from 0, exactly.  While there are more than FEW the
    range is cut into bins, which are counted, and the one with the rank is kept."""
    while True:
        n, low, high = scores.agg(F.count("*"), F.min("s"), F.max("s")).first()
        if n <= FEW or low == high:
            return low if low == high else sorted(r["s"] for r in scores.collect())[rank]  # FEW rows at most
        place = F.least(F.floor((F.col("s") - low) / (high - low) * BINS), F.lit(BINS - 1))
        for at, count in sorted(tuple(r) for r in scores.groupBy(place.alias("at")).agg(F.count("*")).collect()):  # BINS rows
            if rank < count:
                break
            rank -= count
        scores = scores.where(place == at)


def quantile(scores: DataFrame, q: float, n: int) -> float:
    """Of n values s, between the two that are next to the quantile."""
    place = (n - 1) * q
    below = at_rank(scores, int(place))
    return below + (place - int(place)) * (at_rank(scores, min(int(place) + 1, n - 1)) - below) if place % 1 else below


def score(words: list[bytes], ratios: np.ndarray) -> float:
    at = ngram_buckets(words)
    return float(ratios[at].mean()) if len(at) else 0.0


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float | None = None) -> DataFrame:
    """All columns of docs, and n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, llr, kept under these names (columns of docs
    that bear them are replaced; `verdicts` keeps them).

    trusted: doc_id of documents of the trusted target; ids that are null or
    not in docs count for nothing.  threshold: a fixed one in place of the
    fitted.  A null or empty text has no words and fails the base rules.  If
    nothing is trusted every score is 0 and the base rules alone decide.  Rows
    that repeat are judged each for itself; an empty table gives an empty
    result.
    """
    out = verdicts(docs, trusted, threshold)
    return out.withColumns({c: F.col(f"__quality.{c}") for c in (*NUMBERS, "llr", "base_failed", "kept")}).drop("__quality")


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def verdicts(docs: DataFrame, trusted: DataFrame, threshold: float | None = None) -> DataFrame:
    """docs as they are, and a column __quality of what quality_rules tells."""
    ids = stage(trusted_ids(trusted), "quality-trusted")
    good = stage(trusted_texts(only(docs, doc_id="long", text="string"), ids), "quality-texts")  # read twice
    raw, folds = ngram_counts(docs, good)
    ratios = log_ratios(raw, folds.sum(axis=0))
    least = fitted_threshold(good, raw, folds) if threshold is None else threshold
    discard(good, ids)

    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = words_of(text)
            numbers = base_columns(text, words)
            failed, llr = base_failed(numbers[0], numbers[-1]), score(words, ratios)
            rows.append((*numbers, llr, failed, not failed and llr >= least))
        return pd.DataFrame(rows, columns=[*NUMBERS, "llr", "base_failed", "kept"])

    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in NUMBERS], T.StructField("llr", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    return docs.withColumn("__quality", F.pandas_udf(judge, schema)(F.col("text").cast("string")))
