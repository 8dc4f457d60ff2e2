"""Secret scans, in DataFrame functions alone.

Three patterns find what is plainly a secret.  The method adds strings that
look random: a candidate is a run of 20 or more characters of a base-64
alphabet with a letter and a digit.  Its encoding (hex, base 32, base 36, base
62, base 64) is inferred from its characters, separators between groups aside.
A battery of three tests looks at it in that encoding: chi-squared uniformity of
the alphabet, runs about the median, serial correlation; each has its exact
moments for the length.

Two questions are put to the battery.  Is the string as random data would be?
Fisher's combination of the three two-sided p-values says no if it is below
TEST_LEVEL.  Could it be natural?  There characters are as frequent as in the
corpus (counted over all documents without their candidates, case aside where
the encoding has one), which repeats them more often than random data, and clusters them; the three scores,
one-sided and combined by Stouffer's rule, give the p-value of a natural string
of that length.  The Benjamini-Hochberg rule over all candidates of the corpus
then holds the share of false discoveries, so that a short string needs to be
more even than a long one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, only, stage

# fixed values of the contract
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 characters or more
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Characters of an encoding; those of one case stand for both where a string
#: keeps to one case.
ENCODINGS = {16: "0123456789abcdef", 32: "abcdefghijklmnopqrstuvwxyz234567", 36: "abcdefghijklmnopqrstuvwxyz0123456789"}
ONE_CASE = ENCODINGS[36]
MIXED_CASE = ONE_CASE + ONE_CASE[:26].upper()
SIZES = (16, 32, 36, 62, 64)
#: Share of random strings that the battery takes for not random.
TEST_LEVEL = 0.001
#: Weights of uniformity, runs and serial correlation in Stouffer's rule.
WEIGHTS = (2.0, 1.0, 1.0)
#: Share of false discoveries among the strings that the method adds.
FALSE_DISCOVERIES = 0.05
#: p-values are counted in steps of a twentieth of a power of ten, down to 10^-100.
STEPS, LAST_STEP = 20, 2000


EMPTY = "cast(array() as array<struct<start: int, kind: int, end: int>>)"


def _placed(text: Column, found: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end>> of the matches found, in code points:
    they stand between the parts that a split at the pattern leaves."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    pair = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))

    def add(spans: Column, x: Column) -> Column:
        start = F.when(F.size(spans) > 0, F.element_at(spans, -1)["end"]).otherwise(F.lit(0)) + x["gap"]
        return F.concat(spans, F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["size"]).alias("end"))))

    return F.aggregate(pair, F.expr(EMPTY), add)


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the matches of which the group is long enough."""

    def of(found: Column) -> Column:
        spans = _placed(text, found, pattern, kind)
        if group:
            kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
            spans = F.transform(F.filter(F.arrays_zip(spans.alias("s"), kept.alias("k")), lambda x: F.length(x["k"]) >= least), lambda x: x["s"])
        return F.when(F.size(found) > 0, spans).otherwise(F.expr(EMPTY))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def natural_moments(texts: DataFrame) -> dict[int, tuple[float, float]]:
    """By encoding, the sums of squared and of cubed frequencies of its
    characters in all texts, candidates left out (and as if each were there once
    more).  texts: text."""
    symbols = MIXED_CASE + "+/"
    times = lambda t: F.array(*[F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit(""))) for c in symbols])
    # exploded, so that the array, and the text without candidates, is made once for each text
    each = texts.where("text <> ''").select(F.posexplode(let(F.regexp_replace("text", CANDIDATE, ""), times)).alias("at", "n"))
    count = dict.fromkeys(symbols, 0) | {symbols[r["at"]]: r["n"] for r in each.groupBy("at").agg(F.sum("n").alias("n")).collect()}
    out = {}
    for size in SIZES:
        if size in ENCODINGS:
            n = [1 + count[c] + (count[c.upper()] if c.isalpha() else 0) for c in ENCODINGS[size]]
        else:
            n = [1 + count[c] for c in MIXED_CASE + "+/" * (size == 64)]
        out[size] = (sum((x / sum(n)) ** 2 for x in n), sum((x / sum(n)) ** 3 for x in n))
    return out


def uniform_moments(size: int) -> tuple[float, float]:
    return 1 / size, 1 / size**2


def alphabet_size(token: Column) -> Column:
    return (
        F.when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 16)
        .when(token.rlike("^(?:[A-Z2-7]+|[a-z2-7]+)$"), 32)
        .when(token.rlike("^(?:[A-Z0-9]+|[a-z0-9]+)$"), 36)
        .when(token.rlike("^[A-Za-z0-9]+$"), 62)
        .otherwise(64)
    )


def randomness_step(token: Column, natural: dict[int, tuple[float, float]]) -> Column:
    """How small the p-value of a candidate is as a natural string, in STEPS a
    power of ten; 0 if the battery finds that it isn't random."""
    bare = F.regexp_replace(token, "[-_]", "")
    return let(bare, lambda t: let(_codes(t), lambda c: _step(t, c, natural)))


def _codes(token: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(token), F.lit(1))), lambda i: F.ascii(F.substring(token, i, F.lit(1))))


def _sum(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + f(x))


def _step(token: Column, codes: Column, natural: dict[int, tuple[float, float]]) -> Column:
    n, size = F.length(token), alphabet_size(token)
    squares = _sum(F.array_distinct(codes), lambda c: F.pow(F.size(F.filter(codes, lambda x: x == c)), F.lit(2.0)))
    middle = F.element_at(F.array_sort(codes), (n / 2).cast("int") + 1)
    mean = _sum(codes, lambda c: c) / n
    by_size = lambda moments, k: F.element_at(F.array(*[F.lit(float(moments(s)[k])) for s in SIZES]), F.array_position(F.array(*[F.lit(s) for s in SIZES]), size).cast("int"))
    known = F.struct(
        n.cast("double").alias("n"), ((squares - n) / 2).alias("pairs"), middle.alias("middle"), mean.alias("mean"),
        *[by_size(natural.get, k).alias(f"natural{k}") for k in (0, 1)], *[by_size(uniform_moments, k).alias(f"uniform{k}") for k in (0, 1)],
    )
    return let(known, lambda k: let(_battery(codes, k), _verdict))


def _battery(codes: Column, k: Column) -> Column:
    """struct of z-scores: even (of uniformity, for random data), natural (the
    same, for natural strings), runs (positive: too few), serial."""
    n = k["n"]
    low = _sum(codes, lambda c: F.when(c < k["middle"], 1.0).otherwise(0.0))
    mean_runs = low * (n - low) * 2 / n + 1
    ends = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    runs = _sum(ends, lambda p: F.when((p["a"] < k["middle"]) != (p["b"] < k["middle"]), 1.0).otherwise(0.0)) + 1
    spread = _sum(codes, lambda c: F.pow(c - k["mean"], F.lit(2.0)))
    serial = _sum(ends, lambda p: (p["a"] - k["mean"]) * (p["b"] - k["mean"])) / spread
    valid = (spread > 0) & (mean_runs > 2) & (n > 2)
    return F.when(
        valid,
        F.struct(
            _evenness(k["pairs"], n, k["uniform0"], k["uniform1"]).alias("even"),
            _evenness(k["pairs"], n, k["natural0"], k["natural1"]).alias("natural"),
            ((mean_runs - runs) / F.sqrt((mean_runs - 1) * (mean_runs - 2) / (n - 1))).alias("runs"),
            ((serial + 1 / n) / ((n - 2) / (n * F.sqrt(n - 1)))).alias("serial"),
        ),
    )


def _evenness(pairs: Column, n: Column, squares: Column, cubes: Column) -> Column:
    """z-score of the number of pairs of equal characters, which is chi-squared
    up to scale, where characters have frequencies with these sums of squares
    and cubes: exact mean and variance, and the cube root against the skew."""
    mean = n * (n - 1) / 2 * squares
    variance = n * (n - 1) / 2 * (squares - squares * squares) + n * (n - 1) * (n - 2) * F.greatest(cubes - squares * squares, F.lit(0.0))
    shape = mean * mean / variance
    return (F.pow(pairs / mean, F.lit(1 / 3)) - 1 + 1 / (9 * shape)) * 3 * F.sqrt(shape)


def log_tail(z: Column) -> Column:
    """ln of the normal distribution's upper tail at z (Boerjesson and Sundberg,
    1979; within 0.3 %)."""
    x = F.abs(z)
    tail = -x * x / 2 - F.log((x * 0.661 + F.sqrt(x * x + 5.51) * 0.339) * 2.5066282746310002)
    return F.when(z >= 0, tail).otherwise(F.log1p(-F.exp(tail)))


def _verdict(z: Column) -> Column:
    two_sided = lambda c: F.least(log_tail(F.abs(z[c])) + 0.6931471805599453, F.lit(0.0))
    half = -(two_sided("even") + two_sided("runs") + two_sided("serial"))  # half of Fisher's statistic
    random = F.exp(-half) * (1 + half + half * half / 2)  # chi-squared with six degrees
    a, b, c = WEIGHTS
    together = (z["natural"] * a + z["runs"] * b + z["serial"] * c) / (a * a + b * b + c * c) ** 0.5
    step = F.floor(-log_tail(-together) / F.log(F.lit(10.0)) * STEPS)
    return F.when(z.isNotNull() & (random >= TEST_LEVEL), F.least(step, F.lit(LAST_STEP))).otherwise(0).cast("int")


def discovery_step(steps: DataFrame, level: float = FALSE_DISCOVERIES) -> int:
    """Benjamini-Hochberg: the least step at which candidates count as found.
    steps: step.  They are counted by step, so LAST_STEP + 1 rows are ranked."""
    counts = steps.groupBy("step").agg(F.count("*").alias("n"))
    ranked = counts.selectExpr("step", "sum(n) over (order by step desc) as so_far", "sum(n) over () as m")
    p = F.pow(F.lit(10.0), -F.col("step") / STEPS)
    return ranked.where(p <= F.col("so_far") / F.col("m") * level).agg(F.coalesce(F.min("step"), F.lit(LAST_STEP + 1))).first()[0]


def find_secrets(docs: DataFrame, level: float = FALSE_DISCOVERIES) -> DataFrame:
    """doc_id, secrets array<struct<start, kind, end>> in order, for every row.

    kind is the place in KINDS.  Starts and ends are code points.  What the
    method adds never overlaps what a pattern found.  A null or empty text has
    no secrets; rows that repeat are scanned each for itself; an empty table
    gives an empty result; other columns fall away.
    """
    d = only(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    token = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    base = F.concat(_spans(text, ASSIGN, 0, 2, MIN_ASSIGNED), _spans(text, ACCESS, 1), _spans(text, HEX, 2))
    clear = lambda s, base: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    mixed = lambda s: token(s).rlike("[0-9]") & token(s).rlike("[A-Za-z]")
    natural = natural_moments(d)
    scored = lambda s: F.struct(s.alias("span"), let(token(s), lambda t: randomness_step(t, natural)).alias("step"))
    candidates = F.filter(_spans(text, CANDIDATE, 3), mixed)
    both = let(base, lambda b: F.struct(b.alias("base"), F.transform(F.filter(candidates, lambda s: clear(s, b)), scored).alias("tokens")))
    d = d.select("doc_id", both.alias("f")).select("doc_id", "f.base", "f.tokens")
    found = stage(d, "secret-spans")
    cut = discovery_step(found.select(F.explode("tokens").alias("t")).select("t.step"), level)
    added = F.transform(F.filter("tokens", lambda t: t["step"] >= cut), lambda t: t["span"])
    return found.select("doc_id", F.array_sort(F.concat("base", added)).alias("secrets"))


def secret_digest(found: DataFrame) -> DataFrame:
    """The columns of the contract."""
    names = F.array(*[F.lit(k) for k in KINDS])
    as_text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(as_text(base), 256).alias("base_sha256"),
        as_text(F.col("secrets")).alias("spans"),
    )
