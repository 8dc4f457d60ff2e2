"""Fill-in-middle transformation.

A text is a row of units: code points, or what a pattern matches.  Units are
matched in runs of RUN, left to right, and the runs are exploded with their
place; running sums of their lengths over a document give each run its offset.
A document asks for two cuts by unit ordinal.  All runs but the last are full, so
an ordinal names its run, and requests meet runs by an equal join; the offsets
are gathered by document and the text is cut by substring.

What is shuffled for the sums is a few numbers for each thousand units; texts
move once, to meet their offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only

#: Units other than code points; each takes what stands before it, so that
#: units follow each other without gaps.
WORDS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
LINES = r"[^\n]*\n|[^\n]+"
RUN = 1024

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents so many are transformed, and of a hundred of these so
#: many have the suffix first.
RATE, SUFFIX_FIRST = 90, 20


def draws(seed: int) -> list[Column]:
    """Four numbers of 32 bits by doc_id (a null id counts as no digits)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def unit_runs(d: DataFrame, unit: str | None) -> DataFrame:
    """key, run, units, chars of key, text: the runs of every text, in order."""
    one = unit or r"(?s:.)"
    runs = d.select("key", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?:{one}){{1,{RUN}}}+"), F.lit(0))).alias("run", "piece"))
    chars = F.char_length("piece").cast("long")
    units = chars if unit is None else F.regexp_count("piece", F.lit(unit)).cast("long")
    return runs.select("key", "run", units.alias("units"), chars.alias("chars"))


def cut_offsets(d: DataFrame, unit: str | None, first: Column, second: Column) -> DataFrame:
    """key, n, cuts (an array of two: start and chars of the run, units of it that
    lie before the cut) of key, doc_id, text.  The cuts fall after the smaller
    and the larger of the two draws modulo n + 1."""
    runs = unit_runs(d, unit).repartition("key").dropDuplicates(["key", "run"])  # rows that repeat have the same runs
    summed = runs.selectExpr(
        "*", "coalesce(sum(chars) over (partition by key order by run rows between unbounded preceding and 1 preceding), 0L) start", "sum(units) over (partition by key) n"
    )
    ids = d.select("key", first.alias("h1"), second.alias("h2")).repartition("key").dropDuplicates(["key"])
    places = [f(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)) for f in (F.least, F.greatest)]
    requests = summed.where("run = 0").select("key", "n").join(ids, "key").select("key", "n", F.posexplode(F.array(*places)).alias("cut", "ordinal"))
    requests = requests.withColumn("run", F.expr(f"cast(greatest(ordinal - 1, 0) div {RUN} as int)"))
    met = requests.join(summed.select("key", "run", "start", "chars"), ["key", "run"])
    at = F.struct("cut", "start", "chars", (F.col("ordinal") - F.col("run") * RUN).alias("within"))
    return met.groupBy("key").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(at)).alias("cuts"))


def fill_in_middle(docs: DataFrame, unit: str | None = None, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row.

    n counts units; form is plain, psm or spm; the two lengths are code points,
    null if plain.  A null text counts as empty; a text without a unit, and one that holds
    a marker, is plain.  What no unit matches at a text's end goes to the suffix.
    Rows that repeat have the same result; a row without an id draws as if its id
    had no digits.  An empty table gives an empty result.
    """
    d = only(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("key", F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), "text"))))
    h1, h2, h3, h4 = draws(seed)
    offsets = cut_offsets(d, unit, h1, h2)
    both = d.join(offsets.hint("shuffle_hash"), "key", "left")

    def offset(k: int) -> Column:
        cut = F.col("cuts")[k]
        if unit is None:
            return cut["start"] + cut["within"]
        run = F.substr(F.col("text"), (cut["start"] + 1).cast("int"), cut["chars"].cast("int"))
        return cut["start"] + F.char_length(F.array_join(F.slice(F.regexp_extract_all(run, F.lit(unit), F.lit(0)), F.lit(1), cut["within"].cast("int")), ""))

    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = marked | (h3 % 100 >= RATE) | F.col("cuts").isNull()
    form = F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    cut = both.select("doc_id", "text", F.coalesce("n", F.lit(0)).cast("long").alias("n"), form.alias("form"), offset(0).alias("a"), offset(1).alias("b"))

    def part(start: Column, length: Column) -> Column:
        return F.substr(F.col("text"), (start + 1).cast("int"), length.cast("int"))

    prefix, middle = part(F.lit(0), F.col("a")), part(F.col("a"), F.col("b") - F.col("a"))
    suffix = part(F.col("b"), F.char_length("text"))
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix)
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.concat(F.when(F.col("form") == "spm", spm).otherwise(psm), F.lit(MIDDLE), middle))
    shown = F.col("form") != "plain"
    return cut.select("doc_id", "n", "form", F.when(shown, F.col("a")).alias("prefix_chars"), F.when(shown, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restore(form: Column, output: Column) -> Column:
    """The text that an output was made of.  A marker's place is sure: no text
    that is cut holds one, and none arises where a part and a marker meet."""
    middle = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)  # up to the middle's marker

    def halves(second: str) -> tuple[Column, Column]:
        return F.substr(F.substring_index(head, second, 1), F.lit(len(PREFIX) + 1)), F.substring_index(head, second, -1)

    (prefix, suffix), (late, early) = halves(SUFFIX), halves(PREFIX)
    return F.when(form == "plain", output).when(form == "spm", F.concat(early, middle, late)).otherwise(F.concat(prefix, middle, suffix))
