"""Benchmark decontamination by template canonicalisation.

Words become templates: numbers, units, quantities and names turn into typed
placeholders, other words into their lower-case core; the words behind the
placeholders are the slots.  Windows of templates are hash-joined between
documents and benchmark items.  Matches of one document and item on one
diagonal are aligned.  Numbers and units are values, free to change or coincide
at each place; names must map one to one, so windows that contradict the
alignment's mapping of names are dropped, and only those: a question with other
numbers or names matches, a text in which one name stands for two doesn't.
Beside this, windows of the case-folded words themselves are joined: there all
windows count, whatever their slots, and a short item is one window.
A document is contaminated by an item if windows of either kind cover enough of
it, or if it holds a long verbatim run of it.

The windows of documents pass a bitmap of the items' window hashes first.  It
has a fixed size, so it is sent to every task whatever the benchmark; what it
lets through is joined exactly.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, only, stage, window_hashes

WINDOW = 8
#: Items shorter than this many words are sought verbatim only.
MIN_TEMPLATE_WORDS = 5
#: Share of an item's windows that must be found.
MIN_COVERAGE = 0.4
#: So many words of an item in a row are a leak, whatever share they are.
VERBATIM_RUN = 20
BITMAP_BITS = 24
#: Sets the hashes of windows of words apart from those of templates.
EXACT = 1 << 32

PLAIN, TITLE, NUMBER, UNIT, QUANTITY, SKIP = range(6)
NAME = TITLE
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„…–—¿¡·•"
_CLOSING = "\"#$%&'()*]»”’|"
# fixed values: units of measure and their words
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l dl cl gal s sec min h hr hrs ms kmh mph kph hz khz mhz ghz w kw mw v a j kj cal kcal pa bar k c f "
    "meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters millimeter millimeters mile miles foot feet inch inches yard yards "
    "gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros degree degrees".split()
)
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?\Z", re.I)
_QUANTITY = re.compile(r"[+-]?\d[\d.,]*([a-z]+)\Z", re.I)
_WORD_NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion".split())


class Templates(dict):
    """Word (bytes) to a packed number: hash, whether a sentence ends, kind."""

    BOUND = 1 << 17

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.BOUND:
            self.clear()
        raw = word.decode("utf-8", "surrogatepass")
        core = raw.strip(_PUNCTUATION)
        low = core.casefold()
        if not core:
            kind = SKIP
        elif low in _WORD_NUMBERS or (core[0].isdigit() and _NUMBER.match(core)):
            kind = NUMBER
        elif low in UNITS and len(low) > 1:
            kind = UNIT
        elif core[0].isdigit() and (q := _QUANTITY.match(core)) and q[1].lower() in UNITS:
            kind = QUANTITY
        elif core[0].isupper() and core[1:].islower():
            kind = TITLE
        else:
            kind = PLAIN
        ends = raw.rstrip(_CLOSING).endswith((".", "!", "?"))
        packed = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")) & ~15 | ends << 3 | kind
        self[word] = packed
        return packed


def templates(text: str | None, cache: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word that isn't mere punctuation: template hash, hash of the
    word itself (odd for a name), and whether it is a slot."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    packed = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    packed = packed[(packed & np.uint64(7)) != SKIP]
    kind = (packed & np.uint64(7)).astype(np.int64)
    opens = np.ones(len(packed), bool)
    opens[1:] = (packed[:-1] & np.uint64(8)) > 0
    kind[(kind == TITLE) & opens] = PLAIN  # any word that opens a sentence may have a capital
    core = packed >> np.uint64(4)
    slot = kind != PLAIN
    return np.where(slot, mix64(kind.astype(np.uint64)), core), core << np.uint64(1) | (kind == NAME), slot


class Windows(NamedTuple):
    """The windows of one width of a text: position, hash, whether it is one of
    the words themselves and not of templates, whether at least half of it is no
    slot; and the words and slots of the text."""

    width: int
    pos: np.ndarray
    h: np.ndarray
    exact: np.ndarray
    plain: np.ndarray
    core: np.ndarray
    slot: np.ndarray


def windows(text: str | None, widths: list[int], cache: Templates) -> list[Windows]:
    """For each width the windows of the words, and the windows of templates of
    which at least half is no slot (widths below MIN_TEMPLATE_WORDS have none)."""
    template, core, slot = templates(text, cache)
    plain = np.concatenate([[0], np.cumsum(~slot)])
    out = []
    for width in widths:
        exact = window_hashes(core >> np.uint64(1), width)
        n = len(exact)
        half = 2 * (plain[width:] - plain[:-width]) >= width if n else np.zeros(0, bool)
        half &= width >= MIN_TEMPLATE_WORDS
        at = np.flatnonzero(half)
        h = np.concatenate([mix64(exact + np.uint64(EXACT + width)), mix64(window_hashes(template, width)[at] + np.uint64(width))])
        kind = np.arange(n + len(at)) < n
        out.append(Windows(width, np.concatenate([np.arange(n), at]), h, kind, np.concatenate([half, half[at]]), core, slot))
    return out


def _rows(found: list[Windows], pick) -> Iterator[tuple[int, int, bool, bool, list[int]]]:
    """Position, hash, exact, plain, slots of the windows whose hashes `pick` takes."""
    for w in found:
        for i in np.flatnonzero(pick(w.h)):
            k = w.pos[i]
            slots = w.core[k : k + w.width][w.slot[k : k + w.width]] if not w.exact[i] else w.core[:0]
            yield int(k), int(w.h[i].astype(np.int64)), bool(w.exact[i]), bool(w.plain[i]), slots.astype(np.int64)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, width, n_windows, n_plain, pos, h, exact, plain, slots.  An item
    shorter than WINDOW is one window."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Templates()
        for rows in batches:
            out = []
            for item, text in zip(rows["item_id"], rows["text"]):
                n = len(templates(text, cache)[0])
                width = min(WINDOW, n)
                if not width:
                    continue
                mine = list(_rows(windows(text, [width], cache), lambda h: np.ones(len(h), bool)))
                n_windows = n - width + 1
                out += [(item, width, n_windows, len(mine) - n_windows, *r) for r in mine]
            yield pd.DataFrame(out, columns=["item_id", "width", "n_windows", "n_plain", "pos", "h", "exact", "plain", "slots"])

    items = only(benchmark, item_id="long", text="string").where("item_id is not null").distinct()
    return items.mapInPandas(cut, "item_id long, width int, n_windows long, n_plain long, pos long, h long, exact boolean, plain boolean, slots array<long>")


def consistent_windows(found: list[tuple[int, tuple[int, ...], tuple[int, ...]]]) -> tuple[list[int], int]:
    """Of the windows of an alignment (position, slots of the item, slots of the
    document), the positions of those that don't contradict its mapping of
    names, and how many different slots are changed in them.

    A name of the item maps to its most frequent partner, itself if in doubt,
    and to none if that is the partner of another name too.  A name that stays
    as it is contradicts nothing.
    """
    partners: dict[int, Counter] = defaultdict(Counter)
    for _, a, b in found:
        for x, y in zip(a, b):
            if x & 1:
                partners[x][y] += 1
    maps = {x: max(c, key=lambda y: (c[y], y == x, y)) for x, c in partners.items()}
    claims = Counter(maps.values())
    free = {(x, y) for x, y in maps.items() if claims[y] == 1}
    kept = [(p, a, b) for p, a, b in found if all(x == y or not x & 1 or (x, y) in free for x, y in zip(a, b))]
    return [p for p, _, _ in kept], len({(x, y) for _, a, b in kept for x, y in zip(a, b) if x != y})


def longest_run(at: set[int], width: int) -> int:
    """Words of the longest run of consecutive windows."""
    best = run = 0
    for p in sorted(at):
        run = run + 1 if p - 1 in at else 1
        best = max(best, run)
    return best + width - 1 if at else 0


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """By alignment: the windows that count, those of the item's plain ones
    among them, the slots changed, and the longest verbatim run."""
    for rows in batches:
        out = []
        for width, each in zip(rows["width"], rows["windows"]):
            kept, changed = consistent_windows([(w["pos"], tuple(map(int, w["a"])), tuple(map(int, w["b"]))) for w in each if not w["exact"]])
            exact = {w["pos"] for w in each if w["exact"]}
            at = sorted(exact.union(kept))
            plain = {w["pos"] for w in each if w["plain"]}
            out.append(([{"pos": p, "plain": p in plain} for p in at], changed, longest_run(exact, width)))
        yield rows[["no_id", "rk", "text_key", "item_id", "n_windows", "n_plain"]].assign(at=[r[0] for r in out], changed=[r[1] for r in out], run=[r[2] for r in out])


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits set at the top BITMAP_BITS bits of the hashes; put together by
    bytes in Spark, 2^BITMAP_BITS / 8 of them at most."""
    bit = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    each = hashes.select(F.shiftright(bit, 3).alias("byte"), F.expr(f"shiftleft(1, cast(shiftrightunsigned(h, {64 - BITMAP_BITS}) & 7 as int))").alias("bit"))
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    got = each.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    out[got["byte"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, verbatim_run: int = VERBATIM_RUN) -> DataFrame:
    """doc_id, text_key, item_id, matched, n_windows, coverage, changed_slots, run:
    a row for each document and item that contaminates it.

    matched of n_windows is the greater of two shares: of all windows of the
    item, and of those of which at least half is no slot.  run is the longest
    verbatim run in words; coverage is below min_coverage if only it decides.
    text_key is the 64-bit hash of the document's text, which tells rows with
    one id, or none, apart.  Null and empty texts have no windows; items without
    an id are not sought, and of items that repeat id and text there is one.
    Rows that repeat give one row here.  An empty table on either side gives an
    empty result; other columns fall away.
    """
    items = stage(item_windows(benchmark), "leak-items")
    bits = _bitmap(items.select("h"))
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # WINDOW at most

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Templates()
        columns = ["no_id", "rk", "text_key", "doc_pos", "h", "doc_slots"]

        def known(h: np.ndarray) -> np.ndarray:
            at = (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
            return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

        for rows in batches:
            out = []
            for no_id, doc, key, text in zip(rows["no_id"], rows["rk"], rows["text_key"], rows["text"]):
                found = _rows(windows(text, widths, cache), known)
                out += [(no_id, doc, key, pos, h, slots) for pos, h, _, _, slots in found]
            yield pd.DataFrame(out, columns=columns)

    # ids ride in columns without nulls, which pandas would turn into floats
    d = only(docs, doc_id="long", text="string").select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("rk"), F.xxhash64("text").alias("text_key"), "text")
    found = d.mapInPandas(cut, "no_id boolean, rk long, text_key long, doc_pos long, h long, doc_slots array<long>")
    found = stage(found.distinct(), "leak-windows")
    who = ["no_id", "rk", "text_key", "item_id"]
    both = found.join(items, "h").withColumn("shift", F.col("doc_pos") - F.col("pos"))
    # a diagonal has as many windows as the item at most
    window = F.struct("pos", "exact", "plain", F.col("slots").alias("a"), F.col("doc_slots").alias("b"))
    of_item = [F.first(c).alias(c) for c in ("width", "n_windows", "n_plain")]
    aligned = both.groupBy(*who, "shift").agg(*of_item, F.collect_list(window).alias("windows")).drop("shift")
    counted = aligned.mapInPandas(_counted, "no_id boolean, rk long, text_key long, item_id long, n_windows long, n_plain long, at array<struct<pos: long, plain: boolean>>, changed long, run long")
    spots = counted.select(*who, "n_windows", "n_plain", "changed", "run", F.explode("at").alias("at"))
    most = [F.max(c).alias(c) for c in ("n_windows", "n_plain", "run")]
    spots = spots.groupBy(*who, "at").agg(*most, F.min("changed").alias("changed"))
    most = [F.max(c).alias(c) for c in ("n_windows", "n_plain", "run")]
    total = spots.groupBy(*who).agg(F.count("*").alias("all"), F.count_if("at.plain").alias("of_plain"), *most, F.min("changed").alias("changed_slots"))
    share = lambda matched, n: F.struct((F.col(matched) / F.col(n)).alias("coverage"), F.col(matched).alias("matched"), F.col(n).alias("n_windows"))
    best = F.greatest(share("all", "n_windows"), F.when(F.col("n_plain") > 0, share("of_plain", "n_plain")))
    total = total.select(*who, best.alias("best"), "changed_slots", "run")
    leaks = total.select(F.when(~F.col("no_id"), F.col("rk")).alias("doc_id"), "text_key", "item_id", "best.matched", "best.n_windows", "changed_slots", "best.coverage", "run")
    return leaks.where((F.col("coverage") >= min_coverage) | (F.col("run") >= verbatim_run))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, verbatim_run: int = VERBATIM_RUN) -> DataFrame:
    """The rows of docs that no item contaminates."""
    leaks = stage(find_leaks(docs, benchmark, min_coverage, verbatim_run).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct(), "leaks")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__key"))
    return docs.join(leaks, same, "left_anti")
