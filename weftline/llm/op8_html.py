"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score by where they stand (in a
link, heading, list item or plain; in a short or long block; inside a main
element, outside one, or on a page that has none), tags score below zero.  The
weights are log-odds of being inside the main text, counted on labelled pages.
One linear scan finds the contiguous region with the greatest sum.

Menus, headers, footers, sidebars, notices, adverts, forms and comments are no
part of that sequence.  Names alone don't decide which elements are such parts:
each element whose tag, role, class or id hints at one is judged by a logistic
model of its hints, its share of the page's words, its links, its length, and
whether it holds or stands in a main element; so a form or a div "has-sidebar"
around all of a page stays.  The model, too, is fitted on labelled pages.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from math import log
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only
from .labelled_pages import END, MAIN, labelled_page

#: Labelled pages that the weights are fitted on.
FIT_PAGES = 400
#: Added to each count when weights are fitted.
SMOOTHING = 1.0
#: No weight of a word is larger; a tag costs something between the other two.
WEIGHT_BOUND, LEAST_TAG_COST, MOST_TAG_COST = 4.0, 0.15, 1.5
#: Weight decay, step and rounds of the logistic fit.
DECAY, STEP, ROUNDS = 1e-3, 0.5, 600

# fixed values: names of HTML elements and of page parts
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|title|select|canvas|video|audio"
HINT_TAGS = frozenset("nav header footer aside form button dialog menu label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = BLOCKS - HEADINGS - frozenset("p li dt dd td th tr hr option html body head title".split()) | {"a", "button", "label", "span"}
PARTS = re.compile(
    r"(?:^|(?<=[\s_-]))(ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|paywall|"
    r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|widget|footer|header|masthead|toolbar|share|sharing|social|related|recommended|"
    r"newsletter|subscribe|signup|login|search|comments?|disqus|replies|respond|skip|copyright|legal|tags?)(?=$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_TOKEN = re.compile(
    rf"(?P<comment><!--.*?(?:-->|\Z))|<[!?][^>]*+(?:>|\Z)|<(?P<raw>{RAW})\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)|"
    r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^<>\"']|\"[^\"]*+\"|'[^']*+'|[\"'<](?=[^>]*+\Z))*+)(?:>|\Z)|<[/a-zA-Z][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|data-part)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Token(NamedTuple):
    kind: str  # text, space, break, tag or mark
    tag: str
    content: str
    where: str
    element: int


class Element:
    """A container: its hints, and what is in it."""

    __slots__ = ("hints", "in_main", "labelled", "links", "main", "parent", "words")

    def __init__(self, parent: int, hints: list[str], main: bool, in_main: bool, labelled: bool):
        self.parent, self.hints, self.main, self.in_main, self.labelled = parent, hints, main, in_main, labelled
        self.words = self.links = 0


class Model(NamedTuple):
    words: dict[str, float]
    parts: dict[str, float]


def _hints(tag: str, names: dict[str, str], in_main: bool) -> list[str]:
    out = [f"tag {tag}{' in main' * (in_main and tag == 'header')}"] if tag in HINT_TAGS else []
    if (role := names.get("role", "").lower()) in ROLES:
        out.append(f"role {role}")
    for value in {names.get("class", ""), names.get("id", "")}:
        for m in PARTS.finditer(value):
            whole = (m.start() == 0 or value[m.start() - 1].isspace()) and (m.end() == len(value) or value[m.end()].isspace())
            out += [f"name {m[1].lower().rstrip('s')}", "whole name" if whole else "part of a name"]
    return sorted(set(out))


def parse(page: str) -> tuple[list[Token], list[Element]]:
    """The page's tokens, and its elements; a token has the place of its element."""
    out: list[Token] = []
    elements = [Element(-1, [], False, False, False)]
    stack: list[tuple[str, int]] = []  # open containers
    main = links = heading = item = 0
    for m in _TOKEN.finditer(page):
        text, tag, at = m["text"], (m["tag"] or "").lower(), stack[-1][1] if stack else 0
        if text is not None:
            n = len(text.split())
            out.append(Token("text" if n else "space", "", text, "link" if links else "heading" if heading else "item" if item else "words", at))
            elements[at].words += n
            elements[at].links += n if links else 0
            continue
        if m["comment"] in (MAIN, END):
            out.append(Token("mark", "", m["comment"], "", at))
        if not tag:
            continue
        if m["close"]:
            if tag in HEADINGS:
                heading = 0
            elif tag in ("li", "ul", "ol"):
                item = 0
            if tag in CONTAINERS and any(s[0] == tag for s in stack):
                while True:
                    name, e = stack.pop()
                    main, links = main - elements[e].main, links - (name == "a")
                    if name == tag:
                        break
                at = stack[-1][1] if stack else 0
        else:
            if tag in HEADINGS:
                heading = 1
            elif tag == "li":
                item = 1
            elif tag in BLOCKS:
                heading = 0
            if tag in CONTAINERS and tag not in VOID and not (m["rest"] or "").endswith("/"):
                names = {a.lower(): x or y or z for a, x, y, z in _ATTRIBUTE.findall(m["rest"] or "")}
                is_main = tag in ("article", "main") or "articlebody" in names.get("itemprop", "").lower()
                elements.append(Element(at, _hints(tag, names, main > 0), is_main, main > 0, "data-part" in names))
                at = len(elements) - 1
                stack.append((tag, at))
                main, links = main + is_main, links + (tag == "a")
        out.append(Token("break" if tag in BLOCKS else "space" if tag == "br" else "tag", f"<{m['close']}{tag}>", "", "", at))
    for e in reversed(elements[1:]):  # children come after their parents
        up = elements[e.parent]
        up.words, up.links = up.words + e.words, up.links + e.links
    return out, elements


def _holds_main(elements: list[Element]) -> list[bool]:
    out = [e.main for e in elements]
    for k in range(len(elements) - 1, 0, -1):
        out[elements[k].parent] |= out[k]
    return out


def part_features(e: Element, holds_main: bool, page_words: int) -> list[str]:
    share, density = e.words / max(1, page_words), e.links / max(1, e.words)
    return [
        "any", *e.hints, f"hints {min(3, len(e.hints))}",
        "holds main" if holds_main else "in main" if e.in_main else "no main",
        "most words" if share >= 0.5 else "many words" if share >= 0.2 else "few words",
        "links" if density >= 0.5 else "some links" if density >= 0.1 else "no links",
        "long" if e.words >= 80 else "middle" if e.words >= 25 else "short",
    ]


def parts(elements: list[Element], model: dict[str, float]) -> list[bool]:
    """Whether each element is a part to be left out, or in one."""
    holds = _holds_main(elements)
    out = [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        own = bool(e.hints) and sum(model.get(f, 0.0) for f in part_features(e, holds[k], elements[0].words)) > 0
        out[k] = out[e.parent] or own
    return out


def sequence(tokens: list[Token], elements: list[Element], left_out: list[bool]) -> list[tuple[str, int]]:
    """For each token its feature and its number of words (0: scores nothing)."""
    has_main = any(e.main for e in elements)
    in_main = [e.main or e.in_main for e in elements]
    sizes, block = [0] * len(tokens), 0  # words of each token's block
    starts = [k for k, t in enumerate(tokens) if t.kind == "break"]
    for a, b in zip([-1, *starts], [*starts, len(tokens)]):
        block = sum(len(t.content.split()) for t in tokens[a + 1 : b] if t.kind == "text")
        sizes[a + 1 : b] = [block] * (b - a - 1)
    out = []
    for t, size in zip(tokens, sizes):
        if t.kind == "text" and not left_out[t.element]:
            place = "page" if not has_main else "main" if in_main[t.element] else "beside"
            length = "long" if size >= 25 else "middle" if size >= 10 else "short"
            out.append((f"{t.where} {length} {place}", len(t.content.split())))
        else:
            out.append((t.tag, 1 if t.tag and not left_out[t.element] else 0))
    return out


def _coarser(feature: str) -> list[str]:
    """Features that stand in, one after another, for one that the fit never saw."""
    if feature.startswith("<"):
        return []
    where, _, place = feature.split(" ")
    return [f"{where} any {place}", f"any any {place}"]


def score(feature: str, weights: dict[str, float]) -> float:
    """Weight of one word, or of a tag."""
    for f in (feature, *_coarser(feature)) if feature else ():
        if f in weights:
            return weights[f]
    return -LEAST_TAG_COST if feature.startswith("<") else 0.0


def fit_parts(pages: Iterable[str]) -> dict[str, float]:
    """Logistic regression of data-part on the features of hinted elements."""
    rows, labels = [], []
    for page in pages:
        _, elements = parse(page)
        holds = _holds_main(elements)
        inside = [False] * len(elements)
        for k, e in enumerate(elements[1:], 1):
            inside[k] = inside[e.parent] or e.labelled
            if e.hints:
                rows.append(part_features(e, holds[k], elements[0].words))
                labels.append(inside[k])
    names = sorted({f for r in rows for f in r})
    place = {f: k for k, f in enumerate(names)}
    x, y = np.zeros((len(rows), len(names))), np.array(labels, float)
    for k, r in enumerate(rows):
        x[k, [place[f] for f in r]] = 1
    w = np.zeros(len(names))
    for _ in range(ROUNDS):
        w -= STEP * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + DECAY * w)
    return dict(zip(names, w.tolist()))


def fit_words(pages: Iterable[str], part_model: dict[str, float]) -> dict[str, float]:
    """Log-odds of each feature inside the main text against outside."""
    inside, outside = Counter(), Counter()
    for page in pages:
        tokens, elements = parse(page)
        now = outside
        for t, (feature, n) in zip(tokens, sequence(tokens, elements, parts(elements, part_model))):
            if t.kind == "mark":
                now = inside if t.content == MAIN else outside
            elif n:
                for f in (feature, *_coarser(feature)):
                    now[f] += n
    once = lambda counts: sum(n for f, n in counts.items() if " any " not in f)
    total_in, total_out = once(inside), once(outside)
    weights = {}
    for f in inside.keys() | outside.keys():
        odds = log((inside[f] + SMOOTHING) / (total_in + SMOOTHING)) - log((outside[f] + SMOOTHING) / (total_out + SMOOTHING))
        odds = max(-WEIGHT_BOUND, min(WEIGHT_BOUND, odds))
        weights[f] = -min(MOST_TAG_COST, max(LEAST_TAG_COST, -odds)) if f[0] == "<" else odds
    return weights


def fit(pages: list[str]) -> Model:
    part_model = fit_parts(pages)
    return Model(fit_words(pages, part_model), part_model)


@cache
def default_model() -> Model:
    return fit([labelled_page(seed).html for seed in range(FIT_PAGES)])


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the greatest sum (the first and
    shortest of equal ones); (0, 0) if no sum is above zero."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def main_text(page: str | None, model: Model | None = None) -> str:
    """The main text of a page; empty if there is none."""
    if not page:
        return ""
    model = model or default_model()
    tokens, elements = parse(page)
    left_out = parts(elements, model.parts)
    scores = [n and n * score(f, model.words) for f, n in sequence(tokens, elements, left_out)]
    start, end = best_region(scores)
    blocks, current = [], []
    for t in [*tokens[start:end], Token("break", "", "", "", 0)]:
        if t.kind == "text" and not left_out[t.element]:
            current.append(entities.unescape(t.content))
        elif t.kind == "space":
            current.append(" ")
        elif t.kind == "break" and current:
            text = " ".join("".join(current).split())
            if text:
                blocks.append(text)
            current = []
    return "\n\n".join(blocks)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    A null or empty html has an empty text, and so has a page of which no
    region scores above zero.  Form controls (select, textarea, button, label)
    count as forms.  n_chars is in code points.  Rows that repeat are extracted
    each for itself; an empty table gives an empty result; other columns fall
    away.
    """
    model = default_model()  # fitted once; a few hundred numbers go to the tasks

    def extract(htmls: pd.Series) -> pd.Series:
        return htmls.map(lambda x: main_text(x, model), na_action=None)

    text = F.pandas_udf(extract, T.StringType())
    p = only(pages, page_id="long", url="string", html="string")
    return p.withColumn("text", text(F.coalesce("html", F.lit("")))).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
