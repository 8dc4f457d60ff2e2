"""Conversation repair, fill-in-middle and packing: against brute force, and at their edges."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftline.llm import op11_conversations as op11
from weftline.llm import op12_fill_in_middle as op12
from weftline.llm import op13_packing as op13

TURNS = "conv_id long, turn long, role string, text string, pos long, block long, ord long, fault string, cells string"
DOCS = "doc_id long, text string, lang string, source string, n long, key long, run int, cuts string, form string, output string, length long, ids string, worker long"
PATH = public_tokenizers.path("word_bpe_49k.json")
BIG = 1 << 53


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11 ---------------------------------------------------------------------------


def is_well_formed(initials):
    if initials.startswith("s"):
        if len(initials) == 1:
            return False
        initials = initials[1:]
    return len(initials) % 2 == 0 and initials == "ua" * (len(initials) // 2)


def faults_of(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "none")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines) over every series of edits with at most two insertions
    at a place (more lead nowhere new), state by state."""
    faults = faults_of(rows)
    ways = {"": (0, "", [])}  # by the initials so far, shortened to what matters

    def short(initials):  # the automaton's state: empty, s, or the last two
        return initials if len(initials) < 2 else "ua" if initials.endswith("a") else "u"

    def ok(initials):
        return is_well_formed(initials) or is_well_formed(initials + "a") or is_well_formed(initials + "ua")

    def keep(found, initials, way):
        if ok(initials):
            k = short(initials)
            if k not in found or way[:2] < found[k][:2]:
                found[k] = way

    def inserted(ways):
        found = {}
        for initials, (cost, audit, lines) in ways.items():
            for n in range(4):
                for roles in itertools.product(("user", "assistant"), repeat=n):
                    if all(ok(initials + "".join(r[0] for r in roles[: i + 1])) for i in range(n)):
                        keep(found, initials + "".join(r[0] for r in roles), (cost + 2 * n, audit + "I" * n, lines + [f"{r}:" for r in roles]))
        return found

    for (_, role, text), fault in zip(rows, faults, strict=True):
        found = {}
        for initials, (cost, audit, lines) in inserted(ways).items():
            keep(found, initials, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role:
                    keep(found, initials + role[0], (cost + extra, audit + "K", lines + [f"{role}:{text}"]))
                for r in ("user", "assistant"):
                    keep(found, initials + r[0], (cost + 2 + extra, audit + "R", lines + [f"{r}:{text}"]))
        ways = found
    return min((way for initials, way in inserted(ways).items() if is_well_formed(initials)), key=lambda w: w[:2])


def expected(rows):
    """rows of one conversation: (turn, role, text)"""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    count, turns = Counter(faults_of(rows)), [t for t, *_ in rows if t is not None]
    cost, audit, lines = cheapest(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha("\n".join(lines))


def turns(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, 9, "own", "own") for r in rows], TURNS)


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_matrices_against_every_series_of_edits():
    r = random.Random(3)
    for _ in range(300):
        rows = [(k, r.choice(["system", "user", "assistant", "tool"]), r.choice(["Yes.", "No", "", "Well?", f"t{k}."])) for k in range(r.randint(1, 7))]
        symbols = "".join("d" if f in ("blank", "duplicate") else (row[1][0] if row[1][0] in "sua" else "x").upper() if f == "truncated" else row[1][0] if row[1][0] in "sua" else "x" for row, f in zip(rows, faults_of(rows), strict=True))
        m = op11.product(symbols)
        assert min(m[0][e] for e in op11.ENDS if m[0][e]) == cheapest(rows)[:2]
        cut = r.randint(0, len(symbols))
        if 0 < cut < len(symbols):  # any bracketing gives the same
            assert op11.times(op11.product(symbols[:cut]), op11.product(symbols[cut:])) == m


@pytest.fixture(scope="module")
def talks():
    r = random.Random(4)
    out = {}
    for c in range(60):
        out[c] = [(None if r.random() < 0.05 else k + (k > 3) * r.randint(0, 1), r.choice(["system", "user", "user", "assistant", "assistant", "tool", None]), r.choice(["Fine.", "Go on", "", " \n", None, f"What {k}?", "é👍!", f"say {k}."])) for k in range(r.randint(1, 9))]
    # one conversation of many segments, one whose turns are all alike, no conversation's id
    out[BIG + 1] = [(k, ("user", "assistant")[(k + (k % 97 == 0)) % 2], f"turn {k}{'.' if k % 5 else ''}") for k in range(3000)]
    out[BIG + 2] = [(None, "user", "Same.")] * 700
    out[None] = [(1, "user", "Who?"), (2, "assistant", "Nobody.")]
    return out


def test_repair_against_every_series_of_edits(spark, talks):
    rows = [(c, *t) for c, ts in talks.items() for t in ts]
    random.Random(5).shuffle(rows)
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in op11.Repair(turns(spark, rows).repartition(5)).report().collect()}
    assert got == {c: expected(ts) for c, ts in talks.items()}


def test_damage_and_conversations_of_which_nothing_is_left(spark, talks):
    rows = [(c, *t) for c, ts in talks.items() for t in ts] + [(5000 + k, 0, "user", "Hi.") for k in range(80)]
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in op11.repair_damaged(turns(spark, rows)).collect()}
    left = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (t, "user" if fault == 4 else role, "" if fault == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if fault == 2 else text)
        left[c] += [row] * (0 if fault == 0 else 2 if fault == 3 else 1)
    assert got == {c: expected(left[c]) if left[c] else (0, 0, 0, 0, 0, 0, "", sha("")) for c in {r[0] for r in rows}}
    assert any(not left[c] for c in got)
    assert op11.repair_damaged(turns(spark, [])).count() == 0


# --- 12 ---------------------------------------------------------------------------


def docs(spark, rows):
    return spark.createDataFrame([(*r, "xx", "s", 1, 2, 3, "c", "f", "o", 4, "i", 5) for r in rows], DOCS)


def units_of(text, unit):
    import re

    return list(text) if unit is None else re.findall(unit, text)


def cut_up(doc_id, text, unit=None):
    text = text or ""
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = units_of(text, unit)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not units or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle = "".join(units[:a]), "".join(units[a:b])
    suffix = text[len(prefix + middle) :]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"


@pytest.mark.parametrize("unit", [None, op12.WORDS, op12.LINES])
def test_fill_in_middle(spark, unit):
    r = random.Random(6)
    rows = [(k, "".join(r.choice("ab é👍🏽\n\t<S>ñ") for _ in range(r.choice([0, 1, 2, 30, 1023, 1024, 1025, 2048, 5000])))) for k in range(80)]
    rows += [(900, None), (901, ""), (None, "no id at all"), (None, "no id at all"), (902, "a <P> in it"), (903, "twice"), (903, "twice"), (903, "not the same"), (BIG + 1, "x <\n" * 70_000), (904, " \n ")]
    rows = [(i, t if i is None or i > 899 or t is None else t.replace("<S>", "<S")) for i, t in rows]
    got = op12.fill_in_middle(docs(spark, rows), unit)
    seen = got.withColumn("text", op12.restore(got["form"], got["output"])).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted([(i, *cut_up(i, t, unit), t or "") for i, t in rows], key=key)
    assert sorted([(g["doc_id"], g["n"], g["form"], g["prefix_chars"], g["middle_chars"], g["output"], g["text"]) for g in seen], key=key) == want
    assert op12.fill_in_middle(docs(spark, []), unit).count() == 0


# --- 13 ---------------------------------------------------------------------------


def test_piece_lengths_fill_their_class():
    for total in [*range(1, 2100), 4095, 123_457]:
        lengths = op13.piece_lengths(total)
        assert sum(lengths) == total and all(0 < x <= 2048 for x in lengths)
        assert all((2048 // x) * x >= 2000 for x in lengths)
    assert max(len(op13.piece_lengths(n)) for n in range(1, 2049)) <= 4


def packed_whole(rows, got, capacity=2048):
    """Every id in one piece, sequences gapless and within the capacity; the share of padding."""
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text in rows:
        want[doc_id, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids) + (1,)] += 1
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for g in got:
        by_doc[g["doc_id"]].append(g)
        sequences[g["sequence_id"]].append((g["offset"], g["length"]))
    for (doc_id, ids), n in want.items():
        pieces = [g for g in by_doc[doc_id] if g["doc_tokens"] == len(ids) and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[g["start"] : g["start"] + g["length"]])) == g["ids_crc32"]]
        covered = Counter(k for g in pieces for k in range(g["start"], g["start"] + g["length"]))
        assert all(covered[k] >= n for k in range(len(ids)))
    assert sum(g["length"] for g in got) == sum(len(ids) * n for (_, ids), n in want.items())
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(total, 1)


def test_packing(spark):
    r = random.Random(7)
    some = ["the", "Quick", "brown's", "fox", "naïve", "É", "12345", "don't", "áb", "<|endoftext|>", "<|STARTOFTEXT|>x", "ÀB", "İI", "　wide line\x1c", "👍🏽", "x" * 300, "..!?"]
    rows = [(k, r.choice([" ", "\n", "\t ", "\x85"]).join(r.choice(some) + (str(r.randint(0, 99)) if r.random() < 0.3 else "") for _ in range(r.choice([1, 5, 50, 300, 900, 2500])))) for k in range(400)]
    rows += [(900, None), (901, ""), (902, " \n"), (None, "no id"), (None, "no id"), (903, "same row"), (903, "same row"), (BIG + 1, "word " * 50_000)]
    got = op13.pack_documents(docs(spark, rows).repartition(40), PATH).collect()
    assert packed_whole(rows, got) < 0.01
    empty = op13.pack_documents(docs(spark, []), PATH)
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_packing_of_a_few_documents(spark):
    rows = [(1, "one"), (2, "two words"), (3, "")]
    assert packed_whole(rows, op13.pack_documents(docs(spark, rows), PATH).collect()) == 0


def test_words_of_a_full_memory_are_tokenized_anew(monkeypatch):
    monkeypatch.setattr(op13, "REMEMBERED", 20)
    tokens, whole = op13.Tokens(PATH), Tokenizer.from_file(PATH)
    for k in range(30):
        text = " ".join(f"word{k * 7 + i} {'long' * 40}{k}" for i in range(12))
        ids = whole.encode(text, add_special_tokens=False).ids
        assert tokens.ids(text.encode()) == b"".join(i.to_bytes(4, "little") for i in ids)
