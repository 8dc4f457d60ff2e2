"""The stages take effect, one after another, as brute force says, and at their edges."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_llm_operators import BIG, classes_of, edited, natural_prose, prose, targets_by_rounds, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids, columns = [{r["doc_id"] for r in docs.select("doc_id").collect()}], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, sf), f"test-{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[1] != ids[0] and ids[2] != ids[1]
    run = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, run.collect())) == sorted(map(str, docs.collect()))


def tables(spark, at, rows, items, trusted, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return f"file://{at}"


def test_run_against_brute_force(spark, tmp_path):
    """Every stage's decision by plain loops over a corpus in which each has work to do."""
    items = [(k, prose(25, 5000 + k)) for k in range(6)]
    clean = [(k, natural_prose(60 + k % 30, k)) for k in range(120)]
    junk = [(200 + k, " ".join(f"{w.upper()}#{k}$$" for w in prose(60, 300 + k).split())) for k in range(15)]
    short, loops = [(300 + k, natural_prose(10, k)) for k in range(10)], [(320 + k, " ".join([natural_prose(12, k)] * 5)) for k in range(5)]
    near = [(400 + k, edited(clean[k % 10][1], 1 + k % 2, k)) for k in range(40)]
    leaks = [(500 + k, f"{natural_prose(40, 900 + k)} {items[k % 6][1]} {natural_prose(30, 950 + k)}") for k in range(12)]
    rows = [(i, t, "xx", f"s{i % 4}", len(t)) for i, t in clean + junk + short + loops + near + leaks]
    sf = tables(spark, tmp_path, rows, items, range(120))

    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, sf), f"brute-{k}")
        seen.append(docs.collect())
    quality, dedup, decontaminated, mixed, sharded = seen
    texts = {i: t for i, t, *_ in rows}

    kept = {r["doc_id"] for r in quality}  # the ratio itself is held against loops beside op3
    assert kept >= {i for i, _ in clean + near + leaks} and not kept & {i for i, _ in junk + short + loops}
    classes = classes_of([(i, texts[i]) for i in sorted(kept)])
    assert {r["doc_id"] for r in dedup} == set(classes.values()) and len(dedup) == len(set(classes.values()))
    held = {r["doc_id"] for r in dedup if any(t in texts[r["doc_id"]] for _, t in items)}
    assert held and {r["doc_id"] for r in decontaminated} == {r["doc_id"] for r in dedup} - held

    left = [(r["doc_id"], r["text"], r["source"]) for r in decontaminated]
    sizes = Counter()
    for _, t, s in left:
        sizes[s] += len(words(t))
    want, got = targets_by_rounds(sizes), Counter()
    copies = Counter()
    for r in mixed:
        got[r["source"]] += len(words(r["text"]))
        copies[r["doc_id"]] += len(words(r["text"]))
    assert all(abs(got[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    key = lambda d: int(hashlib.md5("|".join(("17", str(d[0]), d[2], d[1])).encode()).hexdigest()[:15], 16)
    for s in sizes:
        budget, epochs = round(want[s]), round(want[s]) // sizes[s]
        rest = budget - epochs * sizes[s]
        for d in sorted((x for x in left if x[2] == s), key=key):
            n = len(words(d[1]))
            assert copies[d[0]] == epochs * n + max(0, min(n, rest))
            rest -= n

    assert Counter(r["doc_id"] for r in sharded) == Counter(r["doc_id"] for r in mixed)
    size_of = {hashlib.md5(r["text"].encode()).hexdigest(): len(r["text"].encode()) + 8 for r in mixed}
    load = Counter()
    for r in sharded:
        load[r["shard"]] += r["size"]
    assert sum(load.values()) == sum(len(r["text"].encode()) + 8 for r in mixed)
    groups = Counter(r["text"] for r in mixed)
    largest = max(n * (len(t.encode()) + 8) for t, n in groups.items())
    assert size_of and max(load.values()) <= sum(load.values()) / 24 + largest
    for k in load:
        assert sorted(r["slot"] for r in sharded if r["shard"] == k) == list(range(sum(r["shard"] == k for r in sharded)))


EDGES = [
    (1, None, "xx", "a", 0), (2, "", None, None, None), (3, "one two", "xx", "a", 7), (3, "one two", "xx", "a", 7), (None, prose(40, 1), "xx", None, 1), (None, None, None, None, None),
    (4, " \n\t ", "xx", "b", 4), (5, " ".join(prose(30_000, 7).split()), "xx", "b", 9), (BIG + 1, prose(45, 2), "xx", "b", 9), (BIG + 2, prose(45, 2), "xx", "b", 9), (BIG + 3, prose(50, 3), None, "c", 9), (BIG + 3, prose(50, 3), None, "c", 9),
]
#: Names that the operators use inside, or return.
CLASHES = ("kept", "n_words", "llr", "rk", "no_id", "text_key", "class_id", "key", "size", "h", "shard", "slot", "taken", "target", "source_size", "range", "item_id", "base_failed")


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    schema = SCHEMA + "".join(f", {c} string" for c in CLASHES)
    return tables(spark, tmp_path_factory.mktemp("edges"), [(*r, *(f"own {c}" for c in CLASHES)) for r in EDGES], [(BIG, prose(50, 3)), (None, "x"), (2, None)], [BIG + 1, 3], schema)


#: What each stage keeps of EDGES, by id (see the docstrings of the stages).
LEFT = {
    "quality rules": {None: 1, 5: 1, BIG + 1: 1, BIG + 2: 1, BIG + 3: 2},
    "near-duplicate removal": {1: 1, 2: 1, 3: 1, None: 2, 4: 1, 5: 1, BIG + 1: 1, BIG + 3: 1},
    "benchmark decontamination": {1: 1, 2: 1, 3: 2, None: 2, 4: 1, 5: 1, BIG + 1: 1, BIG + 2: 1},
}


@pytest.mark.parametrize("k", range(5))
def test_stage_edges(spark, edges, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    got = stage(spark, docs, edges)
    rows = got.collect()
    if k < 4:
        assert got.columns == docs.columns
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    if name in LEFT:
        assert Counter(r["doc_id"] for r in rows) == Counter(LEFT[name])
        assert {(r["doc_id"], r["text"]) for r in rows} <= {r[:2] for r in EDGES}
    elif k == 3:  # words only: texts without any are not taken
        assert {r["doc_id"] for r in rows} <= {3, None, 5, BIG + 1, BIG + 2, BIG + 3} and all(words(r["text"]) for r in rows)
    else:
        assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in EDGES)
    empty = stage(spark, docs.where(F.lit(False)), edges)
    assert empty.count() == 0 and empty.columns == got.columns
