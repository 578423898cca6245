"""The stages over a small table, each against what it must do with what comes in."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import awkward, slow_any_earlier, slow_components

from lakepipe.llm import simhash
from lakepipe.llm.common import written

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, found = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, DIR), "test")
        found.append((name, docs, out))
        docs = out
    return found


def test_columns(steps):
    assert [n for n, _, _ in steps] == ["quality classifier", "line dedup", "simhash near-dedup", "source mixing", "best-fit packing"]
    for _, before, after in steps[:-1]:
        assert after.dtypes == before.dtypes


def test_poor_documents_go(spark, steps):
    _, before, after = steps[0]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after.collect()}
    good = [i for i, q in labels.items() if q == 1]
    poor = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i in kept for i in poor) <= 0.2 * len(poor)


def test_lines(steps):
    _, before, after = steps[1]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    want = {i: t for i, (n, gone, t) in slow_any_earlier(rows).items() if not gone or t.strip(" \t\n\x0b\f\r")}
    got = {r["doc_id"]: r for r in after.collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    old = {r["doc_id"]: r for r in before.collect()}
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] != old[i]["text"] else old[i]["n_chars"]) for i, r in got.items())


def test_one_of_each_group(steps):
    _, before, after = steps[2]
    rows = before.collect()
    fps = {r["doc_id"]: int(f) for r, f in zip(rows, simhash.fingerprints([r["text"].encode() for r in rows]), strict=True)}
    want = {min(i for i, f in fps.items() if f in g) for g in slow_components(set(fps.values()))}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(want)


def test_mix_and_packing(steps):
    _, before, after = steps[3]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    rows = after.collect()
    assert all(r["text"] == texts[r["doc_id"]] for r in rows)
    words = sum(len(t.encode().split()) for t in texts.values())
    assert sum(len(r["text"].encode().split()) for r in rows) == pytest.approx(words, rel=0.05)
    packed = steps[4][2].collect()
    assert sum(r["size"] for r in packed) == sum(len(r["text"].encode().split()) for r in rows)


@pytest.mark.parametrize("rows", ["awkward", "none", "nulls"])
def test_awkward_tables_run_through_all_stages(spark, rows):
    """Nulls in every column, empty and very long texts, repeated rows, no rows, and columns called like the operators' own."""
    docs = awkward(spark)
    if rows == "none":
        docs = docs.limit(0)
    if rows == "nulls":
        docs = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, None, None, None, None)], docs.schema)
    for c in ("__key", "__th", "__gone", "h", "key", "score", "whole", "cuts", "__statistics", "place"):
        docs = docs.withColumn(c, F.lit(c))
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, DIR), "test")
        if name != "best-fit packing":
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
            assert out.where("score != 'score' OR h != 'h' OR __key != '__key'").count() == 0
            if rows == "none":
                assert out.count() == 0
        docs = out
    assert {"doc_id", "bin_id"} <= set(docs.columns)


def test_near_copies_of_similarity(spark):
    """Planted copies of a five-word Jaccard around 0.8, some in a family, against brute force."""
    import random

    rng, rows = random.Random(3), []
    for length, changes in [(3, 0), (5, 1), (100, 1), (100, 2), (300, 3), (300, 6), (300, 9), (1000, 20), (1000, 30)] * 3:
        base = [f"w{rng.randrange(10**9)}" for _ in range(length)]
        for k in range(3):
            words = base[:]
            for at in rng.sample(range(length), changes if k else 0):
                words[at] = f"v{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    common = " ".join(f"c{i}" for i in range(60))
    rows += [(len(rows) + i, common + " " + " ".join(f"o{rng.randrange(10**9)}" for _ in range(40))) for i in range(60)]
    family = [f"f{i}" for i in range(200)]
    for _ in range(80):
        words = family[:]
        for at in rng.sample(range(200), rng.randint(0, 6)):
            words[at] = f"g{rng.randrange(10**9)}"
        rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (None, "one and only one"), (902, "One and only one"), (903, "twice"), (903, "something else"), (903, "twice")]
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)])) or frozenset([tuple(t.split())]) if (t := (x or "").lower()).split() else frozenset() for _, x in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            if (len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9) if a or sets[j] else True:
                parent[find(i)] = find(j)
    least: dict = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (2**70, "")), (2**62 if r[0] is None else r[0], r[1] or ""))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string").repartition(3)
    out = corpus_pipeline.simhash_near_dedup(spark, df, DIR)
    assert out.dtypes == df.dtypes
    assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == sorted(least.values())
    assert corpus_pipeline.simhash_near_dedup(spark, df.limit(0), DIR).count() == 0
