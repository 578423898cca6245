"""Each operator over small tables, against brute force and with awkward rows."""

import hashlib
import itertools
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from lakepipe.llm import ann, line_dedup, mixing, order_minhash, packing, quality, queries, simhash, tokens, url_rules, warc

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "long words and more of them " * 4000


def awkward(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six seven"), (5, "one two three four five six seven"), (5, "one two three four five six seven"), (None, "without an id, five words"), (None, None), (6, LONG), (7, "é ß 😀\nüber\n\n"), (8, "one two three four five six eight")]
    return spark.createDataFrame([(i, t, None, [None, "a", "b"][k % 3], 0) for k, (i, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


# ---- 1


def test_ann_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 12))
    x[100:400] = x[100]  # a vector that very many rows share
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 12), (903, [float("nan")] + [1.0] * 11), (904, [float("inf")] + [1.0] * 11), (905, [1.0] * 5), (906, [None] + [1.0] * 11), (None, [1.0] * 12), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, score string").repartition(3)
    index = ann.build(df)
    assert index.rows.count() == 800  # 7 twice with one vector is one row
    asked = [0, 7, 100, 399, 500]
    q = index.rows.where(F.col("vec_id").isin(asked)).selectExpr("vec_id AS query_id", "vector")
    got = index.search(q, k=20).collect()
    found = total = 0
    for i in asked:
        score = ann.exact(x, x[i])
        order = [j for j in np.lexsort((np.arange(len(x)), -score)) if j != i][:20]
        mine = sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(r["score"] == score[r["vec_id"]] for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        found, total = found + len({r["vec_id"] for r in mine} & set(order)), total + 20
    assert found / total >= 0.9


def test_ann_rows_of_one_id(spark, monkeypatch):
    """Rows of one id with different vectors are rows of their own; blocks of rows and of queries change nothing."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 6))
    ids = [i // 2 for i in range(90)]  # each id twice
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(2)
    want = {}
    for a in range(0, 90, 15):
        s = ann.exact(x, x[a])
        want.setdefault(ids[a], []).append([(float(s[j]), ids[j]) for j in sorted(range(90), key=lambda j: (-s[j], ids[j])) if j != a][:5])

    def found():
        index = ann.build(df)
        asked = spark.createDataFrame([(ids[a], [float(v) for v in x[a]]) for a in range(0, 90, 15)], "query_id long, vector array<double>")
        got = {}
        for r in index.search(asked, k=5).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
        return got

    for rows, queries_ in ((65_536, 4096), (7, 4096), (16, 2)):
        monkeypatch.setattr(ann, "ROW_BLOCK", rows)
        monkeypatch.setattr(ann, "QUERY_BLOCK", queries_)
        got = found()
        assert {q: sorted((s, v) for _, s, v in g) for q, g in got.items()} == {q: sorted(y for w in ws for y in w) for q, ws in want.items()}


def test_ann_recall_on_the_table(spark):
    got = {}
    for r in queries.QUERIES["op1_additive_quantisation"](spark, DIR).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    hits = [len(got[q] & set([j for j in ids[np.argsort(-(x @ x[ids == q][0]), kind="stable")] if j != q][:20])) / 20 for q in ids[ids % 20 == 0]]
    assert np.mean(hits) >= 0.9


def test_ann_of_nothing(spark):
    index = ann.build(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert index.search(index.rows.selectExpr("vec_id AS query_id", "vector")).count() == 0


# ---- 2


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "ü" * 90_000
    rows = [(1, "http://a", None), (2, None, ""), (3, "http://b\r\nX: y", big), (4, "http://c", big), (3, "http://b\r\nX: y", big), (None, "http://n", big), (None, "http://m", "y" * 100), (5, "http://d", "z" * 99), (6, "http://e", "z" * 99), (8, "http://f", "w" * 100), (7, "http://g", "w" * 100)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    folder = str(tmp_path / "w")
    warc.write(pages, folder, segment=1000)
    got = warc.read(spark, folder).collect()
    assert len(got) == len(rows)
    key = lambda r: (r["page_id"] is None, r["page_id"] or 0, r["url"] or "")
    by = sorted(got, key=key)
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in by] == [(1, "response", None), (2, "response", None), (3, "response", None), (3, "response", None), (4, "revisit", 3), (5, "response", None), (6, "response", None), (7, "response", None), (8, "revisit", 7), (None, "response", None), (None, "revisit", 3)]
    html = {(i, (u or "").replace("\r", "%0D").replace("\n", "%0A")): (h or "").encode() for i, u, h in rows}
    for r in got:
        body = html[r["page_id"], r["url"] or ""]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == hashlib.sha256(body).hexdigest()
        assert r["payload"] == (None if r["record_type"] == "revisit" else body)
    records = [f for p in Path(folder).glob("*.gz") for f in warc.parse(p.read_bytes())]
    assert any(f["warc-type"] == "continuation" for f, _ in records) and all(len(b) <= 1000 for _, b in records)


def test_warc_of_nothing(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).count() == 0


def test_warc_as_sql(spark):
    assert compare(spark, queries.QUERIES["op2_warc_segments"], queries.ORACLE["op2_warc_segments"], DIR) == ""


# ---- 3


def slow_lines(rows, threshold=0.8):
    """{id: (lines, gone, text)} for rows in order of id, none of them repeated."""
    seen, out = [], {}
    for i, text in rows:
        lines, kept = [] if text is None else text.split("\n"), []
        for line in lines:
            s = frozenset(w for w in re.split(r"[\x20\x09-\x0d]+", line) if w)
            if s and any(len(s & o) >= threshold * len(s | o) - 1e-9 for o in seen):
                continue
            kept.append(line)
            if s:
                seen.append(s)
        out[i] = (len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept))
    return out


def slow_any_earlier(rows, threshold=0.8):
    seen, index, out = {}, {}, {}
    for i, text in rows:
        lines, kept = [] if text is None else text.split("\n"), []
        for line in lines:
            s = frozenset(w for w in re.split(r"[\x20\x09-\x0d]+", line) if w)
            shared = {}
            for w in s:
                for k in index.get(w, ()):
                    shared[k] = shared.get(k, 0) + 1
            names = list(seen)
            if not any(n >= threshold * (len(s) + len(names[k]) - n) - 1e-9 for k, n in shared.items()):
                kept.append(line)
            if s and s not in seen:
                seen[s] = None
                for w in s:
                    index.setdefault(w, []).append(len(seen) - 1)
        out[i] = (len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept))
    return out


def test_line_dedup_against_brute_force(spark, docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.report(docs).collect()}
    assert got == slow_any_earlier(rows)


def test_line_dedup_of_near_copies(spark):
    """A family of near copies, and lines of very common words."""
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(150):
        line = base[:]
        for _ in range(rng.randint(0, 4)):
            line[rng.randrange(30)] = f"v{rng.randrange(60)}"
        rng.shuffle(line)
        rows.append((i, " ".join(line) + "\nthe same line\n" + " ".join(rng.sample("a b c d e f g".split(), rng.randint(1, 6))) + "\n\n"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.report(df).collect()}
    assert got == slow_any_earlier(rows)


def test_line_dedup_of_rows_that_share_an_id(spark):
    """Rows of one id with different texts lose their own lines only; ids may be text; names may hold dots."""
    rows = [("b", "first line of five words\nonly in this document here"), ("b", "only here and nowhere else\nfirst line of five words"), ("a", "first line of five words"), (None, "first line of five words\nno id for this one line"), ("b", "only here and nowhere else\nfirst line of five words")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "`the.id` string, `the.text` string, __gone string")
    out = line_dedup.clean(df.drop("__gone"), doc_id="the.id", text="the.text")
    got = sorted((str(r["the.id"]), r["the.text"]) for r in out.collect())
    assert got == [("None", "no id for this one line"), ("a", "first line of five words"), ("b", "only here and nowhere else"), ("b", "only here and nowhere else"), ("b", "only in this document here")]
    ids = spark.createDataFrame([(2**62 + 5, "one two three four five"), (None, "one two three four five"), (-(2**63), "one two three four five\nsix"), (2**63 - 1, "seven")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.clean(ids).collect()) == [(-(2**63), "one two three four five\nsix"), (2**63 - 1, "seven")]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_line_dedup_of_all_lengths(spark, threshold):
    """Lines of 1 to 300 tokens with edits, blanks of all kinds, repeated words and a hot word, by several thresholds."""
    import random

    rng, rows = random.Random(int(threshold * 100)), []
    for length in [1, 2, 3, 4, 5, 6, 9, 10, 30, 60, 64, 65, 66, 70, 130, 300] * 2:
        base = ["the", *[f"w{rng.randrange(300)}" for _ in range(length - 1)]]
        for _ in range(4):
            words = base[:]
            for _ in range(rng.randint(0, max(1, int(length * (1 - threshold))))):
                words[rng.randrange(length)] = rng.choice([f"v{rng.randrange(10**6)}", "the", "of"])
            rng.shuffle(words)
            rows.append("".join(w + rng.choice([" ", "  ", "\t", " \x0b", "\f", "\r", " "]) for w in words))
    rng.shuffle(rows)
    docs = [(i, "\n".join(rows[i * 2 : i * 2 + 2]) + rng.choice(["", "\n \t", "\nü\xa0ü"])) for i in range(len(rows) // 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.report(df, threshold).collect()}
    assert got == slow_any_earlier(docs, threshold)


def test_line_dedup_awkward(spark):
    df = awkward(spark)
    out = line_dedup.clean(df)
    assert out.columns == df.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    # 5 twice is one document whose only line is that of 4; 8 shares six of eight words with it and stays
    assert [i for n, i, _ in ids if not n] == [1, 2, 3, 4, 6, 7, 8] and sum(n for n, _, _ in ids) == 2
    assert line_dedup.clean(df.limit(0)).count() == 0


def test_line_dedup_splits_lines_once(spark):
    """Classes hold the hashes of their tokens; what comes after neither has nor splits any text."""
    df = spark.createDataFrame([(1, 1, "b a  b\ta\n\n a b "), (2, 2, "c")], "key long, th long, text string")
    classes = line_dedup._classes(df)
    assert "line" not in classes.columns
    assert sorted(len(r["hashes"]) for r in classes.collect()) == [1, 2, 2]
    sets = line_dedup._with_sets(classes, line_dedup._levels(classes.localCheckpoint()), 0.8)
    rows = sets.collect()
    assert sorted(len(set(r["set"])) for r in rows) == sorted(r["n"] for r in rows) == [1, 2, 2]
    assert len({tuple(r["set"]) for r in rows}) == 2  # two lines of the same tokens


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_line_dedup_maps_pass_similar_sets(spark, threshold):
    """Of sizes around the one from which sets have the second half of a map."""
    import random

    rng, rows = random.Random(7), []
    p, q = line_dedup._ratio(threshold)
    edge = 8 * (p + q) // (q - p)
    for k in range(120):
        n = max(1, edge + rng.randint(-6, 6))
        m = rng.randint(int(n * threshold) + 1, n)
        one = [rng.randrange(-(2**63), 2**63) for _ in range(n)]
        rows.append((k, one, one[:m]))  # a part of the first is as similar as its size says
    df = spark.createDataFrame(rows, "id long, one array<long>, two array<long>")
    levels = F.expr(f"array({', '.join(['0L'] * (line_dedup.BUCKETS // 16))})")
    a, b = (line_dedup._with_sets(df.select("id", F.col(c).alias("hashes")), levels, threshold).alias(t) for c, t in (("one", "a"), ("two", "b")))
    wide = a.join(b, "id").select(F.col("a.m1") != 0, F.col("b.m1") != 0, line_dedup._maps_fit("a", "b", threshold)).collect()
    assert all(r[2] for r in wide) and len(wide) == 120
    assert {True, False} <= {r[0] for r in wide}  # sets of both kinds were there


# ---- 4


def test_hosts_and_paths(spark):
    urls = ["http://A.Com/x?y#z", "https://Ünï.É.com?q", "x://", None, "no scheme", "http://h#f/g", "http://h/p#f?q", "a://b://c/d", ""]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    h, p = url_rules.host_and_path("url")
    got = [tuple(r) for r in df.select(h.alias("h"), p.alias("p")).collect()]
    assert got == [("a.com", "/x"), ("Ünï.É.com", ""), ("", ""), ("", ""), ("", ""), ("h", ""), ("h", "/p"), ("b:", "//c/d"), ("", "")]


def slow_fixed(host, path):
    best = None
    for say, rule in queries.URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (say, rule)
    return best


def test_urls_against_brute_force(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    more = spark.createDataFrame([(9001, None, None), (9002, "http://www.example.com/en/x", None), (9003, "http://example.com/en/", ""), (9004, "http://com", ""), (9004, "http://com", ""), (9005, "", ""), (None, "http://b.net/es/1", "")], "page_id long, url string, html string")
    out = url_rules.judge(pages.unionByName(more).withColumn("rule", F.lit("x")), queries.URL_RULES).collect()
    assert len(out) == pages.count() + 7
    for r in out:
        best = slow_fixed(r["host"], r["path"])
        assert r["rule"] == (best and best[1])
        assert r["verdict"] in (("allow", "block") if best is None else (best[0],))
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in out if (r["page_id"] or 9999) > 9000} == {(9001, None, "allow"), (9002, "www.example.com/en/", "allow"), (9003, "example.com/en/", "block"), (9004, None, "allow"), (9005, None, "allow"), (None, "net/es/", "block")} or {r["verdict"] for r in out if r["page_id"] == 9004} <= {"allow", "block"}


def slow_rules(rows, least_support, least_confidence, least_rows, least_lift):
    """{(tokens, verdict): (confidence, support)} by trying every set of tokens that occurs."""
    n, share = len(rows), {}
    for _, v in rows:
        share[v] = share.get(v, 0) + 1 / len(rows)
    sets = {frozenset(c) for t, _ in rows for k in range(1, len(t) + 1) for c in itertools.combinations(t, k)}
    found = {}
    for s in sets:
        hits = [v for t, v in rows if s <= set(t)]
        for v in share:
            both = hits.count(v)
            if both >= least_rows and both / n >= least_support - 1e-12 and both / len(hits) >= least_confidence - 1e-12 and both / len(hits) / share[v] >= least_lift - 1e-9:
                found[s, v] = (both / len(hits), both / n)
    return {k: x for k, x in found.items() if not any(o < k[0] and v == k[1] and y[0] >= x[0] for (o, v), y in found.items())}


def test_rules_against_a_plain_miner(spark):
    import random

    rng = random.Random(8)
    rows = []
    for _ in range(300):
        t = sorted({f"t{min(int(rng.expovariate(0.5)), 9)}" for _ in range(rng.randint(1, 5))})
        bad = ("t0" in t and "t3" in t) or "t7" in t
        rows.append((t, "block" if (rng.random() < 0.95) == bad else "allow"))
    how = {"least_support": 0.02, "least_confidence": 0.75, "least_rows": 4, "least_lift": 1.1}
    rules = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), **how).collect()
    want = slow_rules(rows, **how)
    assert {(frozenset(r["tokens"]), r["verdict"]): (round(r["confidence"], 9), round(r["support"], 9)) for r in rules} == {k: (round(c, 9), round(s, 9)) for k, (c, s) in want.items()} and len(want) > 5
    # and what they say of URLs, seen and unseen
    asked = [sorted(rng.sample([f"t{i}" for i in range(10)], rng.randint(0, 6))) for _ in range(100)]
    urls = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(asked)], "url string, tokens array<string>")
    learned = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), **how)
    got = {r["url"]: r["learned"] for r in url_rules.match(urls, learned).collect()}
    for i, t in enumerate(asked):
        hits = sorted((-round(c, 9), -round(s, 9), " ".join(sorted(k)), v) for (k, v), (c, s) in want.items() if k <= set(t))
        assert got[f"u{i}"] == (hits[0][3] if hits else None)


def test_mined_rules_and_their_match(spark):
    rows = [(["a", "b"], "block")] * 8 + [(["a"], "allow")] * 8 + [(["c", "d"], "block")] * 4 + [(["c"], "block")] * 4 + [(["e"], "allow")] * 2 + [(["e"], "block")] * 2
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    rules = url_rules.mine(labelled, 0.05, 0.8, 1)
    got = {(r["rule"], r["verdict"], round(r["confidence"], 3)) for r in rules.collect()}
    assert got == {("b", "block", 1.0), ("c", "block", 1.0), ("d", "block", 1.0)}  # what a part says as surely is not said again
    assert url_rules.mine(labelled, 0.05, 0.8, 5).count() == 2 and url_rules.mine(labelled, 0.05, 0.8, 1, 1.6).count() == 0
    urls = spark.createDataFrame([("u1", ["a", "b"]), ("u2", ["e"]), ("u3", []), ("u4", ["x", "c"])], "url string, tokens array<string>")
    assert {r["url"]: r["learned"] for r in url_rules.match(urls, rules).collect()} == {"u1": "block", "u2": None, "u3": None, "u4": "block"}


def test_tokens_of_urls(spark):
    long = "http://x.com/" + "a/" * 5000 + "?" + "&".join(f"p{i}=v" for i in range(5000))
    df = spark.createDataFrame([("http://www.x.com/en/a//b.html?q=1&r&=2&q=1#f",), ("http://x.com",), (None,), (long,)], "url string")
    h, p = url_rules.host_and_path("url")
    got = [r["t"] for r in df.select("url", h.alias("host"), p.alias("path")).select(url_rules.tokens("url").alias("t")).collect()]
    assert got[0] == ["ending:html", "fragment", "host:com", "host:www", "host:x", "path:a", "path:b.html", "path:en", "query:q", "query:q=1", "query:r"]
    assert got[1] == ["host:com", "host:x"] and got[2] is None or got[2] == [] and len(got[3]) == 10_003
    assert url_rules.judge(df.withColumn("page_id", F.lit(1)), queries.URL_RULES).count() == 4


def test_urls_of_nothing(spark):
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0
    only = spark.createDataFrame([(1, "http://x.org/a")], "page_id long, url string")
    assert [r["verdict"] for r in url_rules.judge(only, queries.URL_RULES).collect()] == ["allow"]


# ---- 5


def test_order_minhash_neighbours(spark):
    df = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    got = sorted(((r["doc_id"] is None, -(r["doc_id"] or 0), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["near_next"]) for r in order_minhash.compare_with_next(df).collect()))
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        e = order_minhash.edited(t, nxt)
        a, b = order_minhash.fingerprint(t), order_minhash.fingerprint(nxt)
        want.append((i is None, -(i or 0), len(t), hashlib.sha256(e.encode()).hexdigest(), order_minhash.text_of(a), order_minhash.likeness(a, b)))
    assert got == sorted(want)
    assert order_minhash.edited("abcdefg", "x") == "abcdex"


def test_order_minhash_over_the_table(spark, docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_order_minhash"](spark, DIR).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        assert got[i]["edited_sha256"] == hashlib.sha256(order_minhash.edited(t, nxt).encode()).hexdigest()
        assert got[i]["near_edited"] == order_minhash.likeness(order_minhash.fingerprint(t), order_minhash.fingerprint(order_minhash.edited(t, nxt)))


def test_order_minhash_of_one_and_none(spark):
    one = spark.createDataFrame([(3, "alone in the world")], "doc_id long, text string")
    assert [(r["n_chars"], r["near_next"]) for r in order_minhash.compare_with_next(one).collect()] == [(18, 1.0)]
    assert order_minhash.compare_with_next(one.limit(0)).count() == 0


# ---- 6


def test_records_round_trip(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    df = awkward(spark)
    files = tokens.write(df, path, 2, folder=str(tmp_path / "t"))
    got = sorted(tuple(r) for r in tokens.read(spark, files).select("start", "n_tokens", "ids_crc32", "doc_id").collect())
    rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    coder, start, want = tokens.Encoder(path), 0, []
    for i, t in rows:
        ids = [*coder.tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want.append((start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), i))
        start += len(ids)
    assert got == want
    last = files[-1]
    assert [len(t) for _, t in tokens.read_at(last["path"], [last["records"] - 1, 0])][0] == want[-1][1]
    assert tokens.write(df.limit(0), path, 2, folder=str(tmp_path / "e")) == [] and tokens.read(spark, []).count() == 0


# ---- 7


def slow_components(fps):
    fps = list(fps)
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    groups = {}
    for i, a in enumerate(fps):
        groups.setdefault(find(i), set()).add(a)
    return {frozenset(g) for g in groups.values()}


def test_links_of_families(spark):
    import random

    rng, fps = random.Random(8), set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for bit in rng.sample(range(64), rng.randint(0, 7)):
                x ^= 1 << bit
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(50)} | {0, 15, 255, 4095}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for tables in (2, 3):
        groups = {}
        for r in simhash.linked(df, 4, tables).collect():
            groups.setdefault(r["label"], set()).add(r["node"] % 2**64)
        assert {frozenset(g) for g in groups.values()} == slow_components(fps)


def test_simhash_over_the_table(spark, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_simhash_near_dedup"](spark, DIR).collect()}
    fps = {i: int(r["fingerprint"], 16) for i, r in got.items()}
    assert len(got) == docs.count()
    for group in slow_components(set(fps.values())):
        members = [i for i, f in fps.items() if f in group]
        assert {got[i]["component_id"] for i in members} == {min(members)}


def test_simhash_broadcasts_little(spark, docs, monkeypatch):
    """Tables that grow with the input are not sent to the driver for joins, though the session would allow it."""
    from lakepipe.llm import components

    limits = []
    for module in (simhash, components):

        def written(df, what="table", before=module.written):
            if what not in ("fingerprints", "classes"):  # no joins there
                limits.append(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
            return before(df, what)

        monkeypatch.setattr(module, "written", written)
    was = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    out = simhash.groups(docs)
    assert was > 1 << 20 and len(limits) > 4 and max(limits) <= 1 << 20
    assert spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() == was
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_simhash_awkward(spark):
    df = awkward(spark)
    got = [(r["doc_id"], r["component_id"]) for r in simhash.groups(df).collect()]
    assert len(got) == df.count()
    assert {(i, c) for i, c in got if i in (1, 2, 3, 4, 5)} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None)[:2] == [1, 4] and len(ids) == len({*ids}) and None in ids
    assert simhash.keep_first(df.limit(0)).count() == 0


# ---- 8


def test_packing_of_documents(spark):
    rows = [(1, 0), (2, None), (3, 20_000), (4, 5), (4, 5), (None, 7), (5, 8192), (6, 8193)] + [(100 + i, 300) for i in range(500)]
    out = packing.pack(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, size long, bin_id int").repartition(4)).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in out if r["bin_id"] is None) == [(1, 0), (2, 0)]
    bins = {}
    for r in out:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["size"]
        assert {r["bin_capacity"] for r in rs} == {min(c for c in packing.CAPACITIES if c >= at)}
    sizes = {}
    for r in out:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["size"]
    assert sizes[3] == 20_000 and sizes[6] == 8193 and sizes[4] == 10 and sum(sizes.values()) == sum(n or 0 for _, n in rows)
    assert [(r["piece"], r["start"], r["size"]) for r in sorted((r for r in out if r["doc_id"] == 3), key=lambda r: r["piece"])] == [(0, 0, 8192), (1, 8192, 8192), (2, 16384, 3616)]
    assert packing.pack(spark.createDataFrame([], "doc_id long, size long")).count() == 0


# ---- 9


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_quality_classifier"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    right = [got[i]["predicted"] == q for i, q in labels.items() if i in got and got[i]["held_out"]]
    assert len(right) > 50 and np.mean(right) >= 0.95


def test_quality_awkward(spark):
    df = awkward(spark).withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (6, None, 0), (99, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(df, labels)
    assert out.count() == df.count() and set(out.columns) == {*df.columns, "predicted"}
    model = quality.learn(df, labels)
    assert model.accepted(df).columns == df.columns and model.accepted(df).count() == out.where("predicted = 1").count()
    none = quality.classify(df, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and {r["predicted"] for r in none} == {1}
    assert quality.classify(df.limit(0), labels).count() == 0


def test_column_and_rules_agree(spark, docs):
    model = quality.learn(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    for r in model.score(docs).select("text", "score").limit(50).collect():
        s = dict(zip(quality.STATISTICS, quality.statistics(r["text"].encode()), strict=True))
        z = model.intercept + sum(x.weight for x in model.rules if all((s[f] <= b) == low for f, b, low in x.conditions))
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-9


# ---- 10


def test_mix_of_the_table(spark, docs):
    rows = queries.QUERIES["op10_source_mixing"](spark, "/root/testdata/sf0.01").collect()
    again = queries.QUERIES["op10_source_mixing"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(rows) == sorted(again)
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = source[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    want = mixing.targets(sizes, mixing.cyclic_weights(list(sizes)), sum(sizes.values()))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - want[s]) <= max(100, 0.03 * want[s])


def slow_choice(rows, want):
    """Which (h, id) a quota takes, of rows (h, id, size), one for each key."""
    taken, gap = set(), want
    while fits := sorted((h, i, n) for h, i, n in rows if (h, i) not in taken and n <= gap):
        for h, i, n in fits:
            if n > gap:
                break
            taken.add((h, i))
            gap -= n
    left = sorted((n, h, i) for h, i, n in rows if (h, i) not in taken)
    if gap and left and left[0][0] - gap < gap:
        taken.add(left[0][1:])
    return taken


def test_mix_chooses_the_documents_that_a_plain_one_does(spark):
    import random

    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 7, 40, 300, 3000]))), rng.choice(["a", "a", "a", "b", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    h = {r["doc_id"]: r["h"] for r in df.select("doc_id", mixing._hashed(17, F.col("doc_id"), F.col("text")).alias("h")).collect()}
    size = {i: len(t.split()) for i, t, _ in rows}
    of = {s: sum(size[i] for i, _, x in rows if x == s) for s in ("a", "b", None)}
    goal = mixing.targets(of, mixing.cyclic_weights(list(of)), sum(of.values()))
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(df).report().collect()}
    for s in of:
        whole, rest = divmod(round(goal[s]), of[s])
        more = slow_choice([(h[i], i, size[i]) for i, _, x in rows if x == s and size[i]], rest)
        for i, _, x in rows:
            if x == s:
                assert got[i] == size[i] * (whole + ((h[i], i) in more)), (s, i)


def test_mix_awkward(spark):
    df = awkward(spark).withColumn("whole", F.lit(1))
    m = mixing.mix(df)
    rows = m.report().collect()
    assert len(rows) == df.count()
    chosen = m.select(df)
    assert chosen.columns == df.columns
    # the selection is what the report says
    words = sum(len((r["text"] or "").encode().split()) for r in chosen.collect())
    assert words == sum(r["taken"] for r in rows)
    assert mixing.mix(df.limit(0)).report().count() == 0


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b", None]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    out = mixing.mix(df, sources=F.col("sources")).report().collect()
    assert len(out) == 90 and sum(r["taken"] for r in out) == pytest.approx(900, abs=60)


def test_mix_goes_past_long_documents(spark, monkeypatch):
    """Small documents fill the quota whatever long one lies at the cut; what is collected changes nothing."""
    rows = [(i, "w " * 100, "a") for i in range(1000)] + [(5000, "w " * 200_000, "a"), (5001, "w " * 15_000, "a")]
    rows += [(6000 + i, "w " * 300, "b") for i in range(500)]
    rows += [(7000, "x " * 50, "a"), (7000, "x " * 50, "a"), (None, "y " * 40, "a"), (None, "z " * 60, "b"), (7000, "x " * 50, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for seed in range(3):
        found = []
        for most in (20_000, 0):
            monkeypatch.setattr(mixing, "COLLECTED", most, raising=False)
            m = mixing.mix(df, weights=lambda s: {"a": 0.2, "b": 0.8}, seed=seed)
            out = m.report().collect()
            chosen = m.select(df).collect()
            assert sum(len(r["text"].split()) for r in chosen) == sum(r["taken"] for r in out)
            found.append(sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["source_size"], r["taken"]) for r in out))
            for target in {r["target"] for r in out}:
                assert sum(r["taken"] for r in out if r["target"] == target) == pytest.approx(target, abs=150)
        assert found[0] == found[1]
