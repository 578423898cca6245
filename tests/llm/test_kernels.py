"""What needs no Spark."""

import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lakepipe.llm import ann, mixing, order_minhash, packing, quality, simhash, tokens, warc


def test_simhash_by_the_letter():
    def slow(text):
        words = [w for w in text.encode().lower().replace(b"\x1c", b"\x1c").split()]
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    texts = ["", "  \n", "one", "One  TWO", "a b c d", "É É é b c", "x y " * 500, "\x85 a\x0bb\x0cc\td e f"]
    assert simhash.fingerprints([t.encode() for t in texts] + [None]).tolist() == [slow(t) for t in texts] + [0]


@pytest.mark.parametrize("tables", [2, 3, 4, 5])
def test_balls_meet_whatever_is_near(tables):
    rng = random.Random(tables)
    cut = simhash.segments(tables, 4)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        assert any(((a ^ b) >> s & (1 << n) - 1).bit_count() <= r for s, n, r in cut)
    assert len(simhash.ball(21, 2)) == 1 + 21 + 210


def test_order_minhash_slots():
    a = "the quick brown fox jumps over the lazy dog, again and again and again. " * 4
    same = order_minhash.fingerprint(a)
    assert np.array_equal(same, order_minhash.fingerprint(a))
    assert order_minhash.likeness(same, order_minhash.fingerprint(a[:-1])) > 0.5
    assert not order_minhash.fingerprint("").any()
    assert order_minhash.likeness(order_minhash.fingerprint(""), order_minhash.fingerprint("")) == 1
    assert order_minhash.likeness(order_minhash.fingerprint("short"), order_minhash.fingerprint("")) == 0
    assert order_minhash.fingerprint("é").any() and order_minhash.fingerprint("😀" * 30).any()


def test_order_minhash_against_a_plain_one():
    def slow(text, k=8, slots=64, keep=2):
        codes = [ord(c) for c in text]
        k = min(k, len(codes))
        m64 = 2**64 - 1
        mix = lambda x: ((lambda y: (y ^ y >> 32) * 0x94D049BB133111EB & m64)(x * 0xBF58476D1CE4E5B9 & m64))
        base = 0x9E3779B97F4A7C15
        raw = []
        for i in range(len(codes) - k + 1):
            h = 0
            for c in codes[i : i + k]:
                h = (h * base + c + 1) & m64
            raw.append(mix(h))
        n = len(raw)
        low = (1 << max(1, (n - 1).bit_length())) - 1
        seen, numbered = {}, []
        for h in raw:
            nth = seen.get(h & ~low, 0)
            seen[h & ~low] = nth + 1
            numbered.append((h + nth * base) & m64)
        out = []
        ranked = sorted((mix(h ^ 0x5851F42D4C957F2D) & ~low | i, i) for i, h in enumerate(numbered))
        for s in range(slots):
            lo, hi = (s << 64) // slots, ((s + 1) << 64) // slots
            got = sorted(i for key, i in [x for x in ranked if lo <= x[0] < hi][:keep])
            value = 0
            for j in range(keep):
                value = mix(((value ^ value >> 29) * base + (numbered[got[j]] if j < len(got) else j + 1)) & m64)
            out.append((max(1, value >> 32)) if got else 0)
        return out

    rng = random.Random(3)
    for text in ["a", "abcdefg", "abcdefgh", "ab" * 100, "".join(rng.choice("abcé ") for _ in range(700)), "word " * 90]:
        assert order_minhash.fingerprint(text).tolist() == slow(text)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_packing_plan(histogram):
    capacities = (8, 16, 64)
    p = packing.plan(histogram, capacities)
    size = np.concatenate([np.full(n, s) for s, n in histogram.items()] or [np.zeros(0, int)]).astype(np.int64)
    rank = np.concatenate([np.arange(n) for n in histogram.values()] or [np.zeros(0, int)]).astype(np.int64)
    if not len(size):
        assert p.n_bins == 0
        return
    bins, offset, capacity = p.place(size, rank)
    assert set(bins) == set(range(p.n_bins))
    for b in set(bins):
        mine = sorted(zip(offset[bins == b], size[bins == b], strict=True))
        at = 0
        for o, s in mine:  # next to each other, without a gap
            assert o == at
            at += s
        cap = set(capacity[bins == b])
        assert cap == {min(c for c in capacities if c >= at)}


def test_packing_is_tight():
    rng = random.Random(1)
    histogram = {}
    for _ in range(20_000):
        s = min(8192, max(1, int(rng.lognormvariate(6, 1))))
        histogram[s] = histogram.get(s, 0) + 1
    p = packing.plan(histogram)
    used = sum(s * n for s, n in histogram.items())
    size = np.repeat(np.array(list(histogram)), list(histogram.values()))
    rank = np.concatenate([np.arange(n) for n in histogram.values()])
    bins, _, capacity = p.place(size, rank)
    total = sum({b: c for b, c in zip(bins.tolist(), capacity.tolist(), strict=True)}.values())
    assert used / total > 0.98


def naive_best_fit(pieces, capacities, cost):
    """[(contents, capacity)] of bins, by best-fit decreasing, one piece at a time; each bin shrinks in the end."""
    pieces, bins = sorted(pieces, reverse=True), []
    for i, s in enumerate(pieces):
        fits = [(c - sum(b), k) for k, (b, c) in enumerate(bins) if c - sum(b) >= s]
        if fits:
            bins[min(fits)[1]][0].append(s)
            continue
        same, waiting = pieces[i:].count(s), sum(x for x in pieces[i:] if x < s)
        best = None
        for c in capacities:
            if c >= s:
                alike = min(same, c // s) * s
                fill = min(c, alike + min(c - alike, waiting / -(-same // (c // s))))
                if best is None or cost(c) / fill < best[0] - 1e-12:
                    best = (cost(c) / fill, c)
        bins.append(([s], best[1]))
    return [min(c for c in capacities if c >= sum(b)) for b, _ in bins]


def optimum(pieces, capacities, cost):
    """The least cost of all ways to share the pieces out."""
    best = [float("inf")]

    def go(i, bins):
        if i == len(pieces):
            best[0] = min(best[0], sum(cost(min(c for c in capacities if c >= b)) for b in bins))
            return
        for k, b in enumerate(bins):
            if b + pieces[i] <= capacities[-1]:
                go(i + 1, [*bins[:k], b + pieces[i], *bins[k + 1 :]])
        go(i + 1, [*bins, pieces[i]])

    go(0, [])
    return best[0]


def planned(pieces, capacities, cost):
    histogram = {s: pieces.count(s) for s in pieces}
    p = packing.plan(histogram, capacities, cost)
    size = np.repeat(np.array(list(histogram)), list(histogram.values()))
    rank = np.concatenate([np.arange(n) for n in histogram.values()])
    bins, _, capacity = p.place(size, rank)
    return list(dict(zip(bins.tolist(), capacity.tolist(), strict=True)).values())


def test_packing_against_a_naive_one():
    rng = random.Random(6)
    cost = packing.bin_cost
    worse = []
    for _ in range(40):
        capacities = tuple(sorted(rng.sample([64, 128, 256, 512, 1024], 3)))
        pieces = [min(capacities[-1], max(1, int(rng.lognormvariate(4, 1)))) for _ in range(rng.randint(1, 300))]
        ours, naive = sum(map(cost, planned(pieces, capacities, cost))), sum(map(cost, naive_best_fit(pieces, capacities, cost)))
        worse.append(ours / naive)
        assert ours <= 1.1 * naive
    assert np.mean(worse) <= 1.01


def test_packing_against_the_optimum():
    rng = random.Random(9)
    found = []
    for _ in range(60):
        capacities = (8, 16, 32)
        pieces = [rng.randint(1, 32) for _ in range(rng.randint(1, 6))]
        cost = lambda c: c + 2
        found.append(sum(map(cost, planned(pieces, capacities, cost))) / optimum(pieces, capacities, cost))
    assert min(found) >= 1 and np.mean(found) <= 1.06 and max(found) <= 1.5


def test_targets_share_what_is_cut_off():
    sizes = {"a": 10, "b": 1000, None: 990}
    got = mixing.targets(sizes, {"a": 5.0, "b": 2.0, None: 1.0}, 2000)
    assert got["a"] == 30 and abs(got["b"] - 1970 * 2 / 3) < 1e-9 and abs(sum(got.values()) - 2000) < 1e-9
    assert mixing.targets({}, {}, 0) == {}
    assert mixing.cyclic_weights([None, "b", "a", "c"]) == {"a": 5, "b": 2, "c": 1, None: 5}


def test_flow_repeats_only_where_it_must():
    flow = mixing.route({("a",): 100, ("a", "b"): 50, ("b",): 10}, {"a": 120, "b": 60}, 3)
    assert sum(v for (p, s), v in flow.items() if s == "a") == 120 and sum(v for (p, s), v in flow.items() if s == "b") == 60
    given_ = {p: sum(v for (q, _), v in flow.items() if q == p) for p in [("a",), ("a", "b"), ("b",)]}
    # 180 words of 160: 20 have to be read twice, and none three times
    assert sum(max(0, given_[p] - n) for p, n in {("a",): 100, ("a", "b"): 50, ("b",): 10}.items()) == 20
    assert all(given_[p] <= 2 * n for p, n in {("a",): 100, ("a", "b"): 50, ("b",): 10}.items())


def test_flow_cost_is_least():
    rng = random.Random(4)
    for _ in range(20):
        capacity = {("a",): rng.randint(1, 4), ("a", "b"): rng.randint(1, 4)}
        quota = {"a": rng.randint(0, 8), "b": rng.randint(0, 8)}
        flow = mixing.route(capacity, quota, 3)
        price = lambda p, n: sum((1 + i // capacity[p] - 1) ** 2 for i in range(n))
        total = lambda f: (f[("a",), "a"] + f[("a", "b"), "a"] + f[("a", "b"), "b"], -price(("a",), f[("a",), "a"]) - price(("a", "b"), f[("a", "b"), "a"] + f[("a", "b"), "b"]))
        best = max(
            total({(("a",), "a"): x, (("a", "b"), "a"): y, (("a", "b"), "b"): z})
            for x in range(3 * capacity[("a",)] + 1) for y in range(3 * capacity[("a", "b")] + 1) for z in range(3 * capacity[("a", "b")] + 1)
            if x + y <= quota["a"] and z <= quota["b"] and y + z <= 3 * capacity[("a", "b")]
        )
        assert total(flow) == best


def test_chunks_and_segments():
    assert warc.dechunk(b"4;x=1\r\nWiki\r\n5\r\npedia\r\n0\r\nA: b\r\n\r\n") == b"Wikipedia"
    for bad in (b"", b"zz\r\n", b"5\r\nab", b"3\r\nabcX"):
        with pytest.raises(ValueError):
            warc.dechunk(bad)
    parts = [(2, 5, b"lo"), (1, None, b"hel")]
    assert warc.joined(parts) == (b"hello", 1) and warc.joined(parts * 2) == (b"hello", 2)
    for bad in ([(1, None, b"hel"), (3, 5, b"lo")], [(1, None, b"hel"), (2, 9, b"lo")], [(1, None, b"hel"), (1, None, b"xxx"), (2, 5, b"lo"), (2, 5, b"lo")]):
        with pytest.raises(ValueError):
            warc.joined(bad)
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\n\r\nbody") == b"body"


def test_frames():
    import io

    raw = tokens.frame(b"abc") + tokens.frame(b"")
    stream = io.BytesIO(raw)
    assert tokens.read_frame(stream) == b"abc" and tokens.read_frame(stream) == b"" and tokens.read_frame(stream) is None
    for at in range(len(tokens.frame(b"abc"))):
        broken = bytearray(tokens.frame(b"abc"))
        broken[at] ^= 1
        with pytest.raises(ValueError):
            tokens.read_frame(io.BytesIO(bytes(broken)))
    assert tokens.masked(b"x") == ((zlib.crc32(b"x") >> 15 | zlib.crc32(b"x") << 17) + 0xA282EAD8) & 0xFFFFFFFF
    doc_id, ids = tokens.parse(tokens.payload_of(None, struct.pack("<3H", 1, 2, 3), 2))
    assert doc_id is None and ids.tolist() == [1, 2, 3]


@pytest.fixture(scope="module")
def coder():
    public = pytest.importorskip("public_tokenizers")
    return tokens.Encoder(public.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab .,\n\t'é1ß\xa0😀") | st.characters(codec="utf-8"), max_size=60), max_size=8))
def test_ids_are_the_library_s(coder, texts):
    want = [np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, dtype=coder.kind).tobytes() for t in texts]
    assert coder.encode(texts) == want


def test_ids_of_odd_texts(coder):
    texts = ["a <|endoftext|> b", "a  b", "\na\n\nb\n", " a", "a.b, c's", "x.. y.,", "1.", "é. .", "a\xa0b. c", "don't. won't,", "", "word " * 3000, "one. Two,\nthree. <|endoftext|>"]
    assert coder.encode(texts) == [np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, dtype=coder.kind).tobytes() for t in texts]


def test_quantiser_estimates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = ann.Quantiser.fit(x, n_books=6, n_words=64)
    codes = q.encode(x)
    assert ((q.decode(codes) - x) ** 2).sum(1).mean() < 0.2
    guess = ann.estimate(q.tables(x[:5]), codes, np.ones(len(x), np.float32))
    assert np.allclose(guess, q.decode(codes) @ x[:5].T, atol=1e-4)
    worse = ((q.decode(q.encode(x, beam=1)) - x) ** 2).sum()
    assert ((q.decode(codes) - x) ** 2).sum() <= worse


def test_rules_of_a_plain_case():
    rng = np.random.default_rng(0)
    x = np.zeros((1000, len(quality.STATISTICS)))
    x[:, 4], x[:, 6] = rng.random(1000), rng.random(1000)
    y = ((x[:, 4] < 0.5) & (x[:, 6] < 0.7)).astype(int)
    model = quality.fit(x, y)

    def score(row):
        z = model.intercept + sum(r.weight for r in model.rules if all((row[quality.STATISTICS.index(f)] <= b) == low for f, b, low in r.conditions))
        return z > 0

    assert np.mean([score(r) == bool(v) for r, v in zip(x, y, strict=True)]) > 0.97
    assert quality.fit(x[:0], y[:0]).rules == () and quality.fit(x[:5], np.ones(5)).intercept > 0


def test_lasso_is_at_its_least():
    """The conditions that only the least of the penalised loss fulfils."""
    rng = np.random.default_rng(1)
    x = (rng.random((400, 12)) < 0.4).astype(np.float32)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1.5 * x[:, 3] + 0.3)))).astype(np.float32)
    weigh = (rng.random(400) < 0.8).astype(np.float32)
    for penalty in (0.05, 0.01, 0.001):
        w, b = quality._lasso(x, y, weigh, penalty, steps=5000)
        r = (1 / (1 + np.exp(-(b + x @ w))) - y) * weigh / weigh.sum()
        slope = x.T @ r
        assert abs(r.sum()) < 2e-3
        assert np.all(np.abs(slope[w == 0]) <= penalty + 2e-3) and np.allclose(slope[w != 0], -np.sign(w[w != 0]) * penalty, atol=2e-3)
    assert (quality._lasso(x, y, weigh, 0.05, steps=5000)[0] != 0).sum() < (quality._lasso(x, y, weigh, 0.001, steps=5000)[0] != 0).sum()


def test_first_split_is_the_purest():
    """A tree's first split against trying every one."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        bins, y = rng.integers(0, 6, (60, 3)), (rng.random(60) < 0.4).astype(float)
        weight = rng.random(60) + 0.5

        def impurity(rows):
            p, n = (weight * y)[rows].sum(), weight[rows].sum()
            return p * (1 - p / n)

        every = {(f, at): impurity(bins[:, f] <= at) + impurity(bins[:, f] > at) for f in range(3) for at in range(5) if min((bins[:, f] <= at).sum(), (bins[:, f] > at).sum()) >= 4}
        found: set = set()
        quality._grow(bins, y, weight, np.arange(3), 7, 1, (), found, 4)
        splits = {p[0][:2] for p in found}
        assert len(splits) == 1 and abs(every[splits.pop()] - min(every.values())) < 1e-9


def test_rules_on_rows_not_seen():
    """Two rules over statistics, with noise: found again, whatever the order of the rows."""
    rng = np.random.default_rng(3)
    at = {s: i for i, s in enumerate(quality.STATISTICS)}
    x = rng.random((900, len(at)))
    y = ~((x[:, at["symbol"]] > 0.7) | ((x[:, at["upper"]] > 0.6) & (x[:, at["stop"]] <= 0.4)))
    y ^= rng.random(900) < 0.02
    for order in (np.arange(600), rng.permutation(600)):
        model = quality.fit(x[order], y[order])
        z = np.full(300, model.intercept)
        for r in model.rules:
            hit = np.ones(300, dtype=bool)
            for f, bound, low in r.conditions:
                hit &= (x[600:, at[f]] <= bound) == low
            z += r.weight * hit
        assert np.mean((z >= 0) == y[600:]) >= 0.93


def test_shortlists_hold_the_best_estimates():
    rng = np.random.default_rng(7)
    tables, codes = rng.normal(size=(4, 16, 300)).astype(np.float32), rng.integers(0, 16, (1500, 4)).astype(np.intp)
    scale = rng.random(1500).astype(np.float32) * np.where(rng.random(1500) < 0.3, -1, 1).astype(np.float32)
    q, r = ann._shortlist(tables, codes, scale, 20)
    guess = ann.estimate(tables, codes, scale)
    for i in range(300):
        mine, order = r[q == i], np.lexsort((np.arange(1500), -guess[:, i]))[:20]
        assert len(mine) == 20 and np.array_equal(np.sort(guess[mine, i]), np.sort(guess[order, i]))
    q, r = ann._shortlist(tables, codes[:7], scale[:7], 20)
    assert len(q) == 7 * 300 and set(r) == set(range(7))
