"""Mixing sources to target weights by min-cost flow.

Documents are summed by the set of sources they belong to (their membership pattern). A flow on the driver, over patterns
and sources only, routes each pattern's words to the quotas of its sources; a pattern's first reading is free and each
further one costs more (a convex cost), so words are repeated only where quotas need it. Then each pattern takes whole
documents: all of them as often as its flow has whole readings, and for the rest documents in the order of a seeded hash, up
to the one that would pass the goal. Then again, of the documents that are left, those no larger than the gap, until none is;
and one more if its excess is less than what is missing. A document is taken if one of these cuts takes it, so what travels
is a row for each cut. What is collected is bounded by the number of patterns and COLLECTED, never by that of documents.

Defined results: a text that is null or has no words is never taken; a null source is a source of its own, after all
others; a null id is an id. Rows with one id and text are taken or left together. No rows: no rows. Other columns of
whatever name pass through.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakepipe.llm.common import dropped, small, word_count, written

#: Bits of the hash that one round of the search for a cut looks at, and rounds.
CUT_BITS, CUT_ROUNDS = 10, 2
#: Documents that the search for what fills the last gaps may collect, once no more are left; with more it goes on in Spark,
#: to the same result.
COLLECTED = 20_000
#: Above all hashes.
END = 1 << 62


def cyclic_weights(sources: list, weights=(5, 2, 1)) -> dict:
    """Sources in code point order, null last, with the weights in turn."""
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}


def targets(sizes: dict, weights: dict, total: float, most: float = 3.0) -> dict:
    """``total`` shared by weight, none above ``most`` times its size; what is cut off is shared again among the rest."""
    found, free, left = {}, [s for s in sizes], float(total)
    while free:
        unit = left / sum(weights[s] for s in free) if sum(weights[s] for s in free) else 0.0
        over = [s for s in free if weights[s] * unit > most * sizes[s]]
        if not over:
            return found | {s: weights[s] * unit for s in free}
        for s in over:
            found[s] = most * sizes[s]
            left -= found[s]
            free.remove(s)
    return found


def route(capacity: dict, quota: dict, most: int = 3, price=lambda reading: (reading - 1) ** 2) -> dict:
    """Words that each pattern gives to each of its sources: ``{(pattern, source): words}``.

    A pattern is a tuple of sources and gives up to ``most`` times its capacity, at ``price(reading)`` a word.
    Successive cheapest paths (Dijkstra with potentials): the flow is as large as can be, and of the least cost then.
    """
    nodes: dict = {"start": 0, "end": 1}
    edges: list[list] = []  # to, room, cost, and the twin edge at i ^ 1
    out: list[list[int]] = [[], []]

    def node(x):
        if x not in nodes:
            nodes[x] = len(nodes)
            out.append([])
        return nodes[x]

    def edge(a, b, room, cost):
        out[a].append(len(edges))
        edges.append([b, room, cost])
        out[b].append(len(edges))
        edges.append([a, 0, -cost])
        return len(edges) - 2

    flows = {}
    for p, size in capacity.items():
        for reading in range(1, most + 1):
            edge(0, node(("p", p)), size, price(reading))
        for s in p:
            flows[p, s] = edge(node(("p", p)), node(("s", s)), most * size, 0)
    for s, q in quota.items():
        edge(node(("s", s)), 1, q, 0)
    potential = [0.0] * len(nodes)
    while True:
        far, via = [float("inf")] * len(nodes), [-1] * len(nodes)
        far[0], heap = 0.0, [(0.0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for i in out[a]:
                b, room, cost = edges[i]
                if room > 0 and far[b] > (new := d + cost + potential[a] - potential[b]) + 1e-12:
                    far[b], via[b] = new, i
                    heapq.heappush(heap, (new, b))
        if via[1] < 0:
            break
        for x, d in enumerate(far):
            if d < float("inf"):
                potential[x] += d
        path, at = [], 1
        while at:
            path.append(via[at])
            at = edges[via[at] ^ 1][0]
        push = min(edges[i][1] for i in path)
        for i in path:
            edges[i][1] -= push
            edges[i ^ 1][1] += push
    return {k: edges[i ^ 1][1] for k, i in flows.items()}


def _cut(rows: DataFrame, wanted: list[tuple[int, int]]) -> dict[int, tuple]:
    """For each pattern ``p`` whose documents pass a sum: up to which (hash, id) they are taken, whether the hash itself
    belongs to them, and what is left of the sum.

    ``rows``: p, h, doc_id, size, one for each key. The hash's leading bits are summed, the group in which the sum passes
    the goal is split by the next bits, and only rows of the last such group are looked at one by one.
    """
    spark = rows.sparkSession
    cut, shift = [(p, n, 0) for p, n in wanted], 62
    upto = Window.partitionBy("p").rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(CUT_ROUNDS):
        here = rows.join(small(spark, cut, "p long, want long, prefix long"), "p").where(F.shiftrightunsigned("h", shift) == F.col("prefix"))
        shift -= CUT_BITS
        sums = here.groupBy("p", F.shiftrightunsigned("h", shift).alias("next")).agg(F.sum("size").alias("n"), F.first("want").alias("want"))
        sums = sums.withColumn("upto", F.sum("n").over(upto.orderBy("next"))).where(F.col("upto") > F.col("want"))
        found = sums.groupBy("p").agg(F.min(F.struct("next", (F.col("want") - F.col("upto") + F.col("n")).alias("want"))).alias("x"))
        cut = [(r["p"], r["x"]["want"], r["x"]["next"]) for r in found.collect()]
    last = rows.join(small(spark, cut, "p long, want long, prefix long"), "p").where(F.shiftrightunsigned("h", shift) == F.col("prefix"))
    last = last.withColumn("upto", F.sum("size").over(upto.orderBy("h", "doc_id"))).where(F.col("upto") <= F.col("want"))
    ends = {r["p"]: r for r in last.groupBy("p").agg(F.max("upto").alias("got"), F.max(F.struct("h", "doc_id")).alias("key")).collect()}
    # without such a row the cut is just before the group
    return {p: (ends[p]["key"]["h"], ends[p]["key"]["doc_id"], True, want - ends[p]["got"]) if p in ends else (prefix << shift, None, False, want) for p, want, prefix in cut}


def finish(found: list[tuple], gap: int) -> tuple[list[tuple], int]:
    """The cuts (most, h, id, tie) of (h, id, size) in order, and the gap they leave: what fits, and again what then fits."""
    cuts = []
    while found := [x for x in found if x[2] <= gap]:
        most, n = gap, 0
        for _, _, size in found:
            if size > gap:
                break
            gap, n = gap - size, n + 1
        cuts.append((most, *found[n - 1][:2], True))
        found = found[n:]
    return cuts, gap


def _cuts(rows: DataFrame, wanted: list[tuple[int, int]]) -> dict[int, tuple[list, list]]:
    """For each pattern the cuts (most, h, id, tie), and the one document (h, id) over the sum that comes nearer to it.

    A document of size up to ``most`` is taken up to (h, id); with ``tie`` unset, up to before the hash.
    """
    spark, kind = rows.sparkSession, rows.schema["doc_id"].dataType.simpleString()
    cuts: dict = {p: [] for p, _ in wanted}
    gaps = dict(wanted)
    table = lambda found: small(spark, found, f"p long, gap long, cuts {_cut_type(kind)}")
    left = written(rows.join(table([(p, n, []) for p, n in gaps.items()]), "p").where("size <= gap").select("p", "h", "doc_id", "size"), "left")
    while True:
        sums = {r["p"]: r for r in left.groupBy("p").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
        if sum(r["rows"] for r in sums.values()) <= COLLECTED:
            break
        new = {}
        for p, r in sums.items():
            if r["n"] <= gaps[p]:
                new[p] = (END, None, False, gaps[p] - r["n"])
        new |= _cut(left, [(p, gaps[p]) for p in sums if p not in new])
        for p, (h, i, tie, gap) in new.items():
            cuts[p].append((gaps[p], h, i, tie))
            gaps[p] = gap
        rest = left.join(table([(p, gaps[p], cuts[p][-1:]) for p in new]), "p").where(~_within("h", "doc_id", "size") & (F.col("size") <= F.col("gap")))
        rest = written(rest.select("p", "h", "doc_id", "size"), "left")
        dropped(left)
        left = rest
    found: dict = {}
    for r in left.orderBy("p", "h", "doc_id").collect():
        found.setdefault(r["p"], []).append((r["h"], r["doc_id"], r["size"]))
    dropped(left)
    for p, xs in found.items():
        more, gaps[p] = finish(xs, gaps[p])
        cuts[p] += more
    # nothing that is left fits
    open_ = [(p, gap, cuts[p]) for p, gap in gaps.items() if gap]
    last = rows.join(table(open_), "p").where(~_within("h", "doc_id", "size")).groupBy("p", "gap").agg(F.min(F.struct("size", "h", "doc_id")).alias("x"))
    over = {r["p"]: [(r["x"]["h"], r["x"]["doc_id"])] for r in last.collect() if r["x"]["size"] - r["gap"] < r["gap"]} if open_ else {}
    return {p: (cuts[p], over.get(p, [])) for p in cuts}


def _cut_type(kind: str) -> str:
    return f"array<struct<most:long,h:long,id:{kind},tie:boolean>>"


def _within(h: str, doc_id: str, size: str) -> Column:
    """Whether one of ``cuts`` takes it; a null id comes before all others."""
    i = F.col(doc_id)

    def takes(c: Column) -> Column:
        tie = c["tie"] & (i.isNull() | F.coalesce(i <= c["id"], F.lit(False)))
        return (F.col(size) <= c["most"]) & ((F.col(h) < c["h"]) | ((F.col(h) == c["h"]) & tie))

    return F.coalesce(F.exists("cuts", takes), F.lit(False))


@dataclass
class Mix:
    """What was decided. ``sizes``: a written table of id, words, pattern and hash; ``table``: a row for each pattern;
    ``repeats``: words of the rows of one id and text together, where there are several."""

    sizes: DataFrame
    table: DataFrame
    seed: int
    repeats: DataFrame | None = None

    def _with_total(self, rows: DataFrame, pattern: str, h: str, doc_id: str, size: Column) -> DataFrame:
        """Adds ``__total``, the size that cuts go by."""
        if self.repeats is None:
            return rows.withColumn("__total", size)
        again = self.repeats.select(F.col("pattern").alias("__rp"), F.col("h").alias("__rh"), F.col("doc_id").alias("__rid"), F.col("size").alias("__rn"))
        rows = rows.join(again, (F.col(pattern) == F.col("__rp")) & (F.col(h) == F.col("__rh")) & F.col(doc_id).eqNullSafe(F.col("__rid")), "left")
        return rows.withColumn("__total", F.coalesce("__rn", size))

    def _copies(self, h: str, doc_id: str) -> Column:
        more = F.exists("more", lambda x: (x["h"] == F.col(h)) & x["id"].eqNullSafe(F.col(doc_id)))
        return F.col("whole") + F.when(_within(h, doc_id, "__total") | F.coalesce(more, F.lit(False)), 1).otherwise(0)

    def report(self) -> DataFrame:
        """A row for each document: doc_id, size, source_size, target, taken."""
        rows = self._with_total(self.sizes, "pattern", "h", "doc_id", F.col("size")).join(self.table, "pattern")
        return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * self._copies("h", "doc_id")).alias("taken"))

    def select(self, docs: DataFrame, sources: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """The mix itself: the columns of ``docs``, a row as often as its document is taken."""
        own = {"__h": _hashed(self.seed, F.col(doc_id), F.col(text)), "__pattern": F.to_json(_members(sources), {"ignoreNullFields": "false"}), "__size": word_count(F.col(text)), "__id": F.col(doc_id)}
        # the documents' columns under numbers, so that none clashes with those here
        rows = docs.select(*[c.alias(k) for k, c in own.items()], *[docs[f"`{c}`"].alias(f"__doc{i}") for i, c in enumerate(docs.columns)])
        table = self.table.select(*[F.col(c) if c != "pattern" else F.col(c).alias("__pattern") for c in self.table.columns if c in ("pattern", "whole", "cuts", "more")])
        rows = self._with_total(rows.where("__size > 0"), "__pattern", "__h", "__id", F.col("__size")).join(table, "__pattern")
        rows = rows.withColumn("__n", F.explode(F.array_repeat(F.lit(1), self._copies("__h", "__id").cast("int"))))
        return rows.select(*[F.col(f"__doc{i}").alias(c) for i, c in enumerate(docs.columns)])


def _members(sources: Column | None) -> Column:
    return F.array_sort(F.array_distinct(sources)) if sources is not None else F.array(F.col("source"))


def _hashed(seed: int, doc_id: Column, text: Column) -> Column:
    """62 bits, so that shifts and comparisons stay among positive numbers; the text tells rows of one id apart."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 2)


def mix(docs: DataFrame, sources: Column | None = None, weights=cyclic_weights, most: int = 3, seed: int = 17, doc_id: str = "doc_id", text: str = "text") -> Mix:
    """``sources``: an array column, for documents of several sources; without it each has the one in ``source``.

    ``source_size`` and ``target`` of a document are those of its sources together. ``weights``: a function of the list of
    sources. All words together are shared, and no document is taken more than ``most`` times.
    """
    spark, member = docs.sparkSession, _members(sources)
    rows = docs.select(F.col(doc_id).alias("doc_id"), word_count(docs[text]).alias("size"), F.to_json(member, {"ignoreNullFields": "false"}).alias("pattern"), member.alias("members"), _hashed(seed, F.col(doc_id), F.col(text)).alias("h"))
    rows = written(rows, "mix")
    patterns = rows.groupBy("pattern").agg(F.first("members").alias("m"), F.sum("size").alias("size")).orderBy("pattern").collect()
    capacity = {tuple(r["m"]): int(r["size"]) for r in patterns}
    sizes: dict = {}
    for p, n in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    goal = targets(sizes, weights(list(sizes)), sum(capacity.values()), most)
    flow = route(capacity, {s: round(q) for s, q in goal.items()}, most)
    want = [sum(flow[tuple(r["m"]), s] for s in r["m"]) for r in patterns]
    whole = [n // r["size"] if r["size"] else 0 for n, r in zip(want, patterns, strict=True)]
    rest = [n - k * r["size"] for n, k, r in zip(want, whole, patterns, strict=True)]
    cuts, repeats = {}, None
    if any(rest):
        numbered = small(spark, [(i, r["pattern"]) for i, r in enumerate(patterns)], "p long, pattern string")
        keyed = rows.where("size > 0").join(numbered, "pattern").groupBy("p", "h", "doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
        keyed = written(keyed, "keyed")
        cuts = _cuts(keyed, [(i, n) for i, n in enumerate(rest) if n])
        several = keyed.where("rows > 1")
        repeats = None if several.isEmpty() else several.join(numbered, "p").select("pattern", "h", "doc_id", "size")
    kind = rows.schema["doc_id"].dataType.simpleString()
    table = [
        (r["pattern"], sum(sizes[s] for s in r["m"]), float(sum(goal[s] for s in r["m"])), whole[i], *cuts.get(i, ([], [])))
        for i, r in enumerate(patterns)
    ]
    table = small(spark, table, f"pattern string, source_size long, target double, whole long, cuts {_cut_type(kind)}, more array<struct<h:long,id:{kind}>>")
    return Mix(rows, table, seed, repeats)
