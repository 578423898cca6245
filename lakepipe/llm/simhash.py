"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit for each position at which over half the hashes of its word shingles have one. Fingerprints
within ``distance`` bits are linked, and documents are grouped by the links.

Search (multi-index hashing): a fingerprint is cut into segments, each with a table of its own. If two fingerprints differ
in at most ``distance`` bits, they differ by no more than a small radius in one of the segments; so each fingerprint looks
up, segment by segment, every value of that small Hamming ball, and complete distances are verified for what it meets.

Only different fingerprints take part, copies being one row from the start. In a table entry that many share, all first
measure against one of them, and what that links is contracted; then only fingerprints of different groups still meet
there. So no link is lost that could join groups, and a large group of near copies costs a few rows for each copy.

Defined results: null and empty texts have fingerprint zero and link like any other. A row without an id never names a group
that has one; a group without any id has a null name. For keep_first() such rows come after all others, in order of a hash of
the text. No rows: no rows. Other columns pass through keep_first().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepipe.llm.common import dropped, identified, payloads, small_broadcasts, written
from lakepipe.llm.components import components

SEED = 42


def shingle_hashes(text: bytes | None, width: int) -> bytes:
    """XXH64 of the shingles, 8 bytes each, most significant first."""
    words = text.lower().split() if text else []
    if not words:
        return b""
    if len(words) <= width:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: -width]]]
    digest = xxhash.xxh64_digest
    return b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)])


def majority(raw: bytes) -> int:
    """The fingerprint of hashes of 8 bytes each, most significant first; 0 for none."""
    n = len(raw) // 8
    if n <= 1:
        return int.from_bytes(raw, "big")
    sums = np.zeros(64, dtype=np.int64)
    bits = np.frombuffer(raw, dtype=np.uint8)
    for at in range(0, n, 65_536):  # bounds what a very long text takes
        sums += np.unpackbits(bits[at * 8 : (at + 65_536) * 8]).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def fingerprints(texts: list[bytes | None], width: int = 4) -> np.ndarray:
    """As unsigned 64-bit numbers; 0 for texts without words."""
    return np.array([majority(shingle_hashes(t, width)) for t in texts], dtype=np.uint64)


def fingerprint(text: Column | str, width: int = 4) -> Column:
    """As a signed 64-bit number."""

    @F.arrow_udf("bigint")
    def of(column: pa.Array) -> pa.Array:
        return pa.array(fingerprints(payloads(column), width).view(np.int64))

    return of(text)


def segments(tables: int, distance: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each: with distance = tables * r + a, the first a + 1 need radius r, the others r - 1."""
    r, a = divmod(distance, tables)
    bits = [64 // tables + (i < 64 % tables) for i in range(tables)]
    return [(sum(bits[i + 1 :]), b, r if i <= a else r - 1) for i, b in enumerate(bits) if (r if i <= a else r - 1) >= 0]


def ball(bits: int, radius: int) -> list[int]:
    """Every number of that many bits with up to ``radius`` ones."""
    found, last = [0], [(0, 0)]
    for _ in range(radius):
        last = [(x | 1 << b, b + 1) for x, least in last for b in range(least, bits)]
        found += [x for x, _ in last]
    return found


def _looked_up(rows: DataFrame, cut: list[tuple[int, int, int]], balls: bool) -> DataFrame:
    """A row with t and key for each table entry that ``fp`` is in, or for each that it looks up."""
    masks = [(t, s, (1 << b) - 1, m) for t, (s, b, r) in enumerate(cut) for m in ball(b, r if balls else 0)]
    values = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).alias("shift"), F.lit(w).cast("long").alias("whole"), F.lit(m).cast("long").alias("mask")) for t, s, w, m in masks])
    key = F.expr("(shiftrightunsigned(fp, shift) & whole) ^ mask").alias("key")
    return rows.select("*", F.explode(values).alias("x")).select(*rows.columns, "x.*").select("t", key, *rows.columns)


def _near(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def meetings(rows: DataFrame, distance: int = 4, tables: int = 3) -> DataFrame:
    """``rows``: h, of which each has one row, and a fingerprint fp. Pairs (u, v) of h within ``distance`` bits: each row with
    the one that stands for a table entry it looks up, for every such entry; so they are in proportion to the rows."""
    cut = segments(tables, distance)
    stands = _looked_up(rows, cut, False).groupBy("t", "key").agg(F.min(F.struct("h", "fp")).alias("p")).select("t", "key", F.col("p.h").alias("v"), F.col("p.fp").alias("fp2"))
    met = _looked_up(rows, cut, True).join(stands, ["t", "key"]).where((F.col("h") != F.col("v")) & _near("fp", "fp2", distance))
    return met.select(F.col("h").alias("u"), "v")


def linked(fps: DataFrame, distance: int = 4, tables: int | None = None) -> DataFrame:
    """``fps``: a column fp of different fingerprints. Gives (node, label), the label being the same for
    those that links join."""
    with small_broadcasts(fps.sparkSession):
        return _linked(fps, distance, tables)


def _linked(fps: DataFrame, distance: int, tables: int | None) -> DataFrame:
    if tables is None:  # segments of about as many bits as there are fingerprints in a logarithm; either finds the same links
        tables = 3 if fps.count() <= 1 << 22 else 2
    cut = segments(tables, distance)

    # all that meet in an entry against one of it
    pivots = _looked_up(fps, cut, False).groupBy("t", "key").agg(F.min("fp").alias("pivot"))
    found = _looked_up(fps, cut, True).join(pivots, ["t", "key"]).where((F.col("fp") != F.col("pivot")) & _near("fp", "pivot", distance))
    one = components(found.select(F.col("fp").alias("u"), F.col("pivot").alias("v")))

    # then groups against each other; an entry of one group has nothing more to tell that group
    named = written(fps.join(one.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")), "named")
    there = _looked_up(named, cut, False)
    closed = there.groupBy("t", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"))
    closed = closed.where((F.col("lo") == F.col("hi")) & (F.col("n") >= 16)).select(F.col("t").alias("ct"), F.col("key").alias("ckey"), "lo")
    asking = _looked_up(named, cut, True)
    # the label is compared in a form that is no key of the join, so that both joins are dealt alike
    asking = asking.join(closed, (asking["t"] == closed["ct"]) & (asking["key"] == closed["ckey"]) & (F.col("label").bitwiseXOR(F.col("lo")) == 0), "left_anti")
    there = there.select("t", "key", F.col("fp").alias("fp2"), F.col("label").alias("label2"))
    pairs = asking.join(there, ["t", "key"]).where((F.col("label") != F.col("label2")) & _near("fp", "fp2", distance))
    two = components(pairs.select(F.col("label").alias("u"), F.col("label2").alias("v")))
    out = named.join(two.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select(F.col("fp").alias("node"), F.coalesce("top", "label").alias("label"))
    out = written(out, "linked")
    dropped(named)
    return out


def groups(docs: DataFrame, distance: int = 4, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, fp, component_id (the smallest id of its group)."""
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(docs[text], width).alias("fp")), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    links = linked(classes.select("fp"), distance)
    named = classes.join(links.withColumnRenamed("node", "fp"), "fp")
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    with small_broadcasts(docs.sparkSession):
        found = written(named.join(least, "label").select("fp", "component_id"), "groups")
    dropped(classes, links)
    return rows.join(found.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, distance: int = 4, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: that with the smallest id."""
    keyed, key, th = identified(docs, doc_id, text)
    rows = written(keyed.select(F.col(key).alias("key"), F.col(th).alias("th"), fingerprint(F.col(f"`{text}`"), width).alias("fp")), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min(F.struct("key", "th")).alias("at")), "classes")
    links = linked(classes.select("fp"), distance)
    kept = classes.join(links.withColumnRenamed("node", "fp"), "fp").groupBy("label").agg(F.min("at").alias("at"))
    with small_broadcasts(docs.sparkSession):
        kept = written(kept.select(F.col("at.key").alias(key), F.col("at.th").alias(th)), "kept")
    dropped(rows, classes, links)
    return keyed.join(kept.hint("shuffle_hash"), [key, th], "left_semi").dropDuplicates([key, th]).drop(key, th)
