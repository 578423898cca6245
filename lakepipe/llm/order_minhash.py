"""Document fingerprints by order min-hash.

Every run of ``k`` code points (k-mer) gets the number of its earlier occurrences, so repeats count. The hashes of these
numbered k-mers are dealt to ``slots`` ranges; in each range the ``keep`` least are selected, put back in the order in which
they stand in the text, and hashed together. Two texts share a slot's value only if they share those k-mers in that order,
so the share of equal slots falls with edit distance: moving a passage changes it as removing one does.

This is the one-permutation form: one hash is dealt to all slots, in place of an order of its own for each, and slots that get
fewer k-mers than ``keep`` are not filled up. Texts of up to about 100 code points have slots of no or one k-mer, so that
order counts for little there; from about 400 on it counts as in the other form.

Defined results: a null text counts as empty. Texts shorter than k have one k-mer, themselves; an empty text has none, and
all its slots are empty. Slots empty in both texts do not count; two texts without any slots are alike (1). Neighbours are
taken in descending order of the id, null ids last, rows of one id in order of text; a lone document is its own neighbour.
No rows: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepipe.llm.common import partitions, range_buckets

K, SLOTS, KEEP = 8, 64, 2

_BASE = 0x9E3779B97F4A7C15 | 1


_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x5851F42D4C957F2D)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers whose high bits depend on all others."""
    x = x * _A
    x ^= x >> np.uint64(32)
    x *= _B
    return x


def _kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of each run of k code points, by doubling."""
    out, width = codes + np.uint64(1), 1
    total, power = None, pow(_BASE, 1, 2**64)
    done = 0
    while k:
        if k & 1:
            if total is None:
                total, done = out, width
            else:  # what there is, then this run
                n = len(out) - done
                total = total[:n] * np.uint64(power) + out[done : done + n]
                done += width
        k >>= 1
        if k:
            out = out[:-width] * np.uint64(power) + out[width:]
            width *= 2
            power = pow(_BASE, width, 2**64)
    return total


@lru_cache
def _edges(slots: int) -> np.ndarray:
    """The least hash of each slot, and one for the end."""
    return np.array([(i << 64) // slots for i in range(slots)] + [2**64 - 1], dtype=np.uint64)


def fingerprint(text: str, k: int = K, slots: int = SLOTS, keep: int = KEEP) -> np.ndarray:
    """``slots`` numbers of 32 bits; 0 is an empty slot."""
    out = np.zeros(slots, dtype=np.uint32)
    if not text:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    kmers = _mixed(_kmers(codes, min(k, len(codes))))
    n = len(kmers)
    place = np.uint64(max(1, (n - 1).bit_length()))
    low = (np.uint64(1) << place) - np.uint64(1)
    index = np.arange(n, dtype=np.uint64)
    # equal k-mers next to each other, in text order: hash above, position below
    by = kmers & ~low
    by |= index
    by.sort()
    high = by >> place
    same = np.flatnonzero(high[1:] == high[:-1]) + 1
    numbered = kmers
    if len(same):
        # places in runs of equal k-mers: how far each stands behind the first of its run
        gap = np.empty(len(same), dtype=bool)
        gap[0] = True
        np.not_equal(same[1:], same[:-1] + 1, out=gap[1:])
        run = np.flatnonzero(gap)
        nth = np.arange(len(same)) - np.repeat(run, np.diff(np.append(run, len(same)))) + 1
        pos = (by[same] & low).astype(np.int64)
        numbered = kmers.copy()
        numbered[pos] += nth.astype(np.uint64) * np.uint64(_BASE)
    ranked = _mixed(numbered ^ _C)
    ranked &= ~low
    ranked |= index
    ranked.sort()
    starts = np.searchsorted(ranked, _edges(slots))
    starts[-1] = n
    take = np.minimum(starts[:-1, None] + np.arange(keep), starts[1:, None])  # the slot's end stands for none
    none = take >= starts[1:, None]
    at = np.where(none, n, (ranked[np.minimum(take, n - 1)] & low).astype(np.int64))
    at.sort(axis=1)  # text order, none last
    value = np.zeros(slots, dtype=np.uint64)
    for j in range(keep):
        found = numbered[np.minimum(at[:, j], n - 1)]
        value = _mixed((value ^ (value >> np.uint64(29))) * np.uint64(_BASE) + np.where(at[:, j] < n, found, np.uint64(j + 1)))
    out = (value >> np.uint64(32)).astype(np.uint32)
    out[out == 0] = 1
    out[starts[:-1] == starts[1:]] = 0
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    used = (a != 0) | (b != 0)
    return float(((a == b) & used).sum() / used.sum()) if used.any() else 1.0


def text_of(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _neighbours(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (bucket, key, doc_id, text) so that a bucket's partition holds, in order, its documents and then (``extra``) the
    one that follows its last."""
    n = partitions(docs.sparkSession)
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    bucket = range_buckets(docs, F.col(doc_id).cast("long"), n)
    ends = docs.select(bucket.alias("b"), key.alias("k")).groupBy("b").agg(F.max("k").alias("k")).collect()
    order = sorted((r["b"], r["k"]) for r in ends)
    # the first document of a range follows the last one of the range above, and the very first the very last
    targets = {order[i][1]: order[(i + 1) % len(order)][0] for i in range(len(order))}
    firsts, goes = np.array(sorted(targets), dtype=np.int64), np.array([targets[k] for k in sorted(targets)], dtype=np.int32)

    @F.arrow_udf("int")
    def also(k: pa.Array) -> pa.Array:
        x = k.to_numpy(zero_copy_only=False)
        at = np.searchsorted(firsts, x).clip(0, max(0, len(firsts) - 1))
        hit = firsts[at] == x if len(firsts) else np.zeros(len(x), bool)
        return pa.array(goes[at] if len(firsts) else np.zeros(len(x), np.int32), pa.int32(), mask=~hit)

    rows = docs.select(bucket.alias("bucket"), also(key).alias("also"), key.alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    both = F.when(F.col("also").isNull(), F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra")), F.struct(F.col("also").alias("bucket"), F.lit(1).alias("extra")))
    )
    placed = rows.select(F.explode(both).alias("x"), "key", "doc_id", "text").select("x.bucket", "x.extra", "key", "doc_id", "text")
    return placed.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "extra", F.desc("key"), "text")


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document, its fingerprint, that of its edited text, and how alike they and the next document's are."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # id, text, values
        ended = -1  # the bucket whose extra row has been seen
        for b in batches:
            out = []
            for bucket, extra, i, t in zip(b.column("bucket").to_pylist(), b.column("extra").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if bucket == ended:
                    continue
                t = t or ""
                values = fingerprint(t)
                if last is not None:
                    j, s, own = last
                    new = edited(s, t)
                    other = own if new == s else fingerprint(new)
                    out.append((j, len(s), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), text_of(own), text_of(other), likeness(own, other), likeness(own, values)))
                last = (i, t, values)
                if extra:
                    ended, last = bucket, None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f) for c, f in enumerate((b.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return _neighbours(docs, doc_id, text).mapInArrow(run, schema)
